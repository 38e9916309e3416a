"""Directed fuzzy neighbour graphs: memberships from local scales, unions, epochs, spectral starts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anisomap.operators.spectral import leading, upright
from anisomap.storage import written


def _candidates(pairs: DataFrame, k: int) -> DataFrame:
    """Pairs (src, dst, d) that can be among the k least of their source, so that of dense tables few are shuffled.

    A source's targets are dealt to 4 k parts by hash; the k-th of the parts' minima, which tasks gather, is a bound.
    Sources with fewer parts keep all.
    """
    part = F.pmod(F.xxhash64("dst"), F.lit(4 * k)).alias("part")
    least = pairs.groupBy("src", part).agg(F.min("d").alias("m"))
    bound = least.groupBy("src").agg(F.get(F.sort_array(F.collect_list("m")), F.lit(k - 1)).alias("_most"))
    return pairs.join(F.broadcast(bound), "src").where("_most is null or d <= _most").drop("_most")


def directed_knn(dissim: DataFrame, k: int) -> DataFrame:
    """knn(src, rank, dst, dist): the k smallest finite outgoing dissimilarities with non-zero weight."""
    ok = dissim.where("src <> dst and d is not null and not isnan(d) and abs(d) < double('infinity')")
    if "w" in dissim.columns:
        ok = ok.where("w <> 0")
    place = F.row_number().over(Window.partitionBy("src").orderBy("d", "dst"))
    return _candidates(ok, k).withColumn("rank", place).where(F.col("rank") <= k).select("src", "rank", "dst", F.col("d").alias("dist"))


#: Bisection steps, tolerance, and the share of the mean distance below which no scale goes.
STEPS, TOLERANCE, LEAST_SCALE = 64, 1e-5, 1e-3


def smooth_scales(knn: DataFrame, k: int, local_connectivity: float = 1.0, bandwidth: float = 1.0) -> DataFrame:
    """(id, rho, sigma): distance to the (interpolated) local_connectivity-th positive neighbour, and the scale at which
    the memberships sum to log2(k) bandwidth. The bisection is a fold over the array of a point's at most k distances."""
    wanted = float(np.log2(k) * bandwidth)
    lists = knn.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dist")).alias("ds"))
    overall = knn.agg(F.avg("dist").alias("overall"))
    positive = F.filter("ds", lambda x: x > 0)
    whole, part = int(np.floor(local_connectivity)), local_connectivity - np.floor(local_connectivity)
    at = lambda i: F.get(F.col("pos"), F.lit(i))
    if whole > 0:
        rho = F.when(F.size("pos") >= whole, at(whole - 1) + (part * (F.coalesce(at(whole), at(whole - 1)) - at(whole - 1)) if part > TOLERANCE else 0.0))
        rho = F.coalesce(rho, F.array_max("pos"), F.lit(0.0))
    else:
        rho = F.coalesce(part * at(0), F.lit(0.0))
    rows = lists.withColumn("pos", positive).withColumn("rho", rho)

    def mass(sigma: Column) -> Column:
        return F.aggregate("ds", F.lit(0.0), lambda s, d: s + F.when(d - F.col("rho") > 0, F.exp(-(d - F.col("rho")) / sigma)).otherwise(1.0))

    infinite = F.lit(float("inf"))
    start = F.struct(F.lit(0.0).alias("lo"), infinite.alias("hi"), F.lit(1.0).alias("mid"), F.lit(False).alias("done"))

    def step(state: Column, _: Column) -> Column:
        value = mass(state["mid"])
        stop = state["done"] | (F.abs(value - wanted) < TOLERANCE)
        high = value > wanted
        lo, hi = F.when(high, state["lo"]).otherwise(state["mid"]), F.when(high, state["mid"]).otherwise(state["hi"])
        mid = F.when(hi == infinite, state["mid"] * 2).otherwise((lo + hi) / 2)
        keep = lambda old, new: F.when(stop, old).otherwise(new)
        return F.struct(keep(state["lo"], lo).alias("lo"), keep(state["hi"], hi).alias("hi"), keep(state["mid"], mid).alias("mid"), stop.alias("done"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)["mid"]
    mean = F.try_divide(F.aggregate("ds", F.lit(0.0), lambda s, d: s + d), F.size("ds"))
    floor = LEAST_SCALE * F.when(F.col("rho") > 0, mean).otherwise(F.col("overall"))
    return rows.join(F.broadcast(overall)).select("id", "rho", F.greatest(found, floor).alias("sigma"))


def support_edges(knn: DataFrame, dissim: DataFrame, symmetric: bool = False) -> DataFrame:
    """(src, dst, d): neighbour edges, with their reverses where those have a dissimilarity, looked up per direction."""
    if not symmetric:
        return knn.select("src", "dst", F.col("dist").alias("d"))
    edges = knn.select("src", "dst")
    edges = edges.unionByName(knn.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return edges.join(dissim.select("src", "dst", "d"), ["src", "dst"])


def membership(edges: DataFrame, scales: DataFrame, symmetric: bool = True) -> DataFrame:
    """(src, dst, p) with p = exp(-max(0, d - rho) / sigma); ends' scales combined by mean and harmonic mean, or the source's."""
    e = edges.join(scales.select(F.col("id").alias("src"), F.col("rho").alias("r1"), F.col("sigma").alias("s1")), "src")
    rho, sigma = F.col("r1"), F.col("s1")
    if symmetric:
        e = e.join(scales.select(F.col("id").alias("dst"), F.col("rho").alias("r2"), F.col("sigma").alias("s2")), "dst")
        rho, sigma = (rho + F.col("r2")) / 2, F.try_divide(2 * sigma * F.col("s2"), sigma + F.col("s2"))
    return e.select("src", "dst", F.exp(-F.greatest(F.lit(0.0), F.col("d") - rho) / sigma).alias("p"))


def directed_fuzzy_graph(dissim: DataFrame, k: int = 50, local_connectivity: float = 1.0, symmetric_scales: bool = True, symmetric_support: bool = False) -> DataFrame:
    """(src, dst, p): neighbours, scales, support and memberships, times the weights if there are any; zeros go."""
    # Scales and support read the neighbours, which come from all pairs, several times.
    knn = written(directed_knn(dissim, k), "knn")
    p = membership(support_edges(knn, dissim, symmetric_support), smooth_scales(knn, k, local_connectivity), symmetric_scales)
    if "w" in dissim.columns:
        p = p.join(dissim.select("src", "dst", "w"), ["src", "dst"]).select("src", "dst", (F.col("p") * F.col("w")).alias("p"))
    return p.where("p > 0")


def fuzzy_union(p: DataFrame) -> DataFrame:
    """(src, dst, p): p + p' - p p' of both directions."""
    back = p.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("p").alias("q"))
    both = p.join(back, ["src", "dst"], "full").where("src <> dst")
    a, b = F.coalesce("p", F.lit(0.0)), F.coalesce("q", F.lit(0.0))
    return both.select("src", "dst", (a + b - a * b).alias("p"))


def epochs_per_sample(p: DataFrame, epochs: int | None = None) -> DataFrame:
    """(src, dst, p, every): largest p over p, -1 for p of at most 0; edges rarer than once in ``epochs`` go."""
    most = p.agg(F.max("p").alias("most"))
    out = p.join(F.broadcast(most)).select("src", "dst", "p", F.when(F.col("p") > 0, F.col("most") / F.when(F.col("p") > 0, F.col("p"))).otherwise(-1.0).alias("every"))
    return out if epochs is None else out.where((F.col("every") > 0) & (F.col("every") <= epochs))


#: Products (with edges that the driver holds), and numbers of the space that they span, for a spectral start.
MOST_PRODUCTS, ROOM = 5000, 1 << 22


def spectral_start(n: int, src: np.ndarray, dst: np.ndarray, p: np.ndarray, dimensions: int, seed: int = 0) -> np.ndarray:
    """Smallest non-trivial eigenvectors of the normalized Laplacian, scaled to 10 and jittered.

    They are the leading ones of the normalized adjacency, found by products with its edges: no n x n numbers are held.
    """
    low, high = np.minimum(src, dst).astype(np.int64), np.maximum(src, dst).astype(np.int64)
    keys, at = np.unique(low * n + high, return_inverse=True)
    weight = np.zeros(len(keys))
    np.maximum.at(weight, at, p)
    low, high = keys // n, keys % n
    loop = low == high
    total = np.bincount(low, weight, n) + np.bincount(high[~loop], weight[~loop], n)
    root = 1 / np.sqrt(np.maximum(total, 1e-12))
    weight = weight * root[low] * root[high]

    def product(y: np.ndarray) -> np.ndarray:
        out = y.copy()  # shifted by 1, so that all eigenvalues are at least 0
        for j in range(y.shape[1]):
            out[:, j] += np.bincount(low, weight * y[high, j], n) + np.bincount(high[~loop], (weight * y[low, j])[~loop], n)
        return out

    # Of points with copies many eigenvalues nearly are the largest one: a wide space tells them apart, a narrow one never does.
    _, vectors = leading(product, n, dimensions + 1, seed, most=MOST_PRODUCTS, width=dimensions + 6, room=int(np.clip(ROOM // max(n, 1), 96, 256)))
    y = upright(vectors[:, 1 : dimensions + 1])
    most = np.abs(y).max(initial=0)
    return y * (10 / most if most > 0 else 1) + np.random.default_rng(seed).normal(0, 1e-4, y.shape)


def curve_parameters(min_dist: float = 0.5, spread: float = 1.0) -> tuple[float, float]:
    """(a, b) of 1 / (1 + a f^(2b)) fitted to 1 below min_dist and an exponential beyond, by Gauss-Newton steps."""
    f = np.linspace(0, 3 * spread, 300)
    target = np.where(f < min_dist, 1.0, np.exp(-(f - min_dist) / spread))
    a, b, damp = 1.0, 1.0, 1e-2
    log_f = np.log(np.maximum(f, 1e-12))
    q = lambda a, b: 1 / (1 + a * np.where(f > 0, f, 0) ** (2 * b))
    error = ((q(a, b) - target) ** 2).sum()
    for _ in range(200):
        v = q(a, b)
        power = np.where(f > 0, f, 0) ** (2 * b)
        j = np.stack([-power * v * v, -2 * a * power * log_f * v * v], 1)
        move = np.linalg.solve(j.T @ j + damp * np.eye(2), j.T @ (target - v))
        new = a + move[0], b + move[1]
        if min(new) > 0 and (e := ((q(*new) - target) ** 2).sum()) < error:
            (a, b), error, damp = new, e, damp / 3
        else:
            damp *= 4
    return float(a), float(b)
