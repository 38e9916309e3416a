"""Selection, sampling and weighting of pairs over ``dissim(src, dst, d)``; ``pairs`` have a weight ``w`` too.

Random choices are by hashes of ids and a seed, so that they repeat at any partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anisomap.operators.quantiles import large_quantiles


def hash_order(seed: int | Column, *columns: str) -> Column:
    """A number in [0, 2^32) by integer arithmetic that other engines can repeat."""
    h = (F.lit(seed % (1 << 31)) if isinstance(seed, int) else F.pmod(seed, F.lit(1 << 31))).cast("long")
    for c in columns:
        h = F.pmod(F.pmod(h * 31 + F.col(c), F.lit(1 << 31)) * F.lit(2654435761), F.lit(1 << 32))
    return h


def allowed_pairs(dissim: DataFrame, weights: DataFrame | None = None, mask: DataFrame | None = None) -> DataFrame:
    """(src, dst, d, w): finite dissimilarities between different points, with a non-zero weight, in the mask if there is one."""
    p = dissim.select("src", "dst", "d").where("src <> dst and d is not null and not isnan(d) and abs(d) < double('infinity')")
    p = p.withColumn("w", F.lit(1.0)) if weights is None else p.join(weights.select("src", "dst", "w"), ["src", "dst"]).where("w <> 0")
    return p if mask is None else p.join(mask.select("src", "dst"), ["src", "dst"], "left_semi")


def symmetric_selection(dissim: DataFrame) -> DataFrame:
    """(src, dst, s): mean of both directions, or the one that there is."""
    back = dissim.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("d").alias("back"))
    both = dissim.select("src", "dst", "d").where("src <> dst").join(back.where("src <> dst"), ["src", "dst"], "full")
    return both.select("src", "dst", ((F.coalesce("d", "back") + F.coalesce("back", "d")) / 2).alias("s"))


def local_pairs(pairs: DataFrame, dissim: DataFrame, k: int) -> DataFrame:
    """The k allowed targets of each source with the smallest symmetrised dissimilarity."""
    ranked = pairs.join(symmetric_selection(dissim), ["src", "dst"])
    place = F.row_number().over(Window.partitionBy("src").orderBy("s", "dst"))
    return ranked.withColumn("_r", place).where(F.col("_r") <= k).drop("_r", "s")


def select_landmarks(nodes: DataFrame, n: int, seed: int = 0, random_fraction: float = 1.0, dissim: DataFrame | None = None, explicit: list[int] | None = None) -> DataFrame:
    """(id): explicit landmarks, or farthest points and a hash-random rest."""
    if explicit is not None:
        return nodes.where(F.col("id").isin(explicit)).select("id")
    if not 0 <= random_fraction <= 1:
        raise ValueError("random_fraction must be in [0, 1]")
    n_random = round(random_fraction * n)
    far = farthest_points(nodes, dissim, n - n_random, seed) if n > n_random else nodes.select("id").limit(0)
    rest = nodes.select("id").join(far, "id", "left_anti")
    return far.unionByName(rest.orderBy(hash_order(seed, "id"), "id").limit(n_random))


def farthest_points(nodes: DataFrame, dissim: DataFrame | Callable[[DataFrame], DataFrame], n: int, seed: int = 0, start: str = "random") -> DataFrame:
    """Greedy choice of ids: each is the farthest from those before, by symmetrised dissimilarity; smaller ids on ties.

    One small job a landmark: the distances to the chosen ones are kept as minima per node. ``dissim`` may be a function
    that gives the dissimilarities between points (id) and all others, both ways, so that there is no table of all pairs.
    """
    from anisomap.storage import written

    def of(c: int) -> DataFrame:
        touching = dissim(nodes.where(F.col("id") == c).select("id")) if callable(dissim) else dissim
        return symmetric_selection(touching.where((F.col("src") == c) | (F.col("dst") == c)))

    if start == "diameter":
        if callable(dissim):
            raise ValueError("the diameter is of all pairs")
        s = symmetric_selection(dissim)
        first = s.orderBy(F.desc("s"), "src", "dst").first()
        chosen = [first.src, first.dst][:n] if first else []
    else:
        chosen = [r.id for r in nodes.orderBy(hash_order(seed, "id"), "id").limit(min(1, n)).collect()]
    near = written(nodes.select("id", F.lit(float("inf")).alias("m")), "near")
    for c in chosen:
        near = _nearer(near, of(c), c)
    while 0 < len(chosen) < n:
        row = near.where(~F.col("id").isin(chosen)).orderBy(F.desc("m"), "id").first()
        if row is None:
            break
        chosen.append(row.id)
        near = written(_nearer(near, of(row.id), row.id), "near")
    return nodes.where(F.col("id").isin(chosen)).select("id")


def _nearer(near: DataFrame, s: DataFrame, landmark: int) -> DataFrame:
    to = s.where(F.col("src") == landmark).select(F.col("dst").alias("id"), "s")
    return near.join(to, "id", "left").select("id", F.least("m", F.coalesce("s", F.lit(float("inf")))).alias("m"))


def landmark_pairs(pairs: DataFrame, landmarks: DataFrame, local: DataFrame | None = None) -> DataFrame:
    """Pairs whose source is a landmark, without the local ones."""
    p = pairs.join(landmarks.select(F.col("id").alias("src")), "src", "left_semi")
    return p if local is None else p.join(local.select("src", "dst"), ["src", "dst"], "left_anti")


def sample_targets(pairs: DataFrame, m: int, seed: int | Column = 0, keys: tuple[str, ...] = ("src",)) -> DataFrame:
    """At most m targets of each source (or of other keys), weights scaled by available / m so that sums stay unbiased."""
    counts = pairs.groupBy(*keys).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(hash_order(seed, "src", "dst"), "dst"))
    kept = pairs.withColumn("_r", place).where(F.col("_r") <= m).join(counts, list(keys))
    return kept.withColumn("w", F.col("w") * F.greatest(F.lit(1.0), F.col("n") / F.lit(float(m)))).drop("_r", "n")


def merge_pairs(*groups: DataFrame) -> DataFrame:
    """All pairs of all groups, repeated ones too."""
    out = groups[0]
    for g in groups[1:]:
        out = out.unionByName(g)
    return out


def pair_totals(pairs: DataFrame) -> DataFrame:
    """One row: number of pairs and sources, sum of weights, and sum of w d^2, the stress denominator."""
    return pairs.agg(F.count("*").alias("n_pairs"), F.countDistinct("src").alias("n_sources"), F.sum("w").alias("mass"), F.sum(F.col("w") * F.col("d") * F.col("d")).alias("denom"))


def balance(local: dict | None, rest: dict, mode: str = "count", local_weight: float = 1.0) -> tuple[float, float]:
    """(factor of the others, factor of local pairs) from both groups' ``pair_totals``: scaled up to the larger mass."""
    if mode not in ("none", "count", "energy"):
        raise ValueError("mode is none, count or energy")
    column = "denom" if mode == "energy" else "mass"
    if local is None or not local["n_pairs"]:
        return 1.0, 1.0
    if mode == "none" or not rest["n_pairs"] or not local[column] or not rest[column]:
        return 1.0, float(local_weight)
    most = max(local[column], rest[column])
    return most / rest[column], local_weight * most / local[column]


def group_factors(local: DataFrame, rest: DataFrame, mode: str = "count", local_weight: float = 1.0) -> tuple[float, float]:
    return balance(*(pair_totals(g).first().asDict() for g in (local, rest)), mode, local_weight)


def reweighted(local: DataFrame, rest: DataFrame, mode: str = "count", local_weight: float = 1.0) -> DataFrame:
    """Both groups with balanced weights, and their name in ``grp``."""
    f_rest, f_local = group_factors(local, rest, mode, local_weight)
    scale = lambda g, f, name: g.select("src", "dst", "d", (F.col("w") * f).alias("w"), F.lit(name).alias("grp"))
    return scale(local, f_local, "local").unionByName(scale(rest, f_rest, "global"))


def build_pairs(
    dissim: DataFrame, weights: DataFrame | None = None, n_local: int | None = None, n_landmarks: int = 0, targets: int | None = None,
    mode: str = "count", local_weight: float = 1.0, random_fraction: float = 1.0, seed: int = 0,
) -> DataFrame:
    """Allowed pairs, or local pairs and sampled pairs of landmarks with balanced weights."""
    p = allowed_pairs(dissim, weights)
    nodes = dissim.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    rest = p if not n_landmarks else landmark_pairs(p, select_landmarks(nodes, n_landmarks, seed, random_fraction, dissim))
    local = None if not n_local else local_pairs(p, dissim, n_local)
    if local is not None:
        rest = rest.join(local.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", "d", "w")
    if targets:
        rest = sample_targets(rest, targets, seed)
    if local is None:
        return rest.select("src", "dst", "d", "w", F.lit("global").alias("grp"))
    return reweighted(local, rest.select("src", "dst", "d", "w"), mode, local_weight)


def build_turns(
    pairs: DataFrame, dissim: DataFrame, nodes: DataFrame, turns: list[int], local: DataFrame | None = None, n_landmarks: int = 0, targets: int | None = None, random_fraction: float = 1.0
) -> DataFrame:
    """(turn, src, dst, d, w): what ``build_pairs`` takes besides local pairs, for many seeds in one scan of the pairs."""
    if n_landmarks:
        marks = [select_landmarks(nodes, n_landmarks, t, random_fraction, dissim).select(F.col("id").alias("src"), F.lit(t).cast("long").alias("turn")) for t in turns]
        rest = pairs.join(merge_pairs(*marks), "src")
    else:
        rest = pairs.withColumn("turn", F.explode(F.array(*[F.lit(t).cast("long") for t in turns])))
    if local is not None:
        rest = rest.join(local.select("src", "dst"), ["src", "dst"], "left_anti")
    if targets:
        rest = sample_targets(rest, targets, F.col("turn"), ("turn", "src"))
    return rest.select("turn", "src", "dst", "d", "w")


def goals_of_turns(sampled: DataFrame, local: DataFrame | None, turns: list[int]) -> tuple[DataFrame, dict[int, dict]]:
    """Sampled pairs, and local ones if given, as a table of one row (turn, src, goals) a source; and each turn's ``pair_totals`` of sampled ones."""
    from anisomap.storage import written

    goal = lambda own: F.struct("dst", "d", "w", F.lit(own).alias("own")).alias("goal")
    rows = sampled.select("turn", "src", goal(False))
    if local is not None:
        each = F.explode(F.array(*[F.lit(t).cast("long") for t in turns])).alias("turn")
        rows = rows.unionByName(local.select(each, "src", goal(True)))
    goals = written(rows.groupBy("turn", "src").agg(F.sort_array(F.collect_list("goal")).alias("goals")).sortWithinPartitions("turn", "src"), "goals")
    others = goals.withColumn("goals", F.filter("goals", lambda g: ~g["own"]))
    total = lambda f: F.sum(F.aggregate("goals", F.lit(0.0), lambda a, g: a + f(g)))
    sums = others.groupBy("turn").agg(F.sum(F.size("goals")).alias("n_pairs"), total(lambda g: g["w"]).alias("mass"), total(lambda g: g["w"] * g["d"] * g["d"]).alias("denom"))
    return goals, {r["turn"]: r.asDict() for r in sums.collect()}


def cluster_weights(labels: DataFrame, rho: float = 0.5) -> DataFrame:
    """(id, w): (median cluster size / size)^rho; a pair weighs the product of its ends."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    median = sizes.agg(F.percentile("n", F.lit(0.5)).alias("median"))
    sizes = sizes.join(F.broadcast(median)).select("label", F.pow(F.col("median") / F.col("n"), F.lit(float(rho))).alias("w"))
    return labels.join(F.broadcast(sizes), "label").select("id", "w")


def cluster_pair_weights(pairs: DataFrame, labels: DataFrame, rho: float = 0.5) -> DataFrame:
    w = cluster_weights(labels, rho)
    a, b = w.select(F.col("id").alias("src"), F.col("w").alias("_a")), w.select(F.col("id").alias("dst"), F.col("w").alias("_b"))
    return pairs.join(a, "src").join(b, "dst").withColumn("w", F.col("w") * F.col("_a") * F.col("_b")).drop("_a", "_b").where("src <> dst")


def _active() -> Column:
    """Pairs that count: a weight that is not 0, a finite distance, different ends."""
    d = F.col("d")
    return (F.col("w") != 0) & d.isNotNull() & (F.abs(d) < F.lit(float("inf"))) & (F.col("src") != F.col("dst"))


def distance_weights(pairs: DataFrame, power: float = 1.0, epsilon: float = 1e-6) -> DataFrame:
    """w (d / median + epsilon)^-power of active pairs, with the median of their positive d; without any, w is left as it is."""
    if power < 0 or epsilon < 0:
        raise ValueError("power and epsilon are at least 0")
    if power == 0:
        return pairs
    counted = F.when(_active() & (F.col("d") > 0), F.col("d"))
    known = large_quantiles(pairs.select(counted.alias("v")), "v", [0.5])
    if known is None:
        out = pairs.join(F.broadcast(pairs.agg(F.percentile(counted, F.lit(0.5)).alias("_m"))))
    else:
        out = pairs.withColumn("_m", F.lit(known[0]))
    factor = F.pow(F.col("d") / F.col("_m") + epsilon, F.lit(-float(power)))
    return out.withColumn("w", F.when(_active() & F.col("_m").isNotNull(), F.col("w") * factor).otherwise(F.col("w"))).drop("_m")


def normalized_weights(pairs: DataFrame) -> DataFrame:
    """Weights of active pairs divided by their mean; left as they are without any, or if the mean is not above 0."""
    mean = pairs.agg(F.avg(F.when(_active(), F.col("w"))).alias("_m"))
    return pairs.join(F.broadcast(mean)).withColumn("w", F.when(_active() & (F.col("_m") > 0), F.col("w") / F.col("_m")).otherwise(F.col("w"))).drop("_m")


def frontier_weights(pairs: DataFrame, boundary: DataFrame, factor: float, symmetric: bool = True) -> DataFrame:
    """Weights of boundary pairs (cell, nbr), and of their reverses, times a factor."""
    b = boundary.select(F.col("cell").alias("src"), F.col("nbr").alias("dst"))
    if symmetric:
        b = b.unionByName(b.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    flagged = pairs.join(b.distinct().withColumn("_f", F.lit(True)), ["src", "dst"], "left")
    return flagged.withColumn("w", F.when(F.col("_f"), F.col("w") * factor).otherwise(F.col("w"))).drop("_f")


def pair_weight_pipeline(pairs: DataFrame, labels: DataFrame | None = None, rho: float = 0.0, power: float = 0.0, boundary: DataFrame | None = None, factor: float = 1.0) -> DataFrame | None:
    """Cluster, distance and frontier weights, then mean 1; None if all of them are off."""
    on = [labels is not None and rho != 0, power != 0, boundary is not None and factor != 1]
    if not any(on):
        return None
    if on[0]:
        pairs = cluster_pair_weights(pairs, labels, rho)
    if on[1]:
        pairs = distance_weights(pairs, power)
    if on[2]:
        pairs = frontier_weights(pairs, boundary, factor)
    return normalized_weights(pairs)


def validate_pairs(pairs: DataFrame) -> None:
    """Raises for negative weights and loops."""
    if not pairs.where("w < 0 or src = dst").isEmpty():
        raise ValueError("pairs need weights of at least 0 and different ends")


def initial_embedding(ids: np.ndarray, dimensions: int, seed: int | None = None, given: np.ndarray | None = None) -> np.ndarray:
    """A given start of the right shape, or uniform numbers in [0, 1)."""
    if given is not None:
        given = np.array(given, float)
        if given.shape != (len(ids), dimensions) or not np.isfinite(given).all():
            raise ValueError("the start must be finite and have one row for each point")
        return given
    return np.random.default_rng(seed).random((len(ids), dimensions))
