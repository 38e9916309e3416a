"""Stress objectives and gradients as relations, and the NumPy kernels that optimizers use on small pair sets.

Distributed forms take ``pairs(src, dst, d, w)`` and ``embedding(id, y)`` and aggregate partial sums before a shuffle;
kernels take arrays. Both give the same numbers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anisomap.functions import vectors as V
from anisomap.functions.metrics import Metric
from anisomap.operators.graph import with_vectors
from anisomap.storage import written


def with_lengths(pairs: DataFrame, embedding: DataFrame, metric: Metric) -> DataFrame:
    """Pairs with ``e``, the metric's length from src to dst in the embedding."""
    return with_vectors(pairs, embedding, "y").withColumn("e", metric.length_col(V.sub("b", "a"))).drop("a", "b")


def stress(measured: DataFrame) -> DataFrame:
    """One row: raw = sum w (e - d)^2, denom = sum w d^2, normalized = sqrt(raw / denom); rows without e are left out."""
    raw, denom = F.sum(F.col("w") * (F.col("e") - F.col("d")) * (F.col("e") - F.col("d"))), F.sum(F.col("w") * F.col("d") * F.col("d"))
    got = measured.where("e is not null").agg(F.count("*").alias("n_pairs"), raw.alias("raw"), denom.alias("denom"))
    return got.withColumn("normalized", F.when(F.col("denom") > 0, F.sqrt(F.col("raw") / F.when(F.col("denom") > 0, F.col("denom")))))


def hinge_stress(measured: DataFrame, margin: float = 0.5) -> DataFrame:
    """One row of the squared shortfall of e below margin d, with its own denominator sum w (margin d)^2."""
    target = margin * F.col("d")
    short = F.greatest(F.lit(0.0), target - F.col("e"))
    got = measured.where("e is not null").agg(F.sum(F.col("w") * short * short).alias("raw"), F.sum(F.col("w") * target * target).alias("denom"))
    return got.withColumn("normalized", F.when(F.col("denom") > 0, F.sqrt(F.col("raw") / F.when(F.col("denom") > 0, F.col("denom")))))


def direct_gradient(pairs: DataFrame, embedding: DataFrame, metric: Metric, normalized: bool = False) -> DataFrame:
    """(id, g): gradient of the direct stress by every point."""
    one = pairs.select("src", "dst", F.lit(1).alias("hop"), F.col("src").alias("tail"), F.col("dst").alias("head"))
    return frozen_gradient(one, pairs, embedding, metric, normalized)


def frozen_lengths(frozen: DataFrame, embedding: DataFrame, metric: Metric) -> DataFrame:
    """(src, dst, plen): lengths of frozen paths (src, dst, hop, tail, head), each distinct edge measured once."""
    edges = frozen.select("tail", "head").distinct().withColumnsRenamed({"tail": "src", "head": "dst"})
    measured = with_lengths(edges, embedding, metric).select(F.col("src").alias("tail"), F.col("dst").alias("head"), "e")
    return frozen.join(measured, ["tail", "head"]).groupBy("src", "dst").agg(F.sum("e").alias("plen"))


def frozen_stress(frozen: DataFrame, pairs: DataFrame, embedding: DataFrame, metric: Metric) -> DataFrame:
    measured = pairs.join(frozen_lengths(frozen, embedding, metric), ["src", "dst"]).withColumnRenamed("plen", "e")
    return stress(measured)


def frozen_gradient(frozen: DataFrame, pairs: DataFrame, embedding: DataFrame, metric: Metric, normalized: bool = False) -> DataFrame:
    """(id, g): reverse mode over frozen paths: pairs' residuals go to their edges, edges' gradients to their ends."""
    dimensions = V.width(embedding, "y")
    plen = frozen_lengths(frozen, embedding, metric)
    coef = pairs.join(plen, ["src", "dst"]).select("src", "dst", (2 * F.col("w") * (F.col("plen") - F.col("d"))).alias("coef"))
    adjoint = frozen.join(coef, ["src", "dst"]).groupBy("tail", "head").agg(F.sum("coef").alias("adj"))
    edges = with_vectors(adjoint.withColumnsRenamed({"tail": "src", "head": "dst"}), embedding, "y")
    pull = edges.select("src", "dst", V.scaled(metric.grad_col(V.sub("b", "a")), F.col("adj")).alias("g"))
    ends = pull.select(F.col("dst").alias("id"), "g").unionByName(pull.select(F.col("src").alias("id"), V.scaled("g", F.lit(-1.0)).alias("g")))
    total = ends.groupBy("id").agg(V.sum_vector("g", dimensions).alias("g"))
    zero = F.array_repeat(F.lit(0.0), dimensions)
    total = embedding.select("id").join(total, "id", "left").select("id", F.coalesce("g", zero).alias("g"))
    if not normalized:
        return total
    s = frozen_stress(frozen, pairs, embedding, metric).select((F.lit(0.5) / F.sqrt(F.col("raw") * F.col("denom"))).alias("f"))
    return total.join(F.broadcast(s)).select("id", V.scaled("g", F.col("f")).alias("g"))


def smacof_uniform_step(dissim: DataFrame, embedding: DataFrame, alpha: float = 0.0, weight: float = 1.0) -> DataFrame:
    """(id, y): one majorization step for equal weights over all pairs, projected to mean zero.

    Pairs that have the other direction's dissimilarity as ``back`` are read where they are made, without a shuffle.
    """
    n = embedding.count()
    dimensions = V.width(embedding, "y")
    if "back" in dissim.columns:
        both = with_vectors(dissim.where("src <> dst"), F.broadcast(embedding), "y")
    else:
        back = dissim.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("d").alias("back"))
        both = with_vectors(dissim.where("src <> dst").join(back, ["src", "dst"]), embedding, "y")
    gap = V.distance("a", "b")
    pull = weight * (F.col("d") + F.col("back")) / 2 / F.when(gap > 0, gap).otherwise(1e-5)
    moved = both.select("src", V.scaled(V.sub("a", "b"), pull).alias("r"), (F.col("d") - F.col("back")).alias("skew"))
    rows = moved.groupBy("src").agg(V.sum_vector("r", dimensions).alias("r"), F.sum("skew").alias("skew"))
    rows = rows.select("src", F.transform("r", lambda x, i: x - F.when(i == dimensions - 1, 0.5 * alpha * weight * F.col("skew")).otherwise(0.0)).alias("r"))
    mean = rows.agg(V.mean_vector("r", dimensions).alias("mean"))
    stretch = F.transform(V.sub("r", "mean"), lambda x, i: x / (n * weight * F.when(i == dimensions - 1, 1 + alpha * alpha).otherwise(1.0)))
    return rows.join(F.broadcast(mean)).select(F.col("src").alias("id"), stretch.alias("y"))


def symmetric_squares(dissim: DataFrame) -> DataFrame:
    """(src, dst, q): squares of the symmetrised dissimilarities, 0 on the diagonal where it is there.

    With the other direction's dissimilarity as ``back`` no pair is shuffled.
    """
    square = F.pow((F.col("d") + F.col("back")) / 2, F.lit(2.0))
    if "back" in dissim.columns:
        return dissim.select("src", "dst", F.when(F.col("src") == F.col("dst"), 0.0).otherwise(square).alias("q"))
    back = dissim.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("d").alias("back")).hint("merge")
    return dissim.where("src <> dst").join(back, ["src", "dst"]).select("src", "dst", square.alias("q"))


def centered_gram(dissim: DataFrame) -> DataFrame:
    """(src, dst, g): -1/2 of the doubly centred squares of the symmetrised dissimilarities, zeros on the diagonal included.

    With the other direction's dissimilarity as ``back`` no pair is shuffled: rows' means, a number a point, are broadcast.
    """
    q = symmetric_squares(dissim)
    if "back" in dissim.columns:
        mean = F.sum("q") / (F.count_if(F.col("src") != F.col("dst")) + 1)
        row = written(q.groupBy("src").agg(mean.alias("m")), "means")
        q = q.where("src <> dst").unionByName(row.select("src", F.col("src").alias("dst"), F.lit(0.0).alias("q")))
        return _centred(q, F.broadcast(row))
    ids = dissim.select(F.col("src").alias("src")).distinct()
    q = q.unionByName(ids.select("src", F.col("src").alias("dst"), F.lit(0.0).alias("q")))
    return _centred(q, q.groupBy("src").agg(F.avg("q").alias("m")))


def _centred(q: DataFrame, row: DataFrame) -> DataFrame:
    grand = row.agg(F.avg("m").alias("grand"))
    out = q.join(row, "src").join(row.select(F.col("src").alias("dst"), F.col("m").alias("m2")), "dst").join(F.broadcast(grand))
    return out.select("src", "dst", (-0.5 * (F.col("q") - F.col("m") - F.col("m2") + F.col("grand"))).alias("g"))


# NumPy kernels


class PairArrays:
    """Pairs as arrays: indices of ends, targets, weights."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, d: np.ndarray, w: np.ndarray):
        self.src, self.dst, self.d, self.w = src, dst, d, w
        self.denom = float((w * d * d).sum())

    def __len__(self) -> int:
        return len(self.d)


def direct_raw(x: np.ndarray, pairs: PairArrays, metric: Metric, margin: float | None = None) -> tuple[float, np.ndarray]:
    """Raw stress and gradient of pairs; with a margin only what is shorter than margin d counts."""
    u = x[pairs.dst] - x[pairs.src]
    length = metric.length(u)
    if not np.isfinite(length).all():
        raise ValueError("a pair lies in a forbidden direction")
    gap = length - pairs.d if margin is None else np.minimum(length - margin * pairs.d, 0)
    pull = (2 * pairs.w * gap)[:, None] * metric.grad(u)
    g = np.stack([np.bincount(pairs.dst, p, len(x)) - np.bincount(pairs.src, p, len(x)) for p in pull.T], 1) if len(pull) else np.zeros_like(x)
    return float((pairs.w * gap * gap).sum()), g


def normalize(raw: float, g: np.ndarray, denom: float) -> tuple[float, np.ndarray]:
    """sqrt(raw / denom) and its gradient."""
    if denom <= 0:
        raise ValueError("the targets have no mass")
    return float(np.sqrt(raw / denom)), g * (0.5 / np.sqrt(raw * denom)) if raw > 0 else np.zeros_like(g)
