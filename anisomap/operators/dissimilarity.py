"""Transforms of sparse dissimilarities ``edges(src, dst, d)`` and pair masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anisomap.functions import vectors as V
from anisomap.operators.graph import symmetrize


def temporally_asymmetric(edges: DataFrame, times: DataFrame, weight: float, floor: float = 0.1) -> DataFrame:
    """Symmetrised d, shorter forward in time: max(floor d, d - weight (t_dst - t_src)); unchanged where a time is NULL."""
    e = symmetrize(edges)
    t = lambda end: times.select(F.col("id").alias(end), F.col("t").alias(f"t_{end}"))
    e = e.join(t("src"), "src", "left").join(t("dst"), "dst", "left")
    moved = F.greatest(F.col("d") * floor, F.col("d") - weight * (F.col("t_dst") - F.col("t_src")))
    timed = F.col("t_src").isNotNull() & F.col("t_dst").isNotNull()
    floored = timed & (F.col("d") - weight * (F.col("t_dst") - F.col("t_src")) < F.col("d") * floor)
    return e.select("src", "dst", F.when(timed, moved).otherwise(F.col("d")).alias("d"), timed.alias("timed"), floored.alias("floored"))


def temporal_info(asymmetric: DataFrame) -> DataFrame:
    n = F.count("*")
    return asymmetric.agg(n.alias("n_edges"), F.count_if("timed").alias("n_timed"), F.count_if("floored").alias("n_floored"), F.try_divide(F.count_if("floored"), F.count_if("timed")).alias("fraction_floored"))


def local_scales(edges: DataFrame) -> DataFrame:
    """(id, sigma): the largest positive distance of each row, NULL without any."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.max(F.when(F.col("d") > 0, F.col("d"))).alias("sigma"))


def density_scaled(edges: DataFrame, gamma: float = 1.0, mode: str = "symmetric") -> DataFrame:
    """d (median sigma / local)^gamma with local = sqrt(sigma_src sigma_dst), or sigma_src of the symmetrised graph."""
    if mode not in ("symmetric", "source"):
        raise ValueError("mode is symmetric or source")
    if gamma == 0:
        return edges.select("src", "dst", "d")
    if mode == "source":
        edges = symmetrize(edges)
    sigma = local_scales(edges)
    median = sigma.agg(F.percentile("sigma", F.lit(0.5)).alias("median"))
    e = edges.join(sigma.withColumnRenamed("id", "src").withColumnRenamed("sigma", "a"), "src", "left")
    e = e.join(sigma.withColumnRenamed("id", "dst").withColumnRenamed("sigma", "b"), "dst", "left").join(F.broadcast(median))
    a, b = F.coalesce("a", "median"), F.coalesce("b", "median")
    local = F.sqrt(a * b) if mode == "symmetric" else a
    return e.select("src", "dst", (F.col("d") * F.pow(F.col("median") / local, F.lit(float(gamma)))).alias("d"))


def wormhole_mask(dissim: DataFrame, border: DataFrame, points: DataFrame, drift_bound: float = 0.0, threshold: float = 0.0) -> DataFrame:
    """(src, dst, keep): whether no way through the border's straight shortcuts is shorter than d, or d is below the threshold.

    Two min-plus steps: A(i, b2) = min over b1 of d(i, b1) + (1 - bound) |x_b1 - x_b2|, then the minimum over b2 of
    A(i, b2) + d(j, b2). Both start from the pairs that are there: only border points next to a pair's ends are met.
    """
    self_rows = border.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("d"))
    to_border = dissim.select("src", "dst", "d").where("src <> dst").join(border.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "d").unionByName(self_rows)
    at = points.join(border, "id", "left_semi").select("id", "x")
    back = to_border.select(F.col("src").alias("dst"), F.col("dst").alias("b2"), F.col("d").alias("back"))
    wanted = dissim.select("src", "dst").where("src <> dst").join(back, "dst")
    needed = wanted.select("src", "b2").distinct().join(at.select(F.col("id").alias("b2"), F.col("x").alias("x2")), "b2")
    ahead = to_border.join(at.select(F.col("id").alias("dst"), F.col("x").alias("x1")), "dst").select("src", "x1", "d")
    through = needed.join(ahead, "src").groupBy("src", "b2").agg(F.min(F.col("d") + (1 - drift_bound) * V.distance("x1", "x2")).alias("a"))
    shortest = wanted.join(through, ["src", "b2"]).groupBy("src", "dst").agg(F.min(F.col("a") + F.col("back")).alias("way"))
    out = dissim.select("src", "dst", "d").join(shortest, ["src", "dst"], "left")
    return out.select("src", "dst", (F.col("way").isNull() | (F.col("way") > F.col("d")) | (F.col("d") < threshold)).alias("keep"))


def border_of_hole(knn: DataFrame, hole: DataFrame) -> DataFrame:
    """(id): points outside the hole that have a point of the hole among their neighbours."""
    return knn.join(hole.select(F.col("id").alias("dst")), "dst", "left_semi").join(hole.select(F.col("id").alias("src")), "src", "left_anti").select(F.col("src").alias("id")).distinct()


DISSIMILARITY_KINDS = {None: "none", "none": "none", "pseudotime": "pseudotime", "time": "pseudotime", "density": "density"}
SCALE_MODES = {"symmetric": "symmetric", "sym": "symmetric", "source": "source", "src": "source"}


def normalize_kind(kind: str | None) -> str:
    if kind not in DISSIMILARITY_KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    return DISSIMILARITY_KINDS[kind]


def normalize_scale_mode(mode: str) -> str:
    if mode not in SCALE_MODES:
        raise ValueError(f"unknown mode {mode!r}")
    return SCALE_MODES[mode]
