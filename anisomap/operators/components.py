"""Connected components by alternating large-star and small-star, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anisomap.storage import drop, written_with


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the least of the node and its neighbours; repeated edges are left in."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()


def _print(edges: DataFrame, name: str = "edges") -> tuple[DataFrame, tuple]:
    return written_with(edges, name, F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))


def connected_components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, root) for every id on an edge; root is the smallest id that can be reached.

    ``edges`` has two integer columns. Loops, repeated edges and nulls do no harm; no edges give no rows. Every round
    is written to the shared folder, and the one before it deleted. Minima are taken before rows meet, so that no
    node's neighbours are gathered.
    """
    a, b = edges.columns
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now, seen = _print(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(rounds):
        if not seen[0]:
            break
        last, before = now, seen
        now, seen = _print(_small_star(_large_star(last)))
        drop(last)
        if before == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
