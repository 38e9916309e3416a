"""Exact comparison of points without all pairs of blocks: a cover of pivots whose balls rule pairs out.

Every point belongs to its nearest pivot, and a pivot's points are cut into blocks of at most ``BLOCK``. A query with a
bound on the distances it looks for needs only pivots whose ball it can reach, by the triangle inequality. Blocks of
neighbouring pivots make groups of some ``n / 8`` points, ``GROUP`` at most. What a group of queries needs is cut into
bundles of as many candidates, and a task compares a group with a bundle, leaving out the blocks that a block of queries
does not reach. So work follows what must be compared: on clustered points, or in few dimensions, far less than all
pairs; where balls all overlap, it is all pairs. A point is sent once a group at most, not once a block.

Pivots are half a sample of the points, so that dense places have more of them, and half the farthest of a sample, so that
no group of points is without. What is broadcast: at most ``PIVOTS`` pivots, and their radii and counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from anisomap.session import ship
from anisomap.storage import written, written_with

BLOCK, PIVOTS, GROUP = 4096, 8192, 32768
#: Rounding of distances that come from matrix products, as a share of the points' size.
SLACK = 1e-6


def vectors(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 1))


def rough_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0))


def fresh(rows: DataFrame) -> DataFrame:
    """The same rows as columns of their own, so that a table can be grouped together with itself."""
    return rows.select(*[F.col(c).alias(c) for c in rows.columns])


class Cover:
    """``table`` (id, x, further columns, block, grp) of all points, and what tasks have to know of the pivots."""

    def __init__(self, table: DataFrame, ids: np.ndarray, pivots: np.ndarray, radius: np.ndarray, count: np.ndarray, cuts: np.ndarray, groups: np.ndarray, group: int):
        self.table, self.ids, self.pivots, self.radius, self.count, self.cuts = table, ids, pivots, radius, count, cuts
        #: The group of each block, and about how many points a group has.
        self.groups, self.group = groups, group
        #: Blocks are numbered pivot by pivot: those of pivot j are first[j] .. first[j + 1] - 1.
        self.first = np.append(0, np.cumsum(cuts))
        self.size = float(np.sqrt((pivots * pivots).sum(1)).max(initial=0) + radius.max(initial=0))
        self.blocks = int(self.first[-1])


def _spread(x: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    """n places: half by the given order, which is as dense as the points are, the others each the farthest from all before."""
    chosen = order[: max(1, n // 2)].tolist()
    near = rough_distances(x, x[chosen]).min(1) if len(x) else np.zeros(0)
    while len(chosen) < min(n, len(x)) and near.max(initial=0) > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, np.sqrt(((x - x[chosen[-1]]) ** 2).sum(1)))
    return np.array(chosen, np.int64)


def _side_by_side(x: np.ndarray) -> np.ndarray:
    """Places in an order that keeps near points together: halves by the widest coordinate, and so on."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= 2:
            out.append(at)
            continue
        at = at[np.argsort(x[at, np.ptp(x[at], 0).argmax()], kind="stable")]
        todo += [at[len(at) // 2 :], at[: len(at) // 2]]
    return np.concatenate([np.zeros(0, np.int64), *out])


def cover(points: DataFrame, pivots: int | None = None, block: int | None = None) -> Cover:
    """The cover of ``points`` (id, x, ...): one pivot for a single block, else four times the root of their number, unless given."""
    block = block or BLOCK
    ship(points.sparkSession)
    spark = points.sparkSession
    points, (n,) = written_with(points, "points")
    wanted = pivots or (1 if n <= block else int(np.clip(round(4 * n**0.5), -(-n // block), PIVOTS)))
    sample = points.orderBy(F.xxhash64("id", F.lit(77)), "id").limit(3 * wanted).select("id", "x").toPandas()
    at, own = np.unique(vectors(sample["x"]), axis=0, return_index=True) if len(sample) else (np.zeros((0, 1)), np.zeros(0, int))
    chosen = _spread(at, np.argsort(own), wanted)
    chosen = chosen[_side_by_side(at[chosen])]
    at, ids = at[chosen], sample["id"].to_numpy(np.int64)[own[chosen]]
    held = spark.sparkContext.broadcast(at)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = held.value
        for b in batches:
            x = vectors(b["x"])
            home = rough_distances(x, p).argmin(1) if len(b) else np.zeros(0, int)
            yield b.assign(home=home.astype(np.int32), r=np.sqrt(((x - p[home]) ** 2).sum(1)) if len(b) else np.zeros(0))

    kind = StructType(list(points.schema.fields)).add("home", IntegerType()).add("r", DoubleType())
    near = written(points.mapInPandas(assign, kind), "near")
    radius, count = np.zeros(len(at)), np.zeros(len(at), np.int64)
    for r in near.groupBy("home").agg(F.max("r").alias("r"), F.count("*").alias("n")).collect():
        radius[r["home"]], count[r["home"]] = r["r"], r["n"]
    cuts = np.maximum(1, -(-count // block))
    first = np.append(0, np.cumsum(cuts))
    # A pivot's points are dealt to its blocks by hash: dense places have more pivots, so that this is for copies.
    places = spark.createDataFrame(pd.DataFrame({"home": np.arange(len(at), dtype=np.int32), "f": first[:-1].astype(np.int64), "c": cuts.astype(np.int64)}), "home int, f long, c long")
    table = near.join(F.broadcast(places), "home").withColumn("block", (F.col("f") + F.pmod(F.xxhash64("id"), F.col("c"))).cast("int"))
    group = int(np.clip(n // 8, block, max(block, min(GROUP, (1 << 22) // max(1, at.shape[1])))))
    size = np.repeat(count / cuts, cuts)
    groups = ((np.cumsum(size) - size) // group).astype(np.int32)
    of = spark.createDataFrame(pd.DataFrame({"block": np.arange(len(groups), dtype=np.int32), "grp": groups}), "block int, grp int")
    table = table.drop("home", "r", "f", "c").join(F.broadcast(of), "block").select(*points.columns, "block", "grp")
    return Cover(table, ids, at, radius, count, cuts, groups, group)


def _needed(c: Cover, x: np.ndarray, bound: np.ndarray, least: int) -> np.ndarray:
    """Which pivots' balls each query reaches; an infinite bound is taken from balls that hold ``least`` points for sure."""
    d = rough_distances(x, c.pivots)
    open_ = ~np.isfinite(bound)
    if least and open_.any():
        far = d[open_] + c.radius
        order = np.argsort(far, 1)
        enough = np.cumsum(c.count[order], 1) >= least
        reach = np.take_along_axis(far, order, 1)[np.arange(len(far)), enough.argmax(1)]
        bound = bound.copy()
        bound[open_] = np.where(enough.any(1), reach, np.inf)
    size = c.size + np.sqrt((x * x).sum(1))
    return (d - c.radius <= (bound + SLACK * size)[:, None]) & (c.count > 0)


def wanted_blocks(queries: DataFrame, c: Cover, least: int = 0, own: bool = True, key: str = "block") -> DataFrame:
    """(a, block, n): how many queries (id, x, block, bound) of block a (or of group a) need a block; without their own if not ``own``."""
    held = queries.sparkSession.sparkContext.broadcast((c.pivots, c.radius, c.count, c.first, c.size, c.groups))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cov = Cover.__new__(Cover)
        cov.pivots, cov.radius, cov.count, cov.first, cov.size, cov.groups = held.value
        for b in batches:
            if not len(b):
                continue
            b = b.sort_values("a")
            need = _needed(cov, vectors(b["x"]), b["bound"].to_numpy(float), least)
            a, start = np.unique(b["a"].to_numpy(), return_index=True)
            n = np.add.reduceat(need, start, 0, np.int64)
            row, pivot = np.nonzero(n)
            cuts = (cov.first[pivot + 1] - cov.first[pivot]).astype(np.int64)
            block = np.repeat(cov.first[pivot], cuts) + np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            out = pd.DataFrame({"a": a[np.repeat(row, cuts)].astype(np.int32), "block": block.astype(np.int32), "n": np.repeat(n[row, pivot], cuts)})
            yield out if own else out[out["a"] != (block if key == "block" else cov.groups[block])]

    return queries.select("x", F.col(key).alias("a"), "bound").mapInPandas(run, "a int, block int, n long").groupBy("a", "block").agg(F.sum("n").alias("n"))


def compared(queries: DataFrame, c: Cover, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, least: int = 0, own: bool = True, candidates: DataFrame | None = None) -> DataFrame:
    """``work(queries, candidates)`` for the queries (id, x, block, grp, bound, ...) of every group and every bundle of what they need.

    ``candidates`` (a part of the cover's table, or one with further columns) stand in for the table. A group's own blocks
    are left out if not ``own``.
    """
    candidates = (c.table if candidates is None else candidates).drop("grp")
    pairs = written(wanted_blocks(queries, c, least, own, "grp"), "wanted")
    sizes = candidates.groupBy("block").agg(F.count("*").alias("m"))
    before = Window.partitionBy("a").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bundle = F.floor(F.coalesce(F.sum("m").over(before), F.lit(0)) / c.group).cast("int").alias("bundle")
    bundles = written(pairs.join(sizes, "block").select("a", "block", bundle), "bundles")
    right = fresh(candidates.join(bundles, "block").withColumnsRenamed({"a": "a2", "bundle": "bundle2"}))
    left = fresh(queries).join(bundles.select(F.col("a").alias("grp"), "bundle").distinct(), "grp").withColumnRenamed("grp", "a")
    held = queries.sparkSession.sparkContext.broadcast((c.pivots, c.radius, c.first, c.size))

    def reached(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(b):
            return work(q, b)
        pivots, radius, first, size = held.value
        blocks, at = np.unique(b["block"].to_numpy(), return_inverse=True)
        home = np.searchsorted(first, blocks, "right") - 1
        x = vectors(q["x"])
        reach = q["bound"].to_numpy(float) + SLACK * (size + np.sqrt((x * x).sum(1)))
        need = rough_distances(x, pivots[home]) - radius[home] <= reach[:, None]
        if need.mean() > 0.25:
            return work(q, b)
        parts = []
        for rows in q.reset_index(drop=True).groupby("block").indices.values():
            if (some := need[rows].any(0)).any():
                parts.append(work(q.iloc[rows], b[some[at]]))
        return pd.concat(parts) if parts else work(q.iloc[:0], b)

    # Empty sides are no work: a bundle has candidates and its group has queries.
    return left.groupBy("a", "bundle").cogroup(right.groupBy("a2", "bundle2")).applyInPandas(reached, schema)
