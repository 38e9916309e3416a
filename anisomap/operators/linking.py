"""Linking the parts of a graph by their closest pairs, all parts at once.

In a round every part but the largest takes its closest pair to any other part, of those that a predicate lets through;
parts that are joined by such pairs become one. So the links are the edges of a shortest tree over the parts, and rounds
are at most the logarithm of the number of parts. Pairs are looked for in a cover of pivots: a part's closest pair in its
own group, or to a pivot, bounds what the other blocks have to be asked for.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anisomap.operators.components import connected_components
from anisomap.operators.cover import BLOCK, compared, cover, rough_distances, vectors
from anisomap.operators.graph import _Single
from anisomap.storage import drop, written, written_with

LINK = "part long, other long, src long, dst long, d double"
#: Rows whose pairs are looked at together, pairs that a predicate is asked about at once.
ROWS, ASKED = 64, 2048
#: Rows whose closest pairs give bounds for all other rows, if these are many.
FIRST = 1024
#: Pairs within their bounds that are measured at once.
MEASURED = 1 << 20
#: Links of a round that the driver follows; more are followed in Spark, with the same roots.
FEW = 200_000


def closest(q: pd.DataFrame, b: pd.DataFrame, clear: Callable | None, bounds: np.ndarray | None = None) -> pd.DataFrame:
    """The closest pair of every part of ``q`` (id, x, part) with a row of ``b`` of another part, ties to the smaller ids.

    Pairs beyond ``bounds`` (of q's rows) are of no interest. Without a predicate every pair is clear.
    """
    if clear is None and len(q) and len(b) >= 4 * FIRST:
        found = _closest_within(q, b, bounds)
        if found is not None:
            return found
    x, y = vectors(q["x"]), vectors(b["x"])
    own, other, a, c = (t[k].to_numpy(np.int64) for t, k in ((q, "part"), (b, "part"), (q, "id"), (b, "id")))
    best: dict[int, tuple[float, int, int, int, int]] = {}
    order = np.argsort(own, kind="stable")
    for low in range(0, len(order), ROWS):
        rows = order[low : low + ROWS]
        d = rough_distances(x[rows], y)
        # Rough distances choose, exact ones decide.
        slack = 1e-6 * (1 + np.sqrt((y * y).sum(1).max(initial=0)) + np.sqrt((x[rows] ** 2).sum(1)))
        limit = np.array([best[p][0] if p in best else np.inf for p in own[rows].tolist()])
        if bounds is not None:
            limit = np.minimum(limit, bounds[rows])
        d[own[rows, None] == other[None, :]] = np.inf
        if clear is None:
            limit = np.minimum(limit, d.min(1))
        row, col = np.nonzero((d <= (limit + 2 * slack)[:, None]) & np.isfinite(d))
        exact = np.sqrt(((x[rows[row]] - y[col]) ** 2).sum(1))
        ids = np.sort(np.stack([a[rows[row]], c[col]]), 0)
        rank = np.lexsort((ids[1], ids[0], exact, own[rows[row]]))
        at, parts = 0, own[rows[row[rank]]]
        while at < len(rank):
            # One part after the other: its pairs in order, until one is clear.
            part = int(parts[at])
            end = int(np.searchsorted(parts, part, "right"))
            while at < end:
                some = rank[at : min(end, at + (ASKED if clear else 1))]
                ok = np.ones(len(some), bool) if clear is None else clear(x[rows[row[some]]], y[col[some]])
                if ok.any():
                    i = some[int(ok.argmax())]
                    new = (float(exact[i]), int(ids[0, i]), int(ids[1, i]), int(a[rows[row[i]]]), int(other[col[i]]))
                    best[part] = min(best.get(part, new), new)
                    break
                at += len(some)
            at = end
    ends = [(p, o, s, t if s == m else m, d) for p, (d, m, t, s, o) in best.items()]
    return pd.DataFrame(ends, columns=["part", "other", "src", "dst", "d"])


def _closest_within(q: pd.DataFrame, b: pd.DataFrame, bounds: np.ndarray | None) -> pd.DataFrame | None:
    """``closest`` by products in single precision: a few rows of ``b`` give every part a bound, and what is within it is measured.

    None if some rows have no bound, or if bounds leave too many pairs.
    """
    q, best = q.reset_index(drop=True), []
    limit = np.full(len(q), np.inf) if bounds is None else bounds
    if not np.isfinite(limit).all():
        some = closest(q, b.iloc[:: len(b) // FIRST], None, bounds)
        limit = np.minimum(limit, q["part"].map(some.set_index("part")["d"]).fillna(np.inf).to_numpy(float))
        best.append(some.assign(low=np.minimum(some["src"], some["dst"]), high=np.maximum(some["src"], some["dst"])))
    x, y = vectors(q["x"]), vectors(b["x"])
    single = _Single(x, y, limit)
    if not single.useful:
        return None
    own, other, a, c = (t[k].to_numpy(np.int64) for t, k in ((q, "part"), (b, "part"), (q, "id"), (b, "id")))
    for at in range(0, len(q), _Single.ROWS):
        pairs = single.near(at, min(at + _Single.ROWS, len(q)), MEASURED)
        if pairs is None:
            return None
        row, col = at + pairs[0], pairs[1]
        differ = own[row] != other[col]
        row, col = row[differ], col[differ]
        d = np.sqrt(((x[row] - y[col]) ** 2).sum(1))
        inside = d <= limit[row]
        row, col, d = row[inside], col[inside], d[inside]
        if len(row):
            best.append(_least(pd.DataFrame({"part": own[row], "other": other[col], "src": a[row], "dst": c[col], "d": d, "low": np.minimum(a[row], c[col]), "high": np.maximum(a[row], c[col])})))
    names = ["part", "other", "src", "dst", "d"]
    return _least(pd.concat(best))[names] if best else pd.DataFrame(columns=names)


def _least(links: pd.DataFrame) -> pd.DataFrame:
    """Every part's closest link, ties to the smaller ids."""
    return links.sort_values(["part", "d", "low", "high"], kind="stable").drop_duplicates("part")


def _best(links: DataFrame) -> DataFrame:
    """The closest link of every part."""
    key = F.struct("d", F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high"), "src", "dst", "other")
    return links.groupBy("part").agg(F.min(key).alias("m")).select("part", "m.other", "m.src", "m.dst", "m.d")


def _roots(links: DataFrame, n: int) -> DataFrame:
    """(id, root): the smallest part that each part is joined with; a few links are followed on the driver."""
    ends = links.select("part", "other")
    if n > FEW:
        return connected_components(ends)
    got = ends.toPandas().to_numpy(np.int64)
    ids, at = np.unique(got, return_inverse=True)
    a, b = at.reshape(got.shape).T
    root = np.arange(len(ids))
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return links.sparkSession.createDataFrame(pd.DataFrame({"id": ids, "root": ids[root]}), "id long, root long")
        root = new


def _inner(marks: pd.DataFrame, largest: int, clear: Callable | None) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The closest pairs of a group's parts, but for the largest part, in the group and with the pivots."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        return closest(rows[rows["part"] != largest], pd.concat([rows[["id", "x", "part"]], marks]), clear)

    return work


def _further(clear: Callable | None) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    return lambda q, b: closest(q, b, clear, q["bound"].to_numpy(float))


def part_links(points: DataFrame, graph: DataFrame, clear: Callable | None = None, pivots: int | None = None, block: int = BLOCK) -> tuple[DataFrame, int, int]:
    """(links (src, dst, d), rounds, parts that are left): what connects the parts of ``graph`` on ``points`` (id, x).

    ``clear(a, b)`` says for arrays of points whether their pairs may be links. Pairs that no round can link leave more
    than one part. Points without an edge are parts of their own; no points have no parts.
    """
    from anisomap.operators.graph import components

    parts = written(components(points, graph).withColumnRenamed("component", "part"), "parts")
    found, rounds, c = [], 0, None
    while True:
        sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
        row = sizes.agg(F.count("*").alias("parts"), F.max(F.struct("n", -F.col("part"))).alias("m")).first()
        if row["parts"] < 2:
            break
        if c is None:
            c = cover(points.select("id", "x"), pivots, block)
            table = written(c.table, "cover")
        tagged = written(table.join(parts, "id"), "tagged")
        rounds += 1
        largest = -row["m"][1]
        marks = tagged.join(F.broadcast(points.sparkSession.createDataFrame(pd.DataFrame({"id": c.ids}), "id long")), "id").select("id", "x", "part").toPandas()
        near = _best(tagged.groupBy("grp").applyInPandas(_inner(marks, largest, clear), LINK))
        if c.groups.max(initial=0) > 0:
            near = written(near, "near")
            asking = tagged.where(F.col("part") != largest).join(near.select("part", F.col("d").alias("bound")), "part", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
            near = _best(near.unionByName(compared(asking, c, _further(clear), LINK, own=False, candidates=tagged.select("id", "x", "part", "block"))))
        links, (n,) = written_with(near, "links")
        if not n:
            break
        found.append(links)
        new = parts.join(_roots(links, n).select(F.col("id").alias("part"), "root"), "part", "left").select("id", F.coalesce("root", "part").alias("part"))
        parts, last = written(new, "parts"), parts
        drop(last)
        drop(tagged)
    out = points.sparkSession.createDataFrame([], "src long, dst long, d double")
    for links in found:
        out = out.unionByName(links.select("src", "dst", "d"))
    return out, rounds, row["parts"]
