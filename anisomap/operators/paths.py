"""Shortest paths over ``edges(src, dst, d)`` with non-negative weights; absent rows are unreachable.

Two strategies. ``kernel``: edges of at most ``BROADCAST_EDGES`` are broadcast as compressed rows, and tasks search from
one source after the other. ``iterative``: a frontier of changed rows meets the edges, bucket after bucket of distances, for
graphs of any size; all state is in the shared folder.

Both give the same: of ways of equal length the one of fewest edges counts, and of those the one whose last vertex
before the end has the smallest id. So predecessors form trees, zero weights and ties included, and walks along them end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anisomap.operators.graph import reverse
from anisomap.session import ship
from anisomap.storage import drop, written, written_with

#: 12 bytes an edge: at most some 200 MB are broadcast.
BROADCAST_EDGES = 16_000_000
#: Edges of a walk after which it is held against the number of vertices.
LONG = 64
#: Edges of ways up to which a search goes turn by turn.
SHALLOW = 24


def _distinct(places: np.ndarray, n: int) -> np.ndarray:
    """Different places below n, in order."""
    if 16 * len(places) < n:
        return np.unique(places)
    seen = np.zeros(n, bool)
    seen[places] = True
    return np.flatnonzero(seen)


class Rows:
    """A graph as edges sorted by tail and head, over its sorted ids; edges of the same ends must not repeat."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, d: np.ndarray):
        self.ids = np.union1d(src, dst)
        tail, head = (np.searchsorted(self.ids, v).astype(np.int32) for v in (src, dst))
        order = np.lexsort((head, tail))
        self.begin = np.append(0, np.cumsum(np.bincount(tail, minlength=len(self.ids))))
        self.head, self.weight = head[order], d[order].astype(np.float64)
        self.width = 1.5 * float(self.weight.mean()) if len(self.weight) else 0.0
        self.deep = False

    @cached_property
    def tail(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.begin))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "tail"}

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Places of those ids that the graph has."""
        ids = np.asarray(ids)
        at = np.searchsorted(self.ids, ids)
        return at[self.ids[np.minimum(at, len(self.ids) - 1)] == ids] if len(self.ids) else at[:0]

    def _out_of(self, nodes: np.ndarray) -> np.ndarray:
        """Edges out of nodes, as places."""
        first, size = self.begin[nodes], self.begin[nodes + 1] - self.begin[nodes]
        return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())

    def distances(self, source: int) -> np.ndarray:
        """Lengths of shortest ways; nodes that changed are expanded, those of the nearest bucket first."""
        dist = np.full(len(self.ids), np.inf)
        dist[source], near, far, end = 0.0, np.array([source]), [], self.width
        while len(near):
            while len(near):
                e = self._out_of(near)
                head, d = self.head[e], np.repeat(dist[near], self.begin[near + 1] - self.begin[near]) + self.weight[e]
                better = np.flatnonzero(d < dist[head])
                head = head[better]
                np.minimum.at(dist, head, d[better])
                head = _distinct(head, len(dist))
                inside = dist[head] < end
                near = head[inside]
                far.append(head[~inside])
            far = _distinct(np.concatenate(far), len(dist))
            far = far[dist[far] >= end]
            if len(far):
                end = max(dist[far].min() + self.width, np.nextafter(dist[far].min(), np.inf))
                near = far[dist[far] < end]
            far = [far[dist[far] >= end]]
        return dist

    def search(self, source: int, goals: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distance, edges, predecessor) of every node; infinite, -1 and -1 where there is no way.

        With ``goals`` what is farther than all of these may be missing. Ways of few edges are found turn by turn; once one
        source has longer ones, sources are searched by buckets of distances.
        """
        if not self.deep:
            dist, hops, pred, left = self._turns(source, SHALLOW, goals)
            if not left:
                return dist, hops, pred
            self.deep = True
        dist = self.distances(source)
        reached = np.isfinite(dist)
        tight = np.flatnonzero((dist[self.tail] + self.weight == dist[self.head]) & reached[self.head] & (self.head != source))
        tail, head = self.tail[tight], self.head[tight]
        hops, pred = np.full(len(dist), -1, np.int32), np.full(len(dist), -1)
        hops[source] = 0
        if len(head) == reached.sum() - 1:
            # One way to every node: the walks back are counted by doubling their length.
            pred[head] = tail
            up, depth = np.where(pred < 0, np.arange(len(dist)), pred), (pred >= 0).astype(np.int32)
            while (up[up] != up).any():
                depth, up = depth + depth[up], up[up]
            return dist, np.where(reached, depth, -1).astype(np.int32), pred
        level = 0
        while len(head):
            on = hops[tail] == level
            to, order = head[on], np.lexsort((tail[on], head[on]))
            to, first = np.unique(to[order], return_index=True)
            hops[to], pred[to] = level + 1, tail[on][order][first]
            level += 1
            left = hops[head] < 0
            tail, head = tail[left], head[left]
        return dist, hops, pred

    def bounded(self, source: int, turns: int, goals: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``search`` over ways of at most ``turns`` edges; others are not sought."""
        return self._turns(source, turns, goals)[:3]

    def _turns(self, source: int, turns: int, goals: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
        """``search`` over ways of at most ``turns`` edges, and whether longer ones could be shorter."""
        dist, hops, pred = np.full(len(self.ids), np.inf), np.full(len(self.ids), -1, np.int32), np.full(len(self.ids), -1)
        dist[source], hops[source], near = 0.0, 0, np.array([source])
        for turn in range(1, turns + 1):
            if not len(near):
                break
            e = self._out_of(near)
            tail = np.repeat(near, self.begin[near + 1] - self.begin[near])
            head, d = self.head[e], dist[tail] + self.weight[e]
            better = d < dist[head]
            if goals is not None:
                better &= d <= dist[goals].max(initial=0)
            better = np.flatnonzero(better)
            tail, head, d = tail[better], head[better], d[better]
            np.minimum.at(dist, head, d)
            best = d == dist[head]
            tail, head = tail[best], head[best]
            pred[head] = len(self.ids)
            np.minimum.at(pred, head, tail)
            hops[head] = turn
            near = _distinct(head, len(hops))
        return dist, hops, pred, bool(len(near))


def collect_rows(edges: DataFrame) -> Rows:
    got = edges.groupBy("src", "dst").agg(F.min("d").alias("d")).toPandas()
    return Rows(got["src"].to_numpy(np.int64), got["dst"].to_numpy(np.int64), got["d"].to_numpy())


def shortest_paths(
    edges: DataFrame, sources: DataFrame | None = None, directed: bool = True, strategy: str | None = None, most_hops: int | None = None,
    wanted: DataFrame | None = None, along: bool = False,
) -> DataFrame:
    """sp(src, dst, dist, pred, hops) from each source (default: all nodes); pred is NULL at the source itself.

    hops are the edges of the way; with ``most_hops`` only ways of at most so many edges count. Edges with a null, NaN or infinite weight are none; of repeated ones the shortest counts.

    With ``wanted`` (src, dst) instead of sources only the rows of these pairs are given, which tasks pick out, so that what
    leaves them follows the pairs; and if ``along``, the rows of all vertices on their ways.
    """
    if strategy not in (None, "kernel", "iterative"):
        raise ValueError("strategy is kernel or iterative")
    edges, n, most = _steps(edges, directed)
    if wanted is not None:
        if sources is not None:
            raise ValueError("sources are those of the wanted pairs")
        wanted = wanted.select("src", "dst")
        sources = wanted.select(F.col("src").alias("id"))
    sources = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct() if sources is None else sources.select("id").distinct()
    if strategy is None:
        strategy = "kernel" if n <= BROADCAST_EDGES else "iterative"
    if strategy == "kernel":
        return _by_kernel(edges, sources, most_hops, wanted, along)
    sp = _by_frontier(edges, sources, most_hops, most)
    if wanted is None:
        return sp
    if not along:
        return sp.hint("merge").join(wanted.distinct(), ["src", "dst"], "left_semi")
    sp = written(sp, "sp")
    reached = sp.hint("merge").join(wanted.distinct(), ["src", "dst"], "left_semi").select("src", "dst")
    on = path_table(sp, reached).select("src", F.col("head").alias("dst")).unionByName(reached).unionByName(reached.select("src", F.col("src").alias("dst"))).distinct()
    return sp.hint("merge").join(on, ["src", "dst"], "left_semi")


def _steps(edges: DataFrame, directed: bool = True) -> tuple[DataFrame, int, float | None]:
    """Edges that are some, each once, as a table; their number and largest weight."""
    ship(edges.sparkSession)
    edges = edges.select("src", "dst", "d").where("d is not null and not isnan(d) and d < double('infinity')")
    if not directed:
        edges = edges.unionByName(reverse(edges))
    edges = edges.groupBy("src", "dst").agg(F.min("d").alias("d"))
    edges, (n, least, most) = written_with(edges, "steps", F.min("d"), F.max("d"))
    if n and least < 0:
        raise ValueError("weights must not be negative")
    return edges, n, most


def _ways(pred: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Places of all vertices on the ways to some places, these and the source included."""
    on = np.zeros(len(pred), bool)
    while len(to):
        on[to] = True
        to = np.unique(pred[to])
        to = to[to >= 0]
        to = to[~on[to]]
    return np.flatnonzero(on)


def _by_kernel(edges: DataFrame, sources: DataFrame, most_hops: int | None = None, wanted: DataFrame | None = None, along: bool = False) -> DataFrame:
    held = edges.sparkSession.sparkContext.broadcast(collect_rows(edges))
    every = wanted is None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = held.value
        for batch in batches:
            ids = batch["id"].to_numpy(np.int64)
            goals = None if every else batch["goals"].to_numpy()
            known = np.isin(ids, g.ids)
            for row in np.flatnonzero(~known):
                s = ids[row]
                if goals is not None and s not in goals[row]:
                    continue
                yield pd.DataFrame({"src": [s], "dst": [s], "dist": [0.0], "pred": pd.array([None], "Int64"), "hops": np.zeros(1, np.int32)})
            for row in np.flatnonzero(known):
                at = np.searchsorted(g.ids, ids[row])
                own = None if goals is None else np.unique(g.places(goals[row]))
                dist, hops, pred = g.search(at, own) if most_hops is None else g.bounded(at, most_hops, own)
                if goals is None:
                    to = np.flatnonzero(hops >= 0)
                else:
                    to = own[hops[own] >= 0]
                    to = _ways(pred, to) if along else to
                before, none = pred[to], pred[to] < 0
                yield pd.DataFrame({"src": g.ids[at], "dst": g.ids[to], "dist": dist[to], "pred": pd.arrays.IntegerArray(g.ids[np.where(none, 0, before)], none), "hops": hops[to]})

    if not every:
        sources = wanted.groupBy(F.col("src").alias("id")).agg(F.collect_set("dst").alias("goals"))
    spread = sources.repartition(sources.sparkSession.sparkContext.defaultParallelism)
    # Spark takes the result to have as few rows as there are sources, and would broadcast it in joins.
    return spread.mapInPandas(run, "src long, dst long, dist double, pred long, hops int").hint("merge")


def bellman_ford(edges: DataFrame, sources: DataFrame, hops: int | None = None) -> DataFrame:
    """sp(src, dst, dist, pred, hops) of paths of at most ``hops`` edges, or of any number."""
    steps = edges.groupBy("src", "dst").agg(F.min("d").alias("d"))
    steps, (_, most) = written_with(steps, "steps", F.max("d"))
    return _by_frontier(steps, sources.select("id").distinct(), hops, most)


def _label() -> Column:
    """What the least of counts: length, edges, id of the vertex before."""
    return F.struct("dist", "hops", "pred")


def _least(rows: DataFrame) -> DataFrame:
    return rows.groupBy("src", "dst").agg(F.min(_label()).alias("m")).select("src", "dst", "m.dist", "m.hops", "m.pred")


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _by_frontier(steps: DataFrame, sources: DataFrame, hops: int | None, width: float | None) -> DataFrame:
    """Rows that changed meet the edges, until none is left; with no bound on hops, in buckets of distances of ``width``.

    What a round changes is a table of its own: tables are merged when they outgrow the oldest one, so a row is written
    again a logarithmic number of times. When a bucket has no changes left, its rows are final and set aside. Candidates
    are held against the rows of their own keys only.
    """
    none = F.lit(None).cast("long")
    start = sources.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("dist"), F.lit(0).alias("hops"), none.alias("pred"))
    frontier, (n,) = written_with(start, "paths")
    done, live, sizes = [], [frontier], [n]
    buckets = hops is None and bool(width)
    end, turn = (width if buckets else float("inf")), 0
    while n and (hops is None or turn < hops):
        turn += 1
        longer = frontier.alias("f").join(steps.alias("s"), F.col("f.dst") == F.col("s.src"))
        longer = longer.select("f.src", "s.dst", (F.col("f.dist") + F.col("s.d")).alias("dist"), (F.col("f.hops") + 1).alias("hops"), F.col("f.dst").alias("pred"))
        found = written(_least(longer), "found")
        known = _least(_all(done + live).join(found.select("src", "dst"), ["src", "dst"], "left_semi")).select("src", "dst", _label().alias("old"))
        better = found.join(known, ["src", "dst"], "left").where(F.col("old").isNull() | (_label() < F.col("old"))).drop("old")
        new, (count, n) = written_with(better, "paths", F.count_if(F.col("dist") < end))
        drop(found)
        frontier = new.where(F.col("dist") < end)
        if len(live) > 1 and sum(sizes[1:]) > sizes[0]:
            out, (size,) = written_with(_least(_all(live)), "paths")
            for t in live:
                drop(t)
            live, sizes = [out], [size]
        if count:
            live, sizes = [*live, new], [*sizes, count]
        if not n and buckets:
            out = written(_least(_all(live)), "paths")
            for t in live:
                drop(t)
            done.append(written(out.where(F.col("dist") < end), "done"))
            rest, (size, least) = written_with(out.where(F.col("dist") >= end), "paths", F.min("dist"))
            drop(out)
            live, sizes, n = [rest], [size], size
            if size:
                end = max((least // width + 1) * width, float(np.nextafter(least, np.inf)))
                frontier = rest.where(F.col("dist") < end)
            if len(done) > 16:
                merged = written(_all(done), "done")
                for t in done:
                    drop(t)
                done = [merged]
    return _all([*done, _least(_all(live))])


def soft_bellman_ford(edges: DataFrame, sources: DataFrame, beta: float, rounds: int) -> DataFrame:
    """(src, dst, dist): synchronous rounds of soft minima over keeping and all incoming edges; a source's own is 0."""
    now = written(sources.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("dist")), "soft")
    steps = written(edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), "d"), "steps")
    for _ in range(rounds):
        longer = now.join(steps, now["dst"] == steps["u"]).select("src", F.col("v").alias("dst"), (F.col("dist") + F.col("d")).alias("dist"))
        both = now.unionByName(longer)
        low = both.groupBy("src", "dst").agg(F.min("dist").alias("low"))
        soft = both.join(low, ["src", "dst"]).groupBy("src", "dst").agg((F.min("low") - F.log(F.sum(F.exp(-beta * (F.col("dist") - F.col("low"))))) / beta).alias("dist"))
        now = written(soft.select("src", "dst", F.when(F.col("src") == F.col("dst"), 0.0).otherwise(F.col("dist")).alias("dist")), "soft")
    return now


def soft_floyd_warshall(costs: np.ndarray, beta: float, trace: bool = False):
    """All-pairs soft distances of a dense cost matrix; with ``trace`` also what the pullback needs."""
    m, kept = np.array(costs, float), []
    n = len(m)
    np.fill_diagonal(m, 0)
    index = np.arange(n)
    for k in range(n):
        via = m[:, k, None] + m[None, k, :]
        low = np.minimum(m, via)
        with np.errstate(invalid="ignore"):
            a, b = np.exp(-beta * (m - low)), np.exp(-beta * (via - low))
        a[~np.isfinite(a)], b[~np.isfinite(b)] = 0, 0
        total = a + b
        new = np.where(np.isfinite(low), low - np.log(np.where(total > 0, total, 1)) / beta, np.inf)
        use = np.isfinite(low) & (index[:, None] != k) & (index[None, :] != k) & (index[:, None] != index[None, :])
        p = np.where(use, b / np.where(total > 0, total, 1), 0)
        m = np.where(use, new, m)
        if trace:
            kept.append(p)
    return (m, kept) if trace else m


def soft_floyd_warshall_pullback(kept: list[np.ndarray], grad: np.ndarray) -> np.ndarray:
    """Gradient by the costs of a function whose gradient by the soft distances is ``grad``."""
    g = np.array(grad, float)
    for k in range(len(kept) - 1, -1, -1):
        via = g * kept[k]
        g = g - via
        g[:, k] += via.sum(1)
        g[k, :] += via.sum(0)
    np.fill_diagonal(g, 0)
    return g


def path_table(sp: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, hop, tail, head): edges of the paths of ``pairs(src, dst)``; hop 1 is the first edge.

    Raises if predecessors of another origin than ``shortest_paths`` go round in circles.
    """
    before = sp.where("pred is not null").select("src", F.col("dst").alias("head"), F.col("pred").alias("tail")).hint("merge")
    wanted = pairs.select("src", "dst").distinct()
    now = wanted.withColumn("at", F.col("dst"))
    out, depth, most = None, 0, None
    while True:
        if depth == LONG:
            most = sp.groupBy("src").count().agg(F.max("count")).first()[0]
        if most is not None and depth > most:
            raise ValueError("the predecessors go round in circles")
        step = now.join(before, (now["src"] == before["src"]) & (now["at"] == before["head"])).select(now["src"], "dst", "tail", "head")
        step = written(step.withColumn("back", F.lit(depth)), "path")
        if step.isEmpty():
            break
        out = step if out is None else out.unionByName(step)
        now, depth = step.select("src", "dst", F.col("tail").alias("at")), depth + 1
    if out is None:
        out = now.select("src", "dst", F.col("src").alias("tail"), F.col("dst").alias("head"), F.lit(0).alias("back")).limit(0)
    last = Window.partitionBy("src", "dst")
    return out.select("src", "dst", (F.max("back").over(last) - F.col("back") + 1).alias("hop"), "tail", "head")


def path_vertices(sp: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, path): vertices from src to dst; [src] for a pair of equal ends, no row if unreachable."""
    edges = path_table(sp, pairs)
    path = edges.groupBy("src", "dst").agg(F.sort_array(F.collect_list(F.struct("hop", "head"))).alias("e"))
    path = path.select("src", "dst", F.concat(F.array("src"), F.transform("e", lambda x: x["head"])).alias("path"))
    same = pairs.where("src = dst").select("src", "dst").distinct().withColumn("path", F.array("src"))
    return path.unionByName(same)


def way_lengths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, dst, dist): lengths of the shortest ways from each source, summed over their edges along the predecessors.

    Tasks walk each source's tree, so that neither ways nor predecessors are a table; graphs of more than ``BROADCAST_EDGES``
    edges take ``path_table``.
    """
    steps, n, _ = _steps(edges)
    if n > BROADCAST_EDGES:
        sp = written(shortest_paths(steps, sources), "sp")
        ways = path_table(sp, sp.where("src <> dst").select("src", "dst"))
        return ways.join(steps.withColumnsRenamed({"src": "tail", "dst": "head"}), ["tail", "head"]).groupBy("src", "dst").agg(F.sum("d").alias("dist"))
    held = steps.sparkSession.sparkContext.broadcast(collect_rows(steps))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = held.value
        n = len(g.ids)
        keys = g.tail.astype(np.int64) * n + g.head
        for batch in batches:
            for at in g.places(batch["id"].to_numpy(np.int64)):
                _, hops, pred = g.search(at)
                to = np.flatnonzero(pred >= 0)
                to = to[np.argsort(hops[to], kind="stable")]
                step, total = g.weight[np.searchsorted(keys, pred[to] * n + to)], np.zeros(n)
                cuts = np.searchsorted(hops[to], np.arange(1, hops.max() + 2))
                for a, b in zip(cuts, cuts[1:], strict=False):
                    total[to[a:b]] = total[pred[to[a:b]]] + step[a:b]
                yield pd.DataFrame({"src": g.ids[at], "dst": g.ids[to], "dist": total[to]})

    spread = sources.select("id").distinct().repartition(sources.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInPandas(run, "src long, dst long, dist double").hint("merge")


def pruned_forest(sp: DataFrame, pairs: DataFrame) -> DataFrame:
    """(tail, head): distinct edges on the paths of all pairs. Raises if a pair is unreachable."""
    missing = pairs.select("src", "dst").where("src <> dst").join(sp.select("src", "dst"), ["src", "dst"], "left_anti")
    if not missing.isEmpty():
        raise ValueError("some active pairs are unreachable")
    return path_table(sp, pairs).select("tail", "head").distinct()


def reached_forest(edges: DataFrame, pairs: DataFrame | None = None, sources: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """``pruned_forest`` of the shortest paths over ``edges`` between those ``pairs`` that are reachable.

    Instead of pairs, ``sources`` and ``targets`` (id) stand for all pairs of them: no pair is a row then, targets are
    broadcast, and a task gives each edge once.
    """
    if pairs is None:
        edges, n = _steps(edges)[:2]
        if n <= BROADCAST_EDGES:
            return _forest_by_kernel(edges, sources.select("id").distinct(), targets).distinct()
        pairs = sources.select(F.col("id").alias("src")).crossJoin(F.broadcast(targets.select(F.col("id").alias("dst")))).where("src <> dst")
    sp = shortest_paths(edges, wanted=pairs, along=True)
    return sp.where("pred is not null").select(F.col("pred").alias("tail"), F.col("dst").alias("head")).distinct()


def _forest_by_kernel(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    rows = collect_rows(edges)
    to = rows.places(targets.select("id").distinct().toPandas()["id"].to_numpy(np.int64))
    held = edges.sparkSession.sparkContext.broadcast((rows, np.sort(to)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, goals = held.value
        keys, given = g.tail.astype(np.int64) * len(g.ids) + g.head, np.zeros(len(g.head), bool)
        for batch in batches:
            for at in g.places(batch["id"].to_numpy(np.int64)):
                _, hops, pred = g.search(at, goals)
                on = _ways(pred, goals[hops[goals] >= 0])
                on = on[pred[on] >= 0]
                edge = np.searchsorted(keys, pred[on] * len(g.ids) + on)
                edge = edge[~given[edge]]
                given[edge] = True
                yield pd.DataFrame({"tail": g.ids[g.tail[edge]], "head": g.ids[g.head[edge]]})

    return sources.repartition(sources.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, "tail long, head long")
