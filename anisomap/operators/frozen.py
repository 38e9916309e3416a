"""The path-frozen fit: shortest paths on the embedding's own graph are frozen, and their lengths fitted, in turns.

Pairs stay in Spark. Pairs of several turns are sampled in one scan and kept as one row a source. In a turn, tasks search
the broadcast graph from the sources of their rows and keep, for each, the tree of edges that its targets need; the trees
are a table in the shared folder. An evaluation of the objective sends the n x d coordinates out and gets one value and
one gradient of n x d numbers a partition back. Trees of at most ``LOCAL_TREES`` nodes are collected and evaluated by the
same kernel, as a job would cost more than the sum.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark import Broadcast, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anisomap.functions.metrics import Metric
from anisomap.operators import objectives as O
from anisomap.operators import pairs as P
from anisomap.operators.optimizers import LOCAL_PAIRS, Result, lbfgs, log_every, packed_pairs, packed_raw, summed_parts
from anisomap.operators.paths import BROADCAST_EDGES, Rows
from anisomap.operators.support import knn_support
from anisomap.session import ship
from anisomap.storage import drop, written, written_with

#: Nodes of trees that are evaluated on the driver, turns of pairs that one scan samples.
LOCAL_TREES, TURNS = 4_000_000, 8
TREES = "parent array<int>, edge array<int>, level array<int>, at array<int>, d array<double>, w array<double>, lost long"


class Forest:
    """Trees of shortest paths in one list of nodes, level by level: lengths go down, residuals go up."""

    def __init__(self, rows: pd.DataFrame):
        size = np.array([len(p) for p in rows["parent"]], np.int64)
        base = np.cumsum(size) - size
        flat = lambda c, kind: np.concatenate([np.zeros(0, kind), *rows[c]]).astype(kind)
        self.n = int(size.sum())
        self.parent, self.edge = flat("parent", np.int64) + np.repeat(base, size), flat("edge", np.int64)
        self.at = flat("at", np.int64) + np.repeat(base, [len(a) for a in rows["at"]])
        self.d, self.w = flat("d", float), flat("w", float)
        level = flat("level", np.int64)
        order = np.argsort(level, kind="stable")
        cuts = np.searchsorted(level[order], np.arange(1, level.max(initial=0) + 2))
        self.levels = [order[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def raw(self, length: np.ndarray) -> tuple[float, np.ndarray]:
        """Sum of w (length - d)^2 over targets, and its derivative by the length of every edge."""
        dist = np.zeros(self.n)
        for own in self.levels:
            dist[own] = dist[self.parent[own]] + length[self.edge[own]]
        gap = dist[self.at] - self.d
        pull = np.bincount(self.at, 2 * self.w * gap, self.n)
        for own in reversed(self.levels):
            np.add.at(pull, self.parent[own], pull[own])
        inner = np.concatenate([np.zeros(0, np.int64), *self.levels])
        return float((self.w * gap * gap).sum()), np.bincount(self.edge[inner], pull[inner], len(length))


class Graph:
    """The embedding's own graph: edges in order of tail and head."""

    def __init__(self, x: np.ndarray, metric: Metric, k: int, spark=None):
        tail, head = knn_support(x, k, spark=spark)
        length = metric.length(x[head] - x[tail])
        ok = np.isfinite(length)
        self.rows = Rows(tail[ok], head[ok], length[ok])
        self.tail, self.head = self.rows.ids[self.rows.tail], self.rows.ids[self.rows.head]

    @cached_property
    def keys(self) -> np.ndarray:
        """Edges as numbers, in their order."""
        return self.rows.tail.astype(np.int64) * len(self.rows.ids) + self.rows.head

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "keys"}

    def tree(self, source: int, to: np.ndarray) -> tuple[dict, int]:
        """Parents, edges and levels of the nodes on the ways to some points, the points' places, and how many have no way."""
        g = self.rows
        at, goal = (np.searchsorted(g.ids, v) for v in (source, to))
        known = (goal < len(g.ids)) & (g.ids[np.minimum(goal, len(g.ids) - 1)] == to) if len(g.ids) else np.zeros(len(to), bool)
        if at == len(g.ids) or g.ids[at] != source or not known.all():
            return {}, int(len(to))
        _, hops, pred = g.search(at)
        if (hops[goal] < 0).any():
            return {}, int((hops[goal] < 0).sum())
        needed = np.zeros(len(hops), bool)
        now = np.unique(goal)
        needed[at] = True
        while len(now):
            needed[now] = True
            now = np.unique(pred[now])
            now = now[(now >= 0) & ~needed[np.maximum(now, 0)]]
        nodes = np.flatnonzero(needed)
        nodes = nodes[np.argsort(hops[nodes], kind="stable")]
        place = np.zeros(len(hops), np.int64)
        place[nodes] = np.arange(len(nodes))
        before = np.maximum(pred[nodes], 0)
        n = len(g.ids)
        edge = np.minimum(np.searchsorted(self.keys, before * n + nodes), len(self.keys) - 1)
        tree = {"parent": place[before], "edge": edge, "level": hops[nodes], "at": place[goal]}
        tree["parent"][0], tree["edge"][0] = 0, 0
        return {k: v.astype(np.int32) for k, v in tree.items()}, 0

    def gradient(self, x: np.ndarray, metric: Metric, adjoint: np.ndarray) -> np.ndarray:
        used = np.flatnonzero(adjoint)
        pull = adjoint[used, None] * metric.grad(x[self.head[used]] - x[self.tail[used]])
        g = np.zeros_like(x)
        np.add.at(g, self.head[used], pull)
        np.add.at(g, self.tail[used], -pull)
        return g

    def raw(self, x: np.ndarray, metric: Metric, forests: Iterator[Forest]) -> tuple[float, np.ndarray]:
        """Stress of trees and its gradient by the coordinates; infinite if a way has a forbidden edge."""
        length = metric.length(x[self.head] - x[self.tail])
        value, adjoint = 0.0, np.zeros(len(length))
        for f in forests:
            v, a = f.raw(length)
            value, adjoint = value + v, adjoint + a
        if not np.isfinite(value):
            return np.inf, np.zeros_like(x)
        return value, self.gradient(x, metric, adjoint)


def _frozen(rows: DataFrame, held: Broadcast, factors: tuple[float, float]) -> DataFrame:
    """One row of ``TREES`` for each row (src, goals: array of (dst, d, w, own)); ``held`` has the ids and the graph."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, g = held.value
        for b in batches:
            out = []
            for source, to, d, w, local in zip(*(b[c] for c in ("src", "to", "d", "w", "own")), strict=True):
                tree, lost = g.tree(int(np.searchsorted(own, source)), np.searchsorted(own, np.asarray(to)))
                scale = np.where(np.asarray(local, bool), factors[1], factors[0])
                tree = tree or {k: np.zeros(0, np.int32) for k in ("parent", "edge", "level", "at")}
                out.append({**tree, "d": np.asarray(d, float)[: len(tree["at"])], "w": (np.asarray(w, float) * scale)[: len(tree["at"])], "lost": lost})
            yield pd.DataFrame(out, columns=["parent", "edge", "level", "at", "d", "w", "lost"])

    goals = rows.select("src", F.col("goals.dst").alias("to"), F.col("goals.d").alias("d"), F.col("goals.w").alias("w"), F.col("goals.own").alias("own"))
    return goals.mapInPandas(run, TREES)


def tree_objective(rows: DataFrame, ids: np.ndarray, graph: Graph, metric: Metric, factors: tuple[float, float] = (1.0, 1.0), local_trees: int | None = None) -> tuple[Callable, Callable]:
    """(value and gradient of the frozen paths' raw stress at given coordinates, what to call when it is done)."""
    context = ship(rows.sparkSession).sparkContext
    held = context.broadcast((ids, graph))
    trees, (_, lost, nodes) = written_with(_frozen(rows, held, factors), "trees", F.sum("lost"), F.sum(F.size("parent")))
    held.unpersist()
    if lost:
        drop(trees)
        raise ValueError("an active pair is unreachable")
    if (nodes or 0) <= (LOCAL_TREES if local_trees is None else local_trees):
        forest = Forest(trees.drop("lost").toPandas())
        drop(trees)
        return lambda x: graph.raw(x, metric, [forest]), lambda: None
    shared = context.broadcast(graph)
    trees = trees.drop("lost").persist(StorageLevel.DISK_ONLY)

    def raw(x: np.ndarray) -> tuple[float, np.ndarray]:
        held = context.broadcast(x)

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at = held.value
            value, grad = shared.value.raw(at, metric, (Forest(b) for b in batches if len(b)))
            yield pd.DataFrame({"v": [value], "g": [grad.ravel()]})

        out = summed_parts(trees.mapInPandas(part, "v double, g array<double>"), x.shape)
        held.unpersist()
        return out

    def close() -> None:
        trees.unpersist()
        shared.unpersist()
        drop(trees)

    return raw, close


def direct_objective(pairs: DataFrame, ids: np.ndarray, metric: Metric, margin: float | None = None) -> tuple[int, float, Callable]:
    """(number of pairs, sum of w d^2, value and gradient of the direct raw stress), on the driver if pairs are few."""
    kept, (n, denom) = written_with(pairs.select("src", "dst", "d", "w"), "direct", F.sum(F.col("w") * F.col("d") * F.col("d")))
    if n > LOCAL_PAIRS:
        packed = packed_pairs(kept, ids)
        drop(kept)
        return n, float(denom), lambda x: packed_raw(packed, x, metric, margin)
    got = kept.orderBy("src", "dst").toPandas()
    arrays = O.PairArrays(np.searchsorted(ids, got["src"]), np.searchsorted(ids, got["dst"]), got["d"].to_numpy(float), got["w"].to_numpy(float))
    drop(kept)
    return n, float(denom or 0.0), lambda x: O.direct_raw(x, arrays, metric, margin)


def path_frozen(
    dissim: DataFrame, metric: Metric, n_components: int = 2, graph_neighbors: int = 10, outer_iter: int = 20, inner_iter: int = 5, eps: float = 1e-4,
    n_local_pairs: int | None = None, local_pair_mode: str = "direct", n_landmark: int = 0, random_landmark_fraction: float = 1.0, resample: bool = True,
    targets_per_landmark: int | None = None, local_weight: float = 1.0, local_global_reweighting: str = "count", direct_stress_weight: float = 0.0,
    direct_stress_mode: str = "mds", direct_stress_margin: float = 0.5, outer_step_size: float = 1.0, weights: DataFrame | None = None,
    init: np.ndarray | None = None, seed: int = 0, full_stress: bool = False, local_trees: int | None = None,
) -> Result:
    """Alternates between freezing shortest paths on the embedding's graph and fitting the lengths of those paths.

    The history has the seconds of optimization so far. With ``full_stress`` it also has the stress of all pairs on the
    connected graph, at the steps that ``log_every`` gives and the last; their time does not count. The graph has at most
    ``BROADCAST_EDGES`` edges. Trees of more than ``local_trees`` nodes stay in Spark; both ways give the same.
    """
    if local_pair_mode not in ("direct", "geodesic") or direct_stress_mode not in ("none", "mds", "hinge"):
        raise ValueError("unknown mode")
    spark, base = dissim.sparkSession, P.allowed_pairs(dissim, weights)
    found = base.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    ids = np.sort(found.toPandas()["id"].to_numpy(np.int64))
    if len(ids) * graph_neighbors * 2 > BROADCAST_EDGES:
        raise ValueError("the graph of these points has more edges than may be broadcast")
    x0 = x = P.initial_embedding(ids, n_components, seed, init)
    nothing = (0, 0.0, lambda y: (0.0, np.zeros_like(y)))
    margin = direct_stress_margin if direct_stress_mode == "hinge" else None
    everything = direct_objective(base, ids, metric, margin) if direct_stress_weight and direct_stress_mode != "none" else nothing
    stochastic = bool(targets_per_landmark) or bool(n_landmark and resample)
    local = written(P.local_pairs(base, dissim, n_local_pairs).select("src", "dst", "d", "w"), "local") if n_local_pairs else None
    mine = P.pair_totals(local).first().asDict() if local is not None else None
    direct, history, last, spent, turns = nothing, [], None, 0.0, []
    goals = known = turn = None
    for outer in range(outer_iter):
        began = time.monotonic()
        if not turns and (goals is None or (stochastic and resample)):
            turns = [seed + i for i in (range(outer, min(outer + TURNS, outer_iter)) if stochastic and resample else range(1))]
            if goals is not None:
                drop(goals)
            nodes = spark.createDataFrame(pd.DataFrame({"id": ids}))
            sampled = P.build_turns(base, dissim, nodes, turns, local, n_landmark, targets_per_landmark, random_landmark_fraction)
            goals, known = P.goals_of_turns(sampled, local if local_pair_mode == "geodesic" else None, turns)
        turn = turns.pop(0) if turns else turn
        totals = known.get(turn, {"n_pairs": 0, "mass": 0.0, "denom": 0.0})
        factors = P.balance(mine, totals, local_global_reweighting, local_weight)
        if local is not None and local_pair_mode == "direct":
            direct = direct_objective(local.withColumn("w", F.col("w") * factors[1]), ids, metric)
        graph = Graph(x, metric, graph_neighbors, spark)
        tree, close = tree_objective(goals.where(F.col("turn") == turn), ids, graph, metric, factors, local_trees)
        own = (mine["denom"] or 0.0) * factors[1] if mine else 0.0
        denom = own + (totals["denom"] or 0.0) * factors[0] + direct_stress_weight * everything[1] * (margin or 1) ** 2

        def objective(y, tree=tree, direct=direct, denom=denom):
            terms = [(1.0, tree(y)), (1.0, direct[2](y)), (direct_stress_weight, everything[2](y))]
            raw, g = sum(f * v for f, (v, _) in terms), sum(f * p for f, (_, p) in terms)
            if not np.isfinite(raw):
                raise ValueError("a path has a forbidden edge")
            return O.normalize(raw, g, denom)

        best, s, _ = lbfgs(objective, x, inner_iter)
        close()
        x = x + outer_step_size * (best - x)
        done = not stochastic and last is not None and abs(1 - s / last) < eps
        spent += time.monotonic() - began
        history.append({"step": outer + 1, "stress": s, "elapsed": spent})
        if full_stress and (done or outer + 1 == outer_iter or outer % log_every(outer_iter) == 0):
            from anisomap.operators.evaluate import full_geodesic_stress

            y = Result(ids, x, s).frame(spark)
            history[-1]["full_stress"] = full_geodesic_stress(base, y, metric, graph_neighbors).first()["normalized"]
        if done:
            break
        last = s
    return Result(ids, x, history[-1]["stress"] if history else float("nan"), history, x0)
