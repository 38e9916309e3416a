"""Embedding optimizers. The state (n x d numbers) is on the driver; objectives over pairs are summed where the pairs are.

Pairs of at most ``LOCAL_PAIRS`` are collected once and evaluated by the same NumPy kernel on the driver, as a Spark job
per evaluation would cost more than the evaluation. Beyond that every evaluation is a job that returns one row a partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anisomap.functions.metrics import Metric, Randers
from anisomap.operators import objectives as O
from anisomap.operators import pairs as P
from anisomap.operators.fuzzy import curve_parameters, directed_fuzzy_graph, epochs_per_sample, spectral_start
from anisomap.operators.paths import Rows, soft_floyd_warshall, soft_floyd_warshall_pullback
from anisomap.operators.spectral import GATHERED
from anisomap.operators.support import knn_support
from anisomap.session import ship
from anisomap.storage import written, written_with

LOCAL_PAIRS = 2_000_000
#: Relaxations (sources x edges x rounds) of a soft path fit that are evaluated on the driver; beyond, tasks relax a source batch each.
LOCAL_RELAXED = 20_000_000
#: Numbers that a batch of sources may keep for the way back.
TRACED = 1 << 24


@dataclass
class Result:
    ids: np.ndarray
    y: np.ndarray
    stress: float
    history: list[dict] = field(default_factory=list)
    init: np.ndarray | None = None

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(pd.DataFrame({"id": self.ids, "y": self.y.tolist()}), "id long, y array<double>")

    def history_frame(self, spark: SparkSession) -> DataFrame:
        """(step, stress), and the full stresses where they were taken."""
        rows = [(h["step"], float(h["stress"]), h.get("full_stress")) for h in self.history or [{"step": 0, "stress": self.stress}]]
        out = spark.createDataFrame(rows, "step long, stress double, full_stress double")
        return out if any(r[2] is not None for r in rows) else out.drop("full_stress")


def lbfgs(fun: Callable, x0: np.ndarray, max_iter: int = 300, gtol: float = 1e-6, memory: int = 10, seen: Callable | None = None) -> tuple[np.ndarray, float, int]:
    """Limited-memory quasi-Newton minimum with a strong-Wolfe line search; returns (x, value, iterations)."""
    x, (f, g) = x0.copy(), fun(x0)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for it in range(max_iter):
        if np.abs(g).max(initial=0) <= gtol:
            return x, f, it
        q, kept = g.copy(), []
        for s, y, r in reversed(pairs):
            a = r * (s * q).sum()
            q -= a * y
            kept.append(a)
        if pairs:
            s, y, _ = pairs[-1]
            q *= (s * y).sum() / (y * y).sum()
        else:
            q /= max(1.0, np.sqrt((g * g).sum()))
        for (s, y, r), a in zip(pairs, reversed(kept), strict=True):
            q += s * (a - r * (y * q).sum())
        p = -q
        slope = (p * g).sum()
        if slope >= 0:
            p, slope, pairs = -g, -(g * g).sum(), []
        step = _wolfe(fun, x, f, slope, p)
        if step is None:
            return x, f, it
        t, f_new, g_new = step
        s, y = t * p, g_new - g
        if (sy := (s * y).sum()) > 1e-12 * (y * y).sum():
            pairs = [*pairs, (s, y, 1 / sy)][-memory:]
        done = abs(f - f_new) <= 1e-12 * max(1.0, abs(f))
        x, f, g = x + s, f_new, g_new
        if seen:
            seen(it + 1, x, f)
        if done:
            return x, f, it + 1
    return x, f, max_iter


def _wolfe(fun: Callable, x: np.ndarray, f0: float, slope0: float, p: np.ndarray, c1: float = 1e-4, c2: float = 0.9):
    """(step, value, gradient) by bracketing and bisection with interpolation; None if no decrease is found."""
    lo, hi, t, best = 0.0, np.inf, 1.0, None
    for _ in range(30):
        try:
            f, g = fun(x + t * p)
        except ValueError:  # a forbidden direction: shorten
            f, g = np.inf, None
        if not np.isfinite(f) or f > f0 + c1 * t * slope0:
            hi = t
        else:
            best = (t, f, g)
            slope = (g * p).sum()
            if abs(slope) <= -c2 * slope0:
                return best
            if slope > 0:
                hi = t
            else:
                lo = t
        t = (lo + hi) / 2 if np.isfinite(hi) else 2 * t
    return best


def collect_pairs(pairs: DataFrame) -> tuple[np.ndarray, O.PairArrays]:
    got = pairs.select("src", "dst", "d", "w").orderBy("src", "dst").toPandas()
    ids = np.unique(np.concatenate([got["src"], got["dst"]])) if len(got) else np.zeros(0, np.int64)
    return ids, O.PairArrays(np.searchsorted(ids, got["src"]), np.searchsorted(ids, got["dst"]), got["d"].to_numpy(float), got["w"].to_numpy(float))


def distributed_raw(pairs: DataFrame, ids: np.ndarray, x: np.ndarray, metric: Metric, margin: float | None = None) -> tuple[float, np.ndarray]:
    """Raw stress and gradient of pairs of any number: one partial row a partition."""
    held = ship(pairs.sparkSession).sparkContext.broadcast((ids, x))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, at = held.value
        value, grad = 0.0, np.zeros_like(at)
        for b in batches:
            arrays = O.PairArrays(np.searchsorted(own, b["src"]), np.searchsorted(own, b["dst"]), b["d"].to_numpy(float), b["w"].to_numpy(float))
            v, g = O.direct_raw(at, arrays, metric, margin)
            value, grad = value + v, grad + g
        yield pd.DataFrame({"v": [value], "g": [grad.ravel()]})

    out = summed_parts(pairs.select("src", "dst", "d", "w").mapInPandas(part, "v double, g array<double>"), x.shape)
    held.unpersist()
    return out


#: Most pairs of a packed row: Spark's reader takes 4096 rows at once.
PACKED = 256
#: Numbers of gradients that tasks may send to the driver at once; beyond, task by task.
COLLECTED = 1 << 24


def summed_parts(parts: DataFrame, shape: tuple[int, int]) -> tuple[float, np.ndarray]:
    """Sums of rows (v, g), one a task; tasks run side by side as long as their gradients are few."""
    size = int(np.prod(shape))
    value, grad = 0.0, np.zeros(size)
    few = parts.rdd.getNumPartitions() * size <= COLLECTED
    for r in parts.collect() if few else parts.toLocalIterator(prefetchPartitions=True):
        value, grad = value + r.v, grad + np.array(r.g)
    return value, grad.reshape(shape)


def packed_pairs(pairs: DataFrame, ids: np.ndarray) -> DataFrame:
    """Pairs as a table (src, n, dst, d, w) of n pairs of a source a row, without a shuffle.

    Ends are places in ``ids``; those of n pairs, and their numbers, are bytes, which Spark hands on as they are.
    """
    own = ship(pairs.sparkSession).sparkContext.broadcast(ids)

    def pack(columns: list[np.ndarray]) -> pa.RecordBatch:
        src, dst = (np.searchsorted(own.value, c).astype(np.int32) for c in columns[:2])
        order = np.lexsort((dst, src))
        src = src[order]
        start = np.searchsorted(src, src)
        start = np.flatnonzero((np.arange(len(src)) - start) % PACKED == 0)
        ends = np.append(start, len(src))
        flat = [c[order] for c in (dst, *columns[2:])]
        kept = [pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer((ends * c.itemsize).astype(np.int32)), pa.py_buffer(c)]) for c in flat]
        return pa.RecordBatch.from_arrays([pa.array(src[start]), pa.array(np.diff(ends).astype(np.int32)), *kept], ["src", "n", "dst", "d", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            size += b.num_rows
            if size >= GATHERED:
                yield pack([np.concatenate(c) for c in zip(*held, strict=True)])
                held, size = [], 0
        if size:
            yield pack([np.concatenate(c) for c in zip(*held, strict=True)])

    rows = pairs.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("d").cast("double"), F.col("w").cast("double"))
    return written(rows.mapInArrow(run, "src int, n int, dst binary, d binary, w binary"), "packed")


def packed_raw(packed: DataFrame, x: np.ndarray, metric: Metric, margin: float | None = None) -> tuple[float, np.ndarray]:
    """``distributed_raw`` of ``packed_pairs``."""
    held = ship(packed.sparkSession).sparkContext.broadcast(x)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = held.value
        value, grad = 0.0, np.zeros_like(at)
        for b in batches:
            if not b.num_rows:
                continue
            size = b.column(1).to_numpy()
            dst, d, w = (np.frombuffer(b"".join(b.column(i).to_pylist()), kind) for i, kind in ((2, np.int32), (3, float), (4, float)))
            arrays = O.PairArrays(np.repeat(b.column(0).to_numpy(), size), dst, d, w)
            v, g = O.direct_raw(at, arrays, metric, margin)
            value, grad = value + v, grad + g
        yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([grad.ravel()])], ["v", "g"])

    out = summed_parts(packed.select("src", "n", "dst", "d", "w").mapInArrow(part, "v double, g array<double>"), x.shape)
    held.unpersist()
    return out


def gradient_descent(dissim: DataFrame, metric: Metric, n_components: int = 2, max_iter: int = 300, eps: float = 1e-6, weights: DataFrame | None = None, mask: DataFrame | None = None, init: np.ndarray | None = None, normalized: bool = False, seed: int | None = None) -> Result:
    """Quasi-Newton minimum of the direct stress; the diagonal takes no part."""
    pairs = P.allowed_pairs(dissim, weights, mask)
    P.validate_pairs(pairs)
    n = pairs.count()
    if n <= LOCAL_PAIRS:
        ids, arrays = collect_pairs(pairs)
        raw, denom = (lambda x: O.direct_raw(x, arrays, metric)), arrays.denom
    else:
        ids = np.array(sorted(r[0] for r in pairs.select(F.explode(F.array("src", "dst"))).distinct().collect()))
        denom = pairs.agg(F.sum(F.col("w") * F.col("d") * F.col("d"))).first()[0]
        packed = packed_pairs(pairs, ids)
        raw = lambda x: packed_raw(packed, x, metric)
    x0, history = P.initial_embedding(ids, n_components, seed, init), []
    fun = (lambda x: O.normalize(*raw(x), denom)) if normalized else raw
    x, f, _ = lbfgs(fun, x0, max_iter, eps, seen=lambda i, _, v: history.append({"step": i, "stress": v}))
    return Result(ids, x, f, history, x0)


def _dense(dissim: DataFrame, weights: DataFrame | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, p = collect_pairs(P.allowed_pairs(dissim, weights))
    d, w = np.zeros((len(ids),) * 2), np.zeros((len(ids),) * 2)
    d[p.src, p.dst], w[p.src, p.dst] = p.d, p.w
    return ids, d, w


def smacof_randers(
    dissim: DataFrame, alpha: float = 0.0, n_components: int = 2, n_init: int = 8, max_iter: int = 300, eps: float = 1e-3, weights: DataFrame | None = None,
    init: np.ndarray | None = None, solver: str = "gmres", project: bool = False, check_monotony: bool = True, version: str = "corrected", seed: int = 0,
) -> Result:
    """Majorization for Randers lengths; of ``n_init`` starts the one with the least stress is kept.

    ``version``: ``corrected``, or ``legacy`` with its own last-axis factor and stopping tolerance. ``solver``:
    ``closed`` (equal weights, projected), ``cg``, ``gmres`` (restarted) or ``pinv``.
    """
    Randers(alpha)
    if version not in ("corrected", "legacy") or solver not in ("closed", "cg", "gmres", "pinv"):
        raise ValueError("unknown version or solver")
    ids, d, w = _dense(dissim, weights)
    if version == "corrected" and not np.allclose(w, w.T):
        raise ValueError("weights must be symmetric")
    if (w < 0).any():
        raise ValueError("weights must not be negative")
    runs = [_smacof(d, w, P.initial_embedding(ids, n_components, seed + i, init), alpha, max_iter, eps, solver, project, check_monotony, version) for i in range(1 if init is not None else n_init)]
    x, s, history, x0 = min(runs, key=lambda r: r[1])
    return Result(ids, x, s, history, x0)


def _smacof(d, w, x, alpha, max_iter, eps, solver, project, check, version):
    n, x0, metric = len(d), x, Randers(alpha)
    degree = np.diag(w.sum(1)) - w
    last = alpha**2 if version == "corrected" else 1.0
    skew = alpha * (w * d - (w * d).T).sum(1)
    pinv = np.linalg.pinv(degree) if solver == "pinv" else None
    off = w[~np.eye(n, dtype=bool)] if n > 1 else w.ravel()
    uniform = project and len(off) and np.allclose(off, off[0])

    def value(y):
        gap = metric.pairwise(y) - d
        return float((w * gap * gap).sum())

    s, history = value(x), []
    for it in range(max_iter):
        gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        target = (d + d.T) / 2 if version == "corrected" else d - alpha * (x[None, :, -1] - x[:, None, -1])
        b = -w * target / np.where(gap > 0, gap, 1e-5)
        np.fill_diagonal(b, 0)
        np.fill_diagonal(b, -b.sum(1))
        r = b @ x
        r[:, -1] -= skew / 2 if version == "corrected" else skew
        if uniform or solver == "closed":
            new = (r - r.mean(0)) / (n * off[0])
        elif solver == "pinv":
            new = pinv @ r
        else:
            solve = _gmres if solver == "gmres" else _conjugate
            new = np.stack([solve(degree, r[:, j] - r[:, j].mean(), x[:, j] - x[:, j].mean()) for j in range(r.shape[1])], 1)
        new[:, -1] /= 1 + last if alpha else 1.0
        now = value(new)
        rise = 1e-10 * max(1.0, abs(s)) if version == "corrected" else 0.1
        if check and now > s + rise:
            break
        done = check and abs(s - now) < eps * max(s, 1e-300)
        x, s = new, now
        history.append({"step": it + 1, "stress": s})
        if done:
            break
    return x, s, history, x0


def _conjugate(a: np.ndarray, b: np.ndarray, x: np.ndarray, tol: float = 1e-10) -> np.ndarray:
    r = b - a @ x
    p, rr = r.copy(), r @ r
    for _ in range(2 * len(b)):
        if rr <= tol * tol * max(1.0, b @ b):
            break
        ap = a @ p
        if (c := p @ ap) <= 0:
            break
        x, r = x + rr / c * p, r - rr / c * ap
        rr, old = r @ r, rr
        p = r + rr / old * p
    return x


def _gmres(a: np.ndarray, b: np.ndarray, x: np.ndarray, tol: float = 1e-10, restart: int = 40, turns: int = 20) -> np.ndarray:
    """Least residual over Krylov spaces: an orthonormal basis by Gram-Schmidt, done twice, and a small least-squares problem a turn."""
    size = max(1.0, float(np.linalg.norm(b)))
    for _ in range(turns):
        r = b - a @ x
        beta = float(np.linalg.norm(r))
        if beta <= tol * size:
            break
        steps = min(restart, len(b))
        basis, h = np.zeros((steps + 1, len(b))), np.zeros((steps + 1, steps))
        basis[0], used = r / beta, steps
        for j in range(steps):
            w = a @ basis[j]
            for _ in range(2):
                part = basis[: j + 1] @ w
                h[: j + 1, j] += part
                w = w - part @ basis[: j + 1]
            h[j + 1, j] = np.linalg.norm(w)
            if h[j + 1, j] <= 1e-14 * size:
                used = j + 1
                break
            basis[j + 1] = w / h[j + 1, j]
        target = np.zeros(used + 1)
        target[0] = beta
        x = x + np.linalg.lstsq(h[: used + 1, :used], target, rcond=None)[0] @ basis[:used]
    return x


def soft_relaxations(n: int, tail: np.ndarray, head: np.ndarray, cost: np.ndarray, beta: float, rounds: int, sources: np.ndarray, target: Callable | None = None):
    """Soft distances of a batch of sources, (sources, nodes); with ``target`` (distances to gradient) also the edges' gradient.

    The way back keeps the distances of every round, and finds the edges' shares from these again.
    """
    order = np.argsort(head, kind="stable")
    tail, head, step = tail[order], head[order], cost[order][:, None]
    ids, start = np.unique(head, return_index=True)
    group = np.searchsorted(ids, head)
    rows, trace = np.arange(len(sources)), []
    d = np.full((n, len(sources)), np.inf)
    d[sources, rows] = 0

    def shares(d: np.ndarray) -> tuple[np.ndarray, ...]:
        """Minima over keeping and incoming edges, their shares, and the shares' sums, of nodes with incoming edges."""
        take = d.take(tail, 0)
        take += step
        low = np.minimum(d[ids], np.minimum.reduceat(take, start, axis=0))
        # What is infinite has no share: base is finite.
        base = np.where(np.isfinite(low), low, 0)
        keep = np.exp(-beta * (d[ids] - base))
        take -= base.take(group, 0)
        take *= -beta
        np.exp(take, out=take)
        return base, keep, take, keep + np.add.reduceat(take, start, axis=0)

    for _ in range(rounds if len(ids) else 0):
        if target is not None:
            trace.append(d)
        base, _, _, total = shares(d)
        d = d.copy()
        d[ids] = np.where(total > 0, base - np.log(np.where(total > 0, total, 1)) / beta, np.inf)
        d[sources, rows] = 0
    if target is None:
        return d.T
    g, edge = np.ascontiguousarray(target(d.T).T), np.zeros(len(cost))
    by_tail = np.argsort(tail, kind="stable")
    out_of, first = np.unique(tail[by_tail], return_index=True)
    own, at = np.nonzero(head[:, None] == sources[None, :])
    for before in reversed(trace):
        _, keep, take, total = shares(before)
        safe = np.where(total > 0, total, 1)
        take /= safe.take(group, 0)
        take[own, at] = 0
        take *= g.take(head, 0)
        edge += take.sum(1)
        kept = g[sources, rows]
        g[ids] *= keep / safe
        g[sources, rows] = kept
        g[out_of] += np.add.reduceat(take.take(by_tail, 0), first, axis=0)
    out = np.empty(len(cost))
    out[order] = edge
    return d.T, out


def _relaxed(n: int, graph: tuple, beta: float, rounds: int, batch: int, goals: Iterator[tuple]) -> tuple[float, float, int, np.ndarray]:
    """(raw stress, w d^2 of unreachable targets, their number, gradient by the edges' costs) of goals (source, targets, d, w).

    ``graph``: (tail, head, cost) of the edges. ``batch`` sources are relaxed at once, or fewer, if their rounds need more than ``TRACED`` numbers.
    """
    tail, head, cost = graph
    batch = max(1, min(batch, TRACED // max(1, n * rounds)))
    raw, skipped, lost, edge, goals = 0.0, 0.0, 0, np.zeros(len(cost)), iter(goals)
    while some := list(islice(goals, batch)):
        s = np.repeat(np.arange(len(some)), [len(g[1]) for g in some])
        t, want, w = (np.concatenate([np.asarray(g[i], kind) for g in some]) for i, kind in ((1, np.int64), (2, float), (3, float)))
        seen = {}

        def target(d, s=s, t=t, want=want, w=w, seen=seen):
            ok = np.isfinite(d[s, t])
            gap = np.where(ok, d[s, t] - want, 0)
            seen.update(raw=float((w * gap * gap).sum()), skipped=float((w * want**2)[~ok].sum()), lost=int((~ok).sum()))
            g = np.zeros_like(d)
            np.add.at(g, (s, t), 2 * w * gap)
            return g

        edge += soft_relaxations(n, tail, head, cost, beta, rounds, np.array([g[0] for g in some]), target)[1]
        raw, skipped, lost = raw + seen["raw"], skipped + seen["skipped"], lost + seen["lost"]
    return raw, skipped, lost, edge


def _goals(b: pd.DataFrame, ids: np.ndarray) -> Iterator[tuple]:
    """Goals of rows (src, dst, d, w) whose last three are arrays, by places in ``ids``."""
    for src, dst, d, w in zip(*(b[c] for c in ("src", "dst", "d", "w")), strict=True):
        yield int(np.searchsorted(ids, src)), np.searchsorted(ids, np.asarray(dst)), d, w


def _most_edges(n: int, graph: tuple, goals: Iterator[tuple]) -> int:
    """The most edges that shortest ways to goals have."""
    rows, most = Rows(*graph), 0
    for source, to, *_ in goals:
        at, goal = np.searchsorted(rows.ids, source), np.asarray(to)
        if at < len(rows.ids) and rows.ids[at] == source:
            hops = np.full(n, -1)
            hops[rows.ids] = rows.search(int(at))[1]
            most = max(most, int(hops[goal].max(initial=0)))
    return most


def settled_rounds(goals: DataFrame, ids: np.ndarray, graph: tuple, local: bool) -> int:
    """Rounds after which hard minima would not change at any goal: the most edges of shortest ways to goals (at least 1)."""
    if local:
        return max(1, _most_edges(len(ids), graph, _goals(goals.toPandas(), ids)))
    held = ship(goals.sparkSession).sparkContext.broadcast((ids, graph))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, edges = held.value
        yield pd.DataFrame({"most": [_most_edges(len(own), edges, (g for b in batches for g in _goals(b, own)))]})

    most = goals.mapInPandas(part, "most long").agg(F.max("most")).first()[0]
    held.unpersist()
    return max(1, most or 0)


def relaxed_objective(goals: DataFrame, ids: np.ndarray, beta: float, rounds: int, batch: int, local: bool) -> Callable[[tuple], tuple[float, float, int, np.ndarray]]:
    """``_relaxed`` of a graph over goals (src, dst, d, w: one row a source), on the driver if ``local``; else a job, with one row a task back."""
    if local:
        kept = list(_goals(goals.orderBy("src").toPandas(), ids))
        return lambda graph: _relaxed(len(ids), graph, beta, rounds, batch, kept)
    context = ship(goals.sparkSession).sparkContext
    own = context.broadcast(ids)

    def job(graph: tuple) -> tuple[float, float, int, np.ndarray]:
        held = context.broadcast(graph)

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            raw, skipped, lost, edge = _relaxed(len(own.value), held.value, beta, rounds, batch, (g for b in batches for g in _goals(b, own.value)))
            yield pd.DataFrame({"raw": [raw], "skipped": [skipped], "lost": [lost], "edge": [edge]})

        got = goals.mapInPandas(part, "raw double, skipped double, lost long, edge array<double>").toPandas()
        held.unpersist()
        return float(got["raw"].sum()), float(got["skipped"].sum()), int(got["lost"].sum()), np.sum(got["edge"].tolist(), 0) if len(got) else np.zeros(len(graph[2]))

    return job


def soft_path_fit(
    dissim: DataFrame, metric: Metric, method: str, n_components: int = 2, graph_neighbors: int = 10, beta: float = 10.0, n_relaxations: int | str | None = None, max_iter: int = 100,
    n_graph_updates: int = 1, n_local_pairs: int | None = None, local_pair_mode: str | None = None, n_landmark: int = 0, targets_per_landmark: int | None = None, local_weight: float = 1.0,
    local_global_reweighting: str = "none", source_batch_size: int = 8, on_unreachable: str = "warn_skip", weights: DataFrame | None = None, init: np.ndarray | None = None, seed: int = 0, local_relaxed: int | None = None,
) -> Result:
    """Fit of soft shortest paths on the embedding's graph: a geodesic term and a term of direct local pairs, normalized together.

    Relaxed paths keep their pairs in Spark, one row a source; of more than ``local_relaxed`` relaxations an evaluation is a
    job. Both ways give the same. ``floyd_warshall`` holds the dense matrix and all pairs on the driver.

    ``n_relaxations``: a number, all that ways can have (None), or ``settled``: as many as ``settled_rounds`` finds on each
    graph, so that no goal that has a way is skipped. Targets that a given number of rounds does not reach are skipped.
    """
    from anisomap.operators.frozen import direct_objective

    if on_unreachable not in ("raise", "warn_skip") or method not in ("bellman_ford", "floyd_warshall"):
        raise ValueError("unknown method or on_unreachable")
    if isinstance(n_relaxations, str) and n_relaxations != "settled":
        raise ValueError("n_relaxations is a number, None or settled")
    geodesic_local = (local_pair_mode or ("direct" if method == "bellman_ford" else "geodesic")) == "geodesic"
    spark = dissim.sparkSession
    pairs = written(P.build_pairs(dissim, weights, n_local_pairs, n_landmark, targets_per_landmark, local_global_reweighting, local_weight, 1.0, seed), "soft-pairs")
    ids = np.sort(pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct().toPandas()["id"].to_numpy(np.int64))
    n, x0, history = len(ids), P.initial_embedding(ids, n_components, seed, init), []
    direct = F.lit(False) if geodesic_local else F.col("grp") == "local"
    _, local_denom, local = direct_objective(pairs.where(direct), ids, metric)
    rest, rounds, x, s = pairs.where(~direct), n_relaxations or n - 1, x0, float("nan")
    if method == "floyd_warshall":
        got = rest.toPandas()
        every = O.PairArrays(np.searchsorted(ids, got["src"]), np.searchsorted(ids, got["dst"]), got["d"].to_numpy(float), got["w"].to_numpy(float))
        rest_denom = every.denom
    else:
        goal = F.sort_array(F.collect_list(F.struct("dst", "d", "w"))).alias("g")
        parts = spark.sparkContext.defaultParallelism
        goals = rest.repartition(parts, "src").groupBy("src").agg(goal).select("src", *[F.col(f"g.{c}").alias(c) for c in ("dst", "d", "w")])
        total = F.sum(F.aggregate(F.arrays_zip("d", "w"), F.lit(0.0), lambda a, g: a + g["w"] * g["d"] * g["d"]))
        goals, (n_sources, rest_denom) = written_with(goals, "goals", total)
        rest_denom = rest_denom or 0.0
    for update in range(n_graph_updates):
        tail, head = knn_support(x, graph_neighbors, connected=method == "bellman_ford", spark=spark)
        if method == "bellman_ford":
            if n_relaxations == "settled":
                cost = metric.length(x[head] - x[tail])
                ok = np.isfinite(cost)
                rounds = settled_rounds(goals, ids, (tail[ok], head[ok], cost[ok]), n_sources * len(tail) <= LOCAL_RELAXED // 8)
            few = n_sources * len(tail) * rounds <= (LOCAL_RELAXED if local_relaxed is None else local_relaxed)
            relaxed = relaxed_objective(goals, ids, beta, rounds, source_batch_size, few)

        def objective(y, tail=tail, head=head):
            u = y[head] - y[tail]
            cost = metric.length(u)
            ok = np.isfinite(cost)
            adjoint = np.zeros(len(cost))
            if method == "floyd_warshall":
                m = np.full((n, n), np.inf)
                m[tail[ok], head[ok]] = cost[ok]
                d, kept = soft_floyd_warshall(m, beta, trace=True)
                if not np.isfinite(d[every.src, every.dst]).all():
                    raise ValueError("an active pair is unreachable")
                gap, g, skipped = d[every.src, every.dst] - every.d, np.zeros_like(d), 0.0
                np.add.at(g, (every.src, every.dst), 2 * every.w * gap)
                raw = float((every.w * gap * gap).sum())
                adjoint = soft_floyd_warshall_pullback(kept, g)[tail, head]
            else:
                raw, skipped, lost, adjoint[ok] = relaxed((tail[ok], head[ok], cost[ok]))
                if lost and on_unreachable == "raise":
                    raise ValueError("an active pair is unreachable")
            pull = adjoint[:, None] * np.where(ok[:, None], metric.grad(u), 0)
            g = np.zeros_like(y)
            np.add.at(g, head, pull)
            np.add.at(g, tail, -pull)
            raw2, g2 = local(y)
            return O.normalize(raw + raw2, g + g2, rest_denom - skipped + local_denom)

        x, s, _ = lbfgs(objective, x, max_iter)
        history.append({"step": update + 1, "stress": s})
    return Result(ids, x, s, history, x0)


def finsler_umap(
    dissim: DataFrame, metric: Metric, n_components: int = 2, n_neighbors: int = 50, symmetric_scales: bool = True, symmetric_support: bool = False, min_dist: float = 0.5,
    spread: float = 1.0, max_iter: int = 1500, negative_sample_rate: int = 10, negative_metric: str = "euclidean", gradient_clip: float = 4.0, learning_rate: float = 1.0,
    repulsion: float = 1.0, init: np.ndarray | None = None, seed: int = 0,
) -> Result:
    """Directed fuzzy graph, then synchronous stochastic updates: due edges attract both ends, random points repel the source."""
    if negative_metric not in ("euclidean", "finsler"):
        raise ValueError("negative_metric is euclidean or finsler")
    p = epochs_per_sample(directed_fuzzy_graph(dissim, n_neighbors, 1.0, symmetric_scales, symmetric_support), max_iter).orderBy("src", "dst").toPandas()
    ids = np.array(sorted(r[0] for r in dissim.select(F.explode(F.array("src", "dst"))).distinct().collect()))
    src, dst, every = np.searchsorted(ids, p["src"]), np.searchsorted(ids, p["dst"]), p["every"].to_numpy(float)
    n, r = len(ids), np.random.default_rng(seed)
    x0 = x = spectral_start(n, src, dst, p["p"].to_numpy(float), n_components, seed) if init is None else P.initial_embedding(ids, n_components, seed, init)
    a, b = curve_parameters(min_dist, spread)
    due = every.copy()
    repel = Randers(0.0) if negative_metric == "euclidean" else metric
    for epoch in range(max_iter):
        rate = learning_rate * (1 - epoch / max_iter)
        now = np.flatnonzero(due <= epoch + 1)
        if not len(now):
            continue
        due[now] += every[now]
        move = np.zeros_like(x)
        u = x[dst[now]] - x[src[now]]
        f = metric.length(u)
        ok = np.isfinite(f) & (f > 1e-12)
        q = 1 / (1 + a * np.where(ok, f, 1) ** (2 * b))
        pull = np.where(ok, 2 * b * (1 - q) / np.where(ok, f, 1), 0)[:, None] * np.where(ok[:, None], metric.grad(u), 0)
        pull = np.clip(pull, -gradient_clip, gradient_clip)
        np.add.at(move, src[now], pull)
        np.add.at(move, dst[now], -pull)
        s = np.repeat(src[now], negative_sample_rate)
        t = (s + r.integers(1, n, len(s))) % n
        u = x[t] - x[s]
        f = repel.length(u)
        ok = np.isfinite(f) & (f > 1e-12)
        f = np.where(ok, f, 1)
        q = 1 / (1 + a * f ** (2 * b))
        push = np.where(ok, repulsion * 2 * b * q / (f * (1e-3 / np.maximum(f, 1e-3) + 1)), 0)[:, None] * np.where(ok[:, None], repel.grad(u), 0)
        np.add.at(move, s, -np.clip(push, -gradient_clip, gradient_clip))
        x = x + rate * np.clip(move, -gradient_clip, gradient_clip)
    return Result(ids, x, float("nan"), [], x0)


def log_every(iterations: int) -> int:
    """How often a run of so many iterations is logged: fixed steps, about 10 to 30 lines a run."""
    return next((step for below, step in ((30, 1), (100, 5), (300, 10), (1000, 50)) if iterations < below), 100)


def multi_stage(dissim: DataFrame, metric: Metric, stages: list[dict], init: np.ndarray | None = None) -> list[Result]:
    """Runs one stage after another (``optimizer`` and its options), each from where the last ended."""
    from anisomap.api import fit

    out: list[Result] = []
    for stage in stages:
        options = dict(stage)
        out.append(fit(dissim, metric, options.pop("optimizer", "path_frozen"), init=init, **options))
        init = out[-1].y
    return out
