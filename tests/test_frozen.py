"""The path-frozen fit: trees against paths edge by edge, Spark against the driver, and the neighbour graph of an array."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from anisomap.api import fit
from anisomap.functions.metrics import ConvexMatsumoto, Randers
from anisomap.operators import frozen as Z
from anisomap.operators import objectives as O
from anisomap.operators import pairs as P
from anisomap.operators import support as N
from tests.test_operators import edges


def brute_support(x, k):
    """The k nearest of each point both ways, parts linked by the closest pair of the part of point 0 and any other."""
    n = len(x)
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    d[np.arange(n), np.arange(n)] = np.inf
    near = np.lexsort((np.broadcast_to(np.arange(n), (n, n)), d), axis=1)[:, :k]
    both = {(i, int(j)) for i in range(n) for j in near[i]}
    both |= {(b, a) for a, b in both}
    while True:
        inside, todo = {0}, [0]
        while todo:
            a = todo.pop()
            new = {q for p, q in both if p == a} - inside
            inside |= new
            todo += new
        if len(inside) == n:
            return both
        own, others = sorted(inside), sorted(set(range(n)) - inside)
        a, b = np.unravel_index(d[np.ix_(own, others)].argmin(), (len(own), len(others)))
        both |= {(own[a], others[b]), (others[b], own[a])}


@pytest.mark.parametrize("parts", [1, 6])
def test_neighbour_graph_of_an_array(spark, monkeypatch, parts):
    r = np.random.default_rng(parts)
    x = r.normal(size=(90, 3)) + 20 * r.normal(size=(parts, 3))[r.integers(0, parts, 90)]
    want = brute_support(x, 4)
    assert set(zip(*map(np.ndarray.tolist, N.knn_support(x, 4)), strict=True)) == want
    monkeypatch.setattr(N, "SPREAD", 1)
    assert set(zip(*map(np.ndarray.tolist, N.knn_support(x, 4, spark=spark)), strict=True)) == want
    assert len(N.knn_support(x[:1], 4)[0]) == 0 and len(N.knn_support(np.zeros((5, 2)), 9)[0]) == 20


def brute(x, support, metric, pairs):
    """Raw stress and gradient of the shortest ways of pairs, edge by edge."""
    out = {}
    for a, b in support:
        if np.isfinite(w := float(metric.length((x[b] - x[a])[None])[0])):
            out.setdefault(a, []).append((b, w))
    value, g = 0.0, np.zeros_like(x)
    for s, t, d, w in pairs:
        label, heap, done = {s: (0.0, 0, None)}, [(0.0, 0, s)], set()
        while heap:
            at, h, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            for v, c in out.get(u, []):
                if v not in done and (v not in label or (at + c, h + 1, u) < label[v]):
                    label[v] = (at + c, h + 1, u)
                    heapq.heappush(heap, (at + c, h + 1, v))
        gap = label[t][0] - d
        value += w * gap * gap
        while t != s:
            u = label[t][2]
            pull = 2 * w * gap * metric.grad((x[t] - x[u])[None])[0]
            g[t] += pull
            g[u] -= pull
            t = u
    return value, g


def sample(n=40, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 2))
    rows = [(int(s), int(t), float(d), float(w)) for s, t, d, w in zip(r.integers(0, n, 150), r.integers(0, n, 150), r.random(150) * 3, 0.5 + r.random(150), strict=True) if s != t]
    return x, list({(s, t): (s, t, d, w) for s, t, d, w in rows}.values())


@pytest.mark.parametrize("metric", [Randers(0.4), ConvexMatsumoto(0.3)])
def test_trees_are_paths_edge_by_edge(spark, metric):
    x, rows = sample()
    pairs = spark.createDataFrame([(10 * s, 10 * t, d, w, 5) for s, t, d, w in rows], "src long, dst long, d double, w double, turn long")
    goals, known = P.goals_of_turns(pairs, None, [5])
    assert known[5]["n_pairs"] == len(rows) and known[5]["denom"] == pytest.approx(sum(w * d * d for *_, d, w in rows))
    graph = Z.Graph(x, metric, 5)
    ids, moved = 10 * np.arange(len(x)), x + 0.05 * np.random.default_rng(9).normal(size=x.shape)
    want = brute(x, brute_support(x, 5), metric, rows)
    for bound in (10**6, 0):
        raw, close = Z.tree_objective(goals, ids, graph, metric, local_trees=bound)
        value, g = raw(x)
        assert value == pytest.approx(want[0], rel=1e-12) and np.allclose(g, want[1], rtol=1e-9, atol=1e-12)
        if bound:
            first = raw(moved)
            step = np.array([raw(moved + h)[0] - raw(moved - h)[0] for h in 1e-6 * np.eye(moved.size)[:6].reshape(6, *moved.shape)]) / 2e-6
            assert np.allclose(first[1].ravel()[:6], step, rtol=1e-4, atol=1e-6)
        else:
            again = raw(moved)
            assert again[0] == pytest.approx(first[0], rel=1e-12) and np.allclose(again[1], first[1], rtol=1e-9, atol=1e-12)
        close()


def test_turns_are_what_one_seed_after_the_other_gives(spark):
    x = np.random.default_rng(1).normal(size=(25, 2))
    d = Randers(0.3).pairwise(x)
    dissim = edges(spark, [(i, j, float(d[i, j])) for i in range(25) for j in range(25) if i != j])
    base, nodes = P.allowed_pairs(dissim), spark.range(25)
    local = P.local_pairs(base, dissim, 3).select("src", "dst", "d", "w")
    got = P.build_turns(base, dissim, nodes, [4, 5], local, 6, 8).select("turn", "src", "dst", F.round("w", 9).alias("w")).collect()
    for t in (4, 5):
        one = P.build_pairs(dissim, None, 3, 6, 8, "none", 1.0, 1.0, t).where("grp = 'global'")
        assert {(r.src, r.dst, r.w) for r in got if r.turn == t} == {(r.src, r.dst, r.w) for r in one.select("src", "dst", F.round("w", 9).alias("w")).collect()}


@pytest.mark.parametrize("options", [{}, {"n_local_pairs": 3, "n_landmark": 8, "targets_per_landmark": 10, "local_pair_mode": "geodesic"}, {"n_local_pairs": 3, "n_landmark": 8, "direct_stress_weight": 0.2, "direct_stress_mode": "hinge"}])
def test_fits_in_spark_are_those_on_the_driver(spark, monkeypatch, options):
    x = np.random.default_rng(2).normal(size=(30, 2))
    d = Randers(0.3).pairwise(x)
    dissim = edges(spark, [(i, j, float(d[i, j])) for i in range(30) for j in range(30) if i != j])
    options = {"outer_iter": 2, "inner_iter": 2, "graph_neighbors": 5, "seed": 3} | options
    a = fit(dissim, Randers(0.3), "path_frozen", **options)
    monkeypatch.setattr(Z, "LOCAL_PAIRS", 0)
    monkeypatch.setattr(Z, "TURNS", 1)
    b = fit(dissim, Randers(0.3), "path_frozen", local_trees=0, **options)
    assert np.allclose(a.y, b.y, rtol=1e-9, atol=1e-9) and [h["stress"] for h in a.history] == pytest.approx([h["stress"] for h in b.history], rel=1e-9)
    if not options.get("n_landmark"):
        # The first turn by hand: paths frozen at the start, by brute force, in the same line search.
        rows = [(i, j, float(d[i, j]), 1.0) for i in range(30) for j in range(30) if i != j]
        trees = brute_support(a.init, 5)
        start = brute(a.init, trees, Randers(0.3), rows)
        value, _ = O.normalize(*start, sum(r[2] ** 2 for r in rows))
        assert a.history[0]["stress"] <= value


def test_unreachable_pairs_raise(spark):
    goals, _ = P.goals_of_turns(spark.createDataFrame([(0, 0, 9, 1.0, 1.0)], "turn long, src long, dst long, d double, w double"), None, [0])
    with pytest.raises(ValueError, match="unreachable"):
        Z.tree_objective(goals, np.array([0, 1, 2, 9]), Z.Graph(np.random.default_rng(0).normal(size=(3, 2)), Randers(0.1), 2), Randers(0.1))



def test_soft_paths_of_tasks_are_those_of_the_driver(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(24, 3))
    rows = [(i, j, float(np.sqrt(((x[i] - x[j]) ** 2).sum()) + 0.05 * (x[j, 0] - x[i, 0]))) for i in range(24) for j in range(24) if i != j]
    dissim = spark.createDataFrame(rows, "src long, dst long, d double")
    options = dict(max_iter=3, n_relaxations=5, graph_neighbors=4, n_landmark=9, targets_per_landmark=6, n_local_pairs=3, source_batch_size=2, seed=1)
    a, b = (fit(dissim, ConvexMatsumoto(0.3), "soft_bellman_ford", local_relaxed=n, **options) for n in (None, 0))
    assert np.isfinite(a.stress) and np.allclose(a.y, b.y, atol=1e-9) and abs(a.stress - b.stress) < 1e-12


def test_soft_fit_skips_no_target(spark, sf, monkeypatch):
    from anisomap.operators import optimizers as Q
    from anisomap.plans import fitting

    lost = []
    relaxed = Q._relaxed
    monkeypatch.setattr(Q, "_relaxed", lambda *a: lost.append(relaxed(*a)) or lost[-1])
    monkeypatch.setattr(Q, "LOCAL_RELAXED", 1 << 40)
    assert np.isfinite(fitting.QUERIES["fit_soft_bf"](spark, sf).first()["stress"])
    assert lost and all(got[2] == 0 for got in lost)


@pytest.mark.parametrize("local", [True, False])
def test_settled_rounds_are_the_edges_of_the_longest_way(spark, local):
    from anisomap.operators.optimizers import settled_rounds, soft_relaxations

    # A chain with a dear shortcut: the shortest way to its end has 9 edges.
    tail, head, cost = np.array([*range(9), 0]), np.array([*range(1, 10), 9]), np.array([1.0] * 9 + [50.0])
    goals = spark.createDataFrame([(0, [4, 9], [1.0, 1.0], [1.0, 1.0]), (7, [8], [1.0], [1.0])], "src long, dst array<long>, d array<double>, w array<double>")
    rounds = settled_rounds(goals, np.arange(10), (tail, head, cost), local)
    assert rounds == 9
    assert abs(soft_relaxations(10, tail, head, cost, 100.0, rounds, np.array([0]))[0, 9] - 9) < 0.3
    assert soft_relaxations(10, tail, head, cost, 100.0, 8, np.array([0]))[0, 9] > 49
