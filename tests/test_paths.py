"""Shortest paths with zero weights, ties and cycles: both strategies against a heap search over (length, edges, vertex before)."""

import heapq
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from anisomap.operators import paths as H
from tests.test_operators import edges


def labels(rows, source):
    """(length, edges, vertex before) of every vertex that can be reached."""
    out = {}
    for s, t, w in rows:
        out.setdefault(s, []).append((t, w))
    label, heap, done = {source: (0.0, 0, None)}, [(0.0, 0, source)], set()
    while heap:
        d, h, u = heapq.heappop(heap)
        if u in done:
            continue
        done.add(u)
        for v, w in out.get(u, []):
            c = (d + w, h + 1, u)
            if v != source and v not in done and (v not in label or c < label[v]):
                label[v] = c
                heapq.heappush(heap, (c[0], c[1], v))
    return label


def graphs():
    r = np.random.default_rng(4)
    whole = [(int(s), int(t), float(w)) for s, t, w in zip(r.integers(0, 14, 60), r.integers(0, 14, 60), r.integers(0, 4, 60), strict=True)]
    return {
        "circle of zeros": [(10, 1, 1.0), (1, 2, 0.0), (2, 1, 0.0)],
        "equal ways": [(5, 9, 1.0), (5, 7, 1.0), (5, 8, 1.0), (9, 3, 1.0), (7, 3, 1.0), (8, 3, 1.0), (5, 4, 0.5), (4, 6, 0.5), (6, 3, 1.0)],
        "long chain": [(i, i + 1, 0.25 * (i % 3)) for i in range(12)] + [(0, 12, 9.0)],
        "whole numbers": whole,
    }


@pytest.mark.parametrize("strategy", ["kernel", "iterative"])
@pytest.mark.parametrize("name", list(graphs()))
def test_ties_and_zero_weights(spark, name, strategy):
    rows = graphs()[name]
    ids = sorted({v for s, t, _ in rows for v in (s, t)})
    some = ids if len(ids) < 5 else ids[:2]
    g = edges(spark, rows)
    sp = H.shortest_paths(g, spark.createDataFrame([(i,) for i in some], "id long"), strategy=strategy).persist()
    want = {(s, v, *x) for s in some for v, x in labels(rows, s).items()}
    assert {(r.src, r.dst, r.dist, r.hops, r.pred) for r in sp.collect()} == want
    if strategy == "iterative" or name in ("circle of zeros", "equal ways"):
        pairs = sp.where("src <> dst")
        walks = H.path_table(sp, pairs).groupBy("src", "dst").agg(F.count("*").alias("n"), F.max("hop").alias("last"))
        assert {(r.src, r.dst, r.n, r["last"]) for r in walks.collect()} == {(s, v, h, h) for s, v, _, h, _ in want if s != v}


def test_hop_bounds_by_brute_force(spark):
    rows = graphs()["whole numbers"]
    best = {0: 0.0}
    for bound in (1, 2, 3):
        longer = dict(best)
        for s, t, w in rows:
            if s in best:
                longer[t] = min(longer.get(t, np.inf), best[s] + w)
        best = longer
        if bound > 1:
            got = H.bellman_ford(edges(spark, rows), spark.range(1), hops=bound)
            assert {r.dst: r.dist for r in got.collect()} == best


def test_walks_in_circles_raise(spark, monkeypatch):
    monkeypatch.setattr(H, "LONG", 2)
    sp = spark.createDataFrame([(10, 10, 0.0, None), (10, 1, 1.0, 2), (10, 2, 1.0, 1)], "src long, dst long, dist double, pred long")
    with pytest.raises(ValueError, match="circles"):
        H.path_table(sp, sp.where("dst = 1"))


def test_no_edges(spark):
    g = spark.createDataFrame([], "src long, dst long, d double")
    for strategy in ("kernel", "iterative"):
        assert H.shortest_paths(g, strategy=strategy).count() == 0
        assert [(r.dst, r.hops) for r in H.shortest_paths(g, spark.range(1), strategy=strategy).collect()] == [(0, 0)]


def test_kernel_on_random_graphs():
    r = np.random.default_rng(0)
    for trial in range(60):
        n, m = int(r.integers(2, 30)), int(r.integers(1, 120))
        e = np.unique(r.integers(0, n, m) * n + r.integers(0, n, m))
        src, dst, d = 7 * (e // n), 7 * (e % n), r.integers(0, 3, len(e)) * 1.0 if trial % 2 else r.random(len(e))
        g = H.Rows(src, dst, d)
        for s in range(len(g.ids)):
            dist, hops, pred = g.search(s)
            got = {int(g.ids[v]): (dist[v], hops[v], None if pred[v] < 0 else int(g.ids[pred[v]])) for v in np.flatnonzero(hops >= 0)}
            assert got == labels(list(zip(src.tolist(), dst.tolist(), d.tolist(), strict=True)), int(g.ids[s]))


@pytest.mark.parametrize("strategy", ["kernel", "iterative"])
@pytest.mark.parametrize("turns", [1, 3, 50])
def test_ways_of_few_edges(spark, strategy, turns):
    rows = [(i, i + 1, 0.25) for i in range(40)] + [(0, 40, 20.0), (0, 30, 8.0), (30, 38, 0.5), (2, 38, 9.0), (1, 38, 9.25)]
    steps = edges(spark, rows)
    best = {(0, 0): (0.0, 0, None)}
    for h in range(1, turns + 1):
        for s, t, w in rows:
            if (before := best.get((s, h - 1))) and (best.get((t, h)) or best.get((t, h - 1)) or (np.inf,)) > (c := (before[0] + w, h, s)):
                best[t, h] = c
        best |= {(t, h): best[t, h - 1] for t in range(41) if (t, h) not in best and (t, h - 1) in best}
    got = H.shortest_paths(steps, steps.where("src = 0").select(F.col("src").alias("id")), strategy=strategy, most_hops=turns).collect()
    assert {r.dst: (r.dist, r.hops, r.pred) for r in got} == {t: best[t, turns] for t in range(41) if (t, turns) in best}


@pytest.mark.parametrize("strategy", ["kernel", "iterative"])
def test_wanted_pairs_only(spark, strategy):
    steps = edges(spark, [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (0, 3, 9.0), (3, 0, 1.0), (1, 4, 1.0)])
    wanted = spark.createDataFrame([(0, 3), (0, 3), (3, 1), (7, 7), (7, 1), (4, 0)], "src long, dst long")
    got = H.shortest_paths(steps, strategy=strategy, wanted=wanted).collect()
    assert {(r.src, r.dst): (r.dist, r.pred) for r in got} == {(0, 3): (3.0, 2), (3, 1): (2.0, 0), (7, 7): (0.0, None)}
    along = H.shortest_paths(steps, strategy=strategy, wanted=wanted, along=True).collect()
    assert sorted((r.src, r.dst) for r in along) == [(0, 0), (0, 1), (0, 2), (0, 3), (3, 0), (3, 1), (3, 3), (7, 7)]


def test_paths_of_few_sources_are_not_broadcast(spark):
    """Spark takes what tasks give to have as many rows as there are sources; at 10,000 points it broadcast 5 million rows."""
    ring = edges(spark, [(i, (i + 1) % 50, 1.0) for i in range(50)])
    sp = H.shortest_paths(ring, spark.range(1))
    joined = ring.select("src", "dst").join(sp.select("src", "dst", F.col("dist").alias("e")), ["src", "dst"], "left")
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("strategy", [5_000_000, 0])
def test_forest_of_reachable_pairs(spark, monkeypatch, strategy):
    monkeypatch.setattr(H, "BROADCAST_EDGES", strategy)
    steps = edges(spark, [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (0, 3, 9.0), (1, 4, 1.0), (5, 6, 1.0)])
    pairs = spark.createDataFrame([(0, 3), (1, 3), (0, 6), (5, 5)], "src long, dst long")
    got = H.reached_forest(steps, pairs)
    assert sorted((r.tail, r.head) for r in got.collect()) == [(0, 1), (1, 2), (2, 3)]


def test_ways_of_few_edges_seek_no_others(monkeypatch):
    """A search of all ways took 1.1 s a source on 615,384 points, where ways of 24 edges reach few of them."""
    tail = np.arange(5000)
    g = H.Rows(tail, tail + 1, np.ones(5000))
    monkeypatch.setattr(g, "distances", None)
    dist, hops, pred = g.bounded(0, 24)
    assert np.isfinite(dist).sum() == 25 and hops.max() == 24 and pred[24] == 23


def test_a_graph_sends_twelve_bytes_an_edge():
    """At 615,384 points the graph has more than the 5 million edges that were broadcast, and rounds of joins filled the disk."""
    r = np.random.default_rng(0)
    key = np.unique(r.integers(0, 2000, 40_000) * 2000 + r.integers(0, 2000, 40_000))
    g = H.Rows(key // 2000, key % 2000, r.random(len(key)))
    assert len(g.tail) == len(key) and len(pickle.dumps(g)) < 13 * len(key) + 16 * len(g.ids) + 2000
    assert np.array_equal(pickle.loads(pickle.dumps(g)).tail, g.tail) and H.BROADCAST_EDGES >= 20 * 615_384


def test_searches_for_goals_are_those_of_all():
    r = np.random.default_rng(1)
    for trial in range(60):
        n, m = int(r.integers(2, 80)), int(r.integers(1, 200))
        e = np.unique(r.integers(0, n, m) * n + r.integers(0, n, m))
        d = r.integers(0, 3, len(e)) * 1.0 if trial % 2 else r.random(len(e))
        g = H.Rows(e // n, e % n, d)
        for s in range(0, len(g.ids), 3):
            g.deep = False
            goals = np.unique(r.integers(0, len(g.ids), 3))
            full, some = g.search(s), g.search(s, goals)
            on = H._ways(full[2], goals[full[1][goals] >= 0])
            assert all(np.array_equal(a[on], b[on]) for a, b in zip(full, some, strict=True))
            assert (some[1][goals[full[1][goals] < 0]] < 0).all()


def test_long_ways_after_short_ones():
    tail = np.arange(60)
    g = H.Rows(tail, tail + 1, np.ones(60))
    assert [g.search(s)[1][60] for s in (50, 0, 50)] == [10, 60, 10] and g.deep


def test_forest_of_all_pairs_has_no_pairs(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [(int(a), int(b), float(w)) for a, b, w in zip(r.integers(0, 40, 160), r.integers(0, 40, 160), r.random(160), strict=True) if a != b]
    steps = edges(spark, rows)
    sources, targets = spark.createDataFrame([(1,), (5,), (99,)], "id long"), spark.createDataFrame([(2,), (5,), (30,), (98,)], "id long")
    pairs = sources.selectExpr("id as src").crossJoin(targets.selectExpr("id as dst")).where("src <> dst")
    want = sorted((r.tail, r.head) for r in H.reached_forest(steps, pairs).collect())
    assert want and sorted((r.tail, r.head) for r in H.reached_forest(steps, sources=sources, targets=targets).collect()) == want
    monkeypatch.setattr(H, "BROADCAST_EDGES", 0)
    assert sorted((r.tail, r.head) for r in H.reached_forest(steps, sources=sources, targets=targets).collect()) == want


def test_lengths_along_ways_need_no_path_table(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(int(a), int(b), float(w)) for a, b, w in zip(r.integers(0, 40, 200), r.integers(0, 40, 200), r.random(200), strict=True) if a != b]
    steps, sources = edges(spark, rows), spark.createDataFrame([(1,), (5,), (99,)], "id long")
    want = {(r.src, r.dst): r.dist for r in H.shortest_paths(steps, sources).where("src <> dst").collect()}
    for most in (H.BROADCAST_EDGES, 0):
        monkeypatch.setattr(H, "BROADCAST_EDGES", most)
        with monkeypatch.context() as m:
            if most:
                m.setattr(H, "path_table", None)
            got = {(r.src, r.dst): r.dist for r in H.way_lengths(steps, sources).collect()}
        assert got == pytest.approx(want, rel=1e-12) and len(got) > 40
