"""Neighbours by a cover of pivots against brute force: equal points, ties, empty tables, and how much is compared."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from anisomap.operators import cover as C
from anisomap.operators import graph as G


def points_of(spark, x, **columns):
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "x": x.tolist()} | columns), "id long, x array<double>")


def clustered(n, d=6, clusters=30, seed=0):
    r = np.random.default_rng(seed)
    return 8 * r.normal(size=(clusters, d))[r.integers(0, clusters, n)] + r.normal(size=(n, d))


def brute(x, k):
    for i in range(len(x)):
        d = np.sqrt(((x[i] - x) ** 2).sum(1))
        order = np.lexsort((np.arange(len(x)), d))
        yield [(i, rank, int(j)) for rank, j in enumerate(order[order != i][:k], 1)]


@pytest.mark.parametrize("pivots, block", [(1, 4096), (17, 4096), (9, 40)])
def test_neighbours_with_equal_points(spark, pivots, block):
    x = clustered(500)
    x[100:400] = x[7]  # 300 rows of one point
    x[400:420] = np.round(x[400:420])
    got = {(r.src, r["rank"], r.dst) for r in G.nearest_neighbors(points_of(spark, x), 6, block, pivots).collect()}
    assert got == {row for rows in brute(x, 6) for row in rows}


def test_more_neighbours_than_a_block_has(spark):
    x = clustered(60, clusters=5)
    got = {(r.src, r["rank"], r.dst) for r in G.nearest_neighbors(points_of(spark, x), 25, 8, 12).collect()}
    assert got == {row for rows in brute(x, 25) for row in rows}
    assert G.nearest_neighbors(points_of(spark, x[:3]), 25, 8, 2).count() == 6
    assert G.nearest_neighbors(points_of(spark, x).limit(0), 3, 8, 2).count() == 0 and G.radius_graph(points_of(spark, x).limit(0), 1.0, 8, 2).count() == 0


def test_radius_and_velocity_neighbours(spark):
    x = clustered(300, d=3)
    r = np.random.default_rng(5)
    x[50:80] = x[50]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    got = {(e.src, e.dst) for e in G.radius_graph(points_of(spark, x), 1.5, 40, 14).collect()}
    assert got == {(i, j) for i in range(300) for j in range(300) if i != j and d[i, j] <= 1.5}
    v = r.normal(size=x.shape)
    v[3] = 0
    velocity = spark.createDataFrame(pd.DataFrame({"id": np.arange(300), "v": v.tolist()}), "id long, v array<double>")
    cos = np.einsum("ijk,ik->ij", x[None] - x[:, None], v) / np.maximum(d * np.sqrt((v * v).sum(1))[:, None], 1e-12)
    for formula, w in (("exponential", d * np.exp(-0.8 * np.clip(cos, -0.9, 0.9))), ("matsumoto", d / (1 + 0.8 * np.clip(cos, -0.9, 0.9)))):
        got = G.velocity_finsler_knn(points_of(spark, x), velocity, 5, 0.8, formula, 0.9, 40, 14).groupBy("src").agg(F.count("*").alias("n"), F.max("d").alias("m"), F.sum("d").alias("s")).collect()
        w = np.where(np.eye(300, dtype=bool), np.inf, w)
        best = np.sort(w, 1)[:, :5]
        for row in got:
            assert row.n == 5 and row.m == pytest.approx(best[row.src, 4], abs=1e-9) and row.s == pytest.approx(best[row.src].sum(), abs=1e-9)


def share_compared(spark, x, k):
    """Pairs of points in the blocks that are compared, as a share of all pairs."""
    c = C.cover(points_of(spark, x))
    sizes = dict(c.table.groupBy("block").count().collect())
    table = c.table.toPandas()
    bound = np.concatenate([np.full(1, np.inf)])  # as the own block gives it
    rows = []
    for block, own in table.groupby("block"):
        y = np.stack(own["x"])
        d = np.sort(C.rough_distances(y, y), 1)
        bound = d[:, k] if len(own) > k else np.full(len(own), np.inf)
        rows += [(int(i), v, int(block), float(b)) for i, v, b in zip(own["id"], own["x"].map(list), bound, strict=True)]
    asking = spark.createDataFrame(rows, "id long, x array<double>, block int, bound double")
    wanted = C.wanted_blocks(asking, c, k + 1).collect()
    return sum(sizes[r.a] * sizes[r.block] for r in wanted) / len(x) ** 2


def test_few_pairs_are_compared_on_clustered_points(spark):
    assert share_compared(spark, clustered(20_000, d=8, clusters=200), 10) < 0.1


def test_points_are_sent_once_a_group_where_all_balls_overlap(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(1200, 16))
    seen = []
    monkeypatch.setattr(C, "written", lambda df, name, own=C.written: seen.append((name, own(df, name))) or seen[-1][1])
    got = {(r.src, r["rank"], r.dst) for r in G.nearest_neighbors(points_of(spark, x), 5, 20, 60).collect()}
    assert got == {row for rows in brute(x, 5) for row in rows}
    wanted = dict(seen)["wanted"]
    assert wanted.select("block").distinct().count() >= 60 and max(r["count"] for r in wanted.groupBy("block").count().collect()) <= 9


def test_single_precision_leaves_no_neighbour_out():
    """Pairs are ruled out by single-precision products, with their rounding as slack: near copies and points far off too."""
    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 16))
    x[1500:2000] = x[:500] + 1e-6 * r.normal(size=(500, 16))
    for points in (x, x + 100.0, x + 1e6):
        exact = np.sqrt(((points[:700, None] - points[None]) ** 2).sum(-1))
        exact[np.arange(700), np.arange(700)] = np.inf
        limit = np.sort(exact, 1)[:, 9]
        used = G._Single(points[:700], points, limit)
        assert used.useful
        src, dst, dist = G._k_nearest(np.arange(700), points[:700], np.arange(3000), points, 10, limit)
        for i in range(700):
            order = np.lexsort((np.arange(3000), exact[i]))[:10]
            assert dst[src == i].tolist() == order.tolist()
            assert dist[src == i].tolist() == exact[i][order].tolist()


def test_most_pairs_of_a_group_are_compared_in_single_precision(monkeypatch):
    r = np.random.default_rng(4)
    x = r.normal(size=(9000, 32))
    x[100:120] = x[50]
    ids, counted, rough, within = np.arange(9000), [], G._near_pairs, G._within_rough
    monkeypatch.setattr(G, "_near_pairs", lambda *a: counted.append(len(a[0]) * len(a[2])) or rough(*a))
    monkeypatch.setattr(G, "_within_rough", lambda *a: counted.append(len(a[0]) * len(a[1])) or within(*a))
    src, dst, dist = G._k_nearest(ids[:600], x[:600], ids, x, 5)
    a, b, d = G._within(ids[:600], x[:600], ids, x, 4.0)
    assert sum(counted) < 600 * 9000 / 2
    for i in (0, 50, 101, 599):
        want = np.sqrt(((x - x[i]) ** 2).sum(1))
        want[i] = np.inf
        order = np.lexsort((ids, want))[:5]
        at = np.lexsort((dst[src == i], dist[src == i]))
        assert dst[src == i][at].tolist() == order.tolist() and dist[src == i][at].tolist() == want[order].tolist()
        assert sorted(b[a == i].tolist()) == np.flatnonzero(want <= 4.0).tolist()
