"""Ties, NaN, empty groups and outer cells, by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from anisomap.functions import vectors as V
from anisomap.operators import dissimilarity as D
from anisomap.operators import evaluate as E
from anisomap.operators import graph as G
from anisomap.operators import objectives as O
from anisomap.operators import pairs as P
from anisomap.sources import store as S

NAN = float("nan")


def points_of(spark, x):
    return spark.createDataFrame([(int(i), [float(c) for c in row]) for i, row in enumerate(x)], "id long, x array<double>")


@pytest.mark.parametrize("block", [64, 4096])
def test_neighbours_with_many_ties(spark, block):
    r = np.random.default_rng(1)
    same = np.where(np.arange(600)[:, None] % 2 == 1, r.normal(size=6), r.normal(size=(600, 6)))
    near = same.copy()
    near[1::2] += 1e-9 * r.normal(size=(300, 6))
    for x in (same, near, same + 1e6):
        got = {}
        for row in G.nearest_neighbors(points_of(spark, x), 5, block).collect():
            got.setdefault(row.src, {})[row["rank"]] = row.dst
        for i in range(len(x)):
            d = np.sqrt(((x - x[i]) ** 2).sum(1))
            d[i] = np.inf
            assert [got[i][k] for k in range(1, 6)] == np.lexsort((np.arange(len(x)), d))[:5].tolist()


def test_undefined_directions_do_not_count(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [NAN, 0.0]), (2, [-1.0, 0.0]), (3, [float("inf"), 0.0]), (4, [0.0, 0.0])], "id long, v array<double>")
    labels = v.select("id", F.lit("a").alias("label"))
    knn = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 4)], "src long, rank int, dst long")
    assert E.cluster_coherence(labels, knn, v).where("label is null").first().score == -1.0
    assert tuple(E.global_coherence(v).first()) == (2, 0.0)
    assert v.select(V.cosine("v", F.array(F.lit(1.0), F.lit(0.0))).alias("c")).where("c is null").count() == 3


def test_gaps_are_measured_against_the_whole_embedding(spark):
    y = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [100.0])], "id long, y array<double>")
    groups = spark.createDataFrame([(0, "before"), (1, "after")], "id long, grp string")
    row = E.gap_distance(y, groups).first()
    assert (row.gap_distance, row.max_distance, row.normalized_gap) == (1.0, 100.0, 0.01)
    one = y.where("id = 0")
    assert E.gap_distance(one, spark.createDataFrame([(0, "before"), (0, "after")], "id long, grp string")).first().normalized_gap == 0.0


def test_largest_distance_is_that_of_all_pairs(spark):
    r = np.random.default_rng(5)
    for x in (r.normal(size=(200, 3)), r.normal(size=(50, 2)) * [1, 100], np.zeros((4, 2))):
        y = points_of(spark, x).withColumnRenamed("x", "y")
        want = max(np.sqrt(((x - row) ** 2).sum(1)).max() for row in x)
        assert E.largest_distance(y).first()[0] == pytest.approx(want)


def test_ranks_of_ties_over_several_ranges(spark):
    r = np.random.default_rng(2)
    x = r.integers(0, 40, 500).astype(float)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, v double")
    got = {row.id: row.r for row in E.with_rank(df, "v", "r").collect()}
    assert all(got[i] == (x < v).sum() + ((x == v).sum() + 1) / 2 for i, v in enumerate(x)) and len(got) == 500


def test_weights_stay_where_nothing_is_active(spark):
    rows = "src long, dst long, d double, w double"
    flat = spark.createDataFrame([(0, 1, 0.0, 2.0), (1, 0, None, 3.0), (1, 2, NAN, 4.0)], rows)
    assert sorted(r.w for r in P.distance_weights(flat, 1.0).collect()) == [2.0, 3.0, 4.0]
    none = spark.createDataFrame([(0, 1, 1.0, 0.0), (2, 2, 1.0, 5.0)], rows)
    assert sorted(r.w for r in P.normalized_weights(none).collect()) == [0.0, 5.0]
    some = spark.createDataFrame([(0, 1, 2.0, 1.0), (1, 0, 4.0, 0.0), (1, 2, float("inf"), 1.0)], rows)
    assert [r.w for r in P.distance_weights(some, 1.0, 0.0).orderBy("src", "dst").collect()] == [1.0, 0.0, 1.0]
    with pytest.raises(ValueError):
        P.distance_weights(some, -1.0)


def test_stored_plans_fit_labels_and_transitions(spark, tmp_path):
    knn = spark.createDataFrame([(0, 1, 1), (1, 1, 0)], "src long, rank int, dst long")
    labels = spark.createDataFrame([(0, "a"), (1, "b")], "id long, label string")
    swapped = spark.createDataFrame([(0, "b"), (1, "a")], "id long, label string")
    wanted = spark.createDataFrame([("a", "b")], "src_label string, dst_label string")
    at = f"file://{tmp_path}/plan"
    assert S.load_or_compute_plan(spark, at, labels, wanted, knn, 1).first().cell == 0
    for other in ((swapped, wanted), (labels, wanted.selectExpr("dst_label as src_label", "src_label as dst_label"))):
        with pytest.raises(ValueError):
            S.load_or_compute_plan(spark, at, *other, knn, 1)
    assert S.load_or_compute_plan(spark, at, swapped, wanted, knn, 1, "recompute").first().cell == 1


def test_saved_embeddings_of_a_shape(spark, tmp_path):
    y = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 2.0])], "id long, y array<double>")
    S.save_embedding(f"file://{tmp_path}/e_one", y, 0.5)
    S.save_embedding(f"file://{tmp_path}/e_two", y.where("id = 0"), 0.5)
    (tmp_path / "e_three").mkdir()
    assert S.newest_compatible(spark, f"file://{tmp_path}/e_*", 2, 2).endswith("e_one")
    assert S.newest_compatible(spark, f"file://{tmp_path}/e_*", 2, 3) is None


def test_extra_support_of_the_velocity_graph(spark):
    r = np.random.default_rng(3)
    x, v = r.normal(size=(40, 3)), r.normal(size=(40, 3))
    p = points_of(spark, x)
    w = points_of(spark, v).withColumnRenamed("x", "v")
    edges, used = G.velocity_directed_graph(p, w, k=3, k_finsler=4, velocity_neighbors=2)
    got = {(e.src, e.dst): e.d for e in edges.collect()}
    assert all((b, a) in got for a, b in got)
    plain = {(e.src, e.dst) for e in G.velocity_directed_graph(p, w, k=3)[0].collect()}
    assert plain < set(got)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = [{a for a, b in plain if b == i} for i in range(40)]
    two = sorted(near[0], key=lambda j: (d[0, j], j))[:2]
    assert used.where("id = 0").first().v == pytest.approx(v[[0, *two]].mean(0))
    one = G.velocity_directed_graph(p, w, k=3, k_finsler=4, symmetric=False, average=False)[0]
    assert one.count() < len(got)


@pytest.mark.parametrize("local", [0, 1 << 20])
def test_strong_components_of_chains_and_cycles(spark, local):
    edges = [(i, i + 1) for i in range(7)] + [(10, 11), (11, 12), (12, 10), (12, 13), (13, 14), (14, 13), (20, 20), (14, 7)]
    e = spark.createDataFrame(edges, "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in {x for p in edges for x in p} | {99}], "id long")
    got = {r.id: r.component for r in G.strong_components(nodes, e, local_edges=local).collect()}
    want = {i: i for i in got} | {10: 10, 11: 10, 12: 10, 13: 13, 14: 13}
    assert got == want and 99 in got


def test_wormholes_are_those_of_all_ways(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(14, 2))
    pairs = {(a, b): float(r.random() * 3) for a in range(14) for b in range(14) if a != b and r.random() < 0.5}
    border = [2, 5, 9]
    dissim = spark.createDataFrame([(a, b, d) for (a, b), d in pairs.items()], "src long, dst long, d double")
    got = {(k.src, k.dst): k.keep for k in D.wormhole_mask(dissim, spark.createDataFrame([(b,) for b in border], "id long"), points_of(spark, x), 0.2, 0.3).collect()}
    to = pairs | {(b, b): 0.0 for b in border}
    for (a, b), d in pairs.items():
        ways = [to[a, p] + 0.8 * np.sqrt(((x[p] - x[q]) ** 2).sum()) + to[b, q] for p in border for q in border if (a, p) in to and (b, q) in to]
        assert got[a, b] == (not ways or min(ways) > d or d < 0.3)


def test_obstacles_and_corridors_are_linked_by_visible_ways(spark):
    wall = [{"cx": 0.0, "cy": 0.0, "rx": 0.2, "ry": 3.0, "angle_deg": 0.0}]
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(size=(20, 2)) * [0.2, 1] - [2, 0], r.normal(size=(20, 2)) * [0.2, 1] + [2, 0], [[-1.0, 3.6], [1.0, 3.6]]])
    p = points_of(spark, x)
    g = G.obstacle_graph(p, wall, k=3, wide=4)
    assert G.components(p, g).select("component").distinct().count() == 1
    clear = G._clear_of_ellipses(wall, 15)
    assert all(clear(x[[e.src]], x[[e.dst]])[0] for e in g.collect())
    assert G.visible_edges(p, g, wall).count() == g.count()
    line = [(0.0, 0.0, 10.0, 0.0)]
    q = np.concatenate([np.linspace(0, 3, 12), np.linspace(7, 10, 12)])
    q = np.stack([q, 0.05 * np.sin(np.arange(24))], 1)
    tree = G.corridor_graph(points_of(spark, q), line, 0.2, k=4, wide=8)
    assert G.components(points_of(spark, q), tree).select("component").distinct().count() == 1
    link = [e for e in tree.collect() if e.src < 12 <= e.dst]
    assert [(e.src, e.dst) for e in link] == [(11, 12)]
    with pytest.raises(RuntimeError):
        G.corridor_graph(points_of(spark, q + [0, 5]), line, 0.2, k=4)


def test_nearest_obstacles(spark):
    two = [{"cx": 0.0, "cy": 0.0, "rx": 1.0, "ry": 2.0, "angle_deg": 90.0}, {"cx": 10.0, "cy": 0.0, "rx": 1.0, "ry": 1.0, "angle_deg": 0.0}]
    p = spark.createDataFrame([(0, 4.0, 0.0), (1, 12.0, 0.0), (2, 0.0, 0.0)], "id long, x double, y double")
    got = [r.g for r in p.select("id", G.nearest_obstacle_geometry(F.col("x"), F.col("y"), two).alias("g")).orderBy("id").collect()]
    assert (got[0].distance, got[0].nx, got[0].ny) == pytest.approx((1.0, 1.0, 0.0))
    assert (got[1].distance, got[1].nx) == pytest.approx((1.0, 1.0)) and got[2].distance == pytest.approx(9.0)


def test_gmres_solves_what_pinv_solves(spark):
    from anisomap.operators.optimizers import _conjugate, _gmres

    r = np.random.default_rng(8)
    w = np.abs(r.normal(size=(70, 70)))
    w = w + w.T
    np.fill_diagonal(w, 0)
    a, b = np.diag(w.sum(1)) - w, r.normal(size=70)
    b -= b.mean()
    want = np.linalg.pinv(a) @ b
    for solve in (_gmres, _conjugate):
        x = solve(a, b, np.zeros(70))
        assert x - x.mean() == pytest.approx(want, abs=1e-8)
    u = np.triu(r.normal(size=(60, 60)), 1) + 5 * np.eye(60)  # not symmetric
    assert u @ _gmres(u, b[:60], np.zeros(60)) == pytest.approx(b[:60], abs=1e-8)


def test_full_stress_in_histories(spark):
    from anisomap.api import fit
    from anisomap.functions.metrics import Randers
    from anisomap.operators.evaluate import full_geodesic_stress

    r = np.random.default_rng(9)
    x = r.normal(size=(16, 2))
    d = [(a, b, float(np.sqrt(((x[a] - x[b]) ** 2).sum()))) for a in range(16) for b in range(16) if a != b]
    dissim = spark.createDataFrame(d, "src long, dst long, d double")
    got = fit(dissim, Randers(0.2), "path_frozen", outer_iter=2, graph_neighbors=5, seed=1, full_stress=True)
    h = got.history_frame(spark).orderBy("step").collect()
    assert h[-1].full_stress == pytest.approx(full_geodesic_stress(dissim, got.frame(spark), Randers(0.2), 5).first().normalized)
    assert "full_stress" not in fit(dissim, Randers(0.2), "path_frozen", outer_iter=1, graph_neighbors=5, seed=1).history_frame(spark).columns
    apart = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [5.0, 0.0])], "id long, y array<double>")
    lone = E.support_stress(spark.createDataFrame([(0, 2, 1.0)], "src long, dst long, d double"), apart, spark.createDataFrame([(0, 1)], "src long, dst long"))
    assert lone.first().normalized == float("inf") and lone.first().n_unreachable == 1


def test_names_of_starts(spark, tmp_path):
    from anisomap.operators import initializers as I

    y = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 2.0])], "id long, y array<double>")
    assert I.named_init("UMAP-2d", y, 1, y, {}).orderBy("id").collect()[1].y == [1.0]
    for bad, error in (("isomap", ValueError), (3, TypeError), ("smacof", FileNotFoundError)):
        with pytest.raises(error):
            I.named_init(bad, y, 2, y, {})
    noisy = I.diagonal_view(points_of(spark, np.eye(3)), noise=0.1)
    assert noisy.agg(F.avg(F.get("y", F.lit(0)))).first()[0] == pytest.approx(0, abs=1e-12)


def test_farthest_points_read_chosen_rows_only(spark):
    """A function gives the rows of one point; the choice is that of a table of all pairs, directed ones included."""
    x = np.random.default_rng(5).normal(size=(40, 3))
    p, asked = points_of(spark, x), []
    tilted = F.col("dist") + 0.01 * (F.col("dst") - F.col("src"))
    every = G.all_distances(p).select("src", "dst", tilted.alias("d"))

    def touching(ids):
        asked.append([r.id for r in ids.collect()])
        one = G.all_distances(p, sources=p.join(ids, "id", "left_semi"))
        both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist"))
        return both.select("src", "dst", tilted.alias("d"))

    got = sorted(r.id for r in P.farthest_points(p, touching, 4, seed=1).collect())
    assert got == sorted(r.id for r in P.farthest_points(p, every, 4, seed=1).collect())
    assert sorted(c for ids in asked for c in ids) == got


def _both_ways(spark):
    x = np.random.default_rng(6).normal(size=(30, 3))
    p = points_of(spark, x)
    pairs = G.all_distances(p, 8).select("src", "dst", (F.col("dist") + 0.01 * (F.col("dst") - F.col("src"))).alias("d"), (F.col("dist") + 0.01 * (F.col("src") - F.col("dst"))).alias("back"))
    return p.select("id", F.col("x").alias("y")), pairs


def test_gram_of_pairs_with_both_directions_is_not_joined_with_itself(spark):
    _, pairs = _both_ways(spark)
    got, table = O.centered_gram(pairs), O.centered_gram(pairs.drop("back"))
    a, b = (t.toPandas().sort_values(["src", "dst"]).reset_index(drop=True) for t in (got, table))
    assert len(a) == 900 and (a[["src", "dst"]] == b[["src", "dst"]]).all().all() and np.allclose(a["g"], b["g"])
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_step_of_pairs_with_both_directions_is_not_joined_with_itself(spark):
    y, pairs = _both_ways(spark)
    got = O.smacof_uniform_step(pairs, y, 0.5)
    a, b = (np.array([r.y for r in t.orderBy("id").collect()]) for t in (got, O.smacof_uniform_step(pairs.drop("back"), y, 0.5)))
    assert np.allclose(a, b) and "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_isomap_joins_no_pairs(spark, monkeypatch):
    from anisomap.operators import initializers as I

    seen = []
    monkeypatch.setattr(I, "symmetric_squares", lambda d: seen.append(d.columns) or __import__("anisomap.operators.objectives", fromlist=["x"]).symmetric_squares(d))
    x = [(i, [float(i % 5), float(i // 5), 0.1 * i]) for i in range(20)]
    got, sp = I.isomap(spark.createDataFrame(x, "id long, x array<double>"), 3, 2)
    assert "back" in seen[0] and got.count() == 20 and sp.count() == 400
