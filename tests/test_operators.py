import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from anisomap.api import fit
from anisomap.functions import vectors as V
from anisomap.functions.metrics import ConvexMatsumoto, Matsumoto, Randers
from anisomap.operators import dissimilarity as D
from anisomap.operators import evaluate as E
from anisomap.operators import fuzzy as U
from anisomap.operators import graph as G
from anisomap.operators import initializers as I
from anisomap.operators import objectives as O
from anisomap.operators import optimizers as opt
from anisomap.operators import pairs as P
from anisomap.operators import paths as H
from anisomap.sources import store as S
from anisomap.sources import synthetic as X


def edges(spark, rows):
    return spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in rows], "src long, dst long, d double")


def points(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "id long, x array<double>")


def test_neighbours_with_duplicates_over_several_blocks(spark):
    x = np.random.default_rng(0).normal(size=(60, 4))
    x[7] = x[3]
    got = {(r.src, r["rank"]): r.dst for r in G.nearest_neighbors(points(spark, x), 3, block=16).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = {(i, k + 1): int(j) for i in range(60) for k, j in enumerate(np.lexsort((np.arange(60), d[i]))[:3])}
    assert got == want and got[3, 1] == 7


def test_symmetrize_drops_zero_edges(spark):
    got = {(r.src, r.dst): r.d for r in G.symmetrize(edges(spark, [(0, 1, 2), (1, 0, 3), (1, 2, 0)])).collect()}
    assert got == {(0, 1): 3, (1, 0): 3}


def test_softmin(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, float("inf")), (3, None)], "k int, x double")
    got = {r.k: r.softmin for r in G.softmin(df, ["k"], "x", 10.0).collect()}
    assert got[1] == pytest.approx(1 - np.log(2) / 10) and got[2] is None and got[3] is None


def test_connecting_components(spark):
    x = [[0, 0], [0, 1], [5, 0], [5, 1], [20, 0], [20, 1]]
    g = G.connect_components(points(spark, x), edges(spark, [(0, 1, 1), (1, 0, 1), (2, 3, 1), (3, 2, 1), (4, 5, 1), (5, 4, 1)]))
    parts = G.components(points(spark, x), g)
    assert parts.select("component").distinct().count() == 1
    assert {(r.src, r.dst) for r in g.collect()} >= {(0, 2), (2, 4)}


@pytest.mark.parametrize("strategy", ["kernel", "iterative"])
def test_paths(spark, strategy):
    g = edges(spark, [(0, 1, 1), (1, 2, 1), (0, 2, 5), (3, 0, 1)])
    sp = H.shortest_paths(g, spark.range(4), strategy=strategy)
    got = {(r.src, r.dst): r.dist for r in sp.collect()}
    assert got[0, 2] == 2 and (2, 0) not in got and got[3, 2] == 3
    assert {(r.src, r.dst): r.path for r in H.path_vertices(sp, spark.createDataFrame([(3, 2), (1, 1), (2, 0)], "src long, dst long")).collect()} == {(3, 2): [3, 0, 1, 2], (1, 1): [1]}
    with pytest.raises(ValueError):
        H.pruned_forest(sp, spark.createDataFrame([(2, 0)], "src long, dst long"))


def test_hops_and_negative_weights(spark):
    g = edges(spark, [(0, 1, 1), (1, 2, 1), (0, 2, 5)])
    one = {(r.dst): r.dist for r in H.bellman_ford(g, spark.range(1), hops=1).collect()}
    assert one[2] == 5
    with pytest.raises(ValueError):
        H.shortest_paths(edges(spark, [(0, 1, -1)]))


def test_soft_paths_tend_to_hard_ones():
    c = np.array([[0, 1, 5], [np.inf, 0, 1], [np.inf, np.inf, 0.0]])
    assert H.soft_floyd_warshall(c, 200.0)[0, 2] == pytest.approx(2, abs=1e-2)
    d = opt.soft_relaxations(3, np.array([0, 1, 0]), np.array([1, 2, 2]), np.array([1.0, 1, 5]), 200.0, 4, np.array([0]))
    assert d[0, 2] == pytest.approx(2, abs=1e-1)


def test_soft_gradients_by_differences():
    r = np.random.default_rng(0)
    c = r.uniform(1, 3, (5, 5))
    g = r.normal(size=(5, 5))
    np.fill_diagonal(g, 0)
    _, kept = H.soft_floyd_warshall(c, 3.0, trace=True)
    back = H.soft_floyd_warshall_pullback(kept, g)
    tail, head = np.nonzero(~np.eye(5, dtype=bool))
    cost = c[tail, head]
    w = r.normal(size=(5, 5))
    _, edge = opt.soft_relaxations(5, tail, head, cost, 3.0, 3, np.arange(5), lambda d: w)
    for k in (0, 7, 13):
        i, j = tail[k], head[k]
        step = 1e-6
        up, down = c.copy(), c.copy()
        up[i, j] += step
        down[i, j] -= step
        diff = (g * (H.soft_floyd_warshall(up, 3.0) - H.soft_floyd_warshall(down, 3.0))).sum() / (2 * step)
        assert back[i, j] == pytest.approx(diff, rel=1e-4, abs=1e-6)
        moved = np.zeros(len(cost))
        moved[k] = step
        f = lambda c: (w * opt.soft_relaxations(5, tail, head, c, 3.0, 3, np.arange(5))).sum()
        assert edge[k] == pytest.approx((f(cost + moved) - f(cost - moved)) / (2 * step), rel=1e-4, abs=1e-6)


def test_time_asymmetry(spark):
    t = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, None)], "id long, t double")
    got = {(r.src, r.dst): r.d for r in D.temporally_asymmetric(edges(spark, [(0, 1, 1), (1, 2, 1)]), t, 0.5).collect()}
    assert got == {(0, 1): 0.5, (1, 0): 1.5, (1, 2): 1, (2, 1): 1}
    floored = {(r.src, r.dst): r.d for r in D.temporally_asymmetric(edges(spark, [(0, 1, 1)]), t, 2.0).collect()}
    assert floored[0, 1] == pytest.approx(0.1)


def test_wormhole_is_the_literal_check(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(12, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) * r.uniform(1, 2)
    border = [1, 4, 7]
    rows = [(i, j, d[i, j]) for i in range(12) for j in range(12) if i != j]
    got = {(q.src, q.dst): q.keep for q in D.wormhole_mask(edges(spark, rows), spark.createDataFrame([(b,) for b in border], "id long"), points(spark, x), 0.2).collect()}
    for i, j, v in rows:
        assert got[i, j] == all(d[i, a] + d[j, b] + 0.8 * np.sqrt(((x[a] - x[b]) ** 2).sum()) > v for a in border for b in border)
    empty = D.wormhole_mask(edges(spark, rows), spark.createDataFrame([], "id long"), points(spark, x))
    assert empty.where("not keep").count() == 0


def test_pair_weights(spark):
    labels = spark.createDataFrame([(0, "a"), (1, "b"), (2, "b"), (3, "b"), (4, "b")], "id long, label string")
    w = {r.id: r.w for r in P.cluster_weights(labels, 1.0).collect()}
    assert w[0] == 2.5 and w[1] == 0.625
    pair = lambda n, w: spark.createDataFrame([(0, i + 1, 1.0, w) for i in range(n)], "src long, dst long, d double, w double")
    assert P.group_factors(pair(20, 1.0), pair(100, 1.0), "count", 0.5) == (1.0, 2.5)
    assert P.group_factors(pair(20, 1.0).limit(0), pair(3, 1.0)) == (1.0, 1.0)
    with pytest.raises(ValueError):
        P.validate_pairs(spark.createDataFrame([(0, 1, 1.0, -1.0)], "src long, dst long, d double, w double"))


def test_sampling_keeps_weights_unbiased(spark):
    p = spark.range(100).select(F.lit(0).cast("long").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("d"), F.lit(1.0).alias("w"))
    got = P.sample_targets(p, 10, 1)
    assert got.count() == 10 and got.agg(F.sum("w")).first()[0] == pytest.approx(100)


def test_fuzzy_cases(spark):
    p = spark.createDataFrame([(0, 1, 0.8), (1, 0, 0.5)], "src long, dst long, p double")
    assert {round(r.p, 9) for r in U.fuzzy_union(p).collect()} == {0.9}
    e = spark.createDataFrame([(0, 1, 1.0), (0, 2, 0.5), (0, 3, 0.25)], "src long, dst long, p double")
    assert sorted(r.every for r in U.epochs_per_sample(e).collect()) == [1, 2, 4]
    a, b = U.curve_parameters(0.5, 1.0)
    assert (a, b) == pytest.approx((0.58, 1.33), abs=0.1)


def test_scores_of_degenerate_inputs(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0])], "id long, v array<double>")
    assert E.global_coherence(v).first().gvcoh == pytest.approx(np.sqrt(2) / 2)
    opposite = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0])], "id long, v array<double>")
    assert E.global_coherence(opposite).first().gvcoh == pytest.approx(0)
    flat = spark.createDataFrame([(0.5, 0.1), (0.5, 0.2)], "a_data double, a_embedding double")
    assert E.asymmetry_preservation(flat).first().pearson is None
    none = E.asymmetry_preservation(flat.limit(0)).first()
    assert none.n_pairs == 0 and none.sign_accuracy is None
    row = spark.range(1).select(E.asymmetry_score(F.lit(7.0), F.lit(3.0)).alias("s"), E.asymmetry_score(F.lit(0.0), F.lit(0.0)).alias("n")).first()
    assert row.s == pytest.approx(-0.4) and row.n is None


def dense(spark, n=18, seed=0, alpha=0.3):
    x = np.random.default_rng(seed).normal(size=(n, 2))
    d = Randers(alpha).pairwise(x)
    return edges(spark, [(i, j, d[i, j]) for i in range(n) for j in range(n) if i != j])


@pytest.mark.parametrize("options", [{"optimizer": "gradient_descent"}, {"optimizer": "smacof_randers", "solver": "pinv", "max_iter": 300, "eps": 1e-9}, {"optimizer": "smacof_randers", "max_iter": 300, "eps": 1e-9, "project": True}])
def test_direct_fits_recover_the_distances(spark, options):
    got = fit(dense(spark), Randers(0.3), **options)
    assert got.stress < 1.0
    values = [h["stress"] for h in got.history]
    assert all(b <= a + 1e-9 for a, b in zip(values, values[1:]))
    assert got.frame(spark).count() == 18


def test_distributed_objective_is_the_local_one(spark):
    pairs = P.allowed_pairs(dense(spark))
    ids, arrays = opt.collect_pairs(pairs)
    x = np.random.default_rng(1).normal(size=(len(ids), 2))
    a, b = O.direct_raw(x, arrays, Randers(0.3)), opt.distributed_raw(pairs, ids, x, Randers(0.3))
    assert a[0] == pytest.approx(b[0]) and np.allclose(a[1], b[1])
    e = spark.createDataFrame(pd.DataFrame({"id": ids, "y": x.tolist()}), "id long, y array<double>")
    g = {r.id: r.g for r in O.direct_gradient(pairs, e, Randers(0.3)).collect()}
    assert np.allclose([g[i] for i in ids], a[1])


def test_path_fits_lower_the_stress(spark):
    p = X.parallel_bridges(spark, rail=15, bridge=3).select("id", "x")
    sp = H.shortest_paths(G.symmetric_knn_graph(p, 3, connected=True), directed=False).where("src <> dst").select("src", "dst", F.col("dist").alias("d"))
    start = np.array([r.x for r in p.orderBy("id").collect()]) + np.random.default_rng(0).normal(0, 0.3, (p.count(), 2))
    got = fit(sp, Randers(0.0), "path_frozen", init=start, outer_iter=5, graph_neighbors=4, direct_stress_weight=0.1, direct_stress_mode="hinge")
    assert got.history[-1]["stress"] < got.history[0]["stress"] + 1e-9
    soft = fit(sp, ConvexMatsumoto(0.2), "soft_bellman_ford", init=start, max_iter=3, n_relaxations=6, n_local_pairs=3)
    assert np.isfinite(soft.stress)


def test_forbidden_directions(spark):
    with pytest.raises(ValueError):
        O.direct_raw(np.array([[0.0, 0], [0, 1]]), O.PairArrays(np.array([0]), np.array([1]), np.ones(1), np.ones(1)), Matsumoto(1.25))
    with pytest.raises(TypeError):
        fit(dense(spark), Matsumoto(0.5), "smacof_randers")
    with pytest.raises(ValueError):
        fit(dense(spark), optimizer="nothing")
    assert fit(dense(spark), optimizer=lambda d, m, **k: "own") == "own"


def test_classical_mds_and_rotations(spark):
    x = np.random.default_rng(3).normal(size=(12, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    y = np.array([r.y for r in I.classical_mds(edges(spark, [(i, j, d[i, j]) for i in range(12) for j in range(12) if i != j])).orderBy("id").collect()])
    assert np.allclose(np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1)), d)
    for v in ([1.0, 2.0], [1.0, 2.0, 3.0], [0.0, 0.0, 1.0], [0.0, 0.0, -1.0]):
        r = I.rotation_to_down(np.array(v))
        assert np.allclose(r @ np.array(v), -np.linalg.norm(v) * np.eye(len(v))[-1]) and np.allclose(r @ r.T, np.eye(len(v)))
    assert np.allclose(I.rotation_to_down(np.zeros(2)), np.eye(2))


def test_stores(spark, tmp_path):
    e = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "id long, y array<double>")
    path = f"file://{tmp_path}/e"
    S.save_embedding(path, e, 0.5, None, {"b": 1, "a": "x"})
    assert S.load_embedding(spark, path, spark.range(1)).count() == 1
    with pytest.raises(ValueError):
        S.load_embedding(spark, path, spark.range(3))
    assert S.matches(spark, path, b=1) and not S.matches(spark, path, b=2) and not S.matches(spark, path + "x", b=1)
    assert S.newest(spark, f"file://{tmp_path}/*").endswith("/e")
    m = spark.createDataFrame([(0, 1, 2.5)], "i long, j long, value double")
    S.write_matrix_market(m, f"file://{tmp_path}/m", 1, 2)
    assert S.read_matrix_market(spark, f"file://{tmp_path}/m").collect() == m.collect()
    knn = spark.createDataFrame([(0, 1, 1), (1, 1, 0)], "src long, rank int, dst long")
    labels = spark.createDataFrame([(0, 0), (1, 1)], "id long, label int")
    wanted = spark.createDataFrame([(0, 1)], "src_label int, dst_label int")
    plan = S.load_or_compute_plan(spark, f"file://{tmp_path}/p", labels, wanted, knn, 1)
    assert plan.count() == 1 and S.load_or_compute_plan(spark, f"file://{tmp_path}/p", labels, wanted, knn, 1, "error").count() == 1
    with pytest.raises(ValueError):
        S.load_or_compute_plan(spark, f"file://{tmp_path}/p", labels, wanted, knn.limit(1), 1, "error")


def test_synthetic_sets(spark):
    for df, n in ((X.vortical_sea(spark, 50), 50), (X.river(spark, 20), 20), (X.swiss_roll(spark, 30, hole=(0.1, 0.9, 0.4, 0.6)), 30), (X.spiral(spark, 25), 25), (X.mountains(spark, 6, 4), 24), (X.branching_tree(spark, 40), 40)):
        assert df.count() == n
    assert X.nested_rectangles(spark).select("x").distinct().count() == X.nested_rectangles(spark).count()
    sea = X.current_distances(X.river(spark, 40), 8)
    both = sea.alias("a").join(sea.alias("b"), (F.col("a.src") == F.col("b.dst")) & (F.col("a.dst") == F.col("b.src"))).where("a.d <> b.d")
    assert both.count() > 0
    water = X.archipelago(spark, 60)
    assert water.count() == 60 and water.where(G.inside_any_obstacle(F.get("x", F.lit(0)), F.get("x", F.lit(1)), X.ISLANDS)).count() == 0
    r = water.select(V.norm("w").alias("r")).agg(F.min("r"), F.max("r")).first()
    assert 0.38 * 0.8 - 1e-9 <= r[0] and r[1] <= 0.98 * 0.8 + 1e-9
    d = X.current_distances(water, support=X.archipelago_graph(water, 3))
    assert d.count() == 60 * 60 and d.where("d < 0").count() == 0


def test_obstacles_and_corridors(spark):
    x = [[0, 0], [1, 0], [2, 0], [3, 0]]
    wall = [{"cx": 1.5, "cy": 0.0, "rx": 0.2, "ry": 1.0, "angle_deg": 0.0}]
    with pytest.raises(RuntimeError):  # nothing sees past the wall
        G.obstacle_graph(points(spark, x), wall, 2, 3)
    low = [{"cx": 1.5, "cy": 0.9, "rx": 0.2, "ry": 0.5, "angle_deg": 0.0}]
    kept = {(r.src, r.dst) for r in G.obstacle_graph(points(spark, x), low, 1, 1).collect()}
    assert kept == {(0, 1), (1, 0), (1, 2), (2, 1), (2, 3), (3, 2)}
    with pytest.raises(RuntimeError):  # too few neighbours
        G.corridor_graph(points(spark, x), [(0.0, 0.0, 1.0, 0.0)], 0.1, 2, 3)


def test_of_a_dense_table_few_pairs_are_shuffled_for_neighbours(spark):
    from anisomap.operators import fuzzy

    r = np.random.default_rng(6)
    n = 150
    d = np.round(r.random((n, n)), 2)
    rows = [(i, j, float(d[i, j])) for i in range(n) for j in range(n) if i != j]
    dense = edges(spark, rows).repartition(4)
    assert fuzzy._candidates(dense, 5).count() <= 2 * 5 * n
    got = {(x.src, x["rank"]): x.dst for x in fuzzy.directed_knn(dense, 5).collect()}
    for i in range(n):
        order = [j for j in np.lexsort((np.arange(n), d[i])) if j != i][:5]
        assert [got[i, k] for k in range(1, 6)] == order


@pytest.mark.parametrize("margin", [None, 0.7])
def test_packed_pairs_give_the_same_stress(spark, margin):
    r = np.random.default_rng(8)
    rows = [(int(10 * i), int(10 * j), float(r.random() + 0.1), float(r.random())) for i in range(30) for j in range(30) if i != j]
    pairs = spark.createDataFrame(rows, "src long, dst long, d double, w double").repartition(3)
    ids, arrays = opt.collect_pairs(pairs)
    x = r.normal(size=(30, 2))
    a, b = O.direct_raw(x, arrays, Randers(0.3), margin), opt.packed_raw(opt.packed_pairs(pairs, ids), x, Randers(0.3), margin)
    assert a[0] == pytest.approx(b[0], rel=1e-12) and np.allclose(a[1], b[1], atol=1e-12)


def test_tasks_of_a_gradient_run_in_one_job(spark):
    """A local iterator runs a job for each partition, so that few of them work at a time."""
    parts = spark.range(0, 6, 1, 6).selectExpr("double(id) as v", "array(double(id), 1d, 2d, 3d) as g")
    spark.sparkContext.setJobGroup("parts", "parts")
    value, grad = opt.summed_parts(parts, (2, 2))
    assert value == 15 and grad.tolist() == [[15, 6], [12, 18]]
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("parts")) == 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_quantiles_of_many_values(spark, monkeypatch):
    from anisomap.operators import quantiles as U

    monkeypatch.setattr(U, "FEW", 10)
    shares = [0.0, 0.05, 0.5, 0.95, 1.0]
    for n, kind in ((11, "rand(3)"), (20_000, "rand(3)"), (20_001, "double(id % 7)"), (20_000, "if(id % 3 = 0, null, exp(20 * rand(1)))")):
        v = spark.range(n).selectExpr(f"{kind} as v").localCheckpoint()
        want = v.agg(F.percentile("v", F.array(*map(F.lit, shares)))).first()[0]
        assert U.large_quantiles(v, "v", shares) == pytest.approx(want, rel=1e-12)
    assert U.large_quantiles(spark.range(5).selectExpr("double(id) as v"), "v", [0.5]) is None
