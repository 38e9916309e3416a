import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from anisomap.functions import campaign as C
from anisomap.functions import metrics as M
from anisomap.functions import vectors as V

METRICS = [M.Randers(0.5), M.Matsumoto(0.5), M.Matsumoto(1.25, max_phi=4.0), M.ConvexMatsumoto(1.0), M.Tobler(), M.ConvexTobler(), M.Minetti()]


def lit(u):
    return F.array(*[F.lit(float(x)) for x in u])


@pytest.mark.parametrize("metric", METRICS, ids=lambda m: type(m).__name__)
def test_columns_and_arrays_agree(spark, metric):
    u = np.random.default_rng(0).normal(size=(60, 3)) * [1, 1, 0.4]
    u[0] = 0
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(u)], "i int, u array<double>")
    got = df.select("i", metric.length_col(F.col("u")).alias("f"), metric.grad_col(F.col("u")).alias("g")).orderBy("i").collect()
    length, grad = metric.length(u), metric.grad(u)
    for i, r in enumerate(got):
        if np.isfinite(length[i]):
            assert r.f == pytest.approx(length[i], rel=1e-9)
            assert r.g == pytest.approx(grad[i].tolist(), rel=1e-7, abs=1e-9)
        else:
            assert r.f is None


@pytest.mark.parametrize("metric", METRICS, ids=lambda m: type(m).__name__)
def test_gradients_by_differences(metric):
    r = np.random.default_rng(1)
    for u in r.normal(size=(30, 2)) * [1, 0.3]:
        f = metric.length(u)
        if not np.isfinite(f):
            continue
        step = 1e-6
        diff = [(metric.length(u + step * e) - metric.length(u - step * e)) / (2 * step) for e in np.eye(2)]
        assert metric.grad(u[None])[0] == pytest.approx(diff, rel=1e-4, abs=1e-4)


def test_known_lengths():
    u = np.array([3.0, 4.0])
    assert M.Randers(0.5).length(u) == 7 and M.Randers(0.5).length(-u) == 3
    assert M.Matsumoto(0.5).length(u) == pytest.approx(5 / 0.6)
    assert np.isinf(M.Matsumoto(1.25).length(u))
    c = M.ConvexMatsumoto(1.0)
    assert c.phi(np.array([0.5]))[0] == pytest.approx(2) and c.phi(np.array([0.8]))[0] == pytest.approx(3.2)
    assert M.Minetti().phi(np.array([0.0]))[0] == pytest.approx(1)


@pytest.mark.parametrize("bad", [lambda: M.Randers(1.0), lambda: M.Randers(-0.1), lambda: M.Tobler(speed=0), lambda: M.Minetti(g_max=0), lambda: M.ConvexTobler(a=0), lambda: M.get_metric("nothing")])
def test_bad_parameters(bad):
    with pytest.raises(ValueError):
        bad()


def test_names():
    assert M.get_metric("Convexified-Matsumoto", alpha=1.0) == M.ConvexMatsumoto(1.0)


@given(st.lists(st.floats(-5, 5), min_size=2, max_size=2), st.lists(st.floats(-5, 5), min_size=2, max_size=2))
@settings(max_examples=200, deadline=None)
def test_triangle_inequality_of_convex_metrics(a, b):
    a, b = np.array(a), np.array(b)
    for m in (M.Randers(0.7), M.ConvexMatsumoto(0.8)):
        assert m.length(a + b) <= m.length(a) + m.length(b) + 1e-9


def test_cosine_edges(spark):
    row = spark.range(1).select(V.cosine(lit([0, 0]), lit([1, 0])).alias("zero"), V.cosine(lit([2, 0]), lit([-1, 0])).alias("back")).first()
    assert row.zero is None and row.back == -1


def test_time_columns(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, float("nan"), 3.0), (3, None, None)], "id int, a double, b double")
    assert [r.t for r in C.combined_time(df, ["a", "b"], "t").orderBy("id").collect()] == [1.0, 3.0, None]
    same = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None)], "id int, c double")
    assert [r.s for r in C.finite_rescaled(same, "c", "s").orderBy("id").collect()] == [0.0, 0.0, None]
