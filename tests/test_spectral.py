"""Eigenvectors by products against dense ones: many points, equal eigenvalues, separate parts; maps of large distances."""

import numpy as np
import pytest

from anisomap.operators import initializers as I
from anisomap.operators.fuzzy import spectral_start
from anisomap.operators.spectral import leading, table_product
from tests.test_operators import edges


def angle(a, b):
    """Sine of the largest angle between the spaces of two sets of columns."""
    a, b = np.linalg.qr(a)[0], np.linalg.qr(b)[0]
    return float(np.linalg.norm(b - a @ (a.T @ b), 2))


@pytest.mark.parametrize("n, count", [(1, 1), (3, 2), (40, 3), (300, 4)])
def test_leading_eigenvectors(n, count):
    r = np.random.default_rng(n)
    x = r.normal(size=(n, n))
    m = x + x.T
    values, vectors = leading(lambda y: m @ y, n, count)
    want, dense = np.linalg.eigh(m)
    assert np.allclose(values, want[::-1][:count], rtol=1e-9) and angle(dense[:, ::-1][:, :count], vectors) < 1e-6


def test_equal_eigenvalues():
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(120, 120)))[0]
    m = q @ np.diag([5.0, 5, 5, 3] + [1.0] * 60 + [0.0] * 56) @ q.T
    values, vectors = leading(lambda y: m @ y, 120, 4)
    assert np.allclose(values, [5, 5, 5, 3]) and angle(q[:, :4], vectors) < 1e-6
    assert np.allclose(leading(lambda y: 0 * y, 30, 2)[0], 0)


def test_spectral_start_is_the_dense_one():
    r = np.random.default_rng(2)
    x = r.random((500, 2)) * [3, 1]
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    near = np.argsort(d, 1)[:, 1:11]
    src, dst = np.repeat(np.arange(500), 10), near.ravel()
    p = np.exp(-d[src, dst] * 40)
    a = np.zeros((500, 500))
    a[src, dst] = p
    a = np.maximum(a, a.T)
    root = 1 / np.sqrt(a.sum(1))
    values, dense = np.linalg.eigh(np.eye(500) - root[:, None] * a * root)
    got = spectral_start(500, src, dst, p, 2)
    clean = got - np.random.default_rng(0).normal(0, 1e-4, got.shape)
    assert angle(dense[:, 1:3], clean) < 1e-6 and np.abs(clean).max() == pytest.approx(10)


def test_maps_from_tables_of_distances(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(40, 3)) * [5, 3, 1]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    dissim = edges(spark, [(i, j, float(d[i, j])) for i in range(40) for j in range(40) if i != j])
    want = {r.id: r.y for r in I.classical_mds(dissim, 2).collect()}
    monkeypatch.setattr(I, "LOCAL_POINTS", 0)
    got = {r.id: r.y for r in I.classical_mds(dissim, 2).collect()}
    assert got.keys() == want.keys() and np.allclose([got[i] for i in got], [want[i] for i in got], atol=1e-6)
    assert I.classical_mds(dissim.limit(0), 2).count() == 0


def test_product_of_a_table(spark):
    rows = [(7, 7, 2.0), (7, 9, 1.0), (9, 7, 1.0), (30, 9, -4.0)]
    y = np.array([[1.0, 2], [3, 4], [5, 6]])
    got = table_product(spark.createDataFrame(rows, "src long, dst long, g double"), np.array([7, 9, 30]), "g")(y)
    assert got.tolist() == [[5.0, 8.0], [1.0, 2.0], [-12.0, -16.0]]


def test_landmarks_lay_out_the_rest(spark):
    x = np.random.default_rng(6).normal(size=(30, 2)) * [4, 2]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    rows = [(i, j, float(d[i, j])) for i in range(30) for j in range(30) if i != j]
    want = {r.id: r.y for r in I.classical_mds(edges(spark, rows), 2).collect()}
    got = {r.id: r.y for r in I.landmark_mds(edges(spark, rows), 2).collect()}
    assert got.keys() == want.keys() and np.allclose([got[i] for i in got], [want[i] for i in got], atol=1e-6)
    # Distances in the plane are kept by any four landmarks; a point without a distance to one of them is left out.
    few = [r for r in rows if r[0] in (3, 9, 11, 20) and r[:2] != (3, 29)]
    got = {r.id: np.array(r.y) for r in I.landmark_mds(edges(spark, few), 2).collect()}
    assert set(got) == set(range(29))
    assert np.allclose([[np.linalg.norm(got[i] - got[j]) for j in range(29)] for i in range(29)], d[:29, :29], atol=1e-6)
    assert I.landmark_mds(edges(spark, rows).limit(0), 2).count() == 0


def test_wide_blocks_need_few_products():
    x = np.random.default_rng(3).normal(size=(400, 64))
    calls = []
    values, vectors = leading(lambda y: calls.append(1) or x @ (x.T @ y), 400, 2, width=32)
    want, dense = np.linalg.eigh(x @ x.T)
    assert len(calls) <= 4 and np.allclose(values, want[::-1][:2]) and angle(dense[:, ::-1][:, :2], vectors) < 1e-6


@pytest.mark.parametrize("local", [0, 2000])
@pytest.mark.parametrize("diagonal", [False, True])
def test_scaling_of_packed_squares_is_that_of_the_gram_table(spark, monkeypatch, local, diagonal):
    from anisomap.operators.objectives import centered_gram

    r = np.random.default_rng(8)
    d = r.random((20, 20)) + np.arange(20)
    # Pairs that are missing (both ways) stay 0 in the centred matrix, whichever way it is read.
    rows = [(3 * i, 3 * j, float(d[i, j]), float(d[j, i])) for i in range(20) for j in range(20) if (i != j or diagonal) and {i, j} != {2, 7}]
    pairs = spark.createDataFrame(rows, "src long, dst long, d double, back double")
    gram = centered_gram(pairs).toPandas()
    m = np.zeros((20, 20))
    m[gram["src"] // 3, gram["dst"] // 3] = gram["g"]
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    want = vectors[:, ::-1][:, :2] * np.sqrt(np.maximum(values[::-1][:2], 0))
    want *= np.where(want[np.abs(want).argmax(0), [0, 1]] < 0, -1, 1)
    monkeypatch.setattr(I, "LOCAL_POINTS", local)
    for table in (pairs, pairs.drop("back")):
        got = {x.id: x.y for x in I.classical_mds(table, 2).collect()}
        assert np.allclose([got[3 * i] for i in range(20)], want, atol=1e-6)


def test_spectral_start_settles_where_eigenvalues_are_close():
    # Pairs of copies on a long chain: the second eigenvalue is within 1e-6 of the first.
    n = 2400
    src, dst = np.arange(n - 1), np.arange(1, n)
    p = np.where(src % 2 == 0, 1.0, 0.3)
    got = spectral_start(n, src, dst, p, 1)
    clean = got - np.random.default_rng(0).normal(0, 1e-4, got.shape)
    a = np.zeros((n, n))
    a[src, dst] = a[dst, src] = p
    root = 1 / np.sqrt(a.sum(1))
    dense = np.linalg.eigh(root[:, None] * a * root)[1][:, -2:-1]
    assert angle(dense, clean) < 1e-4


def test_many_landmarks_are_solved_without_their_matrix(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(40, 3)) * [5, 3, 1]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    dissim = edges(spark, [(3 * i, 3 * j, float(d[i, j])) for i in range(12) for j in range(40) if i != j])
    want = {r.id: r.y for r in I.landmark_mds(dissim, 2).collect()}
    monkeypatch.setattr(I, "LOCAL_POINTS", 5)
    scaled = []
    monkeypatch.setattr(I, "_scaling", lambda *a, own=I._scaling: scaled.append(1) or own(*a))
    got = {r.id: r.y for r in I.landmark_mds(dissim, 2).collect()}
    assert scaled and len(want) == 40 and got.keys() == want.keys() and np.allclose([got[i] for i in got], [want[i] for i in got], atol=1e-6)
