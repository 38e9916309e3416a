"""Links between the parts of a graph against a shortest tree by brute force, with and without a predicate."""

import numpy as np
import pandas as pd
import pytest

from anisomap.operators import graph as G
from anisomap.operators import linking
from anisomap.operators.linking import closest, part_links
from tests.test_cover import points_of
from tests.test_operators import edges


def tree(x, part, clear=lambda a, b: np.ones(len(a), bool)):
    """Pairs of a shortest tree over parts: clear pairs in order of length, those that join two trees."""
    i, j = np.triu_indices(len(x), 1)
    d = np.sqrt(((x[i] - x[j]) ** 2).sum(1))
    ok = (part[i] != part[j]) & clear(x[i], x[j])
    label, out = part.copy(), set()
    for n in np.lexsort((j, i, d)):
        if ok[n] and label[i[n]] != label[j[n]]:
            out.add((int(i[n]), int(j[n])))
            label[label == label[j[n]]] = label[i[n]]
    return out, len(set(label.tolist()))


def pairs(links):
    return {(min(r.src, r.dst), max(r.src, r.dst)) for r in links.collect()}


def parted(n, parts, seed=0):
    r = np.random.default_rng(seed)
    part = r.integers(0, parts, n)
    x = r.random((n, 2)) * 0.8 + 6 * r.random((parts, 2))[part]
    first = {p: int(np.flatnonzero(part == p)[0]) for p in set(part.tolist())}
    return x, part, [(first[p], i, 1.0) for i, p in enumerate(part.tolist()) if i != first[p]]


@pytest.mark.parametrize("pivots, block", [(None, 4096), (12, 40)])
def test_links_are_a_shortest_tree(spark, monkeypatch, pivots, block):
    monkeypatch.setattr(linking, "FEW", 0 if pivots else 1000)
    x, part, rows = parted(260, 25)
    links, rounds, left = part_links(points_of(spark, x), edges(spark, rows), None, pivots, block)
    assert pairs(links) == tree(x, part)[0] and left == 1 and rounds <= 5
    wall = G._clear_of_ellipses([{"cx": 3.0, "cy": 3.0, "rx": 0.4, "ry": 2.5, "angle_deg": 20.0}], 15)
    links, rounds, left = part_links(points_of(spark, x), edges(spark, rows), wall, pivots, block)
    want, count = tree(x, part, wall)
    assert pairs(links) == want and left == count and want != tree(x, part)[0]


def test_two_thousand_parts(spark):
    x = np.random.default_rng(3).random((2000, 2))
    none = spark.createDataFrame([], "src long, dst long, d double")
    links, rounds, left = part_links(points_of(spark, x), none)
    assert rounds <= 12 and left == 1
    assert pairs(links) == tree(x, np.arange(2000))[0]


def test_parts_that_nothing_links(spark):
    x = np.array([[0.0, 0], [0, 1], [9, 0], [9, 1], [0.5, 0.5]])
    halves = lambda a, b: (a[:, 0] < 5) == (b[:, 0] < 5)
    none = spark.createDataFrame([], "src long, dst long, d double")
    links, _, left = part_links(points_of(spark, x), none, halves)
    assert left == 2 and pairs(links) == {(0, 4), (1, 4), (2, 3)}
    empty = points_of(spark, x).limit(0)
    assert part_links(empty, none)[1:] == (0, 0) and G.connect_components(empty, none).count() == 0


def test_equal_points_are_linked(spark):
    x = np.array([[0.0, 0], [0, 0], [0, 0], [1, 0]])
    got = G.connect_components(points_of(spark, x), spark.createDataFrame([], "src long, dst long, d double"))
    assert {(r.src, r.dst, r.d) for r in got.collect() if r.src < r.dst} == {(0, 1, 0.0), (0, 2, 0.0), (0, 3, 1.0)}


def test_bounds_leave_far_pairs_out():
    q = pd.DataFrame({"id": [0, 1], "x": [[0.0], [1.0]], "part": [0, 0]})
    b = pd.DataFrame({"id": [5, 6], "x": [[3.0], [0.5]], "part": [1, 0]})
    assert closest(q, b, None).values.tolist() == [[0, 1, 1, 5, 2.0]]
    assert len(closest(q, b, None, np.array([1.5, 1.5]))) == 0


def test_few_pairs_are_compared_in_double_precision(monkeypatch):
    r = np.random.default_rng(8)
    rows = lambda n, first: pd.DataFrame({"id": np.arange(first, first + n), "x": list(r.normal(size=(n, 16))), "part": r.integers(0, 150, n)})
    q, b = rows(400, 0), rows(8192, 1000)
    counted = []
    rough = linking.rough_distances
    monkeypatch.setattr(linking, "rough_distances", lambda x, y: counted.append(len(x) * len(y)) or rough(x, y))
    got = [closest(q, b, None), closest(q, b, None, np.full(len(q), 4.0))]
    assert sum(counted) < 400 * 8192 / 4
    monkeypatch.setattr(linking, "FIRST", 1 << 30)
    for one, bounds in zip(got, (None, np.full(len(q), 4.0)), strict=True):
        want = closest(q, b, None, bounds)
        want = want[want["d"] <= 4.0] if bounds is not None else want
        assert one.sort_values("part").values.tolist() == want.sort_values("part").values.tolist() and len(one) > 100
