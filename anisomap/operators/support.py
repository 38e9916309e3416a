"""The neighbour graph of an embedding that is held as an array: exact, in slabs along its widest axis.

An embedding has few dimensions, so points within the k-th distance along one axis are few. Slices of the points are
dealt to tasks when there are many; every slice gives the same wherever it is computed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

from anisomap.session import ship

#: Queries of a slice, and points above which slices are dealt to tasks.
SLICE, SPREAD = 256, 8192


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += (a[:, j, None] - b[None, :, j]) ** 2
    return out


def _slab(x: np.ndarray, order: np.ndarray, axis: np.ndarray, at: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, neighbour) of the queries order[at : at + SLICE]; ties go to the smaller place."""
    own = order[at : at + SLICE]
    low, high = max(0, at - 2 * k), min(len(order), at + SLICE + 2 * k)
    reach = np.sqrt(np.partition(_squares(x[own], x[order[low:high]]), k, 1)[:, k].max())
    low, high = np.searchsorted(axis, [axis[at] - reach, axis[at + len(own) - 1] + reach], "left")
    high = max(high, int(np.searchsorted(axis, axis[at + len(own) - 1] + reach, "right")))
    near = np.sort(order[low:high])
    d = _squares(x[own], x[near])
    d[near[None, :] == own[:, None]] = np.inf
    row, col = np.nonzero(d <= np.partition(d, k - 1, 1)[:, k - 1 : k])
    rank = np.lexsort((near[col], d[row, col], row))
    row, col = row[rank], col[rank]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return own[row[kept]], near[col[kept]]


def _outside(x: np.ndarray, part: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of some points the nearest one of another part, and its squared distance."""
    d = _squares(x[own], x)
    d[part[own][:, None] == part[None, :]] = np.inf
    best = d.argmin(1)
    return best, d[np.arange(len(own)), best]


def _sliced(spark: SparkSession | None, n: int, work: Callable[[int], tuple]) -> list[np.ndarray]:
    """Columns of ``work`` over the slices that begin at 0, SLICE, ... below n, in order."""
    starts = range(0, n, SLICE)
    if spark is None or n < SPREAD:
        return [np.concatenate(c) for c in zip(*map(work, starts), strict=True)]
    held = ship(spark).sparkContext.broadcast(work)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in b["id"]:
                a, c = held.value(int(s))
                yield pd.DataFrame({"at": s, "a": a, "b": c.astype(float)})

    parts = min(len(starts), 4 * spark.sparkContext.defaultParallelism)
    got = spark.range(0, n, SLICE, parts).mapInPandas(run, "at long, a long, b double").toPandas().sort_values("at", kind="stable")
    held.unpersist()
    return [got["a"].to_numpy(), got["b"].to_numpy()]


class _Slab:
    def __init__(self, x: np.ndarray, k: int):
        self.x, self.k = x, k
        widest = x[:, int(np.ptp(x, axis=0).argmax())]
        self.order = np.argsort(widest, kind="stable")
        self.axis = widest[self.order]

    def __call__(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        return _slab(self.x, self.order, self.axis, at, self.k)


class _Outside:
    def __init__(self, x: np.ndarray, part: np.ndarray, own: np.ndarray):
        self.x, self.part, self.own = x, part, own

    def __call__(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        return _outside(self.x, self.part, self.own[at : at + SLICE])


def parts_of(n: int, tail: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Numbers of the connected parts of an undirected graph whose edges are there both ways."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, tail, label[head])
        new = new[new]
        if (new == label).all():
            return np.unique(label, return_inverse=True)[1]
        label = new


def knn_support(x: np.ndarray, k: int, connected: bool = True, spark: SparkSession | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(tail, head) of the symmetric graph of the k nearest neighbours; if ``connected``, parts are linked by closest pairs.

    Every part but the largest takes its closest pair to any other part, all at once, until one is left: these are the
    edges of a shortest tree over the parts.
    """
    n, k = len(x), min(k, len(x) - 1)
    if k < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    tail, head = (c.astype(np.int64) for c in _sliced(spark, n, _Slab(x, k)))
    edges = np.unique(np.concatenate([tail * n + head, head * n + tail]))
    while connected:
        tail, head = edges // n, edges % n
        part = parts_of(n, tail, head)
        size = np.bincount(part)
        if len(size) < 2:
            break
        own = np.flatnonzero(part != size.argmax())
        to, d = _sliced(spark, len(own), _Outside(x, part, own))
        to = to.astype(np.int64)
        rank = np.lexsort((np.maximum(own, to), np.minimum(own, to), d, part[own]))
        first = rank[np.unique(part[own][rank], return_index=True)[1]]
        a, b = own[first], to[first]
        edges = np.unique(np.concatenate([edges, a * n + b, b * n + a]))
    return edges // n, edges % n
