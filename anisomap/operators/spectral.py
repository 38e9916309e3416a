"""Leading eigenvectors of symmetric matrices that are tables or products: nothing of n x n numbers is held anywhere."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anisomap.session import ship

#: Entries that a task gathers into chunks at once.
GATHERED = 1 << 19
#: Numbers of sums that tasks may send to the driver at once; beyond, task by task.
COLLECTED = 1 << 24


def leading(
    product: Callable[[np.ndarray], np.ndarray], n: int, count: int, seed: int = 0, tolerance: float = 1e-9, most: int = 500, width: int | None = None, room: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the ``count`` largest eigenvalues of a symmetric matrix that is known by its product with a block.

    Block Krylov spaces, started again from their best vectors when they hold ``4 (count + 2) + 24`` vectors, until the
    residuals are below ``tolerance`` times the largest value. Blocks of count + 2 find repeated eigenvalues; wider ones
    (``width``, in a space of ``room`` vectors) need fewer products, which counts where each is a job. Raises after
    ``most`` products.
    """
    count = min(count, n)
    width = min(n, max(count + 2, width or 0))
    room, chance = min(n, max(4 * width + 24, room or 0)), np.random.default_rng(seed)
    block = np.linalg.qr(chance.normal(size=(n, width)))[0]
    basis, image = np.zeros((n, 0)), np.zeros((n, 0))
    for _ in range(most):
        basis, image = np.hstack([basis, block]), np.hstack([image, product(block)])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        best = turn[:, :count]
        rest = image @ best - (basis @ best) * values[:count]
        if np.sqrt((rest * rest).sum(0)).max(initial=0) <= tolerance * max(np.abs(values).max(initial=0), 1e-300) or basis.shape[1] >= n:
            return values[:count], basis @ best
        block = image[:, -width:]
        if basis.shape[1] + width > room:
            kept = turn[:, : max(count + 2, room // 2)]
            basis, image = basis @ kept, image @ kept
            block = (image - basis * values[: kept.shape[1]])[:, :width]
        for _ in range(2):
            block = block - basis @ (basis.T @ block)
        # Directions that are used up are replaced by chance.
        size = np.sqrt((block * block).sum(0))
        spent = size <= 1e-13 * max(np.abs(values).max(initial=0), 1e-300)
        block = np.where(spent, chance.normal(size=block.shape), block / np.where(size > 0, size, 1))
        for _ in range(2):
            block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
        block = block[:, : n - basis.shape[1]]
        width = block.shape[1]
    raise RuntimeError(f"eigenvectors did not settle in {most} products")


def upright(vectors: np.ndarray) -> np.ndarray:
    """Columns with signs so that the largest entry of each is positive."""
    if not vectors.size:
        return vectors
    return vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1, 1)


def chunks(entries: DataFrame, value: str) -> DataFrame:
    """Rows (src, dst, ``value``) as rows (src, n, total, own, dst array, v array) of many entries of a source each, without a shuffle.

    n and total: number and sum of the entries beside the diagonal; own: how many are on it.
    """

    def pack(src: np.ndarray, dst: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((dst, src))
        src, dst, v = src[order], dst[order], v[order]
        ids, start = np.unique(src, return_index=True)
        off = src != dst
        count = lambda x: np.add.reduceat(x, start)
        offsets = np.append(start, len(src)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (dst, v)]
        columns = [pa.array(ids), pa.array(count(off.astype(np.int64))), pa.array(count(np.where(off, v, 0.0))), pa.array(count((~off).astype(np.int64))), *lists]
        return pa.RecordBatch.from_arrays(columns, ["src", "n", "total", "own", "dst", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            size += b.num_rows
            if size >= GATHERED:
                yield pack(*map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
        if size:
            yield pack(*map(np.concatenate, zip(*held, strict=True)))

    ship(entries.sparkSession)
    rows = entries.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col(value).cast("double"))
    return rows.mapInArrow(run, "src long, n long, total double, own long, dst array<long>, v array<double>")


def chunk_product(packed: DataFrame, ids: np.ndarray, mean: np.ndarray | None = None) -> Callable[[np.ndarray], np.ndarray]:
    """The product of a matrix of ``chunks`` with a block over ``ids``: one job, one row a source of a task back.

    With the rows' ``mean`` the entries are centred first: less the means of row and column, plus the mean of these; entries
    that no row has stay 0.
    """
    context, parts = ship(packed.sparkSession).sparkContext, packed.rdd.getNumPartitions()
    places = context.broadcast((ids, mean, float(mean.mean()) if mean is not None and len(mean) else 0.0))

    def product(block: np.ndarray) -> np.ndarray:
        held = context.broadcast(block)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (own, m, grand), y, out = places.value, held.value, {}
            last = at = near = None
            for b in batches:
                src, to, values = (b.column(i) for i in range(3))
                dst, v = to.values.to_numpy(), values.values.to_numpy()
                low, first = to.offsets.to_numpy(), values.offsets.to_numpy()
                for row, s in enumerate(np.searchsorted(own, src.to_numpy()).tolist()):
                    ends = dst[low[row] : low[row + 1]]
                    # Rows of one block of points have the same ends.
                    if last is None or not np.array_equal(ends, last):
                        last, at = ends, np.minimum(np.searchsorted(own, ends), len(own) - 1)
                        known = own[at] == ends
                        known = None if known.all() else known
                        at = at if known is None else at[known]
                        near = y[at]
                    g = v[first[row] : first[row + 1]]
                    g = g if known is None else g[known]
                    if m is not None:
                        g = g - m[at] + (grand - m[s])
                    sums = g @ near
                    out[s] = out[s] + sums if s in out else sums
            if out:
                flat = np.concatenate(list(out.values()))
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, y.shape[1], dtype=np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(out, np.int64, len(out))), vectors], ["i", "v"])

        sums, total = packed.select("src", "dst", "v").mapInArrow(part, "i long, v array<double>"), np.zeros_like(block)
        if parts * block.size <= COLLECTED:
            got = sums.toArrow().combine_chunks()
            if got.num_rows:
                flat = got["v"].combine_chunks().flatten().to_numpy()
                np.add.at(total, got["i"].to_numpy(), flat.reshape(-1, block.shape[1]))
        else:
            for r in sums.toLocalIterator(prefetchPartitions=True):
                total[r.i] += r.v
        held.unpersist()
        return total

    return product


def table_product(entries: DataFrame, ids: np.ndarray, value: str) -> Callable[[np.ndarray], np.ndarray]:
    """The product of a matrix of rows (src, dst, ``value``) with a block over ``ids``."""
    return chunk_product(chunks(entries, value), ids)
