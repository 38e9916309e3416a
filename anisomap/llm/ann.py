"""Approximate nearest neighbours: inverted lists of coarse centroids with product-quantised residuals.

Centroids and codebooks are fitted on a bounded sample (``sample`` vectors by hash order); every vector is indexed with
its codes and the length of what they leave over. How many lists a query probes is the number that covers ``recall``
of the true neighbours of sample vectors within the sample; what is approximate is this choice alone. In a probed list,
asymmetric distances (a table of the distances between the query's residual and all codewords, looked up by code) and
what the codes leave over bound each true distance from both sides. All vectors that can be among the ``k`` nearest by
these bounds are ranked by exact distances in double precision between the original vectors: however many near copies
share a code, none is cut off.

Lists are bundled, or cut by a hash of their rows, into blocks of at most ``BLOCK`` vectors (fewer if there are few for
the cores), and a block's queries into groups of ``QUERIES``, so that no list, no id and no query set has to fit into
one task; a block is copied only for its own groups, and one that no query probes is not read. A query probes further
lists until they hold ``k`` vectors beside itself, so that it finds all candidates if there are few.

Vectors that are null, zero, of another length than most, or hold null, NaN or infinite components take no part, nor
do null ids. Repeated rows of an id count once, with the smaller distance. Ties go to the smaller id. No valid vectors
give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anisomap.llm.common import written

BLOCK, LEAST_BLOCK, QUERIES = 8192, 512, 4096
#: Distances that a worker holds at once.
CELLS = 1 << 20


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        count = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], x[r.choice(len(x), len(c))])
    return c


def _nearest(x: np.ndarray, c: np.ndarray, step: int = 4096) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([(half - x[i : i + step] @ c.T).argmin(1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


class InvertedFile:
    def __init__(self, sample: np.ndarray, lists: int, recall: float, k: int, width: int = 2, words: int = 256, seed: int = 0):
        d = sample.shape[1]
        self.centroids = _kmeans(sample, max(1, min(lists, len(sample))), 12, seed)
        own = _nearest(sample, self.centroids)
        rest = (sample - self.centroids[own])[:8192]
        self.cuts = [*range(0, d, width), d]
        self.books = [_kmeans(np.ascontiguousarray(rest[:, a:b]), words, 8, seed + a) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        self.probes = self._probes(sample, own, recall, k)

    def _probes(self, sample: np.ndarray, own: np.ndarray, recall: float, k: int) -> int:
        """Lists, nearest first, that hold ``recall`` of the neighbours of some sample vectors."""
        q = sample[:256]
        d = (sample * sample).sum(1) - 2 * q @ sample.T
        d[np.arange(len(q)), np.arange(len(q))] = np.inf
        near = np.argsort(d, 1)[:, : min(k, len(sample) - 1)]
        order = np.argsort((self.centroids**2).sum(1) - 2 * q @ self.centroids.T, 1)
        rank = np.argsort(order, 1)
        needed = np.take_along_axis(rank, own[near], 1).ravel()
        return int(np.quantile(needed, recall)) + 1 if len(needed) else 1

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = _nearest(x, self.centroids)
        rest = x - self.centroids[own]
        codes = np.stack([_nearest(np.ascontiguousarray(rest[:, a:b]), book) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)], 1)
        return own, codes.astype(np.uint8)

    def probed(self, q: np.ndarray, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        order = np.argsort((self.centroids**2).sum(1) - 2 * q @ self.centroids.T, 1)
        held = np.cumsum(sizes[order], 1)
        n = np.maximum(self.probes, (held < least).sum(1) + 1)
        return [o[:m] for o, m in zip(order, n, strict=True)]

    def guesses(self, rest: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distances between queries' residuals in a list and its reconstructed vectors, from tables: (queries, vectors)."""
        total = np.zeros((len(rest), len(codes)))
        for j, (a, b, book) in enumerate(zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)):
            part = rest[:, a:b]
            table = (part * part).sum(1)[:, None] - 2 * part @ book.T + (book * book).sum(1)
            total += table[:, codes[:, j]]
        return np.sqrt(np.maximum(total, 0))

    def left_over(self, x: np.ndarray, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distance of each vector from what its codes stand for."""
        made = np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], 1) + self.centroids[own]
        return np.sqrt(((x - made) ** 2).sum(1))

    def nearest_in(self, x: int, q: np.ndarray, q_ids: np.ndarray, v: np.ndarray, ids: np.ndarray, codes: np.ndarray, over: np.ndarray, k: int):
        """(query row, id, distance): for each query the k nearest ids of (a part of) list x; ids are in order."""
        new = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        step = max(1, CELLS // len(ids))
        for at in range(0, len(q), step):
            own = q[at : at + step]
            guess = self.guesses(own - self.centroids[x], codes)
            slack = over + 1e-6 * (guess + over + 1e-12)
            high = guess + slack
            high[q_ids[at : at + step, None] == ids] = np.inf
            by_id = np.minimum.reduceat(high, new, axis=1)
            bound = np.partition(by_id, k - 1, 1)[:, k - 1] if by_id.shape[1] > k else np.full(len(own), np.inf)
            rows, cols = np.nonzero((guess - slack <= bound[:, None]) & np.isfinite(high))
            for i in range(0, len(rows), CELLS // 8):
                r, c = rows[i : i + CELLS // 8], cols[i : i + CELLS // 8]
                yield at + r, ids[c], np.sqrt(((v[c] - own[r]) ** 2).sum(1))


def _best(query: np.ndarray, ids: np.ndarray, distance: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k nearest different ids, ties to the smaller id."""
    order = np.lexsort((distance, ids, query))
    first = np.append(True, (query[order][1:] != query[order][:-1]) | (ids[order][1:] != ids[order][:-1])) if len(order) else order
    order = order[first]
    order = order[np.lexsort((ids[order], distance[order], query[order]))]
    begin = np.searchsorted(query[order], query[order])
    return order[np.arange(len(order)) - begin < k]


def valid_vectors(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v): rows whose vector can take part, in double precision."""
    v = F.col(vector_column).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (sizes.d if sizes else 0))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding",
    sample: int = 20000, recall: float = 0.97,
) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the ``k`` nearest found, without the query's own id."""
    spark = vectors.sparkSession
    rows, asked = valid_vectors(vectors, id_column, vector_column), valid_vectors(queries, id_column, vector_column)
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fitted = _matrix(rows.orderBy(F.xxhash64("id"), "id", "v").limit(sample).toPandas()["v"])
    lists = max(1, min(len(fitted) // 8, int(np.sqrt(n) / 2)))
    held = spark.sparkContext.broadcast(InvertedFile(fitted, lists, recall, k))
    del fitted

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            if len(d):
                x = _matrix(d["v"])
                own, codes = held.value.encode(x)
                yield pd.DataFrame({"id": d["id"], "v": d["v"], "list": own.astype(np.int32), "codes": [c.tobytes() for c in codes], "over": held.value.left_over(x, own, codes)})

    index = rows.mapInPandas(encode, "id long, v array<double>, list int, codes binary, over double")
    # The row's number is written with it, so that it stays the same.
    index = written(index.withColumn("row", F.monotonically_increasing_id()), "index")
    sizes, ids = np.zeros(len(held.value.centroids), np.int64), np.zeros(len(held.value.centroids), np.int64)
    for r in index.groupBy("list").agg(F.count("*").alias("n"), F.approx_count_distinct("id", 0.01).alias("ids")).collect():  # a row a list
        sizes[r["list"]], ids[r["list"]] = r["n"], min(r["n"], int(r["ids"] * 0.9))
    room_in = max(LEAST_BLOCK, min(BLOCK, n // (4 * spark.sparkContext.defaultParallelism)))
    chunks, first, block, room = np.ones(len(sizes), np.int64), np.zeros(len(sizes), np.int64), -1, 0
    for i, s in enumerate(sizes):
        chunks[i] = max(1, -(-int(s) // room_in))
        if chunks[i] > 1 or s > room:
            first[i], block = block + 1, block + int(chunks[i])
            room = room_in - int(s) if chunks[i] == 1 else 0
        else:
            first[i], room = block, room - int(s)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            out = []
            for q, v, probed in zip(d["id"], d["v"], held.value.probed(_matrix(d["v"]), ids, k + 1) if len(d) else [], strict=True):
                by: dict[int, list[int]] = {}
                for x in probed:
                    for c in range(int(first[x]), int(first[x] + chunks[x])):
                        by.setdefault(c, []).append(int(x))
                out += [(q, v, c, x) for c, x in by.items()]
            yield pd.DataFrame(out, columns=["id", "v", "block", "lists"])

    wanted = written(asked.mapInPandas(probe, "id long, v array<double>, block long, lists array<int>"), "wanted")
    groups = wanted.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("long").alias("groups"))
    places = spark.createDataFrame(pd.DataFrame({"list": np.arange(len(sizes), dtype=np.int32), "first": first, "chunks": chunks}), "list int, first long, chunks long")
    blocks = index.join(F.broadcast(places), "list").withColumn("block", F.col("first") + F.pmod(F.xxhash64("id", "row"), F.col("chunks")))
    blocks = blocks.join(groups, "block").select("id", "v", "list", "codes", "over", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group"))
    wanted = wanted.join(groups, "block").select("id", "v", "lists", "block", F.pmod(F.xxhash64("id", "v"), F.col("groups")).alias("group"))

    def search(own: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        model, query, near, distance = held.value, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(own) and len(q):
            own = own.sort_values(["list", "id"], kind="stable")
            v, of, own_ids, over = _matrix(own["v"]), own["list"].to_numpy(), own["id"].to_numpy(), own["over"].to_numpy()
            codes = np.frombuffer(b"".join(own["codes"]), np.uint8).reshape(len(own), -1)
            asked_v, asked_ids = _matrix(q["v"]), q["id"].to_numpy()
            row = np.repeat(np.arange(len(q)), [len(x) for x in q["lists"]])
            probed = np.concatenate([np.asarray(x) for x in q["lists"]])
            for x in np.unique(probed):
                a, b = np.searchsorted(of, [x, x + 1])
                by = row[probed == x]
                if a < b:
                    for r, i, d in model.nearest_in(int(x), asked_v[by], asked_ids[by], v[a:b], own_ids[a:b], codes[a:b], over[a:b], k):
                        part = _best(by[r], i, d, k)
                        query.append(by[r][part])
                        near.append(i[part])
                        distance.append(d[part])
            query, near, distance = np.concatenate(query), np.concatenate(near), np.concatenate(distance)
            best = _best(query, near, distance, k)
            return pd.DataFrame({"query_id": asked_ids[query[best]], "vec_id": near[best], "score": distance[best]})
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    found = blocks.groupBy("block", "group").cogroup(wanted.groupBy("block", "group")).applyInPandas(search, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
