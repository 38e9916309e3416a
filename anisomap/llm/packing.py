"""Mixture-controlled packing: deficit round-robin over source queues fills windows to target token proportions.

Documents are tokenized once, and their ids written to the shared folder. Documents of more than ``CHUNK`` tokens are
cut there. Every row's chunks are dealt by a hash of row and chunk to parts of some million tokens, so that every part
holds a mixture, and neither one id nor one long text fills a part. Within a part, every window gives the queue of each
source in it a quantum of the source's target share; the queue with the largest deficit is served next, and what a
window leaves over or short stays in the deficits for the next one. A part begins with the deficits that all parts
before it leave. Pieces are cut only where a window is full or a quantum is used up. The rest of a part, less than a
window, goes into windows of powers of two, so that nothing is padded.

Every source has a queue of its own, however many there are; null sources share one. Of equal deficits the queue of the
first source by name is served. Null texts are empty and consist of the end id. An empty table gives no rows. Repeated
rows are packed as often as they stand there. Other columns of ``documents`` are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anisomap.llm.common import written
from anisomap.llm.tokens import ids_udf, public_ranks
from anisomap.storage import written_with

#: Tokens of a document that are dealt at once, and parts whose tokens are summed before those of such groups are.
CHUNK, GROUP = 1 << 16, 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, ids array<int>"


def window_sizes(tokens: int, window: int) -> list[int]:
    """Full windows, then the binary digits of the rest."""
    full, rest = divmod(tokens, window)
    return [window] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def round_robin(queues: list[list[int]], share: np.ndarray, deficit: np.ndarray, window: int, least: int):
    """(queue, document in it, start, length, window, offset) of every piece; ``queues``: token numbers of documents.

    ``deficit`` is changed in place to what is left at the end.
    """
    at, used = [0] * len(queues), [0] * len(queues)
    rank = np.where([bool(q) for q in queues], 0.0, -np.inf)
    for w, size in enumerate(window_sizes(sum(map(sum, queues)), window)):
        deficit += share * size
        offset = 0
        while offset < size:
            q = int((deficit + rank).argmax())
            left = queues[q][at[q]] - used[q]
            take = min(left, size - offset, max(least, int(np.ceil(deficit[q]))))
            if left - take < least // 4:
                take = min(left, size - offset)
            yield q, at[q], used[q], take, w, offset
            offset += take
            deficit[q] -= take
            used[q] += take
            if take == left:
                at[q], used[q] = at[q] + 1, 0
                if at[q] == len(queues[q]):
                    rank[q] = -np.inf


def _masked(ids: np.ndarray, known: np.ndarray) -> pd.arrays.IntegerArray:
    return pd.arrays.IntegerArray(ids.astype(np.int64), ~known)


def _pack_part(window: int, least: int, with_ids: bool):
    def pack(rows: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        plan = plan.sort_values("queue", kind="stable")
        share, deficit = plan["share"].to_numpy(float), plan["carried"].to_numpy(float)
        names = [None if q == "0" else q[1:] for q in plan["queue"]]
        own = np.searchsorted(plan["queue"].to_numpy(object), rows["queue"].to_numpy(object))
        rows = rows.assign(own=own, crc=[zlib.crc32(x) for x in rows["ids"]]).sort_values(["own", "order", "doc_id", "start", "crc"], kind="stable").reset_index(drop=True)
        base = int(rows["part"].iloc[0]) << 32
        raw = [memoryview(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in rows["ids"]]
        number = np.array([len(x) // 4 for x in raw], np.int64)
        first = np.searchsorted(rows["own"].to_numpy(), np.arange(len(share) + 1))
        queues = [number[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
        ids, before, doc, known, out, cut = rows["ids"], rows["start"].to_numpy(), rows["doc_id"].to_numpy(), rows["known"].to_numpy(bool), [], []
        for q, d, start, length, w, offset in round_robin(queues, share, deficit, window, least):
            row = first[q] + d
            out.append((row, before[row] + start, length, zlib.crc32(raw[row][4 * start : 4 * (start + length)]), base + w, offset, q))
            if with_ids:
                cut.append(np.frombuffer(ids[row], "<u2")[start : start + length].astype(np.int32))
        got = np.array(out, np.int64).reshape(-1, 7)
        return pd.DataFrame({
            "doc_id": _masked(doc[got[:, 0]], known[got[:, 0]]), "start": got[:, 1], "length": got[:, 2], "ids_crc32": got[:, 3], "doc_tokens": rows["n"].to_numpy()[got[:, 0]],
            "sequence_id": got[:, 4], "offset": got[:, 5], "source": [names[q] for q in got[:, 6]], "ids": cut if with_ids else None,
        })

    return pack


def _before(cells: DataFrame, *by: str) -> DataFrame:
    """``cells`` (by, part, n) with ``before``: the sum of n over all parts before, in two steps, so that no task has all parts."""
    cells = cells.withColumn("group", F.floor(F.col("part") / GROUP).cast("long"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = cells.groupBy(*by, "group").agg(F.sum("n").alias("n"))
    groups = groups.select(*by, "group", earlier(Window.partitionBy(*by, F.lit(0)).orderBy("group")).alias("base"))
    own = cells.withColumn("before", earlier(Window.partitionBy(*by, "group").orderBy("part")))
    return own.join(groups, [*by, "group"]).withColumn("before", F.col("before") + F.col("base")).drop("group", "base")


def _shares(totals: DataFrame, targets: dict[str | None, float] | None) -> DataFrame:
    """(queue, share) of the sources that there are; equal shares if no target is above 0."""
    if targets is None:
        wanted = totals.select("queue", F.col("n").cast("double").alias("w"))
    else:
        rows = [("0" if k is None else f"1{k}", float(v)) for k, v in targets.items()]
        given = totals.sparkSession.createDataFrame(rows, "queue string, w double")
        wanted = totals.select("queue").join(given, "queue", "left").select("queue", F.coalesce("w", F.lit(0.0)).alias("w"))
    whole = wanted.agg(F.sum("w").alias("s"), F.count("*").alias("c"))
    return wanted.crossJoin(F.broadcast(whole)).select("queue", F.when(F.col("s") > 0, F.col("w") / F.col("s")).otherwise(1 / F.col("c")).alias("share"))


def pack(
    documents: DataFrame, targets: dict[str | None, float] | None = None, window: int = 1024, end: int = 0, part_tokens: int = 1 << 21,
    least: int = 256, ranks: tuple[str, str] | None = None, with_ids: bool = False, chunk: int = CHUNK,
) -> DataFrame:
    """Pieces of documents in sequences; ``targets``: wanted token shares of sources, by default those of the corpus.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, and the piece's ids if
    ``with_ids``. doc_id is an integer.
    """
    path, pattern = ranks or public_ranks()
    coded = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), ids_udf(path, pattern, end)("text").alias("e"))
    # The row's number is written with it, so that it stays the same.
    coded = coded.select("doc_id", F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), "source")).alias("queue"), F.monotonically_increasing_id().alias("row"), "e.ids", "e.n")
    coded, (_, everything) = written_with(coded, "ids", F.sum("n"))
    parts = max(1, -(-int(everything or 0) // part_tokens))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(chunk).cast("long"))).alias("start")
    order = F.xxhash64("doc_id", "row", "start")
    # Null ids go as 0 with a flag: pandas would make floats of all ids.
    dealt = coded.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), "queue", "row", "n", "ids", starts)
    dealt = dealt.withColumn("order", order).withColumn("part", F.pmod("order", F.lit(parts)))
    size = F.least(F.col("n") - F.col("start"), F.lit(chunk))
    cells = written(dealt.groupBy("part", "queue").agg(F.sum(size).alias("n")), "cells")
    shares = _shares(cells.groupBy("queue").agg(F.sum("n").alias("n")), targets)
    whole = _before(cells.groupBy("part").agg(F.sum("n").alias("n"))).select("part", F.col("before").alias("all_before"))
    plan = _before(cells, "queue").join(whole, "part").join(shares, "queue")
    plan = plan.select("part", "queue", "share", (F.col("share") * F.col("all_before") - F.col("before")).alias("carried"))
    ids = F.when((F.col("start") == 0) & (F.col("n") <= chunk), F.col("ids")).otherwise(F.substring("ids", (2 * F.col("start") + 1).cast("int"), (2 * size).cast("int")))
    dealt = dealt.select("doc_id", "known", "queue", "n", "start", ids.alias("ids"), "order", "part")
    got = dealt.groupBy("part").cogroup(plan.groupBy("part")).applyInPandas(_pack_part(window, least, with_ids), PIECES)
    return got if with_ids else got.drop("ids")


def sequences(pieces: DataFrame, window: int = 1024, pad: int = 0) -> DataFrame:
    """(sequence_id, ids) from pieces with ids: padded to ``window`` unless their number is a power of two."""
    whole = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"]))
    got = pieces.groupBy("sequence_id").agg(whole.alias("ids"))
    n = F.size("ids")
    exact = F.pow(F.lit(2.0), F.floor(F.log2(n.cast("double")) + 1e-9)) == n
    return got.select("sequence_id", F.when(exact, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad), F.lit(window) - n))).alias("ids"))
