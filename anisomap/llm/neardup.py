"""MinHash near-duplicates: universal hash minima, banding, signature and set verification, connected components.

Texts with equal shingle sets form a class, of which only the smallest doc_id goes on: a class is what has one SHA-256
over the whole set. ``BANDS`` bands of ``ROWS`` minima put representatives into buckets; two sets of similarity 0.8
miss every band with probability 1.2e-7. Every bucket has a pivot, chosen by a mask of its key, so that the members of
a large group meet many pivots. A member's links to the pivots that agree with it best and that have the smallest id
are confirmed on full sets, and components over them come from alternating large-star and small-star. Parts of a bucket
that are still not connected are compared member by member in blocks of bounded size; a block gives the links that
connect its parts, never all of its pairs. These links join whole components: a second pass runs on roots only. A link
needs signatures that allow the wanted similarity (a margin of five standard deviations) and is confirmed on full sets.

Null and empty texts, and texts without words, have no shingles and are linked with nothing. A text of fewer words
than a shingle has its whole sequence as one. Rows with a null doc_id get a null component and are not called kept, but
``keep_one`` leaves them in; rows that share a doc_id are one node. Of pivots that agree equally, the largest id is
taken. An empty table gives no rows. Other columns of ``documents`` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anisomap.llm import subwords
from anisomap.llm.common import release, written
from anisomap.operators.components import connected_components
from anisomap.storage import drop, written_with

BANDS, ROWS = 40, 5
BLOCK_BYTES, CHUNK, LARGE = 1 << 20, 256, 8

_WORD = np.arange(256, dtype=np.uint8)
_WORD[0x41:0x5B] += 32
_WORD[[0x20, *range(0x09, 0x0E)]] = 0
_WORD[0] = 0xFF  # a zero byte is part of words; 0xFF is in no UTF-8 text

_R = np.random.default_rng(20260101)
_A = _R.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _R.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_C = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles, as sorted 64-bit hashes."""
    raw, held = [], 1
    for i, t in enumerate(texts):
        raw.append(_WORD[np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8)])
        held += len(raw[-1]) + 1
        if held < BLOCK_BYTES and i + 1 < len(texts):
            continue
        a, starts, at = np.zeros(held, np.uint8), np.empty(len(raw), np.int64), 1
        for k, r in enumerate(raw):
            starts[k] = at
            a[at : at + len(r)] = r
            at += len(r) + 1
        first, last = subwords.words(a)
        words = _mixed(subwords.word_hashes(a, first, last))
        bounds = np.searchsorted(first, np.append(starts, held))
        rolled = np.zeros(max(0, len(words) - size + 1), np.uint64)
        for j in range(size):
            rolled = _mixed(rolled * _C + words[j : j + len(rolled)] + np.uint64(j))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo >= size:
                yield np.unique(rolled[lo : hi - size + 1])
            elif hi > lo:
                short = np.uint64(hi - lo)
                for w in words[lo:hi]:
                    short = _mixed(np.array([short]) * _C + w + np.uint64(0xABCD))[0]
                yield np.array([short], np.uint64)
            else:
                yield np.zeros(0, np.uint64)
        raw, held = [], 1


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of all universal hash functions over each non-empty set: (sets, BANDS * ROWS) of 32 bits."""
    out = np.empty((len(sets), len(_A)), np.uint32)
    at = 0
    while at < len(sets):
        to, n = at, 0
        while to < len(sets) and (to == at or n + len(sets[to]) <= 1 << 16):
            n += len(sets[to])
            to += 1
        x = np.concatenate(sets[at:to]) >> np.uint64(32)
        begin = np.cumsum([0, *(len(s) for s in sets[at : to - 1])])
        h = np.empty_like(x)
        for k in range(len(_A)):
            np.multiply(x, _A[k], out=h)
            h += _B[k]
            out[at:to, k] = np.minimum.reduceat(h, begin) >> np.uint64(32)
        at = to
    return out


SIGNED = T.StructType([
    T.StructField("n_shingles", T.LongType()),
    T.StructField("digest", T.BinaryType()),
    T.StructField("bands", T.ArrayType(T.LongType())),
    T.StructField("signature", T.BinaryType()),
])


def _signed(size: int):
    @F.pandas_udf(SIGNED)
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = list(shingle_sets([t if isinstance(t, str) else None for t in texts], size))
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            minima = signatures([sets[i] for i in full])
            key = np.zeros((len(full), BANDS), np.uint64)
            for j in range(ROWS):
                key = _mixed(key * _C + minima[:, j::ROWS] + np.uint64(1))
            key = _mixed(key + np.arange(BANDS, dtype=np.uint64) * _C).view(np.int64)
            low = minima.astype(np.uint8)
            digest = [hashlib.sha256(x.tobytes()).digest() for x in sets]
            bands, signature = [None] * len(sets), [None] * len(sets)
            for row, i in enumerate(full):
                bands[i], signature[i] = key[row], low[row].tobytes()
            yield pd.DataFrame({"n_shingles": n, "digest": digest, "bands": bands, "signature": signature})

    return signed


def _sets(size: int):
    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([s.tobytes() for s in shingle_sets([t if isinstance(t, str) else None for t in texts], size)], dtype="object")

    return packed


def _least_agreement(similarity: float) -> int:
    """Equal minima below which a pair of that similarity is five standard deviations off."""
    n = BANDS * ROWS
    return int(np.floor(n * similarity - 5 * np.sqrt(n * similarity * (1 - similarity))))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union of their full sets."""

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a, b, strict=True)], dtype="bool")

    left, right = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").where(linked("x", "y")).select("a", "b").distinct()


def _similar(pairs: DataFrame, heads: DataFrame, least: int) -> DataFrame:
    """Of each ``a``'s pairs (a, b) whose signatures agree in ``least`` minima: the one that agrees most, and the one of the smallest b."""

    @F.pandas_udf("int")
    def agreeing(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
        return pd.Series((x == y).sum(1).astype(np.int32))

    left, right = (heads.select(F.col("doc_id").alias(i), F.col("signature").alias(v)) for i, v in (("a", "x"), ("b", "y")))
    found = pairs.join(left, "a").join(right, "b").select("a", "b", agreeing("x", "y").alias("agree")).where(F.col("agree") >= least)
    best = found.groupBy("a").agg(F.max(F.struct("agree", "b")).alias("best"), F.min("b").alias("low"))
    return best.select("a", F.explode(F.array_distinct(F.array("best.b", "low"))).alias("b"))


def _by_block(work, columns: list[str]):
    """``work`` on the rows of each block, over batches ordered by block; a block may lie in several batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: pd.DataFrame | None = None

        def done(d: pd.DataFrame) -> pd.DataFrame:
            block = d["block"].to_numpy()
            cut = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(d) else []
            out = [x for a, b in zip(cut, np.append(cut[1:], len(d)), strict=True) if b - a > 1 for x in work(d.iloc[a:b])] if len(d) else []
            return pd.DataFrame(out, columns=columns)

        for d in batches:
            if len(d):
                d = d if kept is None else pd.concat([kept, d], ignore_index=True)
                last = d["block"] == d["block"].iloc[-1]
                kept = d[last]
                yield done(d[~last])
        if kept is not None:
            yield done(kept)

    return run


def _candidates(d: pd.DataFrame, least: int) -> Iterator[tuple[int, int]]:
    """Rows (i, j) of a block in different parts whose signatures agree, and whose first common band is the block's."""
    root, side, band = d["root"].to_numpy(), d["side"].to_numpy(), int(d["band"].iloc[0])
    signature = np.frombuffer(b"".join(d["signature"]), np.uint8).reshape(len(d), -1)
    bands = np.stack(d["bands"].to_numpy()) if band else None
    for step in range(1, len(d)):
        i = np.flatnonzero((root[step:] != root[:-step]) & ((side[step:] != side[:-step]) | (side[step:] == 0)))
        i = i[(signature[i] == signature[i + step]).sum(1) >= least]
        if band:
            i = i[~(bands[i] == bands[i + step]).any(1)]
        yield from ((int(x), int(x) + step) for x in i)


def _needed(least: int):
    def work(d: pd.DataFrame) -> Iterator[tuple[int, int]]:
        wanted = sorted({x for pair in _candidates(d, least) for x in pair})
        block, ids = d["block"].to_numpy(), d["id"].to_numpy()
        yield from ((int(block[x]), int(ids[x])) for x in wanted)

    return _by_block(work, ["block", "id"])


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _connecting(least: int, percent: int):
    """Links that connect the parts of a block, each confirmed on full sets; at most one less than it has parts."""

    def work(d: pd.DataFrame) -> Iterator[tuple[int, int]]:
        part = {r: r for r in d["root"]}

        def top(r: int) -> int:
            while part[r] != r:
                part[r] = r = part[part[r]]
            return r

        ids, root = d["id"].to_numpy(), d["root"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in d["shingles"]]
        for i, j in _candidates(d, least):
            a, b = top(root[i]), top(root[j])
            if a != b and _linked(sets[i], sets[j], percent):
                part[max(a, b)] = min(a, b)
                yield int(ids[i]), int(ids[j])

    return _by_block(work, ["a", "b"])


def _between_parts(m: DataFrame, heads: DataFrame, sets: DataFrame, least: int, percent: int) -> DataFrame:
    """Links between the parts of buckets (key, band, id, root), from blocks of at most two chunks.

    If one part has many of a bucket's rows, the others meet that whole part, and once for all buckets that they share
    with it. The other parts of a bucket meet each other bucket by bucket.
    """
    parts = m.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("all"), F.count("*").alias("parts")).where("parts > 1")
    rows = m.join(mixed, "key").withColumn("big", F.col("most.n") >= LARGE).withColumn("main", F.col("big") & (F.col("root") == F.col("most.root")))
    rest = written(rows.where("not main").select("key", "band", "id", "root", "big", F.col("most.root").alias("toward"), "parts", (F.col("all") - F.when(F.col("big"), F.col("most.n")).otherwise(0)).alias("n")), "rest")

    facing = rest.where("big").select("toward", "id", "root").distinct()
    facing_n = facing.groupBy("toward").agg(F.count("*").alias("n_facing"))
    own = m.select("id", "root").distinct().join(facing_n.withColumnRenamed("toward", "root"), "root")
    own_n = own.groupBy("root").agg(F.count("*").alias("n_own")).join(facing_n.withColumnRenamed("toward", "root"), "root").withColumnRenamed("root", "toward")
    facing = facing.join(own_n, "toward")
    own = own.select(F.col("root").alias("toward"), "id", "root").join(own_n, "toward")
    count = lambda n: F.ceil(F.col(n) / CHUNK).cast("int")
    chunk = lambda n: F.pmod(F.xxhash64("id", F.lit(1)), count(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), count(n) - 1))
    own = own.select("toward", "id", "root", chunk("n_own").alias("i"), every("n_facing").alias("j"), F.lit(1).alias("side"))
    facing = facing.select("toward", "id", "root", every("n_own").alias("i"), chunk("n_facing").alias("j"), F.lit(2).alias("side"))
    toward_main = own.union(facing).select(F.xxhash64("toward", "i", "j", F.lit(1)).alias("block"), "side", F.lit(0).alias("band"), "id", "root")

    among = rest.where(F.col("parts") - F.col("big").cast("int") > 1).select("key", "band", "id", "root", chunk("n").alias("own"), every("n").alias("other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    among = among.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"), F.lit(2)).alias("block"), side.alias("side"), "band", "id", "root")

    blocks = written(toward_main.union(among), "blocks")
    signed = blocks.join(heads.withColumnRenamed("doc_id", "id"), "id").withColumn("bands", F.when(F.col("band") > 0, F.slice("bands", F.lit(1), F.col("band"))))
    needed = written(signed.repartition("block").sortWithinPartitions("block").mapInPandas(_needed(least), "block long, id long").distinct(), "needed")
    final = blocks.join(needed, ["block", "id"]).join(heads.withColumnRenamed("doc_id", "id"), "id").withColumn("bands", F.when(F.col("band") > 0, F.slice("bands", F.lit(1), F.col("band"))))
    final = final.join(sets.withColumnRenamed("doc_id", "id"), "id")
    return final.repartition("block").sortWithinPartitions("block").mapInPandas(_connecting(least, percent), "a long, b long").distinct()


def _shared_ids(usable: DataFrame, classes: DataFrame) -> DataFrame:
    """Links for ids that stand in several classes, which few or none do."""
    several = usable.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    rows = usable.join(several, "doc_id", "left_semi").select("doc_id", "digest")
    return rows.join(classes, "digest").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()


def _in_buckets(heads: DataFrame) -> DataFrame:
    """(key, band, id, pivot): members of buckets of at least two; a bucket's pivot is the least id under a mask that its key gives."""
    entries = heads.select(F.col("doc_id").alias("id"), F.posexplode("bands").alias("band", "key"))
    mask = F.xxhash64("key")
    shared = entries.groupBy("key").agg(F.count("*").alias("n"), F.min(F.col("id").bitwiseXOR(mask)).alias("m")).where("n > 1")
    return written(entries.join(shared.select("key", F.col("m").bitwiseXOR(mask).alias("pivot")), "key"), "buckets")


def near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``documents``; ids are integers."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(texts.withColumn("s", _signed(shingle)("text")).select("doc_id", "s.*"), "signed")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = written(usable.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    heads = usable.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "digest"], "left_semi")
    heads = written(heads.select("doc_id", "bands", "signature").dropDuplicates(["doc_id", "signature"]), "heads")
    members = _in_buckets(heads)
    sets = written(texts.join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", _sets(shingle)("text").alias("shingles")), "sets")
    release(documents.sparkSession)
    least = _least_agreement(percent / 100)
    pairs = members.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    links = _confirmed(_similar(pairs, heads, least), sets, percent).union(_shared_ids(usable, classes))
    roots = connected_components(links)
    now = written(members.select("key", "band", "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "members")
    drop(members)
    more, (n, *_) = written_with(_between_parts(now, heads, sets, least, percent), "links")
    if n:
        of = roots.select(F.col("id").alias("x"), F.col("root").alias("r"))
        joined = more.join(of, more["a"] == of["x"], "left").select(F.coalesce("r", "a").alias("a"), "b")
        joined = joined.join(of, joined["b"] == of["x"], "left").select("a", F.coalesce("r", "b").alias("b"))
        again = connected_components(joined).select(F.col("id").alias("root"), F.col("root").alias("top"))
        moved = roots.join(again, "root", "left").select("id", F.coalesce("top", "root").alias("root"))
        roots = moved.union(again.select(F.col("root").alias("id"), F.col("top").alias("root"))).distinct()
    by_class = classes.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left").select("digest", F.coalesce("root", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest")).join(by_class, "digest", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def keep_one(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``documents`` that are kept: one of each component (all rows that share its doc_id), and those without an id."""
    kept = near_duplicates(documents, shingle, percent).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    known = documents.join(kept, documents["doc_id"].cast("long") == kept["_kept"], "left_semi")
    return known.union(documents.where(F.col("doc_id").isNull()))
