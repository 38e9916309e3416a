"""Benchmark decontamination: an FM-index per shard of training words, searched for all windows of the test items.

A window is ``window`` consecutive words of an item, or all words of a shorter one. The words of a shard of documents
are numbered; words that no window has end a sequence, since no occurrence crosses them, and sequences shorter than
the shortest window are left out of the index. Backward search runs all windows at once through wavelet-matrix ranks;
occurrences are located by sampled suffix positions, and overlapping ones merge into removal spans.

Null and empty texts have no words and no hits; items without words, and items with a null id, take no part. Repeated
documents are handled row by row, repeated items count once. Test items come in blocks of at most ``block_chars``
characters (or one item). Driver and workers hold the phrase table of one block at a time; with more than one, what is
found for the blocks before is written with the documents. Empty tables give no rows, or no hits. A column of
``documents`` that is named ``hits`` is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anisomap.llm import subwords
from anisomap.llm.common import written
from anisomap.llm.fmindex import FMIndex
from anisomap.storage import written_with

#: Bytes of texts that are cut into words at once, and words of a shard's index.
SHARD_BYTES, SHARD_WORDS = 1 << 20, 1 << 20

_WORD = np.zeros(256, np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _WORD[_b] = _b
for _b in range(0x41, 0x5B):
    _WORD[_b] = _b + 32

SPAN = ("first", "last", "start", "end")
HITS = f"struct<n_words:long,spans:array<struct<{','.join(f'{k}:long' for k in SPAN)}>>,items:array<string>>"


def _joined(texts: list[str | None]) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """(indices of texts, bytes of words with zeros between, starts) by shards of about SHARD_BYTES."""
    raw, size, since = [], 1, 0
    for i, t in enumerate(texts):
        raw.append(_WORD[np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8)])
        size += len(raw[-1]) + 1
        if size >= SHARD_BYTES or i + 1 == len(texts):
            a, starts, at = np.zeros(size, np.uint8), np.empty(len(raw), np.int64), 1
            for k, r in enumerate(raw):
                starts[k] = at
                a[at : at + len(r)] = r
                at += len(r) + 1
            yield range(since, i + 1), a, starts
            raw, size, since = [], 1, i + 1


def word_hashes_of(text: str | None) -> np.ndarray:
    for _, a, _ in _joined([text]):
        return subwords.word_hashes(a, *subwords.words(a))
    return np.zeros(0, np.uint64)


class Phrases:
    """Windows of test items as rows of word numbers, with the items of each."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = 10):
        hashes = [(item, h) for item, h in ((item, word_hashes_of(text)) for item, text in items) if len(h)]
        names, own = np.unique(np.array([item for item, _ in hashes], object), return_inverse=True) if hashes else (np.zeros(0, object), np.zeros(0, int))
        self.vocabulary = np.unique(np.concatenate([h for _, h in hashes])) if hashes else np.zeros(0, np.uint64)
        rows, of = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)]
        for (_, h), item in zip(hashes, own, strict=True):
            number = (np.searchsorted(self.vocabulary, h) + 1).astype(np.int32)
            short = np.pad(number, (0, max(0, window - len(number))))  # 0 is no word's number
            rows.append(np.lib.stride_tricks.sliding_window_view(short, window))
            of.append(np.full(len(rows[-1]), item))
        rows, of = np.concatenate(rows), np.concatenate(of)
        self.rows, at = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, np.int64))
        self.lengths = (self.rows > 0).sum(1)
        pairs = np.unique(np.stack([at.reshape(-1), of]), axis=1)
        self.item_of = names[pairs[1]].tolist()
        self.item_from = np.searchsorted(pairs[0], np.arange(len(self.rows) + 1))
        self.shortest = int(self.lengths.min(initial=window))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers from 1; 0 for words that no phrase has."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def occurrences(self, numbers: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, phrase) of every occurrence in a shard; ``text``: which text each word is of."""
        known = numbers > 0
        begins = known & np.append(True, ~known[:-1] | (text[1:] != text[:-1]))
        start = np.flatnonzero(begins)
        if not len(start) or not len(self.rows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        length = np.add.reduceat(known.astype(np.int64), start)
        start, length = start[length >= self.shortest], length[length >= self.shortest]
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begin = np.cumsum(length + 1) - (length + 1)
        symbols = np.zeros(int((length + 1).sum()), np.int64)
        inner = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        symbols[np.repeat(begin, length) + inner] = numbers[np.repeat(start, length) + inner]
        index = FMIndex(symbols, len(self.vocabulary) + 1)
        lo, hi = index.search(self.rows, self.lengths)
        size = hi - lo
        phrase = np.repeat(np.arange(len(lo)), size)
        at = index.locate(np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
        run = np.searchsorted(begin, at, "right") - 1
        return start[run] + at - begin[run], phrase

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int, int, int]], list[str]]]:
        """For each text: number of words, merged spans (words and bytes, ends excluded), sorted items."""
        for rows, a, starts in _joined(texts):
            first, last = subwords.words(a)
            text = np.searchsorted(starts, first, "right") - 1
            count = np.bincount(text, minlength=len(rows))
            base = np.cumsum(count) - count
            numbers = self.numbers(subwords.word_hashes(a, first, last))
            cover, found = np.zeros(len(first) + 1, np.int64), []
            lap = self.rows.shape[1] - 1
            for at in range(0, len(first), SHARD_WORDS):  # a text longer than a shard is indexed in overlapping parts
                own = slice(at, at + SHARD_WORDS + lap)
                word, phrase = self.occurrences(numbers[own], text[own])
                word = word + at
                np.add.at(cover, word, 1)
                np.add.at(cover, word + self.lengths[phrase], -1)
                found.append(np.unique(text[word] * len(self.rows) + phrase))
            hit = np.cumsum(cover)[:-1] > 0
            follows = np.append(False, hit[:-1] & (text[1:] == text[:-1])) if len(hit) else hit
            precedes = np.append(hit[1:] & (text[1:] == text[:-1]), False) if len(hit) else hit
            found = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
            items: dict[int, set[str]] = {}
            for x in found:
                p = int(x % len(self.rows))
                items.setdefault(int(x // len(self.rows)), set()).update(self.item_of[self.item_from[p] : self.item_from[p + 1]])
            spans: dict[int, list] = {}
            for s, e in zip(np.flatnonzero(hit & ~follows), np.flatnonzero(hit & ~precedes), strict=True):
                t = int(text[s])
                spans.setdefault(t, []).append((int(s - base[t]), int(e + 1 - base[t]), int(first[s] - starts[t]), int(last[e] - starts[t])))
            for t in range(len(rows)):
                yield int(count[t]), spans.get(t, []), sorted(items.get(t, ()))


def _phrase_blocks(benchmark: DataFrame, window: int, block_chars: int) -> tuple[int, Callable[[int], Broadcast]]:
    """The number of blocks of test items, and what makes the phrase table of one of them and hands it out."""
    usable = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item"), "text").distinct()
    size = usable.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(size) // block_chars))
    own = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return n, lambda b: benchmark.sparkSession.sparkContext.broadcast(Phrases([(r.item, r.text) for r in usable.where(own == b).collect()], window))


def _merge(found: list[list[tuple[int, int, int, int]]]) -> list[tuple[int, int, int, int]]:
    out: list[tuple[int, int, int, int]] = []
    for s in sorted(x for spans in found for x in spans):
        if out and s[0] <= out[-1][1]:
            a, b, c, d = out[-1]
            out[-1] = (a, max(b, s[1]), c, max(d, s[3]))
        else:
            out.append(s)
    return out


def _scan(held: Broadcast):
    @F.pandas_udf(HITS)
    def scan(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for texts, before in batches:
            out = []
            found = held.value.scan([t if isinstance(t, str) else None for t in texts])
            for (n, spans, items), old_spans, old_items in zip(found, before["spans"], before["items"], strict=True):
                if old_spans is not None and len(old_spans):
                    spans = _merge([spans, [tuple(s[k] for k in SPAN) for s in old_spans]])
                    items = sorted({*items, *old_items})
                out.append((n, [dict(zip(SPAN, s, strict=True)) for s in spans], items))
            yield pd.DataFrame(out, columns=["n_words", "spans", "items"])

    return scan


def find_hits(documents: DataFrame, benchmark: DataFrame, window: int = 10, block_chars: int = 1 << 22) -> DataFrame:
    """All columns of ``documents`` with ``hits``: n_words, merged spans, and the items that occur."""
    n, phrases = _phrase_blocks(benchmark, window, block_chars)
    found = documents.withColumn("hits", F.lit(None).cast(HITS))
    for b in range(n):
        held = phrases(b)
        found = found.withColumn("hits", _scan(held)(F.col("text"), F.col("hits")))
        if n > 1:
            found = written(found, "hits")
            held.destroy()
    return found


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``documents``."""
    hits = find_hits(documents.select("doc_id", "text"), benchmark, window)
    n_hit = F.aggregate("hits.spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return hits.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def remove_spans(documents: DataFrame, benchmark: DataFrame, window: int = 10, block_chars: int = 1 << 22) -> DataFrame:
    """``documents`` with the removal spans cut out of ``text``; a line break stands where a span was.

    Texts without hits are as they were. Where parts on both sides of a cut join to a window again, they are cut again.
    """
    n, phrases = _phrase_blocks(benchmark, window, block_chars)
    clean = documents.withColumn("text", _cut(phrases(0))(F.col("text"))) if n == 1 else documents
    # With several blocks, a cut for one may join a window of another: until a round over all of them changes nothing.
    changed = n > 1
    while changed:
        changed = 0
        for b in range(n):
            held = phrases(b)
            now = clean.withColumn("_before", F.xxhash64("text")).withColumn("text", _cut(held)(F.col("text")))
            now, (_, differ) = written_with(now, "cleaned", F.count(F.when(F.xxhash64("text") != F.col("_before"), 1)))
            clean, changed = now.drop("_before"), changed + differ
            held.destroy()
    return clean


def _cut(held: Broadcast):
    def cut(texts: list[str | None]) -> list[str | None]:
        out, open_ = list(texts), list(range(len(texts)))
        while open_:
            again = []
            for i, (_, spans, _) in zip(open_, list(held.value.scan([out[i] for i in open_])), strict=True):
                if spans:
                    raw, parts, at = out[i].encode("utf-8", "surrogatepass"), [], 0
                    for _, _, start, end in spans:
                        parts.append(raw[at:start].rstrip(b" "))
                        at = end
                    out[i] = b"\n".join([*parts, raw[at:]]).decode("utf-8", "surrogatepass")
                    again.append(i)
            open_ = again
        return out

    @F.pandas_udf("string")
    def cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(cut([t if isinstance(t, str) else None for t in texts]), dtype="object")

    # Else a filter on the new text would be pushed below it, and every text would be cleaned twice.
    return cleaned.asNondeterministic()
