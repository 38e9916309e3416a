"""LM scoring: a probabilistic suffix tree over bytes.

Symbols are the bytes of lower-cased words, a blank after each word but the last, and an end. All contexts of up to
``DEPTH`` bytes are counted over all training texts, and all that occur are in the tree, however rare they are. A
context whose next-symbol distribution diverges from its suffix's by ``divergence`` nats has its own: its counts
smoothed with its suffix's distribution, which weighs more the more symbols the context has. Others take their suffix's.
A text is scored by the longest context at every byte.

The tree is a table in Spark: a row for each gram (context and symbol) that is in any text, with its probability, made
from the shortest contexts to the longest. What is held in memory is bounded, and does not change results: the grams
that are met most, at most ``HEAD``, and the words that reach ``word_share`` of all tokens are looked up; all rarer ones
are joined in.

Null and empty texts consist of the end. Without training texts every symbol is equally likely and the base score is
0. Repeated rows are counted and scored as often as they stand there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anisomap.llm import subwords
from anisomap.llm.common import fold, written

DEPTH = 5
END, BLANK = 0x0A, 0x20
BLOCK_BYTES = 1 << 20
#: Counts that a task holds before it hands them on.
HELD = 1 << 21
#: Grams that workers look up; all others are joined in.
HEAD = 1 << 19

_WORD = np.arange(256, dtype=np.uint8)
_WORD[0x41:0x5B] += 32
_WORD[[0x20, *range(0x09, 0x0E)]] = 0
_WORD[0] = 0xFF  # a zero byte is part of words; 0xFF is in no UTF-8 text

_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


class Stream:
    """Texts as one sequence of symbols: each begins with DEPTH ends, its words are followed by a blank or its end."""

    def __init__(self, texts: list[str | None]):
        head, parts, self.words_in, at = bytes([END] * DEPTH), [], np.zeros(len(texts), np.int64), 0
        first = np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            words = (t or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
            body = b" ".join(words)
            parts += [head, body, b"\n"]
            self.words_in[i] = len(words)
            first[i] = at + DEPTH
            at += DEPTH + len(body) + 1
        self.symbols = np.frombuffer(b"".join(parts), np.uint8)
        self.first = first
        self.after = np.append(first[1:] - DEPTH, at)  # of each text, one behind its end
        self.own = np.ones(len(self.symbols), bool)
        for d in range(1, DEPTH + 1):
            self.own[first - d] = False

    def units(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words with what ends them: starts, positions of the blank or end, and the text of each."""
        stops = np.flatnonzero(self.own & ((self.symbols == BLANK) | (self.symbols == END)))
        text = np.searchsorted(self.first, stops, "right") - 1
        starts = np.append(0, stops[:-1] + 1)
        starts = np.maximum(starts, self.first[text])
        return starts, stops, text

    def word_hashes(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """64-bit hashes of words; that of the empty word of an empty text is not a word's."""
        return subwords.word_hashes(self.symbols, starts, stops)

    def grams(self) -> np.ndarray:
        """DEPTH + 1 bytes ending at each position of a text, the last in the low byte."""
        at = np.flatnonzero(self.own)
        out = np.zeros(len(at), np.uint64)
        for j in range(DEPTH + 1):
            out |= self.symbols[at - j].astype(np.uint64) << np.uint64(8 * j)
        return out


#: The end's key among word hashes, and where other words' hashes may not lie.
END_KEY = np.int64(-1)


def _streams(texts: list[str | None]) -> Iterator[tuple[slice, Stream]]:
    since, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") + 8
        if size >= BLOCK_BYTES or i + 1 == len(texts):
            yield slice(since, i + 1), Stream(texts[since : i + 1])
            since, size = i + 1, 0


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


class _Held:
    """Sorted keys with counts of one kind. Beyond ``HELD`` they are merged; what is still more than half of that goes on."""

    def __init__(self, kind: int):
        self.kind, self.parts, self.size = kind, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pd.DataFrame]:
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > HELD:
            self.parts = [_merged(self.parts)]
            self.size = len(self.parts[0][0])
            if self.size > HELD // 2:
                yield from self.rest()

    def rest(self) -> Iterator[pd.DataFrame]:
        keys, counts = _merged(self.parts) if self.parts else (np.zeros(0, np.int64), np.zeros((0, 2)))
        self.parts, self.size = [], 0
        for at in range(0, len(keys), 1 << 17):
            k, c = keys[at : at + (1 << 17)], counts[at : at + (1 << 17)].astype(np.int64)
            yield pd.DataFrame({"kind": np.full(len(k), self.kind, np.int32), "key": k.astype(np.int64), "n": c[:, 0], "m": c[:, 1]})


def _counting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of a partition's words (kind 0) and grams (kind 1): in training texts (n), and in all (m, of grams).

    A key may come more than once: what a task holds is bounded, whatever the texts are.
    """
    words, grams = _Held(0), _Held(1)
    ends = 0
    for d in batches:
        learned = d["train"].to_numpy(bool)
        for rows, s in _streams([t if isinstance(t, str) else None for t in d["text"]]):
            train = learned[rows]
            starts, stops, text = s.units()
            real = (stops > starts) & train[text]
            keys, n = np.unique(s.word_hashes(starts[real], stops[real]).view(np.int64), return_counts=True)
            yield from words.add(keys, np.stack([n, n], 1))
            own, at = s.grams(), np.repeat(train, s.after - s.first)
            for part, weight in ((own[at], 1), (own[~at], 0)):
                keys, m = np.unique(part, return_counts=True)
                yield from grams.add(keys, np.stack([m * weight, m], 1))
            ends += int(train.sum())
    if ends:
        yield from words.add(np.array([END_KEY]), np.array([[ends, ends]]))
    yield from words.rest()
    yield from grams.rest()


def counted(documents: DataFrame, train: Column) -> tuple[DataFrame, DataFrame]:
    """(key, n) of the words of training texts, and (key, n, m) of the grams of all texts."""
    counts = documents.select("text", train.alias("train")).mapInPandas(_counting, "kind int, key long, n long, m long")
    counts = written(counts.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "counts")
    return counts.where("kind = 0").select("key", "n"), counts.where("kind = 1").select("key", "n", "m")


def gram_logs(grams: DataFrame, divergence: float) -> DataFrame:
    """(key, m, log): log10 of the probability of each gram's symbol after its longest context."""
    total = grams.agg(F.sum("n")).first()[0] or 0
    sums = [F.sum("n").alias("n"), F.sum("m").alias("m")]
    logs = grams.groupBy(F.col("key").bitwiseAND(255).alias("key")).agg(*sums).select("key", ((F.col("n") + 1) / F.lit(total + 256.0)).alias("p"))
    w = Window.partitionBy("context")
    for k in range(1, DEPTH + 1):
        own = grams.groupBy(F.col("key").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("key")).agg(*sums) if k < DEPTH else grams
        own = own.withColumn("suffix", F.col("key").bitwiseAND((1 << 8 * k) - 1)).join(logs.select(F.col("key").alias("suffix"), F.col("p").alias("below")), "suffix")
        met = F.col("n") > 0
        own = own.withColumn("context", F.shiftright("key", 8)).select(
            "*", F.sum("n").over(w).alias("seen"), F.sum(F.when(met, 1).otherwise(0)).over(w).alias("novel"), F.sum(F.when(met, F.col("below")).otherwise(0.0)).over(w).alias("covered")
        )
        # What a context has not met shares one factor of its suffix's distribution.
        size = F.greatest(F.col("seen") + F.col("novel"), F.lit(1))
        own = own.withColumn("mixed", (F.col("n") + F.col("novel") * F.col("below")) / size).withColumn("left", F.col("novel") / size)
        kl = F.sum(F.when(met, F.col("mixed") * F.ln(F.col("mixed") / F.col("below"))).otherwise(0.0)).over(w)
        own = own.withColumn("kl", kl + F.greatest(1 - F.col("covered"), F.lit(0.0)) * F.col("left") * F.ln("left"))
        logs = own.select("key", "m", F.when((F.col("seen") > 0) & (F.col("kl") >= divergence), F.col("mixed")).otherwise(F.col("below")).alias("p"))
    return logs.select("key", "m", F.log10("p").alias("log"))


class Lookup:
    """What workers hold to score texts: words and grams that are met most, in order of their keys."""

    def __init__(self, words: pa.Table, grams: pa.Table, tokens: int, distinct: int, texts: int):
        words, grams = words.sort_by("key"), grams.sort_by("key")
        self.words, self.counts = words["key"].to_numpy(), words["n"].to_numpy()
        self.grams, self.logs = grams["key"].to_numpy().view(np.uint64), grams["log"].to_numpy()
        self.tokens, self.texts, self.size = tokens, texts, tokens + distinct + 1

    def score(self, s: Stream) -> pd.DataFrame:
        """Per text: both scores as far as words and grams are held, and the others with how often they are there."""
        n = len(s.first)
        starts, stops, text = s.units()
        hashes, real = s.word_hashes(starts, stops).view(np.int64), stops > starts
        at, found = _places(self.words, hashes)
        found &= real
        base = np.bincount(text[found], np.log10((self.counts[at[found]] + 1) / self.size), n).astype(float)
        base += np.log10((self.texts + 1) / self.size)
        known = np.bincount(text[found], minlength=n) + (1 if self.texts else 0)
        other = real & ~found
        keys, each = np.unique(s.grams(), return_inverse=True)
        owner = np.repeat(np.arange(n), s.after - s.first)
        at, held = _places(self.grams, keys)
        logs = np.zeros(len(keys))
        logs[held] = self.logs[at[held]]
        score = np.bincount(owner, logs[each], n)
        tail = ~held[each]
        pairs, times = np.unique(owner[tail] * len(keys) + each[tail], return_counts=True)
        owner, keys = pairs // max(len(keys), 1), keys.view(np.int64)[pairs % max(len(keys), 1)]
        parted = lambda x, of: np.split(x, np.searchsorted(of, np.arange(1, n)))
        return pd.DataFrame({
            "n_tokens": s.words_in + 1, "n_known": known, "base_score": base, "score": score,
            "words": parted(hashes[other], text[other]), "grams": parted(keys, owner), "times": parted(times, owner),
        })


def _places(held: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``asked`` is in ``held``, and whether it is there."""
    if not len(held):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(held, asked), len(held) - 1)
    return at, held[at] == asked


def score_texts(documents: DataFrame, lookup: Lookup, words: DataFrame, logs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of ``documents``, whose grams ``logs`` has."""
    held = documents.sparkSession.sparkContext.broadcast(lookup)

    @F.pandas_udf("n_tokens long, n_known long, base_score double, score double, words array<long>, grams array<long>, times array<long>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = [held.value.score(s) for _, s in _streams([t if isinstance(t, str) else None for t in texts])]
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({x: [] for x in ("n_tokens", "n_known", "base_score", "score", "words", "grams", "times")})

    # The row's number is written with it, so that it stays the same.
    out = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", scored("text").alias("s")).select("row", "doc_id", "s.*")
    out = written(out, "scored")
    each = F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(lookup.size)))
    rare = out.select("row", F.explode("words").alias("key")).join(words, "key", "left")
    rare = rare.select("row", each.alias("base"), F.col("n").isNotNull().cast("long").alias("known"), F.lit(0.0).alias("more"))
    tail = out.select("row", F.inline(F.arrays_zip(F.col("grams").alias("key"), F.col("times").alias("times")))).toDF("row", "key", "times").join(logs.select("key", "log"), "key")
    tail = tail.select("row", F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("known"), (F.col("times") * F.col("log")).alias("more"))
    added = rare.union(tail).groupBy("row").agg(F.sum("base").alias("base"), F.sum("known").alias("known"), F.sum("more").alias("more"))
    plus = lambda x, y: F.col(x) + F.coalesce(F.col(y), F.lit(0))
    return out.join(added, "row", "left").select(
        "doc_id", "n_tokens", plus("n_known", "known").alias("n_known"), F.lit(lookup.tokens).cast("long").alias("train_tokens"), plus("base_score", "base").alias("base_score"), plus("score", "more").alias("score")
    )


def lm_scores(documents: DataFrame, modulus: int = 7, held_out: int = 2, divergence: float = 0.002, word_share: float = 5e-7) -> DataFrame:
    """Scores of all rows by a model of those whose id is not in the held-out fold."""
    words, grams = counted(documents, fold("doc_id", modulus) != held_out)
    logs = written(gram_logs(grams, divergence), "logs")
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    texts = (words.where(F.col("key") == int(END_KEY)).first() or (0, 0))[1]
    frequent = words.where(F.col("n") >= max(1.0, word_share * tokens)).toArrow()
    # The least power of two that at most HEAD grams are met as often as.
    least, room = 1 << 62, HEAD
    for r in sorted(logs.groupBy(F.floor(F.log2("m")).cast("int").alias("power")).count().collect(), key=lambda r: -r["power"]):
        room -= r["count"]
        if room < 0:
            break
        least = 1 << r["power"]
    head = logs.where(F.col("m") >= least).select("key", "log").toArrow()
    out = score_texts(documents, Lookup(frequent, head, int(tokens), int(distinct), int(texts)), words, logs)
    return out.select("doc_id", (fold("doc_id", modulus) == held_out).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
