"""Language identification: a linear-chain conditional random field over words, in numpy.

Every word of a text gets a language, also where a text changes its language. A word's features are its affixes and
inner n-grams (2 to 4 bytes; word beginnings and endings are marked), the word itself, and which learned lexicon it is
in. Their weights and the transitions between languages are learned together; marginals come from forward-backward.
Training sequences are spans of labelled texts, many of them joined from texts of different languages, so that the
transitions are those of code-switched text.

A text's language is the one with the largest mean marginal over its words, which is the score; of equal ones the
first by name. Texts that are null or have no letter are ``und`` with score 0, and so is everything if no text has a
language label. Repeated rows get the same result. Columns of ``documents`` that are named like those that ``identify``
adds are replaced. An empty table gives no rows. A word of more than half a MB is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anisomap.llm import subwords
from anisomap.llm.common import fold, whole_texts, written

SIZES, BITS = (2, 3, 4), 16
#: Words of a segment that is labelled at once, and of context on either side.
CORE, MARGIN = 128, 16


class WordCRF:
    def __init__(self, languages: list[str]):
        self.languages, k = list(languages), len(languages)
        self.G = np.zeros((1 << BITS, k), np.float32)  # n-grams and whole words
        self.X = np.zeros((k + 1, k), np.float32)  # lexicon that a word is in (last: none)
        self.T = np.zeros((k, k), np.float32)
        self.S = np.zeros(k, np.float32)
        self.lexicon, self.lexicon_of = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    # features

    def _in_lexicon(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.full(len(hashes), len(self.languages))
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == hashes, self.lexicon_of[at], len(self.languages))

    def _emissions(self, a: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        k = len(self.languages)
        each, number = np.zeros((len(a), k), np.float32), np.zeros(len(a), np.float32)
        for bucket, ok in subwords.grams(a, SIZES, BITS):
            each[: len(ok)] += self.G.take(bucket, axis=0) * ok[:, None]
            number[: len(ok)] += ok
        begin = first - 1  # an n-gram that begins with the zero before a word is the word's
        total = np.add.reduceat(each, begin, axis=0)
        count = np.maximum(np.add.reduceat(number, begin), 1)
        hashes = subwords.word_hashes(a, first, last)
        return total / np.sqrt(count)[:, None] + self.G[(hashes >> np.uint64(64 - BITS)).astype(np.int64)] + self.X[self._in_lexicon(hashes)]

    # inference

    def _marginals(self, e: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of the words of each segment, (time, segment, language), with segments ordered by falling length; pair sums."""
        steps, n, k = int(length.max()), len(length), e.shape[1]
        T, S = np.exp(self.T - self.T.max()), np.exp(self.S - self.S.max())
        active = np.searchsorted(-length, -np.arange(steps), "left")  # segments longer than t
        alpha, psi = np.zeros((steps, n, k), np.float32), np.zeros((steps, n, k), np.float32)
        for t in range(steps):
            m = active[t]
            x = e[begin[:m] + t]
            psi[t, :m] = np.exp(x - x.max(1, keepdims=True))
            now = psi[t, :m] * (S if t == 0 else alpha[t - 1, :m] @ T) + 1e-30
            alpha[t, :m] = now / now.sum(1, keepdims=True)
        pairs, beta = np.zeros((k, k)), np.ones((n, k), np.float32)
        for t in range(steps - 1, -1, -1):
            m = active[t]
            if t + 1 < steps and active[t + 1]:
                m1 = active[t + 1]
                ahead = psi[t + 1, :m1] * beta[:m1]
                joint_norm = ((alpha[t, :m1] @ T) * ahead).sum(1, keepdims=True) + 1e-30
                pairs += (alpha[t, :m1] / joint_norm).T @ ahead * T
                back = ahead @ T.T
                beta[:m1] = back / back.sum(1, keepdims=True)
            gamma = alpha[t, :m] * beta[:m]
            alpha[t, :m] = gamma / gamma.sum(1, keepdims=True)
        return alpha, pairs

    def _block(self, a: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per piece: sums of its words' marginals, and the number of words."""
        k = len(self.languages)
        first, last = subwords.words(a)
        if not len(first):
            return np.zeros((len(starts), k)), np.zeros(len(starts))
        piece = np.searchsorted(starts, first, "right") - 1
        count = np.bincount(piece, minlength=len(starts))
        e = self._emissions(a, first, last)
        per = -(-count // CORE)
        owner = np.repeat(np.arange(len(starts)), per)
        base = (np.cumsum(count) - count)[owner]
        core = base + CORE * (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
        core_end = np.minimum(core + CORE, base + count[owner])
        begin, end = np.maximum(core - MARGIN, base), np.minimum(core_end + MARGIN, base + count[owner])
        order = np.argsort(begin - end, kind="stable")
        begin, length, owner, core, core_end = begin[order], (end - begin)[order], owner[order], core[order], core_end[order]
        gamma, _ = self._marginals(e, begin, length)
        word = begin[None, :] + np.arange(len(gamma))[:, None]
        gamma[(word < core) | (word >= core_end)] = 0
        sums = np.zeros((len(starts), k))
        np.add.at(sums, owner, gamma.sum(0))
        return sums, count

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        sums, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for a, starts, text in subwords.blocks(texts):
            if self.languages:
                s, c = self._block(a, starts)
                np.add.at(sums, text, s)
                np.add.at(count, text, c)
        out, score = [], np.zeros(len(texts))
        for i, t in enumerate(texts):
            if not count[i] or not (t.isascii() or any(x.isalpha() for x in t)):
                out.append("und")
                continue
            best = int(sums[i].argmax())
            out.append(self.languages[best])
            score[i] = min(1.0, sums[i, best] / count[i])
        return out, score

    def words(self, text: str) -> list[tuple[str, str, float]]:
        """Each word of a text with its language and that language's marginal."""
        out = []
        for a, _, _ in subwords.blocks([text]):
            first, last = subwords.words(a)
            if len(first):
                gamma, _ = self._marginals(self._emissions(a, first, last), np.zeros(1, np.int64), np.array([len(first)]))
                out += [(a[f:x].tobytes().decode("utf-8", "replace"), self.languages[int(g.argmax())], float(g.max())) for f, x, g in zip(first, last, gamma[:, 0], strict=True)]
        return out

    # training

    def fit(self, texts: list[str], labels: list[str], epochs: int = 4, span: int = 24, batch: int = 192, rate: float = 0.5, seed: int = 0) -> WordCRF:
        """Adagrad on the log likelihood of spans; half of them join words of two texts."""
        k, code = len(self.languages), {x: i for i, x in enumerate(self.languages)}
        gram_rows, sizes, hashes, label = [], [], [], []
        y = np.array([code[x] for x in labels], np.int32)
        for a, starts, text in subwords.blocks(texts):
            first, last = subwords.words(a)
            if not len(first):
                continue
            owner_of = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first - 1, len(a) - 8)))
            # Only the buckets are held, in 16 bits, in order of their words.
            rows, of = [], []
            for bucket, ok in subwords.grams(a, SIZES, BITS):
                where = np.flatnonzero(ok)
                where = where[(where >= first[0] - 1) & (where < len(a) - 8)]
                rows.append(bucket[where].astype(np.uint16))
                of.append(owner_of[where - (first[0] - 1)])
            of = np.concatenate(of)
            gram_rows.append(np.concatenate(rows)[np.argsort(of, kind="stable")])
            sizes.append(np.bincount(of, minlength=len(first)).astype(np.int32))
            hashes.append(subwords.word_hashes(a, first, last))
            label.append(y[text[np.searchsorted(starts, first, "right") - 1]])
        if not hashes:
            return self
        hashes, label = np.concatenate(hashes), np.concatenate(label)
        bounds, n = np.append(0, np.cumsum(np.concatenate(sizes))), len(hashes)
        gram_rows = np.concatenate(gram_rows)
        self._learn_lexicon(hashes, label)
        lexicon, whole = self._in_lexicon(hashes).astype(np.int32), (hashes >> np.uint64(64 - BITS)).astype(np.uint16)
        del hashes, sizes
        r, seen = np.random.default_rng(seed), [np.full_like(x, 1e-4) for x in (self.G, self.X, self.T, self.S)]
        spans = np.arange(0, n - span + 1, span)
        spans = spans if len(spans) else np.zeros(1, np.int64)
        span = min(span, n)
        for epoch in range(epochs):
            now = rate * (1 - epoch / epochs)
            r.shuffle(spans)
            for at in range(0, len(spans), batch):
                own = spans[at : at + batch]
                word = own[:, None] + np.arange(span)
                other = r.permutation(own)[:, None] + np.arange(span)
                cut, mixed = r.integers(1, max(2, span), len(own)), r.random(len(own)) < 0.5
                word = np.where(mixed[:, None] & (np.arange(span) >= cut[:, None]), other, word).reshape(-1)
                truth = label[word]
                size = bounds[word + 1] - bounds[word]
                at_gram = np.repeat(bounds[word] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                rows, row_word = gram_rows[at_gram], np.repeat(np.arange(len(word)), size)
                scale = 1 / np.sqrt(np.maximum(size, 1))
                e = np.stack([np.bincount(row_word, self.G[rows, j], len(word)) for j in range(k)], 1) * scale[:, None]
                e = (e + self.G[whole[word]] + self.X[lexicon[word]]).astype(np.float32)
                m = len(own)
                gamma, pairs = self._marginals(e, np.arange(m) * span, np.full(m, span))
                gamma = gamma.transpose(1, 0, 2).reshape(-1, k)
                gamma[np.arange(len(word)), truth] -= 1
                t2 = truth.reshape(m, span)
                np.subtract.at(pairs, (t2[:, :-1].ravel(), t2[:, 1:].ravel()), 1)
                dG = np.stack([np.bincount(rows, (gamma[:, j] * scale)[row_word], 1 << BITS) + np.bincount(whole[word], gamma[:, j], 1 << BITS) for j in range(k)], 1)
                dX = np.stack([np.bincount(lexicon[word], gamma[:, j], k + 1) for j in range(k)], 1)
                start = gamma.reshape(m, span, k)[:, 0].sum(0)
                for x, d, s in zip((self.G, self.X, self.T, self.S), (dG, dX, pairs, start), seen, strict=True):
                    d = d / m
                    s += d * d
                    x -= (now * d / np.sqrt(s)).astype(np.float32)
        return self

    def _learn_lexicon(self, hashes: np.ndarray, label: np.ndarray, least: int = 5, share: float = 0.9) -> None:
        """A language's lexicon: words met ``least`` times, ``share`` of them in it."""
        own, at = np.unique(hashes, return_inverse=True)
        count = np.zeros((len(own), len(self.languages)))
        np.add.at(count, (at, label), 1)
        total = count.sum(1)
        kept = (total >= least) & (count.max(1) >= share * total)
        self.lexicon, self.lexicon_of = own[kept], count[kept].argmax(1)


def train_language(
    documents: DataFrame, rows: int = 4000, modulus: int = 4, held_out: int = 2, least: int = 100, chars: int = 1 << 23, longest: int = 1 << 18
) -> WordCRF:
    """Fit on a bounded sample: at most ``rows`` whole texts and ``chars`` characters, no text above ``longest``.

    Every language is in it, with ``least`` texts if it has them (fewer if there are more than ``rows / least`` languages;
    of more than ``rows`` languages those with the most texts).
    """
    usable = documents.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", modulus) != held_out))
    usable = usable.where(F.length("text") <= longest)
    # Ids are chosen first: they are small, and only the chosen rows' texts go to the driver.
    ids = written(usable.select("doc_id", "lang").distinct().withColumn("h", F.xxhash64("doc_id")), "ids")
    counts = ids.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()
    if not counts:
        return WordCRF([])
    # Of each language, the ids with the smallest hashes: below a bound that some four times as many as wanted are below.
    low, span = -(1 << 63), 1 << 64
    bounds = [(r.lang, low + int(span * min(1.0, 4 * least / r.n)) - 1) for r in counts]
    bounds = F.broadcast(documents.sparkSession.createDataFrame(bounds, "lang string, bound long"))
    by: dict[str, list] = {}
    for r in ids.withColumn("lang", F.col("lang").cast("string")).join(bounds, "lang").where(F.col("h") <= F.col("bound")).collect():
        by.setdefault(r.lang, []).append((r.h, r.doc_id))
    each = max(1, min(least, rows // max(len(by), 1)))
    # The first texts of every language come before the others, so that no bound leaves a language out.
    chosen = dict.fromkeys((sorted(by[lang])[k][1], lang) for k in range(each) for lang in sorted(by) if k < len(by[lang]))
    chosen |= dict.fromkeys((r.doc_id, r.lang) for r in ids.where(F.col("lang").isin(list(by))).orderBy("h", "doc_id", "lang").limit(rows).collect())
    got = whole_texts(usable, ["doc_id", "lang"], list(chosen)[: max(rows, len(by))], chars, longest)
    labels = [lang for _, lang in got]
    return WordCRF(sorted(set(labels))).fit(list(got.values()), labels)


def identify(documents: DataFrame, model: WordCRF) -> DataFrame:
    """All columns of ``documents`` with ``lang_pred`` and ``lang_score``, every row kept."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            lang, score = held.value.predict([t if isinstance(t, str) else None for t in texts])
            yield pd.DataFrame({"lang": pd.Series(lang, dtype="object"), "score": pd.Series(score, dtype="float64")})

    out = documents.withColumn("_language", predict(F.col("text")))
    return out.withColumn("lang_pred", F.col("_language.lang")).withColumn("lang_score", F.col("_language.score")).drop("_language")


def language(documents: DataFrame, modulus: int = 4, held_out: int = 2, **fit) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``documents``."""
    model = train_language(documents, modulus=modulus, held_out=held_out, **fit)
    return identify(documents.select("doc_id", "text"), model).select(
        "doc_id", (fold("doc_id", modulus) == held_out).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )
