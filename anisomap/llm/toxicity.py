"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A window of ``WINDOW`` words (one begins at every word but the last) is the bag of its words' character
n-grams, each a row of a hashed embedding table. The rows' average goes into a two-class softmax. As a text is toxic
if one passage is, its logit is a soft maximum of its windows' logits (the logarithm of their sum of exponentials at
sharpness ``SHARP``), and that is what training fits: embeddings and softmax learn together from labels of whole texts.
The soft maximum hardly grows with the number of windows, so that long clean texts stay clean. Misspelt words share most
n-grams with words that were learned.

Null and empty texts have no windows and score 0. Repeated rows get the same score; a score of exactly the threshold
counts as predicted. Columns of ``documents`` that are named like those that ``score_toxicity`` adds are replaced. An
empty table gives no rows; without labels the scores are an unfitted model's. A word of more than half a MB is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anisomap.llm import subwords
from anisomap.llm.common import fold, labelled_sample
from anisomap.llm.quality import scorer

SIZES, BITS, WINDOW, SHARP = (3, 4, 5), 17, 2, 4.0
#: Bytes of texts in a training step.
STEP_BYTES = 1 << 20
#: Share of labels of either kind that training takes to be wrong: else a window of a text would be learned for each.
WRONG = 0.02


#: Windows beyond which a soft maximum is taken over the mean of so many: else chance alone would make long texts toxic.
MANY = 1 << 16


def _probability(pooled: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Of soft maxima over so many windows; 0 where there was none."""
    pooled = pooled - np.log(np.maximum(1.0, windows / MANY))
    return np.where(np.isneginf(pooled), 0.0, 1 / (1 + np.exp(-np.clip(pooled / SHARP, -30, 30))))


class SubwordBag:
    def __init__(self, width: int = 16, seed: int = 0):
        r = np.random.default_rng(seed)
        self.E = r.normal(0, 0.1, (1 << BITS, width)).astype(np.float32)
        self.w = r.normal(0, 0.5, width).astype(np.float32)  # toxic minus clean class of the softmax
        self.bias = np.float32(-4.0)

    @staticmethod
    def _windows(a: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte ranges of the windows, and the piece of each."""
        first, _ = subwords.words(a)
        piece = np.searchsorted(starts, first, "right") - 1
        count = np.bincount(piece, minlength=len(starts))
        per = np.where(count > 0, np.maximum(1, count - WINDOW + 1), 0)
        owner = np.repeat(np.arange(len(starts)), per)
        begin = np.cumsum(count) - count
        k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        from_word = begin[owner] + k
        to_word = np.minimum(from_word + WINDOW, begin[owner] + count[owner])
        edge = np.append(first - 1, len(a) - 8)
        return edge[from_word], edge[to_word], owner

    def _table(self) -> np.ndarray:
        return self.E @ self.w

    def _forward(self, a: np.ndarray, starts: np.ndarray, table: np.ndarray):
        kept = list(subwords.grams(a, SIZES, BITS))
        value, number = np.zeros(len(a) + 1), np.zeros(len(a) + 1)
        for bucket, ok in kept:
            value[1 : len(ok) + 1] += table[bucket] * ok
            number[1 : len(ok) + 1] += ok
        value, number = np.cumsum(value), np.cumsum(number)
        lo, hi, owner = self._windows(a, starts)
        size = np.maximum(number[hi] - number[lo], 1)
        return (value[hi] - value[lo]) / size + self.bias, lo, hi, owner, size, kept

    @staticmethod
    def _pooled(z: np.ndarray, owner: np.ndarray, pooled: np.ndarray) -> None:
        """Add windows, in order of their owners, to the owners' soft maxima, which begin at -inf."""
        if len(owner):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            most = np.maximum.reduceat(z, first)
            more = np.log(np.add.reduceat(np.exp(SHARP * (z - np.repeat(most, np.diff(np.append(first, len(z)))))), first))
            pooled[owner[first]] = np.logaddexp(pooled[owner[first]], SHARP * most + more)

    def score(self, texts: list[str | None]) -> np.ndarray:
        pooled, table = np.full(len(texts), -np.inf), getattr(self, "frozen", None)
        windows = np.zeros(len(texts), np.int64)
        if table is None:
            table = self.frozen = self._table()
        for a, starts, text in subwords.blocks(texts, digits=True, lap=WINDOW - 1):
            z, _, _, owner, _, _ = self._forward(a, starts, table)
            self._pooled(z, text[owner], pooled)
            windows += np.bincount(text[owner], minlength=len(texts))
        return _probability(pooled, windows)

    def _gradients(self, texts: list[str], y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """Of the summed log loss of each block of texts: rows of the table, the derivatives by their products with w, and that by the bias."""
        for a, starts, text in subwords.blocks(texts, digits=True, limit=STEP_BYTES, lap=WINDOW - 1):
            z, lo, hi, owner, number, kept = self._forward(a, starts, self._table())
            pooled = np.full(len(starts), -np.inf)
            self._pooled(z, owner, pooled)
            p = _probability(pooled, np.bincount(owner, minlength=len(starts)))
            given = WRONG + (1 - 2 * WRONG) * p  # that the label says toxic
            by_logit = (given - y[text]) / (given * (1 - given)) * (1 - 2 * WRONG) * p * (1 - p)
            g = by_logit[owner] * np.exp(SHARP * z - pooled[owner])
            change = np.zeros(len(a) + 1)
            np.add.at(change, lo, g / number)
            np.add.at(change, hi, -g / number)
            weight = np.cumsum(change)
            total = np.zeros(1 << BITS)
            for bucket, ok in kept:
                total += np.bincount(bucket, weight[: len(ok)] * ok, 1 << BITS)
            rows = np.flatnonzero(total)
            yield rows, total[rows].astype(np.float32), float(g.sum())

    def fit(self, texts: list[str], y: list[int], epochs: int = 8, rate: float = 0.8, seed: int = 0) -> SubwordBag:
        """Adagrad over batches of some hundred kB; rows of the table that a batch does not touch are left alone.

        A text of more than ``STEP_BYTES`` counts as several.
        """
        r, order, y = np.random.default_rng(seed), np.arange(len(texts)), np.asarray(y)
        seen, seen_w, seen_b, limit = np.full(len(self.E), 1e-6, np.float32), np.full_like(self.w, 1e-6), 1e-6, 48
        for epoch in range(epochs):
            r.shuffle(order)
            now = rate * (1 - epoch / epochs)
            for at in range(0, len(order), limit):
                own = order[at : at + limit]
                for rows, t, by_bias in self._gradients([texts[i] for i in own], y[own]):
                    grad_w = self.E[rows].T @ t
                    seen[rows] += t * t * (self.w @ self.w)
                    self.E[rows] -= now * (t / np.sqrt(seen[rows]))[:, None] * self.w
                    seen_w += grad_w * grad_w
                    self.w -= 0.1 * now * grad_w / np.sqrt(seen_w)
                    seen_b += by_bias**2
                    self.bias -= np.float32(now * by_bias / np.sqrt(seen_b))
        return self

    def __getstate__(self) -> dict:
        """Scoring needs the bias and, per bucket, the embedding's product with the softmax weights."""
        return {"frozen": self._table(), "bias": self.bias}


def train_toxicity(
    documents: DataFrame, labels: DataFrame, rows: int = 12000, modulus: int = 4, held_out: int = 2, chars: int = 3 << 24, longest: int = 1 << 18
) -> SubwordBag:
    """Fit on a bounded sample of labelled texts: at most ``rows`` whole texts and ``chars`` characters, none above ``longest``."""
    return SubwordBag().fit(*labelled_sample(documents, labels, "toxic", rows, modulus, held_out, chars, longest))


def score_toxicity(documents: DataFrame, model: SubwordBag, threshold: float = 0.3) -> DataFrame:
    """All columns of ``documents`` with ``toxic_score`` and ``toxic_predicted``, every row kept."""
    return documents.withColumn("toxic_score", scorer(model)(F.col("text"))).withColumn("toxic_predicted", (F.col("toxic_score") >= threshold).cast("int"))


def toxicity(documents: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, **fit) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``documents``; with empty ``labels`` the model is unfitted."""
    model = train_toxicity(documents, labels, modulus=modulus, held_out=held_out, **fit)
    return score_toxicity(documents.select("doc_id", "text"), model).select(
        "doc_id",
        (fold("doc_id", modulus) == held_out).alias("held_out"),
        F.col("toxic_score").alias("score"),
        F.col("toxic_predicted").alias("predicted"),
    )
