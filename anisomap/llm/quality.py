"""Quality classifier: a convolutional network over bytes, in numpy.

A text's bytes are embedded; learned filters of ``WIDTH`` bytes are applied every ``STRIDE`` bytes and rectified.
Chunks of 512 bytes that overlap by half cover the whole text; each filter is max-pooled within every chunk. The mean
and the maximum over the text's chunks are combined by a small hidden layer and a logistic unit into one probability.
Filters, embeddings and both layers are learned together by Adam on labelled texts.

Texts of any length go through the filters in pieces of bounded size whose half-chunks are joined before pooling, so
that the pieces do not change a score. The network learns from a bounded sample of whole texts.

Null and empty texts have one chunk of padding and get the probability that this gives. Repeated rows get the same
score; a score of exactly the threshold counts as predicted. Columns of ``documents`` that are named like those that
``score_quality`` adds are replaced. An empty table gives no rows; without labels the scores are an unfitted net's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anisomap.llm.common import fold, labelled_sample

STRIDE, WIDTH, HALF = 4, 8, 256
#: Bytes that are put through the filters at once, in whole half-chunks.
PIECE = 1 << 17
#: Bytes of texts whose gradients are taken at once.
STEP_BYTES = 1 << 18


def _pack(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (0 is padding), each piece in whole half-chunks with at least STRIDE bytes of padding; halves of each."""
    halves = np.array([-(-(len(p) + STRIDE) // HALF) for p in pieces])
    codes = np.zeros(halves.sum() * HALF, np.uint8)
    for at, p in zip((np.cumsum(halves) - halves) * HALF, pieces, strict=True):
        codes[at : at + len(p)] = np.frombuffer(p, np.uint8)
        codes[at : at + len(p)] += 1
    return codes, halves


class ByteConv:
    """Parameters of the network; ``score`` needs nothing else."""

    def __init__(self, filters: int = 40, width: int = 8, hidden: int = 16, seed: int = 0):
        r = np.random.default_rng(seed)
        self.p = {
            "E": r.normal(0, 0.5, (256, width)).astype(np.float32),
            "W": r.normal(0, 1 / np.sqrt(WIDTH * width), (WIDTH * width, filters)).astype(np.float32),
            "b": np.zeros(filters, np.float32),
            "V": r.normal(0, 0.15, (2 * filters, hidden)).astype(np.float32),
            "a": np.zeros(hidden, np.float32),
            "u": r.normal(0, 0.3, hidden).astype(np.float32),
            "c": np.zeros(1, np.float32),
        }
        self.p["E"][0] = 0

    def _halves(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rectified filter outputs by position: (halves, positions, filters), and the embedded frames."""
        E, W, b = self.p["E"], self.p["W"], self.p["b"]
        frames = E.take(codes, axis=0).reshape(-1, STRIDE * E.shape[1])
        k = frames.shape[1]
        out = frames @ W[:k]
        out[:-1] += (frames @ W[k:])[1:]
        out += b
        np.maximum(out, 0, out=out)
        out[codes[::STRIDE] == 0] = 0  # windows that begin in padding
        return out.reshape(-1, HALF // STRIDE, W.shape[1]), frames

    @staticmethod
    def _chunks(pooled: np.ndarray, halves: np.ndarray) -> np.ndarray:
        """Max over each chunk: a half and the next; a text's last half stands alone."""
        chunks = pooled.copy()
        np.maximum(chunks[:-1], pooled[1:], out=chunks[:-1])
        last = np.cumsum(halves) - 1
        chunks[last] = pooled[last]
        return chunks

    def _long(self, raw: bytes) -> np.ndarray:
        """Maxima by half-chunk of a text of more than a piece; a piece sees the next one's first bytes."""
        out = []
        for at in range(0, len(raw), PIECE):
            codes, _ = _pack([raw[at : at + PIECE + STRIDE]])
            pooled = self._halves(codes)[0].max(1)
            out.append(pooled[: PIECE // HALF] if at + PIECE < len(raw) else pooled)
        return np.concatenate(out)

    def score(self, texts: list[str | None]) -> np.ndarray:
        n, f = len(texts), self.p["b"].size
        features = np.zeros((n, 2 * f), np.float32)

        def pool(rows: list[int], pooled: np.ndarray, halves: np.ndarray) -> None:
            chunks, at = self._chunks(pooled, halves), np.cumsum(halves) - halves
            features[rows, :f] = np.add.reduceat(chunks, at, axis=0, dtype=np.float64) / halves[:, None]
            features[rows, f:] = np.maximum.reduceat(chunks, at, axis=0)

        rows, block, held = [], [], 0
        for i, text in enumerate(texts):
            raw = (text or "").encode("utf-8", "replace")
            if len(raw) > PIECE:
                pooled = self._long(raw)
                pool([i], pooled, np.array([len(pooled)]))
            else:
                rows.append(i)
                block.append(raw)
                held += len(raw) + HALF
            if block and (held >= PIECE or i + 1 == n):
                codes, halves = _pack(block)
                pool(rows, self._halves(codes)[0].max(1), halves)
                rows, block, held = [], [], 0
        layer = np.tanh(features @ self.p["V"] + self.p["a"])
        z = layer @ self.p["u"] + self.p["c"][0]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def _step(self, pieces: list[bytes], y: np.ndarray, of: int | None = None) -> dict[str, np.ndarray]:
        """Gradients of the log loss of whole texts, as their part of a mean over ``of`` texts."""
        E, W, V = self.p["E"], self.p["W"], self.p["V"]
        f, d = W.shape[1], E.shape[1]
        codes, halves = _pack(pieces)
        h, frames = self._halves(codes)
        best = h.argmax(1)
        pooled = np.take_along_axis(h, best[:, None], 1)[:, 0]
        chunks = self._chunks(pooled, halves)
        first = np.cumsum(halves) - halves
        owner = np.repeat(np.arange(len(pieces)), halves)
        top = np.maximum.reduceat(chunks, first, axis=0)
        features = np.hstack([np.add.reduceat(chunks, first, axis=0) / halves[:, None], top])
        layer = np.tanh(features @ V + self.p["a"])
        p = 1 / (1 + np.exp(-np.clip(layer @ self.p["u"] + self.p["c"][0], -30, 30)))
        dz = ((p - y) / (of or len(y))).astype(np.float32)
        dlayer = (dz[:, None] * self.p["u"] * (1 - layer**2)).astype(np.float32)
        dfeatures = dlayer @ V.T
        largest = chunks == top[owner]  # two chunks that share the half with the maximum share its gradient
        ties = np.add.reduceat(largest.astype(np.float32), first, axis=0)
        dchunk = (dfeatures[:, :f] / halves[:, None])[owner] + np.where(largest, (dfeatures[:, f:] / ties)[owner], 0)
        from_next = chunks > pooled  # else the chunk's maximum is in its own half
        dpool = np.where(from_next, 0, dchunk)
        dpool[1:] += np.where(from_next[:-1], dchunk[:-1], 0)
        dpool[pooled <= 0] = 0
        position = best + (np.arange(len(h)) * (HALF // STRIDE))[:, None]
        position_next = np.minimum(position + 1, len(frames) - 1)
        a, c = frames[position], frames[position_next]  # halves, filters, k
        dW = np.vstack([np.einsum("hf,hfk->kf", dpool, a), np.einsum("hf,hfk->kf", dpool, c)])
        by_byte = codes.reshape(-1, STRIDE)
        where = np.concatenate([by_byte[position], by_byte[position_next]], axis=-1)  # halves, filters, WIDTH
        grad = (dpool[:, :, None] * W.T[None]).reshape(-1, d)  # rows by half, filter and byte
        flat = where.reshape(-1)
        dE = np.stack([np.bincount(flat, grad[:, j], 256) for j in range(d)], 1).astype(np.float32)
        dE[0] = 0
        return {"E": dE, "W": dW, "b": dpool.sum(0), "V": features.T @ dlayer, "a": dlayer.sum(0), "u": layer.T @ dz, "c": dz.sum(keepdims=True)}

    def _gradients(self, raw: list[bytes], rows: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of a batch, from parts of about STEP_BYTES."""
        part = np.cumsum([len(raw[i]) + HALF for i in rows]) // STEP_BYTES
        parts = [rows[part == x] for x in np.unique(part)]
        each = [self._step([raw[i] for i in own], y[own], len(rows)) for own in parts]
        return {k: sum(g[k] for g in each) for k in self.p}

    def fit(self, texts: list[str], y: list[int], epochs: int = 12, batch: int = 32, rate: float = 4e-3, seed: int = 0) -> ByteConv:
        """Adam with a falling rate; each batch goes through once per epoch."""
        r, y = np.random.default_rng(seed), np.asarray(y, np.float32)
        if not len(y):
            return self
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.p["c"][0] = np.log(share / (1 - share))
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        (m, v), step = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2)), 0
        steps = epochs * -(-len(y) // batch)
        for _ in range(epochs):
            order = r.permutation(len(y))
            for at in range(0, len(y), batch):
                rows = order[at : at + batch]
                grads, step = self._gradients(raw, rows, y), step + 1
                now = rate * (1 - step / (steps + 1))
                for k, g in grads.items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self


def train_quality(
    documents: DataFrame, labels: DataFrame, rows: int = 4000, modulus: int = 5, held_out: int = 0, chars: int = 1 << 25, longest: int = 1 << 18,
    needed: bool = True,
) -> ByteConv | None:
    """Fit on a bounded sample of labelled texts: at most ``rows`` whole texts and ``chars`` characters, none above ``longest``.

    Without such texts the net is unfitted, or None if it is not ``needed``.
    """
    texts, y = labelled_sample(documents, labels, "quality", rows, modulus, held_out, chars, longest)
    return ByteConv().fit(texts, y) if texts or needed else None


def scorer(model):
    """A Pandas UDF from text to probability; the model (some hundred kB) travels as a broadcast."""
    from pyspark.sql import SparkSession

    held = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(held.value.score([t if isinstance(t, str) else None for t in texts]), dtype="float64")

    return score


def score_quality(documents: DataFrame, model: ByteConv, threshold: float = 0.3) -> DataFrame:
    """All columns of ``documents`` with ``quality_score`` and ``quality_predicted``, every row kept."""
    return documents.withColumn("quality_score", scorer(model)(F.col("text"))).withColumn(
        "quality_predicted", (F.col("quality_score") >= threshold).cast("int")
    )


def quality(documents: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, **fit) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``documents``; an empty ``labels`` gives scores of an unfitted net."""
    model = train_quality(documents, labels, modulus=modulus, held_out=held_out, **fit)
    return score_quality(documents.select("doc_id", "text"), model).select(
        "doc_id",
        (fold("doc_id", modulus) == held_out).alias("held_out"),
        F.col("quality_score").alias("score"),
        F.col("quality_predicted").alias("predicted"),
    )
