"""An FM-index over many short sequences of integer symbols: suffix sorting, wavelet matrix, search and locate."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; only groups that are not told apart yet are sorted again.

    Symbol 0 ends a sequence; each such end is smaller than all words, and earlier ends are smaller than later ones.
    """
    n = len(symbols)
    ends = symbols == 0
    key = np.where(ends, np.cumsum(ends), symbols.astype(np.int64) + int(ends.sum()) + 1)
    order = np.argsort(key, kind="stable")
    new = np.append(True, key[order][1:] != key[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    size = np.diff(np.append(np.flatnonzero(new), n))
    open_ = order[np.repeat(size > 1, size)]
    h = 1
    while len(open_):
        beyond = open_ + h
        second = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        key = rank[open_] * (n + 1) + second
        order = np.argsort(key, kind="stable")
        open_, key = open_[order], key[order]
        group = rank[open_]
        new = np.append(True, key[1:] != key[:-1])
        first = np.append(True, group[1:] != group[:-1])
        at = np.arange(len(open_))
        begin = np.flatnonzero(new)[np.cumsum(new) - 1]
        group_begin = np.flatnonzero(first)[np.cumsum(first) - 1]
        rank[open_] = group + begin - group_begin
        size = np.diff(np.append(np.flatnonzero(new), len(at)))
        open_ = open_[np.repeat(size > 1, size)]
        h *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class WaveletMatrix:
    """Rank and access over a sequence of symbols below ``sigma``, for many positions at once."""

    def __init__(self, sequence: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        s = sequence
        for level in range(self.levels - 1, -1, -1):
            bit = ((s >> level) & 1).astype(bool)
            ones = np.zeros(len(s) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(s) - int(ones[-1]))
            s = np.concatenate([s[~bit], s[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Times that ``symbol`` stands before position ``at``."""
        low = np.zeros_like(at)
        for level, ones, zeros in zip(range(self.levels - 1, -1, -1), self.ones, self.zeros, strict=True):
            up = ((symbol >> level) & 1).astype(bool)
            at = np.where(up, zeros + ones[at], at - ones[at])
            low = np.where(up, zeros + ones[low], low - ones[low])
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            here = ones[at]
            up = ones[at + 1] > here
            at = np.where(up, zeros + here, at - here)
            out = (out << 1) | up
        return out


class FMIndex:
    """Index of a concatenation of sequences, each followed by a 0; symbols 1 to ``sigma - 1`` are words."""

    def __init__(self, symbols: np.ndarray, sigma: int, every: int = 16):
        sa = suffix_array(symbols)
        before = symbols[sa - 1]
        self.n, self.matrix = len(symbols), WaveletMatrix(before, sigma)
        self.less = np.append(0, np.cumsum(np.bincount(symbols, minlength=sigma)))
        # Sequence starts are sampled too, so that no walk leaves its sequence.
        kept = (sa % every == 0) | (before == 0)
        self.sampled, self.samples = kept, sa[kept]
        self.sample_rank = np.append(0, np.cumsum(kept))

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases (rows, padded) at once: the range of suffixes that each begins."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for step in range(int(lengths.max(initial=0))):
            alive = alive[(lengths[alive] > step) & (hi[alive] > lo[alive])]
            if not len(alive):
                break
            c = phrases[alive, lengths[alive] - 1 - step]
            lo[alive] = self.less[c] + self.matrix.rank(c, lo[alive])
            hi[alive] = self.less[c] + self.matrix.rank(c, hi[alive])
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes, by walking back to sampled ones."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.sampled[rows[open_]]
            ready = open_[done]
            out[ready] = self.samples[self.sample_rank[rows[ready]]] + steps[ready]
            open_ = open_[~done]
            at = rows[open_]
            c = self.matrix.access(at)
            rows[open_] = self.less[c] + self.matrix.rank(c, at)
            steps[open_] += 1
        return out
