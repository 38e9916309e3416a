"""Words and character n-grams of many texts at once, as numpy arrays over their bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 19
#: Bytes of a word from which its hash is not a polynomial's.
LONG = 256

_LETTER = np.zeros(256, np.uint8)
for _b in [*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]:
    _LETTER[_b] = _b
_ALNUM = _LETTER.copy()
for _b in range(ord("0"), ord("9") + 1):
    _ALNUM[_b] = _b

#: Odd multipliers that spread packed n-grams over buckets, by n.
_MIX = {n: np.uint64(0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * n & 0xFFFFFFFFFFFFFFFF | 1) for n in range(1, 9)}


def pieces(text: str | None, digits: bool = False, limit: int = BLOCK, lap: int = 0) -> Iterator[np.ndarray]:
    """The text's lower-case bytes, 0 where no word is; texts above ``limit`` in pieces that end between words where they can.

    A piece begins with the last ``lap`` words of the one before.
    """
    raw = np.frombuffer((text or "").lower().encode("utf-8", "replace"), np.uint8)
    raw = (_ALNUM if digits else _LETTER)[raw]
    while len(raw) > limit:
        first, last = words(np.concatenate([np.zeros(1, np.uint8), raw[:limit], np.ones(1, np.uint8), np.zeros(1, np.uint8)]))
        whole = len(first) - 1  # the last one may go on behind the limit
        if whole <= 2 * lap:  # words of such length are cut
            yield raw[:limit]
            raw = raw[limit:]
            continue
        yield raw[: last[whole - 1] - 1]
        raw = raw[first[whole - lap] - 1 :]
    yield raw


def blocks(texts: list[str | None], digits: bool = False, limit: int = BLOCK, lap: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, text indices): pieces of texts joined with zeros around each, in blocks of bounded size."""
    held, owner, size = [], [], 1

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = np.zeros(size + 8, np.uint8)
        starts, at = np.empty(len(held), np.int64), 1
        for i, p in enumerate(held):
            starts[i] = at
            out[at : at + len(p)] = p
            at += len(p) + 1
        return out, starts, np.array(owner, np.int64)

    for i, text in enumerate(texts):
        for p in pieces(text, digits, limit, lap):
            if held and size + len(p) > limit:
                yield joined()
                held, owner, size = [], [], 1
            held.append(p)
            owner.append(i)
            size += len(p) + 1
    if held:
        yield joined()


def words(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-zero bytes; ``a`` begins and ends with zero."""
    edge = np.diff((a != 0).view(np.int8))
    return np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1


def grams(a: np.ndarray, sizes: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the bucket of the n-gram at each byte, and whether there is one.

    An n-gram lies in one word; the zero on either side of the word may be its first or last byte, so that word
    beginnings and endings are n-grams of their own. One that begins with such a zero belongs to the next byte's word.
    """
    m = len(a) - max(sizes)
    full = a != 0
    packed, inner = a[:m].astype(np.uint64), np.ones(m, bool)
    for n in range(2, max(sizes) + 1):
        packed |= a[n - 1 : n - 1 + m].astype(np.uint64) << np.uint64(8 * (n - 1))
        if n > 2:
            inner &= full[n - 2 : n - 2 + m]
        if n in sizes:
            ok = inner & (full[:m] | full[n - 1 : n - 1 + m]) if n == 2 else inner
            yield ((packed * _MIX[n]) >> np.uint64(64 - bits)).astype(np.int32), ok


def word_hashes(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever the word stands.

    It is a polynomial modulo 2^64 up to ``LONG`` bytes: the known words that collide under any base are longer. Longer
    words are hashed by themselves.
    """
    power = _powers(len(a))
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[: len(a)], out=total[1:])
    out = (total[ends] - total[starts]) * _powers(len(a), inverse=True)[starts]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    for i in np.flatnonzero(ends - starts > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(a[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


_POWERS: dict[bool, np.ndarray] = {}


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    if inverse not in _POWERS or len(_POWERS[inverse]) < n:
        base = 0xD6E8FEB86659FD93
        base = pow(base, -1, 1 << 64) if inverse else base
        m = max(n, BLOCK + 4096)
        p = np.full(m, base, np.uint64)
        p[0] = 1
        _POWERS[inverse] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[inverse]
