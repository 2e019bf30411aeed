"""Hashes of any substring and minimiser runs over symbol arrays, in numpy.

A text is an array of random 64-bit symbol values. The hash of symbols i..j-1 is a polynomial in an odd
base modulo 2**64, read from one running sum, so that any k-gram costs O(1). Such sums can be made to collide, so
they only choose places and buckets; nothing counts as equal by them alone.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Odd bases of the two independent hashes (random constants).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
POS_BITS = 22
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over the word (one to one)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def byte_values(which: int) -> np.ndarray:
    """256 fixed random values of a byte."""
    return mix(np.arange(1, 257, dtype=U) * U(BASES[which]) + U(which))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _powers[base] = (out[0], out[1])
    return have


class Hasher:
    """Substring hashes of one symbol array."""

    def __init__(self, values: np.ndarray, which: int):
        n = len(values)
        self.up, down = powers(BASES[which], n + 1)
        # sum of values[i] * base**-i; multiplying by base**(start) takes the start out again
        self.sums = np.zeros(n + 1, dtype=U)
        np.cumsum(values * down[:n], out=self.sums[1:])

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k symbols from each position."""
        n = len(self.sums) - 1
        if n < k:
            return np.zeros(0, U)
        return mix((self.sums[k:] - self.sums[:-k]) * self.up[: n - k + 1])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of symbols start..end-1, with the length mixed in."""
        return mix((self.sums[end] - self.sums[start]) * self.up[start] + (end - start).astype(U) * U(0xA24BAED4963EE407))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values: running minima from both ends of blocks of w."""
    n = len(x)
    if n < w:
        return x[:0]
    blocks = -(-n // w)
    pad = np.full(blocks * w, np.iinfo(x.dtype).max, dtype=x.dtype)
    pad[:n] = x
    left = np.minimum.accumulate(pad.reshape(blocks, w), axis=1).ravel()
    right = np.minimum.accumulate(pad.reshape(blocks, w)[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def minimiser_runs(values: np.ndarray, doc_start: np.ndarray, doc_end: np.ndarray, window: int, k: int):
    """Runs of consecutive windows that share one minimiser.

    ``values``: the values of all symbols, documents end to end (2**22 symbols at most); document d holds symbols
    doc_start[d]..doc_end[d]-1. Returns arrays (doc, first window's symbol, number of windows, minimiser hash).
    The minimiser is the k-gram of least hash, leftmost if tied: equal windows have equal minimisers,
    and within one run no two windows are equal.
    """
    grams = Hasher(values, 0).grams(k)
    if len(values) > 1 << POS_BITS:
        raise ValueError("too many symbols in one step")
    low = U((1 << POS_BITS) - 1)
    best = sliding_min((grams & ~low) | np.arange(len(grams), dtype=U), window - k + 1)
    counts = np.maximum(doc_end - doc_start - window + 1, 0)
    at = ranges_of(doc_start, counts)
    if not len(at):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U))
    doc = np.repeat(np.arange(len(counts)), counts)
    place = (best[at] & low).astype(np.int64)
    new = np.empty(len(at), bool)
    new[0] = True
    np.not_equal(place[1:], place[:-1], out=new[1:])
    new[1:] |= doc[1:] != doc[:-1]
    head = np.flatnonzero(new)
    return doc[head], at[head], np.diff(np.append(head, len(at))), grams[place[head]]


def ranges_of(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1], dtype=np.int64) - np.repeat(ends - counts - starts, counts)


def word_bounds(raw: np.ndarray, is_space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes that aren't space."""
    inside = np.empty(len(raw) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~is_space[raw]
    turn = np.diff(inside)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def white_space() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = True
    return t
