"""An FM-index over word numbers: bit-packed wavelet levels over the Burrows-Wheeler transform, for patterns of bounded length."""

from __future__ import annotations

import numpy as np


def order_ranks(x: np.ndarray, depth: int) -> np.ndarray:
    """Dense ranks of the runs of ``depth`` symbols that start at each position (past the end: smallest)."""
    rank, have = np.unique(x, return_inverse=True)[1].astype(np.int64), 1
    while have < depth:
        step = min(have, depth - have)
        second = np.zeros(len(rank), np.int64)
        second[: len(rank) - step] = rank[step:] + 1
        rank = np.unique(rank * (len(rank) + 2) + second, return_inverse=True)[1].astype(np.int64)
        have += step
    return rank


class _Bits:
    """Packed bits with rank: 64 bits and one count per word."""

    def __init__(self, bits: np.ndarray):
        size = len(bits) // 64 + 1
        padded = np.zeros(size * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(size, np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & mask)


class FmIndex:
    """Index of a sequence of numbers from 0; finds patterns of up to ``depth`` symbols by backward search.

    Suffixes need to be in order of their first ``depth`` symbols only, which is as far as such a search looks.
    """

    def __init__(self, x: np.ndarray, depth: int):
        rank = order_ranks(x, depth)
        self.suffixes = np.argsort(rank, kind="stable")
        bwt = x[self.suffixes - 1]
        symbols = int(x.max()) + 1 if len(x) else 1
        self.starts = np.zeros(symbols + 1, np.int64)
        np.cumsum(np.bincount(x, minlength=symbols), out=self.starts[1:])
        self.levels = max(1, int(symbols - 1).bit_length())
        self.bits, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            one = (bwt >> level) & 1 == 1
            self.bits.append(_Bits(one))
            self.zeros.append(int(len(one) - one.sum()))
            bwt = np.concatenate([bwt[~one], bwt[one]])

    def occurrences(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol stands in the transform before ``lo`` and before ``hi``."""
        start = np.zeros(len(symbol), np.int64)
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k)) & 1 == 1
            a, b, c = (self.bits[k].rank(v) for v in (start, lo, hi))
            start = np.where(one, self.zeros[k] + a, start - a)
            lo = np.where(one, self.zeros[k] + b, lo - b)
            hi = np.where(one, self.zeros[k] + c, hi - c)
        return lo - start, hi - start

    def search(self, x: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lo, hi, length) for the pattern that ends before each of ``ends`` in ``x``: extends to the left for up to
        ``depth`` symbols while more than one suffix matches; length is how far it came."""
        symbol = x[ends - 1]
        lo, hi = self.starts[symbol].copy(), self.starts[symbol + 1].copy()
        length = np.ones(len(ends), np.int64)
        active = np.flatnonzero(hi - lo > 1)
        for step in range(2, depth + 1):
            if not len(active):
                break
            symbol = x[ends[active] - step]
            before_lo, before_hi = self.occurrences(symbol, lo[active], hi[active])
            lo[active] = self.starts[symbol] + before_lo
            hi[active] = self.starts[symbol] + before_hi
            length[active] = step
            active = active[hi[active] - lo[active] > 1]
        return lo, hi, length
