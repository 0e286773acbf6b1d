"""Counts and order statistics of any stretch of a sequence, many at a time.

The sequence is held as one bit vector per bit of its values, each stably ordered by the
bits above (a wavelet matrix). A query walks down the bits with two prefix counts, so its
cost grows with the logarithm of the number of different values and not with the stretch.
"""

from __future__ import annotations

import numpy as np


class Wavelet:
    """Whole numbers from 0 on, in order."""

    def __init__(self, seq: np.ndarray) -> None:
        seq = np.asarray(seq, np.int64)
        self.bits = max(1, int(seq.max(initial=0)).bit_length())
        self.zeros: list[np.ndarray] = []  # zeros among the first i entries, bit by bit
        for k in range(self.bits - 1, -1, -1):
            one = (seq >> k) & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            seq = np.concatenate([seq[~one], seq[one]])

    def count(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of the entries lo to hi - 1 are below ``value``, and how many equal it."""
        lo, hi = np.asarray(lo, np.int64), np.asarray(hi, np.int64)
        big = value >> self.bits > 0
        below = np.where(big, hi - lo, 0)
        for k, z in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            a, b = z[lo], z[hi]
            one = (value >> k) & 1 == 1
            below += np.where(one & ~big, b - a, 0)
            lo, hi = np.where(one, z[-1] + lo - a, a), np.where(one, z[-1] + hi - b, b)
        return below, np.where(big, 0, hi - lo)

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of the entries lo to hi - 1; k must be below hi - lo."""
        lo, hi, k = (np.asarray(v, np.int64) for v in (lo, hi, k))
        out = np.zeros(len(lo), np.int64)
        for bit, z in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            a, b = z[lo], z[hi]
            one = k >= b - a
            out += one.astype(np.int64) << bit
            k = np.where(one, k - (b - a), k)
            lo, hi = np.where(one, z[-1] + lo - a, a), np.where(one, z[-1] + hi - b, b)
        return out


def sliding_ranks(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each entry, over the last ``n`` entries up to it: values below it, equal to it
    (itself included), and known values. NaN entries count nowhere and get zeros."""
    known = ~np.isnan(x)
    seen = np.concatenate([[0], np.cumsum(known)])
    below, ties = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    total = seen[1:] - seen[np.maximum(np.arange(len(x)) + 1 - n, 0)]
    if known.any():
        _, code = np.unique(x[known], return_inverse=True)
        hi = seen[1:][known]
        below[known], ties[known] = Wavelet(code).count(hi - total[known], hi, code)
    return below, ties, total
