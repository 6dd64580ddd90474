"""Sorted hash arrays with a prefix index, and hashing of character n-grams."""

from __future__ import annotations

import numpy as np

#: Fixed odd 64-bit multipliers, one for each distance from the end of an n-gram.
MULTIPLIERS = np.random.default_rng(20240117).integers(1 << 62, (1 << 63) - 1, 16).astype(np.uint64) * np.uint64(2) + np.uint64(1)


class SortedHashes:
    """Ascending 64-bit keys; a search starts where keys with the same leading bits do."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.ascontiguousarray(keys, dtype=np.uint64)
        bits = max(4, int(len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.start = np.append(self.start, np.int32(len(keys)))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Positions of ``wanted``, -1 where absent."""
        out = np.full(len(wanted), -1, np.int32)
        if not len(self.keys):
            return out
        slot = (wanted >> self.shift).astype(np.int64)
        at, end = self.start[slot], self.start[slot + 1]
        open_ = None
        while True:
            there = at < end
            hit = self.keys[np.minimum(at, len(self.keys) - 1)] == wanted
            hit &= there
            rest = there & ~hit
            if open_ is None:
                out[hit] = at[hit]
                open_ = np.flatnonzero(rest)
            else:
                out[open_[hit]] = at[hit]
                open_ = open_[rest]
            if not len(open_):
                return out
            wanted, at, end = wanted[rest], at[rest] + 1, end[rest]


def gram_hashes(codes: np.ndarray, first: int, last: int, order: int, skip: int = 0) -> np.ndarray:
    """Hashes of the n-grams of ``order`` codes that end ``skip`` before the positions [first, last)."""
    total = np.zeros(last - first, np.uint64)
    for back in range(order):
        a = first - skip - back
        total += (codes[a : a + last - first].astype(np.uint64) + np.uint64(1)) * MULTIPLIERS[back]
    return mixed(total + np.uint64(order))


def mixed(total: np.ndarray) -> np.ndarray:
    total = (total ^ (total >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return total ^ (total >> np.uint64(29))
