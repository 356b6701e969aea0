"""Exact lookup of 64-bit hashes for whole arrays."""

from __future__ import annotations

import numpy as np


class HashIndex:
    """Positions in a sorted array of distinct hashes, by their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(1, (2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        slots = (keys >> self.shift).astype(np.int64)
        self.start = np.searchsorted(slots, np.arange((1 << bits) + 1)).astype(np.int32)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Position of each value, or -1."""
        slot = (values >> self.shift).astype(np.int64)
        at, end = self.start[slot].astype(np.int64), self.start[slot + 1]
        out = np.full(len(values), -1, dtype=np.int64)
        left = np.flatnonzero(at < end)
        while len(left):
            equal = self.keys[at[left]] == values[left]
            out[left[equal]] = at[left[equal]]
            left = left[~equal]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out
