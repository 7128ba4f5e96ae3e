"""A wavelet tree over a sequence of integers, level by level, that reports the values of many ranges at once."""

from __future__ import annotations

import numpy as np


class Wavelet:
    """Values below 2**bits by position; each level keeps how many of the first i values have a zero there."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.zeros: list[np.ndarray] = []
        rest = values.astype(np.int64)
        for level in range(self.bits - 1, -1, -1):
            one = (rest >> level & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]).astype(np.int32))
            rest = np.concatenate([rest[~one], rest[one]])

    def report(self, first: np.ndarray, last: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (query, value) with the value in [low, high) at a position in [first, last), for each query of the arrays."""
        query = np.flatnonzero((first < last) & (low < high))
        a, b, node = first[query], last[query], np.zeros(len(query), np.int64)
        for level, zeros in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            a0, b0 = zeros[a], zeros[b]
            query, node = np.concatenate([query, query]), np.concatenate([node << 1, node << 1 | 1])
            a, b = np.concatenate([a0, a - a0 + zeros[-1]]), np.concatenate([b0, b - b0 + zeros[-1]])
            live = (a < b) & (node << level < high[query]) & (node + 1 << level > low[query])
            query, a, b, node = query[live], a[live], b[live], node[live]
        return np.repeat(query, b - a), np.repeat(node, b - a)
