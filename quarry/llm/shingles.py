"""Word shingles of whole texts as sets of 64-bit hashes, and circulant MinHash signatures of the sets.

A circulant signature needs two permutations only: the first scatters the shingles, the second, shifted circularly by k,
orders them for coordinate k.  Both are bijections of the 32-bit integers, so shifting is addition modulo 2**32.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
#: Elements that are permuted at once, to stay in cache.
CHUNK = 1 << 15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[1]
    x = (x ^ (x >> np.uint64(29))) * _ODD[2]
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """The ascending distinct hashes of ``width`` consecutive words (A-Z in lower case, cut at ASCII white space) of each
    text; of a text with fewer words the hash of them all; of one without words none."""
    words = [t.encode().lower().split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    flat = [w for ws in words for w in ws]
    digest = xxhash.xxh3_64_intdigest
    known = {w: digest(w) for w in set(flat)}
    h = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))
    ends = np.cumsum(counts)
    out = []
    if len(flat) >= width:
        rolled = np.zeros(len(flat) - width + 1, np.uint64)
        for k in range(width):
            rolled = rolled * _ODD[0] + h[k : len(h) - width + 1 + k]
        rolled = _mix(rolled)
    for e, n in zip(ends.tolist(), counts.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(rolled[e - n : e - width + 1]))
        elif n:
            one = np.full(1, n, np.uint64)
            for x in h[e - n : e]:
                one = one * _ODD[0] + x
            out.append(_mix(one * _ODD[1]))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def bands_for(threshold: float, rows: int, miss: float = 1e-6) -> int:
    """So many bands that a pair at the threshold shares none of them with at most this probability."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """The circulant signature of each set, one row each; of an empty set the greatest numbers."""
    out = np.full((len(sets), size), 0xFFFFFFFF, np.uint32)
    c1, c2 = np.uint32(0x7FEB352D), np.uint32(0x846CA68B)
    a = 0
    while a < len(sets):
        b, total = a, 0
        while b < len(sets) and (b == a or total + len(sets[b]) <= CHUNK):
            total += len(sets[b])
            b += 1
        full = [i for i in range(a, b) if len(sets[i])]
        if full:
            first = (np.concatenate([sets[i] for i in full]) >> np.uint64(32)).astype(np.uint32)
            first ^= first >> np.uint32(16)  # the first permutation
            first *= np.uint32(0x85EBCA6B)
            first ^= first >> np.uint32(13)
            first *= np.uint32(0xC2B2AE35)
            first ^= first >> np.uint32(16)
            starts = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
            x, t = np.empty_like(first), np.empty_like(first)
            for k in range(size):
                np.add(first, np.uint32(k), out=x)  # the shift
                np.multiply(x, c1, out=x)  # the second permutation
                np.right_shift(x, np.uint32(15), out=t)
                np.bitwise_xor(x, t, out=x)
                np.multiply(x, c2, out=x)
                out[full, k] = np.minimum.reduceat(x, starts)
        a = b
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    n, size = sig.shape
    keys = np.zeros((n, size // rows), np.uint64)
    for k in range(rows):
        keys = keys * _ODD[0] + sig[:, k::rows][:, : size // rows].astype(np.uint64) + np.uint64(k + 1)
    return _mix(keys ^ (np.arange(size // rows, dtype=np.uint64) * _ODD[2])[None, :])


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, exactly."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
