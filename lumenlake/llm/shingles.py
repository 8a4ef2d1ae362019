"""Hashed word shingles and MinHash signatures, in NumPy inside tasks."""

from __future__ import annotations

from functools import cache

import numpy as np
import xxhash

_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes (uint64, ascending) of the shingles of words words in the whole text.

    A to Z are lower-cased; words are runs of what is no ASCII white space. A text with fewer
    words has its whole sequence as one shingle; without words the set is empty.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), dtype=np.uint64, count=len(parts))
    size = min(words, len(parts))
    out = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        out = out * _STEP + _mixed(h[i : len(h) - size + 1 + i] + np.uint64(i))
    return np.unique(_mixed(out))


@cache
def _coefficients(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**64, n, dtype=np.uint64)


def signature(hashes: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """n coordinates (uint32): the least of each of n hash functions over the set, which isn't empty."""
    a, b = _coefficients(n, seed)
    out = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(hashes), 4096):
        np.minimum(out, (a[:, None] * hashes[None, k : k + 4096] + b[:, None]).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)
