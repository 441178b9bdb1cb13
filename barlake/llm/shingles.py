"""Hashed word shingles of a text; used inside tasks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

from barlake.llm.shared import Generations

CACHE_ENTRIES = 100_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _hashes() -> Generations:
    return Generations(xxhash.xxh3_64_intdigest, CACHE_ENTRIES)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words, A-Z lower-cased; bytes split at just the six space characters."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(_hashes().__getitem__, found), np.uint64, len(found))


def rolled(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, by position."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, size):
        out *= _STEP
        out += words[k:k + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def shingle_set(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct shingles; fewer words than ``size`` are one shingle, no words none."""
    if 0 < len(words) < size:
        return rolled(words, len(words)) ^ np.uint64(len(words))
    return np.unique(rolled(words, size))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0
