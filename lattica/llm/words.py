"""Words and word shingles as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

A = np.uint64(0x9E3779B97F4A7C15)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def lower_words(text: str) -> list[bytes]:
    """Runs other than ASCII white space, with A-Z in lower case."""
    return text.encode().lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles; with fewer words, of the whole sequence; none without words."""
    words = lower_words(text or "")
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    width = min(n, len(h))
    last = len(h) - width + 1
    found = h[:last].copy()
    for i in range(1, width):
        found = found * A + h[i : last + i]
    return np.unique(mix(found + np.uint64(n - width)))
