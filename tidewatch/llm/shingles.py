"""Distinct word shingles of a text as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np

WIDTH = 5
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each word, A-Z lower-cased, in order: the sum of a mix of each byte and its place."""
    inside = ~_WHITE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    begins, ends = edges[::2], edges[1::2]
    if not len(begins):
        return np.zeros(0, np.uint64)
    place = np.arange(len(data)) - np.repeat(
        np.append(0, begins), np.diff(np.concatenate(([0], begins, [len(data)])))
    )
    terms = mix(_LOWER[data] + np.uint64(1) + place.astype(np.uint64) * _A)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms)))
    return mix(sums[ends] - sums[begins])


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted distinct hashes (int64) of the shingles: five words, or all of fewer; none of no words."""
    words = word_hashes(np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8))
    if not len(words):
        return np.zeros(0, np.int64)
    width = min(WIDTH, len(words))
    rolled = words[: len(words) - width + 1].copy()
    for i in range(1, width):
        rolled = rolled * _A + words[i : len(words) - width + 1 + i]
    return np.unique(mix(rolled + np.uint64(width)).view(np.int64))
