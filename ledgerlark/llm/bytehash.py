"""Hashes of byte ranges and of words over a whole batch of texts, by numpy.

With an odd base B, P[i] = sum of t(b_j) * B^j for j < i, modulo 2^64, gives the hash of any range [i, k) as
(P[k] - P[i]) * B^-i, wherever it stands. t is a fixed table of odd random numbers, one for each byte.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240131))
TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_RNG.integers(1, 2**62)) * 2 + 1
INVERSE = pow(BASE, -1, 2**64)
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(base: int, size: int) -> np.ndarray:
    return _powers(base, 1 << max(12, (size - 1).bit_length()))[:size]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads all bits; a bijection, so equal in means equal out and the other way round."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLE[data] * powers(BASE, len(data)), out=out[1:])
    return out


def ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(INVERSE, len(sums))[start] + (end - start).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without blanks) of the texts that ``offsets`` cuts ``data`` into, and each text's first
    word (one more entry than texts)."""
    ink = ~BLANK[data]
    before = np.r_[False, ink[:-1]]
    after = np.r_[ink[1:], False]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts] = False
    after[cuts - 1] = False
    start, end = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
    return ranges(prefix_sums(data), start, end), np.searchsorted(start, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words of each text, and each text's first one. A text of fewer words, but at least
    one, has a single shingle of all of them."""
    words, first = word_hashes(data, offsets)
    counts = np.diff(first)
    found = np.zeros(len(words), np.uint64)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(words)) - first[text]
    left = counts[text] - place  # words from here to the end of the text
    for k in range(width):
        word = np.zeros(len(words), np.uint64)
        word[: len(words) - k] = words[k:]
        word[left <= k] = 0
        found = mix(found + word * np.uint64(2 * k + 1))
    whole = (left >= width) | (place == 0)
    return found[whole], np.r_[0, np.cumsum(np.bincount(text[whole], minlength=len(counts)))].astype(np.int64)
