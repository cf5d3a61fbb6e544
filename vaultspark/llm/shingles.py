"""Word hashes, word n-grams and MinHash bands of one text, in numpy.

Words are maximal runs of digits, a-z and bytes of non-ASCII characters in the lower-cased UTF-8 text.
A text of one to n - 1 words has one n-gram, all its words; a text without words has none.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np

U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(12, n.bit_length())
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(size, b, U)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U)
    return _powers


def word_hashes(raw: bytes | memoryview) -> np.ndarray:
    """A 64-bit hash for each word, in order, from wrapped prefix sums: no Python object per word."""
    if not len(raw):
        return np.zeros(0, U)
    b = _LOWER[np.frombuffer(raw, np.uint8)]
    w = np.zeros(len(b) + 2, np.int8)
    w[1:-1] = _WORD[b]
    edge = np.flatnonzero(w[1:] != w[:-1])
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, U)
    up, down = _power(len(b) + 1)
    total = np.zeros(len(b) + 1, U)
    np.cumsum((b.astype(U) + U(1)) * up[: len(b)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct n-gram hashes, sorted."""
    if not len(words):
        return words
    n = min(n, len(words))
    m = len(words) - n + 1
    x = words[:m] + U(n)
    for k in range(1, n):
        x = mix(x * U(0xD6E8FEB86659FD93) + words[k : k + m])
    return np.unique(x)


def sequence_key(words: np.ndarray) -> bytes | None:
    """Equal for texts with the same words in the same order; None without words."""
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest() if len(words) else None


def choose_bands(threshold: float, recall: float, rows: int) -> int:
    """The least number of bands of so many rows with which a pair at the threshold shares a band with probability recall."""
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))))


def multipliers(count: int) -> np.ndarray:
    return mix(np.arange(1, count + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def bands(grams: np.ndarray, by: np.ndarray, rows: int) -> np.ndarray:
    """MinHash values combined over each band, salted by the band's number. by: multipliers, bands * rows of them."""
    if not len(grams):
        return np.zeros(0, np.int64)
    low = np.full(len(by), np.iinfo(U).max, U)
    for at in range(0, len(grams), 2048):
        np.minimum(low, np.multiply.outer(by, grams[at : at + 2048]).min(axis=1), out=low)
    low = low.reshape(-1, rows)
    x = mix(np.arange(1, len(low) + 1, dtype=U))
    for k in range(rows):
        x = mix(x * U(0xD6E8FEB86659FD93) + low[:, k])
    return x.view(np.int64)
