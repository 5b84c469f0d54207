"""Vectorised 64-bit hashes of words and windows over whole texts (numpy).

A polynomial over random byte values, taken from prefix sums modulo 2**64, and
a final mixing step.  The tables come from a fixed seed, so every task and
every retry computes the same hashes.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUES = _RANDOM.integers(1, 1 << 64, 256, np.uint64) | np.uint64(1)
#: an odd base, and its inverse modulo 2**64
BASE = 0x9E3779B97F4A7C15 | 3
INVERSE = pow(BASE, -1, 1 << 64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(b" \t\n\r\x0b\x0c")] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the table grows as needed."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = 1 << max(16, (n - 1).bit_length())
        known = np.full(size, base, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        _powers[base] = known
    return known[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """C with C[j] - C[i] = sum of values[k] * BASE**k for i <= k < j."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def spans_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values from start to end, for prefix sums of them."""
    return mix((sums[end] - sums[start]) * powers(INVERSE, len(sums))[start] + (end - start).astype(np.uint64))


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words of a byte array."""
    inner = np.zeros(len(raw) + 2, np.int8)
    inner[1:-1] = ~IS_SPACE[raw]
    edge = np.diff(inner)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hash of every word of a text, in order."""
    raw = np.frombuffer(text, np.uint8)
    start, end = word_spans(raw)
    return spans_hash(prefix_sums(BYTE_VALUES[raw]), start, end)


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = prefix_sums(values)
    return mix((sums[width:] - sums[:-width]) * powers(INVERSE, n))


def shingles(text: bytes, width: int) -> np.ndarray:
    """Distinct hashes, sorted, of the runs of ``width`` words; with fewer words of all of them."""
    words = word_hashes(text)
    if not len(words):
        return words
    return np.unique(window_hashes(words, min(width, len(words))))


def joined_word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after the other, and the number of words of each."""
    raw = np.frombuffer(b" ".join(texts), np.uint8)
    start, end = word_spans(raw)
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(start, ends)
    return spans_hash(prefix_sums(BYTE_VALUES[raw]), start, end), np.diff(upto, prepend=0)
