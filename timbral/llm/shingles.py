"""Word shingles of a text as 64-bit fingerprints, by whole-array arithmetic on its bytes."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240601)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_FACTORS = [np.uint64(x) for x in _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)]
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """_BASE to the powers 0 to n - 1, modulo 2 to the 64."""
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * np.uint64(pow(_BASE, len(_powers), 1 << 64))])
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """One fingerprint a word ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    at = np.flatnonzero(~_SPACE[data])
    if not len(at):
        return np.empty(0, np.uint64)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    lengths = np.diff(first, append=len(at))
    place = np.arange(len(at)) - np.repeat(first, lengths)
    return mix(np.add.reduceat(_VALUE[data[at]] * powers(int(lengths.max()))[place], first))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct fingerprints of the shingles; fewer words than size are one shingle; no word, none."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(size, len(words))
    total = words[: len(words) - width + 1] * _FACTORS[0]
    for i in range(1, width):
        total = total + words[i : len(words) - width + 1 + i] * _FACTORS[i]
    return np.unique(mix(total + np.uint64(width)))


def in_common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
