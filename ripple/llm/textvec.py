"""Hashed features of many texts at once, from the bytes of an Arrow column; no Python loop over texts or words."""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Classes of bytes: other, space, line end, lower, upper, digit, symbol, punctuation, of a longer character.
CLASS = np.zeros(256, np.int64)
CLASS[[9, 11, 12, 13, 32]], CLASS[10] = 1, 2
CLASS[97:123], CLASS[65:91], CLASS[48:58] = 3, 4, 5
CLASS[list(b"#*$%&|<>")], CLASS[list(b".,;:!?'\"()-")], CLASS[128:] = 6, 7, 8
CLASSES = 9


def powers(n: int, inverse: bool = False) -> np.ndarray:
    key = str(inverse)
    if key not in _powers or len(_powers[key]) < n:
        base = np.full(max(n, 1 << 16), _INVERSE if inverse else _P, np.uint64)
        base[0] = 1
        _powers[key] = np.cumprod(base)
    return _powers[key][:n]


def word_hashes(low: np.ndarray, off: np.ndarray):
    """(start, end, 64-bit hash, text's number) of each word; words do not cross texts."""
    n = len(low)
    inside = ~SPACE[low]
    first = np.zeros(n + 1, bool)
    first[off] = True  # a text begins here (the last entry: the end)
    begin = np.flatnonzero(inside & (np.r_[True, ~inside[:-1]] | first[:-1])) if n else np.zeros(0, np.int64)
    stop = np.flatnonzero(inside & (np.r_[~inside[1:], True] | first[1:])) + 1 if n else begin
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers(n), out=total[1:])
    h = (total[stop] - total[begin]) * powers(n + 1, True)[begin]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return begin, stop, h, np.searchsorted(off, begin, "right") - 1


def histogram(group: np.ndarray, value: np.ndarray, groups: int, bins: int) -> np.ndarray:
    return np.bincount(group * bins + value, minlength=groups * bins).reshape(groups, bins).astype(np.float32)


def chars_hashed(low: np.ndarray, off: np.ndarray, width: int, bins: int) -> np.ndarray:
    """For each byte the hash of it and the width - 1 bytes before it in its text, below ``bins`` (a power of two)."""
    h = low.astype(np.uint32) + np.uint32(1)
    out = h.copy()
    for k in range(1, width):
        before = np.zeros_like(h)
        before[k:] = h[:-k]
        for j in range(k):  # the first bytes of a text have none before them
            at = off[:-1] + j
            before[at[at < off[1:]]] = 0
        out = out * np.uint32(0x01000193) + before * np.uint32(2 * k + 7)
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    return (out >> np.uint32(12)).astype(np.int64) & (bins - 1)
