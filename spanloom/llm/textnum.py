"""Vectorised words, word hashes and shingles over the bytes of many texts at once.

Hashes have 64 bits: among 5 million different words the chance that any two share one is about 1 in a million.
"""

from __future__ import annotations

import numpy as np

_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_INV = pow(_BASE, -1, 1 << 64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def byte_values(seed: int = 7) -> np.ndarray:
    """A random uint64 per byte value."""
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


_VALUES = byte_values()
FOLDED_VALUES = _VALUES[_FOLD]
#: Bytes of words [0-9A-Za-z\x80-], and those that are not ASCII white space.
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
NOT_SPACE = np.array([b not in (32, 9, 10, 11, 12, 13) for b in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Powers:
    """Powers of the hash base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n + n // 4, 1 << 19)
            for name, base in (("up", _BASE), ("down", _INV)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


def word_bounds(flat: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per text) of the maximal runs of member bytes; none crosses a text's end."""
    inside = member[flat]
    first, last = inside.copy(), inside.copy()
    if len(flat):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(flat))]
        first[edges] |= inside[edges]
        last[edges - 1] |= inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def span_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray, powers: Powers) -> np.ndarray:
    """uint64 hash of each byte span; equal strings (under ``values``) get equal hashes."""
    up, down = powers.to(len(flat) + 1)
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(values[flat] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MUL)


def windows(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(uint64 hash of every k consecutive words of a text, windows per text)."""
    n = len(hashes) - k + 1
    per_text = np.maximum(counts - k + 1, 0)
    if n <= 0:
        return np.zeros(0, np.uint64), per_text
    multipliers = np.random.default_rng(k).integers(1, 1 << 63, k, dtype=np.uint64) | np.uint64(1)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += hashes[j : j + n] * multipliers[j]
    begins = np.cumsum(counts) - counts
    valid = np.zeros(n + 1, np.int64)
    has = per_text > 0
    np.add.at(valid, begins[has], 1)
    np.add.at(valid, (begins + per_text)[has], -1)
    return mix(total[np.cumsum(valid[:n]) > 0]), per_text


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values, from the running least of blocks in both directions."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
