"""Words of whole texts as arrays: boundaries, 64-bit hashes and hashes of runs of words."""

from __future__ import annotations

import numpy as np

_BLOCK = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_RUN = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, _BLOCK), _powers(_INVERSE, _BLOCK)


def bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE):
    """Start and end byte of each word, and the first word of each row (with the total last)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~space[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, worked in blocks of bounded size."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + _BLOCK, "right")))
        size = int(ends[j - 1] - low)
        up, down = (_UP, _DOWN) if size <= _BLOCK else (_powers(_BASE, size), _powers(_INVERSE, size))
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE[data[low:low + size]] * up[:size], out=sums[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)
        i = j
    return mix(out)


def runs(words: np.ndarray, first: np.ndarray, length: int):
    """Hash of each run of ``length`` words inside one row: the runs' first words and their hashes."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = words[:n].copy()
    for k in range(1, length):
        total *= _RUN
        total += words[k:k + n]
    at = np.arange(n)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    keep = at + length <= first[row + 1]
    return at[keep], mix(total[keep])
