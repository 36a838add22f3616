"""Word cutting and 64-bit hashing over the bytes of many texts at once (numpy)."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240517)
#: Random value of byte b at place p (mod 64) of a word, and a factor for every 64 places.
_PLACE = _RNG.integers(0, 1 << 63, 256 * 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK = _RNG.integers(0, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK[0] = 1
#: Odd multiplier of sequence hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser: every bit of the result depends on every bit of ``h``."""
    h = h + np.uint64((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def cut_words(data: np.ndarray, off: np.ndarray):
    """Words of the texts data[off[i]:off[i+1]]: (start byte, end byte, first word of each
    text, with the number of words at the end). Words never cross texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = off[:-1][off[:-1] < n]
    first[edges] = word[edges]
    starts = np.flatnonzero(first)
    gap = np.ones(n + 1, bool)  # a word ends before a space or the start of a text
    gap[:n] = ~word
    gap[edges] = True
    stops = np.flatnonzero(gap)
    ends = stops[np.searchsorted(stops, starts + 1)] if len(starts) else starts
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word: the sum of random values by byte and place, mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    total = np.cumsum(size)
    place = np.arange(total[-1]) - np.repeat(total - size, size)
    at = np.repeat(starts, size) + place
    value = _PLACE[data[at].astype(np.int64) * 64 + (place & 63)]
    if size.max() > 64:
        value *= _BLOCK[(place >> 6) & 1023]
    return mix(np.add.reduceat(value, total - size))


#: Powers up to this many elements are kept between calls.
_KEPT_POWERS = 1 << 20
_powers_kept: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2**64 for i from 0 to n."""
    if n > _KEPT_POWERS or not _powers_kept:
        size = max(n, _KEPT_POWERS) + 1
        up, down = np.full(size, BASE, np.uint64), np.full(size, BASE_INV, np.uint64)
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        if n > _KEPT_POWERS:
            return up, down
        _powers_kept[:] = [up, down]
    up, down = _powers_kept
    return up[:n + 1], down[:n + 1]


class RangeHash:
    """64-bit hashes of any ranges of a sequence of hashes, each in constant time (a
    polynomial with an odd base modulo 2**64, over elements mixed by ``seed``)."""

    def __init__(self, h: np.ndarray, seed: int):
        self.seed = seed
        up, self.down = _powers(len(h))
        self.total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum((mix(h, seed) if seed else h) * up[:-1], out=self.total[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.total[hi] - self.total[lo]) * self.down[lo], self.seed)

    def every(self, width: int) -> np.ndarray:
        """The hashes of all ranges of ``width`` elements."""
        last = max(0, len(self.total) - width)
        return mix((self.total[width:] - self.total[:last]) * self.down[:last], self.seed)
