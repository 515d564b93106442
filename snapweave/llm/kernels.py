"""Vectorised hashing of words, bytes and their windows over a batch of texts.

Hashes are 64-bit polynomial sums with random coefficients per byte, finished by a mixing step. Two different words,
windows or sets share one with a probability of about 2**-64 a pair.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_SEED = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _SEED.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: True for a byte of a word: white space parts words, or all ASCII that is no letter or digit.
BY_SPACE = np.ones(256, bool)
BY_SPACE[[0x20, *range(0x09, 0x0E)]] = False
BY_LETTER = np.zeros(256, bool)
BY_LETTER[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each at least."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _POWERS[i] = np.multiply.accumulate(factors)
    return _POWERS[0], _POWERS[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Sums:
    """Hashes of any stretch of a sequence from running sums."""

    def __init__(self, units: np.ndarray):
        up, self.down = _powers(len(units) + 1)
        self.sums = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * up[: len(units)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def windows(self, k: int) -> np.ndarray:
        """Of every k units in a row; none if there are fewer."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mixed((self.sums[k:] - self.sums[:n]) * self.down[:n])


def byte_units(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


class Words(NamedTuple):
    hash: np.ndarray  # of each word
    start: np.ndarray  # its first byte
    end: np.ndarray
    first: np.ndarray  # number of the first word of each text, and at last of all words


def words(data: np.ndarray, off: np.ndarray, inside: np.ndarray = BY_SPACE) -> Words:
    """The words of texts that lie one after another in data, off[i] to off[i + 1]."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(off), np.int64))
    word = inside[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    full = off[1:] > off[:-1]
    before[off[:-1][full]] = False
    after[off[1:][full] - 1] = False
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return Words(Sums(byte_units(data)).of(start, end), start, end, np.searchsorted(start, off))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if span < width else values


def window_starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of size units start that lie within one text, and the number of that text."""
    each = np.maximum(np.diff(first) - size + 1, 0)
    doc = np.repeat(np.arange(len(each)), each)
    return np.arange(len(doc)) + np.repeat(first[:-1] - np.r_[0, np.cumsum(each)[:-1]], each), doc


class Tiles(NamedTuple):
    doc: np.ndarray  # number of the text
    at: np.ndarray  # first window of the tile, in units from the start of the text
    n: np.ndarray  # windows in a row
    anchor: np.ndarray  # the least k-gram hash that all of them hold
    tile: np.ndarray  # hash of all units of the tile


def tiles(units: np.ndarray, first: np.ndarray, size: int, k: int) -> Tiles:
    """Cut every text's windows of size units into runs that share one place of their least k-gram hash, the leftmost.

    Equal windows have equal anchors, so all places of a window lie in tiles of one anchor; and as that place lies alike
    in equal windows, no two of a tile are equal.
    """
    start, doc = window_starts(first, size)
    if not len(start):
        none = np.zeros(0, np.int64)
        return Tiles(none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    sums = Sums(units)
    grams = sums.windows(k)
    key = sliding_min(grams, size - k + 1)[start]
    new = np.ones(len(key), bool)
    # a window that begins with its anchor is the last that has it at this place
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (grams[start[:-1]] == key[:-1])
    begin = np.flatnonzero(new)
    n = np.diff(np.r_[begin, len(key)])
    return Tiles(doc[begin], start[begin] - first[doc[begin]], n, key[begin], sums.of(start[begin], start[begin] + n + size - 1))


def unions(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches as a union of disjoint ones that don't touch."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return start[new], reach[np.r_[new[1:] - 1, len(reach) - 1]]
