"""Words of many texts at once, as numpy arrays over the texts' bytes.

A word is a longest run of bytes other than space and 0x09 to 0x0D; these bytes never occur inside
a longer UTF-8 sequence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from mapshelf.llm.common import raw_bytes

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.array([(x * 0xBF58476D1CE4E5B9 + 0x94D049BB133111EB) % 2**64 for x in range(256)], np.uint64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64. Those of a few MB of text are kept, more are made for one call."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    n = max(n, 1 << 20)
    found = tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)])) for b in (_BASE, _INVERSE))
    if n <= 5 << 19:
        _powers = found
    return found


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers under which close ones part."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """starts, ends: bytes of each word in ``data``; first: n + 1 numbers of the texts' first words; hash: of each word.

    ``between`` marks the bytes that stand between words.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, between: np.ndarray = _SPACE):
        data, offsets = raw_bytes(texts)
        if lower:
            data = _LOWER[data]
        self.data, self.offsets = data, offsets
        solid = ~between[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(data), bool)
        before[:1] = True
        before[1:] = ~solid[:-1]
        self.starts = np.flatnonzero(solid & (before | edge[:-1]))
        after = np.empty(len(data), bool)
        after[-1:] = True
        after[:-1] = ~solid[1:]
        self.ends = np.flatnonzero(solid & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        up, down = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
        length = (self.ends - self.starts).astype(np.uint64)
        self.hash = mix((total[self.ends] - total[self.starts]) * down[self.starts] + length * _STEP)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The number of the text that each word stands in."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def room(self) -> np.ndarray:
        """For each word, how many words its text has from there on."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The words with one space after each, and where each starts and ends there."""
        length = self.ends - self.starts
        ends = np.cumsum(length + 1) - 1
        starts = ends - length
        out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, np.uint8)
        at = np.repeat(self.starts - starts, length) + ranges(starts, length)
        out[at - np.repeat(self.starts - starts, length)] = self.data[at]
        return out.tobytes(), starts, ends


def ranges(starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``starts``."""
    base = np.cumsum(length) - length
    return np.arange(int(length.sum())) + np.repeat(starts - base, length)


def sequence_hash(words: np.ndarray, size: int, factor: np.uint64 = _STEP) -> np.ndarray:
    """Of each ``size`` consecutive words, a hash that depends on their order; empty if there are fewer."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * factor + words[j : j + n]
    return mix(out)


def leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """For each ``width`` consecutive values, the position of the first smallest."""
    best, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        span += step
    return best
