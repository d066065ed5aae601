"""Texts as numpy bytes: words and their hashes without a Python loop over words.

A word's hash is a polynomial over its bytes modulo 2**64, each byte replaced by a fixed 64-bit
value, so that hashes of all words of a batch come from one running sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
IS_LETTER = np.zeros(256, dtype=bool)
IS_LETTER[65:91] = IS_LETTER[97:123] = IS_LETTER[128:] = True


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    size = (1 << bits) + 1
    up = np.full(size, _BASE, dtype=np.uint64)
    down = np.full(size, _BASE_INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Rolling:
    """Hashes of any byte ranges of one array."""

    def __init__(self, data: np.ndarray):
        up, self._down = _powers(max(12, int(len(data)).bit_length()))
        self._sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=self._sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._down[start])

    def of_length(self, length: int) -> np.ndarray:
        """Hash of every range of ``length`` bytes."""
        n = len(self._sums) - length
        return mix((self._sums[length:] - self._sums[:n]) * self._down[:n])


@dataclass
class Chunk:
    """Some rows of a batch: row i holds ``data[offsets[i]:offsets[i + 1]]``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of true bytes; no run crosses rows."""
        padded = np.zeros(len(inside) + 2, dtype=bool)
        padded[1:-1] = inside
        starts = padded[1:] & ~padded[:-1]
        ends = padded[:-1] & ~padded[1:]
        edges = self.offsets[1:-1]
        cut = edges[(edges > 0) & (edges < len(inside))]
        cut = cut[inside[cut] & inside[cut - 1]]
        starts[cut] = ends[cut] = True
        return np.flatnonzero(starts), np.flatnonzero(ends)

    def rows_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, side="right") - 1


def chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[Chunk]:
    """A text column in runs of rows of about ``limit`` bytes; a longer text is a run of its
    own. Null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield Chunk(
            first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        )
        first = last
