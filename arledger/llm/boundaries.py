"""A sorted set of text positions in containers, with rank selection.

Positions are split into a high part, which names a container, and 16 low bits, which the
container holds in the smallest of three forms:

* array: the sorted low parts;
* bitmap: one bit per low part, with the bits before each 64-bit word added up;
* runs: first value of each run of consecutive values, with the values before each run added up.

``select(k)`` finds the container by the cardinalities added up over containers, and then the
value inside it; no form is expanded.
"""

from __future__ import annotations

import numpy as np

#: Low parts per container, and 64-bit words of a bitmap.
SPAN = 1 << 16
WORDS = SPAN // 64


class ArrayContainer:
    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])

    @staticmethod
    def size(low: np.ndarray, runs: int) -> int:
        return 2 * len(low)


class BitmapContainer:
    def __init__(self, low: np.ndarray):
        bits = np.zeros(SPAN, dtype=bool)
        bits[low] = True
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(bits.reshape(WORDS, 64).sum(axis=1))])

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, side="right")) - 1
        left, rest = int(self.words[word]), k - int(self.before[word])
        for _ in range(rest):
            left &= left - 1  # clears the lowest bit
        return 64 * word + (left & -left).bit_length() - 1

    @staticmethod
    def size(low: np.ndarray, runs: int) -> int:
        return 8 * WORDS


class RunContainer:
    def __init__(self, low: np.ndarray):
        first = np.flatnonzero(np.diff(low, prepend=-2) > 1)
        self.first = low[first].astype(np.uint16)
        self.before = first

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.first[run]) + k - int(self.before[run])

    @staticmethod
    def size(low: np.ndarray, runs: int) -> int:
        return 4 * runs + 2


FORMS = (ArrayContainer, BitmapContainer, RunContainer)


class BoundarySet:
    """Positions in rising order, without repeats."""

    def __init__(self, positions: np.ndarray):
        high = positions >> 16
        cut = np.flatnonzero(np.diff(high)) + 1
        starts = np.concatenate([[0], cut, [len(positions)]]) if len(positions) else np.zeros(1, int)
        self.keys = high[starts[:-1]]
        self.before = starts
        self.containers = [
            self._container(positions[a:b] & (SPAN - 1)) for a, b in zip(starts[:-1], starts[1:])
        ]

    @staticmethod
    def _container(low: np.ndarray):
        runs = 1 + int((np.diff(low) > 1).sum())
        return min(FORMS, key=lambda form: form.size(low, runs))(low)

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The value that has k smaller ones."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return (int(self.keys[at]) << 16) + self.containers[at].select(k - int(self.before[at]))
