"""Words, lines and shingles of many texts at once, from the bytes of an Arrow string column, in numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is a run of such characters. Hashes have 64 bits:
a polynomial of random 64-bit values of the bytes over the ring of 64-bit integers, then mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_random = np.random.Generator(np.random.PCG64(20240131))
_BASE = int(_random.integers(1, 2**63, dtype=np.uint64)) * 8 + 5 & (2**64 - 1)
_INVERSE = pow(_BASE, -1, 2**64)
_EXACT = _random.integers(0, 2**64, 256, dtype=np.uint64)
_FOLDED = _EXACT.copy()
_FOLDED[65:91] = _EXACT[97:123]
_SECOND = _random.integers(0, 2**64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), kept while no longer one is asked for."""
    if base not in _powers or len(_powers[base]) < n:
        size = max(n, 1 << 20)
        out, have = np.ones(size, U), 1
        while have < size:
            more = min(have, size - have)
            out[have : have + more] = out[:more] * U(pow(base, have, 2**64))
            have += more
        _powers[base] = out
    return _powers[base][:n]


class Texts:
    """Byte positions of the words of each text; a null counts as an empty text."""

    def __init__(self, column: pa.Array):
        if pa.types.is_large_string(column.type):
            column = column.cast(pa.string())
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
        data = column.buffers()[2] if len(column) else None
        self.data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        if column.null_count:  # the bytes under a null are not defined, though in practice there are none
            filled = column.fill_null("")
            self.__init__(pa.concat_arrays([filled]))
            return
        self.offsets = (offsets - offsets[0]).astype(np.int64)
        self.n = len(column)
        inside = ~_SPACE[self.data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        if len(self.data):
            at = self.offsets[:-1][self.offsets[:-1] < len(self.data)]
            first[at] = inside[at]
            at = at[at > 0] - 1
            last[at] = inside[at]
        self.inside = inside
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        #: The words of text i are first_word[i] .. first_word[i + 1] - 1.
        self.first_word = np.searchsorted(self.starts, self.offsets)
        self.n_words = np.diff(self.first_word)
        self.text_of = np.repeat(np.arange(self.n), self.n_words)
        self._sums: dict[int, np.ndarray] = {}

    def spans(self, starts: np.ndarray, ends: np.ndarray, fold: bool = False, second: bool = False) -> np.ndarray:
        """A hash of the bytes of each span; fold: A-Z count as a-z; second: another hash of the exact bytes."""
        values = _SECOND if second else _FOLDED if fold else _EXACT
        if id(values) not in self._sums:
            sums = np.zeros(len(self.data) + 1, U)
            np.cumsum(values[self.data] * _power(_BASE, len(self.data)), out=sums[1:])
            self._sums[id(values)] = sums
        sums = self._sums[id(values)]
        out = (sums[ends] - sums[starts]) * _power(_INVERSE, len(self.data) + 1)[starts]
        return mix(out + (ends - starts).astype(U))

    def words(self, fold: bool = False) -> np.ndarray:
        return self.spans(self.starts, self.ends, fold)

    def windows(self, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of k words inside one text, and the index of each one's first word."""
        if len(words) < k:
            return np.zeros(0, U), np.zeros(0, np.int64)
        at = np.flatnonzero(self.text_of[: len(words) - k + 1] == self.text_of[k - 1 :])
        return roll(words, k)[at], at


def roll(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k neighbours."""
    n = len(words) - k + 1
    out = np.zeros(n, U)
    for j in range(k):
        out = out * U(0x9E3779B97F4A7C15) + words[j : j + n]
    return mix(out)


def distinct(group: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (group, value) rows, in order."""
    order = np.lexsort((values, group))
    group, values = group[order], values[order]
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | (values[1:] != values[:-1])
    return group[new], values[new]
