"""Row numbers for words, looked up many at a time without a Python object for each."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Odd multipliers of the two hashes that a word is known by.
_M1, _M2, _SPREAD = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


#: Byte values for the hashes: of texts cut at spaces, and of texts cut at any ASCII white space.
BY_SPACES, BY_WHITE_SPACE = (np.where(gap, 0, np.arange(1, 257)).astype(np.uint64) for gap in (np.arange(256) == 32, _SPACE))


def _powers(multiplier: int, count: int) -> np.ndarray:
    out = np.full(count, multiplier, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def spans(data: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't separators."""
    edge = np.flatnonzero(np.diff(separator.view(np.int8), prepend=np.int8(1), append=np.int8(1)))
    return edge[::2], edge[1::2]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of anything but ASCII white space."""
    return spans(data, _SPACE[data])


_holding: list[tuple[str, Callable[[], None]]] = []


def give_back() -> None:
    """Free memory goes back to the system: what C libraries keep of it counts against an executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def only_here(name: str, clear: Callable[[], None]) -> None:
    """At the begin of a task: a worker process keeps what one operator remembers; another's is cleared when this one begins."""
    if _holding and _holding[0][0] != name:
        _holding.pop()[1]()
        gc.collect()
    give_back()
    if not _holding:
        _holding.append((name, clear))


class WordIndex:
    """An open-addressing table from two 64-bit hashes to a row number.

    A word of ``most`` or more distinct ones makes the table start anew; then ``generation`` goes up and row numbers
    begin at 0 again.
    """

    def __init__(self, most: int):
        self.most, self.bits = most, max(4, (2 * most).bit_length())
        self.generation = -1
        self.clear()

    def clear(self) -> None:
        size = 1 << self.bits
        self.one, self.two, self.row = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        self.count, self.generation = 0, self.generation + 1

    def hashes(self, data: np.ndarray, starts: np.ndarray, weights: np.ndarray, variant: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Two polynomial hashes of each word. ``weights``: a value for each byte, 0 for separators; words end at these.

        Words of another ``variant`` count as other words.
        """
        if not len(starts):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        first = int(starts[0])
        sizes = np.diff(starts, append=len(data))
        at = np.arange(first, len(data), dtype=np.int32) - np.repeat(starts.astype(np.int32), sizes)
        values, begins, longest = weights[data[first:]], starts - first, int(sizes.max())
        with np.errstate(over="ignore"):
            one = np.add.reduceat(values * _powers(_M1, longest)[at], begins)
            two = np.add.reduceat(values * _powers(_M2, longest)[at], begins)
            if variant is not None:
                one ^= variant.astype(np.uint64) * np.uint64(_SPREAD)
        return one, two

    def _slot(self, one: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((one ^ (one >> np.uint64(32))) * np.uint64(_SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Row numbers, -1 where a word is new."""
        out, slot, mask = np.full(len(one), -1, np.int32), self._slot(one), (1 << self.bits) - 1
        at = self.row[slot]
        hit = (self.one[slot] == one) & (self.two[slot] == two) & (at >= 0)
        out[hit] = at[hit]
        todo = np.flatnonzero(~hit & (at >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            s = slot[todo]
            at = self.row[s]
            hit = (self.one[s] == one[todo]) & (self.two[s] == two[todo]) & (at >= 0)
            out[todo[hit]] = at[hit]
            todo = todo[~hit & (at >= 0)]
        return out

    def _put(self, one: np.ndarray, two: np.ndarray) -> None:
        """Distinct new words get the next row numbers, in order."""
        rows = np.arange(self.count, self.count + len(one), dtype=np.int32)
        slot, mask, todo = self._slot(one), (1 << self.bits) - 1, np.arange(len(one))
        while len(todo):
            free = self.row[slot[todo]] < 0
            able = todo[free]
            _, first = np.unique(slot[able], return_index=True)
            won = able[first]
            self.one[slot[won]], self.two[slot[won]], self.row[slot[won]] = one[won], two[won], rows[won]
            lost = np.ones(len(one), bool)
            lost[won] = False
            todo = todo[lost[todo]]
            slot[todo] = (slot[todo] + 1) & mask
        self.count += len(one)

    def rows(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of all words, and for each new row, in order, the place of one word that has it.

        If the new words don't fit, the table starts anew with these words alone.
        """
        found = self.find(one, two)
        new = np.flatnonzero(found < 0)
        if not len(new):
            return found, new
        _, first = np.unique(one[new], return_index=True)
        places = new[np.sort(first)]
        if self.count + len(places) > self.most and self.count:
            self.clear()
            return self.rows(one, two)
        if self.count + len(places) > self.most:  # one batch has more words than fit
            self.bits = max(self.bits, (2 * len(places)).bit_length())
            self.clear()
        self._put(one[places], two[places])
        found[new] = self.find(one[new], two[new])
        if (found < 0).any():  # two words with one first hash: tell them apart by both
            rest = np.flatnonzero(found < 0)
            _, first = np.unique(two[rest], return_index=True)
            more = rest[np.sort(first)]
            self._put(one[more], two[more])
            found[rest] = self.find(one[rest], two[rest])
            places = np.concatenate((places, more))
        return found, places


class Rows:
    """An array whose rows follow a WordIndex, with room for ``most`` rows (memory is taken as it fills); beyond, it grows by doubling."""

    def __init__(self, dtype, width: tuple[int, ...] = (), most: int = 1024):
        self.data, self.size = np.zeros((most, *width), dtype), 0

    def extend(self, more: np.ndarray) -> None:
        need = self.size + len(more)
        if need > len(self.data):
            grown = np.zeros((max(need, 2 * len(self.data)), *self.data.shape[1:]), self.data.dtype)
            grown[: self.size] = self.data[: self.size]
            self.data = grown
        self.data[self.size : need] = more
        self.size = need
