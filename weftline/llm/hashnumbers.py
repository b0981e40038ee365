"""Numbers for 64-bit hashes: an open-addressing table worked on with whole arrays."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from .wordhash import Words


class HashNumbers:
    """Gives each distinct hash a number, in order of first sight. ``most`` bounds the memory: 12 bytes a slot."""

    def __init__(self, most: int = 1 << 20):
        bits = max(12, int(2 * most - 1).bit_length())
        self.most, self.shift = most, np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.int32)
        self.n = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The numbers of hashes, -1 for unknown ones. The hash 0 counts as 1."""
        h = np.where(h == 0, np.uint64(1), h)
        out = np.full(len(h), -1, np.int64)
        slot = (h >> self.shift).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            key = self.keys[slot]
            hit = key == h
            out[left[hit]] = self.values[slot[hit]]
            go = ~hit & (key != 0)
            left, h, slot = left[go], h[go], (slot[go] + 1) & self.mask
        return out

    def add(self, h: np.ndarray) -> None:
        """Takes distinct unknown hashes; they get the next numbers in their order."""
        h = np.where(h == 0, np.uint64(1), h)
        value = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.n += len(h)
        slot = (h >> self.shift).astype(np.int64)
        while len(h):
            free = self.keys[slot] == 0
            first = np.zeros(len(h), dtype=bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.values[slot[put]] = h[put], value[put]
            go = ~put
            # those that met another hash move on; those that lost a free slot look at it again
            slot = np.where(free, slot, (slot + 1) & self.mask)[go]
            h, value = h[go], value[go]


class WordRows:
    """Rows of values for distinct words, found once: ``values(words)`` gives an array with a row for each word.

    Words are known by 64-bit hashes, so texts needn't become Python strings; at ``most`` words all are forgotten,
    which bounds the memory and changes no result. A chunk with more distinct words than that gets a larger table.
    """

    def __init__(self, values: Callable[[Sequence[str]], np.ndarray], most: int = 1 << 18):
        self.values, self.most = values, most
        self.table, self.rows = HashNumbers(most), values([""])[:0]

    def look_up(self, words: Words) -> np.ndarray:
        """The number of each word; ``rows`` holds their values until the next call."""
        h = words.hashes()
        at = self.table.find(h)
        new = np.flatnonzero(at < 0)
        if len(new):
            new = new[np.unique(h[new], return_index=True)[1]]
            if self.table.n + len(new) > self.table.most:
                new = np.unique(h, return_index=True)[1]
                self.table, self.rows = HashNumbers(max(self.most, 2 * len(new))), self.rows[:0]
            n = self.table.n
            if n + len(new) > len(self.rows):
                grown = np.zeros((max(n + len(new), min(2 * n, self.table.most)), *self.rows.shape[1:]), self.rows.dtype)
                grown[:n] = self.rows[:n]
                self.rows = grown
            for a in range(0, len(new), 8192):
                some = new[a : a + 8192]
                self.rows[n + a : n + a + len(some)] = self.values([words.data[x:y].tobytes().decode() for x, y in zip(words.start[some].tolist(), words.end[some].tolist(), strict=True)])
            self.table.add(h[new])
            at = self.table.find(h)
        return at


_KEPT: dict[str, WordRows] = {}


def kept_rows(key: str, make: Callable[[], WordRows]) -> WordRows:
    """The store of a model in this worker: later tasks use what earlier ones found. Only the last model's is kept."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]
