"""Vectorised words of UTF-8 text columns: boundaries, 64-bit word hashes and k-gram hashes.

Everything works on the bytes of an Arrow string column without making Python strings, so one batch costs a
few numpy passes. Separators are ASCII in every word definition used here, so bytes are enough.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
#: Words longer than this are hashed one at a time.
_LONG = 512
#: Bytes of text handled at once; a longer text forms a chunk of its own.
CHUNK_BYTES = 1 << 20


def word_table(separators: str | None = None, *, alnum: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(is_word[256], mapped[256]). ``alnum``: words are runs of 0-9, a-z and non-ASCII, A-Z lower-cased."""
    mapped = np.arange(256, dtype=np.uint8)
    if alnum:
        mapped[65:91] += 32
        is_word = np.zeros(256, dtype=bool)
        is_word[48:58] = is_word[97:123] = is_word[65:91] = is_word[128:] = True
    else:
        is_word = np.ones(256, dtype=bool)
        is_word[[ord(c) for c in (separators or " \t\n\x0b\x0c\r")]] = False
    return is_word, mapped


WHITESPACE_WORDS = word_table()
ALNUM_WORDS = word_table(alnum=True)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _K2
    x = (x ^ (x >> np.uint64(27))) * _K3
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty. Offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if not len(column) or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    o = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a column whose texts hold about ``most`` bytes together."""
    _, offs = text_bytes(column)
    a = 0
    while a < len(offs) - 1:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, side="right")) - 1)
        yield a, b
        a = b


@dataclass
class Words:
    """Words of some documents, one after the other. ``first[d]:first[d + 1]`` are those of document d."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    doc: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def pos(self) -> np.ndarray:
        """Position of each word in its document."""
        return np.arange(len(self.start)) - self.first[self.doc]

    def hashes(self) -> np.ndarray:
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        at8 = np.ndarray(shape=(len(self.data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
        length = self.end - self.start
        h = length.astype(np.uint64) * _K1 + _K3
        live, k = None, 0
        while True:
            s = self.start if live is None else self.start[live]
            n = length if live is None else length[live]
            v = at8[s + k] & _MASKS[np.clip(n - k, 0, 8)]
            if live is None:
                h = mix((h ^ v) * _K1)
            else:
                h[live] = mix((h[live] ^ v) * _K1)
            k += 8
            more = n > k
            if k >= _LONG or not more.any():
                break
            live = np.flatnonzero(more) if live is None else live[more]
        for i in np.flatnonzero(length > _LONG):
            h[i] = np.uint64(xxhash.xxh64_intdigest(self.data[self.start[i] : self.end[i]].tobytes()))
        return h


def split_words(column: pa.Array, table: tuple[np.ndarray, np.ndarray], parted: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None) -> Words:
    """``parted`` may map the bytes again and say before which of them a word ends, though no separator stands there."""
    is_word, mapped = table
    raw, offs = text_bytes(column)
    data = mapped[raw]
    inside = is_word[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offs] = True
    if parted is not None:
        data, at = parted(data)
        edge[:-1] |= at
    before = np.zeros(len(raw), dtype=bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(raw), dtype=bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(start, offs)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    return Words(data, start, end, first, doc)


def kgram(h: np.ndarray, k: int, multiplier: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hashes of all k consecutive items, by doubling; len(h) - k + 1 values, whatever the document."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, size = None, 0, h, 1
    m = np.uint64(multiplier | 1)
    step = m
    with np.errstate(over="ignore"):
        while True:
            if k & size:
                piece = power[done : done + n]
                out = piece.copy() if out is None else out * step + piece
                done += size
            if done == k:
                return mix(out)
            power = power[:-size] * step + power[size:]
            step = step * step
            size *= 2


def starts_of(words: Words, k: int) -> np.ndarray:
    """Indexes of the words at which a window of k words of one document starts."""
    return np.flatnonzero(words.pos + k <= words.counts[words.doc])


def covered(n: int, starts: np.ndarray, k: int) -> np.ndarray:
    """Which of n words lie in a window of k words that starts at one of ``starts``."""
    d = np.zeros(n + 1, dtype=np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + k, n), -1)
    return np.cumsum(d[:-1]) > 0


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
