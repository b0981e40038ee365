"""Operator 6: bounded-space online packing of tokenised documents into fixed windows.

Each task keeps ``open_windows`` windows. Whole windows of a long document go out at once; the rest is placed in
the open window in which it fits best. When none fits and no more may be opened, the fullest is emitted, topped up
with the first ids of the document, since documents may be cut. Leftovers are merged at the end: first those of a
task, then, by groups of ``MERGE`` tasks, the one partial window that each task may leave; only these carry
their ids through the shuffle. A group's last ids go to sequences whose lengths are powers of two, which need no
padding.

Tokens. The tokenizer drops white space and never joins across it, so texts are cut at spaces and line ends, each
distinct part is encoded once a worker, and documents gather their ids. A text that holds the string of one of the
tokenizer's special tokens goes to the tokenizer whole, which gives that token's id there.

Recovery: a task's result depends on its rows in order, so packing reads a table (as the pipeline does) and not
the output of a shuffle; the first pass is checkpointed before the leftovers are read.

Edge cases: a null or empty text has only the end id; null ids are kept; rows of a repeated id are documents of
their own; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, freed, table
from .hashnumbers import HashNumbers
from .wordhash import chunks, split_words, word_table

WINDOW, OPEN_WINDOWS, END_ID, MERGE = 2048, 16, 1, 64
TOKENIZER = "word_bpe_49k.json"
#: Texts are cut at spaces and line ends; other white space stays in a part, for the tokenizer.
PARTS = word_table(" \n")
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[33:128] = True
_MARK[_LETTER] = False
_MARK[39] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _fewer_parts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ASCII letters in lower case, and cuts between an ASCII letter and an ASCII mark or digit.

    The tokenizer does both itself: only an apostrophe may join a mark to letters, and a letter before a non-ASCII
    byte may be composed with it, so these are left alone.
    """
    after = np.append(data[1:], np.uint8(0))
    low = np.where(after < 128, _LOWER[data], data)
    letter, mark = _LETTER[data], _MARK[data]
    cut = np.zeros(len(data), dtype=bool)
    cut[1:] = letter[:-1] & mark[1:] | mark[:-1] & letter[1:]
    return low, cut
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Ids of texts, from the ids of their distinct parts, which are known by 64-bit hashes.

    It lives as long as the worker, so later tasks find the parts of earlier ones; at ``most`` parts it forgets all.
    """

    def __init__(self, path: str, most: int = 1 << 19):
        self.tokenizer, self.most = _tokenizer(path), most
        self.special = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self._forget()

    def _forget(self):
        self.numbers = HashNumbers(self.most)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.n = self.used = 0

    def _learn(self, parts: list[str]):
        got = [e.ids for e in self.tokenizer.encode_batch(parts, add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(size.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(parts) > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        self.ids[self.used : self.used + len(flat)] = flat
        self.at[self.n : self.n + len(parts)] = self.used + np.cumsum(size) - size
        self.size[self.n : self.n + len(parts)] = size
        self.n += len(parts)
        self.used += len(flat)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, with the end id."""
        words = split_words(texts, PARTS, _fewer_parts)
        h = words.hashes()
        at = self.numbers.find(h)
        new = np.flatnonzero(at < 0)
        if len(new):
            new = new[np.unique(h[new], return_index=True)[1]]
            if self.n + len(new) > self.most and self.n:
                self._forget()
                new = np.unique(h, return_index=True)[1]
            if len(new) > self.numbers.most:  # a single text with more parts than the store is made for
                self.numbers = HashNumbers(2 * len(new))
            for a in range(0, len(new), 4096):
                some = new[a : a + 4096]
                self._learn([words.data[x:y].tobytes().decode() for x, y in zip(words.start[some].tolist(), words.end[some].tolist(), strict=True)])
            self.numbers.add(h[new])
            at = self.numbers.find(h)
        size = self.size[at]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.at[at] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        cut = np.concatenate([[0], ends])[words.first].tolist()
        out = [np.append(ids[a:b], np.uint32(END_ID)) for a, b in itertools.pairwise(cut)]
        if self.special:
            for i in np.flatnonzero(pc.match_substring_regex(texts, self.special).fill_null(False)):
                whole = self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids
                out[i] = np.array([*whole, END_ID], np.uint32)
        return out


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


class Piece:
    __slots__ = ("doc_id", "doc_tokens", "ids", "start")

    def __init__(self, doc_id, doc_tokens: int, start: int, ids: np.ndarray):
        self.doc_id, self.doc_tokens, self.start, self.ids = doc_id, doc_tokens, start, ids

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.doc_tokens, self.start, self.ids[:n]), Piece(self.doc_id, self.doc_tokens, self.start + n, self.ids[n:])


class Packer:
    """Places pieces; ``out`` gets the rows of emitted sequences."""

    def __init__(self, first_id: int, window: int = WINDOW, most: int = OPEN_WINDOWS):
        self.window, self.most, self.next = window, most, first_id
        self.open: list[tuple[int, list[Piece]]] = []  # ids so far, pieces
        self.out: list[tuple] = []

    def emit(self, pieces: list[Piece], *, keep_ids: bool = False):
        offset = 0
        for p in pieces:
            raw = np.ascontiguousarray(p.ids, dtype="<u4").tobytes()
            self.out.append((p.doc_id, p.start, len(p.ids), zlib.crc32(raw), p.doc_tokens, self.next, offset, raw if keep_ids else None))
            offset += len(p.ids)
        self.next += 1

    def add(self, piece: Piece):
        while len(piece.ids) >= self.window:
            whole, piece = piece.cut(self.window)
            self.emit([whole])
        n = len(piece.ids)
        while n:
            fit = max((i for i, (m, _) in enumerate(self.open) if m + n <= self.window), key=lambda i: self.open[i][0], default=-1)
            if fit >= 0:
                m, pieces = self.open[fit]
                pieces.append(piece)
                self.open[fit] = (m + n, pieces)
                if m + n == self.window:
                    self.emit(self.open.pop(fit)[1])
                return
            if len(self.open) < self.most:
                self.open.append((n, [piece]))
                return
            fullest = max(range(len(self.open)), key=lambda i: self.open[i][0])
            m, pieces = self.open.pop(fullest)
            head, piece = piece.cut(self.window - m)
            self.emit([*pieces, head])
            n = len(piece.ids)

    def merge(self) -> list[Piece]:
        """Fills windows from the open ones, fullest first; returns the pieces of the one that stays partial."""
        self.open.sort(key=lambda x: -x[0])
        rest: list[Piece] = []
        n = 0
        for _, pieces in self.open:
            for p in pieces:
                while n + len(p.ids) >= self.window:
                    head, p = p.cut(self.window - n)
                    self.emit([*rest, head])
                    rest, n = [], 0
                if len(p.ids):
                    rest.append(p)
                    n += len(p.ids)
        self.open = []
        return rest

    def powers(self, rest: list[Piece]):
        """Sequences whose lengths are powers of two, longest first."""
        left = sum(len(p.ids) for p in rest)
        while left:
            want = 1 << (left.bit_length() - 1)
            left -= want
            taken = []
            while want:
                p = rest.pop(0)
                if len(p.ids) > want:
                    head, tail = p.cut(want)
                    rest.insert(0, tail)
                    p = head
                taken.append(p)
                want -= len(p.ids)
            self.emit(taken)

    def rows(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) if self.out else [[] for _ in _NAMES]
        self.out = []
        return pa.record_batch([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(_NAMES, columns, strict=True)], _NAMES)


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if window < 1 or window & (window - 1):
        raise ValueError("a window must be a power of two")
    path = path or tokenizer_path()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = _encoder(path), Packer(TaskContext.get().partitionId() << 32, window, open_windows)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in chunks(texts):
                for doc_id, tokens in zip(ids[a:b], encoder.encode(texts.slice(a, b - a)), strict=True):
                    packer.add(Piece(doc_id, len(tokens), 0, tokens))
                if len(packer.out) > 4096:
                    yield packer.rows()
        rest = packer.merge()
        if rest:
            packer.emit(rest, keep_ids=True)
        yield packer.rows()

    def merge(rows: pa.Table) -> pa.Table:
        group = rows.column("g")[0].as_py()
        packer = Packer((1 << 60) + (group << 32), window, 1 << 62)
        found = sorted(rows.to_pylist(), key=lambda r: (r["sequence_id"], r["offset"]))
        for r in found:
            packer.open.append((r["length"], [Piece(r["doc_id"], r["doc_tokens"], r["start"], np.frombuffer(r["ids"], "<u4"))]))
        packer.open = [(0, [p for _, pieces in packer.open for p in pieces])]
        packer.powers(packer.merge())
        return pa.Table.from_batches([packer.rows()])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    placed = checkpointed(texts.mapInArrow(lambda b: freed(place(b)), _SCHEMA))
    # Task numbers are dense, so each group has MERGE partial windows at most, whatever the size of the table.
    partial = placed.where("ids IS NOT NULL").withColumn("g", F.floor(F.shiftright("sequence_id", 32) / MERGE).cast("long"))
    merged = partial.groupBy("g").applyInArrow(merge, _SCHEMA)
    return placed.where("ids IS NULL").unionByName(merged).drop("ids")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)
