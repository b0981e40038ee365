"""Operator 2: benchmark decontamination by winnowing.

A window is ``window`` consecutive words of an item (an item of fewer words is one window). Of every document
and item the k-gram hashes are winnowed: of ``window - k + 1`` consecutive k-grams the least is kept, so two texts
that share a window keep a common fingerprint in it. A document's fingerprints are looked up among the
benchmark's; a hit is extended to the windows around it, and each window is compared word by word.

Plan. A benchmark of at most ``broadcast_chars`` characters is one broadcast of a few bytes a character, and one pass
over the documents, without a shuffle. A larger one is dealt to blocks of that size (long items in segments that
overlap by a window): each block is broadcast, scanned and destroyed before the next, so neither the driver nor a
worker ever holds more than one; a pass leaves a bit a word of the documents that it hit, and these are joined to the
documents by id and digest. Hashes only propose; words decide.

Edge cases: null or word-free texts have no words; items without words match nothing; repeated items count once
for each distinct item id; a null item id marks words but can't be listed; repeated documents each get a row.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import checkpointed, freed, fresh, table
from .wordhash import ALNUM_WORDS, Words, chunks, covered, kgram, split_words

WINDOW, K = 10, 5
#: Characters of the benchmark that one broadcast may hold, and words of the longest segment of an item.
BROADCAST_CHARS, SEGMENT = 1 << 23, 1 << 16


def winnow(keys: np.ndarray, w: int) -> np.ndarray:
    """Indexes of the least key (the rightmost, of equal ones) of each w consecutive keys."""
    n = len(keys) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = keys[:n].copy()
    at = np.arange(n)
    for j in range(1, w):
        less = keys[j : n + j] <= low
        low[less] = keys[j : n + j][less]
        at[less] = np.flatnonzero(less) + j
    return np.unique(at)


@dataclass
class Windows:
    """Windows of one size in order of their keys: where their texts stand in the block's bytes, and whose they are."""

    keys: np.ndarray
    start: np.ndarray
    end: np.ndarray
    item: np.ndarray


@dataclass
class Block:
    """Fingerprints and windows of some items, as arrays that go to the executors."""

    window: int
    k: int
    prints: np.ndarray  # sorted fingerprints of windows of full length
    ids: list[str | None]
    data: bytes  # the items' words, joined by one space
    by_size: dict[int, Windows]


def make_block(items: list[tuple[str | None, str | None]], window: int = WINDOW, k: int = K) -> Block:
    words = split_words(pa.array([t for _, t in items], pa.string()), ALNUM_WORDS)
    h = words.hashes()
    grams, counts = kgram(h, k), words.counts
    prints, sizes = [], {}
    data = b" ".join(words.data[a:b].tobytes() for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True))
    begin = np.concatenate([[0], np.cumsum(words.end - words.start + 1)])  # of each word in data
    for d in np.flatnonzero(counts >= window):
        g = grams[words.first[d] : words.first[d + 1] - k + 1]
        prints.append(g[winnow(g, window - k + 1)])
    for size in sorted({min(int(n), window) for n in counts if n}):
        own = counts >= window if size == window else counts == size
        at = np.flatnonzero(own[words.doc] & (words.pos + size <= counts[words.doc]))
        keys = kgram(h, size)[at]
        order = np.lexsort((words.doc[at], keys))
        at, keys = at[order], keys[order]
        sizes[size] = Windows(keys, begin[at], begin[at + size] - 1, words.doc[at].astype(np.int32))
    return Block(window, k, np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64), [i for i, _ in items], data, sizes)


def _hits(words: Words, h: np.ndarray, block: Block) -> Iterator[tuple[int, int, set[str]]]:
    """(first word, size, items) of the windows of a block that occur in the texts."""
    counts, pos = words.counts[words.doc], words.pos
    for size, known in block.by_size.items():
        if size == block.window:
            span = block.window - block.k + 1
            grams = kgram(h, block.k)
            at = winnow(grams, span)  # windows across documents only add fingerprints
            if not len(at):
                continue
            i = np.minimum(np.searchsorted(block.prints, grams[at]), len(block.prints) - 1)
            at = at[block.prints[i] == grams[at]]
            if not len(at):
                continue
            starts = np.unique((at[:, None] - np.arange(span)[None, :]).ravel())
            starts = starts[(starts >= 0) & (starts <= len(h) - size)]
            starts = starts[pos[starts] + size <= counts[starts]]
            keys = kgram(h, size)[starts]
        else:
            keys = kgram(h, size)
            if not len(keys):
                continue
            starts = np.flatnonzero(pos[: len(keys)] + size <= counts[: len(keys)])
            keys = keys[starts]
        low, high = np.searchsorted(known.keys, keys), np.searchsorted(known.keys, keys, side="right")
        for j in np.flatnonzero(high > low).tolist():
            a = int(starts[j])
            text = b" ".join(words.data[words.start[i] : words.end[i]].tobytes() for i in range(a, a + size))
            same = {block.ids[known.item[i]] for i in range(int(low[j]), int(high[j])) if block.data[known.start[i] : known.end[i]] == text}
            if same:
                yield a, size, same


def _scan(words: Words, blocks: list[Block]) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Which words are hit, and the items of each text."""
    h = words.hashes()
    starts: dict[int, set[int]] = {}
    items: dict[int, set[str]] = {}
    for block in blocks:
        for at, size, ids in _hits(words, h, block):
            starts.setdefault(size, set()).add(at)
            items.setdefault(int(words.doc[at]), set()).update(x for x in ids if x is not None)
    hit = np.zeros(len(h), dtype=bool)
    for size, at in starts.items():
        hit |= covered(len(h), np.array(sorted(at)), size)
    return hit, items


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    return rows.where("t IS NOT NULL AND t <> ''")


def _segments(items: DataFrame, window: int, segment: int) -> DataFrame:
    """(i, t) of pieces of at most ``segment`` words, which overlap so that each window of an item is in one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                words = split_words(batch.column(1).slice(a, b - a), ALNUM_WORDS)
                ids, texts = [], []
                for d, i in enumerate(batch.column(0).slice(a, b - a).to_pylist()):
                    x, y = int(words.first[d]), int(words.first[d + 1])
                    for at in range(x, max(y - window, x) + 1, segment):
                        to = min(at + segment + window - 1, y)
                        if to > at:
                            ids.append(i)
                            texts.append(words.data[words.start[at] : words.end[to - 1]].tobytes().decode())
                yield pa.record_batch([pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["i", "t"])

    return items.mapInArrow(cut, "i string, t string")


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, k: int, broadcast_chars: int) -> Iterator[Block]:
    """Blocks of the benchmark, none much larger than ``broadcast_chars``: one if it is that small."""
    items = _items(benchmark, id_col, text_col)
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    if total <= broadcast_chars:
        yield make_block([(r.i, r.t) for r in items.collect()], window, k)
        return
    n = -(-2 * total // broadcast_chars)
    parts = _segments(items, window, max(1, min(SEGMENT, broadcast_chars // 64))).dropDuplicates()
    dealt = checkpointed(parts.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(n))))
    for b in range(n):
        rows = dealt.where(F.col("b") == b).collect()
        if rows:
            yield make_block([(r.i, r.t) for r in rows], window, k)


_FOUND = "doc_id long, digest string, bits binary, items array<string>"


def _found(texts: DataFrame, blocks: Iterator[Block]) -> DataFrame:
    """(doc_id, digest, bits, items) of the documents that a block hit: a row for each block. One broadcast at a time."""
    out, sc = texts.sparkSession.createDataFrame([], _FOUND), texts.sparkSession.sparkContext
    for block in blocks:
        sent = sc.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in chunks(batch.column(1)):
                    words = split_words(batch.column(1).slice(a, b - a), ALNUM_WORDS)
                    hit, items = _scan(words, [sent.value])
                    some = np.unique(words.doc[hit])
                    bits = [np.packbits(hit[words.first[d] : words.first[d + 1]]).tobytes() for d in some]
                    part = [batch.column(i).slice(a, b - a).take(pa.array(some)) for i in (0, 2)]
                    yield pa.record_batch([*part, pa.array(bits, pa.binary()), pa.array([sorted(items.get(int(d), ())) for d in some], pa.list_(pa.string()))], ["doc_id", "digest", "bits", "items"])

        out = out.unionByName(checkpointed(texts.mapInArrow(lambda b, scan=scan: freed(scan(b)), _FOUND)))
        sent.destroy()
    return out


_VERDICT = "doc_id long, n_words long, n_hit long, n_items long, items array<string>, spans array<struct<first:long,words:long>>, contaminated boolean"


def _verdicts(ids: pa.Array, words: Words, hit: np.ndarray, items: dict[int, set[str]]) -> pa.RecordBatch:
    n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[words.first])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])) != 0)
    spans: list[list[dict]] = [[] for _ in range(len(ids))]
    for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        while x < y:  # a run may go from one document to the next
            d = int(words.doc[x])
            z = min(y, int(words.first[d + 1]))
            spans[d].append({"first": x - int(words.first[d]), "words": z - x})
            x = z
    listed = [sorted(items.get(i, ())) for i in range(len(ids))]
    return pa.record_batch(
        [ids, pa.array(words.counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in listed], pa.int64()), pa.array(listed, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))), pa.array(n_hit > 0)],
        ["doc_id", "n_words", "n_hit", "n_items", "items", "spans", "contaminated"],
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, k: int = K, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """Per row: id, n_words, n_hit, n_items, items (list of ids), spans (list of first word and words), contaminated."""
    if not 0 < k <= window:
        raise ValueError("a k-gram must fit the window")
    blocks = _blocks(benchmark, item_id_col, item_text_col, window, k, broadcast_chars)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    first = next(blocks, None)
    second = next(blocks, None)
    if second is None:
        sent = docs.sparkSession.sparkContext.broadcast([first] if first else [])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in chunks(batch.column(1)):
                    words = split_words(batch.column(1).slice(a, b - a), ALNUM_WORDS)
                    yield _verdicts(batch.column(0).slice(a, b - a), words, *_scan(words, sent.value))

        return texts.mapInArrow(lambda b: freed(scan(b)), _VERDICT)
    digested = texts.withColumn("digest", F.md5("text"))
    found = _found(digested, itertools.chain([first, second], blocks))
    by_doc = found.groupBy("doc_id", "digest").agg(F.collect_list("bits").alias("bits"), F.flatten(F.collect_list("items")).alias("items"))
    counted = digested.mapInArrow(_counted, "doc_id long, digest string, n long")
    joined = counted.join(by_doc.withColumnRenamed("doc_id", "known"), counted.doc_id.eqNullSafe(F.col("known")) & (counted.digest == by_doc.digest), "left")
    return joined.select("doc_id", "n", "bits", "items").mapInArrow(_joined, _VERDICT)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in chunks(batch.column(1)):
            words = split_words(batch.column(1).slice(a, b - a), ALNUM_WORDS)
            yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(words.counts, pa.int64())], ["doc_id", "digest", "n"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verdicts from the bits that all blocks left."""
    for batch in batches:
        counts = batch.column(1).to_numpy()
        first = np.concatenate([[0], np.cumsum(counts)])
        hit, items = np.zeros(int(first[-1]), dtype=bool), {}
        for d, (bits, ids) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            for one in bits or ():
                hit[first[d] : first[d + 1]] |= np.unpackbits(np.frombuffer(one, np.uint8), count=int(counts[d])).astype(bool)
            items[d] = set(ids or ())
        none = np.zeros(0, np.int64)
        yield _verdicts(batch.column(0), Words(np.zeros(0, np.uint8), none, none, first, np.repeat(np.arange(len(counts)), counts)), hit, items)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a benchmark window."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = K, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """The clean rows as they are. With one block the verdict is made where the row is read; with more, rows that any hit go."""
    blocks = _blocks(benchmark, "item_id", "text", window, k, broadcast_chars)
    first = next(blocks, None)
    second = next(blocks, None)
    if second is None:
        (name,) = fresh(docs, "contaminated")
        sent, at = docs.sparkSession.sparkContext.broadcast([first] if first else []), docs.columns.index(text_col)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                marks = np.zeros(batch.num_rows, dtype=bool)
                for a, b in chunks(batch.column(at)):
                    words = split_words(batch.column(at).slice(a, b - a), ALNUM_WORDS)
                    hit, _ = _scan(words, sent.value)
                    marks[a + words.doc[hit]] = True
                yield pa.record_batch([*batch.columns, pa.array(marks)], [*batch.schema.names, name])

        out = docs.mapInArrow(lambda b: freed(scan(b)), StructType([*docs.schema.fields, StructField(name, BooleanType())]))
        return out.where(~F.col(name)).drop(name)
    digested = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.md5(F.col(text_col).cast("string")).alias("digest"))
    hit_id, hit_digest = fresh(docs, "hit_id", "hit_digest")
    found = _found(digested, itertools.chain([first, second], blocks)).select(F.col("doc_id").alias(hit_id), F.col("digest").alias(hit_digest)).distinct()
    same = F.col(id_col).cast("long").eqNullSafe(F.col(hit_id)) & (F.md5(F.col(text_col).cast("string")) == F.col(hit_digest))
    return docs.join(found, same, "left_anti")
