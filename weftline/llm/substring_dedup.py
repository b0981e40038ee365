"""Operator 1: exact removal of repeated word passages, found with difference-cover anchors.

A window is ``window`` consecutive words of one document. Every word covered by a window whose word sequence
also starts anywhere else is removed. Hashing all windows would shuffle one row a word; instead only windows of
``window - period + 1`` words that start at cover positions (modulo the period) are hashed. Two equal passages
of ``window`` words lie at arbitrary offsets modulo the period; a difference cover has, for any pair of offsets,
a shift at which both are cover positions, so the passages share an anchor there. Only windows that hold a
repeated anchor are then hashed in full, and the full hashes decide.

Plan. Rows go to document buckets by their place in the table, so no row, however often it is repeated, is hot; texts
too short for a window go nowhere. A bucket holds its texts and their anchors; words are found again chunk by chunk
where they are needed. Each bucket sends every hash bucket the sorted set of its anchor hashes and gets a bit for
each: seen in another bucket. What repeats inside the bucket it knows itself. So a passage of a third of all documents is one hash a bucket, not one row a document; no group is
collected, and since sets are sent, the order of rows doesn't matter when a lost executor's task runs again.
The same exchange then runs for the full windows, with hashes of 128 bits. The input must be a table as it is read, whose
rows keep their places when a task runs again; checkpoint the output of a shuffle first.

Edge cases: a null text has no words; a document of fewer words than a window loses none; repeated rows are
occurrences of their own; a null doc_id is returned as null.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LEAST_BUCKETS, bucket_count, freed, table
from .wordhash import WHITESPACE_WORDS, Words, chunks, covered, kgram, split_words, starts_of

WINDOW = 35
#: A perfect difference set modulo 21: each difference is that of one pair.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
_SECOND = 0xD6E8FEB86659FD93
_SENT = "b int, w int, at int, keys binary"
_PAIR = np.dtype([("a", "<u8"), ("b", "<u8")])


def is_difference_cover(cover: tuple[int, ...], period: int) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def _anchors(words: Words, h: np.ndarray, window: int, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of the anchors inside windows."""
    size = window - period + 1
    s = starts_of(words, size)
    s = s[np.isin(words.pos[s] % period, cover) & (words.counts[words.doc[s]] >= window)]
    return s, kgram(h, size)[s]


class _Bucket:
    """A bucket's texts, and the anchors of each chunk of them."""

    def __init__(self, texts: pa.ChunkedArray, window: int, period: int, cover: tuple[int, ...]):
        column = texts.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
        self.column, self.window, self.period = column, window, period
        self.parts = []
        for a, b in chunks(column):
            words = self._words(a, b)
            at, keys = _anchors(words, words.hashes(), window, period, cover)
            self.parts.append((a, b, at.astype(np.int32), keys))

    def _words(self, a: int, b: int) -> Words:
        return split_words(self.column.slice(a, b - a), WHITESPACE_WORDS)

    def anchor_keys(self) -> np.ndarray:
        return np.concatenate([p[3] for p in self.parts] or [np.zeros(0, np.uint64)])

    def candidates(self, repeated: np.ndarray, *, every: bool) -> Iterator[tuple[Words, np.ndarray, np.ndarray]]:
        """For each chunk its words, the starts of windows that hold an anchor in the sorted array ``repeated``, and
        their keys; with ``every`` also chunks without such windows."""
        for a, b, at, keys in self.parts:
            hot = at[_member(keys, repeated)]
            if not len(hot) and not every:
                continue
            words = self._words(a, b)
            s, found = np.zeros(0, np.int64), np.zeros(0, _PAIR)
            if len(hot):
                s = starts_of(words, self.window)
                near = np.zeros(len(words.start) + 1, dtype=np.int32)
                near[1:] = np.cumsum(np.bincount(hot, minlength=len(words.start)))
                s = s[near[np.minimum(s + self.period, len(words.start))] > near[s]]
                h, found = words.hashes(), np.zeros(len(s), _PAIR)
                found["a"], found["b"] = kgram(h, self.window)[s], kgram(h, self.window, _SECOND)[s]
            yield words, s, found


def _member(keys: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered) or not len(keys):
        return np.zeros(len(keys), dtype=bool)
    if keys.dtype.names:
        i = np.minimum(np.searchsorted(ordered["a"], keys["a"]), len(ordered) - 1)
        hit = ordered["a"][i] == keys["a"]
        same = ordered["b"][i] == keys["b"]
        if (hit & ~same).any():  # two keys with the same first half: look at all
            known = set(ordered.tolist())
            for j in np.flatnonzero(hit & ~same):
                same[j] = keys[j].item() in known
        return hit & same
    i = np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)
    return ordered[i] == keys


def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, whether each occurs more than once)."""
    if not len(keys):
        return keys, np.zeros(0, dtype=bool)
    order = np.lexsort((keys["b"], keys["a"])) if keys.dtype.names else np.argsort(keys, kind="stable")
    x = keys[order]
    first = np.ones(len(x), dtype=bool)
    first[1:] = x[1:] != x[:-1]
    at = np.flatnonzero(first)
    return x[at], np.diff(np.append(at, len(x))) > 1


def _dealt(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The hash bucket of each key; keys are spread by their upper bits, so sorted keys stay in runs."""
    a = keys["a"] if keys.dtype.names else keys
    return ((a >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _sent(b: int, keys: np.ndarray, buckets: int) -> pa.Table:
    """A row for each hash bucket, with the sorted distinct keys that go there."""
    own, _ = _unique(keys)
    w = _dealt(own, buckets)
    order = np.argsort(w, kind="stable")
    own, w = own[order], w[order]
    cut = np.flatnonzero(np.diff(w, prepend=-1)) if len(w) else np.zeros(0, np.int64)
    to = np.append(cut, len(w))
    return pa.table({"b": pa.array(np.full(len(cut), b), pa.int32()), "w": pa.array(w[cut], pa.int32()), "at": pa.array(np.zeros(len(cut)), pa.int32()), "keys": pa.array([own[x:y].tobytes() for x, y in zip(to[:-1], to[1:], strict=True)], pa.binary())})


def _elsewhere(dtype: np.dtype):
    """For a hash bucket: for each bucket that sent keys, a bit for each key: another bucket sent it too."""

    def reply(rows: pa.Table) -> pa.Table:
        sent = [np.frombuffer(x, dtype=dtype) for x in rows.column("keys").to_pylist()]
        everything = np.concatenate(sent or [np.zeros(0, dtype)])
        known, more = _unique(everything)
        common = known[more]
        bits = [np.packbits(_member(x, common)).tobytes() for x in sent]
        return pa.table({"b": rows.column("b"), "w": rows.column("w"), "at": rows.column("at"), "keys": pa.array(bits, pa.binary())})

    return reply


def _repeated(keys: np.ndarray, replies: pa.Table, buckets: int) -> np.ndarray:
    """Sorted keys that occur again, in this bucket or, by the replies, in another."""
    own, again = _unique(keys)
    w = _dealt(own, buckets)
    order = np.argsort(w, kind="stable")
    to = np.searchsorted(w[order], np.arange(buckets + 1))
    for bucket, bits in zip(replies.column("w").to_pylist(), replies.column("keys").to_pylist(), strict=True):
        at = order[to[bucket] : to[bucket + 1]]
        again[at] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=len(at)).astype(bool)
    return own[again]


def _split_replies(replies: pa.Table) -> tuple[pa.Table, pa.Table]:
    at = np.asarray(replies.column("at").to_numpy()) if replies.num_rows else np.zeros(0, np.int32)
    return replies.filter(pa.array(at == 0)), replies.filter(pa.array(at == 1))


def kept_texts(words: Words, kept: np.ndarray) -> Iterator[bytes]:
    """For each document, its kept words joined by one space."""
    d = np.zeros(len(words.data) + 1, dtype=np.int8)
    d[words.start[kept]] += 1
    np.subtract.at(d, words.end[kept], 1)
    mask = np.cumsum(d, dtype=np.int8).astype(bool)  # one position more than the bytes
    idx = np.flatnonzero(kept)
    follows = idx[:-1][words.doc[idx[:-1]] == words.doc[idx[1:]]] if len(idx) else idx
    data = np.append(words.data, np.uint8(32))
    data[words.end[follows]] = 32
    mask[words.end[follows]] = True
    out = data[mask].tobytes()
    n = (words.end - words.start) * kept
    n[follows] += 1
    to = np.concatenate([[0], np.cumsum(n)])[words.first]
    for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True):
        yield out[a:b]


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER, with_text: bool = True) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 and, ``with_text``, the kept text."""
    if not is_difference_cover(cover, period) or not 0 < period <= window:
        raise ValueError("cover must be a difference cover of a period no longer than the window")
    buckets = bucket_count(docs)
    hash_buckets = max(LEAST_BUCKETS, buckets // 4)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    long_enough = F.coalesce(F.length("text"), F.lit(0)) >= 2 * window - 1
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).cast("int")
    dealt = texts.withColumn("b", place).where(long_enough)

    def load(rows: pa.Table) -> _Bucket:
        return _Bucket(rows.column("text"), window, period, cover)

    def anchors(rows: pa.Table) -> pa.Table:
        return _sent(rows.column("b")[0].as_py(), load(rows).anchor_keys(), hash_buckets)

    def windows(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"b": pa.array([], pa.int32()), "w": pa.array([], pa.int32()), "at": pa.array([], pa.int32()), "keys": pa.array([], pa.binary())})
        bucket = load(rows)
        repeated = _repeated(bucket.anchor_keys(), replies, hash_buckets)
        keys = [_unique(found)[0] for _, _, found in bucket.candidates(repeated, every=False)]
        out = _sent(rows.column("b")[0].as_py(), np.concatenate([np.zeros(0, _PAIR), *keys]), hash_buckets)
        return out.set_column(2, "at", pa.array(np.ones(out.num_rows), pa.int32()))

    def row(words: Words, gone: np.ndarray) -> tuple[list, ...]:
        kept = list(kept_texts(words, ~gone))
        n_removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first]).tolist()
        return words.counts.tolist(), n_removed, [hashlib.sha256(x).hexdigest() for x in kept], [x.decode() for x in kept] if with_text else []

    def filled(ids: pa.Array, parts: list[tuple[list, ...]]) -> dict[str, pa.Array]:
        n_words, n_removed, sha, text = (list(itertools.chain.from_iterable(x)) for x in (zip(*parts, strict=True) if parts else [()] * 4))
        out = {"doc_id": ids, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        return out | ({"kept_text": pa.array(text, pa.string())} if with_text else {})

    def removed(rows: pa.Table, replies: pa.Table) -> pa.Table:
        parts = []
        if rows.num_rows:
            first, second = _split_replies(replies)
            bucket = load(rows)
            repeated = _repeated(bucket.anchor_keys(), first, hash_buckets)
            twice = _repeated(np.concatenate([np.zeros(0, _PAIR), *(found for _, _, found in bucket.candidates(repeated, every=False))]), second, hash_buckets)
            for words, s, found in bucket.candidates(repeated, every=True):
                parts.append(row(words, covered(len(words.start), s[_member(found, twice)], window)))
        return pa.table(filled(rows.column("doc_id"), parts))

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                words = split_words(batch.column(1).slice(a, b - a), WHITESPACE_WORDS)
                yield pa.RecordBatch.from_pydict(filled(batch.column(0).slice(a, b - a), [row(words, np.zeros(len(words.start), dtype=bool))]))

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    first = dealt.groupBy("b").applyInArrow(anchors, _SENT).groupBy("w").applyInArrow(_elsewhere(np.dtype("<u8")), _SENT)
    second = dealt.groupBy("b").cogroup(first.groupBy("b")).applyInArrow(windows, _SENT).groupBy("w").applyInArrow(_elsewhere(_PAIR), _SENT)
    shorter = texts.where(~long_enough).mapInArrow(lambda b: freed(untouched(b)), schema)
    return dealt.groupBy("b").cogroup(first.unionByName(second).groupBy("b")).applyInArrow(removed, schema).unionByName(shorter)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), with_text=False)
