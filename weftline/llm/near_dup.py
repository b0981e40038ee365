"""Operator 4: near duplicates by Order MinHash, verified by banded alignment.

Sketch. A document's shingles of ``K`` words are labelled with their occurrence number, so repeats count. Each of
``BANDS`` random orders picks the ``MINIMA`` least shingles; their hash, in text order, is the band's key. Two
texts share a key if they have the same least shingles in the same order, which follows edit similarity. At a
similarity of 0.8 a band is shared with probability 0.8 ** 4 = 0.41, one of 20 bands with 0.99997.

Candidates. Equal texts are one class from the start and go on as one row. In the bucket of a key, members aren't
paired with each other: each is paired with the bucket's centre, the member that meets most others over all its
buckets (an original among its edited copies).

Rest. What the centres leave in a bucket as two components or more is joined exactly, whatever its bands: texts whose
multisets have a Jaccard similarity of ``SIMILARITY`` share one of their rarest shingles (prefix filter; the shorter
text needs fewer of them), and its place bounds what they can have in common. All pairs of different components that
pass are verified, so no text that shares a bucket with one like it stays apart. Any order of the shingles gives the
same links; counts in ``CELLS`` cells put a template's shingles last, so its members don't meet by them. The pairs
before this step grow with the members; here they can grow with the square of a group whose texts share rare
shingles and yet differ.

Verification. A pair is a link if the multisets of shingles have a Jaccard similarity of ``SIMILARITY`` or more,
and a banded alignment of the word sequences, as 32-bit hashes of words, matches that share of their words in order
(2 x matches / words of both). Classes are the connected components of the links.

Plan. Documents give (id, text digest, keys); only the texts of bucket members are joined back. Counts, centres
and classes are partial aggregates and joins, which adaptive execution splits at hot keys. Tables and shuffle files are
deleted as soon as the next ones are written.

Edge cases: words are lower-cased runs of letters and digits; a text of fewer than ``K`` words is one shingle;
word-free texts are duplicates only of equal texts; a null text is a class of its own; a null id never names a
class that has another id; repeated rows fall into one class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, dropped, freed, fresh, table
from .components import components
from .wordhash import ALNUM_WORDS, chunks, kgram, mix, split_words

K, MINIMA, BANDS, SIMILARITY = 5, 4, 20, 0.8
#: Cells in which shingles are counted for the order of prefixes.
CELL_BITS = 18
CELLS = 1 << CELL_BITS
_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = mix(_SEEDS) | np.uint64(1)


def shingles(h: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-word shingles of one document; fewer words are one shingle."""
    return kgram(h, min(k, len(h))) if len(h) else np.zeros(0, np.uint64)


def labelled(s: np.ndarray) -> np.ndarray:
    """Shingle hashes with the occurrence number mixed in, in text order."""
    order = np.argsort(s, kind="stable")
    x = s[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = x[1:] != x[:-1]
    if new.all():
        return s
    at = np.arange(len(x))
    number = at - np.maximum.accumulate(np.where(new, at, 0))
    out = s.copy()
    again = order[number > 0]
    out[again] = mix(s[again] + number[number > 0].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out


def sketch(s: np.ndarray, minima: int = MINIMA) -> np.ndarray:
    """A key for each band."""
    m = min(minima, len(s))
    out = np.empty(BANDS, np.uint64)
    step = max(1, min(BANDS, (1 << 20) // max(len(s), 1)))
    for a in range(0, BANDS, step):
        x = (s[None, :] ^ _SEEDS[a : a + step, None]) * _ODD[a : a + step, None]
        x ^= x >> np.uint64(32)
        at = np.argpartition(x, m - 1, axis=1)[:, :m] if m < len(s) else np.broadcast_to(np.arange(m), x.shape)
        at = np.sort(at, axis=1)
        key = _SEEDS[a : a + step].copy()
        for j in range(m):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + s[at[:, j]])
        out[a : a + step] = key
    return out


def _multiset_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = np.concatenate([a, b])
    order = np.argsort(both, kind="stable")
    x = both[order]
    cut = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    total = np.diff(np.append(cut, len(x)))
    mine = np.add.reduceat((order < len(a)).astype(np.int64), cut)
    common = np.minimum(mine, total - mine).sum()
    return common / (len(a) + len(b) - common)


def aligned_words(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The most words matched in order, with places at most ``band`` apart.

    Common ends are matched directly; the middle is aligned a row at a time with the bits of an integer.
    """
    n = min(len(a), len(b))
    differs = np.flatnonzero(a[:n] != b[:n])
    head = int(differs[0]) if len(differs) else n
    a, b = a[head:], b[head:]
    n -= head
    differs = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1]) if n else []
    tail = int(differs[0]) if len(differs) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    where: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    every = (1 << len(a)) - 1
    row, near = every, (1 << (2 * band + 1)) - 1
    for j, w in enumerate(b.tolist()):
        hit = where.get(w, 0)
        if hit:
            u = row & hit & (near << (j - band) if j >= band else near >> (band - j))
            if u:
                row = ((row + u) | (row - u)) & every
    return head + tail + len(a) - row.bit_count()


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two word sequences are near duplicates."""
    n, m = len(a), len(b)
    if not n or not m:
        return False
    if min(n, m) < K:
        return n == m and bool((a == b).all())
    if (min(n, m) - K + 1) < least * (max(n, m) - K + 1):
        return False
    if _multiset_jaccard(shingles(a.astype(np.uint64)), shingles(b.astype(np.uint64))) < least:
        return False
    band = abs(n - m) + int((1 - least) * max(n, m)) + 1
    return 2 * aligned_words(a, b, band) >= least * (n + m)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, column = batch.column(0), batch.column(1)
        for a, b in chunks(column):
            part = column.slice(a, b - a)
            words = split_words(part, ALNUM_WORDS)
            h, first = words.hashes(), words.first
            digests, keys = [], []
            for d, raw in enumerate(part.cast(pa.binary()).to_pylist()):
                digests.append(None if raw is None else hashlib.md5(raw).digest())
                s = shingles(h[first[d] : first[d + 1]])
                keys.append(sketch(labelled(s)).view(np.int64) if len(s) else [])
            yield pa.record_batch([ids.slice(a, b - a), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "cid", "keys"])


def _word_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(1)
        for a, b in chunks(column):
            words = split_words(column.slice(a, b - a), ALNUM_WORDS)
            h = words.hashes().astype(np.uint32)
            yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array([h[x:y].tobytes() for x, y in zip(words.first[:-1], words.first[1:], strict=True)], pa.binary())], ["cid", "words"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for a in range(0, whole.num_rows, 512):
            batch = whole.slice(a, 512)
            ok = [similar(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["cid", "rep", "ok"])


def _least(x: np.ndarray | float) -> np.ndarray:
    """The least whole number that isn't below x, but for rounding."""
    return np.ceil(x - 1e-9).astype(np.int64)


def _shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    for raw in column.to_pylist():
        yield labelled(shingles(np.frombuffer(raw, np.uint32).astype(np.uint64)))


def _cell(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CELLS, np.int64)
    for batch in batches:
        for s in _shingle_sets(batch.column(0)):
            np.add.at(total, _cell(s), 1)
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at), pa.array(total[at])], ["cell", "n"])


def prefix(s: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The rarest shingles, one of which any similar text has, and how many of them do if the other isn't shorter."""
    m = len(s)
    most = m + 1 - int(_least(np.float64(SIMILARITY * m)))
    few = m + 1 - int(_least(np.float64(2 * SIMILARITY / (1 + SIMILARITY) * m)))
    return s[np.lexsort((s, counts[_cell(s)]))[:most]], few


def _rest(texts: DataFrame) -> DataFrame:
    """(cid, rep) of all texts of different roots that can be similar, from (cid, root, words)."""
    cells = texts.select("words").mapInArrow(lambda b: freed(_cells(b)), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CELLS, np.int64)
    counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    sent = texts.sparkSession.sparkContext.broadcast(counts)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                tokens, rows, sizes, places, fews = [], [], [], [], []
                for i, s in enumerate(_shingle_sets(batch.column(2))):
                    if not len(s):
                        continue
                    t, few = prefix(s, own)
                    at = np.flatnonzero(own[_cell(t)] > 1)  # the others are in no other text
                    tokens.append(t[at])
                    places.append(at)
                    rows.append(np.full(len(at), i))
                    sizes.append(np.full(len(at), len(s)))
                    fews.append(at < few)
                if tokens:
                    row = pa.array(np.concatenate(rows))
                    columns = [pa.array(np.concatenate(tokens).view(np.int64)), batch.column(0).take(row), batch.column(1).take(row)]
                    columns += [pa.array(np.concatenate(x).astype(np.int64)) for x in (sizes, places)] + [pa.array(np.concatenate(fews))]
                    yield pa.record_batch(columns, ["token", "cid", "root", "size", "place", "few"])

    posts = checkpointed(texts.select("cid", "root", "words").mapInArrow(lambda b: freed(postings(b)), "token long, cid binary, root binary, size long, place long, few boolean"))
    a = posts.where("few").drop("few")
    b = posts.select("token", F.col("cid").alias("rep"), F.col("root").alias("root2"), F.col("size").alias("size2"), F.col("place").alias("place2"))
    size, size2 = F.col("size"), F.col("size2")
    first = (size < size2) | ((size == size2) & (F.col("cid") < F.col("rep")))
    near = size >= SIMILARITY * size2 - 1e-6
    common = F.least(size - F.col("place"), size2 - F.col("place2"))
    enough = (1 + SIMILARITY) * common >= SIMILARITY * (size + size2) - 1e-6
    return a.join(b, "token").where((F.col("root") != F.col("root2")) & first & near & enough).select("cid", "rep").distinct()


def _star(members: DataFrame) -> DataFrame:
    """(cid, rep) pairs of each bucket's members with its centre, from (key, cid, central)."""
    centre = checkpointed(members.groupBy("key").agg(F.max(F.struct("central", "cid"))["cid"].alias("rep")))
    return members.join(centre, "key").where("cid <> rep").select("key", "cid", "rep")


def near_dup_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, cid (the text's digest), root (the least digest of its class) and class_id, its least doc_id."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = checkpointed(texts.mapInArrow(lambda b: freed(_sketches(b)), "doc_id long, cid binary, keys array<long>"))
    one = rows.where("cid IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("first_id"), F.first("keys").alias("keys"))
    exploded = one.select("cid", "first_id", F.explode("keys").alias("key"))
    # What is joined at keys that may be hot is checkpointed first: then both sides of the join are exchanged, and
    # adaptive execution can split a hot key, as it can't where an aggregate's own partitioning is used.
    shared = checkpointed(exploded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    members = checkpointed(exploded.join(shared, "key").select("key", "cid", "first_id", "n"))
    dropped(shared)
    central = members.groupBy("cid").agg(F.sum("n").alias("central"), F.first("first_id").alias("first_id"))

    # The words of members, from one row of each text.
    wanted = central.select("cid", F.col("first_id").alias("doc_id"))
    mine = texts.select("doc_id", "text").where("text IS NOT NULL")
    found = mine.join(wanted, mine.doc_id.eqNullSafe(wanted.doc_id)).where(F.unhex(F.md5("text")) == F.col("cid")).select("cid", "text")
    words = checkpointed(found.mapInArrow(lambda b: freed(_word_numbers(b)), "cid binary, words binary").dropDuplicates(["cid"]))

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = words.select("cid", F.col("words").alias("wa")), words.select(F.col("cid").alias("rep"), F.col("words").alias("wb"))
        return checkpointed(pairs.join(a, "cid").join(b, "rep").select("cid", "rep", "wa", "wb").mapInArrow(lambda b: freed(_verified(b)), "cid binary, rep binary, ok boolean"))

    def links(pairs: DataFrame) -> DataFrame:
        return components(pairs.where("ok").select(F.col("cid").alias("a"), F.col("rep").alias("b")))

    ranked = checkpointed(members.join(central.select("cid", "central"), "cid").select("key", "cid", "central"))
    dropped(members)
    first = verified(_star(ranked).select("cid", "rep").distinct())

    # Buckets that still hold two components: all of their texts that can be similar are compared.
    roots = links(first).withColumnRenamed("node", "cid")
    part = checkpointed(ranked.join(roots, "cid", "left").select("key", "cid", F.coalesce("root", "cid").alias("root")))
    dropped(ranked)
    torn = checkpointed(part.groupBy("key").agg(F.min("root").alias("one"), F.max("root").alias("two")).where("one <> two").select("key"))
    apart = part.join(torn, "key").select("cid", "root").distinct()
    known = first.select("cid", "rep").unionByName(first.select(F.col("rep").alias("cid"), F.col("cid").alias("rep")))
    loose = checkpointed(apart.join(words, "cid"))
    dropped(part, torn)
    second = verified(_rest(loose).join(known, ["cid", "rep"], "left_anti"))
    dropped(loose, words)
    root = links(first.unionByName(second))
    dropped(first, second)

    named = rows.select("doc_id", "cid").join(root, F.col("cid") == F.col("node"), "left")
    named = named.select("doc_id", "cid", F.coalesce("root", "cid").alias("root"))
    least = checkpointed(named.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least")))
    return named.join(least, "root", "left").select("doc_id", "cid", "root", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("class_id"))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: that of the least doc_id, and of the least digest if ids repeat. Rows without text
    or without id stay."""
    found = near_dup_classes(docs)
    one, digest = fresh(docs, "one_id", "one_digest")
    least = found.where("cid IS NOT NULL AND doc_id IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "cid")).alias("m"))
    kept = least.select(F.col("m.doc_id").alias(one), F.col("m.cid").alias(digest))
    left = docs.where("text IS NULL OR doc_id IS NULL")
    rest = docs.where("text IS NOT NULL AND doc_id IS NOT NULL")
    same = (F.col("doc_id") == F.col(one)) & (F.unhex(F.md5(F.col("text").cast("string"))) == F.col(digest))
    return rest.join(kept, same).dropDuplicates([one, digest]).select(*docs.columns).unionByName(left)
