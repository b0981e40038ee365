"""Labelled rows for the classifiers: a bounded sample, chosen by a hash so that it doesn't depend on order."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id

#: How many ids are asked for, as a multiple of the rows wanted, at first and at most.
ASKED, MOST_ASKED = 4, 64
#: Words between ASCII white space: the same in fitting as where texts are scored.
words_of = re.compile(r"[^\x20\x09-\x0D]+").findall


def fold(doc_id: object, modulus: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def chosen_texts(texts: DataFrame, chosen: DataFrame, target: str) -> list[tuple[str, object]]:
    """(text, target) of the rows whose hash is chosen, from (h, text) and a bounded (h, target). Repeated rows count once."""
    found = texts.join(F.broadcast(chosen), "h").dropDuplicates(["h", target]).collect()
    return [(r.text, r[target]) for r in sorted(found, key=lambda r: (r.h, r.text, str(r[target])))]


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, *, modulus: int, held_out: int, per_class: int, max_chars: int) -> list[tuple[str, int]]:
    """At most ``per_class`` (text, label) rows of each label, none of them held out.

    Of each label's ids the ``ASKED`` times ``per_class`` with the least hash are asked for; of their documents of
    ``max_chars`` characters or fewer those with the least hash of id and text are taken, whole: the same rows at every
    run. Where too few ids have such documents, four times as many are asked for, up to ``MOST_ASKED`` times. So the ids
    that are broadcast and the rows that the driver gets are bounded, whatever ids repeat, and documents are scanned
    without a shuffle of texts. Rows without id have no label, an id with both labels counts as 1. Scoring reads every
    text whole.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & (F.pmod(crc32_of_id(), F.lit(modulus)) != held_out)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y"))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") <= max_chars)
    texts = texts.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h"))
    asked = ASKED * per_class
    while True:
        ids = _each(known, "doc_id", asked, F.xxhash64("doc_id"))
        chosen = _each(texts.select("doc_id", "h").join(F.broadcast(ids), "doc_id").select("y", "h").distinct(), "h", per_class, F.col("h"))
        found = chosen_texts(texts.select("h", "text"), chosen, "y")
        short = [y for y in (0, 1) if sum(v == y for _, v in found) < per_class]
        if not short or asked >= MOST_ASKED * per_class or known.where(F.col("y").isin(short)).groupBy("y").count().where(F.col("count") > asked).isEmpty():
            return found
        asked *= 4


def _each(rows: DataFrame, column: str, most: int, order: Column) -> DataFrame:
    """(column, y): the first ``most`` rows of each label."""
    zero, one = (rows.where(F.col("y") == y).orderBy(order, column).limit(most).select(column, "y") for y in (0, 1))
    return zero.unionByName(one)
