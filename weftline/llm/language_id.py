"""Operator 5: language identification by multinomial naive Bayes over hashed character n-grams.

A word's grams are the runs of one to four characters of its lower-cased letters between end marks, hashed to
``BUCKETS``. Training counts grams by language and keeps smoothed log-probabilities, a (buckets x languages)
matrix that is broadcast. Every language of the training rows is learned; where there are so many that the matrix
would pass ``MATRIX_BYTES`` (1,024 languages), it has fewer buckets. Scoring is a sparse product: each distinct word's
row of sums is found once a worker, and a document adds its words' rows.

Bounds: ``per_language`` training documents of each language, fewer if there are more than ``most_rows`` of them
together, those with the least hash of id and text, of ``max_chars`` characters at most; repeated rows count once.
Texts are scored whole.

Edge cases: null and letterless texts are ``und`` with score 1; with nothing to learn from all texts are ``und``.
The score is the posterior of the predicted language; ties go to the first language in order. Rows without id are
training rows like others; of rows of a repeated id each is scored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import crc32_of_id, freed, fresh, table
from .hashnumbers import WordRows, kept_rows
from .labels import chosen_texts, words_of
from .toxicity import letters
from .wordhash import WHITESPACE_WORDS, chunks, split_words

BUCKETS, LONGEST_GRAM = 1 << 17, 4
PER_LANGUAGE, MAX_CHARS, MOST_ROWS, MATRIX_BYTES = 1500, 20_000, 30_000, 1 << 29
HELD_MODULUS, HELD_OUT = 4, 2


def gram_buckets(clean: Sequence[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of all grams."""
    size = np.fromiter((len(w) + 2 for w in clean), np.int64, len(clean))
    flat = np.frombuffer("".join(f"^{w}$" for w in clean).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(clean)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(flat))
    out, words = [], []
    key = np.zeros(len(flat), np.uint64)
    for n in range(1, LONGEST_GRAM + 1):
        key = key[: len(flat) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + flat[n - 1 :] + np.uint64(n)
        ok = left[: len(key)] >= n
        out.append((((key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(47)).astype(np.int64)[ok] % buckets)
        words.append(owner[: len(key)][ok])
    return np.concatenate(out), np.concatenate(words)


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    log_p: np.ndarray  # buckets x languages

    def rows(self, words: Sequence[str]) -> np.ndarray:
        """For each word as it stands: whether it has letters, then the sums of its grams' log-probabilities."""
        clean = [letters(w) for w in words]
        out = np.zeros((len(words), len(self.languages) + 1))
        have = [i for i, w in enumerate(clean) if w]
        out[have, 0] = 1
        for a in range(0, len(have), 8192):
            at = have[a : a + 8192]
            bucket, word = gram_buckets([clean[i] for i in at], len(self.log_p))
            for k in range(len(self.languages)):
                out[at, k + 1] = np.bincount(word, self.log_p[bucket, k], minlength=len(at))
        return out


def train(rows: Sequence[tuple[str, str]], counts: dict[str, int] | None = None) -> Model:
    languages = sorted({lang for _, lang in rows})
    total = np.array([(counts or Counter(lang for _, lang in rows))[x] for x in languages], float)
    buckets = BUCKETS
    while buckets * len(languages) * 4 > MATRIX_BYTES:
        buckets //= 2
    seen = np.full((buckets, len(languages)), 0.05, np.float32)
    for k, lang in enumerate(languages):
        words = Counter(w for t, x in rows if x == lang for w in map(letters, words_of(t)) if w)
        known = list(words)
        n = np.fromiter(words.values(), float, len(known))
        for a in range(0, len(known), 8192):
            bucket, word = gram_buckets(known[a : a + 8192], buckets)
            seen[:, k] += np.bincount(bucket, n[a + word], minlength=buckets)
    return Model(languages, np.log(total / total.sum()) if len(languages) else total, np.log(seen / seen.sum(axis=0, dtype=np.float64)).astype(np.float32))


def predict(store: WordRows, model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    lang, score = ["und"] * len(texts), np.ones(len(texts))
    if not model.languages:
        return lang, score
    for a, b in chunks(texts):
        words = split_words(texts.slice(a, b - a), WHITESPACE_WORDS)
        full = np.flatnonzero(words.counts)
        if not len(full):
            continue
        at = store.look_up(words)
        sums = np.add.reduceat(store.rows[at], words.first[full], axis=0)
        value = sums[:, 1:] + model.prior
        best = value.argmax(axis=1)
        p = 1 / np.exp(value - value.max(axis=1, keepdims=True)).sum(axis=1)
        for d, have, k, q in zip(full.tolist(), sums[:, 0].tolist(), best.tolist(), p.tolist(), strict=True):
            if have:
                lang[a + d], score[a + d] = model.languages[k], q
    return lang, score


def fit(docs: DataFrame, *, per_language: int = PER_LANGUAGE, max_chars: int = MAX_CHARS, most_rows: int = MOST_ROWS) -> Model:
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where((F.length("text") <= max_chars) & F.col("lang").isNotNull() & (F.pmod(crc32_of_id(), F.lit(HELD_MODULUS)) != HELD_OUT))
    hashed = known.select("lang", F.xxhash64("doc_id", "text").alias("h"))
    found = hashed.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("different")).collect()
    if not found:
        return train([])
    most = max(1, min(per_language, most_rows // len(found)))
    # About twice as many hashes as wanted pass the first filter, whatever the table's size; equal rows have one hash.
    share = docs.sparkSession.createDataFrame([(r.lang, min(1.0, 2.0 * most / r.different)) for r in found], "lang string, share double")
    low = hashed.join(F.broadcast(share), "lang").where(F.pmod("h", F.lit(1 << 30)) / float(1 << 30) < F.col("share"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))
    chosen = low.select("lang", "h").distinct().withColumn("r", rank).where(F.col("r") <= most).select("lang", "h")
    texts = known.select("text", F.xxhash64("doc_id", "text").alias("h"))
    return train(chosen_texts(texts, chosen, "lang"), {r.lang: r.n for r in found})


def with_language(docs: DataFrame, model: Model, *, text_col: str = "text") -> tuple[DataFrame, str, str]:
    """The rows with the predicted language and its score, and those columns' names."""
    names = fresh(docs, "lang_pred", "lang_score")
    sent, at, key = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col), uuid.uuid4().hex

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        store = kept_rows(f"language {key}", lambda: WordRows(own.rows))
        for batch in batches:
            lang, p = predict(store, own, batch.column(at))
            yield pa.record_batch([*batch.columns, pa.array(lang, pa.string()), pa.array(p, pa.float64())], [*batch.schema.names, *names])

    fields = [*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())]
    return docs.mapInArrow(lambda b: freed(score(b)), StructType(fields)), *names


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored, lang, score = with_language(docs.select("doc_id", "text"), fit(docs))
    return scored.select("doc_id", (F.pmod(crc32_of_id(), F.lit(HELD_MODULUS)) == HELD_OUT).alias("held_out"), F.col(lang).alias("lang_pred"), F.col(score).alias("score"))
