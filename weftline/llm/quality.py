"""Operator 10: quality by random-indexing word vectors pooled per document and a two-layer numpy network.

Random indexing. A word's index vector is sparse, ternary and made from a hash of the word and one of its shape
(runs of capitals, small letters, digits and each mark). Its context vector is the sum of the index vectors of the
words up to ``REACH`` places away, over the training texts, with the logarithm's damping and unit length; an
unknown word has the mean context of its shape. A document pools its words: mean context vector, the length of
the mean index vector (high where few words make up the text), how often a word follows itself, and the number
of words. A network with one hidden layer gives a logit; a temperature fitted on rows kept apart from training
calibrates it, and the logit is moved from the sample's share of labels to that of all labels.

Bounds: ``per_class`` labelled documents of each label, of ``max_chars`` characters at most, and ``VOCABULARY``
words with context vectors (fixed by the model's size, which is broadcast). Texts are scored whole.

Edge cases: null and empty texts have zero vectors and no words and get the score that the network gives those;
with only one label in the sample the score is that label's share; of rows of a repeated id each is scored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import crc32_of_id, freed, fresh, table
from .hashnumbers import WordRows, kept_rows
from .labels import labelled_sample, words_of
from .wordhash import WHITESPACE_WORDS, chunks, split_words

DIMENSIONS, NONZERO, REACH, VOCABULARY = 64, 6, 2, 40_000
PER_CLASS, MAX_CHARS = 2500, 20_000
HIDDEN, EPOCHS = 32, 120
STORED_WORDS = 1 << 17
HELD_MODULUS, HELD_OUT = 4, 2
THRESHOLD = 0.7


def shape(word: str) -> str:
    if word.isalpha():
        return "A" if word.isupper() and len(word) > 1 else "Aa" if word[0].isupper() else "a"
    out = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "a", word)
    return re.sub(r"(.)\1+", r"\1\1", re.sub(r"\d+", "9", out))


def index_vectors(words: Sequence[str]) -> np.ndarray:
    """A row of ``NONZERO`` entries of +1 or -1 for each word, the same in every process, of unit length."""
    seed = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint64, len(words))
    out = np.zeros((len(words), DIMENSIONS), np.float32)
    row = np.arange(len(words))
    for i in range(NONZERO):
        x = (seed + np.uint64(i + 1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        out[row, (x % np.uint64(DIMENSIONS)).astype(np.int64)] += np.where(x >> np.uint64(63), 1.0, -1.0)
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-6)


@dataclass
class Model:
    numbers: dict[str, int]
    context: np.ndarray
    shapes: dict[str, np.ndarray]
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    mean: np.ndarray
    scale: np.ndarray
    temperature: float = 1.0
    shift: float = 0.0

    def rows(self, words: Sequence[str]) -> np.ndarray:
        """The context vector and the index vector of each word."""
        out = np.zeros((len(words), 2 * DIMENSIONS), np.float32)
        out[:, DIMENSIONS:] = index_vectors(words)
        none = np.zeros(DIMENSIONS, np.float32)
        for i, w in enumerate(words):
            k = self.numbers.get(w)
            out[i, :DIMENSIONS] = self.shapes.get(shape(w), none) if k is None else self.context[k]
        return out

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        logit = _forward(self.layers, (pooled - self.mean) / self.scale)[1] / self.temperature + self.shift
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _forward(layers, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = layers
    h = np.tanh(np.clip(x, -8, 8) @ w1 + b1)
    return h, h @ w2 + b2


def pool(store: WordRows, texts: pa.Array) -> np.ndarray:
    out = np.zeros((len(texts), DIMENSIONS + 3))
    out[:, DIMENSIONS] = -6.0
    for a, b in chunks(texts, 1 << 18):
        words = split_words(texts.slice(a, b - a), WHITESPACE_WORDS)
        full = np.flatnonzero(words.counts)
        if not len(full):
            continue
        at = store.look_up(words)
        first, n = words.first[full], words.counts[full]
        mean = np.zeros((len(full), 2 * DIMENSIONS))
        for row, x, y in zip(mean, first.tolist(), (first + n).tolist(), strict=True):
            for z in range(x, y, 8192):  # some words at a time, however long the text
                row += store.rows[at[z : min(z + 8192, y)]].sum(axis=0)
        mean /= n[:, None]
        same = np.zeros(len(at))
        same[1:] = at[1:] == at[:-1]
        same[first] = 0
        out[a + full, :DIMENSIONS] = mean[:, :DIMENSIONS]
        out[a + full, DIMENSIONS] = np.log((mean[:, DIMENSIONS:] ** 2).sum(axis=1) + 1e-3)
        out[a + full, DIMENSIONS + 1] = np.add.reduceat(same, first) / n
        out[a + full, DIMENSIONS + 2] = np.log1p(n)
    return out


def _contexts(texts: Sequence[str]) -> tuple[dict[str, int], np.ndarray, dict[str, np.ndarray]]:
    counts = Counter(w for t in texts for w in words_of(t))
    known = sorted(counts, key=lambda w: (-counts[w], w))[:VOCABULARY]
    numbers = {w: i for i, w in enumerate(known)}
    index = index_vectors(known) + index_vectors([f"\0{shape(w)}" for w in known])
    forms = sorted({shape(w) for w in counts})
    rest = dict(zip(forms, index_vectors([f"\0{s}" for s in forms]), strict=True))
    context = np.zeros((len(known), DIMENSIONS))
    for t in texts:
        words = words_of(t)
        at = np.fromiter((numbers.get(w, -1) for w in words), np.int64, len(words))
        own = np.array([index[k] if k >= 0 else rest[shape(w)] for w, k in zip(words, at, strict=True)]).reshape(-1, DIMENSIONS)
        around = np.zeros_like(own)
        for j in range(1, REACH + 1):
            around[j:] += own[:-j]
            around[:-j] += own[j:]
        ok = at >= 0
        np.add.at(context, at[ok], around[ok])
    context = np.sign(context) * np.log1p(np.abs(context))
    context = (context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-6)).astype(np.float32)
    sums: dict[str, np.ndarray] = {}
    for w, i in numbers.items():
        form = shape(w)
        sums[form] = sums.get(form, 0) + context[i]
    return numbers, context, {s: (v / max(np.linalg.norm(v), 1e-6)).astype(np.float32) for s, v in sums.items()}


def _network(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Adam on the cross-entropy, with weight decay."""
    rng = np.random.default_rng(7)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    x = np.clip(x, -8, 8)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            t += 1
            h = np.tanh(x[part] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -30, 30))) - y[part]) / len(part)
            back = np.outer(d, p[2]) * (1 - h * h)
            for i, g in enumerate((x[part].T @ back + 2e-3 * p[0], back.sum(axis=0), h.T @ d + 2e-3 * p[2], np.array([d.sum()]))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return p[0], p[1], p[2], float(p[3][0])


def train(rows: Sequence[tuple[str, int]], share: float | None = None) -> Model:
    """``share``: of label 1 among all labelled rows, if the sample's differs."""
    texts, y = [t for t, _ in rows], np.array([v for _, v in rows], float)
    own = min(max(y.mean() if len(y) else 0.5, 0.02), 0.98)
    share = min(max(own if share is None else share, 0.02), 0.98)
    width = DIMENSIONS + 3
    if len(set(y.tolist())) < 2:
        flat = (np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
        return Model({}, np.zeros((0, DIMENSIONS), np.float32), {}, flat, np.zeros(width), np.ones(width), 1.0, float(np.log(share / (1 - share))))
    numbers, context, shapes = _contexts(texts)
    model = Model(numbers, context, shapes, (np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0), np.zeros(width), np.ones(width))
    x = pool(WordRows(model.rows, 1 << 16), pa.array(texts, pa.string()))
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - model.mean) / model.scale
    apart = np.fromiter((zlib.crc32(t.encode()) % 5 == 0 for t in texts), bool, len(texts))
    if len(set(y[~apart].tolist())) < 2 or len(set(y[apart].tolist())) < 2:
        apart[:] = False
    model.layers = _network(x[~apart], y[~apart])
    if apart.any():
        logit = _forward(model.layers, x[apart])[1]
        loss = lambda t: np.logaddexp(0, np.where(y[apart] > 0, -1, 1) * logit / t).mean()
        model.temperature = float(min(np.geomspace(0.3, 10, 60), key=loss))
    model.shift = float(np.log(share / (1 - share)) - np.log(own / (1 - own)))
    return model


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Model:
    rows = labelled_sample(docs, labels, "quality", modulus=HELD_MODULUS, held_out=HELD_OUT, per_class=per_class, max_chars=max_chars)
    known = labels.where(F.col("quality").isin(0, 1) & (F.pmod(crc32_of_id(), F.lit(HELD_MODULUS)) != HELD_OUT))
    return train(rows, known.agg(F.avg(F.col("quality").cast("double"))).first()[0])


def with_quality(docs: DataFrame, model: Model, *, text_col: str = "text") -> tuple[DataFrame, str]:
    """The rows with a column of scores, and its name."""
    (name,) = fresh(docs, "quality_score")
    sent, at, key = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col), uuid.uuid4().hex

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        store = kept_rows(f"quality {key}", lambda: WordRows(own.rows, STORED_WORDS))
        for batch in batches:
            p = own.probability(pool(store, batch.column(at)))
            yield pa.record_batch([*batch.columns, pa.array(p, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(lambda b: freed(score(b)), StructType([*docs.schema.fields, StructField(name, DoubleType())])), name


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored, name = with_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (F.pmod(crc32_of_id(), F.lit(HELD_MODULUS)) == HELD_OUT).alias("held_out"), F.col(name).alias("score"), (F.col(name) >= THRESHOLD).cast("int").alias("predicted"))
