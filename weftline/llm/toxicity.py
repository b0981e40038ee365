"""Operator 3: toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

Kernel. A unit is the letters of a word, between end marks; a run of single letters is one unit, so an insult
spelled with gaps, inserted characters or punctuation keeps its subsequences. Two units are compared by all their
ordered character triples within ``SPAN`` characters, each weighted by ``DECAY`` for every character it spans,
normalised. Landmarks are units of the labelled sentences; Nyström features are kernel values to the landmarks
times the inverse root of the landmarks' kernel matrix, and a linear SVM (squared hinge, primal Newton) is
trained on them. Its decision is a sum over landmarks, hence one weight for each triple: a unit is scored with
table look-ups, and gives exactly the machine's value.

Training. Labels are of documents, so sentences are learned as bags of units: units of clean documents are
negative; positive are the units that a likelihood-ratio test finds in toxic documents, and of the toxic documents
without one the unit that scores best. These choices and the machine improve each other for a few rounds, in which
the worst clean units join the negatives and the landmarks. Positive units are also trained with a character inserted. Copies count once in the test. A document scores as its worst unit, through a logistic fit on the documents. Where
that misses more than ``SPARED`` of the toxic documents that it was trained on, the test is repeated on those and the
clean ones, for beginnings that several words of a document have (clean ones have one by chance): units with these are
positive for a second machine, and a document scores by the ``SEVERAL``-th of its distinct units as that machine orders
them, if that is more.

A unit has at most ``LONGEST`` letters: of a longer word or run all windows of that length, half a length apart, and
its end are units, in training as in scoring.

Bounds: ``per_class`` labelled documents of each label, of ``max_chars`` characters at most; ``negatives`` clean units
by a hash, and the ``hardest`` that a round's machine gives the most to, join the machine's rows.

Edge cases: null, empty and letterless texts score as a document whose worst unit is empty; with no toxic or no clean
label nothing is toxic; of rows of a repeated id each is scored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import crc32_of_id, freed, fresh, give_back, on_worker, table
from .hashnumbers import WordRows, kept_rows
from .labels import labelled_sample, words_of
from .wordhash import WHITESPACE_WORDS, Words, chunks, split_words

SPAN, DECAY, LONGEST = 7, 0.7, 22
LANDMARKS, NEGATIVES, HARDEST = 192, 20_000, 4000
PER_CLASS, MAX_CHARS = 2500, 20_000
HELD_MODULUS, HELD_OUT = 3, 1
THRESHOLD = 0.7
STORED_WORDS = 1 << 19
SEVERAL, SPARED = 3, 0.05
#: Words between white space, ASCII capitals as small letters, which a unit has anyway.
LOWER_WORDS = (WHITESPACE_WORDS[0], np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8))
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_LETTER = np.zeros(1 << 16, dtype=np.int32)
_LETTER[:] = 27 + np.arange(1 << 16) % 35
_LETTER[97:123] = np.arange(1, 27)
_HEAD, _TAIL = 62, 63


def letters(word: str) -> str:
    out = _NOT_LETTERS.sub("", word.lower())
    return out if out.isalpha() else "".join(filter(str.isalpha, out))  # the pattern leaves superscripts and the like


def units(text: str) -> list[str]:
    """The words of a text, with runs of three or more single letters joined."""
    words = words_of(text)
    size = np.fromiter(map(len, words), np.int64, len(words))
    single = np.concatenate([[0], (size == 1).astype(np.int8), [0]])
    if single.any():
        edge = np.flatnonzero(np.diff(single))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= 3:
                words.append("".join(words[a:b]))
    return words


def windows(clean: str) -> list[str]:
    """The units of a word's letters."""
    n, half = len(clean), LONGEST // 2
    return [clean] if n <= LONGEST else [*(clean[a : a + LONGEST] for a in range(0, n - LONGEST, half)), clean[-LONGEST:]]


def triples(clean: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(rows x triples) keys, sorted in each row, -1 where none, and the weights of triples by span."""
    n = len(clean)
    width = max((len(w) for w in clean), default=0) + 2
    codes = np.zeros((n, width + SPAN), dtype=np.int32)
    size = np.fromiter(map(len, clean), np.int64, n)
    flat = np.frombuffer("".join(clean).encode("utf-32-le"), dtype=np.uint32)
    at = np.repeat(np.arange(n), size)
    pos = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    codes[at, pos + 1] = _LETTER[flat & 0xFFFF]
    codes[:, 0] = _HEAD
    codes[np.arange(n), size + 1] = _TAIL
    out = np.empty((n, len(_OFFSETS), width), dtype=np.int32)
    first = codes[:, :width]
    for t, (a, b) in enumerate(_OFFSETS):
        last = codes[:, b : b + width]
        key = ((first << 12 | codes[:, a : a + width] << 6 | last) << 3) | b
        out[:, t] = np.where((first > 0) & (last > 0), key, -1)
    return out.reshape(n, -1), DECAY ** np.arange(1, SPAN + 2, dtype=np.float64)


def _norms(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The root of the kernel of each row with itself: squares of the weights, and products of equal triples."""
    k = np.sort(keys, axis=1)
    w = weights.astype(np.float32)[k & 7]
    w[k < 0] = 0
    key = k >> 3
    out = np.einsum("ij,ij->i", w, w).astype(np.float64)
    rows, lag = np.arange(len(k)), 1
    while lag < key.shape[1] and len(rows):
        same = (key[:, lag:] == key[:, :-lag]) & (key[:, lag:] >= 0)
        some = same.any(axis=1)
        rows, key, w, same = rows[some], key[some], w[some], same[some]
        out[rows] += 2 * np.einsum("ij,ij,ij->i", w[:, lag:], w[:, :-lag], same.astype(np.float32))
        lag += 1
    return np.sqrt(out)


@dataclass
class Model:
    """Two machines, a row of weights each: for the worst unit, and for the units of which a document must have several."""

    weight: np.ndarray  # of each triple, in single precision
    bias: np.ndarray
    a: np.ndarray
    b: np.ndarray

    def margins(self, words: Sequence[str]) -> np.ndarray:
        """The machines' values of each word as it stands in a text: of its best unit."""
        known: dict[str, int] = {}
        at, first = [], []
        for w in words:
            first.append(len(at))
            at += [known.setdefault(unit, len(known)) for unit in windows(letters(w))]
        every, got = list(known), np.empty((len(known), 2))
        order = np.argsort([len(u) for u in every], kind="stable")
        for x in range(0, len(order), 4096):
            some = order[x : x + 4096]
            got[some] = self.values([every[i] for i in some])
        return np.maximum.reduceat(got[at], first, axis=0) if len(words) else np.zeros((0, 2))

    def values(self, clean: Sequence[str]) -> np.ndarray:
        keys, weights = triples(clean)
        w = weights.astype(np.float32)[keys & 7]
        w[keys < 0] = 0
        at, norms = keys >> 3, np.maximum(_norms(keys, weights), 1e-12)
        out = np.tile(self.bias, (len(clean), 1))
        for k in (0, 1):
            if self.weight[k].any():
                out[:, k] += np.einsum("ij,ij->i", self.weight[k].take(at), w) / norms
        return out

    def empty(self) -> np.ndarray:
        return self.values([""])[0]

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return (1.0 / (1.0 + np.exp(-np.clip(self.a * np.clip(margin, -1.5, 1.5) + self.b, -30, 30)))).max(axis=-1)


#: Nothing is toxic.
NOTHING = Model(np.zeros((2, 1 << 18), np.float32), np.full(2, -1.0), np.ones(2), np.full(2, -5.0))


class _Landmarks:
    """Kernel values to the landmarks, and from a machine over them to one weight a triple."""

    def __init__(self, clean: Sequence[str]):
        keys, weights = triples(clean)
        known = np.unique(keys[keys >= 0] >> 3)
        self.place = np.full(1 << 18, len(known), dtype=np.int64)
        self.place[known] = np.arange(len(known))
        self.known = known
        self.rows = self.sparse(clean)[:, :-1]
        k = self.rows @ self.rows.T
        value, vector = np.linalg.eigh(k)
        self.root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-6))) @ vector.T

    def sparse(self, clean: Sequence[str]) -> np.ndarray:
        keys, weights = triples(clean)
        out = np.zeros((len(clean), len(self.known) + 1), dtype=np.float32)
        row = np.repeat(np.arange(len(clean)), keys.shape[1]).reshape(keys.shape)
        ok = keys >= 0
        np.add.at(out, (row[ok], self.place[keys[ok] >> 3]), weights[keys[ok] & 7])
        return out / np.maximum(_norms(keys, weights), 1e-12)[:, None].astype(np.float32)

    def features(self, clean: Sequence[str]) -> np.ndarray:
        out, root = np.zeros((len(clean), len(self.rows)), np.float32), self.root.astype(np.float32)
        for i in range(0, len(clean), 128):
            out[i : i + 128] = self.sparse(clean[i : i + 128])[:, :-1] @ self.rows.T @ root
        return out

    def weights(self, machine: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << 18)
        out[self.known] = self.rows.T @ (self.root @ machine)
        return out


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss; Newton steps on the rows inside the margin."""
    w = np.zeros(x.shape[1] + 1)
    keep = np.eye(len(w))
    keep[-1, -1] = 1e-3
    inside = None
    for _ in range(rounds):
        now = y * (x @ w[:-1] + w[-1]) < 1
        if inside is not None and (now == inside).all():
            break
        inside, a, b = now, keep.copy(), np.zeros(len(w))
        at = np.flatnonzero(inside)
        for i in range(0, len(at), 2048):  # some rows at a time, in double precision
            some = at[i : i + 2048]
            rows = np.concatenate([x[some], np.ones((len(some), 1))], axis=1, dtype=np.float64)
            weighed = rows * cost[some, None]
            a += rows.T @ weighed
            b += weighed.T @ y[some]
        w = np.linalg.solve(a, b)
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - y) * x).sum() + 0.05 * a, (p - y).sum()])
        s = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * x * x).sum() + 0.05, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def hash_of(word: str) -> int:
    return zlib.crc32(word.encode())


def _inserted(word: str, seed: int) -> str:
    at = 1 + seed % max(len(word) - 1, 1)
    return word[:at] + "abcdefghijklmnopqrstuvwxyz"[seed * 7 % 26] + word[at:]


def _distinct(bags: list[tuple[list[str], int]]) -> list[tuple[list[str], int]]:
    """One bag of each group of copies and near copies: those that share their four least word hashes."""
    known, out = set(), []
    for b, y in bags:
        key = (tuple(sorted(map(hash_of, b))[:4]), y)
        if key not in known:
            known.add(key)
            out.append((b, y))
    return out


def _bags(rows: Sequence[tuple[str, int]]) -> list[tuple[list[str], int]]:
    """The units of two letters or more of each text, of copies once; equal units are one object."""
    known: dict[str, str] = {}
    return _distinct([(sorted({known.setdefault(w, w) for x in units(t) for w in windows(letters(x)) if len(w) >= 2}), y) for t, y in rows])


def _beginnings(w: str, longest: int = 8) -> set[str]:
    """The beginnings of a word, without the word itself."""
    return {"^" + w[:n] for n in range(3, min(len(w) - 1, longest) + 1)}


def _marks(b: list[str]) -> set[str]:
    """The words of a document (``^word$``) and their beginnings (``^wor``)."""
    return {f"^{w}$" for w in b}.union(*map(_beginnings, b))


def _shared_marks(b: list[str]) -> set[str]:
    """The beginnings that two words of a document or more have."""
    first, more = set(), set()
    for w in b:
        own = _beginnings(w)
        more |= own & first
        first |= own
    return more


def _telling(bags: list[tuple[list[str], int]], marks: Callable[[list[str]], set[str]] = _marks) -> set[str]:
    """Marks that toxic documents have far oftener than clean ones.

    The test is a likelihood ratio with as many hypotheses as there are candidates.
    """

    seen: dict[str, int] = {}
    for b, y in bags:
        if y:
            for m in marks(b):
                seen[m] = seen.get(m, 0) + 1
    total = sum(1 for _, y in bags if y)
    share = min(0.95, max(total, 1) / max(len(bags), 1))
    need = np.log(len(seen) + 1) + 3
    seen = {m: n for m, n in seen.items() if -n * np.log(share) > need}
    clean = dict.fromkeys(seen, 0)
    for b, y in bags:
        if not y:
            for m in marks(b) & clean.keys():
                clean[m] += 1
    words: dict[str, dict[str, int]] = {m: {} for m in seen if m[-1] != "$"}
    for b, y in bags:
        if y:
            for w in b:
                for m in _beginnings(w) & words.keys():
                    words[m][w] = words[m].get(w, 0) + 1
    out = set()
    for m, n in seen.items():
        if m in words and (len(words[m]) < 4 or max(words[m].values()) > 0.5 * sum(words[m].values())):
            continue  # a beginning must tell by several words, not by one
        c, both = clean[m], n + clean[m]
        gain = n * np.log(n / (both * share)) + (c * np.log(c / (both * (1 - share))) if c else 0.0)
        if n / both > max(0.85, share) and gain > need:
            out.add(m)
    return out


@dataclass
class _Sizes:
    landmarks: int
    rounds: int
    negatives: int
    hardest: int


def _machine(told: dict[str, int], seen: dict[str, int], clean: dict[str, int], toxic: list[list[str]], sizes: _Sizes) -> tuple[np.ndarray, float]:
    """Weights of triples and bias: told units against clean ones, with more of both by what each round's machine says."""
    landmarks = sizes.landmarks
    below = sorted(clean, key=lambda w: (hash_of(w), w))[: sizes.negatives]
    common = sorted(clean, key=lambda w: (-clean[w], w))[: landmarks // 6]
    telling = sorted(told, key=lambda w: (-told[w], w))[: landmarks // 2]
    hard: list[str] = []
    every, more = sorted(clean), {}
    for r in range(sizes.rounds):
        marks = _Landmarks(list(dict.fromkeys([*telling, *common, *hard, *below]))[:landmarks])
        positive = told | more
        own = sorted(positive)
        near = [_inserted(w, hash_of(w) % 9973 + i) for w in own if len(w) >= 4 for i in range(2)]
        x = marks.features([*own, *near, *below])
        y = np.concatenate([np.ones(len(own) + len(near)), -np.ones(len(below))])
        cost = np.concatenate([[min(positive[w], 10.0) for w in own], np.full(len(near), 2.0), np.ones(len(below))])
        up = y > 0
        cost[up] *= 0.5 * cost[~up].sum() / cost[up].sum()
        machine, bias = _svm(x, y, cost * 10)
        weight = marks.weights(machine)
        if r + 1 < sizes.rounds:
            model = Model(np.stack([weight, 0 * weight]).astype(np.float32), np.array([bias, -1.0]), np.ones(2), np.zeros(2))
            value = dict(zip(seen, model.margins(list(seen))[:, 0], strict=True))
            more = {}
            for b in toxic:  # bags that nothing explains yet give their likeliest unit
                if not any(w in told for w in b):
                    top = max(b, key=lambda w: (value[w], w))
                    if value[top] >= 0.5 and top not in clean:
                        more[top] = seen[top]
            worst = np.argsort(-model.margins(every)[:, 0], kind="stable")[: sizes.hardest]
            hard = list(dict.fromkeys([*(every[i] for i in worst[: landmarks // 6]), *hard]))[: landmarks // 3]
            below = list(dict.fromkeys([*below, *(every[i] for i in worst)]))
    return weight, bias


def train(rows: Sequence[tuple[str, int]], landmarks: int = LANDMARKS, rounds: int = 4, *, negatives: int = NEGATIVES, hardest: int = HARDEST) -> Model:
    bags = _bags(rows)
    toxic = [b for b, y in bags if y and b]
    strong = _telling(bags)
    counted: dict[str, int] = {}
    seen: dict[str, int] = {}
    for b, y in bags:
        to = seen if y else counted
        for w in b:
            to[w] = to.get(w, 0) + 1

    def is_strong(w: str) -> bool:
        if f"^{w}$" in strong:
            return True
        n, c = seen.get(w, 0), counted.get(w, 0)
        return (c < 2 or n > 3 * c) and not strong.isdisjoint(_beginnings(w))

    clean = {w: n for w, n in counted.items() if not is_strong(w)}
    if not toxic or not clean:
        return NOTHING
    told = {w: n for w, n in seen.items() if w not in clean and is_strong(w)}
    if not told:  # too few labels for the test: the words that most toxic documents share
        rest = {w: n for w, n in seen.items() if w not in clean} or seen
        told = {w: n for w, n in rest.items() if n == max(rest.values())}
    first = _machine(told, seen, clean, toxic, _Sizes(landmarks, rounds, negatives, hardest))
    model = Model(np.stack([first[0], np.zeros(1 << 18)]).astype(np.float32), np.array([first[1], -1.0]), np.ones(2), np.full(2, -5.0))
    y = np.array([y for _, y in rows], float)
    texts = pa.array([t for t, _ in rows], pa.string())
    top = worst_units(WordRows(model.margins), model, texts)
    model.a[0], model.b[0] = _logistic(np.clip(top[:, 0], -1.5, 1.5), y)
    missed = (y == 1) & (model.probability(top) < THRESHOLD)
    if missed.sum() <= SPARED * y.sum():
        return model
    rest = _bags([row for row, m in zip(rows, missed, strict=True) if m or not row[1]])
    shared = _telling(rest, _shared_marks)
    several = {w: n for w, n in seen.items() if not shared.isdisjoint(_beginnings(w))}
    if several:
        others = {w: n for w, n in clean.items() if shared.isdisjoint(_beginnings(w))}
        second = _machine(several, seen, others, [b for b, v in rest if v and b], _Sizes(landmarks, 2, negatives, hardest))
        model.weight[1], model.bias[1] = second
        top = worst_units(WordRows(model.margins), model, texts)
        asked = missed | (y == 0)
        model.a[1], model.b[1] = _logistic(np.clip(top[asked, 1], -1.5, 1.5), y[asked])
    return model


def worst_units(store: WordRows, model: Model, texts: pa.Array) -> np.ndarray:
    """For each text the first machine's value of its worst unit, and the second's of the ``SEVERAL``-th worst distinct one."""
    out = np.tile(model.empty(), (len(texts), 1))
    several = bool(model.weight[1].any())
    for a, b in chunks(texts):
        words = split_words(texts.slice(a, b - a), LOWER_WORDS)
        at = store.look_up(words)
        own = store.rows[at]
        full = np.flatnonzero(words.counts)
        if len(full):
            out[a + full, 0] = np.maximum(out[a + full, 0], np.maximum.reduceat(own[:, 0], words.first[full]))
        known: dict[str, int] = {}
        spelled = [(d, known.setdefault(u, len(known))) for d, u in spelled_units(words)]
        values = model.margins(list(known))
        for d, u in spelled:
            out[a + d, 0] = max(out[a + d, 0], values[u, 0])
        if several and len(at):
            doc = np.concatenate([words.doc, [d for d, _ in spelled]]).astype(np.int64)
            unit = np.concatenate([at, [int(at.max()) + 1 + u for _, u in spelled]]).astype(np.int64)
            value = np.concatenate([own[:, 1], values[[u for _, u in spelled], 1]])
            hit = np.flatnonzero(value > out[0, 1])  # the others count as the empty unit
            hit = hit[np.unique(doc[hit] * (int(unit.max()) + 1) + unit[hit], return_index=True)[1]]
            hit = hit[np.lexsort((-value[hit], doc[hit]))]
            place = np.arange(len(hit)) - np.searchsorted(doc[hit], doc[hit])
            third = hit[place == SEVERAL - 1]
            out[a + doc[third], 1] = value[third]
    return out


def spelled_units(words: Words) -> Iterator[tuple[int, str]]:
    """(text, letters) of runs of three or more single letters."""
    # A letter is one code point: bytes that don't continue one are counted.
    leads = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
    single = leads[words.end] - leads[words.start] == 1
    edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
    for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if y - x < 3:
            continue
        for d in range(int(words.doc[x]), int(words.doc[y - 1]) + 1):
            i, j = max(x, int(words.first[d])), min(y, int(words.first[d + 1]))
            if j - i >= 3:
                yield d, "".join([words.data[a:b].tobytes().decode() for a, b in zip(words.start[i:j].tolist(), words.end[i:j].tolist(), strict=True)])


def score_texts(store: WordRows, model: Model, texts: pa.Array) -> np.ndarray:
    """The probability that each text is toxic."""
    return model.probability(worst_units(store, model, texts))


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Model:
    """The machine, trained by one task: the driver has the sample and the model only, and gives the rest back."""
    rows = labelled_sample(docs, labels, "toxic", modulus=HELD_MODULUS, held_out=HELD_OUT, per_class=per_class, max_chars=max_chars)
    model = on_worker(docs.sparkSession, train, rows)
    del rows
    give_back()
    return model


def with_toxicity(docs: DataFrame, model: Model, *, text_col: str = "text") -> tuple[DataFrame, str]:
    """The rows with a column of scores, and its name."""
    (name,) = fresh(docs, "toxicity")
    sent, at, key = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col), uuid.uuid4().hex

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        store = kept_rows(f"toxicity {key}", lambda: WordRows(own.margins, STORED_WORDS))
        for batch in batches:
            scores = score_texts(store, own, batch.column(at))
            yield pa.record_batch([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(lambda b: freed(score(b)), StructType([*docs.schema.fields, StructField(name, DoubleType())])), name


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored, name = with_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (F.pmod(crc32_of_id(), F.lit(HELD_MODULUS)) == HELD_OUT).alias("held_out"), F.col(name).alias("score"), (F.col(name) >= THRESHOLD).cast("int").alias("predicted"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not toxic. The machine learns from this stage's own input and the labels."""
    scored, name = with_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.where(F.col(name) < THRESHOLD).drop(name)
