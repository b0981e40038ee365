import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weftline.llm import language_id as L
from weftline.llm import quality as Q
from weftline.llm import toxicity as T
from weftline.llm.hashnumbers import HashNumbers, WordRows
from weftline.llm.labels import fold, labelled_sample

from .helpers import DOCS, clashing, table

PLAIN = "the river runs over stones and under bridges while people walk along it every morning with their dogs".split()


def sentences(seed, n, bad=()):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = [rng.choice(PLAIN) + rng.choice(["", "s", "ed", "er"]) for _ in range(rng.randint(5, 40))]
        y = int(bool(bad) and i % 2 == 0)
        if y:
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        out.append((" ".join(w), y))
    return out


def slow_kernel(a, b):
    """Sum over common triples within the span, by definition."""
    def feats(s):
        s = "^" + s + "$"
        out = {}
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + T.SPAN)):
                    out[s[i] + s[j] + s[k]] = out.get(s[i] + s[j] + s[k], 0) + T.DECAY ** (k - i + 1)
        return out

    x, y = feats(a), feats(b)
    dot = lambda p, q: sum(v * q.get(u, 0) for u, v in p.items())
    return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))


def test_kernel_by_definition():
    units = ["idiot", "idixot", "banana", "aaaaaa", "a"]
    marks = T._Landmarks(units)
    assert np.allclose(marks.rows @ marks.rows.T, [[slow_kernel(a, b) for b in units] for a in units], atol=1e-5)
    machine = np.arange(1.0, 6.0)
    direct = marks.features(units) @ machine + 0.5
    both = np.stack([marks.weights(machine), marks.weights(-machine)]).astype(np.float32)
    model = T.Model(both, np.array([0.5, 0.0]), np.ones(2), np.zeros(2))
    assert np.allclose(model.margins(units), np.stack([direct, 0.5 - direct], axis=1), atol=1e-4)


def test_toxicity_held_out():
    bad = ["nitwit", "blockhead", "scoundrel", "numbskull"]
    model = T.train(sentences(1, 400, bad))
    clean = [t for t, _ in sentences(2, 100)]
    store = WordRows(model.margins, 64)
    assert (T.score_texts(store, model, pa.array(clean)) < 0.5).mean() >= 0.98
    nasty = ["you are a nitwit today", "you are a n-i-t-w-i-t today", "b l o c k h e a d goes along", "what a scoundXrel they are", "NUMBSKULL!"]
    assert (T.score_texts(store, model, pa.array(nasty)) > T.score_texts(store, model, pa.array(clean)).max()).all()
    odd = T.score_texts(store, model, pa.array([None, "", "123 ...", "x" * 3000, "a " * 5000, "nitwit " * 2000]))
    assert ((odd >= 0) & (odd <= 1)).all() and odd[0] == odd[1] == odd[2] and odd[5] > 0.5


@pytest.mark.parametrize("text", ["b l ö d", "d é b i l e", "д у р а к", "x b l o c k y", "Ö d e r", "so ö d", "笨 蛋 人 𝒳"])
def test_spelled_units_count_letters(text):
    """Scoring joins the same runs of single letters as training, whatever a letter's bytes."""
    got = [u for _, u in T.spelled_units(T.split_words(pa.array([text]), T.LOWER_WORDS))]
    assert [u.lower() for u in got] == [u.lower() for u in T.units(text)[len(text.split()):]]


@pytest.mark.parametrize("n", [1, T.LONGEST, T.LONGEST + 1, 5 * T.LONGEST + 3])
def test_long_words_are_read_in_windows(n):
    """Fitting and scoring see the same units of a long word, from its first to its last letter."""
    word = "".join(chr(97 + i % 26) for i in range(n))
    got = T.windows(word)
    assert got[0] == word[: T.LONGEST] and got[-1] == word[-T.LONGEST :] and all(len(u) <= T.LONGEST for u in got)
    assert all(any(word[i : i + T.LONGEST // 2] in u for u in got) for i in range(n))
    model = T.train(sentences(1, 200, ["nitwit", "blockhead"]))
    assert np.allclose(model.margins([word])[0], model.margins(got).max(axis=0))


def test_run_of_one_letter_is_scored_whole():
    model = T.train(sentences(1, 400, ["nitwit", "blockhead"]))
    store = WordRows(model.margins, 64)
    run = "a" * 3000 + "nitwit" + "a" * 3000
    got = T.worst_units(store, model, pa.array([" ".join(run), "a " * 6000, run]))
    assert np.allclose(got[0, 0], max(model.margins(T.windows(run))[:, 0].max(), model.margins(["a"])[0, 0]))
    assert np.allclose(got[2, 0], model.margins(T.windows(run))[:, 0].max()) and got[0, 0] > got[1, 0]


def test_toxicity_without_labels():
    assert T.train([]).probability(np.array([0.0])) < 0.1
    assert T.train([("a b c", 0)]).probability(np.array([0.0])) < 0.1


def test_language():
    en, de = ["the house and the garden were green"] * 5, ["das haus und der garten waren schön"] * 5
    model = L.train([(t, "en") for t in en] + [(t, "de") for t in de])
    store = WordRows(model.rows, 8)
    got, score = L.predict(store, model, pa.array(["the green garden", "Der schöne Garten", None, "", "12 ! ² ½ _", "the " * 5000]))
    assert got == ["en", "de", "und", "und", "und", "en"] and ((score >= 0) & (score <= 1)).all()
    assert L.predict(WordRows(L.train([]).rows), L.train([]), pa.array(["x"]))[0] == ["und"]


def test_language_rows_by_definition():
    model = L.train([("abc ab", "x"), ("xyz", "y")])
    got = model.rows(["ab"])[0]
    bucket, _ = L.gram_buckets(["ab"])
    assert len(bucket) == 4 + 3 + 2 + 1 and np.allclose(got[1:], model.log_p[bucket].sum(axis=0))


def test_quality_held_out():
    good = [(t, 1) for t, _ in sentences(3, 200)]
    rng = random.Random(4)
    junk = [(" ".join([rng.choice(PLAIN)] * rng.randint(20, 60)), 0) for _ in range(100)] + [(" ".join(w.upper() + "!!" for w in t.split()), 0) for t, _ in sentences(5, 100)]
    model = Q.train(good + junk, share=0.8)
    p = lambda ts: model.probability(Q.pool(WordRows(model.rows, 64), pa.array(ts)))
    assert (p([t for t, _ in sentences(6, 50)]) > 0.7).mean() > 0.95
    assert (p(["river " * 40, "WHAT!! A!! DEAL!! FOR!! YOU!! NOW!! BUY!! IT!!"]) < 0.7).all()
    odd = p([None, "", "x" * 4000])
    assert odd[0] == odd[1] and ((odd >= 0) & (odd <= 1)).all()
    assert Q.train([("a", 1)]).probability(np.zeros((1, Q.DIMENSIONS + 3)))[0] > 0.9


def test_hash_numbers():
    rng = np.random.default_rng(3)
    t, known = HashNumbers(1 << 12), {}
    for _ in range(20):
        h = rng.integers(0, 5000, 300).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        new = np.unique(h[t.find(h) < 0])
        new = np.unique(np.where(new == 0, np.uint64(1), new))
        for x in new.tolist():
            known[x] = len(known)
        t.add(new)
        assert t.find(h).tolist() == [known[x or 1] for x in h.tolist()]


def labelled(spark):
    docs = [(i, t, "en" if y else "de", "s", 0) for i, (t, y) in enumerate(sentences(7, 120, ["nitwit", "blockhead"]))] + [(500, None, None, "s", 0), (None, "no id", None, "s", 0)]
    labels = [(i, 1 - i % 2, int(i % 2 == 0)) for i in range(120)] + [(None, 1, 1), (7777, 0, 1)]
    return clashing(table(spark, docs, DOCS)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows_are_not_learned(spark):
    docs, labels = labelled(spark)
    got = labelled_sample(docs, labels, "toxic", modulus=3, held_out=1, per_class=1000, max_chars=10_000)
    texts = {r.text: r.doc_id for r in docs.collect()}
    assert got and all(fold(texts[t], 3) != 1 for t, _ in got)
    assert len(labelled_sample(docs, labels, "toxic", modulus=3, held_out=1, per_class=5, max_chars=10_000)) == 10
    assert fold(12, 3) == zlib.crc32(b"12") % 3


@pytest.mark.parametrize("op", ["op3", "op5", "op10", "stage"])
def test_operators(spark, op):
    docs, labels = labelled(spark)
    if op == "op3":
        out, name = T.with_toxicity(docs, T.fit(docs, labels))
    elif op == "op5":
        out, _, name = L.with_language(docs, L.fit(docs))
    elif op == "op10":
        out, name = Q.with_quality(docs, Q.fit(docs, labels))
    else:
        out, _ = T.with_toxicity(docs, T.fit(docs, labels.where("false")))
        assert out.count() == docs.count()
        return
    rows = out.collect()
    assert len(rows) == 122 and all(0 <= r[name] <= 1 for r in rows) and set(docs.columns) < set(out.columns)
    assert out.limit(0).count() == 0


def test_toxicity_is_fitted_by_a_worker(spark, monkeypatch):
    """The driver trains nothing, and the machine is the one that its own process would get."""
    docs, labels = labelled(spark)
    rows = labelled_sample(docs, labels, "toxic", modulus=T.HELD_MODULUS, held_out=T.HELD_OUT, per_class=T.PER_CLASS, max_chars=T.MAX_CHARS)
    own = T.train(rows)
    monkeypatch.setattr(T, "_machine", lambda *_: pytest.fail("trained by the driver"))
    got = T.fit(docs, labels)
    assert own.weight.any()
    assert all(np.allclose(getattr(got, k), getattr(own, k), atol=1e-4) for k in ("weight", "bias", "a", "b"))


def _folded(target, modulus, held_out):
    """(text, value, held out) of sf0.1's labelled documents."""
    folder = "/root/testdata/sf0.1"
    docs = pq.read_table(f"{folder}/documents.parquet").to_pylist()
    known = {r["doc_id"]: r[target] for r in (docs if target == "lang" else pq.read_table(f"{folder}/labels.parquet").to_pylist())}
    rows = [(r["text"], known[r["doc_id"]], fold(r["doc_id"], modulus) == held_out) for r in docs if r["text"] is not None and known.get(r["doc_id"]) is not None]
    return [(t, y) for t, y, h in rows if not h and len(t) <= T.MAX_CHARS], [(t, y) for t, y, h in rows if h]


def test_toxicity_of_held_out_documents():
    """About one label in twenty is wrong in these tables."""
    known, apart = _folded("toxic", T.HELD_MODULUS, T.HELD_OUT)
    model = T.train(known)
    p, y = T.score_texts(WordRows(model.margins), model, pa.array([t for t, _ in apart])), np.array([y for _, y in apart])
    assert (p[y == 1] >= T.THRESHOLD).mean() >= 0.9 and (p[y == 0] >= T.THRESHOLD).mean() <= 0.02


def test_language_of_held_out_documents():
    known, apart = _folded("lang", L.HELD_MODULUS, L.HELD_OUT)
    model = L.train(known[:3000])
    got, _ = L.predict(WordRows(model.rows), model, pa.array([t for t, _ in apart]))
    assert np.mean([x == y or x == "und" for x, (_, y) in zip(got, apart, strict=True)]) >= 0.99


def test_quality_of_held_out_documents():
    known, apart = _folded("quality", Q.HELD_MODULUS, Q.HELD_OUT)
    model = Q.train(known)
    p, y = model.probability(Q.pool(WordRows(model.rows, 1 << 16), pa.array([t for t, _ in apart]))), np.array([y for _, y in apart])
    assert ((p >= 0.5) == (y == 1)).mean() >= 0.95 and np.mean(p[y == 1][:, None] > p[y == 0][None, :]) >= 0.97


def test_samples_are_bounded_by_rows(spark):
    """100,000 rows without id, one id 100,000 times: the driver gets no more rows than the bound."""
    text, doc = F.concat(F.lit("the garden is green "), F.col("id")), F.lit("en")
    many = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), text.alias("text"), doc.alias("lang"))
    many = many.unionByName(spark.range(100_000).select(F.lit(8).cast("long").alias("doc_id"), F.lit("das haus").alias("text"), F.lit("de").alias("lang")))
    many = many.unionByName(spark.range(50_000).select(F.lit(9).cast("long").alias("doc_id"), text.alias("text"), doc.alias("lang")))
    labels = spark.createDataFrame([(8, 1, 1), (9, 0, 0), (9, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = labelled_sample(many, labels, "toxic", modulus=3, held_out=1, per_class=40, max_chars=1000)
    assert sorted(y for _, y in got) == [0] * 40 + [1]
    sizes = []
    train, L.train = L.train, lambda rows, counts=None: sizes.append((len(rows), counts)) or train(rows, counts)
    try:
        model = L.fit(many, per_language=60)
    finally:
        L.train = train
    assert sizes == [(61, {"en": 150_000, "de": 100_000})] and model.languages == ["de", "en"]


def test_many_languages():
    """No language is left out; the matrix stays within its bytes."""
    rows = [(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}", f"l{i:04}") for i in range(1500)]
    model = L.train(rows)
    assert len(model.languages) == 1500 and model.log_p.nbytes <= L.MATRIX_BYTES
    got, _ = L.predict(WordRows(model.rows, 64), model, pa.array([rows[i][0] for i in (0, 700, 1499)]))
    assert got == ["l0000", "l0700", "l1499"]
