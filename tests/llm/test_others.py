import collections
import itertools
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import additive_quant as A
from weftline.llm import html_extract as H
from weftline.llm import near_dup as N
from weftline.llm.components import components
from weftline.llm.html_blocks import leaf_blocks
from weftline.llm.wordhash import ALNUM_WORDS, split_words

from .helpers import ODD, clashing, table, words


def numbers(text):
    return split_words(pa.array([text]), ALNUM_WORDS).hashes().astype(np.uint32)


def slow_lcs(a, b):
    t = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, t[j + 1] = t[j + 1], prev + 1 if x == y else max(t[j + 1], t[j])
    return t[-1]


def test_alignment():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.randint(0, 5) for _ in range(rng.randint(0, 20))]
        b = [rng.randint(0, 5) for _ in range(rng.randint(0, 20))]
        assert N.aligned_words(np.array(a, np.uint32), np.array(b, np.uint32), 40) == slow_lcs(a, b)
    a, b = np.arange(30, dtype=np.uint32), np.roll(np.arange(30, dtype=np.uint32), 15)
    assert N.aligned_words(a, b, 2) == 0 and N.aligned_words(a, b, 30) == 15


def test_order_matters():
    rng = random.Random(2)
    w = words(rng, 400)
    moved = w[200:] + w[:200]
    assert N.similar(numbers(" ".join(w)), numbers(" ".join([*w, "new"])))
    assert not N.similar(numbers(" ".join(w)), numbers(" ".join(moved)))


def corpus(seed=3):
    rng = random.Random(seed)
    out = []
    for g in range(12):
        base = words(rng, rng.randint(60, 300))
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 4, 9])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 60))):
                w[rng.randrange(len(w))] = f"edit{rng.randint(0, 999)}"
            out.append(" ".join(w) if rng.random() < 0.7 else " ".join(w).upper())
        out += [out[-1]] * rng.choice([0, 0, 2])
        shared = words(random.Random(99), 50)
        out.append(" ".join(words(rng, 60) + shared + words(rng, 60)))
    out += ["one two", "one two", "One, two!", "one three", "a b c d e", "a b c d e f"]
    rng.shuffle(out)
    return [(i, t, "en", "s", 0) for i, t in enumerate(out)]


def slow_classes(data):
    head = list(range(len(data)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    w = [None if r[1] is None else numbers(r[1]) for r in data]
    for i, j in itertools.combinations(range(len(data)), 2):
        if data[i][1] is not None and data[j][1] is not None and (data[i][1] == data[j][1] or N.similar(w[i], w[j])):
            head[max(find(i), find(j))] = min(find(i), find(j))
    groups = collections.defaultdict(list)
    for i in range(len(data)):
        groups[find(i)].append(data[i][0])
    return {(r[0], min((x for x in groups[find(i)] if x is not None), default=None)) for i, r in enumerate(data)}


def test_near_dup(spark):
    data = [*corpus(), *ODD]
    data.append(data[0])
    df = clashing(table(spark, data))
    got = N.near_dup_classes(df).collect()
    assert len(got) == len(data) and {(r.doc_id, r.class_id) for r in got} == slow_classes(data)
    kept = N.near_dup_stage(spark, df, "")
    assert kept.columns == df.columns
    want = {c for _, c in slow_classes(data) if c is not None}
    ids = [r.doc_id for r in kept.collect()]
    assert collections.Counter(x for x in ids if x is not None) == collections.Counter(want) and ids.count(None) == 1
    assert N.near_dup_classes(table(spark, [])).count() == 0


def test_near_dup_template_family(spark):
    """Planted pairs just above 0.8 among texts that share a template: each is found, whatever the hot buckets hold."""
    rng = random.Random(8)
    template = words(rng, 192)
    texts = []
    for _ in range(200):
        own = template + words(rng, 28)
        texts += [own, own[:198] + words(rng, 18) + own[216:]]
    hashed = [numbers(" ".join(t)) for t in texts]
    want = [N.similar(hashed[i], hashed[i + 1]) for i in range(0, len(texts), 2)]
    assert all(want) and not any(N.similar(hashed[0], h) for h in hashed[2:])
    got = {r.doc_id: r.class_id for r in N.near_dup_classes(table(spark, [(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)])).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}


def test_prefix_filter_is_exact(spark):
    """Pairs of the exact step contain all pairs of a multiset Jaccard similarity of 0.8 or more."""
    rng = random.Random(5)
    vocabulary, texts = words(rng, 12), []
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(4, 60))]
        for _ in range(3):
            t = list(base)
            for _ in range(rng.randint(0, 1)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts.append(t + [rng.choice(vocabulary) for _ in range(rng.randint(0, 1))])
    hashed = [numbers(" ".join(t)) for t in texts]
    ids = [i.to_bytes(4, "big") for i in range(len(texts))]
    df = spark.createDataFrame([(bytearray(i), bytearray(i), bytearray(h.tobytes())) for i, h in zip(ids, hashed, strict=True)], "cid binary, root binary, words binary")
    got = {frozenset((bytes(r.cid), bytes(r.rep))) for r in N._rest(df).collect()}
    sets = [N.shingles(h.astype(np.uint64)) for h in hashed]
    want = {frozenset((ids[i], ids[j])) for i in range(len(ids)) for j in range(i) if N._multiset_jaccard(sets[i], sets[j]) >= N.SIMILARITY}
    assert len(want) > 50 and want <= got


def test_near_dup_stage_with_repeated_ids(spark):
    a, b = " ".join(words(random.Random(1), 40)), " ".join(words(random.Random(2), 40))
    data = [(5, a, "en", "s", 0), (5, b, "en", "s", 0), (5, a, "en", "s", 0), (6, b.upper(), "en", "s", 0), (7, a, "en", "s", 0)]
    kept = N.near_dup_stage(spark, table(spark, data), "").collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(5, a), (5, b)])


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(1000, i) for i in range(1001, 1100)]
    head = {}

    def find(x):
        head.setdefault(x, x)
        while head[x] != x:
            x = head[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            head[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in head}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_leave_no_files(spark):
    """Shuffle files and the tables of past rounds go at once; the setting for that is not left in the session."""
    disk, sc = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), spark.sparkContext
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def kept():
        found = {x for x in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
        folder = sc._jsc.sc().getCheckpointDir()
        where = sc._jvm.org.apache.hadoop.fs.Path(folder.get()) if folder.isDefined() else None
        return found, {x.getPath().getName() for x in where.getFileSystem(sc._jsc.hadoopConfiguration()).listStatus(where)} if where else set()

    (shuffles, tables), setting = kept(), spark.conf.get(key, None)
    got = components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"))
    for _ in range(50):
        if not kept()[0] - shuffles:
            break
        time.sleep(0.2)
    left = kept()
    assert not left[0] - shuffles and len(left[1] - tables) == 1
    assert spark.conf.get(key, None) == setting
    assert {(r.node, r.root) for r in got.collect()} == {(i, 0) for i in range(41)}


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_nearest(spark, metric):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(10, 16))
    x = (centres[rng.integers(0, 10, 1200)] + 0.4 * rng.normal(size=(1200, 16))).astype(np.float32)
    x[7] = x[8]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2020, [0.0] * 16), (2040, [None] + [1.0] * 15), (2060, [float("nan")] * 16), (2080, [float("inf")] * 16), (2100, [1.0, 2.0]), (None, [1.0] * 16)]
    df = clashing(spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3))
    got = collections.defaultdict(list)
    for r in A.nearest(df, df.where("vec_id % 20 = 0"), metric=metric, rerank=150, query_block=25, row_block=100).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    y = x.astype(np.float64)
    recall = []
    assert set(got) == set(range(0, 1200, 20))
    for q, found in got.items():
        s = (y * y[q]).sum(axis=1) if metric == "ip" else -((y - y[q]) ** 2).sum(axis=1)
        assert all(s[i] == v for i, v in found) and len(found) == 20
        assert found == sorted(found, key=lambda z: (-z[1], z[0]))
        s[q] = -np.inf
        recall.append(len({i for i, _ in found} & set(np.lexsort((np.arange(1200), -s))[:20].tolist())) / 20)
    assert np.mean(recall) >= 0.95


def test_nearest_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    got = [(r["rank"], r.vec_id, r.score) for r in A.nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 1, 0.5), (2, 2, 0.5)]
    assert A.nearest(df.limit(0), df.limit(0)).count() == 0


def test_nearest_does_not_depend_on_blocks(spark):
    """The same answer for any partitions and blocks, with far fewer rows reranked than a block holds."""
    x = np.random.default_rng(8).normal(size=(900, 8)).astype(np.float32)
    x[100:130] = x[99]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    ask, got = df.where("vec_id % 20 = 0"), []
    for parts, blocks in ((1, {}), (8, {"row_block": 70, "query_block": 7}), (3, {"row_block": 901, "query_block": 11})):
        got.append(sorted(tuple(r) for r in A.nearest(df.repartition(parts), ask, rerank=25, **blocks).collect()))
    assert got[0] == got[1] == got[2] and len(got[0]) == 45 * 20


def test_nearest_repeated_ids(spark):
    """Each row is a candidate and a query; a query leaves out one row with its id and vector."""
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.9, 0.1]), (1, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id, r.score) for r in A.nearest(df, df.where("vec_id = 0 AND embedding[0] = 1")).collect())
    assert got == [(1, 0, 1.0)] * 2 + [(2, 0, 0.9)] * 2 + [(3, 1, 0.5)] * 2
    hot = spark.createDataFrame([(7, [1.0, 0.0])] * 3000 + [(i, [0.0, 1.0]) for i in range(20)], "vec_id long, embedding array<double>")
    got = A.nearest(hot, hot.where("vec_id = 0"), row_block=100).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, 20)) + [7]


FIELD = H.train(H.labelled_pages())


def test_field_on_held_out_pages():
    right = total = 0
    for page in H.labelled_pages(150, seed=123):
        blocks = leaf_blocks(page)
        truth = [b.content for b in blocks]
        for b in blocks:
            b.context -= {"x-mark"}
            b.tag = "div" if b.tag == "x-mark" else b.tag
        right += sum(x == y for x, y in zip(FIELD.decode(blocks), truth, strict=True))
        total += len(blocks)
    assert right / total > 0.98


def test_viterbi_is_the_best_path():
    for page in H.labelled_pages(30, seed=5):
        blocks = leaf_blocks(page)[:9]
        if not blocks:
            continue
        last = max(len(blocks) - 1, 1)
        e = [sum(FIELD.weights.get(f, 0.0) for f in [*b.context, *H.block_features(b, i / last)]) for i, b in enumerate(blocks)]
        value = lambda y: sum(s if v else -s for s, v in zip(e, y)) + sum(FIELD.steps[int(a)][int(b)] for a, b in itertools.pairwise(y))
        best = max(value(y) for y in itertools.product((False, True), repeat=len(blocks)))
        assert value(FIELD.decode(blocks)) == pytest.approx(best)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<nav><ul><li><a href=x>Home</a></ul></nav><article><h1>Title &amp; more</h1><p><b>One  two<br>three<p>Four.</article><footer>&copy; x</footer>", "Title & more One two three Four."),
        ("<html><head><title>no</title><style>p{}</style></head><body><main><p>In <i>li</i>ne text, and more of it.</p><script>var a='<p>x</p>';</script><form><p>Sign up now</p></form></main></body>", "In line text, and more of it."),
        ("<article><p>Body text, long enough to be read.</p></article><div class=comments><div class=comment><p>Reader says a lot here, too.</p></div></div>", "Body text, long enough to be read."),
        ('<article><p>Price 3&lt;4&#x20;ok&nbsp;then, yes.</p><!-- hidden <p>no</p> --><aside><p>Other stories</p></aside></article>', "Price 3<4 ok then, yes."),
        ("<article><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math>, as we know it.</p></article>", "Energy is E=m, as we know it."),
        ("<article><p>And if a <b or c <d then more, I say.</p></article>", "And if a <b or c <d then more, I say."),
        ("<article><p>See <object data=x>the picture</object> and <svg><title>no</title><path d=''/></svg>read on, please.</p></article>", "See the picture and read on, please."),
        ("<article><p>Before it, some words.</p><div><select><option>one</div><p>After it, more words.</p></article>", "Before it, some words. After it, more words."),
        ("", ""), (None, ""), ("<nav>menu</nav>", ""), ("<div class=cookie-notice><p>We use cookies here.</p></div>", ""),
    ],
)
def test_pages(page, text):
    assert H.main_text(page, FIELD) == text


@pytest.mark.parametrize("page", ["<a " * 1_300_000, "if a <b or c <d then " * 200_000 + "</p>", '<a b="' * 600_000 + ">", "<a b='x\" " * 400_000, "<!" * 2_000_000, "<!--" * 1_000_000, "<p><div>" + "<x>" * 20_000 + "<pre></pre>" * 20_000, "<p>" * 300_000, "<script>" * 400_000, "<select>" * 100_000 + "x"])
def test_markup_takes_linear_time(page):
    began = time.perf_counter()
    leaf_blocks(page)
    assert time.perf_counter() - began < 5


def test_odd_markup_ends(spark):
    for page in ("<" * 1000, "<p" * 500, '<a title="' * 300, "<div>" * 3000 + "x" + "</p>" * 3000, "<!--", "<script>", "</p></div>x", "<p>a<p>b</x><p/>"):
        leaf_blocks(page)
    pages = [(1, "u", None), (2, None, ""), (2, None, ""), (3, "u", "<article><p>Some words, and some more.</p></article>")]
    got = H.extract(clashing(spark.createDataFrame(pages, "page_id long, url string, html string"))).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == [(1, "", 0), (2, "", 0), (2, "", 0), (3, "Some words, and some more.", 26)]
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
