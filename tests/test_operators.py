import itertools
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.operators import context, decide, lexicon, metrics, models, retrieval
from weftline.operators.features import pair_features, prepare, soft_tfidf
from weftline.sources import records
from weftline.sources.synthetic import Generator
from weftline.streaming.live import resolve_stream


def slow_curve(p, most=12):
    out = []
    for k in range(min(len(p), most) + 1):
        total = 0.0
        for hits in itertools.product((0, 1), repeat=len(p)):
            q = np.prod([x if h else 1 - x for x, h in zip(p, hits)])
            x, n = sum(hits[:k]), sum(hits)
            total += q * ((n == 0) if k == 0 else 1.25 * x / (k + 0.25 * n))
        out.append(total)
    return out


@pytest.mark.parametrize(("p", "k"), [([0.97, 0.10, 0.05], 1), ([0.95, 0.91, 0.08], 2), ([0.22, 0.15, 0.09], 0), ([0.55, 0.12], 1)])
def test_choose_sets(spark, p, k):
    rows = spark.createDataFrame([(1, j, x) for j, x in enumerate(p)], "i int, j int, p double")
    got = decide.choose_sets(rows).first()
    assert got.k == k and got.ids == list(range(k))
    assert np.allclose(decide._curve(np.array(p), 12), slow_curve(p))
    curve = decide.candidate_lists(rows).select(decide.expected_f_curve(F.col("ps"))).first()[0]
    assert np.allclose(curve, slow_curve(p))


def test_review_prefers_doubt():
    assert decide.review_value(np.array([0.5]))[0] > decide.review_value(np.array([0.99]))[0] >= 0
    assert decide.review_value(np.array([])) == (0.0, -1)


def test_exclusive(spark):
    rows = spark.createDataFrame([(1, 1, 0.8), (2, 2, 0.8), (3, 2, 0.8)], "i int, j int, p double")
    q = {r.i: r.q for r in decide.exclusive(rows).collect()}
    assert q[1] == pytest.approx(0.8) and q[2] < 0.8 and q[2] + q[3] <= 1


def test_scores(spark):
    u = spark.createDataFrame([("a",), ("b",)], "i string")
    none = spark.createDataFrame([], "i string, j string")
    truth = spark.createDataFrame([("b", "x")], "i string, j string")
    assert metrics.score(u, none, truth).first().macro_f == 0.5
    one = spark.createDataFrame([("a",)], "i string")
    pred = spark.createDataFrame([("a", x) for x in ("S2-00047", "S2-00193", "S3-00812")], "i string, j string")
    real = spark.createDataFrame([("a", x) for x in ("S2-00047", "S3-00812")], "i string, j string")
    assert metrics.score(one, pred, real).first().macro_f == pytest.approx(0.7143, abs=1e-4)
    assert metrics.score(one, pred, none).first().macro_f == 0.0


def test_mining(spark):
    pairs = spark.createDataFrame([("12 Main Rd", "12 Main Road")] * 6 + [("Acme Sons", "Acme Solutions")], "a string, b string")
    assert [(r.short, r.long) for r in lexicon.mine_abbreviations(pairs).collect()] == [("rd", "road")]
    names = spark.createDataFrame([(["acme", "private", "limited"],), (["zen", "limited"],), (["orbit", "private", "limited"],)] * 200, "t array<string>")
    assert lexicon.mine_tails(names) == {"private", "limited"}
    links = spark.createDataFrame([("US", "USA", 0.9)] * 6 + [("US", "FR", 0.9)], "a string, b string, sim double")
    volumes = spark.createDataFrame([("US", 100), ("USA", 20), ("FR", 50)], "label string, n int")
    assert lexicon.country_groups(links, volumes) == {"US": "US", "USA": "US", "FR": "FR"}
    near = spark.createDataFrame([("12 x road, opp temple gate", "12 x road")] * 20, "a string, b string")
    assert "opp" in lexicon.mine_landmark_cues(near)


def test_soft_tfidf():
    idf = {"harbor": 3.0, "bd": 1.5, "boulevard": 2.5}
    score, a, b = soft_tfidf({w: idf[w] for w in ("harbor", "bd")}, {w: idf[w] for w in ("harbor", "boulevard")})
    assert score > 0.9 and a == b == 0.0
    assert soft_tfidf({}, {"x": 2.0}) == soft_tfidf({"x": 2.0}, {}) == (0.0, 0.0, 0.0)
    # both words of a take the same word of b, so the other one that is like them stays unmet
    assert soft_tfidf({"marta": 1.0, "marha": 1.0}, {"martha": 1.0, "zzz": 2.0})[1:] == (0.0, 2.0)


def test_pair_features_by_hand(spark):
    """Divisors and defined values of the features of one pair, and of one without any word in common."""
    rows = [("S1-1", "Acme Foods Zebra Ltd", "12 Main Road, Indore, 452001", "IN"), ("S2-1", "Acme Food Limited", "12 Main Rd, Indore", "IN"), ("S3-1", "", "", "")]
    r = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string").withColumn("src", F.substring("entity_id", 2, 1).cast("int"))
    p = prepare(r, {"rd": "road"}, {"ltd", "limited"})
    pool = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S3-1")], "i string, j string")
    got = {x.j: x.asDict() for x in pair_features(pool, p).collect()}
    idf = lambda n: np.log(4 / (n + 1)) + 1
    one = got["S2-1"]
    assert one["n_miss_a"] == one["id_miss_a"] == 1 and one["n_miss_b"] == 0 and one["a_miss_a"] == 0  # zebra; ltd and food are short forms
    core = (idf(2) ** 2 + 0.9 * idf(1) ** 2) / np.sqrt((idf(2) ** 2 + 2 * idf(1) ** 2) * (idf(2) ** 2 + idf(1) ** 2))
    assert one["c_soft"] == pytest.approx(core) and one["name_x_addr"] == pytest.approx(core * one["a_soft"])
    assert (one["country_label"], one["country_grp"], one["first_eq"], one["house_state"]) == (1, 2, 1, 2)
    none = got["S3-1"]
    assert all(none[c] == 0 for c in ("n_soft", "n_miss_a", "n_miss_b", "a_miss_a", "first_eq", "acr_hit", "country_label", "country_grp", "num_jacc"))
    assert none["tail_jacc"] == -1 and none["pc_state"] == 1


def test_margins_alone(spark):
    rows = spark.createDataFrame([(1, 1, 0.4), (2, 1, 0.9), (2, 2, 0.9)], "i int, j int, p double")
    assert {(r.i, r.j): r.ctx_margin_i for r in context.margins(rows).collect()} == {(1, 1): 0.4, (2, 1): 0.0, (2, 2): 0.0}


def test_retrieval_matches_matrix(spark):
    texts = {("a", 1): "x y", ("b", 2): "x y z", ("c", 2): "z z", ("d", 1): "z"}
    docs = spark.createDataFrame([(i, s, t.split()) for (i, s), t in texts.items()], "id string, src int, terms array<string>")
    words = sorted({w for t in texts.values() for w in t.split()})
    tf = np.array([[t.split().count(w) for w in words] for t in texts.values()], float)
    df = (tf > 0).sum(0)
    m = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * (np.log(5 / (1 + df)) + 1)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    names = [k[0] for k in texts]
    got = {(r.i, r.j): r.sim for r in retrieval.cosine_pairs(retrieval.postings(docs)).collect()}
    for (i, j), sim in got.items():
        assert sim == pytest.approx((m @ m.T)[names.index(i), names.index(j)])
    assert set(got) == {("a", "b"), ("d", "b"), ("d", "c")}


def test_best_pairs_by_blocks(spark):
    """The best of either side are those of all pairs that a join on the term makes, whatever the blocks."""
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(f"r{i:03}", 1 + i % 3, [f"t{x}" for x in rng.zipf(1.5, rng.integers(0, 12)) if x < 50]) for i in range(120)], "id string, src int, terms array<string>")
    p = retrieval.postings(docs)
    every = retrieval.cosine_pairs(p)
    rank = lambda df, by, o, k: {(r.i, r.j, r["rank"], round(r.sim, 9)) for r in retrieval.top_k(df, by, o, k).collect()}
    for block, terms in ((7, 3), (1024, 4096)):
        got = retrieval.cosine_best(p, 4, 2, block=block, terms_at_once=terms)
        assert rank(got, "i", "j", 4) == rank(every, "i", "j", 4) and rank(got, "j", "i", 2) == rank(every, "j", "i", 2)
    assert retrieval.cosine_best(p.limit(0), 4, 2).count() == 0 == retrieval.cosine_best(p.where("src = 1"), 4, 2).count()
    assert retrieval.cosine_best(p, 1 << 30, 0).count() == every.count()


def test_dense_search_by_blocks(spark):
    """The same neighbours whatever the blocks, ties by id."""
    x = np.random.default_rng(2).integers(-3, 4, size=(90, 4)).astype(float)
    x[x.any(axis=1) == False] = 1.0  # noqa: E712
    df = spark.createDataFrame([(i, 1 + i % 3, v.tolist()) for i, v in enumerate(x)], "id long, src int, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j, r + 1) for i in range(0, 90, 3) for r, j in enumerate(sorted((j for j in range(90) if j % 3), key=lambda j: (-round(u[i] @ u[j], 9), j))[:5])}
    for block in (7, 4096):
        assert {(r.i, r.j, r["rank"]) for r in retrieval.dense_top_k(df, 5, block=block).collect()} == want
    assert retrieval.dense_top_k(df.where("src = 1"), 5).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "s.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\textra\nS1-1\t "NA" x\t\tIN\tz\nS2-2\tNA\t a \tFR\tz\n')
    got = {r.entity_id: (r.business_name, r.business_address, r.src) for r in records.with_source(records.read_source(spark, str(tmp_path / "s.tsv"))).collect()}
    assert got == {"S1-1": ('"NA" x', "", 1), "S2-2": ("NA", "a", 2)}
    with pytest.raises(ValueError, match="missing"):
        records.clean_records(spark.createDataFrame([(1,)], "entity_id int"))
    (tmp_path / "t.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-2, S3-4 ,\nS1-2\t\n")
    universe, links = records.read_truth(spark, str(tmp_path / "t.tsv"))
    assert universe.count() == 2 and {tuple(r) for r in links.collect()} == {("S1-1", "S2-2"), ("S1-1", "S3-4")}
    lists = records.pair_lists(universe, links)
    assert {tuple(r) for r in lists.collect()} == {("S1-1", "S2-2,S3-4"), ("S1-2", "")}
    records.write_pairs(str(tmp_path / "out"), lists)
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert text == "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-2,S3-4\nS1-2\t\n"
    records.save_lexicon(str(tmp_path / "l.json"), {"rd": "road"}, {"ltd"}, {"near"})
    assert records.load_lexicon(str(tmp_path / "l.json")) == ({"rd": "road"}, {"ltd"}, {"near"})


def test_written_splits_are_read_again(spark, tmp_path):
    made, links = Generator(4).frames(spark, 25)
    Generator(4).write(spark, str(tmp_path), "train", 25)
    one, rest = records.load_split(spark, str(tmp_path), "train")
    key = lambda df: sorted(tuple(r) for r in df.select(*records.COLUMNS).collect())
    assert key(one) + key(rest) == key(records.clean_records(made).where("entity_id like 'S1%'")) + key(records.clean_records(made).where("entity_id not like 'S1%'"))
    universe, truth = records.read_truth(spark, str(tmp_path / "train_ground_truth.tsv"))
    assert universe.count() == 25 and {tuple(r) for r in truth.collect()} == {tuple(r) for r in links.collect()}


def test_given_order_of_entities_is_kept(spark, tmp_path):
    universe = spark.createDataFrame([(0, "S1-9"), (1, "S1-1"), (2, "S1-5")], "pos int, s1 string")
    lists = records.pair_lists(universe, spark.createDataFrame([("S1-1", "S2-3")], "s1 string, r string"))
    records.write_pairs(str(tmp_path / "out"), lists.repartition(3))
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert text == "source1_entity_id\tmatched_entity_ids\nS1-9\t\nS1-1\tS2-3\nS1-5\t\n"


def test_lines_of_result_files(spark):
    head = ("source1_entity_id", "matched_entity_ids")
    lines = ["\t".join(head), "S1-1\tS2-1,S3-2", "S1-2\t", "S1-3\tS4-1", "S1-4", 'S1-5\t"S2-1"', "S1-6\tS2-1, S2-2", ""]
    got = {r.problem: (r.level, r.n) for r in records.check_lines(spark.createDataFrame([(x,) for x in lines], "value string"), head).collect()}
    assert got == {"no header": ("error", 0), "header with commas": ("error", 0), "not two columns": ("error", 2), "id without a known prefix": ("error", 2), "quotes": ("warning", 1), "spaces around ids": ("warning", 1), "empty line": ("warning", 1)}
    got = {r.problem: r.n for r in records.check_lines(spark.createDataFrame([(",".join(head),), ("S1-1\tS2-1",)], "value string"), head).collect()}
    assert got["no header"] == got["header with commas"] == 1


@pytest.mark.parametrize("kind", ["gbt", "logistic"])
def test_attributions_add_up(spark, kind):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    rows = [(*map(float, v), float(v[0] + 0.5 * v[1] > 0), k % 2) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, fold int")
    scored, fitted = models.cross_fit(df, ["a", "b", "c"], kind=kind, **({"rounds": 5, "depth": 3} if kind == "gbt" else {}))
    for r in models.bagged(df.limit(5), ["a", "b", "c"], fitted[:1]).collect():
        got = models.attributions(fitted[:1], ["a", "b", "c"], r.asDict(), top=2)
        odds = got["base"] + got["rest"] + sum(v for _, _, v in got["features"])
        assert 1 / (1 + np.exp(-odds)) == pytest.approx(r.p, abs=1e-9)


def test_learned_scores_rank_and_calibrate(spark):
    """Out-of-fold scores tell the classes apart; calibrated ones have the share of positives that they say."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 2))
    y = (rng.random(1500) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(v), k % 5) for k, ((a, b), v) in enumerate(zip(x, y))], "a double, b double, y double, fold int")
    scored, fitted = models.cross_fit(df, ["a", "b"], kind="logistic")
    assert len(fitted) == 5 and scored.count() == 1500
    out = models.calibrated(scored).toPandas()
    assert np.mean(out.p[out.y == 1].to_numpy()[:, None] > out.p[out.y == 0].to_numpy()[None, :]) > 0.75
    assert abs(out.pc.mean() - y.mean()) < 0.03 and abs(out.y[out.pc > 0.7].mean() - out.pc[out.pc > 0.7].mean()) < 0.06


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("S1-1", "a")], "entity_id string, business_name string").write.parquet(str(src))
    stream = spark.readStream.schema("entity_id string, business_name string").parquet(str(src))
    q = resolve_stream(stream, lambda b: b.withColumn("seen", F.lit(1)), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_nearest_of_classes(spark):
    """Copies are searched once, and yet the best of each record are those of all pairs; with terms of any frequency."""
    rng = np.random.default_rng(6)
    words_ = [[f"t{x}" for x in rng.zipf(1.4, rng.integers(0, 9)) if x < 40] for _ in range(60)]
    docs = [(f"r{i:03}", 1 + i % 3, words_[i % 7 if i % 4 else i % 60]) for i in range(240)]
    docs = spark.createDataFrame(docs, "id string, src int, terms array<string>")
    every = retrieval.cosine_pairs(retrieval.postings(docs))
    bags = retrieval.bags(docs.select("id", F.least("src", F.lit(2)).alias("side"), "terms"))
    v, classes = retrieval.bag_vectors(bags).cache(), retrieval.bag_classes(bags)
    assert v.count() == classes.select("rep", "side").distinct().count() < classes.count() / 2
    key = lambda rows: {(r.i, r.j, r["rank"], round(r.sim, 9)) for r in rows.collect()}
    for side in (9, 32768):
        found = retrieval.nearest(v.where("side = 1"), v.where("side = 2"), 4, 2, side=side)
        assert key(retrieval.of_members(found, classes, True, 4)) == key(retrieval.top_k(every, "i", "j", 4))
        assert key(retrieval.of_members(found, classes, False, 2)) == key(retrieval.top_k(every, "j", "i", 2))


def test_group_best_by_any_path():
    """Matrices, postings and single entries give the same best; a step's bounds lose none."""
    rng = np.random.default_rng(7)
    m = [rng.random((n, 30)) * (rng.random((n, 30)) < np.linspace(0.02, 0.9, 30)) for n in (300, 400)]
    m[1][200:260] = m[1][3]  # ties
    tables = []
    for x, names in zip(m, (("i", "ta", "wa"), ("j", "tb", "wb")), strict=True):
        cols = [pa.array([f"{names[0]}{r:03}" for r in range(len(x))]), pa.array([np.flatnonzero(r) for r in x], pa.list_(pa.int64())), pa.array([r[r > 0] for r in x], pa.list_(pa.float64()))]
        tables.append(pa.table(cols, list(names)))
    sim = np.round(m[0] @ m[1].T, 9)
    ahead = {(f"i{r:03}", f"j{c:03}") for r, row in enumerate(sim) for c in sorted(range(400), key=lambda c: (-row[c], c))[:5] if row[c] > 0}
    back = {(f"j{c:03}", f"i{r:03}") for c, col in enumerate(sim.T) for r in sorted(range(300), key=lambda r: (-col[r], r))[:3] if col[r] > 0}
    for cells, dense, few in ((1 << 22, 0.03, 48), (4000, 2.0, 0), (400, 0.0, 0), (9000, 2.0, 1 << 20), (30000, 0.3, 100)):
        got = retrieval.group_best(*tables, 5, 3, cells=cells, dense=dense, few=few).to_pylist()
        assert {(r["by"], r["other"]) for r in got if r["ahead"]} == ahead and {(r["by"], r["other"]) for r in got if not r["ahead"]} == back
    floor = tables[1].append_column("least", pa.array(np.full(400, 2.0)))
    got = {(r["by"], r["other"]) for r in retrieval.group_best(tables[0], floor, 0, 0, cells=9000).to_pylist()}
    assert got == {(f"i{r:03}", f"j{c:03}") for r, c in zip(*np.nonzero(sim >= 2.0), strict=True)}


def test_live_classes_make_no_pair_too_many(spark):
    """The rows of live_query over all pairs, from a search that leaves out what can't enter a list."""
    rng = np.random.default_rng(8)
    words_ = [[f"t{x}" for x in rng.zipf(1.4, rng.integers(0, 9)) if x < 40] for _ in range(60)]
    docs = spark.createDataFrame([(f"r{i:03}", 1 + i % 3, words_[i % 7 if i % 5 == 0 else i % 60]) for i in range(240)], "id string, side int, terms array<string>")
    every = retrieval.cosine_pairs(retrieval.postings(docs.withColumnRenamed("side", "src").withColumn("src", F.when(F.col("src") == 2, 2).otherwise(1))))
    new = docs.where("side = 3").select(F.col("id").alias("i"))
    want = retrieval.live_query(every.join(new, "i"), every.join(new, "i", "left_anti"), k=12)
    bags = retrieval.bags(docs)
    got = retrieval.live_classes(retrieval.bag_vectors(bags), retrieval.bag_classes(bags), k=12)
    key = lambda rows: sorted((r.i, r.j, r.ch, r["rank"]) for r in rows.collect())
    assert key(got) == key(want)


def test_review_values_of_many():
    """Many lists at once give what each gives alone, and in far less time."""
    rng = np.random.default_rng(9)
    lists = [np.sort((rng.integers(1, 51, n) - 0.5) / 50)[::-1] for n in rng.integers(0, 9, 300)]
    gain, place = decide.review_values(lists)
    for x, g, c in zip(lists, gain, place, strict=True):
        want = decide.review_value(x)
        assert abs(g - want[0]) < 1e-12 and c == want[1]
    many, began = [np.sort(rng.random(4))[::-1] for _ in range(20_000)], time.thread_time()
    decide.review_values(many)
    spent, began = time.thread_time() - began, time.thread_time()
    for x in many[:1000]:
        decide.review_value(x)
    assert spent < 10 * (time.thread_time() - began)


def test_shared_counts(spark):
    """Pairs that share a term are counted by bits, with copies and steps, without a row for each."""
    rng = np.random.default_rng(10)
    rows = [(f"r{i}", int(1 + i % 2), int(rng.choice([1, 2, 4])), int(rng.integers(1, 4)), sorted({int(x) for x in rng.zipf(1.3, 6) if x < 60})) for i in range(300)]
    want = {s: sum(a[3] * b[3] for a in rows for b in rows if a[1] == 1 and b[1] == 2 and max(a[2], b[2]) <= s and set(a[4]) & set(b[4])) for s in (1, 2, 4)}
    df = spark.createDataFrame([r for r in rows if r[4]], "id string, side int, c int, n int, t array<long>")
    for side in (40, 65536):
        assert {r.step: r.n for r in retrieval.shared_counts(df.where("side = 1"), df.where("side = 2"), [1, 2, 4], side=side).collect()} == want
    left, right = (pa.table({"c" + x: [r[2] for r in rows if r[1] == s], "n_" + x: [r[3] for r in rows if r[1] == s], "t" + x: pa.array([r[4] for r in rows if r[1] == s], pa.list_(pa.int64()))}) for s, x in ((1, "a"), (2, "b")))
    for few, records, n in ((0, 50, 7), (1000, 64, 256), (5, 1 << 17, 256)):
        got = retrieval.group_shared(left, right, [1, 2, 4], few=few, records=records, rows=n)
        assert dict(zip(*got.to_pydict().values(), strict=True)) == want
    df_at = lambda t, s: sum(r[3] for r in rows if t in r[4] and r[2] <= s)
    few_at = {s: {t for t in range(60) if df_at(t, s) <= 20} for s in (1, 2, 4)}
    want = {s: sum(a[3] * b[3] for a in rows for b in rows if a[1] == 1 and b[1] == 2 and max(a[2], b[2]) <= s and set(a[4]) & set(b[4]) & few_at[s]) for s in (1, 2, 4)}
    assert {r.step: r.n for r in retrieval.shared_capped(df, [1, 2, 4], 20).collect()} == want


def test_distractors_carry_no_words_through_a_shuffle(spark, monkeypatch):
    """Whatever the number of blocks the rows are those of one, and pairs meet words by broadcast."""
    from weftline.plans import block_queries

    folder = "/root/testdata/sf0.001"
    one = sorted(map(tuple, block_queries.distractors(spark, folder).collect()))
    monkeypatch.setattr(block_queries, "_BLOCK_WORDS", 500)
    seen, joined = [], block_queries.retrieval.top_k
    monkeypatch.setattr(block_queries.retrieval, "top_k", lambda x, *a: seen.append(x._jdf.queryExecution().optimizedPlan().toString()) or joined(x, *a))
    assert sorted(map(tuple, block_queries.distractors(spark, folder).collect())) == one and one
    assert len(seen) > 2 and all("strategy=broadcast" in plan for plan in seen[:-1])
