"""Queries of context windows, decisions, metrics, models and reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from weftline.operators import analytics, context, decide, metrics, models

from .fixtures import PAIRS, UNIVERSE, pair_graph, table, universe

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def _r(*names: str) -> list:
    return [F.round(c, 6).alias(c) for c in names]


def _l(*names: str) -> list:
    return [F.col(c).cast("long").alias(c) for c in names]


_SIDES = ", ".join(f"rank() OVER (PARTITION BY {s} ORDER BY p DESC) AS ctx_rank_{s}, round(max(p) OVER (PARTITION BY {s}) - p, 6) AS ctx_gap_{s}, round(sum(p) OVER (PARTITION BY {s}) - p, 6) AS ctx_sum_{s}" for s in "ij")


@query(f"WITH {PAIRS} SELECT i, j, {_SIDES}, sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY i)::BIGINT AS ctx_nhi_i, count(*) OVER (PARTITION BY j) AS ctx_cnt_j FROM pairs")
def ctx_rank_gap_sum(spark, d):
    x = context.ranks_and_gaps(pair_graph(spark, d))
    return x.select("i", "j", *_l("ctx_rank_i", "ctx_rank_j", "ctx_nhi_i", "ctx_cnt_j"), *_r("ctx_gap_i", "ctx_sum_i", "ctx_gap_j", "ctx_sum_j"))


@query(f"WITH {PAIRS}, b AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY p DESC, j) AS k FROM pairs), t AS (SELECT i, max(CASE WHEN k = 1 THEN p END) AS p1, max(CASE WHEN k = 2 THEN p END) AS p2 FROM b GROUP BY i) SELECT b.i, b.j, round(p - coalesce(CASE WHEN k = 1 THEN p2 ELSE p1 END, 0), 6) AS ctx_margin_i FROM b JOIN t ON b.i = t.i")
def ctx_margin(spark, d):
    return context.margins(pair_graph(spark, d)).select("i", "j", *_r("ctx_margin_i"))


@query(f"WITH {PAIRS}, o AS (SELECT i, j, p / (1 - least(p, 0.999::DOUBLE)) AS o FROM pairs) SELECT i, j, round(o / (1 + sum(o) OVER (PARTITION BY j)), 6) AS ctx_excl_j FROM o")
def ctx_exclusive(spark, d):
    return context.exclusive_share(pair_graph(spark, d)).select("i", "j", *_r("ctx_excl_j"))


@query(f"""WITH {PAIRS}, t AS (SELECT p_partkey AS j, string_split(p_name, ' ') AS t FROM part), s AS (SELECT a.i, a.j, max(b.p * (len(list_intersect(x.t, y.t)) / CAST(len(list_distinct(list_concat(x.t, y.t))) AS DOUBLE))) AS ctx_support, count(*) AS ctx_nsib
 FROM pairs a JOIN pairs b ON a.i = b.i AND a.j <> b.j JOIN t x ON x.j = a.j JOIN t y ON y.j = b.j WHERE b.p >= 0.3 GROUP BY 1, 2) SELECT p.i, p.j, round(coalesce(ctx_support, 0), 6) AS ctx_support, coalesce(ctx_nsib, 0) AS ctx_nsib FROM pairs p LEFT JOIN s ON p.i = s.i AND p.j = s.j""")
def sibling_support(spark, d):
    pairs = pair_graph(spark, d)
    t = table(spark, d, "part").select(F.col("p_partkey").alias("j"), F.split("p_name", " ").alias("t"))
    met = pairs.select("i", "j").join(pairs.select("i", F.col("j").alias("j2")), "i").where("j <> j2").select("j", "j2").distinct()
    alike = met.join(t, "j").join(t.select(F.col("j").alias("j2"), F.col("t").alias("t2")), "j2").select("j", "j2", (F.size(F.array_intersect("t", "t2")) / F.size(F.array_union("t", "t2"))).alias("s"))
    return context.sibling_support(pairs, alike).select("i", "j", *_r("ctx_support"), *_l("ctx_nsib"))


@query("SELECT p_partkey, round(ln(1 + count(*) OVER (PARTITION BY p_name)), 6) AS dens FROM part")
def density_windows(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    return p.join(p.groupBy("p_name").agg(F.count("*").alias("n")), "p_name").select("p_partkey", F.round(F.log1p("n"), 6).alias("dens"))


_EXCLUSIVE = f"{PAIRS}, c AS (SELECT i, j, y, least(greatest(p, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS p FROM pairs), q AS (SELECT i, j, y, (p / (1 - p)) / (1 + sum(p / (1 - p)) OVER (PARTITION BY j)) AS q FROM c)"


@query(f"WITH {_EXCLUSIVE} SELECT i, j, round(q, 6) AS q FROM q")
def exclusive_posterior(spark, d):
    return decide.exclusive(pair_graph(spark, d)).select("i", "j", *_r("q"))


@query(f"WITH {PAIRS} SELECT i, string_agg(CAST(j AS VARCHAR), ',' ORDER BY p DESC, j) AS ids FROM pairs WHERE p >= 0.8 GROUP BY i")
def threshold_decide(spark, d):
    return decide.by_threshold(pair_graph(spark, d), 0.8).select("i", F.array_join("ids", ",").alias("ids"))


_F = "CASE WHEN n = 0 AND t = 0 THEN 1.0 WHEN n = 0 OR t = 0 THEN 0.0 ELSE 1.25 * h / (n + 0.25 * t) END"


@query(f"""WITH {PAIRS}, {UNIVERSE}, g AS (SELECT unnest({decide.THRESHOLDS}) AS thr), e AS (SELECT i, sum(y) AS t FROM pairs GROUP BY i), h AS (SELECT thr, i, sum(CASE WHEN p >= thr THEN 1 ELSE 0 END) AS n, sum(CASE WHEN p >= thr THEN y ELSE 0 END) AS h FROM pairs, g GROUP BY 1, 2),
 f AS (SELECT g.thr, u.i, coalesce(h.n, 0) AS n, coalesce(h.h, 0) AS h, coalesce(e.t, 0) AS t FROM universe u CROSS JOIN g LEFT JOIN h ON h.i = u.i AND h.thr = g.thr LEFT JOIN e ON e.i = u.i) SELECT CAST(thr AS DOUBLE) AS t, round(avg(CAST({_F} AS DOUBLE)), 6) AS macro_f FROM f GROUP BY thr""")
def best_threshold(spark, d):
    return metrics.threshold_scores(universe(spark, d), pair_graph(spark, d)).select(F.col("t").cast("double").alias("t"), *_r("macro_f"))


@query(f"""WITH RECURSIVE {PAIRS}, l AS (SELECT i, list(p ORDER BY p DESC, j) AS ps FROM pairs GROUP BY i), k AS (SELECT i, ps, unnest(range(1, least(len(ps), 12) + 1)) AS k FROM l),
 st AS (SELECT i, k, 0 AS s, ps, 0::BIGINT AS x, 0::BIGINT AS y, 1.0::DOUBLE AS m FROM k UNION ALL SELECT i, k, s + 1, any_value(ps), x, y, sum(m) FROM (
   SELECT i, k, s, ps, x + CASE WHEN s < k THEN b ELSE 0 END AS x, y + CASE WHEN s < k THEN 0 ELSE b END AS y, m * CASE WHEN b = 1 THEN ps[s + 1] ELSE 1 - ps[s + 1] END AS m FROM st, (VALUES (0), (1)) v(b) WHERE s < len(ps)) GROUP BY i, k, s, x, y)
 SELECT i, CAST(k AS INTEGER) AS k, round(sum(m * 1.25 * x / (k + 0.25 * (x + y))), 6) AS f FROM st WHERE s = len(ps) GROUP BY 1, 2 UNION ALL SELECT i, 0, round(list_product(list_transform(ps, lambda p: 1 - p)), 6) FROM l""")
def expected_f_curve(spark, d):
    got = decide.candidate_lists(pair_graph(spark, d)).select("i", F.posexplode(decide.expected_f_curve(F.col("ps"))).alias("k", "f"))
    return got.select("i", "k", F.round("f", 6).alias("f"))


@query(f"""WITH RECURSIVE {_EXCLUSIVE}, l AS (SELECT i, list(least(greatest(q, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE) ORDER BY q DESC, j) AS ps, list(j ORDER BY q DESC, j) AS js FROM q GROUP BY i), k AS (SELECT i, ps, unnest(range(1, least(len(ps), 12) + 1)) AS k FROM l),
 st AS (SELECT i, k, 0 AS s, ps, 0::BIGINT AS x, 0::BIGINT AS y, 1.0::DOUBLE AS m FROM k UNION ALL SELECT i, k, s + 1, any_value(ps), x, y, sum(m) FROM (
   SELECT i, k, s, ps, x + CASE WHEN s < k THEN b ELSE 0 END AS x, y + CASE WHEN s < k THEN 0 ELSE b END AS y, m * CASE WHEN b = 1 THEN ps[s + 1] ELSE 1 - ps[s + 1] END AS m FROM st, (VALUES (0), (1)) v(b) WHERE s < len(ps)) GROUP BY i, k, s, x, y),
 f AS (SELECT i, k, sum(m * 1.25 * x / (k + 0.25 * (x + y))) AS f FROM st WHERE s = len(ps) GROUP BY 1, 2 UNION ALL SELECT i, 0, list_product(list_transform(ps, lambda p: 1 - p)) FROM l),
 best AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY i ORDER BY round(f, 12) DESC, k) = 1)
SELECT i, CAST(k AS INTEGER) AS k, round(f, 6) AS expected, array_to_string(js[1:k], ',') AS ids FROM best JOIN l USING (i)""")
def choose_set(spark, d):
    got = decide.choose_sets(decide.exclusive(pair_graph(spark, d)).drop("p").withColumnRenamed("q", "p"))
    return got.select("i", "k", F.round("expected", 6).alias("expected"), F.array_join("ids", ",").alias("ids"))


@query(f"""WITH RECURSIVE {PAIRS}, l AS (SELECT i, list(least(greatest(p, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE) ORDER BY p DESC, j) AS ps, list(j ORDER BY p DESC, j) AS js FROM pairs GROUP BY i),
 o AS (SELECT i, ps, unnest(range(1, len(ps) + 1)) AS c FROM l), v AS (SELECT i, 0 AS c, 0 AS b, ps FROM l UNION ALL SELECT i, c, 1, list_prepend(1 - 1e-9::DOUBLE, list_concat(ps[1:c - 1], ps[c + 1:])) FROM o UNION ALL SELECT i, c, 0, list_append(list_concat(ps[1:c - 1], ps[c + 1:]), 1e-9::DOUBLE) FROM o),
 k AS (SELECT *, unnest(range(1, len(ps) + 1)) AS k FROM v),
 st AS (SELECT i, c, b, k, 0 AS s, ps, 0::BIGINT AS x, 0::BIGINT AS y, 1.0::DOUBLE AS m FROM k UNION ALL SELECT i, c, b, k, s + 1, any_value(ps), x, y, sum(m) FROM (
   SELECT i, c, st.b, k, s, ps, x + CASE WHEN s < k THEN h ELSE 0 END AS x, y + CASE WHEN s < k THEN 0 ELSE h END AS y, m * CASE WHEN h = 1 THEN ps[s + 1] ELSE 1 - ps[s + 1] END AS m FROM st, (VALUES (0), (1)) t(h) WHERE s < len(ps)) GROUP BY i, c, b, k, s, x, y),
 f AS (SELECT i, c, b, sum(m * 1.25 * x / (k + 0.25 * (x + y))) AS f FROM st WHERE s = len(ps) GROUP BY i, c, b, k UNION ALL SELECT i, c, b, list_product(list_transform(ps, lambda p: 1 - p)) FROM v),
 best AS (SELECT i, c, b, max(f) AS f FROM f GROUP BY 1, 2, 3),
 gain AS (SELECT o.i, o.c, o.ps[o.c] AS p, o.ps[o.c] * y.f + (1 - o.ps[o.c]) * n.f - z.f AS gain FROM o JOIN best y ON y.i = o.i AND y.c = o.c AND y.b = 1 JOIN best n ON n.i = o.i AND n.c = o.c AND n.b = 0 JOIN best z ON z.i = o.i AND z.c = 0),
 one AS (SELECT * FROM gain QUALIFY row_number() OVER (PARTITION BY i ORDER BY round(gain, 12) DESC, c) = 1)
SELECT i, round(gain, 6) AS gain, js[c] AS j, round(p, 6) AS p FROM one JOIN l USING (i) WHERE gain > 1e-4 ORDER BY round(gain, 9) DESC, i LIMIT 150""")
def evpi_queue(spark, d):
    return decide.review_queue(pair_graph(spark, d)).select("i", F.round("gain", 6).alias("gain"), "j", F.round("p", 6).alias("p"))


@query(f"""WITH {PAIRS}, t AS (SELECT sum(y) AS n FROM pairs), s AS (SELECT 'pool' AS stage, 0.0 AS least UNION ALL SELECT 'kept', 0.3 UNION ALL SELECT 'answered', 0.7)
SELECT stage, count(*) AS n_pairs, count(DISTINCT i) AS n_entities, CAST(sum(y) AS BIGINT) AS found, round(sum(y) / CAST(max(t.n) AS DOUBLE), 6) AS recall FROM pairs, s, t WHERE p >= least GROUP BY stage""")
def funnel_counts(spark, d):
    """What blocking, pruning and deciding leave of the pairs and of the true ones."""
    g = pair_graph(spark, d)
    n = g.agg(F.sum("y")).first()[0]
    return analytics.funnel(g, n, {"pool": F.lit(True), "kept": F.col("p") >= 0.3, "answered": F.col("p") >= 0.7}).withColumn("recall", F.round("recall", 6))


_COUNTS = f"{PAIRS}, {UNIVERSE}, c AS (SELECT u.i, coalesce(sum(CASE WHEN p >= 0.7 THEN 1 ELSE 0 END), 0) AS n, coalesce(sum(y), 0) AS t, coalesce(sum(CASE WHEN p >= 0.7 THEN y ELSE 0 END), 0) AS h FROM universe u LEFT JOIN pairs p ON p.i = u.i GROUP BY u.i), f AS (SELECT *, CAST({_F} AS DOUBLE) AS f FROM c)"


@query(f"WITH {_COUNTS} SELECT round(avg(f), 6) AS macro_f, count(*) AS n, round(avg(CASE WHEN t = 0 THEN f END), 6) AS singleton_f, sum(CASE WHEN t = 0 THEN 1 ELSE 0 END)::BIGINT AS n_singletons, round(avg(CASE WHEN t > 0 THEN f END), 6) AS matched_f, sum(CASE WHEN t > 0 THEN 1 ELSE 0 END)::BIGINT AS n_matched, round(sum(h) / CAST(sum(n) AS DOUBLE), 6) AS precision_micro, round(sum(h) / CAST(sum(t) AS DOUBLE), 6) AS recall_micro FROM f")
def macro_f05(spark, d):
    g = pair_graph(spark, d)
    x = metrics.score(universe(spark, d), g.where("p >= 0.7"), g.where("y = 1"))
    return x.select(*_r("macro_f", "singleton_f", "matched_f", "precision_micro", "recall_micro"), "n", "n_singletons", "n_matched")


@query(f"WITH {PAIRS}, {UNIVERSE}, n AS (SELECT u.i, count(p.i) AS n FROM universe u LEFT JOIN pairs p ON p.i = u.i GROUP BY u.i) SELECT round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.95), 6) AS p95, max(n) AS max, round(avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share FROM n")
def cand_distribution(spark, d):
    n = universe(spark, d).join(pair_graph(spark, d).groupBy("i").agg(F.count("*").alias("n")), "i", "left").fillna(0)
    return metrics.distribution(n, "n").select(*_r("mean", "median", "p95", "zero_share"), "max")


#: Thresholds of the prune curve; fixed values.
PRUNE_GRID = [0.0005, 0.001, 0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2]


@query(f"WITH {PAIRS}, g AS (SELECT unnest({PRUNE_GRID}) AS tau) SELECT CAST(tau AS DOUBLE) AS tau, sum(CASE WHEN p >= tau THEN 1 ELSE 0 END)::BIGINT AS kept, round(sum(CASE WHEN p < tau THEN y ELSE 0 END) / CAST(sum(y) AS DOUBLE), 6) AS lost FROM pairs, g GROUP BY tau")
def prune_curve(spark, d):
    return metrics.prune_curve(pair_graph(spark, d), PRUNE_GRID).select(F.col("tau").cast("double").alias("tau"), "kept", F.round("lost", 6).alias("lost"))


@query(f"WITH {UNIVERSE} SELECT i, CAST(('0x' || substr(md5(CAST(i AS VARCHAR)), 1, 8))::BIGINT % 5 AS INTEGER) AS fold FROM universe")
def fold_assign(spark, d):
    return universe(spark, d).select("i", models.fold_of(F.col("i")).alias("fold"))


def _frame(spark, d):
    """Labelled documents with a few counts of their text."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    t = F.coalesce("text", F.lit(""))
    w = F.split(t, r"\s+")
    x = docs.join(labels, "doc_id").select(
        "doc_id", F.col("quality").alias("y"), F.log1p(F.length(t)).alias("chars"), F.size(F.split(t, "\n")).cast("double").alias("lines"),
        (F.length(F.regexp_replace(t, "[^0-9]", "")) / F.greatest(F.length(t), F.lit(1))).alias("digits"), (F.size(F.array_distinct(w)) / F.size(w)).alias("distinct"),
        (F.length(F.regexp_replace(t, "[^A-Z]", "")) / F.greatest(F.length(t), F.lit(1))).alias("capitals"),
    )
    return x.withColumn("fold", models.fold_of(F.col("doc_id")))


_FEATURES = ["chars", "lines", "digits", "distinct", "capitals"]


@query()
def crossfit_scores(spark, d):
    out, _ = models.cross_fit(_frame(spark, d), _FEATURES, kind="gbt", rounds=8)
    return out.select("doc_id", "fold", "y", F.round("p", 6).alias("p"))


@query()
def isotonic_cal(spark, d):
    out, _ = models.cross_fit(_frame(spark, d), _FEATURES, kind="logistic")
    return models.calibrated(out).select("doc_id", "y", F.round("p", 6).alias("p"), F.round("pc", 6).alias("pc"))


@query(f"""WITH {PAIRS}, {UNIVERSE}, m AS (SELECT i, list(j ORDER BY j) AS ids FROM pairs WHERE p >= 0.9 GROUP BY i), c AS (SELECT i, list(j ORDER BY j) AS ids FROM pairs WHERE p >= 0.5 AND p < 0.95 GROUP BY i), o AS (SELECT p_partkey AS r FROM part WHERE p_size > 7),
 x AS (SELECT 'matching' AS t, i, unnest(ids) AS r FROM m UNION ALL SELECT 'candidates', i, unnest(ids) FROM c)
 SELECT 'matching: repeated entity' AS problem, 0::BIGINT AS n UNION ALL SELECT 'candidates: repeated entity', 0 UNION ALL SELECT 'matching: repeated id in a row', 0 UNION ALL SELECT 'candidates: repeated id in a row', 0
 UNION ALL SELECT 'matching: missing entity', count(*) FROM universe WHERE i NOT IN (SELECT i FROM m) UNION ALL SELECT 'candidates: missing entity', count(*) FROM universe WHERE i NOT IN (SELECT i FROM c)
 UNION ALL SELECT 'matching: unknown entity', count(*) FROM m WHERE i NOT IN (SELECT i FROM universe) UNION ALL SELECT 'candidates: unknown entity', count(*) FROM c WHERE i NOT IN (SELECT i FROM universe)
 UNION ALL SELECT t || ': unknown id', count(DISTINCT CASE WHEN r NOT IN (SELECT r FROM o) THEN r END) FROM x GROUP BY t UNION ALL SELECT t || ': match with itself', sum(CASE WHEN r = i THEN 1 ELSE 0 END)::BIGINT FROM x GROUP BY t
 UNION ALL SELECT 'match that is no candidate', count(*) FROM x a WHERE t = 'matching' AND NOT EXISTS (SELECT 1 FROM x b WHERE b.t = 'candidates' AND b.i = a.i AND b.r = a.r)""")
def validate_submission(spark, d):
    """A submission with planted defects: candidates without the surest pairs, and a catalogue without small parts."""
    g = pair_graph(spark, d).withColumnRenamed("i", "s1")
    lists = lambda x: x.groupBy("s1").agg(F.array_sort(F.collect_list("j")).alias("ids"))
    others = table(spark, d, "part").where("p_size > 7").select(F.col("p_partkey").alias("r"))
    return metrics.check_submission(lists(g.where("p >= 0.9")), lists(g.where("p >= 0.5 AND p < 0.95")), universe(spark, d).withColumnRenamed("i", "s1"), others)


@query(f"WITH {PAIRS}, {UNIVERSE}, n AS (SELECT u.i, count(p.i) AS size FROM universe u LEFT JOIN (SELECT * FROM pairs WHERE y = 1) p ON p.i = u.i GROUP BY u.i) SELECT size, count(*) AS n FROM n GROUP BY size")
def eda_profile(spark, d):
    return analytics.match_sizes(universe(spark, d), pair_graph(spark, d).where("y = 1"))


def _emitted(spark, d):
    return pair_graph(spark, d).withColumn("emitted", F.col("p") >= 0.8)


@query(f"WITH {PAIRS}, {UNIVERSE}, cl AS (SELECT j, count(*) AS claims FROM pairs WHERE p >= 0.8 GROUP BY j), e AS (SELECT i, count(*) AS n_candidates, sum(CASE WHEN p >= 0.8 THEN 1 ELSE 0 END)::BIGINT AS n_emitted, max(p) AS best, max(CASE WHEN p >= 0.8 AND claims > 1 THEN 1 ELSE 0 END) AS c FROM pairs LEFT JOIN cl USING (j) GROUP BY i) SELECT u.i, coalesce(n_candidates, 0) AS n_candidates, coalesce(n_emitted, 0) AS n_emitted, round(coalesce(best, 0), 6) AS best, coalesce(c, 0) = 1 AS is_contested FROM universe u LEFT JOIN e ON e.i = u.i WHERE coalesce(c, 0) = 1")
def entity_browse(spark, d):
    e = analytics.entity_flags(universe(spark, d), _emitted(spark, d))
    return analytics.browse(e, kind="contested").select("i", "n_candidates", "n_emitted", F.round("best", 6).alias("best"), "is_contested")


@query(f"WITH {PAIRS} SELECT j, count(*) AS n, round(max(p), 6) AS top FROM pairs WHERE p >= 0.5 GROUP BY j HAVING count(*) > 1")
def contested(spark, d):
    return analytics.contested(pair_graph(spark, d)).select("j", "n", F.round("top", 6).alias("top"))


@query(f"WITH {PAIRS}, b AS (SELECT j, i, row_number() OVER (PARTITION BY j ORDER BY p DESC, i) AS k FROM pairs WHERE p >= 0.8) SELECT p.j, count(*) AS n_claims, sum(CASE WHEN p >= 0.8 THEN 1 ELSE 0 END)::BIGINT AS n_emitted, max(b.i) AS owner FROM pairs p LEFT JOIN b ON b.j = p.j AND b.k = 1 GROUP BY p.j")
def record_owners(spark, d):
    return analytics.owners(_emitted(spark, d))


@query(f"WITH {PAIRS}, x AS (SELECT a.i, a.j, b.i AS rival, b.p AS p_rival, row_number() OVER (PARTITION BY a.i, a.j ORDER BY b.p DESC, b.i) AS k FROM pairs a JOIN pairs b ON a.j = b.j AND a.i <> b.i WHERE a.p >= 0.8) SELECT i, j, rival, round(p_rival, 6) AS p_rival, CAST(k AS BIGINT) AS k FROM x WHERE k <= 3")
def competing_claims(spark, d):
    return analytics.competing(_emitted(spark, d)).select("i", "j", "rival", F.round("p_rival", 6).alias("p_rival"), F.col("k").cast("long").alias("k"))


@query("WITH k AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(CAST(c_custkey AS VARCHAR) || '|7'), c_custkey) AS k FROM customer) SELECT c_nationkey, c_custkey FROM k WHERE k <= 2")
def review_samples(spark, d):
    c = table(spark, d, "customer").select("c_nationkey", F.col("c_custkey").alias("id"))
    return analytics.samples(c, "c_nationkey", "7", 2).select("c_nationkey", F.col("id").alias("c_custkey"))
