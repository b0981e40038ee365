"""Queries of sources, text functions and mined lexicons."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import kernels
from weftline.functions.address import LANDMARK_CUES, address_slots
from weftline.functions.phonetic import skeleton, transliterate
from weftline.functions.tokens import acronym, char_ngrams, house_numbers, identity_words, is_abbreviation, jaccard, legal_match, number_runs, shared_words, side_state, sorted_key, strip_tail, token_set, tokens, words
from weftline.functions.unicode import fold, fold_marks
from weftline.operators import lexicon
from weftline.operators.features import idf, with_idf, soft_udf
from weftline.sources.records import explode_truth, pair_lists

from .fixtures import NAMES, PAIRS, RECS, UNIVERSE, fold_marks_sql, fold_sql, names, pair_graph, recs, skeleton_sql, table, universe, words_sql

QUERIES, ORACLES = {}, {}
TAIL = ["widget", "gadget", "bolt", "gear", "steel", "brass"]


def query(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


@query(f"WITH {RECS} SELECT entity_id, business_name, business_address, country, src FROM recs")
def src_scan_project(spark, d):
    return recs(spark, d)


@query(f"WITH {PAIRS} SELECT DISTINCT CAST(i AS VARCHAR) AS s1, CAST(j AS VARCHAR) AS r FROM pairs WHERE y = 1")
def truth_explode(spark, d):
    lists = pair_graph(spark, d).where("y = 1").groupBy(F.col("i").cast("string").alias("s1")).agg(F.array_join(F.array_sort(F.collect_set(F.col("j").cast("string"))), " , ").alias("ids"))
    return explode_truth(lists)


@query(f"WITH {PAIRS}, {UNIVERSE}, l AS (SELECT i, string_agg(CAST(j AS VARCHAR), ',' ORDER BY p DESC, CAST(j AS VARCHAR)) AS ids FROM pairs WHERE p >= 0.5 GROUP BY i) SELECT CAST(u.i AS VARCHAR) AS s1, coalesce(ids, '') AS matched_entity_ids FROM universe u LEFT JOIN l ON u.i = l.i")
def pairs_sink_lists(spark, d):
    p = pair_graph(spark, d).where("p >= 0.5").select(F.col("i").cast("string").alias("s1"), F.col("j").cast("string").alias("r"), "p")
    return pair_lists(universe(spark, d).select(F.col("i").cast("string").alias("s1")), p, order="p")


@query(f"WITH f AS (SELECT doc_id, {fold_sql("coalesce(text, '')")} AS f FROM documents) SELECT doc_id, md5(f) AS folded, CAST(len({words_sql('f')}) AS BIGINT) AS n_tokens, md5(array_to_string(list_sort(list_distinct({words_sql('f')})), ' ')) AS sorted_key FROM f")
def fold_tokens(spark, d):
    f = table(spark, d, "documents").select("doc_id", fold(F.col("text")).alias("f")).withColumn("t", words(F.col("f")))
    return f.select("doc_id", F.md5("f").alias("folded"), F.size("t").cast("long").alias("n_tokens"), F.md5(sorted_key(F.col("t"))).alias("sorted_key"))


@query(f"SELECT doc_id, md5({fold_marks_sql("coalesce(text, '')")}) AS folded FROM documents")
def fold_er(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(fold_marks(F.col("text"))).alias("folded"))


@query(f"SELECT p_partkey, {skeleton_sql(fold_marks_sql('p_name'))} AS skeleton FROM part")
def skeleton_key(spark, d):
    return table(spark, d, "part").select("p_partkey", skeleton(fold_marks(F.col("p_name"))).alias("skeleton"))


#: Latin letters and Devanagari ones that are read alike; fixed values. Vowels are dependent signs.
LETTERS = ("bcdfghjklmnpqrstvwxyzaeiou", "बचदफगहजकलमनपकरसतववकयजािेोु".replace("ािेोु", "ा\u0947\u093f\u094b\u0941"))


@query(r"""WITH v AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(translate(p_name, 'qxwz', 'kkvj'), '([b-df-hj-np-tv-z])', '\1a', 'g'), 'a+([eiou])', '\1', 'g'), 'aa+', 'a', 'g') AS s FROM part)
SELECT p_partkey, regexp_replace(replace(s, 'fa', 'pha'), '([b-df-hj-np-tv-z])a\b', '\1', 'g') AS latin FROM (SELECT p_partkey, regexp_replace(s, 'f([eiou])', 'ph\1', 'g') AS s FROM v)""")
def indic_translit(spark, d):
    """Part names written in Devanagari, letter by letter, and read again."""
    return table(spark, d, "part").select("p_partkey", transliterate(F.translate("p_name", *LETTERS)).alias("latin"))


@query(r"WITH p AS (SELECT p_partkey, ' ' || p_name || ' ' AS s FROM part) SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(range(1, length(s) - 1), lambda k: substr(s, k, 3)))), '|') AS grams FROM p")
def char_ngrams_part(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(char_ngrams(F.col("p_name"))), "|").alias("grams"))


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(coalesce(text, ''), '\d+'), ',') AS runs, array_to_string(list_transform(regexp_extract_all(coalesce(text, ''), '\d+'), lambda x: CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END), ',') AS houses FROM documents")
def number_runs_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(number_runs(F.col("text")), ",").alias("runs"), F.array_join(house_numbers(F.col("text")), ",").alias("houses"))


_TAIL_SQL = "[" + ", ".join(f"'{w}'" for w in TAIL) + "]"


@query(f"""WITH {NAMES}, m AS (SELECT id, t, list_max(list_transform(t, lambda x, k: CASE WHEN list_contains({_TAIL_SQL}, x) THEN 0 ELSE k END)) AS last, list_filter(t, lambda x: NOT list_contains({_TAIL_SQL}, x)) AS own FROM names)
SELECT id, array_to_string(t[1:greatest(1, last)], ' ') AS core, array_to_string(CASE WHEN len(own) > 0 THEN own ELSE t[1:greatest(1, last)] END, ' ') AS ident FROM m""")
def strip_legal_tail(spark, d):
    return names(spark, d).select("id", F.array_join(strip_tail(F.col("t"), TAIL), " ").alias("core"), F.array_join(identity_words(F.col("t"), TAIL), " ").alias("ident"))


@query(f"WITH {NAMES} SELECT id, array_to_string(list_transform(t, lambda x: substr(x, 1, 1)), '') AS acronym, array_to_string(t, '') AS joined, array_to_string(list_sort(list_distinct(t)), ' ') AS token_set FROM names")
def acronym_concat(spark, d):
    t = F.col("t")
    return names(spark, d).select("id", acronym(t).alias("acronym"), F.array_join(t, "").alias("joined"), F.array_join(token_set(t), " ").alias("token_set"))


_CUES = "|".join(sorted(LANDMARK_CUES, key=lambda x: (-len(x), x)))
# Numbers stay in place while the words between them are folded; RE2 has no look-ahead, so the digit after a landmark's own number is put back.
SLOTS = rf"""{RECS}, cl AS (SELECT entity_id, k, u FROM (SELECT entity_id, unnest(regexp_split_to_array(lower(business_address), '[,;|]+')) AS u, generate_subscripts(regexp_split_to_array(lower(business_address), '[,;|]+'), 1) AS k FROM recs)),
 nm AS (SELECT entity_id, k, regexp_extract_all(u, '[0-9]+(?:\s*[/-]\s*[0-9]+)*[a-z]?') AS ns, regexp_split_to_array(u, '[0-9]+(?:\s*[/-]\s*[0-9]+)*[a-z]?') AS bs FROM cl),
 flat AS (SELECT entity_id, k, trim(regexp_replace(array_to_string(list_transform(range(1, len(bs) + 1), lambda m: {fold_sql('bs[m]')} || ' ' || coalesce(regexp_replace(ns[m], '\s', '', 'g'), '')), ' '), ' +', ' ', 'g')) AS c FROM nm),
 mark AS (SELECT entity_id, k, c, regexp_replace(c, '\b(?:{_CUES})\b[^0-9]*(?:[0-9][^ ]* ([0-9]))?', '\1', 'g') AS o FROM flat),
 kept AS (SELECT entity_id, k, list_filter(string_split(o, ' '), lambda x: x <> '') AS ws, o <> c AS lm FROM mark),
 rec AS (SELECT entity_id, coalesce(list(ws ORDER BY k) FILTER (len(ws) > 0), []) AS cs, bool_or(lm) AS landmark FROM kept GROUP BY entity_id),
 num AS (SELECT *, list_filter(flatten(cs), lambda x: regexp_matches(x, '^[0-9]')) AS ns FROM rec),
 pc AS (SELECT *, coalesce(list_filter(list_transform(list_filter(ns, lambda x: NOT regexp_matches(x, '[/-]')), lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: length(x) >= 5)[-1], '') AS postcode FROM num),
 hs AS (SELECT *, coalesce(list_filter(ns, lambda x: regexp_replace(x, '[^0-9]', '', 'g') <> postcode)[1], '') AS house FROM pc),
 st AS (SELECT *, list_filter(cs, lambda c: list_contains(c, house))[1] AS own, list_filter(cs, lambda c: NOT list_contains(c, house)) AS other FROM hs),
 sl AS (SELECT *, list_filter(own[list_position(own, house) + 1:], lambda x: NOT regexp_matches(x, '^[0-9]')) AS after, CASE WHEN len(cs) > 1 THEN flatten(other[-2:]) ELSE flatten(cs)[-2:] END AS ends FROM st)"""


@query(f"""WITH {SLOTS} SELECT entity_id, house, postcode, array_to_string(list_sort(list_distinct(list_concat(list_transform(ns, lambda x: CASE WHEN length(regexp_replace(x, '[^0-9]', '', 'g')) >= 5 THEN regexp_replace(x, '[^0-9]', '', 'g') ELSE x END), flatten(list_transform(ns, lambda x: regexp_split_to_array(x, '[/-]')))))), ',') AS numbers,
 coalesce(array_to_string(CASE WHEN len(cs) = 1 THEN after[1:3] ELSE after END, ' '), '') AS street, array_to_string(list_filter(ends, lambda x: NOT regexp_matches(x, '^[0-9]')), ' ') AS tail, landmark FROM sl""")
def address_slots_records(spark, d):
    r = recs(spark, d).select("entity_id", address_slots(F.col("business_address")).alias("s"))
    return r.select("entity_id", "s.house", "s.postcode", F.array_join("s.numbers", ",").alias("numbers"), F.array_join("s.street", " ").alias("street"), F.array_join("s.tail", " ").alias("tail"), "s.landmark")


def _part_pairs(spark, d):
    """Neighbouring parts of one brand: (a, b) names to compare."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_name")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b"))
    return p.join(q, "p_partkey").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("a"), "b")


_PART_PAIRS = "pp AS (SELECT p.p_partkey AS id, p.p_name AS a, q.p_name AS b FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1)"


@query(f"WITH {_PART_PAIRS} SELECT id, round(jaro_winkler_similarity(a, b), 6) AS jw FROM pp")
def jaro_winkler_names(spark, d):
    return _part_pairs(spark, d).select("id", F.round(kernels.jaro_winkler_ratio(F.col("a"), F.col("b")), 6).alias("jw"))


# The longest common subsequence of all needed pairs of strings, a character of x at a time; t is the row of the table.
_INDEL = f"""{_PART_PAIRS}, ab AS (SELECT DISTINCT a, b FROM pp), w AS (SELECT a, b, list_sort(list_distinct(string_split(a, ' '))) AS x, list_sort(list_distinct(string_split(b, ' '))) AS y FROM ab),
 parts AS (SELECT a, b, array_to_string(list_sort(string_split(a, ' ')), ' ') AS sa, array_to_string(list_sort(string_split(b, ' ')), ' ') AS sb, array_to_string(list_filter(x, lambda v: list_contains(y, v)), ' ') AS com,
  array_to_string(list_filter(x, lambda v: NOT list_contains(y, v)), ' ') AS l, array_to_string(list_filter(y, lambda v: NOT list_contains(x, v)), ' ') AS r FROM w),
 sides AS (SELECT *, trim(com || ' ' || l) AS one, trim(com || ' ' || r) AS other FROM parts), short AS (SELECT a, b, CASE WHEN length(a) > length(b) THEN b ELSE a END AS s, CASE WHEN length(a) > length(b) THEN a ELSE b END AS g FROM ab),
 cuts AS (SELECT a, b, s AS x, substr(g, greatest(k, 0) + 1, least(length(g), k + length(s)) - greatest(k, 0)) AS y FROM (SELECT *, unnest(range(1 - length(s), length(g))) AS k FROM short)),
 need AS (SELECT a AS x, b AS y FROM ab UNION SELECT sa, sb FROM parts UNION SELECT one, other FROM sides UNION SELECT com, one FROM sides UNION SELECT com, other FROM sides UNION SELECT x, y FROM cuts),
 step AS (SELECT x, y, 0 AS k, list_transform(range(0, length(y) + 1), lambda j: 0::BIGINT) AS t FROM need
  UNION ALL SELECT x, y, k + 1, list_reduce(list_transform(range(1, length(y) + 1), lambda j: [j]), lambda acc, j: list_append(acc, CASE WHEN x[k + 1] = y[j[1]] THEN t[j[1]] + 1 ELSE greatest(t[j[1] + 1], acc[j[1]]) END), [0::BIGINT]) FROM step WHERE k < length(x)),
 sim AS (SELECT x, y, CASE WHEN length(x) + length(y) = 0 THEN 1.0 ELSE 2.0 * t[length(y) + 1] / (length(x) + length(y)) END AS v FROM step WHERE k = length(x)),
 best AS (SELECT a, b, max(v) AS v FROM cuts JOIN sim USING (x, y) GROUP BY a, b),
 got AS (SELECT s.a, s.b, p.v AS ratio, q.v AS token_sort_ratio, CASE WHEN com <> '' AND (l = '' OR r = '') THEN 1.0 WHEN com = '' THEN o.v ELSE greatest(o.v, c.v, d.v) END AS token_set_ratio, best.v AS partial_ratio
  FROM sides s JOIN sim p ON p.x = s.a AND p.y = s.b JOIN sim q ON q.x = sa AND q.y = sb JOIN sim o ON o.x = one AND o.y = other JOIN sim c ON c.x = com AND c.y = one JOIN sim d ON d.x = com AND d.y = other JOIN best ON best.a = s.a AND best.b = s.b)"""


@query(f"WITH RECURSIVE {_INDEL} SELECT id, round(ratio, 6) AS ratio, round(token_sort_ratio, 6) AS token_sort_ratio, round(token_set_ratio, 6) AS token_set_ratio, round(partial_ratio, 6) AS partial_ratio FROM pp JOIN got USING (a, b)")
def indel_ratios(spark, d):
    a, b = F.col("a"), F.col("b")
    return _part_pairs(spark, d).select("id", *[F.round(f(a, b), 6).alias(f.__name__) for f in (kernels.ratio, kernels.token_sort_ratio, kernels.token_set_ratio, kernels.partial_ratio)])


@query(f"""WITH {_PART_PAIRS}, s AS (SELECT id, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM pp), m AS (SELECT id, list_sort(list_distinct(x)) AS x, list_sort(list_distinct(y)) AS y, len(list_intersect(x, y)) AS n FROM s)
SELECT id, round(CASE WHEN x = y THEN 1.0 ELSE CAST(n AS DOUBLE) / (len(x) + len(y) - n) END, 6) AS legal, CAST(CASE WHEN x[1] = y[1] THEN 2 ELSE 3 END AS INTEGER) AS state, round(CAST(n AS DOUBLE) / (len(x) + len(y) - n), 6) AS jac FROM m""")
def legal_match_states(spark, d):
    x, y = F.split("a", " "), F.split("b", " ")
    first = lambda c: F.element_at(token_set(c), 1)
    return _part_pairs(spark, d).select("id", F.round(legal_match(x, y), 6).alias("legal"), side_state(first(x), first(y)).alias("state"), F.round(jaccard(x, y), 6).alias("jac"))


_ABBREVIATES = "length({x}) >= 2 AND length({x}) < length({y}) AND substr({x}, 1, 1) = substr({y}, 1, 1) AND regexp_matches({y}, '^' || array_to_string(string_split({x}, ''), '.*'))"


@query(f"""WITH {NAMES}, e AS (SELECT DISTINCT id, unnest(t) AS word FROM names), idf AS (SELECT word, ln(((SELECT count(*) FROM names) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) + 1 AS w FROM e GROUP BY word),
 x AS (SELECT id, word, w FROM e JOIN idf USING (word)), m AS (SELECT a.id, a.word AS a, a.w AS wa, b.word AS b, b.w AS wb, CASE WHEN a.word = b.word THEN 1.0 WHEN regexp_full_match(a.word, '[0-9]+') OR regexp_full_match(b.word, '[0-9]+') THEN 0.0
  WHEN {_ABBREVIATES.format(x='a.word', y='b.word')} OR {_ABBREVIATES.format(x='b.word', y='a.word')} THEN 0.9 ELSE jaro_winkler_similarity(a.word, b.word) END AS s FROM x a JOIN x b ON b.id = a.id + 1),
 best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY id, a ORDER BY s DESC, b) = 1), norm AS (SELECT id, sqrt(sum(w * w)) AS n FROM x GROUP BY id),
 part_a AS (SELECT id, sum(CASE WHEN s >= 0.88 THEN wa * wb * s ELSE 0 END) AS dot, max(CASE WHEN s < 0.88 THEN wa ELSE 0 END) AS miss FROM best GROUP BY id),
 part_b AS (SELECT x.id - 1 AS id, max(CASE WHEN h.b IS NULL THEN x.w ELSE 0 END) AS miss FROM x LEFT JOIN (SELECT DISTINCT id, b FROM best WHERE s >= 0.88) h ON h.id = x.id - 1 AND h.b = x.word GROUP BY 1)
SELECT id, round(dot / (p.n * q.n), 6) AS score, round(part_a.miss, 6) AS miss_a, round(part_b.miss, 6) AS miss_b FROM part_a JOIN part_b USING (id) JOIN norm p USING (id) JOIN norm q ON q.id = part_a.id + 1""")
def soft_tfidf_names(spark, d):
    n = names(spark, d).select("id", F.lit(1).alias("src"), "t")
    w = with_idf(n, {"t": ["t"]}).select("id", "t_w")
    x = w.join(w.select((F.col("id") - 1).alias("id"), F.col("t_w").alias("o")), "id").select("id", soft_udf("t_w", "o").alias("s"))
    return x.select("id", *[F.round(f"s.{c}", 6).alias(c) for c in ("score", "miss_a", "miss_b")])


@query(f"WITH {NAMES}, e AS (SELECT DISTINCT id, unnest(t) AS word FROM names) SELECT word, round(ln(((SELECT count(*) FROM names) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) + 1, 6) AS idf FROM e GROUP BY word")
def idf_table(spark, d):
    return idf(names(spark, d), "t").select("word", F.round("idf", 6).alias("idf"))


def _spelled_pairs(spark, d):
    """Part names with the next part's, or with themselves without the vowels after a word's first letter."""
    p = _part_pairs(spark, d)
    short = F.regexp_replace("a", r"\B[aeiou]", "")
    return p.select("a", F.when(F.col("id") % 3 == 0, F.col("b")).otherwise(short).alias("b"))


_VOTES = rf"""{_PART_PAIRS}, sp AS (SELECT id, string_split(a, ' ') AS x, string_split(CASE WHEN id % 3 = 0 THEN b ELSE regexp_replace(a, '\B[aeiou]', '', 'g') END, ' ') AS y FROM pp),
 one AS (SELECT list_distinct(list_filter(x, lambda v: NOT list_contains(y, v))) AS x, list_distinct(list_filter(y, lambda v: NOT list_contains(x, v))) AS y FROM sp), side AS (SELECT * FROM one WHERE len(x) BETWEEN 1 AND 8 AND len(y) BETWEEN 1 AND 8),
 seen AS (SELECT short, count(*) AS seen FROM (SELECT unnest(list_concat(x, y)) AS short FROM side) GROUP BY 1), both_ AS (SELECT p, unnest(y) AS q FROM (SELECT unnest(x) AS p, y FROM side)), turned AS (SELECT p, q FROM both_ UNION ALL SELECT q, p FROM both_),
 votes AS (SELECT p AS short, q AS long, count(*) AS votes FROM turned WHERE length(q) - length(p) >= 2 AND regexp_matches(q, '^' || array_to_string(string_split(p, ''), '.*')) GROUP BY 1, 2)"""


@query(f"WITH {_VOTES} SELECT short, long, votes, seen FROM votes JOIN seen USING (short)")
def abbrev_votes(spark, d):
    return lexicon.abbreviation_votes(_spelled_pairs(spark, d))


@query(f"""WITH {_VOTES}, t AS (SELECT *, sum(votes) OVER (PARTITION BY short) AS total, row_number() OVER (PARTITION BY short ORDER BY votes DESC, long) AS k FROM votes JOIN seen USING (short)),
 kept AS (SELECT short, long FROM t WHERE k = 1 AND votes >= 5 AND votes >= 0.6 * total AND votes >= 0.3 * seen) SELECT short, long FROM kept WHERE short NOT IN (SELECT long FROM kept)""")
def abbrev_mined(spark, d):
    return lexicon.mine_abbreviations(_spelled_pairs(spark, d))


# Names that end in two words of kinds, peeled off one after the other.
_TYPED = "names3 AS (SELECT p_partkey AS id, list_concat(string_split(p_name, ' '), string_split(lower(p_type), ' ')) AS t FROM part)"


def _tail_sql(k: int) -> str:
    """Round ``k`` of peeling, after the words of the rounds before."""
    found = " UNION ALL ".join(f"SELECT word FROM r{i}" for i in range(1, k)) or "SELECT '' AS word WHERE false"
    names_ = f"n{k} AS (SELECT id, t[1:greatest(1, coalesce(list_max(list_transform(t, lambda x, p: CASE WHEN list_contains(ws, x) THEN 0 ELSE p END)), 0))] AS t FROM names3, (SELECT coalesce(list(word), []) AS ws FROM ({found})))" if k > 1 else "n1 AS (SELECT * FROM names3)"
    return f"""{names_}, s{k} AS (SELECT word, count(*) AS n FROM (SELECT DISTINCT id, unnest(t) AS word FROM n{k} WHERE len(t) >= 2) GROUP BY word), l{k} AS (SELECT t[-1] AS word, count(*) AS n_last FROM n{k} WHERE len(t) >= 2 GROUP BY 1),
 r{k} AS (SELECT word FROM s{k} JOIN l{k} USING (word) WHERE n_last >= 0.55 * n AND n >= 0.002 * (SELECT count(*) FROM n{k} WHERE len(t) >= 2) AND NOT regexp_matches(word, '^[0-9]+$'))"""


@query(f"WITH {_TYPED}, {_tail_sql(1)}, {_tail_sql(2)}, {_tail_sql(3)}, {_tail_sql(4)} SELECT DISTINCT word FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4)")
def legal_tails(spark, d):
    """All rounds of peeling words off the ends of names."""
    p = table(spark, d, "part").select(F.concat(F.split("p_name", " "), F.split(F.lower("p_type"), " ")).alias("t"))
    return spark.createDataFrame([(w,) for w in sorted(lexicon.mine_tails(p))], "word string")


@query(f"""WITH {NAMES}, s AS (SELECT word, count(*) AS n FROM (SELECT DISTINCT id, unnest(t) AS word FROM names WHERE len(t) >= 2) GROUP BY word), l AS (SELECT t[-1] AS word, count(*) AS n_last FROM names WHERE len(t) >= 2 GROUP BY 1)
SELECT word, n, n_last FROM s JOIN l USING (word) WHERE n_last >= 0.55 * n AND n >= 0.002 * (SELECT count(*) FROM names WHERE len(t) >= 2)""")
def legal_token_mining(spark, d):
    return lexicon.tail_round(names(spark, d))


@query(f"""WITH {_PART_PAIRS}, s AS (SELECT id AS i, 'near ' || a || ', ' || a AS raw, a AS other FROM pp), c AS (SELECT {words_sql(fold_sql('u'))} AS t, string_split(other, ' ') AS o FROM (SELECT unnest(string_split(raw, ',')) AS u, other FROM s)),
 c2 AS (SELECT * FROM c UNION ALL SELECT string_split(a, ' ') AS t, list_concat(['near'], string_split(a, ' ')) AS o FROM pp),
 w AS (SELECT t[1] AS word, CASE WHEN len(list_intersect(t, o)) = 0 THEN 1 ELSE 0 END AS opens, CASE WHEN len(list_intersect(t, o)) > 0 AND list_contains(o, t[1]) THEN 1 ELSE 0 END AS shared FROM c2 WHERE len(t) >= 2),
 n AS (SELECT word, count(*) AS anywhere FROM (SELECT unnest(t) AS word FROM c2) GROUP BY word)
SELECT w.word, CAST(sum(opens) AS BIGINT) AS opens, CAST(sum(shared) AS BIGINT) AS shared, max(anywhere) AS anywhere FROM w JOIN n USING (word) GROUP BY w.word""")
def landmark_cues(spark, d):
    p = _part_pairs(spark, d).select(F.concat(F.lit("near "), "a", F.lit(", "), "a").alias("a"), F.col("a").alias("b"))
    return lexicon.landmark_cue_counts(p)


@query(f"WITH {_PART_PAIRS}, s AS (SELECT id, list_distinct(string_split(a, ' ')) AS x, string_split(b, ' ') AS y FROM pp) SELECT id, array_to_string(list_sort(list_filter(x, lambda w: list_contains(y, w))), ' ') AS shared FROM s")
def shared_words_marked(spark, d):
    return _part_pairs(spark, d).select("id", F.array_join(F.array_sort(shared_words(F.col("a"), F.col("b"))), " ").alias("shared"))


@query(f"WITH {_PART_PAIRS}, f AS (SELECT id, string_split(a, ' ')[1] AS x, string_split(b, ' ')[1] AS y FROM pp) SELECT id, length(x) < length(y) AND regexp_matches(y, '^' || array_to_string(string_split(x, ''), '.*')) AS is_abbrev FROM f")
def abbreviation_test(spark, d):
    x, y = F.element_at(F.split("a", " "), 1), F.element_at(F.split("b", " "), 1)
    return _part_pairs(spark, d).select("id", is_abbreviation(x, y).alias("is_abbrev"))


@query(f"WITH t AS (SELECT doc_id, {words_sql(fold_sql("coalesce(text, '')"))} AS t FROM documents) SELECT doc_id, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM t")
def token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(F.array_distinct(tokens(F.col("text")))).cast("long").alias("n_distinct"))
