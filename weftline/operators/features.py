"""Prepared records and the features of candidate pairs, in the order that a stored model expects."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from weftline.functions import kernels
from weftline.functions.address import address_slots
from weftline.functions.phonetic import has_indic, skeleton, transliterate
from weftline.functions.tokens import (
    ADDRESS_NOISE, NAME_NOISE, STREET_WORDS, acronym, house_numbers, identity_words, is_abbreviation, jaccard, legal_match, replaced, side_state, strip_tail, token_set, tokens, without, words,
)
from weftline.functions.unicode import fold_marks

#: Name tails where none were mined; fixed values.
LEGAL = {"llc", "inc", "ltd", "limited", "private", "corp", "gmbh", "sarl", "sas", "sa"}
CHANNELS = ["name_char", "full_char", "word", "name_char_rev", "full_char_rev", "word_rev", "keys"]
SOFT = 0.88
#: Feature order; fixed values.
PAIR_FEATURES = (
    "n_ratio n_tsort n_tset n_partial c_ratio c_tset c_jw c_cat_ratio id_ratio id_tset a_ratio a_tset a_tsort n_soft n_miss_a "
    "n_miss_b c_soft id_soft id_miss_a id_miss_b a_soft a_miss_a a_miss_b st_soft tl_soft first_eq acr_hit tail_jacc pc_state pc3 "
    "house_state house_part num_jacc num_conflict country_grp country_label c_equal c_len_a c_len_b a_len_a a_len_b lm_a lm_b src "
    "name_x_addr ident_x_addr dens_s1 dens_r"
).split() + [f"{c}_{v}" for c in CHANNELS for v in ("rank", "sim")] + ["rrf", "n_channels", "pool_rank"]
CONTEXT_FEATURES = "ctx_p ctx_rank_i ctx_gap_i ctx_sum_i ctx_nhi_i ctx_margin_i ctx_rank_j ctx_gap_j ctx_sum_j ctx_cnt_j ctx_excl_j ctx_support ctx_nsib".split()


def prepare(records: DataFrame, abbreviations: dict[str, str] | None = None, legal: set[str] | None = None, cues: set[str] | None = None) -> DataFrame:
    """Source records (entity_id, business_name, business_address, country, src) with all that pairs compare."""
    abbreviations, legal = abbreviations or {}, sorted(legal or LEGAL)
    slots = address_slots(F.col("business_address"), abbreviations, frozenset(cues)) if cues else address_slots(F.col("business_address"), abbreviations)
    r = records.select(F.col("entity_id").alias("id"), "src", F.col("business_name").alias("name_raw"), F.col("business_address").alias("addr_raw"), "country", replaced(tokens(F.col("business_name")), abbreviations).alias("name_toks"), slots.alias("s"))
    r = r.select("*", strip_tail(F.col("name_toks"), legal).alias("core"), identity_words(F.col("name_toks"), legal).alias("ident"))
    return r.select(
        "id", "src", "name_raw", "addr_raw", "country", "name_toks", "core",
        F.slice("name_toks", F.size("core") + 1, F.greatest(F.size("name_toks") - F.size("core"), F.lit(0))).alias("legal_tail"),
        F.array_join("name_toks", " ").alias("name_str"), F.array_join("core", " ").alias("core_str"), F.array_join("core", "").alias("core_cat"),
        acronym(F.col("core")).alias("acr"), "s.house", "s.postcode", "s.numbers", "s.street", F.col("s.tail").alias("addr_tail"),
        F.col("s.tokens").alias("addr_toks"), F.array_join("s.tokens", " ").alias("addr_str"), "s.landmark", "ident",
        F.array_join(F.array_sort("ident"), " ").alias("ident_str"),
    )


def prepare_families(records: DataFrame) -> DataFrame:
    """Source records with the word lists that key families use."""
    name, address = F.coalesce("business_name", F.lit("")), F.coalesce("business_address", F.lit(""))
    r = records.select("entity_id", "src", F.coalesce("country", F.lit("")).alias("country"), has_indic(name).alias("n_indic"), has_indic(address).alias("a_indic"), fold_marks(transliterate(name)).alias("nf"), fold_marks(transliterate(address)).alias("af0"))
    r = r.select("*", words(F.col("nf")).alias("ntall"), replaced(words(F.col("af0")), STREET_WORDS).alias("atall"))
    r = r.select("*", without(F.col("ntall"), NAME_NOISE).alias("nt"), F.filter(without(F.col("atall"), ADDRESS_NOISE), lambda x: ~x.rlike(r"(?U)\d") & (F.length(x) > 1)).alias("at"))
    return r.select(
        F.col("entity_id").alias("id"), "src", "country", "n_indic", "a_indic", "nf", "ntall", "atall", "nt", F.array_join("atall", " ").alias("af"), "at",
        house_numbers(F.col("af0")).alias("an"), F.array_join("nt", "").alias("nsq"), words(skeleton(F.array_join("nt", " "))).alias("nsk"),
    )


def record_keys() -> Column:
    """Deterministic keys of a prepared record: postcode, house and street, name words, name together, name and
    house, initials."""
    some = lambda c, *p: F.when(c, F.concat_ws("|", *p))
    core = F.col("core")
    keys = F.array(
        some(F.col("postcode") != "", F.lit("pc"), "postcode"),
        some((F.col("house") != "") & (F.size("street") > 0), F.lit("hs"), "house", F.get("street", F.lit(0))),
        some(F.size(core) > 0, F.lit("nm"), F.array_join(token_set(core), " ")),
        some(F.col("core_cat") != "", F.lit("cc"), "core_cat"),
        some((F.size(core) > 0) & (F.col("house") != ""), F.lit("nh"), F.get(core, F.lit(0)), "house"),
        some(F.length("acr") >= 2, F.lit("ac"), "acr"),
    )
    return F.filter(keys, lambda x: x.isNotNull())


def idf(docs: DataFrame, column: str) -> DataFrame:
    """(word, idf) over the word lists of all records."""
    n = docs.agg(F.count("*").cast("double").alias("n"))
    df = docs.select(F.explode(F.array_distinct(column)).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("word", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))  # one row


def word_similarity(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if a.isdigit() or b.isdigit():
        return 0.0
    short, long = sorted((a, b), key=len)
    rest = iter(long)
    if len(short) >= 2 and len(short) < len(long) and short[0] == long[0] and all(c in rest for c in short):
        return 0.9
    return kernels.jaro_winkler(a, b)


def soft_tfidf(a: dict[str, float], b: dict[str, float]) -> tuple[float, float, float]:
    """(soft cosine, greatest idf of an unmatched word of a, of b) of word -> idf; all 0 where a side has no words.

    Each word of a takes the word of b that is most like it, the lesser of equals, if it is like enough.
    """
    if not a or not b:
        return 0.0, 0.0, 0.0
    dot, miss, met = 0.0, 0.0, set()
    others = sorted(b)
    for w in sorted(a):
        v = w if w in b else max(others, key=lambda v: word_similarity(w, v))
        alike = word_similarity(w, v)
        if alike >= SOFT:
            dot += a[w] * b[v] * alike
            met.add(v)
        else:
            miss = max(miss, a[w])
    norm = math.sqrt(sum(x * x for x in a.values())) * math.sqrt(sum(x * x for x in b.values()))
    return dot / norm, miss, max((x for w, x in b.items() if w not in met), default=0.0)


@F.pandas_udf(StructType([StructField(c, DoubleType()) for c in ("score", "miss_a", "miss_b")]))
def soft_udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Of two columns of word -> idf maps."""
    as_dict = lambda x: dict(x) if x is not None else {}
    return pd.DataFrame([soft_tfidf(as_dict(x), as_dict(y)) for x, y in zip(a, b, strict=True)], columns=["score", "miss_a", "miss_b"])


def with_idf(records: DataFrame, columns: dict[str, list[str]], tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Adds <column>_w, a map of each record's words to idf, and <source>_top, the greatest idf.

    ``columns``: by the column whose words are counted, those whose words are weighed. Weights come by a join on the word.
    ``tables``: (word, idf) by source where they are known; a word that isn't in its table weighs as the rarest.
    """
    out = records
    for source, weighed in columns.items():
        w = tables[source] if tables else idf(records, source)
        top = F.broadcast(w.agg(F.coalesce(F.max("idf"), F.lit(1.0)).alias(f"{source}_top")))  # one row
        out = out.crossJoin(top)
        for c in weighed:
            each = records.select("id", "src", F.explode(F.array_distinct(c)).alias("word"))
            each = each.join(w, "word", "left").crossJoin(top).withColumn("idf", F.coalesce("idf", f"{source}_top")) if tables else each.join(w, "word")
            maps = each.groupBy("id", "src").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "idf")))).alias(f"{c}_w"))
            out = out.join(maps, ["id", "src"], "left")
    return out


#: The columns whose words are counted, and those that are weighed by the counts.
WEIGHED = {"name_toks": ["name_toks", "core", "ident"], "addr_toks": ["addr_toks", "street", "addr_tail"]}


def name_counts(records: DataFrame) -> DataFrame:
    """(side, core_str, n): how many records of a side have a name."""
    return records.groupBy(F.when(F.col("src") == 1, 1).otherwise(2).alias("side"), "core_str").agg(F.count("*").alias("n"))


def pair_features(pool: DataFrame, records: DataFrame, groups: dict[str, str] | None = None, *, tables: dict[str, DataFrame] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """All pairwise features of a pool (i, j, fused columns) of prepared records.

    ``tables`` and ``counts``: word weights and name counts of a larger population, of which these are some records.
    """
    rec = with_idf(records, WEIGHED, tables).withColumn("side", F.when(F.col("src") == 1, 1).otherwise(2))
    # Counted and joined, so that a name of many records isn't one task.
    n = (name_counts(records) if counts is None else counts).withColumn("dens", F.log1p("n")).drop("n")
    rec = rec.join(n, ["side", "core_str"], "left").fillna(math.log(2), ["dens"])
    a = rec.where("src = 1").select(*[F.col(c).alias(f"a_{c}") for c in rec.columns]).withColumnRenamed("a_id", "i")
    b = rec.where("src <> 1").select(*[F.col(c).alias(f"b_{c}") for c in rec.columns]).withColumnRenamed("b_id", "j")
    x = pool.join(a, "i").join(b, "j")
    A, B = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    both = lambda f, c: f(A(c), B(c))
    for name, c in (("n", "name_toks"), ("c", "core"), ("id", "ident"), ("a", "addr_toks"), ("st", "street"), ("tl", "addr_tail")):
        x = x.withColumn(f"__{name}", soft_udf(A(f"{c}_w"), B(f"{c}_w")))
    label = lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in sorted(groups.items()) for v in kv]), c), c) if groups else c
    parts = lambda c: F.split(F.regexp_replace(c, "-", "/"), "/")
    house_state = both(side_state, "house")
    both_cores = (F.size(A("core")) > 0) & (F.size(B("core")) > 0)
    made = {
        "n_ratio": both(kernels.ratio, "name_str"), "n_tsort": both(kernels.token_sort_ratio, "name_str"), "n_tset": both(kernels.token_set_ratio, "name_str"), "n_partial": both(kernels.partial_ratio, "name_str"),
        "c_ratio": both(kernels.ratio, "core_str"), "c_tset": both(kernels.token_set_ratio, "core_str"), "c_jw": both(kernels.jaro_winkler_ratio, "core_str"), "c_cat_ratio": both(kernels.ratio, "core_cat"),
        "id_ratio": both(kernels.ratio, "ident_str"), "id_tset": both(kernels.token_set_ratio, "ident_str"),
        "a_ratio": both(kernels.ratio, "addr_str"), "a_tset": both(kernels.token_set_ratio, "addr_str"), "a_tsort": both(kernels.token_sort_ratio, "addr_str"),
        **{f"{n}_soft": F.col(f"__{n}.score") for n in ("n", "c", "id", "a", "st", "tl")},
        **{f"{n}_miss_{s}": F.col(f"__{n}.miss_{s}") / A(f"{c}_top") for n, c in (("n", "name_toks"), ("id", "name_toks"), ("a", "addr_toks")) for s in "ab"},
        "first_eq": (both_cores & (kernels.token_similarity(F.coalesce(F.get(A("core"), F.lit(0)), F.lit("")), F.coalesce(F.get(B("core"), F.lit(0)), F.lit(""))) >= SOFT)).cast("int"),
        "acr_hit": (both_cores & (((F.length(A("acr")) >= 2) & F.array_contains(B("core"), A("acr"))) | ((F.length(B("acr")) >= 2) & F.array_contains(A("core"), B("acr"))))).cast("int"),
        "tail_jacc": both(legal_match, "legal_tail"), "pc_state": both(side_state, "postcode"),
        "pc3": ((A("postcode") != "") & (B("postcode") != "") & (F.substring(A("postcode"), 1, 3) == F.substring(B("postcode"), 1, 3))).cast("int"),
        "house_state": house_state, "house_part": ((house_state == 3) & F.arrays_overlap(parts(A("house")), parts(B("house")))).cast("int"),
        "num_jacc": both(jaccard, "numbers"), "num_conflict": ((F.size(A("numbers")) > 0) & (F.size(B("numbers")) > 0) & ~F.arrays_overlap(A("numbers"), B("numbers"))).cast("int"),
        "country_grp": F.when((A("country") == "") | (B("country") == ""), 0).when(label(A("country")) == label(B("country")), 2).otherwise(1), "country_label": ((A("country") != "") & (A("country") == B("country"))).cast("int"),
        "c_equal": (A("core_str") == B("core_str")).cast("int"), "c_len_a": F.size(A("core")), "c_len_b": F.size(B("core")), "a_len_a": F.size(A("addr_toks")), "a_len_b": F.size(B("addr_toks")),
        "lm_a": A("landmark").cast("int"), "lm_b": B("landmark").cast("int"), "src": B("src"), "dens_s1": A("dens"), "dens_r": B("dens"),
    }
    x = x.select("i", "j", *pool.drop("i", "j").columns, *[v.cast("double").alias(k) for k, v in made.items()])
    x = x.withColumn("name_x_addr", F.col("c_soft") * F.col("a_soft")).withColumn("ident_x_addr", F.col("id_soft") * F.col("a_soft"))
    return x.select("i", "j", *[F.col(c).cast("double").alias(c) if c in x.columns else F.lit(0.0).alias(c) for c in PAIR_FEATURES])


__all__ = ["CHANNELS", "CONTEXT_FEATURES", "PAIR_FEATURES", "idf", "is_abbreviation", "pair_features", "prepare", "prepare_families", "record_keys", "soft_tfidf", "soft_udf", "with_idf"]
