"""Blocking by key families: each record emits keys of several kinds, capped and weighted by how rare they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.tokens import token_set, unordered_pairs
from weftline.sources.cut import cut

#: Most reference records, most other records and weight of a key of each family; fixed values.
CAPS = {"nt": (40, 200, 1.0), "np": (40, 200, 1.0), "ns": (40, 200, 1.5), "sk": (40, 200, 0.8), "ah": (40, 200, 1.0), "aw": (40, 200, 0.7)}


def _tail(t: Column, n: int) -> Column:
    return F.slice(t, F.greatest(F.lit(1), F.size(t) - n + 1), F.lit(n))


def family_keys(r: DataFrame, family: str, *, unique: bool = False) -> DataFrame:
    """(id, src, key) of one family, distinct; where ids are ``unique`` they are so without a shuffle. Records have country, nt, nsk, at (words), an (numbers), n_indic.

    nt: name words; np, sk, aw: pairs of name words, of their phonetic keys, of address words; ns: names written
    together, whole and in parts; ah: house number with address word.
    """
    if family == "nt":
        keys = F.filter(F.array_distinct("nt"), lambda x: F.length(x) >= 2)
    elif family in ("np", "sk", "aw"):
        first = F.slice({"np": "nt", "sk": "nsk", "aw": "at"}[family], 1, 8)
        keys = F.transform(unordered_pairs(first), lambda p: F.concat_ws("\x1f", p["a"], p["b"]))
        if family == "sk":
            r = r.where("src = 1 OR n_indic")
    elif family == "ns":
        t = F.col("nt")
        spans = F.array(*[F.array_join(x, "") for x in (t, F.slice(t, 1, 2), F.slice(t, 1, 3), _tail(t, 2))])
        keys = F.filter(F.array_distinct(spans), lambda x: F.length(x) >= 6)
    elif family == "ah":
        some, near = token_set(F.slice("an", 1, 4)), token_set(F.slice("at", 1, 8))
        keys = F.flatten(F.transform(some, lambda n: F.transform(near, lambda w: F.concat_ws("\x1f", n, w))))
    else:
        raise ValueError(family)
    each = r.select("id", "src", "country", F.explode(keys).alias("k"))
    out = each.select("id", "src", F.concat_ws("\x1f", F.lit(family), "country", "k").alias("key"))
    return out if unique else out.distinct()


def all_keys(r: DataFrame, families: list[str], *, unique: bool = False) -> DataFrame:
    """(fam, id, src, key) of several families: one table that counts and joins read."""
    out = None
    for f in families:
        part = family_keys(r, f, unique=unique).select(F.lit(f).alias("fam"), "id", "src", "key")
        out = part if out is None else out.unionByName(part)
    return out


def weighted_keys(keys: DataFrame, n_others: DataFrame) -> DataFrame:
    """(fam, key, n1, n2, w) of keys within their family's caps. ``n_others`` is one row with n_r."""
    cap = [F.element_at(F.create_map(*[F.lit(x) for f, c in CAPS.items() for x in (f, float(c[k]))]), F.col("fam")) for k in range(3)]
    n = keys.groupBy("fam", "key").agg(F.count_if(F.col("src") == 1).alias("n1"), F.count_if(F.col("src") != 1).alias("n2"))
    n = n.where((F.col("n1") >= 1) & (F.col("n1") <= cap[0]) & (F.col("n2") >= 1) & (F.col("n2") <= cap[1]))
    return n.crossJoin(F.broadcast(n_others)).select("fam", "key", "n1", "n2", (cap[2] * (F.log("n_r") - F.log("n2"))).alias("w"))


def others(r: DataFrame) -> DataFrame:
    return r.agg(F.count_if(F.col("src") != 1).cast("double").alias("n_r"))


def key_table_pairs(keys: DataFrame, n_others: DataFrame) -> DataFrame:
    """(i, j, fam, w): the heaviest shared key of each pair in each family."""
    w = weighted_keys(keys, n_others).select("fam", "key", "w")
    a = keys.where("src = 1").select("fam", F.col("id").alias("i"), "key")
    b = keys.where("src <> 1").select("fam", F.col("id").alias("j"), "key")
    return a.join(w, ["fam", "key"]).join(b, ["fam", "key"]).groupBy("i", "j", "fam").agg(F.max("w").alias("w"))


def neighbours(keys: DataFrame, n_others: DataFrame) -> DataFrame:
    """(j, near): for each other record the distinct reference records that share a key within the caps with it.

    Keys go by 64-bit hashes, and only those within the caps are brought together, so a key's lists are bounded.
    """
    keys = keys.select("fam", "id", "src", F.xxhash64("key").alias("key"))
    met = keys.join(weighted_keys(keys, n_others).select("fam", "key"), ["fam", "key"])
    ahead, back = (F.collect_set(F.when(c, F.col("id"))).alias(n) for c, n in ((F.col("src") == 1, "near"), (F.col("src") != 1, "js")))
    each = met.groupBy("fam", "key").agg(ahead, back).select(F.explode("js").alias("j"), "near")
    return each.groupBy("j").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def family_pairs(r: DataFrame, families: list[str]) -> DataFrame:
    """(i, j, fam, w) of several families; records and keys are prepared once."""
    r = cut(r)
    return key_table_pairs(cut(all_keys(r, families)), others(r))


def fused(pairs: DataFrame, families: list[str], *, top: int = 30, reverse: int = 3) -> DataFrame:
    """Sum of family weights with a column for each family; kept by rank from either side."""
    pool = pairs.groupBy("i", "j").agg(F.sum("w").alias("score"), *[F.coalesce(F.max(F.when(F.col("fam") == f, F.col("w"))), F.lit(0.0)).alias(f"b_{f}") for f in families])
    by = lambda a, b: F.row_number().over(Window.partitionBy(a).orderBy(F.desc(F.round("score", 9)), b))
    return pool.select("*", by("i", "j").alias("rank_i"), by("j", "i").alias("rank_j")).where(f"rank_i <= {top} OR rank_j <= {reverse}")


def rarest_words(r: DataFrame, words: str, most: int = 3) -> DataFrame:
    """(id, src, word, df, k): the rarest words of each record that two records or more have."""
    each = r.select("id", "src", F.explode(F.array_distinct(words)).alias("word"))
    df = each.groupBy("word").agg(F.count("*").alias("df")).where("df >= 2")
    k = F.row_number().over(Window.partitionBy("id").orderBy("df", "word"))
    return each.join(df, "word").withColumn("k", k).where(F.col("k") <= most)


def rarest_keys(r: DataFrame, most: int = 3) -> DataFrame:
    """(id, src, key) of each record's rarest address words: ``ar`` pairs of them, ``hr`` one with a house number."""
    rare = rarest_words(r.select("id", "src", "at"), "at", most).groupBy("id", "src").agg(F.array_sort(F.collect_list("word")).alias("ws"))
    x = rare.join(r.select("id", "src", "an"), ["id", "src"])
    pairs = F.transform(unordered_pairs(F.col("ws")), lambda p: F.concat_ws("\x1f", F.lit("ar"), p["a"], p["b"]))
    numbers = F.flatten(F.transform(token_set(F.slice("an", 1, 4)), lambda n: F.transform("ws", lambda w: F.concat_ws("\x1f", F.lit("hr"), n, w))))
    return x.select("id", "src", F.explode(F.concat(pairs, numbers)).alias("key")).distinct()
