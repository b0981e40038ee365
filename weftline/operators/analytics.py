"""Reports and the review console's reads: profiles, browsing, claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def owners(pairs: DataFrame) -> DataFrame:
    """(j, n_claims, n_emitted, owner): claims of each record and its most probable emitted owner."""
    best = F.max(F.when(F.col("emitted"), F.struct("p", (-F.col("i")).alias("k"))))
    return pairs.groupBy("j").agg(F.count("*").alias("n_claims"), F.count_if("emitted").alias("n_emitted"), (-best["k"]).alias("owner"))


def contested(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """(j, n, top, ps): records that several entities claim with a probability of ``least`` or more."""
    strong = pairs.where(F.col("p") >= least).groupBy("j").agg(F.count("*").alias("n"), F.max("p").alias("top"))
    return strong.where("n > 1")


def match_sizes(universe: DataFrame, truth: DataFrame) -> DataFrame:
    """(size, n): how many entities have how many matches."""
    n = truth.groupBy("i").agg(F.count("*").alias("size"))
    return universe.select("i").join(n, "i", "left").groupBy(F.coalesce("size", F.lit(0)).alias("size")).agg(F.count("*").alias("n"))


def entity_flags(universe: DataFrame, pairs: DataFrame) -> DataFrame:
    """(i, n_candidates, n_emitted, best, is_contested) of every entity."""
    claimed = pairs.where("emitted").groupBy("j").agg(F.count("*").alias("claims"))
    x = pairs.join(claimed, "j", "left")
    n = x.groupBy("i").agg(F.count("*").alias("n_candidates"), F.count_if("emitted").alias("n_emitted"), F.max("p").alias("best"), F.max((F.col("emitted") & (F.col("claims") > 1)).cast("int")).alias("c"))
    return universe.join(n, "i", "left").select("i", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_candidates", "n_emitted")], F.coalesce("best", F.lit(0.0)).alias("best"), (F.coalesce("c", F.lit(0)) == 1).alias("is_contested"))


def browse(entities: DataFrame, *, kind: str = "all", search: str = "", text: Column | None = None, order: str = "i", offset: int = 0, limit: int | None = None) -> DataFrame:
    """A page of entities of one kind whose text holds the search. ``limit`` is the page's length."""
    kinds = {"all": F.lit(True), "matched": F.col("n_emitted") > 0, "singleton": F.col("n_emitted") == 0, "contested": F.col("is_contested")}
    out = entities.where(kinds[kind])
    if search and text is not None:
        out = out.where(F.contains(F.lower(text), F.lit(search.lower())))
    out = out.orderBy(order).offset(offset) if offset else out
    return out.orderBy(order).limit(limit) if limit else out


def competing(pairs: DataFrame, most: int = 3) -> DataFrame:
    """(i, j, rival, p_rival, k): the strongest other claims on each emitted record."""
    k = F.row_number().over(Window.partitionBy("i", "j").orderBy(F.desc("p_rival"), "rival"))
    top = Window.partitionBy("j").orderBy(F.desc("p"), "i")
    claims = pairs.withColumn("__r", F.row_number().over(top)).where(F.col("__r") <= most + 1)  # the strongest are enough
    x = pairs.where("emitted").select("i", "j").join(claims.select("j", F.col("i").alias("rival"), F.col("p").alias("p_rival")), "j").where("rival <> i")
    return x.withColumn("k", k).where(F.col("k") <= most)


def samples(records: DataFrame, by: str, seed: str, n: int = 1) -> DataFrame:
    """``n`` rows of each group, chosen by a hash of id and seed."""
    order = F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(seed)))
    return records.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(order, "id"))).where(F.col("k") <= n)


def peek(records: DataFrame, truth: DataFrame, n: int) -> DataFrame:
    """(i, j, name, matched_name, country) of ``n`` entities with matches, chosen by a hash. ``n`` is the report's length."""
    some = truth.select("i").distinct().orderBy(F.md5(F.concat_ws("|", F.col("i").cast("string"), F.lit("peek"))), "i").limit(n)
    side = records.select("entity_id", "business_name", "country")
    mine = side.select(F.col("entity_id").alias("i"), F.col("business_name").alias("name"))
    theirs = side.select(F.col("entity_id").alias("j"), F.col("business_name").alias("matched_name"), "country")
    return truth.join(F.broadcast(some), "i").join(mine, "i").join(theirs, "j")


def owner_counts(truth: DataFrame) -> DataFrame:
    """(owners, records): how many records have how many owners."""
    return truth.groupBy("j").agg(F.countDistinct("i").alias("owners")).groupBy("owners").agg(F.count("*").alias("records"))


def funnel(pairs: DataFrame, n_true: int, stages: dict[str, Column]) -> DataFrame:
    """(stage, n_pairs, n_entities, found, recall) of pairs (i, j, y) that each stage keeps, in their order."""
    one = pairs.agg(*[x for k, kept in enumerate(stages.values()) for x in (F.count_if(kept).alias(f"n{k}"), F.countDistinct(F.when(kept, F.col("i"))).alias(f"e{k}"), F.count_if(kept & (F.col("y") == 1)).alias(f"f{k}"))])
    rows = [F.struct(F.lit(s).alias("stage"), F.col(f"n{k}").alias("n_pairs"), F.col(f"e{k}").alias("n_entities"), F.col(f"f{k}").alias("found")) for k, s in enumerate(stages)]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*", (F.col("x.found") / F.lit(max(n_true, 1))).alias("recall"))
