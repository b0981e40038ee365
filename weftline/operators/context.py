"""Context of scored pairs (i, j, p): windows over each side's competition, and sibling support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def odds(p: Column, most: float = 0.999) -> Column:
    return p / (1 - F.least(p, F.lit(most)))


def ranks_and_gaps(pairs: DataFrame) -> DataFrame:
    """Rank, gap to the best and sum of the others for either side; counts of strong candidates and of claimants.

    A popular record has many claims: what they share is aggregated and joined, and a claim's rank is one more than the
    claims of greater values, which are counted by value.
    """
    out = pairs
    for side in ("i", "j"):
        more = {"i": F.count_if(F.col("p") >= 0.5).alias("ctx_nhi_i"), "j": F.count("*").alias("ctx_cnt_j")}[side]
        whole = pairs.groupBy(side).agg(F.max("p").alias("__most"), F.sum("p").alias("__sum"), more)
        by_value = pairs.groupBy(side, "p").agg(F.count("*").alias("__n"))
        above = F.coalesce(F.sum("__n").over(Window.partitionBy(side).orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        places = by_value.select(side, "p", (above + 1).alias(f"ctx_rank_{side}"))
        out = out.join(places, [side, "p"]).join(whole, side)
        out = out.withColumn(f"ctx_gap_{side}", F.col("__most") - F.col("p")).withColumn(f"ctx_sum_{side}", F.col("__sum") - F.col("p")).drop("__most", "__sum")
    return out.select(*pairs.columns, *[f"ctx_{c}_{s}" for s in "ij" for c in ("rank", "gap", "sum")], "ctx_nhi_i", "ctx_cnt_j")


def margins(pairs: DataFrame) -> DataFrame:
    """p less the best other candidate of i; p itself where there is none."""
    w = Window.partitionBy("i").orderBy(F.desc("p"), "j")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    other = F.when(F.row_number().over(w) == 1, F.nth_value("p", 2).over(whole)).otherwise(F.first("p").over(whole))
    return pairs.select("*", (F.col("p") - F.coalesce(other, F.lit(0.0))).alias("ctx_margin_i"))


def exclusive_share(pairs: DataFrame) -> DataFrame:
    """The share of j's odds that this claim has, with a claim of weight 1 for nobody."""
    o = odds(F.col("p"))
    total = pairs.groupBy("j").agg(F.sum(o).alias("__total"))
    return pairs.join(total, "j").select(*pairs.columns, (o / (1 + F.col("__total"))).alias("ctx_excl_j"))


def sibling_support(pairs: DataFrame, likeness: DataFrame, *, least: float = 0.3) -> DataFrame:
    """(i, j, ctx_support, ctx_nsib): confident other candidates of i, weighted by how alike the records are.

    ``likeness`` (j, j2, s); candidates of an i are few, so the join on i stays small.
    """
    mine = pairs.select("i", "j")
    others = pairs.where(F.col("p") >= least).select("i", F.col("j").alias("j2"), F.col("p").alias("p2"))
    met = mine.join(others, "i").where("j <> j2").join(likeness, ["j", "j2"])
    got = met.groupBy("i", "j").agg(F.max(F.col("p2") * F.col("s")).alias("ctx_support"), F.count("*").alias("ctx_nsib"))
    return mine.join(got, ["i", "j"], "left").fillna(0, ["ctx_support", "ctx_nsib"])
