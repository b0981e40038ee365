"""Views over the driver's tables that stand in for linkage inputs, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.records import clean_records


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def recs(spark: SparkSession, d: str) -> DataFrame:
    """Source records: the first two lines of a document are its name and address, its source decides the side."""
    docs = table(spark, d, "documents")
    src = 1 + F.substring("source", 4, 9).cast("int") % 3
    text = F.coalesce("text", F.lit(""))
    raw = docs.select(F.concat(F.lit("S"), src, F.lit("-"), "doc_id").alias("entity_id"), F.split_part(text, F.lit("\n"), F.lit(1)).alias("business_name"), F.split_part(text, F.lit("\n"), F.lit(2)).alias("business_address"), F.col("lang").alias("country"))
    return clean_records(raw).withColumn("src", F.substring("entity_id", 2, 1).cast("int"))


RECS = r"""recs AS (
 SELECT 'S' || s || '-' || doc_id AS entity_id, regexp_replace(split_part(t, chr(10), 1), '^\s+|\s+$', '', 'g') AS business_name,
  regexp_replace(split_part(t, chr(10), 2), '^\s+|\s+$', '', 'g') AS business_address, coalesce(lang, '') AS country, CAST(s AS INTEGER) AS src
 FROM (SELECT *, 1 + CAST(substr(source, 4) AS INTEGER) % 3 AS s, coalesce(text, '') AS t FROM documents))"""


def fold_sql(x: str) -> str:
    return rf"trim(regexp_replace(replace(strip_accents(lower(regexp_replace({x}, '\s*&\s*', ' and ', 'g'))), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g'))"


def fold_marks_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({x})), '[''’`]', '', 'g'), '[&+]', ' and ', 'g'), '[^a-z0-9ß]+', ' ', 'g'))"


def skeleton_sql(x: str) -> str:
    steps = [("ph", "f"), ("ck|q|c", "k"), ("[vw]", "w"), ("z", "s"), ("([a-z])h", r"\1"), ("(^| )[aeiouy]+", r"\1a"), ("([a-z])[aeiouy]+", r"\1")]
    for a, b in [*steps, *((f"{c}{c}+", c) for c in "bdfgjklmnprstwx")]:
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return x


def words_sql(folded: str) -> str:
    return f"list_filter(string_split({folded}, ' '), lambda x: x <> '')"


def pair_graph(spark: SparkSession, d: str) -> DataFrame:
    """Scored pairs of orders (i) and parts (j) with a truth y."""
    p = ((F.max("l_quantity") - F.lit(0.5).cast("double")) / F.lit(50).cast("double")).alias("p")
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j")).agg(p, F.max((F.col("l_returnflag") == "R").cast("int")).alias("y"))


PAIRS = """pairs AS (
 SELECT l_orderkey AS i, l_partkey AS j, (max(CAST(l_quantity AS DOUBLE)) - 0.5::DOUBLE) / 50::DOUBLE AS p, CAST(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS INTEGER) AS y
 FROM lineitem GROUP BY 1, 2)"""


def universe(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("i")).distinct()


UNIVERSE = "universe AS (SELECT DISTINCT o_orderkey AS i FROM orders)"


def names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("t"))


NAMES = "names AS (SELECT p_partkey AS id, string_split(p_name, ' ') AS t FROM part)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors; those whose label is 0 are the reference side."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") == 0, 1).otherwise(2).alias("src"), F.col("embedding").cast("array<double>").alias("v"))
