"""Sources and sinks of record linkage: source records, truth lists, result lists, lexicon."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.unicode import strip_spaces

COLUMNS = ["entity_id", "business_name", "business_address", "country"]


def _tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("quote", "").option("header", True).option("nullValue", "\0").csv(path)


def clean_records(df: DataFrame) -> DataFrame:
    """Four text columns without nulls, stripped; other columns are dropped, missing ones are an error."""
    missing = [c for c in COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[strip_spaces(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in COLUMNS])


def with_source(df: DataFrame) -> DataFrame:
    """``src``: the digit after the first letter of the id, or 0."""
    digit = F.substring("entity_id", 2, 1)
    return df.withColumn("src", F.when(digit.rlike("^[0-9]$"), digit.cast("int")).otherwise(F.lit(0)))


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated records, all text: no quotes, ``NA`` is a value."""
    return clean_records(_tsv(spark, path))


def load_split(spark: SparkSession, root: str, split: str) -> tuple[DataFrame, DataFrame]:
    """(reference records, records of the other sources)."""
    one, two, three = (read_source(spark, f"{root}/{split}_source{i}.tsv") for i in (1, 2, 3))
    return one, two.unionByName(three)


def load_raw(spark: SparkSession, root: str, split: str, source: int) -> DataFrame:
    """The Parquet form where it was written, else the tab-separated one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{split}_s{source}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.read.parquet(str(path))
    return read_source(spark, f"{root}/{split}_source{source}.tsv")


def to_parquet(df: DataFrame, path: str) -> DataFrame:
    """Writes the table and reports its rows and distinct ids."""
    df.write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.parquet(path)
    return back.agg(F.count("*").alias("n_rows"), F.countDistinct(df.columns[0]).alias("n_ids"))


def split_ids(c: Column) -> Column:
    """Ids of a comma list, stripped, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip_spaces), lambda x: x != "")


def explode_truth(df: DataFrame) -> DataFrame:
    """(s1, r) rows of an id and its list; ids without matches give none, so keep their universe apart."""
    a, b = df.columns[:2]
    return df.select(strip_spaces(F.col(a)).alias("s1"), F.explode(split_ids(F.col(b))).alias("r")).where("s1 <> ''").distinct()


def read_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(universe of s1, links)."""
    raw = _tsv(spark, path)
    if len(raw.columns) < 2 or raw.columns[0].strip() != "source1_entity_id":
        raise ValueError("the truth needs an id column and a list column")
    return raw.select(strip_spaces(F.col(raw.columns[0])).alias("s1")).where("s1 <> ''").distinct(), explode_truth(raw)


def pair_lists(universe: DataFrame, pairs: DataFrame, *, order: str | None = None, column: str = "matched_entity_ids") -> DataFrame:
    """One row for each s1 of the universe with its distinct ids, joined by commas; empty where it has none.

    ``order``: ids by this column, largest first, then by id. A column ``pos`` of the universe stays.
    """
    key = F.struct((-F.col(order)).alias("o"), F.col("r")) if order else F.struct(F.col("r"))
    lists = pairs.groupBy("s1").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["r"])).alias("ids"))
    place = ["pos"] if "pos" in universe.columns else []
    return universe.join(lists, "s1", "left").select(*place, "s1", F.coalesce(F.array_join("ids", ","), F.lit("")).alias(column))


def _write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("quote", "").option("header", True).option("emptyValue", "").csv(path)


def write_pairs(path: str, lists: DataFrame) -> None:
    """Tab-separated, with a header and without quotes: one file, in the order of ``pos`` if there is one, else of s1."""
    named = lists.withColumnRenamed("s1", "source1_entity_id")
    ordered = named.orderBy("pos").drop("pos") if "pos" in named.columns else named.orderBy("source1_entity_id")
    _write_tsv(ordered.coalesce(1), path)


def write_source(df: DataFrame, path: str) -> None:
    """Source records as ``read_source`` reads them; tabs and line ends inside a value become spaces."""
    _write_tsv(df.select(*[F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]", " ").alias(c) for c in COLUMNS]), path)


def write_truth(universe: DataFrame, links: DataFrame, path: str) -> None:
    """The list of each s1's matches as ``read_truth`` reads it."""
    _write_tsv(pair_lists(universe, links).withColumnRenamed("s1", "source1_entity_id"), path)


def check_lines(lines: DataFrame, header: tuple[str, str], prefixes: tuple[str, ...] = ("S2-", "S3-")) -> DataFrame:
    """(problem, level, n) of a result file's lines (``value``): what a reader of the file would stumble over."""
    head = "\t".join(header)
    ids = F.split(F.get(F.split("value", "\t"), F.lit(1)), ",")
    wrong = F.exists(ids, lambda x: (F.trim(x) != "") & ~F.concat_ws("|", *[F.when(F.trim(x).startswith(p), F.lit("y")) for p in prefixes]).contains("y"))
    tests = {
        ("no header", "error"): (F.count("*") == F.count_if(F.col("value") != head)).cast("long"),
        ("header with commas", "error"): F.count_if(F.col("value") == ",".join(header)),
        ("not two columns", "error"): F.count_if((F.col("value") != head) & (F.size(F.split("value", "\t")) != 2)),
        ("id without a known prefix", "error"): F.count_if((F.col("value") != head) & (F.size(F.split("value", "\t")) == 2) & wrong),
        ("quotes", "warning"): F.count_if(F.col("value").contains('"')),
        ("spaces around ids", "warning"): F.count_if((F.col("value") != head) & F.col("value").rlike(" ,|, |, *$")),
        ("empty line", "warning"): F.count_if(F.trim("value") == ""),
    }
    one = lines.agg(*[c.alias(str(k)) for k, c in enumerate(tests.values())])
    return one.select(F.explode(F.array(*[F.struct(F.lit(p).alias("problem"), F.lit(v).alias("level"), F.col(str(k)).alias("n")) for k, (p, v) in enumerate(tests)])).alias("x")).select("x.*")


def save_lexicon(path: str, abbreviations: dict[str, str], legal: set[str], cues: set[str]) -> None:
    with open(path, "w") as f:
        json.dump({"abbrev": dict(sorted(abbreviations.items())), "legal": sorted(legal), "cues": sorted(cues)}, f, ensure_ascii=False, indent=1)


def load_lexicon(path: str) -> tuple[dict[str, str], set[str], set[str]]:
    with open(path) as f:
        x = json.load(f)
    return x["abbrev"], set(x["legal"]), set(x["cues"])
