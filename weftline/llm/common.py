"""Helpers shared by the operators: checked input columns, bucket counts, tables cut from their lineage."""

from __future__ import annotations

import contextlib
import ctypes
import math
import os
import tempfile
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size of the input; for files, their size. No job runs."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:
        return 1 << 60


LEAST_BUCKETS = 64


def bucket_count(df: DataFrame) -> int:
    """Buckets that the rows of a table are dealt to.

    A bucket's size grows with the square root of the input, from 1 MB to 64 MB of files, some 200 MB of texts: so a
    bucket fits a worker and the pieces that buckets exchange don't become too small.
    """
    size = estimated_bytes(df)
    if size > 1 << 50:  # no statistics
        size = 1 << 36
    each = min(64 << 20, max(1 << 20, int(math.sqrt(size * 4096))))
    return max(LEAST_BUCKETS, -(-size // each))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder that all executors see: that of ``spark.checkpoint.dir``. Only one machine may use a folder of its own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or os.path.join(tempfile.gettempdir(), name)


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder; a lost executor loses none of them.

    The shuffle files behind them go at once, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark, "weftline-checkpoints"))
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        once = df.select("*")  # a query of its own, which takes the setting and isn't run again
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_UP)
        else:
            spark.conf.set(_CLEAN_UP, before)
    return once.checkpoint(eager=True)


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables from ``checkpointed`` that nothing will read again."""
    for df in tables:
        path = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if path.isDefined():
            sc = df.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path.get())
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def give_back() -> None:
    """Unused memory of this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def freed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task; afterwards the worker, which later stages use too, gives unused memory back."""
    yield from rows
    give_back()


def on_worker(spark: SparkSession, f: Callable[[Any], Any], value: Any) -> Any:
    """``f(value)`` by one task, so that a fit takes the memory of a worker and not the driver's."""
    sc = spark.sparkContext
    sent = sc.broadcast(value)

    def run(_: int) -> Any:
        try:
            return f(sent.value)
        finally:
            give_back()

    try:
        return sc.parallelize([0], 1).map(run).collect()[0]
    finally:
        sent.destroy()


def crc32_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of the table has, whatever their case."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out
