"""The corpus pipeline: toxicity, near duplicates, benchmark passages, secrets, packing.

Each stage reads what its predecessor kept, from Parquet, and all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.common import shared_folder
from weftline.llm.decontaminate import decontaminate_stage
from weftline.llm.near_dup import near_dup_stage
from weftline.llm.packing import packing_stage
from weftline.llm.secrets import secret_stage
from weftline.llm.toxicity import toxicity_stage

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dup_stage),
    ("decontamination", decontaminate_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: SQL can't express the classifier, the sketches or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _finished(spark: SparkSession, path: str) -> bool:
    where, files = _path(spark, f"{path}/_SUCCESS")
    return files.exists(where)


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The last stage's rows over the documents of ``sf_dir``. A stage's rows are deleted when the next are written.

    A run with the ``folder`` of one that failed goes on after the last stage that was finished there. By default the
    folder is a new one below ``spark.checkpoint.dir``, which goes when the session ends.
    """
    own = folder is None
    folder = folder or f"{shared_folder(spark, 'weftline-pipeline').rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    paths = [f"{folder}/{i}-{name}" for i, (name, _) in enumerate(STAGES)]
    done = max((i + 1 for i, path in enumerate(paths) if _finished(spark, path)), default=0)
    docs = spark.read.parquet(paths[done - 1] if done else f"{sf_dir}/documents.parquet")
    for i in range(done, len(STAGES)):
        out = STAGES[i][1](spark, docs, sf_dir)
        out.write.mode("overwrite").parquet(paths[i])
        docs = spark.read.schema(out.schema).parquet(paths[i])
        if i:
            where, files = _path(spark, paths[i - 1])
            files.delete(where, True)
        elif own:
            where, files = _path(spark, folder)
            files.deleteOnExit(where)
    return docs
