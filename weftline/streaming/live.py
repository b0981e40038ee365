"""Extension: new records from a stream, resolved batch by batch against stored records.

Structured Streaming keeps the source's offsets; each micro-batch is one ``resolve`` and one idempotent write, named
by its batch number, so a batch that runs again after a failure replaces what it had written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def resolve_stream(new: DataFrame, resolve: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """``new`` is a streaming table of source records; results go to ``out``/batch=<number> as Parquet."""
    def one(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            resolve(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return new.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
