"""Operators over a stream of documents.

Every operator of the engine works document by document, so it applies unchanged to each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def run_in_batches(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write ``operator`` of every micro-batch below ``path``, a folder for each batch: a batch that is repeated after a failure
    replaces its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
