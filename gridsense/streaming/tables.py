"""The batch operators over streams of tables: each micro-batch is a collection of whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.cells import to_cells


def each_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, table_id: str = "table_id", data: str = "data", once: bool = True) -> StreamingQuery:
    """Apply `work` (cells -> result) to every micro-batch of whole tables; a batch's result is a folder of its own under
    `path`, overwritten if the batch runs again, so results are there exactly once."""

    def run(batch: DataFrame, number: int) -> None:
        work(to_cells(batch, table_id, data)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
