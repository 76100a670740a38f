"""An inbox of page tables as a stream: the batch transforms run on each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def watch(spark: SparkSession, inbox: str, schema: str, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Every new Parquet file of the inbox through transform, appended to out under its batch number."""

    def each(batch: DataFrame, number: int) -> None:
        # a batch that is run again overwrites its own folder
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = spark.readStream.schema(schema).parquet(inbox).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
