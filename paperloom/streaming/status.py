"""The state of streams as a table of jobs, and an inbox of pages that takes each page once."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

SCHEMA = "job_id string, name string, state string, batch long, input_rows long, rows_per_second double, watermark string, error string, at timestamp"


class JobStatus(StreamingQueryListener):
    """Writes a row for each start, batch and end of the session's streams to a table; each lies in a folder of its own.

    Add it by `spark.streams.addListener`; read the table by its schema. Streams do not wait for it, and go on where it fails.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _note(self, job: uuid.UUID, name: str | None, state: str, **more) -> None:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        row = {"job_id": str(job), "name": name, "state": state} | more
        schema = SCHEMA.replace("at timestamp", "at string")
        made = self.spark.createDataFrame([tuple(row.get(n) for n in names[:-1]) + (None,)], schema).withColumn("at", F.current_timestamp())
        # events may come at once: each is a job of its own, which shares no folder with another's
        made.coalesce(1).write.parquet(f"{self.path}/note={uuid.uuid4().hex}")

    def onQueryStarted(self, event) -> None:
        self._note(event.id, event.name, "started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        times = json.loads(p.json).get("eventTime", {})
        self._note(p.id, p.name, "running", batch=p.batchId, input_rows=p.numInputRows, rows_per_second=float(p.processedRowsPerSecond or 0), watermark=times.get("watermark"))

    def onQueryIdle(self, event) -> None:
        """An idle stream is as it was."""

    def onQueryTerminated(self, event) -> None:
        self._note(event.id, None, "failed" if event.exception else "ended", error=event.exception)


def jobs(notes: DataFrame) -> DataFrame:
    """(job_id, name, state, batches, input_rows, watermark, error, at): what is known last of each job, and its sums over all batches."""
    # a batch that is run again counts once
    batches = notes.where("state = 'running'").groupBy("job_id", "batch").agg(F.max("input_rows").alias("input_rows"))
    sums = batches.groupBy("job_id").agg(F.count("*").alias("batches"), F.sum("input_rows").alias("input_rows"))
    stage = F.when(F.col("state") == "started", 0).when(F.col("state") == "running", 1).otherwise(2)
    last = notes.groupBy("job_id").agg(F.max("name").alias("name"), F.max_by("state", F.struct("at", stage)).alias("state"), F.max("watermark").alias("watermark"), F.max("error").alias("error"), F.max("at").alias("at"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return last.join(sums, "job_id", "left").select("job_id", "name", "state", zero("batches"), zero("input_rows"), "watermark", "error", "at")


def once_each(pages: DataFrame, keys: tuple[str, ...], at: str, delay: str) -> DataFrame:
    """A stream's rows, each key once: those that repeat one within the delay go, and so do those later than it. State is kept no longer than the delay."""
    return pages.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))


def watch_once(
    spark: SparkSession, inbox: str, schema: str, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
    keys: tuple[str, ...] = ("pdf_id", "page_num"), at: str = "arrived", delay: str = "1 hour", files_per_batch: int | None = None, name: str | None = None,
) -> StreamingQuery:
    """What is new in the inbox now, each page once, through transform to out, under its batch number; ends when all of it is done."""

    def each(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    writer = once_each(reader.parquet(inbox), keys, at, delay).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.queryName(name) if name else writer).trigger(availableNow=True).start()


