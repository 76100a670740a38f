"""Windows of pages read in order by a language model, each with a summary of the one before.

All PDFs step together: in each task the k-th windows of all its PDFs are asked in batches before the next ones, which see their
summaries. A job takes a span of rounds and writes replies and summaries as a table, from which the next job takes the last summaries:
jobs are few however long the PDFs are, a task holds one round's summaries of its own PDFs, state never passes the driver, and
a job that fails goes on behind its last whole span when it is started again with the same path.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.files import Files
from ..functions.tables import fresh_path
from ..sources.providers import Model, answers

#: Characters of a summary that go into the next prompt.
MOST = 500
#: Rounds of a job from the eleventh job on; the first jobs have 1, 2, 4, ... rounds.
SPAN = 1024
#: PDFs of a task, whose last summaries it holds.
PDFS = 10_000
#: Prompts that a model is handed at once.
BATCH = 16


def page_windows(pages: DataFrame, size: int = 3, overlap: int = 1, preview: int = 1000) -> DataFrame:
    """(pdf_id, step, window_start, window_end, body): overlapping windows of each PDF's pages in order, with the heads of their pages."""
    stride = size - overlap
    reach = -(-size // stride)
    n = pages.groupBy("pdf_id").agg((F.max("page_num") + 1).alias("n"))
    # a page lies in the windows that start at most size - 1 pages before it
    at = pages.withColumn("step", F.explode(F.sequence(F.floor(F.col("page_num") / stride) - (reach - 1), F.floor(F.col("page_num") / stride))))
    inside = at.where((F.col("step") >= 0) & (F.col("page_num") < F.col("step") * stride + size))
    page = F.struct("page_num", F.concat(F.lit("Page "), (F.col("page_num") + 1).cast("string"), F.lit(": "), F.substring(F.coalesce("text", F.lit("")), 1, preview)).alias("line"))
    packed = inside.groupBy("pdf_id", "step").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    first = F.col("step") * stride
    return packed.join(n, "pdf_id").select(
        "pdf_id", F.col("step").cast("int").alias("step"), first.cast("int").alias("window_start"), F.least(first + size - 1, F.col("n") - 1).cast("int").alias("window_end"),
        F.array_join(F.transform("pages", lambda p: p["line"]), "\n").alias("body"),
    )


def boundary_prompt(body: str, before: str) -> str:
    """What a window is asked: its pages, and what the window before was about, if there was one."""
    carried = f"Before these pages: {before}\n" if before else ""
    return f"Which of these pages start a document? Reply as JSON with boundaries (page, confidence) and window_summary.\n{carried}{body}"


def json_summary(reply: str | None) -> str:
    """The summary that a reply states, clipped; a reply without one, or no reply, carries nothing on."""
    try:
        said = json.loads(reply or "null")
    except ValueError:
        return ""
    said = said.get("window_summary") if isinstance(said, dict) else None
    said = "" if said is None else said if isinstance(said, str) else json.dumps(said, ensure_ascii=False, separators=(",", ":"))
    return said[:MOST]


def _span(number: Column) -> Column:
    """The job that takes a round: round 0, rounds 1 and 2, rounds 3 to 6, and so on up to SPAN rounds."""
    first = SPAN.bit_length() - 1
    return F.when(number < SPAN - 1, F.length(F.bin(number + 1)) - 1).otherwise(first + F.floor((number - (SPAN - 1)) / SPAN)).cast("int")


def _stepped(now: DataFrame, tasks: int, model: Model, prompt: Callable[[str, str], str], summary: Callable[[str | None], str]) -> DataFrame:
    """(pdf_id, step, window_start, window_end, round, content, summary) of a span's windows; before: the summary ahead of the span."""
    names = ["pdf_id", "step", "window_start", "window_end", "round"]
    kinds = ", ".join(f"`{k}` {now.schema[k].dataType.simpleString()}" for k in names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        past, here, at = {}, {}, None
        for b in batches:
            contents, summaries = [], []
            for number, rows in groupby(zip(*(b.column(k).to_pylist() for k in ("round", "pdf_id", "body", "before")), strict=True), lambda r: r[0]):
                if number != at:
                    past, here, at = here, {}, number
                rows = list(rows)
                for i in range(0, len(rows), BATCH):
                    part = rows[i : i + BATCH]
                    said = answers(model, [None if body is None else prompt(body, past.get(pdf, before or "")) for _, pdf, body, before in part])
                    contents += said
                    summaries += map(summary, said)
                    here |= zip((pdf for _, pdf, _, _ in part), summaries[-len(part) :], strict=True)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), pa.array(contents, pa.string()), pa.array(summaries, pa.string())], names=[*names, "content", "summary"])

    dealt = now.repartition(tasks, "pdf_id").sortWithinPartitions("round", "pdf_id").select(*names, "body", "before")
    return dealt.mapInArrow(run, f"{kinds}, content string, summary string")


def carried(windows: DataFrame, model: Model, prompt: Callable[[str, str], str] = boundary_prompt, summary: Callable[[str | None], str] = json_summary, path: str | None = None) -> DataFrame:
    """(pdf_id, step, window_start, window_end, content, summary) of windows (pdf_id, step, window_start, window_end, body).

    Steps of a PDF are taken in ascending order, whatever their numbers; each sees the summary of the one before. path: a folder for the rounds; with
    one that holds spans of rounds already, those are not asked again. A window whose reply fails has a null content and carries nothing on.
    """
    spark, files = windows.sparkSession, Files(windows.sparkSession)
    path = path or fresh_path(spark, "carried")
    order = Window.partitionBy("pdf_id").orderBy("step")
    placed = windows.withColumn("round", F.row_number().over(order) - 1).withColumn("span", _span(F.col("round")))
    # a folder for each span, so that each window is read once
    at, schema = fresh_path(spark, "carried-windows"), placed.schema
    placed.write.partitionBy("span").parquet(at)
    placed = spark.read.schema(schema).parquet(at)
    last, n = placed.agg(F.max("span"), F.count_if(F.col("round") == 0)).first()
    # models are slow beside shuffles: every core has its share of the PDFs
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // PDFS))
    done = []
    for k in range(-1 if last is None else last + 1):
        if not files.exists(f"{path}/span={k}/_SUCCESS"):
            now = placed.where(F.col("span") == k)
            if done:
                before = done[-1].select("pdf_id", (F.col("round") + 1).alias("round"), F.col("summary").alias("before"))
                now = now.join(before, ["pdf_id", "round"], "left")
            else:
                now = now.withColumn("before", F.lit(None).cast("string"))
            _stepped(now, tasks, model, prompt, summary).write.mode("overwrite").parquet(f"{path}/span={k}")
        done.append(spark.read.parquet(f"{path}/span={k}"))
    if not done:
        return placed.select("pdf_id", "step", "window_start", "window_end", F.lit(None).cast("string").alias("content"), F.lit("").alias("summary"))
    return reduce(DataFrame.unionByName, done).drop("round")
