"""Timelines: events of several sources in one order, sessions between gaps, and how many intervals are open at a time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import running


def union(**sources: DataFrame) -> DataFrame:
    """(subject, at, source, id, label) of events (subject, at, id, label) from each source named, without those that have no time."""
    named = [df.select("subject", F.col("at").cast("timestamp").alias("at"), F.lit(name).alias("source"), F.col("id").cast("string").alias("id"), "label") for name, df in sources.items()]
    return reduce(DataFrame.unionByName, named).where("at is not null")


def placed(events: DataFrame) -> DataFrame:
    """Events with their `number` in the subject's order: time, source, id and label."""
    return running(events, ["subject"], ["at", "source", "id", "label"])


def sessions(events: DataFrame, gap: str = "30 minutes", stretch: str = "1 day") -> DataFrame:
    """(subject, first, last, n): runs of a subject's events (subject, at) of which each follows the one before by at most the gap.

    Events of a subject meet in stretches of time first; a stretch's few runs then join those of the next where the gap allows, so
    a subject with very many events is never sorted in one task.
    """
    longest = F.expr(f"interval {gap}")
    within = events.where("at is not null").withColumn("stretch", F.window("at", stretch)["start"])

    def runs(rows: DataFrame, keys: list[str], first: str, last: str, n: Column) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(first, last)
        upto = order.rowsBetween(Window.unboundedPreceding, -1)
        marked = rows.withColumn("new", F.coalesce((F.col(first) > F.max(last).over(upto) + longest).cast("int"), F.lit(1)))
        numbered = marked.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        return numbered.groupBy(*keys, "run").agg(F.min(first).alias("first"), F.max(last).alias("last"), n.alias("n")).drop("run")

    short = runs(within.withColumn("until", F.col("at")), ["subject", "stretch"], "at", "until", F.count("*"))
    return runs(short.drop("stretch"), ["subject"], "first", "last", F.sum("n"))


def open_intervals(intervals: DataFrame) -> DataFrame:
    """(subject, at, n_open): how many of a subject's intervals (subject, start, end), both ends included, are open from each time on at which that changes.

    A sweep over starts and what lies behind ends: changes are added up by time first, so equal times are one row. An interval without an end stays
    open; one that ends before it starts counts as none. Times are dates.
    """
    good = intervals.where("start is not null and (`end` is null or `end` >= start)")
    changes = good.select("subject", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("step")), F.struct(F.date_add("end", 1).alias("at"), F.lit(-1).alias("step")))).alias("c")).select("subject", "c.at", "c.step")
    steps = changes.where("at is not null").groupBy("subject", "at").agg(F.sum("step").alias("step")).where("step != 0")
    return running(steps, ["subject"], ["at"], n_open=F.col("step")).select("subject", "at", "n_open")
