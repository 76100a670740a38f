"""Durable intermediate tables of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir.

    Where none is set: a temporary folder in local mode, whose driver and executors are one machine; on a cluster an error,
    as no machine's own folder is shared.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.gettempdir()}/checkpoints"
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and lost executors cost nothing."""
    spark, schema, path = df.sparkSession, df.schema, fresh_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(schema).parquet(path)


def running(df: DataFrame, group: list[str], order: list[str], **values: Column) -> DataFrame:
    """df with `number` (1, 2, ... in its group by the order) and, for each value named, its sum over the group's rows up to this one.

    Rows are range-sorted by group and order, and each range is summed up where it lies; a row for each group and range then
    says what comes before. A group of any size is so spread over ranges: no window holds more than one range of it. Rows equal in
    group and order are numbered in any order; give an order that tells them apart.
    """
    cut = kept(df.withColumns(values).repartitionByRange(*group, *order).withColumn("range__", F.spark_partition_id()), "running")
    own = Window.partitionBy(*group, "range__").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*group).orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"number": F.lit(1), **{v: F.col(v) for v in values}}
    totals = cut.groupBy(*group, "range__").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    bases = totals.select(*(F.col(g).alias(f"{g}__") for g in group), F.col("range__").alias("of__"), *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}__") for n in sums))
    inside = cut.withColumns({n: F.sum(c).over(own) for n, c in sums.items()})
    same = F.col("range__") == F.col("of__")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}__"))
    joined = inside.join(bases, same).withColumns({n: F.col(n) + F.col(f"{n}__") for n in sums})
    return joined.drop("range__", "of__", *(f"{g}__" for g in group), *(f"{n}__" for n in sums))
