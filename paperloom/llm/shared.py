"""Shared folders, durable intermediate tables and distributed ordering."""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


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


def spare(name: str, *frames: DataFrame) -> str:
    """The name, or the name with underscores behind it, that is no column of the frames."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def col(name: str) -> Column:
    """The column of exactly that name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_key(df: DataFrame) -> Column:
    """128 bits that rows share just where they are equal in all columns; maps count by their entries in order."""

    def plain(f: StructField) -> Column:
        return F.to_json(F.struct(col(f.name))) if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else col(f.name)

    columns = [plain(f) for f in df.schema]
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit("row"), *columns).alias("b"))


def map_columns(df: DataFrame, run, fields: list[StructField]) -> DataFrame:
    """df.mapInArrow with columns by number, so that their names may hold any characters: run yields lists of arrays."""

    def numbered(batches):
        for columns in run(batches):
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    schema = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)])
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(numbered, schema).toDF(*(f.name for f in fields))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there and lost executors cost nothing."""
    spark, path, schema = df.sparkSession, fresh_path(df.sparkSession, name), df.schema
    df.write.options(**options).parquet(path)
    del df
    # plans that nothing refers to any more are collected, so that Spark's cleaner deletes their shuffle files
    gc.collect()
    return spark.read.schema(schema).parquet(path)


def ordered(df: DataFrame, keys: list[str], name: str = "ordered") -> DataFrame:
    """df with `rank` (0, 1, ...) in ascending order of the keys, nulls first.

    Range partitions are written with their number; the totals of partitions, a row for each,
    are summed up, and ranks within a partition come from a window over that partition alone.
    Rows with equal keys get neighbouring ranks in any order.
    """
    cut = df.repartitionByRange(*keys).withColumn("part__", F.spark_partition_id())
    cut = kept(cut, name)
    totals = cut.groupBy("part__").agg(F.count("*").alias("n__"))
    before = Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part__", F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("base__"))
    own = F.row_number().over(Window.partitionBy("part__").orderBy(*keys))
    ranked = cut.withColumn("own__", own).join(totals, "part__")
    return ranked.withColumn("rank", F.col("base__") + F.col("own__") - 1).drop("part__", "own__", "base__")
