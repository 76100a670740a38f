"""Stores of several tables that change as a whole: versions, one pointer to the present one, and the way back.

A version is a folder that nobody reads until all its tables are written; then one rename puts the pointer on it. A job that fails
on the way leaves the store as it was, and readers that hold the tables of an older version keep reading them until it is dropped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.files import Files

POINTER = "CURRENT.json"


@dataclass
class Table:
    """A table of a version: rows from those written before it, by name; partition columns and writer options."""

    rows: Callable[[dict[str, DataFrame]], DataFrame]
    partition_by: tuple[str, ...] = ()
    options: dict[str, str] = field(default_factory=dict)


def publish(spark: SparkSession, path: str, tables: dict[str, Table | DataFrame], keep: int = 2) -> str:
    """Writes all tables as a new version, in order, then makes it the present one; returns its name. The last `keep` versions stay.

    One writer at a time. What a failed writer has left behind is dropped by the next one that succeeds.
    """
    files, version = Files(spark), uuid.uuid4().hex
    at = f"{path}/versions/{version}"
    written: dict[str, DataFrame] = {}
    for name, table in tables.items():
        made = table if isinstance(table, Table) else Table(lambda _, t=table: t)
        made.rows(written).write.partitionBy(*made.partition_by).options(**made.options).parquet(f"{at}/{name}")
        written[name] = spark.read.parquet(f"{at}/{name}")
    before = (files.read_json(f"{path}/{POINTER}") or {"versions": []})["versions"]
    kept = [{"version": version, "tables": list(tables)}, *before][:keep]
    files.swap_json(f"{path}/{POINTER}", {"versions": kept})
    stay = {v["version"] for v in kept}
    for name in files.names(f"{path}/versions"):
        if name not in stay:
            files.delete(f"{path}/versions/{name}")
    return version


def versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the versions that are kept, the present one first."""
    return [v["version"] for v in (Files(spark).read_json(f"{path}/{POINTER}") or {"versions": []})["versions"]]


def tables(spark: SparkSession, path: str, version: str | None = None) -> dict[str, DataFrame]:
    """The tables of the present version, or of one that is kept, by name."""
    found = (Files(spark).read_json(f"{path}/{POINTER}") or {"versions": []})["versions"]
    chosen = [v for v in found if version in (None, v["version"])]
    if not chosen:
        raise ValueError(f"no version of a store at {path!r}" + (f": {version!r}" if version else ""))
    return {name: spark.read.parquet(f"{path}/versions/{chosen[0]['version']}/{name}") for name in chosen[0]["tables"]}


def restore(spark: SparkSession, path: str, version: str | None = None) -> str:
    """Makes an older version the present one (the one before, if none is named) and returns its name; the others stay behind it."""
    files = Files(spark)
    found = (files.read_json(f"{path}/{POINTER}") or {"versions": []})["versions"]
    chosen = [v for v in found[1:] if version in (None, v["version"])]
    if not chosen:
        raise ValueError(f"no older version of a store at {path!r}" + (f": {version!r}" if version else ""))
    files.swap_json(f"{path}/{POINTER}", {"versions": [chosen[0], *(v for v in found if v != chosen[0])]})
    return chosen[0]["version"]


def rebuild(spark: SparkSession, path: str, name: str, rows: Callable[[dict[str, DataFrame]], DataFrame], **options: str) -> str:
    """A new version in which one table is made anew from the others, as a search index after a fault; the version before is its backup."""
    old = tables(spark, path)
    others = {n: t for n, t in old.items() if n != name}
    parts = {n: Table(lambda _, t=t: t) for n, t in others.items()}
    return publish(spark, path, parts | {name: Table(rows, options=options)})
