"""Token-id files: Parquet list columns with chosen encodings, row groups and page indexes.

A data set is a folder of Parquet files in document order. Columns: shard (file number in order), pos (row
in the shard), the id columns kept from the input, n_tokens, and ids as a list of ints. Ids are written with
dictionary or delta encoding; row groups and pages have bounded bytes, and the writer's column and offset
indexes let readers skip pages by shard, pos or n_tokens and leave out ids that are not asked for.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import flat
from .bpe import byte_chars
from .pretokens import PieceCache
from .shared import col


class ByteBPE:
    """Whole texts through the tokenizers library: each new piece is encoded by its model once, then remembered."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.model = library.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special, self.vocabulary = {t["content"]: t["id"] for t in spec["added_tokens"]}, spec["model"]["vocab"]
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.chars = dict(enumerate(byte_chars()))
        self.cache = PieceCache("byte", self._encode)

    def _encode(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spelled = raw.tobytes().decode("latin-1").translate(self.chars)
        ids, counts, at = [], [], 0
        for n in lengths.tolist():
            got = [t.id for t in self.model.tokenize(spelled[at : at + n])]
            at += n
            ids += got
            counts.append(len(got))
        return np.array(ids, np.int32), np.array(counts, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, owner, fixed = [], [], []
        for k, t in enumerate(texts):
            cut = self.split.split(t) if self.split and any(s in t for s in self.special) else [t]
            for n, x in enumerate(cut):
                if n % 2:
                    fixed.append((len(parts), self.special[x]))
                    x = ""
                parts.append(x)
                owner.append(k)
        ids, counts = self.cache.ids(parts)
        if fixed:
            at = np.concatenate(([0], np.cumsum(counts)))
            ids = np.insert(ids, [at[p] for p, _ in fixed], np.array([i for _, i in fixed], np.int32))
            counts = counts.copy()
            counts[[p for p, _ in fixed]] = 1
        return ids, np.bincount(owner, weights=counts, minlength=len(texts)).astype(np.int64)


@lru_cache(2)
def byte_bpe(path: str) -> ByteBPE:
    return ByteBPE(path)


def write_tokens(
    docs: DataFrame, out: str, vocabulary: str, end_id: int | None = None, doc_id: str = "doc_id", text: str = "text",
    encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 1 << 20, page_rows: int = 2_000,
) -> None:
    """Writes the ids of every whole text in ascending doc_id order (null first; equal ids by text).

    encoding: "dictionary" (Parquet falls back to plain pages where a dictionary would be too large) or
    "delta" (format version 2: delta-packed ids). A null text has no ids but end_id. Other columns of docs are
    left out. Range partitions follow the session's shuffle partitions, a file each.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")
    docs = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sorted_docs = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    sorted_docs = sorted_docs.withColumn("shard", F.spark_partition_id())
    tail = np.zeros(0, np.int32) if end_id is None else np.array([end_id], np.int32)

    def run(batches):
        bpe, pos = byte_bpe(vocabulary), 0
        for b in batches:
            column = b.column(1)
            _, offs = flat.flat_bytes(column)
            for i, j in flat.chunks(offs):
                got, counts = bpe.encode([t or "" for t in column.slice(i, j - i).to_pylist()])
                ends = np.cumsum(counts)
                if len(tail):
                    got = np.insert(got, ends, tail[0])
                    counts = counts + 1
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(got, pa.int32()))
                rows = pa.array(np.arange(pos, pos + j - i))
                pos += j - i
                yield pa.RecordBatch.from_arrays([b.column(2).slice(i, j - i), rows, b.column(0).slice(i, j - i), pa.array(counts), lists], names=["shard", "pos", "doc_id", "n_tokens", "ids"])

    rows = sorted_docs.mapInArrow(run, f"shard int, pos long, doc_id {kind}, n_tokens long, ids array<int>")
    options = {
        "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows,
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(), "parquet.writer.version": "v1" if encoding == "dictionary" else "v2",
        "parquet.dictionary.page.size": 1 << 20, "compression": "zstd",
    }
    rows.write.options(**{k: str(v) for k, v in options.items()}).parquet(out)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """shard, pos, doc_id, n_tokens and start (ids of all documents before it): no id page is read.

    Totals of shards, a row for each file, are summed up; within a shard a window runs over its rows.
    """
    meta = spark.read.parquet(path).select("shard", "pos", "doc_id", "n_tokens")
    totals = meta.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("shard").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    inside = meta.withColumn("own", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)))
    return inside.join(totals, "shard").select("shard", "pos", "doc_id", "n_tokens", (F.col("base") + F.col("own")).cast("long").alias("start"))


def read_tokens(spark: SparkSession, path: str, where=None, columns: tuple[str, ...] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """A selective read: where reaches row groups and pages by their indexes, other columns stay unread."""
    rows = spark.read.parquet(path)
    return (rows if where is None else rows.where(where)).select(*columns)


def id_checksums(spark: SparkSession, path: str) -> DataFrame:
    """shard, pos and ids_crc32 of each document's ids as little-endian unsigned 32-bit integers."""
    rows = spark.read.parquet(path).select("shard", "pos", "ids")

    def run(batches):
        for b in batches:
            lists = b.column(2)
            offs = lists.offsets.to_numpy()
            values = np.ascontiguousarray(lists.values.to_numpy(), "<u4")
            sums = [zlib.crc32(values[i:j]) for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sums, pa.int64())], names=["shard", "pos", "ids_crc32"])

    return rows.mapInArrow(run, "shard int, pos long, ids_crc32 long")


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    return read_index(spark, path).join(id_checksums(spark, path), ["shard", "pos"]).select("doc_id", "start", "n_tokens", "ids_crc32")
