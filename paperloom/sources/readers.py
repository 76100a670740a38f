"""Sources and sinks: text files, PDFs through a provider, annotations, tables and results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_SCHEMA = "pdf_id string, page_num int, n_pages int, text string, is_scanned boolean, confidence double, has_tables boolean, has_images boolean, status string"


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (path) and the whole text of each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def pdf_pages(spark: SparkSession, path: str, extract: Callable[[bytes], Iterator[tuple]], most_bytes: int = 100 << 20) -> DataFrame:
    """Pages of the PDF files below a path, .pdf in any case, with status ok.

    extract(bytes), a provider's function, yields (text, is_scanned, confidence) of each page, or these and (has_tables,
    has_images). A file over most_bytes gives one row with status "too large" and is not read, one that the provider cannot
    read gives one with status "error: ..." and no page of it, and one without pages has status "empty". Spark's file
    sources skip files of no bytes.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    large = files.where(F.col("length") > most_bytes).select("path", F.lit(None).cast("binary").alias("content"))
    small = files.where(F.col("length") <= most_bytes).select("path", "content")
    names = [x.split()[0] for x in PAGE_SCHEMA.split(", ")]

    def rows_of(name: str, content: bytes | None) -> list[tuple]:
        if content is None:
            return [(name, None, None, None, None, None, None, None, "too large")]
        try:
            pages = [(*p, False, False)[:5] for p in extract(content)]
        except Exception as e:  # a provider's errors are of any kind, and one file is no reason to lose the others
            return [(name, None, None, None, None, None, None, None, f"error: {e}")]
        if not pages:
            return [(name, None, 0, None, None, None, None, None, "empty")]
        return [(name, i, len(pages), *p, "ok") for i, p in enumerate(pages)]

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                columns = zip(*rows_of(name, content), strict=True)
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.float64(), pa.bool_(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return small.unionByName(large).mapInArrow(run, PAGE_SCHEMA)


def import_outcomes(pages: DataFrame) -> DataFrame:
    """(pdf_id, n_pages, imported, reason) of a bulk import: each file of pdf_pages as imported, or why not."""
    return pages.groupBy("pdf_id").agg(F.count_if(F.col("status") == "ok").cast("int").alias("n_pages"), F.bool_and(F.col("status") == "ok").alias("imported"), F.max(F.when(F.col("status") != "ok", F.col("status"))).alias("reason"))


def image_files(spark: SparkSession, path: str, most_bytes: int = 100 << 20) -> DataFrame:
    """(page_id, content) of the image files below a path, each a page, for `providers.read_images`; content is null over most_bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,PNG,jpg,JPG,jpeg,JPEG,tif,TIF,tiff,TIFF,bmp,BMP}").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("page_id"), F.when(F.col("length") <= most_bytes, F.col("content")).alias("content"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """pdf_id, start_page, end_page, type, notes from JSON files of {pdf_path, boundaries: [[start, end], ...], document_types: {page: type}, notes}.

    type: what document_types says of the range's first page; null where it says nothing. notes: the PDF's, on each of its ranges.
    """
    rows = spark.read.schema("pdf_path string, boundaries array<array<int>>, document_types map<string,string>, notes string").json(path, multiLine=True)
    ranges = rows.select(F.col("pdf_path").alias("pdf_id"), F.explode("boundaries").alias("b"), "document_types", "notes")
    return ranges.select("pdf_id", F.col("b")[0].alias("start_page"), F.col("b")[1].alias("end_page"), F.try_element_at("document_types", F.col("b")[0].cast("string")).alias("type"), "notes")


def page_range(s) -> F.Column:
    """struct(first, last) of "1-4" or "13"."""
    parts = F.split(s, "-")
    return F.struct(F.get(parts, F.lit(0)).try_cast("int").alias("first"), F.element_at(parts, -1).try_cast("int").alias("last"))


def save_documents(docs: DataFrame, path: str) -> None:
    docs.write.partitionBy("type").parquet(path)


def save_results(rows: DataFrame, path: str) -> None:
    rows.write.json(path)
