"""Stored documents: their rows, summaries of PDFs, status, orphans, compaction and the cache of readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sums import steady_sum
from . import snapshots


def grouped_references(flat: Column) -> Column:
    """Map of flat references ("RFI 12", "Invoice #7") by what stands before their first space, signs # removed; others go."""
    pairs = F.transform(F.filter(flat, lambda r: F.contains(r, F.lit(" "))), lambda r: F.struct(F.replace(F.substring_index(r, " ", 1), F.lit("#"), F.lit("")).alias("k"), F.replace(F.substring(r, F.instr(r, " ") + 1, F.length(r)), F.lit("#"), F.lit("")).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"]))))


def stored(docs: DataFrame) -> DataFrame:
    """Rows of the store from documents with a metadata struct: title, grouped references, custom fields, status pending.

    A document without a title is "<type> Document", without a type "unknown Document"; without a date it has no dates.
    """
    m, kind = F.col("metadata"), F.coalesce("type", F.lit("unknown"))
    title = F.coalesce(F.nullif(m["title"], F.lit("")), F.concat(kind, F.lit(" Document")))
    fields = F.struct(m["keywords"].alias("keywords"), m["project_number"].alias("project_number"), m["project_name"].alias("project_name"))
    kept = F.struct(F.array_compact(F.array(m["date"])).alias("dates"), grouped_references(m["reference_numbers"]).alias("reference_numbers"), m["amounts"].alias("amounts"), fields.alias("custom_fields"))
    return docs.select(*(c for c in docs.columns if c not in ("metadata", "title", "status", "summary")), title.alias("title"), F.lit("").alias("summary"), kept.alias("metadata"), F.lit("pending").alias("status"))


def pdf_summary(docs: DataFrame) -> DataFrame:
    """Per pdf_id of (pdf_id, type, n_scanned, ocr_confidence): documents found, documents by type, scanned pages, mean confidence of documents."""
    per = docs.groupBy("pdf_id", F.coalesce("type", F.lit("unknown")).alias("type")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("n_scanned"), F.lit(0)).alias("scanned"), steady_sum("ocr_confidence").alias("sum"), F.count("ocr_confidence").alias("known")
    )
    kinds = F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n"))))
    return per.groupBy("pdf_id").agg(F.sum("n").alias("documents_found"), kinds.alias("page_classification"), F.sum("scanned").alias("ocr_pages"), F.coalesce(F.try_divide(steady_sum("sum"), F.sum("known")), F.lit(0.0)).alias("average_confidence"))


def orphans(files: DataFrame, docs: DataFrame) -> DataFrame:
    """(path, kind) of PDF files that no document refers to: extracted ones by the name before .pdf, sources by what stands before its first _.

    files has path and kind (extracted or source), docs doc_id and pdf_id.
    """
    name = F.substring_index("path", "/", -1)
    pdfs = files.where(F.endswith(name, F.lit(".pdf"))).withColumn("ref", F.when(F.col("kind") == "extracted", F.regexp_replace(name, r"\.pdf$", "")).otherwise(F.substring_index(name, "_", 1)))
    ids = lambda c: docs.select(F.col(c).cast("string").alias("ref")).distinct()
    extracted = pdfs.where("kind = 'extracted'").join(ids("doc_id"), "ref", "left_anti")
    return extracted.unionByName(pdfs.where("kind = 'source'").join(ids("pdf_id"), "ref", "left_anti")).select("path", "kind")


def set_status(docs: DataFrame, ids: DataFrame, status: str, now: Column) -> DataFrame:
    """docs with the status and updated_at of the documents in ids; ids that do not exist change nothing."""
    hit = ids.select("doc_id").distinct().withColumn("hit__", F.lit(True))
    joined = docs.join(hit, "doc_id", "left")
    return joined.withColumns({"status": F.when(F.col("hit__"), F.lit(status)).otherwise(F.col("status")), "updated_at": F.when(F.col("hit__"), now).otherwise(F.col("updated_at"))}).drop("hit__")


def compact(spark: SparkSession, path: str, out: str, file_bytes: int = 256 << 20) -> int:
    """Writes the Parquet table at path as files of about file_bytes to out and returns their number; sizes are summed, contents not read for it."""
    size = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).agg(F.sum("length")).first()[0] or 0
    n = max(1, -(-size // file_bytes))
    spark.read.parquet(path).repartition(n).write.parquet(out)
    return n


def cache_key(text: Column, images: Column, dpi: int, language: str, strategies: tuple[str, ...]) -> Column:
    """Key of a page's reading: what is on the page (its text and first five images) and how it is read."""
    asked = F.struct(text.alias("text"), F.size(images).alias("n_images"), F.slice(images, 1, 5).alias("images"), F.lit(dpi).alias("dpi"), F.lit(language).alias("language"), F.lit(",".join(strategies)).alias("strategies"))
    return F.concat(F.lit("ocr_"), F.md5(F.to_json(asked).cast("binary")))


def cached(pages: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages with a reading in the cache, pages that have to be read) of pages and cache with a column cache_key."""
    known = cache.dropDuplicates(["cache_key"])
    return pages.join(known, "cache_key"), pages.join(known, "cache_key", "left_anti")


def cache_stats(cache: DataFrame) -> DataFrame:
    """One row: items and bytes of text in the cache."""
    return cache.agg(F.count_distinct("cache_key").alias("items"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))


def clear_cache(spark: SparkSession, path: str, before: str | None = None) -> int:
    """Clears the reading cache at path (a store with a table `cache` of cache_key, text and read_at): all of it, or what was read before a time.

    Returns how many rows went. What is left becomes a new version of the store, so readers of the old one are not disturbed.
    """
    cache = snapshots.tables(spark, path)["cache"]
    stays = cache.where("false") if before is None else cache.where(F.col("read_at") >= F.lit(before).cast("timestamp"))
    had = cache.count()
    snapshots.publish(spark, path, {"cache": stays}, keep=1)
    return had - snapshots.tables(spark, path)["cache"].count()
