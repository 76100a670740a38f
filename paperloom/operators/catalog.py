"""The catalog of stored documents: look-ups, lists, details, parties, statistics, and saving a store as one set of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import snapshots, store
from .search import DELTA_PACKED, clustered

#: Writer options of documents: a look-up by id asks each file's bloom filter, and reads the pages of one id of those that may have it.
BY_ID = {"parquet.bloom.filter.enabled#doc_id": "true", "parquet.page.row.count.limit": "2000"}
# The document types, in order.
TYPES = (
    "email", "rfi", "rfp", "change_order", "submittal", "invoice", "contract", "drawing", "specification", "meeting_minutes", "daily_report", "letter", "memorandum",
    "payment_application", "schedule", "inspection_report", "plans_specifications", "other", "unknown",
)


def document_types(spark: SparkSession) -> DataFrame:
    """(ordinal, type) of all document types."""
    return spark.createDataFrame(list(enumerate(TYPES)), "ordinal int, type string")


def type_counts(docs: DataFrame) -> DataFrame:
    """(ordinal, type, n): all document types and how many documents are of each."""
    counts = docs.groupBy("type").agg(F.count("*").alias("n"))
    return document_types(docs.sparkSession).join(counts, "type", "left").select("ordinal", "type", F.coalesce("n", F.lit(0)).alias("n"))


def by_id(docs: DataFrame, edges: DataFrame, doc_id) -> DataFrame:
    """The document of that id, with the ids it responds to, references or is related to; no row if there is none.

    The filter reaches the scans of both tables; only the edges of that document are gathered.
    """
    return store.neighbours(docs.where(F.col("doc_id") == doc_id), edges.where(F.col("source_id") == doc_id))


def by_source(docs: DataFrame, pdf_id) -> DataFrame:
    """The documents of a source PDF by their first page."""
    return docs.where(F.col("pdf_id") == pdf_id).orderBy("page_start", "doc_id")


def listed(docs: DataFrame, limit: int = 20, offset: int = 0, kind: str | None = None) -> DataFrame:
    """One page of the list of documents, newest first: its columns, and dates, parties and amounts as a struct."""
    if kind is not None and kind not in TYPES:
        raise ValueError(f"no document type: {kind!r}")
    found = docs if kind is None else docs.where(F.col("type") == kind)
    page = found.orderBy(F.desc("created"), "doc_id").offset(offset).limit(limit)
    return page.select("doc_id", "title", "type", "page_count", "created", F.struct("dates", "parties", "amounts").alias("metadata"))


def detail(docs: DataFrame, doc_id, include_text: bool = False) -> DataFrame:
    """A document's details; its text is read only where it is asked for."""
    page_range = F.struct(F.col("page_start").alias("first"), F.col("page_end").alias("last"))
    columns = ["doc_id", "title", "type", "page_count", page_range.alias("page_range"), "created", F.struct("dates", "parties", "amounts").alias("metadata")]
    return docs.where(F.col("doc_id") == doc_id).select(*columns, *["text"] * include_text)


def party_list(docs: DataFrame) -> DataFrame:
    """All parties named by documents, each once, ascending."""
    return docs.select(F.explode("parties").alias("party")).distinct().orderBy("party")


def statistics(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: documents, PDFs, pages, mean pages of a document, those with scanned pages and with embeddings, first, last and last indexed dates.

    Sums without documents are 0, the mean too; dates then are null.
    """
    of_docs = docs.agg(
        F.count("*").alias("n_docs"), F.count_distinct("pdf_id").alias("n_pdfs"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("total_pages"), F.coalesce(F.try_divide(F.sum("page_count"), F.count("*")), F.lit(0.0)).alias("average_pages"),
        F.count("embedding").alias("with_embedding"), F.min("created").alias("earliest"), F.max("created").alias("latest"), F.max("indexed_at").alias("last_indexed"),
    )
    scanned = pages.where("is_scanned").agg(F.count_distinct("doc_id").alias("with_ocr"))
    # two single rows
    return of_docs.crossJoin(F.broadcast(scanned))


def file_sizes(spark: SparkSession, **folders: str) -> DataFrame:
    """(kind, files, bytes) below each folder named, by the files' lengths alone; a folder without files has a row of zeros."""
    empty = spark.createDataFrame([(k,) for k in folders], "kind string")
    found = [spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p).select(F.lit(k).alias("kind"), "length") for k, p in folders.items()]
    sizes = found[0]
    for more in found[1:]:
        sizes = sizes.unionByName(more)
    sums = sizes.groupBy("kind").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    return empty.join(sums, "kind", "left").na.fill(0)


def save(docs: DataFrame, pages: DataFrame, edges: DataFrame, path: str, keep: int = 2) -> str:
    """Documents (by type, each type's files sorted by id), pages and edges (whose ends exist, each once) and the positional index as a new version of the store at path.

    Edges and the index are read off the documents as written. Readers see the version before until all four tables are there; a failure leaves it as it is.
    Returns the version's name; the last `keep` versions stay.
    """
    tables = {
        "documents": snapshots.Table(lambda done: docs.sortWithinPartitions("type", "doc_id"), ("type",), BY_ID),
        "pages": snapshots.Table(lambda done: pages.join(done["documents"].select("doc_id"), "doc_id", "left_semi")),
        "edges": snapshots.Table(lambda done: store.related(edges, done["documents"])),
        "postings": snapshots.Table(lambda done: clustered(store.postings(done["documents"], store.searched(docs))), options=DELTA_PACKED),
    }
    return snapshots.publish(docs.sparkSession, path, tables, keep)


def saved(spark: SparkSession, path: str, version: str | None = None) -> dict[str, DataFrame]:
    """The tables of a saved store's present version, or of one that is kept, by name."""
    return snapshots.tables(spark, path, version)


def reindex(spark: SparkSession, path: str) -> str:
    """Makes the index of a store anew from its documents; the version before stays as a backup (`snapshots.restore`)."""
    return snapshots.rebuild(spark, path, "postings", lambda done: clustered(store.postings(done["documents"], store.searched(done["documents"]))), **DELTA_PACKED)


def remove(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables of a store without the documents of these ids: their pages, edges at both ends and postings go with them."""
    children = {"pages": (tables["pages"], ["doc_id"]), "edges": (tables["edges"], ["source_id", "target_id"]), "postings": (tables["postings"], ["doc_id"])}
    left = store.delete(tables["documents"], children, ids)
    return {"documents": left.pop("docs"), **left}


def title(kind: Column, number: Column) -> Column:
    """A title by type and number."""
    return F.concat(F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))), F.lit(" "), number.cast("string"))
