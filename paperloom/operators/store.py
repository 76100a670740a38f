"""The document store: search, statistics, facets, merge, delete and the token index."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sums import steady_sum
from .search import matching, postings, query_test, stemmed

__all__ = ["SearchFilter", "delete", "delete_outcomes", "facets", "matching", "merge", "neighbours", "postings", "query_test", "related", "search", "searched", "stats", "stemmed", "with_page_flags"]

SORTABLE = {"doc_id", "type", "created", "party", "amount", "title", "page_count"}
#: Columns that a search looks in; lists count as the words of their items.
SEARCHED = ("title", "type", "party", "parties", "reference_numbers", "text")


@dataclass
class SearchFilter:
    query: str | None = None
    types: list[str] = field(default_factory=list)
    date_from: str | None = None
    date_to: str | None = None
    parties: list[str] = field(default_factory=list)
    amount_min: float | None = None
    amount_max: float | None = None
    title_part: str | None = None
    reference_numbers: list[str] = field(default_factory=list)
    has_tables: bool | None = None
    has_images: bool | None = None
    is_ocr: bool | None = None
    sort_by: str = "created"
    descending: bool = True
    offset: int = 0
    limit: int | None = 50

    def predicate(self) -> Column:
        tests = [F.lit(True)]
        if self.types:
            tests.append(F.col("type").isin(self.types))
        if self.date_from:
            tests.append(F.col("created") >= F.lit(self.date_from).cast("date"))
        if self.date_to:
            tests.append(F.col("created") <= F.lit(self.date_to).cast("date"))
        if self.parties:
            tests.append(F.col("party").isin(self.parties))
        if self.amount_min is not None:
            tests.append(F.col("amount") >= self.amount_min)
        if self.amount_max is not None:
            tests.append(F.col("amount") <= self.amount_max)
        if self.reference_numbers:
            tests.append(F.arrays_overlap("reference_numbers", F.array(*map(F.lit, self.reference_numbers))))
        for flag in ("has_tables", "has_images", "is_ocr"):
            if getattr(self, flag) is not None:
                tests.append(F.coalesce(F.col(flag), F.lit(False)) == getattr(self, flag))
        if self.title_part:
            tests.append(F.contains(F.lower("title"), F.lit(self.title_part.lower())))
        return reduce(lambda a, b: a & b, tests)


def searched(docs: DataFrame) -> tuple[str, ...]:
    """The columns of docs that a search looks in."""
    return tuple(c for c in SEARCHED if c in docs.columns)


def search(docs: DataFrame, f: SearchFilter, index: DataFrame | None = None) -> DataFrame:
    """One page of the documents that pass the filter (without a limit all behind the offset); ties in the sort column go by doc_id.

    Without an index the query is a test of each row that passes the other filters, in those of SEARCHED that it has; with
    one, a semi-join with its postings. Both find the same where the index holds the same fields, as `postings(docs, searched(docs))` does.
    """
    if f.sort_by not in SORTABLE:
        raise ValueError(f"cannot sort by {f.sort_by!r}")
    found = docs.where(f.predicate())
    if f.query:
        found = found.where(query_test(f.query, searched(docs))) if index is None else found.join(matching(index, f.query), "doc_id", "left_semi")
    key = F.col(f.sort_by)
    page = found.orderBy(key.desc() if f.descending else key.asc(), "doc_id").offset(f.offset)
    return page if f.limit is None else page.limit(f.limit)


def with_page_flags(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """docs with has_tables, has_images, is_ocr: whether one of a document's pages (doc_id, has_tables, has_images, is_scanned) is such."""
    flags = pages.groupBy("doc_id").agg(F.bool_or("has_tables").alias("has_tables"), F.bool_or("has_images").alias("has_images"), F.bool_or("is_scanned").alias("is_ocr"))
    return docs.join(flags, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_tables", "has_images", "is_ocr")})


def stats(docs: DataFrame) -> DataFrame:
    """One row: counts, distinct PDFs, mean amount, first and last dates."""
    return docs.agg(F.count("*").alias("n_docs"), F.count_distinct("pdf_id").alias("n_pdfs"), F.coalesce(steady_sum("amount"), F.lit(0.0)).alias("total"), F.try_divide(steady_sum("amount"), F.count("*")).alias("mean_amount"), F.min("created").alias("first"), F.max("created").alias("last"))


def facets(docs: DataFrame) -> DataFrame:
    """(facet, value, n) of type, year and both, in one pass over grouping sets."""
    year = docs.withColumn("year", F.year("created").cast("string"))
    grouped = year.groupingSets([["type"], ["year"], ["type", "year"]], "type", "year").agg(F.grouping_id("type", "year").alias("g"), F.count("*").alias("n"))
    facet = F.when(F.col("g") == 1, "type").when(F.col("g") == 2, "year").otherwise("type_year")
    return grouped.select(facet.alias("facet"), F.concat_ws("/", "type", "year").alias("value"), "n")


def merge(old: DataFrame, new: DataFrame, key: str, seq: str) -> DataFrame:
    """Last writer wins: new rows replace old ones of the same key; of new rows the one with the greatest seq, of equals that of the greatest hash."""
    last = new.withColumn("r__", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq), F.desc(F.xxhash64(*new.columns))))).where("r__ = 1").drop("r__")
    return old.join(last, key, "left_anti").unionByName(last)


def delete(docs: DataFrame, children: dict[str, tuple[DataFrame, list[str]]], ids: DataFrame) -> dict[str, DataFrame]:
    """docs and its child tables (name: (table, key columns)) without the deleted ids."""
    out = {"docs": docs.join(ids, "doc_id", "left_anti")}
    for name, (child, keys) in children.items():
        for k in keys:
            child = child.join(ids.withColumnRenamed("doc_id", k), k, "left_anti")
        out[name] = child
    return out


def delete_outcomes(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, outcome) of a bulk delete."""
    known = docs.select("doc_id").distinct().withColumn("known", F.lit(True))
    return ids.distinct().join(known, "doc_id", "left").select("doc_id", F.when(F.col("known"), "deleted").otherwise("Document not found").alias("outcome"))


def related(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges between documents that exist, once each; a dangling end drops its edge."""
    ids = docs.select("doc_id").distinct()
    kept = edges.join(ids.withColumnRenamed("doc_id", "target_id"), "target_id", "left_semi").join(ids.withColumnRenamed("doc_id", "source_id"), "source_id", "left_semi")
    return kept.dropDuplicates(["source_id", "target_id", "relationship_type"])


def neighbours(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """docs with the sorted targets of each relationship type."""
    kinds = ("responds_to", "references", "related")
    lists = edges.groupBy(F.col("source_id").alias("doc_id")).agg(*(F.array_sort(F.collect_list(F.when(F.col("relationship_type") == k, F.col("target_id")))).alias(k) for k in kinds))
    return docs.join(lists, "doc_id", "left").withColumns({k: F.coalesce(k, F.array().cast("array<bigint>")) for k in kinds})
