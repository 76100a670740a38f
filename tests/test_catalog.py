"""Files, saved stores, searches without an index, overlaps and the inbox."""

import math
import random

import pytest
from pyspark.sql import functions as F

from paperloom.functions.sums import steady_sum
from paperloom.functions.tables import kept, shared_dir
from paperloom.operators import catalog, classify, evaluate, metadata, store
from paperloom.sources import readers
from paperloom.streaming import inbox


def test_every_pdf_file_has_an_outcome(spark, tmp_path):
    def provider(content):
        if content.startswith(b"broken"):
            raise RuntimeError("no PDF")
        for k, page in enumerate(content.decode().split("|") if content.strip() else []):
            yield (page, k == 1, 0.5) if k else (page, False, 1.0, True, False)

    for name, content in {"a.pdf": b"one|two", "b.PDF": b"x", "c.pdf": b"broken", "d.pdf": b" ", "e.pdf": b"y" * 200, "f.txt": b"no"}.items():
        (tmp_path / name).write_bytes(content)
    pages = readers.pdf_pages(spark, str(tmp_path), provider, most_bytes=100)
    got = sorted((r.pdf_id[-5:], r.page_num if r.page_num is not None else -1, r.n_pages, r.text, r.is_scanned, r.has_tables, r.status) for r in pages.collect())
    assert got == [
        ("a.pdf", 0, 2, "one", False, True, "ok"), ("a.pdf", 1, 2, "two", True, False, "ok"), ("b.PDF", 0, 1, "x", False, True, "ok"),
        ("c.pdf", -1, None, None, None, None, "error: no PDF"), ("d.pdf", -1, 0, None, None, None, "empty"), ("e.pdf", -1, None, None, None, None, "too large"),
    ]
    outcomes = {r.pdf_id[-5:]: (r.n_pages, r.imported, r.reason) for r in readers.import_outcomes(pages).collect()}
    assert outcomes == {"a.pdf": (2, True, None), "b.PDF": (1, True, None), "c.pdf": (0, False, "error: no PDF"), "d.pdf": (0, False, "empty"), "e.pdf": (0, False, "too large")}


def test_files_and_results(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a\nb")
    assert [(r.doc_id[-5:], r.text) for r in readers.text_files(spark, str(tmp_path / "t.txt")).collect()] == [("t.txt", "a\nb")]
    (tmp_path / "n.json").write_text('{"pdf_path": "p.pdf", "boundaries": [[0, 2], [3, 3]]}')
    assert sorted(tuple(r)[:3] for r in readers.annotations(spark, str(tmp_path / "n.json")).collect()) == [("p.pdf", 0, 2), ("p.pdf", 3, 3)]
    rows = spark.createDataFrame([("1-4",), ("13",), ("x",)], "s string").select(readers.page_range(F.col("s")).alias("r"))
    assert [tuple(r.r) for r in rows.collect()] == [(1, 4), (13, 13), (None, None)]
    readers.save_documents(spark.createDataFrame([(1, "rfi"), (2, "email")], "doc_id long, type string"), str(tmp_path / "docs"))
    assert spark.read.parquet(str(tmp_path / "docs")).where("type = 'rfi'").count() == 1
    readers.save_results(spark.createDataFrame([(1,)], "n long"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().n == 1
    sizes = {r.kind: (r.files, r.bytes) for r in catalog.file_sizes(spark, text=str(tmp_path / "t.txt"), results=str(tmp_path / "out")).collect()}
    assert sizes["text"] == (1, 3) and sizes["results"][0] >= 1


def test_saved_store_and_removal(spark, tmp_path):
    docs = spark.createDataFrame([(1, "rfi", "one two"), (2, "email", "two"), (3, "rfi", None)], "doc_id long, type string, text string")
    pages = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (9, 0)], "doc_id long, page_num int")
    edges = spark.createDataFrame([(1, 2, "related"), (1, 2, "related"), (2, 1, "references"), (1, 7, "related")], "source_id long, target_id long, relationship_type string")
    catalog.save(docs, pages, edges, str(tmp_path / "s"))
    tables = catalog.saved(spark, str(tmp_path / "s"))
    assert {k: t.count() for k, t in tables.items()} == {"documents": 3, "pages": 3, "edges": 2, "postings": 6}
    less = catalog.remove(tables, spark.createDataFrame([(2,), (5,)], "doc_id long"))
    assert {k: t.count() for k, t in less.items()} == {"documents": 2, "pages": 2, "edges": 0, "postings": 4}
    found = catalog.by_id(docs, tables["edges"], 1).first()
    assert found.related == [2] and found.references == [] and catalog.by_id(docs, tables["edges"], 8).count() == 0
    with pytest.raises(ValueError, match="document type"):
        catalog.listed(docs, kind="novel")


def test_inbox_transforms_each_file_once(spark, tmp_path):
    for k in (1, 2):
        spark.createDataFrame([(k, "invoice")], "doc_id long, text string").write.mode("append").parquet(str(tmp_path / "in"))
    label = lambda batch: batch.select("doc_id", classify.keyword_type(F.col("text")).alias("label"))
    for _ in range(2):  # a second run finds nothing new
        inbox.watch(spark, str(tmp_path / "in"), "doc_id long, text string", label, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination(60)
    assert sorted((r.doc_id, r.label) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "invoice"), (2, "invoice")]


def test_statistics_of_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, pdf_id long, page_count int, embedding array<float>, created date, indexed_at date")
    row = catalog.statistics(docs, spark.createDataFrame([], "doc_id long, is_scanned boolean")).first()
    assert (row.n_docs, row.total_pages, row.average_pages, row.with_ocr, row.earliest) == (0, 0, 0.0, 0, None)


DOCS = [(1, "Payment due", "Ünited crews, payment due now"), (2, "Report", "due payment of the crew"), (3, "payment", "nothing"), (4, None, None)]


@pytest.mark.parametrize(("query", "want"), [
    ("payment due", [1, 2]), ('"payment due"', [1]), ("united", [1]), ("crew*", [1, 2]), ("crew* -now", [2]), ("-now", []), ("title:payment", [1, 3]), ('nothing OR "of the crew"', [2, 3]), ('-"payment due" crew*', [2]), ("absent", []),
])
def test_searches_without_an_index(spark, query, want):
    docs = spark.createDataFrame(DOCS, "doc_id long, title string, text string")
    f = store.SearchFilter(query=query, sort_by="doc_id", descending=False)
    assert [r.doc_id for r in store.search(docs, f).collect()] == want
    if '"' not in query:
        assert [r.doc_id for r in store.search(docs, f, store.postings(docs, ("title",)).unionByName(store.postings(docs).withColumn("field", F.lit("text"))) if ":" in query else store.postings(docs)).collect()] == want


def test_title_parts_and_ties(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, title string, text string")
    assert [r.doc_id for r in store.search(docs, store.SearchFilter(title_part="PAY", sort_by="doc_id", descending=False)).collect()] == [1, 3]
    old, new = spark.createDataFrame([(1, "a", 0)], "k long, v string, seq int"), [(1, "b", 2), (1, "c", 2), (1, "d", 1)]
    last = [store.merge(old, spark.createDataFrame(rows, "k long, v string, seq int").repartition(3), "k", "seq").collect() for rows in (new, new[::-1])]
    assert last[0] == last[1] and len(last[0]) == 1 and last[0][0].seq == 2


def test_overlaps_by_brute_force(spark):
    rng = random.Random(3)
    make = lambda: [(pdf, s, s + rng.choice((0, 1, 5, 31, 32, 33, 200))) for pdf in range(4) for s in rng.sample(range(400), 25)]
    a, b = make(), make()
    schema = "pdf_id long, start_page int, end_page int"
    got = sorted((r.pdf_id, r.ps, r.pe, r.ts, r.te, r.shared) for r in evaluate.overlaps(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect())
    assert got == sorted((p, s, e, t, u, min(e, u) - max(s, t) + 1) for p, s, e in a for q, t, u in b if p == q and s <= u and t <= e)


def test_written_amounts_of_any_length(spark):
    text = "two million " + "and " * 60 + "fifty dollars"
    assert spark.createDataFrame([(text,)], "t string").select(metadata.written_amounts(F.col("t")).alias("a")).first().a == [2000000.0]
    words = spark.createDataFrame([("A Delay of my Own",)], "t string").select(metadata.keywords(F.col("t"), (*metadata.KEYWORDS, "own")).alias("k")).first()
    assert words.k == ["delay", "own"]


def test_fallback_order(spark):
    docs = spark.createDataFrame([(1, "INVOICE amount due", "letter", 0.9), (2, "INVOICE amount due", None, 0.9), (3, None, None, None), (4, "zzz", None, None)], "doc_id long, text string, m string, c double")
    got = {r.doc_id: (r.label, r.method) for r in classify.fallback(docs, F.col("m"), F.col("c")).collect()}
    assert got == {1: ("letter", "model"), 2: ("invoice", "rules"), 3: ("unknown", "none"), 4: ("unknown", "rules")}


def test_no_machine_folder_on_a_cluster(spark):
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
    Session.conf = Conf({"spark.master": "local[2]"})
    assert shared_dir(Session()).startswith("file:///") and kept(spark.range(3), "t").count() == 3


def test_steady_sums(spark):
    values = [random.Random(1).random() for _ in range(300)] + [1 / 3, 2 / 3, None]
    sums = set()
    for seed in range(4):
        random.Random(seed).shuffle(values)
        sums.add(spark.createDataFrame([(v,) for v in values], "v double").repartition(seed + 1).agg(steady_sum("v")).first()[0])
    assert sums == {round(sum(v for v in values if v is not None), 12)}
    # what is no number, or infinite, makes the sum such
    for odd in (float("nan"), float("inf")):
        assert not math.isfinite(spark.createDataFrame([(v,) for v in [*values, odd]], "v double").agg(steady_sum("v")).first()[0])
    thirds = spark.createDataFrame([(1 / 3,), (2 / 3,), (1 / 3,), (2 / 3,)], "v double")
    assert thirds.agg(steady_sum("v")).first()[0] == 2.0
    assert spark.createDataFrame([(None,)], "v double").agg(steady_sum("v")).first()[0] is None
