import datetime

from pyspark.sql import functions as F

from paperloom.operators import library, metadata, people, segment, visual

LETTER = """From: John Smith <john@acme.com>
To: Mary Q. Jones mary@city.gov, bob@x.org
General Contractor: Acme Builders, Inc. and the
Owner: Lincoln School District
Prepared by Blue Sky Engineering for the Water Authority
Contractor: John Smith
"""


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("v")).first().v


def test_parties_of_a_letter(spark):
    got = [tuple(x) for x in value(spark, people.found(F.col("text")), LETTER)]
    assert got[:4] == [("John Smith", None, "john@acme.com", None), ("Mary Q. Jones", None, "mary@city.gov", None), ("Acme Builders, Inc.", "Contractor", None, None), ("Lincoln School District", "Owner", None, None)]
    assert ("Blue Sky Engineering", None, None, "company") in got and ("Water Authority", None, None, "agency") in got
    assert [x[0] for x in got].count("John Smith") == 1
    assert value(spark, people.found(F.col("text")), None) == value(spark, people.found(F.col("text")), "") == []
    assert [tuple(x)[1:] for x in value(spark, people.found(F.col("text")), "see John Smith.ann@x.org")] == []


def test_rolled_up_parties(spark):
    text = "Owner: ACME CONST.\nArchitect: Acme Construction\nPaid by Acme Construction"
    got = {x.name: (x.role, x.email, x.company) for x in value(spark, people.rolled_up(F.col("text")), text)}
    assert got["Acme Construction"][0] == "Architect, Owner"
    rows = people.document_parties(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string"), "doc_id")
    assert {r.doc_id for r in rows.collect()} == {1}


def test_clean_names(spark):
    got = [value(spark, people.clean_name(F.col("text")), t) for t in (" Acme \n Co., ", "Acme and the", "of the", "Land")]
    assert got == ["Acme Co", "Acme", "", "Land"]


def test_written_amounts(spark):
    text = "pay One Million Dollars, one hundred thousand dollars, Fifty Thousand dollar, Three Million Dollars and TwentyDollars; $5.00" + " and" * 5000 + " dollars"
    assert value(spark, metadata.amounts(F.col("text")), text) == [1000000.0, 100000.0, 50000.0, 5.0]
    assert value(spark, metadata.amounts(F.col("text")), "") == []


def test_references_and_stored_rows(spark):
    refs = spark.createDataFrame([(["RFI 12", "Change Order #7", "RFI 13", "odd"],)], "r array<string>").select(library.grouped_references(F.col("r")).alias("v")).first().v
    assert refs == {"RFI": ["12", "13"], "Change": ["Order 7"]}
    docs = spark.createDataFrame([(1, "rfi", "RFI #5\nProject Number: P-1\nDate: 01/02/2024"), (2, None, None)], "doc_id int, type string, text string")
    got = {r.doc_id: r for r in library.stored(metadata.extract(docs, F.lit("2024-06-30").cast("date"))).collect()}
    assert got[1].title == "RFI #5" and got[1].metadata.reference_numbers["RFI"] == ["5"] and got[1].metadata.dates == [datetime.date(2024, 1, 2)]
    assert got[2].title == "unknown Document" and got[2].metadata.dates == [] and got[2].status == "pending"


def test_summary_and_status(spark):
    docs = spark.createDataFrame([("a", "rfi", 2, 0.5), ("a", "rfi", None, None), ("a", None, 1, 0.7)], "pdf_id string, type string, n_scanned int, ocr_confidence double")
    row = library.pdf_summary(docs).first()
    assert (row.documents_found, row.page_classification, row.ocr_pages, round(row.average_confidence, 6)) == (3, {"rfi": 2, "unknown": 1}, 3, 0.6)
    old, now = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 2, 2)
    rows = spark.createDataFrame([(1, "pending", old), (2, "pending", old)], "doc_id int, status string, updated_at timestamp_ntz")
    ids = spark.createDataFrame([(2,), (2,), (9,)], "doc_id int")
    got = {r.doc_id: (r.status, r.updated_at) for r in library.set_status(rows, ids, "indexed", F.lit(now).cast("timestamp_ntz")).collect()}
    assert got[1] == ("pending", old) and got[2][0] == "indexed" and len(got) == 2


def test_orphans_and_cache(spark):
    files = spark.createDataFrame([("/s/a_x.pdf", "source"), ("/s/b_y_z.pdf", "source"), ("/e/1.pdf", "extracted"), ("/e/9.pdf", "extracted"), ("/e/9.txt", "extracted")], "path string, kind string")
    docs = spark.createDataFrame([(1, "a")], "doc_id int, pdf_id string")
    assert {r.path for r in library.orphans(files, docs).collect()} == {"/s/b_y_z.pdf", "/e/9.pdf"}
    pages = spark.createDataFrame([(1, "x", ["i"]), (2, "x", ["i"]), (3, "y", None)], "page int, text string, images array<string>")
    keyed = pages.withColumn("cache_key", library.cache_key(F.col("text"), F.col("images"), 300, "eng", ("a", "b")))
    keys = [r.cache_key for r in keyed.orderBy("page").collect()]
    assert keys[0] == keys[1] != keys[2] and keys[2].startswith("ocr_")
    cache = spark.createDataFrame([(keys[0], "read"), (keys[0], "read")], "cache_key string, text string")
    hits, misses = library.cached(keyed.select("page", "cache_key"), cache)
    assert {r.page for r in hits.collect()} == {1, 2} and {r.page for r in misses.collect()} == {3}
    assert tuple(library.cache_stats(cache).first()) == (1, 8)


def test_compaction(spark, tmp_path):
    spark.range(1000).repartition(8).write.parquet(str(tmp_path / "many"))
    assert library.compact(spark, str(tmp_path / "many"), str(tmp_path / "few"), 1 << 20) == 1
    assert spark.read.parquet(str(tmp_path / "few")).count() == 1000 and len(list((tmp_path / "few").glob("*.parquet"))) == 1


def test_fragments_and_layout_scores(spark):
    rows = [(1, 0, 0), (1, 1, 1), (1, 2, 2), (1, 3, 6), (1, 7, 7)]
    got = segment.merge_fragments(spark.createDataFrame(rows, "pdf_id int, start_page int, end_page int")).collect()
    assert {tuple(r) for r in got} == {(1, 0, 1), (1, 2, 2), (1, 3, 6), (1, 7, 7)}
    pages = [(1, 0, 0.9, 0.0, [], False), (1, 1, 0.5, 1.0, ["RFI"], False), (1, 2, 0.05, 1.0, [], False), (1, 3, None, None, None, True)]
    got = visual.layout_scores(spark.createDataFrame(pages, "pdf_id int, page_num int, probability double, mean_activation double, kinds array<string>, has_letterhead boolean")).collect()
    assert {(r.page_num, round(r.score, 6), r.confidence) for r in got} == {(1, 0.76, 0.7), (2, 0.05, 0.9), (3, 0.8, 0.7)}
