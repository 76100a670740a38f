"""Versions of stores under failures, windows with carried context, table functions and the state of streams."""

import json
import time
from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from paperloom.functions.files import Files
from paperloom.operators import carried, catalog, library, metadata, snapshots, store, table_functions
from paperloom.streaming import status

DOCS = [(1, "rfi", "delay notice"), (2, "letter", "notice of work"), (3, "rfi", "nothing")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, type string, text string")


def pages_and_edges(spark):
    return spark.createDataFrame([(1, 0), (2, 0), (9, 0)], "doc_id long, page_num int"), spark.createDataFrame([(1, 2, "related"), (1, 9, "related")], "source_id long, target_id long, relationship_type string")


def broken(spark):
    @F.udf("long")
    def fails(x):
        raise RuntimeError("no more")

    return spark.range(5).select(fails("id").alias("source_id"), F.lit(1).cast("long").alias("target_id"), F.lit("related").alias("relationship_type"))


def test_a_failed_table_leaves_the_old_store_whole(spark, docs, tmp_path):
    path = f"file://{tmp_path}/store"
    pages, edges = pages_and_edges(spark)
    first = catalog.save(docs, pages, edges, path)
    more = docs.union(spark.createDataFrame([(4, "other", "later")], docs.schema))
    with pytest.raises(Exception, match="no more"):
        catalog.save(more, pages, broken(spark), path)
    tables = catalog.saved(spark, path)
    assert {n: t.count() for n, t in tables.items()} == {"documents": 3, "pages": 2, "edges": 1, "postings": 9} and snapshots.versions(spark, path) == [first]
    second = catalog.save(more, pages, edges, path)
    assert catalog.saved(spark, path)["documents"].count() == 4 and snapshots.versions(spark, path) == [second, first]
    # what the failed writer left is gone, the version before is there
    assert Files(spark).names(f"{path}/versions") == sorted([first, second]) and catalog.saved(spark, path, first)["documents"].count() == 3
    assert snapshots.restore(spark, path) == first and catalog.saved(spark, path)["documents"].count() == 3
    assert snapshots.restore(spark, path, second) == second and catalog.saved(spark, path)["documents"].count() == 4
    with pytest.raises(ValueError):
        snapshots.restore(spark, path, "x")
    with pytest.raises(ValueError):
        snapshots.tables(spark, f"{path}/nowhere")


def test_reindex_keeps_a_backup(spark, docs, tmp_path):
    path = f"file://{tmp_path}/store"
    pages, edges = pages_and_edges(spark)
    first = catalog.save(docs, pages, edges, path)
    catalog.reindex(spark, path)
    tables = catalog.saved(spark, path)
    assert [r.doc_id for r in store.matching(tables["postings"], '"delay notice"').collect()] == [1] and tables["documents"].count() == 3 and snapshots.versions(spark, path)[1] == first
    third = catalog.reindex(spark, path)
    assert snapshots.versions(spark, path)[0] == third and first not in Files(spark).names(f"{path}/versions")


def test_look_ups_ask_bloom_filters(spark, tmp_path):
    import pyarrow.parquet as pq

    docs = spark.range(20_000).select("id", F.lit("rfi").alias("type")).withColumnRenamed("id", "doc_id").withColumn("text", F.sha2(F.col("doc_id").cast("string"), 256)).coalesce(1)
    catalog.save(docs, docs.select("doc_id"), spark.createDataFrame([], "source_id long, target_id long, relationship_type string"), f"file://{tmp_path}/s")
    file = next((tmp_path / "s").rglob("versions/*/documents/type=rfi/*.parquet"))
    group = pq.ParquetFile(file).metadata.row_group(0)
    assert group.column(0).path_in_schema == "doc_id" and group.column(0).has_offset_index
    assert catalog.saved(spark, f"file://{tmp_path}/s")["documents"].where("doc_id = 777").count() == 1


def test_clearing_a_cache(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    rows = spark.createDataFrame([("a", "x", datetime(2024, 1, 1)), ("b", "y", datetime(2024, 2, 1)), ("c", None, None)], "cache_key string, text string, read_at timestamp")
    snapshots.publish(spark, path, {"cache": rows})
    assert library.clear_cache(spark, path, "2024-01-15") == 2 and library.cache_stats(snapshots.tables(spark, path)["cache"]).first().items == 1
    assert library.clear_cache(spark, path) == 1 and library.clear_cache(spark, path) == 0


def made_model():
    """A model that says of each window how long its prompt is, and sums up what was before; a closure, so that workers get it by value."""

    def answer(prompts):
        return [json.dumps({"boundaries": [], "window_summary": f"{len(p)}<{p.count('Page')}:{sum(map(ord, p)) % 997}"}) for p in prompts]

    return answer


def carried_by_loop(rows, size, overlap):
    by, model = {}, made_model()
    for pdf, page, text in rows:
        by.setdefault(pdf, {})[page] = text or ""
    out = {}
    for pdf, pages in by.items():
        before, n = "", max(pages) + 1
        for step, start in enumerate(range(0, n, size - overlap)):
            body = "\n".join(f"Page {k + 1}: {pages[k][:1000]}" for k in range(start, min(start + size, n)))
            prompt = "Which of these pages start a document? Reply as JSON with boundaries (page, confidence) and window_summary.\n" + (f"Before these pages: {before}\n" if before else "") + body
            reply = model([prompt])[0]
            before = json.loads(reply)["window_summary"]
            out[pdf, step] = (start, min(start + size, n) - 1, reply, before)
    return out


@pytest.mark.parametrize(("size", "overlap"), [(3, 1), (4, 0), (5, 3)])
def test_carried_context_equals_a_loop(spark, size, overlap):
    rows = [(pdf, page, None if page == 3 else f"text {pdf} {page} " * (page % 3)) for pdf, n in (("a", 11), ("b", 1), ("c", 4)) for page in range(n)]
    windows = carried.page_windows(spark.createDataFrame(rows, "pdf_id string, page_num int, text string").repartition(3), size, overlap)
    got = carried.carried(windows, made_model()).collect()
    assert {(r.pdf_id, r.step): (r.window_start, r.window_end, r.content, r.summary) for r in got} == carried_by_loop(rows, size, overlap)


def test_a_failed_round_resumes(spark, tmp_path):
    rows = [(pdf, page, f"text {page}") for pdf in "abc" for page in range(7)]
    windows = carried.page_windows(spark.createDataFrame(rows, "pdf_id string, page_num int, text string"), 3, 1)
    path, asked, model = f"file://{tmp_path}/rounds", str(tmp_path / "asked"), made_model()

    def dies(prompts):
        if any("Page 5" in p for p in prompts):
            raise KeyError("the machine is gone")
        return model(prompts)

    def counts(prompts):
        with open(asked, "a") as f:
            f.write("x" * len(prompts))
        return model(prompts)

    with pytest.raises(Exception, match="the machine is gone"):
        carried.carried(windows, dies, path=path).collect()
    # the first round is done, and not asked again
    got = carried.carried(windows, counts, path=path).collect()
    assert {(r.pdf_id, r.step): (r.window_start, r.window_end, r.content, r.summary) for r in got} == carried_by_loop(rows, 3, 1)
    assert len((tmp_path / "asked").read_text()) == len(got) - 3
    assert not carried.carried(windows.where("false"), model).collect()


def test_table_functions(spark):
    table_functions.register(spark)
    texts = [(1, "Total $1,200.50 and $ 0.00, $7 RFI #12 mail a.b@x.org"), (2, None), (3, "")]
    spark.createDataFrame(texts, "doc_id long, text string").createOrReplaceTempView("tf_docs")
    found = lambda family: sorted(map(tuple, spark.sql(f"SELECT doc_id, m.value FROM tf_docs, LATERAL extract_patterns(text, '{family}') AS m").collect()))
    assert found("amount") == [(1, 7.0), (1, 1200.5)] and found("reference rfi") == [(1, "12")] and found("email") == [(1, "a.b@x.org")]
    by_column = spark.table("tf_docs").select("doc_id", F.explode(metadata.amounts(F.col("text"))).alias("v"))
    assert sorted(map(tuple, by_column.collect())) == found("amount")
    assert spark.sql("SELECT m.start FROM tf_docs, LATERAL extract_patterns(text, 'reference rfi') AS m").first().start == texts[0][1].index("12 mail")
    with pytest.raises(AnalysisException):
        spark.sql("SELECT * FROM tf_docs, LATERAL extract_patterns(text, 'nothing') AS m").collect()
    pages = [(p, k, k in (0, 2, 3)) for p in ("a", "b") for k in range(5)] + [("c", 0, False)]
    spark.createDataFrame(pages, "pdf_id string, page_num int, is_start boolean").repartition(3).createOrReplaceTempView("tf_pages")
    runs = spark.sql("SELECT * FROM page_runs(TABLE(SELECT * FROM tf_pages) PARTITION BY pdf_id ORDER BY page_num)").collect()
    assert sorted(map(tuple, runs)) == sorted([*((p, *r) for p in "ab" for r in ((0, 1), (2, 2), (3, 4))), ("c", 0, 0)])


def test_streams_take_each_page_once_and_tell_their_state(spark, tmp_path):
    schema = "pdf_id string, page_num int, text string, arrived timestamp"
    inbox, out, notes = (f"file://{tmp_path}/{x}" for x in ("inbox", "out", "jobs"))
    page = lambda k, hour, text="x": ("a", k, text, datetime(2024, 1, 1, hour))
    files = [[page(0, 1), page(1, 1)], [page(1, 1), page(2, 5)], [page(7, 1), page(3, 6)], [page(3, 6), page(4, 6)]]  # page 7 comes too late
    listener = status.JobStatus(spark, notes)
    spark.streams.addListener(listener)
    try:
        for rows in files:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
            query = status.watch_once(spark, inbox, schema, lambda df: df, out, f"{tmp_path}/state", name="inbox")
            query.awaitTermination(120)
            assert query.exception() is None
        with pytest.raises(Exception, match="no more"):
            def fails(df):
                raise RuntimeError("no more")

            status.watch_once(spark, inbox, schema, fails, out, f"{tmp_path}/other", name="broken").awaitTermination(120)
        for _ in range(60):
            found = {r.name: r for r in status.jobs(spark.read.schema(status.SCHEMA).parquet(notes)).collect()} if Files(spark).exists(notes) else {}
            if found.get("broken") and found["broken"].state == "failed" and found.get("inbox") and found["inbox"].state == "ended":
                break
            time.sleep(1)
    finally:
        spark.streams.removeListener(listener)
    got = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out).collect()
    assert sorted(r.page_num for r in got) == [0, 1, 2, 3, 4]
    assert found["inbox"].state == "ended" and found["inbox"].input_rows == 8 and found["inbox"].batches >= 4 and found["inbox"].watermark
    assert found["broken"].state == "failed" and "no more" in found["broken"].error
