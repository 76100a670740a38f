"""Whole jobs: nothing of the input is left out."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from paperloom.functions import replies


def test_whole_chunks_lose_no_text(spark):
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    texts = ["", "a", letters(950), letters(230) + ". " + letters(320) + ". b", "\u00e9\U0001f600" * 300, letters(90) + ". " + letters(400)]
    texts += [". ".join(letters(rng.choice([1, 5, 30, 90, 200, 700])) for _ in range(rng.randint(1, 40))) for _ in range(30)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = rows.select("t", replies.chunks(F.col("t"), 25, whole=True).alias("c"), replies.chunks(F.col("t"), 25).alias("clipped")).collect()
    for r in got:
        assert all(len(c) <= 100 for c in r.c)
        joined, at = "".join(r.c), 0
        for sentence in r.t.split(". "):
            assert (at := joined.find(sentence.strip(), at)) >= 0
            at += len(sentence.strip())
        if all(len(s) <= 100 for s in r.t.split(". ")) and all(len(c) <= 100 for c in r.clipped):
            assert r.c == r.clipped
    long = texts[2]
    assert {r.t: r.c for r in got}[long] == [long[k : k + 100] for k in range(0, 950, 100)]


def test_document_chunks_hold_the_whole_text(spark, tmp_path):
    from paperloom.plans import queries

    spark.createDataFrame([(1, "x" * 7001)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [(r.place, r.n_chars) for r in queries.document_chunks(spark, str(tmp_path)).orderBy("place").collect()] == [(0, 2000), (1, 2000), (2, 2000), (3, 1001)]


def test_similar_parties_of_all_nations(spark, tmp_path):
    from paperloom.plans import queries

    rows = [(1, "Harbor Lights Marina", 0), (2, "Granite Peak Masonry", 1), (3, "Harbor Light Marina", 1), (4, "Harbour Lights Marina", 7)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    assert [r.members for r in queries.similar_parties(spark, str(tmp_path)).collect()] == ["Harbor Lights Marina|Harbor Light Marina|Harbour Lights Marina"]


def test_evaluation_scores_a_detector(spark):
    from paperloom.plans import queries

    sf = "/root/testdata/sf0.001"
    true, found = ({(r.pdf_id, r.start_page, r.end_page) for r in queries.QUERIES[n](spark, sf).collect()} for n in ("segment_truth", "segment_pages"))
    got = queries.QUERIES["detector_metrics"](spark, sf).collect()
    assert sum(r.n_pred for r in got) == len(found) and sum(r.n_true for r in got) == len(true)
    assert sum(r.exact for r in got) == len(true & found)
