import json
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from paperloom.operators import store, twostage

# workers cannot import this module, so the models below travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])
PAGES = "pdf_id int, page_num int, text string"
TEXTS = ["From: ann@x.org", "more", "INVOICE # 5", "more", None, "RFI # 7", "more"]


def fast(prompts):
    out = []
    for p in prompts:
        lines = [x for x in p.split("\n") if x.startswith("Page ")]
        rows = [{"page": i, "likely_boundary": "=True" in x, "confidence": 0.9 if "=True" in x else 0.75, "needs_deep_analysis": False} for i, x in enumerate(lines)]
        out.append("```json\n" + json.dumps(rows) + "\n```")
    return out


def down(prompts):
    raise RuntimeError("down")


def deep(prompts):
    rows = [{"page_num": n, "is_boundary": n in (2, 5), "confidence": 0.8} for n in range(7)]
    return [json.dumps({"boundaries": [r for r in rows if f"Page {r['page_num'] + 1}:" in p]}) for p in prompts]


def pages(spark, *ids):
    return spark.createDataFrame([(d, i, t) for d in ids for i, t in enumerate(TEXTS)], PAGES)


def ranges(df):
    return {tuple(r) for r in df.collect()}


def test_sure_screening_needs_no_deep_model(spark):
    assert ranges(twostage.ranges(pages(spark, 1, 2), fast, down)) == {(d, *r) for d in (1, 2) for r in ((0, 1), (2, 4), (5, 6))}


def test_deep_model_where_screening_fails(spark):
    got = twostage.screen(pages(spark, 1), down).collect()
    assert {(r.page_num, r.likely_boundary, r.confidence, r.needs_deep) for r in got} == {(i, i in (0, 5), 0.3, True) for i in range(7)}
    assert ranges(twostage.ranges(pages(spark, 1), down, deep)) == {(1, 0, 1), (1, 2, 4), (1, 5, 6)}


def test_no_model_and_no_pages(spark):
    assert ranges(twostage.ranges(pages(spark, 1), down, down)) == {(1, 0, 6)}
    assert ranges(twostage.ranges(pages(spark, 1), lambda p: ["no json"] * len(p), lambda p: ["none"] * len(p))) == {(1, 0, 6)}
    assert ranges(twostage.ranges(spark.createDataFrame([], PAGES), fast, deep)) == set()


def test_fallback_words(spark):
    got = pages(spark, 1).select("page_num", twostage.fallback_start(F.col("text")).alias("s")).where("s").collect()
    assert {r.page_num for r in got} == {0, 2, 5}


def test_search_by_page_flags_and_references(spark):
    docs = spark.createDataFrame([(1, "rfi", ["RFI 5"]), (2, "rfi", ["RFI 6"]), (3, "rfi", None)], "doc_id int, type string, reference_numbers array<string>").withColumns({"created": F.lit("2024-01-01").cast("date")})
    seen = spark.createDataFrame([(1, True, False, None), (1, False, False, None), (2, None, True, True)], "doc_id int, has_tables boolean, has_images boolean, is_scanned boolean")
    flagged = store.with_page_flags(docs, seen)
    found = lambda **k: {r.doc_id for r in store.search(flagged, store.SearchFilter(**k)).collect()}
    assert found(has_tables=True) == {1} and found(is_ocr=False) == {1, 3} and found(has_images=True, reference_numbers=["RFI 6", "x"]) == {2} and found(reference_numbers=["RFI 5"]) == {1}
