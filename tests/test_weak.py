"""Ensembles, features, close matches, sums, annotations and words, each against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from paperloom.functions import quality
from paperloom.functions.sums import steady_sum
from paperloom.operators import catalog, classify, evaluate, segment, visual
from paperloom.sources import providers, readers


def decided(rule, rule_conf, ai, ai_conf):
    if ai == rule:
        return ai, min(ai_conf * 1.2, 1.0)
    if rule_conf > 0.7 and ai_conf < 0.6:
        return rule, rule_conf * 0.9
    if ai_conf > 0.8:
        return ai, ai_conf * 0.9
    return (ai, ai_conf * 0.7 + rule_conf * 0.3) if ai_conf >= rule_conf else (rule, rule_conf * 0.7 + ai_conf * 0.3)


def test_ensembles_by_loops(spark):
    rng = random.Random(2)
    alts = lambda: [(round(rng.random(), 2), k) for k in rng.sample("abcde", rng.randint(0, 3))]
    rows = [(i, rng.choice("ab"), rng.randint(0, 10) / 10, rng.choice("ab"), rng.randint(0, 10) / 10, alts(), alts()) for i in range(200)]
    pair = "array<struct<score:double,label:string>>"
    got = classify.ensemble(spark.createDataFrame(rows, f"id int, rule_label string, rule_conf double, ai_label string, ai_conf double, rule_alternatives {pair}, ai_alternatives {pair}")).collect()
    for r, (_, rl, rc, al, ac, ra, aa) in zip(sorted(got, key=lambda r: r.id), rows):
        label, conf = decided(rl, rc, al, ac)
        merged = {k: s * 0.6 for s, k in aa}
        for s, k in ra:
            merged[k] = merged.get(k, 0) + s * 0.4
        assert (r.label, round(r.confidence, 9)) == (label, round(conf, 9))
        assert [(a.label, a.score) for a in r.alternatives] == sorted(((k, round(s, 9)) for k, s in merged.items()), key=lambda x: -x[1])[:3]


def test_features(spark):
    docs = spark.createDataFrame([("Invoice #12, RFI 3 and CO 4, change order #5. Payment on March 3, 2024",), (None,)], "text string")
    a, b = classify.features(docs).collect()
    assert a.has_dates and a.reference_numbers == ["rfi_3", "change_order_4", "change_order_5", "invoice_12"] and "payment" in a.key_phrases
    assert not b.has_dates and b.reference_numbers == b.key_phrases == []


def test_sums_drop_nothing(spark):
    total = lambda *values: spark.createDataFrame([(v,) for v in values], "v double").agg(steady_sum("v").alias("s")).first().s
    assert total(1e24, 1.0, 4e-16) == 1e24 + 1.0 and total(*[0.1] * 10) == 1.0 and total(1e-12, 2e-12) == 3e-12
    assert total(float("nan"), 1.0) != total(float("nan"), 1.0) and total(float("inf"), 1.0) == float("inf") and total(None) is None and total(None, 2.0) == 2.0


def test_ranges_that_end_before_they_start(spark):
    schema = "pdf_id string, start_page int, end_page int"
    ranges = spark.createDataFrame([("a", 3, 1), ("a", 0, 1), ("a", 4, 9), ("b", -2, 0)], schema)
    totals = spark.createDataFrame([("a", 6), ("b", 3), ("c", 2), ("d", 0)], "pdf_id string, n_pages int")
    assert {r.pdf_id: r.covered for r in evaluate.coverage(ranges.where("start_page >= 0 and end_page < 6"), totals).collect()} == {"a": 2, "b": 0, "c": 0, "d": 0}
    assert {r.pdf_id: (r.missing, round(r.percent, 3)) for r in evaluate.missing_pages(ranges, totals).collect()} == {"a": ([2, 3], 66.667), "b": ([1, 2], 33.333), "c": ([0, 1], 0.0), "d": ([], 0.0)}
    pages = spark.createDataFrame([("a", k) for k in range(6)], "pdf_id string, page_num int")
    assert sorted(r.page_num for r in segment.paged(pages, ranges).collect()) == [0, 1, 4, 5]


def test_close_matches_by_loops(spark):
    rng = random.Random(8)
    make = lambda: sorted({(p, s, s + rng.randint(0, 6)) for p in "ab" for s in rng.sample(range(40), 8)})
    truth, pred = make(), make() + [("c", 0, 1)]
    schema = "pdf_id string, start_page int, end_page int"
    got = {r.pdf_id: r for r in evaluate.close_matches(spark.createDataFrame(truth, schema), spark.createDataFrame(pred, schema), 0.5).collect()}
    for pdf in "abc":
        own_t, own_p = [x[1:] for x in truth if x[0] == pdf], [x[1:] for x in pred if x[0] == pdf]
        hits, used = 0, set()
        for ts, te in own_t:
            best, which = 0, None
            for ps, pe in own_p:
                shared = min(te, pe) - max(ts, ps) + 1
                if shared > 0 and shared / max(te - ts + 1, pe - ps + 1) > best:
                    best, which = shared / max(te - ts + 1, pe - ps + 1), (ps, pe)
            if best > 0.5:
                hits += 1
                used.add(which)
        r = got[pdf]
        assert (r.n_true, r.n_pred, r.hits, r.false_positives) == (len(own_t), len(own_p), hits, len(own_p) - len(used))


def test_types_are_counted(spark):
    docs = spark.createDataFrame([("rfi",), ("rfi",), ("no type",)], "type string")
    got = {r.type: r.n for r in catalog.type_counts(docs).collect()}
    assert len(got) == len(catalog.TYPES) and got["rfi"] == 2 and sum(got.values()) == 2


def test_annotations_and_images(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"pdf_path": "x.pdf", "boundaries": [[0, 1], [2, 2]], "document_types": {"0": "rfi"}, "notes": "by hand"}, {"pdf_path": "y.pdf", "boundaries": [[0, 0]]}]))
    got = sorted(map(tuple, readers.annotations(spark, str(tmp_path / "a.json")).collect()), key=str)
    assert got == sorted([("x.pdf", 0, 1, "rfi", "by hand"), ("x.pdf", 2, 2, None, "by hand"), ("y.pdf", 0, 0, None, None)], key=str)
    for name, size in (("p.PNG", 5), ("q.jpg", 50), ("r.txt", 5)):
        (tmp_path / name).write_bytes(b"i" * size)
    images = readers.image_files(spark, str(tmp_path), most_bytes=10)
    read = providers.read_images(images, {"plain": lambda content: (f"{len(content)} bytes", 0.8)}).collect()
    assert {r.page_id.rpartition("/")[2]: (r.text, r.confidence) for r in read} == {"p.PNG": ("5 bytes", 0.8), "q.jpg": ("", 0.0)}


@pytest.mark.parametrize(("over", "text", "confidence"), [(0, "a b c", 0.5), (30, "b c", 0.6)])
def test_words_over_a_confidence(spark, over, text, confidence):
    words = spark.createDataFrame([("p", 0, "a", 30), ("p", 1, "b", 40), ("p", 2, "c", 80), ("p", 3, "d", -1), ("p", 4, " ", 90)], "page_id string, ord int, text string, conf int")
    r = quality.page_words(words, over).first()
    assert r.text == text and abs(r.confidence - confidence) < 1e-9


def test_one_lower_case_for_all_signs(spark):
    s = spark.createDataFrame([("Delay of PAYMENT, invoice #7",)], "text string").select(classify.first_signs(F.col("text")).alias("s")).first().s
    assert s.references == ["invoice #7"] and "payment" in s.phrases


def test_table_lines(spark):
    grid = [("a", 0, 0.0, y, 50.0, y) for y in (0.0, 20.0, 40.0, 60.0)] + [("a", 0, 50.0, y, 99.0, y + 0.5) for y in (0.0, 20.0, 40.0, 60.0)] + [("a", 0, x, 60.0, x, 0.0) for x in (0.0, 30.0, 60.0, 99.0)]
    other = [("b", 0, 0.0, 0.0, 50.0, 50.0), ("b", 0, 0.0, 0.0, 9.0, 0.0), ("b", 0, 50.0, 0.0, 60.0, 0.0), ("b", 0, None, 0.0, 1.0, 0.0)]
    lines = spark.createDataFrame(grid + other, "pdf_id string, page_num int, x1 double, y1 double, x2 double, y2 double")
    got = {r.pdf_id: (r.horizontal, r.vertical, r.has_tables) for r in visual.table_lines(lines).collect()}
    assert got == {"a": (4, 4, True), "b": (2, 0, False)}
