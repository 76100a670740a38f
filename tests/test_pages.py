import random

import pytest
from pyspark.sql import functions as F

from paperloom.functions import quality
from paperloom.operators import cascade, pagechain, parties, strategies, visual


def value(spark, column, text=None):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("v")).first().v


@pytest.mark.parametrize(("raw", "want"), [("RF1  and C0", "RFI and CO"), ("O5 l2 7O 2O24", "05 12 70 2024"), (None, None), ("", "")])
def test_repairs(spark, raw, want):
    assert value(spark, quality.repair(F.col("text")), raw) == want


def test_letters_in_dates(spark):
    assert value(spark, quality.repair_terms(F.col("text")), "l2/1O/2024 and 3/l/24, PR0JECT") == "12/10/2024 and 3/1/24, PROJECT"


def test_choice_of_text(spark):
    good = "PROJECT MEETING MINUTES of 5/6/2024: all of the many words in this text are plain and easy to read for each of us here today, $5"
    rows = spark.createDataFrame([(good, "x", 0.5), ("bad", "a longer recognised text", 0.5), ("bad", None, None), (None, None, None)], "n string, o string, c double")
    got = [tuple(r.v) for r in rows.select(quality.choose_text(F.col("n"), F.col("o"), F.col("c")).alias("v")).collect()]
    assert got[0][2] == "native" and got[1] == ("a longer recognised text", 0.5, "ocr") and got[2][::2] == ("bad", "native") and got[3] == ("", 0.0, "native")


def test_page_words(spark):
    words = spark.createDataFrame([("p", 2, "b", 90), ("p", 1, "a", 70), ("p", 3, "x", -1), ("q", 1, "x", -1)], "page_id string, ord int, text string, conf int")
    assert {tuple(r) for r in quality.page_words(words).collect()} == {("p", "a b", 0.8), ("q", "", 0.0)}


MAIL = "From: a@b.org\nTo: c@d.org\nSubject: {}\n" + "text of the mail goes on and on " * 12


@pytest.mark.parametrize(
    ("before", "text", "want"),
    [
        (MAIL.format("lot 7"), MAIL.format("RE: lot 7"), False), (MAIL.format("lot 7"), MAIL.format("lot 8"), True), ("plain words of a body", "SHEET 2 steel", True),
        ("SHEET 1 steel", "SHEET 2 steel", False), ("REQUEST FOR INFORMATION RFI 5", "REQUEST FOR INFORMATION RFI 5", True), ("REQUEST FOR INFORMATION RFI 5", "REQUEST FOR INFORMATION RFI 6", True),
        ("PACKING SLIP\nVendor: A\nOrder #1", "PACKING SLIP\nVendor: A\nOrder #1", False), ("PACKING SLIP\nVendor: A\nOrder #1", "PACKING SLIP\nVendor: A\nOrder #2", True),
        ("INVOICE #1", "INVOICE #2 of the works", True), ("APPLICATION FOR PAYMENT", "Period To 5 May", False), ("words", "> a\n> b\nc", False), ("words", None, False),
    ],
)
def test_page_chain(spark, before, text, want):
    # a repeated request number is no start by its own rule, but the base rules still see a request
    pages = spark.createDataFrame([("a", 0, "x"), ("a", 1, before), ("a", 2, text)], "pdf_id string, page_num int, text string")
    got = {r.page_num: r.is_start for r in pagechain.page_starts(pages).collect()}
    assert got[0] is True and got[2] is want


def test_smart_windows_equal_the_loop(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for pdf in range(30):
        sure = [rng.random() for _ in range(rng.randint(1, 15))]
        rows += [(pdf, i, c, False) for i, c in enumerate(sure)]
        i = 0
        while i < len(sure):
            want.add((pdf, i, min(i + 3, len(sure)) - 1, 2.0 if sure[i] < 0.7 else 1.0))
            i += 1 if sure[i] < 0.7 else 2
    got = cascade.smart_windows(spark.createDataFrame(rows, "pdf_id int, page_num int, confidence double, needs_deep boolean"))
    assert {tuple(r) for r in got.collect()} == want


def test_merges(spark):
    make = lambda rows: spark.createDataFrame(rows, "pdf_id string, start_page int, end_page int, confidence double, score double")
    totals = spark.createDataFrame([("a", 8)], "pdf_id string, n_pages int")
    pattern, visual = make([("a", 0, 0, 0.6, 0.0), ("a", 4, 5, 0.9, 0.0), ("a", 7, 7, 0.1, 0.0)]), make([("a", 0, 0, 0.9, 0.9), ("a", 2, 2, 0.9, 0.9), ("a", 6, 7, 0.9, 0.5)])
    assert {tuple(r) for r in cascade.merge_visual(pattern, visual, totals).collect()} == {("a", 0, 0), ("a", 2, 2), ("a", 4, 5)}
    merged = {tuple(r) for r in cascade.merge_llm(visual, visual.where("start_page < 6"), False).collect()}
    assert merged == {("a", 0, 0, 0.9), ("a", 2, 2, 0.9)}


def test_strategies(spark):
    pages = spark.createDataFrame([("a", 0, "RFI #: 12 question", "rfi"), ("a", 1, "RFI #: 12 more", "rfi"), ("b", 0, "Page 1 of 2", None), ("b", 1, "Page 2 of 2", "odd"), ("c", 0, None, "invoice")], "pdf_id string, page_num int, text string, type string")
    got = {(r.pdf_id, r.page_num): (r.goes_on.continues, r.goes_on.confidence) for r in strategies.judge(pages).collect()}
    assert got == {("a", 0): (False, 0.3), ("a", 1): (True, 0.95), ("b", 0): (False, 0.3), ("b", 1): (True, 0.8), ("c", 0): (False, 0.3)}


def test_party_merge(spark):
    rows = [("ABC Const.", "owner", "b@x.org", None, ""), ("ABC Construction", "architect", "a@x.org", "1", "ABC"), (None, "owner", "z", None, None)]
    got = parties.merge_parties(spark.createDataFrame(rows, "name string, role string, email string, phone string, company string")).collect()
    assert [tuple(r) for r in got] == [("ABC Construction", "architect, owner", "a@x.org", "1", "ABC", ["ABC Const."])]


def test_visual_scores(spark):
    row = lambda page, kinds=None, e=None, density=100.0, blocks=10, orientation="p", letterhead=False: ("a", page, kinds, density, 0.5, blocks, orientation, letterhead, False, 0, e)
    rows = [row(0, e=[1.0, 0.0]), row(1, e=[1.0, 0.0]), row(2, e=[0.25, 0.9682458365518543]), row(3, e=[0.25, 0.9682458365518543]), row(4, ["RFI"], None, 10.0, 30, "l", True), row(5, None, None, None, None, None, None)]
    schema = "pdf_id string, page_num int, kinds array<string>, text_density double, whitespace_ratio double, n_blocks int, orientation string, has_letterhead boolean, has_forms boolean, n_drawings int, embedding array<double>"
    got = [(r.page_num, round(r.score, 6), round(r.confidence, 6), r.is_boundary) for r in visual.boundary_scores(spark.createDataFrame(rows, schema)).orderBy("page_num").collect()]
    # page 2 is a spike of 0.6 * 0.75 between pages of 0; page 4 adds layout 0.8, pattern 1 and letterhead 0.4, times 1.2
    assert got == [(0, 1.0, 1.0, True), (1, 0.0, 0.0, False), (2, 0.45, 0.175, True), (3, 0.0, 0.0, False), (4, 0.396, 0.75, True), (5, 0.0, 0.0, False)]


def test_readings_and_longest(spark):
    row = spark.sql("select array(named_struct('text', 'a', 'confidence', 0.95D), named_struct('text', 'b', 'confidence', 0.99D)) r, array(named_struct('text', 'a', 'confidence', 0.5D), named_struct('text', 'b', 'confidence', 0.5D)) q")
    got = row.select(quality.best_reading(F.col("r")).alias("r"), quality.best_reading(F.col("q")).alias("q"), quality.longest(F.lit(None).cast("string"), F.lit("ab "), F.lit("cde")).alias("t")).first()
    assert (got.r.text, got.q.text, got.t) == ("a", "a", "ab")


def test_ambiguity_and_fragments(spark):
    scores = spark.createDataFrame([("a", 0.5), ("a", 0.9), ("b", 0.1)], "pdf_id string, score double")
    assert {tuple(r) for r in cascade.ambiguous(scores).collect()} == {("a", True), ("b", False)}
    pages = spark.createDataFrame([("a", 0, "RFI #: 1", "rfi"), ("a", 1, "RFI #: 1", "rfi"), ("a", 2, "RFI #: 2", "rfi")], "pdf_id string, page_num int, text string, type string")
    ranges = spark.createDataFrame([("a", 0, 0), ("a", 1, 1), ("a", 2, 2)], "pdf_id string, start_page int, end_page int")
    joined = strategies.fragment_joins(ranges, strategies.judge(pages))
    assert {(r.start_page, r.joins_next) for r in joined.collect()} == {(0, True), (1, False), (2, False)}
