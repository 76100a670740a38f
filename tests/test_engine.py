import datetime
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions.stem import porter
from paperloom.operators import classify, evaluate, metadata, segment, store
from paperloom.plans import registry as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "customer", "events", "embeddings", "supplier", "documents", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = Q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(Q.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in cols]
    rows = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    assert rows and rows == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_rows_only_queries_are_not_vacuous(spark):
    for name in set(Q.QUERIES) - set(Q.ORACLE_SQL):
        assert Q.QUERIES[name](spark, SF).take(1), name


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "text string").select(*columns).first()


def test_metadata_of_a_letter(spark):
    text = "Dated: March 10, 2024\nRFI #123, PCO 7 and RFI 123\n$1,234.56 or USD 50 but not $0\nOwner: Acme Works\n2/30/2024 and 5 Jan 2023\nmail a.b@c.org"
    row = one(spark, text, metadata.dates(F.col("text")).alias("d"), metadata.references(F.col("text")).alias("r"), metadata.amounts(F.col("text")).alias("a"), metadata.role_parties(F.col("text")).alias("p"), metadata.emails(F.col("text")).alias("e"))
    assert row.d == [datetime.date(2023, 1, 5), datetime.date(2024, 3, 10)]
    assert row.r == {"RFI": ["123"], "PCO": ["7"]} and row.a == [1234.56, 50.0]
    assert [tuple(x) for x in row.p] == [("owner", "Acme Works")] and row.e == ["a.b@c.org"]
    date = one(spark, text, metadata.document_date(F.col("text"), metadata.dates(F.col("text"))).alias("d")).d
    assert date == datetime.date(2024, 3, 10)


def test_names(spark):
    names = {"ABC CONST. CO.": "Abc Construction Company", "X & Y  Elec": "X and Y Electric", "": "", None: "", "Foo L. L. C.": "Foo LLC"}
    for raw, want in names.items():
        assert one(spark, raw, T.normal_name(F.col("text")).alias("n")).n == want


def test_pair_merge_equals_the_loop(spark):
    rng = random.Random(5)
    rows, want = [], set()
    for pdf in range(60):
        flags = [rng.random() < 0.6 for _ in range(rng.randint(1, 12))]
        rows += [(pdf, 2 * i, 2 * i + 1, f) for i, f in enumerate(flags)]
        i = 0
        while i < len(flags):
            step = 2 if flags[i] and i + 1 < len(flags) else 1
            want.add((pdf, 2 * i, 2 * (i + step) - 1))
            i += step
    got = segment.merge_pairs(spark.createDataFrame(rows, "pdf_id int, start_page int, end_page int, joins_next boolean"))
    assert {tuple(r) for r in got.collect()} == want


def test_gaps_and_violations(spark):
    ranges = spark.createDataFrame([("a", 2, 3), ("a", 6, 7)], "pdf_id string, start_page int, end_page int")
    totals = spark.createDataFrame([("a", 10), ("b", 2)], "pdf_id string, n_pages int")
    assert {tuple(r) for r in segment.fill_gaps(ranges, totals).collect()} == {("a", 0, 1), ("a", 2, 3), ("a", 4, 5), ("a", 6, 7), ("a", 8, 9), ("b", 0, 1)}
    bad = spark.createDataFrame([("a", 0, 4), ("a", 4, 5), ("b", 1, 2)], "pdf_id string, start_page int, end_page int")
    assert {tuple(r) for r in segment.violations(bad, totals).collect()} == {("a", 4, 5), ("b", 1, 2)}


def test_routing_never_leaks(spark):
    row = spark.sql("select 'hybrid' m").select(T.route(F.col("m"), F.lit(True), F.lit(False), F.lit(True)).alias("a"), T.route(F.lit("full_cloud"), F.lit(False), F.lit(True), F.lit(True)).alias("b")).first()
    assert (row.a, row.b) == ("none", "cloud")


def test_replies_and_ensemble(spark):
    row = one(spark, "RFI | 95 | because | of it", T.parse_reply(F.col("text")).alias("r")).r
    assert tuple(row) == ("RFI", 0.95, "because | of it")
    both = spark.createDataFrame([("a", 0.5, "a", 0.6), ("a", 0.9, "b", 0.3), ("a", 0.2, "b", 0.9)], "rule_label string, rule_conf double, ai_label string, ai_conf double")
    assert [r.label for r in classify.ensemble(both).collect()] == ["a", "a", "b"]


def test_search_prefix_merge_and_dangling_edges(spark):
    docs = spark.createDataFrame([(1, "Delay notice"), (2, "delayed work"), (3, None)], "doc_id long, text string")
    index = store.postings(docs)
    assert {r.doc_id for r in store.matching(index, "dela*").collect()} == {1, 2}
    assert {r.doc_id for r in store.matching(index, "dela* -notice").collect()} == {2}
    edges = spark.createDataFrame([(1, 2, "related"), (1, 2, "related"), (1, 9, "related")], "source_id long, target_id long, relationship_type string")
    assert store.related(edges, docs).count() == 1
    with pytest.raises(ValueError):
        store.search(docs, store.SearchFilter(sort_by="1; drop"))


def test_index_with_fields(spark):
    docs = spark.createDataFrame([(1, "Pump room", "the valve or pump"), (2, "Valve", "a pump"), (3, None, "x"), (4, "x", None)], "doc_id long, title string, text string")
    index = store.postings(docs, ("title", "text"))
    found = lambda q: sorted(r.doc_id for r in store.matching(index, q).collect())
    assert found("title:pump") == [1] and found("pump") == [1, 2] and found("pump -title:val*") == [1]
    assert found("title:valve text:pump OR title:x OR x") == [2, 3, 4] and found("") == found("-pump") == []
    # a colon before what is no field is a sign
    assert [r.doc_id for r in store.matching(store.postings(docs), "title:x").collect()] == [] and found("valve:pump OR 1:2") == []


# Examples of Porter's paper: fixed values.
STEMS = """caresses:caress ponies:poni ties:ti caress:caress cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing
conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky
relational:relat conditional:condit rational:ration valenci:valenc digitizer:digit radically:radic vietnamization:vietnam predication:predic operator:oper
feudalism:feudal decisiveness:decis hopefulness:hope triplicate:triplic formative:form formalize:formal electrical:electr goodness:good revival:reviv
allowance:allow adjustable:adjust replacement:replac adjustment:adjust adoption:adopt probate:probat rate:rate cease:ceas controll:control roll:roll"""


def test_porter():
    pairs = [x.split(":") for x in STEMS.split()]
    assert [(w, porter(w)) for w, _ in pairs] == [(w, s) for w, s in pairs]
    assert [porter(w) for w in ("", "is", "été", "a1b2s")] == ["", "is", "été", "a1b2s"]


def test_stemmed_index(spark):
    docs = spark.createDataFrame([(1, "delays and delayed work"), (2, "Delay"), (3, None)], "doc_id long, text string")
    index = store.stemmed(store.postings(docs))
    assert {(r.doc_id, r.tf) for r in index.where("token = 'delai'").collect()} | {(r.doc_id, r.tf) for r in index.where("token = 'delay'").collect()} == {(1, 2), (2, 1)}
    assert sorted(r.doc_id for r in store.matching(index, "delaying", stems=True).collect()) == [1, 2]


def test_metrics_of_empty_predictions(spark):
    none = spark.createDataFrame([], "pdf_id string, start_page int, end_page int")
    truth = spark.createDataFrame([("a", 0, 1)], "pdf_id string, start_page int, end_page int")
    row = evaluate.range_metrics(none, truth).first()
    assert (row.n_true, row.missed, row.f1) == (1, 1, 0.0)
