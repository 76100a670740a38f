"""Steps whose cost has to grow no faster than their input, on inputs that show how they grow."""

import hashlib
import itertools
import os
import random

from pyspark.sql import functions as F

from paperloom.operators import carried, cascade, context, evaluate, parties, people, search, segment, store, vectors
from paperloom.plans import corpus, ledger_queries, queries


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_spelled_pages_are_not_broadcast(spark):
    n = spark.createDataFrame([(1, 9), (2, 7)], "pdf_id int, n int")
    ranges = n.select("pdf_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(4))).alias("start_page"), "n").select("pdf_id", "start_page", (F.col("n") - 1).alias("end_page"))
    pages = n.select("pdf_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("page_num"))
    out = segment.paged(pages, ranges)
    assert "Broadcast" not in plan(out) and out.count() == 9 + 5 + 1 + 7 + 3


def test_a_search_without_a_limit_returns_all(spark):
    docs = spark.range(120).select(F.col("id").alias("doc_id"), F.lit("a word").alias("text"))
    found = store.search(docs, store.SearchFilter(query="word", sort_by="doc_id", descending=False, limit=None, offset=3))
    assert [r.doc_id for r in found.collect()] == list(range(3, 120))


def test_rounds_of_long_pdfs_take_few_jobs(spark, tmp_path):
    lengths = {"a": 41, "b": 1, "c": 17}
    rows = [(p, i, i, i, f"{p} {i}") for p, n in lengths.items() for i in range(n)]
    windows = spark.createDataFrame(rows, "pdf_id string, step int, window_start int, window_end int, body string").repartition(3)

    def said(prompt):
        return hashlib.md5(prompt.encode()).hexdigest()

    def echo(prompts):
        return ['{"window_summary": "' + said(p) + '"}' for p in prompts]

    got = carried.carried(windows, echo, path=f"file://{tmp_path}").collect()
    assert len([d for d in os.listdir(tmp_path) if not d.startswith(".")]) == 6
    expected = {}
    for p, n in lengths.items():
        before = ""
        for i in range(n):
            before = said(carried.boundary_prompt(f"{p} {i}", before))
            expected[p, i] = before
    assert {(r.pdf_id, r.step): r.summary for r in got} == expected


def test_smart_windows_over_blocks_equal_the_loop(spark, monkeypatch):
    monkeypatch.setattr(cascade, "BLOCK", 4)
    rng, rows, expected = random.Random(3), [], []
    for pdf, n in ((1, 1), (2, 4), (3, 37), (4, 64)):
        unsure = [rng.random() < 0.5 for _ in range(n)]
        rows += [(pdf, i, 0.5 if u else 0.9, False) for i, u in enumerate(unsure)]
        at = 0
        while at < n:
            expected.append((pdf, at, min(at + 5, n) - 1, 2.0 if unsure[at] else 1.0))
            at += 1 if unsure[at] else 4
    pages = spark.createDataFrame(rows, "pdf_id int, page_num int, confidence double, needs_deep boolean")
    assert sorted(map(tuple, cascade.smart_windows(pages, 5, 1, 4).collect())) == expected


def test_greedy_matches_fold_only_what_hangs_together(spark):
    schema = "pdf_id int, start_page int, end_page int"
    pred = [(1, 4 * k, 4 * k + 3) for k in range(50)]
    truth = [(1, 4 * k + (k % 5 == 1), 4 * k + 3) for k in range(50)]
    out = evaluate.greedy_matches(spark.createDataFrame(pred, schema), spark.createDataFrame(truth, schema))
    assert sorted((r.ps, r.ts) for r in out.collect()) == sorted((p[1], t[1]) for p, t in zip(pred, truth, strict=True))
    assert "part#" in plan(out)


def test_best_word_shares_equal_all_of_them(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TEXTS", 40)
    monkeypatch.setattr(vectors, "ASKED", 3)
    rng = random.Random(5)
    rows = [(i, [rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))]) for i in range(200)] + [(7, ["a", "h"]), (7, ["b"])]
    docs = spark.createDataFrame(rows, "doc_id long, words array<string>")
    queries = spark.createDataFrame([(q, [rng.choice("abcdefghz") for _ in range(4)]) for q in range(10)] + [(10, [])], "query long, words array<string>")
    near = spark.createDataFrame([(q, v, rng.uniform(-1, 1)) for q in range(11) for v in rng.sample(range(200), 12)], "query long, vec_id long, score double")
    index = docs.select("doc_id", F.explode("words").alias("token"))
    every = vectors.hybrid(near, vectors.token_scores(index, queries), 5).collect()
    best = vectors.best_token_scores(docs, queries, near, 5)
    assert sorted(map(tuple, vectors.hybrid(near, best, 5).collect())) == sorted(map(tuple, every))
    assert best.groupBy("query").count().agg(F.max("count")).first()[0] <= 5 + 2 * 12


def test_postings_of_pieces_equal_those_of_whole_batches(spark, monkeypatch):
    docs = spark.createDataFrame([(i, None if i % 7 == 3 else f"a {i % 5} b{i} a" * (i % 4), f"t{i % 3} a") for i in range(90)], "doc_id int, text string, title string").coalesce(1)
    whole = sorted(map(str, search.postings(docs, ("title", "text")).collect()))
    monkeypatch.setattr(search, "PIECE", 40)
    assert sorted(map(str, search.postings(docs, ("title", "text")).collect())) == whole


def test_pages_lie_in_as_many_partitions_as_there_are(spark, tmp_path):
    customers = spark.range(40).select(F.col("id").alias("c_custkey"), F.lit("a").alias("c_name"))
    orders = spark.range(80).select(F.col("id").alias("o_orderkey"), (F.col("id") % 40).alias("o_custkey"), F.lit("2020-01-01").cast("timestamp").alias("o_orderdate"), F.lit(1.0).alias("o_totalprice"))
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    pages = corpus.packets(spark, str(tmp_path))
    assert pages.select(F.spark_partition_id()).distinct().count() == 4 and pages.count() == 159


def test_texts_without_a_word_are_not_searched_for_names(spark):
    texts = spark.createDataFrame([("nothing here",), ("Lincoln School District; Ann Lee <a@b.org>",)], "text string").coalesce(1)
    got = texts.select(people.found(F.col("text")).alias("p"))
    names = [{x.name for x in r.p} for r in got.collect()]
    assert names[0] == set() and {"Ann Lee", "Lincoln School District"} <= names[1]
    assert "contains(" in plan(got).lower()


def test_crowded_names_are_compared_with_openers_alone(spark, monkeypatch):
    rng = random.Random(17)
    words = ["Harbor", "Harbour", "Light", "Lights", "Marina", "Mar", "Wood", "Woods", "Inc", "Steel", "Stel", "A", "Bay"]
    names = [(k, i, "Supplier#%09d" % rng.randrange(2000)) for k in (1, 2) for i in range(70)]
    names += [(k, i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))) for k in (2, 3) for i in range(200, 250)]
    names += [(2, i, "long " * 14 + "name of a party " + str(rng.randrange(900))) for i in range(400, 415)]
    rows = spark.createDataFrame(names, "key int, ord int, name string")

    def groups():
        return {(r.key, r.canonical, tuple(r.members)) for r in parties.similar_groups(rows).collect()}

    monkeypatch.setattr(parties, "CROWD", 10**9)
    by_links = groups()
    pairs, linked = [], parties.similar_links
    monkeypatch.setattr(parties, "similar_links", lambda nodes, threshold: pairs.append(nodes.count()) or linked(nodes, threshold))
    for crowd, chunk in ((0, 60), (10, 1 << 15)):
        monkeypatch.setattr(parties, "CROWD", crowd)
        monkeypatch.setattr(parties, "CHUNK", chunk)
        assert groups() == by_links
    # no pair of crowded names was a row
    assert pairs[0] == 0


def test_pages_are_facts_before_the_window(spark):
    texts = ["From: a@b.org\nDate: 1/2/2024", None, "", "Page 1 of 2. See pumps. Best regards,", "RFI #12\nThe Pump House valves! Sincerely\n", "a === b\f---", "Invoice #9 Bill To: x", "continued on next page"]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "pdf_id int, page_num int, text string")
    out = context.page_boundaries(rows)
    want = {}
    for i, (b, a) in enumerate(zip(texts, texts[1:], strict=False), 1):
        if b is not None:
            pair = spark.createDataFrame([(b, a)], "b string, a string")
            heads = [F.when(F.substring("a", 1, 200).rlike(p), F.lit(f"strong_start: {p}")) for p in context.STRONG]
            tails = [F.when(F.substring("b", -200, 200).rlike(p), F.lit(f"weak_end: {p}")) for p in context.WEAK]
            changes = [F.when(f(F.col("b"), F.col("a")), F.lit(f.__name__)) for f in (context.topic_change, context.format_change)]
            want[i] = pair.select(F.array_compact(F.array(*heads, *tails, *changes))).first()[0]
    assert {r.page_num: r.indicators for r in out.collect()} == want and sum(map(len, want.values())) > 8
    # no text passes the window
    window = [line for line in plan(out).split("\n") if "Window [" in line]
    assert window and not any("text" in line for line in window)


def test_lines_are_summed_once_for_the_ledger(spark, tmp_path):
    spark.range(20).selectExpr("id as o_orderkey", "id % 5 as o_custkey", "100d + id as o_totalprice", "timestamp'2024-01-02' as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(40).selectExpr("id % 20 as l_orderkey", "'F' as l_linestatus", "60d as l_extendedprice", "0d as l_discount", "timestamp'2024-01-05' as l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = ledger_queries.reconciliation(spark, str(tmp_path))
    assert not any("lineitem.parquet" in f or "orders.parquet" in f for f in out.inputFiles())
    assert sorted((r.party, r.n_claimed, r.n_paid, r.n_matched) for r in out.collect()) == [(p, 4, 4, 4) for p in range(5)]


def test_several_searches_read_the_index_once(spark, tmp_path):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, rng.choice(["fr", None]), " ".join(rng.choices("aé b, c d e".split(), k=rng.randint(0, 40)))) for i in range(60)], "doc_id long, lang string, text string")
    queries = ("NEAR(ae b, 0)", "", 'NEAR("ae b" c d, 2)', "lang:fr NEAR(b ae, 1) -\"c d\"", "NEAR(c c, 0) OR \"e e e\"", "NEAR(a* e, 0) -d*", "b")
    queries = tuple(q.replace("ae", "ae" if i % 2 else "aé") for i, q in enumerate(queries))
    fields = ("lang", "text")
    path = str(tmp_path / "index")
    search.postings(docs, fields).write.parquet(path)
    index = spark.read.parquet(path)
    each = search.matching_each(index, queries)
    assert each._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    met = docs.select("doc_id", F.explode(search.queries_met(queries, fields)).alias("query"))
    # each column is folded once
    assert met._jdf.queryExecution().optimizedPlan().toString().count("translate(lower(") == len(fields)
    expected = {(q, r.doc_id) for q, query in enumerate(queries) for r in docs.where(search.query_test(query, fields)).collect()}
    assert {(r["query"], r.doc_id) for r in each.collect()} == {(r["query"], r.doc_id) for r in met.collect()} == expected and len({q for q, _ in expected}) == 6


def test_near_passes_starts_once(spark):
    rng = random.Random(8)
    rows = [(sorted(rng.sample(range(30), rng.randint(0, 6))), sorted(rng.sample(range(30), rng.randint(0, 6))), sorted(rng.sample(range(30), rng.randint(1, 6)))) for _ in range(200)]
    sizes, gap = [1, 2, 1], 3
    want = [any(max(s) - min(x + n for x, n in zip(s, sizes, strict=True)) <= gap for s in itertools.product(*r)) for r in rows]
    test = search._close([F.col("a"), F.col("b"), F.col("c")], sizes, gap)
    df = spark.createDataFrame(rows, "a array<int>, b array<int>, c array<int>").coalesce(1)
    assert [r.near for r in df.select(test.alias("near")).collect()] == want and 20 < sum(want) < 180
    long = spark.range(1).select(F.sequence(F.lit(0), F.lit(40000)).alias("a"), F.sequence(F.lit(100000), F.lit(140000)).alias("b"))
    assert long.select(search._close([F.col("a"), F.col("b")], [1, 1], 5).alias("near")).first().near is False


def test_detected_ranges_are_read_from_tables(spark, tmp_path):
    customers = spark.range(40).select(F.col("id").alias("c_custkey"), F.concat(F.lit("Customer"), F.col("id").cast("string")).alias("c_name"))
    orders = spark.range(400).select(F.col("id").alias("o_orderkey"), (F.col("id") % 40).alias("o_custkey"), F.lit("2020-01-01").cast("timestamp").alias("o_orderdate"), F.lit(1.0).alias("o_totalprice"))
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    # texts are reduced to flags before pages are sorted and numbered
    window = queries.starts(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().split("hashpartitioning(pdf_id")[0]
    assert "Window" in window and "text" not in window
    pages = corpus.packets(spark, str(tmp_path))
    found, true = queries.detected(spark, str(tmp_path))
    assert "orders" not in plan(found) + plan(true) and "Window" not in plan(found) + plan(true)
    flagged = pages.withColumn("is_start", segment.page_start(F.col("text"), F.col("page_num")))
    for got, want in ((found, segment.islands(flagged)), (true, segment.islands(pages, "is_first"))):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 100
