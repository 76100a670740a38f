"""Walks over the evidence graph against loops."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import graph
from paperloom.plans import graph_queries


def walks(edges, seeds, hops):
    """All paths without a repeated node, by hops."""
    out, frontier = [], [(s, (s,)) for s in set(seeds)]
    for _ in range(hops):
        frontier = [(s, (*p, t)) for s, p in frontier for a, t in edges if a == p[-1] and t not in p]
        out += frontier
    return out


@pytest.mark.parametrize("hub", [10_000, 2])
def test_walks_by_loops(spark, hub):
    rng = random.Random(1)
    pairs = {(rng.randint(0, 12), rng.randint(0, 12)) for _ in range(30)} | {(0, k) for k in range(10)} | {(5, 5)}
    rows = [(a, b, "x") for a, b in pairs] + [(1, 2, "x"), (None, 3, "x"), (3, None, "x"), (4, 0, "other")]
    edges = spark.createDataFrame(rows, "source_id long, target_id long, relationship_type string")
    seeds = [0, 3, 3, 99]
    seed_rows = spark.createDataFrame([(s,) for s in seeds], "seed long")
    plain = {(a, b) for a, b, k in rows if None not in (a, b) and k == "x"}
    want = walks(plain, seeds, 3)
    got = graph.chains(edges, seed_rows, 3, ["x"], hub).collect()
    assert sorted((r.seed, tuple(r.path)) for r in got) == sorted(want) and all(r.hops == len(r.path) - 1 and r.node == r.path[-1] for r in got)
    least = {(s, s): 0 for s in seeds}
    for s, p in want:
        least[s, p[-1]] = min(least.get((s, p[-1]), 9), len(p) - 1)
    found = graph.reach(edges, seed_rows, 3, ["x"], hub).collect()
    assert {(r.seed, r.node): r.distance for r in found} == least and len(found) == len(least)


def test_walks_of_nothing(spark):
    none = spark.createDataFrame([], "source_id long, target_id long, relationship_type string")
    seeds = spark.createDataFrame([(1,)], "seed long")
    assert [tuple(r) for r in graph.reach(none, seeds, 3).collect()] == [(1, 1, 0)] and not graph.chains(none, seeds, 3).collect()


def test_contradictions_and_gaps(spark):
    rows = [("a", "f", "supports"), ("b", "f", "contradicts"), ("b", "f", "contradicts"), ("c", "f", "contradicts"), ("c", "g", "contradicts"), ("d", None, "supports")]
    edges = spark.createDataFrame(rows, "source_id string, target_id string, relationship_type string")
    assert sorted(map(tuple, graph.contradictions(edges).collect())) == [("f", "b", 2, 1), ("f", "c", 2, 1)]
    nodes = spark.createDataFrame([(x, "doc") for x in "abcd"] + [("e", "claim")], "node string, kind string")
    got = graph.missing_evidence(nodes, edges, {"doc": ["supports", "contradicts"], "claim": ["supports"]}).collect()
    assert sorted(map(tuple, got)) == [("d", "doc", "supports or contradicts"), ("e", "claim", "supports")]


@pytest.mark.parametrize("hub", [10_000, 3])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_ends_of_walks_are_not_written(spark, monkeypatch, hub, kind):
    written, keep = [], graph.kept
    monkeypatch.setattr(graph, "kept", lambda df, name: written.append((name, keep(df, name))) or written[-1][1])
    big = 2**60
    rows = [(0, 1), (0, big), (1, big), (1, -7)] + [(big, 2**31 * k - 5) for k in range(20)] + [(-7, big + k) for k in range(1, 20)]
    edges = spark.createDataFrame([(*r, "x") for r in rows], "source_id long, target_id long, relationship_type string")
    edges = edges.withColumns({c: edges[c].cast(kind) for c in ("source_id", "target_id")})
    seeds = spark.createDataFrame([(0,), (-7,)], "seed long").select(F.col("seed").cast(kind))
    least = {(0, 0): 0, (-7, -7): 0} | {(s, p[-1]): len(p) - 1 for s, p in reversed(walks(rows, [0, -7], 3))}
    got = graph.reach(edges, seeds, 3, None, hub).collect()
    assert {(int(r.seed), int(r.node)): r.distance for r in got} == least and len(got) == len(least)
    assert sum(df.count() for name, df in written if name == "graph-reach") == 5


def test_spelled_order_sorts_as_text(spark):
    keys = [0, 1, 2, 9, 10, 11, 99, 100, -1, -2, -10, 10**16, 10**17 - 1, 12345678901234567]
    order = graph_queries._spelled_order(F.col("k"))
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", order.alias("o"), graph_queries._of_order(order).alias("text")).collect()
    assert [r.text for r in sorted(rows, key=lambda r: r.o)] == sorted(map(str, keys)) and all(r.text == str(r.k) for r in rows)


@pytest.mark.parametrize("crowd", [1_000, 2])
@pytest.mark.parametrize("hub", [10_000, 3])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_lists_of_walks_have_each_node_once(spark, hub, crowd, kind):
    rng, big = random.Random(2), 2**60
    pairs = [(rng.randint(0, 9), rng.randint(0, 14)) for _ in range(40)] + [(k, big - 3 + k) for k in range(9)] + [(big, -(2**40)), (4, 4)]
    edges = spark.createDataFrame([(*p, "x") for p in pairs * 3], "source_id long, target_id long, relationship_type string")
    edges = edges.withColumns({c: edges[c].cast(kind) for c in ("source_id", "target_id")})
    seeds = [0, 1, 7, 7, 99, None]
    seed_rows = spark.createDataFrame([(s,) for s in seeds], "seed long").select(F.col("seed").cast(kind))
    least = {(None, None): 0} | {(s, s): 0 for s in seeds}
    for s, p in reversed(walks(set(pairs), [s for s in seeds if s is not None], 3)):
        least[s, p[-1]] = min(least.get((s, p[-1]), 9), len(p) - 1)
    found = graph.reached(edges, seed_rows, 3, None, hub, lambda node: F.length(node.cast("string")), crowd)
    node = graph.whole("base", F.col("low")) if kind == "long" else F.col("low")
    got = found.select("seed", "by", "distance", F.explode("nodes").alias("low"), "base").select("seed", "by", "distance", node.alias("node")).collect()
    number = lambda x: None if x is None else int(x)
    assert {(number(r.seed), number(r.node)): r.distance for r in got} == least and len(got) == len(least)
    assert all(r.by == (None if r.node is None else len(str(r.node))) for r in got)
    for hops in (0, 1):
        rows = graph.reach(edges, seed_rows, hops, None, hub, crowd).collect()
        want = {k: d for k, d in least.items() if d <= hops}
        assert {(number(r.seed), number(r.node)): r.distance for r in rows} == want and len(rows) == len(want)


def made(plan):
    """Rows that each operator of a plan that has run made."""
    kind = plan.getClass().getSimpleName()
    inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else []
    rows = plan.metrics().get("numOutputRows")
    children = plan.children()
    return ([rows.get().value()] if rows.isDefined() else []) + [n for p in inner + [children.apply(i) for i in range(children.size())] for n in made(p)]


def test_no_row_is_made_for_a_seed_and_an_end(spark):
    found = graph_queries.evidence_reach(spark, "/root/testdata/sf0.01")
    reached = sum(r.n for r in found.collect())
    assert max(made(found._jdf.queryExecution().executedPlan())) < reached


def test_first_nodes_of_odd_keys(spark, tmp_path):
    keys = [-1, -2, -12, -9, 0, 3, 10, 7, 70, 700, 2**33, 2**33 + 1, 10**16, None]
    orders = [(o, k, f"1998-01-{i + 1:02}", "1-URGENT" if i % 3 else "5-LOW") for i, (o, k) in enumerate(zip(keys, [5, 5, None, -5, -5, 5, -5, 5, 40, 40, 5, -5, 5, 40], strict=True))]
    lines = [(o, p, s, "ANR"[(i + j) % 3]) for i, o in enumerate(keys) for j, (p, s) in enumerate(zip(keys[i:] + keys[:3], keys[::-1], strict=False))]
    spark.createDataFrame([(5,), (-5,), (40,), (40,), (6,), (None,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines * 2, "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = [tuple(r)[:2] for r in graph_queries.evidence_edges(spark, str(tmp_path)).collect() if None not in tuple(r)]
    seeds = ["claim:5", "claim:-5", "claim:40", "claim:6"]
    least = {(None, None): 0} | {(s, s): 0 for s in seeds}
    for s, p in reversed(walks(set(edges), seeds, 4)):
        least[s, p[-1]] = min(least.get((s, p[-1]), 9), len(p) - 1)
    want = {}
    for (s, n), d in least.items():
        want.setdefault((s, n and n.split(":")[0], d), []).append(n)
    got = graph_queries.evidence_reach(spark, str(tmp_path)).collect()
    assert {(r.seed, r.kind, r.distance): (r.n, r.first) for r in got} == {k: (len(v), min(v, key=str) if v != [None] else None) for k, v in want.items()}
