"""Queries of the evidence graph over the star schema, and their SQL.

Claims are customers, documents orders, facts parts, parties suppliers. A claim is supported by its urgent and high orders, an order references the
parts of its lines, supports those that were accepted and contradicts those that came back, and responds to the customer's order before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph
from .corpus import spread, table


#: The kinds of nodes; a node in numbers is its key plus its kind's place times SPAN.
KINDS, SPAN, DIGITS = ("claim", "doc", "fact", "party"), 2**60, 17


def _named(kind: str, key: str) -> F.Column:
    return F.concat(F.lit(kind + ":"), F.col(key).cast("string"))


def _numbered(kind: str, key: str) -> F.Column:
    return F.col(key).cast("long") + F.lit(KINDS.index(kind) * SPAN)


def _kind(node: F.Column) -> F.Column:
    return F.shiftright(node + SPAN // 2, 60)


def _spelled_order(key: F.Column) -> F.Column:
    """A long that sorts as the key's digits do, as text: the digits filled up by zeros, then their number; keys of over 17 digits fail."""
    size = F.char_length(F.abs(key).cast("string"))
    order = F.when(size <= DIGITS, F.abs(key) * F.element_at(F.array(*(F.lit(10 ** (DIGITS - n)) for n in range(1, DIGITS + 1))), F.least(size, F.lit(DIGITS))) * 20 + size)
    order = F.when(key.isNotNull() & order.isNull(), F.raise_error(F.lit("keys of nodes have at most 17 digits")).cast("long")).otherwise(order)
    return F.when(key < 0, order - 20 * 10**DIGITS).otherwise(order)


def _of_order(order: F.Column) -> F.Column:
    """The key of a place in _spelled_order."""
    size, digits = F.pmod(order, F.lit(20)).cast("int"), F.when(order < 0, order + 20 * 10**DIGITS).otherwise(order)
    return F.concat(F.when(order < 0, "-").otherwise(""), F.lpad(F.call_function("div", digits, F.lit(20)).cast("string"), DIGITS, "0").substr(F.lit(1), size))


def evidence_edges(spark, sf_dir, node=_named) -> DataFrame:
    """Edges, some of them repeated, of nodes spelled as kind:key, or as `node` has them."""
    orders, lines = spread(table(spark, sf_dir, "orders")), spread(table(spark, sf_dir, "lineitem"))
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    claims = orders.where("o_orderpriority in ('1-URGENT', '2-HIGH')").select(node("claim", "o_custkey"), node("doc", "o_orderkey"), F.lit("supports"))
    replies = orders.select("o_orderkey", before.alias("before")).where("before is not null").select(node("doc", "o_orderkey"), node("doc", "before"), F.lit("responds_to"))
    kind = F.when(F.col("l_returnflag") == "A", "supports").when(F.col("l_returnflag") == "R", "contradicts").otherwise("references")
    facts = lines.select(node("doc", "l_orderkey"), node("fact", "l_partkey"), kind)
    causes = lines.select(node("fact", "l_partkey"), node("party", "l_suppkey"), F.lit("causes"))
    return reduce(DataFrame.union, (claims, replies, facts, causes)).toDF("source_id", "target_id", "relationship_type")


def _claims(spark, sf_dir, node=_named) -> DataFrame:
    return table(spark, sf_dir, "customer").select(node("claim", "c_custkey").alias("seed"))


def _digits(node: F.Column) -> F.Column:
    """How many digits a node's key has; of nodes with as many and the same sign, the first or last number is the first as text."""
    return F.char_length(F.abs(node - _kind(node) * SPAN).cast("string"))


def evidence_reach(spark, sf_dir):
    """How far each claim's evidence goes in four hops: nodes by kind and distance."""
    found = graph.reached(evidence_edges(spark, sf_dir, _numbered), _claims(spark, sf_dir, _numbered), 4, by=_digits)
    # lists are summed up first: expressions of their ends would each look through the whole list again
    ends = found.groupBy("seed", "base", "by", "distance").agg(F.sum(F.size("nodes")).alias("n"), F.min(F.array_min("nodes")).alias("low"), F.max(F.array_max("nodes")).alias("high"))
    ends = ends.select("seed", "distance", "n", *(graph.whole("base", F.col(end)).alias(end) for end in ("low", "high")))
    kind = _kind(F.col("low"))
    first = F.least(*(_spelled_order(F.col(end) - kind * SPAN) for end in ("low", "high")))
    least = ends.groupBy("seed", kind.alias("kind"), "distance").agg(F.sum("n").alias("n"), F.min(first).alias("first"))
    # element_at takes a null place for one of the array's
    name = F.when(F.col("kind").isNotNull(), F.element_at(F.array(*map(F.lit, KINDS)), (F.col("kind") + 1).cast("int")))
    seed = F.concat(F.lit("claim:"), F.col("seed").cast("string"))
    return least.select(seed.alias("seed"), name.alias("kind"), "distance", "n", F.concat(name, F.lit(":"), _of_order(F.col("first"))).alias("first"))


def evidence_chains(spark, sf_dir):
    """Paths of up to three edges from each claim to facts that a document contradicts on the way."""
    edges = evidence_edges(spark, sf_dir).where("relationship_type in ('supports', 'responds_to', 'contradicts')")
    found = graph.chains(edges, _claims(spark, sf_dir), 3).where("node like 'fact:%'")
    return found.groupBy("seed", "node").agg(F.count("*").alias("n_paths"), F.min("hops").alias("shortest"), F.min(F.array_join("path", " ")).alias("first_path"))


def contradicting_documents(spark, sf_dir):
    return graph.contradictions(evidence_edges(spark, sf_dir).where("target_id like 'fact:%'"))


def missing_evidence(spark, sf_dir):
    """Claims without a supporting document, and documents that neither support nor reference a fact."""
    nodes = _claims(spark, sf_dir).select(F.col("seed").alias("node"), F.lit("claim").alias("kind")).unionByName(table(spark, sf_dir, "orders").select(_named("doc", "o_orderkey").alias("node"), F.lit("document").alias("kind")))
    return graph.missing_evidence(nodes, evidence_edges(spark, sf_dir), {"claim": ["supports"], "document": ["supports", "references"]})


QUERIES = {f.__name__: f for f in (evidence_reach, evidence_chains, contradicting_documents, missing_evidence)}

_E = """e AS (
  SELECT 'claim:' || o_custkey AS s, 'doc:' || o_orderkey AS t, 'supports' AS k FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
  UNION SELECT 'doc:' || o_orderkey, 'doc:' || before, 'responds_to' FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders) WHERE before IS NOT NULL
  UNION SELECT 'doc:' || l_orderkey, 'fact:' || l_partkey, CASE l_returnflag WHEN 'A' THEN 'supports' WHEN 'R' THEN 'contradicts' ELSE 'references' END FROM lineitem
  UNION SELECT 'fact:' || l_partkey, 'party:' || l_suppkey, 'causes' FROM lineitem)"""
ORACLE_SQL = {
    "evidence_reach": f"""WITH RECURSIVE {_E}, p AS (SELECT DISTINCT s, t FROM e),
r(seed, node, distance) AS (SELECT 'claim:' || c_custkey, 'claim:' || c_custkey, 0 FROM customer UNION SELECT seed, t, distance + 1 FROM r JOIN p ON s = node WHERE distance < 4),
m AS (SELECT seed, node, min(distance)::INT AS distance FROM r GROUP BY ALL)
SELECT seed, split_part(node, ':', 1) AS kind, distance, count(*) AS n, min(node) AS first FROM m GROUP BY ALL""",
    "evidence_chains": f"""WITH RECURSIVE {_E}, p AS (SELECT DISTINCT s, t FROM e WHERE k IN ('supports', 'responds_to', 'contradicts')),
r(seed, node, hops, path) AS (SELECT 'claim:' || c_custkey, 'claim:' || c_custkey, 0, ['claim:' || c_custkey] FROM customer UNION ALL SELECT seed, t, hops + 1, list_append(path, t) FROM r JOIN p ON s = node WHERE hops < 3 AND NOT list_contains(path, t))
SELECT seed, node, count(*) AS n_paths, min(hops)::INT AS shortest, min(array_to_string(path, ' ')) AS first_path FROM r WHERE node LIKE 'fact:%' GROUP BY ALL""",
    "contradicting_documents": f"""WITH {_E}, n AS (SELECT t, count(*) FILTER (WHERE k = 'contradicts') AS a, count(*) FILTER (WHERE k = 'supports') AS b FROM e WHERE t LIKE 'fact:%' GROUP BY 1)
SELECT e.t AS target_id, s AS source_id, a AS n_against, b AS n_support FROM e JOIN n ON n.t = e.t WHERE k = 'contradicts' AND b > 0""",
    "missing_evidence": f"""WITH {_E} SELECT 'claim:' || c_custkey AS node, 'claim' AS kind, 'supports' AS lacks FROM customer WHERE 'claim:' || c_custkey NOT IN (SELECT s FROM e WHERE k = 'supports')
UNION ALL SELECT 'doc:' || o_orderkey, 'document', 'supports or references' FROM orders WHERE 'doc:' || o_orderkey NOT IN (SELECT s FROM e WHERE k IN ('supports', 'references'))""",
}
