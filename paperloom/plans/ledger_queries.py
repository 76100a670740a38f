"""Queries of reconciliation and timelines over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import kept
from ..operators import finance, metadata, timeline
from .corpus import RENDERED_SQL, rendered, spread, table

TOLERANCE = 2500.0


def _claims(spark, sf_dir) -> DataFrame:
    """What each order claims."""
    o = spread(table(spark, sf_dir, "orders"))
    return o.select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("party"), F.col("o_totalprice").cast(finance.MONEY).alias("amount"), F.to_date("o_orderdate").alias("at"))


def _payments(spark, sf_dir) -> DataFrame:
    """What was paid for each order's lines of one status, by the order's customer, when the last of them was shipped."""
    lines = spread(table(spark, sf_dir, "lineitem")).join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    paid = F.sum(F.col("l_extendedprice").cast("decimal(18,4)") * (1 - F.col("l_discount").cast("decimal(18,4)")))
    sums = lines.groupBy("l_orderkey", "o_custkey", "l_linestatus").agg(F.round(paid, 2).cast(finance.MONEY).alias("amount"), F.to_date(F.max("l_shipdate")).alias("at"))
    return sums.select(F.concat_ws("-", "l_orderkey", "l_linestatus").alias("payment_id"), F.col("o_custkey").alias("party"), "amount", "at")


def _ledger(spark, sf_dir) -> list[DataFrame]:
    """Claims and payments as tables: matching and sums read them many times, and the lines' join and sums run once."""
    return [kept(side(spark, sf_dir).drop("at"), f"ledger-{side.__name__.strip('_')}") for side in (_claims, _payments)]


def _money(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def payment_matches(spark, sf_dir):
    found = finance.matches(*_ledger(spark, sf_dir), TOLERANCE)
    return _money(found, "claimed", "paid")


def reconciliation(spark, sf_dir):
    claims, payments = _ledger(spark, sf_dir)
    out = finance.reconciled(claims, payments, finance.matches(claims, payments, TOLERANCE))
    return _money(out, "claimed", "paid", "difference", "unpaid", "unclaimed")


def running_balances(spark, sf_dir):
    claims, payments = _claims(spark, sf_dir), _payments(spark, sf_dir)
    entries = claims.select("party", "at", F.lit("claim").alias("kind"), F.col("claim_id").cast("string").alias("id"), "amount").unionByName(payments.select("party", "at", F.lit("payment").alias("kind"), F.col("payment_id").alias("id"), "amount"))
    return _money(finance.balances(entries), "amount", "balance")


def party_timeline(spark, sf_dir):
    """Documents, the dates in their texts and events of each customer, in one order."""
    docs = rendered(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey"), "doc_id")
    named = docs.select(F.col("o_custkey").alias("subject"), F.explode(metadata.dates(F.col("text"))).alias("at"), F.col("doc_id").alias("id"), F.col("type").alias("label"))
    written = docs.select(F.col("o_custkey").alias("subject"), F.col("created").alias("at"), F.col("doc_id").alias("id"), F.col("type").alias("label"))
    events = spread(table(spark, sf_dir, "events")).select(F.col("user_id").alias("subject"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.col("event_type").alias("label"))
    return timeline.placed(timeline.union(document=written, mention=named, event=events))


def event_sessions(spark, sf_dir):
    e = spread(table(spark, sf_dir, "events")).select(F.col("user_id").alias("subject"), F.col("ts").alias("at"))
    return timeline.sessions(e, "3 hours")


def orders_open(spark, sf_dir):
    """How many orders of a customer are open, from the order to the last shipment of its lines."""
    last = spread(table(spark, sf_dir, "lineitem")).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_date(F.max("l_shipdate")).alias("end"))
    orders = spread(table(spark, sf_dir, "orders")).join(last, "o_orderkey", "left")
    return timeline.open_intervals(orders.select(F.col("o_custkey").alias("subject"), F.to_date("o_orderdate").alias("start"), "end"))


QUERIES = {f.__name__: f for f in (payment_matches, reconciliation, running_balances, party_timeline, event_sessions, orders_open)}

_LEDGER = f"""c AS (SELECT o_orderkey AS claim_id, o_custkey AS party, o_totalprice::DECIMAL(18, 2) AS amount, o_orderdate::DATE AS "at" FROM orders),
p AS (
  SELECT l_orderkey || '-' || l_linestatus AS payment_id, o_custkey AS party, round(sum(l_extendedprice::DECIMAL(18, 4) * (1 - l_discount::DECIMAL(18, 4))), 2)::DECIMAL(18, 2) AS amount, max(l_shipdate)::DATE AS "at"
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, o_custkey, l_linestatus),
near AS (
  SELECT c.party, claim_id, payment_id, c.amount AS claimed, p.amount AS paid, row_number() OVER (PARTITION BY c.party ORDER BY abs(c.amount - p.amount), c.amount, p.amount, claim_id, payment_id) AS n
  FROM c JOIN p ON c.party = p.party AND abs(c.amount - p.amount) <= {TOLERANCE:.0f}),
walk AS (
  SELECT near.*, true AS taken, [claim_id] AS cs, [payment_id] AS ps FROM near WHERE n = 1
  UNION ALL SELECT near.*, NOT list_contains(cs, near.claim_id) AND NOT list_contains(ps, near.payment_id),
    CASE WHEN NOT list_contains(cs, near.claim_id) AND NOT list_contains(ps, near.payment_id) THEN list_append(cs, near.claim_id) ELSE cs END,
    CASE WHEN NOT list_contains(cs, near.claim_id) AND NOT list_contains(ps, near.payment_id) THEN list_append(ps, near.payment_id) ELSE ps END
  FROM walk JOIN near ON near.party = walk.party AND near.n = walk.n + 1),
m AS (SELECT * FROM walk WHERE taken)"""
ORACLE_SQL = {
    "payment_matches": f"WITH RECURSIVE {_LEDGER} SELECT party, claim_id, payment_id, claimed::DOUBLE AS claimed, paid::DOUBLE AS paid FROM m",
    "reconciliation": f"""WITH RECURSIVE {_LEDGER}, a AS (SELECT party, count(*) AS n, sum(amount) AS s FROM c GROUP BY 1), b AS (SELECT party, count(*) AS n, sum(amount) AS s FROM p GROUP BY 1),
d AS (SELECT party, count(*) AS n, sum(claimed) AS sc, sum(paid) AS sp FROM m GROUP BY 1)
SELECT coalesce(a.party, b.party) AS party, coalesce(a.n, 0) AS n_claimed, coalesce(b.n, 0) AS n_paid, coalesce(d.n, 0) AS n_matched, coalesce(a.s, 0)::DOUBLE AS claimed, coalesce(b.s, 0)::DOUBLE AS paid,
  coalesce(sc - sp, 0)::DOUBLE AS difference, (coalesce(a.s, 0) - coalesce(sc, 0))::DOUBLE AS unpaid, (coalesce(b.s, 0) - coalesce(sp, 0))::DOUBLE AS unclaimed
FROM a FULL JOIN b ON a.party = b.party LEFT JOIN d ON d.party = coalesce(a.party, b.party)""",
    "running_balances": f"""WITH RECURSIVE {_LEDGER}, e AS (SELECT party, "at", 'claim' AS kind, claim_id::VARCHAR AS id, amount FROM c UNION ALL SELECT party, "at", 'payment', payment_id, amount FROM p)
SELECT party, "at", kind, id, amount::DOUBLE AS amount, row_number() OVER w AS number, (sum(CASE kind WHEN 'claim' THEN amount ELSE -amount END) OVER w)::DOUBLE AS balance FROM e WINDOW w AS (PARTITION BY party ORDER BY "at", kind, id)""",
    "party_timeline": rf"""WITH {RENDERED_SQL}, r AS (SELECT rendered.*, o_custkey FROM rendered JOIN orders ON o_orderkey = doc_id),
t AS (
  SELECT o_custkey AS subject, created::TIMESTAMP AS "at", 'document' AS source, doc_id::VARCHAR AS id, type AS label FROM r
  UNION ALL SELECT DISTINCT o_custkey, try_strptime(unnest(regexp_extract_all(text, '\b\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{4}}\b')), '%m/%d/%Y'), 'mention', doc_id::VARCHAR, type FROM r
  UNION ALL SELECT DISTINCT o_custkey, try_strptime(unnest(regexp_extract_all(text, '\b\d{{4}}-\d{{1,2}}-\d{{1,2}}\b')), '%Y-%m-%d'), 'mention', doc_id::VARCHAR, type FROM r
  UNION ALL SELECT user_id, ts, 'event', event_id::VARCHAR, event_type FROM events)
SELECT subject, "at", source, id, label, row_number() OVER (PARTITION BY subject ORDER BY "at", source, id, label) AS number FROM t WHERE "at" IS NOT NULL""",
    "event_sessions": """WITH l AS (SELECT user_id AS subject, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events WHERE ts IS NOT NULL),
s AS (SELECT *, sum((before IS NULL OR ts > before + INTERVAL 3 HOUR)::INT) OVER (PARTITION BY subject ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM l)
SELECT subject, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY subject, run""",
    "orders_open": """WITH i AS (SELECT o_custkey AS subject, o_orderdate::DATE AS s, max(l_shipdate)::DATE AS e FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderdate),
g AS (SELECT * FROM i WHERE e IS NULL OR e >= s),
c AS (SELECT subject, "at", sum(step) AS step FROM (SELECT subject, s AS "at", 1 AS step FROM g UNION ALL SELECT subject, e + 1, -1 FROM g WHERE e IS NOT NULL) GROUP BY ALL HAVING sum(step) != 0)
SELECT subject, "at", (sum(step) OVER (PARTITION BY subject ORDER BY "at"))::BIGINT AS n_open FROM c""",
}
