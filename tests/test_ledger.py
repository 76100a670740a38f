"""Reconciliation and timelines against loops over small tables."""

import random
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from paperloom.functions.tables import running
from paperloom.operators import finance, timeline


def greedy(claims, payments, tolerance):
    pairs = sorted((abs(a - b), a, b, i, j, p) for i, p, a in claims for j, q, b in payments if p is not None and p == q and None not in (a, b) and abs(a - b) <= tolerance)
    done_c, done_p, out = set(), set(), set()
    for _, a, b, i, j, p in pairs:
        if i not in done_c and j not in done_p:
            done_c.add(i)
            done_p.add(j)
            out.add((p, i, j, a, b))
    return out


@pytest.mark.parametrize("tolerance", [0, 1, 7])
def test_matches_by_loops(spark, tolerance):
    rng = random.Random(tolerance)
    amount = lambda: Decimal(rng.choice([100, 100, 100, 101, 103, 104, 110, 111, 250, 251]))
    claims = [(i, rng.choice(["a", "b", None]), amount()) for i in range(90)] + [(900, "a", None), (901, "only", Decimal(5))]
    payments = [(i, rng.choice(["a", "b", None]), amount()) for i in range(70)] + [(900, "c", Decimal(5))]
    c = spark.createDataFrame(claims, "claim_id long, party string, amount decimal(18,2)").repartition(3)
    p = spark.createDataFrame(payments, "payment_id long, party string, amount decimal(18,2)").repartition(3)
    found = finance.matches(c, p, tolerance)
    rows = found.collect()
    # of equal amounts the lower ids go together, so what is matched may differ from the loop in ids alone
    want = greedy(claims, payments, tolerance)
    assert Counter((r.party, r.claimed, r.paid) for r in rows) == Counter((p, a, b) for p, _, _, a, b in want)
    assert len({r.claim_id for r in rows}) == len(rows) == len({r.payment_id for r in rows})
    own = {i: (q, a) for i, q, a in claims}
    assert all(own[r.claim_id] == (r.party, r.claimed) for r in rows)
    sums = {r.party: r for r in finance.reconciled(c, p, found).collect() if r.party is not None}
    for party, r in sums.items():
        matched = [x for x in rows if x.party == party]
        assert r.n_matched == len(matched) and r.unpaid + sum(x.claimed for x in matched) == r.claimed and r.unclaimed + sum(x.paid for x in matched) == r.paid


def test_one_amount_of_very_many_rows(spark):
    c = spark.range(5000).select(F.col("id").alias("claim_id"), F.lit("x").alias("party"), F.lit(10).alias("amount"))
    p = spark.range(3000).select(F.col("id").alias("payment_id"), F.lit("x").alias("party"), F.when(F.col("id") < 1000, 10).otherwise(11).alias("amount"))
    found = finance.matches(c, p, 2).collect()
    assert len(found) == 3000 and {(r.claim_id, r.payment_id) for r in found} == {(k, k) for k in range(3000)}
    assert finance.matched_amounts(c.withColumn("amount", F.col("amount").cast(finance.MONEY)), p.withColumn("amount", F.col("amount").cast(finance.MONEY)), 2).count() == 2


def test_running_numbers_and_sums(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), i, rng.randint(-5, 5)) for i in range(400)]
    got = running(spark.createDataFrame(rows, "g string, k long, v long").repartition(5), ["g"], ["k"], total=F.col("v")).collect()
    sums, numbers = defaultdict(int), defaultdict(int)
    want = {}
    for g, k, v in rows:
        sums[g] += v
        numbers[g] += 1
        want[k] = (numbers[g], sums[g])
    assert {r.k: (r.number, r.total) for r in got} == want and set(got[0].asDict()) == {"g", "k", "v", "number", "total"}


def test_balances(spark):
    rows = [("a", date(2024, 1, 2), "payment", "1", 30), ("a", date(2024, 1, 1), "claim", "9", 100), ("a", date(2024, 1, 2), "claim", "2", 5), (None, date(2024, 1, 1), "claim", "3", 1)]
    got = finance.balances(spark.createDataFrame(rows, "party string, at date, kind string, id string, amount int")).collect()
    assert {(r.party, r.id): (r.number, int(r.balance)) for r in got} == {("a", "9"): (1, 100), ("a", "2"): (2, 105), ("a", "1"): (3, 75), (None, "3"): (1, 1)}


def test_sessions_by_loops(spark):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = [(rng.choice([1, 1, 1, 2, None]), start + timedelta(minutes=rng.randint(0, 9000))) for _ in range(300)] + [(1, None), (3, start)]
    by = defaultdict(list)
    for s, t in rows:
        if t:
            by[s].append(t)
    want = Counter()
    for s, ts in by.items():
        run = []
        for t in [*sorted(ts), None]:
            if run and (t is None or t - run[-1] > timedelta(hours=2)):
                want[s, run[0], run[-1], len(run)] += 1
                run = []
            run.append(t)
    got = timeline.sessions(spark.createDataFrame(rows, "subject long, at timestamp"), "2 hours").collect()
    assert Counter((r.subject, r.first, r.last, r.n) for r in got) == want


def test_open_intervals_by_loops(spark):
    rng = random.Random(5)
    day = date(2024, 1, 1)
    rows = [(rng.choice(["a", "b"]), day + timedelta(s), None if rng.random() < 0.1 else day + timedelta(s + rng.randint(-2, 9))) for s in (rng.randint(0, 60) for _ in range(80))] + [("a", None, day)]
    got = timeline.open_intervals(spark.createDataFrame(rows, "subject string, start date, end date")).collect()
    at = {(r.subject, r.at): r.n_open for r in got}
    for s in "ab":
        n = 0
        for k in range(90):
            d = day + timedelta(k)
            n = at.get((s, d), n)
            assert n == sum(x == s and a is not None and a <= d and (b is None or d <= b) for x, a, b in rows)


def test_union_keeps_what_has_a_time(spark):
    rows = spark.createDataFrame([(1, "2024-01-02 00:00:00", 5, "x"), (1, None, 6, "y")], "subject long, at string, id long, label string").withColumn("at", F.to_timestamp("at"))
    got = timeline.placed(timeline.union(b=rows, a=rows)).collect()
    assert sorted((r.source, r.id, r.number) for r in got) == [("a", "5", 1), ("b", "5", 2)]
