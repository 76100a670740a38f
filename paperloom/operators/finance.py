"""Reconciling what was claimed with what was paid: matches within a tolerance, leftovers and running balances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import kept, running

MONEY = "decimal(18,2)"


def _amounts(rows: DataFrame, n: str) -> DataFrame:
    return rows.groupBy("party", "amount").agg(F.count("*").alias(n))


def matched_amounts(claims: DataFrame, payments: DataFrame, tolerance: float) -> DataFrame:
    """(party, claimed, paid, n, claims_before, payments_before): how many claims of one amount go with payments of another.

    Amounts, not rows, are paired: those of a party that lie within the tolerance meet by bucket of its width, so equal amounts are
    one row however many there are. In a round each amount names its nearest (the lower of equally near ones, claims before
    payments); two that name each other take as many as both have, and what is left goes on. This gives what taking pairs by
    (difference, claimed, paid) one after the other gives.
    """
    width = F.lit(tolerance).cast(MONEY)
    bucket = F.floor(F.col("amount") / width) if tolerance else F.col("amount")
    c = _amounts(claims, "nc").select("party", F.col("amount").alias("claimed"), "nc", bucket.alias("bucket"))
    p = _amounts(payments, "np").withColumn("bucket", F.explode(F.array(*(bucket + k for k in (-1, 0, 1)))) if tolerance else bucket)
    near = c.join(p.withColumnRenamed("amount", "paid"), ["party", "bucket"]).where(F.abs(F.col("claimed") - F.col("paid")) <= width)
    open_ = kept(near.select("party", "claimed", "paid", F.abs(F.col("claimed") - F.col("paid")).alias("diff"), "nc", "np"), "ledger-pairs")
    rounds = []
    while not open_.isEmpty():
        key = F.struct("diff", "claimed", "paid")
        best_c = open_.groupBy("party", "claimed").agg(F.min(key).alias("bc"))
        best_p = open_.groupBy("party", "paid").agg(F.min(key).alias("bp"))
        mutual = best_c.join(best_p, (best_c["party"] == best_p["party"]) & (F.col("bc") == F.col("bp"))).select(best_c["party"], "bc.claimed", "bc.paid")
        taken = kept(open_.join(mutual, ["party", "claimed", "paid"]).select("party", "claimed", "paid", F.least("nc", "np").alias("n")), "ledger-taken")
        rounds.append(taken.withColumn("round", F.lit(len(rounds))))
        less_c, less_p = (taken.select("party", k, F.col("n").alias(f"{k}_n")) for k in ("claimed", "paid"))
        left = open_.join(less_c, ["party", "claimed"], "left").join(less_p, ["party", "paid"], "left")
        left = left.withColumns({"nc": F.col("nc") - F.coalesce("claimed_n", F.lit(0)), "np": F.col("np") - F.coalesce("paid_n", F.lit(0))}).where("nc > 0 and np > 0")
        open_ = kept(left.select(*open_.columns), "ledger-pairs")
    if not rounds:
        return open_.select("party", "claimed", "paid", F.col("nc").alias("n"), F.lit(0).cast("long").alias("claims_before"), F.lit(0).cast("long").alias("payments_before"))
    every = kept(reduce(DataFrame.unionByName, rounds), "ledger-matches")
    # an amount takes part at most once in a round: its rows go to rounds in turn
    out = every
    for side, before in (("claimed", "claims_before"), ("paid", "payments_before")):
        upto = running(every.select("party", side, "round", "n"), ["party", side], ["round"], total=F.col("n"))
        out = out.join(upto.select("party", side, "round", (F.col("total") - F.col("n")).alias(before)), ["party", side, "round"])
    return out.drop("round")


def matches(claims: DataFrame, payments: DataFrame, tolerance: float) -> DataFrame:
    """(party, claim_id, payment_id, claimed, paid): each claim (claim_id, party, amount) with at most one payment (payment_id, party, amount) and the other way round.

    Pairs of a party are taken by least difference, at most the tolerance, then lower claimed and paid amounts; rows of equal amounts go by id.
    Rows with a null party or amount match nothing; ids are unique.
    """
    c, p = (t.withColumn("amount", F.col("amount").cast(MONEY)) for t in (claims, payments))
    pairs = matched_amounts(c, p, tolerance)
    numbered = {}
    for side, rows, key in (("claimed", c, "claim_id"), ("paid", p, "payment_id")):
        rows = rows.where("party is not null and amount is not null").select("party", "amount", key)
        numbered[side] = running(rows, ["party", "amount"], [key]).select("party", F.col("amount").alias(side), key, F.col("number").alias(f"{side}_no"))
    # the k-th pair of a match takes the k-th row that each side still has
    spelled = pairs.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    spelled = spelled.select("party", "claimed", "paid", (F.col("claims_before") + F.col("k")).alias("claimed_no"), (F.col("payments_before") + F.col("k")).alias("paid_no"))
    return spelled.join(numbered["claimed"], ["party", "claimed", "claimed_no"]).join(numbered["paid"], ["party", "paid", "paid_no"]).select("party", "claim_id", "payment_id", "claimed", "paid")


def reconciled(claims: DataFrame, payments: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each party: what it claimed and was paid, matched and left over on both sides; matched and leftovers add up to all."""

    def sums(rows: DataFrame, amount: str, name: str) -> DataFrame:
        return rows.groupBy("party").agg(F.count("*").alias(f"n_{name}"), F.sum(F.col(amount).cast(MONEY)).alias(name))

    parts = [sums(claims, "amount", "claimed"), sums(payments, "amount", "paid"), sums(found, "claimed", "matched_claims"), sums(found, "paid", "matched_payments")]
    joined = reduce(lambda a, b: a.join(b, "party", "full"), parts)
    zero = F.lit(0).cast(MONEY)
    joined = joined.withColumns({c: F.coalesce(c, F.lit(0) if c.startswith("n_") else zero) for c in joined.columns if c != "party"})
    return joined.select(
        "party", "n_claimed", "n_paid", F.col("n_matched_claims").alias("n_matched"), "claimed", "paid", (F.col("matched_claims") - F.col("matched_payments")).alias("difference"),
        (F.col("claimed") - F.col("matched_claims")).alias("unpaid"), (F.col("paid") - F.col("matched_payments")).alias("unclaimed"),
    )


def balances(entries: DataFrame) -> DataFrame:
    """entries (party, at, kind, id, amount) with the party's `balance` after each, by time, kind and id: claims raise it, payments lower it."""
    signed = F.when(F.col("kind") == "claim", F.col("amount").cast(MONEY)).otherwise(-F.col("amount").cast(MONEY))
    return running(entries, ["party"], ["at", "kind", "id"], balance=signed)
