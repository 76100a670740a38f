"""Mixing sources to target weights by repetition rates and hash-seeded Bernoulli copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import col, kept, ordered, spare

WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the document's id and the seed alone."""
    head = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 8)
    return F.conv(head, 16, 10).cast("long") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3) -> DataFrame:
    """(source, source_size, target, rate) from per-document (source, size).

    Sources in code-point order, null last, take the weights in turn and share the total of all sizes.
    A target stops at cap times its source's size; what is above is shared by weight among the others until
    none is above. Each round fixes all sources that the present share would lift above their cap, so the
    rounds are at most the number of sources, and a few in practice; only sums over sources reach the driver.
    A source of size 0 gets target 0 and rate 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("last__", F.col("source").isNull().cast("int"))
    per = ordered(per, ["last__", "source"], "mix-sources")
    turn = F.array(*(F.lit(float(w)) for w in weights))
    per = per.select("source", "source_size", F.element_at(turn, (F.col("rank") % len(weights) + 1).cast("int")).alias("weight"))
    per = kept(per, "mix-weights")
    limit = cap * F.col("source_size")
    total = float(per.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    share = 0.0
    while True:  # the share rises in each round, and with it the sources at their cap, or it is final
        full = F.lit(share) * F.col("weight") >= limit
        row = per.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)).cast("double").alias("fixed"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).cast("double").alias("open"),
        ).first()
        following = (total - row.fixed) / row.open if row.open else share
        if following <= share:
            break
        share = following
    target = F.least(F.lit(share) * F.col("weight"), limit).cast("double")
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    return per.select("source", "source_size", target.alias("target"), F.least(rate, F.lit(float(cap))).alias("rate"))


def with_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, prefix: str = "mix_", **shares) -> DataFrame:
    """docs with size, source_size, target, rate and copies, each with the prefix; a clash with docs's columns is an error.

    Copies: floor(rate), and one more where the draw lies below the rate's fraction. Rows with equal ids draw
    alike; a null id draws as the word null. Null texts have size 0, a null source is one of its own.
    """
    made = [prefix + c for c in ("size", "source_size", "target", "rate", "copies")]
    if clash := {c.lower() for c in docs.columns} & {c.lower() for c in made}:
        raise ValueError(f"columns of the table have names of results, choose another prefix: {sorted(clash)}")
    size, source_size, target, rate, copies = made
    sized = docs.withColumn(size, size_of(col(text)))
    targets = source_targets(sized.select(col(source).alias("source"), col(size).alias("size")), **shares)
    own = spare("source", docs)
    targets = targets.select(F.col("source").alias(own), F.col("source_size").alias(source_size), F.col("target").alias(target), F.col("rate").alias(rate))
    # a row for each source: Spark broadcasts it below the session's threshold, else splits the hot source
    joined = sized.join(targets, col(source).eqNullSafe(col(own)), "left").drop(own)
    whole = F.floor(col(rate))
    extra = (draw(col(doc_id), seed) < col(rate) - whole).cast("long")
    return joined.withColumn(copies, whole + extra)


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as its copies say; columns as before, whatever their names."""
    prefix = "mix_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    copies = F.array_repeat(F.lit(1), col(prefix + "copies").cast("int"))
    repeated = with_copies(docs, prefix=prefix, **options).withColumn(prefix + "copy", F.explode(copies))
    return repeated.select(*map(col, docs.columns))
