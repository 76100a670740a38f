"""Deterministic business documents and page packets, rendered from the star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("invoice", "rfi", "change_order", "email", "letter", "daily_report")


def exact_sum(value: str) -> str:
    """SQL of a sum of doubles that does not depend on their order, as functions.sums adds them."""
    return f"round(sum(({value})::DECIMAL(38, 15)), 12)::DOUBLE"


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as the session has cores, where its files have fewer splits; else as it is."""
    most = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(most) if df.rdd.getNumPartitions() < most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text() -> Column:
    k, name = F.col("o_orderkey").cast("string"), F.col("c_name")
    us, iso = F.date_format("o_orderdate", "MM/dd/yyyy"), F.date_format("o_orderdate", "yyyy-MM-dd")
    money = F.concat(F.lit("$"), F.format_number("o_totalprice", 2))
    bodies = [
        F.concat(F.lit("INVOICE #"), k, F.lit("\nBill To: "), name, F.lit("\nDate: "), us, F.lit("\nTotal: "), money, F.lit("\nPayment and amount due in 30 days.")),
        F.concat(F.lit("REQUEST FOR INFORMATION\nRFI #"), k, F.lit("\nProject Number: P-"), k, F.lit("\nPlease provide clarification of the specification.\nSubmitted: "), us),
        F.concat(F.lit("CHANGE ORDER #"), k, F.lit("\nContract No. C-"), k, F.lit("\nExtra work and time extension: "), money, F.lit("\nEffective date "), iso, F.lit("\nApproved by: "), name),
        F.concat(F.lit("From: user"), k, F.lit("@example.com\nTo: office@example.org\nSubject: Delay notice "), k, F.lit("\nSent: "), us, F.lit("\nRegards, "), name),
        F.concat(F.lit("Dear "), name, F.lit(",\nRE: Substantial completion of lot "), k, F.lit("\nThe warranty starts as of "), iso, F.lit(".\nSincerely")),
        F.concat(F.lit("DAILY REPORT\nDate: "), us, F.lit("\nWeather conditions: fair. Crew size 5. Progress on item "), k, F.lit("\nSafety: no violation.")),
    ]
    kind = F.col("o_orderkey") % len(KINDS)
    out = bodies[-1]
    for i in range(len(bodies) - 1):
        out = F.when(kind == i, bodies[i]).otherwise(out)
    return out


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pdf_id, type, party, created, amount, text: a document for each order."""
    # a row is short but its text costs much: as many partitions as there are, which few bytes would otherwise be merged to few
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    orders, customer = table(spark, sf_dir, "orders").repartition(parts, "o_custkey"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("o_orderkey") % len(KINDS) + 1).cast("int"))
    return joined.select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 500).alias("pdf_id"), kind.alias("type"), F.col("c_name").alias("party"), F.to_date("o_orderdate").alias("created"), F.col("o_totalprice").alias("amount"), _text().alias("text"))


RENDERED_SQL = """rendered AS (
  SELECT o_orderkey AS doc_id, o_custkey % 500 AS pdf_id, ['invoice', 'rfi', 'change_order', 'email', 'letter', 'daily_report'][o_orderkey % 6 + 1] AS type,
    c_name AS party, o_orderdate::DATE AS created, o_totalprice AS amount,
    replace(CASE o_orderkey % 6
      WHEN 0 THEN 'INVOICE #' || o_orderkey || '~Bill To: ' || c_name || '~Date: ' || strftime(o_orderdate, '%m/%d/%Y') || '~Total: $' || format('{:,.2f}', o_totalprice) || '~Payment and amount due in 30 days.'
      WHEN 1 THEN 'REQUEST FOR INFORMATION~RFI #' || o_orderkey || '~Project Number: P-' || o_orderkey || '~Please provide clarification of the specification.~Submitted: ' || strftime(o_orderdate, '%m/%d/%Y')
      WHEN 2 THEN 'CHANGE ORDER #' || o_orderkey || '~Contract No. C-' || o_orderkey || '~Extra work and time extension: $' || format('{:,.2f}', o_totalprice) || '~Effective date ' || strftime(o_orderdate, '%Y-%m-%d') || '~Approved by: ' || c_name
      WHEN 3 THEN 'From: user' || o_orderkey || '@example.com~To: office@example.org~Subject: Delay notice ' || o_orderkey || '~Sent: ' || strftime(o_orderdate, '%m/%d/%Y') || '~Regards, ' || c_name
      WHEN 4 THEN 'Dear ' || c_name || ',~RE: Substantial completion of lot ' || o_orderkey || '~The warranty starts as of ' || strftime(o_orderdate, '%Y-%m-%d') || '.~Sincerely'
      ELSE 'DAILY REPORT~Date: ' || strftime(o_orderdate, '%m/%d/%Y') || '~Weather conditions: fair. Crew size 5. Progress on item ' || o_orderkey || '~Safety: no violation.' END, '~', chr(10)) AS text
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def packets(spark: SparkSession, sf_dir: str, **facts: Column) -> DataFrame:
    """pdf_id, page_num (0-based), doc_id, is_first, text: a packet of pages per pdf_id; continuation pages follow each document.

    facts: named columns of text, which then stand for it, so that texts do not pass through the shuffle and the window.
    """
    docs = rendered(spark, sf_dir)
    pages = docs.withColumn("part", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int"))))
    text = F.when(F.col("part") == 0, F.col("text")).otherwise(F.concat(F.lit("continued text of the body, part "), F.col("part").cast("string"), F.lit(" and nothing more to say here at all")))
    pages = pages.withColumn("text", text)
    if facts:
        pages = pages.select("pdf_id", "doc_id", "created", "part", *(c.alias(name) for name, c in facts.items()))
    from pyspark.sql import Window

    order = Window.partitionBy("pdf_id").orderBy("created", "doc_id", "part")
    # a row is short but costs its reader much: as many partitions as there are, which few bytes would otherwise be merged to few
    pages = pages.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "pdf_id")
    return pages.select("pdf_id", (F.row_number().over(order) - 1).alias("page_num"), "doc_id", (F.col("part") == 0).alias("is_first"), *(facts or ["text"]))


PACKETS_SQL = RENDERED_SQL + """, parts AS (SELECT *, unnest(range(0, doc_id % 3 + 1)) AS part FROM rendered),
packets AS (
  SELECT pdf_id, row_number() OVER (PARTITION BY pdf_id ORDER BY created, doc_id, part) - 1 AS page_num, doc_id, part = 0 AS is_first,
    CASE WHEN part = 0 THEN text ELSE 'continued text of the body, part ' || part || ' and nothing more to say here at all' END AS text FROM parts)"""
