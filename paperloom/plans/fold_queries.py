"""Queries of windows with carried context and of table functions over the test tables, and their SQL."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import functions as F

from ..operators import carried, table_functions
from .corpus import PACKETS_SQL, packets, rendered


def digest_model(prompts):
    """A model whose summary of a window depends on every character it was shown, what is carried included."""
    return ['{"boundaries": [], "window_summary": "' + md5(p.encode()).hexdigest() + '"}' for p in prompts]


def carried_windows(spark, sf_dir):
    """Windows of four pages, each read with the summary of the one before."""
    windows = carried.page_windows(packets(spark, sf_dir), 4, 1)
    return carried.carried(windows, digest_model).select("pdf_id", "step", "window_start", "window_end", "summary")


def lateral_amounts(spark, sf_dir):
    """Amounts by the table function, from SQL."""
    table_functions.register(spark)
    docs = rendered(spark, sf_dir).select("doc_id", "text").where(table_functions.possible(F.col("text"), "amount"))
    return spark.sql("SELECT doc_id, m.value AS amount FROM {docs}, LATERAL extract_patterns(text, 'amount') AS m", docs=docs)


def lateral_references(spark, sf_dir):
    table_functions.register(spark)
    docs = rendered(spark, sf_dir).select("doc_id", "text").where(table_functions.possible(F.col("text"), "reference contract"))
    return spark.sql("SELECT doc_id, m.value AS contract, m.start + 1 AS place FROM {docs}, LATERAL extract_patterns(text, 'reference contract') AS m", docs=docs)


def partitioned_runs(spark, sf_dir):
    """Documents of each PDF by a table function over its pages in order."""
    table_functions.register(spark)
    pages = packets(spark, sf_dir).select("pdf_id", F.col("page_num").cast("int").alias("page_num"), "is_first").withColumnRenamed("is_first", "is_start")
    return spark.sql("SELECT pdf_id, start_page, end_page FROM page_runs(TABLE(SELECT * FROM {pages}) PARTITION BY pdf_id ORDER BY page_num)", pages=pages)


QUERIES = {f.__name__: f for f in (carried_windows, lateral_amounts, lateral_references, partitioned_runs)}

_ASKED = "Which of these pages start a document? Reply as JSON with boundaries (page, confidence) and window_summary.~"
ORACLE_SQL = {
    "carried_windows": f"""WITH RECURSIVE {PACKETS_SQL}, n AS (SELECT pdf_id, max(page_num) + 1 AS n FROM packets GROUP BY 1), w AS (SELECT pdf_id, n, unnest(range(0, n, 3)) AS s FROM n),
b AS (
  SELECT w.pdf_id, (s // 3)::INT AS step, s::INT AS window_start, (least(s + 4, any_value(n)) - 1)::INT AS window_end, string_agg('Page ' || (page_num + 1) || ': ' || text[1:1000], chr(10) ORDER BY page_num) AS body
  FROM w JOIN packets p ON p.pdf_id = w.pdf_id AND page_num BETWEEN s AND s + 3 GROUP BY w.pdf_id, s),
r AS (
  SELECT b.*, md5(replace('{_ASKED}', '~', chr(10)) || body) AS summary FROM b WHERE step = 0
  UNION ALL SELECT b.*, md5(replace('{_ASKED}', '~', chr(10)) || 'Before these pages: ' || r.summary || chr(10) || b.body) FROM r JOIN b ON b.pdf_id = r.pdf_id AND b.step = r.step + 1)
SELECT pdf_id, step, window_start, window_end, summary FROM r""",
    "lateral_amounts": rf"""WITH {PACKETS_SQL}, a AS (SELECT doc_id, replace(unnest(regexp_extract_all(text, '\$\s*(\d{{1,3}}(?:,\d{{3}})*(?:\.\d{{2}})?)\b', 1)), ',', '')::DOUBLE AS amount FROM rendered) SELECT * FROM a WHERE amount > 0""",
    "lateral_references": rf"""WITH {PACKETS_SQL}, a AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '(?i)\bContract\s*(?:#|No\.?|Number)?\s*[A-Z0-9-]+\b')) AS found FROM rendered)
SELECT doc_id, regexp_extract(found, '(?i)Contract\s*(?:#|No\.?|Number)?\s*([A-Z0-9-]+)', 1) AS contract, (instr(text, found) + length(found) - length(regexp_extract(found, '(?i)Contract\s*(?:#|No\.?|Number)?\s*([A-Z0-9-]+)', 1)))::INT AS place FROM a""",
    "partitioned_runs": f"""WITH {PACKETS_SQL}, flags AS (SELECT *, sum(is_first::INT) OVER (PARTITION BY pdf_id ORDER BY page_num) AS seg FROM packets)
SELECT pdf_id, min(page_num)::INT AS start_page, max(page_num)::INT AS end_page FROM flags GROUP BY pdf_id, seg""",
}
