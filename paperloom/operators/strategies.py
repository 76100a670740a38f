"""What continues and what starts a document of a known type: a registry of rules over facts of a page and the one before.

As in the page chain, texts are reduced to facts before the window.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONTH_DATE = r"(January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s+\d{4}"


def _any(s: Column, *words: str) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(s, F.lit(w)) for w in words))


def _first(s: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(s, "(?d)" + pattern, 1), F.lit(""))


def facts(text: Column) -> Column:
    """struct of what the strategies ask of a page's text; null is empty."""
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    head, l500, l1000 = F.substring(t, 1, 1000), F.substring(low, 1, 500), F.substring(low, 1, 1000)
    quoted = F.filter(F.slice(F.split(head, "\n"), 1, 10), lambda x: F.startswith(F.ltrim(x), F.lit(">")))
    mail = head.rlike(r"(?id)From:\s*[^\n]+@[^\n]+\nTo:\s*[^\n]+\n(?:Subject:|Date:|Sent:)")
    asked = {
        "quote_marks": _any(l500, ">", "from:", "sent:", "-----"), "mail": mail, "mostly_quoted": F.size(quoted) > F.least(F.size(F.split(head, "\n")), F.lit(10)) * 0.5,
        "invoice_no": _first(low, r"invoice\s*#?\s*[:]\s*(\w+)"), "goes_on": _any(low, "continued", "page 2"), "items": F.regexp_count(t, F.lit(r"(?d)\d+\s+.+\s+\$?\d+\.\d{2}")) > 3,
        "invoice_strong": _any(l1000, "invoice") & _any(l1000, "bill to", "invoice date", "invoice #"), "invoice_weak": _any(l1000, "invoice") & _any(l1000, "total", "amount due", "payment"),
        "rfi_no": _first(low, r"rfi\s*#?\s*[:]\s*(\d+)"), "response": _any(low, "response:"), "question": _any(low, "question:"),
        "rfi_strong": _any(l1000, "request for information") | (_any(l1000, "rfi") & _any(l1000, "#")), "rfi_weak": _any(l1000, "rfi") & _any(l1000, "project", "question", "response"),
        "sheet": _first(low, r"sheet\s*(\d+)\s*of\s*\d+").try_cast("bigint"), "title_block": _any(low, "drawing", "sheet", "scale", "project"), "n": F.char_length(t),
        "submittal_no": _first(low, r"submittal\s*#?\s*[:]\s*(\w+)"), "attached": _any(low, "attachment", "exhibit"),
        "submittal_strong": _any(l1000, "submittal") & _any(l1000, "approval", "review", "specification"), "submittal": _any(l1000, "submittal"),
        "page_of": _first(low, r"page\s*(\d+)\s*of\s*\d+").try_cast("bigint"), "marker": low.rlike(r"\A(?:continued|\.\.\.|\(continued\))"),
        "heading": _any(l500, "memorandum", "letter", "report", "notice"), "dated": F.substring(t, 1, 500).rlike(MONTH_DATE) & _any(F.substring(t, 1, 500), "Dear", "To:"),
    }
    return F.struct(*(c.alias(k) for k, c in asked.items()))


def _pick(tests: list[tuple[Column, tuple]], names: tuple[str, ...]) -> Column:
    made = lambda values: F.struct(*(F.lit(v).alias(k) for k, v in zip(names, values, strict=True)))
    out = made(tests[-1][1])
    for test, values in reversed(tests[:-1]):
        out = F.when(F.coalesce(test, F.lit(False)), made(values)).otherwise(out)
    return out


def _goes_on(tests: list[tuple[Column, tuple]]) -> Column:
    return _pick(tests, ("continues", "confidence", "reason"))


def _starts(tests: list[tuple[Column, tuple]]) -> Column:
    return _pick(tests, ("is_start", "confidence"))


def _email(c: Column, p: Column) -> tuple[Column, Column]:
    on = _goes_on([(c["quote_marks"], (True, 0.5, "Heuristic: quote markers detected")), (None, (False, 0.5, "Heuristic: quote markers detected"))])
    return on, _starts([(c["mail"] & c["mostly_quoted"], (False, 0.8)), (c["mail"], (True, 0.9)), (None, (False, 0.1))])


def _invoice(c: Column, p: Column) -> tuple[Column, Column]:
    on = _goes_on([
        (c["invoice_no"] == p["invoice_no"], (True, 0.9, "Same invoice number")), (c["goes_on"], (True, 0.8, "Continuation indicator found")),
        (c["items"] & p["items"], (True, 0.7, "Continuing line items")), (None, (False, 0.3, "No continuation indicators")),
    ])
    return on, _starts([(c["invoice_strong"], (True, 0.95)), (c["invoice_weak"], (True, 0.7)), (None, (False, 0.1))])


def _rfi(c: Column, p: Column) -> tuple[Column, Column]:
    on = _goes_on([
        (c["rfi_no"] == p["rfi_no"], (True, 0.95, "Same RFI number")), (p["response"] & ~c["question"], (True, 0.8, "Continuing RFI response")),
        (None, (False, 0.3, "No RFI continuation indicators")),
    ])
    return on, _starts([(c["rfi_strong"], (True, 0.9)), (c["rfi_weak"], (True, 0.7)), (None, (False, 0.1))])


def _drawing(c: Column, p: Column) -> tuple[Column, Column]:
    on = _goes_on([
        ((c["n"] < 100) & (p["n"] < 100) & c["has_images"] & p["has_images"], (True, 0.7, "Sequential drawing pages")),
        (c["sheet"] == p["sheet"] + 1, (True, 0.95, "Sequential sheet numbers")), (None, (False, 0.3, "No drawing set indicators")),
    ])
    bare = c["has_images"] & (c["n"] < 200)
    return on, _starts([(bare & c["title_block"], (True, 0.8)), (bare & c["has_many_drawings"], (True, 0.7)), (None, (False, 0.1))])


def _submittal(c: Column, p: Column) -> tuple[Column, Column]:
    on = _goes_on([
        (c["submittal_no"] == p["submittal_no"], (True, 0.9, "Same submittal number")), (p["attached"], (True, 0.7, "Likely submittal attachment")),
        (None, (False, 0.3, "No submittal continuation")),
    ])
    return on, _starts([(c["submittal_strong"], (True, 0.9)), (c["submittal"], (True, 0.7)), (None, (False, 0.1))])


def _other(c: Column, p: Column) -> tuple[Column, Column]:
    on = _goes_on([
        (c["page_of"] == p["page_of"] + 1, (True, 0.8, "Sequential page numbers")), (c["marker"], (True, 0.7, "Continuation marker")),
        (None, (False, 0.3, "No clear continuation")),
    ])
    return on, _starts([(c["heading"], (True, 0.6)), (c["dated"], (True, 0.7)), (None, (False, 0.2))])


#: Rules by type: (facts, facts of the page before) to (continues, starts); add entries to extend. Other types take "default".
STRATEGIES: dict[str, Callable[[Column, Column], tuple[Column, Column]]] = {"email": _email, "invoice": _invoice, "rfi": _rfi, "drawing": _drawing, "submittal": _submittal, "default": _other}


def judge(pages: DataFrame, kind: str = "type") -> DataFrame:
    """(pdf_id, page_num, kind, goes_on, starts) of each page by the strategy of its type; a first page continues nothing by itself.

    Optional boolean columns has_images and has_many_drawings count as false where they are missing or null.
    """
    flag = lambda name: (F.coalesce(name, F.lit(False)) if name in pages.columns else F.lit(False)).alias(name)
    seen = pages.select("pdf_id", "page_num", F.lower(F.coalesce(kind, F.lit("default"))).alias("kind"), facts(F.col("text")).alias("f"), flag("has_images"), flag("has_many_drawings"))
    seen = seen.select("pdf_id", "page_num", "kind", F.col("f").withField("has_images", F.col("has_images")).withField("has_many_drawings", F.col("has_many_drawings")).alias("c"))
    seen = seen.withColumn("p", F.lag("c").over(Window.partitionBy("pdf_id").orderBy("page_num")))
    on, starts = STRATEGIES["default"](F.col("c"), F.col("p"))
    for name, rule in STRATEGIES.items():
        if name != "default":
            a, b = rule(F.col("c"), F.col("p"))
            on, starts = F.when(F.col("kind") == name, a).otherwise(on), F.when(F.col("kind") == name, b).otherwise(starts)
    return seen.select("pdf_id", "page_num", "kind", on.alias("goes_on"), starts.alias("starts"))


def fragment_joins(ranges: DataFrame, judged: DataFrame, sure: float = 0.7) -> DataFrame:
    """ranges with joins_next: the page after the range continues it with more than `sure` confidence; feed to merge_pairs."""
    first = judged.select("pdf_id", F.col("page_num").alias("next_page"), (F.col("goes_on.continues") & (F.col("goes_on.confidence") > sure)).alias("joins_next"))
    return ranges.withColumn("next_page", F.col("end_page") + 1).join(first, ["pdf_id", "next_page"], "left").drop("next_page").withColumn("joins_next", F.coalesce("joins_next", F.lit(False)))
