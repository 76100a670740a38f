"""Page starts from page facts and the state of an e-mail chain, and the merges of ranges that follow.

What a page does to the chain does not depend on the chain, so the state before a page is the last effect before it: a window,
no loop. Only facts pass through the windows, never page texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quality import let, strip
from ..functions.signs import has_any
from . import segment

# Signs of a new document with their labels, of a page that goes on, of quoted mail, weak signs and carriers.
START_SIGNS = (
    (r"^From:\s*[^@\n]+@[^>\n]+$", "new_email"), (r"^Sent:\s*(Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)", "new_email"), (r"^Subject:\s*(?!RE:|FW:|Fwd:)", "new_email"),
    (r"^\s*SUBMITTAL\s*TRANSMITTAL", "submittal"), (r"^\s*APPLICATION\s+AND\s+CERTIFICATE\s+FOR\s+PAYMENT", "payment"), (r"^\s*SCHEDULE\s+OF\s+VALUES", "sov"),
    (r"^\s*REQUEST\s+FOR\s+INFORMATION", "rfi"), (r"^\s*RFI\s*#?\s*\d+", "rfi"), (r"^\s*COST\s+PROPOSAL\s*#?\s*\d+", "cost_proposal"), (r"^\s*CHANGE\s+ORDER\s*#?\s*\d+", "change_order"),
    (r"^\s*PACKING\s+SLIP", "shipping"), (r"Page\s+1\s+of\s+\d+", "page_one"), (r"Sheet\s+1\s+of\s+\d+", "page_one"),
)
GOES_ON = (r"Page\s+[2-9]\d*\s+of\s+\d+", r"^\s*-\s*\d+\s*-\s*$", r"CONTINUATION\s+SHEET", r"Continued from", r"See attached", r"^\s*\d+\s*$")
QUOTES = (r"^>\s*From:", r"^>\s*To:", r"^>\s*Subject:", r"-----Original Message-----", r"On .+ wrote:", r"From:.*Sent:.*To:.*Subject:")
WEAK_SIGNS = (r"^\s*[A-Z\s]{15,}$", r"^(INVOICE|MEMORANDUM|NOTICE|CERTIFICATE)", r"^Dear\s+", r"^\d{1,2}/\d{1,2}/\d{4}$")
CARRIERS = ("MicroMetl", "Geary Pacific", "UPS", "FedEx")
ATTACHED = r"(?id)(See attached|Attached please find|Attachment)"
INSTANCES = {"COST_PROPOSAL": r"COST\s+PROPOSAL|Proposal\s*#?\s*\d+", "RFI": r"REQUEST\s+FOR\s+INFORMATION|RFI\s*#?\s*\d+"}


def _has(s: Column, patterns: tuple[str, ...], flags: str = "imd", low: Column | None = None) -> Column:
    return has_any(s, patterns, flags, low)


def _found(s: Column, pattern: str) -> Column:
    """The first group of the first match, stripped; null without a match or if nothing is left."""
    return F.nullif(strip(F.regexp_extract(s, "(?id)" + pattern, 1)), F.lit(""))


def facts(text: Column) -> Column:
    """struct of what the rules ask of a page: kind (the first that hits), strong (label of the first start sign), signs, mail fields, numbers.

    The struct is built inside one expression, so that no rule makes the optimizer copy its patterns.
    """
    return let(F.coalesce(text, F.lit("")), lambda t: let(F.struct(segment.first_kind(t).alias("kind"), F.lower(t).alias("low")), lambda x: _facts(t, x["kind"], x["low"])))


def _facts(t: Column, kind: Column, low: Column) -> Column:
    head = lambda n: F.substring(t, 1, n)
    subject = F.regexp_replace(_found(head(1000), r"Subject:\s*(.+?)(?:\n|$)"), r"(?i)^(RE:|FW:|Fwd:)\s*", "")
    head_low, carrier = F.lower(head(500)), F.lit(None).cast("string")
    for name in CARRIERS:
        carrier = F.when(F.contains(head_low, F.lit(name.lower())), F.lit(name)).otherwise(carrier)
    again = reduce(lambda a, b: a | b, ((kind == k) & _has(head(300), (p,), "id", low) for k, p in INSTANCES.items()))
    asked = {
        "blank": F.length(strip(t)) < 50, "kind": kind, "strong": F.coalesce(*(F.when(_has(head(1000), (p,), low=low), F.lit(k)) for p, k in START_SIGNS)),
        "goes_on": _has(t, GOES_ON, "id", low), "quoted": _has(t, QUOTES, low=low), "page_no": F.regexp_extract(t, r"(?id)Page\s+(\d+)\s+of\s+(\d+)", 1).try_cast("bigint"),
        "subject": F.lower(strip(subject)), "sent": F.coalesce(_found(head(500), r"Sent:\s*([^\n]+)"), _found(head(500), r"Date:\s*([^\n]+)")),
        "carrier": carrier, "order_no": _found(head(500), r"Order\s*#?\s*(\d+)"), "slip": _has(head(200), (r"^\s*PACKING\s+SLIP",), low=low), "again": F.coalesce(again, F.lit(False)),
        "weak": _has(head(200), WEAK_SIGNS, low=low), "sheet": _has(t, (r"CONTINUATION\s+SHEET",), "id", low), "attached": F.substring(t, -500, 500).rlike(ATTACHED),
    }
    return F.struct(*(v.alias(k) for k, v in asked.items()))


def page_starts(pages: DataFrame) -> DataFrame:
    """(pdf_id, page_num, is_start, chain, f): whether a page starts a document, whether an e-mail chain is open before it, and its facts.

    Pages of (pdf_id, page_num, text) are numbered from 0 without gaps. Page 0 is never marked; nearly blank pages never start
    one. A mail starts a thread unless a page with mail among the three before (page 0 left out) has the same subject and date
    or one of the two has no subject.
    """
    order = Window.partitionBy("pdf_id").orderBy("page_num")
    f, p, i = F.col("f"), F.col("p"), F.col("page_num")
    mail = F.coalesce(f["kind"] == "EMAIL", F.lit(False))
    staged = pages.select("pdf_id", "page_num", facts(F.col("text")).alias("f"))
    near = F.last(F.when(mail & (i > 0), F.struct(f["subject"].alias("subject"), f["sent"].alias("sent"))), ignorenulls=True).over(order.rowsBetween(-3, -1))
    staged = staged.withColumns({"p": F.lag("f").over(order), "near": near})
    near = F.col("near")
    other_mail = (f["subject"] != near["subject"]) | ~f["sent"].eqNullSafe(near["sent"])
    thread = F.coalesce(near.isNull() | (f["subject"].isNotNull() & near["subject"].isNotNull() & other_mail), F.lit(False))
    shipped = F.coalesce(f["carrier"] != p["carrier"], F.lit(False)) | F.coalesce(f["order_no"] != p["order_no"], F.lit(False)) | f["slip"]
    same = f["kind"] == p["kind"]
    keep, off = F.lit(None).cast("boolean"), F.lit(False)
    stay = F.when(mail, True)
    rules = [
        # (test, starts, what the chain is afterwards; null leaves it)
        (f["blank"], off, keep),
        (f["strong"] == "new_email", thread | F.col("no_chain"), F.lit(True)),
        (f["strong"].isNotNull(), F.lit(True), F.when(i == 0, mail).otherwise(off)),
        (i == 0, off, stay),
        (p["goes_on"], off, stay),
        (f["page_no"] == 1, F.lit(True), off),
        (same & (f["kind"] == "SHIPPING"), shipped, F.when(~shipped, stay)),
        (same & f["kind"].isin("PAYMENT", "DRAWING"), off, stay),
        (same & mail, thread, F.lit(True)),
        (same, f["again"], F.when(~f["again"], stay)),
        (f["kind"].isNotNull() & p["kind"].isNotNull(), F.lit(True), mail),
        ((i > 1) & p["blank"], F.lit(True), off),
        (f["weak"], F.lit(True), off),
    ]
    starts, effect = off, stay
    for test, start, after in reversed(rules):
        starts, effect = F.when(test, start).otherwise(starts), F.when(test, after).otherwise(effect)
    before = F.coalesce(F.last(F.col("effect"), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), off)
    staged = staged.withColumn("effect", effect).withColumn("chain", before).withColumn("no_chain", ~F.col("chain"))
    return staged.select("pdf_id", "page_num", ((i > 0) & starts).alias("is_start"), "chain", "f")


def join_sheets(ranges: DataFrame) -> DataFrame:
    """Ranges of (pdf_id, start_page, end_page, sheet, attached) after both merges.

    A one-page range that is a continuation sheet joins the range before. One whose end announces an attachment takes in its
    next, which then takes nothing itself: of a run of such ranges every other one does.
    """
    order = Window.partitionBy("pdf_id").orderBy("start_page")
    sheet = F.coalesce("sheet", F.lit(False)) & (F.col("start_page") == F.col("end_page")) & (F.col("n") > 1)
    takes = F.coalesce("attached", F.lit(False)) & ~F.col("joins") & F.lead("start_page").over(order).isNotNull()
    staged = ranges.withColumn("n", F.row_number().over(order)).withColumn("joins", sheet).withColumn("takes", takes)
    # rows since the last one that takes nothing
    idle = F.coalesce(F.max(F.when(~F.col("takes"), F.col("n"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    head = F.col("takes") & ((F.col("n") - F.col("idle")) % 2 == 1)
    staged = staged.withColumn("idle", idle).withColumn("head", head)
    new = ~(F.coalesce(F.lag("head").over(order), F.lit(False)) | F.col("joins"))
    staged = staged.withColumn("new", new.cast("int")).withColumn("seg", F.sum("new").over(order))
    return staged.groupBy("pdf_id", "seg").agg(F.min("start_page").alias("start_page"), F.max("end_page").alias("end_page")).drop("seg")


def ranges(pages: DataFrame) -> DataFrame:
    """(pdf_id, start_page, end_page) of the documents of each PDF."""
    order = Window.partitionBy("pdf_id").orderBy("page_num")
    flags = page_starts(pages).select("pdf_id", "page_num", "is_start", F.col("f.sheet").alias("sheet"), F.col("f.attached").alias("attached"))
    seg = flags.withColumn("seg", F.sum((F.col("is_start") | (F.col("page_num") == 0)).cast("int")).over(order))
    found = seg.groupBy("pdf_id", "seg").agg(
        F.min("page_num").alias("start_page"), F.max("page_num").alias("end_page"), F.min_by("sheet", "page_num").alias("sheet"), F.max_by("attached", "page_num").alias("attached")
    )
    return join_sheets(found)
