"""Page starts that depend on the page before: an ordered chain of continuation and start rules.

Each page is reduced to a few facts first. Only the facts pass through the window, so page texts are never shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quality import let, strip
from ..functions.signs import has_any, with_low
from . import segment

# Patterns that mark the first page of a document.
EMAIL_SIGNS = (
    r"From:\s*.*@", r"To:\s*.*@", r"Sent:\s*\w+,\s*\w+\s*\d+", r"From\s*:\s*[^\n]*@[^\n]*", r"To\s*:\s*[^\n]*@[^\n]*", r"CC\s*:\s*[^\n]*@[^\n]*", r"Subject\s*:", r"Sent\s*:\s*\w+",
    r"^(RE|FW|Fwd)\s*:", r"^(Reply|Forward)\s*:", r"(Mon|Tue|Wed|Thu|Fri|Sat|Sun|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday),?\s+\w+\s+\d{1,2},?\s+\d{4}",
    r"\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2}\s*(AM|PM)", r"[\w\s]+@[\w\.]+\.(com|org|net|edu)", r"_{5,}", r"-{5,}",
)
BASIC_SIGNS = (
    r"@\w+\.(com|org|net|edu)", r"\d{1,2}/\d{1,2}/\d{4}", r"#\s*\d+", r"To\s*:", r"From\s*:", r"Date\s*:", r"Subject\s*:", r"Project\s*:", r"Invoice", r"Page\s*\d+", r"Transmittal",
)
OPENINGS = (
    r"From\s*:", r"To\s*:", r"Subject\s*:", r"Date\s*:", r"\w+\s*:", r"Page\s*1", r"\d+\.\s*", r"[A-Z][A-Z\s]+:", r"INVOICE", r"REQUEST", r"TRANSMITTAL", r"APPLICATION", r"SUBMITTAL",
    r"COST\s*PROPOSAL",
)
START_PATTERNS = (
    r"^From:\s*.*@", r"^To:\s*.*@", r"^Sent:\s*\w+,\s*\w+\s*\d+", r"^Subject:\s*", r"^Date:\s*\w+,\s*\w+\s*\d+", r"^(RE:|FW:|Fwd:)\s*", r"From\s*:\s*[^\n]*", r"To\s*:\s*[^\n]*",
    r"Subject\s*:\s*[^\n]*", r"Sent\s*:\s*[^\n]*", r"Date\s*:\s*[^\n]*", r"^\s*SUBMITTAL\s*TRANSMITTAL", r"^SUBMITTAL\s*$", r"^TRANSMITTAL\s*$", r"SHOP\s+DRAWING.*SUBMITTAL",
    r"Reference\s*Number:\s*\d+", r"Submittal\s*#?\s*\d+", r"Transmitted\s*To\s*:", r"Transmitted\s*By\s*:", r"APPLICATION\s+AND\s+CERTIFICATE\s+FOR\s+PAYMENT", r"SCHEDULE\s+OF\s+VALUES",
    r"CONTINUATION\s+SHEET", r"AIA\s+Document\s+G70[0-9]", r"^\s*PACKING\s+SLIP", r"^\s*SALES\s+ORDER", r"^\s*SHIPPING", r"Ship\s+To:", r"Sold\s+To:", r"Bill\s+To:", r"Order\s*#?\s*\d+",
    r"Sales\s+Order\s+Packing\s+Slip", r"REQUEST\s+FOR\s+INFORMATION", r"^\s*RFI\s*#?\s*\d+", r"Request\s*#:\s*\d+", r"^\s*COST\s+PROPOSAL", r"^\s*PROPOSAL\s*#?\s*\d+",
    r"Quote\s+valid\s+for", r"CHANGE\s+ORDER\s*#?\s*\d+", r"^C\.O\.\s*#?\s*\d+", r"PCO\s*#?\s*\d+", r"SCALE:\s*\d+", r"SHEET\s+\d+\s+OF\s+\d+", r"^INVOICE\s*$", r"Invoice\s*#?\s*\d+",
    r"^(MEMORANDUM|MEMO)\s*$", r"\ADear\s+", r"DAILY\s+REPORT", r"FIELD\s+REPORT", r"NOTICE\s+TO\s+PROCEED", r"PUNCH\s+LIST", r"CERTIFICATE\s+OF\s+SUBSTANTIAL\s+COMPLETION",
    r"LIEN\s+WAIVER", r"PAY\s+APPLICATION", r"DSA\s+APPROVAL", r"DSA\s+PROJECT", r"DIVISION\s+OF\s+THE\s+STATE\s+ARCHITECT",
)
FORM_SIGNS = (
    r"Date:\s*_{5,}", r"Project\s*#:\s*", r"Transmitted\s+To:", r"Attention:", r"Project\s+Name:", r"Contract\s+No\.?:", r"P\.?O\.?\s+Box", r"Federal\s+Tax\s+ID",
)
VENDORS = (("MICROMETL", "MicroMetl"), ("GEARY PACIFIC", "Geary Pacific"))
ORDER_NUMBERS = (r"Order\s*#?\s*:?\s*(\d+)", r"Invoice\s*#?\s*:?\s*(\d+)", r"P\.?O\.?\s*#?\s*:?\s*(\d+)", r"Sales\s*Order\s*#?\s*:?\s*(\d+)")
EMAIL_HEADER = r"^From:\s*[^\n]+\s+To:\s*[^\n]+\s+(Subject:|Sent:)"
QUOTED_MAIL = r"Original Message|Forwarded by|wrote:|On\s+\d+/\d+/\d+"
INVOICE_LIKE = r"INVOICE|APPLICATION.*PAYMENT|PAYMENT\s+APPLICATION"
PAYMENT_LIKE = r"APPLICATION.*PAYMENT|SCHEDULE\s+OF\s+VALUES"
SHEET = r"(SHEET|DWG|DRAWING)\s*\d+"
SECTION = r"STRUCTURAL\s+ENGINEERING|HVAC\s+DUCT|SEISMIC\s+BRACING|SHEET\s+\d+"
RUNNING_LINE = r"\A(Page\s+\d+|.*Project.*|\d{1,2}/\d{1,2}/\d{4})\Z"


def _has(s: Column, *patterns: str, low: Column | None = None) -> Column:
    return has_any(s, patterns, "imd", low)


def _group(s: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without one or if it is empty."""
    return F.nullif(F.regexp_extract(s, "(?id)" + pattern, group), F.lit(""))


def clean_subject(text: Column) -> Column:
    """The subject line without one reply or forward prefix; null without a subject."""
    return strip(F.regexp_replace(strip(_group(text, r"Subject:\s*(.+)")), r"(?i)^(RE:|FW:|FWD:)\s*", ""))


def vendor(text: Column) -> Column:
    """A known vendor named anywhere, else what follows a vendor label in the first 500 characters."""
    out = strip(_group(F.substring(text, 1, 500), r"(From|Vendor|Supplier):\s*([^\n]+)", 2))
    for word, name in reversed(VENDORS):
        out = F.when(F.contains(F.upper(text), F.lit(word)), F.lit(name)).otherwise(out)
    return out


def order_number(text: Column) -> Column:
    """The number of the first order pattern with a match in the first 1000 characters."""
    return F.coalesce(*(_group(F.substring(text, 1, 1000), p) for p in ORDER_NUMBERS))


def form_start(text: Column) -> Column:
    """Two or more form fields in the first 1000 characters."""
    return with_low(F.substring(text, 1, 1000), _form_start)


def _form_start(head: Column, low: Column) -> Column:
    return reduce(lambda a, b: a + b, (_has(head, p, low=low).cast("int") for p in FORM_SIGNS)) >= 2


def opens(text: Column) -> Column:
    """Whether a text begins as documents do: a field, a title word, a numbered item or page 1."""
    return strip(text).rlike(r"(?id)\A(?:" + "|".join(OPENINGS) + ")")


def base_start(text: Column, page_num: Column, min_chars: int = 20) -> Column:
    """Whether a page by itself starts a document: all sign lists, page kinds, title lines and form fields."""
    t = F.coalesce(text, F.lit(""))
    return with_low(F.substring(t, 1, 1500), lambda head, low: _base_start(t, page_num, min_chars, head, low))


def _base_start(t: Column, page_num: Column, min_chars: int, head: Column, low: Column) -> Column:
    # a page with a sign starts a document whichever it is, so the cheap rules come first
    rules = [
        _has(F.substring(t, 1, 400), *BASIC_SIGNS, low=low) & ((page_num == 0) | opens(t)), segment._page_start(t, page_num, 0, head, low), _has(head, *START_PATTERNS, low=low),
        _has(F.substring(t, 1, 800), *EMAIL_SIGNS, low=low), head.rlike(segment.DRAWING_NUMBER), _form_start(F.substring(t, 1, 1000), low),
    ]
    return (F.char_length(strip(t)) >= min_chars) & reduce(lambda a, b: a | b, rules)


def facts(text: Column, page_num: Column, min_chars: int = 20) -> Column:
    """struct of all that the chain asks of a page."""
    t = F.coalesce(text, F.lit(""))
    one = F.struct(t.alias("t"), F.substring(t, 1, 1500).alias("head"), F.lower(F.substring(t, 1, 1500)).alias("low"))
    return let(one, lambda x: _facts(x["t"], page_num, min_chars, x["head"], x["low"]))


def _facts(t: Column, page_num: Column, min_chars: int, head: Column, low: Column) -> Column:
    h200, h500, h1000 = (F.substring(t, 1, n) for n in (200, 500, 1000))
    at_from = F.instr(F.lower(t), "from:")
    asked = {
        "n": F.char_length(t), "quoted": F.regexp_count(t, F.lit(r"(?md)^>+\s*")) > F.size(F.split(t, "\n")) * 0.3, "subject": clean_subject(t),
        "mail": _has(t, "From:|To:|Subject:"), "header": _has(h1000, EMAIL_HEADER, low=low) & (at_from <= 51) & ~_has(h500, QUOTED_MAIL, low=low),
        "slip": F.contains(F.upper(t), F.lit("PACKING SLIP")), "slip_head": F.contains(F.upper(h200), F.lit("PACKING SLIP")), "vendor": vendor(t), "order": order_number(t),
        "drawing": _has(h500, SHEET, low=low), "sheet": _group(h500, r"SHEET\s*(\d+)").try_cast("bigint"), "section": _has(h500, SECTION, low=low),
        "rfi": _group(h500, r"RFI[:\s#-]*(\d+)"), "rfi_head": _has(h1000, r"REQUEST\s+FOR\s+INFORMATION.*RFI[:\s#-]*\d+", low=low),
        "submittal": _has(h500, "SUBMITTAL", low=low), "submittal_no": _group(h500, r"SUBMITTAL.*?(\d+)"), "submittal_head": _has(h500, r"SUBMITTAL\s*(TRANSMITTAL|#|NUMBER)?[:\s]*\d+", low=low), "shop": _has(h500, r"SHOP\s+DRAWING.*SUBMITTAL", low=low),
        "payment": _has(h500, PAYMENT_LIKE, low=low), "g703": _has(h500, r"Document\s+G703.*Continuation\s+Sheet", low=low), "values": _has(h500, r"SCHEDULE\s+OF\s+VALUES", low=low), "more": _has(h500, r"Application\s+No|Period\s+To|ITEM\s+SCHEDULED", low=low),
        "invoice": _has(h500, INVOICE_LIKE, low=low), "invoice_no": _group(h500, r"Invoice\s*#?\s*:?\s*(\d+)"), "cost": _has(h500, r"COST\s+PROPOSAL\s*#?\s*\d+", low=low),
        "running": (F.char_length(strip(t)) < 100) & strip(t).rlike("(?id)" + RUNNING_LINE), "base": _base_start(t, page_num, min_chars, head, low),
    }
    return F.struct(*(c.alias(k) for k, c in asked.items()))


def chain(c: Column, p: Column) -> Column:
    """The verdict on a page with facts c after one with facts p (null: an empty page)."""
    yes = lambda x: F.coalesce(x, F.lit(False))
    some = yes(p["n"] > 0)
    same = lambda k: yes(c[k] == p[k])
    other = lambda k: yes(c[k] != p[k])
    had = lambda k: yes(p[k])
    next_sheet = yes(c["sheet"] == p["sheet"] + 1)
    mail_goes_on = c["quoted"] | same("subject")
    slip_goes_on = had("slip") & c["slip_head"] & same("vendor") & same("order")
    drawing_goes_on = had("drawing") & c["drawing"] & next_sheet
    lost_subject = some & p["subject"].isNotNull() & c["subject"].isNull()
    new_mail = c["header"] & ~(some & (c["n"] < 300) & had("mail")) & ~lost_subject
    submittal_goes_on = had("submittal") & (c["shop"] | (c["submittal"] & same("submittal_no")))
    payment_goes_on = some & (c["g703"] | (had("payment") & (c["values"] | c["more"])))
    new_invoice = some & c["invoice"] & (other("invoice_no") | ~had("invoice"))
    new_slip = c["slip_head"] & (~some | other("vendor") | other("order") | ~had("slip"))
    new_section = some & c["section"] & (~had("drawing") | yes(c["sheet"] != p["sheet"] + 1))
    verdicts = [
        (mail_goes_on | slip_goes_on | drawing_goes_on, False), (new_mail, True), (c["rfi_head"] & ~same("rfi"), True), (c["submittal_head"] & ~submittal_goes_on, True),
        (payment_goes_on, False), (new_invoice | new_slip | c["cost"] | new_section | c["values"], True),
    ]
    out = c["base"] & ~c["running"]
    for test, verdict in reversed(verdicts):
        out = F.when(yes(test), F.lit(verdict)).otherwise(out)
    return out


def page_starts(pages: DataFrame, min_chars: int = 20) -> DataFrame:
    """(pdf_id, page_num, is_start) by the chain. Page 0 always starts; page 1 is judged as if after an empty page."""
    seen = pages.select("pdf_id", "page_num", facts(F.col("text"), F.col("page_num"), min_chars).alias("c"))
    before = F.lag("c").over(Window.partitionBy("pdf_id").orderBy("page_num"))
    seen = seen.withColumn("p", F.when(F.col("page_num") > 1, before))
    return seen.select("pdf_id", "page_num", ((F.col("page_num") == 0) | chain(F.col("c"), F.col("p"))).alias("is_start"))
