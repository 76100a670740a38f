"""Metadata extraction: dates, references, amounts, e-mail parties, keywords, project, subject, date of a document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quality import let

# The patterns that decide what counts as a date, reference or amount, number words, roles, date signs and keywords.
US_DATE = r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{4})\b"
ISO_DATE = r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
TEXT_DATE = rf"(?i)\b({MONTHS})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b"
EURO_DATE = rf"(?i)\b(\d{{1,2}})\s+({MONTHS})\.?\s+(\d{{4}})\b"
REFERENCES = {
    "RFI": r"(?i)\bRFI\s*#?\s*(\d+)\b",
    "Change Order": r"(?i)\b(?:Change\s+Order|CO)\s*#?\s*(\d+)\b",
    "Invoice": r"(?i)\bInvoice\s*#?\s*(\d+)\b",
    "Project": r"(?i)\bProject\s*(?:#|No\.?|Number):\s*([A-Z0-9-]+)\b",
    "Contract": r"(?i)\bContract\s*(?:#|No\.?|Number)?\s*([A-Z0-9-]+)\b",
    "Submittal": r"(?i)\bSubmittal\s*#?\s*(\d+)\b",
    "Payment Application": r"(?i)\b(?:Payment\s+Application|Pay\s+App)\s*#?\s*(\d+)\b",
    "ASI": r"(?i)\bASI\s*#?\s*(\d+)\b",
    "RFP": r"(?i)\bRFP\s*#?\s*(\d+)\b",
    "PCO": r"(?i)\bPCO\s*#?\s*(\d+)\b",
}
DOLLARS = r"\$\s*(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)\b"
USD = r"(?i)\bUSD\s*(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)\b"
NUMBER_WORDS = (
    "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
    "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion", "and",
)
EMAIL = r"\b([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})\b"
ROLES = ("Contractor", "Owner", "Architect", "Engineer", "Subcontractor")
DATE_SIGNS = ("date:", "dated:", "date of", "as of", "effective date", "issued:", "prepared:", "submitted:")
KEYWORDS = (
    "delay", "impact", "change", "extra work", "differing conditions", "acceleration", "disruption", "inefficiency", "overtime", "premium time",
    "notice", "backcharge", "liquidated damages", "substantial completion", "final completion", "punch list", "warranty", "defect", "nonconforming",
    "rejection", "approval", "submittal", "RFI", "change order", "time extension", "force majeure", "weather", "unforeseen", "concealed conditions",
    "design error", "coordination", "sequence", "milestone", "critical path", "float", "schedule", "baseline", "as-built", "shop drawings", "samples",
    "product data", "safety", "OSHA", "violation", "stop work", "suspension",
)


#: For each reference family, words of which a text with such a reference holds one, in lower case.
SIGNS = {
    "RFI": ("rfi",), "Change Order": ("change", "co"), "Invoice": ("invoice",), "Project": ("project",), "Contract": ("contract",), "Submittal": ("submittal",), "Payment Application": ("pay",),
    "ASI": ("asi",), "RFP": ("rfp",), "PCO": ("pco",),
}
_MONTH_SIGNS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _holds(low: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))


def _all(text: Column, pattern: str, group: int, low: Column | None = None, signs: tuple[str, ...] = ()) -> Column:
    """All matches; given the text in lower case, only texts with one of the signs are searched."""
    found = F.regexp_extract_all(text, F.lit(pattern), group)
    return found if low is None else F.when(_holds(low, signs), found).otherwise(F.array().cast("array<string>"))


def _dates(found: Column, year: int, month: int, day: int, named: bool = False) -> Column:
    """Dates of matches, which hold year, month and day between signs."""

    def one(parts: Column) -> Column:
        m = F.initcap(F.substring(parts[month], 1, 3)) if named else F.lpad(parts[month], 2, "0")
        d = F.regexp_extract(parts[day], r"^\d+", 0) if named else parts[day]
        return F.try_to_date(F.concat_ws("-", parts[year], m, F.lpad(d, 2, "0")), "yyyy-MMM-dd" if named else "yyyy-MM-dd")

    return F.transform(F.transform(found, lambda match: F.split(match, r"[^A-Za-z0-9]+")), one)


def dates(text: Column, low: Column | None = None) -> Column:
    """All valid dates of a text, ascending and distinct; no date is guessed from an impossible one. low: the text in lower case, where there is one."""
    us, iso = _all(text, US_DATE, 0, low, ("/", "-")), _all(text, ISO_DATE, 0, low, ("-",))
    long, euro = _all(text, TEXT_DATE, 0, low, _MONTH_SIGNS), _all(text, EURO_DATE, 0, low, _MONTH_SIGNS)
    every = F.concat(_dates(us, 2, 0, 1), _dates(iso, 0, 1, 2), _dates(long, 2, 0, 1, True), _dates(euro, 2, 1, 0, True))
    return F.array_sort(F.array_distinct(F.array_compact(every)))


def plausible(found: Column, as_of: Column) -> Column:
    """Dates from 1990 to five years after as_of."""
    return F.filter(found, lambda d: (F.year(d) >= 1990) & (F.year(d) <= F.year(as_of) + 5))


def references(text: Column, low: Column | None = None) -> Column:
    """Map from family to its distinct numbers in order of appearance; families without any are left out."""
    entries = F.array(*(F.struct(F.lit(k).alias("key"), F.array_distinct(_all(text, p, 1, low, SIGNS[k])).alias("value")) for k, p in REFERENCES.items()))
    return F.map_from_entries(F.filter(entries, lambda e: F.size(e["value"]) > 0))


def flat_references(refs: Column) -> Column:
    def one(e: Column) -> Column:
        sign = F.when(e["key"].isin("RFI", "ASI", "PCO", "RFP"), F.lit(" ")).otherwise(F.lit(" #"))
        return F.transform(e["value"], lambda n: F.concat(e["key"], sign, n))

    return F.flatten(F.transform(F.map_entries(refs), one))


def written_amounts(text: Column, low: Column | None = None) -> Column:
    """Amounts in words before "dollars": a million with one or two, a thousand with a hundred or fifty; others are unknown."""
    words = "|".join(sorted(NUMBER_WORDS, key=len, reverse=True))
    found = _all(F.lower(text) if low is None else low, rf"\b((?:(?:{words})\s*)++)(?<=\s)dollars?\b", 1, low, ("dollar",))
    has = F.contains

    def value(s: Column) -> Column:
        million = F.when(has(s, F.lit("one")), 1000000.0).when(has(s, F.lit("two")), 2000000.0)
        thousand = F.when(has(s, F.lit("hundred")), 100000.0).when(has(s, F.lit("fifty")), 50000.0)
        return F.when(has(s, F.lit("million")), million).when(has(s, F.lit("thousand")), thousand)

    return F.array_compact(F.transform(found, value))


def amounts(text: Column, low: Column | None = None) -> Column:
    """Distinct positive amounts in digits or words, descending."""
    found = F.concat(_all(text, DOLLARS, 1, low, ("$",)), _all(text, USD, 1, low, ("usd",)))
    numbers = F.filter(F.transform(found, lambda s: F.replace(s, F.lit(","), F.lit("")).cast("double")), lambda a: a > 0)
    return F.reverse(F.array_sort(F.array_distinct(F.concat(numbers, written_amounts(text, low)))))


def emails(text: Column, low: Column | None = None) -> Column:
    return F.array_distinct(_all(text, EMAIL, 1, low, ("@",)))


def role_parties(text: Column, low: Column | None = None) -> Column:
    """(role, name) of labelled lines, by role and then by place. No name can hold another label, so one search finds all."""
    name = r"\s*([A-Z][A-Za-z\s&.,]+?)(?:\n|$)"
    found = _all(text, rf"(?m)\b(?:{'|'.join(ROLES)}):{name}", 0, low, tuple(f"{r.lower()}:" for r in ROLES))

    def one(role: str, lines: Column) -> Column:
        own = F.filter(lines, lambda x: F.startswith(x, F.lit(f"{role}:")))
        return F.transform(own, lambda x: F.struct(F.lit(role.lower()).alias("role"), F.rtrim(F.regexp_extract(x, rf"(?m):{name}", 1)).alias("name")))

    return let(found, lambda lines: F.concat(*(one(role, lines) for role in ROLES)))


def keywords(text: Column, words: tuple[str, ...] = KEYWORDS, low: Column | None = None) -> Column:
    """The words that a text holds, in any case, in their order. Callers add words of their own field to KEYWORDS."""
    return let(F.lower(text) if low is None else low, lambda low: F.array_compact(F.array(*(F.when(F.contains(low, F.lit(k.lower())), F.lit(k)) for k in words))))


def document_date(text: Column, found: Column, low: Column | None = None) -> Column:
    """The earliest date with a date sign in the 50 characters before its first mention, else the latest."""

    def signed(d: Column, low: Column) -> Column:
        us, long = F.instr(text, F.date_format(d, "MM/dd/yyyy")), F.instr(text, F.date_format(d, "MMMM dd, yyyy"))
        at = F.when(us > 0, us).otherwise(long)
        before = F.substring(low, F.greatest(F.lit(1), at - 50), F.least(F.lit(50), F.greatest(at - 1, F.lit(0))))
        return (at > 0) & reduce(lambda a, b: a | b, (F.contains(before, F.lit(s)) for s in DATE_SIGNS))

    def of(low: Column) -> Column:
        # the dates of a text without a sign are not looked for again
        return F.coalesce(F.when(_holds(low, DATE_SIGNS), F.get(F.filter(found, lambda d: signed(d, low)), F.lit(0))), F.array_max(found))

    return let(F.lower(text), of) if low is None else of(low)


def project_name(text: Column) -> Column:
    tries = [F.rtrim(F.trim(F.regexp_extract(text, r"(?i)Project\s*(?:Name)?:\s*([^\n]+)", 1))), F.trim(F.regexp_extract(text, r"(?im)RE:\s*([^\n]+?)(?:\s*-\s*[A-Z]{2,})?$", 1))]
    tries = [F.regexp_replace(t, "[.,;]+$", "") for t in tries]
    return F.coalesce(*(F.when((F.length(t) > 5) & (F.length(t) < 100), t) for t in tries))


def subject(text: Column, kind: Column, refs: Column) -> Column:
    def numbered(k: str, family: str) -> Column:
        return F.when((kind == k) & F.map_contains_key(refs, family), F.concat(F.lit(f"{family} #"), F.get(F.try_element_at(refs, F.lit(family)), F.lit(0))))

    tries = [F.regexp_replace(F.trim(F.regexp_extract(text, rf"(?i){p}:\s*([^\n]+)", 1)), "[.,;]+$", "") for p in ("Subject", "RE")]
    found = [F.when((F.length(t) > 5) & (F.length(t) < 200), t) for t in tries]
    return F.coalesce(numbered("rfi", "RFI"), numbered("change_order", "Change Order"), numbered("invoice", "Invoice"), *found, F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))))


def extract(docs: DataFrame, as_of: Column, words: tuple[str, ...] = KEYWORDS) -> DataFrame:
    """docs(text, type) with a metadata struct; projections alone, no shuffle.

    Texts are lower-cased once, and patterns run only over texts that hold a sign of what they look for. Fields are columns until the
    last step, so those that nobody reads are not computed.
    """
    text, low = F.coalesce("text", F.lit("")), F.col("low__")
    staged = docs.withColumn("low__", F.lower(text))
    staged = staged.withColumns({"dates__": plausible(dates(text, low), as_of), "refs__": references(text, low)})
    fields = {
        "title": subject(text, F.col("type"), F.col("refs__")), "date": document_date(text, F.col("dates__"), low), "emails": emails(text, low), "parties": role_parties(text, low),
        "reference_numbers": flat_references(F.col("refs__")), "amounts": amounts(text, low), "keywords": keywords(text, words, low),
        "project_number": F.get(F.try_element_at(F.col("refs__"), F.lit("Project")), F.lit(0)), "project_name": F.when(_holds(low, ("project", "re:")), project_name(text)),
    }
    apart = staged.withColumns({f"{k}__": v for k, v in fields.items()})
    meta = F.struct(*(F.col(f"{k}__").alias(k) for k in fields))
    return apart.withColumn("metadata", meta).drop("low__", "dates__", "refs__", *(f"{k}__" for k in fields))
