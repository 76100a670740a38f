"""Quality of extracted page texts, the choice between sources, and repairs of recognition errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The points of the quality score, its grades and the confidence of native text.
LENGTH_POINTS = ((100, 20), (50, 15), (20, 10))
WORD_POINTS = ((20, 15), (10, 10), (5, 5))
DIVERSITY_POINTS = ((0.3, 15), (0.2, 10), (0.1, 5))
READABLE_POINTS = ((0.9, 20), (0.7, 15), (0.5, 10), (0.3, 5))
GRADES = ((85, "EXCELLENT"), (65, "GOOD"), (40, "POOR"))
NATIVE_CONFIDENCE = {"EXCELLENT": 0.98, "GOOD": 0.85, "POOR": 0.65, "UNUSABLE": 0.30}

# Misread terms and what they mean, applied in this order without regard to case.
REPAIRS = (
    (r"\bRF[Il1]\b", "RFI"), (r"\bC[O0]\b", "CO"), (r"\bAS[Il1]\b", "ASI"), (r"\bPCO\b", "PCO"), (r"\bCCD\b", "CCD"),
    (r"\bSUBM[Il1]TTAL\b", "SUBMITTAL"), (r"\b[Il1]NVOICE\b", "INVOICE"), (r"\bP[O0]\b", "PO"),
    (r"\b[O0]([0-9])\b", "0$1"), (r"\b([0-9])[O0]\b", "$10"), (r"\b[Il1]([0-9])\b", "1$1"), (r"\b2[O0]2([0-9])\b", "202$1"),
)
TERM_REPAIRS = (
    *REPAIRS[:8], (r"\bDSA\b", "DSA"), (r"\bD[Il1]R\b", "DIR"), (r"\bPWC\b", "PWC"),
    (r"\bGEN[E3]RAL\s+C[O0]NTRACT[O0]R\b", "GENERAL CONTRACTOR"), (r"\bSUBC[O0]NTRACT[O0]R\b", "SUBCONTRACTOR"), (r"\bARCH[Il1]TECT\b", "ARCHITECT"),
    (r"\bENG[Il1]NEER\b", "ENGINEER"), (r"\bC[O0]NSTRUCT[Il1][O0]N\b", "CONSTRUCTION"), (r"\bBU[Il1]LD[Il1]NG\b", "BUILDING"), (r"\bPR[O0]JECT\b", "PROJECT"),
    *((rf"\b[O0]{d}[/\-]", f"0{d}/") for d in range(1, 10)), (r"\b1[O0][/\-]", "10/"),
    (r"\b2[O0]2[O0]\b", "2020"), *((rf"\b2[O0]2{d}\b", f"202{d}") for d in range(1, 6)),
)
# A letter read for a digit in the first or second part of a date.
DATE_REPAIRS = (
    (r"\b(\d{0,2})O(\d?[/\-]\d{0,2}[O0Il1]?\d?[/\-]\d{2,4})\b", "$10$2"),
    (r"\b(\d{0,2})[lI](\d?[/\-]\d{0,2}[O0Il1]?\d?[/\-]\d{2,4})\b", "$11$2"),
    (r"\b(\d{0,2}[O0Il1]?\d?[/\-]\d{0,2})O(\d?[/\-]\d{2,4})\b", "$10$2"),
    (r"\b(\d{0,2}[O0Il1]?\d?[/\-]\d{0,2})[lI](\d?[/\-]\d{2,4})\b", "$11$2"),
)


def strip(s: Column) -> Column:
    """s without white space at either end."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _points(value: Column, steps: tuple, least=0) -> Column:
    """What the highest bound that value reaches gives, else `least`."""

    def pick(v: Column) -> Column:
        out = F.lit(least)
        for bound, points in reversed(steps):
            out = F.when(v >= bound, points).otherwise(out)
        return out

    return let(value, pick)


def quality_score(text: Column) -> Column:
    """0 to 100 by length, words, variety, readable characters, structure and absence of garbage; null is an empty text."""
    t = F.coalesce(text, F.lit(""))
    n = F.char_length(t)
    share = lambda p: F.coalesce(F.try_divide(F.regexp_count(t, F.lit(p)), n), F.lit(0.0))
    variety = F.coalesce(F.try_divide(F.size(F.array_distinct(F.split(F.lower(t), ""))), n), F.lit(0.0))
    garbage = share(r"[^\x00-\x7F]")
    structure = F.when(t.rlike(r"[A-Z][A-Z\s]{10,}"), 15).when(t.rlike(r"\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}") | t.rlike(r"\$[\d,]+\.?\d*|\d+\.?\d*%"), 10).otherwise(0)
    clean = F.when(n == 0, 0).otherwise(let(garbage, lambda g: F.when(g < 0.1, 15).when(g < 0.3, 10).when(g < 0.5, 5).otherwise(0)))
    words = F.regexp_count(t, F.lit(r"\S+"))
    return _points(n, LENGTH_POINTS) + _points(words, WORD_POINTS) + _points(variety, DIVERSITY_POINTS) + _points(share(r"""[\p{L}\p{N}\s.,;:!?()\-\[\]{}/"']"""), READABLE_POINTS) + structure + clean


def quality_grade(text: Column) -> Column:
    """EXCELLENT, GOOD, POOR or UNUSABLE; texts under 20 characters are unusable."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.char_length(strip(t)) < 20, "UNUSABLE").otherwise(_points(quality_score(t), GRADES, "UNUSABLE"))


def native_confidence(text: Column, grade: Column) -> Column:
    """Confidence in native text of a grade, a little more for long texts and less for short ones."""
    n = F.char_length(F.coalesce(text, F.lit("")))
    base = F.lit(0.5)
    for name, value in NATIVE_CONFIDENCE.items():
        base = F.when(grade == name, value).otherwise(base)
    base = base + F.when(n > 500, 0.02).when(n < 50, -0.10).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), base))


def longest(*candidates: Column) -> Column:
    """The longest candidate text, the first of equals, stripped; nulls are empty."""
    entries = F.array(*(F.struct(F.char_length(F.coalesce(c, F.lit(""))).alias("n"), F.lit(-i).alias("rank"), F.coalesce(c, F.lit("")).alias("text")) for i, c in enumerate(candidates)))
    return strip(F.array_max(entries)["text"])


def choose_text(native: Column, ocr: Column, ocr_confidence: Column) -> Column:
    """struct(text, confidence, method): good native text, else recognised text or the longer of both; a null ocr means that none ran."""
    text = F.coalesce(native, F.lit(""))
    made = lambda t, c, m: F.struct(t.alias("text"), c.cast("double").alias("confidence"), F.lit(m).alias("method"))

    def pick(grade: Column) -> Column:
        sure = native_confidence(text, grade)
        longer = (grade != "UNUSABLE") & (F.char_length(text) > F.char_length(ocr)) & (strip(text) != "")
        # recognised text over 1.2 times as long as the native one is never shorter, so the longer text is the combination
        out = F.when(grade.isin("EXCELLENT", "GOOD"), made(text, sure, "native")).when(ocr.isNotNull() & longer, made(text, ocr_confidence, "hybrid"))
        return out.when(ocr.isNotNull(), made(ocr, ocr_confidence, "ocr")).when(strip(text) != "", made(text, sure, "native")).otherwise(made(F.lit(""), F.lit(0.0), "native"))

    return let(quality_grade(native), pick)


def best_reading(readings: Column) -> Column:
    """Of an array of struct(text, confidence): the first if surer than 0.9, else the surest, the first of equals."""
    keyed = F.transform(readings, lambda r, i: F.struct(r["confidence"].alias("confidence"), (-i).alias("rank"), r["text"].alias("text")))
    best = F.array_max(keyed)
    first = F.get(readings, F.lit(0))
    return F.when(first["confidence"] > 0.9, F.struct(first["text"].alias("text"), first["confidence"].alias("confidence"))).otherwise(F.struct(best["text"].alias("text"), best["confidence"].alias("confidence")))


def page_words(words: DataFrame, over: float = 0) -> DataFrame:
    """(page_id, text, confidence) of recognised words (page_id, ord, text, conf 0 to 100); layout rows have no positive conf.

    over: words of this confidence and less are left out; readers of other make than the first are taken over 30.
    """
    real = (F.col("conf") > over) & (strip(F.col("text")) != "")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(real, F.struct("ord", "text")))), lambda w: w["text"]), " ")
    return words.groupBy("page_id").agg(text.alias("text"), F.coalesce(F.avg(F.when(real, F.col("conf"))) / 100, F.lit(0.0)).alias("confidence"))


def _replaced(text: Column, pairs: tuple, flags: str) -> Column:
    for pattern, by in pairs:
        text = F.regexp_replace(text, flags + pattern, by)
    return text


def repair(text: Column) -> Column:
    """text with common misreadings undone and white space collapsed; null stays null."""
    return strip(F.regexp_replace(_replaced(text, REPAIRS, "(?i)"), r"\s+", " "))


# TERM_REPAIRS with its runs of months and of years as one pattern each: matches of one cannot overlap those of another.
_TERMS_AT_ONCE = (*TERM_REPAIRS[:18], (r"\b[O0]([1-9])[/\-]", "0$1/"), *TERM_REPAIRS[27:29], (r"\b2[O0]2([1-5])\b", "202$1"))
# Of each of the patterns of numbers, what a text needs one of; terms have signs.
_NUMBER_SIGNS = (("/", "-"), ("1o", "10"), ("2o2", "202"), ("2o2", "202"))


def repair_terms(text: Column) -> Column:
    """As repair, for trade terms and for letters in dates. Patterns run only over texts with a sign of them.

    Signs are looked for in the text as it came: no repair makes one that was not there, as terms are whole words and none is
    part of another, and repairs of numbers change letters within their own match.
    """
    from .signs import signs

    def only(x: Column, there: Column, pattern: str, by: str) -> Column:
        return let(x, lambda v: F.when(there, F.regexp_replace(v, pattern, by)).otherwise(v))

    def terms(x: Column) -> Column:
        out = x["t"]
        for i, (pattern, by) in enumerate(_TERMS_AT_ONCE):
            words = sorted(signs(pattern)) if i < 18 else _NUMBER_SIGNS[i - 18]
            there = F.lit(False)
            for w in words:
                there = there | F.contains(x["low"], F.lit(w))
            out = only(out, there, "(?i)" + pattern, by)
        return out

    def dates(x: Column) -> Column:
        # a letter near a sign of a date, with what the repairs before may have made of the character between
        near = F.struct(*(x.rlike(rf"[{c}][\dOlI]?[/\-]").alias(c) for c in ("O", "lI")))

        def run(seen: Column) -> Column:
            out = x
            for (pattern, by), c in zip(DATE_REPAIRS, ("O", "lI", "O", "lI"), strict=True):
                out = only(out, seen[c], pattern, by)
            return out

        return let(near, run)

    repaired = let(F.struct(text.alias("t"), F.lower(text).alias("low")), terms)
    return strip(F.regexp_replace(let(repaired, dates), r"\s+", " "))
