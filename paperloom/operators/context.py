"""Word windows around a position in a text, and what they say of a boundary there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quality import let
from ..functions.signs import signs, with_low

# What begins documents, what ends them, what counts for quality, and words without a topic.
STRONG = (
    r"(?i)^from:\s*\S+@\S+", r"(?i)^to:\s*\S+@\S+", r"(?i)^subject:\s*", r"(?i)^date:\s*\d", r"(?i)^request for information", r"(?i)^rfi\s*#?\d+", r"(?i)^change order\s*#?\d+",
    r"(?i)^invoice\s*#?\w+", r"(?i)^bill\s+to:", r"(?i)^contract\s+for\s+", r"(?i)^meeting minutes", r"(?i)^daily report", r"(?i)^submittal\s*#?\d+",
)
WEAK = (
    r"(?i)sincerely,?\s*$", r"(?i)best regards,?\s*$", r"(?i)thank you,?\s*$", r"(?i)yours truly,?\s*$", r"(?i)\[end of \w+\]", r"(?i)page \d+ of \d+", r"(?i)continued on next page",
    r"\f", r"={3,}", r"-{3,}",
)
STOPWORDS = (
    "the and for are but not you all can her was one our had has have been will this that with from they know want good much some time very when come here just like long make many over such "
    "take than them well were"
).split()
SENTENCES, NAMES = r"[.!?]+\s+[A-Z]", r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b"
BASE, LEAST, MOST = 300, 100, 500


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _sum(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, (F.coalesce(t, F.lit(False)).cast("int") for t in tests))


def dense(text: Column) -> Column:
    """Two of: over 10 numbers, over 5 amounts, over 10 acronyms, over 3 addresses, over 0.15 full stops a word."""
    stops = F.try_divide(_count(text, r"\."), _count(text, r"\S+")) > 0.15
    return _sum([_count(text, r"\d+") > 10, _count(text, r"\$[\d,]+") > 5, _count(text, r"\b[A-Z]{2,}\b") > 10, _count(text, r"\w+@\w+") > 3, stops]) >= 2


def sparse(text: Column) -> Column:
    """Empty, or two of: under 20 words, over 0.5 line breaks a word, under half of the words distinct, under 10 word runs."""
    n = _count(text, r"\S+")
    kinds = F.size(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\S+"), 0)))
    return (n == 0) | (_sum([n < 20, F.try_divide(_count(text, "\n"), n) > 0.5, F.try_divide(kinds, n) < 0.5, _count(text, r"\w+") < 10]) >= 2)


def topic_words(text: Column) -> Column:
    """Distinct lower-case words of four or more letters that are no stopwords."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\b[a-z]{3,}\b"), 0)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(*STOPWORDS)))


def _topics_differ(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)) < 0.3)


def topic_change(before: Column, after: Column) -> Column:
    """Under 0.3 of the topic words are common to both; false if one has none."""
    return let(F.struct(topic_words(before).alias("a"), topic_words(after).alias("b")), lambda pair: _topics_differ(pair["a"], pair["b"]))


def page_facts(text: Column) -> Column:
    """What a text says of a boundary before or after it, each pattern run once and only behind its sign: a struct without the text."""

    def named(part: Column, patterns: tuple, name: str) -> Column:
        def hits(t: Column, low: Column) -> Column:
            return F.array_compact(F.array(*(F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in sorted(signs(p))] or [F.lit(True)]) & t.rlike(p), F.lit(f"{name}: {p}")) for p in patterns)))

        return with_low(part, hits)

    chars = F.char_length(text)
    return F.struct(
        text.isNotNull().alias("there"), named(F.substring(text, 1, 200), STRONG, "strong_start").alias("starts"), named(F.substring(text, -200, 200), WEAK, "weak_end").alias("ends"),
        topic_words(text).alias("topics"), chars.alias("chars"), _count(text, r"\S+").alias("words"), (chars - F.char_length(F.translate(text, "\n", ""))).alias("breaks"),
        _count(text, r"(?<!\S)\p{Lu}").alias("capitals"), (chars - F.char_length(F.translate(text, ".!?,:;", ""))).alias("marks"), _count(text, r"\d+").alias("numbers"),
        _count(text, SENTENCES).alias("sentences"), _count(text, NAMES).alias("names"),
    )


def _measures(f: Column) -> list[Column]:
    """Mean line length, share of capitalised words, punctuation a character, numbers a word."""
    lines = f["breaks"] + 1
    return [(f["chars"] - lines + 1) / lines, F.try_divide(f["capitals"], f["words"]), F.try_divide(f["marks"], f["chars"]), F.try_divide(f["numbers"], f["words"])]


def _formats_differ(b: Column, a: Column) -> Column:
    """Two of the four measures, where both are over 0, differ by over half of the larger."""
    return _sum([(x > 0) & (y > 0) & (F.abs(x - y) / F.greatest(x, y) > 0.5) for x, y in zip(_measures(b), _measures(a), strict=True)]) >= 2


def format_change(before: Column, after: Column) -> Column:
    """Two of the four measures of the texts, where both are over 0, differ by over half of the larger."""
    return let(F.struct(page_facts(before).alias("b"), page_facts(after).alias("a")), lambda x: _formats_differ(x["b"], x["a"]))


def windows(texts: DataFrame, text: str = "text", position: str = "position") -> DataFrame:
    """texts with before, after: words around the word at a character position (from 0), joined by spaces.

    The word is the first that starts there or later, else the last. 360 words on each side where the hundred around are dense,
    240 where they are sparse, else 300; never more than the shorter side has. A text without words, or a null, gives nulls.
    """
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    prefix = F.substring(F.col(text), F.lit(1), F.greatest(F.col(position).cast("int"), F.lit(0)))
    staged = texts.withColumn("words__", words).withColumn("at__", F.least(_count(prefix, r"\S+"), F.size("words__") - 1))
    w, at = F.col("words__"), F.col("at__")
    low = F.greatest(at - 50, F.lit(0))
    around = F.array_join(F.slice(w, low + 1, F.least(at + 50, F.size(w)) - low), " ")
    wanted = let(around, lambda t: F.when(dense(t), F.least(F.lit(MOST), F.lit(int(BASE * 1.2)))).when(sparse(t), F.greatest(F.lit(LEAST), F.lit(int(BASE * 0.8)))).otherwise(BASE))
    size = F.least(wanted, at, F.size(w) - at)
    fine = (F.size(w) > 0) & at.isNotNull()
    staged = staged.withColumn("size__", F.when(fine, size))
    s = F.col("size__")
    cut = lambda start: F.when(fine, F.array_join(F.slice(w, start, s), " "))
    return staged.withColumns({"before": cut(F.greatest(at - s, F.lit(0)) + 1), "after": cut(F.greatest(at, F.lit(0)) + 1)}).drop("words__", "at__", "size__")


def fact_indicators(b: Column, a: Column) -> Column:
    """Names of what speaks for a boundary between texts of which b and a are the facts: strong starts, weak ends, a change of topic, of format."""
    changes = F.array_compact(F.array(F.when(_topics_differ(b["topics"], a["topics"]), F.lit("topic_change")), F.when(_formats_differ(b, a), F.lit("format_change"))))
    return F.concat(a["starts"], b["ends"], changes)


def fact_quality(b: Column, a: Column) -> Column:
    """Mean of the balance of lengths, the sentences of each side (5 are full) and the names of both (10 are full)."""
    m, n = b["words"], a["words"]
    balance = F.coalesce(F.try_divide(F.least(m, n), F.greatest(m, n)), F.lit(0.0))
    full = lambda x, most: F.least(F.lit(1.0), x / most)
    return (balance + full(b["sentences"], 5.0) + full(a["sentences"], 5.0) + full(b["names"] + a["names"], 10.0)) / 4


def indicators(before: Column, after: Column) -> Column:
    """fact_indicators of two texts."""
    return let(F.struct(page_facts(before).alias("b"), page_facts(after).alias("a")), lambda x: fact_indicators(x["b"], x["a"]))


def overall_quality(before: Column, after: Column) -> Column:
    """fact_quality of two texts."""
    return let(F.struct(page_facts(before).alias("b"), page_facts(after).alias("a")), lambda x: fact_quality(x["b"], x["a"]))


def page_boundaries(pages: DataFrame) -> DataFrame:
    """(pdf_id, page_num, indicators, quality) of each page with a page before it whose text is not null. A page's text is read once, before the window."""
    facts = pages.select("pdf_id", "page_num", page_facts(F.col("text")).alias("a"))
    pairs = facts.withColumn("b", F.lag("a").over(Window.partitionBy("pdf_id").orderBy("page_num"))).where(F.col("b.there"))
    return pairs.select("pdf_id", "page_num", fact_indicators(F.col("b"), F.col("a")).alias("indicators"), fact_quality(F.col("b"), F.col("a")).alias("quality"))
