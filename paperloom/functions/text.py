"""Scalar text functions: names, OCR repairs, quality, privacy, routing, prompts and replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that name normalisation spells out.
SPELLED = {
    "inc": "incorporated", "incorporated": "incorporated", "corp": "corporation", "corporation": "corporation", "co": "company", "company": "company", "ltd": "limited", "limited": "limited",
    "assoc": "associates", "associates": "associates", "assocs": "associates", "bros": "brothers", "brothers": "brothers", "const": "construction", "construction": "construction",
    "eng": "engineering", "engineering": "engineering", "engr": "engineering", "arch": "architects", "architects": "architects", "architecture": "architects", "elec": "electric",
    "electric": "electric", "electrical": "electric", "mech": "mechanical", "mechanical": "mechanical", "plumb": "plumbing", "plumbing": "plumbing", "plbg": "plumbing", "htg": "heating",
    "heating": "heating", "ac": "air conditioning", "a/c": "air conditioning", "air-conditioning": "air conditioning", "dev": "development", "development": "development", "&": "and", "+": "and",
    "dept": "department", "div": "division", "intl": "international", "int'l": "international", "natl": "national", "nat'l": "national",
}


def title_case(s: Column) -> Column:
    """First letter of each run of letters upper, the rest lower, also after ' and -."""
    marked = F.regexp_replace(F.lower(s), r"(['\-.&/])(\p{L})", "$1\u0001 $2")
    return F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))


def normal_name(name: Column) -> Column:
    """A party's name with spaces collapsed, capitals undone and abbreviations spelled out; null is empty."""
    s = F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r"\s+", " ")
    s = F.when((F.upper(s) == s) & (F.lower(s) != s) & (F.length(s) > 3), title_case(s)).otherwise(s)
    table = F.create_map(*(F.lit(x) for kv in SPELLED.items() for x in kv))

    def one(w: Column) -> Column:
        long = F.try_element_at(table, F.regexp_replace(F.lower(w), "[.,;:]+$", ""))
        capital = F.concat(F.upper(F.substring(long, 1, 1)), F.substring(long, 2, 100))
        return F.when(long.isNull(), w).when(F.substring(w, 1, 1).rlike(r"\p{Lu}"), capital).otherwise(long)

    s = F.array_join(F.transform(F.split(s, " "), one), " ")
    s = F.regexp_replace(F.regexp_replace(s, r"\bL\.\s*L\.\s*C\b\.?", "LLC"), r"\bL\.\s*L\.\s*P\b\.?", "LLP")
    s = F.regexp_replace(F.regexp_replace(s, r"\s+", " "), r"\s+([,.])", "$1")
    return F.regexp_replace(s, "[.,;:]+$", "")


def text_quality(text: Column) -> dict[str, Column]:
    """Shares of letters, digits, spaces and symbols in a text, and its mean word length."""
    t = F.coalesce(text, F.lit(""))
    n = F.char_length(t)
    share = lambda p: F.coalesce(F.try_divide(n - F.char_length(F.regexp_replace(t, p, "")), n), F.lit(0.0))
    words = F.regexp_count(t, F.lit(r"\S+"))
    return {"n": n, "letters": share(r"\p{L}"), "digits": share(r"\d"), "spaces": share(r"\s"), "symbols": share(r"[^\p{L}\d\s]"), "word_len": F.coalesce(F.try_divide(F.char_length(F.regexp_replace(t, r"\s", "")), words), F.lit(0.0))}


def sensitive(text: Column) -> Column:
    """E-mail addresses, dollar amounts, or legal terms."""
    return F.coalesce(text, F.lit("")).rlike(r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}|\$\s*\d|\b(?:confidential|privileged|attorney|settlement|ssn)\b")


def route(mode: Column, is_sensitive: Column, local_up: Column, cloud_up: Column) -> Column:
    """Provider of a request. Sensitive or full_local requests never leave: without a local provider they wait."""
    inside = (mode == "full_local") | is_sensitive
    return F.when(inside, F.when(local_up, "local").otherwise("none")).when((mode == "full_cloud") & cloud_up, "cloud").when(local_up, "local").when(cloud_up, "cloud").otherwise("none")


def clipped(text: Column, most: int = 4000) -> Column:
    """Long texts as their first and last halves of `most`."""
    half = most // 2
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, half), F.lit("\n...\n"), F.substring(text, -half, half))).otherwise(text)


def parse_reply(reply: Column) -> Column:
    """struct(category, confidence, reason) of "CATEGORY | 95 | why"; a missing number is 0."""
    parts = F.split(F.trim(reply), r"\s*\|\s*", 3)
    return F.struct(F.get(parts, F.lit(0)).alias("category"), F.coalesce(F.get(parts, F.lit(1)).try_cast("double") / 100, F.lit(0.0)).alias("confidence"), F.coalesce(F.get(parts, F.lit(2)), F.lit("")).alias("reason"))


def clean_subject(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"(?i)^(?:(?:re|fw|fwd)\s*:\s*)+", ""))


def jaccard_words(a: Column, b: Column) -> Column:
    """Likeness of two texts' words of four letters or more."""
    x, y = (F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit("[a-z]{4,}"), 0)) for t in (a, b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
