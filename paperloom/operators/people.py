"""Parties that a text names: people before their e-mail address, labelled roles, companies and agencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quality import let
from ..functions.text import normal_name
from . import metadata

# The words that end the names of companies and of agencies, and those that no name ends with.
COMPANY_ENDS = (
    "Inc", "Inc.", "Incorporated", "Corp", "Corp.", "Corporation", "LLC", "L.L.C.", "Company", "Co.", "Ltd", "Ltd.", "Limited", "LLP", "L.L.P.", "Partnership", "Associates", "Group",
    "Construction", "Builders", "Contractors", "Engineering", "Architects", "Design", "Consultants", "Services",
)
AGENCY_ENDS = ("District", "School District", "USD", "Department", "City of", "County of", "State of", "Division", "Authority", "Board", "Commission", "Agency")
NOISE = "the|a|an|and|or|of|by|for"
CAPITALS = r"[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)*"
NAME = r"[A-Z][a-z]+ [A-Z][a-z]+\s{0,90}<?\s{0,90}|[A-Z][a-z]+ [A-Z]\. [A-Z][a-z]+\s{0,90}"


def clean_name(name: Column) -> Column:
    """A name with spaces collapsed, without punctuation and noise words at its end; may be empty."""
    s = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(name, r"\s+", " ")), "[.,;:]+$", ""), rf"(?i)(?:(?:^|\s+)(?:{NOISE}))+$", "")
    return F.trim(s)


def _party(name: Column, role: Column | None = None, email: Column | None = None, kind: str | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(name.alias("name"), (none if role is None else role).alias("role"), (none if email is None else email).alias("email"), F.lit(kind).cast("string").alias("kind"))


def _all(text: Column, words: tuple[str, ...], pattern: str) -> Column:
    """All matches of a pattern that needs one of the words as it is spelled; texts without them are not searched."""
    some = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)) if len(words) > 1 else F.contains(text, F.lit(words[0]))
    return F.when(some, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(F.array().cast("array<string>"))


def found(text: Column) -> Column:
    """Array of (name, role, email, kind) in order of kinds of evidence; each name once, as it was found first. Null is empty."""
    t = F.coalesce(text, F.lit(""))
    mails = _all(t, ("@",), rf"(?:{NAME})(?<![a-zA-Z0-9._%+-]){metadata.EMAIL}")
    people = F.transform(mails, lambda m: _party(F.regexp_extract(m, r"\A([A-Z][a-z]+ (?:[A-Z]\. )?[A-Z][a-z]+)", 1), email=F.regexp_extract(m, metadata.EMAIL + r"\z", 1)))
    roles = F.transform(metadata.role_parties(t), lambda r: _party(clean_name(r["name"]), role=F.initcap(r["role"])))
    ends = "|".join(e.replace(".", r"\.") for e in COMPANY_ENDS)
    whole = _all(t, COMPANY_ENDS, rf"\b{CAPITALS}\s+(?:{ends})\b")
    # between the name and its ending any white space counts as one space
    companies = F.transform(whole, lambda c: _party(F.regexp_replace(c, rf"\s+({ends})$", " $1"), kind="company"))
    agencies = F.flatten(F.array(*(F.transform(_all(t, (e,), rf"\b{CAPITALS}\s+{e}\b"), lambda a: _party(a, kind="agency")) for e in AGENCY_ENDS)))

    def once(all_of: Column) -> Column:
        names = F.transform(all_of, lambda x: x["name"])
        return F.filter(all_of, lambda x, i: (x["name"] != "") & (F.array_position(names, x["name"]) == i + 1))

    return let(F.concat(people, roles, companies, agencies), once)


def rolled_up(text: Column) -> Column:
    """Array of (name, role, email, company) by normalised name: roles sorted and joined, the least address; company if last seen as one."""

    def group(all_of: Column) -> Column:
        def one(name: Column) -> Column:
            mine = F.filter(all_of, lambda x: x["normal"] == name)
            roles = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.transform(mine, lambda x: x["p"]["role"])))), ", ")
            kind = F.try_element_at(F.array_compact(F.transform(mine, lambda x: x["p"]["kind"])), F.lit(-1))
            return F.struct(name.alias("name"), F.nullif(roles, F.lit("")).alias("role"), F.array_min(F.transform(mine, lambda x: x["p"]["email"])).alias("email"), F.when(kind == "company", name).alias("company"))

        return F.transform(F.array_distinct(F.transform(all_of, lambda x: x["normal"])), one)

    return let(F.transform(found(text), lambda p: F.struct(normal_name(p["name"]).alias("normal"), p.alias("p"))), group)


def document_parties(docs: DataFrame, key: str) -> DataFrame:
    """(key, name, role, email, company): a row per party of each document of (key, text); one projection, no shuffle."""
    return docs.select(key, F.explode(rolled_up(F.col("text"))).alias("p")).select(key, "p.*")
