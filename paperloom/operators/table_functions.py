"""Table functions for SQL: pattern extraction with a row for each match, and a page's windows.

After `register(spark)`:

    SELECT doc_id, m.* FROM docs, LATERAL extract_patterns(text, 'amount') AS m
    SELECT * FROM page_runs(TABLE(SELECT pdf_id, page_num, is_start FROM pages) PARTITION BY pdf_id ORDER BY page_num)
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions.signs import signs
from . import metadata


def money(found: str) -> float | None:
    """An amount as a number; none for 0."""
    value = float(found.replace(",", ""))
    return value if value > 0 else None


@dataclass(frozen=True)
class Pattern:
    """A regular expression whose first group is the value, the type of its column, and what becomes of each match (None: nothing)."""

    pattern: str
    kind: type = StringType
    after: Callable[[str], object] | None = None


PATTERNS = {
    "amount": Pattern(metadata.DOLLARS, DoubleType, money),
    "email": Pattern(metadata.EMAIL),
    **{f"reference {name.lower()}": Pattern(p) for name, p in metadata.REFERENCES.items()},
}


def possible(text: Column, family: str) -> Column:
    """Whether a text may have a match of a family: false only without any of the words that each match needs. Other texts need not pass to Python."""
    words = sorted(signs(PATTERNS[family].pattern))
    return reduce(lambda a, b: a | b, (F.contains(F.lower(text), F.lit(w)) for w in words)) if words else F.lit(True)


class ExtractPatterns:
    """(value, start) of every match of a family of PATTERNS in a text; the value's type is the family's."""

    @staticmethod
    def analyze(text: AnalyzeArgument, family: AnalyzeArgument) -> AnalyzeResult:
        if family.value not in PATTERNS:
            raise ValueError(f"the family is a constant, one of {', '.join(PATTERNS)}, not {family.value!r}")
        if not isinstance(text.dataType, StringType):
            raise ValueError("the text is a string")
        return AnalyzeResult(StructType().add("value", PATTERNS[family.value].kind()).add("start", IntegerType()))

    def __init__(self):
        self.compiled: dict[str, re.Pattern] = {}

    def eval(self, text: str | None, family: str) -> Iterator[tuple]:
        rule = PATTERNS[family]
        if family not in self.compiled:
            self.compiled[family] = re.compile(rule.pattern, re.ASCII)
        for m in self.compiled[family].finditer(text or ""):
            value = rule.after(m[1]) if rule.after else m[1]
            if value is not None:
                yield value, m.start(1)


class PageRuns:
    """(pdf_id, start_page, end_page) of each run of pages that begins at a start; rows of one PDF in the order of pages, which the call states."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not {"pdf_id", "page_num", "is_start"} <= set(rows.dataType.names):
            raise ValueError("page_runs takes a table of pdf_id, page_num and is_start")
        pdf = rows.dataType["pdf_id"].dataType
        return AnalyzeResult(StructType().add("pdf_id", pdf).add("start_page", IntegerType()).add("end_page", IntegerType()))

    def __init__(self):
        self.run: list | None = None

    def eval(self, row) -> Iterator[tuple]:
        page = int(row["page_num"])
        if self.run is not None and row["is_start"]:
            yield tuple(self.run)
            self.run = None
        self.run = [row["pdf_id"], page if self.run is None else self.run[1], page]

    def terminate(self) -> Iterator[tuple]:
        if self.run is not None:
            yield tuple(self.run)


def register(spark: SparkSession) -> None:
    """Names the table functions in the session: extract_patterns and page_runs. By Arrow each row's few matches would be a batch of their own."""
    spark.udtf.register("extract_patterns", udtf(ExtractPatterns))
    spark.udtf.register("page_runs", udtf(PageRuns))
