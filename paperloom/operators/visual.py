"""Visual boundary scores of neighbouring pages from page geometry and embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine

# The weights of the four parts and the kinds of page that raise a score.
WEIGHTS = {"visual": 0.6, "layout": 0.2, "pattern": 0.15, "special": 0.05}
RAISING = ("EMAIL", "SUBMITTAL", "RFI", "CHANGE_ORDER")


def _part(test: Column, value: float) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), value).otherwise(0.0)


def _jump(now: Column, before: Column, low: float, high: float) -> Column:
    ratio = F.try_divide(now, before)
    return (before > 0) & ((ratio < low) | (ratio > high))


def layout_change(c: Column, p: Column) -> Column:
    """0 to 1: change of text density, white space, number of blocks and orientation."""
    return (
        _part(_jump(c["text_density"], p["text_density"], 0.2, 5.0), 0.3) + _part(F.abs(c["whitespace_ratio"] - p["whitespace_ratio"]) > 0.3, 0.2)
        + _part(_jump(c["n_blocks"], p["n_blocks"], 0.5, 2.0), 0.3) + _part(c["orientation"] != p["orientation"], 0.2)
    )


def special_change(c: Column, p: Column) -> Column:
    """0 to 1: a letterhead, a form or a drawing (over 50 drawn elements) that the page before has not."""
    new = lambda now, then: F.coalesce(now, F.lit(False)) & ~F.coalesce(then, F.lit(False))
    return _part(new(c["has_letterhead"], p["has_letterhead"]), 0.4) + _part(new(c["has_forms"], p["has_forms"]), 0.3) + _part(new(c["n_drawings"] > 50, p["n_drawings"] > 50), 0.3)


def boundary_scores(pages: DataFrame, threshold: float = 0.2) -> DataFrame:
    """(pdf_id, page_num, score, confidence, is_boundary) of pages with geometry, embedding and kinds (array of page kinds).

    Confidence is the share of parts above 0; a middling score between two low ones keeps 0.7 of it. Pages of raising kinds
    then score 1.2 times as much, at most 1. The first page of a PDF scores 1 with confidence 1. Nulls add nothing.
    """
    names = ("text_density", "whitespace_ratio", "n_blocks", "orientation", "has_letterhead", "has_forms", "n_drawings", "embedding")
    order = Window.partitionBy("pdf_id").orderBy("page_num")
    seen = pages.select("pdf_id", "page_num", F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"), F.struct(*names).alias("c"))
    seen = seen.withColumn("p", F.lag("c").over(order))
    c, p = F.col("c"), F.col("p")
    visual = F.when(c["embedding"].isNotNull() & p["embedding"].isNotNull(), 1 - cosine(c["embedding"], p["embedding"])).otherwise(0.0)
    parts = {"visual": visual, "layout": layout_change(c, p), "pattern": _part(F.size("kinds") > 0, 1.0), "special": special_change(c, p)}
    scored = seen.select("pdf_id", "page_num", "kinds", p.isNull().alias("first"), *(v.alias(k) for k, v in parts.items()))
    total, sure = F.lit(0.0), F.lit(0)
    for k, w in WEIGHTS.items():
        total, sure = total + F.col(k) * w, sure + (F.col(k) > 0).cast("int")
    scored = scored.select("pdf_id", "page_num", "kinds", F.when(F.col("first"), 1.0).otherwise(total).alias("raw"), F.when(F.col("first"), 1.0).otherwise(sure / 4).alias("sure"))
    alone = (F.col("raw") > 0.4) & (F.col("raw") < 0.6) & (F.lag("raw").over(order) < 0.3) & (F.lead("raw").over(order) < 0.3)
    raised = F.arrays_overlap("kinds", F.array(*map(F.lit, RAISING)))
    scored = scored.withColumns({"confidence": F.when(alone, F.col("sure") * 0.7).otherwise(F.col("sure")), "score": F.when(raised, F.least(F.col("raw") * 1.2, F.lit(1.0))).otherwise(F.col("raw"))})
    return scored.select("pdf_id", "page_num", "score", "confidence", (F.col("score") > threshold).alias("is_boundary"))


def layout_scores(pages: DataFrame) -> DataFrame:
    """(pdf_id, page_num, score, confidence) from a layout model's probability and mean_activation, kinds and has_letterhead.

    A jump of over 0.5 in activation counts 1.2 times, kinds lift the score to 0.4 and 0.6 of it, a letterhead to 0.8 at least;
    at most 1. Confidence is 0.9 above 0.9 and below 0.1, else 0.7. A missing probability is 0.5; the first page has no row.
    """
    order = Window.partitionBy("pdf_id").orderBy("page_num")
    seen = pages.withColumns({"before": F.lag("mean_activation").over(order), "place": F.row_number().over(order)}).where("place > 1")
    score = F.coalesce("probability", F.lit(0.5))
    score = F.when(F.abs(F.col("mean_activation") - F.col("before")) > 0.5, score * 1.2).otherwise(score)
    score = F.when(F.coalesce(F.size("kinds"), F.lit(0)) > 0, score * 0.6 + 0.4).otherwise(score)
    score = F.when(F.col("has_letterhead"), F.greatest(score, F.lit(0.8))).otherwise(score)
    return seen.select("pdf_id", "page_num", F.least(score, F.lit(1.0)).alias("score"), F.when((score > 0.9) | (score < 0.1), 0.9).otherwise(0.7).alias("confidence"))


def table_lines(lines: DataFrame, keys: tuple[str, ...] = ("pdf_id", "page_num"), within: float = 2.0) -> DataFrame:
    """(keys, horizontal, vertical, has_tables) of pages from the straight lines drawn on them (keys, x1, y1, x2, y2).

    A line whose ends differ by less than `within` in y is horizontal, else in x vertical. Pieces of one line, which lie on one another or touch, count once:
    they are merged along it, lines being told apart by their place to the same accuracy. Over three of both make a table. A line with a null end counts as none.
    """
    flat = F.abs(F.col("y1") - F.col("y2")) < within
    upright = ~flat & (F.abs(F.col("x1") - F.col("x2")) < within)
    along = lambda a, b: (F.least(a, b).alias("first"), F.greatest(a, b).alias("last"))
    across = lines.where(flat).select(*keys, F.lit("h").alias("way"), F.round(F.least("y1", "y2") / within).alias("at"), *along("x1", "x2"))
    down = lines.where(upright).select(*keys, F.lit("v").alias("way"), F.round(F.least("x1", "x2") / within).alias("at"), *along("y1", "y2"))
    order = Window.partitionBy(*keys, "way", "at").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    pieces = across.unionByName(down).where("first is not null and last is not null").withColumn("reach", F.max("last").over(order))
    new = F.col("reach").isNull() | (F.col("first") > F.col("reach") + within)
    n = pieces.groupBy(*keys).agg(F.count_if(new & (F.col("way") == "h")).alias("horizontal"), F.count_if(new & (F.col("way") == "v")).alias("vertical"))
    return n.withColumn("has_tables", (F.col("horizontal") > 3) & (F.col("vertical") > 3))
