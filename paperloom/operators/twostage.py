"""Page starts by language models: a fast one screens batches of pages, a deep one reads windows where the first is unsure.

Models are called once: their replies are written as tables before anything is derived from them. Windows are asked on their own;
no summary of the window before goes into a prompt, as that would make each PDF one sequential task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import replies
from ..functions.quality import strip
from ..functions.tables import kept
from ..sources.providers import Model, ask
from . import cascade, classify, segment


def fallback_start(text: Column) -> Column:
    """Whether a page starts a document as far as words in its first 500 characters tell, for windows that no model answers (confidence 0.5)."""
    low = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 500))
    has = lambda *words: F.forall(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    return has("from:", "@") | has("invoice", "#") | has("rfi", "#") | has("submittal")


def screen(pages: DataFrame, fast: Model, batch: int = 5, route: str = "local") -> DataFrame:
    """(pdf_id, page_num, likely_boundary, confidence, needs_deep, hint) of every page of (pdf_id, page_num, text).

    Pages that the reply to their batch leaves out, or whose batch has no readable reply, need the deep model: confidence 0.3,
    likely if page_num is a multiple of 5. Of several entries of a page the first counts; those of no page go.
    """
    facts = replies.screening_facts(F.col("text"))
    flag = lambda c: F.initcap(facts[c].cast("string"))
    length = F.char_length(strip(F.coalesce("text", F.lit(""))))
    line = F.concat(F.lit("Page "), (F.col("page_num") + 1).cast("string"), F.lit(": Email="), flag("has_email_header"), F.lit(", Doc="), flag("has_doc_header"), F.lit(", Len="), length.cast("string"))
    lines = pages.select("pdf_id", "page_num", line.alias("line")).groupBy("pdf_id", (F.floor(F.col("page_num") / batch) * batch).cast("int").alias("first")).agg(F.array_sort(F.collect_list(F.struct("page_num", "line"))).alias("lines"))
    task = 'Reply with a JSON array only: [{"page": 0, "likely_boundary": true, "confidence": 0.8, "needs_deep_analysis": false}], pages counted from 0. Email=True or Doc=True speak for a boundary.\n'
    prompts = lines.select("pdf_id", "first", F.concat(F.lit(task), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("prompt"), F.lit(route).alias("route"))
    answered = kept(ask(prompts, {route: fast}, keys=("pdf_id", "first")), "screened-replies")
    entries = answered.select("pdf_id", "first", F.posexplode(replies.screening_reply(F.col("content"), F.col("first"))).alias("place", "e")).select("pdf_id", "first", "place", "e.*")
    order = F.row_number().over(Window.partitionBy("pdf_id", "page_num").orderBy("first", "place"))
    once = entries.withColumn("nth", order).where("nth = 1").drop("nth", "first", "place")
    joined = pages.select("pdf_id", "page_num").join(once, ["pdf_id", "page_num"], "left")
    gone = F.col("confidence").isNull()
    return joined.select(
        "pdf_id", "page_num", F.when(gone, F.col("page_num") % 5 == 0).otherwise(F.col("likely_boundary")).alias("likely_boundary"), F.coalesce("confidence", F.lit(0.3)).alias("confidence"),
        F.coalesce("needs_deep", F.lit(True)).alias("needs_deep"), "hint",
    )


def votes(pages: DataFrame, screened: DataFrame, deep: Model, route: str = "local") -> DataFrame:
    """(pdf_id, page_num, confidence, label, source) of the windows of screened pages, and of screened pages over 0.8.

    The deep model reads windows with an unsure page. Those of sure pages, and those without a reply, vote as screened, under
    the source deep too; a reply that is no JSON casts no vote.
    """
    windows = cascade.smart_windows(screened.select("pdf_id", "page_num", "confidence", "needs_deep"))
    each = windows.withColumn("page_num", F.explode(F.sequence("window_start", "window_end")))
    texts = pages.select("pdf_id", "page_num", F.substring(F.coalesce("text", F.lit("")), 1, 150).alias("preview"), F.char_length(F.coalesce("text", F.lit(""))).alias("n"))
    inside = each.join(screened, ["pdf_id", "page_num"]).join(texts, ["pdf_id", "page_num"])
    hints = F.array_compact(F.array(F.when(F.col("likely_boundary"), F.format_string("likely boundary (confidence: %.2f)", "confidence")), F.concat(F.lit("possible "), F.col("hint"))))
    about = F.concat(
        F.lit("\nPage "), (F.col("page_num") + 1).cast("string"), F.lit(":\n- Screening: "), F.when(F.size(hints) > 0, F.array_join(hints, ", ")).otherwise("no clear indicators"),
        F.lit("\n- Text length: "), F.col("n").cast("string"), F.lit(" chars\n- Text: "), F.col("preview"),
    )
    entry = F.struct("page_num", "likely_boundary", "confidence", "hint", about.alias("about"))
    packed = inside.groupBy("pdf_id", "window_start").agg(F.array_sort(F.collect_list(entry)).alias("entries"), (F.bool_or("needs_deep") | (F.max("priority") > 1)).alias("unsure"))
    task = 'Find the pages that start a document. Reply with JSON: {"boundaries": [{"page_num": 0, "is_boundary": true, "confidence": 0.9, "document_type": "type", "reasoning": "why"}], "summary": "text"}, pages counted from 0.\n'
    prompts = packed.where("unsure").select("pdf_id", "window_start", F.concat(F.lit(task), F.array_join(F.transform("entries", lambda e: e["about"]), "\n")).alias("prompt"), F.lit(route).alias("route"))
    answered = kept(ask(prompts, {route: deep}, keys=("pdf_id", "window_start")), "deep-replies").where(F.col("content").isNotNull())
    read = answered.select("pdf_id", F.explode(replies.json_reply(F.col("content"))["boundaries"]).alias("b")).where(F.col("b.is_boundary") & F.col("b.confidence").isNotNull() & F.col("b.page_num").isNotNull())
    deep_votes = read.select("pdf_id", F.col("b.page_num").alias("page_num"), F.col("b.confidence").alias("confidence"), F.col("b.document_type").alias("label"), F.lit("deep").alias("source"))
    left = packed.join(answered.select("pdf_id", "window_start"), ["pdf_id", "window_start"], "left_anti").select("pdf_id", F.explode("entries").alias("e")).where("e.likely_boundary")
    kept_votes = left.select("pdf_id", "e.page_num", "e.confidence", F.col("e.hint").alias("label"), F.lit("deep").alias("source"))
    sure = screened.where(F.col("likely_boundary") & (F.col("confidence") > 0.8)).select("pdf_id", "page_num", "confidence", F.col("hint").alias("label"), F.lit("screening").alias("source"))
    return deep_votes.unionByName(kept_votes).unionByName(sure)


def voted_ranges(pages: DataFrame, cast: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Ranges that start at page 0 and wherever the weighted mean vote reaches the threshold; votes for other pages go."""
    starts = classify.boundary_votes(cast, threshold).select("pdf_id", "page_num", F.lit(True).alias("is_start"))
    flags = pages.select("pdf_id", "page_num").join(starts, ["pdf_id", "page_num"], "left").withColumn("is_start", F.coalesce("is_start", F.lit(False)))
    return segment.islands(flags)


def ranges(pages: DataFrame, fast: Model, deep: Model, threshold: float = 0.7) -> DataFrame:
    """(pdf_id, start_page, end_page) by both models."""
    screened = screen(pages, fast)
    return voted_ranges(pages, votes(pages, screened, deep), threshold)
