"""The cascade of detectors: when a costlier one has to run, and how its ranges merge with what is there.

Ranges carry pdf_id, start_page, end_page and the mean confidence of their pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sums import steady_sum

from . import segment

KEYS = ["pdf_id", "start_page", "end_page"]
#: Pages that smart_windows folds at once.
BLOCK = 256


def with_confidence(ranges: DataFrame) -> DataFrame:
    """Ranges of the pattern detector with its confidence: 0.8 over several pages, 0.6 on one."""
    return ranges.withColumn("confidence", F.when(F.col("end_page") > F.col("start_page"), 0.8).otherwise(0.6))


def _mean(confidence: str = "confidence") -> Column:
    n = F.col("end_page") - F.col("start_page") + 1
    return F.try_divide(steady_sum(F.col(confidence) * n), F.sum(n))


def bare_pdfs(pages: DataFrame) -> DataFrame:
    """(pdf_id, bare): at least 60 % of the first five pages have under 50 characters."""
    head = pages.where("page_num < 5").groupBy("pdf_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.length(F.trim("text")), F.lit(0)) < 50).alias("few"))
    return head.select("pdf_id", (F.col("few") >= F.col("n") * 0.6).alias("bare"))


def gates(ranges: DataFrame, totals: DataFrame, bare: DataFrame, sure: float = 0.7, visual_pages: int = 10, llm_pages: int = 5) -> DataFrame:
    """Per PDF of totals (pdf_id, n_pages): n_docs, mean confidence, and whether the visual and the language-model stage run.

    A PDF without ranges has no confidence and counts as unsure. Too many documents means over n_pages / 1.5 of 10 pages or more.
    The language-model stage takes every PDF that the visual stage leaves at pattern level.
    """
    found = ranges.groupBy("pdf_id").agg(F.count("*").alias("n_docs"), _mean().alias("mean_confidence"))
    all_pdfs = totals.select("pdf_id", "n_pages").join(found, "pdf_id", "left").join(bare, "pdf_id", "left")
    n_docs, unsure = F.coalesce("n_docs", F.lit(0)), F.coalesce(F.col("mean_confidence") < sure, F.lit(True))
    split = (F.col("n_pages") >= 10) & (n_docs > F.col("n_pages") / 1.5)
    visual = (F.col("n_pages") >= visual_pages) & (unsure | split | F.coalesce("bare", F.lit(False)))
    llm = (F.col("n_pages") >= llm_pages) & (unsure | split | ~visual)
    return all_pdfs.select("pdf_id", "n_pages", n_docs.alias("n_docs"), "mean_confidence", visual.alias("needs_visual"), llm.alias("needs_llm"))


def ambiguous(scores: DataFrame) -> DataFrame:
    """(pdf_id, ambiguous): over 30 % of the page scores lie from 0.4 to 0.6."""
    return scores.groupBy("pdf_id").agg((F.count_if(F.col("score").between(0.4, 0.6)) > F.count("*") * 0.3).alias("ambiguous"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every range of either side with in_a, in_b and the columns a_confidence, b_confidence."""
    left = a.select(*KEYS, F.col("confidence").alias("a_confidence"), F.lit(True).alias("in_a")).dropDuplicates(KEYS)
    right = b.select(*KEYS, F.col("confidence").alias("b_confidence"), F.lit(True).alias("in_b")).dropDuplicates(KEYS)
    return left.join(right, KEYS, "full").withColumns({"in_a": F.coalesce("in_a", F.lit(False)), "in_b": F.coalesce("in_b", F.lit(False))})


def _shares(both: DataFrame) -> DataFrame:
    n_a = F.count_if("in_a")
    length = F.when(F.col("in_a"), F.col("end_page") - F.col("start_page") + 1)
    return both.groupBy("pdf_id").agg(
        n_a.alias("n_a"), (F.count_if(F.col("in_a") & F.col("in_b")) / F.greatest(n_a, F.lit(1))).alias("agreed"),
        F.coalesce(F.try_divide(steady_sum(F.col("a_confidence") * length), F.sum(length)), F.lit(0.0)).alias("mean_a"),
    )


def merge_visual(pattern: DataFrame, visual: DataFrame, totals: DataFrame, merge_adjacent: bool = True) -> DataFrame:
    """Ranges of the pattern and the visual detector as one set per PDF.

    A sure pattern detector (mean over 0.7, at most one document a page) wins; over 70 % agreement the visual one does. Else the
    ranges of both, the pattern's over 0.8 and the visual's whose start scores over 0.8 (column score) at over 0.7 confidence
    are coalesced.
    """
    both = agreement(pattern, visual).join(visual.select(*KEYS, "score").dropDuplicates(KEYS), KEYS, "left")
    staged = both.join(_shares(both), "pdf_id").join(totals.select("pdf_id", "n_pages"), "pdf_id")
    keep_a = (F.col("mean_a") > 0.7) & F.col("n_a").between(1, F.col("n_pages"))
    staged = staged.withColumn("way", F.when(keep_a, "a").when(F.col("agreed") > 0.7, "b").otherwise("mix"))
    good = (F.col("in_a") & F.col("in_b")) | (F.col("in_a") & (F.col("a_confidence") > 0.8)) | (F.col("in_b") & ~F.col("in_a") & (F.col("score") > 0.8) & (F.col("b_confidence") > 0.7))
    whole = staged.where((F.col("way") == "a") & F.col("in_a") | (F.col("way") == "b") & F.col("in_b")).select(*KEYS)
    mixed = segment.coalesce_ranges(staged.where((F.col("way") == "mix") & good).select(*KEYS), merge_adjacent)
    return whole.unionByName(mixed)


def merge_llm(current: DataFrame, llm: DataFrame, merge_adjacent: bool = True) -> DataFrame:
    """Ranges after a language model's: all of its own and, above 70 % agreement, the current ones over 0.8; with confidence.

    0.9 for ranges that both sides hold, 0.8 for the model's, 0.7 for others. With merge_adjacent gap-free ranges of a PDF
    become one, as in the described behaviour; without it only overlaps merge.
    """
    both = agreement(current, llm)
    staged = both.join(_shares(both), "pdf_id")
    kept = staged.where(F.col("in_b") | ((F.col("agreed") > 0.7) & (F.col("a_confidence") > 0.8))).select(*KEYS)
    merged = segment.coalesce_ranges(kept, merge_adjacent)
    known = merged.join(both.select(*KEYS, "in_a", "in_b"), KEYS, "left")
    sure = F.when(F.col("in_a") & F.col("in_b"), 0.9).when(F.col("in_b"), 0.8).otherwise(0.7)
    return known.select(*KEYS, sure.alias("confidence"))


def explanations(ranges: DataFrame, level: str) -> DataFrame:
    """(pdf_id, page_num, reason) of each range's first page."""
    return ranges.select("pdf_id", F.col("start_page").alias("page_num"), F.lit(f"Detected using {level.lower()} analysis").alias("reason"))


def smart_windows(screened: DataFrame, size: int = 3, least_overlap: int = 1, most_overlap: int = 2) -> DataFrame:
    """(pdf_id, window_start, window_end, priority) over pages (pdf_id, page_num, confidence, needs_deep); denser where unsure.

    Unsure pages advance by size - most_overlap, others by size - least_overlap. The next start depends on the current one, so what is
    carried over pages is how many are left before the next start. Blocks of BLOCK pages say what each such number ahead of them becomes behind
    them; a PDF's blocks are chained by these short tables, and each block then finds its own starts, so cost grows with the pages.
    """
    unsure = F.coalesce(F.coalesce("needs_deep", F.lit(False)) | (F.col("confidence") < 0.7), F.lit(True))
    steps = F.when(F.col("u"), size - most_overlap).otherwise(size - least_overlap)
    order = Window.partitionBy("pdf_id").orderBy("page_num", "u")
    placed = screened.select("pdf_id", "page_num", unsure.alias("u")).withColumn("i", F.row_number().over(order) - 1)
    page = F.struct("i", "u", steps.alias("steps"))
    blocks = placed.groupBy("pdf_id", F.floor(F.col("i") / BLOCK).cast("int").alias("block")).agg(F.array_sort(F.collect_list(page)).alias("pages"))
    most = max(size - most_overlap, size - least_overlap, 1)

    def left(wait: Column, p: Column) -> Column:
        return F.when(wait == 0, p["steps"] - 1).otherwise(wait - 1)

    behind = F.array(*(F.aggregate("pages", F.lit(w), left) for w in range(most)))
    chain = blocks.groupBy("pdf_id").agg(F.sum(F.size("pages")).cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("block", behind.alias("behind")))).alias("b"))
    ahead = F.aggregate("b", F.array(F.lit(0)), lambda done, b: F.concat(done, F.array(F.get(b["behind"], F.element_at(done, -1)))))
    entered = chain.select("pdf_id", "n", F.posexplode(F.slice(ahead, 1, F.size("b"))).alias("block", "wait"))
    none = F.array().cast("array<struct<i:int,u:boolean,steps:int>>")

    def found(state: Column, p: Column) -> Column:
        starts = F.when(state["wait"] == 0, F.concat(state["starts"], F.array(p))).otherwise(state["starts"])
        return F.struct(left(state["wait"], p).alias("wait"), starts.alias("starts"))

    # what an explode makes of few rows is estimated as few: not broadcast
    folded = blocks.join(entered.hint("merge"), ["pdf_id", "block"])
    folded = folded.select("pdf_id", "n", F.explode(F.aggregate("pages", F.struct(F.col("wait"), none.alias("starts")), found, lambda s: s["starts"])).alias("w"))
    return folded.select("pdf_id", F.col("w.i").alias("window_start"), (F.least(F.col("w.i") + size, F.col("n")) - 1).alias("window_end"), F.when(F.col("w.u"), 2.0).otherwise(1.0).alias("priority"))
