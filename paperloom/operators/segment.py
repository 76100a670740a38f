"""Segmentation: page flags to ranges, gap filling, coalescing, pair merging, windows, and page rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quality import strip
from ..functions.signs import has_any, with_low

# The pattern groups that mark the kind of a page.
GROUPS = {
    "EMAIL": [r"From:\s*.*@", r"To:\s*.*@", "Subject:", "Sent:", r"(From|Form|Fram):\s*\w+", r"(To|Ta|lo):\s*\w+", "(Subject|Subjact|Subjet):", "(Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)", r"\d{1,2}/\d{1,2}/\d{2,4}\s+\d{1,2}:\d{2}", "(January|February|March|April|May|June|July|August|September|October|November|December)"],
    "SUBMITTAL": [r"SUBMITTAL\s*TRANSMITTAL", "SUBMITTAL", "TRANSMITTAL", r"Reference\s*Number", r"Transmitted\s*(To|For)", "SUBM[I1]TTAL", "TRANSM[I1]TTAL"],
    "PAYMENT": [r"APPLICATION\s+AND\s+CERTIFICATE\s+FOR\s+PAYMENT", r"SCHEDULE\s+OF\s+VALUES", r"CONTINUATION\s+SHEET", r"AIA\s+Document", r"Application\s+No", "APPL[I1]CAT[I1]ON.*PAYMENT", "CERT[I1]F[I1]CATE.*PAYMENT", r"A[I1]A\s+Document"],
    "SHIPPING": [r"PACKING\s+SLIP", r"SALES\s+ORDER", r"Ship\s+To", r"Sold\s+To", r"Customer\s+PO", r"PACK[I1]NG\s+SL[I1]P"],
    "RFI": [r"REQUEST\s+FOR\s+INFORMATION", r"RFI\s*#?\s*\d+", r"Request\s*#", r"RF[I1]\s*#?\s*\d+", "REQUEST.*[I1]NFORMAT[I1]ON"],
    "COST_PROPOSAL": [r"COST\s+PROPOSAL", r"PROPOSAL\s*#", r"Quote\s+valid", r"Total\s+Cost"],
    "CHANGE_ORDER": [r"CHANGE\s+ORDER", r"C\.?O\.?\s*#?\s*\d+", r"PCO\s*#?\s*\d+"],
    "DRAWING": ["SCALE:", r"SHEET\s+\d+\s+OF\s+\d+", "DETAIL", "SECTION", "ELEVATION", "PLAN"],
}
DRAWING_NUMBER = r"(?m)^[A-Z]+\d+\.\d+\s*$"
AGGRESSIVE = (
    r"Page\s*1\s*of\s*\d+", r"^(From|To|Subject)\s*:", r"^\d{1,2}/\d{1,2}/\d{4}", r"^[A-Z\s]{10,}$", r"Transmittal\s*#", r"Invoice\s*#",
    r"Application\s*(and|&)", r"Schedule\s*of\s*Values", r"Request\s*for\s*Information", r"Cost\s*Proposal", r"Packing\s*Slip", r"Sales\s*Order",
)


def _head(text: Column) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, 1500)


def _kind_tests(head: Column, low: Column) -> list[Column]:
    """For each pattern group its name, or null without a hit in the head, of which low is the lower case."""
    tests = []
    for kind, patterns in GROUPS.items():
        hit = has_any(head, patterns, "i", low)
        if kind == "DRAWING":
            hit = hit | head.rlike(DRAWING_NUMBER)
        tests.append(F.when(hit, F.lit(kind)))
    return tests


def page_kinds(text: Column) -> Column:
    """The pattern groups with a hit in the first 1500 characters, in order of the groups."""
    return with_low(_head(text), lambda head, low: F.array_compact(F.array(*_kind_tests(head, low))))


def first_kind(text: Column) -> Column:
    """The first of page_kinds, null if there is none; groups after it are not tried."""
    return with_low(_head(text), lambda head, low: F.coalesce(*_kind_tests(head, low)))


def title_line(text: Column) -> Column:
    """An upper-case line of over 10 characters and at most 5 words among the first five."""
    lines = F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, 5)
    return F.exists(lines, lambda x: (F.length(F.trim(x)) > 10) & (F.upper(x) == x) & (F.lower(x) != x) & (F.regexp_count(x, F.lit(r"\S+")) <= 5))


def page_start(text: Column, page_num: Column, min_chars: int = 20) -> Column:
    """Whether a page starts a document: enough text, and an indicator, a kind, a first page number or a title line."""
    text = F.coalesce(text, F.lit(""))
    return with_low(_head(text), lambda head, low: _page_start(text, page_num, min_chars, head, low))


def _page_start(text: Column, page_num: Column, min_chars: int, head: Column, low: Column) -> Column:
    bold = has_any(F.substring(text, 1, 600), AGGRESSIVE, "im", low)
    rules = [(page_num > 0) & bold, F.coalesce(*_kind_tests(head, low)).isNotNull(), has_any(text, (r"Page\s*1\s*(of|/)",), "i"), title_line(text)]
    return (F.length(F.trim(text)) >= min_chars) & reduce(lambda a, b: a | b, rules)


def islands(flags: DataFrame, flag: str = "is_start") -> DataFrame:
    """(pdf_id, start_page, end_page) from page flags: a range starts at page 0 and at each flag."""
    order = Window.partitionBy("pdf_id").orderBy("page_num")
    seg = F.sum((F.col(flag) | (F.col("page_num") == 0)).cast("int")).over(order)
    return flags.withColumn("seg", seg).groupBy("pdf_id", "seg").agg(F.min("page_num").alias("start_page"), F.max("page_num").alias("end_page")).drop("seg")


def fill_gaps(ranges: DataFrame, totals: DataFrame) -> DataFrame:
    """The ranges and what they leave of 0 .. n_pages - 1; a PDF without ranges is one."""
    order = Window.partitionBy("pdf_id").orderBy("start_page", "end_page")
    before = F.coalesce(F.lag("end_page").over(order), F.lit(-1))
    gaps = ranges.select("pdf_id", (before + 1).alias("start_page"), (F.col("start_page") - 1).alias("end_page")).where("start_page <= end_page")
    last = ranges.groupBy("pdf_id").agg(F.max_by("end_page", F.struct("start_page", "end_page")).alias("last"))
    tails = totals.join(last, "pdf_id", "left").select("pdf_id", (F.coalesce("last", F.lit(-1)) + 1).alias("start_page"), (F.col("n_pages") - 1).alias("end_page")).where("start_page <= end_page")
    return ranges.select("pdf_id", "start_page", "end_page").unionByName(gaps).unionByName(tails)


def coalesce_ranges(ranges: DataFrame, merge_adjacent: bool = True) -> DataFrame:
    """Overlapping (and adjacent) ranges as one."""
    order = Window.partitionBy("pdf_id").orderBy("start_page", "end_page")
    reach = F.max("end_page").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("start_page") > reach + (1 if merge_adjacent else 0), F.lit(True))
    marked = ranges.withColumn("new", new.cast("int")).withColumn("seg", F.sum("new").over(order))
    return marked.groupBy("pdf_id", "seg").agg(F.min("start_page").alias("start_page"), F.max("end_page").alias("end_page")).drop("seg")


def merge_pairs(ranges: DataFrame, flag: str = "joins_next") -> DataFrame:
    """Greedy merge of neighbours: in each run of flagged ranges, those at even places take in their next."""
    order = Window.partitionBy("pdf_id").orderBy("start_page")
    m = F.coalesce(F.col(flag), F.lit(False)) & F.lead("start_page").over(order).isNotNull()
    staged = ranges.withColumn("m", m).withColumn("n", F.row_number().over(order))
    staged = staged.withColumn("run", F.col("n") - F.row_number().over(Window.partitionBy("pdf_id", "m").orderBy("start_page")))
    place = F.row_number().over(Window.partitionBy("pdf_id", "m", "run").orderBy("start_page")) - 1
    staged = staged.withColumn("head", F.col("m") & (place % 2 == 0))
    staged = staged.withColumn("taken", F.coalesce(F.lag("head").over(order), F.lit(False))).withColumn("next_end", F.lead("end_page").over(order))
    return staged.where(~F.col("taken")).select("pdf_id", "start_page", F.when(F.col("head"), F.col("next_end")).otherwise(F.col("end_page")).alias("end_page"))


def windows(totals: DataFrame, size: int = 3, overlap: int = 1) -> DataFrame:
    """(pdf_id, window_start, window_end) of sliding page windows; tails are kept."""
    starts = F.explode(F.sequence(F.lit(0), F.col("n_pages") - 1, F.lit(size - overlap)))
    return totals.where("n_pages > 0").select("pdf_id", "n_pages", starts.alias("window_start")).select("pdf_id", "window_start", F.least(F.col("window_start") + size - 1, F.col("n_pages") - 1).alias("window_end"))


def density_jump(pages: DataFrame) -> DataFrame:
    """pages with jump: text length crosses from over 1000 to under 200 characters or back, against a page of over 50."""
    n = F.length(F.trim("text"))
    before = F.lag(n).over(Window.partitionBy("pdf_id").orderBy("page_num"))
    return pages.withColumn("jump", F.coalesce((before > 50) & (((before > 1000) & (n < 200)) | ((before < 200) & (n > 1000))), F.lit(False)))


def damp_spikes(scores: DataFrame) -> DataFrame:
    """scores with confidence: a middling score between two low neighbours counts 0.7 of itself."""
    order = Window.partitionBy("pdf_id").orderBy("page_num")
    s = F.col("score")
    alone = (s > 0.4) & (s < 0.6) & (F.lag("score").over(order) < 0.3) & (F.lead("score").over(order) < 0.3)
    return scores.withColumn("confidence", F.when(alone, s * 0.7).otherwise(s))


def scanned_pdfs(pages: DataFrame) -> DataFrame:
    """(pdf_id, scanned): at least min(3, n) of the first five pages have under 10 characters."""
    head = pages.where("page_num < 5").groupBy("pdf_id").agg(F.count("*").alias("n"), F.count_if(F.length(F.trim("text")) < 10).alias("bare"))
    return head.select("pdf_id", (F.col("bare") >= F.least(F.lit(3), F.col("n"))).alias("scanned"))


def violations(ranges: DataFrame, totals: DataFrame) -> DataFrame:
    """Ranges that break 0 <= start <= end < n_pages or overlap the range before."""
    order = Window.partitionBy("pdf_id").orderBy("start_page", "end_page")
    joined = ranges.withColumn("before", F.lag("end_page").over(order)).join(totals, "pdf_id")
    bad = (F.col("start_page") < 0) | (F.col("start_page") > F.col("end_page")) | (F.col("end_page") >= F.col("n_pages"))
    return joined.where(bad | (F.col("before") >= F.col("start_page"))).select("pdf_id", "start_page", "end_page")


def whole_pdfs(totals: DataFrame) -> DataFrame:
    """One range for each PDF, of all its pages."""
    return totals.where("n_pages > 0").select("pdf_id", F.lit(0).alias("start_page"), (F.col("n_pages") - 1).cast("int").alias("end_page"))


def first_ranges(ranges: DataFrame, most: int) -> DataFrame:
    """The first `most` documents of each PDF."""
    place = F.row_number().over(Window.partitionBy("pdf_id").orderBy("start_page", "end_page"))
    return ranges.withColumn("place", place).where(F.col("place") <= most).drop("place")


def paged(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """The pages of each range with start_page, end_page and page_number (1, 2, ... in the range), as in a PDF of that range alone.

    Ranges are spelled out by page, so pages and ranges meet by equal keys; a page of several ranges is in each. A range that
    ends before it starts has no pages. What an explode makes of few rows is estimated as few, so the hint keeps it from being broadcast.
    """
    spelled = ranges.where("start_page <= end_page").select("pdf_id", "start_page", "end_page", F.explode(F.sequence("start_page", "end_page")).alias("page_num"))
    return pages.join(spelled.hint("merge"), ["pdf_id", "page_num"]).withColumn("page_number", (F.col("page_num") - F.col("start_page") + 1).cast("int"))


def assemble(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Documents of the ranges, which a detector or a person gave: id, 1-based page range, page count and texts joined by an empty line."""
    packed = paged(pages, ranges).groupBy("pdf_id", "start_page", "end_page").agg(F.array_sort(F.collect_list(F.struct("page_num", F.coalesce("text", F.lit("")).alias("text")))).alias("pages"))
    return packed.select(
        F.sha2(F.concat_ws(":", "pdf_id", "start_page", "end_page"), 256).alias("id"), "pdf_id", (F.col("start_page") + 1).alias("page_start"), (F.col("end_page") + 1).alias("page_end"),
        F.size("pages").alias("page_count"), F.array_join(F.transform("pages", lambda x: x["text"]), "\n\n").alias("text"),
    )


def blank_before(pages: DataFrame) -> DataFrame:
    """(pdf_id, page_num, blank_before): the page before has under 100 characters and is no page number alone."""
    text = strip(F.coalesce("text", F.lit("")))
    blank = (F.char_length(text) < 100) & ~text.rlike(r"^\s*\d+\s*$") & ~text.rlike(r"(?i)Page\s+\d+")
    flagged = pages.select("pdf_id", "page_num", blank.alias("blank"))
    return flagged.select("pdf_id", "page_num", F.coalesce(F.lag("blank").over(Window.partitionBy("pdf_id").orderBy("page_num")), F.lit(False)).alias("blank_before"))


# The time stamp of a mail, its field names, and the marks of a sheet that goes on.
TIME_STAMP = (
    r"(?i)(Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday),\s+(January|February|March|April|May|June|July|August|September|October|November|December)"
    r"\s+\d{1,2},\s+\d{4}\s+\d{1,2}:\d{2}\s+(AM|PM)"
)
MAIL_FIELDS = ("From:", "To:", "Subject:", "@")
GOES_ON = (r"CONTINUATION\s+SHEET", r"Page\s+\d+\s+of\s+\d+", "Continued from previous", "See attached")
SUBJECT_LINE = r"(?i)Subject:\s*(.+?)(?:\n|$)"


def strong_starts(pages: DataFrame, form: Column, start: Column | None = None) -> DataFrame:
    """(pdf_id, page_num, is_strong): a mail's time stamp after a page without one, a form after a mail, or a jump in the amount of text.

    form: whether a page's text begins a form; start, given, is kept beside it as is_start. Pages are reduced to facts first, so that texts do not
    pass through the window.
    """
    kept = [start.alias("is_start")] if start is not None else []
    text = F.coalesce("text", F.lit(""))
    head = F.substring(text, 1, 500)
    mail = reduce(lambda a, b: a | b, (F.contains(head, F.lit(m)) for m in MAIL_FIELDS))
    facts = F.struct(F.char_length(strip(text)).alias("n"), head.rlike(TIME_STAMP).alias("stamp"), mail.alias("mail"), form.alias("form"))
    seen = pages.select("pdf_id", "page_num", facts.alias("c"), *kept)
    p, c = F.lag("c").over(Window.partitionBy("pdf_id").orderBy("page_num")), F.col("c")
    seen = seen.withColumn("p", p)
    p = F.col("p")
    jump = (p["n"] > 50) & (((p["n"] > 1000) & (c["n"] < 200)) | ((p["n"] < 200) & (c["n"] > 1000)))
    strong = (c["stamp"] & ~p["stamp"]) | (p["mail"] & c["form"]) | jump
    return seen.select("pdf_id", "page_num", (p.isNotNull() & strong).alias("is_strong"), *["is_start"] * len(kept))


def driven(pages: DataFrame, start: Column, form: Column) -> DataFrame:
    """Ranges of a detector: a page that starts a document, or has a strong sign of one, ends the document before.

    Texts are read once, for both facts, and pages of a PDF are sorted once, for both windows.
    """
    seen = strong_starts(pages, form, start)
    return islands(seen.withColumn("is_start", F.col("is_start") | F.col("is_strong")))


def pair_flags(ranges: DataFrame, pages: DataFrame) -> DataFrame:
    """ranges with joins_next: of one or two pages that say that they go on, or a mail with the subject of the next range.

    Only first pages, and the second ones of short ranges, are read.
    """
    short = F.col("end_page") - F.col("start_page") < 2
    wanted = ranges.select("pdf_id", "start_page", "end_page", short.alias("short"), F.explode(F.array_distinct(F.array("start_page", F.when(short, F.col("end_page")).otherwise(F.col("start_page"))))).alias("page_num"))
    text = F.coalesce("text", F.lit(""))
    line = strip(F.regexp_extract(F.substring(text, 1, 1000), SUBJECT_LINE, 1))
    subject = F.when(F.substring(text, 1, 1000).rlike(SUBJECT_LINE), F.lower(F.regexp_replace(line, r"(?i)^(RE:|FW:|Fwd:)\s*", "")))
    met = wanted.join(pages.select("pdf_id", "page_num", text.alias("text"), subject.alias("subject")), ["pdf_id", "page_num"])
    per = met.groupBy("pdf_id", "start_page", "end_page").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("short"), F.struct("page_num", "text")))), lambda x: x["text"]), "").alias("text"), F.max(F.when(F.col("page_num") == F.col("start_page"), F.col("subject"))).alias("subject")
    )
    order = Window.partitionBy("pdf_id").orderBy("start_page")
    goes_on = F.col("text").rlike("(?i)" + "|".join(GOES_ON))
    flags = per.select("pdf_id", "start_page", "end_page", goes_on.alias("goes_on"), "subject")
    thread = F.coalesce(F.col("subject") == F.lead("subject").over(order), F.lit(False))
    return flags.withColumn("joins_next", F.lead("start_page").over(order).isNotNull() & (F.col("goes_on") | thread)).drop("goes_on", "subject")


def merge_fragments(ranges: DataFrame, most_pages: int = 3) -> DataFrame:
    """Single pages joined with a next range of at most most_pages pages."""
    order = Window.partitionBy("pdf_id").orderBy("start_page")
    next_pages = F.lead("end_page").over(order) - F.lead("start_page").over(order) + 1
    return merge_pairs(ranges.withColumn("joins_next", (F.col("start_page") == F.col("end_page")) & (next_pages <= most_pages)))
