"""Evaluation of predicted page ranges against the truth, and of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sums import steady_sum

#: Pages in a bucket of the overlap join.
BUCKET = 32


def overlaps(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs of a predicted and a true range of one PDF that share pages, with shared pages and IoU.

    Ranges meet by PDF and bucket of pages, so a long PDF is many keys and its ranges are not all compared; a pair that
    shares several buckets is taken from the first of them.
    """

    def bucketed(ranges: DataFrame, first: str, last: str) -> DataFrame:
        named = ranges.select("pdf_id", F.col("start_page").alias(first), F.col("end_page").alias(last)).where(F.col(first) <= F.col(last))
        return named.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(first) / BUCKET), F.floor(F.col(last) / BUCKET))))

    # what an explode makes of few rows is estimated as few: neither side is broadcast
    met = bucketed(pred, "ps", "pe").join(bucketed(truth, "ts", "te").hint("merge"), ["pdf_id", "bucket"])
    met = met.where((F.col("ps") <= F.col("te")) & (F.col("ts") <= F.col("pe")) & (F.col("bucket") == F.floor(F.greatest("ps", "ts") / BUCKET)))
    shared = F.least("pe", "te") - F.greatest("ps", "ts") + 1
    return met.drop("bucket").withColumn("shared", shared).withColumn("iou", F.col("shared") / (F.greatest("pe", "te") - F.least("ps", "ts") + 1))


def range_metrics(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Per PDF: exact, missed, extra and partial (IoU over 0.5) counts, mean best IoU of predictions, precision, recall, F1."""
    per = overlaps(pred, truth).groupBy("pdf_id", "ps", "pe").agg(F.count_if(F.col("iou") == 1).alias("exact"), F.count_if(F.col("iou") > 0.5).alias("partial"), F.max("iou").alias("iou"))
    met = per.groupBy("pdf_id").agg(F.sum("exact").alias("exact"), F.sum("partial").alias("partial"), steady_sum("iou").alias("iou_sum"))
    n_pred, n_true = pred.groupBy("pdf_id").agg(F.count("*").alias("n_pred")), truth.groupBy("pdf_id").agg(F.count("*").alias("n_true"))
    joined = n_pred.join(n_true, "pdf_id", "full").join(met, "pdf_id", "left").na.fill(0)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = joined.withColumns({"precision": ratio(F.col("exact"), F.col("n_pred")), "recall": ratio(F.col("exact"), F.col("n_true"))})
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.select("pdf_id", "n_pred", "n_true", "exact", (F.col("n_true") - F.col("exact")).alias("missed"), (F.col("n_pred") - F.col("exact")).alias("extra"), "partial", ratio(F.col("iou_sum"), F.col("n_pred")).alias("mean_iou"), "precision", "recall", f1.alias("f1"))


def micro(metrics: DataFrame) -> DataFrame:
    """Sums over PDFs and the ratios of the sums."""
    s = metrics.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_pred", "n_true", "exact")))
    p, r = F.coalesce(F.try_divide("exact", "n_pred"), F.lit(0.0)), F.coalesce(F.try_divide("exact", "n_true"), F.lit(0.0))
    return s.select("n_pred", "n_true", "exact", p.alias("precision"), r.alias("recall"))


def best_overlap(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """For each true range the predicted one with most shared pages; ties to the earlier one; none: nulls."""
    best = overlaps(pred, truth).groupBy("pdf_id", "ts", "te").agg(F.max_by(F.struct("ps", "pe", "shared"), F.struct("shared", -F.col("ps"))).alias("b"))
    t = truth.select("pdf_id", F.col("start_page").alias("ts"), F.col("end_page").alias("te"))
    return t.join(best, ["pdf_id", "ts", "te"], "left").select("pdf_id", "ts", "te", "b.ps", "b.pe", "b.shared")


def close_matches(truth: DataFrame, pred: DataFrame, over: float = 0.8) -> DataFrame:
    """Per PDF: n_true, n_pred, hits (true ranges of which the best predicted one shares more than `over` of the longer of both), false_positives, precision, recall, f1.

    Of equally good predictions the earlier is the best; a prediction that is the best of several counts as one.
    """
    longer = F.greatest(F.col("pe") - F.col("ps"), F.col("te") - F.col("ts")) + 1
    share = F.col("shared") / longer
    best = overlaps(pred, truth).groupBy("pdf_id", "ts", "te").agg(F.max(F.struct(share.alias("share"), (-F.col("ps")).alias("minus"), (-F.col("pe")).alias("last"))).alias("b"))
    hit = best.where(F.col("b.share") > over).groupBy("pdf_id").agg(F.count("*").alias("hits"), F.count_distinct("b.minus", "b.last").alias("used"))
    n = [t.groupBy("pdf_id").agg(F.count("*").alias(name)) for t, name in ((truth, "n_true"), (pred, "n_pred"))]
    out = n[0].join(n[1], "pdf_id", "full").join(hit, "pdf_id", "left").na.fill(0)
    out = out.withColumn("false_positives", F.col("n_pred") - F.col("used"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(F.col("hits"), F.col("hits") + F.col("false_positives")), ratio(F.col("hits"), F.col("n_true"))
    return out.select("pdf_id", "n_true", "n_pred", "hits", "false_positives", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def coverage(ranges: DataFrame, totals: DataFrame) -> DataFrame:
    """(pdf_id, covered, missing): pages that ranges hold. A range that ends before it starts holds none."""
    held = ranges.where("start_page <= end_page").select("pdf_id", F.explode(F.sequence("start_page", "end_page")).alias("page")).groupBy("pdf_id").agg(F.count_distinct("page").alias("covered"))
    return totals.join(held, "pdf_id", "left").select("pdf_id", F.coalesce("covered", F.lit(0)).alias("covered"), (F.col("n_pages") - F.coalesce("covered", F.lit(0))).alias("missing"))


def missing_pages(ranges: DataFrame, totals: DataFrame) -> DataFrame:
    """(pdf_id, missing, percent): the pages from 0 to n_pages - 1 that no range holds, ascending, and how many percent of the pages are held.

    What is missing lies between ranges, so only gaps are spelled out: a PDF's ranges pass one window, its pages none.
    """
    order = Window.partitionBy("pdf_id").orderBy("start_page", "end_page").rowsBetween(Window.unboundedPreceding, -1)
    held = ranges.where("start_page <= end_page and end_page >= 0").join(totals, "pdf_id").where("start_page < n_pages")
    # a range behind the last page closes the last gap
    closed = held.select("pdf_id", F.greatest("start_page", F.lit(0)).cast("int").alias("start_page"), F.col("end_page").cast("int")).unionByName(totals.select("pdf_id", F.col("n_pages").cast("int").alias("start_page"), F.col("n_pages").cast("int").alias("end_page")))
    gaps = closed.withColumn("free", F.coalesce(F.max("end_page").over(order) + 1, F.lit(0)))
    gaps = gaps.select("pdf_id", F.explode_outer(F.when(F.col("free") < F.col("start_page"), F.sequence("free", F.col("start_page") - 1))).alias("page"))
    found = gaps.groupBy("pdf_id").agg(F.array_sort(F.collect_list("page")).alias("missing"))
    share = F.try_divide(F.col("n_pages") - F.size("missing"), F.col("n_pages"))
    return found.join(totals, "pdf_id").select("pdf_id", "missing", F.coalesce(100 * share, F.lit(0.0)).alias("percent"))


def confusion(labels: DataFrame) -> DataFrame:
    """(expected, actual, n) counts."""
    return labels.groupBy("expected", "actual").agg(F.count("*").alias("n"))


def greedy_matches(pred: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(pdf_id, ps, pe, ts, te, iou): each predicted range in page order takes the free true range of highest IoU from the threshold on.

    Ties go to the earlier true range. What is taken depends on the order, so pairs that hang together are folded inside a row: those of
    a PDF are parted where all ranges so far end before the next ones begin, as pairs on both sides share no range.
    """
    pairs = overlaps(pred.distinct(), truth.distinct()).where(F.col("iou") >= threshold)
    pair = F.struct("ps", "pe", (-F.col("iou")).alias("minus"), "ts", "te", "iou")
    first, last = F.least("ps", "ts"), F.greatest("pe", "te")
    order = Window.partitionBy("pdf_id").orderBy(first, "ps", "pe", "ts", "te")
    before = F.max(last).over(order.rowsBetween(Window.unboundedPreceding, -1))
    pairs = pairs.withColumn("new", F.coalesce(first > before, F.lit(True)).cast("int")).withColumn("part", F.sum("new").over(order))
    packed = pairs.groupBy("pdf_id", "part").agg(F.array_sort(F.collect_list(pair)).alias("pairs"), F.slice(F.collect_list(pair), 1, 0).alias("none"))

    def step(done: F.Column, x: F.Column) -> F.Column:
        used = F.exists(done, lambda d: ((d["ps"] == x["ps"]) & (d["pe"] == x["pe"])) | ((d["ts"] == x["ts"]) & (d["te"] == x["te"])))
        return F.when(used, done).otherwise(F.concat(done, F.array(x)))

    return packed.select("pdf_id", F.explode(F.aggregate("pairs", F.col("none"), step)).alias("m")).select("pdf_id", "m.ps", "m.pe", "m.ts", "m.te", "m.iou")


def first_overlap(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Per PDF of truth: n_pred, n_true, exact, partial, missed, extra and accuracy in percent, each true range judged by the first predicted range that touches it."""
    first = overlaps(pred, truth).groupBy("pdf_id", "ts", "te").agg(F.min_by("iou", F.struct("ps", "pe")).alias("iou"))
    t = truth.select("pdf_id", F.col("start_page").alias("ts"), F.col("end_page").alias("te")).join(first, ["pdf_id", "ts", "te"], "left")
    per = t.groupBy("pdf_id").agg(F.count("*").alias("n_true"), F.count_if(F.col("iou") == 1).alias("exact"), F.count_if(F.col("iou") < 1).alias("partial"), F.count_if(F.col("iou").isNull()).alias("missed"))
    n = pred.groupBy("pdf_id").agg(F.count("*").alias("n_pred"))
    out = per.join(n, "pdf_id", "left").withColumn("n_pred", F.coalesce("n_pred", F.lit(0)))
    extra = F.greatest(F.col("n_pred") - F.col("n_true"), F.lit(0))
    return out.select("pdf_id", "n_pred", "n_true", "exact", "partial", "missed", extra.alias("extra"), (F.col("exact") / F.col("n_true") * 100).alias("accuracy"))


def label_errors(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """(expected, actual, n, correct) over predicted ranges with a label and the true range of most shared pages (the earlier of equals)."""
    p = pred.select("pdf_id", F.col("start_page").alias("ps"), F.col("end_page").alias("pe"), F.col("label").alias("actual"))
    t = truth.select("pdf_id", F.col("start_page").alias("ts"), F.col("end_page").alias("te"), F.col("label").alias("expected"))
    best = overlaps(pred, truth).groupBy("pdf_id", "ps", "pe").agg(F.max_by(F.struct("ts", "te"), F.struct("shared", -F.col("ts"))).alias("b")).select("pdf_id", "ps", "pe", "b.ts", "b.te")
    joined = p.join(best, ["pdf_id", "ps", "pe"]).join(t, ["pdf_id", "ts", "te"])
    return joined.groupBy("expected", "actual").agg(F.count("*").alias("n")).withColumn("correct", F.col("expected").eqNullSafe(F.col("actual")))


def compare_methods(metrics: DataFrame) -> DataFrame:
    """range_metrics with a column method, as one row per method: sums over PDFs and the ratios of the sums."""
    s = metrics.groupBy("method").agg(*(F.sum(c).alias(c) for c in ("n_pred", "n_true", "exact")), F.try_divide(steady_sum("mean_iou"), F.count("mean_iou")).alias("mean_iou"))
    p, r = F.coalesce(F.try_divide("exact", "n_pred"), F.lit(0.0)), F.coalesce(F.try_divide("exact", "n_true"), F.lit(0.0))
    return s.withColumns({"precision": p, "recall": r}).withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))
