"""Rule-based document classification, ensembles and votes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quality import let
from ..functions.sums import steady_sum

# Markers of the ordered keyword classifier, and the phrase lists of the scorer.
MARKERS = (
    ("email", ("from:", "to:", "subject:", "sent:")),
    ("rfi", ("request for information", "rfi")),
    ("change_order", ("change order", "c.o.")),
    ("invoice", ("invoice", "bill", "amount due")),
    ("contract", ("agreement", "contract", "terms and conditions")),
    ("meeting_minutes", ("meeting minutes", "attendees:")),
)
PHRASES = {
    "email": ("from:", "to:", "subject:", "sent:", "dear", "sincerely", "regards", "best regards", "thank you"),
    "rfi": ("request for information", "clarification", "please provide", "response required", "submittal", "specification"),
    "change_order": ("change order", "modification", "amendment", "additional work", "scope change", "cost adjustment", "time extension"),
    "invoice": ("invoice", "billing", "payment", "amount due", "remittance", "pay", "total amount", "balance due"),
    "daily_report": ("daily report", "field report", "weather conditions", "crew size", "equipment", "progress", "work performed"),
    "contract": ("contract", "agreement", "terms and conditions", "contractor", "owner", "shall", "whereas"),
    "letter": ("letterhead", "correspondence", "formal letter", "official communication"),
    "meeting_minutes": ("meeting minutes", "attendees", "agenda", "action items", "discussed", "meeting notes", "decisions made"),
}
# What counts as a mention of a reference (type, a sign of it in lower case, pattern), and shapes of dates.
REFERENCE_MENTIONS = (
    ("rfi", "rfi", r"(?i)\brfi\s*#?\s*(\d+)"), ("change_order", "", r"(?i)\b(?:co|change\s*order)\s*#?\s*(\d+)"), ("invoice", "invoice", r"(?i)\binvoice\s*#?\s*(\d+)"),
    ("contract", "contract", r"(?i)\bcontract\s*#?\s*(\d+)"),
)
DATE_SHAPES = (r"\d{1,2}/\d{1,2}/\d{2,4}", r"\d{1,2}-\d{1,2}-\d{2,4}", r"\b\w+\s+\d{1,2},?\s+\d{4}\b")
FRACTION_WORDS = {
    "email": ("from:", "to:", "subject:", "sent:", "@", "email", "dear", "sincerely", "regards"),
    "rfi": ("request for information", "rfi", "clarification", "please provide", "response required"),
    "change_order": ("change order", "co", "modification", "amendment", "additional work", "scope change"),
    "invoice": ("invoice", "bill", "payment", "amount due", "total:", "$", "pay", "remit"),
    "daily_report": ("daily report", "field report", "weather", "crew", "equipment", "progress"),
    "contract": ("contract", "agreement", "terms", "conditions", "shall", "contractor", "owner"),
    "letter": ("letter", "correspondence", "dear", "sincerely", "letterhead"),
    "meeting_minutes": ("meeting minutes", "attendees", "agenda", "action items", "discussed"),
}


def _any(low: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))


def _hits(low: Column, words) -> Column:
    return reduce(lambda a, b: a + b, (F.contains(low, F.lit(w)).cast("int") for w in words))


def keyword_type(text: Column) -> Column:
    """The first type with a marker in the text, else unknown."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit("unknown")
    for kind, words in reversed(MARKERS):
        out = F.when(_any(low, words), F.lit(kind)).otherwise(out)
    return out


def ranked(scores: dict[str, Column]) -> Column:
    """(score, label) best first; ties go to the type named first."""
    entries = F.array(*(F.struct((-s).alias("minus"), F.lit(i).alias("rank"), F.lit(k).alias("label")) for i, (k, s) in enumerate(scores.items())))
    return F.transform(F.array_sort(entries), lambda e: F.struct((-e["minus"]).alias("score"), e["label"].alias("label")))


def _lowered(docs: DataFrame) -> DataFrame:
    """docs with the text in lower case as a column of its own: a projection below those that search it many times."""
    return docs.withColumn("low__", F.lower(F.coalesce("text", F.lit(""))))


def fraction_scores(low: Column) -> dict[str, Column]:
    """Scores of a text in lower case."""
    return {k: _hits(low, words) / F.lit(float(len(words))) for k, words in FRACTION_WORDS.items()}


def fraction_classifier(docs: DataFrame) -> DataFrame:
    """docs with label, confidence (twice the share of a type's words, at most 1) and the three best alternatives."""
    best = F.col("ranked__")
    out = _lowered(docs).withColumn("ranked__", ranked(fraction_scores(F.col("low__")))).drop("low__")
    return out.withColumns({"label": best[0]["label"], "confidence": F.least(best[0]["score"] * 2, F.lit(1.0)), "alternatives": F.slice(F.filter(best, lambda e: e["score"] > 0), 1, 3)}).drop("ranked__")


def features(docs: DataFrame, n_references: int = 10, n_phrases: int = 20) -> DataFrame:
    """docs with text_length, word_count, the structural flags of the scorer, reference_numbers (`<type>_<number>`) and key_phrases, the first of each."""
    text, low = F.coalesce("text", F.lit("")), F.col("low__")
    numbers = [F.transform(F.when(F.contains(low, F.lit(sign)), F.regexp_extract_all(text, F.lit(p), 1)).otherwise(F.array().cast("array<string>")), _prefixed(kind)) for kind, sign, p in REFERENCE_MENTIONS]
    words = [F.filter(F.array(*map(F.lit, group)), lambda w: F.contains(low, w)) for group in PHRASES.values()]
    return _lowered(docs).withColumns({
        "has_dates": reduce(lambda a, b: a | b, (text.rlike(p) for p in DATE_SHAPES)),
        "reference_numbers": F.slice(F.concat(*numbers), 1, n_references), "key_phrases": F.slice(F.concat(*words), 1, n_phrases),
        "text_length": F.char_length(text), "word_count": F.regexp_count(text, F.lit(r"\S+")), "has_numbers": text.rlike(r"\d"),
        "has_amounts": text.rlike(r"\$\s*\d"), "has_signature": _any(low, ("signature", "signed", "authorized by", "approved by")),
        "has_forms": _any(low, ("form", "application", "check one", "☐", "□", "yes/no")),
        "has_tables": _any(low, ("table", "|", "\t\t", "column", "row")) | (F.regexp_count(text, F.lit("\n")) > 10),
    }).drop("low__")


def _prefixed(kind: str):
    return lambda n: F.concat(F.lit(f"{kind}_"), n)


def phrase_scores(text: Column, low: Column) -> dict[str, Column]:
    """Scores by references, phrases and structure of a text and itself in lower case, each one fixed-order expression."""
    text = F.coalesce(text, F.lit(""))
    zero = F.lit(0.0)
    refs = {k: F.regexp_count(text, F.lit(rf"(?i)\b{k}\s*#?\s*(\d+)")) * F.lit(0.4) for k in ("rfi", "invoice", "contract")}
    out = {}
    money, signed, form = text.rlike(r"\$\s*\d"), _any(low, ("signature", "signed", "authorized by", "approved by")), _any(low, ("form", "application", "check one", "☐", "□", "yes/no"))
    extra = {"invoice": [(money, 0.2)], "change_order": [(money, 0.1), (signed, 0.1)], "contract": [(signed, 0.15)], "rfi": [(form, 0.1)]}
    for kind, words in PHRASES.items():
        score = refs.get(kind, zero) + _hits(low, words) / F.lit(float(len(words))) * F.lit(0.6 if kind == "email" else 0.3)
        for flag, gain in extra.get(kind, ()):
            score = score + F.when(flag, F.lit(gain)).otherwise(zero)
        out[kind] = score
    out["submittal"] = F.when(form, F.lit(0.1)).otherwise(zero)
    return out


def phrase_classifier(docs: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """docs with label, confidence (at most 1; below min_confidence the label is unknown)."""
    out = _lowered(docs).withColumn("ranked__", ranked(phrase_scores(F.col("text"), F.col("low__")))).drop("low__")
    best = F.col("ranked__")[0]
    sure = (best["score"] > 0) & (best["score"] >= min_confidence)
    return out.withColumns({"label": F.when(sure, best["label"]).otherwise(F.lit("unknown")), "confidence": F.when(sure, F.least(best["score"], F.lit(1.0))).otherwise(F.lit(0.0))}).drop("ranked__")


def merged_alternatives(ai: Column, rules: Column, most: int = 3) -> Column:
    """The `most` best of two arrays of struct(score, label): a label's score is 0.6 of the model's and 0.4 of the rules'; equal ones (to 9 digits) go to the model's, then in order."""

    def weighted(found: Column, weight: float, after: int) -> Column:
        empty = F.array().cast("array<struct<label:string,score:double,place:int>>")
        parts = F.transform(found, lambda e, i: F.struct(e["label"].alias("label"), (e["score"] * weight).alias("score"), (i + after).cast("int").alias("place")))
        return F.coalesce(parts.cast("array<struct<label:string,score:double,place:int>>"), empty)

    def of_label(every: Column, label: Column) -> Column:
        own = F.filter(every, lambda e: e["label"] == label)
        return F.struct((-F.round(F.aggregate(own, F.lit(0.0), lambda n, e: n + e["score"]), 9)).alias("minus"), F.array_min(F.transform(own, lambda e: e["place"])).alias("place"), label.alias("label"))

    def best(every: Column) -> Column:
        labels = F.array_distinct(F.transform(every, lambda e: e["label"]))
        return F.slice(F.array_sort(F.transform(labels, lambda x: of_label(every, x))), 1, most)

    ranked = let(F.concat(weighted(ai, 0.6, 0), weighted(rules, 0.4, 1_000)), best)
    return F.transform(ranked, lambda e: F.struct((-e["minus"]).alias("score"), e["label"].alias("label")))


def ensemble(both: DataFrame) -> DataFrame:
    """From rule_label, rule_conf, ai_label, ai_conf: label and confidence by the agreement rules; with rule_alternatives and ai_alternatives, alternatives too."""
    agree, rule_conf, ai_conf = F.col("rule_label") == F.col("ai_label"), F.col("rule_conf"), F.col("ai_conf")
    rule, ai, more = (rule_conf > 0.7) & (ai_conf < 0.6), ai_conf > 0.8, ai_conf >= rule_conf
    mixed = F.when(more, ai_conf * 0.7 + rule_conf * 0.3).otherwise(rule_conf * 0.7 + ai_conf * 0.3)
    label = F.when(agree | (~rule & (ai | more)), F.col("ai_label")).otherwise(F.col("rule_label"))
    conf = F.when(agree, F.least(ai_conf * 1.2, F.lit(1.0))).when(rule, rule_conf * 0.9).when(ai, ai_conf * 0.9).otherwise(mixed)
    out = both.withColumns({"label": label, "confidence": conf})
    if {"rule_alternatives", "ai_alternatives"} <= set(both.columns):
        out = out.withColumn("alternatives", merged_alternatives(F.col("ai_alternatives"), F.col("rule_alternatives")))
    return out


def fallback(docs: DataFrame, model_label: Column, model_confidence: Column) -> DataFrame:
    """docs with label, confidence and method: what the model says, where it says nothing the phrase rules, and last unknown with 0.

    The rules judge every row, as they are a projection; a null label or confidence of the model is no answer.
    """
    rules = phrase_classifier(docs.withColumns({"model__": model_label, "sure__": model_confidence}))
    answered = F.col("model__").isNotNull() & F.col("sure__").isNotNull()
    ruled = F.col("text").isNotNull()
    return rules.withColumns({
        "method": F.when(answered, "model").when(ruled, "rules").otherwise("none"),
        "label": F.when(answered, F.col("model__")).when(ruled, F.col("label")).otherwise("unknown"),
        "confidence": F.when(answered, F.col("sure__")).when(ruled, F.col("confidence")).otherwise(0.0),
    }).drop("model__", "sure__")


def first_signs(text: Column, n_references: int = 10, n_phrases: int = 20) -> Column:
    """struct(references, phrases): the first n_references reference mentions and n_phrases listed phrases of a text."""
    refs = F.regexp_extract_all(text, F.lit(r"(?i)\b(?:rfi|invoice|contract|submittal|change order)\s*#?\s*\d+"), 0)
    words = list(dict.fromkeys(w for group in PHRASES.values() for w in group))
    found = let(F.lower(text), lambda low: F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)))
    return F.struct(F.slice(refs, 1, n_references).alias("references"), F.slice(found, 1, n_phrases).alias("phrases"))


def chunk_votes(chunks: DataFrame, key: str) -> DataFrame:
    """From (key, label, confidence) of chunks: the three best labels by summed confidence over the number of chunks."""
    per = chunks.groupBy(key, "label").agg(steady_sum("confidence").alias("total"))
    n = chunks.groupBy(key).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "label"))
    return per.join(n, key).withColumn("score", F.col("total") / F.col("n")).withColumn("rank", rank).where("rank <= 3").select(key, "rank", "label", "score")


def majority(votes: DataFrame, key: str, order: str) -> DataFrame:
    """Most frequent label of each key; ties go to the label seen first."""
    per = votes.groupBy(key, "label").agg(F.count("*").alias("votes"), F.min(order).alias("first_seen"))
    best = F.max_by(F.struct("label", "votes"), F.struct(F.col("votes"), -F.col("first_seen")))
    return per.groupBy(key).agg(best.alias("b")).select(key, "b.label", "b.votes")


def boundary_votes(votes: DataFrame, threshold: float = 0.7, weights: dict[str, float] | None = None) -> DataFrame:
    """(pdf_id, page_num, confidence) of pages whose weighted mean vote reaches the threshold; page 0 always is one."""
    w = F.lit(1.0)
    for source, value in (weights or {"deep": 1.5, "screening": 1.0}).items():
        w = F.when(F.col("source") == source, F.lit(value)).otherwise(w)
    mean = votes.groupBy("pdf_id", "page_num").agg((steady_sum(F.col("confidence") * w) / steady_sum(w)).alias("confidence"))
    return mean.where((F.col("confidence") >= threshold) | (F.col("page_num") == 0))
