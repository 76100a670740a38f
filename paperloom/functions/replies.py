"""Language models: what they are asked, what their replies say, and what they cost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .quality import strip

# The categories a model may name and the types they stand for; marks in a clipped text.
CATEGORIES = {
    "Email": "email", "Contract Document": "contract", "Change Order": "change_order", "Payment Application": "payment_application", "Inspection Report": "inspection_report",
    "Plans and Specifications": "plans_specifications", "Meeting Minutes": "meeting_minutes", "Request for Information (RFI)": "rfi", "Submittal": "submittal", "Daily Report": "daily_report",
    "Invoice": "invoice", "Letter": "letter", "Cost Proposal": "change_order", "Schedule of Values": "payment_application", "Other": "other",
}
CLIP_MARK = "\n\n[... content truncated ...]\n\n"
SCREENED = "array<struct<page:int,likely_boundary:boolean,confidence:double,needs_deep_analysis:boolean,hint:string>>"
WINDOW = "struct<boundaries:array<struct<page_num:int,is_boundary:boolean,confidence:double,document_type:string,reasoning:string,continues_from_previous:boolean>>,window_summary:string,summary:string>"


def clip(text: Column, most: int = 4000) -> Column:
    """A text of over `most` characters as its first and last halves of that with a mark between."""
    half = most // 2
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, half), F.lit(CLIP_MARK), F.substring(text, -half, half))).otherwise(text)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def classification_prompt(text: Column, title: Column, categories: tuple[str, ...] = tuple(CATEGORIES)) -> Column:
    """The categories as a list, the clipped text, and the title if there is one; null texts are empty."""
    listed = "Name the category of the document.\nCategories:\n" + "\n".join(f"- {c}" for c in categories)
    about = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("\nAdditional Context: "), title, F.lit("\n"))).otherwise("")
    return F.concat(F.lit(listed + "\n\nDocument:\n"), clip(F.coalesce(text, F.lit(""))), about, F.lit("\nReply as: CATEGORY | CONFIDENCE (0-100) | REASON"))


def boundary_prompt(before: Column, after: Column, most: int = 150) -> Column:
    """The last words of one segment and the first of the next; segments of at most `most` words stay as they are."""

    def cut(text: Column, start: Column) -> Column:
        words = _words(text)
        return F.when(F.size(words) > most, F.array_join(F.slice(words, start, most), " ")).otherwise(F.coalesce(text, F.lit("")))

    ends, starts = cut(before, F.lit(-most)), cut(after, F.lit(1))
    return F.concat(F.lit("Does a new document begin between these parts?\nEnd of the first:\n"), ends, F.lit("\nStart of the second:\n"), starts, F.lit("\nReply as: YES or NO | CONFIDENCE (0-100) | REASON"))


def _fields(reply: Column) -> tuple[Column, Column, Column, Column]:
    text = strip(F.coalesce(reply, F.lit("")))
    parts = F.split(text, r" \| ", 3)
    sure = F.coalesce(strip(F.get(parts, F.lit(1))).try_cast("double") / 100, F.lit(0.0))
    fine = F.size(parts) >= 2
    reason = F.when(fine, F.coalesce(strip(F.get(parts, F.lit(2))), F.lit("No reason provided"))).otherwise(F.concat(F.lit("Could not parse response: "), F.coalesce(reply, F.lit(""))))
    return fine, strip(F.get(parts, F.lit(0))), F.when(fine, sure).otherwise(0.0), reason


def label_reply(reply: Column) -> Column:
    """struct(category, label, confidence, reason) of "CATEGORY | 95 | why".

    Unknown categories get the label other, numbers that are none the confidence 0; a reply without a bar, empty or null is
    category Other.
    """
    fine, head, sure, reason = _fields(reply)
    category = F.when(fine, head).otherwise("Other")
    table = F.create_map(*(F.lit(x) for kv in CATEGORIES.items() for x in kv))
    return F.struct(category.alias("category"), F.coalesce(F.try_element_at(table, category), F.lit("other")).alias("label"), sure.alias("confidence"), reason.alias("reason"))


def boundary_reply(reply: Column) -> Column:
    """struct(is_boundary, confidence, reason) of "YES | 90 | why"; what cannot be read is no boundary."""
    fine, head, sure, reason = _fields(reply)
    return F.struct((fine & (F.upper(head) == "YES")).alias("is_boundary"), sure.alias("confidence"), reason.alias("reason"))


def unfenced(reply: Column) -> Column:
    """What a reply holds in its first code fence (one marked json before others), else all of it."""
    inside = lambda mark: F.regexp_extract(reply, f"(?s){mark}(.*?)(?:```|$)", 1)
    return strip(F.when(F.contains(reply, F.lit("```json")), inside("```json")).when(F.contains(reply, F.lit("```")), inside("```")).otherwise(reply))


def json_reply(reply: Column, schema: str = WINDOW) -> Column:
    """The reply's JSON by a schema; null if it is none."""
    return F.when(F.get_json_object(unfenced(reply), "$").isNotNull(), F.from_json(unfenced(reply), schema))


def screening_reply(reply: Column, first_page: Column) -> Column:
    """Array of (page_num, likely_boundary, confidence, needs_deep, hint) of a batch that starts at first_page.

    The first [...] counts, also if another text surrounds it. Missing values are false, 0.5, true and null; a reply that is no
    JSON or names no page for an entry is empty.
    """
    found = F.coalesce(F.from_json(F.coalesce(F.nullif(F.regexp_extract(unfenced(reply), r"(?s)\[.*?\]", 0), F.lit("")), unfenced(reply)), SCREENED), F.array().cast(SCREENED))
    whole = F.when(F.exists(found, lambda x: x.isNull() | x["page"].isNull()), F.array().cast(SCREENED)).otherwise(found)
    return F.transform(whole, lambda x: F.struct(
        (x["page"] + first_page).alias("page_num"), F.coalesce(x["likely_boundary"], F.lit(False)).alias("likely_boundary"), F.coalesce(x["confidence"], F.lit(0.5)).alias("confidence"),
        F.coalesce(x["needs_deep_analysis"], F.lit(True)).alias("needs_deep"), x["hint"].alias("hint"),
    ))


def screening_facts(text: Column) -> dict[str, Column]:
    """What the first pass asks of a page: text_length, has_table, has_email_header, has_doc_header."""
    t = F.coalesce(text, F.lit(""))
    lines, low = F.slice(F.split(t, "\n"), 1, 20), F.lower(F.substring(t, 1, 500))
    holding = lambda c: F.size(F.filter(lines, lambda x: F.contains(x, F.lit(c))))
    return {"text_length": F.char_length(t), "has_table": (holding("|") > 3) | (holding("\t") > 5), "has_email_header": low.rlike("from:|to:|subject:|sent:"), "has_doc_header": low.rlike("invoice|rfi|submittal|change order|daily report|notice")}


def needs_chunks(text: Column, most_tokens: int = 6000) -> Column:
    return F.coalesce(F.char_length(text) / 4, F.lit(0.0)) > most_tokens


def chunks(text: Column, most_tokens: int = 6000, overlap: int = 5, whole: bool = False) -> Column:
    """A text in pieces of about most_tokens (4 characters each), cut at ". "; each begins with the last sentences of the one before.

    A sentence that is too long by itself is clipped where a piece would begin with it; with whole, nothing is clipped and
    pieces over most_tokens are cut into several. One text is one row, so the fold stays in it.
    """
    limit = most_tokens * 4
    fits = lambda s: F.char_length(s) * 0.25 <= most_tokens
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(state: Column, sentence: Column) -> Column:
        done, now = state["done"], state["now"]
        pieces = F.split(now, r"\. ")
        tail = F.array_join(F.slice(pieces, F.greatest(F.size(pieces) - overlap + 1, F.lit(1)), overlap), ". ")
        more = F.struct(done.alias("done"), F.concat(now, sentence, F.lit(". ")).alias("now"))
        alone = F.struct(F.concat(done, F.array(sentence if whole else F.substring(sentence, 1, limit))).alias("done"), F.lit("").alias("now"))
        following = F.struct(F.concat(done, F.array(strip(now))).alias("done"), F.concat(tail, F.lit(". "), sentence).alias("now"))
        return F.when(fits(F.concat(now, sentence)), more).when(now == "", alone).otherwise(following)

    def close(state: Column) -> Column:
        return F.when(strip(state["now"]) == "", state["done"]).otherwise(F.concat(state["done"], F.array(strip(state["now"]))))

    def cut(piece: Column) -> Column:
        last = F.floor(F.greatest(F.char_length(piece) - 1, F.lit(0)) / limit).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: piece.substr(k * limit + 1, F.lit(limit)))

    pieces = F.aggregate(F.split(F.coalesce(text, F.lit("")), r"\. "), start, step, close)
    return F.flatten(F.transform(pieces, cut)) if whole else pieces


def cost(prompt_tokens: Column, reply_tokens: Column, price_in: Column, price_out: Column) -> Column:
    """Price of a call by prices of a million tokens; null without a price."""
    return prompt_tokens / 1_000_000 * price_in + reply_tokens / 1_000_000 * price_out
