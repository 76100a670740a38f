"""Queries of the catalog, strong page starts, pair conditions, votes and evaluations over the test tables, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quality
from ..functions import text as T
from ..functions.tables import fresh_path
from ..operators import cascade, catalog, classify, context, evaluate, library, pagechain, segment, store
from .corpus import PACKETS_SQL, RENDERED_SQL, exact_sum, packets, rendered, table
from .queries import _FRACTIONS, AS_OF, detected

LOOKED_UP, SOURCE = 12, 7


def stored(spark, sf_dir) -> DataFrame:
    """Rows of a store: the rendered documents with title, pages, parties, dates, amounts, and some with embedding and indexed_at."""
    places = packets(spark, sf_dir).groupBy("doc_id").agg((F.min("page_num") + 1).cast("int").alias("page_start"), (F.max("page_num") + 1).cast("int").alias("page_end"))
    docs = rendered(spark, sf_dir).join(places, "doc_id")
    return docs.withColumns({
        "title": catalog.title(F.col("type"), F.col("doc_id")), "page_count": (F.col("page_end") - F.col("page_start") + 1), "parties": F.array("party"), "dates": F.array("created"),
        "amounts": F.array("amount"), "embedding": F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(1.0))), "indexed_at": F.when(F.col("doc_id") % 4 != 0, F.date_add("created", (F.col("doc_id") % 5).cast("int"))),
    })


def _edges(docs: DataFrame) -> DataFrame:
    kind = F.element_at(F.array(F.lit("responds_to"), F.lit("references"), F.lit("related")), ((F.col("doc_id") + F.col("step")) % 3 + 1).cast("int"))
    steps = docs.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(2), F.lit(3))).alias("step"))
    return steps.select(F.col("doc_id").alias("source_id"), (F.col("doc_id") * F.col("step")).alias("target_id"), kind.alias("relationship_type"))


def _scanned(pages: DataFrame) -> DataFrame:
    return pages.withColumn("is_scanned", F.col("page_num") % 4 == 3)


def document_lookup(spark, sf_dir):
    docs = rendered(spark, sf_dir)
    found = catalog.by_id(docs, store.related(_edges(docs), docs), LOOKED_UP)
    return found.select("doc_id", "type", "created", *(F.array_join(k, ",").alias(k) for k in ("responds_to", "references", "related")))


def source_documents(spark, sf_dir):
    return catalog.by_source(stored(spark, sf_dir), SOURCE).select("doc_id", "type", "page_start", "page_end", "page_count")


def document_list(spark, sf_dir):
    page = catalog.listed(stored(spark, sf_dir), 20, 40, "invoice")
    return page.select("doc_id", "title", "type", "page_count", "created", F.array_join("metadata.parties", ";").alias("parties"), F.get("metadata.amounts", F.lit(0)).alias("amount"))


def document_detail(spark, sf_dir):
    return catalog.detail(stored(spark, sf_dir), LOOKED_UP, include_text=True).select("doc_id", "title", "page_range.first", "page_range.last", F.array_join(F.transform("metadata.dates", lambda d: d.cast("string")), ",").alias("dates"), "text")


def party_list(spark, sf_dir):
    return catalog.party_list(rendered(spark, sf_dir).select(F.array("party").alias("parties")))


def document_types(spark, sf_dir):
    return catalog.type_counts(rendered(spark, sf_dir))


def storage_statistics(spark, sf_dir):
    out = catalog.statistics(stored(spark, sf_dir), _scanned(packets(spark, sf_dir)))
    return out.withColumn("average_pages", F.round("average_pages", 6))


def saved_tables(spark, sf_dir):
    """The tables of a store as saved and without a fifth of its documents: rows and distinct documents of each."""
    docs = rendered(spark, sf_dir)
    path = fresh_path(spark, "saved-store")
    catalog.save(docs, packets(spark, sf_dir), _edges(docs), path)
    tables = catalog.saved(spark, path)
    less = catalog.remove(tables, tables["documents"].where("doc_id % 5 = 0").select("doc_id"))
    counts = [t.agg(F.lit(name).alias("name"), F.lit(state).alias("state"), F.count("*").alias("n")) for state, found in (("saved", tables), ("removed", less)) for name, t in found.items()]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


def status_updates(spark, sf_dir):
    docs = rendered(spark, sf_dir).select("doc_id", F.lit("pending").alias("status"), F.lit(None).cast("date").alias("updated_at"))
    ids = docs.where("doc_id % 3 = 0").select("doc_id").unionByName(docs.where("doc_id % 6 = 0").select((F.col("doc_id") * -1).alias("doc_id")))
    return library.set_status(docs, ids, "indexed", F.lit(AS_OF).cast("date"))


def orphan_files(spark, sf_dir):
    docs = rendered(spark, sf_dir)
    files = docs.select(F.concat(F.lit("/out/"), (F.col("doc_id") * 2).cast("string"), F.lit(".pdf")).alias("path"), F.lit("extracted").alias("kind")).unionByName(
        docs.select(F.concat(F.lit("/in/"), (F.col("pdf_id") + F.col("doc_id") % 3 * 200).cast("string"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".pdf")), F.lit("source")).toDF("path", "kind")
    )
    return library.orphans(files, docs)


def missing_pages(spark, sf_dir):
    """Pages that no predicted range holds, some ranges reaching behind the end or ending before they start."""
    pages = packets(spark, sf_dir)
    truth = segment.islands(pages, "is_first").where("(start_page + pdf_id) % 3 != 0")
    moved = truth.select("pdf_id", "start_page", (F.col("end_page") + F.when(F.col("start_page") % 5 == 0, 2).when(F.col("start_page") % 5 == 1, -2).otherwise(0)).alias("end_page"))
    out = evaluate.missing_pages(moved, pages.groupBy("pdf_id").agg(F.count("*").alias("n_pages")))
    return out.select("pdf_id", F.array_join("missing", ",").alias("missing"), F.round("percent", 4).alias("percent"))


def single_documents(spark, sf_dir):
    return segment.whole_pdfs(packets(spark, sf_dir).groupBy("pdf_id").agg(F.count("*").alias("n_pages")))


def first_documents(spark, sf_dir):
    return segment.first_ranges(segment.islands(packets(spark, sf_dir), "is_first"), 5)


def resegmented(spark, sf_dir):
    """Documents of hand-made ranges, of which some overlap: every 4 pages a range of 6."""
    pages = packets(spark, sf_dir)
    n = pages.groupBy("pdf_id").agg(F.count("*").alias("n"))
    ranges = n.select("pdf_id", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1, F.lit(4))).alias("start_page"), "n").select("pdf_id", "start_page", F.least(F.col("start_page") + 5, F.col("n") - 1).cast("int").alias("end_page"))
    out = segment.assemble(pages, ranges)
    return out.select("pdf_id", "page_start", "page_end", "page_count", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def extracted_pages(spark, sf_dir):
    """The pages of each document, numbered anew, as a PDF of that document has them."""
    pages = packets(spark, sf_dir)
    return segment.paged(pages.select("pdf_id", "page_num", "doc_id"), segment.islands(pages, "is_first")).select("pdf_id", "page_num", "doc_id", "page_number")


def blank_before(spark, sf_dir):
    return segment.blank_before(packets(spark, sf_dir))


def _mixed_pages(spark, sf_dir) -> DataFrame:
    """Packets with time stamps, forms, long and bare pages, sheets that go on and threads among them."""
    n = F.col("page_num")
    day = F.concat(F.lit("Monday, March 4, 2024 10:1"), (n % 10).cast("string"), F.lit(" AM\n"))
    text = (
        F.when(n % 11 == 3, F.concat(day, F.col("text"))).when(n % 11 == 5, F.concat(F.lit("Attention: all\nProject #: 5\n"), F.col("text"))).when(n % 11 == 7, F.repeat("text", 12)).when(n % 13 == 4, F.lit("Page 3 of 9"))
        .when(n % 13 == 6, F.concat(F.lit("See attached. "), F.col("text"))).when(n % 13 >= 10, F.concat(F.lit("From: a@b.org\nSubject: RE: "), F.when(n % 13 == 12, "Lot").otherwise("lot"), F.lit(" 5\n"), F.col("text"))).otherwise(F.col("text"))
    )
    return packets(spark, sf_dir).withColumn("text", text)


def strong_starts(spark, sf_dir):
    return segment.strong_starts(_mixed_pages(spark, sf_dir), pagechain.form_start(F.col("text")))


def driven_ranges(spark, sf_dir):
    pages = _mixed_pages(spark, sf_dir)
    return segment.driven(pages, segment.page_start(F.col("text"), F.col("page_num")), pagechain.form_start(F.col("text")))


def joined_pairs(spark, sf_dir):
    pages = _mixed_pages(spark, sf_dir)
    return segment.merge_pairs(segment.pair_flags(segment.islands(pages, "is_first"), pages))


def density_jumps(spark, sf_dir):
    return segment.density_jump(_mixed_pages(spark, sf_dir)).select("pdf_id", "page_num", "jump")


def scanned_pdfs(spark, sf_dir):
    bare = F.when((F.col("page_num") + F.col("pdf_id")) % 3 != 0, "  12 ").otherwise(F.col("text"))
    return segment.scanned_pdfs(packets(spark, sf_dir).withColumn("text", bare))


def damped_scores(spark, sf_dir):
    scores = packets(spark, sf_dir).select("pdf_id", "page_num", ((F.col("doc_id") * 7 + F.col("page_num") * 3) % 10 / 10).alias("score"))
    return segment.damp_spikes(scores).select("pdf_id", "page_num", F.round("confidence", 6).alias("confidence"))


def range_violations(spark, sf_dir):
    pages = packets(spark, sf_dir)
    truth = segment.islands(pages, "is_first")
    moved = truth.select("pdf_id", (F.col("start_page") - (F.col("start_page") % 5 == 0).cast("int")).alias("start_page"), (F.col("end_page") + (F.col("end_page") % 7 == 0).cast("int")).alias("end_page"))
    return segment.violations(moved, pages.groupBy("pdf_id").agg(F.count("*").alias("n_pages")))


def chunk_votes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("label"), (F.pmod(F.floor("value"), F.lit(100)) / 100).alias("confidence"))
    return classify.chunk_votes(e, "user_id").withColumn("score", F.round("score", 6))


def _predicted(spark, sf_dir) -> DataFrame:
    """Ranges of four pages beside each other, whatever the documents are."""
    n = packets(spark, sf_dir).groupBy("pdf_id").agg(F.count("*").alias("n"))
    return n.select("pdf_id", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(4))).alias("start_page")).select("pdf_id", "start_page", F.least(F.col("start_page") + 3, F.col("n") - 1).alias("end_page"))


def micro_metrics(spark, sf_dir):
    out = evaluate.micro(evaluate.range_metrics(_predicted(spark, sf_dir), segment.islands(packets(spark, sf_dir), "is_first")))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


def method_comparison(spark, sf_dir):
    found, truth = detected(spark, sf_dir)
    methods = {"fixed": _predicted(spark, sf_dir), "pages": found}
    parts = [evaluate.range_metrics(p, truth).withColumn("method", F.lit(m)) for m, p in methods.items()]
    out = evaluate.compare_methods(parts[0].unionByName(parts[1]))
    return out.select("method", "n_pred", "n_true", "exact", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"), F.round("mean_iou", 5).alias("mean_iou"))


def contested_matches(spark, sf_dir):
    """Greedy matches from an IoU of 0.2 on: fixed ranges of four pages compete for true ranges of one to three."""
    out = evaluate.greedy_matches(_predicted(spark, sf_dir), segment.islands(packets(spark, sf_dir), "is_first"), 0.2)
    return out.withColumn("iou", F.round("iou", 6))


def close_matches(spark, sf_dir):
    """Ranges of segment_pages against the true ones: hits share over 0.8 of the longer range."""
    found, truth = detected(spark, sf_dir)
    out = evaluate.close_matches(truth, found)
    return out.select("pdf_id", "n_true", "n_pred", "hits", "false_positives", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def ensemble_labels(spark, sf_dir):
    """Labels of two scorers of each document, joined: the fraction scorer stands for the model, the phrase scorer for the rules."""
    docs = classify.fraction_classifier(rendered(spark, sf_dir)).select("doc_id", "text", F.col("label").alias("ai_label"), F.round("confidence", 6).alias("ai_conf"), F.col("alternatives").alias("ai_alternatives"))
    both = classify.phrase_classifier(docs).select("doc_id", "ai_label", "ai_conf", "ai_alternatives", F.col("label").alias("rule_label"), F.round("confidence", 6).alias("rule_conf"))
    both = both.withColumn("rule_alternatives", F.array(F.struct(F.lit(0.5).alias("score"), F.col("rule_label").alias("label")), F.struct(F.lit(0.25).alias("score"), F.lit("letter").alias("label"))))
    out = classify.ensemble(both)
    return out.select("doc_id", "label", F.round("confidence", 6).alias("confidence"), F.array_join(F.transform("alternatives", lambda a: a["label"]), ",").alias("alternatives"))


def feature_signs(spark, sf_dir):
    """Dates, references and phrases among the features of a document."""
    f = classify.features(rendered(spark, sf_dir))
    return f.select("doc_id", "has_dates", F.array_join("reference_numbers", ";").alias("refs"), F.array_join("key_phrases", ";").alias("phrases"))


def label_errors(spark, sf_dir):
    pages = packets(spark, sf_dir)
    kinds = rendered(spark, sf_dir).select("doc_id", "type", "text")
    firsts = segment.islands(pages, "is_first").join(pages.select("pdf_id", F.col("page_num").alias("start_page"), "doc_id"), ["pdf_id", "start_page"]).join(kinds, "doc_id")
    truth = firsts.select("pdf_id", "start_page", "end_page", F.col("type").alias("label"))
    return evaluate.label_errors(firsts.select("pdf_id", "start_page", "end_page", classify.keyword_type(F.col("text")).alias("label")), truth)


def explained(spark, sf_dir):
    return cascade.explanations(segment.islands(packets(spark, sf_dir), "is_first"), "PATTERN")


def fallback_types(spark, sf_dir):
    """The label of a model for a third of the documents, rules for those with a text, unknown for the others."""
    docs = rendered(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 5 != 4, F.col("text")).alias("text"))
    says = F.col("doc_id") % 3 == 0
    out = classify.fallback(docs, F.when(says, "letter"), F.when(says & (F.col("doc_id") % 2 == 0), F.lit(0.9)))
    return out.select("doc_id", "label", F.round("confidence", 6).alias("confidence"), "method")


def first_signs(spark, sf_dir):
    s = classify.first_signs(F.col("text"), 1, 2)
    return rendered(spark, sf_dir).select("doc_id", F.array_join(s["references"], ";").alias("refs"), F.array_join(s["phrases"], ";").alias("phrases"))


def phrase_search(spark, sf_dir):
    docs = rendered(spark, sf_dir).withColumn("text", F.replace("text", F.lit("completion"), F.lit("cömpletion")))
    f = store.SearchFilter(query='"substantial completion of" -lot* OR "amount due in" OR party:000000012 "time extension"', sort_by="doc_id", descending=False, limit=None)
    return store.search(docs, f).select("doc_id", "type")


def routes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    mode = F.element_at(F.array(F.lit("full_local"), F.lit("full_cloud"), F.lit("hybrid")), (F.col("event_id") % 3 + 1).cast("int"))
    flag = lambda k: F.floor(F.col("event_id") / k) % 2 == 0
    return e.select("event_id", T.route(mode, flag(3), flag(6), flag(12)).alias("provider"))


def party_name_forms(spark, sf_dir):
    """Normal names of several spellings of supplier names."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.regexp_replace("s_name", "[^0-9]", "").alias("k"))
    forms = F.array(F.concat(F.lit("ACME ELEC. "), F.col("k")), F.concat(F.lit("Lot "), F.col("k"), F.lit(" Dev, Inc.")), F.concat(F.lit(" No. "), F.col("k"), F.lit("   mech  + plumb")), F.concat(F.lit("Smith Bros L. L. C. "), F.col("k"), F.lit(",")))
    return s.select("s_suppkey", T.normal_name(F.element_at(forms, (F.col("s_suppkey") % 4 + 1).cast("int"))).alias("name"))


_FUNCTIONS = (
    document_lookup, source_documents, document_list, document_detail, party_list, document_types, storage_statistics, saved_tables, status_updates, orphan_files, missing_pages, single_documents, first_documents,
    resegmented, extracted_pages, blank_before, strong_starts, driven_ranges, joined_pairs, density_jumps, scanned_pdfs, damped_scores, range_violations, chunk_votes, micro_metrics, method_comparison,
    contested_matches, close_matches, ensemble_labels, feature_signs, label_errors, explained, fallback_types, first_signs, phrase_search, routes, party_name_forms,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

# SQL -------------------------------------------------------------------------------------------------------------

_W, _P = "WITH " + RENDERED_SQL, "WITH " + PACKETS_SQL
_STORED = PACKETS_SQL + """, places AS (SELECT doc_id, (min(page_num) + 1)::INT AS page_start, (max(page_num) + 1)::INT AS page_end FROM packets GROUP BY doc_id),
stored AS (SELECT r.*, page_start, page_end, page_end - page_start + 1 AS page_count,
  CASE type WHEN 'rfi' THEN 'Rfi' WHEN 'change_order' THEN 'Change Order' WHEN 'daily_report' THEN 'Daily Report' ELSE upper(type[1]) || type[2:] END || ' ' || doc_id AS title FROM rendered r JOIN places USING (doc_id))"""
_EDGES = """, steps AS (SELECT doc_id, unnest([1, 2, 3]) AS step FROM rendered),
edges AS (SELECT doc_id AS source_id, doc_id * step AS target_id, ['responds_to', 'references', 'related'][(doc_id + step) % 3 + 1] AS kind FROM steps WHERE doc_id * step IN (SELECT doc_id FROM rendered))"""
_TRUTH = PACKETS_SQL + """, flags AS (SELECT *, sum((is_first OR page_num = 0)::INT) OVER (PARTITION BY pdf_id ORDER BY page_num) AS seg FROM packets),
truth AS (SELECT pdf_id, min(page_num)::BIGINT AS start_page, max(page_num)::BIGINT AS end_page FROM flags GROUP BY pdf_id, seg),
totals AS (SELECT pdf_id, count(*) AS n_pages FROM packets GROUP BY pdf_id)"""
_FIXED = _TRUTH + """, cuts AS (SELECT pdf_id, n_pages, unnest(range(0, n_pages, 4)) AS start_page FROM totals),
pred AS (SELECT pdf_id, start_page, least(start_page + 3, n_pages - 1) AS end_page FROM cuts),
met AS (
  SELECT p.pdf_id, p.start_page AS ps, p.end_page AS pe, t.start_page AS ts, t.end_page AS te, least(p.end_page, t.end_page) - greatest(p.start_page, t.start_page) + 1 AS shared,
    (least(p.end_page, t.end_page) - greatest(p.start_page, t.start_page) + 1)::DOUBLE / (greatest(p.end_page, t.end_page) - least(p.start_page, t.start_page) + 1) AS iou
  FROM pred p JOIN truth t ON p.pdf_id = t.pdf_id AND p.start_page <= t.end_page AND t.start_page <= p.end_page)"""
_MIXED = PACKETS_SQL + """, mixed AS (SELECT pdf_id, page_num, is_first,
  CASE WHEN page_num % 11 = 3 THEN 'Monday, March 4, 2024 10:1' || page_num % 10 || ' AM' || chr(10) || text WHEN page_num % 11 = 5 THEN 'Attention: all' || chr(10) || 'Project #: 5' || chr(10) || text
    WHEN page_num % 11 = 7 THEN repeat(text, 12) WHEN page_num % 13 = 4 THEN 'Page 3 of 9' WHEN page_num % 13 = 6 THEN 'See attached. ' || text
    WHEN page_num % 13 >= 10 THEN 'From: a@b.org' || chr(10) || 'Subject: RE: ' || CASE WHEN page_num % 13 = 12 THEN 'Lot' ELSE 'lot' END || ' 5' || chr(10) || text ELSE text END AS text FROM packets)"""


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def kinds_sql(text: str) -> str:
    """A list of the pattern groups of a page, in order, as SQL."""
    tests = []
    for kind, patterns in segment.GROUPS.items():
        hit = f"regexp_matches({text}[1:1500], '(?i){_q('|'.join(f'(?:{p})' for p in patterns))}')"
        if kind == "DRAWING":
            hit = f"({hit} OR regexp_matches({text}[1:1500], '{_q(segment.DRAWING_NUMBER)}'))"
        tests.append(f"CASE WHEN {hit} THEN '{kind}' END")
    return f"list_filter([{', '.join(tests)}], lambda x: x IS NOT NULL)"


def start_sql(text: str, page: str) -> str:
    """Whether a page starts a document, as SQL."""
    bold = "|".join(f"(?:{p})" for p in segment.AGGRESSIVE)
    line = "length(trim(x)) > 10 AND upper(x) = x AND lower(x) != x AND len(regexp_extract_all(x, '\\S+')) <= 5"
    return rf"""(length(trim({text})) >= 20 AND (({page} > 0 AND regexp_matches({text}[1:600], '(?im){_q(bold)}')) OR len({kinds_sql(text)}) > 0
  OR regexp_matches({text}, '(?i)Page\s*1\s*(of|/)') OR len(list_filter(string_split({text}, chr(10))[1:5], lambda x: {line})) > 0))"""


_FORMS = " + ".join(f"regexp_matches(text[1:1000], '(?im){_q(p)}')::INT" for p in pagechain.FORM_SIGNS)
_STRONG = _MIXED + rf""", facts AS (SELECT pdf_id, page_num, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS n, regexp_matches(text[1:500], '{_q(segment.TIME_STAMP)}') AS stamp,
  regexp_matches(text[1:500], 'From:|To:|Subject:|@') AS mail, {_FORMS} >= 2 AS form FROM mixed),
before AS (SELECT *, lag(n) OVER o AS pn, lag(stamp) OVER o AS pstamp, lag(mail) OVER o AS pmail FROM facts WINDOW o AS (PARTITION BY pdf_id ORDER BY page_num)),
strong AS (SELECT pdf_id, page_num, coalesce((stamp AND NOT pstamp) OR (pmail AND form) OR (pn > 50 AND ((pn > 1000 AND n < 200) OR (pn < 200 AND n > 1000))), false) AS is_strong FROM before)"""
_METRICS = f"""b AS (SELECT pdf_id, ps, pe, max(iou) AS iou FROM met GROUP BY ALL),
m AS (SELECT pdf_id, count(*) FILTER (WHERE iou = 1) AS exact, count(*) FILTER (WHERE iou > 0.5) AS partial FROM met GROUP BY pdf_id),
n AS (SELECT coalesce(p.pdf_id, t.pdf_id) AS pdf_id, coalesce(p.n, 0) AS n_pred, coalesce(t.n, 0) AS n_true FROM (SELECT pdf_id, count(*) AS n FROM pred GROUP BY 1) p FULL JOIN (SELECT pdf_id, count(*) AS n FROM truth GROUP BY 1) t ON p.pdf_id = t.pdf_id),
j AS (SELECT n.*, coalesce(exact, 0) AS exact, coalesce(partial, 0) AS partial, coalesce(s.iou, 0) AS iou FROM n LEFT JOIN m USING (pdf_id) LEFT JOIN (SELECT pdf_id, {exact_sum('iou')} AS iou FROM b GROUP BY 1) s USING (pdf_id))"""
_PAGES = _TRUTH + f""", starts AS (SELECT pdf_id, page_num, sum(({start_sql('text', 'page_num')} OR page_num = 0)::INT) OVER (PARTITION BY pdf_id ORDER BY page_num) AS seg FROM packets),
pred AS (SELECT pdf_id, min(page_num)::BIGINT AS start_page, max(page_num)::BIGINT AS end_page FROM starts GROUP BY pdf_id, seg),
met AS (
  SELECT p.pdf_id, p.start_page AS ps, p.end_page AS pe, t.start_page AS ts, t.end_page AS te,
    (least(p.end_page, t.end_page) - greatest(p.start_page, t.start_page) + 1)::DOUBLE / (greatest(p.end_page, t.end_page) - least(p.start_page, t.start_page) + 1) AS iou
  FROM pred p JOIN truth t ON p.pdf_id = t.pdf_id AND p.start_page <= t.end_page AND t.start_page <= p.end_page)"""
_SUM = """SELECT '{m}' AS method, sum(n_pred)::BIGINT AS n_pred, sum(n_true)::BIGINT AS n_true, sum(exact)::BIGINT AS exact, round(sum(exact) / sum(n_pred), 6)::DOUBLE AS precision, round(sum(exact) / sum(n_true), 6)::DOUBLE AS recall,
  round(2.0 * sum(exact) / (sum(n_pred) + sum(n_true)), 6)::DOUBLE AS f1, round(""" + exact_sum("iou / n_pred") + """ / count(*), 5)::DOUBLE AS mean_iou FROM j"""


def _phrases_sql() -> str:
    """(doc_id, rank, label, score) of the phrase scorer."""
    flags = {"money": r"regexp_matches(text, '\$\s*\d')", "signed": "regexp_matches(low, 'signature|signed|authorized by|approved by')", "form": "regexp_matches(low, 'form|application|check one|☐|□|yes/no')"}
    extra = {"invoice": [("money", 0.2)], "change_order": [("money", 0.1), ("signed", 0.1)], "contract": [("signed", 0.15)], "rfi": [("form", 0.1)]}
    rows = []
    for i, (kind, words) in enumerate(classify.PHRASES.items()):
        refs = rf"len(regexp_extract_all(text, '(?i)\b{kind}\s*#?\s*(\d+)')) * 0.4::DOUBLE" if kind in ("rfi", "invoice", "contract") else "0::DOUBLE"
        hits = " + ".join(f"contains(low, '{w}')::INT" for w in words)
        gains = "".join(f" + CASE WHEN {flags[f]} THEN {g}::DOUBLE ELSE 0 END" for f, g in extra.get(kind, ()))
        rows.append(f"SELECT doc_id, {i} AS rank, '{kind}' AS label, {refs} + ({hits}) / {len(words)}::DOUBLE * {0.6 if kind == 'email' else 0.3}::DOUBLE{gains} AS score FROM lowered")
    rows.append(f"SELECT doc_id, {len(rows)}, 'submittal', CASE WHEN {flags['form']} THEN 0.1::DOUBLE ELSE 0 END FROM lowered")
    return " UNION ALL ".join(rows)


_LABELS = f"""lowered AS (SELECT *, lower(text) AS low FROM rendered), scored AS ({_phrases_sql()}),
best AS (SELECT doc_id, label, score FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, rank) = 1)"""
_LABEL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{k}'" for k, words in classify.MARKERS) + " ELSE 'unknown' END"
_WORDS = list(dict.fromkeys(w for group in classify.PHRASES.values() for w in group))


def _repairs_sql(text: str) -> str:
    for pairs, flags in ((quality.TERM_REPAIRS, "gi"), (quality.DATE_REPAIRS, "g")):
        for pattern, by in pairs:
            text = f"regexp_replace({text}, '{pattern}', '{re.sub(r'\$(\d)', r'\\\1', by)}', '{flags}')"
    return text


def _count_sql(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def _measures_sql(t: str) -> str:
    words, n, lines = _count_sql(t, r"\S+"), f"length({t})", f"({_count_sql(t, r'\n')} + 1)"
    capital = rf"len(list_filter(regexp_extract_all({t}, '\S+'), lambda x: regexp_matches(x, '^\p{{Lu}}')))"
    return f"[({n} - {lines} + 1) / {lines}::DOUBLE, {capital} / nullif({words}, 0)::DOUBLE, {_count_sql(t, '[.!?,:;]')} / nullif({n}, 0)::DOUBLE, {_count_sql(t, r'\d+')} / nullif({words}, 0)::DOUBLE]"


def _topics_sql(t: str) -> str:
    return rf"list_distinct(list_filter(regexp_extract_all(lower({t}), '\b[a-z]{{3,}}\b'), lambda w: length(w) > 3 AND w NOT IN ({', '.join(repr(w) for w in context.STOPWORDS)})))"


_SIGNS = ", ".join(
    [f"CASE WHEN regexp_matches(head, '{p}') THEN 'strong_start: {p}' END" for p in context.STRONG] + [f"CASE WHEN regexp_matches(tail, '{p}') THEN 'weak_end: {p}' END" for p in context.WEAK]
)
ORACLE_SQL = {
    "document_lookup": f"""{_W}{_EDGES}, e AS (SELECT kind, string_agg(target_id::VARCHAR, ',' ORDER BY target_id) AS ids FROM edges WHERE source_id = {LOOKED_UP} GROUP BY kind)
SELECT doc_id, type, created, coalesce((SELECT ids FROM e WHERE kind = 'responds_to'), '') AS responds_to, coalesce((SELECT ids FROM e WHERE kind = 'references'), '') AS "references", coalesce((SELECT ids FROM e WHERE kind = 'related'), '') AS related
FROM rendered WHERE doc_id = {LOOKED_UP}""",
    "source_documents": f"WITH {_STORED} SELECT doc_id, type, page_start, page_end, page_count FROM stored WHERE pdf_id = {SOURCE} ORDER BY page_start",
    "document_list": f"WITH {_STORED} SELECT doc_id, title, type, page_count, created, party AS parties, amount FROM stored WHERE type = 'invoice' ORDER BY created DESC, doc_id LIMIT 20 OFFSET 40",
    "document_detail": f"WITH {_STORED} SELECT doc_id, title, page_start AS first, page_end AS last, created::VARCHAR AS dates, text FROM stored WHERE doc_id = {LOOKED_UP}",
    "party_list": "SELECT DISTINCT c_name AS party FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY party",
    "document_types": _W + " SELECT ordinal, v.type, count(doc_id) AS n FROM (VALUES " + ", ".join(f"({i}::INT, '{t}')" for i, t in enumerate(catalog.TYPES)) + ") AS v(ordinal, type) LEFT JOIN rendered r ON r.type = v.type GROUP BY ALL",
    "storage_statistics": f"""WITH {_STORED} SELECT count(*) AS n_docs, count(DISTINCT pdf_id) AS n_pdfs, sum(page_count)::BIGINT AS total_pages, round(sum(page_count) / count(*), 6)::DOUBLE AS average_pages, count(*) FILTER (WHERE doc_id % 3 = 0) AS with_embedding,
  min(created) AS earliest, max(created) AS latest, max(created + (doc_id % 5)::INT) FILTER (WHERE doc_id % 4 != 0) AS last_indexed, (SELECT count(DISTINCT doc_id) FROM packets WHERE page_num % 4 = 3) AS with_ocr FROM stored""",
    "saved_tables": rf"""{_P}{_EDGES}, fields AS (SELECT doc_id, unnest(['type', 'party', 'text']) AS field, unnest([type, party, text]) AS words FROM rendered),
words AS (SELECT DISTINCT doc_id, field, unnest(regexp_split_to_array(lower(words), '[^\p{{L}}\p{{N}}]+')) AS token FROM fields)
SELECT name, state, n FROM (
  SELECT 'documents' AS name, count(*) AS saved, count(*) FILTER (WHERE doc_id % 5 != 0) AS removed FROM rendered UNION ALL SELECT 'pages', count(*), count(*) FILTER (WHERE doc_id % 5 != 0) FROM packets
  UNION ALL SELECT 'edges', count(*), count(*) FILTER (WHERE source_id % 5 != 0 AND target_id % 5 != 0) FROM (SELECT DISTINCT * FROM edges) UNION ALL SELECT 'postings', count(*), count(*) FILTER (WHERE doc_id % 5 != 0) FROM words WHERE token != '')
UNPIVOT (n FOR state IN (saved, removed))""",
    "status_updates": f"{_W} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'indexed' ELSE 'pending' END AS status, CASE WHEN doc_id % 3 = 0 THEN DATE '{AS_OF}' END AS updated_at FROM rendered",
    "orphan_files": f"""{_W}, k AS (SELECT '/out/' || doc_id * 2 || '.pdf' AS path, 'extracted' AS kind FROM rendered WHERE doc_id * 2 NOT IN (SELECT doc_id FROM rendered)
  UNION ALL SELECT '/in/' || (pdf_id + doc_id % 3 * 200) || '_' || doc_id || '.pdf', 'source' FROM rendered WHERE pdf_id + doc_id % 3 * 200 NOT IN (SELECT pdf_id FROM rendered)) SELECT path, kind FROM k""",
    "single_documents": f"WITH {_TRUTH} SELECT pdf_id, 0 AS start_page, (n_pages - 1)::INT AS end_page FROM totals",
    "first_documents": f"WITH {_TRUTH} SELECT pdf_id, start_page, end_page FROM truth QUALIFY row_number() OVER (PARTITION BY pdf_id ORDER BY start_page) <= 5",
    "resegmented": f"""WITH {_TRUTH}, cuts AS (SELECT pdf_id, n_pages, unnest(range(0, n_pages, 4)) AS s FROM totals), r AS (SELECT pdf_id, s, least(s + 5, n_pages - 1) AS e FROM cuts)
SELECT r.pdf_id, (s + 1)::INT AS page_start, (e + 1)::INT AS page_end, count(*)::INT AS page_count, md5(string_agg(text, chr(10) || chr(10) ORDER BY page_num)) AS text_md5 FROM r JOIN packets p ON p.pdf_id = r.pdf_id AND page_num BETWEEN s AND e GROUP BY r.pdf_id, s, e""",
    "extracted_pages": f"WITH {_TRUTH} SELECT p.pdf_id, page_num, doc_id, (page_num - start_page + 1)::INT AS page_number FROM packets p JOIN truth t ON p.pdf_id = t.pdf_id AND page_num BETWEEN start_page AND end_page",
    "blank_before": rf"""{_P}, b AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM packets), f AS (SELECT pdf_id, page_num, length(t) < 100 AND NOT regexp_matches(t, '^\s*\d+\s*$') AND NOT regexp_matches(t, '(?i)Page\s+\d+') AS blank FROM b)
SELECT pdf_id, page_num, coalesce(lag(blank) OVER (PARTITION BY pdf_id ORDER BY page_num), false) AS blank_before FROM f""",
    "strong_starts": f"WITH {_STRONG} SELECT pdf_id, page_num, is_strong FROM strong",
    "driven_ranges": f"""WITH {_STRONG}, s AS (SELECT pdf_id, page_num, {start_sql('text', 'page_num')} OR page_num = 0 OR is_strong AS is_start FROM mixed JOIN strong USING (pdf_id, page_num)),
g AS (SELECT *, sum(is_start::INT) OVER (PARTITION BY pdf_id ORDER BY page_num) AS seg FROM s) SELECT pdf_id, min(page_num) AS start_page, max(page_num) AS end_page FROM g GROUP BY pdf_id, seg""",
    "joined_pairs": rf"""WITH RECURSIVE {_MIXED}, flags AS (SELECT *, sum((is_first OR page_num = 0)::INT) OVER (PARTITION BY pdf_id ORDER BY page_num) AS seg FROM mixed),
r AS (SELECT pdf_id, seg, min(page_num) AS start_page, max(page_num) AS end_page, string_agg(text, '' ORDER BY page_num) AS body, arg_min(text, page_num)[1:1000] AS head FROM flags GROUP BY pdf_id, seg),
c AS (SELECT pdf_id, start_page, end_page, end_page - start_page < 2 AND regexp_matches(body, '(?i){_q("|".join(segment.GOES_ON))}') AS goes_on,
  CASE WHEN regexp_matches(head, '{_q(segment.SUBJECT_LINE)}') THEN lower(regexp_replace(trim(regexp_extract(head, '{_q(segment.SUBJECT_LINE)}', 1)), '(?i)^(RE:|FW:|Fwd:)\s*', '')) END AS subject FROM r),
o AS (SELECT *, row_number() OVER w AS n, lead(start_page) OVER w AS ns, lead(end_page) OVER w AS ne, coalesce(subject = lead(subject) OVER w, false) AS thread FROM c WINDOW w AS (PARTITION BY pdf_id ORDER BY start_page)),
f AS (SELECT *, ns IS NOT NULL AND (goes_on OR thread) AS m FROM o),
k AS (SELECT pdf_id, n, start_page, CASE WHEN m THEN ne ELSE end_page END AS end_page, n + 1 + m::INT AS follow FROM f WHERE n = 1
  UNION ALL SELECT f.pdf_id, f.n, f.start_page, CASE WHEN f.m THEN f.ne ELSE f.end_page END, f.n + 1 + f.m::INT FROM k JOIN f ON f.pdf_id = k.pdf_id AND f.n = k.follow)
SELECT pdf_id, start_page, end_page FROM k""",
    "density_jumps": f"""WITH {_MIXED}, n AS (SELECT pdf_id, page_num, length(trim(text)) AS n FROM mixed), b AS (SELECT *, lag(n) OVER (PARTITION BY pdf_id ORDER BY page_num) AS p FROM n)
SELECT pdf_id, page_num, coalesce(p > 50 AND ((p > 1000 AND n < 200) OR (p < 200 AND n > 1000)), false) AS jump FROM b""",
    "scanned_pdfs": f"{_P} SELECT pdf_id, count(*) FILTER (WHERE (page_num + pdf_id) % 3 != 0 OR length(trim(text)) < 10) >= least(3, count(*)) AS scanned FROM packets WHERE page_num < 5 GROUP BY pdf_id",
    "damped_scores": f"""{_P}, s AS (SELECT pdf_id, page_num, ((doc_id * 7 + page_num * 3) % 10) / 10.0::DOUBLE AS s FROM packets), b AS (SELECT *, lag(s) OVER o AS p, lead(s) OVER o AS n FROM s WINDOW o AS (PARTITION BY pdf_id ORDER BY page_num))
SELECT pdf_id, page_num, round(CASE WHEN s > 0.4 AND s < 0.6 AND p < 0.3 AND n < 0.3 THEN s * 0.7::DOUBLE ELSE s END, 6) AS confidence FROM b""",
    "range_violations": f"""WITH {_TRUTH}, m AS (SELECT pdf_id, start_page - (start_page % 5 = 0)::INT AS start_page, end_page + (end_page % 7 = 0)::INT AS end_page FROM truth),
b AS (SELECT *, lag(end_page) OVER (PARTITION BY pdf_id ORDER BY start_page, end_page) AS before FROM m)
SELECT pdf_id, start_page, end_page FROM b JOIN totals USING (pdf_id) WHERE start_page < 0 OR start_page > end_page OR end_page >= n_pages OR before >= start_page""",
    "chunk_votes": f"""WITH e AS (SELECT user_id, event_type AS label, (((floor(value)::BIGINT % 100) + 100) % 100) / 100.0::DOUBLE AS c FROM events), n AS (SELECT user_id, count(*) AS n FROM e GROUP BY 1),
s AS (SELECT user_id, label, {exact_sum('c')} / any_value(n) AS score FROM e JOIN n USING (user_id) GROUP BY user_id, label)
SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY score DESC, label))::INT AS rank, label, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, label) <= 3""",
    "micro_metrics": f"WITH {_FIXED}, {_METRICS} SELECT sum(n_pred)::BIGINT AS n_pred, sum(n_true)::BIGINT AS n_true, sum(exact)::BIGINT AS exact, round(sum(exact) / sum(n_pred), 6)::DOUBLE AS precision, round(sum(exact) / sum(n_true), 6)::DOUBLE AS recall FROM j",
    "method_comparison": f"SELECT * FROM (WITH {_FIXED}, {_METRICS} {_SUM.format(m='fixed')}) UNION ALL SELECT * FROM (WITH {_PAGES}, {_METRICS} {_SUM.format(m='pages')})",
    "contested_matches": f"""WITH RECURSIVE {_FIXED}, c AS (SELECT *, row_number() OVER (PARTITION BY pdf_id ORDER BY ps, pe, iou DESC, ts, te) AS n FROM met WHERE iou >= 0.2),
k AS (SELECT pdf_id, n, [(ps, -1)] AS preds, [(ts, -1)] AS trues, ps, pe, ts, te, iou, true AS taken FROM c WHERE n = 1
  UNION ALL SELECT c.pdf_id, c.n, CASE WHEN list_contains(preds, (c.ps, -1)) OR list_contains(trues, (c.ts, -1)) THEN preds ELSE list_append(preds, (c.ps, -1)) END,
    CASE WHEN list_contains(preds, (c.ps, -1)) OR list_contains(trues, (c.ts, -1)) THEN trues ELSE list_append(trues, (c.ts, -1)) END, c.ps, c.pe, c.ts, c.te, c.iou,
    NOT (list_contains(preds, (c.ps, -1)) OR list_contains(trues, (c.ts, -1))) FROM k JOIN c ON c.pdf_id = k.pdf_id AND c.n = k.n + 1)
SELECT pdf_id, ps, pe, ts, te, round(iou, 6) AS iou FROM k WHERE taken""",
    "close_matches": f"""WITH {_PAGES}, x AS (SELECT *, (least(pe, te) - greatest(ps, ts) + 1)::DOUBLE / (greatest(pe - ps, te - ts) + 1) AS share FROM met),
k AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY pdf_id, ts, te ORDER BY share DESC, ps, pe) = 1),
h AS (SELECT pdf_id, count(*) AS hits, count(DISTINCT (ps, pe)) AS used FROM k WHERE share > 0.8 GROUP BY 1),
n AS (SELECT coalesce(t.pdf_id, p.pdf_id) AS pdf_id, coalesce(t.n, 0) AS n_true, coalesce(p.n, 0) AS n_pred FROM (SELECT pdf_id, count(*) AS n FROM truth GROUP BY 1) t FULL JOIN (SELECT pdf_id, count(*) AS n FROM pred GROUP BY 1) p ON t.pdf_id = p.pdf_id),
j AS (SELECT n.*, coalesce(hits, 0) AS hits, n_pred - coalesce(used, 0) AS false_positives FROM n LEFT JOIN h USING (pdf_id)),
r AS (SELECT *, coalesce(hits::DOUBLE / nullif(hits + false_positives, 0), 0) AS p, coalesce(hits::DOUBLE / nullif(n_true, 0), 0) AS r FROM j)
SELECT pdf_id, n_true, n_pred, hits, false_positives, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM r""",
    "feature_signs": rf"""{_W} SELECT doc_id, {' OR '.join(f"regexp_matches(text, '{p}')" for p in classify.DATE_SHAPES)} AS has_dates,
  array_to_string(list_concat({', '.join(f"list_transform(regexp_extract_all(text, '{p}', 1), lambda x: '{k}_' || x)" for k, _, p in classify.REFERENCE_MENTIONS)})[1:10], ';') AS refs,
  array_to_string(list_filter([{', '.join(f"'{w}'" for group in classify.PHRASES.values() for w in group)}], lambda x: contains(lower(text), x))[1:20], ';') AS phrases FROM rendered""",
    "ensemble_labels": f"""{_W}, {_LABELS}, fr AS ({_FRACTIONS}), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, rank) AS n FROM fr),
b AS (
  SELECT f.doc_id, f.label AS ai, round(least(f.score * 2, 1.0), 6)::DOUBLE AS ac, CASE WHEN best.score > 0 THEN best.label ELSE 'unknown' END AS ru, round(CASE WHEN best.score > 0 THEN least(best.score, 1) ELSE 0 END, 6)::DOUBLE AS rc
  FROM f JOIN best USING (doc_id) WHERE n = 1),
alts AS (SELECT doc_id, label, score * 0.6 AS s, n FROM f WHERE n <= 3 AND score > 0 UNION ALL SELECT doc_id, ru, 0.5 * 0.4, 1000 FROM b UNION ALL SELECT doc_id, 'letter', 0.25 * 0.4, 1001 FROM b),
g AS (SELECT doc_id, label, round(sum(s::DECIMAL(38, 15)), 9) AS s, min(n) AS n FROM alts GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, n) AS k FROM g)
SELECT doc_id, any_value(CASE WHEN ai = ru THEN ai WHEN rc > 0.7 AND ac < 0.6 THEN ru WHEN ac > 0.8 OR ac >= rc THEN ai ELSE ru END) AS label,
  any_value(round(CASE WHEN ai = ru THEN least(ac * 1.2, 1) WHEN rc > 0.7 AND ac < 0.6 THEN rc * 0.9 WHEN ac > 0.8 THEN ac * 0.9 WHEN ac >= rc THEN ac * 0.7 + rc * 0.3 ELSE rc * 0.7 + ac * 0.3 END, 6))::DOUBLE AS confidence,
  string_agg(t.label, ',' ORDER BY k) FILTER (WHERE k <= 3) AS alternatives FROM b JOIN t USING (doc_id) GROUP BY doc_id""",
    "missing_pages": f"""WITH {_TRUTH}, m AS (SELECT pdf_id, start_page, end_page + CASE start_page % 5 WHEN 0 THEN 2 WHEN 1 THEN -2 ELSE 0 END AS end_page FROM truth WHERE (start_page + pdf_id) % 3 != 0),
h AS (SELECT DISTINCT pdf_id, unnest(range(start_page, end_page + 1)) AS page_num FROM m),
p AS (SELECT pdf_id, page_num, h.page_num IS NULL AS open FROM packets LEFT JOIN h USING (pdf_id, page_num))
SELECT pdf_id, coalesce(string_agg(page_num::VARCHAR, ',' ORDER BY page_num) FILTER (WHERE open), '') AS missing, round(100.0 * count(*) FILTER (WHERE NOT open) / count(*), 4)::DOUBLE AS percent FROM p GROUP BY 1""",
    "label_errors": f"""WITH {_TRUTH}, d AS (SELECT t.*, row_number() OVER (PARTITION BY t.pdf_id ORDER BY start_page) AS n, r.type, {_LABEL.replace('text', 'r.text')} AS label FROM truth t JOIN packets p ON p.pdf_id = t.pdf_id AND p.page_num = start_page JOIN rendered r USING (doc_id))
SELECT type AS expected, label AS actual, count(*) AS n, type = label AS correct FROM d GROUP BY ALL""",
    "explained": f"WITH {_TRUTH} SELECT pdf_id, start_page AS page_num, 'Detected using pattern analysis' AS reason FROM truth",
    "fallback_types": f"""{_W}, {_LABELS} SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'letter' WHEN doc_id % 5 = 4 OR score = 0 THEN 'unknown' ELSE label END AS label,
  round(CASE WHEN doc_id % 6 = 0 THEN 0.9 WHEN doc_id % 5 = 4 THEN 0 ELSE least(score, 1) END, 6)::DOUBLE AS confidence, CASE WHEN doc_id % 6 = 0 THEN 'model' WHEN doc_id % 5 = 4 THEN 'none' ELSE 'rules' END AS method FROM best""",
    "first_signs": rf"""{_W} SELECT doc_id, array_to_string(regexp_extract_all(text, '(?i)\b(?:rfi|invoice|contract|submittal|change order)\s*#?\s*\d+')[1:1], ';') AS refs,
  array_to_string(list_filter([{', '.join(f"'{w}'" for w in _WORDS)}], lambda x: contains(lower(text), x))[1:2], ';') AS phrases FROM rendered""",
    "phrase_search": f"{_W} SELECT doc_id, type FROM rendered WHERE (text LIKE '%Substantial completion of%' AND text NOT LIKE '%lot%') OR text LIKE '%amount due in%' OR (party LIKE '%#000000012' AND text LIKE '%time extension%') ORDER BY doc_id",
    "routes": """WITH e AS (SELECT event_id, event_id % 3 AS m, (event_id // 3) % 2 = 0 AS s, (event_id // 6) % 2 = 0 AS l, (event_id // 12) % 2 = 0 AS c FROM events)
SELECT event_id, CASE WHEN m = 0 OR s THEN CASE WHEN l THEN 'local' ELSE 'none' END WHEN m = 1 AND c THEN 'cloud' WHEN l THEN 'local' WHEN c THEN 'cloud' ELSE 'none' END AS provider FROM e""",
    "party_name_forms": """WITH k AS (SELECT s_suppkey, regexp_replace(s_name, '[^0-9]', '', 'g') AS k FROM supplier)
SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Acme Electric ' || k WHEN 1 THEN 'Lot ' || k || ' Development Incorporated' WHEN 2 THEN 'No. ' || k || ' mechanical and plumbing' ELSE 'Smith Brothers LLC ' || k END AS name FROM k""",
    # of queries in the other module
    "page_kinds": f"{_P} SELECT pdf_id, page_num, array_to_string({kinds_sql('text')}, ',') AS kinds FROM packets",
    "segment_pages": f"WITH {_PAGES} SELECT pdf_id, start_page, end_page FROM pred",
    "detector_metrics": f"""WITH {_PAGES}, {_METRICS} SELECT pdf_id, n_pred, n_true, exact, n_true - exact AS missed, n_pred - exact AS extra, partial, round(coalesce(iou / nullif(n_pred, 0), 0), 4)::DOUBLE AS mean_iou,
  round(coalesce(2.0 * exact / nullif(n_pred + n_true, 0), 0), 6)::DOUBLE AS f1 FROM j""",
    "assemble_documents": f"""WITH {_TRUTH} SELECT sha256(t.pdf_id || ':' || start_page || ':' || end_page) AS id, t.pdf_id, start_page + 1 AS page_start, end_page + 1 AS page_end, count(*)::INT AS page_count, md5(string_agg(text, chr(10) || chr(10) ORDER BY page_num)) AS text_md5
FROM truth t JOIN packets p ON p.pdf_id = t.pdf_id AND page_num BETWEEN start_page AND end_page GROUP BY t.pdf_id, start_page, end_page""",
    "merge_pairs": f"""WITH RECURSIVE {_TRUTH}, o AS (SELECT *, row_number() OVER w AS n, lead(end_page) OVER w AS ne FROM truth WINDOW w AS (PARTITION BY pdf_id ORDER BY start_page)), f AS (SELECT *, ne IS NOT NULL AND (end_page + pdf_id) % 3 != 0 AS m FROM o),
k AS (SELECT pdf_id, n, start_page, CASE WHEN m THEN ne ELSE end_page END AS end_page, n + 1 + m::INT AS follow FROM f WHERE n = 1
  UNION ALL SELECT f.pdf_id, f.n, f.start_page, CASE WHEN f.m THEN f.ne ELSE f.end_page END, f.n + 1 + f.m::INT FROM k JOIN f ON f.pdf_id = k.pdf_id AND f.n = k.follow)
SELECT pdf_id, start_page, end_page FROM k""",
    "classify_phrases": f"{_W}, {_LABELS} SELECT doc_id, CASE WHEN score > 0 THEN label ELSE 'unknown' END AS label, round(CASE WHEN score > 0 THEN least(score, 1) ELSE 0 END, 6)::DOUBLE AS confidence FROM best",
    "extract_metadata": rf"""{_W}, m AS (SELECT doc_id, type, text, created, len(list_distinct(list_filter(regexp_extract_all(text, '\$\s*(\d{{1,3}}(?:,\d{{3}})*(?:\.\d{{2}})?)\b', 1), lambda x: replace(x, ',', '')::DOUBLE > 0)))::INT AS n_amounts,
  regexp_extract_all(text, '(?i)\bRFI\s*#?\s*(\d+)\b', 1) AS rfi, regexp_extract_all(text, '(?i)\b(?:Change\s+Order|CO)\s*#?\s*(\d+)\b', 1) AS co, regexp_extract_all(text, '(?i)\bInvoice\s*#?\s*(\d+)\b', 1) AS inv,
  regexp_extract_all(text, '(?i)\bProject\s*(?:#|No\.?|Number):\s*([A-Z0-9-]+)\b', 1) AS project, regexp_extract_all(text, '(?i)\bContract\s*(?:#|No\.?|Number)?\s*([A-Z0-9-]+)\b', 1) AS contract,
  regexp_extract(text, '(?i)Subject:\s*([^\n]+)', 1) AS subject, regexp_extract(text, '(?i)RE:\s*([^\n]+)', 1) AS about FROM rendered)
SELECT doc_id, CASE WHEN type = 'rfi' THEN 'RFI #' || rfi[1] WHEN type = 'change_order' THEN 'Change Order #' || co[1] WHEN type = 'invoice' THEN 'Invoice #' || inv[1] WHEN length(subject) BETWEEN 6 AND 199 THEN subject WHEN length(about) BETWEEN 6 AND 199 THEN about ELSE 'Daily Report' END AS title,
  created AS date, n_amounts, array_to_string(list_concat(list_transform(rfi, lambda x: 'RFI ' || x), list_transform(co, lambda x: 'Change Order #' || x), list_transform(inv, lambda x: 'Invoice #' || x), list_transform(project, lambda x: 'Project #' || x), list_transform(contract, lambda x: 'Contract #' || x)), ';') AS refs,
  project[1] AS project_number FROM m""",
    "text_quality": r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, length(t)::INT AS n, round(coalesce(len(regexp_extract_all(t, '\d'))::DOUBLE / nullif(length(t), 0), 0), 6)::DOUBLE AS digits, round(coalesce(len(regexp_extract_all(t, '\S'))::DOUBLE / nullif(len(regexp_extract_all(t, '\S+')), 0), 0), 4)::DOUBLE AS word_len FROM t""",
    "conversation_windows": """WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{4,}')) AS w, row_number() OVER o AS n FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT a.conv_id, a.turn, a.w, coalesce(b.w, []) AS v FROM w a LEFT JOIN w b ON a.conv_id = b.conv_id AND a.n = b.n + 1)
SELECT conv_id, turn, round(coalesce(len(list_intersect(w, v))::DOUBLE / nullif(len(list_distinct(list_concat(w, v))), 0), 0), 6)::DOUBLE AS likeness FROM p""",
    "smart_windows": """WITH RECURSIVE %s, f AS MATERIALIZED (SELECT pdf_id, page_num, NOT is_first AS unsure, count(*) OVER (PARTITION BY pdf_id) AS n FROM packets),
k AS (SELECT * FROM f WHERE page_num = 0 UNION ALL SELECT f.* FROM k JOIN f ON f.pdf_id = k.pdf_id AND f.page_num = k.page_num + CASE WHEN k.unsure THEN 1 ELSE 2 END)
SELECT pdf_id, page_num::INT AS window_start, (least(page_num + 3, n) - 1)::INT AS window_end, CASE WHEN unsure THEN 2.0 ELSE 1.0 END::DOUBLE AS priority FROM k""" % PACKETS_SQL,
    "merged_ranges": f"""WITH {_PAGES}, a AS (SELECT *, CASE WHEN end_page > start_page THEN 0.8 ELSE 0.6 END AS sure FROM truth),
sides AS (SELECT coalesce(a.pdf_id, p.pdf_id) AS pdf_id, coalesce(a.start_page, p.start_page) AS start_page, coalesce(a.end_page, p.end_page) AS end_page, a.pdf_id IS NOT NULL AS in_a, p.pdf_id IS NOT NULL AS in_b, sure
  FROM a FULL JOIN pred p ON a.pdf_id = p.pdf_id AND a.start_page = p.start_page AND a.end_page = p.end_page),
shares AS (SELECT pdf_id, count(*) FILTER (WHERE in_a AND in_b) / greatest(count(*) FILTER (WHERE in_a), 1) AS agreed FROM sides GROUP BY 1),
held AS (SELECT sides.*, max(end_page) OVER (PARTITION BY pdf_id ORDER BY start_page, end_page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sides JOIN shares USING (pdf_id) WHERE in_b OR (agreed > 0.7 AND sure > 0.8)),
runs AS (SELECT *, sum((before IS NULL OR start_page > before)::INT) OVER (PARTITION BY pdf_id ORDER BY start_page, end_page) AS run FROM held),
whole AS (SELECT pdf_id, min(start_page) AS start_page, max(end_page) AS end_page FROM runs GROUP BY pdf_id, run)
SELECT pdf_id, start_page, end_page, CASE WHEN in_a AND in_b THEN 0.9 WHEN in_b THEN 0.8 ELSE 0.7 END::DOUBLE AS confidence FROM whole LEFT JOIN sides USING (pdf_id, start_page, end_page)""",
    "repaired_texts": rf"{_W} SELECT doc_id, md5(regexp_replace(regexp_replace({_repairs_sql("translate(text, '1', 'l')")}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM rendered",
    "boundary_indicators": f"""{_P}, pairs AS (SELECT pdf_id, page_num, lag(text) OVER (PARTITION BY pdf_id ORDER BY page_num) AS b, text AS a FROM packets),
facts AS (SELECT *, left(a, 200) AS head, right(b, 200) AS tail, {_topics_sql('a')} AS ta, {_topics_sql('b')} AS tb, {_measures_sql('a')} AS ma, {_measures_sql('b')} AS mb,
  {_count_sql('a', r'\S+')} AS na, {_count_sql('b', r'\S+')} AS nb FROM pairs WHERE b IS NOT NULL),
signs AS (SELECT *, len(ta) > 0 AND len(tb) > 0 AND len(list_intersect(ta, tb)) / greatest(len(list_distinct(list_concat(ta, tb))), 1)::DOUBLE < 0.3 AS topic,
  {' + '.join(f'coalesce(ma[{i}] > 0 AND mb[{i}] > 0 AND abs(ma[{i}] - mb[{i}]) / greatest(ma[{i}], mb[{i}]) > 0.5, false)::INT' for i in range(1, 5))} >= 2 AS form FROM facts)
SELECT pdf_id, page_num, concat_ws(';', {_SIGNS}, CASE WHEN topic THEN 'topic_change' END, CASE WHEN form THEN 'format_change' END) AS indicators,
  round((coalesce(least(na, nb) / nullif(greatest(na, nb), 0)::DOUBLE, 0) + least(1.0, {_count_sql('b', context.SENTENCES)} / 5.0::DOUBLE) + least(1.0, {_count_sql('a', context.SENTENCES)} / 5.0::DOUBLE)
  + least(1.0, ({_count_sql('b', context.NAMES)} + {_count_sql('a', context.NAMES)}) / 10.0::DOUBLE)) / 4, 6)::DOUBLE AS quality FROM signs""",
}
