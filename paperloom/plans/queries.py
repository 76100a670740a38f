"""Queries of the document engine over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import quality, replies
from ..functions import text as T
from ..functions.tables import kept
from ..operators import cascade, classify, context, evaluate, library, metadata, pagechain, parties, people, refined, segment, store, strategies
from .corpus import PACKETS_SQL, RENDERED_SQL, exact_sum, packets, rendered, table

AS_OF = "2024-06-30"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword classification of all rendered documents: counts and amounts by type and label."""
    docs = rendered(spark, sf_dir).withColumn("label", classify.keyword_type(F.col("text")))
    return docs.groupBy("type", "label").agg(F.count("*").alias("n"), F.round(F.sum(F.col("amount").cast("decimal(18,2)")), 2).cast("double").alias("total"))


def classify_keyword(spark, sf_dir):
    return rendered(spark, sf_dir).select("doc_id", classify.keyword_type(F.col("text")).alias("label"))


def classify_fraction(spark, sf_dir):
    return classify.fraction_classifier(rendered(spark, sf_dir)).select("doc_id", "label", F.round("confidence", 6).alias("confidence"), F.size("alternatives").alias("n_alternatives"))


def classify_phrases(spark, sf_dir):
    return classify.phrase_classifier(rendered(spark, sf_dir)).select("doc_id", "label", F.round("confidence", 6).alias("confidence"))


def classify_features(spark, sf_dir):
    return classify.features(rendered(spark, sf_dir)).select("doc_id", "text_length", "word_count", "has_numbers", "has_amounts", "has_signature", "has_forms", "has_tables")


def extract_dates(spark, sf_dir):
    docs = rendered(spark, sf_dir)
    return docs.select("doc_id", F.explode(metadata.plausible(metadata.dates(F.col("text")), F.lit(AS_OF).cast("date"))).alias("found"))


def extract_references(spark, sf_dir):
    docs = rendered(spark, sf_dir).select("doc_id", F.explode(metadata.references(F.col("text"))).alias("family", "numbers"))
    return docs.select("doc_id", "family", F.array_join("numbers", ",").alias("numbers"))


def extract_amounts(spark, sf_dir):
    return rendered(spark, sf_dir).select("doc_id", F.explode(metadata.amounts(F.col("text"))).alias("amount"))


def extract_emails(spark, sf_dir):
    return rendered(spark, sf_dir).select("doc_id", F.explode(metadata.emails(F.col("text"))).alias("email"))


def extract_keywords(spark, sf_dir):
    return rendered(spark, sf_dir).select("doc_id", F.array_join(metadata.keywords(F.col("text")), ",").alias("keywords"))


def extract_metadata(spark, sf_dir):
    out = metadata.extract(rendered(spark, sf_dir), F.lit(AS_OF).cast("date"))
    return out.select("doc_id", "metadata.title", "metadata.date", F.size("metadata.amounts").alias("n_amounts"), F.array_join("metadata.reference_numbers", ";").alias("refs"), "metadata.project_number")


def page_kinds(spark, sf_dir):
    return packets(spark, sf_dir).select("pdf_id", "page_num", F.array_join(segment.page_kinds(F.col("text")), ",").alias("kinds"))


def starts(spark, sf_dir) -> DataFrame:
    """Pages with is_start for ranges. Those begin at page 0 whatever is_start says there, so it is told by the text alone, before pages are numbered."""
    return packets(spark, sf_dir, is_start=segment.page_start(F.col("text"), F.lit(1)))


def _totals(pages: DataFrame) -> DataFrame:
    return pages.groupBy("pdf_id").agg(F.count("*").cast("int").alias("n_pages"))


def _truth(pages: DataFrame) -> DataFrame:
    return segment.islands(pages, "is_first")


def segment_pages(spark, sf_dir):
    return segment.islands(starts(spark, sf_dir))


def detected(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The ranges of segment_pages and the true ones, as tables: pages are read once for both, and each table as often as it is asked for."""
    pages = kept(starts(spark, sf_dir).select("pdf_id", "page_num", "is_first", "is_start"), "page-starts")
    return tuple(kept(segment.islands(pages, flag), "page-ranges") for flag in ("is_start", "is_first"))


def segment_truth(spark, sf_dir):
    return _truth(packets(spark, sf_dir))


def assemble_documents(spark, sf_dir):
    pages = packets(spark, sf_dir)
    return segment.assemble(pages, _truth(pages)).select("id", "pdf_id", "page_start", "page_end", "page_count", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _some_ranges(pages: DataFrame) -> DataFrame:
    return _truth(pages).where("(start_page + pdf_id) % 3 != 0")


def fill_gaps(spark, sf_dir):
    pages = packets(spark, sf_dir)
    return segment.fill_gaps(_some_ranges(pages), _totals(pages))


def coalesce_ranges(spark, sf_dir):
    return segment.coalesce_ranges(_some_ranges(packets(spark, sf_dir)))


def merge_pairs(spark, sf_dir):
    ranges = _truth(packets(spark, sf_dir)).withColumn("joins_next", (F.col("end_page") + F.col("pdf_id")) % 3 != 0)
    return segment.merge_pairs(ranges)


def page_windows(spark, sf_dir):
    return segment.windows(_totals(packets(spark, sf_dir)))


def range_metrics(spark, sf_dir):
    pages = packets(spark, sf_dir)
    out = evaluate.range_metrics(segment.coalesce_ranges(_some_ranges(pages)), _truth(pages))
    return out.select("pdf_id", "n_pred", "n_true", "exact", "missed", "extra", "partial", F.round("mean_iou", 4).alias("mean_iou"), F.round("f1", 6).alias("f1"))


def detector_metrics(spark, sf_dir):
    """The ranges of segment_pages, a detector's output, against the true ones."""
    out = evaluate.range_metrics(*detected(spark, sf_dir))
    return out.select("pdf_id", "n_pred", "n_true", "exact", "missed", "extra", "partial", F.round("mean_iou", 4).alias("mean_iou"), F.round("f1", 6).alias("f1"))


def best_overlap(spark, sf_dir):
    pages = packets(spark, sf_dir)
    return evaluate.best_overlap(_truth(pages), segment.coalesce_ranges(_some_ranges(pages)))


def page_coverage(spark, sf_dir):
    pages = packets(spark, sf_dir)
    return evaluate.coverage(_some_ranges(pages), _totals(pages))


def confusion(spark, sf_dir):
    docs = rendered(spark, sf_dir).select(F.col("type").alias("expected"), classify.keyword_type(F.col("text")).alias("actual"))
    return evaluate.confusion(docs)


def boundary_votes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("pdf_id"), (F.col("event_id") % 50).alias("page_num"), F.when(F.col("event_type") == "error", "screening").otherwise("deep").alias("source"), (F.pmod(F.floor("value"), F.lit(100)) / 100).alias("confidence"))
    return classify.boundary_votes(e, 0.5).withColumn("confidence", F.round("confidence", 6))


def majority_type(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id"), F.col("event_type").alias("label"), "event_id")
    return classify.majority(e, "user_id", "event_id")


def adjacent_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    before = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("before"))
    return e.join(before, "vec_id").select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("before")), 6).alias("cosine"))


def search_filtered(spark, sf_dir):
    f = store.SearchFilter(query="payment due -rfi", types=["invoice", "contract"], date_from="1995-01-01", amount_min=1000.0, sort_by="amount", limit=50)
    return store.search(rendered(spark, sf_dir), f).select("doc_id", "type", "created", "amount")


def search_fields(spark, sf_dir):
    index = store.postings(rendered(spark, sf_dir), ("type", "party", "text"))
    return store.matching(index, "type:invoice party:00000001* payment OR type:contract party:customer")


def token_index(spark, sf_dir):
    index = store.postings(rendered(spark, sf_dir))
    return index.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def store_stats(spark, sf_dir):
    return store.stats(rendered(spark, sf_dir)).select("n_docs", "n_pdfs", F.round("mean_amount", 2).alias("mean_amount"), "first", "last")


def facet_counts(spark, sf_dir):
    return store.facets(rendered(spark, sf_dir))


def upsert(spark, sf_dir):
    docs = rendered(spark, sf_dir).select("doc_id", "type", "amount", F.lit(0).alias("seq"))
    new = docs.where("doc_id % 7 = 0").select("doc_id", F.lit("other").alias("type"), "amount", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
    return store.merge(docs, new, "doc_id", "seq").groupBy("type", "seq").agg(F.count("*").alias("n"))


def bulk_delete(spark, sf_dir):
    docs = rendered(spark, sf_dir)
    ids = docs.where("doc_id % 5 = 0").select("doc_id").unionByName(docs.where("doc_id % 5 = 1").select((-F.col("doc_id") - 1).alias("doc_id")))
    return store.delete_outcomes(docs, ids).groupBy("outcome").agg(F.count("*").alias("n"))


def relationship_lists(spark, sf_dir):
    docs = rendered(spark, sf_dir).select("doc_id")
    kinds = F.element_at(F.array(F.lit("responds_to"), F.lit("references"), F.lit("related")), (F.col("doc_id") % 3 + 1).cast("int"))
    edges = docs.select(F.col("doc_id").alias("source_id"), (F.col("doc_id") * 2).alias("target_id"), kinds.alias("relationship_type"))
    out = store.neighbours(docs, store.related(edges, docs))
    return out.select("doc_id", *(F.array_join(k, ",").alias(k) for k in ("responds_to", "references", "related")))


def normal_names(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("ABC  Const. & Elec Co., "), F.col("s_name")).alias("name"))
    return s.select("s_suppkey", T.normal_name(F.col("name")).alias("name"))


def text_quality(spark, sf_dir):
    q = T.text_quality(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", q["n"].alias("n"), F.round(q["digits"], 6).alias("digits"), F.round(q["word_len"], 4).alias("word_len"))


def sensitive_docs(spark, sf_dir):
    return rendered(spark, sf_dir).select("doc_id", T.sensitive(F.col("text")).alias("sensitive"))


def documents_by_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


def recent_documents(spark, sf_dir):
    return rendered(spark, sf_dir).orderBy(F.desc("created"), "doc_id").limit(100).select("doc_id", "created", "type")


def conversation_windows(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    return c.select("conv_id", "turn", F.round(T.jaccard_words(F.col("text"), F.lag("text").over(order)), 6).alias("likeness"))


def quality_grades(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", quality.quality_score(F.col("text")).alias("score"), quality.quality_grade(F.col("text")).alias("grade"))


def repaired_texts(spark, sf_dir):
    misread = F.translate("text", "1", "l")
    return rendered(spark, sf_dir).select("doc_id", F.md5(quality.repair_terms(misread).cast("binary")).alias("text_md5"))


def chained_starts(spark, sf_dir):
    return pagechain.page_starts(packets(spark, sf_dir))


def cascade_gates(spark, sf_dir):
    pages = packets(spark, sf_dir)
    out = cascade.gates(cascade.with_confidence(_some_ranges(pages)), _totals(pages), cascade.bare_pdfs(pages))
    return out.withColumn("mean_confidence", F.round("mean_confidence", 6))


def merged_ranges(spark, sf_dir):
    found, true = detected(spark, sf_dir)
    return cascade.merge_llm(cascade.with_confidence(true), cascade.with_confidence(found), merge_adjacent=False)


def smart_windows(spark, sf_dir):
    pages = packets(spark, sf_dir)
    return cascade.smart_windows(pages.select("pdf_id", "page_num", F.when(F.col("is_first"), 0.9).otherwise(0.5).alias("confidence"), F.lit(False).alias("needs_deep")))


def type_strategies(spark, sf_dir):
    pages = packets(spark, sf_dir).withColumn("type", classify.keyword_type(F.col("text")))
    return strategies.judge(pages).select("pdf_id", "page_num", "kind", "goes_on.continues", "goes_on.reason", "starts.is_start", F.col("starts.confidence").alias("start_confidence"))


def merged_parties(spark, sf_dir):
    named = rendered(spark, sf_dir).select(F.regexp_replace("party", "0+", "").alias("name"), F.col("type").alias("role"), F.lit(None).cast("string").alias("email"), F.lit("").alias("phone"), F.col("pdf_id").cast("string").alias("company"))
    return parties.merge_parties(named).select("name", "role", "email", "phone", "company", F.array_join("aliases", "|").alias("aliases"))


def refined_starts(spark, sf_dir):
    return refined.page_starts(packets(spark, sf_dir)).select("pdf_id", "page_num", "is_start", "chain")


def refined_ranges(spark, sf_dir):
    return refined.ranges(packets(spark, sf_dir))


def similar_parties(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    names = s.select(F.lit(0).alias("key"), F.col("s_suppkey").alias("ord"), F.col("s_name").alias("name"))
    return parties.similar_groups(names).select("key", "canonical", F.array_join("members", "|").alias("members"))


def greedy_matches(spark, sf_dir):
    pages = packets(spark, sf_dir)
    return evaluate.greedy_matches(segment.coalesce_ranges(_some_ranges(pages)), _truth(pages), 0.51).withColumn("iou", F.round("iou", 6))


def first_overlap(spark, sf_dir):
    pages = packets(spark, sf_dir)
    return evaluate.first_overlap(segment.coalesce_ranges(_some_ranges(pages)), _truth(pages)).withColumn("accuracy", F.round("accuracy", 4))


def merge_fragments(spark, sf_dir):
    return segment.merge_fragments(_truth(packets(spark, sf_dir)))


def label_replies(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    name = F.element_at(F.array(*map(F.lit, replies.CATEGORIES)), (F.col("event_id") % len(replies.CATEGORIES) + 1).cast("int"))
    reply = F.when(F.col("event_id") % 7 == 0, "no idea").otherwise(F.concat(name, F.lit(" | "), (F.col("event_id") % 101).cast("string"), F.lit(" | as it says | so")))
    return e.select("event_id", replies.label_reply(reply).alias("r")).select("event_id", "r.category", "r.label", F.round("r.confidence", 6).alias("confidence"), "r.reason")


def screening_facts(spark, sf_dir):
    facts = replies.screening_facts(F.col("text"))
    return packets(spark, sf_dir).select("pdf_id", "page_num", *(v.alias(k) for k, v in facts.items()))


def document_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(replies.chunks(F.col("text"), 500, whole=True)).alias("place", "chunk"))
    return d.select("doc_id", "place", F.char_length("chunk").alias("n_chars"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


def word_windows(spark, sf_dir):
    d = rendered(spark, sf_dir).select("doc_id", "text", F.floor(F.char_length("text") / 2).cast("int").alias("position"))
    return context.windows(d).select("doc_id", "position", "before", "after")


def boundary_indicators(spark, sf_dir):
    found = context.page_boundaries(packets(spark, sf_dir))
    return found.select("pdf_id", "page_num", F.array_join("indicators", ";").alias("indicators"), F.round("quality", 6).alias("quality"))


def document_parties(spark, sf_dir):
    return people.document_parties(rendered(spark, sf_dir).select("doc_id", F.concat("text", F.lit("\nOwner: Lincoln School District\nJohn Smith <js@x.org>")).alias("text")), "doc_id")


def stored_documents(spark, sf_dir):
    docs = library.stored(metadata.extract(rendered(spark, sf_dir), F.lit(AS_OF).cast("date")))
    refs = F.array_join(F.transform(F.map_entries("metadata.reference_numbers"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")
    return docs.select("doc_id", "title", "status", refs.alias("refs"))


def pdf_summaries(spark, sf_dir):
    d = rendered(spark, sf_dir).select("pdf_id", "type", (F.col("doc_id") % 3).alias("n_scanned"), ((F.col("doc_id") % 100) / 100).alias("ocr_confidence"))
    out = library.pdf_summary(d)
    return out.select("pdf_id", "documents_found", F.map_values("page_classification")[0].alias("n_first_type"), "ocr_pages", F.round(F.col("average_confidence") * F.col("documents_found") * 100).cast("long").alias("confidence_sum"))


def cached_pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", library.cache_key(F.col("html"), F.array("url"), 300, "eng", ("minimal",)).alias("cache_key"))
    hits, misses = library.cached(p, p.where("page_id % 2 = 0").select("cache_key"))
    return hits.select("page_id", F.lit(True).alias("hit")).unionByName(misses.select("page_id", F.lit(False).alias("hit")))


_FUNCTIONS = (
    flagship, classify_keyword, classify_fraction, classify_phrases, classify_features, extract_dates, extract_references, extract_amounts, extract_emails, extract_keywords,
    extract_metadata, page_kinds, segment_pages, segment_truth, assemble_documents, fill_gaps, coalesce_ranges, merge_pairs, page_windows, range_metrics, detector_metrics, best_overlap, page_coverage,
    confusion, boundary_votes, majority_type, adjacent_cosine, search_filtered, search_fields, token_index, store_stats, facet_counts, upsert, bulk_delete, relationship_lists, normal_names,
    text_quality, sensitive_docs, documents_by_source, recent_documents, conversation_windows, quality_grades, repaired_texts, chained_starts, cascade_gates, merged_ranges,
    smart_windows, type_strategies, merged_parties, refined_starts, refined_ranges, similar_parties, greedy_matches, first_overlap, merge_fragments, label_replies, screening_facts,
    document_chunks, word_windows, boundary_indicators, document_parties, stored_documents, pdf_summaries, cached_pages,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_LABEL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{k}'" for k, words in classify.MARKERS) + " ELSE 'unknown' END"
_FRACTIONS = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS rank, '{k}' AS label, (" + " + ".join(f"contains(lower(text), '{w}')::INT" for w in words) + f") / {len(words)}.0::DOUBLE AS score FROM rendered" for i, (k, words) in enumerate(classify.FRACTION_WORDS.items())
)
_REFS = " UNION ALL ".join(f"SELECT doc_id, {i} AS rank, '{k}' AS family, list_distinct(regexp_extract_all(text, '{p}', 1)) AS numbers FROM rendered" for i, (k, p) in enumerate(metadata.REFERENCES.items()))
_TRUTH = PACKETS_SQL + """, flags AS (SELECT *, sum((is_first OR page_num = 0)::INT) OVER (PARTITION BY pdf_id ORDER BY page_num) AS seg FROM packets),
truth AS (SELECT pdf_id, min(page_num)::BIGINT AS start_page, max(page_num)::BIGINT AS end_page FROM flags GROUP BY pdf_id, seg),
kept_ranges AS (SELECT * FROM truth WHERE (start_page + pdf_id) % 3 != 0),
totals AS (SELECT pdf_id, count(*) AS n_pages FROM packets GROUP BY pdf_id),
reach AS (SELECT *, max(end_page) OVER (PARTITION BY pdf_id ORDER BY start_page, end_page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM kept_ranges),
marked AS (SELECT *, sum((r IS NULL OR start_page > r + 1)::INT) OVER (PARTITION BY pdf_id ORDER BY start_page, end_page) AS seg FROM reach),
pred AS (SELECT pdf_id, min(start_page) AS start_page, max(end_page) AS end_page FROM marked GROUP BY pdf_id, seg),
met AS (
  SELECT p.pdf_id, p.start_page AS ps, p.end_page AS pe, t.start_page AS ts, t.end_page AS te, least(p.end_page, t.end_page) - greatest(p.start_page, t.start_page) + 1 AS shared,
    (least(p.end_page, t.end_page) - greatest(p.start_page, t.start_page) + 1)::DOUBLE / (greatest(p.end_page, t.end_page) - least(p.start_page, t.start_page) + 1) AS iou
  FROM pred p JOIN truth t ON p.pdf_id = t.pdf_id AND p.start_page <= t.end_page AND t.start_page <= p.end_page)"""
_W = "WITH " + RENDERED_SQL
_TOKENS = _W + r""", words AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS token FROM rendered),
postings AS (SELECT token, doc_id, count(*) AS tf FROM words WHERE token != '' GROUP BY token, doc_id)"""
ORACLE_SQL = {
    "flagship": f"{_W} SELECT type, {_LABEL} AS label, count(*) AS n, round(sum(amount::DECIMAL(18, 2)), 2)::DOUBLE AS total FROM rendered GROUP BY ALL",
    "classify_keyword": f"{_W} SELECT doc_id, {_LABEL} AS label FROM rendered",
    "classify_fraction": f"{_W}, s AS ({_FRACTIONS}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, rank) AS n, count(*) FILTER (WHERE score > 0) OVER (PARTITION BY doc_id) AS hits FROM s) SELECT doc_id, label, round(least(score * 2, 1.0), 6)::DOUBLE AS confidence, least(hits, 3)::INT AS n_alternatives FROM r WHERE n = 1",
    "classify_features": rf"""{_W} SELECT doc_id, length(text)::INT AS text_length, len(regexp_extract_all(text, '\S+'))::INT AS word_count, regexp_matches(text, '\d') AS has_numbers, regexp_matches(text, '\$\s*\d') AS has_amounts,
regexp_matches(lower(text), 'signature|signed|authorized by|approved by') AS has_signature, regexp_matches(lower(text), 'form|application|check one|☐|□|yes/no') AS has_forms,
regexp_matches(lower(text), 'table|\||\t\t|column|row') OR len(regexp_extract_all(text, '\n')) > 10 AS has_tables FROM rendered""",
    "extract_dates": rf"""{_W}, f AS (
  SELECT doc_id, try_strptime(unnest(regexp_extract_all(text, '\b\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{4}}\b')), '%m/%d/%Y')::DATE AS found FROM rendered
  UNION ALL SELECT doc_id, try_strptime(unnest(regexp_extract_all(text, '\b\d{{4}}-\d{{1,2}}-\d{{1,2}}\b')), '%Y-%m-%d')::DATE FROM rendered)
SELECT DISTINCT doc_id, found FROM f WHERE year(found) BETWEEN 1990 AND 2029""",
    "extract_references": f"{_W}, r AS ({_REFS}) SELECT doc_id, family, array_to_string(numbers, ',') AS numbers FROM r WHERE len(numbers) > 0",
    "extract_amounts": rf"{_W}, a AS (SELECT doc_id, unnest(regexp_extract_all(text, '\$\s*(\d{{1,3}}(?:,\d{{3}})*(?:\.\d{{2}})?)\b', 1)) AS s FROM rendered) SELECT DISTINCT doc_id, replace(s, ',', '')::DOUBLE AS amount FROM a WHERE replace(s, ',', '')::DOUBLE > 0",
    "extract_emails": rf"{_W} SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}\b')) AS email FROM rendered",
    "extract_keywords": f"{_W} SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{k.lower()}') THEN '{k}' END" for k in metadata.KEYWORDS) + "], lambda x: x IS NOT NULL), ',') AS keywords FROM rendered",
    "segment_truth": f"WITH {_TRUTH} SELECT pdf_id, start_page, end_page FROM truth",
    "fill_gaps": f"""WITH {_TRUTH}, l AS (SELECT *, coalesce(lag(end_page) OVER (PARTITION BY pdf_id ORDER BY start_page), -1) AS before FROM kept_ranges),
e AS (SELECT pdf_id, max(end_page) AS last FROM kept_ranges GROUP BY pdf_id)
SELECT pdf_id, start_page, end_page FROM kept_ranges UNION ALL SELECT pdf_id, before + 1, start_page - 1 FROM l WHERE before + 1 <= start_page - 1
UNION ALL SELECT t.pdf_id, coalesce(last, -1) + 1, n_pages - 1 FROM totals t LEFT JOIN e USING (pdf_id) WHERE coalesce(last, -1) + 1 <= n_pages - 1""",
    "coalesce_ranges": f"WITH {_TRUTH} SELECT pdf_id, start_page, end_page FROM pred",
    "page_windows": f"WITH {_TRUTH}, w AS (SELECT pdf_id, n_pages, unnest(range(0, n_pages, 2)) AS window_start FROM totals) SELECT pdf_id, window_start::INT AS window_start, least(window_start + 2, n_pages - 1)::INT AS window_end FROM w",
    "range_metrics": f"""WITH {_TRUTH}, b AS (SELECT pdf_id, ps, pe, max(iou) AS iou FROM met GROUP BY ALL),
m AS (SELECT pdf_id, count(*) FILTER (WHERE iou = 1) AS exact, count(*) FILTER (WHERE iou > 0.5) AS partial FROM met GROUP BY pdf_id),
n AS (SELECT coalesce(p.pdf_id, t.pdf_id) AS pdf_id, coalesce(p.n, 0) AS n_pred, coalesce(t.n, 0) AS n_true FROM (SELECT pdf_id, count(*) AS n FROM pred GROUP BY 1) p FULL JOIN (SELECT pdf_id, count(*) AS n FROM truth GROUP BY 1) t ON p.pdf_id = t.pdf_id),
j AS (SELECT n.*, coalesce(exact, 0) AS exact, coalesce(partial, 0) AS partial, coalesce(s.iou, 0) AS iou FROM n LEFT JOIN m USING (pdf_id) LEFT JOIN (SELECT pdf_id, {exact_sum('iou')} AS iou FROM b GROUP BY 1) s USING (pdf_id))
SELECT pdf_id, n_pred, n_true, exact, n_true - exact AS missed, n_pred - exact AS extra, partial, round(coalesce(iou / nullif(n_pred, 0), 0), 4)::DOUBLE AS mean_iou,
  round(coalesce(2.0 * exact / nullif(n_pred + n_true, 0), 0), 6)::DOUBLE AS f1 FROM j""",
    "best_overlap": f"""WITH {_TRUTH}, k AS (SELECT *, row_number() OVER (PARTITION BY pdf_id, ts, te ORDER BY shared DESC, ps) AS n FROM met)
SELECT t.pdf_id, t.start_page AS ts, t.end_page AS te, k.ps, k.pe, k.shared FROM truth t LEFT JOIN k ON t.pdf_id = k.pdf_id AND t.start_page = k.ts AND t.end_page = k.te AND k.n = 1""",
    "page_coverage": f"WITH {_TRUTH}, c AS (SELECT pdf_id, sum(end_page - start_page + 1)::BIGINT AS covered FROM kept_ranges GROUP BY 1) SELECT t.pdf_id, coalesce(covered, 0) AS covered, n_pages - coalesce(covered, 0) AS missing FROM totals t LEFT JOIN c USING (pdf_id)",
    "confusion": f"{_W} SELECT type AS expected, {_LABEL} AS actual, count(*) AS n FROM rendered GROUP BY ALL",
    "boundary_votes": f"WITH e AS (SELECT user_id AS pdf_id, event_id % 50 AS page_num, CASE WHEN event_type = 'error' THEN 1.0 ELSE 1.5 END::DOUBLE AS w, (((floor(value)::BIGINT % 100) + 100) % 100) / 100.0::DOUBLE AS c FROM events), m AS (SELECT pdf_id, page_num, {exact_sum('c * w')} / {exact_sum('w')} AS confidence FROM e GROUP BY ALL) SELECT pdf_id, page_num, round(confidence, 6) AS confidence FROM m WHERE confidence >= 0.5 OR page_num = 0",
    "majority_type": "WITH p AS (SELECT user_id, event_type AS label, count(*) AS votes, min(event_id) AS first_seen FROM events GROUP BY ALL) SELECT user_id, label, votes FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, first_seen) = 1",
    "adjacent_cosine": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id + 1",
    "search_filtered": f"{_TOKENS}, m AS (SELECT doc_id FROM postings WHERE token IN ('payment', 'due') GROUP BY doc_id HAVING count(DISTINCT token) = 2) SELECT doc_id, type, created, amount FROM rendered WHERE type IN ('invoice', 'contract') AND created >= DATE '1995-01-01' AND amount >= 1000 AND doc_id IN (SELECT doc_id FROM m) AND doc_id NOT IN (SELECT doc_id FROM postings WHERE token = 'rfi') ORDER BY amount DESC, doc_id LIMIT 50",
    "search_fields": f"""{_TOKENS}, f AS (SELECT doc_id, type, regexp_split_to_array(lower(party), '[^\\p{{L}}\\p{{N}}]+') AS names FROM rendered)
SELECT doc_id FROM f WHERE type = 'invoice' AND len(list_filter(names, lambda x: starts_with(x, '00000001'))) > 0 AND doc_id IN (SELECT doc_id FROM postings WHERE token = 'payment') OR type = 'contract' AND list_contains(names, 'customer')""",
    "token_index": f"{_TOKENS} SELECT token, count(*) AS df, sum(tf)::BIGINT AS tf FROM postings GROUP BY token",
    "store_stats": f"{_W} SELECT count(*) AS n_docs, count(DISTINCT pdf_id) AS n_pdfs, round({exact_sum('amount')} / count(*), 2) AS mean_amount, min(created) AS first, max(created) AS last FROM rendered",
    "facet_counts": f"{_W}, y AS (SELECT *, year(created)::VARCHAR AS year FROM rendered) SELECT CASE grouping(type, year) WHEN 1 THEN 'type' WHEN 2 THEN 'year' ELSE 'type_year' END AS facet, concat_ws('/', type, year) AS value, count(*) AS n FROM y GROUP BY GROUPING SETS ((type), (year), (type, year))",
    "upsert": f"{_W} SELECT CASE WHEN doc_id % 7 = 0 THEN 'other' ELSE type END AS type, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 0 END AS seq, count(*) AS n FROM rendered GROUP BY ALL",
    "bulk_delete": f"{_W} SELECT CASE doc_id % 5 WHEN 0 THEN 'deleted' ELSE 'Document not found' END AS outcome, count(*) AS n FROM rendered WHERE doc_id % 5 < 2 GROUP BY ALL",
    "relationship_lists": f"{_W}, k AS (SELECT doc_id, CASE WHEN doc_id * 2 IN (SELECT doc_id FROM rendered) THEN (doc_id * 2)::VARCHAR ELSE '' END AS t FROM rendered) SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN t ELSE '' END AS responds_to, CASE doc_id % 3 WHEN 1 THEN t ELSE '' END AS \"references\", CASE doc_id % 3 WHEN 2 THEN t ELSE '' END AS related FROM k",
    "normal_names": "SELECT s_suppkey, 'ABC Construction And Electric Company ' || s_name AS name FROM supplier".replace("And", "and"),
    "sensitive_docs": rf"{_W} SELECT doc_id, regexp_matches(text, '(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{{2,}}|\$\s*\d|\b(?:confidential|privileged|attorney|settlement|ssn)\b') AS sensitive FROM rendered",
    "documents_by_source": "SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars, max(n_chars) AS longest FROM documents GROUP BY ALL",
    "recent_documents": f"{_W} SELECT doc_id, created, type FROM rendered ORDER BY created DESC, doc_id LIMIT 100",
    "quality_grades": r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT doc_id, text, length(text) AS n, len(regexp_extract_all(text, '\S+')) AS words, len(list_distinct(string_split(lower(text), ''))) AS kinds,
  len(regexp_extract_all(text, '[\p{L}\p{N}\s.,;:!?()\-\[\]{}/"'']')) AS fine, len(regexp_extract_all(text, '[^\x00-\x7F]')) AS garbage FROM t),
m AS (SELECT *, coalesce(kinds::DOUBLE / nullif(n, 0), 0) AS v, coalesce(fine::DOUBLE / nullif(n, 0), 0) AS r, coalesce(garbage::DOUBLE / nullif(n, 0), 0) AS g FROM c),
s AS (SELECT doc_id, text,
  CASE WHEN n >= 100 THEN 20 WHEN n >= 50 THEN 15 WHEN n >= 20 THEN 10 ELSE 0 END + CASE WHEN words >= 20 THEN 15 WHEN words >= 10 THEN 10 WHEN words >= 5 THEN 5 ELSE 0 END
  + CASE WHEN v >= 0.3 THEN 15 WHEN v >= 0.2 THEN 10 WHEN v >= 0.1 THEN 5 ELSE 0 END + CASE WHEN r >= 0.9 THEN 20 WHEN r >= 0.7 THEN 15 WHEN r >= 0.5 THEN 10 WHEN r >= 0.3 THEN 5 ELSE 0 END
  + CASE WHEN regexp_matches(text, '[A-Z][A-Z\s]{10,}') THEN 15 WHEN regexp_matches(text, '\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}|\$[\d,]+\.?\d*|\d+\.?\d*%') THEN 10 ELSE 0 END
  + CASE WHEN n = 0 THEN 0 WHEN g < 0.1 THEN 15 WHEN g < 0.3 THEN 10 WHEN g < 0.5 THEN 5 ELSE 0 END AS score FROM m)
SELECT doc_id, score::INT AS score, CASE WHEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 20 THEN 'UNUSABLE' WHEN score >= 85 THEN 'EXCELLENT' WHEN score >= 65 THEN 'GOOD' WHEN score >= 40 THEN 'POOR' ELSE 'UNUSABLE' END AS grade FROM s""",
    "cascade_gates": f"""WITH {_TRUTH}, c AS (SELECT pdf_id, count(*) AS n, {exact_sum('CASE WHEN end_page > start_page THEN 0.8 ELSE 0.6 END::DOUBLE * (end_page - start_page + 1)')} / sum(end_page - start_page + 1) AS mean FROM kept_ranges GROUP BY 1),
b AS (SELECT pdf_id, count(*) FILTER (WHERE length(trim(text)) < 50) >= count(*) * 0.6 AS bare FROM packets WHERE page_num < 5 GROUP BY 1),
j AS (SELECT t.pdf_id, n_pages::INT AS n_pages, coalesce(n, 0) AS n_docs, mean, coalesce(mean < 0.7, true) OR (n_pages >= 10 AND coalesce(n, 0) > n_pages / 1.5) AS odd, bare FROM totals t LEFT JOIN c USING (pdf_id) LEFT JOIN b USING (pdf_id)),
k AS (SELECT *, n_pages >= 10 AND (odd OR bare) AS needs_visual FROM j)
SELECT pdf_id, n_pages, n_docs, round(mean, 6) AS mean_confidence, needs_visual, n_pages >= 5 AND (odd OR NOT needs_visual) AS needs_llm FROM k""",
    "greedy_matches": f"WITH {_TRUTH} SELECT pdf_id, ps, pe, ts, te, round(iou, 6) AS iou FROM met WHERE iou >= 0.51",
    "first_overlap": f"""WITH {_TRUTH}, k AS (SELECT *, row_number() OVER (PARTITION BY pdf_id, ts, te ORDER BY ps, pe) AS n FROM met),
j AS (SELECT t.pdf_id, k.iou FROM truth t LEFT JOIN k ON t.pdf_id = k.pdf_id AND t.start_page = k.ts AND t.end_page = k.te AND k.n = 1),
g AS (SELECT pdf_id, count(*) AS n_true, count(*) FILTER (WHERE iou = 1) AS exact, count(*) FILTER (WHERE iou < 1) AS partial, count(*) FILTER (WHERE iou IS NULL) AS missed FROM j GROUP BY 1)
SELECT g.pdf_id, coalesce(n, 0) AS n_pred, n_true, exact, partial, missed, greatest(coalesce(n, 0) - n_true, 0) AS extra, round(exact / n_true * 100, 4) AS accuracy FROM g LEFT JOIN (SELECT pdf_id, count(*) AS n FROM pred GROUP BY 1) p ON g.pdf_id = p.pdf_id""",
    "merge_fragments": f"""WITH RECURSIVE {_TRUTH}, o AS (SELECT *, row_number() OVER (PARTITION BY pdf_id ORDER BY start_page) AS n, lead(start_page) OVER (PARTITION BY pdf_id ORDER BY start_page) AS ns, lead(end_page) OVER (PARTITION BY pdf_id ORDER BY start_page) AS ne FROM truth),
f AS (SELECT *, start_page = end_page AND ns IS NOT NULL AND ne - ns <= 2 AS m FROM o),
w AS (SELECT pdf_id, n, start_page, CASE WHEN m THEN ne ELSE end_page END AS end_page, n + 1 + m::INT AS follow FROM f WHERE n = 1
  UNION ALL SELECT f.pdf_id, f.n, f.start_page, CASE WHEN f.m THEN f.ne ELSE f.end_page END, f.n + 1 + f.m::INT FROM w JOIN f ON f.pdf_id = w.pdf_id AND f.n = w.follow)
SELECT pdf_id, start_page, end_page FROM w""",
    "label_replies": f"""WITH c AS (SELECT event_id, event_id % 7 = 0 AS none, [{", ".join(f"'{c}'" for c in replies.CATEGORIES)}][event_id % {len(replies.CATEGORIES)} + 1] AS category,
  [{", ".join(f"'{c}'" for c in replies.CATEGORIES.values())}][event_id % {len(replies.CATEGORIES)} + 1] AS label FROM events)
SELECT event_id, CASE WHEN none THEN 'Other' ELSE category END AS category, CASE WHEN none THEN 'other' ELSE label END AS label, CASE WHEN none THEN 0 ELSE round((event_id % 101) / 100, 6) END::DOUBLE AS confidence,
  CASE WHEN none THEN 'Could not parse response: no idea' ELSE 'as it says | so' END AS reason FROM c""",
    "screening_facts": f"""WITH {PACKETS_SQL}, h AS (SELECT *, lower(text[1:500]) AS low, string_split(text, chr(10))[1:20] AS lines FROM packets)
SELECT pdf_id, page_num::INT AS page_num, length(text)::INT AS text_length, len(list_filter(lines, lambda x: contains(x, '|'))) > 3 OR len(list_filter(lines, lambda x: contains(x, chr(9)))) > 5 AS has_table,
  regexp_matches(low, 'from:|to:|subject:|sent:') AS has_email_header, regexp_matches(low, 'invoice|rfi|submittal|change order|daily report|notice') AS has_doc_header FROM h""",
    "word_windows": f"""{_W}, w AS (SELECT doc_id, text, (length(text) // 2)::INT AS position, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x != '') AS words FROM rendered),
a AS (SELECT *, least(len(regexp_extract_all(text[1:position], '\\S+')), len(words) - 1) AS k FROM w), s AS (SELECT *, least(k, len(words) - k) AS size FROM a)
SELECT doc_id, position, array_to_string(words[k - size + 1:k], ' ') AS before, array_to_string(words[k + 1:k + size], ' ') AS after FROM s""",
    "stored_documents": f"""{_W} SELECT doc_id, CASE type WHEN 'rfi' THEN 'RFI #' || doc_id WHEN 'change_order' THEN 'Change Order #' || doc_id WHEN 'invoice' THEN 'Invoice #' || doc_id
    WHEN 'email' THEN 'Delay notice ' || doc_id WHEN 'letter' THEN 'Substantial completion of lot ' || doc_id ELSE 'Daily Report' END AS title, 'pending' AS status,
  CASE type WHEN 'rfi' THEN 'RFI=' || doc_id || ';Project=P-' || doc_id WHEN 'change_order' THEN 'Change=Order ' || doc_id || ';Contract=C-' || doc_id WHEN 'invoice' THEN 'Invoice=' || doc_id ELSE '' END AS refs FROM rendered""",
    "pdf_summaries": f"""{_W}, g AS (SELECT pdf_id, count(*) AS documents_found, sum(doc_id % 3)::BIGINT AS ocr_pages, sum(doc_id % 100)::BIGINT AS confidence_sum, min(type) AS t FROM rendered GROUP BY 1)
SELECT pdf_id, documents_found, (SELECT count(*) FROM rendered r WHERE r.pdf_id = g.pdf_id AND r.type = g.t) AS n_first_type, ocr_pages, confidence_sum FROM g""",
    "cached_pages": "WITH k AS (SELECT page_id, coalesce(html, '~null') AS h, coalesce(url, '~null') AS u FROM pages) SELECT page_id, (h, u) IN (SELECT (h, u) FROM k WHERE page_id % 2 = 0) AS hit FROM k",
    "merged_parties": f"{_W}, p AS (SELECT regexp_replace(c_name, '0+', '', 'g') AS name, type, pdf_id::VARCHAR AS company FROM (SELECT party AS c_name, type, pdf_id FROM rendered)) SELECT name, string_agg(DISTINCT type, ', ' ORDER BY type) AS role, NULL::VARCHAR AS email, NULL::VARCHAR AS phone, min(company) AS company, '' AS aliases FROM p GROUP BY name",
}
