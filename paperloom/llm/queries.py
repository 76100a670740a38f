"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, fingerprint, mixing, ngram_join, packing, phrases, quality, suffix_dedup, token_files, toxicity, warc
from .shared import fresh_path, kept


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file: in the folder TOKENIZERS_DIR names, or where its package lies."""
    if "TOKENIZERS_DIR" in os.environ:
        return os.path.join(os.environ["TOKENIZERS_DIR"], name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.join(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "copy_id", "n_links", "n_copies")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    formatted = kept(chat.format_conversations(turns.unionByName(extra)), "chat-formatted")
    return chat.read_back(formatted).drop("attachments", "attachment_tokens")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    counted = kept(quality.with_counts(docs, drop_text=True), "quality-counts")
    return quality.judge(counted).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode_digests(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), path, tokenizer("byte_bpe_50k.json"), end_id=2)
    return token_files.document_index(spark, path)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.with_copies(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_pages(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return warc.page_index(spark, path)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), digests=True)


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.scored_alignments(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1, checksums=True)


QUERIES = {
    f.__name__: f
    for f in (op1_ngram_jaccard_join, op2_chat_formatting, op3_quality_rules, op4_bpe, op5_token_files, op6_toxicity, op7_mixing, op8_warc, op9_fingerprints, op10_suffix_dedup, op11_cross_tokenizer_alignment, op12_phrase_collocations, op13_packing)
}

_WORDS = r"[^\x20\x09-\x0D]+"
ORACLE_SQL = {
    "op2_chat_formatting": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
x AS (
  SELECT *, len(regexp_extract_all(role, '[<\[]' || chr(8288) || '*[|/A-Za-z]')) + len(regexp_extract_all(text, '[<\[]' || chr(8288) || '*[|/A-Za-z]')) AS escapes FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(text) + escapes + length('<|turn><|says|><|end|>') + 1)::BIGINT AS formatted_chars
FROM x GROUP BY conv_id""",
    "op3_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, source, text, regexp_extract_all(text, '{_WORDS}') AS w FROM d),
g AS (
  SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i:i + 4]) AS n FROM g),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM h WHERE n > 1) GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
k AS (SELECT r, sum(n - 1) AS n FROM (SELECT r, line, count(*) AS n FROM l WHERE regexp_matches(line, '{_WORDS}') GROUP BY r, line) GROUP BY r),
b AS (
  SELECT w.doc_id, w.source, len(w.w) AS n_words, coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(w.text, '[#*$%&|<>]')) AS n_symbols, coalesce(k.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN k USING (r) LEFT JOIN c USING (r)),
f AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM b),
s AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM f GROUP BY source),
a AS (SELECT count(*)::DOUBLE AS k, sum(n) AS n, sum(f) AS f, sum(n * (f / n) * (f / n)) AS npp, sum(n * n) AS nn FROM s),
v AS (
  SELECT *, f / n AS m, (npp - n * (f / n) * (f / n) - (f / n) * (1 - f / n) * (k - 1)) / nullif(n - nn / n, 0) AS v FROM a),
p AS (SELECT m, CASE WHEN k >= 2 AND v > 0 THEN greatest(m * (1 - m) / v - 1, 1) ELSE n END AS weight FROM v),
j AS (SELECT s.source, (s.f + p.m * p.weight) / (s.n + p.weight) > 0.5 AS host_failed FROM s, p)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT j.host_failed AS kept
FROM f JOIN j ON f.source IS NOT DISTINCT FROM j.source""",
    "op7_mixing": rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORDS}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM s),
-- the sources whose cap binds first are those with the least cap over weight
o AS (
  SELECT *, 3.0 * source_size AS cap,
    coalesce(sum(3.0 * source_size) OVER before, 0) AS fixed, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS free, sum(source_size) OVER () AS total
  FROM w WINDOW before AS (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT arg_min((total - fixed) / free, cap / weight) FILTER (WHERE (total - fixed) / free * weight < cap) AS share FROM o),
t AS (SELECT source, source_size, least(coalesce(e.share, 0) * weight, cap)::DOUBLE AS target FROM o, e),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0.0 END AS rate FROM t)
SELECT d.doc_id, d.size, r.source_size, r.target,
  (d.size * (floor(r.rate) + (('0x' || substr(md5('7:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0 < r.rate - floor(r.rate))::INT))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source""",
    "op12_phrase_collocations": r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, unnest(list_transform(range(1, len(w) + 2 - k), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase, k
  FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, phrase, k, count(*)::HUGEINT AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
cuts AS (SELECT *, unnest(range(1, k)) AS j FROM c),
s AS (
  SELECT cuts.lang, cuts.phrase, cuts.k, cuts.a, cuts.j, l.a AS l, r.a AS r, (1000000 * cuts.a * cuts.a) // (l.a * r.a) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = array_to_string(cuts.w[1:cuts.j], ' ')
  JOIN f r ON r.lang = cuts.lang AND r.phrase = array_to_string(cuts.w[cuts.j + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
h AS (SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS held FROM (SELECT *, unnest([1, 2]) AS i FROM c WHERE k = 3) GROUP BY ALL),
k AS (SELECT b.* FROM b LEFT JOIN h USING (lang, phrase) WHERE h.held IS NULL OR 100 * h.held < 50 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n.n, score::BIGINT AS score
FROM k JOIN n USING (lang) QUALIFY rank <= 2000""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS winner FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  translate(to_base(('0x' || substr(h, 1, 10))::BIGINT, 32, 8) || to_base(('0x' || substr(h, 11, 10))::BIGINT, 32, 8)
    || to_base(('0x' || substr(h, 21, 10))::BIGINT, 32, 8) || to_base(('0x' || substr(h, 31, 10))::BIGINT, 32, 8),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM winner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM winner THEN winner END AS refers_to
FROM m""",
}
