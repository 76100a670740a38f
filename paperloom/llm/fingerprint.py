"""Merkle fingerprints of documents, with DataFrame functions only.

A paragraph is a line; its leaves are its clauses, cut after punctuation, and where a clause is longer than LONG code
points, further after the words and particles of CUT, and last after each PIECE code points. A leaf's node is the md5 of
its text, a paragraph's that of its leaves' nodes, a section's that of its paragraphs' nodes and the root that of its
sections' nodes, all of 128 bits: unlike texts differ up to the root. A section is a run of paragraphs that ends after a
node whose first hex digit is below 4, so an insertion moves no section but its own.

The fingerprint spells the tree: root|section;section, a section as node:paragraph,paragraph, a paragraph as
node=leaf leaf. To stay short it spells nodes of sections and paragraphs by 8 hex digits and leaves by 6, as a sketch:
roots test equality, the sketch tells how much is alike and where unlike branches are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import col, kept, ordered

LONG, PIECE = 160, 400
_CLAUSE = r"(?s)(?<=[.,;:!?|\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])(?=.)"
#: Places inside long clauses depend on what stands before them alone, so that an edit moves none but its own.
_CUT = r"(?s)(?<=[dgkmpy] |[\u306f\u3092\u306b\u7684\u4e86\u662f])(?=.)"
_PIECE = f"(?s).{{1,{PIECE}}}"
NODE, LEAF = 8, 6


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clauses(text: Column) -> Column:
    """The leaves' texts of each paragraph of a text (not null): together they are the paragraph. An empty one has an empty leaf."""

    def refined(parts: Column, most: int, finer) -> Column:
        return F.flatten(F.transform(parts, lambda c: F.when(F.char_length(c) > most, finer(c)).otherwise(F.array(c))))

    def cut(parts: Column) -> Column:
        by_words = refined(parts, LONG, lambda c: F.split(c, _CUT))
        short = refined(by_words, PIECE, lambda c: F.regexp_extract_all(c, F.lit(_PIECE), F.lit(0)))
        # a clause has no more code points than bytes, so few paragraphs are looked at again
        return F.when(F.exists(parts, lambda c: F.octet_length(c) > LONG), short).otherwise(parts)

    return F.transform(F.split(text, "\n"), lambda p: _let(F.split(p, _CLAUSE), cut))


def _node(children: Column) -> Column:
    return F.md5(children.cast("binary"))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; null and empty texts are one empty paragraph."""

    def paragraph(leaves: Column) -> Column:
        sketch = F.array_join(F.transform(leaves, lambda n: F.substring(n, 1, LEAF)), " ")
        return F.struct(_node(F.array_join(leaves, "")).alias("node"), sketch.alias("sketch"))

    def sections(paragraphs: Column) -> Column:
        # nodes and spellings side by side, cut at the same places
        end = lambda p: F.when(p["node"] < "4", ";").otherwise(",")
        nodes = F.array_join(F.transform(paragraphs, lambda p: F.concat(p["node"], end(p))), "")
        spelled = F.array_join(F.transform(paragraphs, lambda p: F.concat(F.substring(p["node"], 1, NODE), F.lit("="), p["sketch"], end(p))), "")
        own = F.transform(F.split(F.substring(nodes, F.lit(1), F.length(nodes) - 1), ";"), lambda s: _node(F.replace(s, F.lit(","), F.lit(""))))
        return F.arrays_zip(own.alias("node"), F.split(F.substring(spelled, F.lit(1), F.length(spelled) - 1), ";").alias("paragraphs"))

    def spell(found: Column) -> Column:
        top = _node(F.array_join(F.transform(found, lambda s: s["node"]), ""))
        return F.concat(top, F.lit("|"), F.array_join(F.transform(found, lambda s: F.concat(F.substring(s["node"], 1, NODE), F.lit(":"), s["paragraphs"])), ";"))

    leaf_nodes = F.transform(clauses(F.coalesce(text, F.lit(""))), lambda p: F.transform(p, _node))
    return _let(_let(F.transform(leaf_nodes, paragraph), sections), spell)


def root(fp: Column) -> Column:
    return F.substring(fp, 1, 32)


def leaves(fp: Column) -> Column:
    """The distinct leaf digests below a fingerprint's root."""
    return F.array_distinct(F.filter(F.split(F.translate(F.substring_index(fp, "|", -1), ",;:=", "    "), " "), lambda x: F.octet_length(x) == LEAF))


def likeness(a: Column, b: Column) -> Column:
    """Shared leaves over all leaves of two fingerprints: 1 where the roots are equal, and nowhere else."""

    def shared(x: Column) -> Column:
        n = F.size(x["a"]) + F.size(x["b"])
        both = F.size(F.array_intersect(x["a"], x["b"]))
        # texts of the same set of leaves in another order, or with others that look like them in the sketch, are unlike still
        return F.least(both / F.greatest(n - both, F.lit(1)).cast("double"), 1 - 1 / (n + 1).cast("double"))

    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(_let(F.struct(leaves(a).alias("a"), leaves(b).alias("b")), shared))


def changed_sections(a: Column, b: Column) -> Column:
    """Numbers of a's sections that b does not have, each with the numbers of its changed paragraphs; null if equal."""
    body_a, body_b = F.substring_index(a, "|", -1), F.substring_index(b, "|", -1)
    nodes_b = F.transform(F.split(body_b, ";"), lambda s: F.substring(s, 1, NODE))
    paragraphs_b = F.transform(F.split(F.regexp_replace(body_b, f"(^|;)[0-9a-f]{{{NODE}}}:", "$1"), "[;,]"), lambda p: F.substring(p, 1, NODE))

    def one(s: Column, i: Column) -> Column:
        own = F.split(F.substring_index(s, ":", -1), ",")
        flagged = F.transform(own, lambda p, k: F.when(~F.array_contains(paragraphs_b, F.substring(p, 1, NODE)), k))
        return F.struct(i.alias("section"), F.array_compact(flagged).alias("paragraphs"))

    noted = F.transform(F.split(body_a, ";"), lambda s, i: F.when(~F.array_contains(nodes_b, F.substring(s, 1, NODE)), one(s, i)))
    return F.when(root(a) == root(b), F.lit(None)).otherwise(F.array_compact(noted))


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with their fingerprint; a column of that name is replaced."""
    return docs.withColumn(name, fingerprint(col(text)))


_NULL_ID = -(1 << 63)


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    Edited: the last floor(n_chars / 2) code points give way to the first as many, or all, of the next document in
    ascending id order (null first; after the last: the first). Documents of one id go by a hash of their text.
    Rows that repeat an id and a text are one document, so each gets its results; an only document is next to itself.

    Ids, hashes and lengths alone are sorted. Texts and fingerprints go through one exchange, by id and hash, which
    both sides of the last join read; the side of next documents passes on only the head that is needed.
    """
    body = F.coalesce(col(text), F.lit(""))
    key = F.coalesce(col(doc_id).cast("long"), F.lit(_NULL_ID)).alias("k1"), F.xxhash64(body).alias("k2")
    slim = docs.select(*key, F.char_length(body).cast("long").alias("n_chars"))
    ranks = kept(ordered(slim.groupBy("k1", "k2").agg(F.max("n_chars").alias("n_chars"), F.count("*").alias("copies")), ["k1", "k2"], "merkle-order"), "merkle-ranks")
    n = max(ranks.count(), 1)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    before = ranks.select(((F.col("rank") + 1) % n).alias("rank"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), half.alias("need"))
    places = kept(ranks.join(before, "rank").drop("rank"), "merkle-places")

    texts = docs.select(*key, body.alias("text"), fingerprint(col(text)).alias("fp"))
    own = texts.join(places.select("k1", "k2", "n_chars", half.alias("half")), ["k1", "k2"])
    follows = texts.join(places.select("k1", "k2", "p1", "p2", "need", "copies"), ["k1", "k2"])
    follows = follows.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.expr("substring(text, 1, need)").alias("head"), F.col("fp").alias("next_fp"), "copies")
    alone = follows.where("copies = 1").drop("copies")
    repeated = follows.where("copies > 1").groupBy("k1", "k2").agg(F.min("head").alias("head"), F.min("next_fp").alias("next_fp"))
    both = own.join(alone.unionByName(repeated), ["k1", "k2"])
    both = both.withColumn("edited", F.concat(F.expr("substring(text, 1, n_chars - half)"), F.col("head")))
    both = both.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return both.select(
        F.when(F.col("k1") != _NULL_ID, F.col("k1")).alias(doc_id), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.col("fp").alias("fingerprint"), "edited_fingerprint",
        likeness(F.col("fp"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
