"""Full-text search: one query language, answered by each row's own words or by a positional index.

A query is parts joined by OR; a part finds what holds all its terms and none of those with a minus (or NOT) before them, and
finds nothing without a wanted term. A term is

    word            or several at once where signs part it: 10:30 is the phrase "10 30"
    word*           words that start so
    "two words"     words in this order; "two wor"* for any word that starts so at its end
    NEAR(a "b c", 5)    these with at most 5 words between the end of the first and the start of the last (10 if not said)
    field:term      a term of one field (its name in any case); before anything else a colon is a sign like others

Terms without a field look in every field searched, each phrase within one field. Case and diacritical marks do not count:
words are folded by Unicode decomposition, letters with strokes and the like by their base letter.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache, reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quality import let
from ..functions.stem import porter

TOKEN = r"[^\p{L}\p{N}]+"
_TERM = regex.compile(r'(-?)(?:([^\W\d]\w*):(?=\S))?("[^"]*"\*?|NEAR\([^)]*\)|\S+)')
_NEAR = regex.compile(r'"[^"]*"\*?|[^\s",]+')
_WITH = regex.compile(r"LATIN (?:SMALL|CAPITAL) LETTER ([A-Z]) WITH ")


@lru_cache(1)
def base_letters() -> dict[str, str]:
    """Lower-case letters with marks or strokes, and the letter that is left without them."""
    out = {}
    for k in range(0xC0, sys.maxunicode + 1):
        c = chr(k)
        if not c.islower() and unicodedata.category(c) not in ("Lo", "Lm"):
            continue
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if len(plain) == 1 and (found := _WITH.match(unicodedata.name(plain, ""))):
            plain = found[1].lower()
        if len(plain) == 1 and plain != c:
            out[c] = plain
    return out | {"ς": "σ"}


@lru_cache(1)
def marks() -> str:
    """All combining marks."""
    return "".join(c for c in map(chr, range(0x300, sys.maxunicode + 1)) if unicodedata.category(c)[0] == "M")


def fold(text: str) -> str:
    """The text in lower case without marks, as `folded` does with a column."""
    return text.lower().translate(str.maketrans(base_letters()) | dict.fromkeys(map(ord, marks())))


def folded(c: Column) -> Column:
    """Lower case without marks; null is empty. Only texts with characters beyond ASCII are translated."""
    lowered = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    letters = base_letters()
    plain = F.translate(lowered, "".join(letters) + marks(), "".join(letters.values()))  # characters without a partner go
    return F.when(F.octet_length(lowered) == F.char_length(lowered), lowered).otherwise(plain)


def tokens_of(c: str) -> Column:
    """The folded words of a column, in order; empty ones stand at the ends where it begins or ends with other characters."""
    return F.split(folded(F.col(c)), TOKEN)


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False
    field: str | None = None


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    gap: int


@dataclass(frozen=True)
class Part:
    wanted: tuple[Phrase | Near, ...]
    banned: tuple[Phrase | Near, ...]


def _phrase(text: str, field: str | None) -> Phrase | None:
    prefix = text.endswith("*")
    words = tuple(w for w in regex.split(TOKEN, fold(text)) if w)
    return Phrase(words, prefix, field) if words else None


def parse(query: str, fields: tuple[str, ...] | None = ()) -> list[Part]:
    """The parts of a query. fields: names that may stand before a colon; None: any name. Terms without a word are left out."""
    known = None if fields is None else {f.lower(): f for f in fields}
    parts, wanted, banned, negate = [], [], [], False
    for minus, name, body in _TERM.findall(query):
        if not minus and not name and body in ("OR", "AND", "NOT"):
            if body == "OR":
                parts.append(Part(tuple(wanted), tuple(banned)))
                wanted, banned = [], []
            negate = body == "NOT"
            continue
        field = None
        if name:
            field = name if known is None else known.get(name.lower())
            body = body if field else f"{name}:{body}"
        if body.startswith("NEAR("):
            inner = body[5:-1]
            gap = regex.search(r",\s*(\d+)\s*$", inner)
            phrases = [p for x in _NEAR.findall(inner[: gap.start()] if gap else inner) if (p := _phrase(x, field))]
            term = Near(tuple(phrases), int(gap[1]) if gap else 10) if phrases else None
        else:
            term = _phrase(body, field)
        if term:
            (banned if minus or negate else wanted).append(term)
        negate = False
    return [*parts, Part(tuple(wanted), tuple(banned))]


def _combined(parts: list[Part], test) -> Column:
    """The parts' condition from the condition of a term."""
    whole = [reduce(and_, [*map(test, p.wanted), *(~test(t) for t in p.banned)]) for p in parts if p.wanted]
    return reduce(or_, whole) if whole else F.lit(False)


def _close(starts: list[Column], sizes: list[int], gap: int) -> Column:
    """Whether occurrences of all phrases, given by where each starts, lie so close: one of them starts last, and every other ends shortly before.

    Starts of all phrases pass once, in their order, with the last start of each phrase so far: of those before a place it ends nearest.
    """

    def marked(i: int) -> Column:
        return F.transform(starts[i], lambda x: F.struct(x.alias("at"), F.lit(i).alias("phrase")))

    passed = F.sort_array(F.concat(*map(marked, range(len(starts)))))
    none = F.struct(F.lit(False).alias("found"), *(F.lit(None).cast("int").alias(f"s{i}") for i in range(len(starts))))

    def step(seen: Column, x: Column) -> Column:
        last = [F.when(x["phrase"] == i, x["at"]).otherwise(seen[f"s{i}"]) for i in range(len(starts))]
        near = reduce(and_, (x["at"] - s - n <= gap for s, n in zip(last, sizes, strict=True)))
        return F.struct((seen["found"] | F.coalesce(near, F.lit(False))).alias("found"), *(s.alias(f"s{i}") for i, s in enumerate(last)))

    return F.aggregate(passed, none, step, lambda seen: seen["found"])


def spelled(c: str) -> Column:
    """The folded words of a column, in order, with one space between them."""
    return F.trim(F.regexp_replace(folded(F.col(c)), TOKEN, " "))


def _row(fields: tuple[str, ...]) -> Column:
    """The words of each field between spaces."""
    return F.struct(*(F.concat(F.lit(" "), spelled(f), F.lit(" ")).alias(f) for f in fields))


def _test_of(query: str, fields: tuple[str, ...], row: Column) -> Column:
    """Whether a row of words matches the query."""

    def at(text: Column, p: Phrase) -> Column:
        return F.contains(text, F.lit(" " + " ".join(p.words) + " " * (not p.prefix)))

    def starts(words: Column, p: Phrase) -> Column:
        def is_word(w: Column, k: int) -> Column:
            return F.startswith(w, F.lit(p.words[k])) if p.prefix and k == len(p.words) - 1 else w == p.words[k]

        def here(w: Column, i: Column) -> Column:
            # words behind the end are null
            return F.when(reduce(and_, (is_word(F.get(words, i + k), k) for k in range(1, len(p.words))), is_word(w, 0)), i)

        return F.array_compact(F.transform(words, here))

    def one(t: Phrase | Near) -> Column:
        if isinstance(t, Phrase):
            return reduce(or_, (at(row[f], t) for f in fields if t.field in (None, f)))

        def within(f: str) -> Column:
            there = reduce(and_, (at(row[f], p) for p in t.phrases))
            near = F.exists(F.array(F.split(F.trim(row[f]), " ")), lambda words: _close([starts(words, p) for p in t.phrases], [len(p.words) for p in t.phrases], t.gap))
            return F.when(there, near).otherwise(False)

        return reduce(or_, (within(f) for f in fields if t.phrases[0].field in (None, f)))

    return _combined(parse(query, fields), one)


def query_test(query: str, fields: tuple[str, ...] = ("text",)) -> Column:
    """Whether a row matches the query in its own columns `fields`: nothing is exploded or shuffled, and each column is folded once."""
    return let(_row(fields), lambda row: _test_of(query, fields, row))


def queries_met(queries: tuple[str, ...], fields: tuple[str, ...] = ("text",)) -> Column:
    """The places of the queries that a row matches, as `query_test` tells of each; columns are folded once for all of them."""
    return let(_row(fields), lambda row: F.array_compact(F.array(*(F.when(_test_of(q, fields, row), i) for i, q in enumerate(queries)))))


#: Bytes of text whose words are sorted at once.
PIECE = 2 << 20


def postings(docs: DataFrame, fields: tuple[str, ...] = (), stems: bool = False) -> DataFrame:
    """(token, doc_id, tf, positions) of the words of text; with fields, (field, token, doc_id, tf, positions) of each of these columns.

    positions: where the word stands, ascending from 0. Parquet files of the writer's version 2 keep them as differences, bit-packed
    (`delta_packed`). Rows are counted where they lie, so nothing is shuffled; stems: Porter's stems stand for the words.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = fields or ("text",)
    texts = docs.select("doc_id", *(spelled(f).alias(f"f{i}") for i, f in enumerate(named)))

    def pieces(batches):
        for b in batches:
            sizes = sum(np.asarray(pc.binary_length(c)).astype(np.int64) for c in b.columns[1:])
            # where another PIECE characters have begun
            edges = np.flatnonzero(np.diff(np.cumsum(sizes) // PIECE)) + 1
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows], strict=True):
                yield b.slice(i, j - i)

    def run(batches):
        for b in pieces(batches):
            for i, name in enumerate(named):
                lists = pc.split_pattern(b.column(i + 1), " ")
                words, row = lists.flatten(), np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
                at = np.arange(len(row)) - (lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0])[row]
                real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
                coded = words.dictionary_encode()
                names, code = coded.dictionary, coded.indices.to_numpy()
                if stems:
                    coded = pa.array([porter(w) for w in names.to_pylist()], pa.string()).dictionary_encode()
                    names, code = coded.dictionary, coded.indices.to_numpy()[code]
                # by row and word; words lie in the order of their places
                order = np.argsort(row * len(names) + code, kind="stable")
                order = order[real[order]]
                row, code, at = row[order], code[order], at[order]
                head = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])))) if len(row) else np.zeros(0, np.int64)
                edges = np.append(head, len(row)).astype(np.int32)
                columns = [names.take(pa.array(code[head])), b.column(0).take(pa.array(row[head])), pa.array(np.diff(edges), pa.int64()), pa.ListArray.from_arrays(pa.array(edges), pa.array(at, pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.repeat(name, len(head))] * bool(fields) + columns, names=["field"] * bool(fields) + ["token", "doc_id", "tf", "positions"])

    index = texts.mapInArrow(run, "field string, " * bool(fields) + f"token string, doc_id {kind}, tf long, positions array<int>")
    # the index knows its fields, saved or not
    return index.withColumn("field", F.col("field").alias("field", metadata={"fields": list(fields)})) if fields else index


def clustered(index: DataFrame) -> DataFrame:
    """The index as it should be written: each task's rows by token, so that the files' page indexes leave out all pages but those of a query's words."""
    return index.sortWithinPartitions("token")


#: Writer options for tables of postings: differences of positions, bit-packed.
DELTA_PACKED = {"parquet.writer.version": "v2", "parquet.enable.dictionary#positions.list.element": "false"}


def index_fields(index: DataFrame) -> tuple[str, ...] | None:
    """Fields of an index: none, those that its column notes, or None for any."""
    if "field" not in index.columns:
        return ()
    noted = index.schema["field"].metadata.get("fields")
    return tuple(noted) if noted else None


def matching(index: DataFrame, query: str, stems: bool = False, fields: tuple[str, ...] | None = None) -> DataFrame:
    """doc_id of the documents that match the query, from the rows of its words in the index alone: those are shuffled once, by document.

    A phrase is found by intersecting its words' positions, each shifted to where the phrase begins. stems: the index holds stems, and whole words of
    the query become such. An index without positions answers queries of single words.
    """
    return matching_each(index, (query,), stems, fields).select("doc_id")


def matching_each(index: DataFrame, queries: tuple[str, ...], stems: bool = False, fields: tuple[str, ...] | None = None) -> DataFrame:
    """(query, doc_id): the place of each query and the documents that match it, as `matching` finds them; the index is read once for all queries."""
    asked = [parse(q, fields or index_fields(index)) for q in queries]
    terms = list(dict.fromkeys(t for parts in asked for p in parts if p.wanted for t in (*p.wanted, *p.banned)))
    phrases = list(dict.fromkeys(p for t in terms for p in (t.phrases if isinstance(t, Near) else (t,))))
    if not phrases:
        return index.select(F.lit(0).alias("query"), "doc_id").where("false")
    apart = "field" in index.columns
    positional = any(isinstance(t, Near) or len(t.words) > 1 for t in terms)
    if positional and "positions" not in index.columns:
        raise ValueError(f"{', '.join(map(repr, queries))}: phrases, but the index has no positions")

    def word_of(p: Phrase, k: int) -> tuple[str, bool, str | None]:
        prefix = p.prefix and k == len(p.words) - 1
        return (p.words[k] if prefix or not stems else porter(p.words[k])), prefix, p.field if apart else None

    def word_test(word: str, prefix: bool, field: str | None) -> Column:
        test = F.startswith(F.col("token"), F.lit(word)) if prefix else F.col("token") == word
        return test & (F.col("field") == field) if field else test

    # slots: one for each word of the phrases, however many have it
    slots = {w: word_test(*w) for w in dict.fromkeys(word_of(p, k) for p in phrases for k in range(len(p.words)))}
    hits = index.where(reduce(or_, slots.values())).repartition("doc_id")

    def found_at(test: Column) -> Column:
        return F.flatten(F.collect_list(F.when(test, F.col("positions"))))

    wanted = [found_at(t) if positional else F.max(t.cast("int")) for t in slots.values()]
    rows = hits.groupBy("doc_id", *["field"] * apart).agg(*(w.alias(f"s{i}") for i, w in enumerate(wanted)))
    slot = {w: F.col(f"s{i}") for i, w in enumerate(slots)}

    def shifted(at: Column, k: int) -> Column:
        return F.transform(at, lambda x: x - k)

    def starts(p: Phrase) -> Column:
        return reduce(F.array_intersect, (shifted(slot[word_of(p, k)], k) for k in range(1, len(p.words))), slot[word_of(p, 0)])

    def here(t: Phrase | Near) -> Column:
        if not positional:
            return slot[word_of(t, 0)] > 0
        if isinstance(t, Phrase):
            return F.size(starts(t)) > 0
        at = [starts(p) for p in t.phrases]
        return F.when(reduce(and_, (F.size(x) > 0 for x in at)), _close(at, [len(p.words) for p in t.phrases], t.gap)).otherwise(False)

    # a term is found where one of the fields has it
    of_docs = rows.groupBy("doc_id").agg(*(F.coalesce(F.bool_or(here(t)), F.lit(False)).alias(f"t{i}") for i, t in enumerate(terms)))
    flag = {t: F.col(f"t{i}") for i, t in enumerate(terms)}
    met = F.array(*(F.when(_combined(parts, flag.__getitem__), i) for i, parts in enumerate(asked)))
    return of_docs.select(F.explode(F.array_compact(met)).alias("query"), "doc_id")


def stemmed(index: DataFrame) -> DataFrame:
    """The index by stems: tokens of one stem become one. Only distinct (token, document) rows pass through Python."""
    from ..functions.stem import stem

    keys = [c for c in index.columns if c not in ("token", "tf", "positions")]
    merged = [F.sum("tf").alias("tf")] + [F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions")] * ("positions" in index.columns)
    return index.withColumn("token", stem(F.col("token"))).groupBy("token", *keys).agg(*merged)
