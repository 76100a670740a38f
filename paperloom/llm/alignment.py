"""Aligning the tokens of two tokenizers by lockstep merging of their ends.

Tokenizer A is a byte-level BPE and B a sentencepiece BPE with byte fallback; both spell a text with one space before it,
so their tokens are two cuttings of the same bytes. Byte offsets where tokens of both end part them into groups, and all
A-B pairs of a group are links.

In a batch, one state vector holds an A pointer and a B pointer for each lane. A step compares the ends of the tokens
under both for all lanes at once and moves the pointer whose token ends first, or both where they end together, which
is a cut; lanes that are through are compacted away. A lane is a document or, of a long one, a stretch of about `LANE_BYTES`
between two places where words begin and tokens of both end, so that steps do not grow with the longest document.

Documents meet in blocks of about `BLOCK_BYTES` of text. A block's distinct pairs go to the count of pairs over the corpus, and
the counts come back to the block; links themselves are never shuffled.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import flat
from .bpe import byte_chars
from .pretokens import PieceCache
from .shared import col, kept, map_columns
from .token_files import ByteBPE

BLOCK_BYTES, LANE_BYTES = 2 << 20, 1 << 12
#: A group of more pairs than this is counted by the distinct ids of both sides.
WIDE = 1 << 12
_Z = np.zeros(0, np.int64)


class Spelling(NamedTuple):
    """The bytes of every token of a vocabulary end to end, and where each begins and how many it has."""

    pool: np.ndarray
    begin: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, spelled: list[bytes]) -> Spelling:
        size = np.array([len(x) for x in spelled], np.int64)
        return cls(np.frombuffer(b"".join(spelled), np.uint8), np.cumsum(size) - size, size)


class Batch(NamedTuple):
    """Tokens and groups of some texts, end to end; group numbers ascend."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    a_cut: np.ndarray  # A tokens up to each cut, over all texts
    b_cut: np.ndarray
    doc: np.ndarray  # text number of each group


class Aligner:
    """Both tokenizers, and the spelling of their tokens."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece

        byte = ByteBPE(byte_path)
        self.byte = byte.cache
        value = {c: k for k, c in enumerate(byte_chars())}
        names = {i: t for t, i in byte.vocabulary.items()}
        self.a = Spelling.of([bytes(value[c] for c in names[i]) if i in names and all(c in value for c in names[i]) else b"" for i in range(max(names) + 1)])
        self.model = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.b = Spelling.of([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        # words are pieces of their own where no token holds a space behind something else
        apart = all("▁" not in p.lstrip("▁") for p in pieces)
        self.piece = PieceCache("spaced", self._encode_pieces) if apart else None

    def _encode_pieces(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that begin with a space, which the model puts before each text itself."""
        data, ends = raw.tobytes(), np.cumsum(lengths).tolist()
        got = self.model.encode([data[e - n + 1 : e].decode("utf-8", "surrogatepass") for n, e in zip(lengths.tolist(), ends, strict=True)], num_threads=1)
        # a lone space is an empty text to the model: the piece is its space token
        lone = [self.model.piece_to_id("▁")]
        got = [x or lone for x in got]
        return np.array([i for x in got for i in x], np.int32), np.array([len(x) for x in got], np.int64)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and their numbers, ids of B and their numbers. Strings of special tokens are plain text to both."""
        spaced = [" " + t if t else "" for t in texts]
        a, n_a = self.byte.ids(spaced)
        if self.piece:
            b, n_b = self.piece.ids(spaced)
        else:
            got = [self.model.encode(t) if t else [] for t in texts]
            b, n_b = np.array([i for x in got for i in x], np.int32), np.array([len(x) for x in got], np.int64)
        return a.astype(np.int64), n_a, b.astype(np.int64), n_b

    def batch(self, texts: list[str]) -> Batch:
        """Aligned tokens; a text whose joined tokens are not its bytes has none."""
        a, n_a, b, n_b = self.ids(texts)
        raw = [(" " + t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        size = np.array([len(x) for x in raw], np.int64)
        text = np.frombuffer(b"".join(raw), np.uint8)
        good = _spells(self.a, a, n_a, text, size) & _spells(self.b, b, n_b, text, size)
        if not good.all():
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            text = text[np.repeat(good, size)]
            n_a, n_b, size = n_a * good, n_b * good, size * good
        a_end, b_end = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        a_cut, b_cut = lockstep(a_end, b_end, *lanes(text, size, a_end, b_end))
        doc = np.searchsorted(np.cumsum(n_a), a_cut, "left")
        return Batch(a, b, n_a, n_b, a_cut, b_cut, doc)


def _spells(spelling: Spelling, ids: np.ndarray, counts: np.ndarray, text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the tokens of each text, joined, are its bytes."""
    got = np.bincount(np.repeat(np.arange(len(counts)), counts), weights=spelling.size[ids], minlength=len(counts)).astype(np.int64)
    spelled = spelling.pool[flat.ragged(spelling.begin[ids], spelling.size[ids])]
    return flat.equal_spans(spelled, np.cumsum(got) - got, np.cumsum(got), text, np.cumsum(size) - size, np.cumsum(size))


def lanes(text: np.ndarray, size: np.ndarray, a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First A token, first B token and last byte of each lane: texts, long ones parted where words begin and both have a token end."""
    ends = np.cumsum(size)
    begins = (ends - size)[size > 0]
    ends = ends[size > 0]
    if not len(ends):
        return _Z, _Z, _Z
    # places where a space follows something else, one of them in each stretch of LANE_BYTES
    word = np.flatnonzero((text[1:] == 32) & (text[:-1] != 32)) + 1
    stretch = word // LANE_BYTES
    word = word[np.concatenate(([True], stretch[1:] != stretch[:-1]))] if len(word) else word
    for one in (a_end, b_end):
        word = word[one[np.minimum(np.searchsorted(one, word), len(one) - 1)] == word]
    first = np.union1d(begins, word)
    last = np.append(first[1:], ends[-1])
    at = [np.searchsorted(one, first, "right") for one in (a_end, b_end)]
    return at[0], at[1], last


def lockstep(a_end: np.ndarray, b_end: np.ndarray, i: np.ndarray, j: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of A and B tokens up to each cut, ascending; a step moves the pointers of all lanes."""
    cuts_a, cuts_b = [], []
    while len(i):
        at_a, at_b = a_end[i], b_end[j]
        i, j = i + (at_a <= at_b), j + (at_b <= at_a)
        cut = at_a == at_b
        cuts_a.append(i[cut])
        cuts_b.append(j[cut])
        open_ = ~cut | (at_a < last)
        if not open_.all():
            i, j, last = i[open_], j[open_], last[open_]
    a, b = np.concatenate((_Z, *cuts_a)), np.concatenate((_Z, *cuts_b))
    return np.sort(a), np.sort(b)


@lru_cache(2)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def linked_pairs(found: Batch, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, pair (A id << 32 | B id) and number of its links, each pair of a text once, by text and pair."""
    left, right = np.diff(found.a_cut, prepend=0), np.diff(found.b_cut, prepend=0)
    a0, b0 = found.a_cut - left, found.b_cut - right
    links = left * right
    docs, pairs, times = [], [], []
    wide = np.flatnonzero(links > WIDE)
    for g in wide.tolist():
        a, m = np.unique(found.a[a0[g] : found.a_cut[g]], return_counts=True)
        b, n = np.unique(found.b[b0[g] : found.b_cut[g]], return_counts=True)
        docs.append(np.full(len(a) * len(b), found.doc[g]))
        pairs.append((a[:, None] << 32 | b).ravel())
        times.append(np.outer(m, n).ravel())
    plain = np.flatnonzero(links <= WIDE)
    upto = np.cumsum(links[plain])
    k = 0
    while k < len(plain):  # about `most` links at a time
        stop = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + most, "right")))
        g = plain[k:stop]
        nth = flat.ragged(np.zeros(len(g), np.int64), links[g])
        of = np.repeat(g, links[g])
        row, column = nth // right[of], nth % right[of]
        docs.append(found.doc[of])
        pairs.append(found.a[a0[of] + row] << 32 | found.b[b0[of] + column])
        times.append(np.ones(len(of), np.int64))
        k = stop
    doc, pair, n = (np.concatenate((_Z, *x)) for x in (docs, pairs, times))
    order = np.lexsort((pair, doc))
    doc, pair, n = doc[order], pair[order], n[order]
    head = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])))) if len(doc) else _Z
    return doc[head], pair[head], np.add.reduceat(n, head) if len(head) else n


@lru_cache(8)
def _names(n: int, sign: str) -> np.ndarray:
    """Decimal ids with a sign behind them."""
    return np.array([f"{i}{sign}" for i in range(n)], object)


def spelled_groups(found: Batch) -> list[str]:
    """a1,a2|b1;a3|b2 of each text; empty for a text without tokens."""

    def named(ids: np.ndarray, cut: np.ndarray, sign: str) -> np.ndarray:
        n = 1 << max(int(ids.max(initial=0)).bit_length(), 16)
        out = _names(n, ",")[ids]
        out[cut - 1] = _names(n, sign)[ids[cut - 1]]
        return out

    a, b = named(found.a, found.a_cut, "|"), named(found.b, found.b_cut, ";")
    # B tokens of a group stand behind its A tokens
    left, right = np.diff(found.a_cut, prepend=0), np.diff(found.b_cut, prepend=0)
    both = np.empty(len(a) + len(b), object)
    base = found.a_cut - left + found.b_cut - right
    both[flat.ragged(base, left)] = a
    both[flat.ragged(base + left, right)] = b
    signs, at, out = both.tolist(), 0, []
    for n in (found.n_a + found.n_b).tolist():
        out.append("".join(signs[at : at + n])[:-1])
        at += n
    return out


def alignments(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text") -> DataFrame:
    """docs with a_ids, b_ids and, for each group in order, a_ends and b_ends: how many tokens of A and B the text has up to its end.

    Links are all A-B pairs of a group. Null and empty texts and those that either tokenizer does not spell byte for byte have
    empty arrays. Columns of docs may have any names but these four, which are replaced.
    """
    made = ("a_ids", "b_ids", "a_ends", "b_ends")
    docs = docs.drop(*made)
    at = docs.columns.index(text)

    def run(batches):
        both = aligner(byte_path, piece_path)
        for b in batches:
            for i, n, part in _parts(b.column(at)):
                got = both.batch(part)
                groups = np.bincount(got.doc, minlength=n)
                a_base, b_base = np.cumsum(got.n_a) - got.n_a, np.cumsum(got.n_b) - got.n_b
                yield [
                    *b.slice(i, n).columns, _lists(got.a, got.n_a), _lists(got.b, got.n_b),
                    _lists(got.a_cut - a_base[got.doc], groups), _lists(got.b_cut - b_base[got.doc], groups),
                ]

    return map_columns(docs, run, [*docs.schema, *StructType.fromDDL(", ".join(f"{c} array<int>" for c in made))])


def _parts(texts, limit: int = BLOCK_BYTES):
    """First row, number of rows and texts (null: empty) of about `limit` bytes each."""
    _, offs = flat.flat_bytes(texts)
    for i, j in flat.chunks(offs, limit):
        yield i, j - i, [t or "" for t in texts.slice(i, j - i).to_pylist()]


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, kind or pa.int32()))


def _linked(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """block, id, n_a, n_b, n_groups, n_links, groups_sha256, pairs and times of each row of docs (id, text)."""

    def run(batches):
        both, block = aligner(byte_path, piece_path), TaskContext.get().partitionId() << 32
        for b in batches:
            for i, n, part in _parts(b.column(1)):
                got = both.batch(part)
                doc, pair, times = linked_pairs(got)
                links = np.bincount(doc, weights=times, minlength=n).astype(np.int64)
                digests = [sha256(x.encode()).hexdigest() if x else "" for x in spelled_groups(got)]
                held = np.bincount(doc, minlength=n)
                yield [
                    pa.array(np.full(n, block)), b.column(0).slice(i, n), *map(pa.array, (got.n_a, got.n_b, np.bincount(got.doc, minlength=n), links)),
                    pa.array(digests, pa.string()), _lists(pair, held, pa.int64()), _lists(times, held, pa.int64()),
                ]
                block += 1

    fields = StructType.fromDDL("block long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>").fields
    fields[1].dataType = docs.schema.fields[0].dataType
    return map_columns(docs, run, fields)


def _block_pairs(linked: DataFrame) -> DataFrame:
    """block, pair, n: how many documents of a block, or of a part of it, hold a pair."""

    def run(batches):
        for b in batches:
            block, lists = b.column(0).to_numpy(), b.column(1)
            owner, pairs = np.repeat(block, np.diff(lists.offsets.to_numpy())), lists.values.to_numpy()
            order = np.lexsort((pairs, owner))
            owner, pairs = owner[order], pairs[order]
            head = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (pairs[1:] != pairs[:-1])))) if len(pairs) else _Z
            n = np.diff(np.append(head, len(pairs)))
            yield pa.RecordBatch.from_arrays(list(map(pa.array, (owner[head], pairs[head], n))), names=["block", "pair", "n"])

    return linked.select("block", "pairs").mapInArrow(run, "block long, pair long, n long")


def pair_counts(block_pairs: DataFrame) -> DataFrame:
    """pair, n_docs and best: how many documents hold a linked pair, and whether no pair of its A id has more."""
    counts = block_pairs.groupBy("pair").agg(F.sum("n").alias("n_docs")).withColumn("a", F.shiftrightunsigned("pair", 32))
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counts.join(most, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def scored_alignments(docs: DataFrame, byte_path: str, piece_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: a row for each row of docs.

    A pair's count is the number of rows of docs that hold it linked. Null and empty texts, and those that either tokenizer does
    not spell byte for byte, have zeros and an empty digest; repeated rows and null ids are rows like others. Columns of docs other
    than these two are left out; an empty table stays empty.
    """
    linked = kept(_linked(docs.select(col(doc_id), col(text)), byte_path, piece_path), "alignment-links", compression="zstd")
    blocks = kept(_block_pairs(linked), "alignment-blocks", compression="zstd")
    scored = blocks.select("block", "pair").join(pair_counts(blocks), "pair")
    kind = linked.schema["id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        pair, n_docs, best = (right.column(c).to_numpy() for c in ("pair", "n_docs", "best"))
        order = np.argsort(pair)
        offs, pairs, times = _flat_lists(left.column("pairs"), left.column("times"))
        at = order[np.searchsorted(pair, pairs, sorter=order)] if len(pairs) else _Z
        n_best, count_sum = (np.diff(np.concatenate(([0], np.cumsum(times * x[at])))[offs]) for x in (best, n_docs))
        return pa.table([*(left.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")), pa.array(n_best), pa.array(count_sum), left.column("groups_sha256")], names=names)

    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    out = linked.groupBy("block").cogroup(scored.groupBy("block")).applyInArrow(run, schema)
    return out.withColumnRenamed("id", doc_id)


def _flat_lists(*columns) -> tuple[np.ndarray, ...]:
    """len + 1 offsets, and the values of list columns of equal lengths."""
    lists = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    sizes = np.diff(lists[0].offsets.to_numpy())
    return np.concatenate(([0], np.cumsum(sizes))), *(x.flatten().to_numpy() for x in lists)
