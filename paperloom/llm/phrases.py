"""Frequent phrases and collocations by Rabin-Karp fingerprints.

1. Texts are laid down in chunks of about `CHUNK_BYTES`, a row each. Prefix polynomials over the hashes of a chunk's words give a
   64-bit fingerprint of every phrase of up to `most_words` words at once; equal ones of a chunk become one entry.
2. Entries are shuffled as (bucket, chunk, 32 more bits of each fingerprint, counts that stop at the least count asked for): the
   first bits choose the bucket, and an entry's pointer to its occurrences is its place in the chunk's order. A task adds up a
   bucket and returns to each chunk one bit for each of its entries: whether the corpus may hold it often enough.
3. Only those are looked up in the text. Their occurrences are compared with the first one, word by word, so that phrases that
   share a fingerprint part; what is left is materialised, and counts are added up by the phrase itself. A collision can
   thus let a rare phrase through to this sum, which drops it, but never changes a count.

Words are lower-cased in A-Z; phrases cross neither `.,;:!?`, line breaks (any of \\n, \\v, \\f, \\r) nor documents, and each language has its own.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import flat
from .shared import col, kept, map_columns

CHUNK_BYTES = 4 << 20
#: About so many bytes of text fall into a bucket of fingerprints, and at least so many bits choose it.
BUCKET_BYTES, BUCKET_BITS = 16 << 20, 10
#: Writer options for tables with a chunk in a row: sizes are looked at after each row, where the writer would hold 100 rows before its first look,
#: so that neither it nor a reader, who takes a page at once and batches up to a row group, holds more than a few chunks at a time.
ROW_BY_ROW = {"parquet.block.size": str(4 * CHUNK_BYTES), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1"}
#: Parts of a language that rank their phrases apart before the first ones meet.
RANK_PARTS = 64
_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?", *range(10, 14)]] = True
_APART = _CUT.copy()
_APART[[9, 32]] = True
_U = np.uint64


def _chunks(docs: DataFrame) -> DataFrame:
    """chunk, langs and texts: a row for about CHUNK_BYTES of whole texts. Texts that are null or empty are left out."""

    def row(number: int, langs: list, texts: list) -> list[pa.Array]:
        joined = [pa.concat_arrays(x) for x in (langs, texts)]
        return [pa.array([number]), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in joined)]

    def run(batches):
        number, langs, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            _, offs = flat.flat_bytes(b.column(1))
            for i, j in flat.chunks(offs, max(CHUNK_BYTES - size, CHUNK_BYTES // 4)):
                langs.append(b.column(0).slice(i, j - i))
                texts.append(b.column(1).slice(i, j - i))
                size += int(offs[j] - offs[i])
                if size >= CHUNK_BYTES // 2:
                    yield row(number, langs, texts)
                    number, langs, texts, size = number + 1, [], [], 0
        if texts:
            yield row(number, langs, texts)

    return map_columns(docs.where("length(c1) > 0"), run, StructType.fromDDL("chunk long, langs array<string>, texts array<string>").fields)


def _chunk_table(texts: DataFrame) -> DataFrame:
    return kept(_chunks(texts), "phrase-chunks", compression="zstd", **ROW_BY_ROW)


class _Chunk:
    """The words and phrases of a chunk."""

    def __init__(self, langs: pa.Array, texts: pa.Array, most_words: int):
        raw, offs = flat.flat_bytes(texts)
        self.buf = raw.copy()
        upper = (self.buf >= 65) & (self.buf <= 90)
        self.buf[upper] += 32
        self.starts, self.ends, doc = flat.word_spans(self.buf, offs, _APART)
        coded = langs.dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        self.lang = coded.indices.to_numpy()[doc]  # of each word
        # a run of words is a piece of a text: the words between two signs
        run = np.cumsum(_CUT[self.buf])[self.starts] if len(doc) else doc
        self.hashes = flat.word_hash(self.buf, self.starts, self.ends)
        p, q = flat.powers(len(doc) + 1)
        prefix = np.zeros(len(doc) + 1, np.uint64)
        np.cumsum(self.hashes * p[: len(doc)], out=prefix[1:])
        keys = np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs], np.uint64)
        at, width, prints = [], [], []
        for n in range(1, most_words + 1):
            ok = np.arange(max(0, len(doc) - n + 1))
            ok = ok[(run[n - 1 :] == run[: len(ok)]) & (doc[n - 1 :] == doc[: len(ok)])]
            at.append(ok)
            width.append(np.full(len(ok), n, np.int8))
            prints.append(flat.mix((prefix[ok + n] - prefix[ok]) * q[ok] + keys[self.lang[ok]] + flat.SHINGLE_KEYS[n % len(flat.SHINGLE_KEYS)]))
        #: First word, number of words and fingerprint of each occurrence.
        self.at, self.width, self.prints = (np.concatenate(x) for x in (at, width, prints))

    def word_numbers(self) -> np.ndarray:
        """A number for each word, equal just where the words' bytes are."""
        _, first, number = np.unique(self.hashes, return_index=True, return_inverse=True)
        same = flat.equal_spans(self.buf, self.starts, self.ends, self.buf, self.starts[first[number]], self.ends[first[number]])
        odd: dict[bytes, int] = {}
        for k in np.flatnonzero(~same).tolist():
            number[k] = odd.setdefault(self.buf[self.starts[k] : self.ends[k]].tobytes(), len(first) + len(odd))
        return number

    def spelled(self, at: np.ndarray, width: np.ndarray) -> pa.Array:
        """The phrases of some occurrences, their words joined by a space."""
        words = flat.ragged(at, width.astype(np.int64))
        size = self.ends[words] - self.starts[words]
        gap = np.ones(len(words), np.int64)
        gap[np.cumsum(width.astype(np.int64)) - 1] = 0
        begin = np.cumsum(size + gap) - size - gap
        out = np.full(int((size + gap).sum()), 32, np.uint8)
        out[flat.ragged(begin, size)] = self.buf[flat.ragged(self.starts[words], size)]
        ends = (begin + size)[np.cumsum(width.astype(np.int64)) - 1]
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.concatenate(([0], ends))), pa.py_buffer(out)]).cast(pa.string())


def _bucket_edges(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that the sorted fingerprints fall into, and where each begins (and the last one ends)."""
    bucket = prints >> _U(64 - bits)
    head = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(prints) else np.zeros(0, np.int64)
    return bucket[head].astype(np.int64), np.append(head, len(prints))


def _rows_of(chunks, most_words):
    for b in chunks:
        for k in range(b.num_rows):
            lists = [b.column(c).slice(k, 1) for c in (1, 2)]
            yield b.column(0)[k].as_py(), _Chunk(lists[0].flatten(), lists[1].flatten(), most_words)


def _prints(chunks: DataFrame, bits: int, most_words: int, least: int) -> DataFrame:
    """bucket, chunk, and the keys and counts of the chunk's entries in that bucket, by fingerprint."""
    counted = np.uint8 if least < 256 else np.int64

    def run(batches):
        for chunk, c in _rows_of(batches, most_words):
            prints, counts = np.unique(c.prints, return_counts=True)
            buckets, edges = _bucket_edges(prints, bits)
            keys = (prints >> _U(32 - bits)).astype(np.uint32)
            counts = np.minimum(counts, least).astype(counted)
            yield pa.RecordBatch.from_arrays(
                [pa.array(buckets), pa.array(np.full(len(buckets), chunk)), _binary(keys, edges), _binary(counts, edges)], names=["bucket", "chunk", "keys", "counts"]
            )

    return chunks.mapInArrow(run, "bucket long, chunk long, keys binary, counts binary")


def _binary(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _frequent(prints: DataFrame, least: int) -> DataFrame:
    """chunk, bucket and a bit for each entry there: whether the counts of its fingerprint add up to the least."""
    counted = np.uint8 if least < 256 else np.int64
    dealt = prints.repartition("bucket").sortWithinPartitions("bucket")

    def run(batches):
        for table in flat.groups(batches, ["bucket"]):
            sizes = np.array([len(x) // 4 for x in table.column("keys").to_pylist()], np.int64)
            keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint32)
            counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), counted)
            order = np.argsort(keys, kind="stable")
            ordered = keys[order]
            head = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
            total = np.add.reduceat(counts[order].astype(np.int64), head)
            often = np.zeros(len(keys), bool)
            often[order] = np.repeat(total >= least, np.diff(np.append(head, len(keys))))
            bits = [np.packbits(x).tobytes() for x in np.split(often, np.cumsum(sizes)[:-1])]
            yield pa.RecordBatch.from_arrays([table.column("chunk").combine_chunks(), table.column("bucket").combine_chunks(), pa.array(bits, pa.binary())], names=["chunk", "bucket", "bits"])

    return dealt.mapInArrow(run, "chunk long, bucket long, bits binary")


def phrase_counts(docs: DataFrame, least: int = 10, most_words: int = 3, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, phrase and n: all phrases of up to most_words words that a language holds at least `least` times, overlaps included.

    A row with a null phrase has the number of all words of the language. Null texts are empty, a null language is `und`.
    Repeated rows count each time; columns other than these two are left out; an empty table has no phrases.
    """
    texts = docs.select(F.coalesce(col(lang).cast("string"), F.lit("und")).alias("c0"), col(text).alias("c1"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("c1")), F.lit(0))).first()[0]
    bits = min(32, max(BUCKET_BITS, (size // BUCKET_BYTES).bit_length()))
    chunks = _chunk_table(texts)
    often = _frequent(_prints(chunks, bits, most_words, least), least)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        langs, phrases, counts = [], [], []
        marks = dict(zip(right.column("bucket").to_pylist(), right.column("bits").to_pylist(), strict=True))
        for _, c in _rows_of(left.to_batches(), most_words):
            for code, n in enumerate(np.bincount(c.lang, minlength=len(c.langs)).tolist()):
                langs.append(pa.array([c.langs[code]]))
                phrases.append(pa.array([None], pa.string()))
                counts.append([n])
            prints, first, entry = np.unique(c.prints, return_index=True, return_inverse=True)
            if not len(prints):
                continue
            buckets, edges = _bucket_edges(prints, bits)
            held = [np.unpackbits(np.frombuffer(marks[k], np.uint8), count=n) for k, n in zip(buckets.tolist(), np.diff(edges).tolist(), strict=True)]
            here = np.concatenate(held).astype(bool)[entry]
            entry, at, width = entry[here], c.at[here], c.width[here]
            # occurrences that share a fingerprint with the first one, but are another phrase, stand for themselves
            number, head = c.word_numbers(), first[entry]
            same = (c.width[head] == width) & (c.lang[c.at[head]] == c.lang[at])
            for k in range(most_words):
                more = np.flatnonzero(same & (width > k))
                same[more] = number[at[more] + k] == number[c.at[head[more]] + k]
            total = np.bincount(entry[same], minlength=len(prints))
            chosen = np.flatnonzero(total)
            odd = np.flatnonzero(~same)
            begin, words = np.concatenate((c.at[first[chosen]], at[odd])), np.concatenate((c.width[first[chosen]], width[odd]))
            if len(begin):
                langs.append(pa.array(c.langs).take(pa.array(c.lang[begin])))
                phrases.append(c.spelled(begin, words))
                counts.append(np.concatenate((total[chosen], np.ones(len(odd), np.int64))))
        if not langs:
            return pa.table([pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.int64())], names=["lang", "phrase", "n"])
        return pa.table([pa.concat_arrays(langs), pa.concat_arrays(phrases), pa.array(np.concatenate(counts), pa.int64())], names=["lang", "phrase", "n"])

    found = chunks.groupBy("chunk").cogroup(often.groupBy("chunk")).applyInArrow(run, "lang string, phrase string, n long")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("phrase").isNull())


def collocations(docs: DataFrame, first: int = 2000, least: int = 10, most_words: int = 3, share: int = 50, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of two words and more of each language by score, a (both falling) and phrase.

    a is the phrase's count, l and r are those of its parts where it is cut so that the score floor(1000000 * a * a / (l * r)) is
    least (the shortest first part of equals), n is the number of the language's words. A phrase drops out where a longer one of up to
    most_words words, dropped out or not, holds its words and is counted at least share % as often. Counts up to 1e16 are exact. Nulls, repeated rows and
    empty tables: as in `phrase_counts`.
    """
    counts = kept(phrase_counts(docs, least, most_words, lang, text), "phrase-counts", compression="zstd")
    frequent = counts.where("phrase is not null").select("lang", "phrase", "n", F.split("phrase", " ").alias("words"))
    longer = frequent.where(F.size("words") > 1)
    # each way to cut a phrase meets the counts of both parts: parts of a frequent phrase are as frequent
    cut = longer.select("lang", "phrase", F.col("n").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", 1, F.col("k")), " ").alias("left"), F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("right"))
    parts = frequent.select("lang", "phrase", "n")
    for side, count in (("left", "l"), ("right", "r")):
        cut = cut.join(parts.select("lang", F.col("phrase").alias(side), F.col("n").alias(count)), ["lang", side])
    a, lr = F.col("a").cast("decimal(18,0)"), F.col("l").cast("decimal(18,0)") * F.col("r").cast("decimal(18,0)")
    cut = cut.withColumns({"top": a * a * F.lit(1_000_000).cast("decimal(7,0)"), "bottom": lr}).withColumn("score", F.expr("top div bottom"))
    least_cut = cut.groupBy("lang", "phrase").agg(F.min("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # phrases of two words and more inside each longer one, with the greatest count of those
    inside = longer.where(F.size("words") > 2).select("lang", "n", "words", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("width"))
    inside = inside.select("lang", "n", "words", "width", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("width") + 1)).alias("at"))
    inside = inside.select("lang", F.array_join(F.slice("words", F.col("at"), F.col("width")), " ").alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("held"))
    left = least_cut.join(inside, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("held") < share * F.col("a"), F.lit(True)))
    ranked = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = ranked.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= first)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    words = counts.where("phrase is null").select("lang", F.col("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
