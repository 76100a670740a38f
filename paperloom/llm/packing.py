"""Packing documents into sequences along a space-filling curve.

1. Each document's tokens are hashed into a vector of `BUCKETS` damped counts of length 1, which a fixed random matrix
   projects to `DIMS` dimensions; the Hilbert index of that point, `BITS` bits a dimension, is the document's key.
2. Keys, ids and lengths alone, a small row for each document, are range-sorted; totals of the range partitions, a row
   for each, give every document its place in one stream of tokens in the order of the curve.
3. The stream is cut each `size` tokens, so neighbours on the curve share a sequence and no sequence is padded. The rest
   of less than `size` tokens is cut into powers of two, largest first, which need no padding either.

A sequence thus holds what one stretch of the curve holds, whatever the lengths of documents. Texts travel nowhere: ids
are written once beside their keys and meet their places in a join by row.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import flat
from .bpe import _text_chunks, word_bpe
from .shared import col, kept, map_columns

SIZE, BUCKETS, DIMS, BITS = 2048, 256, 4, 15
_rng = np.random.default_rng(20250311)
#: A direction for each bucket of the hashed vectors.
_DIRECTIONS = _rng.standard_normal((BUCKETS, DIMS))
#: Vectors of a chunk of documents that are held at once.
_ROWS = 2_048


def hilbert_index(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The index along the Hilbert curve of points with whole coordinates of `bits` bits, a row each.

    Coordinates are first brought to the curve's own axes, highest bit first: where a coordinate has the bit, the lower bits of
    the first are inverted, else they change places with the coordinate's own. A Gray code then gives the digits of the index.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for k in range(dims):
            has = (x[k] >> bit & 1).astype(bool)
            swap = np.where(has, 0, (x[0] ^ x[k]) & low)
            x[0] ^= np.where(has, low, swap)
            x[k] ^= swap
    for k in range(1, dims):
        x[k] ^= x[k - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= turn
    out = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for k in range(dims):
            out = out << 1 | x[k] >> bit & 1
    return out


def curve_keys(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The Hilbert key of each document, from the ids of all documents end to end; documents without ids lie in the middle."""
    bucket = (flat.mix(ids.astype(np.uint64) + np.uint64(1)) % np.uint64(BUCKETS)).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(counts)))
    keys = []
    for i in range(0, len(counts), _ROWS):
        n = counts[i : i + _ROWS]
        owner = np.repeat(np.arange(len(n)), n)
        vectors = np.bincount(owner * BUCKETS + bucket[ends[i] : ends[i + len(n)]], minlength=len(n) * BUCKETS).reshape(len(n), BUCKETS)
        vectors = np.log1p(vectors)
        length = np.sqrt((vectors * vectors).sum(1, keepdims=True))
        at = (vectors / np.maximum(length, 1e-12)) @ _DIRECTIONS
        # a logistic curve spreads a coordinate, of variance about 1, over the cells
        cells = np.minimum((1 << BITS) / (1 + np.exp(-1.7 * at)), (1 << BITS) - 1)
        keys.append(hilbert_index(cells))
    return np.concatenate(keys) if keys else np.zeros(0, np.int64)


def _encoded(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """part, row (which name a row of docs), key, doc_id, doc_tokens, ids."""

    def run(batches):
        bpe, row = word_bpe(vocabulary), 0
        for b in batches:
            for i, part in _text_chunks(b.column(1)):
                got, counts = bpe.encode(part)
                keys = curve_keys(got, counts)
                got = np.insert(got, np.cumsum(counts), np.int32(end_id))
                counts = counts + 1
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(got, pa.int32()))
                task = np.full(len(part), TaskContext.get().partitionId(), np.int32)
                rows = np.arange(row, row + len(part))
                row += len(part)
                yield [pa.array(task), pa.array(rows), pa.array(keys), b.column(0).slice(i, len(part)), pa.array(counts), lists]

    fields = StructType.fromDDL("part int, row long, key long, doc_id string, doc_tokens long, ids array<int>").fields
    fields[3] = docs.schema.fields[0]
    return map_columns(docs, run, fields)


def _places(encoded: DataFrame) -> DataFrame:
    """part, row, stream_at: tokens of the stream before each document, in the order of key, id, length and row."""
    order = ["key", "id", "doc_tokens", "part", "row"]
    slim = encoded.select("part", "row", "key", col(encoded.columns[3]).alias("id"), "doc_tokens")
    slim = kept(slim.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "packing-order")
    totals = slim.groupBy("range").agg(F.sum("doc_tokens").alias("total"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = slim.withColumn("own", F.coalesce(F.sum("doc_tokens").over(own), F.lit(0)))
    return inside.join(totals, "range").select("part", "row", (F.col("base") + F.col("own")).cast("long").alias("stream_at"))


def cut_points(total: int, size: int) -> np.ndarray:
    """Ends of the sequences behind the last whole one: powers of two that add up to the rest, largest first."""
    rest, at = total % size, total - total % size
    powers = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    return at + np.cumsum(powers, dtype=np.int64)


def pack(
    docs: DataFrame, vocabulary: str, end_id: int, size: int = SIZE, doc_id: str = "doc_id", text: str = "text", checksums: bool = False,
) -> DataFrame:
    """A row for each piece of a document: doc_id, start (its document's ids before it), length, ids, doc_tokens, sequence_id and offset.

    A document's ids are those of its whole text and end_id; a null text is empty, so every row of docs, repeated ones and null
    ids taken in, has at least one piece. With checksums ids_crc32, of the ids as little-endian unsigned 32-bit integers, stands
    in place of ids. Sequences count from 0 without gaps; each has `size` tokens but the last few, of powers of two. Documents
    of equal keys go by id and length (rows equal in these are told apart by their place in the input, so reruns over the same files
    agree). Columns of docs other than these two are left out; an empty table has no pieces.
    """
    encoded = kept(_encoded(docs.select(col(doc_id), col(text)), vocabulary, end_id).toDF("part", "row", "key", "doc_id", "doc_tokens", "ids"), "packing-ids", compression="zstd")
    total = encoded.agg(F.coalesce(F.sum("doc_tokens"), F.lit(0))).first()[0]
    ends = cut_points(total, size)
    whole = total // size

    placed = encoded.join(_places(encoded), ["part", "row"]).select("doc_id", "doc_tokens", "stream_at", "ids")
    fields = StructType.fromDDL(f"doc_id string, start long, length long, {'ids_crc32 long' if checksums else 'ids array<int>'}, doc_tokens long, sequence_id long, offset long").fields
    fields[0] = StructField(doc_id, placed.schema["doc_id"].dataType)

    def run(batches):
        for b in batches:
            lists = b.column(3)
            ids, offs = lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
            n, at = np.diff(offs), b.column(2).to_numpy()
            last = np.searchsorted(ends, at + n, "left") + np.minimum((at + n - 1) // size, whole)
            first = np.searchsorted(ends, at, "right") + np.minimum(at // size, whole)
            pieces = last - first + 1
            owner = np.repeat(np.arange(b.num_rows), pieces)
            sequence = flat.ragged(first, pieces)
            begins, finish = _bounds(sequence, ends, size, whole)
            left, right = np.maximum(begins, at[owner]), np.minimum(finish, (at + n)[owner])
            start, length = left - at[owner], right - left
            lo = offs[owner] + start
            if checksums:
                raw = np.ascontiguousarray(ids, "<u4")
                made = pa.array([zlib.crc32(raw[i : i + m]) for i, m in zip(lo.tolist(), length.tolist(), strict=True)], pa.int64())
            else:
                made = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))), pa.int32()), pa.array(ids[flat.ragged(lo, length)], pa.int32()))
            yield [b.column(0).take(pa.array(owner)), pa.array(start), pa.array(length), made, pa.array(n[owner]), pa.array(sequence), pa.array(left - begins)]

    return map_columns(placed, run, fields)


def _bounds(sequence: np.ndarray, ends: np.ndarray, size: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """Where in the stream each sequence begins and ends."""
    edges = np.concatenate(([whole * size], ends))
    late = np.clip(sequence - whole, 0, max(len(edges) - 2, 0))
    tail = sequence >= whole
    after = edges[np.minimum(late + 1, len(edges) - 1)]
    return np.where(tail, edges[late], sequence * size), np.where(tail, after, (sequence + 1) * size)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id and ids of each sequence, from pieces with their ids; at most `size` tokens meet in a group."""
    grouped = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids: Column = F.flatten(F.transform("parts", lambda p: p["ids"]))
    return grouped.select("sequence_id", ids.alias("ids"))

