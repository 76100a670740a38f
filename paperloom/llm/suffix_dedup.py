"""Suffix-array de-duplication by bucket-pointer refinement.

Removes each byte covered by a string of `length` bytes that also starts earlier in the corpus. The suffixes are
sorted only as deep as `length`, and only where they share a bucket:

1. Initial q-gram buckets, distributed. Of the q-grams of each string of `length` bytes, that with the least hash
   (leftmost of equals) anchors the string, so equal strings have equal anchors at equal offsets, and the starts of
   a text fall into runs, one for each anchor. Buckets of a single suffix are final at once, as in the plain method:
   anchors that occur once in the corpus drop out after a count by hash.
2. What is left is pre-aggregated: runs with equal bytes collapse to their earliest, the others are covered whole.
   A run of copies therefore never meets in one task, however often it repeats. Runs are known by their anchor's hash
   and a blake2b digest of their bytes.
3. Refinement, in each task. The earliest runs of a bucket lie end to end in one text; a start's bucket pointer is
   the rank of its first 8 bytes; pointers are then refined by the pointers of later offsets, 8 to 16 to 32 to 64
   bytes, the new pointers being used for the next step, and last to `length` by an overlapping offset. Starts that
   share a pointer are equal strings. Buckets with many unlike runs are split over tasks by a salt; the first start
   of each class then meets those of other salts in an aggregate by the class's digest.

Documents are keyed by k1 (doc_id, null as the least long) and k2 (hash of the text). Earlier means a smaller key, or
the same key and an earlier start. Rows that repeat an id and a text are one document and get the same result.
"""

from __future__ import annotations

from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import flat
from .shared import col, kept

LENGTH, Q = 100, 32
#: A bucket with more unlike runs than this is split by a salt; a task refines about so many runs at once.
SALT_RUNS, REFINE_ROWS = 2_000, 12_000
_CHUNK = 1 << 19


def window_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Index of the least value, by its high bits, in each window of `width` values; leftmost of equals."""
    bits = max(24, len(h).bit_length())
    best = (h >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span < width:  # windows of `span` values merge pairwise until they reach `width`
        step = min(span, width - span)
        best = np.minimum(best[: len(best) - step], best[step:])
        span += step
    return (best & np.uint64((1 << bits) - 1)).astype(np.int64)


def anchored_runs(raw: np.ndarray, offs: np.ndarray, length: int = LENGTH, q: int = Q):
    """(anchor hash, text number, first start, starts after it) of all runs; starts are byte offsets in the flat array."""
    z = np.zeros(0, np.int64)
    if len(raw) < length:
        return z.astype(np.uint64), z, z, z
    prefix = flat.prefix_hash(raw)
    _, inverse = flat.powers(len(raw))
    order = (prefix[q:] - prefix[:-q]) * inverse[: len(raw) - q + 1]
    anchor = window_argmin(order, length - q + 1)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(anchor)]
    inside = np.arange(len(anchor)) + length <= offs[doc + 1]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return z.astype(np.uint64), z, z, z
    doc, anchor = doc[starts], anchor[starts]
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))))
    more = np.diff(np.append(new, len(starts))) - 1
    at = anchor[new]
    return flat.span_hash(prefix, at, at + q), doc[new], starts[new], more


def refine(text: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A bucket pointer for each start, equal just where the strings of `length` bytes there are equal.

    Bucket pointers of all positions are refined by those at later offsets; positions alone in their bucket keep
    their pointer, as nothing can tell them from others further.
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    code = np.zeros(n, np.uint64)
    for k in range(8):
        code = (code << np.uint64(8)) | padded[k : n + k]
    pointer = _ranks(code)
    depth = 8
    while depth < length:
        step = min(depth, length - depth)
        later = np.concatenate((pointer[step:], np.full(step, -1, np.int64)))[:n]
        pointer = _refined(pointer, later)
        depth += step
    return pointer[starts]


def _ranks(code: np.ndarray) -> np.ndarray:
    return np.unique(code, return_inverse=True)[1].astype(np.int64)


def _refined(pointer: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Sub-buckets of each bucket by the later pointers: only buckets of two or more are sorted."""
    size = np.bincount(pointer)
    open_ = np.flatnonzero(size[pointer] > 1)
    if not len(open_):
        return pointer
    a, b = pointer[open_], later[open_]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    head = np.concatenate(([True], a[1:] != a[:-1]))
    sub = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    # a bucket's first sub-bucket keeps its pointer, the others get new ones
    out = pointer.copy()
    fresh = np.cumsum(sub & ~head)
    own = np.flatnonzero(sub)
    label = np.where(head[own], a[own], len(size) - 1 + fresh[own])
    out[open_[order]] = label[np.cumsum(sub) - 1]
    return out


def _keyed(docs: DataFrame, doc_id: str, text: str, *more: Column) -> DataFrame:
    """k1, k2, the text (null as empty) and what more is asked for; no other column of docs."""
    body = F.coalesce(col(text), F.lit(""))
    return docs.select(F.coalesce(col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("k1"), F.xxhash64(body).alias("k2"), body.alias("text"), *more)


def _anchors(texts: DataFrame, length: int, q: int, keyed: bool) -> DataFrame:
    """anchor of every run; keyed: k1, k2 and the distinct anchors of each document."""

    def run(batches):
        for b in batches:
            raw, offs = flat.flat_bytes(b.column(b.num_columns - 1))
            for i, j in flat.chunks(offs, _CHUNK):
                h, d, _, _ = anchored_runs(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], length, q)
                h = h.view(np.int64)
                if not keyed:
                    yield pa.RecordBatch.from_arrays([pa.array(h)], names=["anchor"])
                    continue
                order = np.lexsort((h, d))
                h, d = h[order], d[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                h, d = h[new], d[new]
                keys = [pa.array(b.column(k).to_numpy()[i + d]) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(h), *keys], names=["anchor", "k1", "k2"])

    if not keyed:
        return texts.select("text").mapInArrow(run, "anchor long")
    return texts.mapInArrow(run, "anchor long, k1 long, k2 long")


def _digests(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of blake2b of each run of bytes; together with the anchor's hash they stand for the run."""
    data = raw.tobytes()
    return np.frombuffer(b"".join([blake2b(data[s:e], digest_size=8).digest() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]), np.int64)


def shared_runs(texts: DataFrame, length: int, q: int) -> DataFrame:
    """anchor, h (of the run's bytes), k1, k2, first, more: all runs whose anchor the corpus repeats."""
    shared = _anchors(texts, length, q, False).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    held = _anchors(texts, length, q, True).join(shared, "anchor", "left_semi")
    held = kept(held.groupBy("k1", "k2").agg(F.collect_set("anchor").alias("anchors")), "suffix-held")

    def run(batches):
        for b in batches:
            raw, offs = flat.flat_bytes(b.column(2))
            k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            lists = b.column(3)
            at, wanted = lists.offsets.to_numpy(), lists.values.to_numpy()
            for i, j in flat.chunks(offs, _CHUNK):
                part = raw[offs[i] : offs[j]]
                h, d, first, more = anchored_runs(part, offs[i : j + 1] - offs[i], length, q)
                # membership in the text's own list, for all texts of the chunk at once
                owner = np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))
                have = np.sort(flat.mix(wanted[at[i] : at[j]].view(np.uint64)) + owner.astype(np.uint64) * flat.SHINGLE_KEYS[0])
                probe = flat.mix(h) + d.astype(np.uint64) * flat.SHINGLE_KEYS[0]
                if not len(have) or not len(probe):
                    continue
                hit = have[np.minimum(np.searchsorted(have, probe), len(have) - 1)] == probe
                h, d, first, more = h[hit], d[hit], first[hit], more[hit]
                whole = _digests(part, first, first + more + length)
                own = first - (offs[i + d] - offs[i])
                columns = (h.view(np.int64), whole, k1[i + d], k2[i + d], own, more)
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["anchor", "h", "k1", "k2", "first", "more"])

    return texts.join(held, ["k1", "k2"]).mapInArrow(run, "anchor long, h long, k1 long, k2 long, first long, more long")


def with_bytes(texts: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """anchor, salts, h, k1, k2, first and the bytes of the runs, from the texts that hold them."""
    packed = runs.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "salts", "h", "first", "more")).alias("runs"))

    def run(batches):
        for b in batches:
            raw, offs = flat.flat_bytes(b.column(2))
            lists = b.column(3)
            owner = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            items = lists.flatten()
            anchor, salts, h, first, more = (items.field(k) for k in range(5))
            begin, size = offs[owner] + first.to_numpy(), more.to_numpy() + length
            k1, k2 = b.column(0).to_numpy()[owner], b.column(1).to_numpy()[owner]
            for i in range(0, len(owner), 10_000):
                c = slice(i, i + 10_000)
                cuts = np.concatenate(([0], np.cumsum(size[c]))).astype(np.int32)
                got = np.ascontiguousarray(raw[flat.ragged(begin[c], size[c])])
                data = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(got)])
                yield pa.RecordBatch.from_arrays([*(x.slice(i, 10_000) for x in (anchor, salts, h)), pa.array(k1[c]), pa.array(k2[c]), first.slice(i, 10_000), data], names=["anchor", "salts", "h", "k1", "k2", "first", "bytes"])

    return texts.join(packed, ["k1", "k2"]).mapInArrow(run, "anchor long, salts int, h long, k1 long, k2 long, first long, bytes binary")


def refined_ranges(texts: DataFrame, least: DataFrame, length: int) -> DataFrame:
    """k1, k2, first, last, digest from the earliest runs: without a digest, a range of starts that repeat within a task;
    with one, the first start of its class in a bucket that several tasks share."""
    sizes = least.groupBy("anchor").agg(F.count("*").alias("runs")).where("runs > 1")
    rows = least.join(sizes, "anchor").select("anchor", "h", "place.k1", "place.k2", "place.first", "more", F.ceil(F.col("runs") / SALT_RUNS).cast("int").alias("salts"))
    rows = with_bytes(texts, rows, length).select("anchor", "k1", "k2", "first", "bytes", "salts", F.pmod("h", "salts").cast("int").alias("salt"))
    rows = rows.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")

    def run(batches):
        for table in flat.groups(batches, ["anchor", "salt"], REFINE_ROWS):
            yield _refine_table(table.combine_chunks().to_batches()[0], length)

    return rows.mapInArrow(run, "k1 long, k2 long, first long, last long, digest binary")


def _refine_table(b: pa.RecordBatch, length: int) -> pa.RecordBatch:
    # of rows that repeat a document, each brings its runs: they count once
    place = np.stack([b.column(k).to_numpy() for k in (1, 2, 3)])
    order = np.lexsort(place)
    again = order[1:][(place[:, order[1:]] == place[:, order[:-1]]).all(0)]
    if len(again):
        b = b.take(pa.array(np.delete(np.arange(b.num_rows), again)))
    column = b.column(4).cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    offs = offs - offs[0]
    sizes = np.diff(offs) - length + 1
    owner = np.repeat(np.arange(b.num_rows), sizes)
    within = flat.ragged(np.zeros(b.num_rows, np.int64), sizes)
    pointer = refine(raw, offs[owner] + within, length)
    k1, k2, first = (b.column(k).to_numpy() for k in (1, 2, 3))
    start = first[owner] + within
    order = np.lexsort((start, k2[owner], k1[owner], pointer))
    p = pointer[order]
    again = np.zeros(len(p), bool)
    again[1:] = p[1:] == p[:-1]
    repeat = np.zeros(len(p), bool)
    repeat[order] = again
    at = np.flatnonzero(repeat)
    if len(at):
        cut = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]]))))
        lo, hi = at[cut], at[np.append(cut[1:], len(at)) - 1]
    else:
        lo = hi = at
    single = np.flatnonzero((b.column(5).to_numpy() > 1)[owner] & ~repeat)
    digests = [sha256(raw[s : s + length]).digest()[:16] for s in (offs[owner[single]] + within[single]).tolist()]
    rows, ends = np.concatenate((lo, single)), np.concatenate((hi, single))
    return pa.RecordBatch.from_arrays(
        [*map(pa.array, (k1[owner[rows]], k2[owner[rows]], start[rows], start[ends])), pa.array([None] * len(lo) + digests, pa.binary())],
        names=["k1", "k2", "first", "last", "digest"],
    )


def duplicate_ranges(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, q: int = Q) -> DataFrame:
    """k1, k2, ranges: for each document with repeats, an array of (first, last) starts of strings that start earlier too."""
    if not q + 8 <= length <= 255:
        raise ValueError("length must lie between q + 8 and 255")
    texts = _keyed(docs, doc_id, text)
    found = kept(shared_runs(texts, length, q), "suffix-found", compression="zstd")
    place = F.struct("k1", "k2", "first")
    least = kept(found.groupBy("anchor", "h").agg(F.min(place).alias("place"), F.first("more").alias("more"), F.count("*").alias("n")), "suffix-least", compression="zstd")
    refined = kept(refined_ranges(texts, least, length), "suffix-refined")
    # of equal runs, all but the earliest are covered whole
    early = least.where("n > 1").select("anchor", "h", F.col("place").alias("least"))
    copies = found.join(early, ["anchor", "h"]).where(place != F.col("least"))
    copies = copies.select("k1", "k2", "first", (F.col("first") + F.col("more")).alias("last"))
    ranges = refined.where("digest is null").select("k1", "k2", "first", "last")
    classes = refined.where("digest is not null").select("digest", "k1", "k2", "first")
    firsts = classes.groupBy("digest").agg(F.min(place).alias("least"), F.count("*").alias("n")).where("n > 1")
    split = classes.join(firsts, "digest").where(place != F.col("least")).select("k1", "k2", "first", F.col("first").alias("last"))
    every = copies.unionByName(ranges).unionByName(split)
    return kept(every.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last")).alias("ranges")), "suffix-ranges", compression="zstd")


def covered(ranges: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal (begin, end) byte runs that the strings starting in the ranges cover."""
    out: list[list[int]] = []
    for first, last in sorted((r["first"], r["last"]) for r in ranges or ()):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [(a, b) for a, b in out]


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, q: int = Q, digests: bool = False) -> DataFrame:
    """docs with repeated strings cut out of their texts, or with digests the figures of the cut.

    digests: doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row. Otherwise the columns of docs, the text
    being what is left of it; what is left of a character that lost some of its bytes goes too, and a null text stays
    null. Null and empty texts have no bytes; texts under `length` bytes keep all.
    """
    ranges = duplicate_ranges(docs, doc_id, text, length, q)
    others = [] if digests else [c for c in docs.columns if c != text]
    # the caller's columns travel in a struct, by number: no name of theirs meets one of this module
    rest = F.struct(*(col(c).alias(f"c{i}") for i, c in enumerate(others)), F.lit(0).alias("none"))
    slim = _keyed(docs, doc_id, text, col(doc_id).alias("id"), col(text).isNull().alias("is_null"), rest.alias("rest"))
    joined = slim.join(ranges, ["k1", "k2"], "left").select("id", "text", "is_null", "rest", "ranges")
    kind, packed = slim.schema["id"].dataType.simpleString(), slim.schema["rest"].dataType.simpleString()

    def cut(batches):
        for b in batches:
            for i in range(0, b.num_rows, 200):
                c = b.slice(i, 200)
                rows = []
                for t, ranges in zip(c.column(1).to_pylist(), c.column(4).to_pylist(), strict=True):
                    data, at, left = t.encode("utf-8"), 0, []
                    spans = covered(ranges, length)
                    for begin, end in spans:
                        left.append(data[at:begin])
                        at = end
                    left.append(data[at:])
                    rows.append((data, b"".join(left), len(spans)))
                if digests:
                    columns = [[len(x) for x, _, _ in rows], [len(x) - len(y) for x, y, _ in rows], [n for _, _, n in rows], [sha256(y).hexdigest() for _, y, _ in rows]]
                    yield pa.RecordBatch.from_arrays([c.column(0), *(pa.array(x) for x in columns)], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
                else:
                    texts = [None if null else y.decode("utf-8", "ignore") for (_, y, _), null in zip(rows, c.column(2).to_pylist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([c.column(3), pa.array(texts, pa.string())], names=["rest", "text"])

    if digests:
        out = joined.mapInArrow(cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
        return out.select(F.col("id").alias(doc_id), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    out = joined.mapInArrow(cut, f"rest {packed}, text string")
    return out.select(*(F.col("text").alias(c) if c == text else F.col(f"rest.c{others.index(c)}").alias(c) for c in docs.columns))
