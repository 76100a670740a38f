"""N-gram Jaccard self-join with Bayesian candidate pruning over MinHash values.

Classes: texts with the same set of word n-grams. Each class has a signature of MinHash values; classes that agree on
a band of it are candidates. A bucket's members are compared in blocks: values are compared a few at a time, and a
pair is dropped as soon as the posterior probability (uniform prior) that its similarity reaches the threshold falls
below `tolerance`; what is left is verified on the exact n-gram sets. A pair that shares several buckets is handled
in that of its first equal band alone. Blocks return links per class and a spanning forest of their links, never pairs.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .shared import col, kept, row_key, spare

WIDTH, THRESHOLD = 5, 0.8
#: MinHash values, the most of them in a band, and the most probable miss of a pair at the threshold.
_K, ROWS, MISS = 100, 4, 2e-6
STEP, BLOCK = 20, 256
_rng = np.random.default_rng(77)
_MUL = _rng.integers(1, 1 << 63, _K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, _K, dtype=np.uint64)
_BAND_KEYS = _rng.integers(1, 1 << 63, _K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_rows(threshold: float) -> int:
    """The most values in a band, up to ROWS, at which a pair at the threshold shares none with probability of at most MISS."""
    for rows in range(ROWS, 0, -1):
        if 0 < threshold <= 1 and (1 - threshold**rows) ** (_K // rows) <= MISS:
            return rows
    raise ValueError(f"{_K} MinHash values find no links at a threshold of {threshold} with a miss of at most {MISS}")


@lru_cache(16)
def least_matches(threshold: float, tolerance: float, most: int = _K, step: int = STEP) -> tuple[int, ...]:
    """After step, 2 * step, ... values: the least number of equal ones at which a pair stays.

    With a uniform prior, m equal values of n leave similarity a Beta(m + 1, n - m + 1) posterior, and
    P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(step, most + 1, step):
        below, m = 0.0, -1
        while below < tolerance and m < n:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def signatures(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """MinHash values (n x K, 32 bits) of sorted (shingle, text) pairs; all ones for a text without shingles."""
    out = np.full((n, _K), 0xFFFFFFFF, np.uint32)
    if not len(h):
        return out
    heads = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    rows = owner[heads]
    for k in range(_K):
        values = h * _MUL[k]
        values += _ADD[k]
        values >>= np.uint64(32)
        out[rows, k] = np.minimum.reduceat(values, heads).astype(np.uint32)
    return out


def band_hashes(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key of each band of so many values, the band's number taken in."""
    bands = _K // rows
    parts = sig[:, : bands * rows].reshape(len(sig), bands, rows).astype(np.uint64)
    return flat.mix((parts * _BAND_KEYS[: bands * rows].reshape(bands, rows)).sum(axis=2) + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _set_keys(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two order-free hashes of each text's set, and its size."""
    size = np.bincount(owner, minlength=n)
    keys = []
    for lane in (1, 2):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(flat.mix(h + flat.SHINGLE_KEYS[lane]))))
        ends = np.cumsum(size)
        keys.append(flat.mix(total[ends] - total[ends - size]).view(np.int64))
    return keys[0], keys[1], size


def text_shingles(raw: np.ndarray, offs: np.ndarray, width: int = WIDTH):
    starts, ends, doc = flat.word_spans(raw, offs)
    return flat.shingles(flat.word_hash(raw, starts, ends), doc, len(offs) - 1, width)


def signed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """id, row (its key), h1, h2, size, sig of every row of docs."""
    slim = docs.select(col(doc_id).cast("long").alias("id"), row_key(docs).alias("row"), col(text).alias("text"))

    def run(batches):
        for b in batches:
            raw, offs = flat.flat_bytes(b.column(2))
            for i, j in flat.chunks(offs, 1 << 20):
                h, owner = text_shingles(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], width)
                h1, h2, size = _set_keys(h, owner, j - i)
                sig = signatures(h, owner, j - i)
                data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * _K), j - i, [None, pa.py_buffer(np.ascontiguousarray(sig))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), *map(pa.array, (h1, h2, size)), data], names=["id", "row", "h1", "h2", "size", "sig"])

    return slim.mapInArrow(run, "id long, row struct<a: long, b: long>, h1 long, h2 long, size long, sig binary")


def _bands(classes: DataFrame, rows: int) -> DataFrame:
    """band, key, h1, h2 of every class."""
    slim, bands = classes.select("h1", "h2", "sig"), _K // rows

    def run(batches):
        band = np.tile(np.arange(bands, dtype=np.int32), 4096)
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                c = b.slice(i, 4096)
                sig = np.frombuffer(b"".join(c.column(2).to_pylist()), np.uint32).reshape(-1, _K)
                keys = band_hashes(sig, rows).ravel().view(np.int64)
                h1, h2 = (np.repeat(c.column(k).to_numpy(), bands) for k in (0, 1))
                yield pa.RecordBatch.from_arrays(list(map(pa.array, (band[: len(keys)], keys, h1, h2))), names=["band", "key", "h1", "h2"])

    return slim.mapInArrow(run, "band int, key long, h1 long, h2 long")


def _buckets(classes: DataFrame, rows: int) -> DataFrame:
    """key, band, members of the buckets of two or more classes; of buckets with the same members, that of the first band."""
    who = F.xxhash64("h1", "h2")
    found = _bands(classes, rows).groupBy("key").agg(F.min("band").alias("band"), F.count("*").alias("members"), F.bit_xor(who).alias("x"), F.sum(who.cast("decimal(20,0)")).alias("s"))
    found = found.where("members > 1")
    firsts = found.groupBy("members", "x", "s").agg(F.min(F.struct("band", "key")).alias("first"))
    return firsts.select("first.key", "first.band", "members")


def compare(sig: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that survive all steps of the comparison of their MinHash values."""
    equal = np.zeros(len(left), np.int32)
    for k, least in enumerate(least_matches(threshold, tolerance)):
        part = sig[:, k * STEP : (k + 1) * STEP]
        equal = equal + (part[left] == part[right]).sum(axis=1, dtype=np.int32)
        stay = equal >= least
        left, right, equal = left[stay], right[stay], equal[stay]
    return left, right


def verify(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold, by the exact sets."""
    size = np.array([len(s) for s in sets])
    if len(left) > 8 * len(sets):  # a dense block: one incidence matrix, some columns at a time
        terms, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        shared = np.zeros((len(sets), len(sets)), np.float32)
        for at in range(0, len(terms), 4096):
            i, j = np.searchsorted(column, (at, at + 4096))
            x = np.zeros((len(sets), 4096), np.float32)
            x[row[i:j], column[i:j] - at] = 1
            shared += x @ x.T
        both = shared[left, right].astype(np.int64)
    else:
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left.tolist(), right.tolist(), strict=True)], np.int64)
    return both >= threshold * (size[left] + size[right] - both) - 1e-9


def forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """(node, root) of all nodes that links join to a smaller root."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(x, r) for x in range(n) if (r := find(x)) != x]


def _compare_block(b: pa.Table, threshold: float, tolerance: float):
    """Rows (h1, h2, links, r1, r2) of one block pair: links of a class, or a link to the class (r1, r2)."""
    sig = np.frombuffer(b"".join(b["sig"].to_pylist()), np.uint32).reshape(-1, _K)
    sets = [np.frombuffer(x, np.uint64) for x in b["shingles"].to_pylist()]
    block, band = b["block"].to_numpy(), b["band"][0].as_py()
    one, two = b["low"][0].as_py(), b["high"][0].as_py()
    if one == two:
        left, right = np.triu_indices(len(sets), 1)
    else:
        a, c = np.flatnonzero(block == one), np.flatnonzero(block == two)
        left, right = np.repeat(a, len(c)), np.tile(c, len(a))
    if not len(left):
        return None
    # bands before this bucket's must differ: else the pair belongs to an earlier bucket
    parts = band_hashes(sig, band_rows(threshold))
    for k in range(band):
        stay = parts[left, k] != parts[right, k]
        left, right = left[stay], right[stay]
    left, right = compare(sig, left, right, threshold, tolerance)
    if not len(left):
        return None
    ok = verify(sets, left, right, threshold)
    left, right = left[ok], right[ok]
    if not len(left):
        return None
    weight = b["copies"].to_numpy()
    links = np.bincount(left, weight[right], len(sets)) + np.bincount(right, weight[left], len(sets))
    at = np.flatnonzero(links)
    tree = np.array(forest(len(sets), left, right), np.int64).reshape(-1, 2)
    h1, h2 = b["h1"].to_numpy(), b["h2"].to_numpy()
    node = np.concatenate((at, tree[:, 0]))
    value = pa.array(np.concatenate((links[at], np.zeros(len(tree)))).astype(np.int64))
    empty = [None] * len(at)
    return pa.RecordBatch.from_arrays([pa.array(h1[node]), pa.array(h2[node]), value, *(pa.array(empty + h[tree[:, 1]].tolist(), pa.int64()) for h in (h1, h2))], names=["h1", "h2", "links", "r1", "r2"])


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node) of every node with an edge (a, b); nodes are structs, all in files between rounds.

    Each round points every node at the least neighbour of its neighbourhood (a large step, then a small one), so
    paths shorten as by doubling; hubs are sums by partial aggregates and joins, never lists.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    current = kept(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:  # each round lowers what edges point at, so the rounds come to an end, after about log n of them
        row = current.agg(F.count("*").alias("n"), F.count_distinct("a").alias("d")).first()
        # every node has one edge and no root has any: a forest of stars
        if row.n == row.d and not current.join(current.select(F.col("a").alias("b")), "b", "left_semi").take(1):
            break
        current = kept(star(star(current, True), False), "links")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = 1e-6, width: int = WIDTH) -> DataFrame:
    """id, row (its key), class_id, copy_id, n_links, n_copies of every row of docs.

    copy_id: least id of the rows with the same n-gram set; n_copies: how many rows have it; class_id: least id of all
    rows that links of at least `threshold` join, directly or through others; n_links: rows with a similarity of at
    least `threshold` to this one, copies taken in. Texts of 1 to width - 1 words have one n-gram; null texts and
    texts without words have none, no links, and themselves as class. Null ids are skipped in least ids.
    A pair at the threshold is missed with a probability of at most MISS: below 0.8 bands hold fewer values, so buckets
    and candidates grow, and a threshold too low for any band is an error.
    """
    per_band = band_rows(threshold)
    rows = kept(signed(docs, doc_id, text, width), "ngram-rows")
    worded = rows.where("size > 0")
    classes = worded.groupBy("h1", "h2").agg(F.min("id").alias("copy_id"), F.count("*").alias("copies"), F.min("row").alias("row"), F.first("sig").alias("sig"))
    classes = kept(classes, "ngram-classes")
    buckets = kept(_buckets(classes, per_band), "ngram-buckets")
    members = kept(_bands(classes, per_band).join(buckets, ["key", "band"]), "ngram-members")
    wanted = kept(members.select("h1", "h2").distinct().join(classes, ["h1", "h2"]), "ngram-wanted")
    sets = kept(_sets(docs, wanted, doc_id, text, width), "ngram-sets")
    verified = kept(_verified(members, sets, threshold, tolerance), "ngram-links")

    node = F.struct("h1", "h2")
    roots = components(verified.where("r1 is not null").select(node.alias("a"), F.struct(F.col("r1").alias("h1"), F.col("r2").alias("h2")).alias("b")))
    roots = kept(roots.select("node.h1", "node.h2", F.col("root.h1").alias("r1"), F.col("root.h2").alias("r2")), "ngram-roots")
    links = verified.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    slim = classes.select("h1", "h2", "copy_id", "copies")
    placed = slim.join(roots, ["h1", "h2"], "left").join(links, ["h1", "h2"], "left")
    placed = placed.select("h1", "h2", "copy_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("r1", "h1").alias("r1"), F.coalesce("r2", "h2").alias("r2"))
    ids = placed.groupBy("r1", "r2").agg(F.min("copy_id").alias("class_id"))
    placed = placed.join(ids, ["r1", "r2"])
    of = rows.select("id", "row", "h1", "h2", "size").join(placed, ["h1", "h2"], "left")
    return of.select(
        "id", "row", F.when(F.col("size") > 0, F.col("class_id")).otherwise(F.col("id")).alias("class_id"), F.when(F.col("size") > 0, F.col("copy_id")).otherwise(F.col("id")).alias("copy_id"),
        F.when(F.col("size") > 0, F.col("links") + F.col("copies") - 1).otherwise(0).cast("long").alias("n_links"), F.when(F.col("size") > 0, F.col("copies")).otherwise(1).cast("long").alias("n_copies"),
        "r1", "r2", (F.col("size") > 0).alias("worded"),
    )


def _sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """h1, h2, copies, sig, shingles of the wanted classes, from one row of each."""
    rows = docs.select(row_key(docs).alias("row"), col(text).alias("text"))
    met = rows.join(wanted.select("row", "h1", "h2"), "row").select("h1", "h2", "text")

    def run(batches):
        for b in batches:
            raw, offs = flat.flat_bytes(b.column(2))
            h1, h2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, j in flat.chunks(offs, 1 << 20):
                h, owner = text_shingles(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], width)
                k1, k2, size = _set_keys(h, owner, j - i)
                ends = np.cumsum(size)
                keep = [k for k in range(j - i) if k1[k] == h1[i + k] and k2[k] == h2[i + k]]
                yield pa.RecordBatch.from_arrays([pa.array(h1[i:j][keep]), pa.array(h2[i:j][keep]), pa.array([h[ends[k] - size[k] : ends[k]].tobytes() for k in keep], pa.binary())], names=["h1", "h2", "shingles"])

    sets = met.mapInArrow(run, "h1 long, h2 long, shingles binary")
    # rows that repeat one another bring their set more than once
    sets = sets.groupBy("h1", "h2").agg(F.first("shingles").alias("shingles"))
    return sets.join(wanted.select("h1", "h2", "copies", "sig"), ["h1", "h2"])


def _verified(members: DataFrame, sets: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    n_blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("h1", "h2"), n_blocks).cast("int")
    placed = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    placed = placed.select("h1", "h2", "key", "band", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    rows = placed.join(sets, ["h1", "h2"]).repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "h1", "h2")

    def run(batches):
        for table in flat.groups(batches, ["key", "low", "high"]):
            out = _compare_block(table, threshold, tolerance)
            if out is not None:
                yield out

    return rows.mapInArrow(run, "h1 long, h2 long, links long, r1 long, r2 long")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row of each class: that with the least id (null ids last), then the least key of the row.

    Rows without words stay. Of rows that repeat one another in all columns, one stays if any does. The columns of docs,
    whatever their names and types, are those of the result.
    """
    found = join(docs, doc_id, text, **options)
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    worded = found.where("worded")
    chosen = worded.groupBy("r1", "r2").agg(F.min(rank).alias("least")).select("least.row")
    same = worded.groupBy("row").agg(F.count("*").alias("rows"))
    keepers = kept(chosen.join(same, "row").unionByName(found.where("not worded").select("row", F.lit(1).cast("long").alias("rows")).distinct()), "ngram-keepers")
    key, count = spare("row", docs), spare("rows", docs)
    stay = docs.withColumn(key, row_key(docs)).join(keepers.select(F.col("row").alias(key), F.col("rows").alias(count)), key)
    once = stay.where(col(count) == 1).drop(key, count)
    return once.unionByName(stay.where(col(count) > 1).dropDuplicates([key]).drop(key, count)).select(*map(col, docs.columns))
