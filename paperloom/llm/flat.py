"""Vectorised text scanning: many texts lie in one flat byte or code-point array.

Every helper takes whole texts; `chunks` only bounds how many of them share one array, so
memory follows CHUNK_BYTES (or one longer text), never the partition.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
#: A polynomial modulo 2**64 tells spans of up to so many bytes apart; longer ones (of which Thue-Morse words collide
#: for any base) are hashed by blake2b.
POLYNOMIAL_BYTES = 64
_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_rng = np.random.default_rng(20240607)
_BYTE_KEYS = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * _U(2) + _U(1)
SHINGLE_KEYS = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) * _U(2) + _U(1)
_powers = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a polynomial hash count."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(29))
    h = h * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse, modulo 2**64."""
    if len(_powers["p"]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        for name, base in (("p", _P), ("q", _P_INV)):
            steps = np.full(size, _U(base))
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["p"], _powers["q"]


def flat_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string array end to end, and len + 1 offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES):
    """(first, last) ranges of whole texts with about `limit` bytes, at least one text each."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(buf: np.ndarray, offs: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of all runs of bytes other than space, \\t, \\n, \\v, \\f, \\r, or those marked in space."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~space[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = offs[:-1][np.diff(offs) > 0]
    begins[at] = inside[at]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    last = at[1:] - 1
    closes[last] = inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(offs, starts, "right") - 1


def prefix_hash(buf: np.ndarray, lane: int = 0) -> np.ndarray:
    p, _ = powers(len(buf))
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE_KEYS[lane][buf] * p[: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes in each span, the same wherever these bytes stand."""
    _, q = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * q[starts] + (ends - starts).astype(np.uint64) * _U(_P))


def word_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes in each span, which may be of any length and kind."""
    out = span_hash(prefix_hash(buf), starts, ends)
    for k in np.flatnonzero(ends - starts > POLYNOMIAL_BYTES).tolist():
        out[k] = int.from_bytes(blake2b(buf[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return out


def equal_spans(one: np.ndarray, a: np.ndarray, a_end: np.ndarray, two: np.ndarray, b: np.ndarray, b_end: np.ndarray, limit: int = CHUNK_BYTES) -> np.ndarray:
    """Whether the items of one from a to a_end and those of two from b to b_end are the same, span by span."""
    size = a_end - a
    same = size == b_end - b
    at = np.flatnonzero(same & (size > 0))
    ends = np.cumsum(size[at])
    i = 0
    while i < len(at):  # about `limit` items at a time
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right")))
        k = at[i:j]
        n = size[k]
        differ = one[ragged(a[k], n)] != two[ragged(b[k], n)]
        same[k] = ~np.logical_or.reduceat(differ, np.cumsum(n) - n)
        i = j
    return same


def shingles(words: np.ndarray, doc: np.ndarray, n_docs: int, width: int = 5):
    """Distinct word n-grams of each text: (hashes, text numbers), sorted by both.

    A text of one to width - 1 words has one shingle, of all its words; one without words has none.
    """
    counts = np.bincount(doc, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(counts)))
    rank = np.arange(len(words)) - first[doc]
    full = np.flatnonzero(rank + width <= counts[doc])
    h = np.zeros(len(full), np.uint64)
    for k in range(width):
        h += words[full + k] * SHINGLE_KEYS[k]
    owner = doc[full]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            extra[has] += words[first[short[has]] + k] * SHINGLE_KEYS[8 + k]
        h, owner = np.concatenate((h, extra)), np.concatenate((owner, short))
    h = mix(h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[new], owner[new]
    return h, owner


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0].., starts[1].. of `lengths` items each, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(starts - (ends - lengths), lengths)


def groups(batches, keys: list[str], most_rows: int | None = None):
    """Arrow tables with all rows of one key each, from batches sorted by the keys.

    With most_rows, neighbouring keys share a table until it has that many rows; a key is never split.
    """
    held: list[pa.RecordBatch] = []

    def cuts(batch: pa.RecordBatch) -> np.ndarray:
        change = np.zeros(max(0, batch.num_rows - 1), bool)
        for k in keys:
            c = batch.column(k).to_numpy(zero_copy_only=False)
            change |= np.asarray(c[1:] != c[:-1], bool)
        return np.flatnonzero(change) + 1

    def key(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch.column(k)[i].as_py() for k in keys)

    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and key(held[-1], held[-1].num_rows - 1) != key(batch, 0) and (not most_rows or rows >= most_rows):
            yield pa.Table.from_batches(held)
            held, rows = [], 0
        at = 0
        for cut in cuts(batch).tolist():
            if not most_rows or rows + cut - at >= most_rows:
                held.append(batch.slice(at, cut - at))
                yield pa.Table.from_batches(held)
                held, rows, at = [], 0, cut
        held.append(batch.slice(at))
        rows += batch.num_rows - at
    if held:
        yield pa.Table.from_batches(held)
