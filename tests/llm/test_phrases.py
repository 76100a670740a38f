"""Phrase counts and collocations against loops over small tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from paperloom.llm import flat, phrases

ROWS = [
    (None, "und is a language"), ("und", "und is a language"), ("en", None), ("en", ""), ("en", " \t "), ("en", "A b\x0bA b\x0cA B\rA b: a\tb  a b;a b!a b?a b,a b.a b"), ("en", " x É é İ ß"),
]


def rows():
    rng = random.Random(4)
    words = ["the", "of", "Delay", "notice", "naïve", "x", "y-z", "中", "(a)"]
    made = [(rng.choice(["en", "de", None]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n"]) for _ in range(rng.randint(1, 80)))) for _ in range(150)]
    return ROWS + made + made[:10] + [("de", "new york city " * 40 + "new york " * 11 + "york city " * 90)]


def pieces(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\n-\r]", lowered)]


def counts_by_loops(table, most):
    found, words = Counter(), Counter()
    for lang, text in table:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            words[lang] += len(w)
            found.update((lang, tuple(w[i : i + k])) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    return found, words


def collocations_by_loops(table, first, least, most, share):
    f, words = counts_by_loops(table, most)
    ranked = {}
    longer = [(lang, p, a) for (lang, p), a in f.items() if a >= least and len(p) > 1]
    for lang, p, a in longer:
        best = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        if not any(o == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= share * a for o, q, b in longer):
            k = best[1]
            ranked.setdefault(lang, []).append((-best[0], -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, left, right, words[lang], -s) for lang, x in ranked.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:first])}


@pytest.mark.parametrize(("first", "least", "most", "share", "chunk"), [(2000, 10, 3, 50, 4 << 20), (7, 3, 4, 70, 500), (2000, 300, 2, 50, 2000)])
def test_collocations_by_loops(spark, monkeypatch, first, least, most, share, chunk):
    monkeypatch.setattr(phrases, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(phrases, "BUCKET_BITS", 3)
    table = rows()
    docs = spark.createDataFrame([(t, "x", c) for c, t in table], "text string, phrase string, lang string").repartition(3)
    got = phrases.collocations(docs, first, least, most, share).collect()
    assert {tuple(r) for r in got} == collocations_by_loops(table, first, least, most, share) and len(got) == len(set(got))


def test_colliding_fingerprints_part(monkeypatch):
    # hashes of three bits: nearly all words and phrases collide
    monkeypatch.setattr(flat, "word_hash", lambda buf, starts, ends: buf[starts].astype(np.uint64) & np.uint64(7))
    table = rows()[:60]
    f, _ = counts_by_loops(table, 3)
    # in this process, where the patched hash holds
    c = phrases._Chunk(*map(pa.array, zip(*[(c or "und", t) for c, t in table if t])), 3)
    spelled = c.spelled(c.at, c.width).to_pylist()
    assert len(set(c.word_numbers().tolist())) == len({c.buf[s:e].tobytes() for s, e in zip(c.starts, c.ends)})
    assert len(set(c.prints.tolist())) < len(set(spelled))
    assert Counter((c.langs[k], tuple(p.split(" "))) for k, p in zip(c.lang[c.at].tolist(), spelled)) == f


def test_no_phrases_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert not phrases.collocations(empty).collect() and not phrases.phrase_counts(empty).collect()
    assert not phrases.collocations(spark.createDataFrame([("en", None), (None, " ")], "lang string, text string")).collect()


def test_row_groups_hold_a_few_chunks(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 1 << 14)
    monkeypatch.setitem(phrases.ROW_BY_ROW, "parquet.block.size", str(1 << 16))
    texts = [" ".join(hashlib.sha256(f"{i} {k}".encode()).hexdigest() for k in range(252)) for i in range(60)]
    table = phrases._chunk_table(spark.createDataFrame([("en", t) for t in texts], "c0 string, c1 string").coalesce(1))
    (file,) = table.inputFiles()
    groups = pq.ParquetFile(file.removeprefix("file://")).metadata
    assert groups.num_rows == 60 and groups.num_row_groups >= 5
    assert max(groups.row_group(i).total_byte_size for i in range(groups.num_row_groups)) < 1 << 18
