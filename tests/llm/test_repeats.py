"""Repeated rows in the suffix-array cut, and every code point in the lower-casing tokenizer."""

import hashlib
import random

import numpy as np
import pytest

from paperloom.llm import bpe, suffix_dedup
from paperloom.llm.queries import tokenizer


def cut_by_brute_force(rows):
    seen, want = set(), set()
    for i, t in sorted(set(rows)):
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        want.add((i, len(b), sum(gone), hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return want


@pytest.mark.parametrize("salt_runs", [2_000, 2])
def test_repeated_rows_lose_no_first_occurrence(spark, monkeypatch, salt_runs):
    monkeypatch.setattr(suffix_dedup, "SALT_RUNS", salt_runs)
    rng = random.Random(3)
    passages = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(120, 200))) for _ in range(6)]
    rows = [(i, "".join(x for _ in range(3) for x in (rng.choice(passages)[rng.randint(0, 15) :], "".join(rng.choice("ghij") for _ in range(20))))) for i in range(80)]
    rows += [rows[5], rows[5], rows[17], rows[0]]
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), digests=True).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got} == cut_by_brute_force(rows)


def test_every_code_point_as_the_library():
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    library, ours = Tokenizer.from_file(path), bpe.WordBPE(path)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(5)
    texts = ["a".join(every[i : i + 64]) for i in range(0, len(every), 64)] + ["".join(every[i : i + 64]) for i in range(0, len(every), 64)]
    newer = [c for c in every if ours.cache.unsure[ord(c)] and ord(c) < 0x32000] + list("aA1 #'é́")
    texts += ["".join(rng.choice(newer if rng.random() < 0.5 else every) for _ in range(12)) for _ in range(10_000)]
    ids, counts = ours.encode(texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    differ = [t for t, got, w in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), want, strict=True) if got.tolist() != w]
    assert not differ, (len(differ), differ[:3])


def test_one_training_row_of_each_id(spark):
    from paperloom.llm import toxicity

    docs = spark.createDataFrame([(i, f"text {k % 3}") for i in range(20) for k in range(100)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20) for _ in range(3)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels, 10).collect()
    assert len(rows) == 10 and len({r.text for r in rows}) == 1


def test_columns_of_any_name(spark, tmp_path):
    from paperloom.llm import chat, token_files, toxicity

    docs = spark.createDataFrame([(1, "a `b`"), (2, None)], "`doc.id` long, `the text` string")
    token_files.write_tokens(docs, str(tmp_path / "t"), tokenizer("byte_bpe_50k.json"), 2, doc_id="doc.id", text="the text")
    assert token_files.read_tokens(spark, str(tmp_path / "t")).count() == 2
    model = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(2 * len(toxicity.OUTCOMES) + 1))
    assert [r.score for r in toxicity.score(docs, model, "doc.id", "the text").collect()] == [0.5, 0.5]
    turns = spark.createDataFrame([(1, 0, "user", "x")], "`conv.id` long, `a.turn` long, `the role` string, `the text` string")
    assert chat.format_conversations(turns, "conv.id", "a.turn", "the role", "the text").count() == 1
