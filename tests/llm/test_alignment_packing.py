"""Alignment of two tokenizers and packing along the curve, against loops over small tables."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from paperloom.llm import alignment, packing
from paperloom.llm.queries import tokenizer

BYTE, PIECE, WORD = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"), tokenizer("word_bpe_49k.json")
ODD = [
    None, "", " ", "  ", "a", "Hello world, it's  two   spaces \n\n and\ttabs ", "<|endoftext|> and <s> </s> <0x41> <unk>", "a▁b", "a▁ b", "日本語のテキストと한국어 и русский 🙂🙂👩‍👩‍👧", "ﬁ \u0000  x　y",
    "a" * 9000, "ab" * 4000 + " " + "z" * 100, " " * 3000 + "x" + " " * 50, "word " * 4000, "🙂" * 300, "é" * 50 + "​͸",
]


def texts():
    rng = random.Random(7)
    words = ["alpha", "Beta", "gam-ma", "délta", "x1", "12", "…", "(so)", "naïve", "über", "中文"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    return ODD + made + made[:5] + made[:1]


def align_by_loops(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE)
    library.encode_special_tokens = True
    value = {c: k for k, c in enumerate(alignment.byte_chars())}
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECE)

    def spell(i):
        return bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()

    docs = []
    for key, t in rows:
        groups = []
        if t:
            a = [(i, bytes(value[c] for c in library.id_to_token(i))) for i in library.encode(" " + t, add_special_tokens=False).ids]
            b = [(i, spell(i)) for i in pieces.encode(t)]
            whole = (" " + t).encode()
            if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b):
                ends_a, ends_b = (list(itertools.accumulate(len(x) for _, x in s)) for s in (a, b))
                both = set(ends_a) & set(ends_b)
                group_a, group_b = defaultdict(list), defaultdict(list)
                cuts = sorted(both)
                for ends, ids, group in ((ends_a, a, group_a), (ends_b, b, group_b)):
                    at = 0
                    for e, (i, _) in zip(ends, ids, strict=True):
                        group[at].append(i)
                        at += e == cuts[at]
                groups = [(group_a[k], group_b[k]) for k in range(len(cuts))]
        docs.append((key, groups))
    counts = Counter(p for _, groups in docs for p in {(x, y) for a, b in groups for x in a for y in b})
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for key, groups in docs:
        links = [(x, y) for a, b in groups for x in a for y in b]
        spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        digest = hashlib.sha256(spelled.encode()).hexdigest() if spelled else ""
        out.append((key, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), digest))
    return Counter(out)


@pytest.mark.parametrize(("block", "lane", "wide"), [(4 << 20, 1 << 12, 1 << 12), (3000, 64, 4)])
def test_alignment_by_loops(spark, monkeypatch, block, lane, wide):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    monkeypatch.setattr(alignment, "LANE_BYTES", lane)
    monkeypatch.setattr(alignment, "WIDE", wide)
    rows = [*enumerate(texts()), (None, "null id"), (3, "twice"), (3, "twice")]
    docs = spark.createDataFrame([(t, "n", k) for k, t in rows], "text string, n_a string, doc_id long").repartition(3)
    got = alignment.scored_alignments(docs, BYTE, PIECE)
    assert Counter(map(tuple, got.collect())) == align_by_loops(rows)


def test_alignments_keep_columns_and_groups(spark):
    docs = spark.createDataFrame([("it's a test", 1, "x"), (None, None, None)], "text string, `a b.c` int, a_ids string")
    got = alignment.alignments(docs, BYTE, PIECE).collect()
    assert got[0]["a b.c"] == 1 and len(got[0].a_ids) == got[0].a_ends[-1] and len(got[0].b_ids) == got[0].b_ends[-1] and got[1].a_ids == []


def test_an_empty_table_stays_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert not alignment.scored_alignments(docs, BYTE, PIECE).collect() and not packing.pack(docs, WORD, 1).collect()


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_neighbours_on_the_curve_touch(dims, bits):
    grid = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    index = packing.hilbert_index(grid, bits)
    assert sorted(index.tolist()) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("size", [2048, 64])
def test_packing_by_loops(spark, size):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    rows = [*enumerate(texts()), (None, "null id"), (3, "twice"), (3, "twice")]
    docs = spark.createDataFrame([(t, "x", k) for k, t in rows], "text string, ids string, doc_id long").repartition(3)
    pieces = packing.pack(docs, WORD, 1, size=size).collect()
    sums = packing.pack(docs, WORD, 1, size=size, checksums=True).collect()
    assert Counter((r.doc_id, r.start, r.length, zlib.crc32(np.array(r.ids, "<u4").tobytes()), r.sequence_id, r.offset) for r in pieces) == Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.sequence_id, r.offset) for r in sums)
    # pieces of each document add up to its ids
    want = Counter((k, tuple(library.encode(t or "", add_special_tokens=False).ids) + (1,)) for k, t in rows)
    by_place = sorted(pieces, key=lambda r: (r.sequence_id, r.offset))
    got, held = Counter(), ()
    for r in by_place:
        assert r.start == len(held) and r.length == len(r.ids)
        held += tuple(r.ids)
        if len(held) == r.doc_tokens:
            got[r.doc_id, held] += 1
            held = ()
    assert got == want and not held
    # sequences are gapless, whole or powers of two
    filled = defaultdict(int)
    for r in by_place:
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
    assert sorted(filled) == list(range(len(filled))) and all(n == size or n < size and n & (n - 1) == 0 for n in filled.values())
    whole = packing.sequences(spark.createDataFrame(pieces, "doc_id long, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long")).collect()
    assert {r.sequence_id: len(r.ids) for r in whole} == dict(filled)


def test_copies_and_likes_lie_together(spark):
    rng = random.Random(2)
    topics = [[f"{c}{k}word" for k in range(30)] for c in "abcdefgh"]
    rows = [(i, " ".join(rng.choice(topics[i % 8]) for _ in range(80))) for i in range(160)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), WORD, 1).where("start = 0").orderBy("sequence_id", "offset").collect()
    near = sum(a.doc_id % 8 == b.doc_id % 8 for a, b in zip(pieces, pieces[1:]))
    assert near > 100  # of 159; by chance 20
