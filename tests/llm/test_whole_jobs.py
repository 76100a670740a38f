"""Whole jobs: nothing of the input is left out."""

import gzip
import json
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import chat, ngram_join, toxicity, warc


def _record(k, kind="response", url="u", size=50):
    return warc.record([("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{k}>"), ("WARC-Target-URI", url)], bytes([97 + k % 26]) * size)


def test_one_gzip_stream_of_many_records(spark, tmp_path):
    records = [_record(k, "revisit" if k % 3 == 0 else "response", size=40_000 * (k % 2) + k) for k in range(12)]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(records[:9])) + gzip.compress(records[9]) + gzip.compress(b"") + warc.member(records[10]) + warc.member(records[11]))
    rows = warc.read(spark, str(tmp_path)).collect()
    assert sorted((warc_id(r), r.payload_bytes, r.payload[:1]) for r in rows) == [(k, 40_000 * (k % 2) + k, bytes([97 + k]) if k else b"") for k in range(12)]
    assert sorted(map(warc_id, warc.read(spark, str(tmp_path)).where("record_type = 'revisit'").collect())) == [0, 3, 6, 9]
    assert sorted(map(warc_id, warc.read(spark, str(tmp_path), payload=False).collect())) == list(range(12))


def warc_id(row):
    return int(row.record_id[10:-1])


@pytest.mark.parametrize("packed", ["plain", "gzip", "own"])
def test_headers_of_any_length(spark, tmp_path, packed):
    records = [_record(0), _record(1, url="u" * 3_000_000), _record(2)]
    data = {"plain": b"".join(records), "gzip": b"".join(map(gzip.compress, records)), "own": b"".join(map(warc.member, records))}[packed]
    (tmp_path / ("a.warc" if packed == "plain" else "a.warc.gz")).write_bytes(data)
    assert sorted((warc_id(r), len(r.target_uri), r.payload_bytes) for r in warc.read(spark, str(tmp_path)).collect()) == [(0, 1, 50), (1, 3_000_000, 50), (2, 1, 50)]


def test_what_is_no_record_is_an_error(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(_record(0) + b"junk\r\n\r\n" + _record(1))
    with pytest.raises(Exception, match="no whole WARC record"):
        warc.read(spark, str(tmp_path), mode="FAILFAST").collect()


def test_bands_fit_the_threshold():
    assert ngram_join.band_rows(0.8) == ngram_join.band_rows(0.95) == 4
    for t in (0.2, 0.5, 0.6, 0.7, 0.79):
        rows = ngram_join.band_rows(t)
        assert (1 - t**rows) ** (100 // rows) <= 2e-6
    for t in (0.0, 0.1, 1.5):
        with pytest.raises(ValueError, match="threshold"):
            ngram_join.band_rows(t)
    sig = np.arange(300, dtype=np.uint32).reshape(3, 100)
    assert [ngram_join.band_hashes(sig, r).shape[1] for r in (4, 3, 2, 1)] == [25, 33, 50, 100]


def test_links_at_a_low_threshold_by_brute_force(spark):
    rng = random.Random(11)
    texts = []
    for k in range(60):
        base = [f"w{k}x{i}" for i in range(24)]
        # 20 n-grams, and 13, 12 or 11 of which all but one are shared: similarities of 12, 11 or 10 of 21
        texts += [" ".join(base), " ".join(base[: 16 - rng.randint(0, 2)] + [f"z{k}"])]
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    want = Counter()
    for i in range(len(grams)):
        for j in range(len(grams)):
            want[i] += i != j and len(grams[i] & grams[j]) >= 0.5 * len(grams[i] | grams[j])
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.n_links for r in ngram_join.join(rows, threshold=0.5).collect()}
    assert got == dict(want) and sum(got.values()) > 60


def test_every_turn_goes_through_the_visitor(spark):
    class Loud(chat.PartVisitor):
        def visit_text(self, part, out):
            out.text += part["text"].upper()

    parts = json.dumps([{"type": "text", "text": "see "}, {"type": "image", "ref": "a.png", "width": 1000, "height": 500}, {"type": "audio", "seconds": 2}])
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", "[a]"), (2, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    plain = {r.conv_id: r for r in chat.format_conversations(turns, visitor=Loud()).collect()}
    assert chat.read_turns(plain[1].formatted) == [("user", parts.upper()), ("assistant", "[A]")] and plain[1].attachments == "[]"
    typed = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns, typed=True)).collect()}
    assert [(a["turn"], a["number"], a["kind"], a["tokens"]) for a in json.loads(typed[1].attachments)] == [(0, 0, "image", 425), (0, 1, "audio", 50)]
    assert (typed[1].attachment_tokens, typed[2].attachments, typed[2].attachment_tokens, typed[1].loss_chars) == (475, "[]", 0, 3)
    text = {r.conv_id: chat.read_turns(r.formatted) for r in chat.format_conversations(turns, typed=True).collect()}
    assert text[1] == [("user", "see {{image:0}}{{audio:1}}"), ("assistant", "[a]")]


@pytest.mark.parametrize(("text", "want"), [
    ("you are an idiot", {"aimed"}), ("you're an idiot", {"aimed"}), ("it isn't a big old idiot", {"negated"}), ("they don\u2019t like the idiot", {"negated"}),
    ("she said, you are an idiot", {"reported"}), ("she said, well, you are an idiot. you idiot", {"reported", "aimed"}), ("you, what an idiot", {"plain"}), ("not so, you idiot", {"aimed"}),
    ("what an 'idiot'", {"plain"}), ("what an \u201cidiot\u201d", {"plain"}), ("l'idiot", {"plain"}), ("'you' idiots'", {"aimed"}), ("the clock's hand", set()), ("", set()),
])
def test_apostrophes_and_commas_in_the_grammar(text, want):
    keys = sorted(toxicity.word_keys(w) for w in ("idiot", "idiots"))
    model = toxicity.Model(np.array(keys, np.uint64), np.ones(2), np.zeros(2 * len(toxicity.OUTCOMES) + 1))
    raw, offs = toxicity.lowered(pa.array([text, "an idiot"]))
    row = toxicity.features(raw, offs, model, toxicity.compiled())
    assert {o for o, x in zip(toxicity.OUTCOMES, row[0], strict=False) if x > 0} == want and row[1, 1] > 0
