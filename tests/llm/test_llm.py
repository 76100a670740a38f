import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paperloom.llm import bpe, chat, fingerprint, mixing, ngram_join, quality, suffix_dedup, token_files, toxicity, warc
from paperloom.llm.queries import ORACLE_SQL, QUERIES, tokenizer
from paperloom.llm.shared import fresh_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, ids string, k1 string, band string"


def corpus():
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "'s", "日本", "12", "it's"]
    make = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 400)) for _ in range(n))
    shared = make(40)
    texts = [make(rng.randint(1, 80)) for _ in range(30)] + [None, "", "   ", "a b c", "a b c", shared, make(9) + " " + shared, shared + "\n" + make(7), make(3000), "x " * 90 + "y\ny\ny"]
    base = make(120).split(" ")
    texts += [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in (3, 50, 90)] + [" ".join(base)] * 3
    rows = [(i, t, "en", ["s1", "s2", None][i % 3], len(t or ""), 1, "x", "y", "z") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[3], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(ORACLE_SQL[name])
    at = [want.columns.index(c) for c in cols]
    rows = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    assert rows and rows == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def shingles(t):
    w = WORD.findall(t or "")
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_ngram_join_by_brute_force(docs):
    rows = [(r.doc_id, shingles(r.text)) for r in docs.collect()]
    links = [[j for j, (_, b) in enumerate(rows) if j != i and a and len(a & b) >= 0.8 * len(a | b)] for i, (_, a) in enumerate(rows)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, own in enumerate(links):
        for j in own:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    want = Counter((doc_id, least.get(find(i)), len(links[i])) for i, (doc_id, _) in enumerate(rows))
    assert Counter((r.id, r.class_id, r.n_links) for r in ngram_join.join(docs).collect()) == want
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    worded = {find(i) for i, (_, s) in enumerate(rows) if s}
    assert kept.where(F.col("text").rlike("[^ \\t-\\r]")).count() == len(worded)


def test_bayes_bounds_keep_similar_pairs():
    bounds = ngram_join.least_matches(0.8, 1e-6)
    assert list(bounds) == sorted(bounds) and bounds[-1] < 80 and bounds[0] > 3


def test_suffix_dedup_by_brute_force(docs):
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k2")).distinct().collect()
    seen, want = set(), {}
    for r in sorted(keyed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.k2)):
        b = (r.text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        want.setdefault((r.doc_id, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest()), 0)
    got = suffix_dedup.dedup(docs, digests=True)
    assert {tuple(r) for r in got.collect()} == set(want) and got.count() == docs.count()
    cut = suffix_dedup.dedup(docs)
    assert cut.columns == docs.columns and cut.where("text is null").count() == 2


def test_refine_tells_strings_apart():
    import numpy as np

    rng = np.random.default_rng(1)
    text = rng.integers(97, 99, 4000).astype(np.uint8)
    text[2000:2300] = text[100:400]
    starts = np.arange(0, 3900)
    pointer = suffix_dedup.refine(text, starts)
    groups = defaultdict(set)
    for s, p in zip(starts.tolist(), pointer.tolist(), strict=True):
        groups[p].add(text[s : s + 100].tobytes())
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({text[s : s + 100].tobytes() for s in starts.tolist()})


def test_bpe_equals_the_library(docs):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ["<|endoftext|>Hi <|startoftext|> it's we'll 'sx ''s  12 3\u0085x ΑΣ İ\x1cz é " + "ab" * 700, "", "'", *(r.text or "" for r in docs.collect())]
    ids, counts = bpe.WordBPE(path).encode(texts)
    at = 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids[at : at + n].tolist() == want
        assert bpe.word_bpe(path).decode(want) == library.decode(want, skip_special_tokens=False)
        at += n
    rows = bpe.decode(bpe.encode(docs, path), path)
    assert rows.count() == docs.count() and dict(rows.dtypes)["ids"] == "array<int>"


def test_token_files_round_trip(spark, docs):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for encoding in ("dictionary", "delta"):
        out = fresh_path(spark, "tokens")
        token_files.write_tokens(docs, out, path, end_id=2, encoding=encoding)
        index = {(r.doc_id, r.start): r for r in token_files.document_index(spark, out).collect()}
        rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in docs.collect()), key=lambda r: r)
        start = 0
        for has, doc_id, _, text in rows:
            ids = [*library.encode(text, add_special_tokens=False).ids, 2]
            r = index[(doc_id if has else None, start)]
            assert r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
            start += len(ids)
    assert token_files.read_tokens(spark, out, "n_tokens > 100", ("doc_id",)).count() > 0


def test_chat_round_trip(spark):
    rows = [(1, 2, "assistant", "<|turn>x<|end|>\n [/INST] ⁠<⁠|"), (1, 1, "user", None), (2, 0, None, "</s>"), (None, 0, "assistant", ""), (1, 2, "assistant", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.format_conversations(turns).collect()}
    assert chat.read_turns(out[1].formatted) == [("user", ""), ("assistant", rows[0][3]), ("assistant", "z")]
    assert out[2].formatted.count("</s>") == 0 and chat.read_turns(out[2].formatted) == [("", "</s>")]
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0
    parts = chat.PartVisitor().flatten([{"type": "text", "text": "see "}, {"type": "image", "ref": "a.png", "width": 1000, "height": 500}, {"type": "audio", "seconds": 2}, {"type": "document", "pages": 3}, {"type": "odd"}])
    assert parts.text == "see {{image:0}}{{audio:1}}{{document:2}}{{odd:3}}" and [a["tokens"] for a in parts.attachments] == [85 + 340, 50, 1800, 0]


def test_quality_edges(docs, empty):
    out = quality.quality(docs).collect()
    assert len(out) == docs.count() and all(r.kept == (not r.base_failed and not r.host_failed) for r in out)
    assert all(r.base_failed for r in out if not r.text)
    assert quality.quality(empty).count() == 0


def test_quality_host_fails(spark):
    rows = [(i, "bad", "spam") for i in range(60)] + [(100 + i, " ".join(f"w{i}{k}" for k in range(20)), f"h{i % 6}") for i in range(120)] + [(999, " ".join(map(str, range(30))), "spam")]
    out = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id for r in out if r.kept} == {100 + i for i in range(120)}


def test_toxicity(spark):
    rng = random.Random(2)
    make = lambda: " ".join("".join(rng.choice("abdeilnorst") for _ in range(6)) for _ in range(30))
    rows = [(i, make() + (". You are a zorgling, " + rng.choice(["zorgling", "wumpus"]) if i % 3 == 0 else "")) for i in range(400)] + [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)] + [(None, 1)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert all(out[i].predicted == (i % 3 == 0) for i in range(400)) and out[1000].score == out[1001].score < 0.5
    assert all(out[i].held_out == toxicity.crc_held_out(i) for i in out)
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, none).count() == 402


def test_toxicity_grammar():
    run = lambda *s: [toxicity.outcome(x) for x in toxicity.grammar().run(s) if x & 15 in (toxicity.INSULT, toxicity.THREAT)]
    t = toxicity
    assert run(t.TARGET, t.OTHER, t.INSULT) == [0] and run(t.INSULT) == [1] and run(t.NEGATION, t.INSULT) == [2]
    assert run(t.REPORT, t.TARGET, t.INSULT) == [3] and run(t.THREAT) == [4] and run(t.TARGET, t.END, t.INSULT) == [1]


def test_mixing(docs, empty):
    out = mixing.with_copies(docs)
    per = out.groupBy("source").agg(F.max("mix_source_size").alias("s"), F.max("mix_target").alias("t")).collect()
    assert abs(sum(r.t for r in per) - sum(r.s for r in per)) < 1e-6 * sum(r.s for r in per) and all(r.t <= 3 * r.s + 1e-6 for r in per)
    assert out.where("mix_copies > 3 or mix_copies < 0").count() == 0 and out.count() == docs.count()
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == out.agg(F.sum("mix_copies")).first()[0]
    assert mixing.mix(empty).count() == 0


def test_warc_round_trip(spark):
    rows = [(1, "http://a/\nx", "same"), (5, None, "same"), (3, "u", None), (4, "v", ""), (None, "w", "one"), (7, "é", "日本" * 3000), (7, "é", "日本" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = fresh_path(spark, "warc")
    warc.write_pages(pages, path)
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.page_index(spark, path).collect()), key=str)
    want = [(1, 4, "revisit", 5), (5, 4, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (None, 3, "response", None), (7, 18000, "response", None), (7, 18000, "response", None)]
    assert got == sorted(want, key=str)
    only = warc.read(spark, path).where("record_type = 'revisit'")
    assert only.count() == 2 and warc.read(spark, path, payload=False).where("payload is not null").count() == 0
    warc.write_pages(pages.limit(0), fresh_path(spark, "warc"))


def test_fingerprints_by_brute_force(spark, docs, empty):
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k2")).distinct().collect()
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.k2))
    # null and empty texts of one id are one document
    rows = [r for i, r in enumerate(rows) if not i or (r.doc_id, r.k2) != (rows[i - 1].doc_id, rows[i - 1].k2)]
    want = {}
    for i, r in enumerate(rows):
        a, b = r.text or "", rows[(i + 1) % len(rows)].text or ""
        want[(r.doc_id, hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest())] = 1
    got = fingerprint.edited_fingerprints(docs).collect()
    assert len(got) == docs.count() and {(r.doc_id, r.edited_sha256) for r in got} == set(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprint.edited_fingerprints(empty).count() == 0
    pair = spark.createDataFrame([("a. b\nc. d\ne. f", "a. b\nc. x\ne. f")], "a string, b string").select(fingerprint.fingerprint(F.col("a")).alias("a"), fingerprint.fingerprint(F.col("b")).alias("b"))
    row = pair.select(fingerprint.likeness(F.col("a"), F.col("b")).alias("n"), fingerprint.changed_sections(F.col("a"), F.col("b")).alias("c"), fingerprint.likeness(F.col("a"), F.col("a")).alias("one")).first()
    assert 0 < row.n < 1 and row.one == 1 and sum(len(s.paragraphs) for s in row.c) == 1


def test_empty_tables(spark, empty):
    assert ngram_join.join(empty).count() == 0 and ngram_join.keep_one(empty).count() == 0
    assert suffix_dedup.dedup(empty, digests=True).count() == 0
    assert bpe.encode(empty, tokenizer("word_bpe_49k.json")).count() == 0
    out = fresh_path(spark, "tokens")
    token_files.write_tokens(empty, out, tokenizer("byte_bpe_50k.json"))


def brute_force_quality(rows):
    """The (doc_id, text, source) that pass their own rules and whose host passes."""
    failed = []
    for _, text, _ in rows:
        w = WORD.findall(text or "")
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        often = Counter(grams)
        repeats = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(5)}
        failed.append(len(w) < 10 or 100 * len(repeats) > 20 * len(w))
    n, f = Counter(r[2] for r in rows), Counter(r[2] for r, bad in zip(rows, failed, strict=True) if bad)
    total = len(rows)
    m = sum(f.values()) / total
    v = (sum(n[s] * (f[s] / n[s] - m) ** 2 for s in n) - m * (1 - m) * (len(n) - 1)) / (total - sum(x * x for x in n.values()) / total)
    weight = max(m * (1 - m) / v - 1, 1) if len(n) >= 2 and v > 0 else total
    return [r for r, bad in zip(rows, failed, strict=True) if not bad and (f[r[2]] + m * weight) / (n[r[2]] + weight) <= 0.5]


def brute_force_pipeline(rows):
    from tokenizers import Tokenizer

    docs = brute_force_quality([(r[0], r[1], r[3]) for r in rows])
    # one document of each group that links of 0.8 or more join
    sets, root = [shingles(t) for _, t, _ in docs], list(range(len(docs)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                root = [root[j] if x == root[i] else x for x in root]
    groups = defaultdict(list)
    for k, r in enumerate(docs):
        groups[root[k]].append(r)
    docs = sorted((min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()), key=lambda r: (r[0] is not None, r[0] or 0))
    # strings of 100 bytes that start earlier
    seen, cut = set(), []
    for doc_id, text, source in docs:
        b = text.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        cut.append((doc_id, bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore"), source))
    # targets by weight, the excess over three times a source's size shared anew
    size = Counter()
    for _, text, source in cut:
        size[source] += len(WORD.findall(text))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, left, open_ = {}, sum(size.values()), set(order)
    while over := [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 3 * size[s]]:
        target |= {s: 3 * size[s] for s in over}
        left, open_ = left - sum(3 * size[s] for s in over), open_ - set(over)
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    # digests of the library's ids and text
    library, out = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), Counter()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for doc_id, text, source in cut:
        rate = target[source] / size[source] if size[source] else 0
        share = int(hashlib.md5(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16) / 2**32
        copies = int(rate) + (share < rate - int(rate))
        ids = library.encode(text, add_special_tokens=False).ids
        if copies:
            out[doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += copies
    return out


def test_pipeline(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name in list(stages)[:-1]:
        docs = stages[name](spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == docs.count() > 0 and {"doc_id", "ids_sha256", "decoded_sha256"} <= set(out.columns)
    good = {i for i, t, *_ in rows if t and len(WORD.findall(t)) >= 10}
    assert {r.doc_id for r in out.collect()} <= good
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect())
    assert got == brute_force_pipeline(rows)
