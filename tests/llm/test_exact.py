"""Results by brute force: colliding hashes, clashing columns, trees, machines and odd parts."""

import hashlib
import json
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from paperloom.llm import bpe, chat, fingerprint, mixing, ngram_join, quality, suffix_dedup, token_files, toxicity
from paperloom.llm.queries import tokenizer
from paperloom.llm.shared import fresh_path, row_key


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[i.bit_count() & 1] for i in range(n))


#: Words that every polynomial modulo 2**64 takes for one another.
PAIRS = [(thue_morse(n, a, b), thue_morse(n, b, a)) for n in (512, 1024, 4096, 65536) for a, b in (("a", "b"), ("x", "é"))]


@pytest.mark.parametrize("library", [(bpe.WordBPE, "word_bpe_49k.json"), (token_files.ByteBPE, "byte_bpe_50k.json")])
def test_colliding_words_get_their_own_ids(library):
    from tokenizers import Tokenizer

    kind, name = library
    rng = random.Random(1)
    whole, ours = Tokenizer.from_file(tokenizer(name)), kind(tokenizer(name))
    texts = [w for p in PAIRS for w in p] + ["a" * k for k in range(1, 40)] + ["".join(rng.choice("etaoins") for _ in range(n)) for n in (5, 600, 20_000)]
    for _ in range(2):  # the second time from the cache
        ids, counts = ours.encode(texts)
        for t, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert got.tolist() == whole.encode(t, add_special_tokens=False).ids


def test_merges_that_have_to_be_alone():
    ours = object.__new__(bpe.WordBPE)
    # d + c is worth more than a + bc, of which it needs the abc
    names = ["a", "b", "c", "bc", "abc", "abca"]
    merges = [("abc", "a"), ("b", "c"), ("a", "bc")]
    number = {x: i for i, x in enumerate(names)}
    ours.size = np.int64(len(names))
    keys = np.array([number[a] * len(names) + number[b] for a, b in merges])
    order = np.argsort(keys)
    ours.keys, ours.ranks, ours.made = keys[order], np.arange(3)[order], np.array([number[a + b] for a, b in merges])
    ours.inner = ours.final = np.array([number.get(chr(k), 0) for k in range(256)], np.int64)
    ours.alone = np.array([False, False, True])
    ids, _ = ours.encode_words(np.frombuffer(b"abcabcabc", np.uint8), np.array([9]))
    assert [names[i] for i in ids] == ["abca", "bc", "abc"]


def test_colliding_lines_and_windows():
    for a, b in PAIRS:
        texts = [f"{a}\n{b}\n{a}", f"{a}\n{b}", " ".join([a, "w", "x", "y", "z", b, "w", "x", "y", "z"]), " ".join([a, "w", "x", "y", "z"] * 2)]
        counts = quality.text_counts(pa.array(texts))
        assert counts["n_dup_lines"].tolist() == [1, 0, 0, 0] and counts["n_repeat_words"].tolist() == [0, 0, 0, 10]


def test_colliding_words_in_joins(spark):
    a, b = PAIRS[4]
    rows = [(1, a), (2, b), (3, a + " x " + b), (4, b + " x " + a), (5, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.id, r.class_id, r.n_links) for r in ngram_join.join(docs).collect()} == {(1, 1, 1), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 1, 1)}
    seen, want = set(), {}
    for i, t in rows:
        raw = t.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(raw[p : p + 100])
        want[i] = sum(gone)
    assert {r.doc_id: r.n_removed for r in suffix_dedup.dedup(docs, digests=True).collect()} == want


#: Names that the operators use within themselves, and types that do not hash or compare.
CLASH = "doc_id long, text string, source string, k1 string, k2 string, body__ string, ranges string, mix_size string, mix_copies string, row string, rows string, row_hash__ string, `host` string, host__ string, `a.b` string, `c``d` string, n_tokens string, pages map<string,int>, list array<struct<x:int>>"


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(9)
    rows = []
    for i in range(30):
        text = " ".join(f"w{rng.randint(0, 9999)}" for _ in range(60)) if i % 5 else "one text of many " * 20
        rows.append((i, text, f"s{i % 2}", *(f"{c}{i}" for c in range(13)), f"n{i}", {"p": i, "q": 2}, [(i,)]))
    return spark.createDataFrame(rows + rows[:2], CLASH)


def contents(df, *without):
    return Counter(json.dumps({k: v for k, v in r.asDict(True).items() if k not in without}, sort_keys=True) for r in df.collect())


def test_columns_of_any_name_keep_their_values(clashing):
    whole = contents(clashing)
    mixed = mixing.mix(clashing)
    assert mixed.columns == clashing.columns and set(contents(mixed)) <= set(whole)
    with pytest.raises(ValueError, match="mix_size"):
        mixing.with_copies(clashing)
    assert contents(mixing.with_copies(clashing, prefix="p_").select(*(f"`{c.replace('`', '``')}`" for c in clashing.columns))) == whole
    one = ngram_join.keep_one(clashing)
    assert one.columns == clashing.columns and set(contents(one)) <= set(whole) and max(contents(one).values()) == 1 and one.count() == 25
    cut = suffix_dedup.dedup(clashing)
    assert cut.columns == clashing.columns and contents(cut, "text") == contents(clashing, "text")
    judged = quality.quality(clashing)
    assert contents(judged.select(*(f"`{c.replace('`', '``')}`" for c in clashing.columns))) == whole
    ids = bpe.encode(clashing, tokenizer("word_bpe_49k.json"))
    assert contents(ids.drop("ids")) == whole
    named = bpe.encode_decode_digests(clashing, tokenizer("word_bpe_49k.json"), others=("n_tokens", "a.b", "source"))
    assert named.columns == ["doc_id", "a.b", "source", "n_tokens", "ids_sha256", "decoded_sha256"] and dict(named.dtypes)["n_tokens"] == "bigint"
    prints = fingerprint.fingerprints(clashing)
    assert contents(prints.drop("fingerprint")) == whole


def test_row_keys_tell_rows_apart(spark):
    rows = spark.createDataFrame([({"a": 1}, "x"), ({"a": 2}, "x"), (None, "x"), ({"a": 1}, "x")], "m map<string,int>, t string")
    assert rows.select(row_key(rows).alias("k")).distinct().count() == 3


# fingerprints ----------------------------------------------------------------------------------------------------


def clauses(paragraph):
    parts = regex.split(r"(?s)(?<=[.,;:!?|、。！，：；？])(?=.)", paragraph)
    if len(paragraph) <= 160:
        return parts
    cut = [x for c in parts for x in (regex.split(r"(?s)(?<=[dgkmpy] |[はをに的了是])(?=.)", c) if len(c) > 160 else [c])]
    return [x for c in cut for x in ([c[i : i + 400] for i in range(0, len(c), 400)] if len(c) > 400 else [c])]


def tree(text):
    """root, and the sections as (node, [(node, [leaf nodes])])."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    sections, own = [], []
    paragraphs = [[md5(c) for c in clauses(p)] for p in (text or "").split("\n")]
    for k, leaves in enumerate(paragraphs):
        own.append((md5("".join(leaves)), leaves))
        if own[-1][0][0] in "0123" or k == len(paragraphs) - 1:
            sections.append((md5("".join(n for n, _ in own)), own))
            own = []
    return md5("".join(n for n, _ in sections)), sections


def spell(text):
    root, sections = tree(text)
    return root + "|" + ";".join(f"{n[:8]}:" + ",".join(f"{m[:8]}={' '.join(x[:6] for x in leaves)}" for m, leaves in ps) for n, ps in sections)


def near(a, b):
    (one, left), (two, right) = tree(a), tree(b)
    if one == two:
        return 1.0
    x, y = ({leaf[:6] for _, ps in s for _, leaves in ps for leaf in leaves} for s in (left, right))
    return min(len(x & y) / len(x | y), 1 - 1 / (len(x) + len(y) + 1))


def prose(rng, n):
    return "".join(rng.choice(["kind ", "word ", "my ", "seen ", "日本語は", "是的", "x. ", "y, ", "\n", "\n\n", "😀", "long" * 30, "A", "é "]) for _ in range(n))


def test_fingerprints_are_the_trees(spark):
    rng = random.Random(8)
    texts = ["", None, "\n", "a", "a.\x01b. c", "a.b. c", "..!", "x" * 1000, "😀" * 901, *(prose(rng, n) for n in (3, 20, 100, 400, 400, 400))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs).collect()}
    for i, t in enumerate(texts):
        a, b = t or "", texts[(i + 1) % len(texts)] or ""
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(a), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (spell(a), spell(edited))
        assert math.isclose(r.near_edited, near(a, edited)) and math.isclose(r.near_next, near(a, b))


def test_short_digests_that_collide_leave_roots_unlike(spark):
    pair = spark.createDataFrame([("clause 1386", "clause 2672")], "a string, b string")
    a, b = (fingerprint.fingerprint(F.col(c)) for c in "ab")
    row = pair.select(a.alias("a"), b.alias("b"), fingerprint.likeness(a, b).alias("n")).first()
    assert row.a[:32] != row.b[:32] and row.n < 1 and hashlib.md5(b"clause 1386").digest()[:3] == hashlib.md5(b"clause 2672").digest()[:3]


# joins -----------------------------------------------------------------------------------------------------------


def test_recall_of_links_at_the_threshold(spark):
    """Pairs of texts of 100 words that share 0.8 to 0.9 of their windows, most of them at the threshold."""
    rng = random.Random(13)
    rows, want = [], 0
    for k in range(400):
        base = [f"k{k}w{i}" for i in range(104)]
        # 100 windows; c words in front are others: 100 - c shared of 100 + c
        c = rng.choice((11, 11, 11, 10, 8, 5))
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([f"k{k}z{i}" for i in range(c)] + base[c:]))]
        want += (100 - c) >= 0.8 * (100 + c)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram_join.join(docs).where("class_id != id").count()
    assert want == 400 and found >= 0.99 * want


# toxicity --------------------------------------------------------------------------------------------------------


def test_the_composed_table_is_the_cascade():
    rng = random.Random(21)
    kinds = [rng.choices(range(toxicity.KINDS), (4, 3, 2, 2, 2, 1, 1, 2, 2), k=rng.randint(0, 60)) for _ in range(300)]
    kinds = [k for k in kinds if k]
    flat, heads = np.concatenate([np.array(k) for k in kinds]), np.cumsum([0, *map(len, kinds)])[:-1]
    written, weight = toxicity.compiled().run(flat, heads)
    at = 0
    for sequence in kinds:
        symbols, weights = list(sequence), [0.0] * len(sequence)
        for machine in toxicity.cascade():  # one machine after the other, each over the whole sequence
            state, out = 0, []
            for k, s in enumerate(symbols):
                state, w, more = machine.step(state, s)
                out.append(w)
                weights[k] += more
            symbols = out
        assert written[at : at + len(symbols)].tolist() == symbols and weight[at : at + len(symbols)].tolist() == weights
        at += len(symbols)


def slow_features(text, lexicon):
    """By sentences, clauses and words of a text, with counters in place of machines."""
    function = {w: kind for kind, words in toxicity.FUNCTION_WORDS.items() for w in words.split()}
    sums = Counter()
    for sentence in re.split(r"[.!?;:\n|]", text.lower()):
        reported, best = False, Counter()
        for clause in sentence.split(","):
            seen = {}
            place = 0
            for m in re.finditer(r"[0-9a-z\x80-\U0010ffff]+", clause):
                kind = toxicity.INSULT if m[0] in lexicon else function.get(m[0], toxicity.OTHER)
                if kind == toxicity.OTHER and m.start() and clause[m.start() - 1] == "'" and m.start() > 1 and re.match(r"[0-9a-z\x80-\U0010ffff]", clause[m.start() - 2]):
                    continue
                within = lambda k, n: k in seen and place - seen[k] <= n  # noqa: B023, E731
                if kind in (toxicity.INSULT, toxicity.THREAT):
                    w = lexicon.get(m[0], 1.0) + (within(toxicity.INSULT, 2) if kind == toxicity.INSULT else within(toxicity.INTENT, 4))
                    label = "reported" if reported else "negated" if within(toxicity.NEGATION, 4) else "threat" if kind == toxicity.THREAT else "aimed" if within(toxicity.TARGET, 6) else "plain"
                    best[label] = max(best[label], w)
                reported |= kind == toxicity.REPORT
                seen[kind] = place
                place += 1
            sums.update(best)
            best = Counter()
    return [math.log1p(sums[o]) for o in toxicity.OUTCOMES] + [float(sums[o] > 0) for o in toxicity.OUTCOMES]


def test_scores_by_brute_force(spark):
    rng = random.Random(22)
    lexicon = {"idiot": 2.0, "moron": 3.5}
    keys = sorted((toxicity.word_keys(w), v) for w, v in lexicon.items())
    model = toxicity.Model(np.array([k for k, _ in keys], np.uint64), np.array([v for _, v in keys]), np.array([rng.uniform(-1, 1) for _ in range(2 * len(toxicity.OUTCOMES) + 1)]))
    words = ["idiot", "moron", "you", "not", "said", "kill", "will", "don't", "you're", "tree", "sky", "a", ",", ",", ".", "\n", "!", "said,", "idiot.", "über", *["the"] * 6]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice((3, 10, 40, 400)))) for _ in range(150)] + ["", None, "the " * 300 + "you " + "the " * 9 + "idiot", "said " + "the " * 500 + "idiot"]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        x = np.array(slow_features(t or "", lexicon))
        want = 1 / (1 + math.exp(-(x @ model.coefficients[:-1] + model.coefficients[-1])))
        assert math.isclose(got[i].score, want, rel_tol=1e-9) and got[i].predicted == (want >= 0.5), t
    assert len(got) == len(texts)


def test_toxicity_of_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 0


# chat ------------------------------------------------------------------------------------------------------------

ODD = [
    {"type": "image", "width": "wide", "height": None}, {"type": "document", "pages": "x"}, {"type": "audio", "seconds": "Infinity"}, {"type": "audio", "seconds": -3}, {"type": "image", "width": 0, "height": 1e400},
    {"type": "text", "text": 5}, {"type": "text", "text": {"a": 1}}, {"type": "text"}, {"type": None}, {"type": ["x"]}, {}, {"type": "image", "ref": 7, "width": True}, "plain", {"type": "document", "pages": 2.9},
]


def test_odd_parts_have_defined_results(spark):
    turns = [(1, 0, "user", json.dumps(ODD)), (1, 1, "assistant", json.dumps([*ODD, 3])), (2, 0, "user", "[" * 5000), (3, 0, None, None)]
    out = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), typed=True).collect()}
    found = json.loads(out[1].attachments)
    assert [(a["kind"], a["tokens"]) for a in found] == [("image", 255), ("document", 600), ("audio", 0), ("audio", 0), ("image", 255), ("", 0), ('["x"]', 0), ("", 0), ("image", 255), ("document", 1200)]
    assert chat.read_turns(out[2].formatted) == [("user", "[" * 5000)] and chat.read_turns(out[3].formatted) == [("", "")]
    # a list that holds what is no part is text
    assert chat.read_turns(out[1].formatted)[1] == ("assistant", json.dumps([*ODD, 3]))


def test_text_like_a_placeholder_is_text():
    flat = chat.PartVisitor().flatten([{"type": "text", "text": "{{image:0}} "}, {"type": "image", "ref": "a"}, {"type": "text", "text": "{{image:1}}"}, {"type": "image", "ref": "b"}, {"type": "text", "text": ""}])
    parts = chat.parts_of(flat.text, flat.attachments)
    assert [p if isinstance(p, str) else p["ref"] for p in parts] == ["{{image:0}} ", "a", "{{image:1}}", "b"]


def test_empty_token_files(spark):
    out = fresh_path(spark, "tokens")
    token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), out, tokenizer("byte_bpe_50k.json"), end_id=2)
    assert token_files.document_index(spark, out).count() == 0 and token_files.read_tokens(spark, out).count() == 0


# quality ---------------------------------------------------------------------------------------------------------


def test_rules_of_hosts_by_brute_force(spark):
    rng = random.Random(31)
    texts = {"good": " ".join(f"word{i}" for i in range(30)), "symbols": " ".join(f"wo#{i}" for i in range(30)), "short": "x", "long": " ".join("w" * 20 + str(i) for i in range(30))}
    rows = [(i, texts[rng.choice(["good"] * 6 + ["symbols", "short", "long"] if h else ["symbols"] * 5 + ["good"])], f"h{h}" if h else None) for i, h in enumerate(rng.choices(range(7), (60, 9, 40, 3, 1, 1, 80), k=400))]
    counted = quality.with_counts(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    found = {(r.host, r.rule): r for r in quality.rule_verdicts(counted, quality.more_rules()).collect()}
    fails = {"symbols": lambda t: sum(c in "#*$%&|<>" for c in t) > 0.1 * len(t.split()), "dup_lines": lambda t: False, "word_length": lambda t: not 2 <= len(t.replace(" ", "")) / len(t.split()) <= 15}
    for rule, test in fails.items():
        n, f = Counter(r[2] for r in rows), Counter(r[2] for r in rows if test(r[1]))
        m, total = sum(f.values()) / 400, 400
        v = (sum(n[h] * (f[h] / n[h] - m) ** 2 for h in n) - m * (1 - m) * (len(n) - 1)) / (total - sum(x * x for x in n.values()) / total)
        weight = max(m * (1 - m) / v - 1, 1) if v > 0 else total
        for h in n:
            want = (f[h] + m * weight) / (n[h] + weight)
            assert found[h, rule].n_failed == f[h] and math.isclose(found[h, rule].rate, want, abs_tol=1e-9) and found[h, rule].host_failed == (want > 0.5)
    judged = quality.judge(counted, rules=quality.more_rules()).collect()
    assert {r.source for r in judged if r.host_failed} == {None} and all(r.kept == (not r.base_failed and not r.host_failed) for r in judged)
