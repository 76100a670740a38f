import itertools
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from paperloom.functions import replies
from paperloom.operators import context, evaluate, parties, refined
from paperloom.sources import providers

PAGE = "pdf_id int, page_num int, text string"
PAD = " some words that fill the page so that it is not nearly blank at all"
KINDS = [
    "", "- 7 -", PAD, "From: ann@x.org\nSubject: Pumps" + PAD, "From: ann@x.org\nSubject: RE: pumps" + PAD, "Sent: Monday, May 6\nSubject: Valves" + PAD, "To: bob@y.org" + PAD,
    "REQUEST FOR INFORMATION" + PAD, "about RFI # 7" + PAD, "PACKING SLIP by FedEx Order # 5" + PAD, "Ship To us by UPS Order # 6" + PAD, "Ship To them" + PAD, "SCALE: 1" + PAD, "SCALE: 2" + PAD,
    "Page 1 of 9" + PAD, "Page 2 of 9" + PAD, "CONTINUATION SHEET" + PAD, "See attached" + PAD, "Dear Ann," + PAD, "COST PROPOSAL" + PAD, None,
]


def machine(pages):
    """The rules read one page after the other: the numbers of pages that start."""
    starts, chain = [], False
    for i, f in enumerate(pages):
        p, mail = pages[i - 1] if i else None, f.kind == "EMAIL"
        near = next((pages[j] for j in range(i - 1, max(0, i - 4), -1) if pages[j].kind == "EMAIL"), None)
        thread = near is None or (f.subject is not None and near.subject is not None and (f.subject, f.sent) != (near.subject, near.sent))
        if f.blank:
            continue
        new, after = False, True if mail else chain
        if f.strong == "new_email":
            new, after = (i > 0 and thread) or not chain, True
        elif f.strong:
            new, after = True, mail if i == 0 else False
        elif i == 0 or p.goes_on:
            pass
        elif f.page_no == 1:
            new, after = True, False
        elif f.kind and p.kind:
            if f.kind != p.kind:
                new, after = True, mail
            elif f.kind == "SHIPPING":
                new = f.slip or any(x and y and x != y for x, y in ((f.carrier, p.carrier), (f.order_no, p.order_no)))
            elif mail:
                new = thread
            elif f.kind not in ("PAYMENT", "DRAWING"):
                new = f.again
            after = chain if new and f.kind == p.kind and not mail else after
        elif (i > 1 and p.blank) or f.weak:
            new, after = True, False
        if new and i:
            starts.append(i)
        chain = after
    return starts


def test_starts_against_a_loop(spark):
    rng = random.Random(3)
    rows = [(d, i, rng.choice(KINDS)) for d in range(60) for i in range(rng.choice([1, 2, 9, 14]))]
    got = refined.page_starts(spark.createDataFrame(rows, PAGE).repartition(3)).collect()
    assert {r.f.strong for r in got} >= {"new_email", "rfi", "page_one", None}
    for d in range(60):
        pages = sorted((r for r in got if r.pdf_id == d), key=lambda r: r.page_num)
        assert [r.page_num for r in pages if r.is_start] == machine([r.f for r in pages]), d


def test_new_thread_looks_back_three_pages(spark):
    a, b = "From: ann@x.org\nSubject: Pumps" + PAD, "From: ann@x.org\nSubject: Fwd: PUMPS" + PAD
    x = "a plain page, with nothing that starts or ends a document; item 4" + PAD
    rows = [(1, i, t) for i, t in enumerate([x, a, x, x, b])] + [(2, i, t) for i, t in enumerate([x, a, x, x, x, b])] + [(3, i, t) for i, t in enumerate([a, b])]
    got = refined.page_starts(spark.createDataFrame(rows, PAGE)).where("is_start").collect()
    assert {(r.pdf_id, r.page_num) for r in got} == {(1, 1), (2, 1), (2, 5), (3, 1)}


def test_sheets_and_attachments_against_a_loop(spark):
    rows, want = [], set()
    for d, flags in enumerate(itertools.product(["", "s", "a", "sa"], repeat=4)):
        docs, at = [], 0
        while at < 4:
            sheet, attached = "s" in flags[at], "a" in flags[at]
            if sheet and docs:
                docs[-1][1] = at
            elif attached and at < 3:
                docs.append([at, at + 1])
                at += 1
            else:
                docs.append([at, at])
            at += 1
        want |= {(d, *x) for x in docs}
        rows += [(d, i, i, "s" in f, "a" in f) for i, f in enumerate(flags)]
    got = refined.join_sheets(spark.createDataFrame(rows, "pdf_id int, start_page int, end_page int, sheet boolean, attached boolean"))
    assert {tuple(r) for r in got.collect()} == want


def test_ranges_of_nothing_and_of_blanks(spark):
    assert refined.ranges(spark.createDataFrame([], PAGE)).count() == 0
    got = refined.ranges(spark.createDataFrame([(1, 0, None), (1, 1, ""), (2, 0, "REQUEST FOR INFORMATION" + PAD), (2, 1, "CONTINUATION SHEET" + PAD)], PAGE))
    assert {tuple(r) for r in got.collect()} == {(1, 0, 1), (2, 0, 1)}


def _like(a, b):
    if a == b:
        return 0.95
    short = lambda x, y: len(x) == len(y) and all(p == q or (len(p) <= 4 and q.startswith(p)) for p, q in zip(x, y))
    if short(a.split(), b.split()) or short(b.split(), a.split()):
        return 0.9
    return SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("threshold", [0.82, 0.85, 0.92])
def test_similar_names_against_a_loop(spark, threshold):
    rng = random.Random(7)
    words = ["Acme", "Ac", "Acmee", "Builders", "Buil", "Bilders", "Electric", "Elec", "Inc", "LLC", "Co", "Jon", "Jones", "Smith", "Smyth", "X", "Xy", "Xyz", "Xaz"]
    rows = [(d, i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))) for d in range(3) for i in range(60)] + [(0, 99, None), (5, 0, "Alone")]
    names = spark.createDataFrame(rows, "key int, ord int, name string")
    normal = {(r.key, r.ord): (r.normal, r.base) for r in names.select("key", "ord", parties.normal_name(F.col("name")).alias("normal")).withColumn("base", parties.base_name(F.col("normal"))).collect()}
    want = set()
    for d in range(3):
        listed, done = [(n, *normal[k, o]) for k, o, n in rows if k == d and n], set()
        for i, (name, norm, base) in enumerate(listed):
            if norm in done:
                continue
            group = [(name, norm)]
            done.add(norm)
            for other, norm2, base2 in listed[i + 1 :]:
                if norm2 not in done and _like(base, base2) >= threshold:
                    group.append((other, norm2))
                    done.add(norm2)
            if len(group) > 1:
                want.add((d, max(group, key=lambda x: len(x[0]))[1], tuple(x[0] for x in group)))
    got = {(r.key, r.canonical, tuple(r.members)) for r in parties.similar_groups(names, threshold).collect()}
    assert got == want and want


def test_threshold_bounds_and_no_names(spark):
    none = spark.createDataFrame([], "key int, ord int, name string")
    assert parties.similar_groups(none).count() == 0
    with pytest.raises(ValueError):
        parties.similar_groups(none, 0.5)


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())).select(column.alias("v")).first().v


@pytest.mark.parametrize(("reply", "want"), [
    ("Invoice | 95 | due | soon", ("Invoice", "invoice", 0.95, "due | soon")), ("Cost Proposal | high", ("Cost Proposal", "change_order", 0.0, "No reason provided")),
    ("Menu | 50 | x", ("Menu", "other", 0.5, "x")), ("Invoice", ("Other", "other", 0.0, "Could not parse response: Invoice")), (None, ("Other", "other", 0.0, "Could not parse response: ")),
])
def test_label_replies(spark, reply, want):
    assert tuple(one(spark, replies.label_reply(F.col("t")), t=reply)) == want


def test_boundary_and_json_replies(spark):
    assert tuple(one(spark, replies.boundary_reply(F.col("t")), t="yes | 80 | new header")) == (True, 0.8, "new header")
    assert tuple(one(spark, replies.boundary_reply(F.col("t")), t="perhaps")) == (False, 0.0, "Could not parse response: perhaps")
    fenced = 'Here:\n```json\n{"boundaries": [{"page_num": 3, "is_boundary": true, "confidence": 0.9}], "window_summary": "s"}\n``` bye'
    got = one(spark, replies.json_reply(F.col("t")), t=fenced)
    assert got.boundaries[0].page_num == 3 and got.window_summary == "s" and one(spark, replies.json_reply(F.col("t")), t="no json") is None
    screened = 'Sure: [{"page": 1, "likely_boundary": true, "hint": "rfi"}, {"page": 2, "confidence": 0.1, "needs_deep_analysis": false}] and [1]'
    assert [tuple(x) for x in one(spark, replies.screening_reply(F.col("t"), F.lit(5)), t=screened)] == [(6, True, 0.5, True, "rfi"), (7, False, 0.1, False, None)]
    assert one(spark, replies.screening_reply(F.col("t"), F.lit(5)), t='[{"confidence": 1}]') == one(spark, replies.screening_reply(F.col("t"), F.lit(5)), t="none") == []


def _chunks(text, most):
    done, now = [], ""
    for sentence in text.split(". "):
        if len(now + sentence) * 0.25 <= most:
            now += sentence + ". "
        elif now:
            done.append(now.strip())
            now = ". ".join(now.split(". ")[-5:]) + ". " + sentence
        else:
            done.append(sentence[: most * 4])
    return done + ([now.strip()] if now.strip() else [])


def test_chunks_against_a_loop(spark):
    rng = random.Random(5)
    texts = ["", "a", "x" * 500, ". " * 9] + [". ".join("w" * rng.choice([1, 5, 30, 90, 200]) for _ in range(rng.randint(1, 40))) for _ in range(40)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", replies.chunks(F.col("t"), 25).alias("c")).collect()
    assert {r.i: r.c for r in got} == {i: _chunks(t, 25) for i, t in enumerate(texts)}


def test_prompts(spark):
    got = one(spark, replies.classification_prompt(F.col("t"), F.col("n")), t="a" * 3000 + "b" * 3000, n="Title")
    assert "a" * 2000 + replies.CLIP_MARK + "b" * 2000 + "\nAdditional Context: Title" in got and "- Invoice\n" in got
    ends = one(spark, replies.boundary_prompt(F.col("t"), F.col("n")), t=" ".join(map(str, range(400))), n="few  words")
    assert " 249 " not in ends and "\n250 251 " in ends and "\nfew  words\n" in ends
    assert one(spark, replies.cost(F.col("a"), F.col("b"), F.lit(2.0), F.lit(8.0)), a=500_000, b=250_000) == 3.0


def test_windows(spark):
    text = " ".join(f"word{i}" for i in range(1000))
    rows = spark.createDataFrame([(1, text, text.index("word400 ")), (2, text, 10**6), (3, "two words", 4), (4, "", 0), (5, None, 3), (6, "a a a a", 3)], "id int, text string, position int")
    got = {r.id: (r.before, r.after) for r in context.windows(rows).collect()}
    assert got[1][0].split()[0] == "word100" and got[1][1].split()[0] == "word400" and len(got[1][1].split()) == 300
    assert got[2] == ("word998", "word999") and got[3] == ("two", "words") and got[4] == got[5] == (None, None) and got[6] == ("a a", "a a")


def test_boundary_indicators(spark):
    before, after = "the pumps were installed by our crew. Best regards,", "From: ann@x.org Subject: valves ordered yesterday"
    got = one(spark, context.indicators(F.col("b"), F.col("a")), b=before, a=after)
    assert [x.split(":")[0] for x in got] == ["strong_start", "weak_end", "topic_change"]
    assert one(spark, context.topic_change(F.col("b"), F.col("a")), b="", a=after) is False
    assert 0 < one(spark, context.overall_quality(F.col("b"), F.col("a")), b=before, a=after) < 1


def test_greedy_matches_against_a_loop(spark):
    rng, p, t, want = random.Random(2), [], [], set()
    for d in range(30):
        pred, true = ([(s, s + rng.randint(0, 4)) for s in sorted(rng.sample(range(15), 5))] for _ in range(2))
        p, t, free = p + [(d, *x) for x in pred], t + [(d, *x) for x in true], list(true)
        for x in pred:
            iou = lambda y: max(0, min(x[1], y[1]) - max(x[0], y[0]) + 1) / len(set(range(x[0], x[1] + 1)) | set(range(y[0], y[1] + 1)))  # noqa: B023, E731
            best = max(free, key=lambda y: (iou(y), -free.index(y)), default=None)  # noqa: B023
            if best and iou(best) >= 0.5:
                want.add((d, *x, *best))
                free.remove(best)
    schema = "pdf_id int, start_page int, end_page int"
    got = evaluate.greedy_matches(spark.createDataFrame(p, schema), spark.createDataFrame(t, schema))
    assert {tuple(r)[:5] for r in got.collect()} == want


def test_first_overlap_and_labels(spark):
    schema = "pdf_id int, start_page int, end_page int, label string"
    pred = spark.createDataFrame([(1, 0, 3, "rfi"), (1, 4, 5, "email")], schema)
    truth = spark.createDataFrame([(1, 0, 3, "rfi"), (1, 4, 6, "rfi"), (1, 7, 8, "letter"), (2, 0, 1, "rfi")], schema)
    rows = {r.pdf_id: tuple(r)[1:7] for r in evaluate.first_overlap(pred, truth).collect()}
    assert rows == {1: (2, 3, 1, 1, 1, 0), 2: (0, 1, 0, 0, 1, 0)}
    assert {tuple(r) for r in evaluate.label_errors(pred, truth).collect()} == {("rfi", "rfi", 1, True), ("rfi", "email", 1, False)}
    both = evaluate.range_metrics(pred, truth).withColumn("method", F.lit("m"))
    assert tuple(evaluate.compare_methods(both).select("method", "n_pred", "n_true", "exact").first()) == ("m", 2, 4, 1)


def test_providers(spark):
    prompts = spark.createDataFrame([(1, "plain"), (2, "pay $5"), (3, None), (4, "boom")], "id int, prompt string")

    def cloud(batch):
        if "boom" in batch:
            raise RuntimeError("down")
        return [x.upper() for x in batch]

    routed = providers.routed(prompts, "hybrid", False, True)
    got = {r.id: (r.route, r.content) for r in providers.ask(routed, {"cloud": cloud}, batch=1).collect()}
    assert got == {1: ("cloud", "PLAIN"), 2: ("none", None), 3: ("cloud", None), 4: ("cloud", None)}


def test_readings(spark):
    images = spark.createDataFrame([(1, b"a"), (2, b"b"), (3, None)], "page_id int, content binary")

    def fails(content):
        raise ValueError("no image")

    readers = {"fails": fails, "least": lambda c: ("x", 0.95 if c == b"a" else 0.5), "more": lambda c: ("y", 0.5)}
    got = {r.page_id: tuple(r)[1:] for r in providers.read_images(images, readers).collect()}
    assert got == {1: ("least", "x", 0.95), 2: ("least", "x", 0.5), 3: (None, "", 0.0)}
