"""The search language by rows and by the positional index, against a loop over words."""

import unicodedata

import pyarrow.parquet as pq
import pytest
import regex
from pyspark.sql import functions as F

from paperloom.operators import search, store

ROWS = [
    (1, "Café delay", "Café delay notice: the delay notice of 10:30 in Łódź"), (2, "Report", "cafe notice of delay, subject: delay"), (3, "OR", "10 20 30 lodz ODZ"),
    (4, None, None), (5, "", " ... "), (6, "Ångström Straße", "a b c d e f g a x b ﬁne ΣΊΣΥΦΟΣ naïve café"), (7, "delay notice", "the notice comes after a delay; delays happen"), (8, "x", "a a b a b c øre ðe"),
]
QUERIES = [
    "café", "cafe", "CAFÉ -notice", "notice -café", '"delay notice"', '"notice delay"', "subject: delay", "10:30", "lodz", "łódź OR odz", "dela*", '"the del"*', '-"delay notice" delay',
    "title:delay", "TITLE:t*", "title:\"delay notice\" text:after", "NEAR(a c, 1)", "NEAR(a c, 0)", 'NEAR("a b" c, 0)', "NEAR(notice delay, 2)", "text:NEAR(delay happen, 1) -title:report", "NEAR(a b x, 2)", "σίσυφος", "angstrom AND strasse OR straße",
    "notice NOT after", "happen OR 20", "-cafe", "", "...", "a b -c", '"b a b c"', "øre OR ore", "nosuch:word", "text:10:30",
]


def words(text):
    plain = "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if not unicodedata.combining(c))
    return regex.findall(r"[\p{L}\p{N}]+", plain.translate(str.maketrans("łøðς", "lødσ".replace("ø", "o"))))


def holds(term, columns):
    """Whether one of the columns has the term."""

    def starts(w, p):
        n = len(p.words)
        same = lambda own: own[:-1] == list(p.words[:-1]) and (own[-1].startswith(p.words[-1]) if p.prefix else own[-1] == p.words[-1])
        return [i for i in range(len(w) - n + 1) if same(w[i : i + n])]

    for name, w in columns.items():
        if isinstance(term, search.Phrase):
            if term.field in (None, name) and starts(w, term):
                return True
        elif term.phrases[0].field in (None, name):
            def pick(k, chosen):
                if k == len(term.phrases):
                    return max(s for s, _ in chosen) - min(e for _, e in chosen) <= term.gap
                return any(pick(k + 1, [*chosen, (s, s + len(term.phrases[k].words))]) for s in starts(w, term.phrases[k]))

            if pick(0, []):
                return True
    return False


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, title string, text string").repartition(3)


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "postings")
    search.postings(docs, ("title", "text")).write.options(**search.DELTA_PACKED).parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("query", QUERIES)
def test_rows_and_index_agree(docs, index, query):
    fields = ("title", "text")
    parts = search.parse(query, fields)
    want = sorted(i for i, title, text in ROWS if any(p.wanted and all(holds(t, {"title": words(title), "text": words(text)}) for t in p.wanted) and not any(holds(t, {"title": words(title), "text": words(text)}) for t in p.banned) for p in parts))
    assert sorted(r.doc_id for r in docs.where(search.query_test(query, fields)).collect()) == want
    assert sorted(r.doc_id for r in search.matching(index, query).collect()) == want


def test_some_answers(docs, index):
    found = lambda q: sorted(r.doc_id for r in search.matching(index, q).collect())
    assert found("café") == [1, 2, 6] and found('"delay notice"') == [1, 7] and found("lodz") == [1, 3] and found("10:30") == [1] and found("subject: delay") == [2]
    assert found("NEAR(a c, 1)") == [6, 8] and found("NEAR(a c, 0)") == [] and found("ΣΙΣΥΦΟΣ") == [6] and found("notice -café") == [7]


def test_positions_are_packed_and_kept(spark, docs, index, tmp_path):
    assert search.index_fields(index) == ("title", "text")
    row = search.postings(docs).where("doc_id = 1 and token = 'delay'").first()
    assert row.tf == 2 and row.positions == [1, 4]
    path = str(tmp_path / "p")
    search.postings(docs).coalesce(1).write.options(**search.DELTA_PACKED).parquet(path)
    file = next((tmp_path / "p").glob("*.parquet"))
    chunk = next(c for g in [pq.ParquetFile(file).metadata.row_group(0)] for c in map(g.column, range(g.num_columns)) if "positions" in c.path_in_schema)
    assert "DELTA_BINARY_PACKED" in chunk.encodings


def test_phrases_by_stems(spark):
    docs = spark.createDataFrame([(1, "delayed notices of work"), (2, "notice of delay"), (3, None)], "doc_id long, text string")
    for index in (search.postings(docs, stems=True), search.stemmed(search.postings(docs))):
        assert [r.doc_id for r in search.matching(index, '"delaying notice"', stems=True).collect()] == [1]
        assert sorted(r.doc_id for r in search.matching(index, "NEAR(works delays, 3) OR delay", stems=True).collect()) == [1, 2]


def test_phrases_need_positions(docs):
    bare = search.postings(docs).drop("positions")
    assert [r.doc_id for r in search.matching(bare, "happen -cafe").collect()] == [7]
    with pytest.raises(ValueError):
        search.matching(bare, '"delay notice"')


def test_sorts_by_title_and_pages(spark):
    rows = [(1, "b", 3, "x"), (2, None, 5, "x"), (3, "a", 3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, title string, page_count int, text string")
    by = lambda c: [r.doc_id for r in store.search(docs, store.SearchFilter(query="x", sort_by=c)).collect()]
    assert by("page_count") == [2, 1, 3] and by("title") == [1, 3, 2]


def test_every_letter_folds_alike(spark):
    every = [chr(c) for c in range(0x20, 0x3000) if unicodedata.category(chr(c)) != "Cn"]
    got = spark.createDataFrame([(c,) for c in every], "c string").select("c", search.folded(F.col("c")).alias("f")).collect()
    assert [r.c for r in got if r.f != search.fold(r.c)] == []
