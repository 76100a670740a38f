"""The vector index against all pairs, and weighted fusion."""

import numpy as np
import pytest

from paperloom.operators import vectors


def nearest(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    unit = lambda v: np.asarray(v, float) / (np.linalg.norm(v) or 1)
    x = np.stack([unit(v if v is not None else np.zeros(16)) for _, v in rows])
    out = {}
    for q, v in queries:
        s = np.round(x @ unit(v if v is not None else np.zeros(16)), 9)
        order = np.lexsort((ids, -s))[:k]
        out[q] = [(int(ids[i]), float(s[i])) for i in order]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 16))
    made = [(i, (centres[i % 20] + 0.5 * rng.standard_normal(16)).tolist()) for i in range(1200)]
    # copies of one vector, zeros and nulls
    return made + [(2000 + i, made[7][1]) for i in range(150)] + [(3000, [0.0] * 16), (3001, None)]


@pytest.mark.parametrize("block", [20_000, 40])
def test_exact_search_finds_all_pairs_nearest(spark, rows, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = [r for r in rows if r[0] % 25 == 0]
    index = vectors.build(table, 12, most_rows=500)
    assert index.cells.count() == 2 * len(rows) and index.cells.select("vec_id").distinct().count() == len(rows)
    got = vectors.search(index, spark.createDataFrame(asked, "vec_id long, embedding array<double>"), 10, 2, exact=True).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query, r.rank)):
        found.setdefault(r.query, []).append((r.vec_id, round(r.score, 9) + 0.0))
    assert found == {q: [(i, s + 0.0) for i, s in v] for q, v in nearest(rows, asked, 10).items()}


def test_recall_of_probes(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = [r for r in rows if r[0] % 25 == 0 and r[1] is not None and any(r[1])]
    got = vectors.search(vectors.build(table, 16), spark.createDataFrame(asked, "vec_id long, embedding array<double>"), 10, 4).collect()
    want = nearest(rows, asked, 10)
    hits = sum((r.query, r.vec_id) in {(q, i) for q, v in want.items() for i, _ in v} for r in got)
    assert hits / sum(map(len, want.values())) >= 0.9


def test_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    some = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert not vectors.search(vectors.build(none), some).collect() and not vectors.search(vectors.build(some), none).collect()
    assert [tuple(r) for r in vectors.search(vectors.build(some), some, exact=True).collect()] == [(1, 1, 1, 1.0)]


def test_fusion(spark):
    v = spark.createDataFrame([(1, 1, 5, 0.9), (1, 2, 6, 0.5)], "query long, rank int, vec_id long, score double")
    w = spark.createDataFrame([(1, 6, 1.0), (1, 7, 0.5), (1, 4, 0.5)], "query long, doc_id long, share double")
    assert [tuple(r) for r in vectors.hybrid(v, w, 3).orderBy("rank").collect()] == [(1, 1, 6, 0.7), (1, 2, 5, 0.54), (1, 3, 4, 0.2)]
