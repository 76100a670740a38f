"""An inverted-file index over embeddings, and hybrid search.

Vectors are scaled to length 1 and dealt to the cells of a k-means whose centres are fitted on a bounded sample; every vector is
indexed, in the `homes` cells that are nearest to it. A query visits the cells whose centres are nearest (`probes`) and ranks what lies there by its exact cosine. With
`exact` it then visits every other cell that may hold something nearer, by the triangle inequality, so that nothing is lost.

Cells meet queries in blocks: a cell of more than BLOCK vectors is parted by their ids' hash, so neither copies of one vector nor
a popular region land in one task, and a block compares its queries and vectors by one matrix product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import kept

BLOCK = 20_000
#: Documents and queries of a block that compares words.
TEXTS, ASKED = 10_000, 4_096
#: Scores are compared to so many digits, equal ones by id: a product's last digits depend on where a vector stands in a block.
DIGITS = 9


@dataclass
class CellIndex:
    """cells: (cell, part, vec_id, vector); shape: (cell, parts, radius), a row for each cell."""

    centres: np.ndarray
    cells: DataFrame
    shape: DataFrame


def _unit(column: pa.Array) -> np.ndarray:
    """Vectors of length 1, a row each; a null or zero vector, or one with a null in it, is a row of zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    width = int(sizes.max(initial=0))
    good = (sizes == width) & column.is_valid().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    if width and good.any():
        out[good] = column.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    out[~np.isfinite(out).all(1)] = 0
    length = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(length > 0, length, 1)


def _rows(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as lists."""
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(matrix.ravel(), kind))


def _vectors(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    return df.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))


def fit_centres(vectors: DataFrame, n_cells: int, most_rows: int = 20_000, rounds: int = 10) -> np.ndarray:
    """Centres of at most n_cells cells, by k-means over the most_rows vectors whose ids hash lowest: the bound of what the driver holds."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most_rows).select("vector").toArrow().column("vector").combine_chunks()
    x = _unit(sample)
    x = np.unique(x[(x != 0).any(1)], axis=0)
    if not len(x):
        return np.zeros((1, x.shape[1]))
    # the first centres are spread: each next one is the vector farthest from those chosen
    chosen = [0]
    far = x @ x[0]
    while len(chosen) < min(n_cells, len(x)):
        chosen.append(int(far.argmin()))
        far = np.maximum(far, x @ x[chosen[-1]])
    centres = x[chosen]
    for _ in range(rounds):
        cell = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        length = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


def build(embeddings: DataFrame, n_cells: int = 64, vec_id: str = "vec_id", embedding: str = "embedding", most_rows: int = 20_000, homes: int = 2) -> CellIndex:
    """The index of all rows, each in its `homes` nearest cells, written to the shared folder. Null vectors and those of zeros lie in the first cell and are like nothing."""
    vectors = _vectors(embeddings, vec_id, embedding)
    centres = fit_centres(vectors, n_cells, most_rows)
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            x = _unit(b.column(1))
            x = x if x.shape[1] == centres.shape[1] else np.zeros((len(x), centres.shape[1]))
            near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :homes]
            row, cell = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()
            x = x[row]
            far = np.sqrt(((x - centres[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), b.column(0).take(pa.array(row)), pa.array(far), _rows(x, pa.float64())], names=["cell", "vec_id", "far", "vector"])

    dealt = kept(vectors.mapInArrow(run, f"cell int, vec_id {kind}, far double, vector array<double>"), "vector-cells")
    shape = dealt.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"), F.max("far").alias("radius"))
    parted = dealt.join(shape, "cell").select("cell", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), "vec_id", "vector")
    return CellIndex(centres, kept(parted, "vector-parts"), kept(shape, "vector-shape"))


def _ranked(index: CellIndex, visits: DataFrame, k: int) -> DataFrame:
    """(query, vec_id, score): the first k of each query over the cells it visits; visits: (query, cell, qv)."""
    kind = index.cells.schema["vec_id"].dataType.simpleString()
    asked = visits.join(index.shape, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cell", "part", "query", "qv")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        queries, found = left.combine_chunks(), right.combine_chunks()
        q = np.stack(queries.column("qv").to_numpy()) if queries.num_rows else np.zeros((0, index_width))
        x = np.stack(found.column("vector").to_numpy()) if found.num_rows else np.zeros((0, index_width))
        ids = found.column("vec_id").combine_chunks()
        order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable") if found.num_rows else np.zeros(0, int)
        x, ids = x[order], ids.take(pa.array(order))
        rows, columns, scores = [], [], []
        for i in range(0, len(q), 256):
            s = np.round(q[i : i + 256] @ x.T, DIGITS)
            best = np.argsort(-s, axis=1, kind="stable")[:, :k]
            rows.append(np.repeat(np.arange(i, i + len(s)), best.shape[1]))
            columns.append(best.ravel())
            scores.append(np.take_along_axis(s, best, 1).ravel())
        none = [np.zeros(0, int)]
        rows, columns, scores = (np.concatenate(x or none) for x in (rows, columns, scores))
        return pa.table([queries.column("query").take(pa.array(rows)), ids.take(pa.array(columns)), pa.array(scores, pa.float64())], names=["query", "vec_id", "score"])

    index_width = index.centres.shape[1]
    query_kind = visits.schema["query"].dataType.simpleString()
    return asked.groupBy("cell", "part").cogroup(index.cells.groupBy("cell", "part")).applyInArrow(run, f"query {query_kind}, vec_id {kind}, score double")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each query by score, equal ones by id."""
    pairs = F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))
    # a vector may be met in several cells
    best = found.groupBy("query", "vec_id").agg(F.max("score").alias("score")).groupBy("query").agg(F.slice(F.array_sort(pairs), 1, k).alias("best"))
    return best.select("query", F.posexplode("best").alias("rank", "b")).select("query", (F.col("rank") + 1).alias("rank"), "b.vec_id", (-F.col("b.minus")).alias("score"))


def search(index: CellIndex, queries: DataFrame, k: int = 10, probes: int = 8, exact: bool = False, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query, rank, vec_id, score): the k indexed vectors of highest cosine for each row of queries, from its `probes` nearest cells or, exact, from all.

    Equal scores (to 9 digits) go by id; a vector is found by itself. Queries whose vector is null or zero are like nothing: all scores are 0.
    Rows of queries that share an id are one query.
    """
    asked = _vectors(queries, vec_id, embedding).dropDuplicates(["vec_id"])
    centres = index.centres
    kind = asked.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            x = _unit(b.column(1))
            x = x if x.shape[1] == centres.shape[1] else np.zeros((len(x), centres.shape[1]))
            near = x @ centres.T
            order = np.argsort(-near, axis=1, kind="stable")
            place = np.argsort(order, axis=1)
            far = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * near, 0))
            yield pa.RecordBatch.from_arrays([b.column(0), _rows(x, pa.float64()), _rows(place, pa.int32()), _rows(far, pa.float64())], names=["query", "qv", "place", "far"])

    placed = kept(asked.mapInArrow(run, f"query {kind}, qv array<double>, place array<int>, far array<double>"), "vector-queries")
    each = placed.select("query", "qv", F.posexplode(F.arrays_zip("place", "far")).alias("cell", "to")).select("query", "qv", "cell", "to.place", "to.far")
    found = kept(_ranked(index, each.where(F.col("place") < probes).select("query", "cell", "qv"), k), "vector-near")
    if exact:
        # distance of the k-th so far; a query with fewer than k visits all cells
        reached = _first(found, k).where(F.col("rank") == k).select("query", F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))).alias("kth"))
        rest = each.where(F.col("place") >= probes).join(reached, "query", "left").join(index.shape.select("cell", "radius"), "cell")
        rest = rest.where(F.col("kth").isNull() | (F.col("far") - F.col("radius") <= F.col("kth") + 1e-6) | (F.size(F.filter("qv", lambda x: x != 0)) == 0))
        found = found.unionByName(_ranked(index, rest.select("query", "cell", "qv"), k))
    return _first(found, k)


def token_scores(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, doc_id, share): what share of a query's words (query, words) each document holds that holds one; from postings alone."""
    words = queries.select("query", F.size(F.array_distinct("words")).alias("n"), F.explode(F.array_distinct("words")).alias("token"))
    hits = index.select("token", "doc_id").distinct().join(words, "token")
    return hits.groupBy("query", "doc_id").agg((F.count("*") / F.max("n")).alias("share"))


def best_token_scores(docs: DataFrame, queries: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """(query, doc_id, share): the shares of `token_scores` that can enter the first k of a hybrid search, from docs (doc_id, words) and queries (query, words).

    Those are the shares of what near (query, vec_id) holds, and for each query the first k others, so the most that a query is near to are
    ranked as well. Blocks of documents and queries meet, each ranks its own, and only first ones are shuffled: no pair of a query and a document is.
    """
    docs = docs.select("doc_id", F.array_distinct("words").alias("words"))
    asked = queries.groupBy("query").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("asked")).where(F.size("asked") > 0)
    n_docs, n_asked = docs.count(), asked.count()
    most = k + (near.groupBy("query").count().agg(F.max("count")).first()[0] or 0)
    parts, turns = max(1, -(-n_docs // TEXTS)), max(1, -(-n_asked // ASKED))
    left = docs.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts))).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    right = asked.withColumn("turn", F.pmod(F.xxhash64("query"), F.lit(turns)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))
    kinds = f"query {asked.schema['query'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, share double"

    def run(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        texts, wanted = texts.combine_chunks(), wanted.combine_chunks()
        lists, words = (t.column(c).combine_chunks() for t, c in ((texts, "words"), (wanted, "asked")))
        names = words.flatten().unique()
        ids = texts.column("doc_id").combine_chunks().dictionary_encode()
        order = pc.sort_indices(ids.dictionary)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        n = max(len(order), 1)
        row = np.repeat(place[ids.indices.to_numpy()], pc.list_value_length(lists).fill_null(0).to_numpy()) if len(lists) else np.zeros(0, np.int64)
        code = pc.index_in(lists.flatten(), value_set=names).fill_null(-1).to_numpy().astype(np.int64)
        held = np.unique((code * n + row)[code >= 0])
        edges = np.searchsorted(held, np.arange(len(names) + 1) * n)
        held %= n
        asks = pc.index_in(words.flatten(), value_set=names).to_numpy()
        sizes = pc.list_value_length(words).to_numpy()
        ends = np.cumsum(sizes)
        rows, found, shares = [], [], []
        for i, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)):
            count = np.zeros(n, np.int64)
            for t in asks[end - size : end].tolist():
                count[held[edges[t] : edges[t + 1]]] += 1
            at = np.flatnonzero(count)
            if len(at) > most:
                # by count, equal ones by id
                at = at[np.argpartition(-count[at] * n + at, most - 1)[:most]]
            rows.append(np.full(len(at), i))
            found.append(at)
            shares.append(count[at] / size)
        none = [np.zeros(0, np.int64)]
        rows, found, shares = (np.concatenate(x or none) for x in (rows, found, shares))
        return pa.table([wanted.column("query").take(pa.array(rows)), ids.dictionary.take(order).take(pa.array(found)), pa.array(shares, pa.float64())], names=["query", "doc_id", "share"])

    each = left.groupBy("part", "turn").cogroup(right.groupBy("part", "turn")).applyInArrow(run, kinds)
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("minus"), "doc_id"))), 1, most)
    first = each.groupBy("query").agg(ranked.alias("best")).select("query", F.explode("best").alias("b")).select("query", "b.doc_id", (-F.col("b.minus")).alias("share"))
    pairs = near.select("query", F.col("vec_id").alias("doc_id")).distinct().join(asked, "query").join(docs, "doc_id")
    common = F.array_distinct(F.flatten(F.collect_list(F.array_intersect("words", "asked"))))
    met = pairs.groupBy("query", "doc_id").agg(F.size(common).alias("n"), F.first("asked").alias("asked")).where("n > 0").select("query", "doc_id", (F.col("n") / F.size("asked")).alias("share"))
    return first.unionByName(met).dropDuplicates(["query", "doc_id"])


def hybrid(by_vector: DataFrame, by_words: DataFrame, k: int = 10, vector_weight: float = 0.6, word_weight: float = 0.4) -> DataFrame:
    """(query, rank, doc_id, score): the first k by the weighted sum of cosine (query, vec_id, score) and share of words (query, doc_id, share).

    What one of the two has not found counts 0 there; equal sums (to 9 digits) go by id.
    """
    v = by_vector.select("query", F.col("vec_id").alias("doc_id"), (F.col("score") * vector_weight).alias("part"))
    w = by_words.select("query", "doc_id", (F.col("share") * word_weight).alias("part"))
    both = v.unionByName(w).groupBy("query", "doc_id").agg(F.round(F.sum("part"), DIGITS).alias("score"))
    return _first(both.withColumnRenamed("doc_id", "vec_id"), k).withColumnRenamed("vec_id", "doc_id")
