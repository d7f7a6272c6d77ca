"""Exact top-k search by term-at-a-time accumulation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranks import bucket_count, exact_rank
from .store import materialize, read_table

#: Queries that are sent to the executors at once, rows whose scores are held at once, and score cells of a step.
QUERY_BLOCK, ROW_BLOCK, CELLS = 16_384, 8_192, 1 << 20
#: From this size on every double is whole. A product of lengths under SAFE bounds a score well within a long.
WHOLE, SAFE = 2.0**53, 2.0**62


def quantised(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """Rows (id, array<double>) of floor(scale * x), exact at any size; without null keys, null vectors, and those with null or non-finite components."""
    # A null, NaN or infinite component fails the comparison or makes it null.
    finite = F.coalesce(F.forall(vector, lambda x: ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))

    def floor(y):
        return F.when(F.abs(y) < WHOLE, F.floor(y).cast("double")).otherwise(y)

    usable = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite)
    return usable.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: floor(x.cast("double") * scale)).alias("q"))


def wrapped(values: np.ndarray) -> np.ndarray:
    """Whole numbers modulo 2**64, as longs. fmod and the shift by 2**64 are exact."""
    if values.dtype == np.int64:
        return values
    if not np.isfinite(values).all():
        raise OverflowError("a component times the scale leaves the range of a double")
    rest = np.fmod(values, 2.0**64)
    return np.where(rest >= 2.0**63, rest - 2.0**64, np.where(rest < -(2.0**63), rest + 2.0**64, rest)).astype(np.int64)


class Vectors:
    """Vectors with ids, as lists and as postings by term: (term, row, weight modulo 2**64) of all components that aren't zero. A term is a dimension."""

    def __init__(self, ids: np.ndarray, lists: pa.Array):
        offsets = lists.offsets.to_numpy()
        self.ids = ids
        self.values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        self.starts, self.sizes = offsets[:-1] - offsets[0], np.diff(offsets)
        rows = np.repeat(np.arange(len(self.sizes)), self.sizes)
        terms = np.arange(len(self.values)) - np.repeat(self.starts, self.sizes)
        weights = wrapped(self.values)
        keep = np.flatnonzero(self.values)
        order = keep[np.lexsort((rows[keep], terms[keep]))]
        self.terms, self.rows, self.weights = terms[order], rows[order], weights[order]
        with np.errstate(over="ignore"):
            self.lengths = np.sqrt(np.bincount(rows, self.values.astype(np.float64) ** 2, len(self.sizes)))

    def dense(self, picked: np.ndarray, width: int) -> np.ndarray:
        sizes = self.sizes[picked]
        rows = np.repeat(np.arange(len(picked)), sizes)
        places = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out = np.zeros((len(picked), width))
        out[rows, places] = self.values[np.repeat(self.starts[picked], sizes) + places]
        return out

    def whole(self, row: int) -> list[int]:
        return [int(x) for x in self.values[self.starts[row] : self.starts[row] + self.sizes[row]]]


def refuse_overflow(queries: Vectors, own: np.ndarray, rows: Vectors, others: np.ndarray) -> None:
    """Raise if the score of one of the ``own`` queries with one of the ``others`` isn't a long; what rounding leaves in doubt is summed in Python's integers."""
    width = int(max(queries.sizes[own].max(initial=0), rows.sizes[others].max(initial=0)))
    step = max(1, min(1024, CELLS // max(1, width)))
    for i in range(0, len(own), step):
        mine = own[i : i + step]
        left = queries.dense(mine, width)
        for j in range(0, len(others), step):
            theirs = others[j : j + step]
            right = rows.dense(theirs, width)
            with np.errstate(over="ignore", invalid="ignore"):
                slack = (width + 8) * 2.0**-52 * (np.abs(left) @ np.abs(right).T)
                sure = np.abs(left @ right.T) + slack < 2.0**63
            for a, b in np.argwhere(~sure & (queries.ids[mine][:, None] != rows.ids[theirs][None, :])):
                score = sum(x * y for x, y in zip(queries.whole(mine[a]), rows.whole(theirs[b])))
                if not -(2**63) <= score < 2**63:
                    raise OverflowError(f"the score {score} of query {queries.ids[mine[a]]} and row {rows.ids[theirs[b]]} leaves the range of a long")


def best_in_block(queries: Vectors, block: Vectors, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, row id, score) of the k best rows of a block for each query, ties to the smaller id, a query's own id left out.

    For each term, each query that has it scatters its weight times the
    postings of the block into its dense array of scores. Sums are modulo
    2**64, so a score that is a long is exact; the others are refused.
    """
    ids, terms, rows, weights = block.ids, block.terms, block.rows, block.weights
    with np.errstate(over="ignore", invalid="ignore"):
        wide_rows = np.flatnonzero(block.lengths * queries.lengths.max(initial=0) >= SAFE)
        wide_queries = np.flatnonzero(queries.lengths * block.lengths.max(initial=0) >= SAFE)
    refuse_overflow(queries, wide_queries, block, wide_rows)
    by_id = np.argsort(ids, kind="stable")  # columns in the order of ids: then ties go to the first
    place = np.empty_like(by_id)
    place[by_id] = np.arange(len(ids))
    columns, ordered = place[rows], ids[by_id]
    most = int(max(terms.max(initial=-1), queries.terms.max(initial=-1))) + 1
    of_rows = np.searchsorted(terms, np.arange(most + 1))
    of_queries = np.searchsorted(queries.terms, np.arange(most + 1))
    whole = np.diff(of_rows) == len(ids)  # all rows of the block have the term: its postings are a dense array
    dense = {}
    for t in np.flatnonzero(whole):
        dense[t] = np.empty(len(ids), np.int64)
        dense[t][columns[of_rows[t] : of_rows[t + 1]]] = weights[of_rows[t] : of_rows[t + 1]]
    step = max(1, CELLS // max(1, len(ids)))
    added = np.empty((step, len(ids)), np.int64)
    found = []
    for begin in range(0, len(queries.ids), step):
        own = queries.ids[begin : begin + step]
        scores = np.zeros((len(own), len(ids)), np.int64)
        for t in range(most):
            at, to = of_rows[t], of_rows[t + 1]
            a, b = of_queries[t] + np.searchsorted(queries.rows[of_queries[t] : of_queries[t + 1]], [begin, begin + len(own)])
            if a < b and at < to:
                into = queries.rows[a:b] - begin
                if whole[t]:
                    much = np.multiply(queries.weights[a:b, None], dense[t][None, :], out=added[: b - a])
                    if b - a == len(own):
                        scores += much
                    else:
                        scores[into] += much
                else:
                    scores[into[:, None], columns[None, at:to]] += queries.weights[a:b, None] * weights[None, at:to]
        other = ordered[None, :] != own[:, None]
        scores = np.where(other, scores, np.iinfo(np.int64).min)
        n = min(k, len(ids))
        # Partition selection: the k-th best score; above it all, at it the first columns.
        bound = np.partition(scores, len(ids) - n, axis=1)[:, len(ids) - n]
        over = scores > bound[:, None]
        level = (scores == bound[:, None]) & other
        keep = over | (level & (np.cumsum(level, axis=1) <= (n - over.sum(axis=1))[:, None]))
        q, c = np.nonzero(keep)
        found.append((own[q], ordered[c], scores[q, c]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3


def _search(queries, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Vectors(*queries.value)
        best = None
        for batch in batches:
            for begin in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(begin, ROW_BLOCK)
                lists = pa.concat_arrays([part.column("q")])
                found = best_in_block(block, Vectors(part.column("id").to_numpy(zero_copy_only=False), lists), k)
                q, r, s = found if best is None else (np.concatenate(x) for x in zip(best, found))
                order = np.lexsort((r, ~s, q))
                q, r, s = q[order], r[order], s[order]
                first = np.searchsorted(q, q)
                keep = np.arange(len(q)) - first < k
                best = q[keep], r[keep], s[keep]
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], names=["query_id", "vec_id", "score"])

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k best ids by inner product for each query: query_id, rank, vec_id, score.

    Both tables are rows (id long, q array<double> of whole numbers, or
    array<bigint>), sparse in the sense that only components that aren't zero
    are used; vectors may differ in length, and the missing components count
    as zero. Scores are exact, and one that isn't a long raises. Queries are numbered and go
    out in blocks of at most ``query_block`` rows, one pass over all vectors
    for each, finished before the next; only that many rows are ever on the
    driver or in a task. Each task merges its own blocks' best, then the
    tasks' best are merged.

    Ids equal to the query's are left out; ids that repeat compete as
    separate rows; of a query that repeats, one row is answered. Vectors of
    any length are taken whole, and an empty one scores 0. Empty tables give
    no rows.
    """
    spark = vectors.sparkSession
    queries = materialize(queries.dropDuplicates(["id"]), "queries")
    total = queries.count()
    numbered = queries.withColumn("__bucket", F.pmod(F.xxhash64("id"), F.lit(bucket_count(total))))
    if total > query_block:
        numbered = materialize(exact_rank(numbered, [], "__bucket", ["id"], "__n").withColumn("__block", F.expr(f"__n div {query_block}")), "blocks")
    found = None
    for b in range(max(1, -(-total // query_block))):
        own = numbered.where(F.col("__block") == b) if total > query_block else numbered
        table = own.select("id", "q").toArrow().combine_chunks()
        ids = table.column("id").to_numpy().astype(np.int64)
        lists = table.column("q").combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        sent = spark.sparkContext.broadcast((ids, lists.cast(pa.list_(lists.type.value_type))))
        best = vectors.mapInArrow(_search(sent, k), "query_id bigint, vec_id bigint, score bigint")
        if total > query_block:  # each pass is finished and stored before the next block of queries goes out
            best = materialize(_ranked(best, k).drop("rank"), "best")
            sent.destroy()
        found = best if found is None else found.union(best)
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows for each vector whose id is divisible by 50, among all others."""
    vectors = quantised(read_table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("id") % 50 == 0), 5)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
