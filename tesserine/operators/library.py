"""Libraries of stored vectors: exhaustive top-k, votes, margins, explanations."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError, DimensionError, EmptyInputError
from ..functions import bits as B
from ..functions.vectors import EPSILON, METRICS, contributions, top_contributions
from ..session import kept
from . import nearest
from .interval_model import as_matrix
from .ranking import bucket_count, exact_rank

#: Vectors, and bytes of them, that are sent to the tasks at once, and queries that are scored at once.
BLOCK, SENT_BYTES, QUERY_BLOCK = 1 << 17, 64 << 20, 64
#: Pairs from which on the searching side is dealt out to all cores, and what was found is stored.
MANY_PAIRS = 10**8
#: Meetings of blocks for each core where vectors are searched among themselves, and rows that a block has at least.
MEETINGS, LEAST_BLOCK = 4, 4096
#: Rows that a task gives back at once.
SLICE = 8192

NEIGHBORS = "query_id bigint, ref_id bigint, label bigint, score double"
MET_ITSELF = "ref_id bigint, label bigint, __block int, __floor double, vector array<double>, __ids array<bigint>, __labels array<bigint>, __scores array<double>"


def dense_scores(q: np.ndarray, r: np.ndarray, metric: str, threshold: float = 0.5) -> np.ndarray:
    """Similarities of all rows of q and r. Sums run over the features in order, so a score depends on its two vectors alone."""
    n, m = len(q), len(r)
    if metric == "cosine":
        dots = in_order(q, r, lambda x, y: x * y)
        a, b = _squares(q), _squares(r)
        small = (a[:, None] <= EPSILON) | (b[None, :] <= EPSILON)
        return np.where(small, 0.0, dots / np.where(small, 1.0, np.sqrt(a)[:, None] * np.sqrt(b)[None, :]))
    if metric == "euclidean":
        return 1.0 / (1.0 + np.sqrt(in_order(q, r, lambda x, y: (x - y) ** 2)))
    a, b = q >= threshold, r >= threshold
    if metric == "hamming":
        return in_order(a, b, lambda x, y: x == y) / q.shape[1] if q.shape[1] else np.zeros((n, m))
    if metric == "jaccard":
        both, either = in_order(a, b, lambda x, y: x & y), in_order(a, b, lambda x, y: x | y)
        return np.where(either > 0, both / np.where(either > 0, either, 1.0), 1.0)
    raise ConfigError(f"unknown metric {metric}")


def in_order(q: np.ndarray, r: np.ndarray, term) -> np.ndarray:
    total = np.zeros((len(q), len(r)))
    columns = np.ascontiguousarray(r.T)
    for d in range(q.shape[1]):
        total += term(q[:, d, None], columns[d][None, :])
    return total


def _squares(x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += x[:, d] ** 2
    return total


def bit_scores(q: np.ndarray, r: np.ndarray, weight: float, length: int, blocks: int = B.ALL_BLOCKS) -> np.ndarray:
    """Blended similarities of boolean rows over the chosen blocks of features."""
    chosen = np.zeros(length, bool)
    for b in range(B.BLOCKS):
        if B.normal_blocks(blocks) >> b & 1:
            chosen[length * b // B.BLOCKS : length * (b + 1) // B.BLOCKS] = True
    p, s = q[:, chosen].astype(np.float32), r[:, chosen].astype(np.float32)  # counts are exact well beyond any length
    both = (p @ s.T).astype(float)
    a, b = p.sum(axis=1)[:, None].astype(float), s.sum(axis=1)[None, :].astype(float)
    either, n = a + b - both, int(chosen.sum())
    hamming = 1.0 - (either - both) / n if n else np.zeros(both.shape)
    jaccard = np.where(either > 0, both / np.where(either > 0, either, 1.0), 1.0)
    return hamming * (1.0 - weight) + jaccard * weight


def best(scores: np.ndarray, ids: np.ndarray, labels: np.ndarray, k: int, by_label: bool) -> np.ndarray:
    """Indices (rows, k) of the best: score falling, then label if asked, then id rising; found by partition, then sorted."""
    n = scores.shape[1]
    k = min(k, n)
    order = np.lexsort((ids, labels)) if by_label else np.argsort(ids, kind="stable")
    s = scores[:, order]
    bound = np.partition(s, n - k, axis=1)[:, n - k]
    over, level = s > bound[:, None], s == bound[:, None]
    keep = over | (level & (np.cumsum(level, axis=1) <= (k - over.sum(axis=1))[:, None]))
    at = np.nonzero(keep)[1].reshape(-1, k)
    inner = np.argsort(-np.take_along_axis(s, at, axis=1), axis=1, kind="stable")
    return order[np.take_along_axis(at, inner, axis=1)]


def block_size(width: int | None) -> int:
    """Vectors of so many features that are sent at once."""
    return max(1, min(BLOCK, SENT_BYTES // (8 * max(width or 1, 1))))


def blocks(rows: DataFrame, key: str, n: int, columns: list[str], size: int | None = None) -> Iterator[pa.Table]:
    """The n rows in blocks of at most ``size`` (BLOCK if not given), one after the other."""
    size = size or BLOCK
    if n > size:
        keyed = rows.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(bucket_count(n))))
        rows = kept(exact_rank(keyed, [], "__bucket", [key], "__n").withColumn("__block", F.expr(f"__n div {size}")).select(*columns, "__block"))
    for b in range(-(-n // size)):
        yield (rows.where(F.col("__block") == b) if n > size else rows).select(*columns).toArrow().combine_chunks()


def matrix(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    lists = table.column("vector")
    return as_matrix(lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists)


def column(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    column = table.column(name)
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def pair_scores(q: np.ndarray, r: np.ndarray, metric: str) -> np.ndarray:
    """Cosine or Euclidean similarities of rows of q and r side by side, the same numbers as ``dense_scores`` gives."""
    if metric == "euclidean":
        return 1.0 / (1.0 + np.sqrt(nearest.ordered_sum((q - r) ** 2)))
    a, b = nearest.ordered_sum(q**2), nearest.ordered_sum(r**2)
    small = (a <= EPSILON) | (b <= EPSILON)
    return np.where(small, 0.0, nearest.ordered_sum(q * r) / np.where(small, 1.0, np.sqrt(a) * np.sqrt(b)))


#: Adds the best of some stored vectors for queries (vectors, their ids, what they have so far).
Finder = Callable[[np.ndarray, np.ndarray, nearest.Best], None]


def _scored(r: np.ndarray, ids: np.ndarray, labels: np.ndarray, k: int, scorer: Callable, by_label: bool, exclude_self: bool) -> Finder:
    """Every pair is scored."""

    def find(q: np.ndarray, own: np.ndarray, so_far: nearest.Best) -> None:
        for begin in range(0, len(q), QUERY_BLOCK):
            scores = scorer(q[begin : begin + QUERY_BLOCK], r)
            if exclude_self:
                scores = np.where(own[begin : begin + QUERY_BLOCK, None] == ids[None, :], -np.inf, scores)
            at = best(scores, ids, labels, k, by_label)
            s = np.take_along_axis(scores, at, axis=1)
            so_far.add(begin + np.repeat(np.arange(len(at)), at.shape[1]), s.ravel(), labels[at].ravel().astype(np.int64), ids[at].ravel().astype(np.int64))

    return find


def dense_finder(metric: str, threshold: float):
    """Finders of the best by a metric."""
    plain = lambda q, r: dense_scores(q, r, metric, threshold)

    def finder(r: np.ndarray, ids: np.ndarray, labels: np.ndarray, k: int, exclude_self: bool) -> Finder:
        slow = _scored(r, ids, labels, k, plain, False, exclude_self)
        if metric in ("hamming", "jaccard"):
            score, weight = (nearest.equal_share, 0.0) if metric == "hamming" else (nearest.blended(1.0), 1.0)
            return _by_bits(r, ids, labels, k, threshold, weight, B.ALL_BLOCKS, score, False, exclude_self) or slow
        stored = nearest.Vectors(r, ids, labels, metric, lambda q, s: pair_scores(q, s, metric))

        def find(q: np.ndarray, own: np.ndarray, so_far: nearest.Best) -> None:
            if stored.fits(q):
                stored.search(q, own if exclude_self else None, so_far)
            else:
                slow(q, own, so_far)

        return find

    return finder


def bit_finder(threshold: float, weight: float, blocks: int):
    """Finders of the best by blended similarity over some blocks of bits."""

    def finder(r: np.ndarray, ids: np.ndarray, labels: np.ndarray, k: int, exclude_self: bool) -> Finder:
        plain = lambda q, s: bit_scores(q >= threshold, s >= threshold, weight, q.shape[1], blocks)
        return _by_bits(r, ids, labels, k, threshold, weight, blocks, nearest.blended(weight), True, exclude_self) or _scored(r, ids, labels, k, plain, True, exclude_self)

    return finder


def _by_bits(r: np.ndarray, ids: np.ndarray, labels: np.ndarray, k: int, threshold: float, weight: float, blocks: int, score: Callable, by_label: bool, exclude_self: bool) -> Finder | None:
    """None where there are no bits to compare, or where the weight is none."""
    words, n = nearest.features(r.shape[1], blocks)
    if not n or not 0.0 <= weight <= 1.0:
        return None
    twice = exclude_self and len(np.unique(ids)) < len(ids)
    stored = nearest.Bits(nearest.packed(r >= threshold), ids, labels, words, n, k + exclude_self, by_label, twice)
    return lambda q, own, so_far: stored.search(nearest.packed(q >= threshold), own if exclude_self else None, [(so_far, score, weight)])


def _asked(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return column(table, "query_id"), matrix(table)


def _stored(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return matrix(table), column(table, "ref_id"), column(table, "label")


def _top(rows: DataFrame, k: int, ties: list[str]) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *ties)
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def _search(queries: DataFrame, refs: DataFrame, k: int, finder, by_label: bool, exclude_self: bool) -> DataFrame:
    """Top k of each query.

    The smaller side goes out in blocks of bounded size, one after the other;
    the other is passed over once for each block, dealt out to all cores if
    there are many pairs. A task keeps only the k best of what it has seen for
    each query, and these are merged by query. With several blocks each pass
    is finished before the next.
    """
    stored, width = refs.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if not stored:
        raise EmptyInputError("the library is empty")
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    number = queries.count()
    names, ties = ["query_id", "ref_id", "label", "score"], ["label", "ref_id"] if by_label else ["ref_id"]
    top = lambda rows: _top(rows, k, ties)
    send_queries = 0 < number < stored
    columns, key, sent_rows, n = (["query_id", "vector"], "query_id", asked, number) if send_queries else (["ref_id", "label", "vector"], "ref_id", refs, stored)
    passed, passed_key = (refs.select("ref_id", "label", "vector"), "ref_id") if send_queries else (asked, "query_id")
    size, many = block_size(width), number * stored >= MANY_PAIRS
    if many:
        passed = passed.repartition(2 * queries.sparkSession.sparkContext.defaultParallelism, passed_key)
        passed = kept(passed) if n > size else passed

    found = None
    for table in blocks(sent_rows, key, n, columns, size):
        sent = queries.sparkSession.sparkContext.broadcast(table)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            find, so_far = None, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                if send_queries:
                    own, q = _asked(sent.value)
                    so_far = so_far or nearest.Best(len(own), k, by_label)
                    for begin in range(0, batch.num_rows, BLOCK):
                        r, ids, labels = _stored(batch.slice(begin, BLOCK))
                        _same_width(q, r)
                        finder(r, ids, labels, k, exclude_self)(q, own, so_far)
                else:
                    own, q = _asked(batch)
                    if find is None:
                        r, ids, labels = _stored(sent.value)
                        find = finder(r, ids, labels, k, exclude_self)
                    _same_width(q, r)
                    mine = nearest.Best(len(own), k, by_label)
                    find(q, own, mine)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in nearest.results(own, mine)], names=names)
            if so_far is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in nearest.results(own, so_far)], names=names)

        rows = passed.mapInArrow(search, NEIGHBORS)
        if n > size:
            rows = kept(top(rows).drop("rank") if send_queries else rows)
            sent.destroy()
        found = rows if found is None else found.unionByName(rows)
    return kept(top(found)) if many else top(found)


def _others(table: pa.Table, metric: str) -> nearest.Others:
    return nearest.Others(*_stored(table), metric, lambda q, r: pair_scores(q, r, metric))


def _all_others(asked: nearest.Others, stored: nearest.Others, best: nearest.Best, metric: str) -> None:
    """Every pair is scored, where single precision bounds nothing."""
    _scored(stored.r, stored.ids, stored.labels, best.k, lambda q, r: dense_scores(q, r, metric), False, True)(asked.r, asked.ids, best)


def _met_itself(table: pa.Table, block: int, k: int, metric: str) -> Iterator[pa.RecordBatch]:
    """A block's rows, each with its k best among them and the score that others have to reach."""
    rows, best = _others(table, metric), nearest.Best(table.num_rows, k, False)
    if rows.keys is None:
        _all_others(rows, rows, best, metric)
    else:
        floor = rows.floor(k)
        rows.meet(rows, best, best, floor, floor)
    width = rows.r.shape[1]
    for begin in range(0, len(rows.ids), SLICE):
        at = slice(begin, begin + SLICE)
        found = best.scores[at] > -np.inf
        ends = np.append(0, np.cumsum(found.sum(axis=1))).astype(np.int32)
        near = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[at][found])) for x in (best.ids, best.labels, best.scores)]
        n = len(found)
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(rows.r[at].ravel()))
        plain = [rows.ids[at], rows.labels[at], np.full(n, block, np.int32), best.scores[at, -1] if k else np.full(n, np.inf)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, plain), vectors, *near], names=["ref_id", "label", "__block", "__floor", "vector", "__ids", "__labels", "__scores"])


def _met(one: pa.Table, two: pa.Table, k: int, metric: str) -> Iterator[pa.RecordBatch]:
    """The k best of the rows of two blocks, each among the other's rows, as far as they reach their floors."""
    stored = [_others(t, metric) for t in (one, two)]
    _same_width(stored[0].r, stored[1].r)
    found = [nearest.Best(len(s.ids), k, False) for s in stored]
    if all(s.keys is not None for s in stored):
        floors = [column(t, "__floor")[s.order] for t, s in zip((one, two), stored)]
        stored[0].meet(stored[1], *found, *floors)
    else:
        for s, other, best in zip(stored, stored[::-1], found):
            _all_others(s, other, best, metric)
    for s, best in zip(stored, found):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in nearest.results(s.ids, best)], names=["query_id", "ref_id", "label", "score"])


def nearest_others(refs: DataFrame, k: int, metric: str = "euclidean", threshold: float = 0.5) -> DataFrame:
    """(query_id, rank, ref_id, label, score): the k most similar others of each stored vector, ties to the smaller id.

    The same as ``top_k`` of the vectors among themselves without equal ids.
    By cosine or Euclidean similarity, many are dealt out to blocks of bounded
    size. Each block is searched by itself first, and then each two blocks
    meet in a task of their own, so that a pair is looked at once, for both of
    its vectors, and only what beats the best of the own block is scored.
    Nothing goes through the driver.
    """
    g = grid(refs)
    if metric not in ("cosine", "euclidean") or not g:
        return top_k(refs.select(F.col("ref_id").alias("query_id"), "vector"), refs, k, metric, threshold, exclude_self=True)
    rows = kept(dealt(refs, g).mapInArrow(lambda batches: alone(batches, k, metric), MET_ITSELF))
    found = rows.select(F.col("ref_id").alias("query_id"), F.explode(F.arrays_zip("__ids", "__labels", "__scores")).alias("__n")).select("query_id", F.col("__n.__ids").alias("ref_id"), F.col("__n.__labels").alias("label"), F.col("__n.__scores").alias("score"))
    if g > 1:
        found = found.unionByName(meetings(rows, g).mapInArrow(lambda batches: together(batches, k, metric), NEIGHBORS))
    return kept(_top(found, k, ["ref_id"]))


def grid(refs: DataFrame) -> int:
    """Blocks that vectors are dealt out to where they are searched among themselves; 0 where they are few."""
    n, width = refs.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    cores = refs.sparkSession.sparkContext.defaultParallelism
    return 0 if n * n < MANY_PAIRS else max(-(-n // block_size(width)), min(-(-n // LEAST_BLOCK), math.isqrt(2 * MEETINGS * cores)))


def dealt(refs: DataFrame, g: int) -> DataFrame:
    """The vectors with their blocks, a block in each partition."""
    rows = refs.select("ref_id", "label", F.col("vector").cast("array<double>").alias("vector"), F.pmod(F.xxhash64("ref_id"), F.lit(g)).cast("int").alias("__block"))
    return rows.repartitionById(g, "__block")


def meetings(rows: DataFrame, g: int) -> DataFrame:
    """Blocks that have met themselves, each two of them in a partition; there are two at least."""
    pairs = rows.select("ref_id", "label", "vector", "__block", "__floor", F.explode(F.sequence(F.lit(0), F.lit(g - 1))).alias("__other")).where("__block <> __other")
    pairs = pairs.select("ref_id", "label", "vector", "__block", "__floor", F.least("__block", "__other").alias("__low"), F.greatest("__block", "__other").alias("__high"))
    return pairs.repartitionById(g * (g - 1) // 2, F.expr(f"int(__low * ({2 * g - 1} - __low) div 2 + __high - __low - 1)"))


def alone(batches: Iterator[pa.RecordBatch], k: int, metric: str) -> Iterator[pa.RecordBatch]:
    """A task of ``dealt`` blocks."""
    for (block,), table in _groups(batches, "__block"):
        yield from _met_itself(table, block, k, metric)


def together(batches: Iterator[pa.RecordBatch], k: int, metric: str) -> Iterator[pa.RecordBatch]:
    """A task of ``meetings``."""
    for (low, high), table in _groups(batches, "__low", "__high"):
        side = column(table, "__block")
        one, two = (table.filter(pa.array(side == b)) for b in (low, high))
        if one.num_rows and two.num_rows:
            yield from _met(one, two, k, metric)


def _groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """The rows of a task by their keys; as they are dealt out, all have the same."""
    held = [batch for batch in batches if batch.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    values = np.stack([column(table, key) for key in keys], axis=1)
    for group in np.unique(values, axis=0):
        yield tuple(group.tolist()), table.filter(pa.array((values == group).all(axis=1)))


def _same_width(q: np.ndarray, r: np.ndarray) -> None:
    if q.shape[1] != r.shape[1]:
        raise DimensionError(f"{q.shape[1]} features, expected {r.shape[1]}")


def top_k(queries: DataFrame, refs: DataFrame, k: int, metric: str = "euclidean", threshold: float = 0.5, exclude_self: bool = False) -> DataFrame:
    """(query_id, rank, ref_id, label, score): the k most similar stored vectors, ties to the smaller id.

    ``queries`` has query_id and vector; ``refs`` has ref_id, vector, label.
    The smaller side goes out in blocks of bounded size; the other stays where
    it is. Only k rows for each query, task and block are shuffled.
    """
    if metric not in METRICS:
        raise ConfigError(f"unknown metric {metric}")
    return _search(queries, refs, k, dense_finder(metric, threshold), False, exclude_self)


def top_k_bits(queries: DataFrame, refs: DataFrame, k: int, threshold: float, weight: float = 0.0, blocks: int = B.ALL_BLOCKS, exclude_self: bool = False) -> DataFrame:
    """Like ``top_k`` over vectors cut at ``threshold``, with masked blocks and blended similarity; ties to the smaller label, then id."""
    return _search(queries, refs, k, bit_finder(threshold, weight, blocks), True, exclude_self)


def vote(neighbors: DataFrame, label_order: str = "desc") -> DataFrame:
    """(query_id, predicted): the label with the greatest sum of scores, then count, then label (``desc`` for dense, ``asc`` for binary libraries)."""
    sums = class_scores(neighbors)
    key = F.col("label") if label_order == "desc" else -F.col("label")
    return sums.groupBy("query_id").agg(F.max_by("label", F.struct("score", "votes", key.alias("k"))).alias("predicted"))


def class_scores(neighbors: DataFrame) -> DataFrame:
    """(query_id, label, score, votes) summed over the neighbours, in the order of their ranks."""
    packed = neighbors.groupBy("query_id", "label").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("__s"))
    total = F.aggregate("__s", F.lit(0.0), lambda a, s: a + s["score"])
    return packed.select("query_id", "label", total.alias("score"), F.size("__s").cast("long").alias("votes"))


def margins(neighbors: DataFrame) -> DataFrame:
    """(query_id, predicted, score_margin): best class by score then highest label, and its lead over the second (over 0 if alone)."""
    packed = class_scores(neighbors).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("score", "label")), asc=False).alias("__c"))
    second = F.coalesce(F.get("__c", F.lit(1))["score"], F.lit(0.0))
    return packed.select("query_id", F.col("__c")[0]["label"].alias("predicted"), (F.col("__c")[0]["score"] - second).alias("score_margin"))


def explain(queries: DataFrame, refs: DataFrame, neighbors: DataFrame, metric: str, top_features: int, threshold: float = 0.5) -> DataFrame:
    """(query_id, predicted, ref_id, score, contributions): the vote, the best neighbour, and its strongest features."""
    first = neighbors.where("rank = 1").select("query_id", "ref_id", "score")
    joined = first.join(queries.select("query_id", F.col("vector").alias("__q")), "query_id").join(refs.select("ref_id", F.col("vector").alias("__r")), "ref_id")
    values = contributions(metric, F.col("__q").cast("array<double>"), F.col("__r").cast("array<double>"), threshold)
    told = joined.select("query_id", "ref_id", "score", top_contributions(values, top_features).alias("contributions"))
    return told.join(vote(neighbors), "query_id")


def explain_bits(queries: DataFrame, refs: DataFrame, neighbors: DataFrame, threshold: float, length: int, top_bits: int) -> DataFrame:
    """Like ``explain``, by the bits that agree."""
    first = neighbors.where("rank = 1").select("query_id", "ref_id", "score")
    words = lambda df, key, name: df.select(key, B.pack(F.col("vector").cast("array<double>"), threshold).alias(name))
    joined = first.join(words(queries, "query_id", "__q"), "query_id").join(words(refs, "ref_id", "__r"), "ref_id")
    values = B.bit_contributions(F.col("__q"), F.col("__r"), length)
    told = joined.select("query_id", "ref_id", "score", top_contributions(values, top_bits).alias("contributions"))
    return told.join(vote(neighbors, "asc"), "query_id")


def memory_bytes(count: int, width: int, binary: bool = False) -> int:
    """8 bytes a value, or a packed word."""
    return 8 * count * (-(-width // 64) if binary else width)


class Library:
    """Stored reference vectors with labels; the first vectors fix the width."""

    def __init__(self, refs: DataFrame, metric: str = "euclidean", threshold: float = 0.5):
        low, high = refs.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
        if not high:
            raise EmptyInputError("no reference vectors")
        if low != high:
            raise DimensionError(f"vectors have {low} to {high} features")
        self.refs, self.metric, self.threshold, self.width = refs, metric, threshold, high

    def add(self, more: DataFrame) -> Library:
        return Library(self.refs.unionByName(more), self.metric, self.threshold)

    def top_k(self, queries: DataFrame, k: int) -> DataFrame:
        return top_k(queries, self.refs, k, self.metric, self.threshold)

    def predict(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, predicted); with k = 0 there is nobody to ask, and no rows."""
        return vote(self.top_k(queries, k)) if k else queries.select("query_id", F.lit(None).cast("long").alias("predicted")).limit(0)

    def explain(self, queries: DataFrame, k: int, top_features: int) -> DataFrame:
        return explain(queries, self.refs, self.top_k(queries, k), self.metric, top_features, self.threshold)


class BinaryLibrary(Library):
    """Reference vectors cut into bits."""

    def __init__(self, refs: DataFrame, threshold: float = 0.5, weight: float = 0.0, blocks: int = B.ALL_BLOCKS):
        super().__init__(refs, "hamming", threshold)
        self.weight, self.blocks = weight, blocks

    def top_k(self, queries: DataFrame, k: int) -> DataFrame:
        return top_k_bits(queries, self.refs, k, self.threshold, self.weight, self.blocks)

    def predict(self, queries: DataFrame, k: int) -> DataFrame:
        return vote(self.top_k(queries, k), "asc")

    def explain(self, queries: DataFrame, k: int, top_features: int) -> DataFrame:
        return explain_bits(queries, self.refs, self.top_k(queries, k), self.threshold, self.width, top_features)
