"""Queries on dense and binary libraries: every embedding against all others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as B
from ..operators import library
from ..operators.growing import GrowingLibrary, Neighbours
from ..session import shared_path
from .base import V_SQL, as_queries, as_refs, neighbors, neighbors_sql, r6, vectors

K, MASK, WEIGHT, CUT = 5, 0x7E57, 0.25, 0.0


def top(metric: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return neighbors(spark, d, metric, 3).select("query_id", "rank", "ref_id", "label", r6("score").alias("score"))

    return query


def votes(spark: SparkSession, d: str) -> DataFrame:
    return library.vote(neighbors(spark, d))


def margins(spark: SparkSession, d: str) -> DataFrame:
    return library.margins(neighbors(spark, d)).select("query_id", "predicted", r6("score_margin").alias("score_margin"))


def class_scores(spark: SparkSession, d: str) -> DataFrame:
    return library.class_scores(neighbors(spark, d)).select("query_id", "label", r6("score").alias("score"), "votes")


def explain(metric: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        v = vectors(spark, d)
        told = library.explain(as_queries(v), as_refs(v), neighbors(spark, d, metric, 3), metric, 4, CUT)
        rows = told.select("query_id", "predicted", "ref_id", F.posexplode("contributions").alias("place", "c"))
        return rows.select("query_id", "predicted", "ref_id", F.col("place").cast("long").alias("place"), F.col("c.feature").alias("feature"), r6("c.contribution").alias("contribution"))

    return query


def growing(spark: SparkSession, d: str) -> DataFrame:
    """``lib_topk_euclidean`` by a library that grows in three batches, one of them replayed, its neighbours updated after each."""
    v = vectors(spark, d)
    path = shared_path(spark, "library")
    stored = GrowingLibrary(spark, f"{path}/refs")
    near = Neighbours(stored, f"{path}/near", as_queries(v), 3, exclude_self=True)
    parts = [F.col("label") < 3, F.col("label").between(3, 6), F.coalesce(F.col("label") > 6, F.lit(True))]  # classes arrive one after the other
    for i in (0, 1, 1, 2):
        stored.append(as_refs(v.where(parts[i])), f"batch-{i}")
        rows = near.update()
    return rows.withColumn("score", r6("score"))


def pack_words(spark: SparkSession, d: str) -> DataFrame:
    words = vectors(spark, d).select("sample_id", F.posexplode(B.pack(F.col("features"), CUT)).alias("word", "bits"))
    return words.select("sample_id", F.col("word").cast("long").alias("word"), "bits")


def _bits(spark: SparkSession, d: str, weight: float, blocks: int, k: int = 3) -> DataFrame:
    v = vectors(spark, d)
    return library.top_k_bits(as_queries(v), as_refs(v), k, CUT, weight, blocks, exclude_self=True)


def bit_top(weight: float, blocks: int = B.ALL_BLOCKS):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _bits(spark, d, weight, blocks).select("query_id", "rank", "ref_id", "label", r6("score").alias("score"))

    return query


def bit_predict(spark: SparkSession, d: str) -> DataFrame:
    return library.vote(_bits(spark, d, WEIGHT, MASK, K), "asc")


def bit_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The blended similarity of each vector with its neighbour, from packed words on the JVM."""
    v = vectors(spark, d)
    near = _bits(spark, d, 0.0, B.ALL_BLOCKS, 1).select("query_id", "ref_id")
    words = v.select("sample_id", B.pack(F.col("features"), CUT).alias("w"))
    mask = B.block_mask_words(64, MASK)
    both = near.join(words.select(F.col("sample_id").alias("query_id"), F.col("w").alias("a")), "query_id").join(words.select(F.col("sample_id").alias("ref_id"), F.col("w").alias("b")), "ref_id")
    return both.select("query_id", "ref_id", r6(B.blended(F.col("a"), F.col("b"), 64, WEIGHT, mask)).alias("score"))


def contributing_bits(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    told = library.explain_bits(as_queries(v), as_refs(v), _bits(spark, d, 0.0, B.ALL_BLOCKS), CUT, 64, 4)
    rows = told.select("query_id", "ref_id", F.posexplode("contributions").alias("place", "c"))
    return rows.select("query_id", "ref_id", F.col("place").cast("long").alias("place"), F.col("c.feature").alias("feature"), F.col("c.contribution").alias("contribution"))


def memory(spark: SparkSession, d: str) -> DataFrame:
    n, width = vectors(spark, d).agg(F.count(F.lit(1)), F.max(F.size("features"))).first()
    return spark.createDataFrame([(library.memory_bytes(n, width), library.memory_bytes(n, width, True))], "dense_bytes bigint, binary_bytes bigint")


QUERIES = {
    **{f"lib_topk_{m}": top(m) for m in ("cosine", "euclidean", "hamming", "jaccard")},
    "lib_growing_topk": growing,
    "lib_vote": votes,
    "lib_margin": margins,
    "lib_class_scores": class_scores,
    "lib_explain_cosine": explain("cosine"),
    "lib_explain_euclidean": explain("euclidean"),
    "lib_memory_bytes": memory,
    "blib_pack_words": pack_words,
    "blib_topk_hamming": bit_top(0.0),
    "blib_topk_jaccard": bit_top(1.0),
    "blib_topk_masked_blend": bit_top(WEIGHT, MASK),
    "blib_predict": bit_predict,
    "blib_pair_similarity": bit_pairs,
    "blib_contributing_bits": contributing_bits,
}


def _top_sql(metric: str) -> str:
    return f"WITH {neighbors_sql(metric, 3)} SELECT query_id, rank, ref_id, label, round(score, 6) AS score FROM nb"


def _explain_sql(metric: str) -> str:
    term = "q.f[i] * r.f[i]" if metric == "cosine" else "-abs(q.f[i] - r.f[i])"
    return f"""WITH {neighbors_sql(metric, 3)}, cs AS (SELECT query_id, label, list_sum(list(score ORDER BY rank)) AS s, count(*) AS c FROM nb GROUP BY 1, 2),
vt AS (SELECT query_id, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, c DESC, label DESC) AS r FROM cs) WHERE r = 1),
x AS (SELECT query_id, ref_id, i - 1 AS feature, {term} AS contribution FROM nb JOIN v q ON q.id = query_id JOIN v r ON r.id = ref_id, range(1, 65) t(i) WHERE rank = 1)
SELECT query_id, predicted, ref_id, p - 1 AS place, feature, round(contribution, 6) AS contribution FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY contribution DESC, feature) AS p FROM x) JOIN vt USING (query_id) WHERE p <= 4"""


def _bits_sql(weight: float, blocks: int, k: int = 3) -> str:
    chosen = [i + 1 for b in range(B.BLOCKS) if blocks >> b & 1 for i in range(4 * b, 4 * b + 4)]
    return f"""{V_SQL}, bt AS (SELECT id, label, list_transform({chosen}, lambda i: f[i] >= {CUT}) AS b FROM v), pr AS (
  SELECT a.id AS query_id, b.id AS ref_id, b.label AS label, list_sum(list_transform(list_zip(a.b, b.b), lambda z: (z[1] AND z[2])::INT))::DOUBLE AS shared, list_sum(list_transform(list_zip(a.b, b.b), lambda z: (z[1] OR z[2])::INT))::DOUBLE AS either
  FROM bt a JOIN bt b ON a.id <> b.id
), ss AS (SELECT query_id, ref_id, label, (1 - (either - shared) / {len(chosen)}) * {1 - weight}::DOUBLE + CASE WHEN either = 0 THEN 1 ELSE shared / either END * {weight}::DOUBLE AS score FROM pr),
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label, ref_id) AS rank FROM ss) WHERE rank <= {k})"""


_BIT_OUT = "SELECT query_id, rank, ref_id, label, round(score, 6) AS score FROM nb"
_CS = "cs AS (SELECT query_id, label, list_sum(list(score ORDER BY rank)) AS score, count(*) AS votes FROM nb GROUP BY 1, 2)"

SQL = {
    **{f"lib_topk_{m}": _top_sql(m) for m in ("cosine", "euclidean", "hamming", "jaccard")},
    "lib_growing_topk": _top_sql("euclidean"),
    "lib_vote": f"WITH {neighbors_sql()}, {_CS} SELECT query_id, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, votes DESC, label DESC) AS r FROM cs) WHERE r = 1",
    "lib_margin": f"""WITH {neighbors_sql()}, {_CS}, rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label DESC) AS r FROM cs)
SELECT a.query_id, a.label AS predicted, round(a.score - coalesce(b.score, 0), 6) AS score_margin FROM rk a LEFT JOIN rk b ON b.query_id = a.query_id AND b.r = 2 WHERE a.r = 1""",
    "lib_class_scores": f"WITH {neighbors_sql()}, {_CS} SELECT query_id, label, round(score, 6) AS score, votes FROM cs",
    "lib_explain_cosine": _explain_sql("cosine"),
    "lib_explain_euclidean": _explain_sql("euclidean"),
    "lib_memory_bytes": "SELECT (8 * count(*) * max(len(embedding)))::BIGINT AS dense_bytes, (8 * count(*) * ((max(len(embedding)) + 63) // 64))::BIGINT AS binary_bytes FROM embeddings",
    "blib_pack_words": f"""WITH {V_SQL}, b AS (SELECT id, unnest(range(len(f))) AS i, unnest(f) AS x FROM v)
SELECT id AS sample_id, (i // 64)::BIGINT AS word, (sum(CASE WHEN x >= {CUT} AND i % 64 < 63 THEN (1::HUGEINT << (i % 64)::INT) ELSE 0 END) + sum(CASE WHEN x >= {CUT} AND i % 64 = 63 THEN -9223372036854775808::HUGEINT ELSE 0 END))::BIGINT AS bits FROM b GROUP BY 1, 2""",
    "blib_topk_hamming": f"WITH {_bits_sql(0.0, B.ALL_BLOCKS)} {_BIT_OUT}",
    "blib_topk_jaccard": f"WITH {_bits_sql(1.0, B.ALL_BLOCKS)} {_BIT_OUT}",
    "blib_topk_masked_blend": f"WITH {_bits_sql(WEIGHT, MASK)} {_BIT_OUT}",
    "blib_predict": f"WITH {_bits_sql(WEIGHT, MASK, K)}, {_CS} SELECT query_id, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, votes DESC, label) AS r FROM cs) WHERE r = 1",
    "blib_pair_similarity": f"""WITH {_bits_sql(0.0, B.ALL_BLOCKS, 1)}, m AS (SELECT query_id, ref_id FROM nb), c AS (SELECT id, list_transform({[i + 1 for b in range(16) if MASK >> b & 1 for i in range(4 * b, 4 * b + 4)]}, lambda i: f[i] >= {CUT}) AS b FROM v),
p AS (SELECT query_id, ref_id, len(x.b) AS n, list_sum(list_transform(list_zip(x.b, y.b), lambda z: (z[1] AND z[2])::INT))::DOUBLE AS shared, list_sum(list_transform(list_zip(x.b, y.b), lambda z: (z[1] OR z[2])::INT))::DOUBLE AS either FROM m JOIN c x ON x.id = query_id JOIN c y ON y.id = ref_id)
SELECT query_id, ref_id, round((1 - (either - shared) / n) * {1 - WEIGHT}::DOUBLE + CASE WHEN either = 0 THEN 1 ELSE shared / either END * {WEIGHT}::DOUBLE, 6) AS score FROM p""",
    "blib_contributing_bits": f"""WITH {_bits_sql(0.0, B.ALL_BLOCKS)}, x AS (SELECT query_id, ref_id, i - 1 AS feature, CASE WHEN q.f[i] >= {CUT} AND r.f[i] >= {CUT} THEN 1::DOUBLE WHEN q.f[i] < {CUT} AND r.f[i] < {CUT} THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS contribution
  FROM nb JOIN v q ON q.id = query_id JOIN v r ON r.id = ref_id, range(1, 65) t(i) WHERE rank = 1)
SELECT query_id, ref_id, p - 1 AS place, feature, contribution FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY contribution DESC, feature) AS p FROM x) WHERE p <= 4""",
}
