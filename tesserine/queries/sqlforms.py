"""SQL texts that return what the DataFrame forms return, held against the same SQL of DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import library
from ..operators.prep import min_max_ranges
from ..plans.sqlforms import nearest_others, nearest_sql, register
from . import prep, reports, similarity
from .base import V_SQL, as_queries, as_refs, r6, scaled, similarity_sql, table, vectors


def patches(spark: SparkSession, d: str) -> DataFrame:
    """``scan_positions`` in SQL."""
    register(spark, part=table(spark, d, "part"))
    return spark.sql("SELECT * FROM patches(48, 20, TABLE(SELECT p_partkey AS image_id, CAST(p_size * 5 AS BIGINT) AS width, CAST(p_size AS BIGINT) AS height FROM part) PARTITION BY (image_id))")


def nearest(metric: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        """``lib_topk`` in SQL. Of few vectors one neighbour more is asked for, as each finds itself; many are searched among themselves."""
        v = vectors(spark, d)
        g = library.grid(as_refs(v))
        if g:
            nearest_others(spark, as_refs(v), 3, metric, g).createOrReplaceTempView("found")
            return spark.sql("SELECT query_id, rank, ref_id, label, round(score, 6) + 0D AS score FROM found")
        register(spark, asked=as_queries(v), stored=as_refs(v))
        spark.sql(nearest_sql("asked", "stored", 4, metric, 0.0)).createOrReplaceTempView("found")
        return spark.sql("SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS rank, ref_id, label, round(score, 6) + 0D AS score FROM found WHERE ref_id <> query_id) WHERE rank <= 3")

    return query


def activations(spark: SparkSession, d: str) -> DataFrame:
    """``iv_encode_triangular`` in SQL."""
    v = scaled(spark, d)
    low, high = (min_max_ranges(v).agg(F.array_sort(F.collect_list(F.struct("feature", c)))[c].alias(name)) for c, name in (("min", "low"), ("max", "high")))
    register(spark, samples=v, low=low, high=high)
    return spark.sql("SELECT sample_id, feature, interval, round(coefficient, 6) + 0D AS coefficient FROM activations(4, TABLE(SELECT sample_id, features, low, high FROM samples, low, high))")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Similarities of embeddings with their successors by functions that SQL inlines."""
    register(spark, v=vectors(spark, d))
    names = ("euclidean", "cosine")
    told = ", ".join(f"round(vector_{n}(a.features, b.features), 6) + 0D AS {n}" for n in names)
    return spark.sql(f"SELECT a.sample_id, {told}, round(vector_hamming(a.features, b.features, 0D), 6) + 0D AS hamming, hard_interval(unit_position(a.features[0], -1D, 1D), 8) AS interval FROM v a JOIN v b ON b.sample_id = a.sample_id + 1")


QUERIES = {
    "sql_patches": patches,
    "sql_nearest_euclidean": nearest("euclidean"),
    "sql_nearest_cosine": nearest("cosine"),
    "sql_activations": activations,
    "sql_vector_functions": pairs,
}

SQL = {
    "sql_patches": reports.SQL["scan_positions"],
    "sql_nearest_euclidean": similarity.SQL["lib_topk_euclidean"],
    "sql_nearest_cosine": similarity.SQL["lib_topk_cosine"],
    "sql_activations": prep.SQL["iv_encode_triangular"],
    "sql_vector_functions": f"WITH {V_SQL} SELECT a.id AS sample_id, "
    + ", ".join(f"round({similarity_sql(n, 'a.f', 'b.f')}, 6) AS {n}" for n in ("euclidean", "cosine", "hamming"))
    + ", least(floor(least(greatest((a.f[1] + 1) / 2, 0), 1) * 8), 7)::BIGINT AS interval FROM v a JOIN v b ON b.id = a.id + 1",
}
