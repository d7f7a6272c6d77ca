"""Queries on statistics, scaling, labels, splits and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import argmax_last, column_array, mean_squared, one_hot
from ..operators import intervals as I
from ..operators import prep
from .base import LINE_FEATURES, LINES_SQL, LONG_SQL, SCALED_SQL, SEED, V_SQL, key_sql, lines, r6, scaled, table, vectors

EDGES = 8


def ranges_out(df: DataFrame) -> DataFrame:
    return df.select("feature", r6("min").alias("min"), r6("max").alias("max"))


def min_max_ranges(spark: SparkSession, d: str) -> DataFrame:
    return ranges_out(prep.min_max_ranges(vectors(spark, d)))


def min_max_scale(spark: SparkSession, d: str) -> DataFrame:
    return scaled(spark, d).select("sample_id", F.posexplode("features").alias("feature", "x")).select("sample_id", F.col("feature").cast("long").alias("feature"), r6("x").alias("x"))


def min_max_scale_lines(spark: SparkSession, d: str) -> DataFrame:
    t = lines(spark, d)
    out = prep.min_max_scale(t, prep.min_max_ranges(t))
    return out.select("sample_id", *(r6(F.col("features")[i]).alias(c) for i, c in enumerate(LINE_FEATURES)))


def z_score_clip(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "customer").select("c_custkey", column_array(["c_acctbal", "c_nationkey"]).alias("features"))
    return prep.z_score_clip(t, 1.5).select("c_custkey", r6(F.col("features")[0]).alias("acctbal"), r6(F.col("features")[1]).alias("nation"))


def percentile_clip(spark: SparkSession, d: str) -> DataFrame:
    return ranges_out(prep.percentile_clip_ranges(lines(spark, d), 0.05, 0.95))


def split(spark: SparkSession, d: str) -> DataFrame:
    return prep.train_test_split(vectors(spark, d), 0.2, SEED).select("sample_id", "split", "ord")


def split_stratified(spark: SparkSession, d: str) -> DataFrame:
    out = prep.train_test_split(vectors(spark, d), 0.25, SEED, within=["label"])
    return out.select("sample_id", "label", "split", "ord")


def one_hot_labels(spark: SparkSession, d: str) -> DataFrame:
    hot = vectors(spark, d).select("sample_id", F.posexplode(one_hot("label", 8)).alias("output", "target"))
    return hot.select("sample_id", F.col("output").cast("long").alias("output"), "target")


def dim_first(spark: SparkSession, d: str) -> DataFrame:
    return prep.label_dim(table(spark, d, "events"), "event_type", "event_id")


def dim_name(spark: SparkSession, d: str) -> DataFrame:
    return prep.label_dim(table(spark, d, "customer"), "c_mktsegment")


def remap(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders")
    dim = prep.label_dim(t, "o_orderpriority")
    return prep.remap_labels(t, "o_orderpriority", dim).select("o_orderkey", "label")


def counts(spark: SparkSession, d: str) -> DataFrame:
    return prep.class_counts(vectors(spark, d))


def argmax(spark: SparkSession, d: str) -> DataFrame:
    """The strongest feature of each vector, cut to tenths, so that ties occur."""
    cut = F.transform("features", lambda x: F.round(x, 1))
    return vectors(spark, d).select("sample_id", argmax_last(cut).alias("feature"))


def mse(spark: SparkSession, d: str) -> DataFrame:
    """Mean squared difference between each vector and its scaled form."""
    v, s = vectors(spark, d), scaled(spark, d).select("sample_id", F.col("features").alias("s"))
    return v.join(s, "sample_id").select("sample_id", r6(mean_squared(F.col("features"), F.col("s"))).alias("mse"))


def edges_out(df: DataFrame) -> DataFrame:
    return df.select("feature", F.posexplode("edges").alias("i", "edge")).select("feature", F.col("i").cast("long").alias("i"), r6("edge").alias("edge"))


def parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("sample_id"), column_array(["p_size", "p_retailprice"]).alias("features"))


def uniform_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges_out(I.uniform_edges(prep.min_max_ranges(parts(spark, d)), EDGES))


def quantile_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges_out(I.quantile_edges(lines(spark, d), EDGES))


def clipped_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges_out(I.uniform_edges(prep.percentile_clip_ranges(lines(spark, d), 0.1, 0.9), EDGES))


def entries(encoded: DataFrame) -> DataFrame:
    rows = encoded.select("sample_id", F.posexplode("activations").alias("i", "x"))
    return rows.select("sample_id", F.col("x.feature").alias("feature"), F.col("x.interval").alias("interval"), r6("x.coefficient").alias("coefficient"))


def event_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("sample_id"), F.array("value").alias("features"))


def encode_hard(spark: SparkSession, d: str) -> DataFrame:
    v = event_values(spark, d)
    return entries(I.encode(v, I.fit_intervals(v, 8, distributor=I.Distributor("hard"))))


def encode_triangular(spark: SparkSession, d: str) -> DataFrame:
    v = scaled(spark, d)
    return entries(I.encode(v, I.fit_intervals(v, 4, distributor=I.TRIANGULAR)))


def encode_gaussian(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "customer").select(F.col("c_custkey").alias("sample_id"), column_array(["c_acctbal"]).alias("features"))
    return entries(I.encode(v, I.fit_intervals(v, 5, distributor=I.Distributor("gaussian", 1, 1.0))))


def encode_quantile(spark: SparkSession, d: str) -> DataFrame:
    v = event_values(spark, d)
    return entries(I.encode(v, I.fit_intervals(v, 6, "quantile", distributor=I.TRIANGULAR)))


def activation_matrix(spark: SparkSession, d: str) -> DataFrame:
    v = scaled(spark, d)
    out = I.activation_matrix(I.encode(v, I.fit_intervals(v, 4, distributor=I.TRIANGULAR)), "sample_id", 4)
    return out.select("sample_id", "k", r6("a").alias("a"))


QUERIES = {
    "prep_min_max_ranges": min_max_ranges,
    "prep_min_max_scale": min_max_scale,
    "prep_min_max_scale_lines": min_max_scale_lines,
    "prep_z_score_clip": z_score_clip,
    "prep_percentile_clip_ranges": percentile_clip,
    "prep_train_test_split": split,
    "prep_split_stratified": split_stratified,
    "prep_one_hot": one_hot_labels,
    "prep_label_dim_first": dim_first,
    "prep_label_dim_name": dim_name,
    "prep_label_remap": remap,
    "prep_class_counts": counts,
    "prep_argmax": argmax,
    "prep_mean_squared": mse,
    "iv_uniform_edges": uniform_edges,
    "iv_quantile_edges": quantile_edges,
    "iv_clipped_edges": clipped_edges,
    "iv_encode_hard": encode_hard,
    "iv_encode_triangular": encode_triangular,
    "iv_encode_gaussian": encode_gaussian,
    "iv_encode_quantile": encode_quantile,
    "iv_activation_matrix": activation_matrix,
}

_RANK = "list_sort(list(x))[1 + round((count(*) - 1) * {q}::DOUBLE)::INT]"
_TRI = f"""{SCALED_SQL}, pp AS (SELECT id, label, feature, x * 3 AS p FROM sl),
en AS (SELECT id, label, feature, floor(p)::BIGINT AS interval, 1 - (p - floor(p)) AS c FROM pp UNION ALL SELECT id, label, feature, ceil(p)::BIGINT, 1 - (ceil(p) - p) FROM pp)"""
_EV = "e AS (SELECT event_id AS id, value AS x FROM events), g AS (SELECT min(x) AS lo, max(x) AS hi FROM e)"
_POSITION = "CASE WHEN hi - lo <= 2.3e-16 THEN 0::DOUBLE ELSE least(greatest((x - lo) / (hi - lo), 0), 1) END"

SQL = {
    "prep_min_max_ranges": f"WITH {LONG_SQL} SELECT feature, round(min(x), 6) AS min, round(max(x), 6) AS max FROM l GROUP BY feature",
    "prep_min_max_scale": f"WITH {SCALED_SQL} SELECT id AS sample_id, feature, round(x, 6) AS x FROM sl",
    "prep_min_max_scale_lines": "WITH r AS (SELECT "
    + ", ".join(f"min({c}) AS lo{i}, max({c}) AS hi{i}" for i, c in enumerate(LINE_FEATURES))
    + " FROM lineitem) SELECT l_orderkey * 100 + l_linenumber AS sample_id, "
    + ", ".join(f"round(({c} - lo{i}) / (hi{i} - lo{i}), 6) AS {c}" for i, c in enumerate(LINE_FEATURES))
    + " FROM lineitem, r",
    "prep_z_score_clip": """WITH s AS (SELECT avg(c_acctbal) AS am, stddev_pop(c_acctbal) AS asd, avg(c_nationkey) AS nm, stddev_pop(c_nationkey) AS nsd FROM customer)
SELECT c_custkey, round(least(greatest((c_acctbal - am) / asd, -1.5), 1.5), 6)::DOUBLE AS acctbal, round(least(greatest((c_nationkey - nm) / nsd, -1.5), 1.5), 6)::DOUBLE AS nation FROM customer, s""",
    "prep_percentile_clip_ranges": f"WITH {LINES_SQL} SELECT feature, round({_RANK.format(q=0.05)}, 6) AS min, round({_RANK.format(q=0.95)}, 6) AS max FROM ll GROUP BY feature",
    "prep_train_test_split": f"""WITH o AS (SELECT vec_id, row_number() OVER (ORDER BY {key_sql("vec_id")}, vec_id) - 1 AS ord, count(*) OVER () AS n FROM embeddings)
SELECT vec_id AS sample_id, CASE WHEN ord < round(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split, ord FROM o""",
    "prep_split_stratified": f"""WITH o AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {key_sql("vec_id")}, vec_id) - 1 AS ord, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT vec_id AS sample_id, label::BIGINT AS label, CASE WHEN ord < round(n * 0.25::DOUBLE) THEN 'test' ELSE 'train' END AS split, ord FROM o""",
    "prep_one_hot": "SELECT vec_id AS sample_id, o AS output, (label = o)::INT::DOUBLE AS target FROM (SELECT vec_id, label, unnest(range(8)) AS o FROM embeddings)",
    "prep_label_dim_first": "SELECT row_number() OVER (ORDER BY f) - 1 AS label, event_type AS class_name FROM (SELECT event_type, min(event_id) AS f FROM events GROUP BY 1)",
    "prep_label_dim_name": "SELECT row_number() OVER (ORDER BY n) - 1 AS label, n AS class_name FROM (SELECT DISTINCT c_mktsegment AS n FROM customer)",
    "prep_label_remap": "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS label FROM orders",
    "prep_class_counts": "SELECT label::BIGINT AS label, count(*) AS n FROM embeddings GROUP BY 1",
    "prep_argmax": f"WITH {LONG_SQL} SELECT id AS sample_id, max_by(feature, round(x, 1) * 1000 + feature) AS feature FROM l GROUP BY id",
    "prep_mean_squared": f"WITH {SCALED_SQL} SELECT id AS sample_id, round(avg((l.x - sl.x) ** 2), 6) AS mse FROM l JOIN sl USING (id, feature) GROUP BY id",
    "iv_uniform_edges": f"""WITH p AS (SELECT unnest([0, 1])::BIGINT AS feature, unnest([p_size::DOUBLE, p_retailprice::DOUBLE]) AS x FROM part), g AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM p GROUP BY 1)
SELECT feature, i, round(lo + (hi - lo) / {EDGES} * i, 6) AS edge FROM g, range({EDGES + 1}) t(i)""",
    "iv_quantile_edges": f"WITH {LINES_SQL}, s AS (SELECT feature, list_sort(list(x)) AS s, count(*) AS n FROM ll GROUP BY 1) SELECT feature, i, round(s[1 + round((n - 1) * (i / {EDGES}::DOUBLE))::INT], 6) AS edge FROM s, range({EDGES + 1}) t(i)",
    "iv_clipped_edges": f"WITH {LINES_SQL}, g AS (SELECT feature, {_RANK.format(q=0.1)} AS lo, {_RANK.format(q=0.9)} AS hi FROM ll GROUP BY 1) SELECT feature, i, round(lo + (hi - lo) / {EDGES} * i, 6) AS edge FROM g, range({EDGES + 1}) t(i)",
    "iv_encode_hard": f"WITH {_EV} SELECT id AS sample_id, 0::BIGINT AS feature, least(floor({_POSITION} * 8), 7)::BIGINT AS interval, 1::DOUBLE AS coefficient FROM e, g",
    "iv_encode_triangular": f"WITH {_TRI} SELECT id AS sample_id, feature, interval, round(c, 6) AS coefficient FROM en",
    "iv_encode_gaussian": f"""WITH e AS (SELECT c_custkey AS id, c_acctbal AS x FROM customer), g AS (SELECT min(x) AS lo, max(x) AS hi FROM e),
h AS (SELECT id, least(floor({_POSITION} * 5), 4)::BIGINT AS home FROM e, g)
SELECT id AS sample_id, 0::BIGINT AS feature, home + s AS interval, round(exp(-(s * s) / 2.0::DOUBLE), 6) AS coefficient FROM h, (VALUES (-1::BIGINT), (0), (1)) t(s) WHERE home + s BETWEEN 0 AND 4""",
    "iv_encode_quantile": f"""WITH {_EV}, s AS (SELECT list_sort(list(x)) AS s, count(*) AS n FROM e),
q AS (SELECT list_transform(range(1, 7), lambda i: s[1 + round((n - 1) * (i / 6::DOUBLE))::INT]) AS up FROM s)
SELECT id AS sample_id, 0::BIGINT AS feature, least(len(list_filter(up, lambda u: u < x)), 5)::BIGINT AS interval, 1::DOUBLE AS coefficient FROM e, q, range(2) t(i)""",
    "iv_activation_matrix": f"WITH {_TRI} SELECT id AS sample_id, feature * 4 + interval AS k, round(sum(c), 6) AS a FROM en GROUP BY 1, 2",
}
