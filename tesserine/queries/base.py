"""Tables and SQL that several queries start from. Results are rounded to 6 places on both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anomaly, library, prep

SEED = 42
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, features, label) of the embeddings."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("features"), F.col("label").cast("long").alias("label"))


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings scaled by their own ranges."""
    v = vectors(spark, sf_dir)
    return prep.min_max_scale(v, prep.min_max_ranges(v))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, features) of lineitem's measures; the id is made of the order and the line."""
    t = table(spark, sf_dir, "lineitem")
    return t.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("sample_id"), F.array(*(F.col(c).cast("double") for c in LINE_FEATURES)).alias("features"))


def neighbors(spark: SparkSession, sf_dir: str, metric: str = "euclidean", k: int = 5) -> DataFrame:
    """The k most similar other rows of every embedding."""
    return library.nearest_others(as_refs(vectors(spark, sf_dir)), k, metric, 0.0)


def as_queries(v: DataFrame) -> DataFrame:
    return v.select(F.col("sample_id").alias("query_id"), F.col("features").alias("vector"))


def as_refs(v: DataFrame) -> DataFrame:
    return v.select(F.col("sample_id").alias("ref_id"), F.col("features").alias("vector"), "label")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, expected, predicted, correct, score_margin): every embedding by its 5 nearest others."""
    told = library.margins(neighbors(spark, sf_dir))
    own = vectors(spark, sf_dir).select(F.col("sample_id"), F.col("label").alias("expected"))
    joined = own.join(told, F.col("sample_id") == F.col("query_id")).drop("query_id")
    return joined.withColumns({"correct": F.col("expected") == F.col("predicted"), "score_margin": r6("score_margin")})


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, class_name) of the embeddings' labels."""
    labels = table(spark, sf_dir, "embeddings").select(F.format_string("class-%02d", "label").alias("n")).distinct()
    return prep.label_dim(labels, "n")


def scan_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as patches: (patch_id, image_id, vector, expected, role).

    Vectors of one label in a run of 50 ids are an image; labels from 5 on
    are anomalies. A fifth of the normal images calibrates, a fifth is
    evaluated with all anomalies, the rest are the library.
    """
    v = vectors(spark, sf_dir)
    v = v.select(F.col("sample_id").alias("patch_id"), (F.col("label") * 1_000_000 + F.expr("sample_id div 50")).alias("image_id"), F.col("features").alias("vector"), (F.col("label") >= 5).alias("expected"))
    images = v.where("not expected").select("image_id").distinct()
    split = prep.train_test_split(images, 0.4, SEED, "image_id")
    share = F.when(F.col("split") == "train", "ref").when(F.col("ord") % 2 == 0, "cal").otherwise("eval")
    return v.join(split.select("image_id", share.alias("role")), "image_id", "left").withColumn("role", F.coalesce("role", F.lit("eval")))


def scan_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration and evaluation patches with their anomaly scores."""
    roles = scan_roles(spark, sf_dir)
    refs = roles.where("role = 'ref'").select(F.col("patch_id").alias("ref_id"), "vector", F.lit(0).cast("long").alias("label"))
    return anomaly.patch_scores(roles.where("role <> 'ref'"), refs, "cosine")


def scan_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, expected, score, threshold, predicted) of the evaluated images."""
    scored = scan_scores(spark, sf_dir)
    threshold = anomaly.calibrate(anomaly.image_scores(scored.where("role = 'cal'"), 0.5), 0.9)
    evaluated = scored.where("role = 'eval'")
    scores = anomaly.image_scores(evaluated, 0.5).join(evaluated.select("image_id", "expected").distinct(), "image_id")
    return anomaly.verdicts(scores, threshold)


# --- SQL --------------------------------------------------------------------------------------------

V_SQL = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS f, label::BIGINT AS label FROM embeddings)"
LONG_SQL = f"{V_SQL}, l AS (SELECT id, label, unnest(range(len(f)))::BIGINT AS feature, unnest(f) AS x FROM v)"
SCALED_SQL = f"""{LONG_SQL}, rg AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM l GROUP BY feature),
sl AS (SELECT id, label, feature, CASE WHEN hi - lo <= 2.220446049250313e-16::DOUBLE THEN 0::DOUBLE ELSE least(greatest((x - lo) / (hi - lo), 0), 1) END AS x FROM l JOIN rg USING (feature))"""
LINES_SQL = """ll AS (SELECT l_orderkey * 100 + l_linenumber AS id, unnest([0, 1, 2, 3])::BIGINT AS feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax]::DOUBLE[]) AS x FROM lineitem)"""


def key_sql(column: str, seed: int = SEED) -> str:
    return f"((({column} + {seed}) % 1048576) * 2654435761 + ({column} % 2147483648) * 40503) % 4294967296"


def similarity_sql(metric: str, a: str, b: str, threshold: str = "0") -> str:
    z = f"list_zip({a}, {b})"
    if metric == "cosine":
        dot = lambda p, q: f"list_sum(list_transform(list_zip({p}, {q}), lambda z: z[1] * z[2]))"
        return f"{dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)}))"
    if metric == "euclidean":
        return f"1::DOUBLE / (1::DOUBLE + sqrt(list_sum(list_transform({z}, lambda z: (z[1] - z[2]) * (z[1] - z[2])))))"
    one = f"list_sum(list_transform({z}, lambda z: CASE WHEN %s THEN 1::DOUBLE ELSE 0::DOUBLE END))"
    if metric == "hamming":
        return one % f"(z[1] >= {threshold}) = (z[2] >= {threshold})" + f" / len({a})"
    both, either = one % f"z[1] >= {threshold} AND z[2] >= {threshold}", one % f"z[1] >= {threshold} OR z[2] >= {threshold}"
    return f"CASE WHEN {either} = 0 THEN 1::DOUBLE ELSE {both} / {either} END"


def neighbors_sql(metric: str = "euclidean", k: int = 5) -> str:
    return f"""{V_SQL}, pairs AS (
  SELECT a.id AS query_id, b.id AS ref_id, b.label AS label, {similarity_sql(metric, "a.f", "b.f")} AS score FROM v a JOIN v b ON a.id <> b.id
), nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref_id) AS rank FROM pairs) WHERE rank <= {k})"""


PREDICTIONS_SQL = f"""{neighbors_sql()}, cs AS (
  SELECT query_id, label, list_sum(list(score ORDER BY rank)) AS score FROM nb GROUP BY 1, 2
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label DESC) AS r FROM cs),
pr AS (
  SELECT v.id AS sample_id, v.label AS expected, t.label AS predicted, v.label = t.label AS correct, round(t.score - coalesce(s.score, 0), 6) AS score_margin
  FROM v JOIN ranked t ON t.query_id = v.id AND t.r = 1 LEFT JOIN ranked s ON s.query_id = v.id AND s.r = 2
), dim AS (SELECT row_number() OVER (ORDER BY n) - 1 AS label, n AS class_name FROM (SELECT DISTINCT format('class-{{:02d}}', label) AS n FROM embeddings))"""

ROLES_SQL = f"""{V_SQL}, pt AS (SELECT id AS patch_id, label * 1000000 + id // 50 AS image_id, f, label >= 5 AS expected FROM v),
im AS (
  SELECT image_id, row_number() OVER (ORDER BY {key_sql("image_id")}, image_id) - 1 AS ord, count(*) OVER () AS n FROM (SELECT DISTINCT image_id FROM pt WHERE NOT expected)
), ro AS (
  SELECT pt.*, CASE WHEN im.image_id IS NULL THEN 'eval' WHEN ord >= round(n * 0.4::DOUBLE) THEN 'ref' WHEN ord % 2 = 0 THEN 'cal' ELSE 'eval' END AS role
  FROM pt LEFT JOIN im USING (image_id)
), ps AS (
  SELECT a.patch_id, a.image_id, a.expected, a.role, least(greatest(1 - max({similarity_sql("cosine", "a.f", "b.f")}), 0), 1) AS anomaly_score
  FROM ro a JOIN ro b ON a.role <> 'ref' AND b.role = 'ref' GROUP BY ALL
), ims AS (
  SELECT image_id, any_value(expected) AS expected, any_value(role) AS role, list(anomaly_score ORDER BY anomaly_score DESC) AS s FROM ps GROUP BY image_id
), isc AS (
  SELECT image_id, expected, role, list_sum(s[1:greatest(1, ceil(len(s) * 0.5::DOUBLE)::INT)]) / greatest(1, ceil(len(s) * 0.5::DOUBLE)::INT) AS score, s[1] AS max_patch_score, len(s)::BIGINT AS patch_count FROM ims
), th AS (SELECT list_sort(list(score))[1 + round((count(*) - 1) * 0.9::DOUBLE)::INT] AS threshold FROM isc WHERE role = 'cal'),
ve AS (SELECT isc.*, threshold, score >= threshold AS predicted FROM isc, th WHERE role = 'eval')"""
