"""Queries on interval models and centroids. The class-parallel online epochs are held against a recursive query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import centroid, metrics, prep
from ..operators import intervals as I
from ..operators.interval_model import Correction, IntervalModel, learning_curve, relational_forward
from ..operators.model_table import ModelTable
from .base import SCALED_SQL, SEED, V_SQL, classes, key_sql, r6, scaled, table, vectors

D, OUTPUTS = 3, 10


def ordered(spark: SparkSession, d: str) -> DataFrame:
    """All scaled embeddings in shuffled training order."""
    return prep.train_test_split(scaled(spark, d), 0.0, SEED)


def fresh(samples: DataFrame, **correction) -> IntervalModel:
    return IntervalModel.from_training_data(samples, D, OUTPUTS, distributor=I.TRIANGULAR, correction=Correction(**correction))


def weights_out(spark: SparkSession, model: IntervalModel, counts: bool = True) -> DataFrame:
    w = model.weights_frame(spark)
    extra = ["access_count"] if counts else []
    return w.select("feature", "interval", "output", (F.round("weight", 5) + F.lit(0.0)).alias("weight"), *extra)


def online(spark: SparkSession, d: str, epochs: int = 1, epoch_mode: str = "honour", **correction) -> DataFrame:
    samples = ordered(spark, d)
    model = fresh(samples, **correction)
    model.fit(samples, epochs, epoch_mode)
    return weights_out(spark, model)


def online_ls(spark: SparkSession, d: str) -> DataFrame:
    return online(spark, d)


def online_two_epochs(spark: SparkSession, d: str) -> DataFrame:
    return online(spark, d, 2)


def online_reference_mode(spark: SparkSession, d: str) -> DataFrame:
    """Proportional as the original epoch loop has it: least squares."""
    return online(spark, d, 1, "reference", mode="proportional")


def online_prop(spark: SparkSession, d: str) -> DataFrame:
    return online(spark, d, mode="proportional")


def online_ratio(spark: SparkSession, d: str) -> DataFrame:
    return online(spark, d, mode="ratio", epsilon=1e-9, max_factor=2.0)


def plasticity(spark: SparkSession, d: str) -> DataFrame:
    return online(spark, d, freeze_after=6)


def batch(spark: SparkSession, d: str, epochs: int, **correction) -> DataFrame:
    samples = scaled(spark, d)
    model = fresh(samples, **correction)
    model.fit(samples, epochs, batch=True)
    return weights_out(spark, model)


def batch_ls(spark: SparkSession, d: str) -> DataFrame:
    return batch(spark, d, 1)


def batch_ls_three(spark: SparkSession, d: str) -> DataFrame:
    return batch(spark, d, 3)


def batch_prop(spark: SparkSession, d: str) -> DataFrame:
    return batch(spark, d, 1, mode="proportional")


def table_epochs(spark: SparkSession, d: str) -> DataFrame:
    """Three batch epochs of a model that is a table."""
    samples = ordered(spark, d)
    encoded = I.encode(samples, I.fit_intervals(samples, D, distributor=I.TRIANGULAR))
    model = ModelTable(I.activation_matrix(encoded, "sample_id", D), samples, OUTPUTS)
    model.fit(3)
    features = samples.select(F.size("features").alias("m")).first()["m"]
    places = spark.range(features * D).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(OUTPUTS - 1).cast("long"))).alias("output"))
    w = places.join(model.weights, ["k", "output"], "left")
    weight = F.round(F.coalesce("weight", F.lit(0.0)), 5) + F.lit(0.0)
    return w.select(F.expr(f"k div {D}").alias("feature"), (F.col("k") % D).alias("interval"), "output", weight.alias("weight"), F.coalesce("access_count", F.lit(0)).cast("long").alias("access_count"))


def fixed_model(samples: DataFrame) -> IntervalModel:
    """Weights by a formula, so that inference can be held against SQL."""
    import numpy as np

    model = IntervalModel.from_training_data(samples, 4, OUTPUTS, distributor=I.TRIANGULAR)
    f, i, o = np.indices(model.weights.shape)
    model.weights = ((f * 7 + i * 3 + o * 5) % 11 - 5) / 10.0
    return model


def forward_relational(spark: SparkSession, d: str) -> DataFrame:
    """Scores as a join of the activation matrix with a table of weights."""
    samples = scaled(spark, d)
    model = fixed_model(samples)
    acts = I.activation_matrix(I.encode(samples, model.intervals), "sample_id", 4)
    weights = model.weights_frame(spark).select((F.col("feature") * 4 + F.col("interval")).alias("k"), "output", "weight")
    return relational_forward(acts, weights, "sample_id").select("sample_id", "output", r6("score").alias("score"))


def forward_arrow(spark: SparkSession, d: str) -> DataFrame:
    """The same scores in Arrow batches."""
    samples = scaled(spark, d)
    out = fixed_model(samples).forward(samples).select("sample_id", F.posexplode("scores").alias("output", "score"))
    return out.select("sample_id", F.col("output").cast("long").alias("output"), r6("score").alias("score"))


def predict(spark: SparkSession, d: str) -> DataFrame:
    samples = scaled(spark, d)
    scores = fixed_model(samples).forward(samples).withColumn("scores", F.transform("scores", lambda s: F.round(s, 6)))
    from ..functions.vectors import argmax_last

    return scores.select("sample_id", argmax_last(F.col("scores")).alias("predicted"))


def curve(spark: SparkSession, d: str) -> DataFrame:
    """Errors before and after each of two epochs."""
    samples = ordered(spark, d)
    model = fresh(samples)
    rows = learning_curve(model, samples, samples, 2)
    out = spark.createDataFrame([(r["epoch"], r["mean_mse_before"], r["mean_mse_after"]) for r in rows], "epoch bigint, mse_before double, mse_after double")
    return out.select("epoch", F.round("mse_before", 5).alias("mse_before"), F.round("mse_after", 5).alias("mse_after"))


def memory(spark: SparkSession, d: str) -> DataFrame:
    model = fresh(scaled(spark, d))
    return spark.createDataFrame([(model.memory_bytes(),)], "memory_bytes bigint")


def train_evaluate(spark: SparkSession, d: str) -> DataFrame:
    """The whole run: split, scale by the training part, fit, train, predict the test part, metrics by class."""
    v = prep.train_test_split(vectors(spark, d), 0.2, SEED).persist()
    train, test = v.where("split = 'train'"), v.where("split = 'test'")
    ranges = prep.min_max_ranges(train)
    train, test = prep.min_max_scale(train, ranges), prep.min_max_scale(test, ranges)
    model = IntervalModel.from_training_data(train, 8, OUTPUTS, distributor=I.TRIANGULAR)
    model.fit(train, 3)
    told = model.predict(test).select("sample_id", F.col("label").alias("expected"), "predicted")
    return metrics.per_class_accuracy(told, classes(spark, d))


def cen_fit(spark: SparkSession, d: str) -> DataFrame:
    c = centroid.fit_centroids(vectors(spark, d))
    return c.select("label", "n", F.posexplode("centroid").alias("feature", "mean")).select("label", "n", F.col("feature").cast("long").alias("feature"), r6("mean").alias("mean"))


def cen_predict(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    out = centroid.predict_centroid(v, centroid.fit_centroids(v))
    return out.select("sample_id", "predicted", r6("distance").alias("distance"))


def document_features(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, features, label): length, share of digits and of spaces, of the documents that have a quality label."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    share = lambda pattern: F.regexp_count("text", F.lit(pattern)) / F.greatest(F.char_length("text"), F.lit(1))
    features = F.array(F.log1p(F.col("n_chars").cast("double")), share("[0-9]"), share(" "))
    return docs.join(labels, "doc_id").where("text is not null").select(F.col("doc_id").alias("sample_id"), features.alias("features"), F.col("quality").cast("long").alias("label"))


def cen_documents(spark: SparkSession, d: str) -> DataFrame:
    """Quality of documents by the nearest centroid of scaled features: confusion."""
    v = document_features(spark, d)
    v = prep.min_max_scale(v, prep.min_max_ranges(v))
    out = centroid.predict_centroid(v, centroid.fit_centroids(v)).select(F.col("label").alias("expected"), "predicted")
    dim = spark.createDataFrame([(0, "low"), (1, "high")], "label bigint, class_name string")
    return metrics.confusion(out, dim)


QUERIES = {
    "iw_online_ls": online_ls,
    "iw_online_two_epochs": online_two_epochs,
    "iw_online_reference_mode": online_reference_mode,
    "iw_online_prop": online_prop,
    "iw_online_ratio": online_ratio,
    "iw_plasticity": plasticity,
    "iw_batch_epoch_ls": batch_ls,
    "iw_batch_three_epochs": batch_ls_three,
    "iw_table_three_epochs": table_epochs,
    "iw_batch_epoch_prop": batch_prop,
    "iw_forward": forward_relational,
    "iw_forward_arrow": forward_arrow,
    "iw_predict": predict,
    "iw_learning_curve": curve,
    "iw_memory_bytes": memory,
    "iw_train_evaluate": train_evaluate,
    "cen_fit": cen_fit,
    "cen_predict": cen_predict,
    "cen_documents": cen_documents,
}

_EPS = "2.220446049250313e-16::DOUBLE"


def _refit(inner: str) -> str:
    """Ranges are fitted again on scaled data: 0..1, or nothing for a constant feature."""
    return f"{inner}, r2 AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM sl GROUP BY feature), ps AS (SELECT id, label, feature, CASE WHEN hi - lo <= {_EPS} THEN 0::DOUBLE ELSE least(greatest((x - lo) / (hi - lo), 0), 1) END AS p FROM sl JOIN r2 USING (feature))"


def _dense(count: int) -> str:
    """Per sample the list of coefficients of all (feature, interval), 2 where an interval is active twice."""
    return f"""en AS (SELECT id, label, feature, d AS interval, CASE WHEN p * {count - 1} = d THEN 2::DOUBLE WHEN abs(p * {count - 1} - d) < 1 THEN 1 - abs(p * {count - 1} - d) ELSE 0::DOUBLE END AS a FROM ps, range({count}) t(d)),
ac AS (SELECT id, any_value(label) AS label, list(a ORDER BY feature, interval) AS a FROM en GROUP BY id)"""


def _online_sql(mode: str = "ls", epochs: int = 1, select: str | None = None, freeze: int | None = None) -> str:
    """Folds the samples in their order with a recursive query; a state is the list of weights (and counts) of one output."""
    den = "list_sum(list_transform(a, lambda x: CASE WHEN x = 2 THEN 2::DOUBLE ELSE x * x END))"
    if mode == "prop":
        den = "list_sum(list_transform(a, lambda x: CASE WHEN x = 2 THEN 2 WHEN x > 0 THEN 1 ELSE 0 END))::DOUBLE"
    z = "list_zip(w, a)"
    y = f"list_sum(list_transform({z}, lambda z: z[1] * z[2]))"
    update = f"list_transform({z}, lambda z: z[1] + z[2] * e / den)"
    if mode == "ratio":
        factor = "least(greatest(t / CASE WHEN abs(y) <= 1e-9 THEN 1 ELSE y END, -2), 2)"
        update = f"""CASE WHEN abs(y) <= 1e-9 THEN list_transform({z}, lambda z: z[1] + z[2] * t / den)
      ELSE list_transform({z}, lambda z: CASE WHEN z[2] = 2 THEN z[1] * {factor} * {factor} WHEN z[2] > 0 THEN z[1] * {factor} ELSE z[1] END) END"""
    count = "list_transform(list_zip(c, a), lambda z: z[1] + CASE WHEN z[2] = 2 THEN 2 WHEN z[2] > 0 THEN 1 ELSE 0 END)"
    if freeze is not None:
        half = lambda n: f"CASE WHEN {n} >= {freeze} THEN 0::DOUBLE ELSE 0.5::DOUBLE ** ({n}) END"
        z3 = "list_zip(w, a, c)"
        update = f"""list_transform({z3}, lambda z: z[1] + CASE WHEN z[2] = 2 THEN e / den * ({half("z[3]")} + {half("z[3] + 1")}) WHEN z[2] > 0 THEN z[2] * e / den * {half("z[3]")} ELSE 0 END)"""
    return f"""WITH RECURSIVE {_refit(SCALED_SQL)}, {_dense(D)},
o AS (SELECT id, label, a, {den} AS den, row_number() OVER (ORDER BY {key_sql("id")}, id) AS ord, count(*) OVER () AS n FROM ac),
f(step, output, w, c, y, t) AS (
  SELECT 0::BIGINT, k, list_transform(o.a, lambda x: 0::DOUBLE), list_transform(o.a, lambda x: 0::BIGINT), 0::DOUBLE, 0::DOUBLE FROM o, range({OUTPUTS}) r(k) WHERE ord = 1
  UNION ALL
  SELECT step + 1, output, {update}, {count}, y, t FROM (
    SELECT *, t - y AS e FROM (SELECT f.step, f.output, f.w, f.c, o.a, o.den, {y} AS y, (o.label = f.output)::INT::DOUBLE AS t FROM f JOIN o ON o.ord = f.step % o.n + 1 WHERE f.step < {epochs} * o.n))
)
{select or f"SELECT (i // {D})::BIGINT AS feature, (i % {D})::BIGINT AS interval, output::BIGINT AS output, round(w[i + 1], 5) + 0::DOUBLE AS weight, c[i + 1]::BIGINT AS access_count FROM (SELECT output, w, c, unnest(range(len(w))) AS i FROM f WHERE step = (SELECT max(step) FROM f))"}"""


def _train_evaluate_sql() -> str:
    """The whole run: ranges and intervals come from the training part alone, three epochs in its order, then the test part's classes."""
    of_train = "WHERE id IN (SELECT id FROM tr) GROUP BY feature)"
    split = f"sp AS (SELECT id, row_number() OVER (ORDER BY {key_sql('id')}, id) - 1 < round((SELECT count(*) FROM v) * 0.2::DOUBLE) AS test FROM v), tr AS (SELECT id FROM sp WHERE NOT test)"
    inner = SCALED_SQL.replace(", l AS (", f", {split}, l AS (", 1).replace("FROM l GROUP BY feature)", f"FROM l {of_train}")
    dot = "list_sum(list_transform(list_zip(w, a), lambda z: z[1] * z[2]))"
    return f"""WITH RECURSIVE {_refit(inner).replace("FROM sl GROUP BY feature)", f"FROM sl {of_train}")}, {_dense(8)},
o AS (SELECT id, label, a, list_sum(list_transform(a, lambda x: CASE WHEN x = 2 THEN 2::DOUBLE ELSE x * x END)) AS den, row_number() OVER (ORDER BY {key_sql("id")}, id) AS ord, count(*) OVER () AS n FROM (SELECT ac.* FROM ac JOIN tr USING (id))),
f(step, output, w) AS (
  SELECT 0::BIGINT, k, list_transform(o.a, lambda x: 0::DOUBLE) FROM o, range({OUTPUTS}) r(k) WHERE ord = 1
  UNION ALL
  SELECT step + 1, output, list_transform(list_zip(w, a), lambda z: z[1] + z[2] * e / den) FROM (
    SELECT f.step, f.output, f.w, o.a, o.den, (o.label = f.output)::INT::DOUBLE - {dot} AS e FROM f JOIN o ON o.ord = f.step % o.n + 1 WHERE f.step < 3 * o.n)
), m AS (SELECT output, w FROM f WHERE step = (SELECT max(step) FROM f)),
p AS (SELECT id, any_value(label) AS label, arg_max(output, struct_pack(s := s, o := output)) AS predicted FROM (SELECT ac.id, ac.label, output, {dot} AS s FROM ac, m WHERE ac.id NOT IN (SELECT id FROM tr)) GROUP BY id),
dim AS (SELECT row_number() OVER (ORDER BY n) - 1 AS label, n AS class_name FROM (SELECT DISTINCT format('class-{{:02d}}', label) AS n FROM embeddings))
SELECT dim.label AS class_index, class_name, count_if(predicted = p.label) AS correct, count(p.id) AS total, CASE WHEN count(p.id) > 0 THEN count_if(predicted = p.label) / count(p.id) ELSE 0 END AS accuracy
FROM dim LEFT JOIN p USING (label) GROUP BY ALL"""


def _batch_sql(epochs: int, proportional: bool = False) -> str:
    den = "sum((a > 0)::INT)" if proportional else "sum(a * a)"
    parts = [f"WITH {_refit(SCALED_SQL)}, {_dense(D)}, am AS (SELECT id, label, feature * {D} + interval AS k, a FROM en WHERE a > 0), dn AS (SELECT id, {den}::DOUBLE AS den FROM am GROUP BY id), us AS (SELECT k, count(*) AS usage FROM am GROUP BY k), ks AS (SELECT DISTINCT feature * {D} + interval AS k FROM en)"]
    parts.append(f"w0 AS (SELECT k, o AS output, 0::DOUBLE AS w FROM ks, range({OUTPUTS}) t(o))")
    for e in range(epochs):
        parts.append(f"e{e} AS (SELECT id, output, ((any_value(label) = output)::INT - sum(a * w)) / any_value(den) AS e FROM am JOIN w{e} USING (k) JOIN dn USING (id) GROUP BY id, output)")
        parts.append(f"w{e + 1} AS (SELECT w.k, w.output, w.w + coalesce(c, 0) AS w FROM w{e} w LEFT JOIN (SELECT k, output, sum(a * e) / any_value(usage) AS c FROM am JOIN e{e} USING (id) JOIN us USING (k) GROUP BY k, output) x USING (k, output))")
    return ", ".join(parts) + f" SELECT (k // {D})::BIGINT AS feature, (k % {D})::BIGINT AS interval, output::BIGINT AS output, round(w, 5) + 0::DOUBLE AS weight, coalesce(usage, 0) * {epochs} AS access_count FROM w{epochs} LEFT JOIN us USING (k)"


_FORWARD = f"""WITH {_refit(SCALED_SQL)}, {_dense(4)},
sc AS (SELECT id AS sample_id, o AS output, round(sum(a * ((feature * 7 + interval * 3 + o * 5) % 11 - 5) / 10.0::DOUBLE), 6) AS score FROM en, range({OUTPUTS}) t(o) GROUP BY 1, 2)"""
_DOC = """dc AS (SELECT d.doc_id AS id, l.quality::BIGINT AS label, [ln(1 + n_chars::DOUBLE), len(regexp_extract_all(text, '[0-9]')) / greatest(length(text), 1)::DOUBLE, len(regexp_extract_all(text, ' ')) / greatest(length(text), 1)::DOUBLE] AS f
  FROM documents d JOIN labels l USING (doc_id) WHERE text IS NOT NULL), l AS (SELECT id, label, unnest([0, 1, 2]) AS feature, unnest(f) AS x FROM dc),
g AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM l GROUP BY 1), s AS (SELECT id, label, feature, CASE WHEN hi - lo <= 2.3e-16 THEN 0 ELSE (x - lo) / (hi - lo) END AS x FROM l JOIN g USING (feature))"""
_CURVE = f"""SELECT e + 1 AS epoch, round(avg((t - y) ** 2), 5) AS mse_before, any_value(round(after, 5)) AS mse_after FROM (SELECT *, (step - 1) // n AS e FROM f, (SELECT any_value(n) AS n FROM o) WHERE step > 0)
JOIN (SELECT step // o.n - 1 AS e, avg(((o.label = f.output)::INT - list_sum(list_transform(list_zip(f.w, o.a), lambda z: z[1] * z[2]))) ** 2) AS after FROM f, o WHERE f.step > 0 AND f.step % o.n = 0 GROUP BY 1) USING (e) GROUP BY e"""

SQL = {
    "iw_online_ls": _online_sql(),
    "iw_online_two_epochs": _online_sql(epochs=2),
    "iw_online_reference_mode": _online_sql(),
    "iw_online_prop": _online_sql("prop"),
    "iw_online_ratio": _online_sql("ratio"),
    "iw_plasticity": _online_sql(freeze=6),
    "iw_batch_epoch_ls": _batch_sql(1),
    "iw_batch_three_epochs": _batch_sql(3),
    "iw_table_three_epochs": _batch_sql(3),
    "iw_batch_epoch_prop": _batch_sql(1, True),
    "iw_forward": f"{_FORWARD} SELECT * FROM sc",
    "iw_forward_arrow": f"{_FORWARD} SELECT * FROM sc",
    "iw_predict": f"{_FORWARD} SELECT sample_id, arg_max(output, score * 1000 + output * 1e-7)::BIGINT AS predicted FROM sc GROUP BY 1",
    "iw_learning_curve": _online_sql(epochs=2, select=_CURVE),
    "iw_memory_bytes": f"SELECT (12 * max(len(embedding)) * {D} * {OUTPUTS})::BIGINT AS memory_bytes FROM embeddings",
    "cen_fit": f"WITH {V_SQL}, l AS (SELECT label, unnest(range(len(f)))::BIGINT AS feature, unnest(f) AS x FROM v) SELECT label, feature, count(*) AS n, round(avg(x), 6) AS mean FROM l GROUP BY 1, 2",
    "cen_predict": f"""WITH {V_SQL}, l AS (SELECT id, label, unnest(range(len(f)))::BIGINT AS feature, unnest(f) AS x FROM v), c AS (SELECT label, feature, avg(x) AS m FROM l GROUP BY 1, 2),
d AS (SELECT l.id, c.label, sum((x - m) * (x - m)) AS distance FROM l JOIN c USING (feature) GROUP BY 1, 2)
SELECT id AS sample_id, label AS predicted, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, label) AS r FROM d) WHERE r = 1""",
    "cen_documents": f"""WITH {_DOC}, c AS (SELECT label, feature, avg(x) AS m FROM s GROUP BY 1, 2), d AS (SELECT s.id, any_value(s.label) AS expected, c.label AS predicted, sum((x - m) ** 2) AS q FROM s JOIN c USING (feature) GROUP BY s.id, c.label),
p AS (SELECT expected, predicted FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY q, predicted) AS r FROM d) WHERE r = 1)
SELECT a AS actual_index, b AS predicted_index, count(expected) AS n FROM range(2) x(a), range(2) y(b) LEFT JOIN p ON expected = a AND predicted = b GROUP BY 1, 2""",
}
SQL["iw_train_evaluate"] = _train_evaluate_sql()
