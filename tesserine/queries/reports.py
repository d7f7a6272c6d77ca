"""Queries on reports, failure analysis, patch scans, experiment grids, search, boxes, images and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anomaly, boxes, failures, images, metrics, prep
from ..operators.library import top_k_bits, vote
from ..plans import matrix, search
from ..plans.population import Population
from ..sources import sinks
from ..sources.vectors import JITTER, synthetic_lines, synthetic_points, uniform_sql
from ..streaming.scoring import window_rates
from .base import (
    PREDICTIONS_SQL,
    ROLES_SQL,
    SEED,
    V_SQL,
    as_queries,
    as_refs,
    classes,
    key_sql,
    predictions,
    r6,
    scan_results,
    scan_roles,
    scan_scores,
    table,
    vectors,
)

#: Lines repeat their numbers, so part and supplier are part of an id.
LINE_ID = "((l_orderkey * 100 + l_linenumber) * 100000 + l_partkey % 100000) * 1000 + l_suppkey % 1000"
DETECTION_ID = "(l_linenumber * 100000 + l_partkey % 100000) * 1000 + l_suppkey % 1000"

# --- predictions ------------------------------------------------------------------------------------


def accuracy(spark: SparkSession, d: str) -> DataFrame:
    return metrics.accuracy(predictions(spark, d)).withColumn("accuracy", r6("accuracy"))


def per_class(spark: SparkSession, d: str) -> DataFrame:
    return metrics.per_class_accuracy(predictions(spark, d), classes(spark, d)).withColumn("accuracy", r6("accuracy"))


def confusion(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(predictions(spark, d), classes(spark, d))


def worst(spark: SparkSession, d: str) -> DataFrame:
    return metrics.worst_class(metrics.per_class_accuracy(predictions(spark, d), classes(spark, d))).withColumn("accuracy", r6("accuracy"))


def common_confusion(spark: SparkSession, d: str) -> DataFrame:
    return metrics.most_common_confusion(metrics.confusion(predictions(spark, d), classes(spark, d)))


def common_confusion_last(spark: SparkSession, d: str) -> DataFrame:
    return metrics.most_common_confusion(metrics.confusion(predictions(spark, d), classes(spark, d)), last=True)


def misclassified(spark: SparkSession, d: str) -> DataFrame:
    return metrics.misclassified(predictions(spark, d)).select("sample_id", "expected", "predicted", "score_margin")


def confidence(spark: SparkSession, d: str) -> DataFrame:
    return failures.confidence_summary(predictions(spark, d))


def ranked(confident: bool):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return failures.ranked_wrong(predictions(spark, d), confident).select("sample_id", "expected", "predicted", "score_margin")

    return query


def buckets(spark: SparkSession, d: str) -> DataFrame:
    """Wrong predictions by the brightness and contrast that vectors would have as images."""
    v = vectors(spark, d)
    mean = F.aggregate("features", F.lit(0.0), lambda a, x: a + x) / F.size("features")
    square = F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x) / F.size("features")
    stats = v.select("sample_id", (mean + 0.5).alias("brightness"), F.sqrt(square - mean * mean).alias("contrast"))
    rows = predictions(spark, d).join(stats, "sample_id")
    out = failures.bucket_summaries(rows, {"brightness": failures.brightness_bucket(F.col("brightness")), "contrast": failures.contrast_bucket(F.col("contrast"))})
    return out.withColumn("wrong_rate", r6("wrong_rate"))


def selected(mode: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return failures.select_samples(predictions(spark, d), mode, 20)

    return query


# --- patch scan -------------------------------------------------------------------------------------


def positions(spark: SparkSession, d: str) -> DataFrame:
    """Patch grids of images as large as parts are."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("image_id"), (F.col("p_size") * 5).cast("long").alias("width"), F.col("p_size").cast("long").alias("height"))
    return anomaly.patch_grid(p, 48, 20)


def cap(spark: SparkSession, d: str) -> DataFrame:
    refs = vectors(spark, d).select(F.col("sample_id").alias("ref_id"))
    return anomaly.cap_references(refs, 130)


def patch_scores(spark: SparkSession, d: str) -> DataFrame:
    return scan_scores(spark, d).select("patch_id", "image_id", "role", r6("anomaly_score").alias("anomaly_score"))


def image_scores(spark: SparkSession, d: str) -> DataFrame:
    out = anomaly.image_scores(scan_scores(spark, d), 0.5)
    return out.select("image_id", r6("score").alias("score"), r6("max_patch_score").alias("max_patch_score"), "patch_count")


def threshold(spark: SparkSession, d: str) -> DataFrame:
    scores = anomaly.image_scores(scan_scores(spark, d).where("role = 'cal'"), 0.5)
    return anomaly.calibrate(scores, 0.9).select(r6("threshold").alias("threshold"))


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    return scan_results(spark, d).select("image_id", "expected", "predicted", r6("score").alias("score"))


def class_accuracy(spark: SparkSession, d: str) -> DataFrame:
    out = anomaly.class_accuracy(scan_results(spark, d))
    return out.select(*(r6(c).alias(c) for c in out.columns))


def auroc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.auroc(scan_results(spark, d).withColumn("score", F.round("score", 3))).select(r6("auroc").alias("auroc"))


def auroc_events(spark: SparkSession, d: str) -> DataFrame:
    """How well an event's value, cut to cents, tells purchases from others."""
    e = table(spark, d, "events").where("value is not null").select(F.round("value", 2).alias("score"), (F.col("event_type") == "purchase").alias("expected"))
    return metrics.auroc(e).select(r6("auroc").alias("auroc"))


def f1(spark: SparkSession, d: str) -> DataFrame:
    rows = scan_results(spark, d)
    return rows.agg(*(r6(v).alias(k) for k, v in metrics.f1_columns(F.col("predicted"), F.col("expected")).items()))


def rectangles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(patches, runs of the truth) of 32 x 32 images, one for each supplier: patches from its parts, truth a rectangle by its key."""
    line = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("image_id"), "l_partkey", F.expr(LINE_ID).alias("patch_id"), "l_discount")
    at = lambda m: (F.col("l_partkey") * m % 28).cast("long")
    patches = line.select("patch_id", "image_id", at(7).alias("x"), at(11).alias("y"), F.lit(4).cast("long").alias("w"), F.lit(4).cast("long").alias("h"), (F.col("l_discount") * 10).alias("anomaly_score"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("image_id"))
    x0, y0 = F.col("image_id") % 16, F.col("image_id") % 13
    return patches, s.select("image_id", F.explode(F.sequence(y0, y0 + 9)).alias("y"), x0.alias("x0"), (x0 + 12).alias("x1"))


def mask_iou(spark: SparkSession, d: str) -> DataFrame:
    patches, truth = rectangles(spark, d)
    hit = anomaly.predicted_rectangles(patches, 0.9, 32, 32).where("predicted")
    return anomaly.mask_iou(hit, truth).select("image_id", r6("iou").alias("iou"))


def predicted_area(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of the union of predicted patches, and of the part of it in each quarter of the image, from strips."""
    strips = anomaly.predicted_mask(rectangles(spark, d)[0], 0.9, 32, 32)
    part = lambda a, b: F.greatest(F.least("x1", F.lit(b)) - F.greatest("x0", F.lit(a)), F.lit(0)) * (F.col("y1") - F.col("y0"))
    return strips.groupBy("image_id").agg(F.sum(part(0, 32)).alias("pixels"), F.sum(part(0, 16)).alias("left_pixels"))


def patch_overlap(spark: SparkSession, d: str) -> DataFrame:
    patches, truth = rectangles(spark, d)
    return anomaly.overlap_ratio(patches, truth).select("patch_id", r6("mask_overlap_ratio").alias("mask_overlap_ratio"), "mask_positive")


# --- grids and search -------------------------------------------------------------------------------


def runs(spark: SparkSession, d: str) -> DataFrame:
    """A grid of settings with the results that k and threshold of binary libraries give."""
    cells = matrix.grid(spark, interval_count=[1, 3], image_size=[8, 16], seed=[1, 2, 3])
    v = vectors(spark, d)
    found = top_k_bits(as_queries(v), as_refs(v), 3, 0.0, exclude_self=True).select("query_id", "rank", "label", "score")
    rows = None
    for k in (1, 3):
        told = vote(found.where(F.col("rank") <= k), "asc").join(v.select(F.col("sample_id").alias("query_id"), "label"), "query_id").withColumn("k", F.lit(k))
        rows = told if rows is None else rows.union(told)
    by = rows.select("k", "label", (F.col("predicted") == F.col("label")).cast("long").alias("right"), F.col("query_id"))
    part = by.withColumn("seed", F.col("query_id") % 3 + 1).groupBy("k", "seed", F.col("label").alias("class_index")).agg(F.sum("right").alias("correct"), F.count(F.lit(1)).alias("total"))
    joined = cells.join(part, (cells["interval_count"] == part["k"]) & (cells["seed"] == part["seed"])).drop(part["seed"], "k")
    return joined.withColumns({"model": F.lit("binary"), "image_features": F.lit("vector"), "image_resize": F.lit("none"), "correction_mode": F.lit("none")})


def results(spark: SparkSession, d: str) -> DataFrame:
    share = F.col("correct") / F.col("total")
    rows = runs(spark, d).groupBy(*matrix.KEYS, "seed").agg(
        F.round(F.sum("correct") / F.sum("total"), 6).alias("test_accuracy"),
        F.round(F.max(share), 6).alias("train_accuracy"),
        F.collect_list(F.struct("class_index", F.format_string("class-%02d", "class_index").alias("class_name"), "correct", "total", share.alias("accuracy"))).alias("per_class"),
    )
    return matrix.row_columns(rows)


def mx_grid(spark: SparkSession, d: str) -> DataFrame:
    return matrix.grid(spark, model=["binary", "dense"], image_size=[8, 16, 32], seed=[1, 2])


def mx_summary(spark: SparkSession, d: str) -> DataFrame:
    s = matrix.summarize(results(spark, d))
    return s.select(*(r6(c).alias(c) if c.endswith(("accuracy", "gap")) else F.col(c) for c in s.columns))


def mx_pooled(spark: SparkSession, d: str) -> DataFrame:
    p = matrix.pooled_classes(runs(spark, d), ["image_size", "interval_count"])
    return p.withColumn("accuracy", r6("accuracy"))


def mx_top(spark: SparkSession, d: str) -> DataFrame:
    rows = matrix.top_rows(results(spark, d), 5)
    return rows.select("interval_count", "image_size", "seed", r6("test_accuracy").alias("test_accuracy"), r6("overfit_gap").alias("overfit_gap"), "worst_class_name", r6("worst_class_accuracy").alias("worst_class_accuracy"))


def halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(queries with expected, refs) of a 30 % split."""
    v = prep.train_test_split(vectors(spark, d), 0.3, SEED)
    test, train = v.where("split = 'test'"), v.where("split = 'train'")
    return test.select(F.col("sample_id").alias("query_id"), F.col("features").alias("vector"), F.col("label").alias("expected")), as_refs(train)


#: Fixed recipes, so that one generation's fitness can be held against SQL; some share thresholds or masks.
GENOMES = [
    {"variant": 0, "top_k": k, "threshold": t, "jaccard_weight": w, "blocks": m}
    for t, masks in ((0.0, (0xFFFF, 0x00FF)), (0.05, (0x7E57,)), (-0.05, (0x00FF, 0x8001, 0xFFFF)))
    for m in masks
    for k, w in ((1, 0.0), (3, 1.0), (5, 0.5))
]


def ga_fitness(spark: SparkSession, d: str) -> DataFrame:
    found = search.evaluate_libraries(GENOMES, [halves(spark, d)])
    return spark.createDataFrame([(i, f) for i, f in enumerate(found)], "genome bigint, fitness double").withColumn("fitness", r6("fitness"))


def ga_run(spark: SparkSession, d: str) -> DataFrame:
    """A seeded search of 32 genomes over 20 generations; its history."""
    space = search.Space({"variant": (0,), "top_k": (1, 3)}, {"threshold": (-0.2, 0.2, 0.05), "jaccard_weight": (0.0, 1.0, 0.25)}, True)
    scored = Population([halves(spark, d)])
    try:
        _, history = search.search(space, search.SearchConfig(32, 20), lambda g: search.evaluate_libraries(g, scored), lambda g: (g["variant"], g["top_k"]))
    finally:
        scored.close()
    return spark.createDataFrame([(h["generation"], h["best_fitness"], h["top_k"], h["threshold"], h["jaccard_weight"], h["blocks"]) for h in history], "generation bigint, best_fitness double, top_k bigint, threshold double, jaccard_weight double, blocks bigint")


# --- boxes ------------------------------------------------------------------------------------------


def detections(spark: SparkSession, d: str) -> DataFrame:
    """Boxes from lineitem: an order is an image of 640 x 480, a line a detection."""
    t = table(spark, d, "lineitem")
    x, y = F.col("l_partkey") * 13 % 600, F.col("l_suppkey") * 7 % 440
    box = F.array(x.cast("double"), y.cast("double"), (x + F.col("l_quantity") * 2).cast("double"), (y + F.col("l_quantity")).cast("double"))
    return t.select(F.col("l_orderkey").alias("image_id"), F.expr(DETECTION_ID).alias("detection_id"), F.col("l_returnflag").alias("label"), (F.col("l_discount") * 10).alias("score"), box.alias("box"))


def coordinates(column: str):
    return [F.col(column)[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]


def square_expand(spark: SparkSession, d: str) -> DataFrame:
    rows = detections(spark, d).withColumn("crop", boxes.round_box(boxes.expanded_square(F.col("box"), F.lit(640.0), F.lit(480.0), 0.1)))
    return rows.select("image_id", "detection_id", *coordinates("crop"))


def box_rank(selection: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = boxes.select_detections(detections(spark, d), selection, 2, ["a", "n"])
        return rows.select("image_id", "detection_id", "label", "place", r6("area").alias("area"))

    return query


def box_map(spark: SparkSession, d: str) -> DataFrame:
    rows = detections(spark, d).withColumn("crop", boxes.expanded_square(F.col("box"), F.lit(640.0), F.lit(480.0), 0.1))
    rows = rows.withColumn("inner", boxes.box_in_crop(F.col("box"), F.col("crop"), F.lit(100), F.lit(80)))
    return rows.select("image_id", "detection_id", *coordinates("inner"))


# --- images, generators, streams ----------------------------------------------------------------------


def points(spark: SparkSession, d: str) -> DataFrame:
    rows, dim = synthetic_points(spark)
    return rows.join(dim, "label").select("sample_id", "label", "class_name", *(r6(F.col("features")[i]).alias(c) for i, c in enumerate("xy")))


def line_images(spark: SparkSession, d: str) -> DataFrame:
    rows, dim = synthetic_lines(spark)
    long = rows.join(dim, "label").select("sample_id", "class_name", F.posexplode("features").alias("i", "value"))
    return long.select("sample_id", "class_name", F.col("i").cast("long").alias("i"), r6("value").alias("value"))


def formatted(spark: SparkSession, d: str) -> DataFrame:
    """The reports' flat texts, from counts of orders by priority and status."""
    t = table(spark, d, "orders")
    per = t.groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("correct"), F.count(F.lit(1)).alias("total"))
    per = per.select(F.struct(F.col("o_orderpriority").alias("class_name"), (F.col("correct") / F.col("total")).alias("accuracy"), "correct", "total").alias("s"))
    counts = t.groupBy("o_orderpriority").agg(*(F.count_if(F.col("o_orderstatus") == x).alias(x) for x in "FOP"))
    rows = counts.select(F.struct(F.col("o_orderpriority").alias("actual_name"), F.array("F", "O", "P").alias("predicted_counts")).alias("c"))
    scores = t.groupBy("o_orderpriority").agg(F.round(F.avg(F.col("o_orderkey") % 100), 3).alias("score"))
    scores = scores.select(F.struct(F.col("o_orderpriority").alias("class_name"), "score").alias("p"))
    gathered = lambda df, c: df.agg(F.array_sort(F.collect_list(c)).alias(c))
    one = gathered(per, "s").crossJoin(gathered(rows, "c")).crossJoin(gathered(scores, "p"))  # three rows of one each
    return one.select(sinks.format_per_class("s").alias("per_class"), sinks.format_confusion("c").alias("confusion"), sinks.format_scores("p").alias("scores"))


def stream_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of errors by hour and type of event, over the events as a stream."""
    events = table(spark, d, "events")
    source = spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet*")
    rates = window_rates(source.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type = 'error'", "1 hour", "1 day")
    name = f"rates_{uuid.uuid4().hex}"
    query = rates.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    try:
        query.awaitTermination(600)
    finally:
        query.stop()
    return spark.table(name).select(F.date_format("window.start", "yyyy-MM-dd HH").alias("start"), "n", "hits", r6("rate").alias("rate"))


QUERIES = {
    "cls_accuracy": accuracy,
    "cls_per_class": per_class,
    "cls_confusion": confusion,
    "cls_worst_class": worst,
    "cls_top_confusion": common_confusion,
    "cls_top_confusion_last": common_confusion_last,
    "cls_misclassified": misclassified,
    "fa_confidence": confidence,
    "fa_ranked_confident": ranked(True),
    "fa_ranked_ambiguous": ranked(False),
    "fa_buckets": buckets,
    "fa_selected_misclassified": selected("misclassified"),
    "fa_selected_correct": selected("correct"),
    "scan_positions": positions,
    "scan_cap": cap,
    "scan_patch_scores": patch_scores,
    "scan_image_scores": image_scores,
    "scan_threshold": threshold,
    "scan_verdicts": verdicts,
    "scan_class_accuracy": class_accuracy,
    "scan_auroc": auroc,
    "scan_auroc_events": auroc_events,
    "scan_f1": f1,
    "scan_mask_iou": mask_iou,
    "scan_predicted_area": predicted_area,
    "scan_patch_overlap": patch_overlap,
    "mx_grid": mx_grid,
    "mx_summary": mx_summary,
    "mx_pooled": mx_pooled,
    "mx_top_rows": mx_top,
    "ga_population_fitness": ga_fitness,
    "ga_run": ga_run,
    "box_square_expand": square_expand,
    "box_rank_best": box_rank("best"),
    "box_rank_largest": box_rank("largest"),
    "box_rank_all": box_rank("all"),
    "box_map": box_map,
    "src_synthetic_points": points,
    "src_synthetic_lines": line_images,
    "rep_formatted": formatted,
    "stream_window_rates": stream_rates,
}

# --- SQL --------------------------------------------------------------------------------------------

_P = f"WITH {PREDICTIONS_SQL}"
_PER = "pc AS (SELECT d.label AS class_index, class_name, count_if(correct) AS correct, count(expected) AS total, CASE WHEN count(expected) = 0 THEN 0::DOUBLE ELSE count_if(correct) / count(expected) END AS accuracy FROM dim d LEFT JOIN pr ON expected = d.label GROUP BY 1, 2)"
_CF = "cf AS (SELECT a.label AS actual_index, b.label AS predicted_index, count(expected) AS n FROM dim a CROSS JOIN dim b LEFT JOIN pr ON expected = a.label AND predicted = b.label GROUP BY 1, 2)"
_W = f"WITH {ROLES_SQL}"
_RECT = f"""pa AS (SELECT {LINE_ID} AS patch_id, l_suppkey AS image_id, l_partkey * 7 % 28 AS x, l_partkey * 11 % 28 AS y, l_discount * 10 AS s FROM lineitem),
tr AS (SELECT s_suppkey AS image_id, s_suppkey % 16 + a AS px, s_suppkey % 13 + b AS py FROM supplier, range(12) t(a), range(10) u(b))"""
_BOX = f"""de AS (SELECT l_orderkey AS image_id, {DETECTION_ID} AS detection_id, l_returnflag AS label, l_discount * 10 AS score, (l_partkey * 13 % 600)::DOUBLE AS x1, (l_suppkey * 7 % 440)::DOUBLE AS y1,
  l_partkey * 13 % 600 + l_quantity * 2 AS x2, l_suppkey * 7 % 440 + l_quantity AS y2 FROM lineitem),
c0 AS (SELECT *, greatest(1, x2 - x1, y2 - y1) * 1.2::DOUBLE AS side, (x1 + x2) / 2 AS mx, (y1 + y2) / 2 AS my FROM de),
c1 AS (SELECT *, greatest(mx - side / 2, 0) AS ax, CASE WHEN mx - side / 2 < 0 THEN side ELSE mx + side / 2 END AS bx, greatest(my - side / 2, 0) AS ay, CASE WHEN my - side / 2 < 0 THEN side ELSE my + side / 2 END AS by_ FROM c0),
c2 AS (SELECT image_id, detection_id, x1 AS ox1, y1 AS oy1, x2 AS ox2, y2 AS oy2, greatest(0, ax - greatest(bx - 640, 0)) AS x1, greatest(0, ay - greatest(by_ - 480, 0)) AS y1, least(640, bx) AS x2, least(480, by_) AS y2 FROM c1)"""


def _rank_sql(keys: str) -> str:
    return f"""WITH {_BOX}, a AS (SELECT *, greatest(x2 - x1, 0) * greatest(y2 - y1, 0) AS area FROM de WHERE lower(label) IN ('a', 'n')),
r AS (SELECT image_id, detection_id, lower(label) AS label, area, row_number() OVER (PARTITION BY image_id ORDER BY {keys}, detection_id) AS place FROM a) SELECT image_id, detection_id, label, place, round(area, 6) AS area FROM r WHERE place <= 2"""


def _genome_sql(i: int, g: dict) -> str:
    chosen = [x + 1 for b in range(16) if g["blocks"] >> b & 1 for x in range(4 * b, 4 * b + 4)]
    w = g["jaccard_weight"]
    return f"""SELECT {i}::BIGINT AS genome, round(avg((label = expected)::INT::DOUBLE), 6) AS fitness FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, c DESC, label) AS r FROM (
  SELECT query_id, any_value(expected) AS expected, label, list_sum(list(score ORDER BY rank)) AS s, count(*) AS c FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label, ref_id) AS rank FROM (
    SELECT query_id, expected, ref_id, label, (1 - (either - shared) / {len(chosen)}) * {1 - w}::DOUBLE + CASE WHEN either = 0 THEN 1 ELSE shared / either END * {w}::DOUBLE AS score FROM (
      SELECT a.id AS query_id, a.label AS expected, b.id AS ref_id, b.label AS label,
        list_sum(list_transform({chosen}, lambda i: (a.f[i] >= {g["threshold"]} AND b.f[i] >= {g["threshold"]})::INT))::DOUBLE AS shared, list_sum(list_transform({chosen}, lambda i: (a.f[i] >= {g["threshold"]} OR b.f[i] >= {g["threshold"]})::INT))::DOUBLE AS either
      FROM sp a JOIN sp b ON a.test AND NOT b.test))) WHERE rank <= {g["top_k"]} GROUP BY query_id, label)) WHERE r = 1"""


_RUNS = """bt AS (SELECT id, label, list_transform(f, lambda x: x >= 0) AS b FROM v), pp AS (SELECT a.id AS query_id, a.label AS own, b.id AS ref_id, b.label AS label, list_sum(list_transform(list_zip(a.b, b.b), lambda z: (z[1] = z[2])::INT)) AS same FROM bt a JOIN bt b ON a.id <> b.id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY same DESC, label, ref_id) AS rank FROM pp),
vt AS (SELECT k, query_id, own, label FROM (SELECT *, row_number() OVER (PARTITION BY k, query_id ORDER BY s DESC, c DESC, label) AS r FROM (SELECT k, query_id, any_value(own) AS own, label, sum(same) AS s, count(*) AS c FROM rk, (VALUES (1::BIGINT), (3)) t(k) WHERE rank <= k GROUP BY k, query_id, label)) WHERE r = 1),
ru AS (SELECT k AS interval_count, size AS image_size, query_id % 3 + 1 AS seed, own AS class_index, sum((own = label)::INT)::BIGINT AS correct, count(*) AS total FROM vt, (VALUES (8::BIGINT), (16)) t(size) GROUP BY 1, 2, 3, 4)"""
_RES = f"""WITH {V_SQL}, {_RUNS}, re AS (SELECT interval_count, image_size, seed, round(sum(correct) / sum(total), 6) AS test_accuracy, round(max(correct / total), 6) AS train_accuracy,
  min_by(format('class-{{:02d}}', class_index), correct / total * 1000 + class_index * 1e-6) AS worst_class_name, min(correct / total) AS worst_class_accuracy FROM ru GROUP BY 1, 2, 3)"""

_LINES = f"""WITH s AS (SELECT id, id // 12 AS label FROM range(36) t(id)), c AS (
  SELECT *, 6 + floor({uniform_sql(123, "id", str(JITTER + 1))} * 3)::INT - 1 AS cx, 6 + floor({uniform_sql(123, "id", str(JITTER + 2))} * 3)::INT - 1 AS cy FROM s
), p AS (SELECT *, i % 12 AS x, i // 12 AS y, {uniform_sql(123, "id", "i")} AS draw FROM c, range(144) r(i))
SELECT id AS sample_id, CASE label WHEN 0 THEN 'vertical' WHEN 1 THEN 'horizontal' ELSE 'diagonal' END AS class_name, i,
  round(CASE WHEN CASE label WHEN 0 THEN abs(x - cx) <= 1 WHEN 1 THEN abs(y - cy) <= 1 ELSE abs(x - y) <= 1 OR abs(x - greatest(11 - y, 0)) <= 1 END THEN 0.85 + draw * 0.15 ELSE draw * 0.12 END, 6) AS value FROM p"""
_POINTS = f"""SELECT id AS sample_id, label, ['a', 'b', 'c'][label + 1] AS class_name,
  round(least(greatest([0.15, 0.85, 0.5][label + 1]::DOUBLE + {uniform_sql(42, "id", "0")} * 0.1::DOUBLE - 0.05::DOUBLE, 0), 1), 6) AS x,
  round(least(greatest([0.15, 0.2, 0.85][label + 1]::DOUBLE + {uniform_sql(42, "id", "1")} * 0.1::DOUBLE - 0.05::DOUBLE, 0), 1), 6) AS y FROM (SELECT id, id // 80 AS label FROM range(240) t(id))"""
_FORMATTED = """WITH p AS (SELECT o_orderpriority AS n, count_if(o_orderstatus = 'F') AS c, count(*) AS t, count_if(o_orderstatus = 'O') AS o, count_if(o_orderstatus = 'P') AS p, round(avg(o_orderkey % 100), 3) AS s FROM orders GROUP BY 1)
SELECT string_agg(format('{}={:.6f}({}/{})', n, c / t, c, t), ';' ORDER BY n) AS per_class, string_agg(format('{}=[{}|{}|{}]', n, c, o, p), ';' ORDER BY n) AS confusion, string_agg(format('{}={:.6f}', n, s), ';' ORDER BY n) AS scores FROM p"""

SQL = {
    "src_synthetic_points": _POINTS,
    "src_synthetic_lines": _LINES,
    "rep_formatted": _FORMATTED,
    "cls_accuracy": f"{_P} SELECT count_if(correct) AS correct, count(*) AS total, round(avg(correct::INT), 6) AS accuracy FROM pr",
    "cls_per_class": f"{_P}, {_PER} SELECT class_index, class_name, correct, total, round(accuracy, 6) AS accuracy FROM pc",
    "cls_confusion": f"{_P}, {_CF} SELECT * FROM cf",
    "cls_worst_class": f"{_P}, {_PER} SELECT class_index, class_name, correct, total, round(accuracy, 6) AS accuracy FROM pc WHERE total > 0 ORDER BY pc.accuracy, class_index LIMIT 1",
    "cls_top_confusion": f"{_P}, {_CF} SELECT * FROM cf WHERE actual_index <> predicted_index AND n > 0 ORDER BY n DESC, actual_index, predicted_index LIMIT 1",
    "cls_top_confusion_last": f"{_P}, {_CF} SELECT * FROM cf WHERE actual_index <> predicted_index ORDER BY n DESC, actual_index DESC, predicted_index DESC LIMIT 1",
    "cls_misclassified": f"{_P} SELECT sample_id, expected, predicted, score_margin FROM pr WHERE NOT correct ORDER BY sample_id LIMIT 25",
    "fa_confidence": f"{_P} SELECT count_if(NOT correct) AS wrong_total, count_if(NOT correct AND score_margin >= 0.5) AS high_confidence_wrong, count_if(NOT correct AND score_margin <= 0.1) AS ambiguous_wrong FROM pr",
    "fa_ranked_confident": f"{_P} SELECT sample_id, expected, predicted, score_margin FROM pr WHERE NOT correct ORDER BY score_margin DESC, sample_id LIMIT 24",
    "fa_ranked_ambiguous": f"{_P} SELECT sample_id, expected, predicted, score_margin FROM pr WHERE NOT correct ORDER BY score_margin, sample_id LIMIT 24",
    "fa_buckets": f"""{_P}, st AS (SELECT id AS sample_id, list_sum(f) / len(f) + 0.5 AS b, sqrt(list_sum(list_transform(f, lambda x: x * x)) / len(f) - (list_sum(f) / len(f)) ** 2) AS c FROM v),
lo AS (SELECT correct, unnest(['brightness', 'contrast']) AS bucket_group, unnest([CASE WHEN b < 0.33 THEN 'dark' WHEN b > 0.66 THEN 'bright' ELSE 'medium' END, CASE WHEN c < 0.12 THEN 'low' WHEN c > 0.28 THEN 'high' ELSE 'medium' END]) AS bucket FROM pr JOIN st USING (sample_id))
SELECT bucket_group, bucket, count(*) AS total, count_if(NOT correct) AS wrong, round(count_if(NOT correct) / count(*), 6) AS wrong_rate FROM lo GROUP BY 1, 2""",
    "fa_selected_misclassified": f"""{_P}, w AS (SELECT * FROM pr WHERE NOT correct), h AS (SELECT sample_id, row_number() OVER (ORDER BY score_margin DESC, sample_id) AS p FROM w), a AS (SELECT sample_id, row_number() OVER (ORDER BY score_margin, sample_id) AS p FROM w),
u AS (SELECT sample_id, p FROM h WHERE p <= 10 UNION ALL SELECT sample_id, p + 20 FROM a WHERE p <= 10 UNION ALL SELECT sample_id, row_number() OVER (ORDER BY sample_id) + 40 FROM w), o AS (SELECT sample_id, min(p) AS p FROM u GROUP BY 1)
SELECT sample_id, row_number() OVER (ORDER BY p) AS place FROM o ORDER BY p LIMIT 20""",
    "fa_selected_correct": f"{_P} SELECT sample_id, row_number() OVER (ORDER BY sample_id) AS place FROM pr WHERE correct ORDER BY sample_id LIMIT 20",
    "scan_positions": """WITH p AS (SELECT p_partkey AS image_id, (p_size * 5)::BIGINT AS width, p_size::BIGINT AS height FROM part),
x AS (SELECT image_id, width, height, unnest(CASE WHEN width <= 48 THEN [0] ELSE list_distinct(list_append(range(0, width - 48, 20), width - 48)) END) AS x FROM p),
y AS (SELECT *, unnest(CASE WHEN height <= 48 THEN [0] ELSE list_distinct(list_append(range(0, height - 48, 20), height - 48)) END) AS y FROM x)
SELECT image_id, x, y, least(48, width - x) AS w, least(48, height - y) AS h FROM y""",
    "scan_cap": """WITH r AS (SELECT vec_id AS ref_id, row_number() OVER (ORDER BY vec_id) - 1 AS n, count(*) OVER () AS c FROM embeddings), k AS (SELECT floor(i * (c / 130::DOUBLE))::BIGINT AS n FROM range(130) t(i), (SELECT any_value(c) AS c FROM r))
SELECT DISTINCT ref_id FROM r JOIN k USING (n)""",
    "scan_patch_scores": f"{_W} SELECT patch_id, image_id, role, round(anomaly_score, 6) AS anomaly_score FROM ps",
    "scan_image_scores": f"{_W} SELECT image_id, round(score, 6) AS score, round(max_patch_score, 6) AS max_patch_score, patch_count FROM isc",
    "scan_threshold": f"{_W} SELECT round(threshold, 6) AS threshold FROM th",
    "scan_verdicts": f"{_W} SELECT image_id, expected, predicted, round(score, 6) AS score FROM ve",
    "scan_class_accuracy": f"{_W} SELECT round(avg((predicted = expected)::INT), 6) AS accuracy, round(avg((predicted = expected)::INT) FILTER (NOT expected), 6) AS normal_accuracy, round(avg((predicted = expected)::INT) FILTER (expected), 6) AS anomaly_recall FROM ve",
    "scan_auroc": f"{_W}, s AS (SELECT expected, round(score, 3) AS score FROM ve) SELECT coalesce(round(avg(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END), 6), 0)::DOUBLE AS auroc FROM s a JOIN s b ON a.expected AND NOT b.expected",
    "scan_auroc_events": """WITH s AS (SELECT round(value, 2) AS score, event_type = 'purchase' AS e FROM events WHERE value IS NOT NULL), c AS (SELECT score, count_if(e) AS p, count_if(NOT e) AS n FROM s GROUP BY 1),
r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c) SELECT round(sum(p * (b + n / 2))::DOUBLE / (sum(p) * sum(n))::DOUBLE, 6) AS auroc FROM r""",
    "scan_f1": f"""{_W}, c AS (SELECT count_if(predicted AND expected)::DOUBLE AS h, count_if(predicted)::DOUBLE AS s, count_if(expected)::DOUBLE AS t FROM ve),
q AS (SELECT CASE WHEN s = 0 THEN 0::DOUBLE ELSE h / s END AS p, CASE WHEN t = 0 THEN 0::DOUBLE ELSE h / t END AS r FROM c) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r <= 2.3e-16 THEN 0 ELSE 2 * p * r / (p + r) END, 6)::DOUBLE AS f1 FROM q""",
    "scan_mask_iou": f"""WITH {_RECT}, pp AS (SELECT DISTINCT image_id, x + a AS px, y + b AS py FROM pa, range(4) t(a), range(4) u(b) WHERE s >= 0.9)
SELECT coalesce(tr.image_id, pp.image_id) AS image_id, round(count_if(tr.image_id IS NOT NULL AND pp.image_id IS NOT NULL) / count(*), 6) AS iou FROM tr FULL JOIN pp ON tr.image_id = pp.image_id AND tr.px = pp.px AND tr.py = pp.py GROUP BY 1""",
    "scan_predicted_area": f"""WITH {_RECT}, pp AS (SELECT DISTINCT image_id, x + a AS px, y + b AS py FROM pa, range(4) t(a), range(4) u(b) WHERE s >= 0.9)
SELECT image_id, count(*) AS pixels, count_if(px < 16) AS left_pixels FROM pp GROUP BY 1""",
    "scan_patch_overlap": f"""WITH {_RECT}, o AS (SELECT patch_id, greatest(0, least(x + 4, image_id % 16 + 12) - greatest(x, image_id % 16)) * greatest(0, least(y + 4, image_id % 13 + 10) - greatest(y, image_id % 13)) AS n FROM pa)
SELECT patch_id, round(n / 16, 6) AS mask_overlap_ratio, n > 0 AS mask_positive FROM o""",
    "mx_grid": "SELECT m AS model, s AS image_size, r AS seed FROM (VALUES ('binary'), ('dense')) a(m), (VALUES (8::BIGINT), (16), (32)) b(s), (VALUES (1::BIGINT), (2)) c(r)",
    "mx_summary": f"""{_RES} SELECT 'binary' AS model, 'vector' AS image_features, 'none' AS image_resize, 'none' AS correction_mode, image_size, interval_count, count(*) AS runs, round(avg(test_accuracy), 6) AS mean_test_accuracy, round(min(test_accuracy), 6) AS min_test_accuracy, round(max(test_accuracy), 6) AS max_test_accuracy,
arg_max(seed, test_accuracy * 1000 + seed * 1e-6)::BIGINT AS best_seed, round(arg_max(train_accuracy, test_accuracy * 1000 + seed * 1e-6), 6) AS best_train_accuracy, round(avg(train_accuracy - test_accuracy), 6) AS mean_overfit_gap, round(avg(train_accuracy), 6) AS mean_train_accuracy FROM re GROUP BY image_size, interval_count""",
    "mx_pooled": f"WITH {V_SQL}, {_RUNS} SELECT image_size, interval_count, class_index, sum(correct)::BIGINT AS correct, sum(total)::BIGINT AS total, round(sum(correct) / sum(total), 6) AS accuracy FROM ru GROUP BY 1, 2, 3",
    "mx_top_rows": f"{_RES} SELECT interval_count, image_size, seed, round(test_accuracy, 6) AS test_accuracy, round(train_accuracy - test_accuracy, 6) AS overfit_gap, worst_class_name, round(worst_class_accuracy, 6) AS worst_class_accuracy FROM re ORDER BY re.test_accuracy DESC, re.worst_class_accuracy DESC, train_accuracy - re.test_accuracy, interval_count, seed, image_size LIMIT 5",
    "ga_population_fitness": f"WITH {V_SQL}, sp AS (SELECT *, row_number() OVER (ORDER BY {key_sql('id')}, id) - 1 < round((SELECT count(*) FROM v) * 0.3::DOUBLE) AS test FROM v) " + " UNION ALL ".join(_genome_sql(i, g) for i, g in enumerate(GENOMES)),
    "box_square_expand": f"WITH {_BOX} SELECT image_id, detection_id, round(x1, 3) AS x1, round(y1, 3) AS y1, round(x2, 3) AS x2, round(y2, 3) AS y2 FROM c2",
    "box_rank_best": _rank_sql("score * greatest(area, 1) DESC, score DESC"),
    "box_rank_largest": _rank_sql("area DESC, score DESC"),
    "box_rank_all": _rank_sql("score DESC"),
    "box_map": f"""WITH {_BOX}, s AS (SELECT *, least(100 / greatest(1, x2 - x1), 80 / greatest(1, y2 - y1)) AS k FROM c2),
m AS (SELECT *, (100 - greatest(1, x2 - x1) * k) / 2 AS dx, (80 - greatest(1, y2 - y1) * k) / 2 AS dy FROM s)
SELECT image_id, detection_id, greatest(0, round_even(dx + (ox1 - x1) * k, 0))::BIGINT AS x1, greatest(0, round_even(dy + (oy1 - y1) * k, 0))::BIGINT AS y1, least(100, round_even(dx + (ox2 - x1) * k, 0))::BIGINT AS x2, least(80, round_even(dy + (oy2 - y1) * k, 0))::BIGINT AS y2 FROM m""",
    "stream_window_rates": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS start, count(*) AS n, count_if(event_type = 'error') AS hits, round(count_if(event_type = 'error') / count(*), 6) AS rate FROM events GROUP BY 1",
}
