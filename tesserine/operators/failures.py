"""Failure analysis of predictions (sample_id, expected, predicted, correct, score_margin)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import safe_div

HIGH, LOW, LISTED = 0.5, 0.1, 24


def confidence_summary(predictions: DataFrame) -> DataFrame:
    wrong = ~F.col("correct")
    return predictions.agg(
        F.count_if(wrong).alias("wrong_total"),
        F.count_if(wrong & (F.col("score_margin") >= HIGH)).alias("high_confidence_wrong"),
        F.count_if(wrong & (F.col("score_margin") <= LOW)).alias("ambiguous_wrong"),
    )


def ranked_wrong(predictions: DataFrame, confident: bool, limit: int = LISTED) -> DataFrame:
    """Wrong predictions by margin, falling or rising, ties in sample order."""
    margin = F.col("score_margin").desc() if confident else F.col("score_margin").asc()
    return predictions.where("not correct").orderBy(margin, "sample_id").limit(limit)


def bucket_summaries(rows: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """(bucket_group, bucket, total, wrong, wrong_rate) for each way of bucketing; all groups in one pass and one shuffle."""
    cells = F.array(*(F.struct(F.lit(g).alias("bucket_group"), c.alias("bucket")) for g, c in groups.items()))
    long = rows.select("correct", F.explode(cells).alias("c")).select("correct", "c.*")
    agg = long.groupBy("bucket_group", "bucket").agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("correct")).alias("wrong"))
    return agg.withColumn("wrong_rate", safe_div(F.col("wrong").cast("double"), F.col("total").cast("double")))


def brightness_bucket(v: Column) -> Column:
    return F.when(v < 0.33, "dark").when(v > 0.66, "bright").otherwise("medium")


def contrast_bucket(v: Column) -> Column:
    return F.when(v < 0.12, "low").when(v > 0.28, "high").otherwise("medium")


def orientation_bucket(aspect: Column) -> Column:
    return F.when(aspect > 1.2, "landscape").when(aspect < 0.83, "portrait").otherwise("square")


def crop_loss_bucket(v: Column) -> Column:
    return F.when(v < 0.10, "low").when(v > 0.35, "high").otherwise("medium")


def select_samples(predictions: DataFrame, mode: str, limit: int) -> DataFrame:
    """(sample_id, place): samples to look at closely.

    ``all`` and ``correct`` take the first in sample order; ``misclassified``
    takes half of the limit by falling margin, then as many as are still
    missing from the front of those by rising margin (some may be there
    already), then the rest in sample order; each once.
    """
    if limit <= 0:
        return predictions.select("sample_id", F.lit(0).cast("long").alias("place")).limit(0)
    if mode != "misclassified":
        rows = predictions if mode == "all" else predictions.where("correct")
        first = rows.select("sample_id").orderBy("sample_id").limit(limit)
        return first.withColumn("place", F.row_number().over(Window.orderBy("sample_id")).cast("long"))
    wrong = predictions.where("not correct")
    quota = max(limit // 2, 1)
    number = lambda df, o, start: df.withColumn("place", F.row_number().over(Window.orderBy(*o)) + start)
    high = wrong.select("sample_id", "score_margin").orderBy(F.col("score_margin").desc(), "sample_id").limit(quota)
    high = number(high, [F.col("score_margin").desc(), "sample_id"], 0)
    low = wrong.select("sample_id", "score_margin").orderBy("score_margin", "sample_id").limit(max(limit - quota, 0))
    low = number(low, ["score_margin", "sample_id"], limit)
    rest = number(wrong.select("sample_id", "score_margin").orderBy("sample_id").limit(2 * limit), ["sample_id"], 2 * limit)
    once = high.union(low).union(rest).groupBy("sample_id").agg(F.min("place").alias("__p"))
    placed = once.orderBy("__p").limit(limit)
    return placed.select("sample_id", F.row_number().over(Window.orderBy("__p")).cast("long").alias("place"))


def resize_disagreements(comparisons: DataFrame, predictions: DataFrame) -> DataFrame:
    """Comparisons (sample_id, mode, predicted) that differ from the sample's own prediction."""
    own = predictions.select("sample_id", F.col("predicted").alias("__own"))
    return comparisons.join(own, "sample_id").where("predicted <> __own").drop("__own")


def findings(worst: DataFrame, common: DataFrame, confidence: DataFrame) -> list[str]:
    """The report's sentences, from three small frames."""
    out = []
    if w := worst.first():
        out.append(f"Weakest class is {w['class_name']}: {w['accuracy'] * 100:.2f}% accuracy ({w['correct']} / {w['total']}).")
    if c := common.first():
        out.append(f"Most common mistake is {c['actual_index']} predicted as {c['predicted_index']} ({c['n']} images).")
    k = confidence.first()
    return [*out, f"{k['high_confidence_wrong']} wrong predictions are high-confidence; {k['ambiguous_wrong']} wrong predictions are ambiguous."]
