"""Experiment grids: rows, summaries, best rows."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["model", "image_features", "image_resize", "correction_mode", "image_size", "interval_count"]


def grid(spark: SparkSession, **dimensions: list) -> DataFrame:
    """Every combination of the settings, one row each, in the order of the dimensions; settings are few."""
    rows = [dict(zip(dimensions, values)) for values in product(*dimensions.values())]
    names = list(dimensions)
    kinds = {n: "string" if isinstance(v[0], str) else "double" if isinstance(v[0], float) else "bigint" for n, v in dimensions.items()}
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} {kinds[n]}" for n in names))


def row_columns(rows: DataFrame) -> DataFrame:
    """Add ``overfit_gap``, and the class with samples that does worst, from nested ``per_class``."""
    seen = F.filter("per_class", lambda c: c["total"] > 0)
    worst = F.array_min(F.transform(seen, lambda c: F.struct(c["accuracy"], c["class_index"], c["class_name"].alias("name"))))
    return rows.withColumns(
        {"overfit_gap": F.col("train_accuracy") - F.col("test_accuracy"), "worst_class_name": F.coalesce(worst["name"], F.lit("none")), "worst_class_accuracy": F.coalesce(worst["accuracy"], F.lit(0.0))}
    )


def summarize(rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Per group: runs, mean, least and greatest test accuracy, the best run (the last seed on ties), mean gap."""
    best = lambda c: F.max_by(c, F.struct("test_accuracy", "seed"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg("test_accuracy").alias("mean_test_accuracy"),
        F.min("test_accuracy").alias("min_test_accuracy"),
        F.max("test_accuracy").alias("max_test_accuracy"),
        best("seed").alias("best_seed"),
        best("train_accuracy").alias("best_train_accuracy"),
        F.avg(F.col("train_accuracy") - F.col("test_accuracy")).alias("mean_overfit_gap"),
        F.avg("train_accuracy").alias("mean_train_accuracy"),
    )


def pooled_classes(per_class: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, class_index, correct, total, accuracy): counts of all runs of a group put together."""
    sums = per_class.groupBy(*keys, "class_index").agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"))
    return sums.withColumn("accuracy", F.when(F.col("total") > 0, F.col("correct") / F.when(F.col("total") > 0, F.col("total")).otherwise(1)).otherwise(0.0))


def top_rows(rows: DataFrame, limit: int) -> DataFrame:
    """The best rows: test accuracy, worst class, least gap, then the settings; 0 gives none."""
    order = [F.col("test_accuracy").desc(), F.col("worst_class_accuracy").desc(), "overfit_gap", "model", "image_features", "image_resize", "correction_mode", "interval_count", "seed", "image_size"]
    return rows.orderBy(*order).limit(limit)
