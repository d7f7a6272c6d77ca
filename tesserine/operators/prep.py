"""Statistics, scaling, encoding of labels, and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, DimensionError, EmptyInputError, UnknownClassError
from ..functions.vectors import EPSILON, clamp, finite, unit_position
from .ranking import bucket_count, exact_rank, nearest_ranks


def long_form(samples: DataFrame, vector: str = "features", *keep: str) -> DataFrame:
    """One row per feature: feature (bigint), value (double)."""
    return samples.select(*keep, F.posexplode(F.col(vector).cast("array<double>")).alias("feature", "value")).withColumn("feature", F.col("feature").cast("long"))


def check_rectangular(samples: DataFrame, vector: str = "features") -> int:
    """The common length of all vectors; raises if there are none or they differ."""
    low, high = samples.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if not high:
        raise EmptyInputError("no samples or no features")
    if low != high:
        raise DimensionError(f"vectors have {low} to {high} features")
    return high


def min_max_ranges(samples: DataFrame, vector: str = "features") -> DataFrame:
    """(feature, min, max) over finite values; (0, 0) where a feature has none. Map-side combined."""
    value = F.when(finite(F.col("value")), F.col("value"))
    ranges = long_form(samples, vector).groupBy("feature").agg(F.min(value).alias("min"), F.max(value).alias("max"))
    return ranges.select("feature", F.coalesce("min", F.lit(0.0)).alias("min"), F.coalesce("max", F.lit(0.0)).alias("max"))


def percentile_clip_ranges(samples: DataFrame, low: float, high: float, vector: str = "features") -> DataFrame:
    """(feature, min, max) from nearest-rank percentiles of finite values; (0, 0) where there are none."""
    if not 0.0 <= low < high <= 1.0:
        raise ConfigError("percentiles must rise within 0..1")
    values = long_form(samples, vector)
    found = nearest_ranks(values.where(finite(F.col("value"))), "feature", "value", [low, high])
    pivot = found.groupBy("feature").agg(F.max(F.when(F.col("q") == low, F.col("value"))).alias("min"), F.max(F.when(F.col("q") == high, F.col("value"))).alias("max"))
    every = values.select("feature").distinct()
    return every.join(pivot, "feature", "left").select("feature", F.coalesce("min", F.lit(0.0)).alias("min"), F.coalesce("max", F.lit(0.0)).alias("max"))


def ranges_row(ranges: DataFrame) -> DataFrame:
    """Ranges as one row: __ranges, array of (min, max) by feature. Its size is the number of features."""
    packed = F.array_sort(F.collect_list(F.struct("feature", "min", "max")))
    return ranges.agg(packed.alias("__ranges"))


def scale(vector: Column, ranges: Column) -> Column:
    return F.zip_with(vector, ranges, lambda v, r: unit_position(v, r["min"], r["max"]))


def min_max_scale(samples: DataFrame, ranges: DataFrame, vector: str = "features") -> DataFrame:
    """Each feature scaled into 0..1 by ``ranges``: 0 for zero width or values that aren't finite. The single row of ranges is broadcast."""
    joined = samples.crossJoin(F.broadcast(ranges_row(ranges)))
    return joined.withColumn(vector, scale(F.col(vector).cast("array<double>"), F.col("__ranges"))).drop("__ranges")


def z_score_clip(samples: DataFrame, clip: float, vector: str = "features") -> DataFrame:
    """(v - mean) / population deviation (at least EPSILON), clamped to +-clip; values aren't filtered."""
    if clip <= 0:
        raise ConfigError("clip must be positive")
    stats = long_form(samples, vector).groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    row = stats.agg(F.array_sort(F.collect_list(F.struct("feature", "mean", "std"))).alias("__stats"))
    scaled = F.zip_with(F.col(vector).cast("array<double>"), F.col("__stats"), lambda v, s: clamp((v - s["mean"]) / F.greatest(s["std"], F.lit(EPSILON)), -clip, clip))
    return samples.crossJoin(F.broadcast(row)).withColumn(vector, scaled).drop("__stats")


def shuffle_key(key: str, seed: int) -> Column:
    """A seeded 32-bit arithmetic hash of an integer key."""
    return F.pmod(F.pmod(F.col(key) + seed, F.lit(1 << 20)) * 2654435761 + F.pmod(F.col(key), F.lit(1 << 31)) * 40503, F.lit(1 << 32))


def train_test_split(samples: DataFrame, ratio: float, seed: int = 42, key: str = "sample_id", within: list[str] | None = None) -> DataFrame:
    """Add ``split`` and ``ord`` (bigint): a seeded shuffle whose first round(n * ratio) rows are the test part.

    ``ord`` is the place in the shuffle, so a ratio of 0 still shuffles the
    training order. With ``within``, each group is split by itself.
    """
    if not 0.0 <= ratio <= 1.0:
        raise ConfigError("ratio must be within 0..1")
    group = within or []
    if not group:
        samples, group = samples.withColumn("__all", F.lit(0)), ["__all"]
    sizes = samples.groupBy(*group).agg(F.count(F.lit(1)).alias("__size"))
    total = samples.count()
    keyed = samples.withColumn("__key", shuffle_key(key, seed)).withColumn("__bucket", F.floor(F.col("__key") / F.lit(2.0**32) * bucket_count(total)))
    ranked = exact_rank(keyed, group, "__bucket", ["__key", key], "ord").join(sizes, group)
    split = F.when(F.col("ord") < F.round(F.col("__size") * ratio), "test").otherwise("train")
    return ranked.withColumn("split", split).drop("__key", "__bucket", "__size", "__all")


def label_dim(rows: DataFrame, name: str, first: str | None = None) -> DataFrame:
    """(label, class_name): numbered by the least ``first`` (first appearance), or by name."""
    if first:
        order = rows.groupBy(F.col(name).alias("class_name")).agg(F.min(first).alias("__first"))
        by = "__first"
    else:
        order, by = rows.select(F.col(name).alias("class_name")).distinct(), "class_name"
    names = order.agg(F.array_sort(F.collect_list(F.struct(F.col(by).alias("k"), F.col("class_name").alias("n")))).alias("__n"))
    return names.select(F.posexplode("__n").alias("label", "__x")).select(F.col("label").cast("long").alias("label"), F.col("__x.n").alias("class_name"))


def remap_labels(rows: DataFrame, name: str, dim: DataFrame, strict: bool = True) -> DataFrame:
    """Add ``label`` by class name; with ``strict``, names that ``dim`` lacks raise."""
    if strict and (unknown := rows.join(dim, rows[name] == dim["class_name"], "left_anti").select(name).first()):
        raise UnknownClassError(f"unknown class {unknown[0]}")
    return rows.join(dim.select(F.col("class_name").alias("__class"), "label"), F.col(name) == F.col("__class")).drop("__class")


def class_counts(rows: DataFrame, name: str = "label") -> DataFrame:
    return rows.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
