"""Patch anomaly scan: scores against normal patches, calibrated verdicts, masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.vectors import clamp
from . import areas
from .library import top_k
from .ranking import bucket_count, exact_rank, nearest_ranks


def check_settings(patch: int, stride: int, quantile: float, fraction: float) -> None:
    """Raises on settings that no scan can have."""
    if patch < 1 or stride < 1:
        raise ConfigError("patch size and stride must be positive")
    if not 0.0 <= quantile <= 1.0 or not 0.0 < fraction <= 1.0:
        raise ConfigError("quantile must be within 0..1, fraction above 0 and at most 1")


def normal_class(names: list[str]) -> str:
    """``normal``, else ``good``, else the first."""
    return next((n for n in ("normal", "good") if n in names), names[0])


def sliding_positions(size: Column, patch: int, stride: int) -> Column:
    """Starts of patches: every ``stride`` before the last one, and the last one; 0 alone if the patch covers all."""
    last = (size - patch).cast("long")
    steps = F.sequence(F.lit(0).cast("long"), F.greatest(last - 1, F.lit(0)), F.lit(max(stride, 1)).cast("long"))
    return F.when(last <= 0, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.concat(steps, F.array(last))))


def patch_grid(images: DataFrame, patch: int, stride: int) -> DataFrame:
    """(image_id, x, y, w, h) of all patches of images (image_id, width, height), clipped to the image."""
    across = images.select("image_id", "width", "height", F.explode(sliding_positions(F.col("width"), patch, stride)).alias("x"))
    grid = across.select("*", F.explode(sliding_positions(F.col("height"), patch, stride)).alias("y"))
    clip = lambda size, at: F.least(F.lit(patch), F.col(size) - F.col(at)).cast("long")
    return grid.select("image_id", "x", "y", clip("width", "x").alias("w"), clip("height", "y").alias("h"))


def cap_references(refs: DataFrame, limit: int, order: str = "ref_id") -> DataFrame:
    """An evenly strided subsample of ``limit`` rows in the order of an integer column: places floor(i * n / limit); 0 keeps all. The cap is the operator itself."""
    n = refs.count()
    if limit == 0 or n <= limit:
        return refs
    low, high = refs.agg(F.min(order), F.max(order)).first()
    width = max(1.0, (high - low + 1) / bucket_count(n))
    keyed = refs.withColumn("__bucket", F.floor((F.col(order).cast("double") - float(low)) / F.lit(width)))  # ids may span all longs, so their difference isn't one
    ranked = exact_rank(keyed, [], "__bucket", [order], "__n")
    # Place n is taken if some i has floor(i * step) = n: that is the least i with i * step >= n.
    step = n / limit
    i = F.ceil(F.col("__n") / F.lit(step))
    candidates = F.array(i - 1, i, i + 1)
    taken = F.exists(candidates, lambda c: (c >= 0) & (c < limit) & (F.least(F.floor(c * F.lit(step)), F.lit(n - 1)) == F.col("__n")))
    return ranked.where(taken).drop("__bucket", "__n")


def patch_scores(patches: DataFrame, refs: DataFrame, metric: str = "cosine", threshold: float = 0.5) -> DataFrame:
    """Patches (patch_id, image_id, vector, ...) with ``anomaly_score``: 1 - best similarity, clamped to 0..1. Only the best neighbour counts."""
    best = top_k(patches.select(F.col("patch_id").alias("query_id"), "vector"), refs, 1, metric, threshold)
    scores = best.select(F.col("query_id").alias("__q"), clamp(1.0 - F.col("score")).alias("anomaly_score"))
    return patches.join(scores, F.col("patch_id") == F.col("__q")).drop("__q")


def image_scores(scored: DataFrame, fraction: float) -> DataFrame:
    """(image_id, score, max_patch_score, patch_count): the mean of the max(1, ceil(n * fraction)) highest patch scores."""
    packed = scored.groupBy("image_id").agg(F.sort_array(F.collect_list("anomaly_score"), asc=False).alias("__s"))
    n = F.size("__s")
    take = F.greatest(F.lit(1), F.ceil(n * F.lit(fraction)).cast("int"))
    mean = F.aggregate(F.slice("__s", F.lit(1), take), F.lit(0.0), lambda a, x: a + x) / take
    return packed.select("image_id", mean.alias("score"), F.col("__s")[0].alias("max_patch_score"), n.cast("long").alias("patch_count"))


def image_scores_at(scored: DataFrame, fractions: list[float]) -> DataFrame:
    """(image_id, role, fraction, score): what ``image_scores`` gives for each of some fractions, from one pass over the patches (image_id, role, anomaly_score)."""
    packed = scored.groupBy("image_id", "role").agg(F.sort_array(F.collect_list("anomaly_score"), asc=False).alias("__s"))
    each = packed.withColumn("fraction", F.explode(F.array(*(F.lit(float(f)) for f in fractions))))
    take = F.greatest(F.lit(1), F.ceil(F.size("__s") * F.col("fraction")).cast("int"))
    return each.select("image_id", "role", "fraction", (F.aggregate(F.slice("__s", F.lit(1), take), F.lit(0.0), lambda a, x: a + x) / take).alias("score"))


def calibrate(scores: DataFrame, quantile: float) -> DataFrame:
    """(threshold): the nearest-rank percentile of the scores of held-out normal images; one row, 0 without any."""
    found = nearest_ranks(scores.select(F.lit(0).alias("one"), "score"), "one", "score", [quantile])
    return found.agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("threshold"))


def verdicts(scores: DataFrame, threshold: DataFrame) -> DataFrame:
    """Add ``threshold`` and ``predicted`` (score >= threshold)."""
    return scores.crossJoin(F.broadcast(threshold)).withColumn("predicted", F.col("score") >= F.col("threshold"))


def class_accuracy(rows: DataFrame) -> DataFrame:
    """(accuracy, normal_accuracy, anomaly_recall); null where a class has no rows."""
    right = (F.col("predicted") == F.col("expected")).cast("double")
    return rows.agg(F.avg(right).alias("accuracy"), F.avg(F.when(~F.col("expected"), right)).alias("normal_accuracy"), F.avg(F.when(F.col("expected"), right)).alias("anomaly_recall"))


def predicted_rectangles(patches: DataFrame, threshold: Column | float, width: int, height: int) -> DataFrame:
    """Patches (image_id, patch_id, x, y, w, h, anomaly_score), clipped to the image, with ``predicted``, whether they are at or over the threshold."""
    clip = lambda at, size, most: F.least(F.col(at) + F.col(size), F.lit(most).cast("long")) - F.col(at)
    return patches.select("image_id", "patch_id", "x", "y", clip("x", "w", width).alias("w"), clip("y", "h", height).alias("h"), (F.col("anomaly_score") >= threshold).alias("predicted"))


def predicted_mask(patches: DataFrame, threshold: Column | float, width: int, height: int) -> DataFrame:
    """(image_id, y0, y1, x0, x1): the union of the rectangles of patches at or over the threshold, within the image, as disjoint rectangles."""
    return areas.union_strips(predicted_rectangles(patches, threshold, width, height).where("predicted"))


def mask_iou(rectangles: DataFrame, runs: DataFrame) -> DataFrame:
    """(image_id, iou) of the union of predicted rectangles and a mask's runs (image_id, y, x0, x1); 0 for an empty union, for images that either has."""
    told = areas.area_measures(rectangles, runs)
    either = F.col("predicted_area") + F.col("truth_area") - F.col("shared_area")
    return told.select("image_id", F.when(either > 0, F.col("shared_area") / F.when(either > 0, either)).otherwise(0.0).alias("iou"))


def overlap_ratio(patches: DataFrame, runs: DataFrame) -> DataFrame:
    """(patch_id, mask_overlap_ratio, mask_positive) of patches (image_id, patch_id, x, y, w, h): the share of their pixels that a mask's runs have."""
    sizes = patches.select("patch_id", (F.col("w") * F.col("h")).alias("__pixels"))
    told = areas.area_measures(patches.withColumn("predicted", F.lit(False)), runs).select(F.explode("overlaps").alias("o")).select("o.patch_id", "o.area")
    ratio = F.when(F.col("__pixels") > 0, F.col("area") / F.when(F.col("__pixels") > 0, F.col("__pixels"))).otherwise(0.0)
    return told.join(sizes, "patch_id").select("patch_id", ratio.alias("mask_overlap_ratio"), (F.col("area") > 0).alias("mask_positive"))


def ordered_results(rows: DataFrame) -> DataFrame:
    """Results by falling score, then image."""
    return rows.orderBy(F.col("score").desc(), "image_id")
