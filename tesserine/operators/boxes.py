"""Detection boxes: filtering, ranking, square expansion, mapping into crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.vectors import safe_div


def box_area(box: Column) -> Column:
    side = lambda a, b: F.greatest(F.lit(0.0), box[b] - box[a])
    return side(0, 2) * side(1, 3)


def select_detections(detections: DataFrame, selection: str = "best", limit: int = 1, allowed: list[str] | None = None, source_class: str | Column | None = None) -> DataFrame:
    """The first detections of each image: by score times area (``best``), area (``largest``) or score (``all``); the limit holds for all three.

    ``detections`` has image_id, detection_id, label, score and box. Labels
    are compared in lower case. Adds area, rank_score and place.
    """
    rows = detections.withColumn("label", F.lower("label")).withColumn("area", box_area(F.col("box")))
    rows = rows.withColumn("rank_score", F.col("score") * F.greatest("area", F.lit(1.0)))
    if allowed:
        rows = rows.where(F.col("label").isin([a.lower() for a in allowed]))
    if source_class is not None:
        rows = rows.where(F.col("label") == F.lower(F.lit(source_class) if isinstance(source_class, str) else source_class))
    if selection not in ("best", "largest", "all"):
        raise ConfigError(f"unknown selection {selection}")
    keys = {"best": ["rank_score", "score"], "largest": ["area", "score"], "all": ["score"]}[selection]
    order = Window.partitionBy("image_id").orderBy(*(F.col(k).desc() for k in keys), "detection_id")
    return rows.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= max(1, limit))


def expanded_square(box: Column, width: Column, height: Column, expand: float) -> Column:
    """A square around a box, its longer side widened on both sides by ``expand``, pushed into the image, then clipped."""
    side = F.greatest(F.lit(1.0), box[2] - box[0], box[3] - box[1]) * (1.0 + max(0.0, expand) * 2.0)
    ends = []
    for low, high, most in ((0, 2, width), (1, 3, height)):
        middle = (box[low] + box[high]) / 2.0
        a, b = middle - side / 2.0, middle + side / 2.0
        b = F.when(a < 0, b - a).otherwise(b)
        a = F.greatest(a, F.lit(0.0))
        a = F.when(b > most, a - (b - most)).otherwise(a)
        ends.append((F.greatest(F.lit(0.0), a), F.least(most.cast("double"), b)))
    (x1, x2), (y1, y2) = ends
    return F.array(x1, y1, x2, y2)


def box_in_crop(box: Column, crop: Column, out_width: Column, out_height: Column) -> Column:
    """The box in the pixels of a crop that was scaled to fit and centred, rounded to even on halves and clipped."""
    cw, ch = (F.greatest(F.lit(1.0), crop[b] - crop[a]) for a, b in ((0, 2), (1, 3)))
    scale = F.least(safe_div(out_width.cast("double"), cw), safe_div(out_height.cast("double"), ch))
    dx, dy = (out_width - cw * scale) / 2.0, (out_height - ch * scale) / 2.0
    at = lambda i, d, o: F.bround(d + (box[i] - crop[o]) * scale, 0).cast("long")
    low, zero = F.greatest, F.lit(0).cast("long")
    return F.array(low(zero, at(0, dx, 0)), low(zero, at(1, dy, 1)), F.least(out_width.cast("long"), at(2, dx, 0)), F.least(out_height.cast("long"), at(3, dy, 1)))


def round_box(box: Column, places: int = 3) -> Column:
    """Banker's rounding of each coordinate."""
    return F.transform(box, lambda x: F.bround(x, places))


def crop_name(path: Column, number: Column) -> Column:
    """<stem>__crop%03d.jpg, with a hash of the whole path, so that equal stems don't overwrite each other."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.format_string("%s_%s__crop%03d.jpg", stem, F.substring(F.md5(path), 1, 8), number)


def crop_totals(crops: DataFrame, images: DataFrame) -> DataFrame:
    """(source_class, label, seen, crops, without): images seen and crops made by class and label, and images without any."""
    per = crops.groupBy("source_class", "label").agg(F.count(F.lit(1)).alias("crops"))
    seen = images.groupBy("source_class").agg(F.count(F.lit(1)).alias("seen"))
    none = images.join(crops.select("image_id").distinct(), "image_id", "left_anti").groupBy("source_class").agg(F.count(F.lit(1)).alias("without"))
    return seen.join(none, "source_class", "left").join(per, "source_class", "left").select("source_class", "label", "seen", F.coalesce("crops", F.lit(0)).alias("crops"), F.coalesce("without", F.lit(0)).alias("without"))
