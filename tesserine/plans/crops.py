"""Crops of detected objects: images by class folder, detections as a table, crops, their manifest and totals.

The detector itself is outside: its detections come with columns path,
detection_id, label, score and box (four corners), path being that of the
image below the data's folder.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..operators import boxes, images
from ..sources import images as image_sources
from ..sources import sinks

BACKGROUNDS = ("original", "solid", "blur")


@dataclass(frozen=True)
class CropSettings:
    """What is cropped and how."""

    allowed_labels: tuple[str, ...] = ()
    excluded_classes: tuple[str, ...] = image_sources.EVAL_FOLDERS
    match_source_class: bool = False
    selection: str = "best"
    max_crops: int = 1
    expand: float = 0.1
    output_size: int = 0
    background: str = "original"
    pad_color: tuple[int, int, int] = (0, 0, 0)
    overwrite: bool = False


def parse_color(text: str) -> tuple[int, int, int]:
    """Three numbers within 0 to 255, by commas."""
    parts = [p.strip() for p in text.split(",")]
    if len(parts) != 3 or not all(p.isdigit() and int(p) <= 255 for p in parts):
        raise ConfigError(f"not a colour: {text}")
    return tuple(map(int, parts))


def class_images(spark: SparkSession, root: str, excluded: tuple[str, ...] = image_sources.EVAL_FOLDERS) -> DataFrame:
    """(image_id, path, source_class, image) of images at any depth below the class folders of a root, but for the excluded ones, whatever their case."""
    found = image_sources.read_images(spark, root, names=image_sources.CROP_NAMES).withColumn("image_id", image_sources.within("path", root))
    rows = found.withColumn("source_class", F.element_at(F.split("image_id", "/"), 1)).where(F.col("image_id").contains("/"))
    return rows.where(~F.lower("source_class").isin([e.lower() for e in excluded])) if excluded else rows


def build_crops(found: DataFrame, s: CropSettings) -> DataFrame:
    """(keys, crop_box, png): each detection's square cut out, padded to a square, its surroundings kept, in one colour or blurred, and resized."""
    if s.background not in BACKGROUNDS:
        raise ConfigError(f"unknown background {s.background}")
    keys = ["image_id", "source_class", "label", "score", "box", "place"]
    box = boxes.expanded_square(F.col("box"), F.col("image.width"), F.col("image.height"), s.expand)
    side = F.greatest(*(F.bround(F.col("crop_box")[b], 0) - F.bround(F.col("crop_box")[a], 0) for a, b in ((0, 2), (1, 3)))).cast("int")
    rows = found.withColumn("crop_box", box).withColumn("inner", boxes.box_in_crop(F.col("box"), F.col("crop_box"), side, side))
    names = [*keys, "crop_box"]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names) + ", png binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for r in batch.select(["image", "crop_box", "inner"]).to_pylist():
                m = r["image"]
                picture = images.decode_row(m["data"], m["height"], m["width"], m["nChannels"])
                x1, y1, x2, y2 = (round(v) for v in r["crop_box"])
                crop = images.pad_to_square(picture[y1:y2, x1:x2], s.pad_color)
                if s.background != "original":
                    crop = images.replace_background(crop, tuple(r["inner"]), s.pad_color if s.background == "solid" else None)
                made.append(images.encode_png(images.resize(crop, s.output_size, s.output_size) if s.output_size > 0 else crop))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(made, pa.binary())], names=[*names, "png"])

    return rows.select(*names, "image", "inner").mapInArrow(run, schema)


def crop_dataset(spark: SparkSession, root: str, detections: DataFrame, out: str, s: CropSettings = CropSettings()) -> dict:
    """Write ``crops`` (Parquet: name and PNG), ``crop_manifest.jsonl`` and ``detections.json`` below a path, and return the totals.

    What is there already is overwritten only if asked for. Images that can't
    be decoded are counted and left out.
    """
    jvm = spark.sparkContext._jvm
    for name in ("crops", "crop_manifest.jsonl", "detections.json"):
        at = jvm.org.apache.hadoop.fs.Path(f"{out}/{name}")
        if not s.overwrite and at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            raise ConfigError(f"{out} has {name} already")
    pictures = class_images(spark, root, s.excluded_classes)
    seen = pictures.select("image_id", "source_class")
    own = detections.withColumnRenamed("path", "image_id").join(seen, "image_id")
    picked = boxes.select_detections(own, s.selection, s.max_crops, [*s.allowed_labels], F.col("source_class") if s.match_source_class else None)
    found = picked.drop("source_class").join(pictures, "image_id")
    crops = build_crops(found, s).withColumn("crop_rel_path", F.concat_ws("/", "source_class", boxes.crop_name(F.col("image_id"), F.col("place") - 1)))
    crops.write.mode("overwrite").parquet(f"{out}/crops")
    kept = spark.read.parquet(f"{out}/crops")
    record = kept.select(
        F.concat(F.lit(root.rstrip("/") + "/"), "image_id").alias("source_path"), F.col("image_id").alias("source_rel_path"), "source_class", "crop_rel_path",
        F.col("label").alias("detection_label"), "score", boxes.round_box(F.col("box")).alias("box_xyxy"), boxes.round_box(F.col("crop_box")).alias("crop_box_xyxy"),
    )
    record.write.mode("overwrite").json(f"{out}/crop_manifest.jsonl")
    count = lambda df, c: {r[0]: r[1] for r in df.groupBy(c).count().orderBy(c).collect()}
    images_seen, with_any = seen.count(), kept.select("image_id").distinct().count()
    totals = {
        "images_seen": images_seen,
        "images_with_detections": with_any,
        "crops_written": kept.count(),
        "skipped_no_detection": images_seen - with_any,
        "skipped_unreadable": image_sources.unread(spark, root, image_sources.CROP_NAMES).count(),
        "source_class_counts": count(seen, "source_class"),
        "detection_label_counts": count(kept, "label"),
    }
    sinks.write_files(spark, {"detections.json": json.dumps({"version": 1, "data_path": root, "config": asdict(s), "totals": totals}, indent=2).encode()}, out)
    return totals
