"""Labelled images from class folders, manifests and industrial categories; decoded by Spark's image source."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, EmptyInputError
from ..operators.prep import label_dim, remap_labels

IMAGE_NAMES = r"(?i)\.(jpe?g|png)$"
CROP_NAMES = r"(?i)\.(jpe?g|png|bmp|webp)$"
#: Folders beside the classes that hold evaluation data.
EVAL_FOLDERS = ("eval", "validation", "test")
#: Endings of mask files, the first that exists wins.
MASK_ENDINGS = ("_mask.png", ".png", "_mask.jpg", ".jpg")


def read_images(spark: SparkSession, paths: str | list[str], recursive: bool = True, names: str = IMAGE_NAMES) -> DataFrame:
    """(path, image) of readable files, JPEG and PNG unless other names are given; broken ones are left out, and ``unread`` tells them."""
    reader = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", recursive)
    path = F.url_decode(F.replace("image.origin", F.lit("+"), F.lit("%2B")))  # the source writes blanks and other signs as %20 and so on
    return reader.load(paths).where(F.col("image.origin").rlike(names)).select(path.alias("path"), "image")


def within(path: str, root: str):
    """A path below a root, without the root; others stay whole. So the same files have the same names wherever they lie."""
    return F.regexp_replace(path, r"^.*?" + _escaped(root.rstrip("/").removeprefix("file:")) + "/", "")


def unread(spark: SparkSession, paths: str | list[str], names: str = IMAGE_NAMES) -> DataFrame:
    """(path) of files that have an image's name and can't be decoded: what ``read_images`` leaves out."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).where(F.col("path").rlike(names)).select("path")
    plain = lambda c: F.regexp_replace(c, r"^file:/*", "/")  # the two sources write the scheme in different ways
    read = read_images(spark, paths, names=names).select(plain("path").alias("__read"))
    return listed.join(read, plain("path") == F.col("__read"), "left_anti")


def stem(path):
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def read_image_folder(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(images, classes) of <root>/<class>/<file>; deeper files and classes without images are left out; classes by name."""
    images = read_images(spark, root)
    prefix = r"^.*?" + _escaped(root.rstrip("/").removeprefix("file:")) + r"/([^/]+)/[^/]+$"
    rows = images.withColumn("class_name", F.regexp_extract("path", prefix, 1)).where("class_name <> ''")
    if rows.isEmpty():
        raise EmptyInputError(f"no class folders with images in {root}")
    rows = rows.withColumn("source_name", F.col("class_name"))
    dim = label_dim(rows, "class_name")
    return remap_labels(rows, "class_name", dim, strict=False), dim


def _escaped(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_-" else f"\\{c}" for c in text)


def parse_manifest(text: str, folder: str) -> list[tuple[str, str, str, str]]:
    """(split, class_name, source_name, path) of a manifest: root relative to its folder, one path or many for each class, ``train`` required."""
    manifest = json.loads(text)
    if "train" not in manifest:
        raise ConfigError("a manifest needs train")
    root = _resolved(manifest.get("root") or ".", folder)
    rows = []
    for split in ("train", "eval", "masks"):
        for name in sorted(manifest.get(split) or {}):
            paths = manifest[split][name]
            for p in [paths] if isinstance(paths, str) else paths:
                rows.append((split, name, p.rstrip("/").rpartition("/")[2], _resolved(p, root)))
    return rows


def _resolved(path: str, base: str) -> str:
    return path if path.startswith("/") or "://" in path else base if path == "." else f"{base.rstrip('/')}/{path}"


def read_manifest_entries(spark: SparkSession, path: str) -> tuple[str, str, DataFrame]:
    """(name, root, images with path, split, masks among them, class_name and source_name) of a manifest; a path in it may be a file or a folder of any depth."""
    text = "\n".join(r[0] for r in spark.read.text(path).collect())
    folder, manifest = path.rpartition("/")[0], json.loads(text)
    parts = [
        read_images(spark, p).select("path", "image", F.lit(split).alias("split"), F.lit(name).alias("class_name"), F.lit(source).alias("source_name"))
        for split, name, source, p in parse_manifest(text, folder)
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    return manifest.get("name") or "image-manifest", _resolved(manifest.get("root") or ".", folder), rows


def read_image_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(images with split, classes) of a manifest. A class's number is its place by name in train."""
    rows = read_manifest_entries(spark, path)[2].where("split <> 'masks'")
    dim = label_dim(rows.where("split = 'train'"), "class_name")
    return remap_labels(rows, "class_name", dim), dim


def industrial_entries(paths: DataFrame, root: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, split, class_name, source_name, keep) of an inspection category: train/good, test/good, test/<defect>, ground_truth/<defect>."""
    inside = F.regexp_extract("path", _escaped(root.rstrip("/")) + r"/(.*)/[^/]+$", 1)
    part, source = F.element_at(F.split(inside, "/"), 1), F.element_at(F.split(inside, "/"), -1)
    split = F.when(part == "train", "train").when(part == "test", "eval").when(part == "ground_truth", "masks")
    name = F.when(source == "good", "normal").otherwise("anomaly")
    return paths.select("path", split.alias("split"), name.alias("class_name"), source.alias("source_name"), *keep).where("split is not null")


def match_masks(entries: DataFrame) -> DataFrame:
    """Evaluation entries with ``mask_path``: the mask of the same source and stem whose ending comes first; null without one."""
    name = F.element_at(F.split("path", "/"), -1)
    ending = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(e).alias("e")) for i, e in enumerate(MASK_ENDINGS)))
    masks = entries.where("split = 'masks'").select("source_name", F.col("path").alias("__mask"), F.explode(F.filter(ending, lambda x: name.endswith(x["e"]))).alias("x"), name.alias("__n"))
    masks = masks.select("source_name", "__mask", "x.i", F.expr("substring(__n, 1, length(__n) - length(x.e))").alias("__stem"))
    best = masks.groupBy("source_name", "__stem").agg(F.min_by("__mask", "i").alias("mask_path"))
    rows = entries.where("split = 'eval'").withColumn("__stem", stem(F.col("path")))
    return rows.join(best, ["source_name", "__stem"], "left").drop("__stem")
