"""Patch scans of image categories: normal reference patches, a calibrated threshold, verdicts, masks, and the report."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, EmptyInputError
from ..operators import anomaly, areas, images, metrics, prep
from ..operators.ranking import nearest_ranks
from ..session import kept, release
from ..sources import images as image_sources

if TYPE_CHECKING:
    from .commands import Settings

CALIBRATION_SHARE = 0.2


@dataclass
class Category:
    """``rows``: image_id, path, image, split (train, eval), class_name, source_name, expected, mask_path; ``masks``: mask_path, mask."""

    name: str
    rows: DataFrame
    masks: DataFrame


def load_category(spark: SparkSession, path: str) -> Category:
    """An inspection category's folder, or a manifest with masks.

    An image's number comes from its path within the category, so that splits
    are the same wherever the files lie. Classes other than the normal one
    are anomalies.
    """
    if path.endswith(".json"):
        name, root, entries = image_sources.read_manifest_entries(spark, path)
    else:
        name, root = path.rstrip("/").rpartition("/")[2], path
        entries = image_sources.industrial_entries(image_sources.read_images(spark, root), root, ("image",))
    names = [r[0] for r in entries.where("split = 'train'").select("class_name").distinct().orderBy("class_name").collect()]
    if not names:
        raise EmptyInputError(f"no training images in {path}")
    normal = anomaly.normal_class(names)
    masked = image_sources.match_masks(entries.drop("image")).select("path", "mask_path")
    own = entries.where("split <> 'masks'").where((F.col("split") == "eval") | (F.col("class_name") == normal))
    expected = F.col("class_name") != normal
    rows = own.join(masked, "path", "left").withColumns({"image_id": F.xxhash64(image_sources.within("path", root)), "expected": expected, "mask_path": F.when(expected, F.col("mask_path"))})
    masks = entries.where("split = 'masks'")
    return Category(name, rows, masks.select(F.col("path").alias("mask_path"), F.col("image").alias("mask")))


def roles(rows: DataFrame, seed: int) -> DataFrame:
    """(image_id, role) of normal training images: a seeded fifth calibrates (``cal``), the rest are the library (``ref``); where one part is empty, all images are ``both``."""
    normal = rows.where("split = 'train'").select("image_id")
    part = prep.train_test_split(normal, CALIBRATION_SHARE, seed, "image_id")
    told = part.select("image_id", F.when(F.col("split") == "test", "cal").otherwise("ref").alias("role"))
    return told.withColumn("role", F.when(F.lit(told.select("role").distinct().count() < 2), "both").otherwise(F.col("role")))


_TRUTH = "image_id bigint, iou double, overlaps array<struct<patch_id: bigint, ratio: double>>"


def against_masks(patches: DataFrame, masks: DataFrame, threshold: float) -> DataFrame:
    """(image_id, iou, overlaps) of images with a readable mask: the mask against the union of the patches over the threshold, and each patch's share of mask pixels.

    ``patches`` has image_id, mask_path, patch_id, x, y, w, h and
    anomaly_score. An image's patches and its mask meet in one row, where the
    mask becomes runs.
    """
    packed = patches.where("mask_path is not null").groupBy("image_id", "mask_path").agg(F.collect_list(F.struct("patch_id", "x", "y", "w", "h", "anomaly_score")).alias("patches"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                m = r["mask"]
                runs = areas.mask_runs(images.luma(images.decode_row(m["data"], m["height"], m["width"], m["nChannels"])) > 0)
                clip = lambda p, at, size, most: max(min(p[at] + p[size], most) - p[at], 0)
                boxes = np.array([(p["x"], p["y"], clip(p, "x", "w", m["width"]), clip(p, "y", "h", m["height"])) for p in r["patches"]], np.int64).T
                hit = np.array([p["anomaly_score"] >= threshold for p in r["patches"]])
                total, shared = areas.union_and_shared(tuple(boxes[:, hit]), runs)
                either = total + int((runs[2] - runs[1]).sum()) - shared
                pixels = boxes[2] * boxes[3]
                ratios = areas.shared_by_each(tuple(boxes), runs) / np.maximum(pixels, 1)
                overlaps = [{"patch_id": p["patch_id"], "ratio": ratio} for p, ratio in zip(r["patches"], ratios.tolist())]
                rows.append({"image_id": r["image_id"], "iou": shared / either if either else 0.0, "overlaps": overlaps})
            kind = pa.struct([("image_id", pa.int64()), ("iou", pa.float64()), ("overlaps", pa.list_(pa.struct([("patch_id", pa.int64()), ("ratio", pa.float64())])))])
            yield pa.RecordBatch.from_struct_array(pa.array(rows, kind))

    return packed.join(masks, "mask_path").select("image_id", "mask", "patches").mapInArrow(run, _TRUTH)


@dataclass
class Scanned:
    """``results``: a row an image; ``patches``: a row a patch of the evaluated images; counts of what was used."""

    results: DataFrame
    patches: DataFrame
    threshold: float
    counts: dict[str, int]


class ScanStages:
    """The stages of a category's scans, each stored once for all scans that agree in what it depends on.

    Patches depend on the image settings and the grid; the references, and
    with them the patches' scores, on the cap and the metric too; an image's
    score on the fraction, and the threshold on the quantile. Patches of
    several grids and image settings are made in one pass, from one decode.
    """

    def __init__(self, category: Category, seed: int, evaluated: DataFrame | None = None):
        held = category.rows.where("split = 'eval'")
        if evaluated is not None:
            held = held.join(evaluated.select("image_id"), "image_id", "left_semi")
        if held.isEmpty():
            raise EmptyInputError("a scan needs images to evaluate")
        self.held, self.part = held, roles(category.rows, seed)
        reading = category.rows.where("split = 'train'").join(self.part, "image_id").select("image_id", "image", "role")
        self.rows = reading.unionByName(held.select("image_id", "image", F.lit("eval").alias("role")))
        self._patches: dict[tuple, DataFrame] = {}
        self._scored: dict[tuple, tuple[DataFrame, int]] = {}
        self._measures: dict[tuple, dict] = {}
        self._stored: list[DataFrame] = []

    @staticmethod
    def first_key(s: Settings) -> tuple:
        return images.VectorConfig(s.image_size, s.image_size, s.features, s.resize), s.patch_size, s.patch_stride

    def second_key(self, s: Settings) -> tuple:
        return *self.first_key(s), s.max_patches, s.metric

    def _keep(self, df: DataFrame) -> DataFrame:
        self._stored.append(kept(df))
        return self._stored[-1]

    def prepare(self, settings: list[Settings]) -> None:
        """Make the patches of all settings that need others than are there, in one pass over the images."""
        keys = [k for k in dict.fromkeys(self.first_key(s) for s in settings) if k not in self._patches]
        if keys:
            made = images.vectorize_patch_sets(self.rows, keys, ("image_id", "role")).withColumn("patch_id", F.xxhash64("image_id", "x", "y"))
            made = self._keep(made)
            self._patches |= {k: made.where(F.col("spec") == i).drop("spec") for i, k in enumerate(keys)}

    def scored(self, s: Settings) -> tuple[DataFrame, int]:
        """(patches of all images but the library's, with anomaly_score, in their roles; how many references there are)."""
        key = self.second_key(s)
        if key not in self._scored:
            self.prepare([s])
            patches = self._patches[self.first_key(s)]
            refs = anomaly.cap_references(patches.where("role in ('ref', 'both')").select(F.col("patch_id").alias("ref_id"), "vector", F.lit(0).cast("long").alias("label")), s.max_patches)
            ranges = prep.min_max_ranges(refs, "vector")
            refs = prep.min_max_scale(refs, ranges, "vector")
            others = prep.min_max_scale(patches.where("role <> 'ref'"), ranges, "vector")
            self._scored[key] = self._keep(anomaly.patch_scores(others, refs, s.metric).drop("vector")), refs.count()
        return self._scored[key]

    def measures(self, s: Settings, fractions: list[float], quantiles: list[float], evaluated: DataFrame) -> dict[tuple[float, float], dict]:
        """Threshold, accuracy, auroc and f1 of some images (image_id, expected) for all fractions and quantiles at once, by (fraction, quantile)."""
        key = self.second_key(s)
        if key not in self._measures:
            told = self._keep(anomaly.image_scores_at(self.scored(s)[0], fractions))
            found = nearest_ranks(told.where("role in ('cal', 'both')"), "fraction", "score", [float(q) for q in quantiles]).select("fraction", F.col("q").alias("quantile"), F.col("value").alias("threshold"))
            wanted = told.sparkSession.createDataFrame([(float(f), float(q)) for f in fractions for q in quantiles], "fraction double, quantile double")
            limits = wanted.join(found, ["fraction", "quantile"], "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.0)))
            rows = told.where("role = 'eval'").join(evaluated.select("image_id", "expected"), "image_id")
            verdicts = rows.join(limits, "fraction").withColumn("predicted", F.col("score") >= F.col("threshold"))
            right = (F.col("predicted") == F.col("expected")).cast("double")
            f1 = metrics.f1_columns(F.col("predicted"), F.col("expected"))["f1"]
            sums = verdicts.groupBy("fraction", "quantile").agg(F.first("threshold").alias("threshold"), F.avg(right).alias("accuracy"), f1.alias("f1"))
            both = sums.join(metrics.auroc_by(rows, "fraction"), "fraction").collect()
            self._measures[key] = {(r["fraction"], r["quantile"]): r.asDict() for r in both}
        return self._measures[key]

    def close(self) -> None:
        for df in self._stored:
            release(df)


def run_scan(category: Category, s: Settings, evaluated: DataFrame | None = None) -> Scanned:
    """Scan a category's evaluation images, or those of ``evaluated`` (image_id), against its normal training images."""
    anomaly.check_settings(s.patch_size, s.patch_stride, s.quantile, s.fraction)
    stages = ScanStages(category, s.seed, evaluated)
    held, part = stages.held, stages.part
    scored, references = stages.scored(s)
    threshold = anomaly.calibrate(anomaly.image_scores(scored.where("role in ('cal', 'both')"), s.fraction), s.quantile).first()["threshold"]
    by_role = {r["role"]: r["count"] for r in part.groupBy("role").count().collect()}
    both = by_role.get("both", 0)
    counts = {"reference_images": by_role.get("ref", both), "calibration_images": by_role.get("cal", both), "reference_patches": references}
    release(stages._stored[0])  # the patches' vectors; the scores are used on
    scored = scored.where("role = 'eval'").drop("role")
    named = held.select("image_id", "path", "class_name", "source_name", "expected", "mask_path")
    verdicts = anomaly.image_scores(scored, s.fraction).withColumns({"threshold": F.lit(threshold), "predicted": F.col("score") >= threshold})
    found = scored.join(named, "image_id")
    truth = kept(against_masks(found, category.masks, threshold))
    results = verdicts.join(named, "image_id").join(truth.select("image_id", F.col("iou").alias("mask_iou")), "image_id", "left")
    overlaps = truth.select(F.explode("overlaps").alias("o")).select("o.patch_id", "o.ratio")
    ratio = F.when(F.col("expected"), F.col("ratio")).otherwise(0.0)  # a normal image has no defect; a defect without a mask can't be told
    patches = found.join(overlaps, "patch_id", "left").join(verdicts.select("image_id", F.col("score").alias("image_score"), "predicted"), "image_id")
    patches = patches.withColumns({"predicted_patch": F.col("anomaly_score") >= threshold, "mask_overlap_ratio": ratio, "mask_positive": ratio > 0}).drop("ratio")
    return Scanned(results, patches, threshold, counts)


def report(scanned: Scanned) -> dict:
    """The measures of a scan: of images, and of patches where masks tell them apart (null without masks)."""
    results = scanned.results.persist()
    out = {"threshold": scanned.threshold, **scanned.counts}
    out |= {k: v for k, v in anomaly.class_accuracy(results).first().asDict().items()}
    out |= metrics.auroc(results).first().asDict()
    out |= results.agg(F.count(F.lit(1)).alias("eval_images"), F.count_if("expected").alias("anomaly_eval_images"), F.avg("mask_iou").alias("mask_iou_mean"), metrics.f1_columns(F.col("predicted"), F.col("expected"))["f1"].alias("f1")).first().asDict()
    out["normal_eval_images"] = out["eval_images"] - out["anomaly_eval_images"]
    told = scanned.patches.where("mask_positive is not null").persist()
    right = (F.col("predicted_patch") == F.col("mask_positive")).cast("double")
    f1 = metrics.f1_columns(F.col("predicted_patch"), F.col("mask_positive"))["f1"]
    patch = told.agg(F.count(F.lit(1)).alias("mask_patch_count"), F.count_if("mask_positive").alias("mask_positive_patch_count"), F.avg(right).alias("mask_patch_accuracy"), f1.alias("mask_patch_f1")).first().asDict()
    patch["mask_patch_auroc"] = metrics.auroc(told, "anomaly_score", "mask_positive").first()["auroc"]
    if not patch["mask_patch_count"]:
        patch |= dict.fromkeys(("mask_patch_accuracy", "mask_patch_f1", "mask_patch_auroc"))
    results.unpersist()
    told.unpersist()
    return out | patch


def split_evaluation(category: Category, ratio: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """((image_id) for validation, for holdout): a seeded share of the normal and of the anomalous images, each by its own seed; of one image or none, all validate."""
    share, parts = min(max(ratio, 0.05), 0.8), []
    for i, kind in enumerate(("not expected", "expected")):
        rows = category.rows.where("split = 'eval'").where(kind).select("image_id")
        if rows.count() <= 1:
            parts.append(rows.withColumn("split", F.lit("test")))
        else:
            parts.append(prep.train_test_split(rows, share, seed + 1 + i, "image_id").select("image_id", "split"))
    both = parts[0].union(parts[1])
    return both.where("split = 'test'").select("image_id"), both.where("split = 'train'").select("image_id")


def write_debug(scanned: Scanned, s: Settings, path: str, limit: int = 24, verdict: str = "all") -> list[str]:
    """Under a path: results and patches as CSV, and of a few samples (all, wrong, or right verdicts) their images, heat maps and patches, with a page that lists them. Returns the samples' names."""
    from ..sources import sinks

    if verdict not in ("all", "wrong", "right"):
        raise ConfigError(f"unknown verdict {verdict}")
    spark = scanned.results.sparkSession
    sinks.write_report(anomaly.ordered_results(scanned.results), f"{path}/patch_scan_predictions", "csv", "overwrite")
    scanned.patches.write.mode("overwrite").csv(f"{path}/patch_scan_patches", header=True)
    rows = scanned.results if verdict == "all" else scanned.results.where(f"predicted {'<>' if verdict == 'wrong' else '='} expected")
    chosen = anomaly.ordered_results(rows).limit(max(limit, 0)).collect()
    by_image: dict[int, list] = {}
    for p in scanned.patches.where(F.col("image_id").isin([r["image_id"] for r in chosen])).collect():
        by_image.setdefault(p["image_id"], []).append(p)
    pictures = {r["path"]: r["image"] for r in image_sources.read_images(spark, [r["path"] for r in chosen]).collect()} if chosen else {}
    files, names = {}, []
    for i, r in enumerate(chosen):
        name = f"{i:03d}-{sinks.safe_name(r['source_name'])}-{sinks.safe_name(r['path'].rpartition('/')[2].rpartition('.')[0])}"
        m = pictures[r["path"]]
        picture = images.decode_row(m["data"], m["height"], m["width"], m["nChannels"])
        heat = images.heat_colors(images.heat_values(picture.shape[1], picture.shape[0], [(p["x"], p["y"], p["w"], p["h"], p["anomaly_score"]) for p in by_image.get(r["image_id"], [])]))
        files |= {f"samples/{name}/original.png": images.encode_png(picture), f"samples/{name}/heatmap.png": images.encode_png(heat), f"samples/{name}/overlay.png": images.encode_png(images.overlay(picture, heat))}
        names.append(name)
    listed = [{"sample": n, "path": r["path"], "score": r["score"], "predicted": r["predicted"], "expected": r["expected"], "mask_iou": r["mask_iou"]} for n, r in zip(names, chosen)]
    files["index.html"] = sinks.index_html("Patch scan", listed).encode()
    sinks.write_files(spark, files, path)
    return names
