"""Whole commands: load, split, scale, fit, score, report. Settings come from defaults, a config file, a search result and the call, later ones winning."""

from __future__ import annotations

import json
import time
import warnings
from collections.abc import Callable
from dataclasses import asdict, dataclass, fields, replace
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions import bits
from ..functions.vectors import squared_distance
from ..operators import centroid, failures, images, library, metrics, prep
from ..operators.interval_model import Correction, IntervalModel, learning_curve
from ..operators.intervals import TRIANGULAR
from ..session import kept, release
from ..sources import images as image_sources
from ..sources import sinks
from ..sources import vectors as vector_sources
from . import matrix, scan
from . import search as searching

MODELS = ("interval", "library", "binary", "centroid")
IMAGE_SOURCES = ("image-folder", "image-manifest")
SOURCES = ("iris", "synthetic", "image-synthetic", "embedding-csv", *IMAGE_SOURCES)
SEARCHES = ("binary-search", "scan-search")
#: Names of settings in the results of a search, and what such a result reports besides its recipe.
ALIASES = {"image_features": "features", "image_resize": "resize", "active_blocks": "blocks", "max_train_patches": "max_patches", "threshold_quantile": "quantile", "patch_score_fraction": "fraction"}
REPORTED = ("fitness", "best_fitness", "generation", "similarity", "active_block_count", "accuracy", "auroc", "f1", "validation_accuracy", "validation_auroc", "validation_f1", "validation_ms", "eval_accuracy", "memory_bytes")


@dataclass(frozen=True)
class Settings:
    """All settings of a command, with their defaults."""

    source: str = "synthetic"
    data: str | None = None
    eval_data: str | None = None
    epochs: int = 12
    intervals: int = 8
    seed: int = 42
    test_ratio: float = 0.2
    correction: str = "least-squares"
    epoch_mode: str = "reference"
    image_size: int = 16
    features: str = "pixels"
    resize: str = "stretch"
    top_k: int = 3
    metric: str = "euclidean"
    threshold: float = 0.5
    jaccard_weight: float = 0.0
    blocks: int = bits.ALL_BLOCKS
    patch_size: int = 96
    patch_stride: int = 48
    max_patches: int = 4096
    quantile: float = 0.95
    fraction: float = 0.10
    target_mse: float | None = None
    population: int = 32
    generations: int = 20
    elite: int = 4
    mutation: float = 0.2
    validation_ratio: float = 0.2
    memory_penalty: float = 0.0
    time_penalty: float = 0.0
    search_sizes: str | None = None
    search_features: str | None = None
    search_resizes: str | None = None
    search_top_ks: str | None = None
    search_patch_sizes: str | None = None
    search_patch_strides: str | None = None
    search_max_patches: str | None = None
    search_quantiles: str | None = None
    search_fractions: str | None = None
    matrix_models: str | None = None
    matrix_features: str | None = None
    matrix_resize_modes: str | None = None
    matrix_image_sizes: str | None = None
    matrix_seeds: str | None = None
    matrix_intervals: str | None = None
    matrix_correction_modes: str | None = None
    matrix_top: int = 0
    debug_out: str | None = None
    debug_limit: int = 24
    debug_samples: str = "misclassified"


def blocks_of(value: int | str) -> int:
    """A mask of feature blocks, as a number or as text such as 0x7e57."""
    return bits.normal_blocks(int(value, 0) if isinstance(value, str) else value)


def listed(text: str | None, kind: type = str) -> list | None:
    """The values of a setting that is a list, written with commas; None if it isn't set."""
    return None if text is None else [kind(x.strip()) for x in text.split(",") if x.strip()]


def recipe(found: dict) -> dict:
    """The settings in a search's result: its best genome or recipe, or all of it, without what it only reports. A result of another kind of search raises."""
    if found.get("model") not in (None, *SEARCHES):
        raise ConfigError(f"not the result of a search: {found['model']}")
    found = found.get("best_genome") or found.get("best_recipe") or found
    own = {ALIASES.get(k.replace("-", "_"), k.replace("-", "_")): v for k, v in found.items() if k.replace("-", "_") not in REPORTED}
    if own.pop("variant", 0):
        raise ConfigError("a search result must name its image settings, not only the number of its variant")
    return own


def layered(call: dict, config: str | None = None, search: str | None = None) -> tuple[Settings, dict[str, str]]:
    """(settings, where each came from). ``config`` and ``search`` are JSON texts; unknown keys raise, but for what a search reports besides its recipe; dashes may stand for underscores, and a list for its values with commas."""
    known, values, origin = {f.name for f in fields(Settings)}, {}, {f.name: "default" for f in fields(Settings)}
    layers = [("config", json.loads(config) if config else {}), ("search", recipe(json.loads(search)) if search else {}), ("call", call)]
    for name, layer in layers:
        for key, value in layer.items():
            key = key.replace("-", "_")
            if key not in known:
                raise ConfigError(f"unknown setting {key}")
            if value is not None:
                value = ",".join(map(str, value)) if isinstance(value, list) else value
                values[key], origin[key] = blocks_of(value) if key == "blocks" else value, name
    return Settings(**values), origin


def load(spark: SparkSession, s: Settings, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(samples with sample_id, features, label; classes) of the source."""
    path = path or s.data
    if s.source == "synthetic":
        return vector_sources.synthetic_points(spark, s.seed)
    if s.source == "image-synthetic":
        return vector_sources.synthetic_lines(spark, s.image_size, s.image_size, seed=s.seed)
    if path is None:
        raise ConfigError(f"{s.source} needs data")
    if s.source == "iris":
        return vector_sources.read_iris(spark, path)
    if s.source == "embedding-csv":
        return vector_sources.read_embedding_csv(spark, path)
    if s.source not in SOURCES:
        raise ConfigError(f"unknown source {s.source}")
    found = load_variants(spark, [s], path)
    return found.samples(s), found.dim


class Variants:
    """An image source's vectors for several image settings, from one scan of its files and one decode of each image.

    ``samples`` gives those of one of the settings, as ``load`` does. With
    more than one they are stored, so that no model or seed decodes again;
    ``close`` gives that back.
    """

    def __init__(self, rows: DataFrame, dim: DataFrame, configs: list[images.VectorConfig], root: str):
        keep = tuple(c for c in ("path", "label", "class_name", "source_name", "split") if c in rows.columns)
        self.dim, self.names = dim, {c: f"v{i}" for i, c in enumerate(dict.fromkeys(configs))}
        vectors = images.vectorize(rows, {name: c for c, name in self.names.items()}, keep)
        self.rows = vectors.withColumn("sample_id", F.xxhash64(image_sources.within("path", root)))  # the same wherever the files lie
        self.stored = len(self.names) > 1
        if self.stored:
            self.rows = kept(self.rows)

    def samples(self, s: Settings) -> DataFrame:
        own = self.names[image_config(s)]
        return self.rows.withColumnRenamed(own, "features").drop(*self.names.values())

    def close(self) -> None:
        if self.stored:
            release(self.rows)


def image_config(s: Settings) -> images.VectorConfig:
    return images.VectorConfig(s.image_size, s.image_size, s.features, s.resize)


def load_variants(spark: SparkSession, settings: list[Settings], path: str | None = None) -> Variants:
    """The vectors of an image source for all of some settings, which differ in image size, features and resize mode."""
    s = settings[0]
    path = path or s.data
    if s.source not in IMAGE_SOURCES or path is None:
        raise ConfigError(f"{s.source} has no images, or needs data")
    read = image_sources.read_image_folder if s.source == "image-folder" else image_sources.read_image_manifest
    rows, dim = read(spark, path)
    return Variants(rows, dim, [image_config(x) for x in settings], path if s.source == "image-folder" else path.rpartition("/")[0])


def split(spark: SparkSession, s: Settings, found: Variants | None = None, other: Variants | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, test, classes): a manifest's own split without shuffling, other evaluation data mapped by class name, or a seeded share. ``found`` and ``other`` hold the data, and those of evaluation, where these are loaded."""
    samples, dim = (found.samples(s), found.dim) if found else load(spark, s)
    if "split" in samples.columns and not samples.where("split = 'eval'").isEmpty():
        ordered = samples.withColumn("ord", F.col("sample_id"))
        return ordered.where("split = 'train'"), ordered.where("split = 'eval'"), dim
    samples = samples.drop("split")
    if s.eval_data:
        if s.source not in ("image-folder", "embedding-csv"):
            raise ConfigError(f"{s.source} takes no evaluation data")
        rows = other.samples(s) if other else load(spark, s, s.eval_data)[0]
        return prep.train_test_split(samples, 0.0, s.seed), prep.remap_labels(rows.drop("label"), "class_name", dim).withColumn("ord", F.col("sample_id")), dim
    both = prep.train_test_split(samples, s.test_ratio, s.seed)
    return both.where("split = 'train'"), both.where("split = 'test'"), dim


def scaled(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both parts scaled by the training part's ranges, and these."""
    ranges = prep.min_max_ranges(train)
    return prep.min_max_scale(train, ranges), prep.min_max_scale(test, ranges), ranges


def voted(s: Settings, model: str, samples: DataFrame, refs: DataFrame) -> DataFrame:
    """(query_id, predicted) of samples by a dense or a binary library."""
    queries, k = samples.select(F.col("sample_id").alias("query_id"), F.col("features").alias("vector")), max(s.top_k, 1)
    if model == "binary":
        threshold, weight = (min(max(x, 0.0), 1.0) for x in (s.threshold, s.jaccard_weight))
        return library.vote(library.top_k_bits(queries, refs, k, threshold, weight, s.blocks), "asc")
    return library.vote(library.top_k(queries, refs, k, s.metric))


def predictions(s: Settings, model: str, train: DataFrame, test: DataFrame, classes: int) -> tuple[DataFrame, int]:
    """((sample_id, expected, predicted) of the test part, bytes of the model)."""
    width = prep.check_rectangular(train)
    if model == "interval":
        fitted = IntervalModel.from_training_data(train, s.intervals, classes, distributor=TRIANGULAR, correction=Correction(s.correction))
        fitted.fit(train, s.epochs, s.epoch_mode)
        out, size = fitted.predict(test), fitted.memory_bytes()
    elif model == "centroid":
        out, size = centroid.predict_centroid(test, centroid.fit_centroids(train)), centroid.centroid_memory_bytes(classes, width)
    elif model in ("library", "binary"):
        refs = train.select(F.col("sample_id").alias("ref_id"), F.col("features").alias("vector"), "label")
        told = voted(s, model, test, refs)
        out, size = test.join(told, test["sample_id"] == told["query_id"]), library.memory_bytes(refs.count(), width, model == "binary")
    else:
        raise ConfigError(f"unknown model {model}")
    return out.select("sample_id", F.col("label").alias("expected"), F.col("predicted").cast("long").alias("predicted")), size


def evaluate(spark: SparkSession, model: str, s: Settings) -> dict:
    """Train and evaluate: accuracy, by class, confusion, times, bytes, and the settings."""
    train, test, dim = split(spark, s)
    train, test, _ = scaled(train, test)
    classes, began = dim.count(), time.time()
    train = train.persist()
    told, size = predictions(s, model, train, test, classes)
    told = told.persist()
    row = metrics.classification_metrics(told, dim).first().asDict(recursive=True)
    train.unpersist()
    told.unpersist()
    return {**row, "model": model, "memory_bytes": size, "seconds": time.time() - began, "settings": asdict(s)}


def train_artifact(spark: SparkSession, s: Settings, path: str) -> IntervalModel:
    """An interval model of all data, shuffled, with its scaling ranges and classes beside it."""
    samples, dim = load(spark, s)
    train, _, ranges = scaled(prep.train_test_split(samples, 0.0, s.seed), samples)
    model = IntervalModel.from_training_data(train, s.intervals, dim.count(), distributor=TRIANGULAR, correction=Correction(s.correction))
    model.fit(train, s.epochs, s.epoch_mode)
    model.save(spark, path, settings=asdict(s))
    ranges.write.mode("overwrite").parquet(f"{path}/ranges")
    dim.write.mode("overwrite").parquet(f"{path}/classes")
    return model


def train_library(spark: SparkSession, s: Settings, path: str) -> None:
    """A library of all data as Parquet, with its scaling ranges and classes."""
    samples, dim = load(spark, s)
    ranges = prep.min_max_ranges(samples)
    refs = prep.min_max_scale(samples, ranges).select(F.col("sample_id").alias("ref_id"), F.col("features").alias("vector"), "label")
    for name, df in (("references", refs), ("ranges", ranges), ("classes", dim)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def score_artifact(spark: SparkSession, s: Settings, path: str, kind: str = "interval") -> DataFrame:
    """Predictions of the settings' data by a saved model or library; labels are mapped by class name."""
    samples, _ = load(spark, s)
    dim = spark.read.parquet(f"{path}/classes")
    if "class_name" in samples.columns:
        samples = prep.remap_labels(samples.drop("label"), "class_name", dim)
    rows = prep.min_max_scale(samples, spark.read.parquet(f"{path}/ranges"))
    if kind == "interval":
        return IntervalModel.load(spark, path).predict(rows)
    refs = spark.read.parquet(f"{path}/references")
    told = voted(s, kind, rows, refs)
    return rows.join(told, rows["sample_id"] == told["query_id"]).drop("query_id")


def curve(spark: SparkSession, s: Settings) -> list[dict]:
    """Errors and accuracies by epoch, until the target."""
    train, test, dim = split(spark, s)
    train, test, _ = scaled(train, test)
    model = IntervalModel.from_training_data(train, s.intervals, dim.count(), distributor=TRIANGULAR, correction=Correction(s.correction))
    return learning_curve(model, train, test, s.epochs, s.target_mse)


def run_matrix(
    spark: SparkSession,
    s: Settings,
    models: list[str],
    seeds: list[int],
    intervals: list[int] | None = None,
    features: list[str] | None = None,
    resizes: list[str] | None = None,
    sizes: list[int] | None = None,
    corrections: list[str] | None = None,
) -> DataFrame:
    """Results of every combination; what isn't listed is as in the settings.

    Images are read and decoded once for all features, resize modes and
    sizes, and split once for all models. Interval counts and correction
    modes vary for the interval model alone; the others have no use for them.
    """
    rows = []
    counts, modes = intervals or [s.intervals], corrections or [s.correction]
    variants = [replace(s, features=feature, resize=resize, image_size=size) for feature, resize, size in product(features or [s.features], resizes or [s.resize], sizes or [s.image_size])]
    found = load_variants(spark, variants) if s.source in IMAGE_SOURCES else None
    other = load_variants(spark, variants, s.eval_data) if s.source == "image-folder" and s.eval_data else None
    for variant, seed in product(variants, seeds):
        own = replace(variant, seed=seed)
        train, test, dim = split(spark, own, found, other)
        train, test, _ = scaled(train, test)
        train, test, classes = train.persist(), test.persist(), dim.count()
        for model in models:
            for mode, count in product(modes, counts) if model == "interval" else [(s.correction, counts[0])]:
                cell = replace(own, intervals=count, correction=mode)
                told, _ = predictions(cell, model, train, test, classes)
                mine, _ = predictions(cell, model, train, train, classes)
                per = [r.asDict() for r in metrics.per_class_accuracy(told, dim).collect()]
                right, total = sum(p["correct"] for p in per), sum(p["total"] for p in per)
                rows.append((model, own.features, own.resize, mode, own.image_size, count, seed, metrics.accuracy(mine).first()["accuracy"], right / total if total else 0.0, per))
        train.unpersist()
        test.unpersist()
    for v in (found, other):
        if v:
            v.close()
    schema = "model string, image_features string, image_resize string, correction_mode string, image_size bigint, interval_count bigint, seed bigint, train_accuracy double, test_accuracy double, per_class array<struct<class_index: bigint, class_name: string, correct: bigint, total: bigint, accuracy: double>>"
    return matrix.row_columns(spark.createDataFrame(rows, schema))


def patch_scan(spark: SparkSession, s: Settings, path: str) -> DataFrame:
    """(path, class_name, score, threshold, predicted, expected, mask_iou, ...) of an inspection category's test images, scored against its normal training images."""
    return scan.anomaly.ordered_results(scan.run_scan(scan.load_category(spark, path), s).results)


def scan_report(spark: SparkSession, s: Settings, path: str) -> dict:
    """The measures of a patch scan, and its results; with ``debug_out`` also the files for a closer look."""
    category = scan.load_category(spark, path)
    scanned = scan.run_scan(category, s)
    if s.debug_out:
        scan.write_debug(scanned, s, s.debug_out, s.debug_limit)
    rows = [r.asDict() for r in scan.anomaly.ordered_results(scanned.results).collect()]
    return {"model": "patch-scan", "dataset": category.name, "settings": asdict(s), **scan.report(scanned), "results": rows}


def search_config(s: Settings) -> searching.SearchConfig:
    return searching.SearchConfig(s.population, s.generations, s.elite, s.mutation, s.seed).normalized()


def _searched(spark: SparkSession, s: Settings, kind: str, out: str | None, run) -> dict:
    """Run a search whose history is written after every generation, and its artifact at the end."""
    rows: list[dict] = []

    def after(history: list[dict]) -> None:
        rows[:] = history
        if out:
            sinks.write_siblings(spark, out, {"history": rows})

    found = {"version": 1, "model": kind, "seed": s.seed, "population_size": s.population, "generations": s.generations, "validation_ratio": s.validation_ratio, **run(after)}
    if out:
        sinks.write_files(spark, {out.rpartition("/")[2]: json.dumps(found).encode()}, out.rpartition("/")[0] or ".")
    return found | {"history": rows}


def search_libraries(spark: SparkSession, s: Settings, out: str | None = None) -> dict:
    """Search binary libraries over image sizes, features and resize modes: a seeded share of the training images validates, and evaluation data are used once, for the best recipe."""
    if s.source != "image-folder" or not s.data:
        raise ConfigError("a search over libraries needs an image folder")
    specs = list(product(listed(s.search_sizes, int) or [64], listed(s.search_features) or ["rich-texture"], listed(s.search_resizes) or ["center-crop"]))
    settings = [replace(s, image_size=size, features=features, resize=resize) for size, features, resize in specs]
    found = load_variants(spark, settings)
    variants, rest = [], []
    for own in settings:
        parts = prep.train_test_split(found.samples(own), s.validation_ratio, s.seed)
        train, held = parts.where("split = 'train'"), parts.where("split = 'test'")
        ranges = prep.min_max_ranges(train)
        refs = prep.min_max_scale(train, ranges).select(F.col("sample_id").alias("ref_id"), F.col("features").alias("vector"), "label").persist()
        asked = lambda rows, r=ranges: prep.min_max_scale(rows, r).select(F.col("sample_id").alias("query_id"), F.col("features").alias("vector"), F.col("label").alias("expected"))
        variants.append((asked(held).persist(), refs))
        rest.append((own, found.dim, asked))
    scored = searching.Population(variants)

    def run(after) -> dict:
        space = searching.library_space(len(specs), listed(s.search_top_ks, int))
        score = lambda g: searching.evaluate_libraries(g, scored, s.memory_penalty, s.time_penalty)
        genome, history = searching.search(space, search_config(s), score, lambda g: (specs[g["variant"]][0], g["top_k"]), after)
        queries, refs = variants[genome["variant"]]
        own, dim, asked = rest[genome["variant"]]
        judged = lambda q: metrics.classification_metrics(searching.evaluate_one(genome, q, refs).join(q.select("query_id", "expected"), "query_id"), dim).first().asDict(recursive=True)
        told_of = {"best_genome": searching.recipe_of(genome, specs), "best_fitness": history[-1]["best_fitness"], "validation_accuracy": judged(queries)["accuracy"], "eval_accuracy": None}
        if s.eval_data:
            other, _ = load(spark, own, s.eval_data)
            told = judged(asked(prep.remap_labels(other.drop("label"), "class_name", dim)))
            told_of |= {"eval_accuracy": told["accuracy"], "eval_per_class_accuracy": told["per_class_accuracy"], "eval_confusion_matrix": told["confusion_matrix"], "eval_confusion_cells": told["confusion_cells"]}
        return told_of

    try:
        return _searched(spark, s, "binary-search", out, run)
    finally:
        scored.close()
        found.close()
        for queries, refs in variants:
            queries.unpersist()
            refs.unpersist()


def search_scans(spark: SparkSession, s: Settings, path: str, out: str | None = None) -> dict:
    """Search patch scans: a seeded share of the test images, normal and anomalous alike, validates; the rest judge the best recipe once."""
    category = scan.load_category(spark, path)
    validation, holdout = scan.split_evaluation(category, s.validation_ratio, s.seed)
    validation, holdout = validation.persist(), holdout.persist()
    if validation.isEmpty():
        raise ConfigError("a search over scans needs an image that validates")
    space = searching.scan_space(
        image_size=listed(s.search_sizes, int), features=listed(s.search_features), resize=listed(s.search_resizes), patch_size=listed(s.search_patch_sizes, int), patch_stride=listed(s.search_patch_strides, int),
        max_patches=listed(s.search_max_patches, int), top_k=listed(s.search_top_ks, int), quantile=listed(s.search_quantiles, float), fraction=listed(s.search_fractions, float),
    )

    stages = scan.ScanStages(category, s.seed)
    expected = category.rows.select("image_id", "expected")
    asked, lists = validation.join(expected, "image_id"), (list(space.choices["fraction"]), list(space.choices["quantile"]))

    def tried(what):
        """What a step gives, or None where it fails; a session that has ended is an error."""
        try:
            return what()
        except Exception as e:  # noqa: BLE001  a genome that can't be scored, for whatever reason, is the worst
            if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
                raise
            warnings.warn(f"a scan failed and counts as the worst: {str(e)[:300]}", stacklevel=2)
            return None

    def measured(genome: dict) -> tuple[dict, int]:
        own = replace(s, **genome)
        scan.anomaly.check_settings(own.patch_size, own.patch_stride, own.quantile, own.fraction)
        return stages.measures(own, *lists, asked)[(float(own.fraction), float(own.quantile))], stages.scored(own)[1]

    def score(genomes: list[dict]) -> list[float]:
        began = time.time()
        tried(lambda: stages.prepare([replace(s, **g) for g in genomes]))  # where this fails, each is tried by itself
        found = [tried(lambda g=g: measured(g)) for g in genomes]
        ms, out = (time.time() - began) * 1000 / max(len(genomes), 1), []
        for g, told in zip(genomes, found):
            if told is None:
                out.append(float("-inf"))
                continue
            width = image_config(replace(s, **g)).length
            penalty = library.memory_bytes(told[1], width) / 2**20 * max(s.memory_penalty, 0.0) + ms * max(s.time_penalty, 0.0)
            out.append(searching.scan_fitness(told[0]["auroc"], told[0]["f1"], told[0]["accuracy"] or 0.0, penalty))
        return out

    def run(after) -> dict:
        order = lambda g: (g["image_size"], g["patch_size"], g["patch_stride"])
        genome, history = searching.search(space, search_config(s), score, order, after)
        found = {"best_recipe": genome, "best_fitness": history[-1]["best_fitness"]}
        for name, part in (("validation", validation), ("holdout", validation if holdout.isEmpty() else holdout)):
            told = scan.report(scan.run_scan(category, replace(s, **genome), part))
            found |= {f"{name}_{k}": told[k] for k in ("accuracy", "auroc", "f1")}
        return found

    try:
        return _searched(spark, s, "scan-search", out, run)
    finally:
        stages.close()
        validation.unpersist()
        holdout.unpersist()


def predict_one(spark: SparkSession, s: Settings, path: str, image: str, kind: str = "interval") -> dict:
    """The prediction of a saved model for one image, with all classes' scores, and the neighbours for a library; a library asked with k = 0 still looks at one."""
    found = image_sources.read_images(spark, image)
    rows = images.vectorize(found, {"features": images.VectorConfig(s.image_size, s.image_size, s.features, s.resize)}, ("path",)).withColumn("sample_id", F.lit(0).cast("long"))
    if rows.isEmpty():
        raise ConfigError(f"no image at {image}")
    rows, dim = prep.min_max_scale(rows, spark.read.parquet(f"{path}/ranges")), {r["label"]: r["class_name"] for r in spark.read.parquet(f"{path}/classes").collect()}
    if kind == "interval":
        scores = list(enumerate(IntervalModel.load(spark, path).forward(rows).first()["scores"]))
        near = []
    else:
        asked = rows.select(F.col("sample_id").alias("query_id"), F.col("features").alias("vector"))
        near = [r.asDict() for r in library.top_k(asked, spark.read.parquet(f"{path}/references"), max(s.top_k, 1), s.metric).orderBy("rank").collect()]
        sums: dict[int, float] = {}
        for n in near:
            sums[n["label"]] = sums.get(n["label"], 0.0) + n["score"]
        scores = [(c, sums.get(c, 0.0)) for c in dim]
    ranked = sorted(scores, key=lambda x: -x[1])
    best = max(scores, key=lambda x: (x[1], x[0]))[0]  # the last on ties
    told = [{"class_index": c, "class_name": dim[c], "score": v} for c, v in ranked]
    return {"model": kind, "image": image, "predicted_index": best, "predicted_label": dim[best], "scores": told, "neighbors": [n | {"class_name": dim[n["label"]]} for n in near]}


def resize_comparisons(spark: SparkSession, s: Settings, chosen: DataFrame, ranges: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(sample_id, mode, predicted): what a model says of the chosen images (sample_id, path) in each resize mode, from one decode."""
    paths = chosen.select("path").collect()
    found = image_sources.read_images(spark, [r["path"] for r in paths]).join(chosen.select("path", "sample_id"), "path")
    made = images.vectorize(found, {f"as_{i}": images.VectorConfig(s.image_size, s.image_size, s.features, mode) for i, mode in enumerate(images.RESIZE_MODES)}, ("sample_id",))
    out = None
    for i, mode in enumerate(images.RESIZE_MODES):
        rows = made.select("sample_id", F.col(f"as_{i}").alias("features"), F.lit(0).cast("long").alias("label"))
        own = judge(prep.min_max_scale(rows, ranges)).select("sample_id", F.lit(mode).alias("mode"), "predicted")
        out = own if out is None else out.union(own)
    return out


def debug_train_data(s: Settings) -> str | None:
    """Where the training data of evaluated ones are: the settings' own where evaluation data are given, else the parent of a folder of evaluation data; None if neither tells."""
    if s.eval_data:
        return s.data
    parent, _, name = (s.data or "").rstrip("/").rpartition("/")
    return parent if parent and name.lower() in image_sources.EVAL_FOLDERS else None


@dataclass
class Judged:
    """What a closer look at mistakes starts from: scaled references and samples, the ranges they were scaled by, the classes, and what judges scaled rows."""

    train: DataFrame
    test: DataFrame
    ranges: DataFrame
    dim: DataFrame
    judge: Callable[[DataFrame], DataFrame]


def judged(spark: SparkSession, s: Settings, model: str, artifact: str | None = None) -> Judged:
    """A model trained on the settings' data, or a saved one with its own ranges and classes.

    The references of a saved library are its own; those of a saved interval
    model are the training data, which ``debug_train_data`` finds.
    """
    if artifact is None:
        train, test, dim = split(spark, s)
        train, test, ranges = scaled(train, test)
        classes = dim.count()
        return Judged(train, test, ranges, dim, lambda rows: predictions(s, model, train, rows, classes)[0])
    dim, ranges = (spark.read.parquet(f"{artifact}/{name}") for name in ("classes", "ranges"))
    mapped = lambda rows: prep.min_max_scale(prep.remap_labels(rows.drop("label"), "class_name", dim) if "class_name" in rows.columns else rows, ranges)
    test = mapped(load(spark, s, s.eval_data or s.data)[0])
    told = lambda rows: rows.select("sample_id", F.col("label").alias("expected"), F.col("predicted").cast("long").alias("predicted"))
    if model == "interval":
        where = debug_train_data(s)
        if where is None:
            raise ConfigError("a saved interval model needs its training data for a closer look: give them as data, and what is judged as eval-data")
        fitted = IntervalModel.load(spark, artifact)
        return Judged(mapped(load(spark, s, where)[0]), test, ranges, dim, lambda rows: told(fitted.predict(rows)))
    refs = spark.read.parquet(f"{artifact}/references")

    def by_library(rows: DataFrame) -> DataFrame:
        votes = voted(s, model, rows, refs)
        return told(rows.join(votes, rows["sample_id"] == votes["query_id"]))

    return Judged(refs.select(F.col("ref_id").alias("sample_id"), F.col("vector").alias("features"), "label"), test, ranges, dim, by_library)


def plain_neighbours(asked: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, ref_id, label, distance): the stored vectors at the least Euclidean distance, whatever metric a model has."""
    near = library.top_k(asked, refs, k, "euclidean").drop("score", "rank")
    with_both = near.join(asked.select("query_id", F.col("vector").alias("__q")), "query_id").join(refs.select("ref_id", F.col("vector").alias("__r")), "ref_id")
    rows = with_both.withColumn("distance", F.sqrt(squared_distance(F.col("__q").cast("array<double>"), F.col("__r").cast("array<double>"))))
    order = Window.partitionBy("query_id").orderBy("distance", "ref_id")
    return rows.select("query_id", F.row_number().over(order).alias("rank"), "ref_id", "label", "distance")


def debug_bundle(spark: SparkSession, s: Settings, model: str, path: str, artifact: str | None = None) -> list[str]:
    """Everything for a closer look at a model's mistakes, below a path; returns the failure analysis' sentences. ``artifact`` is a saved model to look at instead of a new one.

    Settings, metrics by class, predictions with margins, failure analysis by
    buckets of image properties; of a few samples the images on the way to
    the vector, the vector, and how other resize modes would be judged.
    """
    own = judged(spark, s, model, artifact)
    test, ranges, dim, classes, train = own.test, own.ranges, own.dim, own.dim.count(), own.train.persist()
    told = own.judge(test)
    refs = train.select(F.col("sample_id").alias("ref_id"), F.col("features").alias("vector"), "label")
    asked = test.select(F.col("sample_id").alias("query_id"), F.col("features").alias("vector"))
    near = library.top_k(asked, refs, max(s.top_k, 1), s.metric)
    margin = library.margins(near).select(F.col("query_id").alias("sample_id"), "score_margin")
    names = [c for c in ("path", "class_name") if c in test.columns]
    rows = told.join(margin, "sample_id", "left").join(test.select("sample_id", *names), "sample_id").withColumns({"correct": F.col("expected") == F.col("predicted"), "score_margin": F.coalesce("score_margin", F.lit(0.0))}).persist()
    per, cells = metrics.per_class_accuracy(rows, dim), metrics.confusion_cells(rows)
    common = metrics.most_common_confusion(cells)
    said = failures.findings(metrics.worst_class(per), common, failures.confidence_summary(rows))
    frames = {"predictions": rows, "per_class": per, "confusion": metrics.confusion(rows, dim) if classes <= metrics.DENSE_CLASSES else cells, "high_confidence_wrong": failures.ranked_wrong(rows, True), "ambiguous_wrong": failures.ranked_wrong(rows, False)}
    files = {"config.json": json.dumps(asdict(s)), "failure_analysis.json": json.dumps(said), "metrics.json": json.dumps(metrics.classification_metrics(rows, dim).first().asDict(recursive=True))}
    page = []
    if "path" in names:
        found = image_sources.read_images(spark, s.eval_data or s.data)
        stats = images.stats(found).join(rows.select("path", "sample_id", "correct"), "path")
        frames["buckets"] = failures.bucket_summaries(stats, {"brightness": failures.brightness_bucket(F.col("brightness")), "contrast": failures.contrast_bucket(F.col("contrast")), "orientation": failures.orientation_bucket(F.col("aspect")), "crop_loss": failures.crop_loss_bucket(F.col("crop_loss"))})
        chosen = failures.select_samples(rows, s.debug_samples, s.debug_limit).join(rows, "sample_id").join(test.select("sample_id", "features"), "sample_id").orderBy("place").collect()
        if chosen:
            some = spark.createDataFrame([(r["sample_id"], r["path"]) for r in chosen], "sample_id bigint, path string")
            compared = resize_comparisons(spark, s, some, ranges, own.judge)
            frames |= {"resize_comparisons": compared, "resize_disagreements": failures.resize_disagreements(compared, rows)}
            pictures = {r["path"]: r["image"] for r in image_sources.read_images(spark, [r["path"] for r in chosen]).collect()}
            config = image_config(s)
            closest: dict[int, list] = {}
            looked_at = asked.join(some.select(F.col("sample_id").alias("query_id")), "query_id", "left_semi")
            for n in plain_neighbours(looked_at, refs, max(s.top_k, 1)).orderBy("query_id", "rank").collect():
                closest.setdefault(n["query_id"], []).append({"ref_id": n["ref_id"], "label": n["label"], "distance": n["distance"]})
            for r in chosen:
                name = f"{r['place']:03d}-{sinks.safe_name(r['path'].rpartition('/')[2].rpartition('.')[0])}"
                m = pictures[r["path"]]
                for step, picture in images.processing_steps(images.decode_row(m["data"], m["height"], m["width"], m["nChannels"]), config):
                    files[f"samples/{name}/{step}.png"] = images.encode_png(picture)
                files[f"samples/{name}/features.csv"] = sinks.csv_text([{"feature": i, "value": v} for i, v in enumerate(r["features"])])
                files[f"samples/{name}/neighbors.json"] = json.dumps(closest.get(r["sample_id"], []))
                page.append({"sample": name, "path": r["path"], "expected": r["expected"], "predicted": r["predicted"], "margin": r["score_margin"]})
    files["index.html"] = sinks.index_html(f"{model} on {s.source}", page)
    sinks.write_bundle(frames, path, "overwrite")
    sinks.write_files(spark, {k: v if isinstance(v, bytes) else v.encode() for k, v in files.items()}, path)
    train.unpersist()
    rows.unpersist()
    return said


def demo(spark: SparkSession) -> int:
    """The smallest example: four points of two classes, one query."""
    points = [(0, [0.1, 0.1], 0), (1, [0.2, 0.2], 0), (2, [0.8, 0.8], 1), (3, [0.9, 0.9], 1)]
    refs = spark.createDataFrame(points, "ref_id bigint, vector array<double>, label bigint")
    query = spark.createDataFrame([(0, np.array([0.85, 0.85]).tolist())], "query_id bigint, vector array<double>")
    return library.Library(refs).predict(query, 3).first()["predicted"]
