from __future__ import annotations

import itertools
import json
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine.errors import ConfigError
from tesserine import __main__ as cli
from tesserine.operators import images
from tesserine.plans import commands, crops, matrix, scan, search
from tesserine.sources import images as image_sources
from tests.test_rest import png


def test_layers():
    s, origin = commands.layered({"epochs": 3}, '{"top-k": 5, "epochs": 1}', '{"top_k": 7, "fitness": 1}')
    assert (s.epochs, s.top_k) == (3, 7) and origin["epochs"] == "call" and origin["top_k"] == "search" and origin["seed"] == "default"
    with pytest.raises(ConfigError):
        commands.layered({}, '{"nothing": 1}')


def test_search_result_is_used_whole(spark, tmp_path):
    found = {"best_genome": {"image_size": 24, "image_features": "hog", "image_resize": "letterbox", "threshold": 0.3, "similarity": "blended", "jaccard_weight": 0.25, "top_k": 5, "active_blocks": "0x7e57", "active_block_count": 11}, "best_fitness": 0.8}
    s, origin = commands.layered({}, None, json.dumps(found))
    assert (s.image_size, s.features, s.resize, s.threshold, s.jaccard_weight, s.top_k, s.blocks) == (24, "hog", "letterbox", 0.3, 0.25, 5, 0x7E57) and origin["blocks"] == "search"
    genome = {"variant": 0, "top_k": 1, "threshold": 0.3, "jaccard_weight": 0.25, "blocks": 0x00FF, "generation": 1, "best_fitness": 0.5}
    s, _ = commands.layered({}, None, json.dumps(genome))
    for unknown in ({"tresholt": 0.3}, {"variant": 1}):
        with pytest.raises(ConfigError):
            commands.layered({}, None, json.dumps(unknown))
    s = replace(s, source="image-synthetic", image_size=8)
    train, test, dim = commands.split(spark, s)
    train, test, _ = commands.scaled(train, test)
    told, size = commands.predictions(s, "binary", train, test, dim.count())
    refs = train.select(F.col("sample_id").alias("ref_id"), F.col("features").alias("vector"), "label")
    want = search.evaluate_one(genome, test.select(F.col("sample_id").alias("query_id"), F.col("features").alias("vector")), refs)
    assert {r[0]: r[2] for r in told.collect()} == {r[0]: r[1] for r in want.collect()} and size == 8 * train.count()
    commands.train_library(spark, s, str(tmp_path / "b"))
    assert commands.score_artifact(spark, s, str(tmp_path / "b"), "binary").where("predicted = label").count() > 0


@pytest.mark.parametrize("model", commands.MODELS)
def test_evaluate(spark, model):
    out = commands.evaluate(spark, model, commands.Settings(epochs=2))
    assert out["accuracy"] >= 0.9 and len(out["per_class_accuracy"]) == 3


def test_artifact_curve_matrix(spark, tmp_path):
    s = commands.Settings(epochs=2)
    commands.train_artifact(spark, s, str(tmp_path / "a"))
    commands.train_library(spark, s, str(tmp_path / "l"))
    for kind, path in (("interval", "a"), ("library", "l")):
        told = commands.score_artifact(spark, s, str(tmp_path / path), kind)
        assert told.where("label = predicted").count() >= 0.9 * told.count()
    assert len(commands.curve(spark, s)) == 2
    assert matrix.summarize(commands.run_matrix(spark, s, ["library", "centroid"], [1, 2])).count() == 2
    assert commands.demo(spark) == 1


def test_matrix_varies_all_settings_and_reports_rows(spark, tmp_path, monkeypatch):
    for name, first in (("a", 20), ("b", 200)):
        for i in range(5):
            png(tmp_path / f"in/{name}/{i}.png", first + i, 8)
    s = commands.Settings(source="image-folder", data=str(tmp_path / "in"), epochs=1, image_size=4)
    rows = commands.run_matrix(spark, s, ["centroid"], [1], None, ["pixels", "color"], ["stretch", "center-crop"], [4, 6], ["least-squares", "ratio"])
    got = [tuple(r) for r in rows.select("image_features", "image_resize", "image_size", "correction_mode").collect()]
    assert sorted(got) == sorted((f, r, n, "least-squares") for f in ("pixels", "color") for r in ("stretch", "center-crop") for n in (4, 6))
    call = ["matrix", "--source", "synthetic", "--epochs", "1", "--seed", "7", "--matrix-models", "interval,centroid", "--matrix-intervals", "4,8", "--matrix-correction-modes", "least-squares,ratio"]
    monkeypatch.setattr(cli, "get_session", lambda: spark)
    cli.main([*call, "--matrix-top", "2", "--out", str(tmp_path / "out")])
    rows, summaries, top = (spark.read.json(str(tmp_path / "out" / part)) for part in ("rows", "summaries", "top_rows"))
    cells = {(r.model, r.correction_mode, r.interval_count, r.seed) for r in rows.collect()}
    assert cells == {("interval", m, n, 7) for m in ("least-squares", "ratio") for n in (4, 8)} | {("centroid", "least-squares", 4, 7)}
    assert rows.count() == summaries.count() == 5 and top.count() == 2


def picture(path, pixels):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(images.encode_png(np.ascontiguousarray(pixels, dtype=np.uint8)))


def category(root, defects=3, goods=3):
    """Eight normal images of noise between 60 and 120, good ones, and defects that have dark and bright spots within that range's neighbourhood turned about, with masks."""
    rng = np.random.default_rng(5)
    normal = lambda: np.repeat(rng.integers(95, 100, (8, 8, 1)) + np.arange(8)[None, :, None] * 4, 3, axis=2)
    for i in range(8):
        picture(root / f"train/good/{i}.png", normal())
    for i in range(goods):
        picture(root / f"test/good/g{i}.png", normal())
    for i in range(defects):
        bad = normal()
        bad[0:4, 0:4] = bad[0:4, 0:4][:, ::-1] + 12  # within the references' range, but turned
        picture(root / f"test/cut/{i}.png", bad)
        mask = np.zeros((8, 8, 3))
        mask[0:4, 0:4] = 255
        picture(root / f"ground_truth/cut/{i}_mask.png", mask)
    return str(root)


SCAN = commands.Settings(patch_size=4, patch_stride=4, image_size=4, fraction=0.25, metric="euclidean", quantile=1.0)


def test_patch_scan(spark, tmp_path):
    """Verdicts, masks and measures; the same wherever the files lie."""
    seen = []
    for place in ("a", "b/deep", "c with blanks"):
        root = category(tmp_path / place)
        rows = commands.patch_scan(spark, SCAN, root).collect()
        seen.append(sorted((r.path.rpartition("/")[2], r.score, r.threshold, r.predicted, r.mask_iou) for r in rows))
        assert {r.source_name: r.expected for r in rows} == {"good": False, "cut": True}
        assert all(r.predicted and r.mask_iou == 1.0 for r in rows if r.expected) and all(r.mask_iou is None for r in rows if not r.expected)
    assert seen[0] == seen[1] == seen[2]
    told = commands.scan_report(spark, replace(SCAN, debug_out=str(tmp_path / "debug"), debug_limit=2), root)
    assert told["anomaly_recall"] == told["auroc"] == told["mask_patch_auroc"] == told["mask_iou_mean"] == 1.0
    assert (told["reference_images"], told["calibration_images"], told["eval_images"], told["anomaly_eval_images"]) == (6, 2, 6, 3)
    assert (told["mask_patch_count"], told["mask_positive_patch_count"], told["reference_patches"]) == (24, 3, 24)
    made = sorted(p.relative_to(tmp_path / "debug").as_posix() for p in (tmp_path / "debug").rglob("*.png"))
    assert len(made) == 6 and (tmp_path / "debug/index.html").exists()
    assert spark.read.csv(str(tmp_path / "debug/patch_scan_patches"), header=True).count() == 24


def test_scan_of_few_images(spark, tmp_path):
    """One normal image is both library and calibration; a manifest does as well, and a defect without a mask can't be told by patches."""
    root = category(tmp_path / "x", 1, 1)
    for i in range(1, 8):
        (tmp_path / f"x/train/good/{i}.png").unlink()
    (tmp_path / "x/ground_truth/cut/0_mask.png").unlink()
    manifest = {"name": "few", "train": {"normal": "train/good"}, "eval": {"normal": "test/good", "cut": ["test/cut"]}}
    (tmp_path / "x/manifest.json").write_text(json.dumps(manifest))
    told = commands.scan_report(spark, SCAN, root)
    assert (told["reference_images"], told["calibration_images"], told["threshold"]) == (1, 1, 0.0)
    assert told["mask_iou_mean"] is None and told["mask_patch_count"] == 4 and told["mask_positive_patch_count"] == 0
    other = commands.scan_report(spark, SCAN, f"{root}/manifest.json")
    assert other["dataset"] == "few" and [r["score"] for r in other["results"]] == [r["score"] for r in told["results"]]


def test_search_of_scans(spark, tmp_path):
    root = category(tmp_path / "x", 4, 4)
    s = replace(SCAN, population=3, generations=2, elite=1, validation_ratio=0.5, search_sizes="4", search_features="pixels", search_resizes="stretch", search_patch_sizes="4,8", search_patch_strides="4", search_fractions="0.25,1.0", search_quantiles="1.0")
    found = commands.search_scans(spark, s, root, str(tmp_path / "out/best.json"))
    saved = json.loads((tmp_path / "out/best.json").read_text())
    assert saved["best_recipe"] == found["best_recipe"] and saved["model"] == "scan-search"
    history = (tmp_path / "out/best.history.csv").read_text().splitlines()
    assert len(history) == 3 and [h["generation"] for h in found["history"]] == [0, 1]
    fits = [h["best_fitness"] for h in found["history"]]
    assert fits == sorted(fits) and found["best_fitness"] == fits[-1]
    used, origin = commands.layered({}, None, json.dumps(saved))
    assert used.patch_size == found["best_recipe"]["patch_size"] and origin["fraction"] == "search"
    # The best recipe's fitness, taken again by itself.
    cat = scan.load_category(spark, root)
    validation, holdout = scan.split_evaluation(cat, 0.5, s.seed)
    assert validation.count() == holdout.count() == 4 and validation.join(holdout, "image_id").count() == 0
    told = scan.report(scan.run_scan(cat, replace(s, **found["best_recipe"]), validation))
    assert found["best_fitness"] == pytest.approx(0.65 * told["auroc"] + 0.25 * told["f1"] + 0.1 * told["accuracy"])
    few = scan.split_evaluation(scan.load_category(spark, category(tmp_path / "y", 1, 1)), 0.5, 1)
    assert (few[0].count(), few[1].count()) == (2, 0)


def test_scan_space():
    space = search.scan_space(patch_size=[0, 8, 8], quantile=[2.0, -1.0], fraction=[0.0], top_k=[0])
    assert space.choices["patch_size"] == (8,) and space.choices["quantile"] == (1.0, 0.0) and space.choices["fraction"] == (0.01,) and space.choices["top_k"] == (1,)
    rng = random.Random(3)
    space = search.scan_space(patch_size=[4, 8], top_k=[1, 3])
    genome = search.random_genome(space, rng)
    for _ in range(100):
        genome = search.mutate(search.crossover(genome, search.random_genome(space, rng), rng), space, 1.0, rng)
        assert all(genome[k] in v for k, v in space.choices.items())


def folders(root, parts):
    rng = np.random.default_rng(2)
    for part, n in parts.items():
        for name, base in (("dark", 40), ("light", 160)):
            for i in range(n):
                picture(root / f"{part}/{name}/{i}.png", np.repeat(rng.integers(base, base + 40, (6, 9, 1)), 3, axis=2))
    return str(root)


def test_search_of_libraries(spark, tmp_path):
    root = folders(tmp_path, {"train": 8, "eval": 3})
    s = commands.Settings(source="image-folder", data=f"{root}/train", eval_data=f"{root}/eval", population=4, generations=2, elite=1, validation_ratio=0.25, search_sizes="4,6", search_features="pixels", search_resizes="stretch,center-crop", search_top_ks="1,3")
    found = commands.search_libraries(spark, s, str(tmp_path / "lib.json"))
    assert found["eval_accuracy"] == 1.0 and found["best_genome"]["image_size"] in (4, 6) and len(found["history"]) == 2
    assert found["eval_confusion_matrix"][0]["predicted_counts"] == [3, 0]
    saved = (tmp_path / "lib.json").read_text()
    used, _ = commands.layered({"source": "image-folder", "data": s.data, "eval_data": s.eval_data}, None, saved)
    assert used.image_size == found["best_genome"]["image_size"] and commands.evaluate(spark, "binary", used)["accuracy"] == 1.0
    assert (tmp_path / "lib.history.csv").exists()
    with pytest.raises(ConfigError):
        commands.layered({}, None, json.dumps({"model": "interval"}))


def test_debug_bundle_and_single_predictions(spark, tmp_path):
    root = folders(tmp_path, {"train": 6, "eval": 2})
    s = commands.Settings(source="image-folder", data=f"{root}/train", eval_data=f"{root}/eval", image_size=4, epochs=1, debug_samples="all", debug_limit=3)
    said = commands.debug_bundle(spark, s, "library", str(tmp_path / "bundle"))
    assert any("high-confidence" in x for x in said)
    read = lambda name: spark.read.parquet(str(tmp_path / "bundle" / name))
    assert read("predictions").count() == 4 and read("resize_comparisons").count() == 12
    assert {r.bucket_group for r in read("buckets").collect()} == {"brightness", "contrast", "orientation", "crop_loss"}
    assert len(list((tmp_path / "bundle/samples").iterdir())) == 3 and len(list((tmp_path / "bundle").rglob("features.csv"))) == 3
    for kind, train in (("interval", commands.train_artifact), ("library", commands.train_library)):
        train(spark, s, str(tmp_path / kind))
        told = commands.predict_one(spark, replace(s, top_k=0), str(tmp_path / kind), f"{root}/eval/light/0.png", kind)
        assert told["predicted_label"] == "light" and len(told["scores"]) == 2
        assert len(told["neighbors"]) == (0 if kind == "interval" else 1)


def test_lists_in_settings(tmp_path):
    s, _ = commands.layered({}, json.dumps({"matrix-seeds": [1, 2], "search_sizes": "8, 16", "matrix_models": ["library"]}))
    assert commands.listed(s.matrix_seeds, int) == [1, 2] and commands.listed(s.search_sizes, int) == [8, 16] and commands.listed(s.matrix_models) == ["library"]


def test_crops(spark, tmp_path):
    rng = np.random.default_rng(4)
    made = {}
    for name in ("cat/a.png", "cat/deep/b.png", "dog/c.png", "Eval/d.png"):
        made[name] = rng.integers(0, 255, (20, 30, 3))
        picture(tmp_path / "in" / name, made[name])
    (tmp_path / "in/dog/broken.png").write_bytes(b"no image")
    rows = [("cat/a.png", 1, "Cat", 0.9, [10.0, 5.0, 20.0, 12.0]), ("cat/a.png", 2, "dog", 0.95, [0.0, 0.0, 4.0, 4.0]), ("dog/c.png", 3, "cat", 0.5, [1.0, 1.0, 5.0, 5.0])]
    found = spark.createDataFrame(rows, "path string, detection_id bigint, label string, score double, box array<double>")
    s = crops.CropSettings(match_source_class=True, expand=0.0, background="solid", pad_color=crops.parse_color("1, 2,3"))
    totals = crops.crop_dataset(spark, str(tmp_path / "in"), found, str(tmp_path / "out"), s)
    assert totals["images_seen"] == 3 and totals["crops_written"] == 1 and totals["skipped_no_detection"] == 2 and totals["skipped_unreadable"] == 1
    assert totals["source_class_counts"] == {"cat": 2, "dog": 1} and totals["detection_label_counts"] == {"cat": 1}
    record = json.loads(next((tmp_path / "out/crop_manifest.jsonl").glob("part-*")).read_text().splitlines()[0])
    assert record["crop_box_xyxy"] == [10.0, 3.5, 20.0, 13.5] and record["detection_label"] == "cat"
    png = spark.read.parquet(str(tmp_path / "out/crops")).first().png
    picture_of = tmp_path / "one/x.png"
    picture_of.parent.mkdir()
    picture_of.write_bytes(png)
    m = image_sources.read_images(spark, str(picture_of)).first().image
    got = images.decode_row(m.data, m.height, m.width, m.nChannels)
    want = np.zeros((10, 10, 3), int) + [1, 2, 3]
    want[2:8] = made["cat/a.png"][6:12, 10:20]  # the box, rounded to even, within rows 4 to 14
    assert got.shape == (10, 10, 3) and (got == want).all()
    with pytest.raises(ConfigError):
        crops.crop_dataset(spark, str(tmp_path / "in"), found, str(tmp_path / "out"), s)
    assert crops.crop_dataset(spark, str(tmp_path / "in"), found, str(tmp_path / "out"), replace(s, overwrite=True, background="blur", output_size=6, match_source_class=False))["crops_written"] == 2


def test_thousands_of_classes(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_text("a,b,label\n" + "".join(f"{i % 55 + 0.01 * k},{i // 55},c{i:04d}\n" for i in range(3000) for k in range(3)))
    told = commands.evaluate(spark, "centroid", commands.Settings(source="embedding-csv", data=str(path), test_ratio=0.3))
    assert len(told["per_class_accuracy"]) == 3000 and told["accuracy"] > 0.9 and told["confusion_matrix"] is None
    assert sum(c["n"] for c in told["confusion_cells"]) == told["total"] and told["correct"] == sum(c["n"] for c in told["confusion_cells"] if c["actual_index"] == c["predicted_index"])


def test_stages_of_a_scan_search(spark, tmp_path, monkeypatch):
    """Every genome's fitness as a scan by itself gives it; patches are made once for each grid and image config, in one pass a generation; what fails is the worst."""
    root = category(tmp_path / "x", 4, 4)
    cat = scan.load_category(spark, root)
    validation, _ = scan.split_evaluation(cat, 0.5, 1)
    asked = validation.join(cat.rows.select("image_id", "expected"), "image_id")
    stages, passes, true = scan.ScanStages(cat, 1), [], images.vectorize_patch_sets
    monkeypatch.setattr(images, "vectorize_patch_sets", lambda rows, specs, keep: passes.append(len(specs)) or true(rows, specs, keep))
    settings = [replace(SCAN, seed=1, patch_size=p, max_patches=m, fraction=f, quantile=q) for p in (4, 8) for m in (0, 5) for f in (0.25,) for q in (0.5, 1.0)]
    stages.prepare(settings)
    assert passes == [2]
    found = [stages.measures(x, [0.25, 1.0], [0.5, 1.0], asked)[(x.fraction, x.quantile)] for x in settings]
    assert passes == [2] and len(stages._scored) == 4
    for x, told in [*zip(settings, found)][::5]:
        alone = scan.report(scan.run_scan(cat, x, validation))
        assert all(told[k] == pytest.approx(alone[k]) for k in ("threshold", "accuracy", "auroc", "f1"))
    stages.close()


def test_a_genome_that_fails_is_the_worst(spark, tmp_path, monkeypatch):
    root, true = category(tmp_path / "x", 4, 4), images.vectorize_patch_sets

    def failing(rows, specs, keep):
        if any(patch == 8 for _, patch, _ in specs):
            raise RuntimeError("a lost executor")
        return true(rows, specs, keep)

    monkeypatch.setattr(images, "vectorize_patch_sets", failing)
    s = replace(SCAN, population=6, generations=1, elite=1, validation_ratio=0.5, search_sizes="4", search_features="pixels", search_resizes="stretch", search_patch_sizes="4,8", search_patch_strides="4", search_fractions="0.25", search_quantiles="1.0")
    with pytest.warns(UserWarning, match="counts as the worst"):
        found = commands.search_scans(spark, s, root)
    assert found["best_recipe"]["patch_size"] == 4 and found["best_fitness"] > 0


def test_a_matrix_decodes_once(spark, tmp_path, monkeypatch):
    root = folders(tmp_path, {"train": 5, "eval": 2})
    s = commands.Settings(source="image-folder", data=f"{root}/train", eval_data=f"{root}/eval")
    cells = (["pixels", "combined", "rich"], ["stretch", "letterbox"], [4, 6])
    alone = {}
    for feature, resize, size in itertools.product(*cells):
        for r in commands.run_matrix(spark, s, ["centroid"], [1], None, [feature], [resize], [size]).collect():
            alone[feature, resize, size] = (r.train_accuracy, r.test_accuracy)
        if len(alone) == 2:
            break
    reads, true = [], image_sources.read_images
    monkeypatch.setattr(image_sources, "read_images", lambda *a, **k: reads.append(a[1]) or true(*a, **k))
    rows = commands.run_matrix(spark, s, ["centroid"], [1], None, *cells).collect()
    assert len(rows) == 12 and reads == [f"{root}/train", f"{root}/eval"]
    told = {(r.image_features, r.image_resize, r.image_size): (r.train_accuracy, r.test_accuracy) for r in rows}
    assert all(told[k] == v for k, v in alone.items())


def test_modes_that_share_parts_are_the_same():
    rng = np.random.default_rng(8)
    picture_ = rng.integers(0, 255, (30, 41, 3)).astype(np.uint8)
    configs = [images.VectorConfig(w, 12, f, r, i) for w in (12, 16) for f in images.FEATURE_MODES for r in images.RESIZE_MODES for i in (False, True)]
    for c, v in zip(configs, images.image_vectors(picture_, configs)):
        assert np.array_equal(v, images.image_vector(picture_, c)) and len(v) == c.length


def test_a_closer_look_at_saved_models(spark, tmp_path):
    """References of a saved library are its own, those of an interval model lie beside the evaluated folder; distances are plain whatever the metric."""
    root = folders(tmp_path, {".": 5, "Eval": 2})
    s = commands.Settings(source="image-folder", data=root, image_size=4, epochs=1, metric="cosine")
    looked = replace(s, data=f"{root}/Eval", debug_samples="all", debug_limit=2, top_k=2)
    assert commands.debug_train_data(looked) == root and commands.debug_train_data(s) is None and commands.debug_train_data(replace(s, eval_data="x")) == root
    for kind, train in (("interval", commands.train_artifact), ("library", commands.train_library)):
        train(spark, s, str(tmp_path / f"m/{kind}"))
        commands.debug_bundle(spark, looked, kind, str(tmp_path / f"b/{kind}"), str(tmp_path / f"m/{kind}"))
        assert spark.read.parquet(str(tmp_path / f"b/{kind}/predictions")).count() == 4
        assert spark.read.parquet(str(tmp_path / f"b/{kind}/resize_comparisons")).count() == 8
        near = [json.loads(p.read_text()) for p in (tmp_path / f"b/{kind}/samples").rglob("neighbors.json")]
        assert len(near) == 2 and all(len(n) == 2 and 0 <= n[0]["distance"] <= n[1]["distance"] for n in near)
    with pytest.raises(ConfigError):
        commands.debug_bundle(spark, s, "interval", str(tmp_path / "x"), str(tmp_path / "m/interval"))


def test_reports_go_to_both_places(spark, tmp_path):
    base = ["--source", "synthetic", "--epochs", "1", "--out", str(tmp_path / "out"), "--report-out", str(tmp_path / "report")]
    for call in (["evaluate", "--model", "centroid"], ["curve"]):
        cli.main([*call, *[x.replace(str(tmp_path), str(tmp_path / call[0])) for x in base]])
        out, report = (spark.read.json(str(tmp_path / call[0] / x)) for x in ("out", "report"))
        assert out.count() == report.count() == 1
    cli.main(["train", "--model", "library", "--source", "synthetic", "--artifact", str(tmp_path / "m"), "--report-out", str(tmp_path / "trained")])
    assert spark.read.json(str(tmp_path / "trained")).count() == 1
