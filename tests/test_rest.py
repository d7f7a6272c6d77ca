"""Preprocessing, images, scans, boxes, search, grids, sources, sinks."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine.errors import ConfigError, UnknownClassError
from tesserine.functions import bits as B
from tesserine.functions import vectors as V
from tesserine.operators import anomaly, boxes, images, metrics, prep, ranking
from tesserine.plans import matrix, search
from tesserine.sources import images as image_sources
from tesserine.sources import sinks
from tesserine.sources import vectors as sources


def vec(spark, rows):
    return spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(rows)], "sample_id bigint, features array<double>")


def test_scaling(spark):
    df = vec(spark, [(2, 10), (4, 20), (float("nan"), 15)])
    out = [r.features for r in prep.min_max_scale(df, prep.min_max_ranges(df)).orderBy("sample_id").collect()]
    assert out == [[0.0, 0.0], [1.0, 1.0], [0.0, 0.5]]


@pytest.mark.parametrize("one_task", [1 << 20, 10])
def test_nearest_rank(spark, monkeypatch, one_task):
    monkeypatch.setattr(ranking, "ONE_TASK", one_task)  # beyond it, values are dealt into ranges
    df = spark.createDataFrame([(1, float(x)) for x in (1, 2, 3, 4)], "g int, v double")
    assert ranking.nearest_ranks(df, "g", "v", [0.5]).first().value == 3.0
    rng = random.Random(1)
    rows = [(g, rng.choice([rng.random(), 0.5])) for g in (0, 1) for _ in range(3000)]
    qs = [0.0, 0.1, 0.37, 0.5, 0.95, 1.0]
    got = {(r.g, r.q): r.value for r in ranking.nearest_ranks(spark.createDataFrame(rows, "g int, v double"), "g", "v", qs).collect()}
    for g in (0, 1):
        s = sorted(v for h, v in rows if h == g)
        assert all(got[g, q] == s[int((len(s) - 1) * q + 0.5)] for q in qs)
    odd = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, None), (2, 5.0), (2, 5.0)], "g int, v double")
    assert sorted(map(tuple, ranking.nearest_ranks(odd, "g", "v", [0.0, 1.0]).collect()), key=str) == [(2, 0.0, 5.0), (2, 1.0, 5.0), (None, 0.0, 1.0), (None, 1.0, 3.0)]
    assert ranking.nearest_ranks(odd.limit(0), "g", "v", [0.5]).count() == 0


def test_split(spark):
    df = vec(spark, [(i,) for i in range(50)])
    a = prep.train_test_split(df, 0.3, 1).select("sample_id", "split", "ord").collect()
    assert sum(r.split == "test" for r in a) == 15 and sorted(r.ord for r in a) == list(range(50))
    assert sorted(a) == sorted(prep.train_test_split(df, 0.3, 1).select("sample_id", "split", "ord").collect())
    assert [r.ord for r in sorted(a)] != list(range(50))


def test_labels(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b")], "i int, n string")
    dim = prep.label_dim(df, "n", "i")
    assert {r.class_name: r.label for r in dim.collect()} == {"b": 0, "a": 1}
    with pytest.raises(UnknownClassError):
        prep.remap_labels(spark.createDataFrame([("z",)], "n string"), "n", dim)


def test_argmax_takes_the_last(spark):
    df = vec(spark, [(1, 3, 3), (2, 1, 0)])
    assert [r[0] for r in df.orderBy("sample_id").select(V.argmax_last(F.col("features"))).collect()] == [2, 0]


def test_packed_bits(spark):
    df = vec(spark, [[float(i % 3 == 0) for i in range(70)]]).select(B.pack(F.col("features"), 0.5).alias("w"))
    words = df.first().w
    assert len(words) == 2 and all((words[i // 64] >> i % 64 & 1) == (i % 3 == 0) for i in range(70))
    assert B.block_mask_words(16, 0b11) == [3] and B.format_blocks(0) == "0xffff" and B.similarity_name(0.5) == "hamming_jaccard_blend"


def test_auroc(spark):
    frame = lambda rows: spark.createDataFrame(rows, "score double, expected boolean")
    assert metrics.auroc(frame([(0.9, True), (0.1, False), (0.5, True), (0.5, False)])).first().auroc == pytest.approx(0.875)
    assert metrics.auroc(frame([(0.9, True)])).first().auroc == 0.0


@pytest.mark.parametrize("mode,length", [("combined", 184), ("rich", 476), ("rich-spatial", 860), ("rich-normalized", 866), ("rich-hog", 1154), ("rich-texture", 1410), ("rich-edge", 1458), ("rich-layout", 1426), ("color", 24), ("hog", 128), ("pixels", 64)])
def test_feature_lengths(mode, length):
    image = np.random.default_rng(0).integers(0, 255, (11, 9, 3), dtype=np.uint8)
    config = images.VectorConfig(8, 8, mode)
    assert len(images.image_vector(image, config)) == config.length == length
    assert len(images.gray_vector(image[:8, :8, 0] / 255.0, config)) == length


def test_letterbox_and_stretch():
    white = np.full((2, 4, 3), 255, np.uint8)
    boxed = images.image_vector(white, images.VectorConfig(4, 4, "pixels", "letterbox"))
    assert boxed[0] == boxed[15] == pytest.approx(0.498, abs=0.01) and boxed[5] > 0.99 and boxed[10] > 0.99
    assert (images.image_vector(white, images.VectorConfig(4, 4, "pixels", "contain".replace("contain", "stretch"))) > 0.99).all()


def test_foreground_crop():
    image = np.full((8, 8, 3), 255, np.uint8)
    image[2:6, 2:6] = 0
    steps = images.processing_steps(image, images.VectorConfig(4, 4, "pixels", "foreground-crop"))
    assert [n for n, _ in steps] == ["original", "foreground_crop", "resize_exact"]
    assert steps[1][1].shape[:2] == (6, 6) and steps[2][1].shape[:2] == (4, 4)


def test_aliases():
    assert images.mode_name("enhanced", images.FEATURE_MODES) == "rich" and images.mode_name("pad", images.RESIZE_MODES) == "letterbox"
    with pytest.raises(ConfigError):
        images.mode_name("nothing", images.RESIZE_MODES)


def png(path, value, size=4):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes([value] * 3 * size) for _ in range(size))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", size, size, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_folder(spark, tmp_path):
    png(tmp_path / "dark/sample.png", 0)
    png(tmp_path / "light/sample.png", 255)
    png(tmp_path / "eval/dark/sample.png", 0)
    (tmp_path / "light/broken.png").write_bytes(b"no image")
    rows, dim = image_sources.read_image_folder(spark, str(tmp_path))
    assert {r.class_name: r.label for r in dim.collect()} == {"dark": 0, "light": 1}
    out = images.vectorize(rows, {"pixels": images.VectorConfig(2, 2)}, ("label",)).orderBy("label").collect()
    assert [r.pixels for r in out] == [[0.0] * 4, [1.0] * 4]
    patches = images.vectorize_patches(rows.withColumn("image_id", F.col("label")), images.VectorConfig(2, 2), 3, 2)
    assert patches.count() == 8


def test_manifest(spark, tmp_path):
    for name in ("normal-a", "normal-b", "defect"):
        png(tmp_path / f"data/{name}/deep/x.png", 9)
    (tmp_path / "m.json").write_text('{"root": "data", "train": {"normal": ["normal-a", "normal-b"], "defect": []}, "eval": {"normal": "normal-a"}}')
    rows, dim = image_sources.read_image_manifest(spark, str(tmp_path / "m.json"))
    assert sorted(r.source_name for r in rows.where("split = 'train'").collect()) == ["normal-a", "normal-b"]
    assert rows.where("split = 'eval'").count() == 1 and dim.count() == 1


def test_masks(spark):
    paths = ["r/train/good/1.png", "r/test/good/2.png", "r/test/cut/3.png", "r/ground_truth/cut/3.png", "r/ground_truth/cut/3_mask.png"]
    entries = image_sources.industrial_entries(spark.createDataFrame([(p,) for p in paths], "path string"), "r")
    out = {r.path: r.mask_path for r in image_sources.match_masks(entries).collect()}
    assert out == {"r/test/good/2.png": None, "r/test/cut/3.png": "r/ground_truth/cut/3_mask.png"}


def test_csv_sources(spark, tmp_path):
    (tmp_path / "e.csv").write_text("Path, Class ,e0,e1\ncat-a,Cat,.1,.2\ndog-a,Dog,.8,.7\n")
    rows, dim = sources.read_embedding_csv(spark, str(tmp_path / "e.csv"))
    assert [(r.features, r.label) for r in rows.orderBy("sample_id").collect()] == [([0.1, 0.2], 0), ([0.8, 0.7], 1)]
    (tmp_path / "i.csv").write_text("a,b,c,d,species\n5.1,3.5,1.4,.2,setosa\n7,3.2,4.7,1.4,versicolor\n")
    rows, dim = sources.read_iris(spark, str(tmp_path / "i.csv"))
    assert rows.count() == 2 and dim.count() == 2
    assert sources.synthetic_points(spark)[0].count() == 240


def test_reports(spark, tmp_path):
    df = spark.sql("select array(named_struct('class_name', 'a', 'accuracy', 0.5D, 'correct', 1, 'total', 2)) p, array(named_struct('actual_name', 'a', 'predicted_counts', array(1, 2))) c")
    assert df.select(sinks.format_per_class("p"), sinks.format_confusion("c")).first() == ("a=0.500000(1/2)", "a=[1|2]")
    sinks.write_report(df, str(tmp_path / "r"), "csv")
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 1
    assert sinks.safe_name("a b/c") == "a_b_c" and "&lt;" in sinks.index_html("<", [{"a": 1}])


def test_positions_and_cap(spark):
    at = lambda n, p, s: spark.range(1).select(anomaly.sliding_positions(F.lit(n), p, s)).first()[0]
    assert at(100, 48, 20) == [0, 20, 40, 52] and at(40, 48, 20) == [0] and at(88, 48, 20) == [0, 20, 40]
    refs = spark.range(1000).select(F.col("id").alias("ref_id"))
    for limit in (7, 130, 999):
        got = sorted(r.ref_id for r in anomaly.cap_references(refs, limit).collect())
        assert got == sorted({int(i * (1000 / limit)) for i in range(limit)})


def test_boxes(spark):
    df = spark.sql("select array(10D, 10D, 30D, 20D) b")
    assert df.select(boxes.expanded_square(F.col("b"), F.lit(100.0), F.lit(100.0), 0.0)).first()[0] == [10.0, 5.0, 30.0, 25.0]
    assert df.select(boxes.expanded_square(F.col("b"), F.lit(25.0), F.lit(100.0), 0.0)).first()[0] == [5.0, 5.0, 25.0, 25.0]
    assert images.pad_to_square(np.zeros((2, 4, 3), np.uint8), (1, 1, 1)).shape == (4, 4, 3)


def test_genomes_stay_in_space():
    rng, space = random.Random(1), search.Space({"k": (1, 3)}, {"threshold": (0.2, 0.8, 0.15), "w": (0.0, 1.0, 0.25)}, True)
    g = search.random_genome(space, rng)
    for _ in range(100):
        g = search.mutate(g, space, 1.0, rng)
        assert g["k"] in (1, 3) and 0.2 <= g["threshold"] <= 0.8 and 0 <= g["w"] <= 1 and 0 < g["blocks"] <= 0xFFFF
    best, history = search.search(space, search.SearchConfig(6, 4, 1), lambda gs: [-abs(x["threshold"] - 0.5) for x in gs])
    assert len(history) == 4 and history[-1]["best_fitness"] >= history[0]["best_fitness"]
    assert search.SearchConfig(0, 0, 9, 3.0).normalized() == search.SearchConfig(2, 1, 1, 1.0)


def test_grid(spark):
    assert matrix.grid(spark, a=[1, 2], b=["x", "y", "z"]).count() == 6


def test_heat():
    heat = images.heat_values(4, 4, [(0, 0, 2, 2, 0.1), (1, 1, 3, 3, 0.9)])
    assert heat[1, 1] == 1.0 and heat[0, 0] == 0.0 and images.heat_colors(heat)[0, 0, 3] == 0
