"""Interval models, libraries, centroids: small fixtures with known results."""

from __future__ import annotations

import numpy as np
import pytest

from tesserine.errors import ConfigError, DimensionError, EmptyInputError, UnsupportedCorrectionError
from tesserine.operators import centroid, library, metrics
from tesserine.operators import intervals as I
from tesserine.operators.interval_model import Correction, IntervalModel, learning_curve
from tesserine.sources.vectors import synthetic_lines

POINTS = [(0.1, 0.1, 0), (0.12, 0.08, 0), (0.08, 0.12, 0), (0.85, 0.15, 1), (0.88, 0.12, 1), (0.82, 0.18, 1), (0.45, 0.85, 2), (0.5, 0.88, 2), (0.55, 0.82, 2)]


def samples(spark, rows):
    return spark.createDataFrame([(i, list(map(float, r[:-1])), r[-1], i) for i, r in enumerate(rows)], "sample_id bigint, features array<double>, label bigint, ord bigint")


def refs(spark, rows):
    return spark.createDataFrame([(i, list(map(float, v)), l) for i, (v, l) in enumerate(rows)], "ref_id bigint, vector array<double>, label bigint")


def query(spark, *vectors):
    return spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(vectors)], "query_id bigint, vector array<double>")


def test_hard_bin_step():
    m = IntervalModel.with_unit_ranges(2, 4, 2)
    told = m.train_one([0.2, 0.8], [1.0, -1.0])
    assert told["output_after"] == pytest.approx([1.0, -1.0]) and told["active_count"] == 2
    assert m.weight(0, 0, 0) == m.weight(1, 3, 0) == 0.5 and m.weight(0, 0, 1) == -0.5
    assert np.count_nonzero(m.weights) == 4 and m.weight(9, 0, 0) is None and m.memory_bytes() == 12 * 16


def test_triangular_and_duplicates():
    m = IntervalModel.with_unit_ranges(1, 4, 1, I.Distributor("triangular"))
    told = m.train_one([0.5], [0.75])
    assert told["active_count"] == 2 and told["output_after"] == pytest.approx([0.75])
    m = IntervalModel.with_unit_ranges(1, 4, 1, I.Distributor("triangular"))
    told = m.train_one([0.0], [1.0])
    assert m.weight(0, 0, 0) == pytest.approx(1.0) and told["output_after"] == pytest.approx([2.0]) and m.access_count(0, 0, 0) == 2


def test_gaussian():
    m = IntervalModel.with_unit_ranges(1, 5, 1, I.Distributor("gaussian", 1, 1.0))
    assert m.train_one([0.5], [1.0])["active_count"] == 3
    assert np.argmax(m.weights[0, :, 0]) == 2


def test_ratio():
    m = IntervalModel.with_unit_ranges(1, 2, 1, correction=Correction("ratio"))
    assert m.train_one([0.25], [1.0])["output_after"] == pytest.approx([1.0])
    m = IntervalModel.with_unit_ranges(1, 1, 1, correction=Correction("ratio", max_factor=2.0))
    m.train_one([0.5], [1.0])
    assert m.train_one([0.5], [100.0])["output_after"] == pytest.approx([2.0])


def test_plasticity():
    m = IntervalModel.with_unit_ranges(1, 1, 1, correction=Correction(freeze_after=5))
    m.train_one([0.5], [1.0])
    m.train_one([0.5], [0.0])
    assert m.weight(0, 0, 0) == pytest.approx(0.5) and m.access_count(0, 0, 0) == 2


def test_quantile_intervals(spark):
    fitted = I.fit_intervals(samples(spark, [(0, 0), (1, 0), (10, 0), (100, 0)]), 2, "quantile", distributor=I.Distributor("hard"))
    at, _, _ = I.encode_array(np.array([[0.0], [100.0], [float("nan")]]), fitted)
    assert at.ravel().tolist() == [0, 1, 0]


def test_batch_equals_online_when_disjoint(spark):
    df = samples(spark, [(0.1, 0), (0.9, 1)])
    models = []
    for batch in (True, False):
        m = IntervalModel.with_unit_ranges(1, 2, 2)
        m.fit(df, 1, batch=batch)
        models.append(m.weights)
    assert np.allclose(*models)
    with pytest.raises(UnsupportedCorrectionError):
        IntervalModel.with_unit_ranges(1, 2, 2, correction=Correction("ratio")).fit(df, 1, batch=True)


def test_class_parallel_equals_one_loop(spark):
    rng = np.random.default_rng(1)
    rows = [(*rng.random(3), int(rng.integers(0, 5))) for _ in range(60)]
    df = samples(spark, rows)
    for mode in ("least-squares", "proportional", "ratio"):
        m = IntervalModel.from_training_data(df, 4, 5, distributor=I.TRIANGULAR, correction=Correction(mode, max_factor=2.0, freeze_after=9))
        alone = IntervalModel(m.intervals, 5, correction=m.correction)
        m.fit(df, 2, "honour")
        for _ in range(2):
            for r in rows:
                alone.train_one(r[:3], [float(r[3] == c) for c in range(5)])
        assert np.allclose(m.weights, alone.weights) and (m.counts == alone.counts).all()


def test_gates(spark, tmp_path):
    df = samples(spark, POINTS)
    m = IntervalModel.from_training_data(df, 8, 3, distributor=I.Distributor("hard"))
    m.fit(df, 3)
    assert m.accuracy(df) >= 0.95
    m.save(spark, str(tmp_path / "m"))
    again = IntervalModel.load(spark, str(tmp_path / "m"))
    assert np.array_equal(again.weights, m.weights) and again.intervals == m.intervals
    assert learning_curve(IntervalModel.from_training_data(df, 8, 3), df, df, 5, target_mse=10.0)[-1]["epoch"] == 1
    told = library.vote(library.top_k(query(spark, *[p[:2] for p in POINTS]), refs(spark, [(p[:2], p[2]) for p in POINTS]), 3))
    assert {r.query_id: r.predicted for r in told.collect()} == {i: p[2] for i, p in enumerate(POINTS)}
    lines, _ = synthetic_lines(spark)
    m = IntervalModel.from_training_data(lines, 4, 3, distributor=I.Distributor("hard"))
    m.fit(lines, 4, order="sample_id")
    assert m.accuracy(lines) >= 0.95


def test_library(spark):
    r = refs(spark, [((1, 0), 0), ((0, 1), 1)])
    assert library.top_k(query(spark, (0.9, 0.1)), r, 1, "cosine").first().ref_id == 0
    told = library.vote(library.top_k(query(spark, (0.11,)), refs(spark, [((0,), 0), ((0.1,), 1), ((0.2,), 1)]), 3))
    assert told.first().predicted == 1
    assert library.top_k(query(spark, (0.7, 0.2, 0.9)), refs(spark, [((1, 0, 1), 0), ((0, 1, 0), 1)]), 1, "hamming").first().label == 0
    assert library.top_k(query(spark, (0.9, 0.1, 0.8)), refs(spark, [((1, 0, 1), 0), ((1, 1, 0), 1)]), 1, "jaccard").first().label == 0
    q, r = query(spark, (0.1, 0.9)), refs(spark, [((0, 1), 0), ((1, 0), 1)])
    told = library.Library(r, "cosine").explain(q, 1, 1).first()
    assert told.predicted == 0 and len(told.contributions) == 1 and told.contributions[0].feature == 1
    told = library.BinaryLibrary(refs(spark, [((1, 0, 1), 0), ((0, 1, 0), 1)])).explain(query(spark, (0.8, 0.1, 0.9)), 1, 2).first()
    assert told.predicted == 0 and tuple(told.contributions[0]) == (0, 1.0)
    assert library.Library(r).predict(q, 0).count() == 0
    with pytest.raises(EmptyInputError):
        library.Library(r.limit(0))
    with pytest.raises(DimensionError):
        library.Library(refs(spark, [((1,), 0), ((1, 2), 1)]))


@pytest.mark.parametrize("asked", [20, 50, 80])
def test_many_blocks_give_the_same(spark, monkeypatch, asked):
    """Either side goes out, in one block or in many; equal scores go to the smaller label or id."""
    rng = np.random.default_rng(3)
    rows = [(rng.random(4).round(1), int(rng.integers(0, 3))) for _ in range(50)]
    q = query(spark, *[rng.random(4).round(1) for _ in range(asked)]).repartition(3)
    stored = refs(spark, rows).repartition(4)
    distance = lambda x, y: 1 / (1 + sum((a - b) ** 2 for a, b in zip(x, y)) ** 0.5)
    for block in (16_384, 7):
        monkeypatch.setattr(library, "BLOCK", block)
        got = {}
        for r in library.top_k(q, stored, 4).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.ref_id))
        for r in q.collect():
            best = sorted((-distance(r.vector, v), i) for i, (v, _) in enumerate(rows))[:4]
            assert sorted(got[r.query_id]) == [(k + 1, i) for k, (_, i) in enumerate(best)]
        bits = [sorted(map(tuple, library.top_k_bits(q, stored, 3, 0.5).select("query_id", "rank", "ref_id", "score").collect()))]
    assert bits[0] == bits[-1] and len(bits[0]) == 3 * asked


def test_bits():
    a, b = np.array([[1, 0, 1, 0]], bool), np.array([[1, 1, 1, 0]], bool)
    assert library.bit_scores(a, b, 0.0, 4)[0, 0] == pytest.approx(0.75)
    assert library.bit_scores(a, b, 1.0, 4)[0, 0] == pytest.approx(2 / 3)


def test_mask_ignores_blocks(spark):
    good, bad = [1, 1] + [0] * 14, [0, 0] + [0] * 12 + [1, 1]
    q = [1, 1] + [0] * 12 + [1, 1]
    told = library.BinaryLibrary(refs(spark, [(good, 0), (bad, 1)]), 0.5, 0.0, 0b11).predict(query(spark, q), 1)
    assert told.first().predicted == 0


def test_centroid(spark):
    df = samples(spark, [(0, 0, 0), (0.2, 0, 0), (1, 1, 1), (0.8, 1, 1)])
    c = centroid.fit_centroids(df)
    out = centroid.predict_centroid(samples(spark, [(0.1, 0.1, 0), (0.9, 0.9, 0)]), c).orderBy("sample_id").collect()
    assert [r.predicted for r in out] == [0, 1]
    with pytest.raises(DimensionError):
        centroid.fit_centroids(samples(spark, [(0, 0, 0), (1, 1)]))


@pytest.mark.parametrize("limit", [0, 100, 64 << 20])
def test_many_centroids(spark, monkeypatch, limit):
    """Results don't depend on how many centroids are sent at once; distances that differ by little, rows that share an id or have none, ties, nulls and what is no number."""
    monkeypatch.setattr(centroid, "SENT_BYTES", limit)
    c = spark.createDataFrame([(0, [1e-17]), (1, [0.0]), (2, [5.0]), (7, [0.0])], "label bigint, centroid array<double>")
    rows = spark.createDataFrame([(1, [0.0]), (2, [1e-17]), (2, [5.0]), (3, [2.5]), (4, None), (5, [float("nan")])], "sample_id bigint, features array<double>")
    told = [(r.predicted, r.distance) for r in centroid.predict_centroid(rows, c).orderBy("sample_id", "features").collect()]
    assert told[:5] == [(1, 0.0), (0, 0.0), (2, 0.0), (0, 6.25), (None, None)] and told[5][0] == 0 and np.isnan(told[5][1])
    assert centroid.predict_centroid(rows.drop("sample_id"), c).columns == ["features", "predicted", "distance"]
    rng = np.random.default_rng(6)
    df = samples(spark, [(*rng.integers(0, 5, 3), int(rng.integers(0, 9))) for _ in range(60)])
    fitted = centroid.fit_centroids(df)
    by_label = {r.label: np.array(r.centroid) for r in fitted.collect()}
    for r in centroid.predict_centroid(df, fitted).collect():
        assert (r.distance, r.predicted) == min((float(sum((np.array(r.features) - v) ** 2)), label) for label, v in by_label.items())
    with pytest.raises(EmptyInputError):
        centroid.predict_centroid(df, fitted.limit(0))


def test_confusion_of_many_classes(spark, monkeypatch):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 1)], "expected bigint, predicted bigint")
    dim = spark.createDataFrame([(0, "a"), (1, "b")], "label bigint, class_name string")
    assert sorted(map(tuple, metrics.confusion(df, dim).collect())) == [(0, 0, 0), (0, 1, 2), (1, 0, 0), (1, 1, 1)]
    told = metrics.classification_metrics(df, dim).first()
    cells = [tuple(c) for c in told.confusion_cells]
    assert cells == [(0, 1, 2), (1, 1, 1)] and [list(r.predicted_counts) for r in told.confusion_matrix] == [[0, 2], [0, 1]]
    monkeypatch.setattr(metrics, "DENSE_CLASSES", 1)
    told = metrics.classification_metrics(df, dim).first()
    assert [tuple(c) for c in told.confusion_cells] == cells and told.confusion_matrix is None and told.accuracy == pytest.approx(1 / 3)


def test_bad_settings():
    with pytest.raises(ConfigError):
        I.Distributor("other")
    with pytest.raises(ConfigError):
        Correction("other")
    with pytest.raises(ConfigError):
        IntervalModel.with_unit_ranges(1, 2, 0)
