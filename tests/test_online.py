"""Online epochs by blocks against one correction after the other."""

from __future__ import annotations

import numpy as np
import pytest

from tesserine.errors import ConfigError
from tesserine.operators import interval_model as M
from tesserine.operators import intervals as I
from tesserine.operators.model_table import ModelTable


def samples(spark, n=60, features=6, seed=4):
    rng = np.random.default_rng(seed)
    x = np.round(rng.random((n, features)) * 8) / 8  # positions at integers too, which activate an interval twice
    x[:3] = x[3:6]
    x[7, 2] = np.nan
    return spark.createDataFrame([(int(o), v.tolist(), int(rng.integers(0, 3)), int(o)) for o, v in zip(rng.permutation(n), x)], "sample_id bigint, features array<double>, label bigint, ord bigint").repartition(3)


@pytest.mark.parametrize("kind", [I.TRIANGULAR, I.Distributor("hard"), I.Distributor("gaussian", 1, 1.0)])
@pytest.mark.parametrize("mode, epoch_mode", [("least-squares", "reference"), ("proportional", "reference"), ("proportional", "honour")])
@pytest.mark.parametrize("size, each", [(256, 50_000), (7, 1)])
def test_blocks(spark, monkeypatch, kind, mode, epoch_mode, size, each):
    monkeypatch.setattr(M, "BLOCK_SAMPLES", size)
    monkeypatch.setattr(M, "STEP_WEIGHTS", each)
    df = samples(spark)
    fresh = lambda: M.IntervalModel.from_training_data(df, 5, 3, distributor=kind, correction=M.Correction(mode))
    model, one = fresh(), fresh()
    told = model.fit(df, 2, epoch_mode)
    rows, errors = sorted(df.collect(), key=lambda r: r.ord), []
    for _ in range(2):
        errors.append(np.mean([one.train_one(list(r.features), [float(r.label == o) for o in range(3)], epoch_mode == "honour")["mse_before"] for r in rows]))
    assert np.allclose(model.weights, one.weights, atol=1e-9) and (model.counts == one.counts).all()
    assert told == pytest.approx(errors, abs=1e-9)


def test_the_heavy_part_is_shared(spark):
    df, model = samples(spark, 400), None
    model = M.IntervalModel.from_training_data(df, 5, 3, distributor=I.TRIANGULAR)
    rows = model.prepare(df).select("first").collect()
    assert len({r["first"] >> 32 for r in rows}) > 1 and [r["first"] for r in rows] == sorted(r["first"] for r in rows)


def test_prepared_for_another_mode(spark):
    df = samples(spark, 20)
    model = M.IntervalModel.from_training_data(df, 5, 3, correction=M.Correction("proportional"))
    with pytest.raises(Exception, match="another epoch mode"):
        model.train_epoch(model.prepare(df, epoch_mode="honour"), "reference")
    with pytest.raises(ConfigError):
        M.IntervalModel.from_training_data(df, 5, 3, correction=M.Correction("ratio")).train_epoch(model.prepare(df))


@pytest.mark.parametrize("mode", ["least-squares", "proportional"])
def test_a_model_that_is_a_table(spark, mode):
    df = samples(spark, 50)
    model = M.IntervalModel.from_training_data(df, 5, 3, distributor=I.TRIANGULAR, correction=M.Correction(mode))
    own = ModelTable(I.activation_matrix(I.encode(df, model.intervals), "sample_id", 5), df, 3, mode == "proportional")
    assert own.fit(2) == pytest.approx([model.train_epoch_batch(df) for _ in range(2)], abs=1e-12)
    found = np.zeros((30, 3)), np.zeros((30, 3), int)
    for r in own.weights.collect():
        found[0][r.k, r.output], found[1][r.k, r.output] = r.weight, r.access_count
    assert np.allclose(found[0], model.weights.reshape(30, 3), atol=1e-9) and (found[1] == model.counts.reshape(30, 3)).all()
    own.close()
