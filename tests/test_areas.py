"""Areas by sweeping against pixels."""

from __future__ import annotations

import time

import numpy as np
import pytest

from tesserine.operators import anomaly, areas


def painted(rectangles, shape):
    out = np.zeros(shape, bool)
    for x, y, w, h in zip(*rectangles):
        out[y : y + h, x : x + w] = True
    return out


@pytest.mark.parametrize("seed", range(20))
def test_against_pixels(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 12))
    rects = tuple(rng.integers(0, m, n) for m in (30, 25, 12, 12))
    mask = np.zeros((45, 50), bool)
    for x, y, w, h in zip(*(rng.integers(0, m, 5) for m in (35, 30, 12, 12))):
        mask[y : y + h, x : x + w] = rng.random((h, w)) < 0.7
    told, runs = painted(rects, mask.shape), areas.mask_runs(mask)
    assert areas.union_and_shared(rects, runs) == (told.sum(), (told & mask).sum())
    assert areas.shared_by_each(rects, runs).tolist() == [mask[y : y + h, x : x + w].sum() for x, y, w, h in zip(*rects)]
    again = np.zeros(mask.shape, int)
    for y0, y1, x0, x1 in areas.strips(*rects):
        assert (x0[1:] > x1[:-1]).all()
        for a, b in zip(x0, x1):
            again[y0:y1, a:b] += 1
    assert (again == told).all()
    back = np.zeros(mask.shape, bool)
    for y, a, b in zip(*runs):
        back[y, a:b] = True
    assert (back == mask).all()


def test_large_images_cost_what_their_edges_do(spark):
    """Images of 4,000 x 4,000 pixels: rows out as many as images and rectangles, in little time."""
    patches = [(i, 100 * i + j, 48 * (j % 80), 48 * (j // 80), 96, 96, 1.0 if j % 3 else 0.0) for i in range(3) for j in range(90)]
    runs = [(i, y, 500, 3500) for i in range(3) for y in range(10, 4000)]
    df = spark.createDataFrame(patches, "image_id bigint, patch_id bigint, x bigint, y bigint, w bigint, h bigint, anomaly_score double")
    truth = spark.createDataFrame(runs, "image_id bigint, y bigint, x0 bigint, x1 bigint")
    boxes = anomaly.predicted_rectangles(df, 0.5, 4000, 4000)
    began = time.time()
    got = {r.image_id: r.iou for r in anomaly.mask_iou(boxes, truth).collect()}
    mask = np.zeros((4000, 4000), bool)
    mask[10:, 500:3500] = True
    own = [p for p in patches if p[0] == 0 and p[-1] >= 0.5]
    told = painted(tuple(np.array(c) for c in zip(*((p[2], p[3], min(p[4], 4000 - p[2]), min(p[5], 4000 - p[3])) for p in own))), mask.shape)
    assert got == pytest.approx({i: (told & mask).sum() / (told | mask).sum() for i in range(3)})
    ratios = {r.patch_id: (r.mask_overlap_ratio, r.mask_positive) for r in anomaly.overlap_ratio(df, truth).collect()}
    assert len(ratios) == len(patches) and ratios[0] == (0.0, False) and ratios[20] == (86 / 96, True)
    assert anomaly.predicted_mask(df, 0.5, 4000, 4000).count() < 500 and time.time() - began < 120


def test_odd_images(spark):
    """Images with a mask alone, with patches alone, with nothing predicted, and empty rectangles."""
    df = spark.createDataFrame([(1, 1, 0, 0, 4, 4, 1.0), (2, 2, 0, 0, 4, 4, 0.0), (3, 3, 9, 9, 4, 4, 1.0), (5, 4, 0, 0, 0, 4, 1.0), (5, 5, 1, 0, 2, 2, None)], "image_id bigint, patch_id bigint, x bigint, y bigint, w bigint, h bigint, anomaly_score double")
    runs = spark.createDataFrame([(2, 0, 0, 2), (4, 0, 0, 2), (1, 0, 0, 4), (1, 1, 2, 2)], "image_id bigint, y bigint, x0 bigint, x1 bigint")
    boxes = anomaly.predicted_rectangles(df, 0.5, 8, 8)
    assert {r.image_id: r.iou for r in anomaly.mask_iou(boxes, runs).collect()} == {1: 0.25, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0}
    assert {r.patch_id: r.mask_overlap_ratio for r in anomaly.overlap_ratio(df, runs).collect()} == {1: 0.25, 2: 0.125, 3: 0.0, 4: 0.0, 5: 0.0}
    assert anomaly.predicted_mask(df, 0.5, 8, 8).collect() == [(1, 0, 4, 0, 4)]
    assert anomaly.mask_iou(boxes.limit(0), runs.limit(0)).count() == 0
