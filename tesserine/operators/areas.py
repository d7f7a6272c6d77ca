"""Areas of unions of rectangles and of masks in rows of runs: swept over edges, never over pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRIPS = "image_id bigint, y0 bigint, y1 bigint, x0 bigint, x1 bigint"
_MEASURES = "image_id bigint, predicted_area bigint, truth_area bigint, shared_area bigint, overlaps array<struct<patch_id: bigint, area: bigint>>"


def mask_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, column behind the last) of the runs of set pixels of a mask, row by row."""
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, starts = np.nonzero(edges == 1)
    return rows.astype(np.int64), starts.astype(np.int64), np.nonzero(edges == -1)[1].astype(np.int64)


def strips(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The union of rectangles: for each strip between neighbouring edges that has any, its ends and the disjoint runs of columns, in order.

    A rectangle enters at its upper and leaves at its lower edge; runs are
    merged anew only among those that a strip has.
    """
    real = (w > 0) & (h > 0)
    x, y, x1, y1 = x[real], y[real], (x + w)[real], (y + h)[real]
    order = np.argsort(x, kind="stable")
    x, y, x1, y1 = x[order], y[order], x1[order], y1[order]
    edges = np.unique(np.concatenate([y, y1]))
    enter, leave = np.searchsorted(edges, y), np.searchsorted(edges, y1)
    comes, goes = np.argsort(enter, kind="stable"), np.argsort(leave, kind="stable")
    inside = np.zeros(len(x), bool)
    a = b = 0
    for i in range(len(edges) - 1):
        while a < len(comes) and enter[comes[a]] == i:
            inside[comes[a]] = True
            a += 1
        while b < len(goes) and leave[goes[b]] == i:
            inside[goes[b]] = False
            b += 1
        own = np.flatnonzero(inside)
        if len(own):
            furthest = np.maximum.accumulate(x1[own])
            first = np.ones(len(own), bool)
            first[1:] = x[own][1:] > furthest[:-1]
            last = np.append(np.flatnonzero(first)[1:] - 1, len(own) - 1)
            yield int(edges[i]), int(edges[i + 1]), x[own][first], furthest[last]


def covered(starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many columns before each place disjoint runs cover."""
    before = np.concatenate([[0], np.cumsum(ends - starts)])
    k = np.searchsorted(starts, at, side="left")  # runs that begin before the place
    last = np.maximum(k - 1, 0)
    return before[k] - np.where(k > 0, np.maximum(ends[last] - at, 0), 0)


def union_and_shared(rectangles: tuple[np.ndarray, ...], runs: tuple[np.ndarray, ...]) -> tuple[int, int]:
    """(area of the rectangles' union, what of it the runs, sorted by row, have)."""
    rows, starts, ends = runs
    total = shared = 0
    for y0, y1, x0, x1 in strips(*rectangles):
        total += (y1 - y0) * int((x1 - x0).sum())
        i, j = np.searchsorted(rows, y0), np.searchsorted(rows, y1)
        shared += int((covered(x0, x1, ends[i:j]) - covered(x0, x1, starts[i:j])).sum())
    return total, shared


def shared_by_each(rectangles: tuple[np.ndarray, ...], runs: tuple[np.ndarray, ...]) -> np.ndarray:
    """The pixels of runs, sorted by row, within each rectangle."""
    (x, y, w, h), (rows, starts, ends) = rectangles, runs
    first, behind = np.searchsorted(rows, y), np.searchsorted(rows, y + h)
    out = np.zeros(len(x), np.int64)
    for i in np.flatnonzero(behind > first):
        own = slice(first[i], behind[i])
        out[i] = np.maximum(np.minimum(ends[own], x[i] + w[i]) - np.maximum(starts[own], x[i]), 0).sum()
    return out


def _columns(table: pa.Table, *names: str) -> tuple[np.ndarray, ...]:
    return tuple(table.column(c).to_numpy().astype(np.int64) for c in names)


def union_strips(rectangles: DataFrame) -> DataFrame:
    """(image_id, y0, y1, x0, x1): the union of an image's rectangles (image_id, x, y, w, h) as disjoint ones, strip by strip. One image is a group; empty rectangles have none."""

    def run(table: pa.Table) -> pa.Table:
        image, out = table.column("image_id")[0].as_py(), []
        for y0, y1, x0, x1 in strips(*_columns(table, "x", "y", "w", "h")):
            out += [(image, y0, y1, a, b) for a, b in zip(x0.tolist(), x1.tolist())]
        return pa.table([pa.array(c, pa.int64()) for c in [*zip(*out)] or [[]] * 5], names=["image_id", "y0", "y1", "x0", "x1"])

    return rectangles.select("image_id", "x", "y", "w", "h").groupBy("image_id").applyInArrow(run, STRIPS)


def area_measures(patches: DataFrame, runs: DataFrame) -> DataFrame:
    """(image_id, predicted_area, truth_area, shared_area, overlaps) of images that have patches or runs.

    ``patches`` has image_id, patch_id, x, y, w, h and ``predicted``, ``runs``
    of the truth (image_id, y, x0, x1), which don't overlap. An image's rows meet in one
    group; what it costs grows with them, not with its pixels. ``overlaps``
    tells each patch's share of the truth, predicted or not.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        image = (left if left.num_rows else right).column("image_id")[0].as_py()
        order = right.sort_by([("y", "ascending"), ("x0", "ascending")])
        truth = _columns(order, "y", "x0", "x1")
        boxes = _columns(left, "x", "y", "w", "h")
        hit = left.column("predicted").to_numpy().astype(bool)
        total, shared = union_and_shared(tuple(c[hit] for c in boxes), truth)
        each = [{"patch_id": p, "area": a} for p, a in zip(left.column("patch_id").to_pylist(), shared_by_each(boxes, truth).tolist())]
        kinds = [pa.int64()] * 4 + [pa.list_(pa.struct([("patch_id", pa.int64()), ("area", pa.int64())]))]
        row = (image, total, int((truth[2] - truth[1]).sum()), shared, each)
        return pa.table([pa.array([v], t) for v, t in zip(row, kinds)], names=["image_id", "predicted_area", "truth_area", "shared_area", "overlaps"])

    left = patches.select("image_id", "patch_id", "x", "y", "w", "h", F.coalesce("predicted", F.lit(False)).alias("predicted"))
    right = runs.select("image_id", "y", "x0", "x1").where("x1 > x0")
    return left.groupBy("image_id").cogroup(right.groupBy("image_id")).applyInArrow(run, _MEASURES)
