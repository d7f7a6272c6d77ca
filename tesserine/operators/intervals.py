"""Fitting of intervals and encoding of values into weighted intervals."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.vectors import EPSILON, finite, unit_position
from .prep import long_form, min_max_ranges, percentile_clip_ranges
from .ranking import nearest_ranks

DISTRIBUTORS = ("hard", "triangular", "gaussian")


@dataclass(frozen=True)
class Distributor:
    """How a value activates intervals: the one it is in, the two around it, or a truncated bell."""

    kind: str = "hard"
    radius: int = 1
    sigma: float = 1.0

    def __post_init__(self):
        if self.kind not in DISTRIBUTORS or self.radius < 0 or self.sigma <= 0:
            raise ConfigError(f"bad distributor {self}")

    @property
    def width(self) -> int:
        return {"hard": 1, "triangular": 2, "gaussian": 2 * self.radius + 1}[self.kind]


#: What whole commands use.
TRIANGULAR = Distributor("triangular")


@dataclass(frozen=True)
class Intervals:
    """Fitted intervals of all features: ends, and inner and outer edges if they were fitted to quantiles."""

    count: int
    low: tuple[float, ...]
    high: tuple[float, ...]
    edges: tuple[tuple[float, ...], ...] | None = None
    distributor: Distributor = field(default_factory=Distributor)

    @property
    def features(self) -> int:
        return len(self.low)


def fit_intervals(
    samples: DataFrame, count: int, strategy: str = "uniform", low: float = 0.05, high: float = 0.95, vector: str = "features", distributor: Distributor = Distributor()
) -> Intervals:
    """Uniform intervals between min and max, or between two percentiles (``clipped``), or with nearest-rank ``quantile`` edges. Finite values only."""
    if count < 1:
        raise ConfigError("at least one interval")
    if strategy == "clipped":
        ranges = percentile_clip_ranges(samples, low, high, vector)
    elif strategy in ("uniform", "quantile"):
        ranges = min_max_ranges(samples, vector)
    else:
        raise ConfigError(f"unknown strategy {strategy}")
    rows = ranges.orderBy("feature").collect()
    edges = None
    if strategy == "quantile":
        found = quantile_edges(samples, count, vector).collect()
        by = {r["feature"]: tuple(r["edges"]) for r in found}
        edges = tuple(by.get(r["feature"], (0.0,) * (count + 1)) for r in rows)
    return Intervals(count, tuple(r["min"] for r in rows), tuple(r["max"] for r in rows), edges, distributor)


def uniform_edges(ranges: DataFrame, count: int) -> DataFrame:
    """(feature, edges) of equal intervals."""
    step = (F.col("max") - F.col("min")) / count
    return ranges.select("feature", F.transform(F.sequence(F.lit(0), F.lit(count)), lambda i: F.col("min") + step * i).alias("edges"))


def quantile_edges(samples: DataFrame, count: int, vector: str = "features") -> DataFrame:
    """(feature, edges): count + 1 nearest-rank percentiles of the finite values."""
    values = long_form(samples, vector).where(finite(F.col("value")))
    found = nearest_ranks(values, "feature", "value", [i / count for i in range(count + 1)])
    return found.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("q", "value"))).alias("e")).select("feature", F.col("e.value").alias("edges"))


# --- columns --------------------------------------------------------------------------------------


def hard_interval(position: Column, count: int) -> Column:
    """min(floor(position * count), count - 1)."""
    return F.least(F.floor(position * count), F.lit(count - 1)).cast("long")


def edge_interval(value: Column, edges: Column, count: int) -> Column:
    """The first interval whose upper edge is not below the value; 0 for values that aren't finite."""
    below = F.size(F.filter(F.slice(edges, 2, count), lambda e: e < value))
    return F.when(finite(value), F.least(below, F.lit(count - 1))).otherwise(0).cast("long")


def activations(vector: Column, low: Column, high: Column, count: int, distributor: Distributor = Distributor(), edges: Column | None = None) -> Column:
    """array<struct<feature, interval, coefficient>> of a vector.

    A triangular position that is an exact integer activates the same interval
    twice, with 1 each; so do all positions fitted to quantile edges.
    """
    parts = F.arrays_zip(vector.alias("v"), low.alias("l"), high.alias("h"), *([edges.alias("e")] if edges is not None else []))

    def one(s: Column, i: Column) -> Column:
        position = unit_position(s["v"], s["l"], s["h"])
        home = edge_interval(s["v"], s["e"], count) if edges is not None else hard_interval(position, count)
        entry = lambda d, c: F.struct(i.cast("long").alias("feature"), d.cast("long").alias("interval"), c.alias("coefficient"))
        if count == 1 or distributor.kind == "hard":
            return F.array(entry(F.lit(0) if count == 1 else home, F.lit(1.0)))
        if distributor.kind == "triangular":
            p = home.cast("double") if edges is not None else position * (count - 1)
            return F.array(entry(F.floor(p), 1.0 - (p - F.floor(p))), entry(F.ceil(p), 1.0 - (F.ceil(p) - p)))
        window = F.sequence(F.greatest(home - distributor.radius, F.lit(0)), F.least(home + distributor.radius, F.lit(count - 1)))
        return F.transform(window, lambda d: entry(d, F.exp(-((d - home) * (d - home)) / (2.0 * distributor.sigma**2))))

    return F.flatten(F.transform(parts, one))


def doubles(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def encode(samples: DataFrame, intervals: Intervals, vector: str = "features", out: str = "activations") -> DataFrame:
    """Add the activations of each sample."""
    edges = F.array(*(doubles(e) for e in intervals.edges)) if intervals.edges else None
    column = activations(F.col(vector).cast("array<double>"), doubles(intervals.low), doubles(intervals.high), intervals.count, intervals.distributor, edges)
    return samples.withColumn(out, column)


def activation_matrix(encoded: DataFrame, key: str, count: int, column: str = "activations") -> DataFrame:
    """(key, k, a): the sparse matrix with column k = feature * count + interval; entries of one place are summed."""
    entries = encoded.select(key, F.explode(column).alias("x"))
    return entries.groupBy(key, (F.col("x.feature") * count + F.col("x.interval")).alias("k")).agg(F.sum("x.coefficient").alias("a"))


# --- arrays ---------------------------------------------------------------------------------------


def triangular_array(x: np.ndarray, intervals: Intervals) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower interval, its coefficient, upper interval, its coefficient), each (samples, features), of triangular activations without edges; each of them counts."""
    low = np.array(intervals.low)
    width = np.array(intervals.high) - low
    wide = width > EPSILON
    p = x - low
    p /= np.where(wide, width, 1.0)
    bad = ~np.isfinite(x)
    np.clip(p, 0.0, 1.0, out=p)
    p[:, ~wide] = 0.0
    if bad.any():
        p[bad] = 0.0
    p *= intervals.count - 1
    left, right = np.floor(p), np.ceil(p)
    return left.astype(np.int64), 1.0 - (p - left), right.astype(np.int64), 1.0 - (right - p)


def encode_array(x: np.ndarray, intervals: Intervals) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(interval, coefficient, valid), each (samples, features, width): the same encoding for a batch in numpy."""
    d, kind = intervals.count, intervals.distributor
    if kind.kind == "triangular" and intervals.edges is None and d > 1:
        left, a, right, b = triangular_array(x, intervals)
        return np.stack([left, right], axis=2), np.stack([a, b], axis=2), np.ones((*x.shape, 2), bool)
    low, high = np.array(intervals.low), np.array(intervals.high)
    width = high - low
    usable = np.isfinite(x) & (width > EPSILON)
    position = np.where(usable, np.clip((np.where(usable, x, 0.0) - low) / np.where(width > EPSILON, width, 1.0), 0.0, 1.0), 0.0)
    if intervals.edges is not None:
        upper = np.array(intervals.edges)[:, 1:]
        home = np.minimum((upper[None] < x[:, :, None]).sum(axis=2), d - 1)
        home = np.where(np.isfinite(x), home, 0)
    else:
        home = np.minimum(np.floor(position * d).astype(np.int64), d - 1)
    if d == 1 or kind.kind == "hard":
        at = home[:, :, None] * (d > 1)
        return at, np.ones(at.shape), np.ones(at.shape, bool)
    if kind.kind == "triangular":
        p = home.astype(float) if intervals.edges is not None else position * (d - 1)
        left, right = np.floor(p), np.ceil(p)
        at = np.stack([left, right], axis=2).astype(np.int64)
        c = np.stack([1.0 - (p - left), 1.0 - (right - p)], axis=2)
        return at, c, c > 0
    steps = np.arange(-kind.radius, kind.radius + 1)
    at = home[:, :, None] + steps
    valid = (at >= 0) & (at < d)
    c = np.broadcast_to(np.exp(-(steps**2) / (2.0 * kind.sigma**2)), at.shape)
    return np.clip(at, 0, d - 1), np.where(valid, c, 0.0), valid
