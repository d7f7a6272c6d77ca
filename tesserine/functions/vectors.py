"""Columns over dense vectors (array<double>). All stay on the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The smallest step from 1.0; norms, widths and denominators up to it count as zero.
EPSILON = 2.0**-52
METRICS = ("cosine", "euclidean", "hamming", "jaccard")


def as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_doubles(x: Column | str) -> Column:
    """The vector as array<double>; cast before any arithmetic."""
    return as_column(x).cast("array<double>")


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def clamp(x: Column, low: float | Column = 0.0, high: float | Column = 1.0) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.least(F.greatest(x, low), high)


def safe_div(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """a / b, or ``otherwise`` where b is zero or null."""
    return F.when(b != 0, a / b).otherwise(F.lit(otherwise))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either squared norm is at most EPSILON."""
    p, q = dot(a, a), dot(b, b)
    return F.when((p <= EPSILON) | (q <= EPSILON), F.lit(0.0)).otherwise(dot(a, b) / (F.sqrt(p) * F.sqrt(q)))


def euclidean_similarity(a: Column, b: Column) -> Column:
    return 1.0 / (1.0 + F.sqrt(squared_distance(a, b)))


def dense_hamming(a: Column, b: Column, threshold: float) -> Column:
    """Share of positions on the same side of the threshold; 0 for empty vectors."""
    same = total(F.zip_with(a, b, lambda x, y: F.when((x >= threshold) == (y >= threshold), 1.0).otherwise(0.0)))
    return safe_div(same, F.size(a).cast("double"))


def dense_jaccard(a: Column, b: Column, threshold: float) -> Column:
    """Intersection over union of the positions at or over the threshold; 1 for an empty union."""
    both = total(F.zip_with(a, b, lambda x, y: F.when((x >= threshold) & (y >= threshold), 1.0).otherwise(0.0)))
    either = total(F.zip_with(a, b, lambda x, y: F.when((x >= threshold) | (y >= threshold), 1.0).otherwise(0.0)))
    return safe_div(both, either, 1.0)


def similarity(metric: str, a: Column, b: Column, threshold: float = 0.5) -> Column:
    """One of METRICS between two vector columns."""
    if metric == "cosine":
        return cosine(a, b)
    if metric == "euclidean":
        return euclidean_similarity(a, b)
    if metric == "hamming":
        return dense_hamming(a, b, threshold)
    if metric == "jaccard":
        return dense_jaccard(a, b, threshold)
    raise ValueError(f"unknown metric {metric}")


def contributions(metric: str, a: Column, b: Column, threshold: float = 0.5) -> Column:
    """What each feature adds to the similarity, as array<double>."""
    pick = {
        "cosine": lambda x, y: x * y,
        "euclidean": lambda x, y: -F.abs(x - y),
        "hamming": lambda x, y: F.when((x >= threshold) == (y >= threshold), 1.0).otherwise(0.0),
        "jaccard": lambda x, y: F.when((x >= threshold) & (y >= threshold), 1.0).otherwise(0.0),
    }
    return F.zip_with(a, b, pick[metric])


def top_contributions(values: Column, n: int) -> Column:
    """The n largest (feature, contribution) of an array, ties by feature."""
    keyed = F.transform(values, lambda v, i: F.struct((-v).alias("k"), i.alias("feature"), v.alias("contribution")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda s: F.struct(s["feature"].cast("long").alias("feature"), s["contribution"].alias("contribution")))


def argmax_last(values: Column) -> Column:
    """Index of the largest value, the last one on ties; NaN counts as largest; 0 for an empty array."""
    keyed = F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    return F.coalesce(F.array_max(keyed)["i"], F.lit(0)).cast("long")


def one_hot(label: Column | str, classes: int) -> Column:
    """Indicator array; all zeros for labels out of range."""
    label = as_column(label)
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(i == label, 1.0).otherwise(0.0))


def mean_squared(a: Column, b: Column) -> Column:
    """Mean of squared differences; 0 for empty arrays."""
    return safe_div(squared_distance(a, b), F.size(a).cast("double"))


def unit_position(x: Column, low: Column, high: Column) -> Column:
    """Place of x between two ends, clamped to 0..1; 0 where x is not finite or the width is at most EPSILON."""
    width = high - low
    return F.when((width <= EPSILON) | ~finite(x), F.lit(0.0)).otherwise(clamp((x - low) / F.when(width <= EPSILON, 1.0).otherwise(width)))


def column_array(names: list[str]) -> Column:
    """Numeric columns as one vector."""
    return F.array(*(F.col(n).cast("double") for n in names))


def any_true(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
