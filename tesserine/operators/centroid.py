"""Nearest-centroid baseline."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DimensionError, EmptyInputError
from ..functions.vectors import finite
from ..session import kept
from .interval_model import as_matrix
from .library import BLOCK, QUERY_BLOCK, blocks, column, in_order, matrix
from .prep import check_rectangular, long_form

#: The most bytes of centroids that are sent to every task at once.
SENT_BYTES = 64 << 20
#: The class of what has none yet.
NONE = np.iinfo(np.int64).max

_BEST = "struct<distance: double, label: bigint>"


def fit_centroids(samples: DataFrame, label: str = "label", vector: str = "features") -> DataFrame:
    """(label, centroid, n): sums over finite values only, divided by the count of all samples of the class. Map-side combined."""
    check_rectangular(samples, vector)
    value = F.when(finite(F.col("value")), F.col("value")).otherwise(0.0)
    means = long_form(samples, vector, label).groupBy(label, "feature").agg((F.sum(value) / F.count(F.lit(1))).alias("mean"), F.count(F.lit(1)).alias("n"))
    packed = means.groupBy(F.col(label).cast("long").alias("label")).agg(F.array_sort(F.collect_list(F.struct("feature", "mean"))).alias("c"), F.max("n").alias("n"))
    return packed.select("label", F.col("c.mean").alias("centroid"), "n")


def predict_centroid(samples: DataFrame, centroids: DataFrame, vector: str = "features") -> DataFrame:
    """Add ``predicted`` (lowest class on ties) and ``distance``, squared; both null where the vector is.

    Centroids go out in blocks of at most SENT_BYTES, and past the samples one
    after the other; each sample keeps its least (distance, class) so far, so
    the number of blocks makes no difference. No ids are needed, and nothing
    is shuffled. With several blocks each pass is finished before the next.
    """
    n, width = centroids.agg(F.count(F.lit(1)), F.max(F.size("centroid"))).first()
    if not n:
        raise EmptyInputError("no centroids")
    rows = max(1, min(BLOCK, SENT_BYTES // (8 * max(width, 1))))
    own = centroids.select(F.col("label").cast("long").alias("label"), F.col("centroid").cast("array<double>").alias("vector"))
    out = samples.withColumn("__best", F.lit(None).cast(_BEST))
    for table in blocks(own, "label", n, ["label", "vector"], rows):
        sent = samples.sparkSession.sparkContext.broadcast(table)
        out = out.withColumn("__best", _nearest(sent)(F.col(vector).cast("array<double>"), F.col("__best.distance"), F.col("__best.label")))
        if n > rows:
            out = kept(out)
            sent.destroy()
    return out.withColumns({"predicted": F.col("__best.label"), "distance": F.col("__best.distance")}).drop("__best")


def _nearest(sent):
    """The lesser of what a row has and its nearest centroid of a block, as an Arrow function; a distance that is no number is beyond all others."""

    def nearest(vectors: pa.Array, distances: pa.Array, labels: pa.Array) -> pa.Array:
        there = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
        known = pc.fill_null(labels, NONE).to_numpy(zero_copy_only=False).copy()
        least = pc.fill_null(distances, np.inf).to_numpy(zero_copy_only=False).copy()
        if len(there):
            x, c, own = as_matrix(vectors.take(pa.array(there))), matrix(sent.value), column(sent.value, "label").astype(np.int64)
            if x.shape[1] != c.shape[1]:
                raise DimensionError(f"{x.shape[1]} features, expected {c.shape[1]}")
            order = np.argsort(own, kind="stable")
            for begin in range(0, len(x), QUERY_BLOCK):
                at = there[begin : begin + QUERY_BLOCK]
                d = in_order(x[begin : begin + QUERY_BLOCK], c[order], lambda p, q: (p - q) * (p - q))
                best = np.where(np.isnan(d), np.inf, d).argmin(axis=1)  # the first, so the lowest class
                found, label = d[np.arange(len(d)), best], own[order][best]
                rank = lambda v: np.where(np.isnan(v), np.inf, v)
                nearer = (known[at] == NONE) | (rank(found) < rank(least[at])) | ((rank(found) == rank(least[at])) & (label < known[at]))
                least[at], known[at] = np.where(nearer, found, least[at]), np.where(nearer, label, known[at])
        gone = pa.array(known == NONE)
        columns = [pc.if_else(gone, pa.scalar(None, kind), pa.array(values, kind)) for values, kind in ((least, pa.float64()), (known, pa.int64()))]
        return pa.StructArray.from_arrays(columns, names=["distance", "label"])

    return F.arrow_udf(nearest, _BEST)


def centroid_memory_bytes(classes: int, features: int) -> int:
    return 8 * classes * features + 8 * classes
