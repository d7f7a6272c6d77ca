"""What SQL texts can call: functions over vectors, which Spark inlines, and table functions that see a partition of their table at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.vectors import EPSILON, METRICS
from ..operators import images, library
from ..operators.interval_model import as_matrix
from ..operators.nearest import Best, results
from ..session import kept

_ROW = "ARRAY<DOUBLE>"
_SUM = "aggregate({}, 0D, (s, x) -> s + x)"

#: Name: (parameters, type, body) of the functions that are SQL themselves, those that others call first. They stay in Spark's own expressions.
SCALARS = {
    "vector_dot": (f"a {_ROW}, b {_ROW}", "DOUBLE", _SUM.format("zip_with(a, b, (x, y) -> x * y)")),
    "vector_squared_distance": (f"a {_ROW}, b {_ROW}", "DOUBLE", _SUM.format("zip_with(a, b, (x, y) -> (x - y) * (x - y))")),
    "vector_euclidean": (f"a {_ROW}, b {_ROW}", "DOUBLE", "1D / (1D + sqrt(vector_squared_distance(a, b)))"),
    "vector_cosine": (
        f"a {_ROW}, b {_ROW}",
        "DOUBLE",
        f"CASE WHEN vector_dot(a, a) <= {EPSILON!r} OR vector_dot(b, b) <= {EPSILON!r} THEN 0D ELSE vector_dot(a, b) / (sqrt(vector_dot(a, a)) * sqrt(vector_dot(b, b))) END",
    ),
    "vector_hamming": (f"a {_ROW}, b {_ROW}, t DOUBLE", "DOUBLE", "CASE WHEN size(a) = 0 THEN 0D ELSE aggregate(zip_with(a, b, (x, y) -> CASE WHEN (x >= t) = (y >= t) THEN 1D ELSE 0D END), 0D, (s, x) -> s + x) / size(a) END"),
    "unit_position": ("x DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", f"CASE WHEN high - low <= {EPSILON!r} OR isnan(x) OR abs(x) = double('Infinity') THEN 0D ELSE least(greatest((x - low) / nullif(high - low, 0D), 0D), 1D) END"),
    "hard_interval": ("position DOUBLE, n INT", "BIGINT", "CAST(least(floor(position * n), n - 1) AS BIGINT)"),
}


class Patches:
    """patches(size, stride, TABLE(images) PARTITION BY (image_id)): the grid of patches of images (image_id, width, height)."""

    def eval(self, patch: pa.Array, stride: pa.Array, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        if rows.num_rows:
            n, step = patch[0].as_py(), stride[0].as_py()
            if n < 1 or step < 1:
                raise ConfigError("patch size and stride must be positive")
            ids, widths, heights = (rows.column(c).to_pylist() for c in ("image_id", "width", "height"))
            grid = [(i, x, y, min(n, w - x), min(n, h - y)) for i, w, h in zip(ids, widths, heights) for x in images.patch_starts(w, n, step) for y in images.patch_starts(h, n, step)]
            yield pa.table([pa.array(c, pa.int64()) for c in zip(*grid)], names=["image_id", "x", "y", "w", "h"])


class ImagePatches:
    """image_patches(image_size, features, resize, size, stride, TABLE(images) PARTITION BY (image_id)): patches of images (image_id, image) with their vectors."""

    def eval(self, size: pa.Array, features: pa.Array, resize: pa.Array, patch: pa.Array, stride: pa.Array, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        if rows.num_rows:
            config = images.VectorConfig(size[0].as_py(), size[0].as_py(), features[0].as_py(), resize[0].as_py())
            n, step = patch[0].as_py(), stride[0].as_py()
            for image_id, r in zip(rows.column("image_id").to_pylist(), rows.column("image").to_pylist()):
                pixels = images.decode_row(r["data"], r["height"], r["width"], r["nChannels"])
                parts = [(x, y, pixels[y : y + n, x : x + n]) for x in images.patch_starts(r["width"], n, step) for y in images.patch_starts(r["height"], n, step)]
                columns = [[image_id] * len(parts), *zip(*((x, y, p.shape[1], p.shape[0]) for x, y, p in parts))]
                vectors = pa.array([images.image_vector(p, config) for _, _, p in parts], pa.list_(pa.float64()))
                yield pa.table([*(pa.array(c, pa.int64()) for c in columns), vectors], names=["image_id", "x", "y", "w", "h", "vector"])


class Nearest:
    """nearest(k, metric, threshold, TABLE(sides) PARTITION BY (part)): the k most similar stored vectors of a part for each of its queries.

    ``sides`` has part, side (query or ref), id, label (of refs) and vector.
    Stored vectors that are dealt out by part meet queries that are in every
    part; the best of all parts are then ranked. Within a part queries are
    scored as they pass, in blocks, and rows come in any order.
    """

    def __init__(self):
        self.sides: dict[str, list[tuple]] = {"query": [], "ref": []}
        self.asked = None

    def eval(self, k: pa.Array, metric: pa.Array, threshold: pa.Array, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        if rows.num_rows:
            self.asked = k[0].as_py(), metric[0].as_py(), float(threshold[0].as_py())
            if self.asked[1] not in METRICS:
                raise ConfigError(f"unknown metric {self.asked[1]}")
            side = np.array(rows.column("side").to_pylist())
            for name, held in self.sides.items():
                own = rows.filter(pa.array(side == name))
                if own.num_rows:
                    labels = own.column("label").fill_null(-1).to_numpy(zero_copy_only=False)
                    held.append((own.column("id").to_numpy(zero_copy_only=False), labels, as_matrix(own.column("vector"))))
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        if self.sides["query"] and self.sides["ref"]:
            k, metric, threshold = self.asked
            ids, labels, r = (np.concatenate(x) for x in zip(*self.sides["ref"]))
            find = library.dense_finder(metric, threshold)(r, ids, labels, k, False)
            for own, _, q in self.sides["query"]:
                found = Best(len(own), k, False)
                find(q, own, found)
                yield pa.table([pa.array(x) for x in results(own, found)], names=["query_id", "ref_id", "label", "score"])


class _Gathered:
    """A table function of k, a metric and a table, whose partitions are worked on whole, as they are dealt out."""

    def __init__(self):
        self.asked, self.held = None, []

    def eval(self, k: pa.Array, metric: pa.Array, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        if rows.num_rows:
            self.asked = k[0].as_py(), metric[0].as_py()
            self.held.append(rows)
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        if self.held:
            for batch in self.work(iter(self.held), *self.asked):
                yield pa.Table.from_batches([batch])


class NearestAlone(_Gathered):
    """nearest_alone(k, metric, TABLE(blocks)): vectors that ``library.dealt`` has dealt out, each with its k most similar others of its block."""

    work = staticmethod(library.alone)


class NearestMet(_Gathered):
    """nearest_met(k, metric, TABLE(meetings)): what each two blocks of ``library.meetings`` find in each other."""

    work = staticmethod(library.together)


class Activations:
    """activations(n, TABLE(samples)): the triangular activations of samples (sample_id, features, low, high) in n intervals, a row each."""

    def eval(self, count: pa.Array, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        if rows.num_rows:
            n, ids = count[0].as_py(), rows.column("sample_id").to_numpy(zero_copy_only=False)
            x, low, high = (as_matrix(rows.column(c)) for c in ("features", "low", "high"))
            width = high - low
            usable = np.isfinite(x) & (width > EPSILON)
            p = np.where(usable, np.clip((np.where(usable, x, 0.0) - low) / np.where(width > EPSILON, width, 1.0), 0.0, 1.0), 0.0) * (n - 1)
            left, right = np.floor(p), np.ceil(p)
            features = np.broadcast_to(np.arange(x.shape[1]), x.shape)
            parts = [(np.repeat(ids, x.shape[1]), features.ravel(), at.astype(np.int64).ravel(), c.ravel()) for at, c in ((left, 1.0 - (p - left)), (right, 1.0 - (right - p)))]
            yield pa.table([pa.array(np.concatenate(c)) for c in zip(*parts)], names=["sample_id", "feature", "interval", "coefficient"])


#: Name: (handler, type) of the table functions.
TABLES = {
    "patches": (Patches, "image_id bigint, x bigint, y bigint, w bigint, h bigint"),
    "image_patches": (ImagePatches, "image_id bigint, x bigint, y bigint, w bigint, h bigint, vector array<double>"),
    "nearest": (Nearest, library.NEIGHBORS),
    "nearest_alone": (NearestAlone, library.MET_ITSELF),
    "nearest_met": (NearestMet, library.NEIGHBORS),
    "activations": (Activations, "sample_id bigint, feature bigint, interval bigint, coefficient double"),
}


def register(spark: SparkSession, **views: DataFrame) -> None:
    """Make the functions known to a session's SQL, and tables as views under their names."""
    for name, (parameters, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, (handler, kind) in TABLES.items():
        spark.udtf.register(name, F.arrow_udtf(handler, returnType=kind))
    for name, df in views.items():
        df.createOrReplaceTempView(name)


#: The nearest of all stored vectors, dealt out over so many parts; queries are in each of them.
NEAREST = """
SELECT query_id, rank, ref_id, label, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref_id) AS BIGINT) AS rank
  FROM nearest({k}, '{metric}', {threshold}, TABLE(
    SELECT pmod(xxhash64(ref_id), {parts}) AS part, 'ref' AS side, ref_id AS id, label, vector FROM {refs}
    UNION ALL SELECT part, 'query', query_id, CAST(NULL AS BIGINT), vector FROM {queries} LATERAL VIEW explode(sequence(0L, {parts}L - 1L)) AS part
  ) PARTITION BY (part))
) WHERE rank <= {limit}
"""


def nearest_sql(queries: str, refs: str, k: int, metric: str = "euclidean", threshold: float = 0.5, parts: int = 8, spare: int = 0) -> str:
    """The text of a search over two views; a part gives ``spare`` neighbours more than are ranked."""
    return NEAREST.format(k=k + spare, limit=k, metric=metric, threshold=float(threshold), parts=parts, queries=queries, refs=refs)


#: The nearest others of vectors among themselves, from blocks that have met themselves and, where there are two at least, each other.
ALONE = "SELECT ref_id AS query_id, near.__ids AS ref_id, near.__labels AS label, near.__scores AS score FROM met_themselves LATERAL VIEW explode(arrays_zip(__ids, __labels, __scores)) AS near"
MET = "SELECT * FROM nearest_met({k}, '{metric}', TABLE(meetings))"
OTHERS = """
SELECT query_id, rank, ref_id, label, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref_id) AS BIGINT) AS rank FROM ({found})
) WHERE rank <= {k}
"""


def nearest_others(spark: SparkSession, refs: DataFrame, k: int, metric: str, g: int) -> DataFrame:
    """``library.nearest_others`` in SQL, by cosine or Euclidean similarity over g blocks: vectors are looked at once for each pair, not once for each of the two."""
    register(spark, blocks=library.dealt(refs, g))
    rows = kept(spark.sql(f"SELECT * FROM nearest_alone({k}, '{metric}', TABLE(blocks))"))
    found = [ALONE]
    if g > 1:
        found.append(MET.format(k=k, metric=metric))
        library.meetings(rows, g).createOrReplaceTempView("meetings")
    rows.createOrReplaceTempView("met_themselves")
    return spark.sql(OTHERS.format(found=" UNION ALL ".join(found), k=k))
