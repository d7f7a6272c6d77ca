"""Labelled vectors from CSV, Parquet and seeded generators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EmptyInputError
from ..operators.prep import label_dim, remap_labels

#: Column names that hold the label, and those that hold a path.
LABEL_NAMES = ("label", "class", "class_name", "target")
PATH_NAMES = ("path", "image", "image_path", "file")


def _numbered(df: DataFrame) -> DataFrame:
    """Rows with a sample_id in file order."""
    return df.withColumn("sample_id", F.monotonically_increasing_id())


def _labelled(rows: DataFrame, name: str, order: str | None = "sample_id") -> tuple[DataFrame, DataFrame]:
    dim = label_dim(rows, name, order)
    return remap_labels(rows, name, dim, strict=False).withColumnRenamed(name, "class_name"), dim


def read_iris(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(samples, classes) of a CSV with a header, four measures and a species, by position."""
    schema = "a double, b double, c double, d double, species string"
    rows = _numbered(spark.read.csv(path, schema=schema, header=True, enforceSchema=True))
    rows = rows.select("sample_id", F.array("a", "b", "c", "d").alias("features"), F.trim("species").alias("species"))
    return _labelled(rows, "species")


def read_embedding_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(samples, classes) of a CSV: the label by its name, the first path-like column left out, all others numbers.

    Header names are trimmed and compared in lower case. A value that is no
    number raises when the rows are read.
    """
    raw = spark.read.csv(path, header=True)
    names = {c: c.strip().lower() for c in raw.columns}
    label = next((c for c, n in names.items() if n in LABEL_NAMES), None)
    if label is None:
        raise EmptyInputError("no label column")
    skip = next((c for c, n in names.items() if n in PATH_NAMES), None)
    columns = [c for c in raw.columns if c not in (label, skip)]
    if not columns:
        raise EmptyInputError("no feature columns")
    quoted = lambda c: F.col(f"`{c}`")
    rows = _numbered(raw).select("sample_id", F.array(*(F.trim(quoted(c)).cast("double") for c in columns)).alias("features"), F.trim(quoted(label)).alias("__label"))
    if rows.isEmpty():
        raise EmptyInputError("no rows")
    return _labelled(rows, "__label")


def read_parquet_vectors(spark: SparkSession, path: str, key: str, vector: str, label: str) -> DataFrame:
    """(sample_id, features, label) of a Parquet table."""
    return spark.read.parquet(path).select(F.col(key).cast("long").alias("sample_id"), F.col(vector).cast("array<double>").alias("features"), F.col(label).cast("long").alias("label"))


#: Keys of what isn't a pixel begin here.
JITTER = 1_000_000


def uniform(seed: int, *keys: Column) -> Column:
    """A number within 0..1 from a seed and keys below 2**31, by arithmetic on 32 bits; the same wherever it is computed, in SQL too."""
    most = F.lit(1 << 32)
    h = F.lit(seed % (1 << 32))
    for k in keys:
        h = (h * 69_069 + k.cast("long") * 2_654_435_761 + 12_345) % most
    for _ in range(2):
        h = h.bitwiseXOR(F.shiftright(h, 16)) * 73_244_475 % most
    return h.bitwiseXOR(F.shiftright(h, 16)) / F.lit(float(1 << 32))


def uniform_sql(seed: int, *keys: str) -> str:
    """The same in DuckDB's SQL."""
    h = f"{seed % (1 << 32)}::BIGINT"
    for k in keys:
        h = f"(({h}) * 69069 + ({k})::BIGINT * 2654435761 + 12345) % 4294967296"
    spread = "list_reduce([({h}), 73244475, 73244475], lambda a, m: xor(a, a >> 16) * m % 4294967296)".format(h=h)
    return f"list_transform([{spread}], lambda a: xor(a, a >> 16) / 4294967296::DOUBLE)[1]"


def synthetic_points(spark: SparkSession, seed: int = 42, per_class: int = 80) -> tuple[DataFrame, DataFrame]:
    """Three square blobs (a, b, c) in the unit square."""
    centres = F.array(*(F.array(F.lit(x), F.lit(y)) for x, y in ((0.15, 0.15), (0.85, 0.2), (0.5, 0.85))))
    rows = spark.range(3 * per_class).select(F.col("id").alias("sample_id"), F.floor(F.col("id") / per_class).alias("label"))
    at = lambda i: F.least(F.greatest(centres[F.col("label").cast("int")][i] + uniform(seed, F.col("sample_id"), F.lit(i)) * 0.1 - 0.05, F.lit(0.0)), F.lit(1.0))
    dim = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "label bigint, class_name string")
    return rows.select("sample_id", F.array(at(0), at(1)).alias("features"), "label"), dim


def synthetic_lines(spark: SparkSession, width: int = 12, height: int = 12, per_class: int = 12, seed: int = 123) -> tuple[DataFrame, DataFrame]:
    """Grey images (features: pixels by rows) of a vertical, a horizontal or two diagonal lines, on noise."""
    rows = spark.range(3 * per_class).select(F.col("id").alias("sample_id"), F.floor(F.col("id") / per_class).alias("label"))

    def centre(size: int, key: int) -> Column:
        jitter = F.floor(uniform(seed, F.col("sample_id"), F.lit(JITTER + key)) * 3).cast("int") - 1
        return F.lit(size // 2) + (jitter if size > 2 else F.lit(0))

    def pixel(i: Column) -> Column:
        x, y = i % width, F.floor(i / width)
        near = lambda a, b: F.abs(a - b) <= 1
        line = F.when(F.col("label") == 0, near(x, centre(width, 1))).when(F.col("label") == 1, near(y, centre(height, 2)))
        line = line.otherwise(near(x, y) | near(x, F.greatest(F.lit(width - 1) - y, F.lit(0))))
        draw = uniform(seed, F.col("sample_id"), i)
        return F.when(line, F.lit(0.85) + draw * 0.15).otherwise(draw * 0.12)

    dim = spark.createDataFrame([(0, "vertical"), (1, "horizontal"), (2, "diagonal")], "label bigint, class_name string")
    pixels = F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), pixel)
    return rows.select("sample_id", pixels.alias("features"), "label"), dim
