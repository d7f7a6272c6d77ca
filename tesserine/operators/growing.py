"""Libraries that grow: a log of appended versions, and neighbours that are kept up to date from what is new."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ConfigError, DimensionError, EmptyInputError
from .library import top_k

REFS = "ref_id bigint, label bigint, vector array<double>"
TOP = "query_id bigint, rank bigint, ref_id bigint, label bigint, score double"
COMMIT = "version bigint, batch string, width bigint, rows bigint"


class Log:
    """Versions of rows below a path, each written whole before a commit makes it count. One writer at a time.

    ``data/<version>`` has a version's rows, ``commits/<version>.json`` says
    that it is there, and of which batch. A run that fails leaves nothing
    that is read, and a batch that is repeated finds its commit.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def commits(self) -> list[dict]:
        """What has been committed, in order; a row for each version."""
        folder = f"{self.path}/commits"
        if not self._fs.exists(self._at(folder)):
            return []
        return [r.asDict() for r in self.spark.read.schema(COMMIT).json(folder).where("version is not null").orderBy("version").collect()]

    def commit(self, rows: DataFrame, batch: str | None, width: int, n: int, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/data/{version}")  # over what a failed run may have left
        done, temporary = self._at(f"{self.path}/commits/{version}.json"), self._at(f"{self.path}/commits/.{version}-{uuid.uuid4().hex}")
        out = self._fs.create(temporary, False)
        out.write(bytearray(json.dumps({"version": version, "batch": batch, "width": width, "rows": n}).encode()))
        out.close()
        if self._fs.exists(done) or not self._fs.rename(temporary, done):
            raise ConfigError(f"another writer has committed version {version}")

    def read(self, after: int = 0, upto: int | None = None) -> DataFrame:
        """The rows of the versions behind ``after``, up to ``upto``."""
        own = [c["version"] for c in self.commits() if c["version"] > after and (upto is None or c["version"] <= upto)]
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{v}" for v in own)) if own else self.spark.createDataFrame([], self.schema)

    @property
    def version(self) -> int:
        return max((c["version"] for c in self.commits()), default=0)

    def forget(self, upto: int) -> None:
        """Delete the rows of versions up to one; their commits stay."""
        for c in self.commits():
            if c["version"] <= upto:
                self._fs.delete(self._at(f"{self.path}/data/{c['version']}"), True)


class GrowingLibrary(Log):
    """Reference vectors (ref_id, label, vector) that are appended batch by batch; the first batch fixes the width."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, REFS)

    def append(self, refs: DataFrame, batch: str | None = None) -> int:
        """The version that has these vectors. A batch that is known by its name is not written again; one of another width is refused whole; one without rows makes no version."""
        known = self.commits()
        for c in known:
            if batch is not None and c["batch"] == batch:
                return c["version"]
        rows = refs.select(F.col("ref_id").cast("long").alias("ref_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
        least, most, n, gone = rows.agg(F.min(F.size("vector")), F.max(F.size("vector")), F.count(F.lit(1)), F.count_if(F.col("vector").isNull())).first()
        if not n:
            return known[-1]["version"] if known else 0
        width = known[0]["width"] if known else most
        if gone or least != most or most != width:
            raise DimensionError(f"vectors of {least} to {most} features, expected {width}; {gone} are null")
        if not width:
            raise EmptyInputError("vectors without features")
        version = known[-1]["version"] + 1 if known else 1
        self.commit(rows, batch, width, n, version)
        return version

    def appender(self, name: str) -> Callable[[DataFrame, int], None]:
        """What a stream's ``foreachBatch`` takes: each batch is appended once, however often it is replayed."""
        return lambda rows, number: self.append(rows, f"{name}-{number}") and None


class Neighbours(Log):
    """The k nearest stored vectors of some queries (query_id, vector), kept below a path: an update searches only versions that are new and merges their best with those there are."""

    def __init__(self, library: GrowingLibrary, path: str, queries: DataFrame, k: int, metric: str = "euclidean", threshold: float = 0.5, exclude_self: bool = False):
        super().__init__(library.spark, path, TOP)
        self.library, self.queries, self.k = library, queries, k
        self.options = {"metric": metric, "threshold": threshold, "exclude_self": exclude_self}

    def update(self) -> DataFrame:
        """(query_id, rank, ref_id, label, score) over all that the library has now; a repeated update changes nothing."""
        seen, now = self.version, self.library.version
        if now > seen:
            found = top_k(self.queries, self.library.read(seen, now), self.k, **self.options).select("query_id", "ref_id", "label", "score")
            both = found.unionByName(self.read(seen - 1, seen).drop("rank")) if seen else found
            order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "ref_id")
            best = both.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= self.k)
            self.commit(best.select("query_id", "rank", "ref_id", "label", "score"), None, self.k, self.k, now)
            self.forget(seen)
        return self.read(now - 1, now)
