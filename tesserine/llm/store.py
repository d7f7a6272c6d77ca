"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What goes to Python at once while an intermediate table is made, at most; sets of shingles and long texts make wide rows.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}

#: The tables made within each open ``scratch``, innermost last.
_open: ContextVar[tuple[list, ...]] = ContextVar("open", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset (local tests), a new temporary one. Elsewhere than in local mode the setting is needed."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tesserine-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses; it goes when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tesserine/{label}-{uuid.uuid4().hex}"
    at, fs = _file_system(spark, path)
    fs.deleteOnExit(at)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stored table before the JVM ends."""
    at, fs = _file_system(spark, path)
    fs.delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables stored within it, but those stored with ``outlive``, which belong to the scratch around it."""
    made: list[str] = []
    token = _open.set((*_open.get(), made))
    try:
        yield
    finally:
        _open.reset(token)
        for path in made:
            remove(spark, path)


def materialize(df: DataFrame, label: str, outlive: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts lineage, survives lost executors, and gives the planner true sizes,
    so that it broadcasts a table only if its files are small enough. The
    files go at the end of the ``scratch`` that they belong to, or when the
    driver's JVM ends.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    before = {k: spark.conf.get(k) for k in BATCHES}
    for k, v in BATCHES.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    scopes = _open.get()[: -1 if outlive else None]
    if scopes:
        scopes[-1].append(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored = path
    return stored


def release(df: DataFrame) -> None:
    """Delete a table that ``materialize`` has stored; nothing may read it any more. Other tables stay."""
    if path := getattr(df, "_stored", None):
        remove(df.sparkSession, path)


def plain_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """(``df`` with its columns named c0, c1 and so on, these names by the true ones), so that no caller's name can clash with an operator's own."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names))


def true_names(names: dict[str, str], but: Iterable[str] = ()) -> list[Column]:
    """The columns of ``plain_names`` under their true names, without those of ``but``."""
    return [F.col(plain).alias(true) for true, plain in names.items() if true not in but]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables of a query."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
