"""Session defaults; every one can be overridden by the cluster's own settings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(name: str = "tesserine", **settings: str) -> SparkSession:
    """A session with the library's defaults and ``settings`` (dots as double underscores)."""
    builder = SparkSession.builder.appName(name)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def kept(df: DataFrame) -> DataFrame:
    """The rows, computed once: by a checkpoint where the session has a folder for it, which survives lost executors; else kept in memory and on disk."""
    context = df.sparkSession.sparkContext
    if df.sparkSession.conf.get("spark.checkpoint.dir", None) or context._jsc.sc().getCheckpointDir().isDefined():
        return df.checkpoint()
    rows = df.persist()
    rows.count()
    return rows


def release(df: DataFrame) -> None:
    """Give back what ``kept`` has stored in memory; files of a checkpoint go as the session's cleaner is set."""
    df.unpersist()


def shared_path(spark: SparkSession, label: str) -> str:
    """A path that nothing uses in the folder of ``spark.checkpoint.dir``, which driver and executors share; in local mode, where that is unset, in a temporary one. It goes when the driver's JVM ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tesserine-")
    path = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path
