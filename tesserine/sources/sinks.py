"""Writers: nested reports as JSON, flattened ones as CSV, bundles for a closer look."""

from __future__ import annotations

import csv
import html
import io
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError


def format_per_class(column: Column | str) -> Column:
    """name=0.123456(correct/total);... of an array of per-class structs."""
    one = lambda s: F.format_string("%s=%.6f(%d/%d)", s["class_name"], s["accuracy"], s["correct"], s["total"])
    return F.array_join(F.transform(column, one), ";")


def format_confusion(column: Column | str) -> Column:
    """name=[a|b];... of an array of (actual_name, predicted_counts)."""
    one = lambda s: F.concat(s["actual_name"], F.lit("=["), F.array_join(s["predicted_counts"].cast("array<string>"), "|"), F.lit("]"))
    return F.array_join(F.transform(column, one), ";")


def format_scores(column: Column | str) -> Column:
    """class=0.123456;... of an array of (class_name, score)."""
    return F.array_join(F.transform(column, lambda s: F.format_string("%s=%.6f", s["class_name"], s["score"])), ";")


def flatten(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that CSV can hold them; others stay."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields))


def write_report(df: DataFrame, path: str, form: str = "json", mode: str = "errorifexists") -> None:
    """One file of a report of bounded size."""
    if form == "json":
        df.coalesce(1).write.mode(mode).json(path)
    elif form == "csv":
        flatten(df).coalesce(1).write.mode(mode).csv(path, header=True)
    else:
        raise ConfigError(f"unknown form {form}")


def write_bundle(frames: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Several frames side by side, as Parquet: they may be large."""
    for name, df in frames.items():
        df.write.mode(mode).parquet(f"{path}/{safe_name(name)}")


def safe_name(text: str) -> str:
    """Letters, digits, dot, dash and underscore; all else becomes an underscore."""
    return re.sub(r"[^A-Za-z0-9._-]", "_", text) or "sample"


def index_html(title: str, rows: list[dict]) -> str:
    """A plain page with one table; for the few samples that were chosen for a closer look."""
    head = "".join(f"<th>{html.escape(str(k))}</th>" for k in (rows[0] if rows else {}))
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r.values()) + "</tr>" for r in rows)
    return f"<!doctype html><title>{html.escape(title)}</title><table><tr>{head}</tr>{body}</table>"


def write_files(spark: SparkSession, files: dict[str, bytes], path: str) -> None:
    """Small files, by their names below a path, through Spark's own file systems; for reports and the few samples chosen for a closer look."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name, data in files.items():
        at = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}")
        out = at.getFileSystem(conf).create(at, True)
        try:
            out.write(bytearray(data), 0, len(data))
        finally:
            out.close()


def csv_text(rows: list[dict]) -> str:
    """Rows of one form as CSV with a header, nested values as JSON."""
    out = io.StringIO()
    if rows:
        writer = csv.DictWriter(out, [*rows[0]], lineterminator="\n")
        writer.writeheader()
        writer.writerows([{k: json.dumps(v) if isinstance(v, (list, dict)) else v for k, v in r.items()} for r in rows])
    return out.getvalue()


def write_siblings(spark: SparkSession, out: str, tables: dict[str, list[dict]]) -> None:
    """<out without its ending>.<name>.csv for each table."""
    folder, _, name = out.rstrip("/").rpartition("/")
    stem = name.rpartition(".")[0] or name
    write_files(spark, {f"{stem}.{k}.csv": csv_text(rows).encode() for k, rows in tables.items()}, folder or ".")
