"""Exact row numbers without gathering a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket holds on average, and the most buckets that the order is cut into.
BUCKET_ROWS, MOST_BUCKETS = 256, 65_536


def bucket_count(rows: int) -> int:
    """Buckets for ``rows`` rows; bounded, so that the table of bucket totals stays small at any size."""
    return max(1, min(MOST_BUCKETS, -(-rows // BUCKET_ROWS)))


def exact_rank(df: DataFrame, group: list[str], bucket: str, order: list[Column | str], out: str) -> DataFrame:
    """Add ``out``: the row's 0-based place in its group, ordered by ``bucket`` and then ``order``.

    ``bucket`` must rise with the order and neither it nor ``group`` may be
    null. Only the totals of buckets are summed in a group's order; rows are
    numbered within their own bucket, so a group of any size spreads over
    as many tasks as it has buckets. ``df`` is read twice.
    """
    keys = [*group, bucket]
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.join(starts, keys).withColumn(out, F.col("__before") + within - 1).drop("__before")
