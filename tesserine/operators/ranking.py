"""Exact row numbers and nearest-rank percentiles that no single task has to sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket holds on average, the most buckets, the cuts that narrow a percentile down, and the distinct values of a group that one task may sort.
BUCKET_ROWS, MOST_BUCKETS, CUTS, ONE_TASK = 256, 65_536, 128, 1 << 20


def bucket_count(rows: int) -> int:
    """Buckets for so many rows; bounded, so that the table of their totals is."""
    return max(1, min(MOST_BUCKETS, -(-rows // BUCKET_ROWS)))


def exact_rank(df: DataFrame, group: list[str], bucket: str, order: list[Column | str], out: str) -> DataFrame:
    """Add the row's 0-based place in its group, ordered by ``bucket`` and then ``order``.

    ``bucket`` rises with the order; neither it nor ``group`` is null. Only
    totals of buckets are summed in order; rows are numbered within buckets.
    """
    keys = [*group, bucket]
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.join(starts, keys).withColumn(out, F.col("__before") + within - 1).drop("__before")


def rank_position(n: Column, q: float) -> Column:
    """0-based place of a nearest-rank percentile: round((n - 1) * q), halves away from zero, q clamped to 0..1."""
    return F.round((n - 1) * min(max(q, 0.0), 1.0)).cast("long")


def nearest_ranks(df: DataFrame, group: str, value: str, fractions: list[float]) -> DataFrame:
    """(group, q, value): for each fraction the nearest-rank percentile of each group.

    Equal values are counted together before anything is shuffled, so ``df``
    is read once and only distinct values go on. Where a group can have more
    than ONE_TASK of them, approximate cuts deal them into ranges first:
    totals of ranges tell which one holds a rank, and values are summed up
    within their range only. So the result is exact, and a task sorts about
    a CUTS-th of a group's distinct values. Groups may be null.
    """
    spark = df.sparkSession
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("__g"), F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n")).persist()
    try:
        groups = counts.groupBy("__g").agg(F.count(F.lit(1)).alias("__distinct"), F.sum("__n").alias("__of"))
        most = groups.agg(F.max("__distinct")).first()[0] or 0
        ranged = counts.withColumn("__r", F.lit(0))
        if most > ONE_TASK:
            cuts = counts.groupBy(F.col("__g").alias("__cg")).agg(F.percentile_approx("__v", [i / CUTS for i in range(1, CUTS)], 4 * CUTS).alias("__cuts"))
            ranged = counts.join(cuts, F.col("__g").eqNullSafe(F.col("__cg"))).select("__g", "__v", "__n", _range_of("__v", "__cuts").alias("__r"))
        before = Window.partitionBy("__g").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
        totals = ranged.groupBy("__g", "__r").agg(F.sum("__n").alias("__in"))
        totals = totals.select(F.col("__g").alias("__tg"), F.col("__r").alias("__tr"), F.coalesce(F.sum("__in").over(before), F.lit(0)).alias("__before"), F.sum("__in").over(Window.partitionBy("__g")).alias("__of"))
        placed = ranged.join(totals, F.col("__g").eqNullSafe(F.col("__tg")) & (F.col("__r") == F.col("__tr")))
        upto = F.col("__before") + F.sum("__n").over(Window.partitionBy("__g", "__r").orderBy("__v"))
        wanted = F.array(*(F.struct(F.lit(q).cast("double").alias("q"), rank_position(F.col("__of"), q).alias("at")) for q in fractions))
        placed = placed.select("__g", "__v", (upto - F.col("__n")).alias("__from"), upto.alias("__to"), wanted.alias("__w"))
        found = placed.select("__g", "__v", F.explode(F.filter("__w", lambda w: (w["at"] >= F.col("__from")) & (w["at"] < F.col("__to")))).alias("__w"))
        rows = found.select(F.col("__g").alias(group), F.col("__w.q").alias("q"), F.col("__v").alias("value"))
        return spark.createDataFrame(rows.toArrow(), rows.schema)  # a row for each group and fraction
    finally:
        counts.unpersist()


def _range_of(value: str, cuts: str) -> Column:
    """How many of the sorted cuts are below a value, by halving."""
    at = F.lit(0)
    step = CUTS // 2
    while step:
        at = at + F.when(F.get(F.col(cuts), at + (step - 1)) < F.col(value), F.lit(step)).otherwise(F.lit(0))
        step //= 2
    return at
