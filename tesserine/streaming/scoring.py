"""Models and libraries over Structured Streaming, and anomaly windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.interval_model import IntervalModel


def score_stream(stream: DataFrame, model: IntervalModel, vector: str = "features") -> DataFrame:
    """Predictions for each row of a stream; no state."""
    return model.predict(stream, vector)


def window_rates(stream: DataFrame, time: str, condition: str, window: str = "10 minutes", late: str = "30 minutes", keys: list[str] | None = None) -> DataFrame:
    """(window, keys, n, hits, rate) of a condition over tumbling windows; rows later than ``late`` are dropped by the watermark, which is what bounds the state."""
    rows = stream.withWatermark(time, late)
    agg = rows.groupBy(F.window(time, window), *(keys or [])).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr(condition)).alias("hits"))
    return agg.withColumn("rate", F.col("hits") / F.col("n"))
