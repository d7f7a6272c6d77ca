"""Batch epochs of interval models that are tables: weights never come to the driver or into a task's closure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.vectors import EPSILON
from ..session import kept, release


class ModelTable:
    """Weights as rows (k, output, weight, access_count), k = feature * intervals + interval; a weight without a row is 0.

    ``activations`` has (sample_id, k, a) of all samples, entries of one place
    summed, and ``samples`` (sample_id, label) of distinct sample_id. An
    epoch is three joins and three sums by equal keys: activations meet
    weights by k, errors go back to activations by sample, and changes are
    added up by k before anything else is done with them. Spark can split
    the activations of a k that all samples have. Each epoch's rows are
    stored, in the checkpoint folder where the session has one, so lineage
    doesn't grow.
    """

    def __init__(self, activations: DataFrame, samples: DataFrame, outputs: int, proportional: bool = False, weights: DataFrame | None = None):
        if outputs < 1:
            raise ConfigError("outputs must be positive")
        spark = activations.sparkSession
        used = F.abs("a") > EPSILON
        per_sample = F.count_if(used).cast("double") if proportional else F.sum(F.col("a") * F.col("a"))
        self.outputs = outputs
        self.activations = kept(activations.select("sample_id", "k", F.col("a").cast("double").alias("a")))
        self.divisors = kept(self.activations.groupBy("sample_id").agg(F.greatest(per_sample, F.lit(EPSILON)).alias("den")).join(samples.select("sample_id", "label"), "sample_id"))
        self.usage = kept(self.activations.groupBy("k").agg(F.count_if(used).alias("usage")).where("usage > 0"))
        empty = spark.createDataFrame([], "k bigint, output bigint, weight double, access_count bigint")
        self.weights = weights if weights is not None else empty

    def epoch(self) -> float:
        """One batch epoch: errors of all samples under the same weights, averaged over the samples that use a weight. The mean squared error before."""
        sums = self.activations.join(self.weights.select("k", "output", "weight"), "k").groupBy("sample_id", "output").agg(F.sum(F.col("a") * F.col("weight")).alias("y"))
        each = self.divisors.withColumn("output", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.outputs - 1).cast("long"))))
        target = F.when(F.col("label") == F.col("output"), 1.0).otherwise(0.0)
        errors = kept(each.join(sums, ["sample_id", "output"], "left").select("sample_id", "output", "den", (target - F.coalesce("y", F.lit(0.0))).alias("e")))
        mse = errors.agg(F.avg(F.col("e") * F.col("e"))).first()[0] or 0.0
        changes = self.activations.join(errors, "sample_id").groupBy("k", "output").agg(F.sum(F.col("a") * F.col("e") / F.col("den")).alias("c"))
        moved = changes.join(self.usage, "k").select("k", "output", (F.col("c") / F.col("usage")).alias("change"), "usage")
        both = self.weights.join(moved, ["k", "output"], "full")
        told = both.select("k", "output", (F.coalesce("weight", F.lit(0.0)) + F.coalesce("change", F.lit(0.0))).alias("weight"), (F.coalesce("access_count", F.lit(0)) + F.coalesce("usage", F.lit(0))).cast("long").alias("access_count"))
        before, self.weights = self.weights, kept(told)
        release(before)
        release(errors)
        return mse

    def fit(self, epochs: int) -> list[float]:
        return [self.epoch() for _ in range(epochs)]

    def close(self) -> None:
        """Give back what is stored beside the weights."""
        for df in (self.activations, self.divisors, self.usage):
            release(df)
