"""Reports on predictions: accuracy, confusion, AUROC, F1, margins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import EPSILON, safe_div

#: Classes up to which a report writes a confusion matrix out with its zeros, besides its cells.
DENSE_CLASSES = 2_048

_as_int = lambda c: c.cast("long")


def accuracy(predictions: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """(correct, total, accuracy); 0 without rows."""
    agg = predictions.agg(F.count_if(F.col(expected) == F.col(predicted)).alias("correct"), F.count(F.lit(1)).alias("total"))
    return agg.withColumn("accuracy", safe_div(F.col("correct").cast("double"), F.col("total").cast("double")))


def per_class_accuracy(predictions: DataFrame, dim: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """(class_index, class_name, correct, total, accuracy) for every class of ``dim``; absent classes have 0."""
    counts = predictions.groupBy(F.col(expected).alias("__l")).agg(F.count_if(F.col(expected) == F.col(predicted)).alias("c"), F.count(F.lit(1)).alias("t"))
    joined = dim.join(counts, dim["label"] == counts["__l"], "left")
    correct, total = F.coalesce("c", F.lit(0)), F.coalesce("t", F.lit(0))
    share = F.when(total > 0, correct.cast("double") / F.when(total > 0, total).otherwise(1)).otherwise(0.0)
    return joined.select(F.col("label").alias("class_index"), "class_name", _as_int(correct).alias("correct"), _as_int(total).alias("total"), share.alias("accuracy"))


def confusion_cells(predictions: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """(actual_index, predicted_index, n) of the cells that aren't zero, for any number of classes."""
    return predictions.groupBy(F.col(expected).cast("long").alias("actual_index"), F.col(predicted).cast("long").alias("predicted_index")).agg(F.count(F.lit(1)).alias("n"))


def confusion(predictions: DataFrame, dim: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """(actual_index, predicted_index, n): the dense matrix in long form. The two dimensions are classes, not rows; ``confusion_cells`` leaves the zeros out."""
    counts = confusion_cells(predictions, expected, predicted).toDF("__a", "__p", "__n")
    cells = dim.select(F.col("label").alias("actual_index")).crossJoin(dim.select(F.col("label").alias("predicted_index")))
    joined = cells.join(counts, (F.col("actual_index") == F.col("__a")) & (F.col("predicted_index") == F.col("__p")), "left")
    return joined.select("actual_index", "predicted_index", F.coalesce("__n", F.lit(0)).cast("long").alias("n"))


def confusion_rows(matrix: DataFrame) -> DataFrame:
    """(actual_index, predicted_counts) with an array per class."""
    packed = matrix.groupBy("actual_index").agg(F.array_sort(F.collect_list(F.struct("predicted_index", "n"))).alias("r"))
    return packed.select("actual_index", F.col("r.n").alias("predicted_counts"))


def worst_class(per_class: DataFrame) -> DataFrame:
    """The class that has samples and the least accuracy, the first on ties."""
    return per_class.where("total > 0").orderBy("accuracy", "class_index").limit(1)


def most_common_confusion(matrix: DataFrame, last: bool = False) -> DataFrame:
    """The largest cell off the diagonal: the first that isn't zero, or (``last``) the last one, even if it is zero."""
    off = matrix.where("actual_index <> predicted_index" + ("" if last else " and n > 0"))
    side = (lambda c: F.col(c).desc()) if last else F.col
    return off.orderBy(F.col("n").desc(), side("actual_index"), side("predicted_index")).limit(1)


def auroc(rows: DataFrame, score: str = "score", positive: str = "expected") -> DataFrame:
    """(auroc): share of pairs of a positive and a negative that are in order, ties one half; 0 if a class is absent.

    Exact from sums over distinct scores: those are counted map-side first,
    then summed in order over ranges of scores and within ranges, so no task
    sorts all of them.
    """
    counts = rows.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    cuts = counts.agg(F.percentile_approx("s", [i / 256 for i in range(1, 256)], 1024).alias("__cuts"))
    ranged = counts.crossJoin(F.broadcast(cuts)).withColumn("__r", F.size(F.filter("__cuts", lambda c: c < F.col("s")))).drop("__cuts")
    blocks = ranged.groupBy("__r").agg(F.sum("n").alias("__n"))
    over = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("__r", F.coalesce(F.sum("__n").over(over), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__r").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = ranged.withColumn("__w", F.coalesce(F.sum("n").over(within), F.lit(0))).join(blocks, "__r")
    sums = below.agg(F.sum(F.col("p") * (F.col("__before") + F.col("__w") + F.col("n") / 2)).alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    pairs = F.col("p").cast("double") * F.col("n")
    return sums.select(F.coalesce(F.when(pairs > 0, F.col("w") / F.when(pairs > 0, pairs)), F.lit(0.0)).alias("auroc"))


def auroc_by(rows: DataFrame, group: str, score: str = "score", positive: str = "expected") -> DataFrame:
    """(group, auroc): what ``auroc`` gives for each group that has rows. A group isn't null."""
    counts = rows.groupBy(group, F.col(score).alias("s")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    cuts = counts.groupBy(group).agg(F.percentile_approx("s", [i / 256 for i in range(1, 256)], 1024).alias("__cuts"))
    ranged = counts.join(cuts, group).withColumn("__r", F.size(F.filter("__cuts", lambda c: c < F.col("s")))).drop("__cuts")
    over = Window.partitionBy(group).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy(group, "__r").agg(F.sum("n").alias("__n")).select(group, "__r", F.coalesce(F.sum("__n").over(over), F.lit(0)).alias("__before"))
    within = Window.partitionBy(group, "__r").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = ranged.withColumn("__w", F.coalesce(F.sum("n").over(within), F.lit(0))).join(before, [group, "__r"])
    sums = below.groupBy(group).agg(F.sum(F.col("p") * (F.col("__before") + F.col("__w") + F.col("n") / 2)).alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    pairs = F.col("p").cast("double") * F.col("n")
    return sums.select(group, F.coalesce(F.when(pairs > 0, F.col("w") / F.when(pairs > 0, pairs)), F.lit(0.0)).alias("auroc"))


def f1_columns(predicted: Column, expected: Column) -> dict[str, Column]:
    """Aggregates precision, recall and f1 (0 where precision + recall is at most EPSILON)."""
    hit, said, true = (F.count_if(c).cast("double") for c in (predicted & expected, predicted, expected))
    precision, recall = safe_div(hit, said), safe_div(hit, true)
    both = precision + recall
    return {"precision": precision, "recall": recall, "f1": F.when(both <= EPSILON, 0.0).otherwise(2.0 * precision * recall / F.when(both <= EPSILON, 1.0).otherwise(both))}


def classification_metrics(predictions: DataFrame, dim: DataFrame) -> DataFrame:
    """One row: accuracy, per_class, the confusion's cells that aren't zero, and up to DENSE_CLASSES classes the matrix with its zeros too (else null), as nested arrays."""
    per = per_class_accuracy(predictions, dim)
    nested = per.agg(F.array_sort(F.collect_list(F.struct("class_index", "class_name", "correct", "total", "accuracy"))).alias("per_class_accuracy"))
    cells = confusion_cells(predictions).agg(F.array_sort(F.collect_list(F.struct("actual_index", "predicted_index", "n"))).alias("confusion_cells"))
    told = accuracy(predictions).crossJoin(nested).crossJoin(cells)  # of one row each
    rows = "array<struct<actual_index: bigint, predicted_counts: array<bigint>>>"
    if dim.count() > DENSE_CLASSES:
        return told.withColumn("confusion_matrix", F.lit(None).cast(rows))
    dense = confusion_rows(confusion(predictions, dim)).agg(F.array_sort(F.collect_list(F.struct("actual_index", "predicted_counts"))).alias("confusion_matrix"))
    return told.crossJoin(dense)


def misclassified(predictions: DataFrame, order: str = "sample_id", limit: int = 25) -> DataFrame:
    """The first wrong predictions in sample order."""
    return predictions.where("expected <> predicted").orderBy(order).limit(limit)
