"""Classifier metrics from predictions: accuracy, recall, confusion, reject sweep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(pred: DataFrame, truth: str = "label", guess: str = "pred") -> DataFrame:
    return pred.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))


def per_class(pred: DataFrame, truth: str = "label", guess: str = "pred") -> DataFrame:
    """Support, hits and recall per true class."""
    return pred.groupBy(F.col(truth).alias("label")).agg(
        F.count(F.lit(1)).alias("support"),
        F.count_if(F.col(truth) == F.col(guess)).alias("correct"),
        F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("recall"),
    )


def overall(pred: DataFrame, truth: str = "label", guess: str = "pred") -> DataFrame:
    """One row: rows, accuracy, and balanced accuracy (the mean recall over classes)."""
    return per_class(pred, truth, guess).agg(
        F.sum("support").alias("n"),
        (F.sum("correct") / F.sum("support")).alias("accuracy"),
        F.avg("recall").alias("balanced"),
    )


def reject_sweep(pred: DataFrame, cutoffs: Sequence[float], truth: str = "label", guess: str = "pred",
                 score: str = "score") -> DataFrame:
    """Per cutoff: share rejected, share of the rejected that were wrong, accuracy on the rest.

    All cutoffs are conditional sums of a single aggregation; no row is repeated per cutoff.
    """
    right = F.col(truth) == F.col(guess)
    sums = []
    for i, cut in enumerate(cutoffs):
        low = F.col(score) < cut
        sums += [F.count_if(low).alias(f"r{i}"), F.count_if(low & ~right).alias(f"w{i}"),
                 F.count_if(~low & right).alias(f"k{i}")]
    one = pred.agg(F.count(F.lit(1)).alias("n"), *sums)
    rows = F.array(*[
        F.struct(F.lit(float(c)).alias("cutoff"), F.col(f"r{i}").alias("r"), F.col(f"w{i}").alias("w"),
                 F.col(f"k{i}").alias("k"))
        for i, c in enumerate(cutoffs)
    ])
    return one.select("n", F.explode(rows).alias("s")).select(
        "s.cutoff",
        F.try_divide("s.r", "n").alias("rejected"),
        F.try_divide("s.w", "s.r").alias("deserved"),
        F.try_divide(F.col("s.k"), F.col("n") - F.col("s.r")).alias("accuracy_kept"),
    )
