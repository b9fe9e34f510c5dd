"""Counts per label: progress, totals, section sizes and class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atlas.functions.labels import UNSORTED

TARGET = 150


def tally(df: DataFrame, labels: DataFrame, target: int = TARGET, label: str = "label",
          position: str = "position") -> DataFrame:
    """One row per label of the dimension, zero counts included, rarest first."""
    counts = df.where(F.col(label) != UNSORTED).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    share = F.least(n / F.lit(target), F.lit(1.0)) if target else F.lit(0.0)
    return (
        labels.join(counts, label, "left")
        .select(label, position, n.alias("n"), share.alias("progress"), (n >= target).alias("done"))
        .orderBy("n", position)
    )


def tally_totals(df: DataFrame, labels: DataFrame, target: int = TARGET, label: str = "label") -> DataFrame:
    """One row: labelled rows, held-out rows, labels of the dimension at target."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    held = F.col(label) == UNSORTED
    known = labels.select(label).withColumn("_known", F.lit(True))
    return counts.join(known, label, "left").agg(
        F.coalesce(F.sum(F.when(F.col("_known"), F.col("n"))), F.lit(0)).alias("labelled"),
        F.coalesce(F.sum(F.when(held, F.col("n"))), F.lit(0)).alias("held_out"),
        F.count_if(F.col("_known") & (F.col("n") >= target)).alias("at_target"),
    )


def section_counts(df: DataFrame, section: str = "section") -> DataFrame:
    """Section sizes, largest first."""
    return df.groupBy(section).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), section)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights ``N / (classes * n)`` and the imbalance ratio; works on the table of classes."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(0))
    return counts.select(
        label, "n",
        (F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.greatest("n", F.lit(1)))).alias("weight"),
        (F.max("n").over(every) / F.min("n").over(every)).alias("imbalance"),
    )
