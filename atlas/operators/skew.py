"""Joins and positions that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlas.session import cut_lineage


def hot_keys(df: DataFrame, on: Sequence[str], share: float = 0.001, floor: int = 100_000) -> DataFrame:
    """Keys that hold more than ``share`` of the rows (and more than ``floor``): at most ``1 / share``.

    One aggregation of ``df``. The candidates above ``floor`` are few and are kept; the total comes from them
    and from the sum of the rest, which the same pass delivers.
    """
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    large = F.col("_n") > floor
    held = cut_lineage(counts.groupBy(F.when(large, F.struct(*on)).alias("_key")).agg(F.sum("_n").alias("_n")))
    total = held.agg(F.sum("_n")).first()[0] or 0
    return held.where(F.col("_key").isNotNull() & (F.col("_n") > max(float(floor), total * share))).select("_key.*")


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] = (),
    salts: int = 64,
    share: float = 0.001,
    floor: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Equi-join (``inner`` or ``left``) of a side that may hold hot keys.

    Adaptive execution splits skewed partitions of a join as it runs, which needs no pass over the input
    beforehand, so that is the plan. With ``floor``, keys above it and above ``share`` of the rows are spread
    over ``salts`` tasks instead, for sessions without adaptive execution.

    Only the hot keys of ``small`` are replicated. The salt is a hash of ``spread``, so a retried task
    sends every row to the same place. The list of hot keys has at most ``1 / share`` rows, which
    bounds its broadcast. ``rows``, where the caller knows it, is the size of ``big``: below ``floor``
    no key can be hot and the plain join is used.
    """
    on = list(on)
    if floor is None or (rows is not None and rows <= floor):
        return big.join(small, on, how)
    found = hot_keys(big, on, share, floor)
    if found.isEmpty():
        return big.join(small, on, how)
    hot = F.broadcast(found.withColumn("_hot", F.lit(True)))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in (spread or big.columns)]), F.lit(salts)).cast("int")
    left = big.join(hot, on, "left").withColumn(
        "_salt", F.when(F.col("_hot"), salt).otherwise(F.lit(0))
    )
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = small.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.drop("_hot").join(right, on + ["_salt"], how).drop("_salt")


def positions(
    df: DataFrame,
    by: Sequence[str],
    slices: Sequence[Column],
    order: Sequence[Column],
    out: str,
) -> DataFrame:
    """1-based ``row_number() OVER (PARTITION BY by ORDER BY slices, order)`` without one task per key.

    ``slices`` are ascending sort expressions that cut each key into ordered, bounded pieces (a time hour, a
    range of ids, a hash prefix). Rows are numbered inside a piece and shifted by the size of the
    pieces before it; only the table of pieces is ever sorted per key.
    """
    by = list(by)
    names = [f"_s{i}" for i in range(len(slices))]
    values = [expr.alias(name) for name, expr in zip(names, slices)]
    sliced = df.select("*", *values)
    sizes = sliced.groupBy(*by, *names).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*by).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    inside = Window.partitionBy(*by, *names).orderBy(*order)
    return (
        sliced.withColumn("_within", F.row_number().over(inside))
        .join(starts, by + names)
        .withColumn(out, F.col("_start") + F.col("_within"))
        .drop("_start", "_within", *names)
    )
