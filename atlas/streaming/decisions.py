"""Review decisions and map corrections, as batch folds and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DROP_MARK = "notdrum"
NEUTRAL_MARKS = ("keep", "skip")


def replay_decisions(df: DataFrame, key: str = "hash", seq: str = "seq") -> DataFrame:
    """``key, label, dropped``: the last real label per key, null if none; a drop mark is permanent.

    One aggregation with map-side partial results; it runs on a stream as it does on a table.
    """
    real = ~F.col("label").isin(DROP_MARK, *NEUTRAL_MARKS)
    return df.groupBy(key).agg(
        F.max_by("label", F.when(real, F.col(seq))).alias("_l"),
        F.max(F.when(real, 1).otherwise(0)).alias("_any"),
        F.bool_or(F.col("label") == DROP_MARK).alias("dropped"),
    ).select(key, F.when(F.col("_any") == 1, F.col("_l")).alias("label"), "dropped")


def real_moves(df: DataFrame) -> DataFrame:
    """A move to the current section cannot happen on the map; such rows are noise."""
    return df.where(F.col("from_section") != F.col("to_section"))


def journeys(moves: DataFrame, session: str | None = None) -> DataFrame:
    """First origin and last target per path (and session). Works on streams."""
    keys = ["path"] + ([session] if session else [])
    return real_moves(moves).groupBy(*keys).agg(
        F.min_by("from_section", "seq").alias("origin"), F.max_by("to_section", "seq").alias("section"),
        F.max("seq").alias("seq"))


def fold_corrections(moves: DataFrame, session: str | None = None) -> DataFrame:
    """``path, section``: where each item finally belongs; items back at their origin have no row.

    Returning to the origin erases a correction, and a later journey starts from that same section, so
    first origin and last target are enough. Sessions have origins of their own; one that ends where
    it began leaves an earlier session's correction standing.
    """
    trips = journeys(moves, session)
    away = trips.where(F.col("section") != F.col("origin"))
    if session is None:
        return away.select("path", "section")
    return away.groupBy("path").agg(F.max_by("section", "seq").alias("section"))


def apply_moves_counts(counts: DataFrame, moves: DataFrame) -> DataFrame:
    """Section sizes after the moves: one less at the origin (never below 0), one more at the target."""
    real = real_moves(moves)
    steps = F.array(F.struct(F.col("from_section").alias("section"), F.lit(-1).alias("d")),
                    F.struct(F.col("to_section").alias("section"), F.lit(1).alias("d")))
    deltas = real.select(F.explode(steps).alias("s")).select("s.section", F.col("s.d").cast("long").alias("n"))
    return counts.select("section", F.col("n").cast("long").alias("n")).unionByName(deltas).groupBy("section").agg(
        F.greatest(F.sum("n"), F.lit(0)).alias("n"))
