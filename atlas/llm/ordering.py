"""One global order over the turns of all conversations, however long one of them is.

Rows are range-partitioned, so a conversation that holds a third of all rows is cut into contiguous blocks over
many tasks, and rows that are equal in every column are cut too. Texts stay behind: only a digest travels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlas.session import cut_lineage

BLOCK_BITS = 33  # of monotonically_increasing_id: what lies above is the partition


def turn_digest(role: Column, text: Column) -> Column:
    """Digest of a turn; equal for equal (role, text) only."""
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def in_order(turns: DataFrame, *carried: str) -> DataFrame:
    """``conv, turn, <carried>, digest, at, block`` of rows ``conv, turn, role, text`` (role and text not null).

    ``at`` ascends with (conv, turn with nulls first, role, beginning of the text, digest), and ``block`` numbers
    the partitions in that order, so a block's rows of one conversation are contiguous in ``at``. Equal rows take
    any order. The result is materialised.
    """
    rows = turns.select("conv", "turn", *carried, turn_digest(F.col("role"), F.col("text")).alias("digest"),
                        F.col("role").alias("_r"), F.substring("text", 1, 32).alias("_p"),
                        F.monotonically_increasing_id().alias("_n"))
    keys = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("_r"), F.col("_p"),
            F.col("digest"), F.col("_n")]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    return cut_lineage(ranged.select("conv", "turn", *carried, "digest", at.alias("at"))).withColumn(
        "block", F.shiftright("at", BLOCK_BITS))


def places(ordered: DataFrame) -> DataFrame:
    """``ordered`` with ``place``, the row's number in its conversation from 0.

    A block's rows of a conversation are contiguous, so only the blocks of each conversation are sorted.
    """
    blocks = ordered.groupBy("conv", "block").agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(F.col("conv").alias("_conv"), F.col("block").alias("_block"), "_first",
                           F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_ahead"))
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))
    return ordered.join(starts, same).withColumn("place", F.col("_ahead") + F.col("at") - F.col("_first")).drop(
        "_conv", "_block", "_first", "_ahead")
