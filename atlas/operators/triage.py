"""Label consensus of neighbours, and what follows from it: fixes, review queue, exemplars, purity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlas.operators.neighbours import top_k

NEIGHBOURS = 15
OWN_LIMIT = 0.45
STRENGTH = 0.60
HISTOGRAM = 4
SUGGESTIONS = 3


def label_neighbours(items: DataFrame, k: int = NEIGHBOURS, group: str = "group_id", label: str = "label",
                     block_rows: int | None = None) -> DataFrame:
    """Cross-group neighbours that carry their label: ``src, dst, rank, score, dst_label``."""
    return top_k(items, k=k, exclude=group, carry=label, block_rows=block_rows)


def consensus(items: DataFrame, neighbours: DataFrame, k: int = NEIGHBOURS, label: str = "label") -> DataFrame:
    """Per item: ``own`` (share of its neighbours that agree), ``consensus`` and its ``strength`` (votes
    over ``k``), and ``votes``, the neighbour labels by count. No neighbour: all null, the item stays."""
    votes = neighbours.groupBy("src", "dst_label").agg(F.count(F.lit(1)).cast("int").alias("n"))
    ballot = votes.groupBy("src").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), F.col("dst_label").alias("label"))))
        .alias("_b"))
    rows = items.join(ballot.withColumnRenamed("src", "id"), "id", "left")
    ordered = F.transform("_b", lambda v: F.struct(v["label"].alias("label"), (-v["minus"]).alias("n")))
    total = F.aggregate("votes", F.lit(0), lambda acc, v: acc + v["n"])
    agreeing = F.aggregate(
        F.filter("votes", lambda v: v["label"] == F.col(label).cast("string")), F.lit(0),
        lambda acc, v: acc + v["n"])
    return (
        rows.withColumn("votes", ordered)
        .withColumn("own", agreeing / total)
        .withColumn("consensus", F.col("votes")[0]["label"])
        .withColumn("strength", F.col("votes")[0]["n"] / F.lit(k))
        .drop("_b")
    )


def histogram(votes: str = "votes", top: int = HISTOGRAM):
    """Map label -> count of the most frequent neighbour labels."""
    return F.map_from_entries(F.slice(F.col(votes), 1, top))


def suggestions(votes: str = "votes", top: int = SUGGESTIONS):
    """The first labels a reviewer is offered."""
    return F.transform(F.slice(F.col(votes), 1, top), lambda v: v["label"])


def triage(scored: DataFrame, own_limit: float = OWN_LIMIT, strength: float = STRENGTH, label: str = "label",
           has_file: str | None = None) -> DataFrame:
    """Add ``decision``: keep, fix (strong disagreement) or review (weak, and there is a file to check)."""
    available = F.col(has_file) if has_file else F.lit(True)
    weak = F.col("own") < own_limit
    decision = (
        F.when(F.col("consensus").isNull() | (F.col("consensus") == F.col(label).cast("string")), "keep")
        .when(weak & (F.col("strength") >= strength), "fix")
        .when(weak & available, "review")
        .otherwise("keep")
    )
    return scored.withColumn("decision", decision)


def auto_fixes(triaged: DataFrame, key: str = "id", label: str = "label") -> DataFrame:
    return triaged.where(F.col("decision") == "fix").select(
        key, F.col(label).alias("old"), F.col("consensus").alias("new"), F.round("own", 2).alias("own"))


def review_queue(triaged: DataFrame, seq: str = "id") -> DataFrame:
    """Most uncertain first."""
    return triaged.where(F.col("decision") == "review").orderBy(F.round("own", 2), seq)


def exemplars(scored: DataFrame, label: str = "label", key: str = "id", has_file: str | None = None) -> DataFrame:
    """Per class the row its neighbours agree with most; the first one on a tie."""
    rows = scored.where(F.col("own").isNotNull())
    if has_file:
        rows = rows.where(F.col(has_file))
    best = F.struct((-F.col("own")).alias("minus"), F.col(key))
    return rows.groupBy(label).agg(F.min_by(key, best).alias(key), F.max("own").alias("own"))


def purity(scored: DataFrame, label: str = "label") -> DataFrame:
    return scored.groupBy(label).agg(F.avg("own").alias("purity"), F.count("own").alias("n"))


def triage_sweep(scored: DataFrame, own_limits: Sequence[float], strengths: Sequence[float],
                 label: str = "label") -> DataFrame:
    """Rows an automatic fix would touch per pair of thresholds, from one pass over the rows.

    Own share and strength are fractions of a few votes, so the rows first shrink to their distinct
    pairs; the grid is applied to that table.
    """
    candidates = scored.where(F.col("consensus") != F.col(label).cast("string"))
    pairs = candidates.groupBy("own", "strength").agg(F.count(F.lit(1)).alias("n"))
    grid = F.array(*[F.struct(F.lit(float(o)).alias("own_limit"), F.lit(float(s)).alias("min_strength"))
                     for o in own_limits for s in strengths])
    hit = (F.col("own") < F.col("g.own_limit")) & (F.col("strength") >= F.col("g.min_strength"))
    return (
        pairs.withColumn("g", F.explode(grid))
        .groupBy("g.own_limit", "g.min_strength")
        .agg(F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("fixed"))
    )


