"""Mixing sources to target weights (operator 7), in DataFrame functions only.

Sizes are added up per source; targets share the budget by weight, no source beyond a multiple of its size;
a source's rate is target over size. A document is emitted floor(rate) times plus one more with a probability
equal to the fraction, decided by a hash of its id and a seed. Of a few seeds each source takes the one whose
copies come nearest to its target, from the same aggregation that a single seed would need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlas.llm.names import shielded
from atlas.session import cut_lineage

WEIGHTS = (5, 2, 1)
BUDGET = 1.5  # words to emit, as a share of all words
MOST = 2.0  # times its size that a source may be emitted
SEEDS = 16
FEW_SOURCES = 10_000  # rows of a plan that is broadcast, a few hundred kilobytes
INK = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(INK)), F.lit(0)).cast("long")


def draw(seed: Column, key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of ``md5("seed:key")``."""
    digest = F.md5(F.concat(seed.cast("string"), F.lit(":"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(2 ** 32)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET,
            most: float = MOST) -> DataFrame:
    """Add ``target`` to ``source, source_size`` (one row per source).

    Sources in code point order, null last, weigh ``weights``, repeating. Sharing the budget by weight and
    resharing what exceeds a cap ends with the capped sources at their cap and the others at one level times
    their weight. The capped ones are those of the smallest cap per weight, so running sums in that order find
    the level: at the first source that stays below its cap, where it is the highest. The table has one row per source; it is ordered in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    capped = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    stepped = (
        capped.withColumn("total", F.sum("source_size").over(whole) * budget)
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weights", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.when(F.col("left") / F.col("weights") * F.col("weight") <= F.col("cap"),
                                    F.col("left") / F.col("weights")))
        .withColumn("level", F.max("level").over(whole)))
    return stepped.select("source", "source_size",
                          F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _with_source(rows: DataFrame, plan: DataFrame, column: str) -> DataFrame:
    """Join the rows to their source's row of ``plan`` (null meets null), whose columns get a leading ``_``.

    The plan travels to the rows while it has at most ``FEW_SOURCES`` rows; beyond, both sides are shuffled.
    """
    right = plan.select(*[F.col(c).alias(f"_{c}") for c in plan.columns])
    few = plan.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    return rows.join(F.broadcast(right) if few else right, rows[column].eqNullSafe(right["_source"]))


def source_plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET,
                most: float = MOST, seeds: int = SEEDS, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source") -> DataFrame:
    """``source, source_size, target, rate, seed``, one row per source (see :func:`targets`).

    Null and empty texts have size 0; a source of such texts has target and rate 0. A null source is a source
    of its own.
    """
    sized = cut_lineage(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                                    word_count(F.col(text_col)).alias("size")))
    aims = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, most)
    aims = cut_lineage(aims.withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))
    copies = [F.sum(F.col("size") * _copies(F.col("_rate"), F.lit(s), F.col("id"))).alias(f"s{s}")
              for s in range(seeds)]
    tried = _with_source(sized, aims.select("source", "rate"), "source").groupBy("source").agg(*copies)
    miss = [F.struct(F.abs(F.col(f"s{s}") - F.col("target")).alias("miss"), F.lit(s).alias("seed"))
            for s in range(seeds)]
    return cut_lineage(aims.join(tried, aims["source"].eqNullSafe(tried["source"])).select(
        aims["source"], "source_size", "target", "rate", F.array_min(F.array(*miss))["seed"].alias("seed")))


def _copies(rate: Column, seed: Column, key: Column) -> Column:
    extra = F.when(draw(seed, key) < rate - F.floor(rate), 1).otherwise(0)
    return (F.floor(rate) + extra).cast("int")


def planned(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` with the source's row of the plan (``_source_size, _target, _rate, _seed``) and ``_copies``.

    Columns of ``docs`` that bear one of these names make the join ambiguous; rename them first. Repeated
    rows take the same decision each. Reruns agree.
    """
    return _with_source(docs, plan, source_col).withColumn(
        "_copies", _copies(F.col("_rate"), F.col("_seed"), docs[id_col]))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as its source's rate and its draw say; columns unchanged.

    An empty table gives no rows, and columns may have any names. ``options`` go to :func:`source_plan`.
    """
    def run(rows: DataFrame) -> DataFrame:
        plan = source_plan(rows, id_col=id_col, source_col=source_col, **options)
        return (planned(rows, plan, id_col, source_col)
                .withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_copies"))))
                .select(*[rows[c] for c in rows.columns]))

    return shielded(docs, (id_col, source_col, options.get("text_col", "text")), run)
