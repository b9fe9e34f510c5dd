"""Nearest points within a radius through a quadtree of bounded leaves, built from counts by Morton prefix.

Points are counted at the finest cells once; counts of coarser cells are sums of those. A cell splits as long as it
holds more than ``LEAF`` points and is wider than the finest size, so a crowd is cut finely and a desert is one leaf.
A query looks into the leaves that its disc touches, and the leaves are found by equi-joins on cell numbers. Points
that the finest cell cannot separate, a crowd within ``radius / 2 ** FINEST``, are dealt over pieces of ``LEAF``
points, so no leaf that a task sees is larger. No leaf is empty, so the least of the farthest corners of the leaves
around bounds the answer, and only leaves within that bound are asked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlas.session import cut_lineage

LEAF = 32  # points of a leaf at most
FINEST = 6  # times that a cell of the radius' size is halved at most
REACH = 1  # cells of the radius' size to each side that a disc can touch


def cell_of(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def cells(points: DataFrame, radius: float, leaf: int = LEAF, finest: int = FINEST) -> DataFrame:
    """``cx, cy, level, pieces`` of every finest cell that holds points ``x, y``: the level of the leaf it lies in, a
    cell of size ``radius / 2 ** level``, and the pieces of that leaf.

    The leaf is the largest cell that is not crowded. A cell of the radius' size holds at most ``4 ** finest`` finest
    ones, so the sums by level stay within it.
    """
    fine = radius / 2 ** finest
    counts = points.groupBy(cell_of(F.col("x"), fine).alias("cx"), cell_of(F.col("y"), fine).alias("cy")).agg(
        F.count(F.lit(1)).alias("n"))
    top = [F.shiftright("cx", finest), F.shiftright("cy", finest)]
    held = F.array(*[F.sum("n").over(Window.partitionBy(*top, F.shiftright("cx", finest - k), F.shiftright("cy", finest - k)))
                     for k in range(finest)], F.col("n"))
    level = F.lit(finest)
    for k in reversed(range(finest)):
        level = F.when(F.col("_n")[k] <= leaf, k).otherwise(level)
    return counts.repartition(*top).withColumn("_n", held).withColumn("level", level).select(
        "cx", "cy", "level", F.ceil(F.element_at("_n", F.col("level") + 1) / leaf).cast("int").alias("pieces"))


def _leaf(finest: int) -> list[Column]:
    return [F.col("level"), F.expr(f"shiftright(cx, {finest} - level)").alias("lx"),
            F.expr(f"shiftright(cy, {finest} - level)").alias("ly")]


def _corners(qx: str, qy: str, radius: float) -> tuple[Column, Column]:
    """Distances from a query to the square of a leaf: to its closest point, and to its farthest."""
    size = F.lit(radius) / F.pow(F.lit(2.0), F.col("level"))
    near, far = [], []
    for q, c in ((qx, "lx"), (qy, "ly")):
        low, high = F.col(c) * size - F.col(q), F.col(q) - (F.col(c) + 1) * size
        near.append(F.greatest(low, high, F.lit(0.0)))
        far.append(F.greatest(F.abs(low), F.abs(high)))
    return tuple(F.sqrt(a * a + b * b) for a, b in (near, far))


def nearest_within(queries: DataFrame, points: DataFrame, radius: float, payload: str, leaf: int = LEAF,
                   finest: int = FINEST, own: str | None = None) -> DataFrame:
    """``qx, qy, d, <payload>`` of the closest point no further than ``radius``; ties go to the smaller payload.

    ``queries``: distinct qx, qy; ``points``: distinct x, y with an orderable payload. Queries without a point are
    left out. With ``own``, a column of the queries and of the result, points whose payload equals it do not count;
    a leaf all of whose points have one payload then bounds only the answers of others.
    """
    asked = ["qx", "qy", *([own] if own else [])]
    split = cut_lineage(cells(points, radius, leaf, finest))
    fine = radius / 2 ** finest
    piece = F.pmod(F.xxhash64("x", "y"), F.col("pieces")).cast("int")
    filed = points.select("x", "y", payload, cell_of(F.col("x"), fine).alias("cx"), cell_of(F.col("y"), fine).alias("cy")).join(
        split, ["cx", "cy"]).select("x", "y", payload, *_leaf(finest), piece.alias("piece"))
    tree = split.select(F.shiftright("cx", finest).alias("top_x"), F.shiftright("cy", finest).alias("top_y"),
                        *_leaf(finest), "pieces").distinct()

    steps = [(dx, dy) for dx in range(-REACH, REACH + 1) for dy in range(-REACH, REACH + 1)]
    around = F.explode(F.array(*[F.struct((cell_of(F.col("qx"), radius) + dx).alias("top_x"),
                                          (cell_of(F.col("qy"), radius) + dy).alias("top_y")) for dx, dy in steps]))
    if own:
        mixed = filed.groupBy("level", "lx", "ly").agg(F.min(payload).alias("_least"), F.max(payload).alias("_most"))
        tree = tree.join(mixed, ["level", "lx", "ly"])
        counts = (F.col("_least") != F.col("_most")) | (F.col("_least") != F.col(own))
    else:
        counts = F.lit(True)
    touched = queries.select(*asked, around.alias("_t")).select(*asked, "_t.top_x", "_t.top_y").join(
        tree, ["top_x", "top_y"])
    near, far = _corners("qx", "qy", radius)
    touched = touched.select(*asked, "level", "lx", "ly", "pieces", near.alias("_near"), F.when(counts, far).alias("_far")).where(
        F.col("_near") <= radius)
    bound = F.coalesce(F.min("_far").over(Window.partitionBy(*asked)), F.lit(radius))
    wanted = touched.withColumn("_bound", bound).where(F.col("_near") <= F.col("_bound") * (1 + 1e-9)).select(
        *asked, "level", "lx", "ly", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    dx, dy = F.col("qx") - F.col("x"), F.col("qy") - F.col("y")
    met = wanted.join(filed, ["level", "lx", "ly", "piece"]).withColumn("d", F.sqrt(dx * dx + dy * dy)).where(F.col("d") <= radius)
    met = met.where(F.col(payload) != F.col(own)) if own else met
    best = met.groupBy(*asked).agg(F.min(F.struct("d", payload)).alias("_b"))
    return best.select(*asked, F.col("_b.d").alias("d"), F.col(f"_b.{payload}").alias(payload))
