"""Points and sections on the plane: boxes, radii, range joins, arrangement, views.

Distances are joined through grids: an equi-join on cells, never all pairs. Points at the very same
place are merged first, so a pile of copies counts once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlas.operators.neighbours import top_k
from atlas.operators.quadtree import LEAF, nearest_within
from atlas.operators.skew import salted_join
from atlas.session import cut_lineage, spread

# Node radius, gap between sections, spacing of nodes, search radii, view limits.
NODE_R = 1.6
SECTION_MARGIN = NODE_R * 2.2
MIN_DIST = 2 * NODE_R + 1.0
DROP_RADIUS = 20.0
ACTIVE_RADIUS = 8.0
HIT_PIXELS = 7.0
ZOOM_RANGE = (0.05, 200.0)
SPIRAL_ANGLE = 2.3999632
SPIRAL_LOOSENESS = 1.15
PIECE_IDS = 1024  # ids of one place that travel together


def _cell(column: Column, size: float | Column) -> Column:
    return F.floor(column / size).cast("long")


def _around(x: Column, y: Column, size: float | Column) -> Column:
    """The 3 x 3 cells around a point."""
    steps = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    return F.array(*[F.struct((_cell(x, size) + dx).alias("cx"), (_cell(y, size) + dy).alias("cy"))
                     for dx, dy in steps])


def _distance(ax, ay, bx, by) -> Column:
    dx, dy = F.col(ax) - F.col(bx), F.col(ay) - F.col(by)
    return F.sqrt(dx * dx + dy * dy)


def unit_box(df: DataFrame, by: Sequence[str], x: str = "x", y: str = "y", id_col: str = "id",
             rows: int | None = None) -> DataFrame:
    """Scale both axes of each group into 0..1. ``rows``: the number of rows, where the caller knows it."""
    by = list(by)
    box = df.groupBy(*by).agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"),
                              F.max(y).alias("_y1"))
    floor = F.lit(1e-6)
    return salted_join(df, box, by, spread=[id_col], rows=rows).withColumns({
        x: (F.col(x) - F.col("_x0")) / F.greatest(F.col("_x1") - F.col("_x0"), floor),
        y: (F.col(y) - F.col("_y0")) / F.greatest(F.col("_y1") - F.col("_y0"), floor),
    }).drop("_x0", "_x1", "_y0", "_y1")


def centre(df: DataFrame, by: Sequence[str], id_col: str = "id", rows: int | None = None) -> DataFrame:
    """Move the mean of each group to the origin."""
    by = list(by)
    mean = df.groupBy(*by).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    return salted_join(df, mean, by, spread=[id_col], rows=rows).withColumns(
        {"x": F.col("x") - F.col("_mx"), "y": F.col("y") - F.col("_my")}).drop("_mx", "_my")


def blob_radius(df: DataFrame, by: Sequence[str], id_col: str = "id", rows: int | None = None) -> DataFrame:
    """Per group: rows and the radius of the disc around its mean that holds every node."""
    far = F.max(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))) + NODE_R
    return centre(df, by, id_col, rows).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.greatest(far, F.lit(2 * NODE_R)).alias("radius"))


def fit_view(df: DataFrame, by: Sequence[str] = (), width: float = 1280.0, height: float = 800.0) -> DataFrame:
    """Centre and zoom that frame all nodes, or each group when ``by`` is given. World y points down."""
    share, least = (0.7, 4 * NODE_R) if by else (0.85, 1.0)
    box = df.groupBy(*by).agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min(-F.col("y")).alias("y0"),
        F.max(-F.col("y")).alias("y1"))
    span_x = F.greatest(F.col("x1") - F.col("x0"), F.lit(least))
    span_y = F.greatest(F.col("y1") - F.col("y0"), F.lit(least))
    zoom = F.least(width * share / span_x, height * share / span_y)
    return box.select(
        *by, ((F.col("x0") + F.col("x1")) * 0.5).alias("cx"), ((F.col("y0") + F.col("y1")) * 0.5).alias("cy"),
        F.least(F.greatest(zoom, F.lit(ZOOM_RANGE[0])), F.lit(ZOOM_RANGE[1])).alias("zoom"))


def nearest_section(points: DataFrame, sections: DataFrame, radius: float = DROP_RADIUS,
                    own: str = "section") -> DataFrame:
    """Closest section centre within ``radius`` of each point, its own section excluded.

    ``points``: id, x, y, <own>; ``sections``: name, cx, cy. Points without a hit keep nulls. Sections are searched
    through a quadtree, first within a small distance, the smaller the more sections there are; points without an
    answer go on to four times that distance, until the last round looks as far as ``radius``. At one place only the
    two smallest names can matter, since a point has one section of its own.
    """
    centres = sections.where("cx IS NOT NULL AND cy IS NOT NULL").select(
        F.col("cx").alias("x"), F.col("cy").alias("y"), "name").distinct()
    first = centres.groupBy("x", "y").agg(F.min("name").alias("_first"))
    second = centres.join(first, ["x", "y"]).where(F.col("name") > F.col("_first")).groupBy("x", "y").agg(F.min("name").alias("name"))
    spots = cut_lineage(first.withColumnRenamed("_first", "name").unionByName(second))
    n = spots.count()
    halvings = max(0, min(6, int(math.log(max(n, 1) / 64, 4)))) if n > 64 else 0
    asked = cut_lineage(points.select(F.col("x").alias("qx"), F.col("y").alias("qy"), F.col(own).alias("_own")).where(
        "qx IS NOT NULL AND qy IS NOT NULL AND _own IS NOT NULL").distinct())
    answers = None
    while True:
        found = cut_lineage(nearest_within(asked, spots, radius / 2 ** halvings, "name", own="_own"))
        answers = found if answers is None else answers.unionByName(found)
        if halvings == 0:
            break
        asked = cut_lineage(asked.join(found, ["qx", "qy", "_own"], "left_anti"))
        halvings = max(0, halvings - 2)
    best = answers.where(F.col("d") < radius).select("qx", "qy", "_own", "d", F.col("name").alias("_name"))
    keyed = points.withColumns({"qx": F.col("x"), "qy": F.col("y"), "_own": F.col(own)})
    return salted_join(keyed, best, ["qx", "qy", "_own"], "left", spread=["id"]).withColumns(
        {"target": F.col("_name"), "distance": F.col("d")}).drop("qx", "qy", "_own", "_name", "d")


def nearest_node(queries: DataFrame, nodes: DataFrame, zoom: float = 1.2, leaf: int = LEAF) -> DataFrame:
    """Closest node to each query point: ``id, node, distance, hit, active_section``.

    A node is hit inside its visible radius, and its section is active within a wider one; nothing
    further away matters, so the search stops there and such queries keep nulls. Points are searched
    through a quadtree whose leaves hold at most ``leaf`` of them, so a crowd is no task's alone.
    """
    hit_radius = max(NODE_R, HIT_PIXELS / zoom)
    radius = max(ACTIVE_RADIUS, hit_radius)
    spots = cut_lineage(nodes.groupBy("x", "y").agg(F.min(F.struct("id", "section")).alias("node")))
    places = queries.select(F.col("x").alias("qx"), F.col("y").alias("qy")).distinct()
    answers = nearest_within(places, spots, radius, "node", leaf)
    keyed = queries.withColumns({"qx": F.col("x"), "qy": F.col("y")})
    found = salted_join(keyed, answers, ["qx", "qy"], "left", spread=["id"])
    return found.select(
        "id", F.col("node.id").alias("node"), F.col("d").alias("distance"),
        F.coalesce(F.col("d") < hit_radius, F.lit(False)).alias("hit"),
        F.when(F.col("d") < ACTIVE_RADIUS, F.col("node.section")).alias("active_section"))


def place_pieces(df: DataFrame, by: Sequence[str] = (), most: int = PIECE_IDS) -> DataFrame:
    """Nodes by place: ``<by>, x, y, piece, ids``, about ``most`` ids in each piece of a crowded place.

    Nodes without a finite position, or without a group, are close to nothing and are left out.
    """
    place = [*by, "x", "y"]
    nodes = df.select(*place, "id").where((F.abs("x") < F.lit(math.inf)) & (F.abs("y") < F.lit(math.inf)))
    for c in by:
        nodes = nodes.where(F.col(c).isNotNull())
    crowded = nodes.groupBy(*place).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(
        *place, F.ceil(F.col("_n") / most).alias("_pieces"))
    piece = F.coalesce(F.pmod(F.xxhash64("id"), F.col("_pieces")), F.lit(0))
    return salted_join(nodes, crowded, place, "left", spread=["id"]).withColumn("piece", piece).groupBy(
        *place, "piece").agg(F.collect_list("id").alias("ids"))


def proximity_pairs(df: DataFrame, distance: float = MIN_DIST, by: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """``src < dst, distance`` of nodes closer than ``distance`` (in the same group, if ``by`` is given).

    Places meet, not nodes: each piece of a place looks at its own cell and at the four cells ahead of it, so every
    pair is met once, and only pairs that are close enough are written out node by node. The number of partitions is
    explicit: few bytes can stand for many pairs. ``digits`` rounds the distances found, once for each pair of pieces.
    """
    by = list(by)
    pieces = cut_lineage(place_pieces(df, by))
    cx, cy = _cell(F.col("x"), distance), _cell(F.col("y"), distance)
    ahead = F.array(*[F.struct((cx + dx).alias("cx"), (cy + dy).alias("cy"))
                      for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    keys = [*by, "_cx", "_cy"]
    a = pieces.select(*by, F.col("ids").alias("a_ids"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("piece").alias("ap"),
                      cx.alias("hx"), cy.alias("hy"), F.explode(ahead).alias("c")).select(
        *by, "a_ids", "ax", "ay", "ap", "hx", "hy", F.col("c.cx").alias("_cx"), F.col("c.cy").alias("_cy"))
    b = pieces.select(*by, F.col("ids").alias("b_ids"), F.col("x").alias("bx"), F.col("y").alias("by_"), F.col("piece").alias("bp"),
                      cx.alias("_cx"), cy.alias("_cy"))
    same_cell = (F.col("hx") == F.col("_cx")) & (F.col("hy") == F.col("_cy"))
    one, other = F.struct("ax", "ay", "ap"), F.struct("bx", "by_", "bp")
    met = spread(a, *keys).join(spread(b, *keys), keys).where(~same_cell | (one <= other))
    close = met.withColumn("distance", _distance("ax", "ay", "bx", "by_")).where(F.col("distance") < distance)
    if digits is not None:
        close = close.withColumn("distance", F.round("distance", digits))
    nodes = close.select(*by, "distance", (one == other).alias("_own"), F.explode("a_ids").alias("a"), "b_ids").select(
        *by, "distance", "_own", "a", F.explode("b_ids").alias("b"))
    return nodes.where(F.when(F.col("_own"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b"))).select(
        *by, F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "distance")


def separate_once(df: DataFrame, distance: float = MIN_DIST, by: Sequence[str] = ()) -> DataFrame:
    """One simultaneous separation step: every pair closer than ``distance`` moves half the gap apart.

    Nodes at the same place move together (their direction is undefined), so they enter as one place
    with a weight and all pushes are sums over places.
    """
    by = list(by)
    places = df.groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("w"))
    a = places.select(*by, F.col("x").alias("ax"), F.col("y").alias("ay"),
                      F.explode(_around(F.col("x"), F.col("y"), distance)).alias("c")).select(
        *by, "ax", "ay", F.col("c.cx").alias("_cx"), F.col("c.cy").alias("_cy"))
    b = places.select(*by, F.col("x").alias("bx"), F.col("y").alias("by_"), "w",
                      _cell(F.col("x"), distance).alias("_cx"), _cell(F.col("y"), distance).alias("_cy"))
    d = F.col("d")
    pushes = a.join(b, [*by, "_cx", "_cy"]).withColumn("d", _distance("ax", "ay", "bx", "by_")).where(
        (d < distance) & (d * d > 1e-9)).groupBy(*by, F.col("ax").alias("x"), F.col("ay").alias("y")).agg(
        F.sum(F.col("w") * (F.col("ax") - F.col("bx")) / d * (distance - d) * 0.5).alias("_px"),
        F.sum(F.col("w") * (F.col("ay") - F.col("by_")) / d * (distance - d) * 0.5).alias("_py"))
    return salted_join(df, pushes, [*by, "x", "y"], "left", spread=["id"]).withColumns({
        "x": F.col("x") + F.coalesce("_px", F.lit(0.0)), "y": F.col("y") + F.coalesce("_py", F.lit(0.0)),
    }).drop("_px", "_py")


def overlap_pairs(sections: DataFrame, margin: float = SECTION_MARGIN, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of discs (name, cx, cy, radius) closer than the sum of their radii plus ``margin``.

    Discs are filed on grids by magnitude: a disc looks around itself on its own grid, and is listed on
    that grid and on the coarser ones, so a large and a small disc meet on the large one's grid.
    """
    by = list(by)
    level = F.ceil(F.log2(F.col("radius") + margin / 2)).cast("int")
    tagged = sections.select(*by, "name", "cx", "cy", "radius", level.alias("level"))
    tops = tagged.groupBy(*by).agg(F.array_sort(F.collect_set("level")).alias("levels"))
    listed = tagged.join(tops, by) if by else tagged.withColumn("levels", tops.scalar())
    size = F.pow(F.lit(2.0), F.col("at") + 1)
    listed = listed.withColumn("at", F.explode(F.filter("levels", lambda v: v >= F.col("level")))).select(
        *by, F.col("name").alias("b"), F.col("cx").alias("bx"), F.col("cy").alias("by_"),
        F.col("radius").alias("rb"), F.col("level").alias("lb"), "at",
        _cell(F.col("cx"), size).alias("_cx"), _cell(F.col("cy"), size).alias("_cy"))
    own = F.pow(F.lit(2.0), F.col("level") + 1)
    looking = tagged.select(
        *by, F.col("name").alias("a"), F.col("cx").alias("ax"), F.col("cy").alias("ay"),
        F.col("radius").alias("ra"), F.col("level").alias("at"),
        F.explode(_around(F.col("cx"), F.col("cy"), own)).alias("c")).select(
        *by, "a", "ax", "ay", "ra", "at", F.col("c.cx").alias("_cx"), F.col("c.cy").alias("_cy"))
    met = looking.join(listed, [*by, "at", "_cx", "_cy"]).where(
        (F.col("lb") < F.col("at")) | (F.col("a") < F.col("b")))
    need = F.col("ra") + F.col("rb") + margin
    return met.withColumn("distance", _distance("ax", "ay", "bx", "by_")).where(
        F.col("distance") < need).select(
        *by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance", need.alias("needed"))


def arrange_sections(sections: DataFrame, margin: float = SECTION_MARGIN, by: Sequence[str] = ()) -> DataFrame:
    """Centres (name, radius -> cx, cy) that keep all discs apart, the largest at the origin.

    Discs start on a spiral whose radius follows the area placed before them; then all positions grow by
    the worst ratio of needed to actual distance. Only overlapping pairs can set that ratio.
    """
    by = list(by)
    area = math.pi * (F.col("radius") + margin) * (F.col("radius") + margin)
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("radius"), F.asc("name"))
    before = F.coalesce(F.sum(area).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    r = F.sqrt(before / math.pi) * SPIRAL_LOOSENESS
    angle = (F.row_number().over(order) - 1) * F.lit(SPIRAL_ANGLE)
    seeded = sections.select(*by, "name", "radius", (r * F.cos(angle)).alias("cx"), (r * F.sin(angle)).alias("cy"))
    ratio = F.max(F.col("needed") / F.greatest("distance", F.lit(1e-4)))
    worst = overlap_pairs(seeded, margin, by).groupBy(*by).agg(ratio.alias("_s"))
    if by:
        scaled = seeded.join(worst, by, "left").withColumn("_s", F.coalesce("_s", F.lit(1.0)))
    else:
        scaled = seeded.withColumn("_s", F.coalesce(worst.scalar(), F.lit(1.0)))
    return scaled.withColumns({"cx": F.col("cx") * F.col("_s"), "cy": F.col("cy") * F.col("_s")}).drop("_s")


def carry_positions(new: DataFrame, old: DataFrame, key: str = "filename", seq: str = "seq") -> DataFrame:
    """New nodes at the place the last old node of the same file name had, or at their own."""
    last = old.groupBy(key).agg(F.max_by(F.struct("x", "y"), seq).alias("_p"))
    return salted_join(new, last, [key], "left", spread=["id"]).withColumns(
        {"x": F.coalesce("_p.x", "x"), "y": F.coalesce("_p.y", "y")}).drop("_p")


def resettle(moves: DataFrame, items: DataFrame, block_rows: int | None = None) -> DataFrame:
    """New home of moved items: next to the closest item (by cosine) of the target section.

    ``moves``: id, section; ``items``: id, section, embedding, home_x, home_y, rel_x, rel_y. An item
    without embedding or peer keeps its place.
    """
    mover = moves.select("id", "section").join(items.drop("section"), "id")
    having = items.where(F.col("embedding").isNotNull())
    best = top_k(mover.where(F.col("embedding").isNotNull()), having, k=1, by=["section"],
                 block_rows=block_rows).select(F.col("src").alias("id"), F.col("dst").alias("peer"))
    spot = items.select(F.col("id").alias("peer"), F.struct("home_x", "home_y", "rel_x", "rel_y").alias("_p"))
    placed = mover.drop("embedding").join(salted_join(best, spot, ["peer"], spread=["id"]), "id", "left")
    return placed.withColumns({
        "home_x": F.coalesce(F.col("_p.home_x") + NODE_R, F.col("home_x")),
        "home_y": F.coalesce(F.col("_p.home_y") + NODE_R, F.col("home_y")),
        "rel_x": F.coalesce("_p.rel_x", "rel_x"), "rel_y": F.coalesce("_p.rel_y", "rel_y"),
    }).drop("_p")


def as_vector(df: DataFrame, out: str = "embedding") -> DataFrame:
    return df.withColumn(out, F.array(F.col("x").cast("double"), F.col("y").cast("double")))
