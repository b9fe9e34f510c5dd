"""Queries on points, sections and maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atlas.operators import geometry as G
from atlas.operators import layout as Y
from atlas.operators.spectral import spectral_2d
from atlas.plans.registry import query, r6, table
from atlas.plans.vector_queries import ITEMS_SQL, items
from atlas.session import cut_lineage

RADIUS = 8.0


def points(spark: SparkSession, folder: str) -> DataFrame:
    """part as nodes: price against size, sections by type."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_type").alias("section"), (F.col("p_retailprice") % 97).alias("x"),
        (F.col("p_size") * 2.0).alias("y"), F.col("p_name").alias("filename"), F.col("p_brand").alias("brand"))


def visitors(spark: SparkSession, folder: str) -> DataFrame:
    """customer as query points."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_acctbal") % 97).alias("x"),
        (F.col("c_custkey") % 100).cast("double").alias("y"), F.col("c_mktsegment").alias("segment"))


POINTS_SQL = """pts AS (SELECT p_partkey AS id, p_type AS section, p_retailprice % 97 AS x, p_size * 2.0::DOUBLE AS y,
  p_name AS filename, p_brand AS brand FROM part),
vis AS (SELECT c_custkey AS id, c_acctbal % 97 AS x, (c_custkey % 100)::DOUBLE AS y, c_mktsegment AS segment FROM customer)"""


@query("unit_box", f"""WITH {POINTS_SQL}, b AS (SELECT section, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1
  FROM pts GROUP BY 1)
SELECT id, round((x - x0) / greatest(x1 - x0, 1e-6), 6) AS x, round((y - y0) / greatest(y1 - y0, 1e-6), 6) AS y
FROM pts JOIN b ON pts.section = b.section""")
def unit_box(spark, folder):
    return G.unit_box(points(spark, folder), ["section"]).select("id", r6("x").alias("x"), r6("y").alias("y"))


BLOB_SQL = f"""{POINTS_SQL}, c AS (SELECT section, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM pts GROUP BY 1),
blob AS (SELECT p.section, any_value(n) AS n, greatest(max(sqrt(power(x - mx, 2) + power(y - my, 2))) + 1.6, 3.2) AS radius
  FROM pts p JOIN c ON p.section = c.section GROUP BY 1)"""


@query("blob_radius", f"WITH {BLOB_SQL} SELECT section, n, round(radius, 6) AS radius FROM blob")
def blob_radius(spark, folder):
    return G.blob_radius(points(spark, folder), ["section"]).withColumn("radius", r6("radius"))


def brand_discs(spark, folder) -> DataFrame:
    """One disc per brand and type: radius from its points, centre from their mean."""
    rows = points(spark, folder)
    keys = ["brand", "section"]
    mid = rows.groupBy(*keys).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return G.blob_radius(rows, keys).join(mid, keys).select(
        "brand", F.col("section").alias("name"), "cx", "cy", (F.col("radius") / 4).alias("radius"))


DISC_SQL = f"""{POINTS_SQL}, c AS (SELECT brand, section, avg(x) AS cx, avg(y) AS cy FROM pts GROUP BY ALL),
disc AS (SELECT p.brand, p.section AS name, any_value(cx) AS cx, any_value(cy) AS cy,
  greatest(max(sqrt(power(x - cx, 2) + power(y - cy, 2))) + 1.6, 3.2) / 4 AS radius
  FROM pts p JOIN c ON p.brand = c.brand AND p.section = c.section GROUP BY ALL)"""


@query("overlap_pairs", f"""WITH {DISC_SQL} SELECT a.brand, a.name AS a, b.name AS b,
  round(sqrt(power(a.cx - b.cx, 2) + power(a.cy - b.cy, 2)), 6) AS distance,
  round(a.radius + b.radius + 3.52, 6) AS needed
FROM disc a JOIN disc b ON a.brand = b.brand AND a.name < b.name
WHERE sqrt(power(a.cx - b.cx, 2) + power(a.cy - b.cy, 2)) < a.radius + b.radius + 3.52""")
def overlap_pairs(spark, folder):
    return G.overlap_pairs(brand_discs(spark, folder), by=["brand"]).withColumns(
        {"distance": r6("distance"), "needed": r6("needed")})


@query("arrange_sections", f"""WITH {DISC_SQL}, o AS (SELECT *, row_number() OVER w - 1 AS k,
    coalesce(sum(pi() * power(radius + 3.52, 2)) OVER (PARTITION BY brand ORDER BY radius DESC, name
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM disc WINDOW w AS (PARTITION BY brand ORDER BY radius DESC, name)),
seed AS (SELECT brand, name, radius, sqrt(before / pi()) * 1.15 * cos(k * 2.3999632) AS x,
  sqrt(before / pi()) * 1.15 * sin(k * 2.3999632) AS y FROM o),
s AS (SELECT a.brand, max((a.radius + b.radius + 3.52) / greatest(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), 1e-4)) AS s
  FROM seed a JOIN seed b ON a.brand = b.brand AND a.name < b.name GROUP BY 1)
SELECT seed.brand, name, round(radius, 6) AS radius, round(x * greatest(coalesce(s, 1), 1), 6) AS cx,
  round(y * greatest(coalesce(s, 1), 1), 6) AS cy FROM seed LEFT JOIN s ON seed.brand = s.brand""")
def arrange_sections(spark, folder):
    placed = G.arrange_sections(brand_discs(spark, folder), by=["brand"])
    return placed.select("brand", "name", *[r6(c).alias(c) for c in ("radius", "cx", "cy")])


@query("fit_view_all", f"""WITH {POINTS_SQL}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(-y) AS y0, max(-y) AS y1 FROM pts)
SELECT round((x0 + x1) / 2, 6) AS cx, round((y0 + y1) / 2, 6) AS cy,
  round(least(greatest(least(1280 * 0.85 / greatest(x1 - x0, 1), 800 * 0.85 / greatest(y1 - y0, 1)), 0.05), 200), 6) AS zoom FROM b""")
def fit_view_all(spark, folder):
    return G.fit_view(points(spark, folder)).select(*[r6(c).alias(c) for c in ("cx", "cy", "zoom")])


@query("fit_view_sections", f"""WITH {POINTS_SQL}, b AS (SELECT section, min(x) AS x0, max(x) AS x1, min(-y) AS y0,
  max(-y) AS y1 FROM pts GROUP BY 1)
SELECT section, round((x0 + x1) / 2, 6) AS cx, round((y0 + y1) / 2, 6) AS cy,
  round(least(greatest(least(1280 * 0.7 / greatest(x1 - x0, 6.4), 800 * 0.7 / greatest(y1 - y0, 6.4)), 0.05), 200), 6) AS zoom FROM b""")
def fit_view_sections(spark, folder):
    return G.fit_view(points(spark, folder), ["section"]).select("section", *[r6(c).alias(c) for c in ("cx", "cy", "zoom")])


@query("nearest_section", """WITH sec AS (SELECT s_suppkey AS name, s_acctbal % 97 AS cx, (s_suppkey * 7) % 100::DOUBLE AS cy FROM supplier),
pts AS (SELECT c_custkey AS id, c_acctbal % 97 AS x, (c_custkey % 100)::DOUBLE AS y, c_custkey % 25 AS own FROM customer),
near AS (SELECT id, name, sqrt(power(x - cx, 2) + power(y - cy, 2)) AS d FROM pts JOIN sec ON name <> own
  AND sqrt(power(x - cx, 2) + power(y - cy, 2)) < 20),
best AS (SELECT id, name, d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, name) AS rn FROM near) WHERE rn = 1)
SELECT pts.id, name AS target, round(d, 6) AS distance FROM pts LEFT JOIN best ON pts.id = best.id""")
def nearest_section(spark, folder):
    sections = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("name"), (F.col("s_acctbal") % 97).alias("cx"),
        ((F.col("s_suppkey") * 7) % 100).cast("double").alias("cy"))
    moved = visitors(spark, folder).withColumn("section", F.col("id") % 25)
    return G.nearest_section(moved, sections).select("id", "target", r6("distance").alias("distance"))


@query("nearest_node", f"""WITH {POINTS_SQL}, near AS (SELECT v.id, p.id AS node, p.section,
    sqrt(power(v.x - p.x, 2) + power(v.y - p.y, 2)) AS d FROM vis v JOIN pts p ON abs(v.x - p.x) <= 8 AND abs(v.y - p.y) <= 8),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, node) AS rn FROM near WHERE d <= 8) WHERE rn = 1)
SELECT v.id, node, round(d, 6) AS distance, coalesce(d < 7 / 1.2, false) AS hit,
  CASE WHEN d < 8 THEN section END AS active_section FROM vis v LEFT JOIN best b ON v.id = b.id""")
def nearest_node(spark, folder):
    found = G.nearest_node(visitors(spark, folder), points(spark, folder))
    return found.withColumn("distance", r6("distance"))


@query("proximity_pairs", f"""WITH {POINTS_SQL} SELECT a.section, a.id AS src, b.id AS dst,
  round(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), 6) AS distance FROM pts a JOIN pts b ON a.section = b.section
  AND a.id < b.id WHERE sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) < 4.2""")
def proximity_pairs(spark, folder):
    return G.proximity_pairs(points(spark, folder), by=["section"], digits=6)


@query("separate_once", f"""WITH {POINTS_SQL}, pair AS (SELECT a.id, a.x - b.x AS dx, a.y - b.y AS dy,
  sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS d FROM pts a JOIN pts b ON a.section = b.section AND a.id <> b.id),
push AS (SELECT id, sum(dx / d * (4.2 - d) * 0.5) AS px, sum(dy / d * (4.2 - d) * 0.5) AS py FROM pair
  WHERE d < 4.2 AND d * d > 1e-9 GROUP BY id)
SELECT pts.id, round(x + coalesce(px, 0), 6) AS x, round(y + coalesce(py, 0), 6) AS y FROM pts LEFT JOIN push ON pts.id = push.id""")
def separate_once(spark, folder):
    return G.separate_once(points(spark, folder), by=["section"]).select("id", r6("x").alias("x"), r6("y").alias("y"))


@query("carry_positions", f"""WITH {POINTS_SQL}, old AS (SELECT filename, x + 1 AS x, y - 1 AS y, id AS seq FROM pts WHERE section <> 'PROMO'),
last AS (SELECT filename, arg_max(x, seq) AS x, arg_max(y, seq) AS y FROM old WHERE filename NOT LIKE 'red%' GROUP BY 1)
SELECT id, round(coalesce(l.x, p.x), 6) AS x, round(coalesce(l.y, p.y), 6) AS y FROM pts p LEFT JOIN last l ON p.filename = l.filename""")
def carry_positions(spark, folder):
    new = points(spark, folder)
    old = new.where((F.col("section") != "PROMO") & ~F.col("filename").startswith("red")).select(
        "filename", (F.col("x") + 1).alias("x"), (F.col("y") - 1).alias("y"), F.col("id").alias("seq"))
    return G.carry_positions(new, old).select("id", r6("x").alias("x"), r6("y").alias("y"))


@query("resettle", f"""WITH {ITEMS_SQL}, n AS (SELECT id, label, u, (id * 13) % 101::DOUBLE AS home_x, (id * 29) % 103::DOUBLE AS home_y,
    (id % 7) / 7.0::DOUBLE AS rel_x, (id % 11) / 11.0::DOUBLE AS rel_y FROM unit),
m AS (SELECT id, 'L' || ((CAST(substr(label, 2) AS INT) + 1) % 10) AS target, u FROM n),
best AS (SELECT m.id, arg_min(n.id, (-round(list_dot_product(m.u, n.u), 9), n.id)) AS peer FROM m JOIN n ON n.label = m.target AND n.id <> m.id GROUP BY 1)
SELECT m.id, target AS section, peer, round(p.home_x + 1.6, 6) AS home_x, round(p.home_y + 1.6, 6) AS home_y,
  round(p.rel_x, 6) AS rel_x, round(p.rel_y, 6) AS rel_y FROM m JOIN best b ON b.id = m.id JOIN n p ON p.id = b.peer""")
def resettle(spark, folder):
    nodes = items(spark, folder).select(
        "id", F.col("label").alias("section"), "embedding", ((F.col("id") * 13) % 101).cast("double").alias("home_x"),
        ((F.col("id") * 29) % 103).cast("double").alias("home_y"), (F.col("id") % 7 / 7).alias("rel_x"),
        (F.col("id") % 11 / 11).alias("rel_y"))
    target = F.concat(F.lit("L"), ((F.substring("section", 2, 9).cast("int") + 1) % 10).cast("string"))
    moved = G.resettle(nodes.select("id", target.alias("section")), nodes)
    return moved.select("id", "section", "peer", *[r6(c).alias(c) for c in ("home_x", "home_y", "rel_x", "rel_y")])


def sections(spark, folder) -> DataFrame:
    return items(spark, folder).select("id", F.col("label").alias("section"), "embedding")


@query("pca_2d")
def pca_2d(spark, folder):
    """Spread of each section along its two leading directions."""
    flat = Y.pca_2d(sections(spark, folder), ["section"])
    return flat.groupBy("section").agg(F.count(F.lit(1)).alias("n"), r6(F.stddev_pop("x")).alias("sx"),
                                       r6(F.stddev_pop("y")).alias("sy"))


@query("spectral_paths", """WITH o AS (SELECT o_custkey AS section, o_orderkey AS id,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT section, id, round(cos(pi() * i / (n - 1)), 3) + 0.0 AS x FROM o WHERE n > 1""")
def spectral_paths(spark, folder):
    """Each customer's orders, linked one to the next: the smoothest direction of a path of n is the half cosine."""
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("section"), F.col("o_orderkey").alias("src"))
    after = F.lead("src").over(Window.partitionBy("section").orderBy("src"))
    steps = rows.withColumn("dst", after).where("dst IS NOT NULL")
    back = steps.select("section", F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = spectral_2d(steps.unionByName(back).withColumn("w", F.lit(1.0)), ["section"])
    first = found.groupBy("section").agg(F.min_by("x", "id").alias("_first"))
    return found.join(first, "section").select("section", "id", (F.round(F.col("x") / F.col("_first"), 3) + 0.0).alias("x"))


@query("layout_recall")
def layout_recall(spark, folder):
    """How much of the neighbourhood the section layouts keep, next to projection and chance."""
    rows = sections(spark, folder)
    placed = cut_lineage(Y.layout(rows, neighbours=True))
    flat = G.unit_box(Y.pca_2d(rows, ["section"]), ["section"])
    near = Y.recall_base(rows)
    good = Y.knn_recall(rows, placed, base=near)
    base = Y.knn_recall(rows, flat, base=near).select("section", F.col("recall").alias("pca"))
    return good.join(base, "section").select("section", "n", *[F.round(c, 3).alias(c) for c in ("recall", "pca", "random")])


RECALL_SQL = f"""WITH {ITEMS_SQL},
hi AS (SELECT * FROM (SELECT a.label, a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.id ORDER BY
    round(list_dot_product(a.v, a.v) + list_dot_product(b.v, b.v) - 2 * list_dot_product(a.v, b.v), 9), b.id) AS rank
  FROM items a JOIN items b ON a.label = b.label AND a.id <> b.id) WHERE rank <= 10),
lo AS (SELECT * FROM (SELECT a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.id ORDER BY
    round(a.v[1] * a.v[1] + a.v[2] * a.v[2] + b.v[1] * b.v[1] + b.v[2] * b.v[2] - 2 * (a.v[1] * b.v[1] + a.v[2] * b.v[2]), 9), b.id) AS rank
  FROM items a JOIN items b ON a.label = b.label AND a.id <> b.id) WHERE rank <= 10),
big AS (SELECT label, count(*) AS n FROM items GROUP BY 1 HAVING count(*) >= 30),
hit AS (SELECT hi.label, count(*) AS hits FROM hi JOIN lo ON hi.src = lo.src AND hi.dst = lo.dst GROUP BY 1)
SELECT big.label AS section, n, round(coalesce(hits, 0) / (10.0::DOUBLE * n), 6) AS recall, round(10.0::DOUBLE / n, 6) AS random
FROM big LEFT JOIN hit ON hit.label = big.label"""


@query("knn_recall", RECALL_SQL)
def knn_recall(spark, folder):
    """Recall of the first two dimensions as a stand-in for a layout."""
    rows = sections(spark, folder)
    flat = rows.select("id", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    return Y.knn_recall(rows, flat).withColumns({"recall": r6("recall"), "random": r6("random")})


@query("map_nodes", """SELECT 'L' || label AS section, CASE WHEN count(*) = 1 THEN 'centre' WHEN count(*) <= 6 THEN 'disc'
  ELSE 'projected' END AS method, count(*) AS n, count(*) AS n_inside, count(*) AS places, 1::BIGINT AS section_ids
FROM embeddings GROUP BY label""")
def map_nodes(spark, folder):
    """The finished map: nodes per section and whether their positions are sound."""
    nodes, _ = Y.build_map(sections(spark, folder))
    inside = (F.col("rel_x") >= 0) & (F.col("rel_x") <= 1) & (F.col("rel_y") >= 0) & (F.col("rel_y") <= 1)
    return nodes.groupBy("section", "method").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("n_inside"),
        F.count_distinct("x", "y").alias("places"), F.count_distinct("section_id").alias("section_ids"))


@query("map_sections", """WITH sizes AS (SELECT 'L' || label AS section, count(*) AS n FROM embeddings GROUP BY label)
SELECT a.section, a.n, (SELECT count(*) FROM sizes b WHERE b.section <> a.section) AS apart FROM sizes a""")
def map_sections(spark, folder):
    """Section summary of the map, with how many of the other sections each one keeps clear of."""
    _, summary = Y.build_map(sections(spark, folder))
    clash = G.overlap_pairs(summary, margin=G.SECTION_MARGIN - 1e-6)
    touched = clash.select(F.explode(F.array("a", "b")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("hit"))
    others = summary.agg(F.count(F.lit(1)) - 1).scalar()
    return summary.join(touched, "name", "left").select(
        F.col("name").alias("section"), "n", (others - F.coalesce("hit", F.lit(0))).alias("apart"))
