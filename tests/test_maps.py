"""Geometry and layout: no overlaps, recall above chance, small and large sections alike."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlas.operators import geometry as G
from atlas.operators import layout as Y
from atlas.operators import quadtree as Q
from atlas.operators import spectral as P

RADII = [
    [120.0] + [4.0] * 6, [50.0] * 21, [1.0, 2.0, 3.0, 80.0, 5.0, 90.0, 2.5, 40.0], [7.0, 7.0],
    [i * 6.0 for i in range(1, 21)],
]


def test_sections_never_overlap(spark):
    rows = [(case, f"s{i:02d}", r) for case, radii in enumerate(RADII) for i, r in enumerate(radii)]
    df = spark.createDataFrame(rows, "map long, name string, radius double")
    placed = G.arrange_sections(df, by=["map"]).toPandas()
    for _, part in placed.groupby("map"):
        x, y, r = part["cx"].to_numpy(), part["cy"].to_numpy(), part["radius"].to_numpy()
        d = np.hypot(x[:, None] - x, y[:, None] - y)
        need = r[:, None] + r + G.SECTION_MARGIN
        off = ~np.eye(len(part), dtype=bool)
        assert (d[off] >= need[off] - 1e-6).all()


def test_single_section_sits_at_the_origin(spark):
    df = spark.createDataFrame([("a", 5.0)], "name string, radius double")
    assert G.arrange_sections(df).first()[:] == ("a", 5.0, 0.0, 0.0)


def test_overlap_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    x, y, r = rng.uniform(0, 300, 80), rng.uniform(0, 300, 80), 10 ** rng.uniform(-1, 2, 80)
    rows = [(f"n{i:02d}", float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, r))]
    got = {(p["a"], p["b"]) for p in G.overlap_pairs(
        spark.createDataFrame(rows, "name string, cx double, cy double, radius double"), 3.0).collect()}
    want = {(f"n{i:02d}", f"n{j:02d}") for i in range(80) for j in range(i + 1, 80)
            if np.hypot(x[i] - x[j], y[i] - y[j]) < r[i] + r[j] + 3.0}
    assert got == want


def test_nearest_node_in_a_crowd(spark):
    rng = np.random.default_rng(1)
    nodes = np.concatenate([np.full((200, 2), 5.0), rng.normal(5, 0.2, (200, 2)), rng.uniform(-40, 40, (100, 2))])
    asked = np.concatenate([np.full((50, 2), 5.0), rng.uniform(-45, 45, (60, 2))])
    nd = spark.createDataFrame([(i, "s", float(a), float(b)) for i, (a, b) in enumerate(nodes)],
                               "id long, section string, x double, y double")
    q = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(asked)], "id long, x double, y double")
    got = {r["id"]: r for r in G.nearest_node(q, nd).collect()}
    for i, p in enumerate(asked):
        d = np.hypot(*(nodes - p).T)
        best = int(d.argmin())
        if d[best] <= 8:
            assert got[i]["node"] == best and abs(got[i]["distance"] - d[best]) < 1e-9
            assert got[i]["hit"] == (d[best] < 7 / 1.2)
        else:
            assert got[i]["node"] is None and not got[i]["hit"]


def test_separation_reduces_overlap(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 6, (80, 2)))]
    df = spark.createDataFrame(rows, "id long, x double, y double")

    def total(frame):
        gap = F.sum(G.MIN_DIST - F.col("distance"))
        return G.proximity_pairs(frame).agg(gap).first()[0] or 0.0

    assert total(G.separate_once(df)) < total(df)


def items(spark, sizes, dim=12, seed=0):
    rng = np.random.default_rng(seed)
    rows, at = [], 0
    for name, n in sizes.items():
        base = rng.normal(size=(max(1, n // 12), dim)) * 3
        for i in range(n):
            rows.append((at, name, (base[i % len(base)] + 0.3 * rng.normal(size=dim)).tolist()))
            at += 1
    return spark.createDataFrame(rows, "id long, section string, embedding array<double>")


SIZES = {"a": 90, "b": 60, "c": 5, "d": 1, "Unsorted": 40}


def test_layout_methods_and_bounds(spark):
    df = items(spark, SIZES)
    rows = Y.layout(df).toPandas()
    assert len(rows) == sum(SIZES.values())
    methods = rows.groupby("section")["method"].first().to_dict()
    assert methods == {"a": "projected", "b": "projected", "c": "disc", "d": "centre", "Unsorted": "projected"}
    assert rows[["x", "y"]].min().min() >= -1e-9 and rows[["x", "y"]].max().max() <= 1 + 1e-9
    assert rows[rows.section == "d"][["x", "y"]].iloc[0].tolist() == [0.5, 0.5]


def test_layout_keeps_neighbours(spark):
    df = items(spark, {"a": 60, "b": 40})
    placed = Y.layout(df, pack=True).cache()
    for row in Y.knn_recall(df, placed).collect():
        assert row["recall"] > 1.5 * row["random"]


def test_packing_moves_rows_apart(spark):
    df = items(spark, {"a": 90})
    gap = F.coalesce(F.sum(G.MIN_DIST - F.col("distance")), F.lit(0.0))
    before, after = (G.proximity_pairs(Y.layout(df, pack=True, rounds=r)).agg(gap).first()[0] for r in (0, 6))
    assert after < 0.5 * before


def test_map(spark):
    df = items(spark, SIZES).withColumn("filename", F.concat(F.lit("f"), "id"))
    nodes, sections = Y.build_map(df)
    nodes, summary = nodes.toPandas(), sections.toPandas()
    assert summary["name"].tolist() == ["a", "b", "Unsorted", "c", "d"]
    assert summary.set_index("name")["n"].to_dict() == SIZES
    for _, s in summary.iterrows():
        part = nodes[nodes.section == s["name"]]
        assert (np.hypot(part.x - s.cx, part.y - s.cy) <= s.radius + 1e-6).all()
    xy = nodes[["x", "y"]].to_numpy()
    d = np.hypot(xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1])[~np.eye(len(xy), dtype=bool)]
    assert np.median(np.sort(d.reshape(len(xy), -1), axis=1)[:, 0]) > 0.3 * G.MIN_DIST
    order = [r["name"] for r in Y.section_order(sections).collect()]
    assert order == ["a", "b", "c", "d", "Unsorted"]


def test_many_maps_in_one_job(spark):
    df = items(spark, {"a": 30, "b": 10}).withColumn("collection", F.when(F.col("id") % 2 == 0, "x").otherwise("y"))
    _, sections = Y.build_map(df, by=["collection"])
    got = {(r["collection"], r["name"]): r["n"] for r in sections.collect()}
    assert got == {("x", "a"): 15, ("y", "a"): 15, ("x", "b"): 5, ("y", "b"): 5}


def test_resettle_without_peer_stays(spark):
    rows = [(1, "a", [1.0, 0.0], 3.0, 4.0, 0.1, 0.2), (2, "b", [1.0, 0.0], 5.0, 6.0, 0.3, 0.4), (3, "c", None, 0.0, 0.0, 0.0, 0.0)]
    nodes = spark.createDataFrame(
        rows, "id long, section string, embedding array<double>, home_x double, home_y double, rel_x double, rel_y double")
    moves = spark.createDataFrame([(1, "b"), (2, "z"), (3, "a")], "id long, section string")
    got = {r["id"]: r for r in G.resettle(moves, nodes).collect()}
    assert (got[1]["home_x"], got[1]["home_y"], got[1]["rel_x"], got[1]["peer"]) == (6.6, 7.6, 0.3, 2)
    assert got[2]["home_x"] == 5.0 and got[2]["peer"] is None
    assert got[3]["home_x"] == 0.0


def test_copies_of_a_vector_get_places_of_their_own(spark):
    rng = np.random.default_rng(4)
    vectors = [[1.0, 2.0, 3.0, 4.0]] * 300 + rng.normal(size=(40, 4)).tolist()
    df = spark.createDataFrame([(i, "a", v) for i, v in enumerate(vectors)], "id long, section string, embedding array<double>")
    nodes = Y.build_map(df)[0].select("id", "x", "y").toPandas()
    assert len(nodes) == 340 and len(nodes[["x", "y"]].drop_duplicates()) == 340
    xy = nodes[["x", "y"]].to_numpy()
    d = np.hypot(xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1])
    np.fill_diagonal(d, np.inf)
    print("closer than MIN_DIST to another:", (d.min(axis=1) < G.MIN_DIST).sum(), "than half:", (d.min(axis=1) < G.MIN_DIST / 2).sum())
    assert np.median(d.min(axis=1)) > 0.3 * G.MIN_DIST


def knot(spark, n=300, dims=16, copies=0):
    """A closed curve that overlaps itself in every projection."""
    rng = np.random.default_rng(5)
    t = np.sort(rng.uniform(0, 2 * np.pi, n))
    waves = np.stack([f(k * t) for k in range(1, 9) for f in (np.cos, np.sin)], axis=1)
    turn = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
    x = waves @ turn + 0.01 * rng.normal(size=(n, dims))
    rows = [(i, "curve", v.tolist()) for i, v in enumerate(x)] + [(n + i, "curve", x[0].tolist()) for i in range(copies)]
    return spark.createDataFrame(rows, "id long, section string, embedding array<double>")


def test_neighbour_layout_keeps_a_curve_that_projection_folds(spark):
    df = knot(spark, copies=40)
    recall = {way: Y.knn_recall(df.where("id < 300"), Y.layout(df, neighbours=way)).first()["recall"] for way in (True, False)}
    assert recall[True] > 0.8 and recall[True] > recall[False] + 0.2, recall
    placed = Y.layout(df, neighbours=True).where("id >= 300 OR id = 0")
    assert placed.select("x", "y").distinct().count() == 1  # copies share their place
    one = spark.createDataFrame([(i, "s", [1.0, 2.0]) for i in range(20)], "id long, section string, embedding array<double>")
    assert Y.layout(one, neighbours=True).count() == 20


def test_crowded_cell_is_cut_into_bounded_leaves(spark):
    rng = np.random.default_rng(7)
    # a crowd inside one cell of the radius' size, half of it inside one finest cell
    spots = np.concatenate([rng.uniform(0, 8, (3000, 2)), rng.uniform(0, 0.05, (3000, 2)), rng.uniform(-60, 60, (500, 2))])
    asked = np.concatenate([rng.uniform(-1, 9, (200, 2)), rng.uniform(0, 0.06, (60, 2)), rng.uniform(-70, 70, (100, 2))])
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(spots)], "node long, x double, y double")
    tree = Q.cells(points, 8.0).collect()
    assert len({(r["level"], r["cx"] >> Q.FINEST - r["level"], r["cy"] >> Q.FINEST - r["level"]) for r in tree}) > 50
    assert all(r["level"] == Q.FINEST for r in tree if r["pieces"] > 1) and max(r["pieces"] for r in tree) >= 3000 // Q.LEAF
    queries = spark.createDataFrame([(float(a), float(b)) for a, b in asked], "qx double, qy double")
    got = {(r["qx"], r["qy"]): (r["node"], r["d"]) for r in Q.nearest_within(queries, points, 8.0, "node").collect()}
    for p in asked:
        d = np.hypot(*(spots - p).T)
        best = int(d.argmin())
        if d[best] <= 8:
            assert got[tuple(p)][0] == best and abs(got[tuple(p)][1] - d[best]) < 1e-9
        else:
            assert tuple(p) not in got


@pytest.mark.parametrize("n", [40, 3000])
def test_nearest_section_equals_brute_force(spark, n):
    rng = np.random.default_rng(n)
    place = np.round(rng.uniform(0, 100, size=(n, 2)))
    place[: n // 4] = place[0]  # a crowd of sections at one place
    sections = spark.createDataFrame([(i // 2, *map(float, p)) for i, p in enumerate(place)], "name long, cx double, cy double")
    at = np.concatenate([place[:60], np.round(rng.uniform(-40, 140, size=(200, 2)))])
    at[-1] = (400, 400)
    own = [int(i) // 2 if k % 2 else int(rng.integers(n)) for k, i in enumerate(range(len(at)))]
    points = spark.createDataFrame([(i, *map(float, p), o) for i, (p, o) in enumerate(zip(at, own))] + [(999, 1.0, 1.0, None)],
                                   "id long, x double, y double, section long")
    got = {r["id"]: (r["target"], r["distance"]) for r in G.nearest_section(points, sections).collect()}
    name = np.arange(n) // 2
    for i, p in enumerate(at):
        d = np.sqrt(((place - p) ** 2).sum(axis=1))
        d[name == own[i]] = np.inf
        best = np.lexsort((name, d))[0]
        assert got[i] == ((name[best], d[best]) if d[best] < 20 else (None, None))
    assert got[999] == (None, None) and len(got) == len(at) + 1


def test_a_crowd_of_sections_is_not_joined_with_a_crowd_of_points(spark):
    sections = spark.range(20_000).select(F.col("id").alias("name"), (F.col("id") % 50).cast("double").alias("cx"), F.lit(1.0).alias("cy"))
    points = spark.range(40_000).select("id", (F.col("id") % 50 + 0.25).alias("x"), F.lit(1.0).alias("y"), (F.col("id") % 25).alias("section"))
    got = G.nearest_section(points, sections)  # joined by cells, 20 000 sections meet 40 000 points
    assert got.agg(F.min("distance"), F.max("distance"), F.count("target")).first()[:] == (0.25, 0.25, 40_000)
    assert got.where("target % 50 <> id % 50 OR target = section").isEmpty()


def test_sections_of_bounded_size_take_the_same_steps_without_joins(spark):
    """A ring with chords, a path and a large ladder; in the third run the ladder alone is iterated by joins."""
    links = [("ring", f"r{i}", f"r{(i + s) % 30}", 1.0 + i * i % 5) for i in range(30) for s in (1, 4)]
    links += [("path", f"p{i}", f"p{i + 1}", 1.0) for i in range(9)]
    links += [("wide", f"w{i}", f"w{i + s}", 1.0 + i % 7) for i in range(78) for s in (1, 2)]
    edges = spark.createDataFrame(links + [(s, b, a, w) for s, a, b, w in links], "section string, src string, dst string, w double")
    sc = spark.sparkContext

    def placed(name, **how):
        sc.setJobGroup(name, name)
        rows = P.spectral_2d(edges, ["section"], steps=3, turns=2, **how).collect()
        jobs = len(sc.statusTracker().getJobIdsForGroup(name))
        sc.setLocalProperty("spark.jobGroup.id", None)
        return {(r.section, r.id): (r.x, r.y) for r in rows}, jobs

    joined, many = placed("spectral-joins", section_links=0)
    whole, few = placed("spectral-whole")
    mixed, _ = placed("spectral-mixed", section_links=200)
    assert len(whole) == 120 and whole.keys() == joined.keys() == mixed.keys()
    assert few < many / 2  # every step by joins: no fewer jobs than before
    for key, at in joined.items():
        assert whole[key] == pytest.approx(at, abs=1e-6) and mixed[key] == pytest.approx(at, abs=1e-6)


def test_proximity_pairs_meet_by_place(spark, monkeypatch):
    """A pile in several pieces, a pile next to it, loose nodes, and nodes that lie nowhere."""
    monkeypatch.setattr(G, "place_pieces", lambda df, by=(), cut=G.place_pieces: cut(df, by, 16))
    spots = [(1.0, 1.0)] * 70 + [(4.19, 1.0)] * 20 + [(5.3, 1.0), (-3.0, -0.0), (-3.0, 0.0), (40.0, 2.0)]
    odd = [(float("nan"), 1.0), (float("inf"), 1.0), (float("inf"), 1.0), (None, 1.0), (None, 1.0)]
    rows = [(i, s, x, y) for s in ("a", "b", None) for i, (x, y) in enumerate(spots + odd, 1000 if s == "a" else 0)]
    df = spark.createDataFrame(rows, "id long, section string, x double, y double")
    sizes = G.place_pieces(df, ["section"]).select("section", "x", F.size("ids").alias("n"))
    most, total = sizes.agg(F.max("n"), F.sum("n")).first()
    assert total == 2 * len(spots) and most < 40
    got = {(r.section, r.src, r.dst): r.distance for r in G.proximity_pairs(df, by=["section"]).collect()}
    want = {(s, i, j): np.hypot(a - c, b - d) for i, s, a, b in rows for j, t, c, d in rows
            if s is not None and s == t and i < j and a is not None and c is not None and np.hypot(a - c, b - d) < G.MIN_DIST}
    assert G.proximity_pairs(df, by=["section"]).count() == len(got) and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(d) for k, d in want.items())
