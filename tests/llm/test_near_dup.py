"""Operators 5 and 9, against brute force."""

import random

import numpy as np
import pytest
import xxhash

from atlas.llm import projections, simhash
from atlas.llm.tiles import spanning_forest


def groups_of(links, members):
    parent = {m: m for m in members}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {m: root(m) for m in members}


def plain_simhash(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for bit in range(64):
            counts[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * counts[bit] > len(shingles))


def test_fingerprint():
    for text in ("A b c d A b c", "one", "one two", "", None, " \n ", "É É\x85É é", "a b c a b c a b c d" * 50):
        assert simhash.simhash(text) & (2 ** 64 - 1) == plain_simhash(text)


def test_forest_joins_what_the_links_join():
    rng = np.random.default_rng(0)
    for n, links in ((1, 0), (5, 3), (60, 40), (60, 1500)):
        u, v = rng.integers(0, n, (2, links))
        kept = spanning_forest(u, v, n)
        assert groups_of(zip(u[kept].tolist(), v[kept].tolist()), range(n)) == groups_of(zip(u.tolist(), v.tolist()), range(n))
        assert len(kept) == n - len(set(groups_of(zip(u.tolist(), v.tolist()), range(n)).values()))


@pytest.mark.parametrize("tile", [4, 4096])
def test_links_equal_brute_force(spark, tile):
    rng = random.Random(3)
    fps = {0, 2 ** 64 - 1}
    for _ in range(60):
        fp = rng.getrandbits(64)
        for _ in range(6):
            fps.add(fp)
            fp ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
    for bit in range(64):
        fps.add(1 << bit)  # a dense ball around zero
    fps = sorted(fps)
    signed = [f - 2 ** 64 if f >= 2 ** 63 else f for f in fps]
    vertices = spark.createDataFrame(list(enumerate(signed)), "id long, fp long")
    found = [(r["src"], r["dst"]) for r in simhash.fingerprint_links(vertices, 2, tile).collect()]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    assert all((fps[a] ^ fps[b]).bit_count() <= 2 for a, b in found)
    assert groups_of(found, range(len(fps))) == groups_of(links, range(len(fps)))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    long = [" ".join(rng.choices(words, k=250)) for _ in range(12)]
    near = [t.replace("w7", "w8", 1) for t in long] + [long[0] + " w1"]
    return [*long, *near, long[3], long[3], None, "", " ", "one two", "w1 " * 60_000]


def test_near_duplicates(spark, texts):
    rows = [(3 * i + 1, t, "x", "y") for i, t in enumerate(texts)]
    rows += [rows[0], (None, texts[5], None, None), (None, "only without an id", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, id string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = {r[0]: plain_simhash(r[1]) for r in rows if r[0] is not None}
    ids = sorted(fps)
    expected = groups_of([(a, b) for a in ids for b in ids if b < a and (fps[a] ^ fps[b]).bit_count() <= 2], ids)
    for r in got:
        if r["doc_id"] is not None:
            assert r["fp"] & (2 ** 64 - 1) == fps[r["doc_id"]] and r["component_id"] == expected[r["doc_id"]]
    unnamed = {r["component_id"] for r in got if r["doc_id"] is None}
    assert unnamed == {expected[16], None}
    kept = [r["doc_id"] for r in simhash.keep_one(docs).collect()]
    assert sorted(k for k in kept if k is not None) == sorted(set(expected.values())) and kept.count(None) == 1  # the copy of a named text goes
    assert simhash.keep_one(docs).columns == docs.columns
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((150, 24))
    rows = [(v, int(i % 3)) for i, v in enumerate(base)]
    for i in range(40):  # around the threshold
        rows += [(base[i] + s * rng.standard_normal(24), int(i % 3)) for s in (0.05, 0.3, 0.42, 0.6)]
    rows += [(base[0], 0)] * 30 + [(2 * base[1], 1), (-base[1], 1), (base[2], 0), (base[3][:12], 0)]
    return rows


def test_vectors_equal_brute_force(spark, vectors):
    bad = [(None, 0), ([0.0] * 24, 0), ([float("nan")] + [1.0] * 23, 0), ([float("inf")] * 24, 0),
           ([None] + [1.0] * 23, 0), ([1.0] * 24, None), ([], 0)]
    rows = [(i, v.tolist(), label, "x", 1) for i, (v, label) in enumerate(vectors)]
    n = len(rows)
    rows += [(n + i, v, label, None, None) for i, (v, label) in enumerate(bad)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id string, block int")
    links = []
    for i in range(n):
        for j in range(i):
            (a, la), (b, lb) = vectors[i], vectors[j]
            if la == lb and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                links.append((i, j))
    component = groups_of(links, range(n))
    count = np.bincount(np.array(links).ravel(), minlength=n)
    for tile in (16, 1024):
        got = {r["vec_id"]: r for r in projections.near_duplicate_vectors(frame, tile=tile).collect()}
        assert len(got) == len(rows)
        for i in range(n):
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (count[i], component[i], component[i] == i)
        for i in range(n, len(rows)):
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert projections.near_duplicate_vectors(frame.limit(0)).count() == 0
    nameless = frame.limit(3).withColumn("vec_id", frame["vec_id"] * None)
    assert {tuple(r) for r in projections.near_duplicate_vectors(nameless).collect()} == {(None, 0, None, False)}


def test_calibration_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(9)
    a = projections.unit_rows(rng.standard_normal((4000, 64)))
    side = rng.standard_normal((4000, 64))
    side = projections.unit_rows(side - (side * a).sum(axis=1, keepdims=True) * a)
    b = 0.93 * a + np.sqrt(1 - 0.93 ** 2) * side
    axes = projections._directions(64, projections.DIRECTIONS, projections.SEED)
    window = projections.HALF_WINDOW * np.sqrt(2 - 2 * 0.93)
    collided = (np.abs(a @ axes - b @ axes) <= window).sum(axis=1)
    assert (collided < projections.collisions_needed()).mean() < 0.002
    far = projections.unit_rows(rng.standard_normal((4000, 64)))
    assert ((np.abs(a @ axes - far @ axes) <= window).sum(axis=1) >= projections.collisions_needed()).mean() < 0.05


def test_keep_one_loses_no_text(spark):
    rows = [(1, "a b c d"), (1, "w x y z other text"), (2, "a b c d"), (None, "a b c d"), (None, "quite another text here"),
            (None, "quite another text here"), (5, None), (6, ""), (7, "solo words of its own"), (7, "solo words of its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for _ in range(2):
        kept = sorted(map(str, (tuple(r) for r in simhash.keep_one(docs.repartition(3)).collect())))
        assert kept == sorted(map(str, [(1, "a b c d"), (1, "w x y z other text"), (None, "quite another text here"), (5, None),
                                        (7, "solo words of its own")]))
