"""Neighbour joins against brute force, on every path: one block, many blocks, copies, exclusions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from atlas.operators import evaluate, groups, triage
from atlas.operators import centroids as C
from atlas.operators import neighbours as N
from atlas.operators.skew import positions, salted_join
from atlas.plans import vector_queries as Q
from atlas.plans.corpus import label_triage


def frame(spark, vectors, **columns):
    rows = [(i, [float(x) for x in v], *[c[i] for c in columns.values()]) for i, v in enumerate(vectors)]
    kinds = {k: "string" if isinstance(c[0], str) else "long" for k, c in columns.items()}
    schema = "id long, embedding array<double>" + "".join(f", {k} {t}" for k, t in kinds.items())
    return spark.createDataFrame(rows, schema)


def brute(x, k, group=None, by=None, metric="cosine"):
    x = np.asarray(x, dtype=float)
    if metric == "cosine":
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        s = np.round(u @ u.T, 9)
    else:
        s = -np.round(((x[:, None] - x[None]) ** 2).sum(axis=2), 9)
    np.fill_diagonal(s, -np.inf)
    for keys, same in ((group, True), (by, False)):
        if keys is not None:
            keys = np.asarray(keys)
            s[(keys[:, None] == keys[None]) == same] = -np.inf
    out = set()
    for i in range(len(x)):
        order = [j for j in np.argsort(-s[i], kind="stable")[:k] if np.isfinite(s[i, j])]
        out |= {(i, int(j), r + 1) for r, j in enumerate(order)}
    return out


def found(df):
    return {(r["src"], r["dst"], r["rank"]) for r in df.collect()}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    x = np.concatenate([centres[i % 6] + 0.15 * rng.normal(size=8) for i in range(240)]).reshape(240, 8)
    x[100:180] = x[100]  # a third of the rows are copies of one vector
    return x


@pytest.mark.parametrize("block_rows", [None, 40])
@pytest.mark.parametrize("metric", ["cosine", "sqeuclid"])
def test_top_k(spark, vectors, block_rows, metric):
    df = frame(spark, vectors)
    assert found(N.top_k(df, k=5, metric=metric, block_rows=block_rows)) == brute(vectors, 5, metric=metric)


@pytest.mark.parametrize("block_rows", [None, 30])
def test_top_k_excludes_groups_and_respects_keys(spark, vectors, block_rows):
    group = [i % 3 if i < 100 or i >= 180 else 0 for i in range(len(vectors))]
    by = ["hot" if i % 5 else "cold" for i in range(len(vectors))]
    df = frame(spark, vectors, g=group, b=by)
    assert found(N.top_k(df, k=4, exclude="g", block_rows=block_rows)) == brute(vectors, 4, group=group)
    assert found(N.top_k(df, k=4, by=["b"], block_rows=block_rows)) == brute(vectors, 4, by=by)


def test_top_k_where_a_group_owns_its_cells(spark, vectors):
    group = [i % 6 for i in range(len(vectors))]  # one group per centre
    df = frame(spark, vectors, g=group)
    assert found(N.top_k(df, k=4, exclude="g", block_rows=40)) == brute(vectors, 4, group=group)


def test_top_k_between_tables(spark, vectors):
    df = frame(spark, vectors)
    left, right = df.where("id < 90"), df.where("id >= 60")
    got = found(N.top_k(left, right, k=3, block_rows=25))
    want = set()
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    for i in range(90):
        order = [j for j in np.argsort(-s[i], kind="stable") if j >= 60 and j != i][:3]
        want |= {(i, int(j), r + 1) for r, j in enumerate(order)}
    assert got == want


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_partitions_do_not_matter(spark, vectors, partitions):
    df = frame(spark, vectors).repartition(partitions)
    assert found(N.top_k(df, k=5, block_rows=40)) == brute(vectors, 5)


def pairs_of(x, t):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    return {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= t}


def partition_of(edges, n):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(n)}


@pytest.mark.parametrize("block_rows", [None, 30])
@pytest.mark.parametrize("threshold", [0.98, 0.9, 0.3])
def test_near_duplicates(spark, vectors, block_rows, threshold):
    df = frame(spark, vectors)
    copies = set(range(101, 180))
    want = pairs_of(vectors, threshold)
    pairs = {(r["src"], r["dst"]) for r in N.near_dup_pairs(df, threshold, block_rows=block_rows).collect()}
    plain = {p for p in want if not copies & set(p)}
    assert {p for p in pairs if not copies & set(p)} == plain
    assert pairs == want
    links = [(r["src"], r["dst"]) for r in N.near_dup_links(df, threshold, block_rows=block_rows).collect()]
    assert partition_of(links, len(vectors)) == partition_of(want, len(vectors))


def test_string_ids(spark, vectors):
    named = frame(spark, vectors).withColumn("id", F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 4, "0")))
    got = {(int(a[1:]), int(b[1:]), r) for a, b, r in found(N.top_k(named, k=3, block_rows=60))}
    assert got == brute(vectors, 3)
    links = [(int(r["src"][1:]), int(r["dst"][1:])) for r in N.near_dup_links(named, 0.98, block_rows=60).collect()]
    assert partition_of(links, len(vectors)) == partition_of(pairs_of(vectors, 0.98), len(vectors))
    joined = groups.components(N.near_dup_links(named, 0.98))
    assert joined.count() == len({v for p in links for v in p})


def test_variants_of_one_source_keep_their_own_label(spark):
    cents = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("b", 1, [0.0, 1.0])], "label string, n long, centroid array<double>")
    source = spark.createDataFrame([(1, "a", 0, [1.0, 0.1])], "id long, label string, group_id long, embedding array<double>")
    aug = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.1, 1.0])], "source_id long, k long, embedding array<double>")
    for block_rows in (None, 1):
        got = {r["k"]: (r["nearest"], r["passed"]) for r in C.augment_gate(aug, source, cents, block_rows=block_rows).collect()}
        assert got == {0: ("a", True), 1: ("b", False)}
    with pytest.raises(Exception, match="repeated key"):
        C.augment_gate(aug, source, cents, keys=("source_id",)).collect()


def test_near_copies_cost_one_link_each(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([np.ones((300, 6)) + 1e-4 * rng.normal(size=(300, 6)), rng.normal(size=(100, 6))])
    links = N.near_dup_links(frame(spark, x), 0.98, block_rows=50).collect()
    assert partition_of([(r["src"], r["dst"]) for r in links], 400) == partition_of(pairs_of(x, 0.98), 400)
    assert len(links) < 4000  # all pairs would be 44 850


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, j) for j in range(1001, 1200)] + [(5000, 5001)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["id"]: r["component"] for r in groups.components(df).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[j] == 1000 for j in range(1000, 1200))
    assert got[5001] == 5000


def test_leakage_groups_and_folds(spark, vectors):
    folder = [i // 7 for i in range(len(vectors))]
    df = frame(spark, vectors, folder=folder)
    links = N.near_dup_links(df, 0.98, block_rows=60)
    got = {r["id"]: r["group_id"] for r in groups.leakage_groups(df, links).collect()}
    edges = pairs_of(vectors, 0.98) | {(i, i - i % 7) for i in range(len(vectors))}
    assert got == partition_of(edges, len(vectors))
    rows = groups.group_kfold(groups.leakage_groups(df, links), 3)
    audit = groups.leakage_audit(rows, N.near_dup_pairs(df, 0.98)).first()
    assert (audit["crossing_groups"], audit["crossing_pairs"]) == (0, 0)


def test_folds_are_balanced(spark):
    rows = spark.range(2000).withColumn("group_id", F.floor(F.col("id") / 5))
    sizes = [r["n"] for r in groups.group_kfold(rows, 5).groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 5


def test_salted_join_equals_join(spark):
    big = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"))
    small = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        got = salted_join(big, small, ["k"], how, spread=["id"], share=0.05, floor=10)
        assert sorted(map(tuple, got.select("id", "k", "v").collect()), key=str) == sorted(
            map(tuple, big.join(small, "k", how).select("id", "k", "v").collect()), key=str)


def test_positions_equal_row_number(spark):
    df = spark.range(500).select("id", (F.col("id") % 2).alias("k"), ((F.col("id") * 37) % 101).alias("t"))
    got = positions(df, ["k"], [F.floor(F.col("t") / 10)], [F.col("t"), F.col("id")], "at").collect()
    for key in (0, 1):
        ordered = sorted((r for r in got if r["k"] == key), key=lambda r: (r["t"], r["id"]))
        assert [r["at"] for r in ordered] == list(range(1, 251))


@pytest.fixture(scope="module")
def planted():
    """Five clear classes over 20 packs, one label in eleven flipped."""
    rng = np.random.default_rng(3)
    n = 300
    truth = np.arange(n) % 5
    x = np.eye(5)[truth] + 0.05 * rng.normal(size=(n, 5))
    label = truth.copy()
    flipped = np.arange(0, n, 11)
    label[flipped] = (label[flipped] + 1 + flipped // 11 % 4) % 5
    return x, [f"L{v}" for v in truth], [f"L{v}" for v in label], set(flipped.tolist())


def test_triage_with_shipped_thresholds(spark, planted):
    x, truth, label, flipped = planted
    df = frame(spark, x, label=label, group_id=[i % 20 for i in range(len(x))])
    rows = {r["id"]: r for r in label_triage(df).collect()}
    fixed = {i for i, r in rows.items() if r["decision"] == "fix"}
    assert fixed == flipped
    assert all(rows[i]["consensus"] == truth[i] for i in flipped)


def test_item_without_neighbours_is_kept(spark):
    df = frame(spark, np.eye(3), label=["a", "b", "c"], group_id=[1, 1, 1])
    rows = label_triage(df).collect()
    assert len(rows) == 3 and all(r["own"] is None and r["decision"] == "keep" for r in rows)


def test_review_needs_a_file(spark):
    scored = spark.createDataFrame(
        [(1, "a", "b", 0.1, 0.4, True), (2, "a", "b", 0.1, 0.4, False), (3, "a", "b", 0.5, 0.5, True)],
        "id long, label string, consensus string, own double, strength double, here boolean")
    got = {r["id"]: r["decision"] for r in triage.triage(scored, has_file="here").collect()}
    assert got == {1: "review", 2: "keep", 3: "keep"}


def test_shuffled_labels_score_at_chance(spark):
    rows = spark.range(4000).select("id", (F.col("id") % 4).alias("label"))
    mixed = groups.shuffle_labels(rows, 3)
    assert mixed.groupBy("shuffled").count().agg(F.min("count"), F.max("count")).first()[:] == (1000, 1000)
    accuracy = evaluate.overall(mixed, "label", "shuffled").first()["accuracy"]
    assert abs(accuracy - 0.25) < 0.03


def compared(monkeypatch, spark, n, groups=1):
    """Share of all pairs of rows that meet in a task, for clustered vectors."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 4)) * 4
    x = centres[np.arange(n) % 40] + rng.normal(size=(n, 4)) * rng.uniform(0.2, 1, size=(n, 1))
    rows = spark.createDataFrame([(i, i % 40 % groups, v.tolist()) for i, v in enumerate(x)], "id long, pack long, embedding array<double>")
    met, real = [], N._meet

    def counted(left, right, pairs, lkeys, rkeys, by, run, schema):
        a = left.groupBy(*lkeys).agg(F.count(F.lit(1)).alias("a"))
        b = right.groupBy(*rkeys).agg(F.count(F.lit(1)).alias("b"))
        met.append(pairs.join(a, lkeys).join(b, rkeys).agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0)
        return real(left, right, pairs, lkeys, rkeys, by, run, schema)

    monkeypatch.setattr(N, "_meet", counted)
    found = N.top_k(rows, k=5, metric="sqeuclid", block_rows=n // 2, exclude="pack" if groups > 1 else None)
    monkeypatch.setattr(N, "_meet", real)
    return sum(met) / n / n, found, x


def test_compared_share_falls_as_the_table_grows(spark, monkeypatch):
    small, large = (compared(monkeypatch, spark, n)[0] for n in (4000, 16_000))
    assert small < 0.5 and large < 0.6 * small, (small, large)


def test_cells_of_one_group_still_prune(spark, monkeypatch):
    # a cluster belongs to one group, so no row finds anything in its own surroundings
    share, found, x = compared(monkeypatch, spark, 4000, groups=8)
    assert share < 0.7, share
    got = {(r["src"], r["rank"]): r["dst"] for r in found.where("src % 97 = 0").collect()}
    for i in range(0, 4000, 97):
        d = np.round(((x - x[i]) ** 2).sum(axis=1), N.DIGITS)
        d[np.arange(4000) % 40 % 8 == i % 40 % 8] = np.inf
        assert [got[i, k + 1] for k in range(5)] == np.lexsort((np.arange(4000), d))[:5].tolist()


def counted_meetings(monkeypatch):
    calls, real = [], N._meet

    def meet(left, right, pairs, *rest):
        calls.append(pairs.count())
        return real(left, right, pairs, *rest)

    monkeypatch.setattr(N, "_meet", meet)
    return calls


def test_rows_without_structure_meet_in_tiles(spark, monkeypatch):
    x = np.random.default_rng(8).normal(size=(900, 32))
    x[500:520] = x[500] + 1e-3 * np.random.default_rng(9).normal(size=(20, 32))
    group, by = [i % 7 for i in range(900)], [f"b{i % 3}" for i in range(900)]
    df = frame(spark, x, g=group, b=by)
    monkeypatch.setattr(N, "TILE_ROWS", (250, 250))
    monkeypatch.setattr(N, "COLUMNS_AT_ONCE", 64)
    calls = counted_meetings(monkeypatch)
    assert found(N.top_k(df, k=5, exclude="g", block_rows=30)) == brute(x, 5, group=group)
    assert calls[-1] == 16  # four tiles a side; before: 30 cells a side
    assert found(N.top_k(df, k=5, metric="sqeuclid", by=["b"], block_rows=30)) == brute(x, 5, by=by, metric="sqeuclid")
    for threshold in (0.3, 0.45):
        got = {(r["src"], r["dst"]) for r in N.near_dup_pairs(df, threshold, block_rows=30).collect()}
        assert got == pairs_of(x, threshold) and calls[-1] == 10
        links = [(r["src"], r["dst"]) for r in N.near_dup_links(df, threshold, block_rows=30).collect()]
        assert partition_of(links, 900) == partition_of(got, 900)


def test_cells_that_would_send_too_much_give_way_to_tiles(spark, monkeypatch):
    """Half of the cells separate, so cells are taken; rows that would travel too often for them meet in tiles."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 3))
    df = frame(spark, x)
    monkeypatch.setattr(N, "TILE_ROWS", (500, 500))
    monkeypatch.setattr(N, "TRAVEL", 1)
    calls, few = counted_meetings(monkeypatch), []
    for free in (N.TRAVEL_BYTES, 0):
        monkeypatch.setattr(N, "TRAVEL_BYTES", free)
        for run in (lambda: N.top_k(df, k=5, block_rows=30), lambda: N.near_dup_pairs(df, 0.8, block_rows=30)):
            got = run().collect()
            few.append(calls[-1])
            if len(got[0]) == 4:
                assert {(r["src"], r["dst"], r["rank"]) for r in got} == brute(x, 5)
            else:
                assert {(r["src"], r["dst"]) for r in got} == pairs_of(x, 0.8)
    assert min(few[:2]) > 100 and few[2:] == [4, 3], few


def test_slivers_of_cells_meet_in_tiles(spark, monkeypatch):
    x, by = np.random.default_rng(4).normal(size=(800, 2)), [f"b{i % 20}" for i in range(800)]
    calls = counted_meetings(monkeypatch)
    df = frame(spark, x, b=by)
    assert found(N.top_k(df, k=4, metric="sqeuclid", by=["b"], block_rows=100)) == brute(x, 4, by=by, metric="sqeuclid")
    assert calls[-1] == 20  # one tile for each key


def test_roots_of_links():
    rng = np.random.default_rng(2)
    for n, m in ((50, 20), (300, 280), (40, 700)):
        u, v = rng.integers(0, n, (2, m))
        root = np.arange(n)
        for part in np.array_split(np.arange(m), 3):
            N._join_roots(root, u[part], v[part])
        assert root.tolist() == list(partition_of(list(zip(u.tolist(), v.tolist())), n).values())


def test_sections_too_small_for_cells_are_not_cut_into_cells(spark, monkeypatch):
    """Cells of a few rows in each section cost a call each; then all pairs of a section meet, without pivots."""
    rng = np.random.default_rng(5)
    x, section = rng.normal(size=(300, 4)), [int(s) for s in rng.integers(0, 6, 300)]

    def none(*_, **__):
        raise AssertionError("pivots chosen")

    monkeypatch.setattr(N, "_pivots", none)
    near = N.top_k(frame(spark, x, section=section), k=3, metric="sqeuclid", by=["section"], block_rows=20)
    assert {(r.src, r.dst, r["rank"]) for r in near.collect()} == brute(x, 3, by=section, metric="sqeuclid")


def test_few_bytes_do_not_put_all_pairs_of_blocks_into_one_task(spark):
    def where(left, right):
        from pyspark import TaskContext

        return left[["_id"]].head(1).assign(task=TaskContext.get().partitionId())

    rows = spark.range(400).selectExpr("id AS _id", "cast(id % 40 AS int) AS cell", "array(1.0D) AS _v", "0 AS _x", "'' AS _c")
    left, right = (rows.withColumnsRenamed({"cell": f"{s}_cell"}) for s in "lr")
    pairs = spark.range(40).selectExpr("cast(id AS int) AS l_cell", "cast(id AS int) AS r_cell")
    met = N._meet(left, right, pairs, ["l_cell"], ["r_cell"], (), where, "_id long, task int")
    tasks = [r["task"] for r in met.collect()]
    assert len(tasks) == 40 and len(set(tasks)) >= 8


@pytest.mark.parametrize("metric", ["cosine", "sqeuclid"])
def test_single_precision_only_decides_what_is_scored(metric):
    """Scores that single precision cannot tell apart, copies, huge and tiny vectors: the same columns as by full scores."""
    rng = np.random.default_rng(3)
    close = rng.normal(size=(1, 8)) + 1e-8 * rng.normal(size=(700, 8))
    wide = rng.normal(size=(300, 8)) * 10.0 ** rng.integers(-6, 4, (300, 1))
    for rm in (np.concatenate([close, wide, wide[:100]]), rng.normal(size=(1200, 8)) * 1e17, np.zeros((900, 8))):
        rm = N._unit(rm) if metric == "cosine" else rm
        lm, lid, rid = rm[::9], np.arange(len(rm))[::9], np.arange(len(rm))
        group = rid % 3
        best, value = N._running_best(lm, rm, 5, metric, lid, rid, group[::9], group)
        full = N._scores(lm, rm, metric)
        full[group[::9][:, None] == group[None]] = -np.inf
        top = np.take_along_axis(full, N._best(full, 5), axis=1)
        scale = max(1.0, np.abs(top).max())
        assert np.abs(value - top).max() <= 2e-9 * scale
        assert (np.abs(np.take_along_axis(full, best, axis=1) - value) <= 2e-9 * scale).all()


def test_true_distances_of_a_few_rows_save_the_search_for_a_bound(spark, monkeypatch):
    """Without structure no bound makes cells worth while; before, all rows met three cells each to find that out."""
    x, group = np.random.default_rng(8).normal(size=(600, 32)), [i % 7 for i in range(600)]
    flat = np.random.default_rng(9).normal(size=(600, 2))
    calls = counted_meetings(monkeypatch)
    monkeypatch.setattr(N, "TILE_ROWS", (250, 250))
    assert found(N.top_k(frame(spark, x, g=group), k=5, exclude="g", block_rows=30)) == brute(x, 5, group=group)
    assert calls == [9], calls
    calls.clear()
    assert found(N.top_k(frame(spark, flat), k=5, metric="sqeuclid", block_rows=30)) == brute(flat, 5, metric="sqeuclid")
    assert len(calls) == 2 and calls[1] > 9, calls  # cells separate here, and are taken


def test_least_needed_is_no_more_than_what_bounds_leave(spark):
    rng = np.random.default_rng(3)
    x, by, group = rng.normal(size=(400, 3)), [f"b{i % 2}" for i in range(400)], [i % 3 for i in range(400)]
    rows = N._standard(frame(spark, x, g=group, b=by), "id", "embedding", ["b"], "g")
    pivots = N._pivots(rows, 20, "sqeuclid")
    radii = N._radii(N._with_cells(rows, pivots, "sqeuclid"), pivots)
    got = N._least_needed(rows, rows, 400, pivots, radii, 4, "sqeuclid", ["_by0"], True, True)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    i = np.arange(400)
    d[(i[:, None] % 2 != i[None] % 2) | (i[:, None] % 3 == i[None] % 3)] = np.inf
    chosen = [r["_id"] for r in rows.where(F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(400 // N.FEW_PROBES)) == 0).orderBy(
        F.xxhash64("_id"), "_id").limit(N.FEW_PROBES).collect()]
    want = len(N._within(x[chosen], np.sqrt(np.sort(d[chosen], axis=1)[:, 3]), pivots, radii)[0]) / len(chosen)
    assert got == pytest.approx(want) and got < 20


def test_tiles_of_keys_keep_all_cores_busy(spark, monkeypatch):
    """One tile for each key made as many tasks as keys; with ten keys, eight cores waited for two of them."""
    x, by = np.random.default_rng(4).normal(size=(400, 8)), [f"b{i % 2}" for i in range(400)]
    calls = counted_meetings(monkeypatch)
    monkeypatch.setattr(N, "TILE_ROWS", (20, 200))
    got = found(N.top_k(frame(spark, x, b=by), k=4, metric="sqeuclid", by=["b"], block_rows=100))
    assert got == brute(x, 4, by=by, metric="sqeuclid")
    assert calls[-1] >= N.TASKS_A_CORE * spark.sparkContext.defaultParallelism, calls


def test_cells_of_keys_suit_the_rows_of_a_key(spark, monkeypatch):
    """Cells for the whole table were cut into slivers by the keys, each of them a call for every neighbour."""
    assert N.keyed_leaf_count(615_384, 61_538.0, 131_072, 2) == 87 and N.leaf_count(615_384, 131_072, 2) == 784
    x, by = np.random.default_rng(4).normal(size=(800, 2)), [f"b{i % 4}" for i in range(800)]
    counts, real = [], N._pivots
    monkeypatch.setattr(N, "_pivots", lambda df, count, *rest: counts.append(count) or real(df, count, *rest))
    monkeypatch.setattr(N, "PAIRS_A_CALL", 0)
    monkeypatch.setattr(N, "CELL_ROWS", 40)
    got = found(N.top_k(frame(spark, x, b=by), k=4, metric="sqeuclid", by=["b"], block_rows=400))
    assert got == brute(x, 4, by=by, metric="sqeuclid")
    assert counts == [5], counts  # before: 28


def test_links_of_pairs_connect_what_the_pairs_connect(spark, monkeypatch):
    rng = np.random.default_rng(7)
    pairs = [(int(a), int(b)) for a, b in np.sort(rng.integers(0, 500, (900, 2)), axis=1) if a < b]
    pairs += [(a, b) for a in range(500, 560) for b in range(a + 1, 560)]  # a cluster: 1,770 pairs of 60 rows
    for ids, at_once in (("long", 1 << 20), ("long", 64), ("string", 200)):
        monkeypatch.setattr(N, "LINKS_AT_ONCE", at_once)
        rows = [(f"{a:03d}", f"{b:03d}") if ids == "string" else (a, b) for a, b in pairs]
        df = spark.createDataFrame(rows, f"src {ids}, dst {ids}").coalesce(1)
        links = [(int(r["src"]), int(r["dst"])) for r in N.links_of_pairs(df).collect()]
        assert partition_of(links, 560) == partition_of(pairs, 560)
        assert at_once < 1 << 20 or len(links) < 560
    assert N.links_of_pairs(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_the_audit_compares_the_vectors_once(spark, monkeypatch):
    """Before, groups and pairs compared all vectors each for itself."""
    folder, calls, real = "/root/testdata/sf0.001", [], N._near_dup
    rows = Q.items(spark, folder)
    want = groups.leakage_audit(Q.folded(spark, folder), N.near_dup_pairs(rows, Q.PAIR_LIMIT)).first()
    careless = Q.grouped(spark, folder).withColumn("fold", F.col("id") % 5)
    worse = groups.leakage_audit(careless, N.near_dup_pairs(rows, Q.PAIR_LIMIT)).first()
    monkeypatch.setattr(N, "_near_dup", lambda *a, **k: calls.append(1) or real(*a, **k))
    assert Q.leakage_audit(spark, folder).first() == want and len(calls) == 1
    assert Q.leakage_audit_careless(spark, folder).first() == worse and len(calls) == 2 and worse["crossing_pairs"] > 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_a_group_of_most_rows_is_not_compared_with_itself(kind, monkeypatch):
    rng = np.random.default_rng(3)
    x, group = rng.normal(size=(1500, 8)), np.where(np.arange(1500) % 100 == 0, np.arange(1500), 7)
    name = (lambda v: f"{v:05d}") if kind == "string" else int
    df = pd.DataFrame({"_id": [name(i) for i in range(1500)], "_v": list(x), "_x": [name(g) for g in group], "_c": ""})
    seen, scores, candidates = [], N._raw_scores, N._candidates
    monkeypatch.setattr(N, "_raw_scores", lambda a, b, m: seen.append(len(a) * len(b)) or scores(a, b, m))
    monkeypatch.setattr(N, "_candidates", lambda a, b, *rest: seen.append(len(a.rows) * len(b.rows)) or candidates(a, b, *rest))
    got = N._block_topk(5, "cosine", True, True, False)(df, df)
    assert sum(seen) < 1500 * 1500 / 10  # before: all pairs, most of them for nothing
    near = {(int(s), int(d)) for s, d in zip(got["src"], got["dst"])}
    assert near == {(s, d) for s, d, _ in brute(x, 5, group)} and len(got) == 7500


def test_codes_are_equal_where_values_are():
    a, b = N._codes(np.array([1.0, np.nan, 3.0]), np.array([3.0, np.nan]))
    assert (a[:, None] == b[None, :]).tolist() == [[False, False], [False, False], [True, False]]
    a, b = N._codes(np.array(["x", None], object), np.array([None, "x"], object))
    assert (a[:, None] == b[None, :]).tolist() == [[False, True], [True, False]]


def test_tiles_of_one_group_do_not_meet(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x, group = rng.normal(size=(900, 16)), ["a" if i < 500 else "b" if i < 820 else f"c{i % 9}" for i in range(900)]
    df = frame(spark, x, pack=group)
    rows = N._standard(df, "id", "embedding", exclude="pack")
    count = "src long, dst long, score double"
    run = lambda left, right: pd.DataFrame({"src": [len(left) * len(right)], "dst": [0], "score": [0.0]})
    met = N._by_tiles(rows, rows, [], 100, run, count, True).agg(F.sum("src")).first()[0]
    assert met == 900 * 900 - 500 * 500 - 320 * 320  # before: 900 * 900
    alone = N._standard(df.withColumn("pack", F.lit("a")), "id", "embedding", exclude="pack")
    assert N._by_tiles(alone, alone, [], 100, run, count, True).isEmpty()
    monkeypatch.setattr(N, "TILE_ROWS", (100, 200))
    monkeypatch.setattr(N, "_is_dense", lambda *a: True)
    assert found(N.top_k(df, k=5, exclude="pack", block_rows=60)) == brute(x, 5, group)
