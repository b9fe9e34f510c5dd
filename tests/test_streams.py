"""Streams end where their batch forms do; sinks and sources round-trip."""

import json

import pytest
from pyspark.sql import functions as F

from atlas.operators import intake
from atlas.plans import stream_queries as Q
from atlas.sources import cache as C
from atlas.sources import tables as S
from atlas.streaming import decisions as D
from atlas.streaming import flows as W
from atlas.streaming import seen as SEEN
from atlas.streaming import state as K


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def files(spark, df, path, order, n=4):
    """The rows in ``n`` files that arrive in order."""
    data = df.orderBy(order).collect()
    step = -(-len(data) // n)
    for i in range(n):
        part = spark.createDataFrame(data[i * step:(i + 1) * step], df.schema)
        part.coalesce(1).write.mode("append").parquet(path)
    return W.table_stream(spark, path, df.schema, files_per_batch=1)


MOVES = "path string, session long, seq long, from_section string, to_section string"


@pytest.fixture(scope="module")
def moves(spark):
    log = [
        ("p", 1, 1, "A", "B"), ("p", 1, 2, "B", "A"),                       # there and back
        ("q", 1, 3, "A", "B"), ("q", 1, 4, "B", "C"),                       # last wins
        ("r", 1, 5, "A", "B"), ("r", 1, 6, "B", "A"), ("r", 1, 7, "A", "C"),  # a fresh journey
        ("s", 1, 8, "A", "A"),                                              # not a move
        ("t", 1, 9, "A", "B"), ("t", 2, 10, "B", "C"), ("t", 2, 11, "C", "B"),  # session 2 undoes itself only
    ]
    return spark.createDataFrame(log, MOVES)


def test_fold_corrections(spark, moves, tmp_path):
    one = moves.where("session = 1")
    want = {"q": "C", "r": "C", "t": "B"}
    assert {r["path"]: r["section"] for r in D.fold_corrections(one).collect()} == want
    assert {r["path"]: r["section"] for r in D.fold_corrections(moves, "session").collect()} == want
    stream = files(spark, one, str(tmp_path / "moves"), "seq")
    state = W.final_state(D.journeys(stream))
    assert rows(state) == rows(D.journeys(one))


def test_counts_after_moves(spark, moves):
    start = spark.createDataFrame([("A", 3), ("B", 1)], "section string, n long")
    got = {r["section"]: r["n"] for r in D.apply_moves_counts(start, moves.where("path = 'q'")).collect()}
    assert got == {"A": 2, "B": 1, "C": 1}


def test_replay(spark, tmp_path):
    log = spark.createDataFrame([
        ("a", 1, "Kick"), ("a", 2, "keep"), ("a", 3, "Snare"), ("b", 4, "notdrum"), ("b", 5, "Kick"), ("c", 6, "skip"),
    ], "hash string, seq long, label string")
    want = {"a": ("Snare", False), "b": ("Kick", True), "c": (None, False)}
    assert {r["hash"]: (r["label"], r["dropped"]) for r in D.replay_decisions(log).collect()} == want
    state = W.final_state(D.replay_decisions(files(spark, log, str(tmp_path / "log"), "seq")))
    assert {r["hash"]: (r["label"], r["dropped"]) for r in state.collect()} == want


ITEMS = "path string, hash string, label string, duration double, seq long"


def test_ingest_equals_batch(spark, tmp_path):
    data = [(f"f{i:03d}", f"h{i % 17}", None if i % 11 == 0 else "Kick", 4.0 if i % 7 == 0 else 1.0, i) for i in range(80)]
    df = spark.createDataFrame(data, ITEMS)
    out = str(tmp_path / "out")
    W.ingest_stream(files(spark, df, str(tmp_path / "in"), "seq"), out)
    batch = intake.gate(df).where("reason = 'kept'").drop("reason")
    assert rows(W.kept_items(spark, out)) == rows(batch)
    verdicts = spark.read.parquet(f"{out}/verdicts")
    assert verdicts.count() == 80  # each item exactly once
    assert verdicts.select("batch").distinct().count() > 1


def test_a_second_run_adds_to_the_first(spark, tmp_path):
    out = str(tmp_path / "out")
    first = spark.createDataFrame([("a", "h1", "Kick", 1.0, 0), ("b", "h2", "Kick", 1.0, 1)], ITEMS)
    second = spark.createDataFrame([("c", "h2", "Kick", 1.0, 0), ("d", "h3", "Kick", 1.0, 1)], ITEMS)
    for name, df in (("one", first), ("two", second)):
        W.ingest_stream(files(spark, df, str(tmp_path / name), "seq"), out)
    assert sorted(r["path"] for r in W.kept_items(spark, out).collect()) == ["a", "b", "d"]


def test_new_hashes_read_no_history(spark, tmp_path):
    out = str(tmp_path / "out")
    seen = SEEN.open_seen(spark, out, "one", slots=256, buckets=64, epoch=3)

    def hashes(first, last):
        return spark.range(first, last).select(F.md5(F.col("id").cast("string")).alias("hash"))

    for number in range(8):  # over two foldings
        seen.fold(number)
        seen.add(hashes(20 * number, 20 * number + 20), number)
    fresh, asked = hashes(10_000, 10_020), hashes(150, 152)
    assert seen.may_hold(fresh, 8) == [] and seen.earlier(fresh, 8).inputFiles() == []
    assert len(seen.may_hold(asked, 8)) <= 2 < len(seen.may_hold(hashes(0, 160), 8))
    assert asked.exceptAll(seen.earlier(asked, 8)).isEmpty()
    # a batch does not see itself or what followed, however often it runs
    assert seen.may_hold(asked, 7) == []
    seen.add(hashes(140, 160), 7)
    assert seen.earlier(hashes(0, 160), 8).count() == 160  # once each
    assert asked.join(seen.earlier(asked, 7), "hash").isEmpty()
    # another run sees all of it, and is seen when the first goes on
    other = SEEN.open_seen(spark, out, "two", slots=256, buckets=64, epoch=3)
    assert other.earlier(hashes(0, 160), 0).count() == 160 and other.may_hold(fresh, 0) == []
    other.add(fresh, 0)
    again = SEEN.open_seen(spark, out, "one", slots=256, buckets=64, epoch=3)
    assert again.earlier(fresh, 8).join(fresh, "hash").count() == 20
    other.add(spark.createDataFrame([(None,), (None,)], "hash string"), 1)  # null has a place; nothing at all is fine
    other.add(fresh.limit(0), 2)
    other.fold(3)
    assert len(other.may_hold(spark.createDataFrame([(None,)], "hash string"), 2)) == 1
    assert other.earlier(fresh, 3).join(fresh, "hash").count() == 20


def test_gate_precedence_and_seen(spark):
    df = spark.createDataFrame([
        ("a", "h1", None, None, 0), ("b", "h1", "Kick", None, 0), ("c", "h1", "Kick", 9.0, 0), ("d", "h1", "Kick", 3.0, 0),
        ("e", "h1", "Snare", 1.0, 0), ("f", "h2", "Snare", 1.0, 0)], ITEMS)
    seen = spark.createDataFrame([("h2",)], "hash string")
    got = {r["path"]: r["reason"] for r in intake.gate(df, seen=seen).collect()}
    assert got == {"a": "unlabeled", "b": "bad", "c": "long", "d": "kept", "e": "dupe", "f": "dupe"}
    grown = intake.extend_seen(seen, df.where("path = 'd'"))
    assert {r["hash"] for r in grown.collect()} == {"h1", "h2"}


def test_running_dedup_and_counts(spark, tmp_path):
    df = spark.createDataFrame([(f"h{i % 9}", f"s{i % 4}", i) for i in range(60)], "hash string, section string, seq long")
    stream = files(spark, df, str(tmp_path / "a"), "seq")
    assert W.final_state(W.stream_dedup(stream), "append").select("hash").distinct().count() == 9
    assert rows(W.final_state(W.stream_counts(W.table_stream(spark, str(tmp_path / "a"), df.schema, files_per_batch=1)))) == rows(
        df.groupBy("section").agg(F.count("*").alias("n")))


def test_progress(spark):
    df = spark.createDataFrame([(0, 10, 5.0), (4, 10, 6.0), (10, 10, 9.0)], "done long, total long, elapsed double")
    assert [r["eta"] for r in W.progress(df).orderBy("done").collect()] == [None, 9, None]


def test_cache_versions(spark, tmp_path):
    cache = spark.createDataFrame([("v5|a|1|2",), ("v6|a|1|2",), ("v60|a|1|2",)], "fingerprint string")
    assert W.invalidate(cache, 6).first()[:] == (1, 2)
    assert W.valid_entries(cache, 6).first()[0] == "v6|a|1|2"
    cache.write.parquet(str(tmp_path / "cache"))
    assert W.clear(spark, str(tmp_path / "cache")) == 3
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 0


def test_cache_reuse_computes_misses_once(spark):
    df = spark.createDataFrame([("/new/a", "k1"), ("/b", "k2"), ("/copy/b", "k2"), ("/c", "k3")], "path string, fingerprint string")
    cache = spark.createDataFrame([("k1", 1)], "fingerprint string, value long")

    def compute(missing):
        assert missing.count() == 2
        return missing.where("fingerprint <> 'k3'").select("fingerprint", F.lit(7).cast("long").alias("value"))

    full, fresh = intake.incremental(df, cache, compute)
    assert rows(full.select("path", "value")) == [("/b", 7), ("/copy/b", 7), ("/new/a", 1)]
    assert fresh.count() == 1


def test_versioned_cache(spark, tmp_path):
    root, seen = str(tmp_path / "cache"), []
    names = spark.createDataFrame([(f"/{i}", f"k{i % 30}") for i in range(40)], "path string, fingerprint string")

    def compute(missing):
        seen.append(missing.count())
        return missing.where("fingerprint <> 'k3'").select("fingerprint", F.length("fingerprint").alias("size"))

    first = C.through_cache(names.where("fingerprint < 'k2'"), root, 6, "size int", compute)
    assert first.count() == names.where("fingerprint < 'k2' AND fingerprint <> 'k3'").count()
    full = C.through_cache(names, root, 6, "size int", compute)
    assert full.count() == 38 and full.where("fingerprint = 'k3'").isEmpty()
    assert C.through_cache(names.where("fingerprint <> 'k3'"), root, 6, "size int", compute).count() == 38
    assert seen[0] + seen[1] == 30 and seen[2] == 0
    assert C.entries(spark, root, 6, "size int").count() == 29  # the failed key has no entry and is tried again
    with pytest.raises(Exception):  # a run that breaks while it computes leaves nothing behind
        C.through_cache(names, root, 7, "size int", lambda m: m.select("fingerprint", F.raise_error(F.lit("x")).cast("int").alias("size")))
    assert C.entries(spark, root, 7, "size int").isEmpty()
    # what two runs at the same time both entered is one again after tidying
    C.insert(C.entries(spark, root, 6, "size int").limit(5), root, 6)
    assert C.entries(spark, root, 6, "size int").count() == 34
    C.tidy(spark, root, 6, "size int")
    assert sorted(r[0] for r in C.entries(spark, root, 6, "size int").select("fingerprint").collect()) == sorted(
        f"k{i}" for i in range(30) if i != 3)


def test_manifest_csv_and_parquet(spark, tmp_path):
    df = spark.createDataFrame([("h", "Kick", 1.23456, 'a "b", c.wav', "kit", "http://x")],
                               "hash string, label string, duration double, orig_name string, source_folder string, source_link string")
    for fmt in ("csv", "parquet"):
        out = str(tmp_path / fmt)
        S.append_manifest(df, out, fmt)
        S.append_manifest(df, out, fmt)
        back = S.read_manifest(spark, out, fmt).collect()
        assert len(back) == 2 and back[0]["duration"] == 1.235
    assert S.read_manifest(spark, str(tmp_path / "parquet"), "parquet").first()["orig_name"] == 'a "b", c.wav'


def test_ledger(spark):
    runs = spark.createDataFrame([("https://drive.google.com/a", True), ("https://mediafire.com/b", False), ("/local", True)],
                                 "link string, succeeded boolean")
    assert [r["link"] for r in intake.ledger_entries(runs).collect()] == ["https://drive.google.com/a"]


def test_decision_files(spark, tmp_path):
    good = [{"hash": "a", "current": "x", "label": "Kick"}, {"hash": "b", "current": "x", "label": "keep"}]
    (tmp_path / "d.jsonl").write_text("\n".join([json.dumps(good[0]), "{broken", json.dumps(good[1]), ""]))
    assert {r["hash"] for r in S.read_decisions(spark, str(tmp_path)).collect()} == {"a", "b"}
    with pytest.raises(Exception):
        S.read_decisions(spark, str(tmp_path), strict=True).collect()
    assert S.stream_decisions(spark, str(tmp_path)).isStreaming


def test_head_default_confidence(spark, tmp_path):
    S.write_head(spark, {"labels": ["a"], "coef": [[1.0]]}, str(tmp_path / "head"))
    assert S.read_head(spark, str(tmp_path / "head"))["min_confidence"] == 0.49


def test_audio_map_prefers_exemplars(spark):
    review = spark.createDataFrame([("h", "/r"), ("i", "/i")], "hash string, path string")
    best = spark.createDataFrame([("h", "/e")], "hash string, path string")
    assert rows(S.audio_map(review, best)) == [("h", "/e"), ("i", "/i")]


def test_keyed_state_survives_a_restart(spark, moves, tmp_path):
    log = moves.where("session = 1").drop("session")
    out, checkpoint, source = str(tmp_path / "out"), str(tmp_path / "check"), str(tmp_path / "in")
    wanted = set()
    for low, high in ((1, 3), (4, 6), (7, 9)):
        log.where(F.col("seq").between(low, high)).coalesce(1).write.mode("append").parquet(source)
        K.keep_batches(K.correction_state(W.table_stream(spark, source, log.schema, files_per_batch=1)), out, checkpoint)
        wanted = {tuple(r) for r in D.fold_corrections(log.where(F.col("seq") <= high)).collect()}
        assert {tuple(r) for r in K.current(spark, out, "path").where("section IS NOT NULL").collect()} == wanted
    assert wanted == {("q", "C"), ("r", "C"), ("t", "B")}
    # a move that arrives once more changes nothing
    log.where("seq = 4").coalesce(1).write.mode("append").parquet(source)
    K.keep_batches(K.correction_state(W.table_stream(spark, source, log.schema)), out, checkpoint)
    assert {tuple(r) for r in K.current(spark, out, "path").where("section IS NOT NULL").collect()} == wanted


def test_a_pause_ends_the_session(spark, tmp_path):
    schema = "path string, seq long, from_section string, to_section string, ts timestamp"
    rows = [("p", 1, "A", "B", 0), ("p", 2, "B", "A", 50), ("q", 3, "A", "B", 0), ("q", 4, "B", "C", 500), ("q", 5, "C", "B", 520),
            ("r", 6, "A", "B", 10), ("r", 7, "B", "A", 5000), ("z", 8, "A", "B", 9000)]
    out, checkpoint, source = str(tmp_path / "out"), str(tmp_path / "check"), str(tmp_path / "in")
    for part in (rows[:4], rows[4:6], rows[6:]):
        frame = spark.createDataFrame([(*r[:4], r[4]) for r in part], schema.replace("ts timestamp", "s long")).select(
            "path", "seq", "from_section", "to_section", F.timestamp_seconds(F.col("s") + 1_000_000).alias("ts"))
        frame.coalesce(1).write.mode("append").parquet(source)
        stream = W.table_stream(spark, source, schema, files_per_batch=1).withWatermark("ts", "10 seconds")
        K.keep_batches(K.correction_state(stream, idle=100), out, checkpoint)
    # p went home in time; r came back too late, so A is a correction of its own
    assert dict(map(tuple, K.current(spark, out, "path").collect())) == {"p": None, "q": None, "r": "A", "z": "B"}


def test_a_table_of_several_files_is_streamed_whole(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(3, "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    hashes = {r[0] for r in docs.select(F.md5("text")).collect()}
    assert {r["hash"] for r in Q.stream_dedup(spark, str(tmp_path)).collect()} == hashes
    one = {tuple(r) for r in Q.ingest_stream(spark, "/root/testdata/sf0.001").collect()}
    assert {tuple(r) for r in Q.ingest_stream(spark, str(tmp_path)).collect()} == one and one
