"""Queries on logs, run as streams where the reference works incrementally."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atlas.functions import paths as P
from atlas.plans.registry import query, table
from atlas.plans.vector_queries import decisions
from atlas.session import fresh_path
from atlas.sources import tables as S
from atlas.streaming import decisions as D
from atlas.streaming import flows as W
from atlas.streaming import state as K


def stream_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of them: the pattern matches the name itself, and Spark lists
    what it finds there (a plain path has to be a folder)."""
    return W.table_stream(spark, f"{folder}/{name}.parque[t]", table(spark, folder, name).schema)


def moves(events: DataFrame) -> DataFrame:
    """events as map moves: the item is the user; the target is derived from value and type."""
    pick = F.floor(F.col("value")).cast("long")
    return events.select(
        F.col("user_id").alias("path"), F.col("event_id").alias("seq"), F.col("event_type").alias("from_section"),
        F.when(pick % 2 == 0, "click").when(pick % 3 == 0, "view").otherwise(F.col("event_type")).alias("to_section"),
        (F.col("event_id") % 4).alias("session"))


MOVES_SQL = """mv AS (SELECT user_id AS path, event_id AS seq, event_type AS from_section, event_id % 4 AS session,
  CASE WHEN floor(value)::BIGINT % 2 = 0 THEN 'click' WHEN floor(value)::BIGINT % 3 = 0 THEN 'view' ELSE event_type END AS to_section
  FROM events),
rm AS (SELECT * FROM mv WHERE from_section <> to_section)"""
REPLAY_SQL = """WITH d AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 'notdrum'
  WHEN 'assistant' THEN 'L' || (length(text) % 10) ELSE CASE WHEN length(text) % 2 = 0 THEN 'keep' ELSE 'skip' END END AS label
  FROM conversations)
SELECT conv_id AS hash, arg_max(label, turn) FILTER (label NOT IN ('notdrum', 'keep', 'skip')) AS label,
  bool_or(label = 'notdrum') AS dropped FROM d GROUP BY 1"""


@query("replay_decisions", REPLAY_SQL)
def replay_decisions(spark, folder):
    return D.replay_decisions(decisions(spark, folder))


@query("replay_decisions_stream", REPLAY_SQL)
def replay_decisions_stream(spark, folder):
    """The decision log as JSON lines, read back as a stream."""
    out = fresh_path(spark, "decisions")
    rows = decisions(spark, folder).select(F.col("hash").cast("string"), F.col("seq"), "label")
    rows.write.json(out)
    log = spark.readStream.schema("hash string, seq long, label string").json(out)
    return W.final_state(D.replay_decisions(log)).withColumn("hash", F.col("hash").cast("long"))


@query("decision_log", """SELECT count(*) AS n, count(DISTINCT conv_id) AS hashes FROM conversations""")
def decision_log(spark, folder):
    """Decision log with every second line malformed: the good lines survive."""
    out = fresh_path(spark, "decisions")
    good = decisions(spark, folder).select(
        F.to_json(F.struct(F.col("hash").cast("string").alias("hash"), F.lit("x").alias("current"), "label")).alias("value"))
    broken = good.select(F.concat(F.lit("{broken "), "value").alias("value"))
    good.unionByName(broken).write.text(out)
    return S.read_decisions(spark, out).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("hash").alias("hashes"))


FOLD_SQL = f"""WITH {MOVES_SQL} SELECT path, arg_max(to_section, seq) AS section FROM rm GROUP BY path
HAVING arg_max(to_section, seq) <> arg_min(from_section, seq)"""


@query("fold_corrections", FOLD_SQL)
def fold_corrections(spark, folder):
    return D.fold_corrections(moves(table(spark, folder, "events")))


@query("fold_corrections_stream", FOLD_SQL)
def fold_corrections_stream(spark, folder):
    trips = W.final_state(D.journeys(moves(stream_of(spark, folder, "events"))))
    return trips.where(F.col("section") != F.col("origin")).select("path", "section")


@query("fold_corrections_sessions", f"""WITH {MOVES_SQL}, t AS (SELECT path, session, arg_max(to_section, seq) AS section,
  arg_min(from_section, seq) AS origin, max(seq) AS seq FROM rm GROUP BY ALL)
SELECT path, arg_max(section, seq) AS section FROM t WHERE section <> origin GROUP BY path""")
def fold_corrections_sessions(spark, folder):
    return D.fold_corrections(moves(table(spark, folder, "events")), "session")


@query("corrections_table", FOLD_SQL)
def corrections_table(spark, folder):
    out = fresh_path(spark, "corrections")
    folded = D.fold_corrections(moves(table(spark, folder, "events")))
    S.write_corrections(folded.withColumn("path", F.col("path").cast("string")), out)
    return S.read_corrections(spark, out).withColumn("path", F.col("path").cast("long"))


@query("moves_counts", f"""WITH {MOVES_SQL}, d AS (SELECT event_type AS section, count(*) AS n FROM events GROUP BY 1
  UNION ALL SELECT from_section, -1 FROM rm UNION ALL SELECT to_section, 1 FROM rm)
SELECT section, CAST(greatest(sum(n), 0) AS BIGINT) AS n FROM d GROUP BY section""")
def moves_counts(spark, folder):
    events = table(spark, folder, "events")
    start = events.groupBy(F.col("event_type").alias("section")).agg(F.count(F.lit(1)).alias("n"))
    return D.apply_moves_counts(start, moves(events))


@query("stream_counts", "SELECT event_type AS section, count(*) AS n FROM events GROUP BY 1")
def stream_counts(spark, folder):
    return W.final_state(W.stream_counts(stream_of(spark, folder, "events"), "event_type")).withColumnRenamed(
        "event_type", "section")


@query("stream_dedup", "SELECT DISTINCT md5(text) AS hash FROM documents")
def stream_dedup(spark, folder):
    docs = stream_of(spark, folder, "documents").select(P.content_hash(F.col("text")).alias("hash"))
    return W.final_state(W.stream_dedup(docs), "append")


INGEST_SQL = """WITH m AS (SELECT doc_id, md5(text) AS hash, n_chars / 1000.0::DOUBLE AS duration FROM documents WHERE lang <> 'fr'),
ok AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id) AS rn FROM m WHERE duration <= 3)
SELECT doc_id, hash FROM ok WHERE rn = 1"""


def arrivals(docs: DataFrame) -> DataFrame:
    """documents as items of a collection: the text is the content, French ones bear no label."""
    return docs.select(
        "doc_id", F.col("doc_id").alias("path"), P.content_hash(F.col("text")).alias("hash"),
        (F.col("n_chars") / 1000.0).alias("duration"), F.when(F.col("lang") != "fr", F.col("lang")).alias("label"))


@query("ingest_stream", INGEST_SQL)
def ingest_stream(spark, folder):
    out = fresh_path(spark, "ingest")
    W.ingest_stream(arrivals(stream_of(spark, folder, "documents")), out)
    return W.kept_items(spark, out).select("doc_id", "hash")


@query("ingest_across_runs", INGEST_SQL)
def ingest_across_runs(spark, folder):
    """The documents arrive in two halves, each taken in by a run of its own, with a checkpoint of its own."""
    out, docs = fresh_path(spark, "ingest"), table(spark, folder, "documents")
    middle = docs.agg(F.expr("percentile_approx(doc_id, 0.5)")).first()[0]
    for part in (F.col("doc_id") <= middle, F.col("doc_id") > middle):
        arriving = fresh_path(spark, "arriving")
        docs.where(part).write.parquet(arriving)
        W.ingest_stream(arrivals(W.table_stream(spark, arriving, docs.schema)), out)
    return W.kept_items(spark, out).select("doc_id", "hash")


@query("progress", """SELECT event_id, CASE WHEN user_id > 0 AND 100 > user_id
  THEN CAST(ceil(value / user_id * (100 - user_id)) AS BIGINT) END AS eta FROM events""")
def progress(spark, folder):
    """Seconds left per report, with the user id as items done of 100 and the value as elapsed time."""
    rows = table(spark, folder, "events").select(
        "event_id", F.col("user_id").alias("done"), F.lit(100).alias("total"), F.col("value").alias("elapsed"))
    return W.progress(rows).select("event_id", "eta")


def in_two_runs(spark, rows: DataFrame, order: str, fold, key: str) -> DataFrame:
    """The rows arrive in two parts by ``order``; each is folded by a query of its own over one checkpoint."""
    arriving, out, checkpoint = (fresh_path(spark, name) for name in ("arriving", "folded", "stream"))
    middle = rows.agg(F.expr(f"percentile_approx({order}, 0.5)")).first()[0]
    for part in (F.col(order) <= middle, F.col(order) > middle):
        rows.where(part).write.mode("append").parquet(arriving)
        K.keep_batches(fold(W.table_stream(spark, arriving, rows.schema)), out, checkpoint)
    return K.current(spark, out, key)


@query("replay_decisions_keyed", REPLAY_SQL)
def replay_decisions_keyed(spark, folder):
    """Decisions folded into keyed state, in two runs."""
    return in_two_runs(spark, decisions(spark, folder), "seq", K.review_state, "hash")


@query("fold_corrections_keyed", f"""WITH {MOVES_SQL}, chain AS (SELECT path, seq, to_section,
  coalesce(lag(to_section) OVER (PARTITION BY path ORDER BY seq), from_section) AS from_section FROM mv)
SELECT path, arg_max(to_section, seq) AS section FROM chain WHERE from_section <> to_section GROUP BY path
HAVING arg_max(to_section, seq) <> arg_min(from_section, seq)""")
def fold_corrections_keyed(spark, folder):
    """Moves, each from where the last one led, folded into keyed state in two runs; erased corrections leave no row."""
    log = moves(table(spark, folder, "events")).drop("session")
    led = F.lag("to_section").over(Window.partitionBy("path").orderBy("seq"))
    log = log.withColumn("from_section", F.coalesce(led, "from_section"))
    return in_two_runs(spark, log, "seq", K.correction_state, "path").where("section IS NOT NULL")
