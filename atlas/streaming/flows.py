"""File-driven streams: ingest, running dedup, running counts, progress, cache versions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from atlas.operators import intake
from atlas.session import fresh_path
from atlas.sources.tables import append_manifest
from atlas.streaming.seen import open_seen


def table_stream(spark: SparkSession, folder: str, schema: StructType | str, pattern: str | None = None,
                 files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(folder)


def drain(stream: DataFrame, handle: Callable[[DataFrame, int], None], mode: str = "append",
          checkpoint: str | None = None) -> None:
    """Process everything available, batch by batch, and stop. The checkpoint lies in the shared folder."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(handle)
        .option("checkpointLocation", checkpoint or fresh_path(spark, "stream"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def final_state(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The table a stream ends in: the last full result of an aggregation, or all appended rows.

    Batches are written as Parquet under their number, so a batch that runs twice leaves one copy.
    """
    spark, out = stream.sparkSession, fresh_path(stream.sparkSession, "state")
    last = {"batch": None}

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        last["batch"] = number

    drain(stream, keep, mode)
    if last["batch"] is None:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{out}/batch={last['batch']}")
    return spark.read.parquet(out).drop("batch")


def ingest_stream(items: DataFrame, out: str, checkpoint: str | None = None, max_seconds: float = 3.0) -> None:
    """Gate arriving items (path, label, duration, hash, ...), dedup them against everything kept so far
    and append the survivors to the manifest below ``out``. Each item is processed once.

    A batch is written under its run and number; the run is named after the checkpoint, since batch numbers
    start anew with a new one. A batch reads the hashes kept by other runs and by earlier batches, from those
    buckets that may hold one of its own, so a repeated batch after a failure comes out the same.
    """
    spark = items.sparkSession
    checkpoint = checkpoint or fresh_path(spark, "stream")
    run = hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()
    seen = open_seen(spark, out, run)

    def handle(batch: DataFrame, number: int) -> None:
        seen.fold(number)
        judged = intake.gate(batch, seen=seen.earlier(batch, number), max_seconds=max_seconds)
        place = f"{out}/verdicts/run={run}/batch={number}"
        judged.write.mode("overwrite").parquet(place)
        seen.add(spark.read.parquet(place).where(F.col("reason") == "kept"), number)

    drain(items, handle, checkpoint=checkpoint)


def kept_items(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/verdicts").where(F.col("reason") == "kept").drop("run", "batch", "reason")


def export_manifest(spark: SparkSession, out: str, target: str) -> None:
    append_manifest(kept_items(spark, out), target)


def stream_dedup(items: DataFrame, key: str = "hash", delay: str | None = None, event_time: str = "ts") -> DataFrame:
    """First arrival per key. The state is unbounded, as the seen set is; ``delay`` bounds it to
    duplicates that arrive within that time."""
    if delay is None:
        return items.dropDuplicates([key])
    return items.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def stream_counts(items: DataFrame, section: str = "section") -> DataFrame:
    """Running section sizes (complete mode)."""
    return items.groupBy(section).agg(F.count(F.lit(1)).alias("n"))


def progress(df: DataFrame, total: str = "total", done: str = "done", elapsed: str = "elapsed") -> DataFrame:
    """Add ``eta``: whole seconds left at the current pace, only while some but not all is done."""
    running = (F.col(done) > 0) & (F.col(total) > F.col(done))
    left = F.ceil(F.try_divide(F.col(elapsed), F.col(done)) * (F.col(total) - F.col(done)))
    return df.withColumn("eta", F.when(running, left.cast("long")))


def valid_entries(cache: DataFrame, version: int, key: str = "fingerprint") -> DataFrame:
    """Entries stamped with the current pipeline version."""
    return cache.where(F.substring_index(key, "|", 1) == f"v{version}")


def invalidate(cache: DataFrame, version: int, key: str = "fingerprint") -> DataFrame:
    """One row: entries kept and entries removed when the version changes."""
    valid = F.substring_index(key, "|", 1) == f"v{version}"
    return cache.agg(F.count_if(valid).alias("kept"), F.count_if(~valid).alias("removed"))


def clear(spark: SparkSession, path: str) -> int:
    """Empty a cache table; returns how many entries it had."""
    cache = spark.read.parquet(path)
    n = cache.count()
    spark.createDataFrame([], cache.schema).write.mode("overwrite").parquet(path)
    return n
