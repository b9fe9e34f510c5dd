"""Manifests, ledgers, embedding sets, triage artefacts, decisions, corrections and model heads."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlas.functions import paths as P

MANIFEST_SCHEMA = (
    "hash string, label string, duration double, orig_name string, source_folder string, source_link string"
)
DECISION_SCHEMA = "hash string, current string, label string"
MIN_CONFIDENCE = 0.49


def append_manifest(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append rows (durations to 3 decimals). The CSV form writes its header into every part file."""
    names = [f.split()[0] for f in MANIFEST_SCHEMA.split(", ")]
    rows = df.withColumn("duration", F.round("duration", 3)).select(*names)
    writer = rows.write.mode("append")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def read_manifest(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(MANIFEST_SCHEMA)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)


def original_names(manifest: DataFrame, seq: str = "seq") -> DataFrame:
    """``hash12, orig_name``: the last row of each key wins."""
    return manifest.groupBy(P.hash_key(F.col("hash")).alias("hash12")).agg(
        F.max_by("orig_name", seq).alias("orig_name"))


def write_embeddings(df: DataFrame, path: str) -> None:
    df.withColumn("embedding", F.col("embedding").cast("array<float>")).write.mode("overwrite").parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def audio_map(review: DataFrame, exemplars: DataFrame) -> DataFrame:
    """``hash, path`` of everything a reviewer may play; an exemplar's path wins."""
    both = review.select("hash", "path", F.lit(1).alias("_r")).unionByName(
        exemplars.select("hash", "path", F.lit(0).alias("_r")))
    return both.groupBy("hash").agg(F.min_by("path", F.struct("_r", "path")).alias("path"))


def write_triage(fixes: DataFrame, review: DataFrame, exemplars: DataFrame, path: str) -> None:
    """The four artefacts of a triage as JSON tables below ``path``."""
    for name, frame in (("auto_corrections", fixes), ("review_queue", review), ("examples", exemplars),
                        ("audio_map", audio_map(review, exemplars))):
        frame.write.mode("overwrite").json(f"{path}/{name}")


def read_decisions(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Decision log; malformed lines are skipped, or fail the job when ``strict``."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    rows = spark.read.schema(DECISION_SCHEMA).option("mode", mode).json(path)
    return rows.where(F.col("hash").isNotNull())


def stream_decisions(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(DECISION_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def write_corrections(df: DataFrame, path: str) -> None:
    df.select("path", "section").write.mode("overwrite").parquet(path)


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, section string").parquet(path)


def write_head(spark: SparkSession, head: dict, path: str) -> None:
    """A model head as one JSON row."""
    spark.createDataFrame([(json.dumps(head),)], "value string").write.mode("overwrite").text(path)


def read_head(spark: SparkSession, path: str) -> dict:
    """A model head: weights are a fixed-size input, read on the driver and broadcast by the scorer."""
    head = json.loads("".join(r["value"] for r in spark.read.text(path).collect()))
    head.setdefault("min_confidence", MIN_CONFIDENCE)
    return head
