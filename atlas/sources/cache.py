"""Values by fingerprint, kept from run to run below a folder for each version of the pipeline.

Entries lie in buckets of their fingerprint, so a run reads only the buckets of the keys it asks for. A run enters
what was missing, which makes a repeated or broken run harmless: what it had entered is found the next time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atlas.operators.intake import incremental
from atlas.session import cut_lineage, spread

BUCKETS = 64
KEY = "fingerprint"


def _bucket() -> Column:
    return F.pmod(F.xxhash64(KEY), F.lit(BUCKETS)).cast("int").alias("bucket")


def _place(root: str, version: int) -> str:
    return f"{root}/version={version}"


def _schema(values: str) -> str:
    return f"{KEY} string, {values}, bucket int"


def entries(spark: SparkSession, root: str, version: int, values: str, asked: DataFrame | None = None) -> DataFrame:
    """``fingerprint`` and the columns ``values`` (a DDL list) of one version; only the buckets of ``asked`` are
    read, if it is given. A version without entries is empty."""
    place, schema = _place(root, version), _schema(values)
    spark.createDataFrame([], schema).write.mode("append").partitionBy("bucket").parquet(place)
    rows = spark.read.schema(schema).parquet(place)
    if asked is not None:
        wanted = [r["bucket"] for r in asked.select(_bucket()).distinct().collect()]  # at most BUCKETS numbers
        rows = rows.where(F.col("bucket").isin(wanted))
    return rows.drop("bucket")


def insert(fresh: DataFrame, root: str, version: int) -> None:
    rows = spread(fresh.withColumn("bucket", _bucket()), "bucket")
    rows.write.mode("append").partitionBy("bucket").parquet(_place(root, version))


def through_cache(df: DataFrame, root: str, version: int, values: str,
                  compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with the cached or fresh columns ``values``; fresh ones enter the cache.

    ``compute`` sees each missing fingerprint once and returns it with the columns ``values``. Keys that it drops
    (unreadable files) have no row and no entry, so they are tried again. Rows without a fingerprint drop out.
    """
    known = entries(df.sparkSession, root, version, values, df)
    full, fresh = incremental(df.where(F.col(KEY).isNotNull()), known, compute, KEY)
    insert(fresh, root, version)
    return full


def tidy(spark: SparkSession, root: str, version: int, values: str) -> None:
    """One file for each bucket and one entry for each key; every bucket is replaced as a whole."""
    kept = cut_lineage(entries(spark, root, version, values).dropDuplicates([KEY]))
    (spread(kept.withColumn("bucket", _bucket()), "bucket").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(_place(root, version)))
