"""Class centroids, nearest-centroid labels, augmentation gate, scaling and parity of vector sets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlas.functions import vectors as V
from atlas.operators.arrow import batch_udf
from atlas.operators.neighbours import DIGITS, top_k
from atlas.operators.skew import salted_join
from atlas.session import cut_lineage

EPS = 1e-9
AUG_GATE = 0.70
# Classes with too few recordings, and the variants made of each of their sources.
THIN_CLASSES = ["Rolls", "Bass", "Woodblock", "Ride", "Snap", "Conga", "Tambourine", "Cowbell", "Shaker"]
VARIANTS = 4


def unit_rows(df: DataFrame, vec: str = "embedding", eps: float | None = EPS) -> DataFrame:
    """Replace ``vec`` by its unit vector (``eps=None``: zero vectors stay as they are)."""

    @batch_udf("array<double>")
    def unit(column: pd.Series) -> pd.Series:
        matrix = np.stack(column.to_numpy()).astype(np.float64)
        length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
        scale = np.where(length > 0, length, 1.0) if eps is None else length + eps
        return pd.Series(list(matrix / scale))

    return df.withColumn(vec, unit(vec))


def centroids(df: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """``label, n, centroid``: mean of the unit vectors, scaled to length one again.

    The mean is a vector aggregate inside the JVM with map-side partial sums.
    """
    mean = unit_rows(df, vec).groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), Summarizer.mean(array_to_vector(F.col(vec))).alias("_m"))
    return mean.select(label, "n", V.l2_normalize(vector_to_array("_m"), EPS).alias("centroid"))


def nearest_centroid(df: DataFrame, cents: DataFrame, label: str = "label", vec: str = "embedding",
                     keys: Sequence[str] = ("id",), out: str = "nearest", block_rows: int | None = None) -> DataFrame:
    """Add the label of the closest centroid (smallest label on a tie), by the blocked neighbour join.

    ``keys`` name a row of ``df`` uniquely; the joined result depends on that, and repeated keys raise.
    """
    one = F.when(F.count(F.lit(1)) == 1, F.first("_vec")).otherwise(
        F.raise_error(F.concat(F.lit("repeated key "), F.first("_id"))))
    rows = df.select(F.to_json(F.struct(*keys)).alias("_id"), F.col(vec).alias("_vec")).groupBy("_id").agg(
        one.alias("_vec"))
    coded = cut_lineage(cents.select(F.col(label).cast("string").alias("_id"), F.col("centroid").alias("_vec")))
    hit = top_k(rows, coded, k=1, id_col="_id", vec="_vec", skip_self=False, block_rows=block_rows)
    return df.withColumn("_key", F.to_json(F.struct(*keys))).join(hit.select("src", F.col("dst").alias(out)), F.col("_key") == F.col("src"), "left").drop("_key", "src")


def inherit_group(aug: DataFrame, source: DataFrame, source_id: str = "source_id",
                  id_col: str = "id") -> DataFrame:
    """Augmented rows take label and leakage group of their source and are marked train-only."""
    parent = source.select(F.col(id_col).alias(source_id), "label", "group_id",
                           F.col("embedding").alias("source_embedding"))
    return aug.join(parent, source_id).withColumn("is_aug", F.lit(True))


def augment_gate(aug: DataFrame, source: DataFrame, cents: DataFrame, limit: float = AUG_GATE,
                 keys: Sequence[str] = ("source_id", "k"), block_rows: int | None = None) -> DataFrame:
    """Add ``cos_source``, ``nearest`` and ``passed`` to augmented rows (after :func:`inherit_group`).

    A source has several variants, so ``keys`` name the source and the variant.
    """
    rows = inherit_group(aug, source)
    judged = nearest_centroid(rows, cents, keys=keys, block_rows=block_rows)
    cos = F.round(V.cosine(F.col("embedding"), F.col("source_embedding")), DIGITS)
    return judged.withColumn("cos_source", cos).withColumn(
        "passed", (F.col("cos_source") >= limit) & (F.col("nearest") == F.col("label").cast("string")))


def gate_report(gated: DataFrame, label: str = "label") -> DataFrame:
    return gated.groupBy(label).agg(
        F.count(F.lit(1)).alias("tried"), F.count_if("passed").alias("kept"),
        F.avg(F.col("passed").cast("double")).alias("pass_rate"))


def thin_sources(df: DataFrame, thin: list[str] | None = None, label: str = "label") -> DataFrame:
    return df.where(F.col(label).isin(THIN_CLASSES if thin is None else thin))


def scaler_fit(df: DataFrame, vec: str = "embedding", by: list[str] | None = None,
               floor: float = 1e-6) -> DataFrame:
    """``mean`` and population ``scale`` per dimension; a spread below ``floor`` counts as 1."""
    stats = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col(vec)))
    one = df.groupBy(*(by or [])).agg(stats.alias("_s"))
    count = F.col("_s.count").cast("double")
    spread = F.transform(
        vector_to_array(F.col("_s.variance")), lambda v: F.sqrt(v * (count - 1) / count))
    scale = F.transform(spread, lambda s: F.when(s < floor, F.lit(1.0)).otherwise(s))
    return one.select(*(by or []), vector_to_array(F.col("_s.mean")).alias("mean"), scale.alias("scale"))


def scaler_apply(df: DataFrame, scaler: DataFrame, vec: str = "embedding",
                 by: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """``(x - mean) / scale``. Without ``by`` the scaler is a single row, fetched and broadcast."""
    if by:
        joined = salted_join(df, scaler, by, spread=[c for c in df.columns if c != vec], rows=rows)
        scaled = F.transform(
            F.arrays_zip(F.col(vec).alias("x"), F.col("mean").alias("m"), F.col("scale").alias("s")),
            lambda e: (e["x"].cast("double") - e["m"]) / e["s"])
        return joined.withColumn(vec, scaled).drop("mean", "scale")
    row = scaler.first()
    held = df.sparkSession.sparkContext.broadcast((np.array(row["mean"]), np.array(row["scale"])))

    @batch_udf("array<double>")
    def apply(column: pd.Series) -> pd.Series:
        mean, scale = held.value
        return pd.Series(list((np.stack(column.to_numpy()).astype(np.float64) - mean) / scale))

    return df.withColumn(vec, apply(vec))


def parity(a: DataFrame, b: DataFrame, tolerance: float = 1e-2, min_cosine: float = 0.9999,
           id_col: str = "id", vec: str = "embedding") -> DataFrame:
    """Compare two versions of a vector set: largest and mean difference, where, cosine, verdict."""
    both = a.select(id_col, F.col(vec).alias("_a")).join(b.select(id_col, F.col(vec).alias("_b")), id_col)
    gaps = F.zip_with(V.as_double(F.col("_a")), V.as_double(F.col("_b")), lambda x, y: F.abs(x - y))
    rows = both.withColumn("_g", gaps).withColumn("max_diff", F.array_max("_g"))
    return rows.select(
        id_col, "max_diff",
        (F.array_position("_g", F.col("max_diff")) - 1).alias("max_at"),
        (F.aggregate("_g", F.lit(0.0), lambda acc, g: acc + g) / F.size("_g")).alias("mean_diff"),
        V.cosine(F.col("_a"), F.col("_b")).alias("cosine"),
    ).withColumn("passed", (F.col("cosine") > min_cosine) & (F.col("max_diff") < tolerance))
