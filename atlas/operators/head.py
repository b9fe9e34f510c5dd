"""Model jobs: batch embedding, head scoring, and the class-balanced linear head."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlas.functions.labels import MAP_UNSORTED
from atlas.operators.arrow import batch_udf
from atlas.operators.tally import class_weights

TOP_TAGS = 3
Embedder = Callable[[pd.Series], np.ndarray]


def hashed_words(df: DataFrame, id_col: str = "id", source: str = "text", dim: int = 64,
                 out: str = "embedding") -> DataFrame:
    """``id, embedding``: unit-length signed counts of the words of each text, in ``dim`` hash buckets.

    Words are counted by (row, bucket) with partial sums on the map side; a text without words has zeros.
    Ids must be unique.
    """
    code = F.conv(F.substring(F.md5(F.col("word")), 1, 8), 16, 10).cast("long")
    words = df.select(F.col(id_col).alias("_id"), F.explode(
        F.regexp_extract_all(F.col(source), F.lit(r"\w+"), F.lit(0))).alias("word")).select("_id", code.alias("code"))
    sign = F.when(F.floor(F.col("code") / 65536) % 2 == 1, 1.0).otherwise(-1.0)
    sums = words.groupBy("_id", (F.col("code") % dim).alias("at")).agg(F.sum(sign).alias("v"))
    length = F.sqrt(F.sum(F.col("v") * F.col("v")))
    held = sums.groupBy("_id").agg(
        F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"), length.alias("length"))
    value = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long")), lambda i: F.coalesce(
        F.try_divide(F.try_element_at(F.col("m"), i), F.col("length")), F.lit(0.0)))
    return df.join(held, F.col(id_col) == F.col("_id"), "left").select(F.col(id_col), value.alias(out))


def embed(df: DataFrame, loader: Callable[[], Embedder], source: str = "text",
          out: str = "embedding") -> DataFrame:
    """Add unit-length embeddings. ``loader`` runs once per Python worker task; the model it returns maps
    a column to a matrix. A row whose embedding is not finite counts as failed and drops out."""
    load = loader

    @batch_udf("array<float>")
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for column in columns:
            matrix = np.asarray(model(column), dtype=np.float64)
            ok = np.isfinite(matrix).all(axis=1)
            length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
            unit = (matrix / np.where(length > 0, length, 1.0)).astype(np.float32)
            yield pd.Series([row if good else None for row, good in zip(unit, ok)])

    return df.withColumn(out, run(source)).where(F.col(out).isNotNull())


def _dense(head: dict) -> dict[str, np.ndarray]:
    names = ("scaler_mean", "scaler_scale", "proj_w1", "proj_b1", "proj_w2", "proj_b2", "coef", "intercept")
    return {n: np.asarray(head[n], dtype=np.float64) for n in names}


def probabilities(x: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Scale, two layers, unit length, linear classes, softmax: one row of class probabilities per vector."""
    hidden = np.maximum(((x - w["scaler_mean"]) / w["scaler_scale"]) @ w["proj_w1"].T + w["proj_b1"], 0)
    z = hidden @ w["proj_w2"].T + w["proj_b2"]
    z = z / np.maximum(np.sqrt((z * z).sum(axis=1, keepdims=True)), 1e-9)
    logits = z @ w["coef"].T + w["intercept"]
    exps = np.exp(logits - logits.max(axis=1, keepdims=True))
    return exps / np.maximum(exps.sum(axis=1, keepdims=True), 1e-9)


def score(df: DataFrame, head: dict, vec: str = "embedding") -> DataFrame:
    """Add ``section``, ``confidence`` and ``tags`` (the three best labels). The head is broadcast once
    and every batch is a few matrix products. Below the head's confidence limit the section is Unsorted."""
    labels = np.array([str(x) for x in head["labels"]], dtype=object)
    limit = float(head.get("min_confidence", 0.49))
    held = df.sparkSession.sparkContext.broadcast((labels, _dense(head)))

    @batch_udf("struct<section:string,confidence:double,tags:array<struct<label:string,p:double>>>")
    def classify(column: pd.Series) -> pd.DataFrame:
        names, weights = held.value
        p = probabilities(np.stack(column.to_numpy()).astype(np.float64), weights)
        order = np.argsort(-p, axis=1, kind="stable")[:, :TOP_TAGS]
        top = np.take_along_axis(p, order, axis=1)
        rounded = np.floor(top * 1000 + 0.5) / 1000
        return pd.DataFrame({
            "section": np.where(top[:, 0] >= limit, names[order[:, 0]], MAP_UNSORTED),
            "confidence": top[:, 0],
            "tags": [[{"label": names[i], "p": float(v)} for i, v in zip(o, r)] for o, r in zip(order, rounded)],
        })

    return df.withColumn("_s", classify(vec)).select("*", "_s.section", "_s.confidence", "_s.tags").drop("_s")


def fit_head(df: DataFrame, c: float = 1.0, label: str = "label", vec: str = "embedding",
             max_iter: int = 100) -> tuple[LogisticRegressionModel, list[str]]:
    """Class-balanced multinomial logistic regression, and its labels by class index.

    Balanced weights add up to the number of rows, so the penalty ``1 / C`` per unit of total loss is
    ``1 / (C * rows)`` here.
    """
    weights = class_weights(df, label).select(label, "weight", "n").orderBy(label).collect()
    names = [str(r[label]) for r in weights]
    total = sum(r["n"] for r in weights)
    index = F.create_map(*[F.lit(v) for i, r in enumerate(weights) for v in (str(r[label]), float(i))])
    weight = F.create_map(*[F.lit(v) for r in weights for v in (str(r[label]), float(r["weight"]))])
    key = F.col(label).cast("string")
    rows = df.select(array_to_vector(F.col(vec)).alias("features"), index[key].alias("target"),
                     weight[key].alias("weight"))
    model = LogisticRegression(
        featuresCol="features", labelCol="target", weightCol="weight", family="multinomial",
        standardization=False, regParam=1.0 / (c * total), maxIter=max_iter).fit(rows)
    return model, names
