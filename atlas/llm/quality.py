"""Quality score by a regularised quadratic discriminant (operator 3).

Every whole text gives a vector of transformed statistics (logarithms of sizes and of shares). Each
class of labelled documents has a mean and a covariance, shrunk towards its own diagonal and, a little,
towards the pooled covariance. Cholesky factors of the covariances are computed once and travel with the
scoring tasks; the score is the logistic of the difference of the two log densities and log priors.

Class moments are sums, so they are added up over *all* labelled rows inside Spark; the driver sees one row
per class, whatever the size of the input.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlas.llm.names import shielded
from atlas.operators.arrow import batch_udf
from atlas.session import cut_lineage

DIAGONAL = 0.01  # shrinkage towards the class's own variances
POOLED = 0.01  # and towards the pooled covariance
FLOOR = 1e-3  # least variance of a standardised statistic

STATISTICS = ("words", "word_length", "word_length_spread", "distinct", "repeats", "upper", "digits", "symbols",
              "stops", "top_word", "line_length", "repeated_lines", "high_bytes", "byte_entropy", "decorated")

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOPS = np.zeros(256, bool)
_STOPS[list(b".,;:?!'\"()-")] = True
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[33:127] = True
_SYMBOLS &= ~_LETTERS & ~_STOPS
_SYMBOLS[48:58] = False


def _share(part: float, whole: float) -> float:
    """Logarithm of a share; none is the same for short and for long texts."""
    return log(part / max(whole, 1) + 0.02)


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text, all finite (null: as empty)."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    printed = int(counts[33:].sum())
    letters = int(counts[_LETTERS].sum())
    lengths = np.fromiter(map(len, words), np.int64, n)
    distinct = Counter(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    share = counts[counts > 0] / max(1, len(raw))
    decorated = sum(c for w, c in distinct.items() if len(w) > 1 and w[-1] in b"!#$%&*|@^~=+<>" or w == b"|")
    return [
        log(1 + n), log(1 + (lengths.mean() if n else 0)), log(1 + (lengths.std() if n else 0)),
        log(1 + len(distinct)) / log(2 + n), _share(sum(map(bytes.__eq__, words, words[1:])), n - 1 if n else 0),
        _share(int(counts[65:91].sum()), letters), _share(int(counts[48:58].sum()), printed),
        _share(int(counts[_SYMBOLS].sum()), printed), _share(int(counts[_STOPS].sum()), printed),
        _share(max(distinct.values(), default=0), n), log(1 + len(raw) / max(1, len(lines))),
        _share(len(lines) - len(set(lines)), len(lines)), _share(int(counts[128:].sum()), printed),
        float(-(share * np.log2(share)).sum()), _share(decorated, n)]


@dataclass
class Discriminant:
    """Centre and scale of the statistics; for each class a mean, an inverse Cholesky factor and a constant."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        x = (rows - self.centre) / self.scale
        dens = []
        for mean, factor, constant in zip(self.means, self.factors, self.constants):
            z = (x - mean) @ factor.T
            dens.append(constant - 0.5 * (z * z).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(dens[0] - dens[1], -500, 500)))


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], diagonal: float = DIAGONAL,
        pooled: float = POOLED, floor: float = FLOOR) -> Discriminant:
    """From ``class: (count, sums, sums of products)`` of classes 0 and 1.

    A class without rows takes the moments of the other one, so the score is then its prior alone (the
    smoothed share of the classes); without any rows the score is 1/2.
    """
    dims = len(STATISTICS)
    counts = np.array([moments.get(c, (0.0,))[0] for c in (0, 1)])
    total = sum((m[0] for m in moments.values()), 0.0)
    if not total:
        return Discriminant(np.zeros(dims), np.ones(dims), np.zeros((2, dims)), np.stack([np.eye(dims)] * 2), np.zeros(2))
    centre = sum(m[1] for m in moments.values()) / total
    spread = sum(np.diag(m[2]) for m in moments.values()) / total - centre ** 2
    scale = np.sqrt(np.maximum(spread, 1e-12))
    scale[spread < 1e-9] = 1.0
    means, covariances = [], []
    for c in (0, 1):
        n, first, second = moments[c] if counts[c] else moments[1 - c]
        mean = first / n
        means.append((mean - centre) / scale)
        covariances.append((second / n - np.outer(mean, mean)) / np.outer(scale, scale))
    share = (counts + 1) / (total + 2)
    within = share[0] * covariances[0] + share[1] * covariances[1]
    factors, constants = [], []
    for c in (0, 1):
        own = covariances[c]
        shrunk = ((1 - diagonal - pooled) * own + diagonal * np.diag(np.diag(own)) + pooled * within
                  + floor * np.eye(dims))
        lower = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(lower))
        constants.append(log(share[c]) - np.log(np.diag(lower)).sum())
    return Discriminant(centre, scale, np.array(means), np.array(factors), np.array(constants))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, stats`` of every row."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([statistics(t.as_py()) for t in batch.column(1)], pa.list_(pa.float64()))],
                ["doc_id", "stats"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, stats array<double>")


def held_out_of(id_column: Column, parts: int, held: int) -> Column:
    """crc32 of the id as text, modulo ``parts``, is ``held`` (false for a null id)."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % parts == held, F.lit(False))


def class_moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Moments per class of ``label, stats``; each task adds up its rows, so two rows per task are shuffled."""
    dims = len(STATISTICS)

    def partial(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            for c in (0, 1):
                own = rows[label == c]
                if len(own):
                    was = sums.setdefault(c, [0.0, np.zeros(dims), np.zeros((dims, dims))])
                    sums[c] = [was[0] + len(own), was[1] + own.sum(axis=0), was[2] + own.T @ own]
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()),
                 pa.array([np.concatenate([[n], a, b.ravel()]) for n, a, b in sums.values()], pa.list_(pa.float64()))],
                ["label", "sums"])

    parts = labelled.select("label", "stats").mapInArrow(partial, "label int, sums array<double>")
    size = 1 + dims + dims * dims
    added = parts.groupBy("label").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size)])
    found = {}
    for row in added.collect():  # one row per class
        values = np.array(row[1:], float)
        found[row[0]] = (values[0], values[1:1 + dims], values[1 + dims:].reshape(dims, dims))
    return found


def train_quality(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, id_col: str = "doc_id",
                  text_col: str = "text", label_col: str = "quality") -> tuple[Discriminant, DataFrame]:
    """The discriminant and the statistics of all documents.

    Learns from labelled rows whose crc32 of the id modulo ``parts`` is not ``held``. Labels that are null or
    neither 0 nor 1 are not learnt from; repeated labels and rows count as often as they appear.
    """
    stats = cut_lineage(document_statistics(docs, id_col, text_col))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & ~held_out_of(F.col("doc_id"), parts, held))
    return fit(class_moments(stats.join(known, "doc_id"))), stats


def score_quality(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, threshold: float = 0.3,
                  id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row for each row of ``docs``.

    Null and empty texts have the statistics of an empty text and get a score like any other. Documents
    without an id are scored and count as not held out. An empty table gives no rows; without labels every
    score is 1/2.
    """
    model, stats = train_quality(docs, labels, parts, held, id_col, text_col, label_col)

    def run(batches):
        dims = len(STATISTICS)
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.score(rows), pa.float64())], ["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out_of(F.col("doc_id"), parts, held).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text_col: str = "text",
              **options) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, columns unchanged, whatever their names.

    Texts are scored where they are scanned: only statistics, never texts, are shuffled. Null and empty texts are
    scored like others, repeated rows each; an empty table gives no rows.
    """
    model, _ = train_quality(docs, labels, text_col=text_col, **options)

    @batch_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in texts]).reshape(len(texts), -1)))

    def run(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_score", score(F.col(text_col))).where(F.col("_score") >= threshold).drop("_score")

    return shielded(docs, (text_col,), run)
