"""From manifest and files to embeddings, and from embeddings to a training set."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from atlas.functions import labels as L
from atlas.functions import paths as P
from atlas.operators import intake, signals
from atlas.operators.head import Embedder, embed, score
from atlas.operators.triage import consensus, label_neighbours, triage
from atlas.session import spread
from atlas.sources import cache
from atlas.sources.media import load_signals
from atlas.streaming.decisions import replay_decisions


def relabel(manifest: DataFrame, rules: L.Rules = L.KEYWORD_RULES) -> DataFrame:
    """Manifest rows under their final label: the file name corrects the folder, and grab-bag rows
    survive only when their file name tells what they are."""
    named = manifest.withColumn("_fn", L.keyword_label(P.clean_name(F.col("orig_name")), rules))
    return named.where(L.recoverable(F.col("label"), F.col("_fn"))).withColumn(
        "label", L.overlay_label(F.col("label"), F.col("_fn"))).drop("_fn")


def build_corpus(manifest: DataFrame, files: DataFrame, loader: Callable[[], Embedder],
                 rules: L.Rules = L.KEYWORD_RULES) -> DataFrame:
    """``path, hash, label, embedding`` of all manifest rows with a readable file (``path, content``).

    Labels are settled and rows without a file dropped before any byte is decoded. The rows are spread after the join:
    its own exchange may be merged into few tasks by its bytes, which tell little of the work on them.
    """
    wanted = intake.attach_files(relabel(manifest, rules), files.select("path"))
    content = spread(wanted.join(files.select("path", "content"), "path"), "path", "hash")
    waves = load_signals(content, keep=["path", "hash", "label"], change=signals.trim_array)
    return embed(waves, loader, source="samples").drop("samples", "sr")


def _trimmed_one_shot(wave: np.ndarray) -> np.ndarray | None:
    return signals.trim_array(wave) if 0 < len(wave) <= intake.MAX_SECONDS * signals.SAMPLE_RATE else None


def analyze(files: DataFrame, loader: Callable[[], Embedder], head: dict, keep: Sequence[str] = ("path",)) -> DataFrame:
    """One-shots of ``path, content`` rows: embedding, section, confidence, tags, envelope, duration.

    Files whose header says that they are too long are not decoded; the exact gate follows decoding.
    """
    drawn = load_signals(
        files, keep=keep, longest=intake.MAX_SECONDS + 0.01, change=_trimmed_one_shot,
        also={"envelope": signals.envelope_array}).withColumn(
        "duration", F.size("samples") / F.lit(float(signals.SAMPLE_RATE)))
    return score(embed(drawn, loader, source="samples"), head).withColumn(
        "filename", P.basename(F.col("path"))).drop("samples", "sr")


ANALYSED = ("embedding array<float>, section string, confidence double, tags array<struct<label:string,p:double>>, "
            "envelope array<float>, duration double")


def analyze_cached(files: DataFrame, loader: Callable[[], Embedder], head: dict, root: str, version: int,
                   corrections: DataFrame | None = None) -> DataFrame:
    """:func:`analyze` of ``path, fingerprint, content`` rows through the cache below ``root``, with the sections
    that ``corrections`` (path, section) name.

    Only files whose fingerprint the cache lacks are decoded, copies under one fingerprint once. Names and
    fingerprints travel; the bytes of a file are joined to the missing ones alone, in as many tasks as decoding wants,
    however few the bytes. Corrections are not cached:
    they belong to a path, entries to a content. Files that cannot be analysed have no row.
    """
    def fresh(missing: DataFrame) -> DataFrame:
        wanted = spread(files.select("path", "content"), "path").join(missing.select("path", cache.KEY), "path")
        return analyze(wanted, loader, head, keep=[cache.KEY, "path"]).select(
            cache.KEY, *[F.col(c).cast(t) for c, t in cached])

    cached = [(f.name, f.dataType) for f in StructType.fromDDL(ANALYSED)]
    rows = cache.through_cache(files.select("path", cache.KEY), root, version, ANALYSED, fresh)
    named = rows.withColumn("filename", P.basename(F.col("path")))
    return named if corrections is None else intake.apply_corrections(named, corrections)


def label_triage(items: DataFrame, k: int = 15, own_limit: float = 0.45, strength: float = 0.60,
                 block_rows: int | None = None) -> DataFrame:
    """Cross-group neighbours, their consensus and the decision per item (id, label, group_id, embedding)."""
    near = label_neighbours(items, k, block_rows=block_rows)
    return triage(consensus(items.drop("embedding"), near, k), own_limit, strength)


def training_set(items: DataFrame, fixes: DataFrame, decisions: DataFrame,
                 augmented: DataFrame | None = None, key: str = "hash") -> DataFrame:
    """Items after automatic fixes and human decisions, without the dropped ones, plus augmented rows.

    A later decision overrides a fix; ``keep`` and ``skip`` change nothing.
    """
    fixed = fixes.select(key, F.col("new").alias("_fix"))
    replayed = replay_decisions(decisions, key).withColumnRenamed("label", "_human")
    rows = items.join(fixed, key, "left").join(replayed, key, "left")
    real = rows.where(~F.coalesce("dropped", F.lit(False))).withColumn(
        "label", F.coalesce("_human", "_fix", "label")).drop("_fix", "_human", "dropped")
    real = real.withColumn("is_aug", F.lit(False))
    return real if augmented is None else real.unionByName(augmented)
