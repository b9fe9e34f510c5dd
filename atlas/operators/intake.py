"""Collection intake: gates, content dedup, routing, cache reuse and lookups by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlas.functions import labels as L
from atlas.functions import paths as P
from atlas.operators.skew import salted_join
from atlas.session import cut_lineage

MAX_SECONDS = 3.0  # anything longer is a loop
SKIP_REASONS = ("unlabeled", "bad", "long", "dupe")


def union_roots(*frames: DataFrame, path: str = "path") -> DataFrame:
    """Union of scans; repeated or nested roots add nothing. Sorted by path."""
    every = frames[0]
    for frame in frames[1:]:
        every = every.unionByName(frame)
    return every.dropDuplicates([path]).orderBy(path)


def first_of_content(df: DataFrame, hash_col: str = "hash", path: str = "path",
                     seen: DataFrame | None = None) -> DataFrame:
    """Paths that carry a content for the first time (the smallest path of each unseen hash).

    A minimum per hash combines on the map side, so one content repeated over a third of the rows
    costs no more than any other.
    """
    firsts = df.groupBy(hash_col).agg(F.min(path).alias(path))
    if seen is not None:
        firsts = firsts.join(seen.select(hash_col).distinct(), hash_col, "left_anti")
    return firsts.select(path)


def dedup_content(df: DataFrame, seen: DataFrame | None = None, hash_col: str = "hash",
                  path: str = "path") -> DataFrame:
    """Rows whose content is neither in ``seen`` nor under a smaller path of the batch."""
    return df.join(first_of_content(df, hash_col, path, seen), path, "left_semi")


def extend_seen(seen: DataFrame, kept: DataFrame, hash_col: str = "hash") -> DataFrame:
    return seen.select(hash_col).unionByName(kept.select(hash_col)).distinct()


def gate(df: DataFrame, label: str = "label", duration: str = "duration", hash_col: str = "hash",
         path: str = "path", seen: DataFrame | None = None, max_seconds: float = MAX_SECONDS) -> DataFrame:
    """Add ``reason``: the first of unlabeled, bad, long, dupe that applies, else kept.

    ``path`` identifies a row. Only rows that pass the earlier gates count for the content check; the
    verdict is joined back by path, which no repeated content can skew.
    """
    early = (
        F.when(F.col(label).isNull(), "unlabeled")
        .when(F.col(duration).isNull(), "bad")
        .when(F.col(duration) > max_seconds, "long")
    )
    passed = df.withColumn("_early", early).where(F.col("_early").isNull())
    kept = first_of_content(passed, hash_col, path, seen).withColumn("_kept", F.lit(True))
    reason = F.coalesce(early, F.when(F.col("_kept"), "kept").otherwise("dupe"))
    return df.join(kept, path, "left").withColumn("reason", reason).drop("_kept")


def one_shot(df: DataFrame, duration: str = "duration", max_seconds: float = MAX_SECONDS) -> DataFrame:
    return df.where((F.col(duration) > 0) & (F.col(duration) <= max_seconds))


def route(df: DataFrame, label: str = "label", hash_col: str = "hash", path: str = "path") -> DataFrame:
    """Add ``split`` (trainable or held out) and ``target``, the content-keyed file name."""
    split = F.when(F.col(label) == L.UNSORTED, "unsorted").otherwise("labeled")
    target = F.concat(P.hash_key(F.col(hash_col)), P.suffix(F.col(path)))
    return df.withColumns({"split": split, "target": target})


def write_routed(df: DataFrame, out: str) -> None:
    df.write.mode("append").partitionBy("split", "label").parquet(out)


def attach_files(manifest: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Manifest rows with the first file whose name starts with their hash key; others drop out."""
    by_key = files.withColumn("_key", F.substring(P.stem(F.col(path)), 1, 12)).groupBy("_key").agg(
        F.min(path).alias(path))
    keyed = manifest.withColumn("_key", P.hash_key(F.col("hash")))
    return salted_join(keyed, by_key, ["_key"], spread=manifest.columns).drop("_key")


def incremental(df: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame],
                key: str = "fingerprint") -> tuple[DataFrame, DataFrame]:
    """``(all rows with their cached or fresh values, fresh cache entries)``.

    ``compute`` sees every missing key once and returns ``key`` plus the cached columns; keys it drops
    (failures) are neither in the result nor in the new entries. It runs when this is called and its
    result is checkpointed, so that using both frames costs one run. The row keeps its own columns, so a
    hit under a new path reports the new path.
    """
    missing = df.join(cache.select(key), key, "left_anti").dropDuplicates([key])
    fresh = cut_lineage(compute(missing).select(*cache.columns))
    known = cache.unionByName(fresh)
    return salted_join(df, known, [key], spread=df.columns), fresh


def apply_corrections(df: DataFrame, corrections: DataFrame, path: str = "path",
                      section: str = "section") -> DataFrame:
    """Override sections by path before layout."""
    moved = corrections.select(path, F.col(section).alias("_section"))
    return df.join(moved, path, "left").withColumn(
        section, F.coalesce("_section", section)).drop("_section")


def attach_embeddings(df: DataFrame, embeddings: DataFrame, path: str = "path",
                      embedding: str = "embedding") -> DataFrame:
    """Embedding by path; rows without one keep their place."""
    return df.join(embeddings.select(path, embedding), path, "left")


def pending(queue: DataFrame, decisions: DataFrame, key: str = "hash") -> DataFrame:
    return queue.join(decisions.select(key).distinct(), key, "left_anti")


def review_progress(queue: DataFrame, decisions: DataFrame, key: str = "hash") -> DataFrame:
    """One row: queue size, distinct decided hashes, queue minus decided."""
    decided = decisions.agg(F.count_distinct(key).alias("n")).scalar()
    total = F.count(F.lit(1))
    return queue.agg(total.alias("queued")).withColumn("done", decided).withColumn(
        "remaining", F.col("queued") - F.col("done"))


def folder_labels(df: DataFrame, folder: str = "folder", label: str = "label", seq: str = "seq") -> DataFrame:
    """Label of the first kept row of each folder."""
    return df.groupBy(folder).agg(F.min_by(label, seq).alias(label))


def run_summary(df: DataFrame, link: str = "link", label: str = "label", reason: str = "reason") -> DataFrame:
    """Per link: labelled, held out, and skipped rows by reason."""
    kept, held = F.col(reason) == "kept", F.col(label) == L.UNSORTED
    return df.groupBy(link).agg(
        F.count_if(kept & ~held).alias("added"), F.count_if(kept & held).alias("added_unsorted"),
        *[F.count_if(F.col(reason) == r).alias(f"skipped_{r}") for r in SKIP_REASONS],
    )


def kept_per_label(df: DataFrame, link: str = "link", label: str = "label", reason: str = "reason") -> DataFrame:
    return df.where(F.col(reason) == "kept").groupBy(link, label).agg(F.count(F.lit(1)).alias("n"))


def flag_processed(links: DataFrame, ledger: DataFrame, link: str = "link") -> DataFrame:
    """Flag links of the ledger; they are processed again all the same."""
    done = ledger.select(link).distinct().withColumn("_done", F.lit(True))
    return salted_join(links, done, [link], "left", spread=links.columns).withColumn(
        "already_processed", F.coalesce("_done", F.lit(False))).drop("_done")


def ledger_entries(runs: DataFrame, link: str = "link", ok: str = "succeeded") -> DataFrame:
    """Links to append after a run: only successful ones, never local paths."""
    return runs.where(F.col(ok) & (P.ref_kind(F.col(link)) != "local")).select(link)
