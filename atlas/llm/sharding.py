"""Sharding by rendezvous hashing of record keys over weighted shards (operator 11).

Every shard draws a number from the record's key, and the record goes to the shard with the least
``-ln(u) / weight``. A draw depends on the key and the shard alone, so a new shard (or a larger weight) takes
records only into itself, and a removed one gives away only its own: with equal weights one shard more than n
moves 1 / (n + 1) of the records, the least that evens the load. Each record is placed on its own, in built-in
functions, without a shuffle.

Slots number the records of a shard without a gap. They follow a digest of the key, so they do not depend on
files, partitions or machines. Equal records are counted before they are shuffled, a shard is numbered in slices
of its digests, and copies beyond ``CHUNK`` form slices of their own: neither a shard nor a key that holds a third
of all records meets in one task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlas.llm.names import unused
from atlas.session import cut_lineage

SHARDS = 8
SLICE_DIGITS = 3  # hexadecimal digits of the digest that cut a shard into slices
CHUNK = 1 << 16  # equal records that are numbered and expanded together


def key_text(key: Column | str) -> Column:
    """A key as text; null is the empty text. Several columns: pass ``F.to_json(F.struct(...))``."""
    return F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))


def draw(key: Column, shard: int) -> Column:
    """The shard's number for a key, between 0 and 1, both excluded: 52 bits of a digest."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{shard}:"), key)), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard of a key text. Ties go to the smaller shard; shards of weight 0 get nothing.

    Negative weights, and weights that are all 0, raise ``ValueError``.
    """
    if any(not w >= 0 for w in weights.values()) or not any(weights.values()):
        raise ValueError("weights are 0 or more, and one of them is more than 0")
    tries = [F.struct((-F.log(draw(key, s)) / float(w)).alias("cost"), F.lit(int(s)).alias("shard"))
             for s, w in sorted(weights.items()) if w > 0]
    return (F.least(*tries) if len(tries) > 1 else tries[0])["shard"].cast("int")


def even(shards: int) -> dict[int, float]:
    return {s: 1.0 for s in range(shards)}


def place(records: DataFrame, key: Column | str, weights: Mapping[int, float], out: str = "shard") -> DataFrame:
    """``records`` with the shard of each row in ``out`` (a column of that name is replaced).

    All rows are kept, equal keys share a shard whatever else the rows hold, and rows with a null key count as
    one key. An empty table gives an empty one.
    """
    return records.withColumn(out, rendezvous(key_text(key), weights))


def write_shards(records: DataFrame, key: Column | str, weights: Mapping[int, float], path: str) -> None:
    """Whole records as Parquet below ``path``, a folder ``shard=N`` for each shard. No shuffle: every task
    writes its share of each shard."""
    place(records, key, weights).write.partitionBy("shard").parquet(path)


def slots(placed: DataFrame, key: str, columns: list[str], shard: str = "shard", chunk: int = CHUNK) -> DataFrame:
    """``columns`` of ``placed`` (which hold ``key`` and ``shard``) with ``slot``, 0, 1, ... within each shard.

    The order is that of the first digits of the digest of the key; then of the copy's number divided by
    ``chunk``, the digest, and the columns. Rows equal in all ``columns`` are copies and take neighbouring slots.
    """
    digest, copies, part, piece, here, start, at = unused(columns, 7)
    mix = F.md5(key_text(key))
    counted = cut_lineage(placed.select(*columns, mix.alias(digest)).groupBy(*columns, digest).agg(
        F.count(F.lit(1)).alias(copies)))
    cut = counted.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col(copies) - 1) / chunk))).alias(piece)).select(
        *columns, digest, piece, F.substring(digest, 1, SLICE_DIGITS).alias(part),
        F.least(F.lit(chunk), F.col(copies) - F.col(piece) * chunk).alias(copies))
    slices = [shard, part, piece]
    before = Window.partitionBy(shard).orderBy(part, piece).rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(*slices).agg(F.sum(copies).alias(here)).select(
        *slices, F.coalesce(F.sum(here).over(before), F.lit(0)).alias(start))
    inside = Window.partitionBy(*slices).orderBy(digest, *columns).rowsBetween(Window.unboundedPreceding, -1)
    numbered = cut.withColumn(here, F.coalesce(F.sum(copies).over(inside), F.lit(0))).join(starts, slices)
    return numbered.select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1)).alias(at), here, start).select(
        *columns, (F.col(start) + F.col(here) + F.col(at)).cast("long").alias("slot"))


def shard_index(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``, one row for each row of ``docs``.

    ``size`` is the UTF-8 length of the text and 1; a null or empty text has size 1 and checksum 0. The law is
    ``key``: id and number of shards decide. ``grown_shard`` is the shard if there were one more. Repeated ids,
    and rows without an id, share a shard and take a slot each. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = place(place(narrow, "doc_id", even(shards)), "doc_id", even(shards + 1), "grown_shard")
    return slots(placed, "doc_id", ["doc_id", "size", "text_crc32", "shard", "grown_shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
