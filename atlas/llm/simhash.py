"""SimHash near duplicates by tiled exact comparison (operator 5).

Fingerprints are compared exactly in tiles with exclusive-or and bit counts. A tile holds fingerprints whose
four 16-bit quarters have the same population counts; the counts of two fingerprints differ, summed over the
quarters, by at most their Hamming distance, so tile pairs beyond the radius are skipped (the total population
count is the sum of the four). Tiles of a crowded cell are split by hash into blocks of bounded size, and each
pair of blocks is one row of an equi-join. Equal fingerprints are one vertex.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlas.llm.names import shielded
from atlas.llm.tiles import spanning_forest
from atlas.operators.groups import components
from atlas.session import cut_lineage

SEED = 42
QUARTERS = 4
TILE = 4096  # fingerprints in a block, about


def simhash(text: str | None, words_in_shingle: int = 3, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles of a whole text, as a signed integer (null: 0)."""
    words = text.encode("utf-8", "replace").lower().split() if text else []  # A-Z; white space of ASCII
    if not words:
        return 0
    k = min(words_in_shingle, len(words))
    joined = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate([[0], stops[:len(words) - k]]).tolist()
    ends = (stops[k - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(begins, ends)], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i:i + (1 << 16)].astype(">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes))
    return int(bits.view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``doc_id, fp`` (signed 64-bit) of every row."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([simhash(t.as_py(), words) for t in batch.column(1)], pa.int64())],
                ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, fp long")


def _quarter(fp: Column, i: int) -> Column:
    return F.bit_count(F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF)))


def _near_cells(radius: int) -> list[tuple[int, ...]]:
    """Half of the differences of quarter counts within the radius, nil included."""
    spread = range(-radius, radius + 1)
    within = [d for d in product(spread, repeat=QUARTERS) if sum(map(abs, d)) <= radius]
    return [d for d in within if d >= (0,) * QUARTERS]


def fingerprint_links(vertices: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """``src, dst``: links between the vertices (``id, fp``, distinct) within the radius, reduced in each tile
    pair to a spanning forest: connectivity is whole, dense groups stay small."""
    cell = sum((_quarter(F.col("fp"), i).cast("int") * 17 ** (QUARTERS - 1 - i) for i in range(QUARTERS)), F.lit(0))
    placed = vertices.select("id", "fp", cell.alias("cell"))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("blocks"))
    sizes = F.broadcast(sizes)  # at most 17 ** 4 rows
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    tiles = cut_lineage(
        placed.join(sizes, "cell").groupBy("cell", block.alias("block"))
        .agg(F.collect_list(F.struct("fp", "id")).alias("members"))
        .select("cell", "block", F.col("members.fp").alias("fps"), F.col("members.id").alias("ids")))

    steps = F.array(*[F.array(*map(F.lit, d)) for d in _near_cells(radius)])
    digits = [F.floor(F.col("cell") / 17 ** (QUARTERS - 1 - i)).cast("int") % 17 for i in range(QUARTERS)]
    there = [digits[i] + F.col("step")[i] for i in range(QUARTERS)]
    inside = there[0].between(0, 16)
    for t in there[1:]:
        inside &= t.between(0, 16)
    other = sum((there[i] * 17 ** (QUARTERS - 1 - i) for i in range(QUARTERS)), F.lit(0))
    asked = (
        tiles.withColumn("step", F.explode(steps)).where(inside)
        .select(F.col("cell").alias("own"), F.col("block").alias("own_block"), F.col("fps").alias("a"),
                F.col("ids").alias("a_ids"), other.alias("cell"))
        .join(sizes, "cell")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .where((F.col("own") != F.col("cell")) | (F.col("block") >= F.col("own_block")))
        .drop("blocks"))
    met = asked.join(tiles.withColumnsRenamed({"fps": "b", "ids": "b_ids"}), ["cell", "block"]).select(
        ((F.col("own") == F.col("cell")) & (F.col("own_block") == F.col("block"))).alias("same"),
        "a", "a_ids", "b", "b_ids")

    def compare(batches):
        for batch in batches:
            src, dst = [], []
            same = batch.column(0).to_pylist()
            for i in range(batch.num_rows):
                a, a_ids, b, b_ids = (batch.column(j)[i].values.to_numpy() for j in range(1, 5))
                a, b = a.view(np.uint64), b.view(np.uint64)  # of a signed number, bits of the absolute value count
                hits_a, hits_b = [], []
                for at in range(0, len(a), 256):  # a strip at a time bounds the memory
                    near = np.bitwise_count(a[at:at + 256, None] ^ b[None, :]) <= radius
                    x, y = np.nonzero(near)
                    hits_a.append(x + at)
                    hits_b.append(y)
                x, y = np.concatenate(hits_a), np.concatenate(hits_b)
                if same[i]:
                    keep = x < y
                    x, y = x[keep], y[keep]
                if not len(x):
                    continue
                kept = spanning_forest(x, y if same[i] else y + len(a), len(a) + len(b))
                src.append(a_ids[x[kept]])
                dst.append(b_ids[y[kept]])
            if src:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(src), pa.int64()), pa.array(np.concatenate(dst), pa.int64())],
                    ["src", "dst"])

    return met.mapInArrow(compare, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                    radius: int = 2) -> DataFrame:
    """``doc_id, fp, component_id``, one row for each row of ``docs``.

    ``component_id`` is the smallest id that links of at most ``radius`` differing bits reach. Null and empty
    texts have fingerprint zero and link like any other. Equal texts (ties, repeated rows) share a vertex.
    A row whose id is null cannot be a member: its component is the one its fingerprint has, if any row with
    an id has that fingerprint, else null. An empty table gives no rows.
    """
    marked = cut_lineage(fingerprints(docs, id_col, text_col, words))
    vertices = cut_lineage(
        marked.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("id")).select("id", "fp"))
    joined = components(fingerprint_links(vertices, radius))
    whose = vertices.join(joined, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return marked.join(whose, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
             radius: int = 2) -> DataFrame:
    """One document of each group of linked fingerprints, columns unchanged, whatever their names.

    The one with the smallest id stays (rows without an id come last), then the smallest digest of the text, then of
    the whole row; of rows equal in every column one stays. Groups are groups of fingerprints, so two texts
    under one id stay apart unless they are linked, and rows without an id are members like others. Null and empty
    texts are one group. An empty table gives no rows.
    """
    def run(rows: DataFrame) -> DataFrame:
        order = F.struct(F.col(id_col).isNull().alias("late"), F.col(id_col).alias("id"),
                         F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("said"),
                         F.xxhash64(*rows.columns).alias("row"))
        marked = cut_lineage(rows.select(order.alias("o"), F.col(text_col).alias("text")).transform(
            lambda d: _marked(d, words)))
        vertices = cut_lineage(marked.select(F.col("fp").alias("id"), "fp").distinct())
        joined = components(fingerprint_links(vertices, radius)).withColumnRenamed("id", "_fp")
        whose = marked.join(joined, F.col("fp") == F.col("_fp"), "left").select(
            F.coalesce("component", "fp").alias("group"), "o")
        first = whose.groupBy("group").agg(F.min("o").alias("_first")).select("_first")
        kept = rows.withColumn("_o", order).join(first, F.col("_o") == F.col("_first"))
        return kept.dropDuplicates(["_o"]).select(*[rows[c] for c in rows.columns])

    return shielded(docs, (id_col, text_col), run)


def _marked(rows: DataFrame, words: int) -> DataFrame:
    """``o, fp`` of rows ``o, text``."""
    kind = rows.schema["o"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([simhash(t.as_py(), words) for t in batch.column(1)], pa.int64())], ["o", "fp"])

    return rows.mapInArrow(run, f"o {kind}, fp long")
