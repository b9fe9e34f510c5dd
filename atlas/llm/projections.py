"""Near-duplicate vectors by collision counting on sorted projections (operator 9).

Vectors are compared under equal labels by cosine. Each is projected on many random directions; along every
direction the values of a tile are sorted, and the window around a query value gives the vectors that collide
with it there. A pair is verified by its exact cosine if it collides along enough directions. Window and count
are calibrated for a pair exactly at the threshold: the difference of its projections is normal with the
pair's distance as deviation, so its collisions are binomial and the count is the quantile that misses at most
``miss`` of such pairs (closer pairs collide more often).

A label is cut into tiles by hash; each pair of tiles is one row of an equi-join, so a label that holds a
third of all rows is spread like any other. A task returns link counts and a spanning forest of the links.
"""

from __future__ import annotations

from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlas.llm.tiles import spanning_forest
from atlas.operators.groups import components
from atlas.session import cut_lineage

DIRECTIONS = 40
HALF_WINDOW = 1.0  # in distances of a pair at the threshold
MISS = 1e-4
TILE = 1024
SEED = 7


def collisions_needed(directions: int = DIRECTIONS, half_window: float = HALF_WINDOW, miss: float = MISS) -> int:
    """The largest count that a pair at the threshold falls short of with probability ``miss`` at most."""
    p = erf(half_window / sqrt(2))
    below = 0.0
    for count in range(directions + 1):
        below += comb(directions, count) * p ** count * (1 - p) ** (directions - count)
        if below > miss:
            return count
    return directions


def _directions(dims: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims, n))


def unit_rows(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def collision_counts(a: np.ndarray, b: np.ndarray, half_window: float) -> np.ndarray:
    """How many columns bring each row of ``b`` into the window around each row of ``a``."""
    counts = np.zeros((len(a), len(b)), np.uint8 if a.shape[1] < 256 else np.uint16)
    for values, others in zip(a.T, b.T):
        order = np.argsort(others, kind="stable")
        ranked = others[order]
        low = np.searchsorted(ranked, values - half_window, "left")
        high = np.searchsorted(ranked, values + half_window, "right")
        for row, x, y in zip(counts, low.tolist(), high.tolist()):
            row[order[x:y]] += 1
    return counts


def similar_pairs(a: np.ndarray, b: np.ndarray, threshold: float, directions: int, half_window: float,
                  needed: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of unit rows with cosine of at least ``threshold`` that collide often enough."""
    distance = sqrt(max(0.0, 2 - 2 * threshold))
    axes = _directions(a.shape[1], directions, seed)
    found_a, found_b = [], []
    projected = b @ axes
    for at in range(0, len(a), 256):
        part = a[at:at + 256]
        x, y = np.nonzero(collision_counts(part @ axes, projected, half_window * distance) >= needed)
        cosine = np.einsum("ij,ij->i", part[x], b[y])
        sure = cosine >= threshold
        found_a.append(x[sure] + at)
        found_b.append(y[sure])
    return np.concatenate(found_a), np.concatenate(found_b)


def valid_vector(vector: str):
    """True for vectors that can have a cosine: not null, not empty, finite, not zero."""
    values = F.col(vector)
    fine = F.forall(values, lambda x: F.coalesce(
        x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(fine & (F.size(values) > 0) & F.exists(values, lambda x: x != 0), F.lit(False))


def near_duplicate_vectors(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding",
                           label: str = "label", threshold: float = 0.93, directions: int = DIRECTIONS,
                           half_window: float = HALF_WINDOW, miss: float = MISS, tile: int = TILE,
                           seed: int = SEED) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row for each row of ``rows``.

    Only rows with an id, a label and a valid vector take part; others have no links and are their own
    component (null without an id). Equal vectors under one label are one vertex with a multiplicity, and link with one another.
    Vectors of different length never link. An empty table gives no rows.
    """
    base = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("v"),
                       F.col(label).alias("label"))
    taking = base.where(valid_vector("v") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    vertices = cut_lineage(
        taking.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
        .withColumn("dims", F.size("v")))
    group = ["label", "dims"]
    sizes = vertices.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("blocks"))
    placed = vertices.join(sizes, group).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    tiles = cut_lineage(
        placed.groupBy(*group, "block", "blocks").agg(F.collect_list(F.struct("id", "copies", "v")).alias("m"))
        .select(*group, "block", "blocks", F.col("m.id").alias("ids"), F.col("m.copies").alias("copies"),
                F.flatten("m.v").alias("values")))
    asked = (tiles.withColumnsRenamed({"block": "own", "ids": "a_ids", "copies": "a_copies", "values": "a"})
             .withColumn("block", F.explode(F.sequence(F.col("own"), F.col("blocks") - 1))).drop("blocks"))
    met = asked.join(tiles.withColumnsRenamed({"ids": "b_ids", "copies": "b_copies", "values": "b"}),
                     [*group, "block"]).select(
        (F.col("own") == F.col("block")).alias("same"), "dims", "a_ids", "a_copies", "a", "b_ids", "b_copies", "b")
    needed = collisions_needed(directions, half_window, miss)

    def compare(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                same, dims = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                a_ids, a_copies, a, b_ids, b_copies, b = (
                    batch.column(j)[i].values.to_numpy(zero_copy_only=False) for j in range(2, 8))
                a, b = (unit_rows(x.astype(np.float64).reshape(-1, dims)) for x in (a, b))
                x, y = similar_pairs(a, b, threshold, directions, half_window, needed, seed)
                if same:
                    x, y = x[x < y], y[x < y]
                if not len(x):
                    continue
                kept = spanning_forest(x, y if same else y + len(a), len(a) + len(b))
                for_a = np.bincount(x, b_copies[y], len(a)).astype(np.int64)
                for_b = np.bincount(y, a_copies[x], len(b)).astype(np.int64)
                at_a, at_b = np.flatnonzero(for_a), np.flatnonzero(for_b)
                none = np.zeros(len(kept), np.int64)
                yield pa.RecordBatch.from_pydict({
                    "src": np.concatenate([a_ids[x[kept]], a_ids[at_a], b_ids[at_b]]),
                    "dst": np.concatenate([b_ids[y[kept]], a_ids[at_a], b_ids[at_b]]),
                    "links": np.concatenate([none, for_a[at_a], for_b[at_b]])})

    found = cut_lineage(met.mapInArrow(compare, "src long, dst long, links long"))
    joined = components(found.where("src != dst").select("src", "dst"))
    linked = found.where("src = dst").groupBy(F.col("src").alias("id")).agg(F.sum("links").alias("links"))
    whose = vertices.join(linked, "id", "left").join(joined, "id", "left").select(
        "label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"))
    component = F.coalesce("component_id", "vec_id")
    return base.join(
        whose, (base["label"] == whose["label"]) & (base["v"] == whose["v"]) & base["vec_id"].isNotNull(), "left"
    ).select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
             component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
