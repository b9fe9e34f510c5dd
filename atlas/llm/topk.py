"""Exact top-k search by a three-phase uniform threshold (operator 8).

The dimensions are cut into slices; each slice scores every row for every query on its own.

1. Every block of rows lists its best rows of each slice for each query; the listed rows are scored in full,
   and the k-th best of them is a safe cutoff of the query: at least k rows reach it.
2. The cutoff goes to all blocks. A row can only reach it if at least one of the ``m`` slices gives it
   ``cutoff / m`` or more (the uniform threshold); only such rows are collected.
3. The collected rows get their remaining slice scores, and the k best that reach the cutoff are ranked.

Queries and rows are cut into blocks of bounded size; each pair of blocks is one row of an equi-join, and a
task returns at most k rows for each query it holds. Integers are multiplied exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlas.session import cut_lineage

ROW_BLOCK = 8192
QUERY_BLOCK = 512
SLICES = 4


def quantised(vector: Column, scale: int = 1024) -> Column:
    """``floor(scale * x)`` of every component as longs; null for vectors that take no part."""
    fine = F.forall(vector, lambda x: F.coalesce(
        x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(fine & (F.size(vector) > 0),
                  F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows, exact: in doubles where every sum fits 53 bits, else in longs."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _slices(dims: int, m: int) -> list[slice]:
    cuts = np.linspace(0, dims, min(m, dims) + 1).astype(int)
    return [slice(a, b) for a, b in zip(cuts, cuts[1:])]


def _blocks(rows: DataFrame, size: int, names: tuple[str, ...]) -> DataFrame:
    """``dims, block, blocks`` and arrays of the rows' columns; blocks are dealt by hash."""
    sizes = rows.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks"))
    placed = rows.join(sizes, "dims").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    return placed.groupBy("dims", "block", "blocks").agg(
        F.collect_list(F.struct("id", *names, "v")).alias("m")).select(
        "dims", "block", "blocks", F.col("m.id").alias("ids"), *[F.col(f"m.{n}").alias(n) for n in names],
        F.flatten("m.v").alias("values"))


def top_k(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector: str = "embedding",
          scale: int = 1024, slices: int = SLICES, row_block: int = ROW_BLOCK,
          query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows with the highest integer inner product for each row
    that ``is_query`` selects, itself excluded; all rows if there are fewer. Ties go to smaller ids.

    Rows without an id or with a vector that is null or holds null or non-finite components take no part.
    Rows that repeat an id count once, with the smallest vector. Vectors meet those of their own length. An
    empty table gives no rows.
    """
    every = cut_lineage(
        rows.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector), scale).alias("v"),
                F.coalesce(is_query, F.lit(False)).alias("asks"))
        .where("v IS NOT NULL").groupBy("id").agg(F.min("v").alias("v"), F.max("asks").alias("asks"))
        .withColumn("dims", F.size("v")))
    tiles = cut_lineage(_blocks(every, row_block, ()))
    sides = tiles.select("dims", F.col("block").alias("tile"), F.col("ids").alias("b_ids"), F.col("values").alias("b"))
    counts = tiles.groupBy("dims").agg(F.max("blocks").alias("tiles"))

    def met(queries: DataFrame, names: tuple[str, ...]) -> DataFrame:
        asked = _blocks(queries, query_block, names).drop("block", "blocks").join(counts, "dims").withColumn(
            "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        return asked.join(sides, ["dims", "tile"]).select("dims", "ids", *names, "values", "b_ids", "b")

    def parts(batch, i, extra):
        dims = batch.column(0)[i].as_py()
        columns = [batch.column(j)[i].values.to_numpy(zero_copy_only=False) for j in range(1, 5 + extra)]
        a, b = columns[-3].reshape(-1, dims), columns[-1].reshape(-1, dims)
        scores = [exact_product(a[:, s], b[:, s]) for s in _slices(dims, slices)]
        return columns, scores

    def listed(batches):
        """Phase 1: the union of the slices' lists, scored in full, cut to k for each query."""
        for batch in batches:
            for i in range(batch.num_rows):
                (ids, _, b_ids, _), scores = parts(batch, i, 0)
                out_q, out_s, out_i = [], [], []
                for row, name in enumerate(ids):
                    seen = np.unique(np.concatenate([_best(s[row], b_ids, k + 1) for s in scores]))
                    seen = seen[b_ids[seen] != name]
                    total = sum(s[row][seen] for s in scores)
                    top = _best(total, b_ids[seen], k)
                    out_q.append(np.full(len(top), name))
                    out_i.append(b_ids[seen][top])
                    out_s.append(total[top])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x), pa.int64()) for x in (out_q, out_i, out_s)],
                    ["query_id", "vec_id", "score"])

    def collected(batches):
        """Phases 2 and 3."""
        for batch in batches:
            for i in range(batch.num_rows):
                (ids, cutoffs, _, b_ids, _), scores = parts(batch, i, 1)
                out_q, out_s, out_i = [], [], []
                for row, (name, cutoff) in enumerate(zip(ids, cutoffs)):
                    enough = np.zeros(len(b_ids), bool)
                    for s in scores:
                        enough |= s[row] >= -(-int(cutoff) // len(scores))
                    at = np.flatnonzero(enough & (b_ids != name))
                    total = sum(s[row][at] for s in scores)
                    at, total = at[total >= cutoff], total[total >= cutoff]
                    top = _best(total, b_ids[at], k)
                    out_q.append(np.full(len(top), name))
                    out_i.append(b_ids[at][top])
                    out_s.append(total[top])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x), pa.int64()) for x in (out_q, out_i, out_s)],
                    ["query_id", "vec_id", "score"])

    schema = "query_id long, vec_id long, score long"
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    queries = every.where("asks").select("id", "v", "dims")
    gathered = met(queries, ()).mapInArrow(listed, schema)
    cutoffs = gathered.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(
        F.col("query_id").alias("id"), F.col("score").alias("cutoff"))
    least = -(2 ** 62)  # fewer than k rows: every row is sufficient
    sent = queries.join(cutoffs, "id", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(least)))
    return (met(sent, ("cutoff",)).mapInArrow(collected, schema)
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
