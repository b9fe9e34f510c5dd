"""Exact nearest-neighbour and near-duplicate joins over vector columns.

Vectors are cut into bounded blocks, and only pairs of blocks that can still hold an answer meet in a
task. A sample of about sqrt(n) rows serves as pivots, in two levels: a row goes to the closest coarse pivot and
then to the closest leaf below it, and the triangle inequality on the distances to both tells which cells a row can
skip, whole branches first. So cells grow finer with the table, and placing a row looks at the fourth root of n
pivots twice. A task sees two blocks of bounded size and returns the best ``k`` per row (or the pairs above a
threshold), so all pairs are never emitted and no key, however frequent, ends up in a single task.

Where the cells separate next to nothing, as those of vectors without structure, or keys cut them into slivers, every
pair of cells would meet and each row would travel once for each cell. Then the rows are cut into tiles instead, as
large as two of them fit a task, and every pair of tiles meets: the same comparisons, with a hundredth of the traffic.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlas.operators.arrow import batch_udf
from atlas.operators.skew import salted_join
from atlas.session import cut_lineage, spread

DIGITS = 9  # scores are rounded before ranking, so equal vectors tie exactly and the id decides
BLOCK_BYTES = 32 << 20
ROUNDING = 1e-9  # more than rounding moves a score
ROWS_AT_ONCE, COLUMNS_AT_ONCE, FIRST_COLUMNS = 256, 4096, 256
PAIRS_AT_ONCE = 1 << 16  # pairs whose vectors are gathered for exact scores
DENSE = 0.6  # of the cells of an average row: where more may hold an answer, whole tiles meet instead
TRAVEL = 4  # times as often as with tiles: rows may travel so far for cells, where the bytes matter
TRAVEL_BYTES = 1 << 30  # sent for cells that do not matter
TILE_ROWS = 2048, 65_536  # of a tile: at least, for the tasks to be worth their start, and at most
PAIRS_A_CALL = 500_000  # pairs of rows that are compared in the time that a call for two blocks takes by itself
PROBES = 4096  # rows, about, that tell how many cells an average row needs
FEW_PROBES = 256  # rows, at most, that tell it beforehand, from their true k-th distance
TASKS_A_CORE = 8  # pairs of tiles, at least, where tables are large enough and keys cut them up
PIVOT_BYTES = 32 << 20  # that all pivots, which every task holds, take at most
CELL_ROWS = 700  # of one key and cell: with fewer, the calls for pairs of blocks cost more than the rows they compare
SEED_CELLS = 3  # cells that bound a row's k-th distance before the others are looked at
SLACK = 1e-6
LINKS_AT_ONCE = 1 << 20  # pairs that a task holds while it thins them to a forest


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def _unit(matrix: np.ndarray) -> np.ndarray:
    length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix / np.where(length > 0, length, 1.0)


def _scores(left: np.ndarray, right: np.ndarray, metric: str) -> np.ndarray:
    """Larger is closer: the cosine, or the negative squared distance."""
    return np.round(_raw_scores(left, right, metric), DIGITS)


def _raw_scores(left: np.ndarray, right: np.ndarray, metric: str) -> np.ndarray:
    gram = left @ right.T
    if metric == "cosine":
        return gram
    d2 = (left * left).sum(axis=1)[:, None] + (right * right).sum(axis=1)[None, :] - 2.0 * gram
    return -np.maximum(d2, 0.0)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Column indices of the ``k`` best scores per row, ties resolved by the smaller index."""
    k = min(k, scores.shape[1])
    if k == scores.shape[1]:
        return np.argsort(-scores, axis=1, kind="stable")
    picked = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    worst = np.take_along_axis(scores, picked, axis=1).min(axis=1)
    for row in np.flatnonzero((scores >= worst[:, None]).sum(axis=1) > k):
        picked[row] = np.argsort(-scores[row], kind="stable")[:k]
    picked.sort(axis=1)
    order = np.argsort(-np.take_along_axis(scores, picked, axis=1), axis=1, kind="stable")
    return np.take_along_axis(picked, order, axis=1)


@dataclass(frozen=True)
class Short:
    """A matrix in single precision, for deciding which pairs are worth an exact score."""

    rows: np.ndarray
    norm: np.ndarray
    sound: bool  # small enough that nothing overflows

    @staticmethod
    def of(matrix: np.ndarray) -> Short:
        norm = np.sqrt((matrix * matrix).sum(axis=1))
        return Short(matrix.astype(np.float32), norm, bool(np.isfinite(norm).all() and (not len(norm) or norm.max() < 1e15)))

    def part(self, rows: slice) -> Short:
        return Short(self.rows[rows], self.norm[rows], self.sound)


def _marked(mask: np.ndarray) -> np.ndarray:
    """Places of the few true values, looked for eight at a time."""
    flat = mask.reshape(-1)
    even = len(flat) // 8 * 8
    eights = np.flatnonzero(flat[:even].view(np.uint64))
    i, j = np.nonzero(flat[:even].reshape(-1, 8)[eights])
    return np.concatenate([eights[i] * 8 + j, even + np.flatnonzero(flat[even:])])


def _candidates(left: Short, right: Short, limit: np.ndarray | float, metric: str,
                room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose score may reach their row's ``limit``: all that do, and few others. ``room``: for the products.

    The error of a sum of d products in single precision is below d + 2 units of 2^-24 of the product of the norms;
    what is allowed for is more than twice that.
    """
    error = (left.rows.shape[1] + 16) * 2.0 ** -22
    gram = room[:len(left.rows) * len(right.rows)].reshape(len(left.rows), len(right.rows))
    np.matmul(left.rows, right.rows.T, out=gram)
    widest = right.norm.max(initial=0.0)
    if metric == "cosine":
        least = limit - ROUNDING - error * left.norm * widest
    else:
        gram -= (right.norm * right.norm / 2).astype(np.float32)[None, :]
        least = (limit + left.norm * left.norm - ROUNDING - error * (left.norm + widest) ** 2) / 2
    flat = _marked(gram >= least.astype(np.float32)[:, None])
    return flat // gram.shape[1], flat % gram.shape[1]


def _scores_of(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, metric: str) -> np.ndarray:
    """Scores of the pairs ``i, j``, pair by pair if they are few."""
    if len(i) * 16 > len(left) * len(right):
        return np.round(_raw_scores(left, right, metric)[i, j], DIGITS)
    out = np.empty(len(i))
    for at in range(0, len(i), PAIRS_AT_ONCE):
        part = slice(at, at + PAIRS_AT_ONCE)
        a, b = left[i[part]], right[j[part]]
        gram = np.einsum("ij,ij->i", a, b)
        out[part] = gram if metric == "cosine" else -np.maximum((a * a).sum(axis=1) + (b * b).sum(axis=1) - 2.0 * gram, 0.0)
    return np.round(out, DIGITS)


def _running_best(lm: np.ndarray, rm: np.ndarray, k: int, metric: str, lid, rid, lx, rx, ls: Short | None = None,
                  rs: Short | None = None, room: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Column indices and scores of the ``k`` best columns per row; fewer are filled up with scores of -inf.

    Columns come in pieces, each as wide as all before it. The first gives every row its ``k`` best so far; of the
    others only those pairs are scored and ranked that may reach a row's k-th best, which fewer and fewer do: single
    precision tells. ``lid`` (``lx``): ids (groups) of the rows, if equal ones may not meet. ``ls``, ``rs``: the rows
    in single precision, where the caller has them; ``room``: for products.
    """
    n = len(lm)
    ls, rs = ls or Short.of(lm), rs or Short.of(rm)
    room = np.empty(n * max(k, COLUMNS_AT_ONCE), np.float32) if room is None else room
    best, value = np.zeros((n, k), np.int64), np.full((n, k), -np.inf)
    at, wide = 0, max(k, FIRST_COLUMNS)
    while at < len(rm):
        cols = slice(at, at + wide)
        if at == 0:
            scores = _scores(lm, rm[cols], metric)
            if lid is not None:
                scores[lid[:, None] == rid[None, cols]] = -np.inf
            if lx is not None:
                scores[lx[:, None] == rx[None, cols]] = -np.inf
            top = _best(scores, k)
            best[:, :top.shape[1]], value[:, :top.shape[1]] = top, np.take_along_axis(scores, top, axis=1)
            at += wide
            continue
        if ls.sound and rs.sound:
            i, j = _candidates(ls, rs.part(cols), value[:, -1], metric, room)
        else:
            i, j = np.nonzero(_raw_scores(lm, rm[cols], metric) >= value[:, -1:] - ROUNDING)
        free = np.ones(len(i), bool)
        if lid is not None:
            free &= lid[i] != rid[at + j]
        if lx is not None:
            free &= lx[i] != rx[at + j]
        i, j = i[free], j[free]
        score, j = _scores_of(lm, rm[cols], i, j, metric), j + at
        at, wide = at + wide, min(at + wide, max(k, COLUMNS_AT_ONCE))
        good = score >= value[i, -1]
        if not good.any():
            continue
        i, j, score = i[good], j[good], score[good]
        touched, place = np.unique(i, return_inverse=True)
        row = np.concatenate([np.repeat(np.arange(len(touched)), k), place])
        col, got = np.concatenate([best[touched].ravel(), j]), np.concatenate([value[touched].ravel(), score])
        order = np.lexsort((col, -got, row))
        row, col, got = row[order], col[order], got[order]
        first = np.searchsorted(row, np.arange(len(touched)))[:, None] + np.arange(k)[None, :]
        best[touched], value[touched] = col[first], got[first]
    return best, value


def _codes(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in place of the values, equal where those are: quicker to compare than strings."""
    codes = pd.factorize(np.concatenate([left, right]))[0]
    a, b = codes[:len(left)], codes[len(left):]
    return a, b if codes.min(initial=0) >= 0 or left.dtype == object else np.where(b < 0, -2, b)  # NaN equals nothing


def _allowed(lx: np.ndarray | None, rx: np.ndarray | None, n: int) -> list[tuple[np.ndarray, np.ndarray | slice]]:
    """Rows of the left block, and the columns that they meet. Rows of a group that holds most of the right block meet
    the others' columns only, rather than pass over most columns one by one."""
    every = slice(None)
    if rx is not None:
        groups, sizes = np.unique(rx, return_counts=True)
        crowd = groups[sizes.argmax()]
        if 2 * sizes.max() > len(rx) and (lx == crowd).any():
            return [(np.flatnonzero(lx == crowd), np.flatnonzero(rx != crowd)), (np.flatnonzero(lx != crowd), every)]
    return [(np.arange(n), every)]


def _block_topk(k: int, metric: str, exclude: bool, skip_self: bool, carry: bool):
    """Cogroup function: left block x right block -> best ``k`` of the right block per left row."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = _no_edges(left["_id"])
        if carry:
            empty["carried"] = pd.Series(dtype="object")
        if left.empty or right.empty:
            return empty
        right = right.sort_values("_id", kind="stable")
        lm, rm = _matrix(left["_v"]), _matrix(right["_v"])
        if metric == "cosine":
            lm, rm = _unit(lm), _unit(rm)
        lid, rid = left["_id"].to_numpy(), right["_id"].to_numpy()
        li, ri = _codes(lid, rid) if skip_self else (None, None)
        lx, rx = _codes(left["_x"].to_numpy(), right["_x"].to_numpy()) if exclude else (None, None)
        room = np.empty(ROWS_AT_ONCE * max(k, COLUMNS_AT_ONCE), np.float32)
        parts = []
        for rows, cols in _allowed(lx, rx, len(lid)):
            met = np.arange(len(rid))[cols]
            if not len(met):
                continue
            theirs = rm[cols]
            ls, rs = Short.of(lm[rows]), Short.of(theirs)
            for at in range(0, len(rows), ROWS_AT_ONCE):
                some = rows[at:at + ROWS_AT_ONCE]
                best, value = _running_best(lm[some], theirs, k, metric, li[some] if skip_self else None, ri[cols] if skip_self else None,
                                            lx[some] if exclude else None, rx[cols] if exclude else None,
                                            ls.part(slice(at, at + ROWS_AT_ONCE)), rs, room)
                valid = np.isfinite(value)
                found = met[best[valid]]
                part = pd.DataFrame({
                    "src": np.repeat(lid[some], valid.sum(axis=1)), "dst": rid[found], "score": value[valid],
                })
                if carry:
                    part["carried"] = right["_c"].to_numpy()[found]
                parts.append(part)
        return pd.concat(parts) if parts else empty

    return run


def _shape(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_v")).alias("d")).first()
    return row["n"], row["d"] or 1


def default_block_rows(df: DataFrame, n: int, dim: int) -> int:
    """Bounded by memory, and small enough that the pairs of blocks keep the cluster busy."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    spread = math.ceil(n / math.ceil(math.sqrt(2 * cores)))
    return max(8192, min(spread, BLOCK_BYTES // (4 * dim)))


def _standard(df: DataFrame, id_col: str, vec: str, by: Sequence[str] = (), exclude: str | None = None,
              carry: str | None = None) -> DataFrame:
    group = F.col(exclude) if exclude else F.lit(0)
    carried = F.col(carry).cast("string") if carry else F.lit("")
    return df.select(
        *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)],
        (F.col(id_col) if dict(df.dtypes)[id_col] == "string" else F.col(id_col).cast("long")).alias("_id"), F.col(vec).alias("_v"), group.alias("_x"),
        carried.alias("_c"),
    )


@dataclass(frozen=True)
class Pivots:
    """Leaves, coarse pivots (some of the leaves), and the leaves below each coarse pivot."""

    leaves: np.ndarray
    coarse: np.ndarray
    below: list[np.ndarray]

    def owner(self) -> np.ndarray:
        out = np.empty(len(self.leaves), np.int64)
        for c, leaves in enumerate(self.below):
            out[leaves] = c
        return out


def leaf_count(n: int, block_rows: int, dim: int) -> int:
    """About sqrt(n), more where blocks shall be smaller, and never more than ``PIVOT_BYTES`` hold."""
    return min(max(2, math.ceil(n / block_rows), math.isqrt(n)), max(2, PIVOT_BYTES // (8 * dim)))


def keyed_leaf_count(n: int, typical: float, block_rows: int, dim: int) -> int:
    """:func:`leaf_count` where keys cut every cell up: as many as suit the ``typical`` rows of a row's key."""
    few = max(2, math.ceil(typical / block_rows), min(math.isqrt(int(typical)), int(typical) // CELL_ROWS))
    return min(few, leaf_count(n, block_rows, dim))


def _apart(leaves: np.ndarray, distance: float) -> np.ndarray:
    """The leaves without those that lie within ``distance`` of one kept before them."""
    kept = np.zeros(len(leaves), bool)
    free = np.ones(len(leaves), bool)
    for i in range(len(leaves)):
        if free[i]:
            kept[i] = True
            free &= _distances(leaves, leaves[i:i + 1])[:, 0] > distance
    return leaves[kept]


def _pivots(df: DataFrame, count: int, metric: str, apart: float = 0.0) -> Pivots:
    """A bounded sample of distinct vectors, chosen by hash so that it never changes between runs. ``apart`` thins
    it, so that a cluster of near copies, however large, has one pivot."""
    rows = df.orderBy(F.xxhash64("_id"), "_id").limit(count).select("_v").collect()
    sample = np.array([r["_v"] for r in rows], dtype=np.float64)
    leaves = np.unique(_unit(sample) if metric == "cosine" else sample, axis=0)
    leaves = _apart(leaves, apart) if apart > 0 else leaves
    coarse = leaves[:: max(1, math.isqrt(len(leaves)))]
    nearest = np.concatenate([_distances(leaves[i:i + 1024], coarse).argmin(axis=1) for i in range(0, len(leaves), 1024)])
    return Pivots(leaves, coarse, [np.flatnonzero(nearest == c) for c in range(len(coarse))])


def _distances(matrix: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d2 = (matrix * matrix).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(d2 - 2.0 * (matrix @ pivots.T), 0.0))


def _with_cells(df: DataFrame, pivots: Pivots, metric: str) -> DataFrame:
    """Add ``_cell`` (the leaf), ``_r`` (distance to it) and ``_q`` (distance to its coarse pivot)."""
    held = df.sparkSession.sparkContext.broadcast(pivots)

    @batch_udf("struct<cell:int,r:double,q:double>")
    def place(v: pd.Series) -> pd.DataFrame:
        p = held.value
        matrix = _unit(_matrix(v)) if metric == "cosine" else _matrix(v)
        far = _distances(matrix, p.coarse)
        far[:, [not len(leaves) for leaves in p.below]] = np.inf
        branch = far.argmin(axis=1)
        cell, r = np.zeros(len(matrix), "int32"), np.zeros(len(matrix))
        for c in np.unique(branch):
            rows = np.flatnonzero(branch == c)
            dist = _distances(matrix[rows], p.leaves[p.below[c]])
            best = dist.argmin(axis=1)
            cell[rows], r[rows] = p.below[c][best], dist[np.arange(len(rows)), best]
        return pd.DataFrame({"cell": cell, "r": r, "q": far[np.arange(len(matrix)), branch]})

    return df.withColumn("_p", place("_v")).select("*", F.col("_p.cell").alias("_cell"), F.col("_p.r").alias("_r"),
                                                   F.col("_p.q").alias("_q")).drop("_p")


def _with_blocks(df: DataFrame, keys: Sequence[str], block_rows: int) -> DataFrame:
    """Add ``_sub``: the piece of an over-full cell."""
    full = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block_rows)
    pieces = full.select(*keys, F.ceil(F.col("_n") / block_rows).cast("int").alias("_pieces"))
    sub = F.coalesce(F.pmod(F.xxhash64("_id"), F.col("_pieces")), F.lit(0)).cast("int")
    return df.join(pieces, list(keys), "left").withColumn("_sub", sub).drop("_pieces")


@dataclass(frozen=True)
class Radii:
    """Smallest and largest distance to the pivot, by leaf and by coarse pivot; rows and sole group of a leaf."""

    low: np.ndarray
    high: np.ndarray
    outer_low: np.ndarray
    outer_high: np.ndarray
    rows: np.ndarray
    sole: list


def _radii(df: DataFrame, pivots: Pivots) -> Radii:
    """One row for each leaf comes to the driver; ``PIVOT_BYTES`` bounds their number."""
    m, c = len(pivots.leaves), len(pivots.coarse)
    out = Radii(np.full(m, np.inf), np.full(m, -np.inf), np.full(c, np.inf), np.full(c, -np.inf), np.zeros(m, np.int64), [None] * m)
    owner, group = pivots.owner(), F.xxhash64("_x")
    for row in df.groupBy("_cell").agg(F.min("_r"), F.max("_r"), F.min("_q"), F.max("_q"), F.count(F.lit(1)),
                                       F.min(group), F.max(group)).collect():
        i = row[0]
        out.low[i], out.high[i], out.rows[i] = row[1], row[2], row[5]
        out.sole[i] = row[6] if row[6] == row[7] else None
        out.outer_low[owner[i]] = min(out.outer_low[owner[i]], row[3])
        out.outer_high[owner[i]] = max(out.outer_high[owner[i]], row[4])
    return out


def _bound(dist: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least distance that a row of each cell can have, from the distances to the pivots."""
    return np.where(np.isfinite(low), np.maximum(np.maximum(dist - high, low - dist), 0.0), np.inf)


def _cells_within(df: DataFrame, pivots: Pivots, radii: Radii, metric: str, reach: Column) -> Column:
    """Cells that may hold a row within distance ``reach``: ``array<int>``."""
    held = df.sparkSession.sparkContext.broadcast((pivots, radii))

    @batch_udf("array<int>")
    def cells(v: pd.Series, far: pd.Series) -> pd.Series:
        matrix = _unit(_matrix(v)) if metric == "cosine" else _matrix(v)
        row, cell = _within(matrix, far.to_numpy(), *held.value)
        order = np.argsort(row, kind="stable")
        return pd.Series(np.split(cell[order], np.searchsorted(row[order], np.arange(1, len(matrix)))))

    return cells(F.col("_v"), reach)


def _within(matrix: np.ndarray, reach: np.ndarray, p: Pivots, r: Radii) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, cell) where the cell may hold something within the row's ``reach``."""
    limit = reach[:, None] + SLACK
    branches = _bound(_distances(matrix, p.coarse), r.outer_low, r.outer_high) <= limit
    branches &= np.isfinite(r.outer_low)
    row, cell = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for c in np.flatnonzero(branches.any(axis=0)):
        rows, leaves = np.flatnonzero(branches[:, c]), p.below[c]
        keep = (_bound(_distances(matrix[rows], p.leaves[leaves]), r.low[leaves], r.high[leaves]) <= limit[rows])
        i, j = np.nonzero(keep & np.isfinite(r.low[leaves]))
        row.append(rows[i])
        cell.append(leaves[j])
    return np.concatenate(row), np.concatenate(cell).astype("int32")


def _sure_reach(df: DataFrame, pivots: Pivots, radii: Radii, metric: str, k: int) -> Column:
    """A distance within which ``k`` rows of other groups lie for sure, from the radii alone; else infinite.

    A cell of one group gives all its rows to the others and none to its own; a cell of several gives at least one.
    """
    held = df.sparkSession.sparkContext.broadcast((pivots, radii))

    @batch_udf("double")
    def sure(v: pd.Series, group: pd.Series) -> pd.Series:
        p, r = held.value
        matrix = _unit(_matrix(v)) if metric == "cosine" else _matrix(v)
        single = np.array([s is not None for s in r.sole])
        owner = np.array([s if s is not None else 0 for s in r.sole], np.int64)
        out = np.full(len(matrix), np.inf)
        for at in range(0, len(matrix), 256):
            part = slice(at, at + 256)
            far = np.where(r.rows > 0, _distances(matrix[part], p.leaves) + np.where(r.rows > 0, r.high, 0), np.inf)
            mine = group.to_numpy(np.int64)[part, None] == owner[None, :]
            usable = np.where(single, np.where(mine, 0, r.rows), np.minimum(r.rows, 1))
            order = np.argsort(far, axis=1)
            enough = np.cumsum(np.take_along_axis(usable, order, 1), axis=1) > k  # one may be the row itself
            first = enough.argmax(axis=1)
            rows = np.arange(len(first))
            out[part] = np.where(enough.any(axis=1), far[rows, order[rows, first]], np.inf)
        return pd.Series(out)

    return sure(F.col("_v"), F.xxhash64("_x"))


def _needed(df: DataFrame, n: int, pivots: Pivots, radii: Radii, metric: str, reach: Column) -> float:
    """Cells that an average row has to look at. A fixed choice of rows tells; what is made of it decides the way,
    never the result."""
    probes = df.where(F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(max(1, n // PROBES))) == 0)
    return probes.select(F.size(_cells_within(probes, pivots, radii, metric, reach)).alias("n")).agg(
        F.avg("n")).first()[0] or 0.0


def _least_needed(left: DataFrame, right: DataFrame, n: int, pivots: Pivots, radii: Radii, k: int, metric: str,
                  keys: Sequence[str], exclude: bool, skip_self: bool) -> float:
    """Cells that an average row has to look at if it knew its true ``k``-th distance: no bound found on the way leaves
    fewer. A few rows chosen by hash tell, from one pass over ``right``, before any pair of blocks meets."""
    key = F.xxhash64(*keys) if keys else F.lit(0).cast("long")
    named = ["_id", "_v", key.alias("_key"), F.xxhash64("_x").alias("_group")]
    rows = left.where(F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(max(1, n // FEW_PROBES))) == 0).select(*named).orderBy(
        F.xxhash64("_id"), "_id").limit(FEW_PROBES).collect()
    if not rows:
        return 0.0
    matrix = np.array([r["_v"] for r in rows], np.float64)
    matrix = _unit(matrix) if metric == "cosine" else matrix
    ids, key_of, group_of = (np.array([r[c] for r in rows]) for c in ("_id", "_key", "_group"))
    held = left.sparkSession.sparkContext.broadcast((matrix, ids, key_of, group_of))

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, own, mine, group = held.value
        top = np.full((len(m), k), -np.inf)
        for frame in frames:
            for at in range(0, len(frame), COLUMNS_AT_ONCE):
                part = frame.iloc[at:at + COLUMNS_AT_ONCE]
                other = _matrix(part["_v"])
                scores = _raw_scores(m, _unit(other) if metric == "cosine" else other, metric)
                scores[mine[:, None] != part["_key"].to_numpy()[None, :]] = -np.inf
                if skip_self:
                    scores[own[:, None] == part["_id"].to_numpy()[None, :]] = -np.inf
                if exclude:
                    scores[group[:, None] == part["_group"].to_numpy()[None, :]] = -np.inf
                top = -np.partition(-np.concatenate([top, scores], axis=1), k - 1, axis=1)[:, :k]
        yield pd.DataFrame({"probe": np.arange(len(m)), "scores": list(top)})

    found = right.select(*named).mapInPandas(best, "probe int, scores array<double>").groupBy("probe").agg(
        F.element_at(F.sort_array(F.flatten(F.collect_list("scores")), asc=False), k).alias("worst")).collect()
    reach = np.full(len(matrix), np.inf)
    for probe, worst in found:
        if np.isfinite(worst):
            reach[probe] = math.sqrt(max(0.0, 2 - 2 * worst if metric == "cosine" else -worst))
    return len(_within(matrix, reach, pivots, radii)[0]) / len(matrix)


def _is_dense(needed: float, radii: Radii, n: float, dim: int, tile: int) -> bool:
    """Whether the cells separate so little that tiles are cheaper: rows travel once for each partner, and there are
    far fewer tiles than cells. A fixed share of sqrt(n) cells would let traffic grow faster than the rows ``n`` (of one
    key), so where it matters a row travels at most ``TRAVEL`` times as often as with tiles."""
    if needed > DENSE * int(np.isfinite(radii.low).sum()):
        return True
    return needed * n * 8 * dim > TRAVEL_BYTES and needed > TRAVEL * math.ceil(n / tile)


def _are_slivers(left: DataFrame, right: DataFrame, keys: Sequence[str], needed: float) -> bool:
    """Whether keys cut the cells so small that calls of the block function cost more than comparing all rows of a key."""
    blocks = left.select(*keys, "l_cell", "l_sub").distinct().count()
    return _pairs_in_keys(left, right, keys)[0] < blocks * needed * PAIRS_A_CALL


def _pairs_in_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[float, int]:
    """Pairs of rows with equal keys, and keys."""
    rows = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("a")).join(
        right.groupBy(*keys).agg(F.count(F.lit(1)).alias("b")), list(keys))
    pairs, held = rows.agg(F.sum(F.col("a").cast("double") * F.col("b")), F.count(F.lit(1))).first()
    return pairs or 0.0, held


def tile_rows(df: DataFrame, n: int, dim: int) -> int:
    """Rows of a tile: pairs of tiles keep the cluster busy, two tiles fit a task, and the tiles are few."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    least, most = TILE_ROWS
    return max(least, min(math.ceil(n / math.ceil(math.sqrt(2 * cores))), most, BLOCK_BYTES // (4 * dim)))


def keyed_tile_rows(df: DataFrame, pairs: float, tile: int) -> int:
    """:func:`tile_rows` where keys cut the rows up already: one tile for each key would keep few cores busy, so the
    pairs of rows within the keys tell."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(TILE_ROWS[0], min(tile, math.ceil(math.sqrt(pairs / (TASKS_A_CORE * cores)))))


def _tiles(df: DataFrame, keys: Sequence[str], rows: int, crowds: DataFrame | None = None) -> DataFrame:
    """Tiles in place of cells: one cell for all, cut by digests of the ids. Each of the ``crowds`` has a cell of its own."""
    whole = df.drop("_cell", "_sub", "_r", "_q").withColumn("_cell", F.lit(0))
    if crowds is not None:
        whole = whole.drop("_cell").join(F.broadcast(crowds), [*keys, "_x"], "left").withColumn("_cell", F.coalesce("_cell", F.lit(0)))
    return _with_blocks(whole, [*keys, "_cell"], rows)


def _crowds(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Groups (of a key) that would fill tiles by themselves, numbered from 1 in ``_cell``: fewer than there are tiles."""
    large = df.where(F.col("_x").isNotNull()).groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows)
    found = [(*row, i) for i, row in enumerate(large.select(*keys, "_x").collect(), 1)]
    return df.sparkSession.createDataFrame(found, df.select(*keys, "_x", F.lit(0).alias("_cell")).schema)


def _keyed(df: DataFrame, prefix: str, by: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    names = ["_cell", *extra, "_sub"]
    return df.select(*by, *[F.col(c).alias(prefix + c) for c in names], "_id", "_v", "_x", "_c")


def renewed(df: DataFrame) -> DataFrame:
    """The same columns under new attribute ids, so that frames with a common origin can be joined."""
    return df.toDF(*df.columns)


def _meet(left: DataFrame, right: DataFrame, pairs: DataFrame, lkeys: Sequence[str], rkeys: Sequence[str],
          by: Sequence[str], run, schema: str) -> DataFrame:
    """Send every listed pair of blocks to one task. Blocks are bounded, so every group is.

    The number of partitions is explicit: the work grows with the product of two blocks, so few bytes are no reason
    to merge partitions.
    """
    keys = [*by, *lkeys, *rkeys]
    ls = renewed(left).join(renewed(pairs), [*by, *lkeys])
    rs = renewed(right).join(renewed(pairs), [*by, *rkeys])
    sides = [spread(renewed(side), *keys).groupBy(*keys) for side in (ls, rs)]
    return sides[0].cogroup(sides[1]).applyInPandas(run, schema)


def edge_schema(df: DataFrame) -> str:
    kind = df.schema["_id"].dataType.simpleString()
    return f"src {kind}, dst {kind}, score double"


def _no_edges(ids: pd.Series) -> pd.DataFrame:
    kind = "int64" if ids.dtype.kind in "iu" else "object"
    return pd.DataFrame({"src": pd.Series(dtype=kind), "dst": pd.Series(dtype=kind), "score": pd.Series(dtype="float64")})


def top_k(
    left: DataFrame,
    right: DataFrame | None = None,
    k: int = 15,
    id_col: str = "id",
    vec: str = "embedding",
    metric: str = "cosine",
    by: Sequence[str] = (),
    exclude: str | None = None,
    skip_self: bool = True,
    carry: str | None = None,
    block_rows: int | None = None,
    size: tuple[int, int] | None = None,
) -> DataFrame:
    """The ``k`` closest rows of ``right`` for each row of ``left``: ``src, dst, rank, score``.

    ``by`` columns must be equal on both sides; rows equal in ``exclude`` never meet. ``score`` is the
    cosine or the squared distance; ties go to the smaller id. ``right=None`` joins ``left`` to itself.
    ``carry`` names a column of ``right`` to bring along as ``dst_<carry>``, which saves a join on ``dst``.
    Counts the rows and samples the pivots when called; the join itself stays lazy. ``size`` (rows of
    the right side, dimensions) saves the count where the caller knows it.
    """
    same = right is None
    lt = _standard(left, id_col, vec, by, exclude, carry if same else None)
    rt = lt if same else _standard(right, id_col, vec, by, exclude, carry)
    keys = [f"_by{i}" for i in range(len(by))]
    n_right, dim = size or _shape(rt)
    n_left = n_right if same else _shape(lt)[0]
    rows = block_rows or default_block_rows(lt, n_right, dim)
    run = _block_topk(k, metric, exclude is not None, skip_self, carry is not None)
    schema = edge_schema(lt) + (", carried string" if carry else "")
    if n_right <= rows:
        # One right block fits a task: hand a copy to every piece of the left side.
        pieces = max(1, math.ceil(n_left / rows))
        ls = lt.withColumn("_piece", F.pmod(F.xxhash64("_id"), F.lit(pieces)).cast("int"))
        rs = rt.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
        found = renewed(ls).groupBy(*keys, "_piece").cogroup(renewed(rs).groupBy(*keys, "_piece")).applyInPandas(
            run, schema)
    else:
        found = _pruned_top_k(lt, rt, k, metric, keys, rows, n_left, n_right, dim, exclude is not None, skip_self, run,
                              schema)
    nearest = Window.partitionBy("src").orderBy(F.desc("score"), F.asc("dst"))
    ranked = found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    score = F.col("score") if metric == "cosine" else -F.col("score")
    extra = [F.col("carried").alias(f"dst_{carry}")] if carry else []
    return ranked.select("src", "dst", "rank", score.alias("score"), *extra)


def _by_tiles(lb: DataFrame, rb: DataFrame, keys: Sequence[str], tile: int, run, schema: str, exclude: bool) -> DataFrame:
    """Every pair of tiles with equal keys meets, but for two tiles of one group that may not meet itself (``exclude``)."""
    crowds = _crowds(rb, keys, tile) if exclude else None
    left, right = (_keyed(cut_lineage(_tiles(side, keys, tile, crowds)), prefix, keys) for side, prefix in ((lb, "l"), (rb, "r")))
    lkeys, rkeys = ["l_cell", "l_sub"], ["r_cell", "r_sub"]
    ends = [left.select(*keys, *lkeys).distinct(), right.select(*keys, *rkeys).distinct()]
    every = ends[0].join(ends[1], list(keys)) if keys else ends[0].crossJoin(ends[1])
    every = every.where((F.col("l_cell") != F.col("r_cell")) | (F.col("l_cell") == 0))
    return _meet(left, right, cut_lineage(every), lkeys, rkeys, keys, run, schema)


def _pruned_top_k(lt, rt, k, metric, keys, rows, n_left, n_right, dim, exclude, skip_self, run,
                  schema) -> DataFrame:
    # Of rows with the same vector and group, only the first k + 1 can be among anybody's best k.
    copy = Window.partitionBy(*keys, "_v", "_x").orderBy("_id")
    useful = rt.withColumn("_copy", F.row_number().over(copy)).where(F.col("_copy") <= k + 1).drop("_copy")
    tile = tile_rows(lt, max(n_left, n_right), dim)
    held, leaves = 1, leaf_count(n_right, rows, dim)
    if keys:
        # Where a few calls for each cell of each key would cost more than all pairs within the keys, no cells are made.
        pairs, held = _pairs_in_keys(lt, rt, keys)
        tile = keyed_tile_rows(lt, pairs, tile)
        if pairs < leaves * held * SEED_CELLS * PAIRS_A_CALL:
            return _by_tiles(lt, useful, keys, tile, run, schema, exclude)
        leaves = keyed_leaf_count(n_right, pairs / max(n_left, 1), rows, dim)
    pivots = _pivots(rt, leaves, metric)
    rb = cut_lineage(_with_blocks(_with_cells(useful, pivots, metric), [*keys, "_cell"], rows))
    radii = _radii(rb, pivots)
    a_key = max(n_left, n_right) / max(held, 1)
    if _is_dense(_least_needed(lt, rb, n_left, pivots, radii, k, metric, keys, exclude, skip_self), radii, a_key, dim, tile):
        return _by_tiles(lt, rb, keys, tile, run, schema, exclude)
    lb = cut_lineage(_with_blocks(_with_cells(lt, pivots, metric), [*keys, "_cell"], rows))
    left, right = _keyed(lb, "l", keys), _keyed(rb, "r", keys)
    lkeys, rkeys = ["l_cell", "l_sub"], ["r_cell", "r_sub"]
    rblocks = right.select(*keys, *rkeys).distinct()

    # First the block a row lives in and one block of each of the cells around it: they give a bound on the
    # k-th distance even where a whole cell is excluded.
    lblocks = left.select(*keys, *lkeys).distinct()
    leaves = pivots.leaves
    around = np.concatenate([np.argsort(_distances(leaves[i:i + 256], leaves), axis=1, kind="stable")[:, :SEED_CELLS]
                             for i in range(0, len(leaves), 256)])
    beside = F.broadcast(lt.sparkSession.createDataFrame(
        [(i, int(j)) for i, row in enumerate(around) for j in row if i != j] or [(-1, -1)], "l_cell int, r_cell int"))
    own = lblocks.withColumns({"r_cell": F.col("l_cell"), "r_sub": F.col("l_sub")})
    other = lblocks.join(beside, "l_cell").withColumn("r_sub", F.lit(0)).select(*own.columns)
    home = cut_lineage(own.unionByName(other).join(rblocks, [*keys, *rkeys], "left_semi"))
    near = cut_lineage(_meet(left, right, home, lkeys, rkeys, keys, run, schema))
    ranked = F.sort_array(F.collect_list("score"), asc=False)  # at most k from each of a few blocks
    worst = near.groupBy("src").agg(F.count(F.lit(1)).alias("_found"), F.try_element_at(ranked, F.lit(k)).alias("_worst"))
    distance = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("_worst"))) if metric == "cosine" else F.sqrt(
        -F.col("_worst"))
    # the error of a squared distance grows with the squared norms
    scale = F.lit(1.0) if metric == "cosine" else 1 + F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    seen = F.col("_found") >= k
    bounded = lb.join(worst.withColumnRenamed("src", "_id"), "_id", "left")
    if exclude and not keys:
        # where a row's own surroundings belong to its group, radii alone still bound the k-th distance
        bounded = cut_lineage(bounded.where(seen).withColumn("_sure", F.lit(None).cast("double")).unionByName(
            bounded.where(~F.coalesce(seen, F.lit(False))).withColumn("_sure", _sure_reach(lb, pivots, radii, metric, k))))
        unseen = F.col("_sure") + scale * 1e-4
    else:
        unseen = F.lit(float("inf"))
    reach = F.when(seen, distance + scale * 1e-4).otherwise(unseen)
    needed = _needed(bounded, n_left, pivots, radii, metric, reach)
    if _is_dense(needed, radii, a_key, dim, tile) or (keys and _are_slivers(left, right, keys, needed)):
        return _by_tiles(lb, rb, keys, tile, run, schema, exclude)
    wanted = bounded.select(
        *keys, F.col("_cell").alias("l_cell"), F.col("_sub").alias("l_sub"),
        F.explode(_cells_within(lb, pivots, radii, metric, reach)).alias("r_cell"),
    ).distinct()
    pairs = wanted.join(rblocks, [*keys, "r_cell"]).join(renewed(home), [*keys, *lkeys, *rkeys], "left_anti")
    far = _meet(left, right, pairs, lkeys, rkeys, keys, run, schema)
    return near.unionByName(far)


# ---- near duplicates ------------------------------------------------------------------------------

def _linked(lm: np.ndarray, rm: np.ndarray, threshold: float):
    """Pieces of the pairs with cosine >= ``threshold`` of two blocks of unit vectors: places on both sides, scores."""
    ls, rs = Short.of(lm), Short.of(rm)
    room = np.empty(ROWS_AT_ONCE * COLUMNS_AT_ONCE, np.float32)
    for at in range(0, len(lm), ROWS_AT_ONCE):
        rows = slice(at, at + ROWS_AT_ONCE)
        for start in range(0, len(rm), COLUMNS_AT_ONCE):
            cols = slice(start, start + COLUMNS_AT_ONCE)
            if ls.sound and rs.sound:
                i, j = _candidates(ls.part(rows), rs.part(cols), threshold, "cosine", room)
            else:
                i, j = np.nonzero(lm[rows] @ rm[cols].T >= threshold - ROUNDING)
            score = _scores_of(lm[rows], rm[cols], i, j, "cosine")
            good = score >= threshold
            yield at + i[good], start + j[good], score[good]


def _block_pairs(threshold: float):
    """Cogroup function: every pair ``src < dst`` of the two blocks at or above the threshold."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = [_no_edges(left["_id"])]
        if len(left) and len(right):
            lm, rm = _unit(_matrix(left["_v"])), _unit(_matrix(right["_v"]))
            lid, rid = left["_id"].to_numpy(), right["_id"].to_numpy()
            own_block = left["l_cell"].iloc[0] == right["r_cell"].iloc[0] and (
                left["l_core"].iloc[0] == right["r_core"].iloc[0]) and (
                left["l_sub"].iloc[0] == right["r_sub"].iloc[0])
            for i, j, score in _linked(lm, rm, threshold):
                a, b = lid[i], rid[j]
                if own_block:
                    hit = a < b
                    a, b, score = a[hit], b[hit], score[hit]
                if len(a):
                    parts.append(pd.DataFrame({"src": np.minimum(a, b), "dst": np.maximum(a, b), "score": score}))
        return pd.concat(parts)

    return run


def _join_roots(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Make ``root`` (the smallest vertex that each is joined to) hold for the links ``u - v`` too."""
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return
        u, v = u[apart], v[apart]
        high, low = np.maximum(a, b)[apart], np.minimum(a, b)[apart]
        order = np.lexsort((low, high))
        first = np.unique(high[order], return_index=True)[1]
        root[high[order][first]] = low[order][first]  # roots only, each to a smaller one
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def _block_forest(threshold: float):
    """Cogroup function: links (root, member) that connect exactly what the block's pairs connect."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return _no_edges(left["_id"])
        lm, rm = _unit(_matrix(left["_v"])), _unit(_matrix(right["_v"]))
        lid, rid = left["_id"].to_numpy(), right["_id"].to_numpy()
        ids, place = np.unique(np.concatenate([lid, rid]), return_inverse=True)  # in order, whatever their type
        lroot, rroot = place[:len(lid)].copy(), place[len(lid):].copy()
        root = np.arange(len(ids))
        for i, j, _ in _linked(lm, rm, threshold):
            _join_roots(root, lroot[i], rroot[j])
        lroot, rroot = root[lroot], root[rroot]
        roots = np.concatenate([lroot, rroot])
        linked = place != roots
        links = pd.DataFrame({"src": ids[roots[linked]], "dst": ids[place[linked]]}).drop_duplicates()
        return links.assign(score=threshold)

    return run


def links_of_pairs(pairs: DataFrame) -> DataFrame:
    """``src, dst``: links with the connected components of ``pairs``, at most one for each member within a piece of a
    partition. For callers that need the pairs as well, so that vectors are compared once."""
    kind = pairs.schema["src"].dataType.simpleString()

    def thinned(frames: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(frames)
        ids, place = np.unique(np.concatenate([rows["src"].to_numpy(), rows["dst"].to_numpy()]), return_inverse=True)
        root = np.arange(len(ids))
        _join_roots(root, place[:len(rows)], place[len(rows):])
        linked = root != np.arange(len(ids))
        return pd.DataFrame({"src": ids[root[linked]], "dst": ids[linked]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for frame in frames:
            held.append(frame)
            n += len(frame)
            if n >= LINKS_AT_ONCE:
                held = [thinned(held)]
                n = len(held[0])
                if n > LINKS_AT_ONCE // 2:
                    yield held.pop()
                    n = 0
        if n:
            yield thinned(held)

    return pairs.select("src", "dst").mapInPandas(run, f"src {kind}, dst {kind}")


def _near_dup(df: DataFrame, threshold: float, id_col: str, vec: str, block_rows: int | None,
              forest: bool) -> DataFrame:
    every = _standard(df, id_col, vec)
    n, dim = _shape(every)
    rows = min(block_rows or default_block_rows(df, n, dim), 4096 if forest else 1 << 20)
    run = _block_forest(threshold) if forest else _block_pairs(threshold)
    schema = edge_schema(every)
    # Copies of one vector are linked to the smallest id and take no further part.
    distinct = every.groupBy("_v").agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("_copies"),
                                       F.min("_x").alias("_x"), F.min("_c").alias("_c"))
    if n > rows:
        distinct = cut_lineage(distinct)
    shared = distinct.where(F.col("_copies") > 1).select("_v", F.col("_id").alias("src"))
    links = salted_join(every, shared, ["_v"], spread=["_id"], rows=n).where(
        F.col("src") != F.col("_id")).select("src", F.col("_id").alias("dst"), F.lit(1.0).alias("score"))
    if not forest:
        shared_ids = shared.select("src", F.col("src").alias("dst")).unionByName(links.select("src", "dst"))
    if n <= rows:
        only = distinct.withColumns({"_cell": F.lit(0), "_core": F.lit(False), "_sub": F.lit(0)})
        sides = [renewed(_keyed(only, side, (), ["_core"])) for side in "lr"]
        found = sides[0].groupBy("l_cell").cogroup(sides[1].groupBy("r_cell")).applyInPandas(run, schema)
        return found.unionByName(links) if forest else _expanded(found, shared_ids)
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    # Rows this close to their pivot are all near-duplicates of each other.
    core_radius = 2 * math.sin(math.acos(max(-1.0, min(1.0, threshold))) / 4) - SLACK if threshold > 0 else -1.0
    pivots = _pivots(distinct, leaf_count(n, rows, dim), "cosine", core_radius if forest else 0.0)
    placed = _with_cells(distinct, pivots, "cosine").withColumn(
        "_core", (F.col("_r") <= core_radius) if forest else F.lit(False))
    blocks = cut_lineage(_with_blocks(placed, ["_cell", "_core"], rows))
    radii = _radii(blocks, pivots)
    lkeys, rkeys = ["l_cell", "l_core", "l_sub"], ["r_cell", "r_core", "r_sub"]
    tile = tile_rows(df, n, dim)
    if _is_dense(_needed(blocks, n, pivots, radii, "cosine", F.lit(reach)), radii, n, dim, tile):
        tiles = _tiles(blocks.withColumn("_core", F.lit(False)), (), tile)
        tiles = cut_lineage(tiles)
        left, right = _keyed(tiles, "l", (), ["_core"]), _keyed(tiles, "r", (), ["_core"])
        every = left.select(*lkeys).distinct().crossJoin(right.select(*rkeys).distinct()).where("l_sub <= r_sub")
        found = _meet(left, right, cut_lineage(every), lkeys, rkeys, (), run, schema)
        return found.unionByName(links) if forest else _expanded(found, shared_ids)
    left, right = _keyed(blocks, "l", (), ["_core"]), _keyed(blocks, "r", (), ["_core"])
    wanted = blocks.select(
        F.col("_cell").alias("l_cell"), F.col("_core").alias("l_core"), F.col("_sub").alias("l_sub"),
        F.explode(_cells_within(blocks, pivots, radii, "cosine", F.lit(reach))).alias("r_cell"),
    ).distinct()
    rblocks = right.select(*rkeys).distinct()
    pairs = wanted.join(rblocks, "r_cell").where(
        F.struct("l_cell", "l_core", "l_sub") <= F.struct("r_cell", "r_core", "r_sub"))
    if forest:
        # Inside a core everything is linked already, so its own pairs of blocks are skipped.
        pairs = pairs.where(~((F.col("l_cell") == F.col("r_cell")) & F.col("l_core") & F.col("r_core")))
        roots = blocks.where("_core").groupBy("_cell").agg(F.min("_id").alias("src"))
        core_links = blocks.where("_core").join(F.broadcast(roots), "_cell").where(
            F.col("src") != F.col("_id")).select("src", F.col("_id").alias("dst"),
                                                 F.lit(threshold).alias("score"))
        links = links.unionByName(core_links)
    found = _meet(left, right, pairs, lkeys, rkeys, (), run, schema)
    return found.unionByName(links) if forest else _expanded(found, shared_ids)


def _expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs between representatives as pairs between all their members (``members``: src, dst = member)."""
    own = cut_lineage(members)
    a = renewed(own).toDF("src", "_a")
    b = renewed(own).toDF("dst", "_b")
    spread = pairs.join(a, "src", "left").join(b, "dst", "left").select(
        F.coalesce("_a", "src").alias("x"), F.coalesce("_b", "dst").alias("y"), "score").select(
        F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"), "score")
    alike = a.join(renewed(own).toDF("src", "_b"), "src").where("_a < _b").select(
        F.col("_a").alias("src"), F.col("_b").alias("dst"), F.lit(1.0).alias("score"))
    return spread.unionByName(alike)


def near_dup_pairs(df: DataFrame, threshold: float = 0.98, id_col: str = "id", vec: str = "embedding",
                   block_rows: int | None = None) -> DataFrame:
    """``src < dst, score``: all pairs of rows with cosine >= ``threshold``, copies of a vector included.
    The list is the result, so it grows with the square of a group; use links for grouping."""
    return _near_dup(df, threshold, id_col, vec, block_rows, forest=False)


def near_dup_links(df: DataFrame, threshold: float = 0.98, id_col: str = "id", vec: str = "embedding",
                   block_rows: int | None = None) -> DataFrame:
    """Links with the same connected components as :func:`near_dup_pairs`, but never more than the
    size of the two blocks per pair of blocks. Use these for grouping: a cluster of near copies costs
    one link per row, not one per pair."""
    return _near_dup(df, threshold, id_col, vec, block_rows, forest=True)

