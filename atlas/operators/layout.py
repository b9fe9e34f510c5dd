"""Section maps: projection, packing, and the map built from them.

Every section takes the same steps, as joins over its own rows, so none has to fit a worker.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atlas.functions import labels as L
from atlas.functions import vectors as V
from atlas.operators import geometry as G
from atlas.operators.neighbours import top_k
from atlas.operators.skew import salted_join
from atlas.operators.spectral import neighbour_graph, spectral_2d
from atlas.session import cut_lineage

# Fixed values of the section layout.
PACK_BASE = 0.48
TINY = 6
RECALL_K = 10
RECALL_MIN_ROWS = 30

PACK_ROUNDS = 6  # separation steps of a map


# ---- projection -----------------------------------------------------------------------------------

def pca_axes(df: DataFrame, by: Sequence[str], vec: str = "embedding") -> DataFrame:
    """``by, n, w1, w2, c1, c2``: the two leading directions of each section's z-scored vectors, folded with
    mean and scale, so that a projection is ``dot(x, w) - c``.

    One pass sums the second moments per partition; the partial matrices are added row by row, and a
    task only sees the ``dim`` rows of one section's matrix.
    """
    by = list(by)
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}

        def flush():
            parts = [
                pd.DataFrame({**{c: [k] * len(m[1]) for c, k in zip(by, key)}, "i": np.arange(len(m[1])),
                              "n": float(m[0]), "s": m[1], "row": list(m[2])})
                for key, m in held.items()
            ]
            held.clear()
            return parts

        for pdf in frames:
            for key, part in pdf.groupby(by, dropna=False):
                x = np.stack(part[vec].to_numpy()).astype(np.float64)
                key = key if isinstance(key, tuple) else (key,)
                entry = held.setdefault(key, [0, np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2)])
                entry[0] += len(x)
                entry[1] += x.sum(axis=0)
                entry[2] += x.T @ x
            if len(held) > 64:
                yield from flush()
        yield from flush()

    partial = df.select(*by, vec).mapInPandas(moments, f"{kinds}, i int, n double, s double, row array<double>")
    rows = partial.groupBy(*by, "i").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"),
        vector_to_array(Summarizer.sum(array_to_vector(F.col("row")))).alias("row"))

    def axes(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        n, mean = pdf["n"].iloc[0], (pdf["s"] / pdf["n"]).to_numpy()
        cov = np.stack(pdf["row"].to_numpy()) / n - np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(cov), 0))
        scale[scale < 1e-6] = 1.0
        _, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
        out = {c: [pdf[c].iloc[0]] for c in by} | {"n": [int(n)]}
        for j in (1, 2):
            u = vectors[:, -min(j, len(mean))]
            u = u * np.sign(u[np.abs(u).argmax()])
            out |= {f"w{j}": [u / scale], f"c{j}": [float((u / scale) @ mean)]}
        return pd.DataFrame(out)

    return rows.groupBy(*by).applyInPandas(
        axes, f"{kinds}, n long, w1 array<double>, c1 double, w2 array<double>, c2 double")


def pca_2d(df: DataFrame, by: Sequence[str], vec: str = "embedding", id_col: str = "id",
           rows: int | None = None) -> DataFrame:
    """Each row's position on its section's two leading directions: adds ``x``, ``y`` and ``n``."""
    model = pca_axes(df, by, vec)
    joined = salted_join(df, model, list(by), spread=[id_col], rows=rows)
    return joined.withColumns({
        "x": V.dot(F.col(vec), F.col("w1")) - F.col("c1"),
        "y": V.dot(F.col(vec), F.col("w2")) - F.col("c2"),
    }).drop("w1", "w2", "c1", "c2")


# ---- layout -------------------------------------------------------------------------------------------

def layout(df: DataFrame, by: Sequence[str] = ("section",), vec: str = "embedding", pack: bool = False,
           rounds: int = PACK_ROUNDS, neighbours: bool = False, block_rows: int | None = None) -> DataFrame:
    """2-D position of every row within its section: ``by, id, x, y, method``.

    A section of any size is projected on its two leading directions, or with ``neighbours`` placed by the smoothest
    directions of its neighbour graph, which begin at that projection; one of at most ``TINY`` rows sits on a small
    disc instead, a single row in the centre. ``pack=False`` gives the unit box; ``pack=True`` blows it up to the
    side its rows need, deals rows at one place over a disc, and then moves close rows apart, ``rounds`` times.
    ``method`` says which rule placed a row (centre, disc, projected, neighbours).
    """
    by = list(by)
    total = df.count()
    start = cut_lineage(G.unit_box(pca_2d(df, by, vec, rows=total), by, rows=total).select(*by, "id", "n", "x", "y"))
    if neighbours:
        start = cut_lineage(_by_neighbours(df, start, by, vec, total, block_rows))
    side = 2 * PACK_BASE * F.sqrt("n") * G.MIN_DIST if pack else F.lit(1.0)
    shift = F.lit(0.5) if pack else F.lit(0.0)
    rest = start.where(F.col("n") > TINY).select(
        *by, "id", ((F.col("x") - shift) * side).alias("x"), ((F.col("y") - shift) * side).alias("y"))
    if pack:
        rest = cut_lineage(_spread(rest, by))
    for at in range(rounds if pack else 0):
        rest = G.separate_once(rest, by=by)
        if at % 2 or at == rounds - 1:
            rest = cut_lineage(rest)

    turn = _number(start.where(F.col("n") <= TINY), by).withColumn("_d", L.sunflower(F.col("at") - 1, F.col("n"), 0.5))
    centre = F.col("n") == 1
    tiny = turn.select(
        *by, "id", (F.when(centre, 0.0).otherwise(F.col("_d.x")) * side + 0.5 - shift).alias("x"),
        (F.when(centre, 0.0).otherwise(F.col("_d.y")) * side + 0.5 - shift).alias("y"),
        F.when(centre, "centre").otherwise("disc").alias("method"))
    method = F.lit("neighbours" if neighbours else "projected").alias("method")
    return rest.select(*by, "id", "x", "y", method).unionByName(tiny)


def _by_neighbours(df: DataFrame, start: DataFrame, by: list[str], vec: str, rows: int,
                   block_rows: int | None) -> DataFrame:
    """``start`` with the places that the neighbour graph gives to sections above ``TINY`` rows.

    Copies of a vector are one vertex, their smallest id, so a pile of them is no hub. Two digests of 64 bits tell
    vectors apart. A section of copies alone has no links and keeps its place.
    """
    print_of = [F.xxhash64(vec).alias("_h"), F.xxhash64(F.lit(1), vec).alias("_g")]
    marked = cut_lineage(df.select(*by, "id", *print_of))
    firsts = marked.groupBy(*by, "_h", "_g").agg(F.min("id").alias("_first"))
    named = salted_join(marked, firsts, [*by, "_h", "_g"], spread=["id"], rows=rows).select(*by, "id", "_first")
    large = start.where(F.col("n") > TINY).select(*by, "id", "x", "y")
    only = df.select(*by, "id", vec).join(named.where("id = _first").select("id"), "id", "left_semi").join(
        large.select("id"), "id", "left_semi")
    found = G.unit_box(spectral_2d(neighbour_graph(only, by, vec=vec, block_rows=block_rows), by, start=large), by, rows=rows)
    spots = found.select(*by, F.col("id").alias("_first"), F.struct("x", "y").alias("_p"))
    return salted_join(start.join(named, [*by, "id"]), spots, [*by, "_first"], "left", spread=["id"], rows=rows).select(
        *by, "id", "n", F.coalesce("_p.x", "x").alias("x"), F.coalesce("_p.y", "y").alias("y"))


def _spread(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows at one place, such as copies of a vector, dealt by digests of their ids over a disc that has room
    for them; the separation steps have no direction for them."""
    at = [F.round("x", 4).alias("_x"), F.round("y", 4).alias("_y")]
    piles = df.groupBy(*by, *at).agg(F.count(F.lit(1)).alias("_w")).where("_w > 1")
    joined = salted_join(df.withColumns({"_x": F.round("x", 4), "_y": F.round("y", 4)}), piles,
                         [*by, "_x", "_y"], "left", spread=["id"])
    angle = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) * (2 * np.pi / (1 << 30))
    share = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) / (1 << 30)
    far = F.when(F.col("_w") > 1, G.MIN_DIST / 2 * F.sqrt(F.col("_w") * share)).otherwise(0.0)
    return joined.withColumns({"x": F.col("x") + far * F.cos(angle), "y": F.col("y") + far * F.sin(angle)}).drop(
        "_x", "_y", "_w")


def _number(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Number the rows of sections of at most ``TINY`` rows."""
    return df.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy("id")))


# ---- the whole map --------------------------------------------------------------------------------

def build_map(items: DataFrame, by: Sequence[str] = (), section: str = "section", vec: str = "embedding",
              rounds: int = PACK_ROUNDS, neighbours: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(nodes, sections)`` of one map, or of one map per ``by`` key. ``neighbours``: as in :func:`layout`.

    Nodes carry position, home, colour, section id and relative position; the section table carries
    size, colour and centre, largest first.
    """
    by = list(by)
    keys = [*by, section]
    packed = layout(items.select(*keys, "id", vec), keys, vec, pack=True, rounds=rounds, neighbours=neighbours)
    packed = cut_lineage(packed)
    total = packed.count()
    offsets = cut_lineage(G.centre(packed, keys, rows=total))
    radii = G.blob_radius(offsets, keys, rows=total)
    centres = G.arrange_sections(radii.withColumnRenamed(section, "name"), by=by)
    sections = centres.join(radii.select(*by, F.col(section).alias("name"), "n"), [*by, "name"])
    sections = cut_lineage(sections)
    rel = G.unit_box(offsets, keys, rows=total).select("id", F.col("x").alias("rel_x"), F.col("y").alias("rel_y"))
    at = sections.select(*by, F.col("name").alias(section), "cx", "cy")
    placed = salted_join(offsets, at, keys, spread=["id"], rows=total).withColumns(
        {"x": F.col("cx") + F.col("x"), "y": F.col("cy") + F.col("y")}).drop("cx", "cy")
    nodes = items.drop(vec, *keys).join(placed.join(rel, "id"), "id").withColumns({
        "home_x": F.col("x"), "home_y": F.col("y"), "color": L.label_colour(F.col(section)),
        "section_id": L.label_id(F.col(section)),
    })
    last = F.when(F.col("name") == L.MAP_UNSORTED, 1).otherwise(0)
    summary = sections.withColumn("color", L.label_colour(F.col("name"))).orderBy(
        *by, F.desc("n"), last, "name")
    return nodes, summary


def section_order(sections: DataFrame, name: str = "name") -> DataFrame:
    """Alphabetical, with Unsorted last."""
    return sections.orderBy(F.when(F.col(name) == L.MAP_UNSORTED, 1).otherwise(0), name)


def recall_base(high: DataFrame, by: Sequence[str] = ("section",), k: int = RECALL_K, min_rows: int = RECALL_MIN_ROWS,
                block_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(rows, neighbours)`` in the vectors of ``high``, computed once: for :func:`knn_recall` of several layouts."""
    by = list(by)
    sizes = high.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows)
    kept = salted_join(high, sizes, by, spread=["id"])
    near = top_k(kept, k=k, metric="sqeuclid", by=by, block_rows=block_rows).select("src", "dst")
    return cut_lineage(kept.select(*by, "id", "n")), cut_lineage(near)


def knn_recall(high: DataFrame, low: DataFrame, by: Sequence[str] = ("section",), k: int = RECALL_K,
               min_rows: int = RECALL_MIN_ROWS, block_rows: int | None = None,
               base: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Share of each row's ``k`` neighbours in the vectors of ``high`` that ``low`` (id, x, y) keeps, per
    section of at least ``min_rows`` rows, next to the random baseline ``k / n``. ``base``: :func:`recall_base` of
    ``high`` with the same settings, where the caller has it."""
    by = list(by)
    kept, near = base or recall_base(high, by, k, min_rows, block_rows)
    flat = cut_lineage(kept.select(*by, "id").join(G.as_vector(low.select("id", "x", "y")), "id"))
    b = top_k(flat, k=k, metric="sqeuclid", by=by, block_rows=block_rows)
    same = near.join(b.select("src", "dst"), ["src", "dst"]).groupBy("src").agg(
        F.count(F.lit(1)).alias("hits"))
    rows = kept.select(*by, "n", F.col("id").alias("src")).join(same, "src", "left")
    share = F.coalesce("hits", F.lit(0)) / F.lit(k)
    return rows.groupBy(*by, "n").agg(F.avg(share).alias("recall")).withColumn("random", F.lit(k) / F.col("n"))
