"""Leakage groups, grouped folds and their audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlas.operators.skew import positions, salted_join
from atlas.session import cut_lineage

SLICE_DIGITS = 4  # hexadecimal digits that cut an order by digest into pieces


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``id, component`` (the smallest member) for every vertex that has an edge ``src - dst``.

    Each round takes the smallest label among the neighbours and then the label of that label, so the
    number of rounds grows with the logarithm of the longest path. The loop runs on the driver and
    sees one number per round; labels are checkpointed in the shared folder. Hub vertices and the
    label of a giant component are salted.
    """
    pair = edges.where(F.col("src") != F.col("dst")).select("src", "dst")
    both = cut_lineage(pair.unionByName(pair.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
                       .distinct())
    n = both.count()
    labels = both.groupBy(F.col("src").alias("id")).agg(
        F.min(F.least("src", "dst")).alias("component"))
    labels = cut_lineage(labels)
    for _ in range(max_rounds):
        near = salted_join(both, labels.select(F.col("id").alias("dst"), "component"), ["dst"],
                           spread=["src"], rows=n)
        lowest = near.groupBy(F.col("src").alias("id")).agg(F.min("component").alias("_near"))
        step = labels.join(lowest, "id").select(
            "id", F.col("component").alias("_old"), F.least("component", "_near").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("_next"))
        fresh = salted_join(step, jump, ["component"], spread=["id"], rows=n).select(
            "id", "_old", F.least("component", "_next").alias("component"))
        fresh = cut_lineage(fresh)
        labels = fresh.select("id", "component")
        if fresh.where(F.col("component") != F.col("_old")).isEmpty():
            return labels
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")


def leakage_groups(df: DataFrame, links: DataFrame, folder: str = "folder", id_col: str = "id") -> DataFrame:
    """``id, group_id``: components of (same folder, or near duplicate).

    A folder is one vertex, its smallest id, so its members never become edges; links between rows
    shrink to distinct links between folders before the iteration starts.
    """
    links = cut_lineage(links.select("src", "dst"))
    lead = df.groupBy(folder).agg(F.min(id_col).alias("_lead"))
    member = cut_lineage(
        salted_join(df.select(F.col(id_col).alias("id"), folder), lead, [folder], spread=["id"])
        .select("id", "_lead"))
    n_rows, n_links = member.count(), links.count()
    a = member.select(F.col("id").alias("src"), F.col("_lead").alias("a"))
    b = member.select(F.col("id").alias("dst"), F.col("_lead").alias("b"))
    one = salted_join(links, a, ["src"], spread=["dst"], rows=n_links)
    two = salted_join(one, b, ["dst"], spread=["src"], rows=n_links)
    bridges = two.where(F.col("a") != F.col("b")).select(
        F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
    merged = components(bridges).withColumnRenamed("id", "_lead")
    return salted_join(member, merged, ["_lead"], "left", spread=["id"], rows=n_rows).select(
        "id", F.coalesce("component", "_lead").alias("group_id"))


def group_kfold(df: DataFrame, k: int = 5, group: str = "group_id") -> DataFrame:
    """Add ``fold``: groups stay whole, and go to the folds by size, back and forth.

    Groups are numbered by (size descending, digest of the id) through slices of equal size and the same
    first digits, so even billions of single-row groups are never sorted in one task, whatever their ids.
    """
    mix = F.md5(F.col(group).cast("string"))
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_rows"))
    ranked = positions(
        sizes, by=[], slices=[-F.col("_rows"), F.substring(mix, 1, SLICE_DIGITS)], order=[mix, F.col(group)],
        out="_at")
    zero = F.col("_at") - 1
    ahead, lap = zero % k, F.floor(zero / k)
    fold = F.when(lap % 2 == 0, ahead).otherwise(k - 1 - ahead).cast("int")
    return salted_join(df, ranked.select(group, fold.alias("fold")), [group], spread=df.columns)


def train_view(df: DataFrame, fold: int, train_label: str = "train_label") -> DataFrame:
    """Rows outside the test fold under their (possibly corrected) training label."""
    return df.where(F.col("fold") != fold).withColumn("label", F.col(train_label))


def test_view(df: DataFrame, fold: int, is_aug: str = "is_aug") -> DataFrame:
    """Real rows of the fold under their original label; augmented rows are never tested on."""
    return df.where((F.col("fold") == fold) & ~F.col(is_aug))


def shuffle_labels(df: DataFrame, seed: int = 0, id_col: str = "id", label: str = "label") -> DataFrame:
    """The same labels in a seeded random order over the rows: ``id, label, shuffled``.

    Row i by one digest of its id receives the label of row i by another. Both numberings run over slices.
    """
    own = F.md5(F.col(id_col).cast("string"))
    mix = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    by_id = positions(df.select(id_col, label), [], [F.substring(own, 1, SLICE_DIGITS)], [own, F.col(id_col)], "_at")
    by_hash = positions(
        df.select(F.col(label).alias("shuffled"), mix.alias("_mix"), id_col), [],
        [F.substring("_mix", 1, SLICE_DIGITS)], [F.col("_mix"), F.col(id_col)], "_at")
    return by_id.join(by_hash.select("_at", "shuffled"), "_at").drop("_at")


def leakage_audit(df: DataFrame, pairs: DataFrame | None = None, group: str = "group_id",
                  id_col: str = "id") -> DataFrame:
    """One row: groups, groups in more than one fold, and near-duplicate pairs across folds."""
    spread = df.groupBy(group).agg(F.min("fold").alias("lo"), F.max("fold").alias("hi"))
    result = spread.agg(F.count(F.lit(1)).alias("groups"),
                        F.count_if(F.col("lo") != F.col("hi")).alias("crossing_groups"))
    if pairs is None:
        return result
    a = df.select(F.col(id_col).alias("src"), F.col("fold").alias("fa"))
    b = df.select(F.col(id_col).alias("dst"), F.col("fold").alias("fb"))
    met = salted_join(salted_join(pairs.select("src", "dst"), a, ["src"], spread=["dst"]), b, ["dst"],
                      spread=["src"])
    crossing = met.agg(F.count_if(F.col("fa") != F.col("fb")).alias("n")).scalar()
    return result.withColumn("crossing_pairs", crossing)
