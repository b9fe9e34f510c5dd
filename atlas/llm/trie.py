"""Prefix trie of conversations by time-forward processing (operator 13).

A node is a distinct sequence of first turns. Sums of digests of (place, turn) name it: they run along a
conversation in slices, so the trie takes shape from aggregations alone. What a node passes to its parent (leaves
and saved characters) is summed by time-forward processing: nodes in reverse level order, each taking what its
children have left for it in a priority queue and leaving its own total for its parent.

A shard holds the nodes of ``WIDTH`` neighbouring owners (a node's owner is its smallest conversation) in ``DEPTH``
neighbouring levels, so it is bounded whatever the data: a first turn shared by a third of all conversations, or a
conversation of a third of all turns, spreads over many shards. Spark's external sort brings each shard into reverse
level order. Nodes whose parents lie elsewhere are shard roots. Their totals go up the much smaller tree of shard
roots in doubling steps (after k steps a root holds what lies less than 2^k roots below), are left for the nodes
they hang on, and a second run within the shards completes every node.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from hashlib import sha256
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlas.llm.ordering import in_order, places
from atlas.session import cut_lineage

HEADS = 6  # a conversation takes fewer than so many turns from its base
GROUP = 100  # conversations that share a base
SLICE = 4096  # turns of a conversation that are summed together
WIDTH, DEPTH = 1024, 64  # owners and levels of a shard
QUEUE = 1 << 14  # messages that a queue holds in memory
ENDS = 4096  # neighbouring ids that are joined before they are hashed
PARTS = ("_a", "_b", "_c", "_d")


class SpillingQueue:
    """A priority queue of tuples. Beyond ``limit`` entries, a sorted run goes to a file that has no name, in the
    folder that Spark gives its Python workers to spill; it vanishes with the task."""

    def __init__(self, limit: int = QUEUE):
        self.limit, self.heap, self.fronts, self.runs = limit, [], [], []

    def push(self, item: tuple) -> None:
        heappush(self.heap, item)
        if len(self.heap) > self.limit:
            file = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
            for entry in sorted(self.heap):
                pickle.dump(entry, file)
            file.seek(0)
            self.heap = []
            self.runs.append(file)
            self._advance(len(self.runs) - 1)

    def _advance(self, run: int) -> None:
        try:
            heappush(self.fronts, (pickle.load(self.runs[run]), run))
        except EOFError:
            self.runs[run].close()

    def peek(self) -> tuple | None:
        if self.fronts and (not self.heap or self.fronts[0][0] < self.heap[0]):
            return self.fronts[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.fronts and (not self.heap or self.fronts[0][0] < self.heap[0]):
            item, run = heappop(self.fronts)
            self._advance(run)
            return item
        return heappop(self.heap)


def _rows(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def pass_up(batches, limit: int = QUEUE):
    """Totals of nodes within their shards, and the shard root above each.

    Takes rows ``wide, slab, depth, key, parent, inside, leaves, saved`` sorted by shard, then depth descending,
    then key. A message lies in the queue under the place of its receiver in that order.
    """
    queue, shard, seen, rank = SpillingQueue(limit), None, [], 0

    def finish():
        root: dict[str, str] = {}
        for key, parent, inside, leaves, saved in reversed(seen):  # parents first
            root[key] = root[parent] if inside else key
        for start in range(0, len(seen), 1 << 13):
            part = seen[start:start + (1 << 13)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in part], pa.string()), pa.array([root[p[0]] for p in part], pa.string()),
                 pa.array([p[3] for p in part], pa.int64()), pa.array([p[4] for p in part], pa.int64())],
                ["key", "root", "leaves", "saved"])

    for wide, slab, depth, key, parent, inside, leaves, saved in _rows(batches):
        if (wide, slab) != shard:
            yield from finish()
            shard, seen, rank = (wide, slab), [], rank + 1
        place = (rank, -depth, key)
        while (top := queue.peek()) is not None and top[:3] == place:
            message = queue.pop()
            leaves += message[3]
            saved += message[4]
        if inside:
            queue.push((rank, 1 - depth, parent, leaves, saved))
        seen.append((key, parent, inside, leaves, saved))
    yield from finish()


def within_shards(nodes: DataFrame) -> DataFrame:
    """``key, root, leaves, saved``: totals below each node in its shard."""
    shard = ["wide", "slab"]
    return nodes.select(*shard, "depth", "key", "parent", "inside", "leaves", "saved").repartition(*shard).sortWithinPartitions(
        *shard, F.desc("depth"), "key").mapInArrow(pass_up, "key string, root string, leaves long, saved long")


def across_roots(roots: DataFrame) -> DataFrame:
    """``key, leaves, saved`` of everything below each root, from ``key, above, leaves, saved``; ``above`` is the
    next root upwards, or null."""
    held = cut_lineage(roots)
    while not held.where("above IS NOT NULL").isEmpty():
        passed = held.where("above IS NOT NULL").groupBy(F.col("above").alias("_k")).agg(
            F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
        further = held.where("above IS NOT NULL").select(F.col("key").alias("_t"), F.col("above").alias("_above"))
        held = cut_lineage(held.join(passed, F.col("key") == F.col("_k"), "left").join(
            further, F.col("above") == F.col("_t"), "left").select(
            "key", F.col("_above").alias("above"), (F.col("leaves") + F.coalesce("_l", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("_s", F.lit(0))).alias("saved")))
    return held.select("key", "leaves", "saved")


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """``key, leaves, saved`` summed over the subtree of each node ``key, parent, depth, owner, parent_owner,
    leaves, saved``; the parent of a root is null."""
    shards = nodes.withColumns({"wide": F.floor(F.col("owner") / WIDTH), "slab": F.floor(F.col("depth") / DEPTH)})
    inside = (F.floor(F.col("parent_owner") / WIDTH) == F.col("wide")) & (
        F.floor((F.col("depth") - 1) / DEPTH) == F.col("slab"))
    shards = shards.withColumn("inside", F.coalesce(inside & F.col("parent").isNotNull(), F.lit(False)))
    first = cut_lineage(within_shards(shards))
    hung = shards.where(~F.col("inside")).select("key", "parent")
    own = hung.join(first.where("key = root").select("key", "leaves", "saved"), "key")
    above = first.select(F.col("key").alias("_p"), F.col("root").alias("above"))
    linked = own.join(above, F.col("parent") == F.col("_p"), "left").drop("_p")
    totals = across_roots(linked.select("key", "above", "leaves", "saved"))
    left = totals.join(hung.where("parent IS NOT NULL"), "key").groupBy(F.col("parent").alias("_k")).agg(
        F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
    again = shards.join(left, F.col("key") == F.col("_k"), "left").withColumns({
        "leaves": F.col("leaves") + F.coalesce("_l", F.lit(0)), "saved": F.col("saved") + F.coalesce("_s", F.lit(0))})
    return within_shards(again).select("key", "leaves", "saved")


def heads_of(conv: Column) -> Column:
    """How many turns a conversation takes from its base."""
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns ``conv, place, digest, chars, length``, and conversations ``conv, length``.

    Of rows ``conv, turn, role, text``: conversation c takes its first turns, fewer than ``HEADS``, from conversation
    ``c - c % GROUP`` and the rest from itself. Turns are ordered by number (nulls first), then role and text.
    """
    kept = turns.where("conv IS NOT NULL").select("conv", "turn", F.coalesce("role", F.lit("")).alias("role"),
                                                  F.coalesce("text", F.lit("")).alias("text"))
    ordered = cut_lineage(places(in_order(kept.withColumn("chars", F.length("text").cast("long")), "chars")))
    sizes = ordered.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    based = sizes.select("conv", "n", heads_of(F.col("conv")).alias("heads"), (F.col("conv") - F.col("conv") % GROUP).alias("base"))
    bases = sizes.where(F.col("conv") % GROUP == 0).select(F.col("conv").alias("base"), F.col("n").alias("has"))
    taken = F.least("heads", F.coalesce("has", F.lit(0)))
    convs = cut_lineage(based.join(bases, "base", "left").withColumn("taken", taken).withColumn(
        "length", F.col("taken") + F.greatest(F.col("n") - F.col("heads"), F.lit(0))))
    starts = ordered.where((F.col("conv") % GROUP == 0) & (F.col("place") < HEADS - 1)).select(
        F.col("conv").alias("base"), "place", "digest", "chars")
    head = convs.join(starts, "base").where(F.col("place") < F.col("heads")).select("conv", "place", "digest", "chars", "length")
    tail = ordered.select("conv", "place", "digest", "chars").where(F.col("place") >= heads_of(F.col("conv"))).join(
        convs.select("conv", "heads", "taken", "length"), "conv").select(
        "conv", (F.col("taken") + F.col("place") - F.col("heads")).alias("place"), "digest", "chars", "length")
    return head.unionByName(tail), convs.select("conv", "length")


def node_key(depth: Column, parts: list[Column]) -> Column:
    return F.md5(F.concat_ws(":", depth.cast("string"), *[p.cast("string") for p in parts]))


def root_key() -> Column:
    return node_key(F.lit(0), [F.lit(0)] * len(PARTS))


def members(rows: DataFrame) -> DataFrame:
    """``conv, depth, key, parent, chars, ended`` of rebuilt turns: the nodes that each conversation runs through."""
    mix = F.md5(F.concat(F.col("place").cast("string"), F.lit(":"), F.col("digest")))
    marked = rows.select("conv", "place", "chars", "length", F.floor(F.col("place") / SLICE).alias("_slice"), *[
        F.conv(F.substring(mix, 8 * i + 1, 8), 16, 10).cast("long").alias(p) for i, p in enumerate(PARTS)])
    sums = marked.groupBy("conv", "_slice").agg(*[F.sum(p).alias(p) for p in PARTS])
    before = Window.partitionBy("conv").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select("conv", "_slice", *[F.coalesce(F.sum(p).over(before), F.lit(0)).alias(f"_{p}") for p in PARTS])
    inside = Window.partitionBy("conv", "_slice").orderBy("place")
    run = marked.select("conv", "place", "chars", "length", "_slice", *[
        F.struct(F.sum(p).over(inside).alias("now"), F.col(p).alias("own")).alias(p) for p in PARTS])
    met = run.join(ahead, ["conv", "_slice"])
    now = [F.col(f"_{p}") + F.col(p)["now"] for p in PARTS]
    return met.select(
        "conv", (F.col("place") + 1).alias("depth"), node_key(F.col("place") + 1, now).alias("key"),
        node_key(F.col("place"), [n - F.col(p)["own"] for n, p in zip(now, PARTS)]).alias("parent"), "chars",
        (F.col("place") + 1 == F.col("length")).alias("ended"))


def _hashed(batches):
    state, current = None, None
    for batch in batches:
        keys, digests = [], []
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if key != current:
                if state is not None:
                    keys.append(current)
                    digests.append(state.hexdigest())
                state, current = sha256(), key
                state.update(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(digests, pa.string())], ["key", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([current]), pa.array([state.hexdigest()])], ["key", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """``key, ends_sha256`` of ``key, conv``: the digest of the ascending ids, comma-joined.

    Neighbouring ids are joined first, so the sequential hash of a node where very many conversations end reads
    few rows.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    joined = ends.groupBy("key", F.floor(F.col("conv") / ENDS).alias("_part")).agg(ids.alias("ids"))
    return joined.repartition("key").sortWithinPartitions("key", "_part").select("key", "ids").mapInArrow(
        _hashed, "key string, ends_sha256 string")


def conversation_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                      text: str = "text") -> DataFrame:
    """One row for each node of the trie of rebuilt conversations: ``conv_id`` (its smallest member), ``depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Null roles and texts are empty. Turns of a conversation with equal numbers are ordered by role and text, and
    repeated rows stay turns of their own. Rows without a conversation id belong to none and are left out. Other
    columns are not read. Ids are whole numbers. An empty table gives no rows; otherwise there is a root, of which
    conversations without turns are members, too.
    """
    rows, convs = rebuilt(turns.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"),
                                       F.col(role).alias("role"), F.col(text).alias("text")))
    run = cut_lineage(members(rows))
    root = convs.agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        root_key().alias("key"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"),
        F.lit(0).cast("long").alias("chars"), "owner", "n_convs")
    nodes = run.groupBy("key", "parent", "depth", "chars").agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs"))
    nodes = cut_lineage(nodes.withColumn("depth", F.col("depth").cast("long")).unionByName(root))
    kids = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("_k")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = cut_lineage(nodes.join(kids, F.col("key") == F.col("_k"), "left").drop("_k").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0))))
    over = counted.where("n_children > 0").select(F.col("key").alias("_k"), F.col("owner").alias("parent_owner"))
    valued = cut_lineage(counted.join(over, F.col("parent") == F.col("_k"), "left").drop("_k").withColumns({
        "leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")}))
    totals = subtree_totals(valued).withColumnsRenamed({"leaves": "n_leaves", "saved": "saved_tokens"})
    ends = run.where("ended").select("key", "conv").unionByName(
        convs.where("length = 0").select(root_key().alias("key"), "conv"))
    done = valued.drop("leaves", "saved").join(totals, "key").join(end_digests(ends), "key", "left")
    return done.select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent_owner").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
