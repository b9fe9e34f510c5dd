"""Conversation structure repair by a square-root checkpointed dynamic programme (operator 12).

The cheapest edits turn a conversation's roles into ``(system? (user assistant)+)?``. A state is the kind of the
last role written. Backward, the state-cost vector of a row follows from that of the next one; forward, every step
takes the first edit letter that is tight. Letters decide the next state, and the number of rows left decides the
roles, so the result is the least edit string among the cheapest.

Backward vectors are stored at checkpoints alone, and a stretch between two of them is computed again when the
walk reaches it. This happens at two levels. Inside a task, the checkpoints of a block of n rows lie sqrt(n) rows
apart. Between tasks, the blocks of a conversation are those of :func:`atlas.llm.ordering.in_order`: each gives the
least cost from every state at its start to every state at its end, a fold over these small matrices gives the
vectors at the block borders, and each block is walked from all four states, of which a second fold keeps the one
that the blocks before it lead to. So no task ever sees a whole long conversation.
"""

from __future__ import annotations

from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlas.llm.ordering import in_order, turn_digest
from atlas.session import cut_lineage

START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})  # by state and role initial
ENDS = (START, ASSISTANT)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAR = 1 << 60
INITIALS = "suao"  # o: any other
CODES = INITIALS + "SUAO" + "1234"  # whole; truncated; blank or duplicate
INK = r"[^\x20\x09-\x0D]"
CUT_OFF = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*+\z"  # the last character with ink is no full stop


def _moves(code: str) -> tuple:
    """Per state the edits of a row, in the order of their letters: (letter, next state, cost)."""
    kind, initial = divmod(CODES.index(code), 4)
    extra = TRUNCATED if kind == 1 else 0
    out = []
    for state in range(4):
        edits = [("D", state, DELETE)]
        if kind < 2:
            step = NEXT[state]
            if INITIALS[initial] in step:
                edits.append(("K", step[INITIALS[initial]], extra))
            edits += [("R", to, REROLE + extra) for name, to in step.items() if name != "s"]
        out.append(tuple(edits))
    return tuple(out)


MOVES = {code: _moves(code) for code in CODES}
WRITES = tuple(next(to for name, to in step.items() if name != "s") for step in NEXT)  # where an insertion leads


def _closed(costs: list[int]) -> tuple:
    """Costs after any insertions. Two passes suffice: user and assistant take turns."""
    for _ in range(2):
        costs = [min(c, costs[WRITES[s]] + INSERT) for s, c in enumerate(costs)]
    return tuple(costs)


FINAL = _closed([0 if s in ENDS else FAR for s in range(4)])


def before(code: str, after: tuple) -> tuple:
    """The vector at a row from the vector behind it."""
    return _closed([min(cost + after[to] for _, to, cost in edits) for edits in MOVES[code]])


def vector(codes: str, end: tuple) -> tuple:
    for code in reversed(codes):
        end = before(code, end)
    return end


def crossing(codes: str) -> list[int]:
    """Least costs from each state at the start of a block to each state at its end, row by row of the matrix."""
    columns = [vector(codes, tuple(0 if s == e else FAR for s in range(4))) for e in range(4)]
    return [min(columns[e][s], FAR) for s in range(4) for e in range(4)]


def walk(codes: str, end: tuple, state: int, last: bool) -> tuple[str, int]:
    """The least tight edit string of a block from ``state``, and the state it ends in.

    ``end`` is the vector behind the block; ``last``: nothing follows, so the walk goes on until it may stop.
    """
    n = len(codes)
    every = isqrt(max(n - 1, 0)) + 1
    marks = {n: end}
    value = end
    for i in range(n - 1, -1, -1):
        value = before(codes[i], value)
        if i % every == 0:
            marks[i] = value
    out = []
    for low in range(0, n, every):
        high = min(n, low + every)
        held = [marks[high]]
        for i in range(high - 1, low - 1, -1):
            held.append(before(codes[i], held[-1]))
        for i in range(low, high):
            after, now = held[high - i - 1], held[high - i]
            while True:
                tight = {letter: to for letter, to, cost in MOVES[codes[i]][state] if cost + after[to] == now[state]}
                if now[WRITES[state]] + INSERT == now[state]:
                    tight["I"] = WRITES[state]
                letter = min(tight)
                out.append(letter)
                state = tight[letter]
                if letter != "I":
                    break
    while last and state not in ENDS:
        out.append("I")
        state = WRITES[state]
    return "".join(out), state


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text`` after a loss that depends on crc32 of ``conv:turn`` modulo 20.

    0 drops the row, 1 empties the text, 2 removes its full stops, 3 repeats the row, 4 sets the role to user.
    Null roles and texts are one space, and so are null ids and turns within the digest.
    """
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled(conv), F.lit(":"), filled(turn)).cast("binary")) % 20
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), filled(role).alias("role"),
                        filled(text).alias("text"), kind.alias("_k")).where("_k <> 0")
    copies = F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("_copy", F.explode(copies)).select(
        "conv", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"))


def _row_codes(rows: DataFrame) -> DataFrame:
    """``conv, turn, digest, at, block, fault, code`` of rows ``conv, turn, role, text`` in order."""
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    own = F.when(~F.col("text").rlike(INK), "blank").when(F.col("text").rlike(CUT_OFF), "truncated").otherwise("")
    ordered = in_order(rows.withColumns({"initial": known, "own": own}), "initial", "own")
    first = ordered.groupBy(F.col("conv").alias("_conv"), F.col("digest").alias("_digest")).agg(F.min("at").alias("_first"))
    met = ordered.join(first, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")))
    fault = F.when(F.col("own") == "blank", "blank").when(F.col("at") > F.col("_first"), "duplicate").otherwise(F.col("own"))
    place = F.instr(F.lit(INITIALS), F.col("initial"))
    kind = F.when(fault.isin("blank", "duplicate"), 8).when(fault == "truncated", 4).otherwise(0)
    return met.select("conv", "turn", "digest", "at", "block", fault.alias("fault"),
                      F.substring(F.lit(CODES), place + kind, F.lit(1)).alias("code"))


def _block_matrices(batches):
    for batch in batches:
        codes = batch.column("codes").to_pylist()
        initials = ["".join(INITIALS[CODES.index(c) % 4] for c in s) for s in codes]
        illegal = [sum(a + b not in ("su", "ua", "au") for a, b in zip(s, s[1:])) for s in initials]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("block"), batch.column("codes"), pa.array(illegal, pa.int64()),
             pa.array([s[:1] for s in initials]), pa.array([s[-1:] for s in initials]),
             pa.array([crossing(s) for s in codes], pa.list_(pa.int64()))],
            ["conv", "block", "codes", "illegal", "head", "tail", "costs"])


def _border_vectors(batches):
    """For each conversation its least cost, the faulty pairs of roles, and the vectors behind its blocks."""
    for batch in batches:
        cost, illegal, vectors = [], [], []
        for blocks in batch.column("blocks").to_pylist():
            value, held = FINAL, []
            for b in reversed(blocks):
                held.append(list(value))
                m = b["costs"]
                value = _closed([min(m[4 * s + e] + value[e] for e in range(4)) for s in range(4)])
            cost.append(value[START])
            vectors.append(held[::-1])
            between = sum(a["tail"] + b["head"] not in ("su", "ua", "au") for a, b in zip(blocks, blocks[1:]))
            illegal.append(between + sum(b["illegal"] for b in blocks))
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), pa.array([[b["block"] for b in x] for x in batch.column("blocks").to_pylist()], pa.list_(pa.int64())),
             pa.array(cost, pa.int64()), pa.array(illegal, pa.int64()),
             pa.array(vectors, pa.list_(pa.list_(pa.int64())))], ["conv", "block", "cost", "illegal", "ends"])


def _walks(batches):
    """Every block from all four states; ``ways`` holds (edits, state at the end) by state at the start."""
    for batch in batches:
        codes, ends, last = (batch.column(c).to_pylist() for c in ("codes", "end", "last"))
        ways = []
        for s, e, z in zip(codes, ends, last):
            ways.append([dict(zip(("edits", "to"), walk(s, tuple(e), state, z))) for state in range(4)])
        kind = pa.list_(pa.struct([("edits", pa.string()), ("to", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("block"), pa.array(ways, kind)],
                                         ["conv", "block", "ways"])


def _chosen(batches):
    """The edits of each block of a conversation, with the number of rows written before it and in all."""
    for batch in batches:
        convs, blocks, edits, ahead, total = [], [], [], [], []
        for conv, row in zip(batch.column("conv").to_pylist(), batch.column("blocks").to_pylist()):
            state, written = START, 0
            first = len(edits)
            for b in row:
                way = b["ways"][state]
                convs.append(conv)
                blocks.append(b["block"])
                edits.append(way["edits"])
                ahead.append(written)
                written += len(way["edits"]) - way["edits"].count("D")
                state = way["to"]
            total += [written] * (len(edits) - first)
        yield pa.RecordBatch.from_arrays(
            [pa.array(convs, batch.column("conv").type), pa.array(blocks, pa.int64()), pa.array(edits, pa.string()),
             pa.array(ahead, pa.int64()), pa.array(total, pa.int64())], ["conv", "block", "edits", "ahead", "total"])


def _written(batches):
    """Rows of the repaired conversation: for kept and reroled ones the place ``at`` they come from."""
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("conv", "position", "edit", "at", "role")}
        for conv, edits, first, position, total in zip(*(batch.column(c).to_pylist() for c in ("conv", "edits", "first", "ahead", "total"))):
            at = first
            for edit in edits:
                if edit != "D":
                    user = (position - total % 2) % 2 == 0  # an odd number of rows begins with a system row
                    out["conv"].append(conv)
                    out["position"].append(position)
                    out["edit"].append(edit)
                    out["at"].append(None if edit == "I" else at)
                    out["role"].append(None if edit == "K" else "user" if user else "assistant")
                    position += 1
                at += edit != "I"
        kinds = (batch.column("conv").type, pa.int64(), pa.string(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows ``conv, turn, role, text``: a summary of each conversation, and the repaired rows.

    Summary: ``conv, gaps, blank, duplicate, truncated, illegal, cost, audit``. Repaired: ``conv, position, edit,
    role, text``, positions from 0, edits K (kept), R (other role) and I (inserted, with an empty text).

    Rows are ordered by turn (nulls first), then role and text. A row's first fault counts: blank, a duplicate of an
    earlier row (role and text), truncated (its last character with ink ends no sentence). Gaps count the missing
    numbers between the turns, nulls aside. Null roles and texts count as empty; a null id is a conversation;
    repeated rows are duplicates; other columns are not read. An empty table gives empty ones. The audit of a
    conversation is one value, a letter for each edit.
    """
    kind = rows.schema["conv"].dataType.simpleString()
    rows = rows.select("conv", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    coded = cut_lineage(_row_codes(rows))
    turns = F.count_distinct("turn")
    counts = coded.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - turns, F.lit(0)).cast("long").alias("gaps"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    blocks = coded.groupBy("conv", "block").agg(
        F.min("at").alias("first"), F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]), "").alias("codes"))
    crossed = cut_lineage(blocks.select("conv", "block", "codes").mapInArrow(
        _block_matrices, f"conv {kind}, block long, codes string, illegal long, head string, tail string, costs array<long>"))
    held = F.array_sort(F.collect_list(F.struct("block", "illegal", "head", "tail", "costs")))
    borders = cut_lineage(crossed.groupBy("conv").agg(held.alias("blocks")).mapInArrow(
        _border_vectors, f"conv {kind}, block array<long>, cost long, illegal long, ends array<array<long>>"))
    ends = borders.select(F.col("conv").alias("_conv"), F.size("block").alias("_n"),
                          F.posexplode(F.arrays_zip("block", "ends"))).select(
        "_conv", F.col("col.block").alias("_block"), F.col("col.ends").alias("end"), (F.col("pos") + 1 == F.col("_n")).alias("last"))
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))
    walked = crossed.select("conv", "block", "codes").join(ends, same).select("conv", "block", "codes", "end", "last").mapInArrow(
        _walks, f"conv {kind}, block long, ways array<struct<edits: string, to: int>>")
    chosen = cut_lineage(walked.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "ways"))).alias("blocks")).mapInArrow(
        _chosen, f"conv {kind}, block long, edits string, ahead long, total long"))
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "edits"))), lambda x: x["edits"]), "")
    audits = chosen.groupBy(F.col("conv").alias("_conv")).agg(audit.alias("audit"))
    costs = borders.select(F.col("conv").alias("_other"), "illegal", "cost")
    summary = counts.join(audits, F.col("conv").eqNullSafe(F.col("_conv"))).join(
        costs, F.col("conv").eqNullSafe(F.col("_other"))).drop("_conv", "_other")

    firsts = blocks.select(F.col("conv").alias("_conv"), F.col("block").alias("_block"), "first")
    written = cut_lineage(chosen.join(firsts, same).select("conv", "edits", "first", "ahead", "total").mapInArrow(
        _written, f"conv {kind}, position long, edit string, at long, role string"))
    # a row that stays is the first of its kind in its conversation, so its digest names its text
    named = written.join(coded.select(F.col("at").alias("_at"), "digest"), F.col("at") == F.col("_at"), "left").drop("_at")
    said = rows.select(F.col("conv").alias("_conv"), turn_digest(F.col("role"), F.col("text")).alias("_digest"),
                       F.col("role").alias("_role"), "text").dropDuplicates(["_conv", "_digest"])
    kept = named.where("at IS NOT NULL").join(
        said, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest"))).select(
        "conv", "position", "edit", F.coalesce("role", "_role").alias("role"), "text")
    added = written.where("at IS NULL").select("conv", "position", "edit", "role", F.lit("").alias("text"))
    return summary, kept.unionByName(added)


def _hashed(batches):
    """Streams rows sorted by conversation and position; memory holds one hash state."""
    from hashlib import sha256

    state, current, begun = None, None, False
    for batch in batches:
        convs, digests = [], []
        for conv, line in zip(batch.column("conv").to_pylist(), batch.column("line").to_pylist()):
            if not begun or conv != current:
                if begun:
                    convs.append(current)
                    digests.append(state.hexdigest())
                state, current, begun = sha256(), conv, True
                state.update(line.encode())
            else:
                state.update(b"\n" + line.encode())
        kind = batch.column("conv").type
        yield pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array(digests, pa.string())], ["conv", "sha"])
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array([current], kind), pa.array([state.hexdigest()])], ["conv", "sha"])


def text_digests(repaired: DataFrame) -> DataFrame:
    """``conv, sha`` of the repaired rows ``role:text``, newline-joined.

    The hash of one conversation is sequential by its nature; its rows stream through one task in order.
    """
    kind = repaired.schema["conv"].dataType.simpleString()
    lines = repaired.select("conv", "position", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("conv").sortWithinPartitions("conv", "position").select("conv", "line").mapInArrow(
        _hashed, f"conv {kind}, sha string")


EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def repair_digest(turns: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of damaged turns, one row
    for each original id; zeros, an empty audit and the digest of nothing where no row is left."""
    summary, repaired = repair(damage(turns))
    shas = text_digests(repaired).withColumnRenamed("conv", "_conv")
    ids = turns.select("conv_id").distinct()
    found = ids.join(summary, F.col("conv_id").eqNullSafe(F.col("conv")), "left").join(
        shas, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return found.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.lit(EMPTY_SHA)).alias("repaired_sha256"))
