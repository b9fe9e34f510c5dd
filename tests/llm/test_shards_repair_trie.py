"""Operators 11 to 13 against brute force: placement and slots, edits of least cost, the trie; edge cases."""

import itertools
import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from atlas.llm import repair, sharding, trie

TURNS = "conv_id long, turn long, role string, text string"


# operator 11

def test_shares_follow_weights_and_growth_moves_rows_into_the_new_shard_only(spark):
    rows = spark.range(20_000)
    weights = {0: 1.0, 1: 2.0, 2: 0.0, 5: 1.0}
    shares = {r["shard"]: r["count"] / 20_000 for r in sharding.place(rows, "id", weights).groupBy("shard").count().collect()}
    assert set(shares) == {0, 1, 5} and abs(shares[1] - 0.5) < 0.02 and abs(shares[0] - 0.25) < 0.02
    both = sharding.place(sharding.place(rows, "id", sharding.even(8)), "id", sharding.even(9), "grown")
    assert both.where("shard <> grown AND grown <> 8").isEmpty()
    assert abs(both.where("grown = 8").count() / 20_000 - 1 / 9) < 0.01
    heavier = sharding.place(sharding.place(rows, "id", weights), "id", weights | {5: 3.0}, "grown")
    assert heavier.where("shard <> grown AND grown <> 5").isEmpty()
    for wrong in ({}, {0: 0.0}, {0: -1.0, 1: 1.0}):
        with pytest.raises(ValueError):
            sharding.rendezvous(F.lit("a"), wrong)


def test_slots_are_gapless_and_hot_copies_are_split(spark):
    docs = spark.createDataFrame(
        [(7, "copy", "x", 1)] * 500 + [(i, f"text {i}", "y", 2) for i in range(300)] + [(None, None, None, 3)] * 40 + [(8, "", "z", 4)],
        "doc_id long, text string, shard string, _x0 int")
    index = sharding.shard_index(docs)
    rows = index.collect()
    assert len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] is None} == {(1, 0)}
    assert all(r["text_crc32"] == zlib.crc32(b"copy") and r["size"] == 5 for r in rows if r["doc_id"] == 7 and r["size"] > 4 and r["text_crc32"] != zlib.crc32(b"text 7"))
    placed = sharding.place(docs, "doc_id", sharding.even(4))
    assert placed.count() == docs.count() and sorted(placed.columns) == sorted(docs.columns)
    small = sharding.slots(placed.select("doc_id", "_x0", "shard"), "doc_id", ["doc_id", "_x0", "shard"], chunk=16).collect()
    by = defaultdict(list)
    for r in small:
        by[r["shard"]].append(r["slot"])
    assert len(small) == docs.count() and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard_index(docs.limit(0)).count() == 0
    again = sharding.shard_index(docs.repartition(7, "doc_id"))
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, rows))


def test_shards_are_written_whole(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)] + [(None, None)], "doc_id long, text string")
    sharding.write_shards(docs, "doc_id", sharding.even(3), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(map(tuple, back.select("doc_id", "text").collect())) == Counter(map(tuple, docs.collect()))
    assert back.select("shard").distinct().count() == 3


# operator 12

GOOD = {""} | {"s" * a + "ua" * n for a in (0, 1) for n in range(1, 8)}


def brute_edits(codes):
    """All ways to edit at most three rows, with at most three insertions at each place."""
    best = None
    choices = []
    for code in codes:
        kind, initial = divmod(repair.CODES.index(code), 4)
        more = 3 if kind == 1 else 0
        options = [("D", "", 4)]
        if kind < 2:
            options += [("K", repair.INITIALS[initial], more), ("R", "u", 3 + more), ("R", "a", 3 + more)]
        choices.append(options)
    gaps = [("", 0)] + [(x, 3 * len(x)) for n in (1, 2, 3) for x in map("".join, itertools.product("ua", repeat=n))]
    for edits in itertools.product(*choices):
        for fill in itertools.product(gaps, repeat=len(codes) + 1):
            cost = sum(e[2] for e in edits) + sum(f[1] for f in fill)
            if best is not None and cost > best[0]:
                continue
            roles, letters = fill[0][0], "I" * len(fill[0][0])
            for e, f in zip(edits, fill[1:]):
                roles += e[1] + f[0]
                letters += e[0] + "I" * len(f[0])
            if roles in GOOD and (best is None or (cost, letters) < best):
                best = (cost, letters)
    return best


@pytest.mark.parametrize("n", [0, 1, 2])
def test_walk_equals_all_edits(n):
    for codes in map("".join, itertools.product("suaoSUAO1", repeat=n)):
        cost = repair.vector(codes, repair.FINAL)[repair.START]
        assert (cost, repair.walk(codes, repair.FINAL, repair.START, True)[0]) == brute_edits(codes), codes


def plain_walk(codes):
    """All vectors held, no checkpoints."""
    held = [repair.FINAL]
    for code in reversed(codes):
        held.append(repair.before(code, held[-1]))
    held.reverse()
    state, i, out = 0, 0, ""
    while i < len(codes) or state not in repair.ENDS:
        options = []
        if held[i][state] == held[i][repair.WRITES[state]] + 3:
            options.append(("I", repair.WRITES[state], i))
        if i < len(codes):
            options += [(a, to, i + 1) for a, to, c in repair.MOVES[codes[i]][state] if c + held[i + 1][to] == held[i][state]]
        letter, state, i = min(options)
        out += letter
    return held[0][0], out


def test_checkpoints_and_blocks_equal_the_plain_programme():
    rng = random.Random(4)
    for _ in range(200):
        codes = "".join(rng.choice("suaoSUAO1234uaua") for _ in range(rng.randrange(60)))
        cost, edits = plain_walk(codes)
        assert repair.walk(codes, repair.FINAL, 0, True)[0] == edits
        cuts = sorted({0, len(codes), *(rng.randrange(len(codes) + 1) for _ in range(4))})
        parts = [codes[a:b] for a, b in zip(cuts, cuts[1:])]
        value, ends = repair.FINAL, []
        for part in reversed(parts):
            ends.insert(0, value)
            m = repair.crossing(part)
            value = repair._closed([min(m[4 * s + e] + value[e] for e in range(4)) for s in range(4)])
        assert value[0] == cost
        state, out = 0, ""
        for k, (part, end) in enumerate(zip(parts, ends)):
            more, state = repair.walk(part, end, state, k == len(parts) - 1)
            out += more
        assert not parts or out == edits


def brute_repair(rows):
    """Summary and repaired text of one conversation's rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    ink = " \t\n\x0b\x0c\r"
    seen, codes, faults = set(), "", Counter()
    for _, role, text in rows:
        bare = text.strip(ink)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        faults[fault] += 1
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        codes += repair.CODES["suao".index(initial) + {"": 0, "truncated": 4}.get(fault, 8)]
    cost, edits = plain_walk(codes)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    kept, i = [], 0
    for e in edits:
        if e == "I":
            kept.append(("I", None, ""))
        else:
            if e != "D":
                kept.append((e, rows[i][1], rows[i][2]))
            i += 1
    odd = len(kept) % 2
    lines = [f"{r if e == 'K' else 'user' if (j - odd) % 2 == 0 else 'assistant'}:{t}" for j, (e, r, t) in enumerate(kept)]
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, edits,
            sha256("\n".join(lines).encode()).hexdigest())


def brute_damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        for _ in range({0: 0, 3: 2}.get(kind, 1)):
            yield conv, turn, "user" if kind == 4 else role, text


def talk(rng, n):
    texts = ["Yes.", "No!", " ", "", "cut off", "Why? ", "é😀.", "x\n", "Yes. "]
    return [(rng.choice([1, 2, 3, 4, None]), rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", "tool", None, ""]),
             rng.choice([None, *texts])) for _ in range(n)]


def test_repair_equals_brute_force(spark):
    rng = random.Random(6)
    rows = talk(rng, 150)
    # one conversation with most of the rows is cut into blocks
    rows += [(9, t, rng.choice(["user", "assistant", "assistant"]), f"{t % 1700}{rng.choice(['.', '', '!'])}") for t in range(4000)]
    rows += [(9, 3, "user", "Same.")] * 300 + [(77, None, None, None)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], TURNS + ", at int").repartition(6)
    by = defaultdict(list)
    for conv, *rest in brute_damage(rows):
        by[conv].append(tuple(rest))
    wanted = {conv: brute_repair(by[conv]) if by[conv] else (0,) * 6 + ("", repair.EMPTY_SHA) for conv in {r[0] for r in rows}}
    found = {r[0]: tuple(r[1:]) for r in repair.repair_digest(frame).collect()}
    assert found == wanted
    assert repair.repair_digest(frame.limit(0)).count() == 0


def test_repaired_rows_hold_their_rules(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Well."), (1, 2, "assistant", None), (1, 3, "assistant", "Done.")],
                                 "conv long, turn long, role string, text string")
    summary, repaired = repair.repair(rows)
    assert [tuple(r) for r in repaired.orderBy("position").select("edit", "role", "text").collect()] == [
        ("K", "user", "Hi."), ("I", "assistant", ""), ("K", "user", "Well."), ("K", "assistant", "Done.")]
    assert summary.first()["audit"] == "KIKDK" and summary.first()["cost"] == 7


# operator 13

def brute_trie(rows, group=100):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in by.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - c % group, [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = Counter(k[:-1] for k in nodes if k)
    leaves, saved = Counter(), Counter()
    for k, m in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    return Counter((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], sha256(
        ",".join(map(str, sorted(c for c in m if len(full[c]) == len(k)))).encode()).hexdigest()) for k, m in nodes.items())


@pytest.mark.parametrize("width,depth", [(1024, 64), (3, 2)])
def test_trie_equals_brute_force(spark, monkeypatch, width, depth):
    rng = random.Random(2)
    rows = [(rng.choice([*range(6), 100, 101, 105, 199, 205, 1001, None]), rng.choice([None, *range(6)]),
             rng.choice(["user", "assistant", None]), rng.choice(["a", "b", None, "", "é😀"])) for _ in range(220)]
    rows += [(c, t, "user", f"same {t}") for c in range(300, 340) for t in range(4)]
    rows += [(400, t, "user", str(t % 3)) for t in range(700)] + [(5000, 0, "user", "alone")]
    monkeypatch.setattr(trie, "WIDTH", width)
    monkeypatch.setattr(trie, "DEPTH", depth)
    monkeypatch.setattr(trie, "SLICE", 64)
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], TURNS + ", key int, depth int").repartition(5)
    assert Counter(map(tuple, trie.conversation_trie(frame).collect())) == brute_trie(rows)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], TURNS)
    assert trie.conversation_trie(none).count() == 0
    assert trie.conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], TURNS)).count() == 0


def test_queue_spills_and_keeps_order():
    rng = random.Random(1)
    for limit in (1, 7, 10_000):
        queue, held = trie.SpillingQueue(limit), []
        for _ in range(500):
            item = (rng.randrange(50), rng.random())
            queue.push(item)
            held.append(item)
            if rng.random() < 0.3:
                assert queue.pop() == min(held)
                held.remove(min(held))
        assert [queue.pop() for _ in range(len(held))] == sorted(held) and queue.peek() is None
