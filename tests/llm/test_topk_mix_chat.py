"""Operators 2, 7 and 8, against brute force."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from atlas.llm import chat, disclosure, mixing, quality, simhash, topk


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.standard_normal(10).astype(np.float32).tolist()) for i in range(300)]
    vectors += [(300 + i, [0.5] * 10) for i in range(40)]  # ties
    vectors += [(400, None), (401, [float("nan")] * 10), (402, [1.0, None] * 5), (403, []), (404, [3.0] * 4), (420, [1.0] * 4)]
    rows = [(i, v, "q", 1) for i, v in vectors]
    frame = spark.createDataFrame([*rows, rows[5], (None, [1.0] * 10, "q", 1)],
                                  "vec_id long, embedding array<double>, query_id string, rank int")
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in vectors
             if v and all(x is not None and np.isfinite(x) for x in v)}
    expected = set()
    for q, a in whole.items():
        if q % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole.items() if i != q and len(a) == len(b))
            expected |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:10])}
    for row_block, query_block in ((8192, 512), (32, 4)):
        got = topk.top_k(frame, F.col("vec_id") % 20 == 0, 10, row_block=row_block, query_block=query_block)
        assert {tuple(r) for r in got.collect()} == expected
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_large_components_are_exact():
    a = np.array([[2 ** 29 + 1, 3]], np.int64)
    assert topk.exact_product(a, a)[0, 0] == (2 ** 29 + 1) ** 2 + 9


def shares(sizes, weights, budget, most):
    """Share, cap, share the excess again, until nothing is above."""
    capped, level = set(), {}
    total = budget * sum(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        spare = total - sum(most * sizes[i] for i in capped)
        level = {i: spare * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if level[i] > most * sizes[i] + 1e-9}
        if not over:
            return [most * sizes[i] if i in capped else level[i] for i in range(len(sizes))]
        capped |= over


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=8))
def test_targets_equal_repeated_sharing(spark, sizes):
    table = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(table).collect()}
    expected = shares(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(sizes))], 1.5, 2.0)
    assert np.allclose([got[f"s{i}"] for i in range(len(sizes))], expected)


def test_mix(spark):
    rows = [(i, "w " * (i % 37 + 1), f"s{i % 4}", "x") for i in range(2000)]
    rows += [(5000, None, None, "x"), (5001, "", "empty", "x"), (5002, "a\x0bb\x1cc\u00a0d", None, "x"), rows[3],
             (None, "one two", "s1", "x"), (5003, "long " * 50_000, "s2", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    plan = mixing.source_plan(docs)
    got = mixing.planned(docs, plan).select(
        "doc_id", "source", mixing.word_count(F.col("text")).alias("size"), "_source_size", "_target", "_copies").collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["size"] for r in got if (r["doc_id"] or 0) >= 5000} == {5000: 0, 5001: 0, 5002: 2, 5003: 50_000}
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        size = sum(r["size"] for r in own)
        assert all(r["_source_size"] == size and 0 <= r["_copies"] <= 2 for r in own)
        taken = sum(r["size"] * r["_copies"] for r in own)
        largest = max(r["size"] for r in own)
        assert abs(taken - own[0]["_target"]) <= max(largest, 0.02 * size)
    again = mixing.mix(docs)
    assert again.columns == docs.columns and again.count() == sum(r["_copies"] for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


CONVERSATIONS = [
    (1, 1, "assistant", "b <turn user>\n"), (1, 0, "user", "a </turn>\n \\l \\\\l <"), (1, 2, "user", "c"), (1, 3, "assistant", "é😀"),
    (2, 0, "system", "s"), (2, 1, "user", None), (2, 2, "assistant", ""), (3, 0, "assistant", "first"),
    (4, 0, "user", "u"), (4, 1, "user", "again"), (5, 0, "tool>\n<x", "odd \\"), (5, 1, None, "nobody"),
    (6, None, "user", "z"), (6, 1, "assistant", "y"), (6, 1, "assistant", "x"), (None, 0, "user", "no id"), (7, 0, "user", "q " * 200_000)]


def test_chat(spark):
    frame = spark.createDataFrame([(*c, "e", 1) for c in CONVERSATIONS],
                                  "conv_id long, turn long, role string, text string, t string, at int")
    formatted = chat.format_chats(frame)
    read = {r["conv_id"]: r for r in formatted.select(
        "*", chat.parse(F.col("formatted")).alias("back")).collect()}
    digest = {r["conv_id"]: r for r in chat.chat_digest(formatted).collect()}
    for conv in {c[0] for c in CONVERSATIONS}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in CONVERSATIONS if c == conv))
        row = read[conv]
        assert [(b["role"], b["text"]) for b in row["back"]] == [(t[2], t[3]) for t in turns]
        assert "".join(s["text"] for s in row["segments"]) == row["formatted"]
        learned = "".join(t[3] for t in turns if t[2] == "assistant")
        told = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        d = digest[conv]
        assert d["n_turns"] == len(turns) and d["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert d["loss_chars"] == len(learned) and d["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
        assert d["formatted_chars"] == len(row["formatted"])
        assert all(s["loss"] == (i % 3 == 1 and turns[i // 3][2] == "assistant") for i, s in enumerate(row["segments"]))
    faults = {c: read[c]["first_fault"] for c in read}
    assert faults == {1: None, 2: None, 3: 0, 4: 1, 5: 0, 6: 2, 7: 1, None: 1}
    assert all(read[c]["valid"] == (faults[c] is None) for c in read)
    assert chat.chat_digest(chat.format_chats(frame.limit(0))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="\\l</turn>\n x", max_size=30))
def test_escape_is_reversible(spark, text):
    row = spark.createDataFrame([(text,)], "x string").select(
        chat.escape(F.col("x")).alias("e"), chat.unescape(chat.escape(F.col("x"))).alias("b")).first()
    assert row["b"] == text and "<" not in row["e"]


@pytest.mark.parametrize("role", ["narrator", "user"])
def test_another_template(spark, role):
    plain = chat.Template(opens={"narrator": "<N>"}, other="<role %s>", close="<end>", loss=("narrator",),
                          moves={"": ("narrator",), "narrator": ("narrator",)}, ends=("narrator",))
    frame = spark.createDataFrame([(1, 0, role, "a <end> b")], "conv_id long, turn long, role string, text string")
    row = chat.format_chats(frame, plain).select("*", chat.parse(F.col("formatted"), plain).alias("b")).first()
    assert [tuple(x) for x in row["b"]] == [(role, "a <end> b", role == "narrator")]
    assert row["valid"] == (role == "narrator")


def test_words_are_counted_in_linear_time(spark):
    import time

    rows = [("a" + " " * 1_000_000 + "b", 2), (" \t\n", 0), ("", 0), (None, 0), (" a  b\u00a0c ", 2), ("\x1f", 1)]
    frame = spark.createDataFrame(rows, "text string, n long")
    began = time.time()
    assert all(r["n"] == r["words"] for r in frame.withColumn("words", mixing.word_count(F.col("text"))).collect())
    assert time.time() - began < 5


def test_stages_take_columns_of_any_name(spark):
    names = ["_score", "_copies", "_copy", "_source", "_key", "_spans", "_levels", "_terms", "component_id", "_o", "fp", "group", "_size"]
    docs = spark.createDataFrame(
        [(i, f"Some words in text {i}, mail a{i}@b.org.", "en", f"s{i % 3}", 30, *range(len(names))) for i in range(40)],
        "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    for stage in (lambda d: quality.keep_good(d, labels), simhash.keep_one, lambda d: disclosure.sanitise(d, everywhere=True), mixing.mix):
        out = stage(docs)
        assert out.columns == docs.columns
        assert all(tuple(r[n] for n in names) == tuple(range(len(names))) for r in out.collect())
