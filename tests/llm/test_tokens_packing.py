"""Operators 1 and 10: exact round trips."""

import random
import zlib

import numpy as np
import pytest

from atlas.llm import packing, token_blocks
from atlas.llm.tokens import WordEncoder, default_vocabulary

SCHEMA = "doc_id long, text string, start string, shard string"
TEXTS = ["Plain words, here.", None, "", "  \n\t ", "Same text", "Same text", "x" * 30_000, "wörd éa 日本 😀 12 a.b's",
         "ab " * 40_000, "<|endoftext|> and <|start"]


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(default_vocabulary())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "a", None) for i, t in enumerate(TEXTS)] + [(4, "Same text", "b", "c"), (None, "no id", None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def whole_ids(encoder, text):
    return [*encoder.whole.encode(text or "", add_special_tokens=False).ids, 2]


def test_encoder_equals_the_tokenizer(encoder):
    rng = random.Random(5)
    letters = [*"abcXYZ é́ÀİßςΣσst 12 ..,,!&\t\n  \x1c\x85中文😀<|>-_ﬁ²½'", "<|endoftext|>", "'s", "don't", "x.,", ". "]
    for _ in range(1500):
        text = "".join(rng.choices(letters, k=rng.randint(0, 40)))
        assert list(encoder.document(text)) == whole_ids(encoder, text), repr(text)


def test_encoder_forgets_and_learns_again():
    small = WordEncoder(default_vocabulary(), cache_words=3)
    for text in ("one two three four five", "six one seven", "two eight nine ten"):
        assert list(small.document(text)) == whole_ids(small, text)


@pytest.mark.parametrize("ids", [
    [], [7], [0, 2 ** 32 - 1] * 700, [0] * 1024, [5] * 1023, list(range(5000)),
    list(np.random.default_rng(1).zipf(1.3, 20_000) % 49_000)])
def test_blocks_round_trip(ids):
    ids = np.array(ids, np.uint32)
    cuts = np.split(ids, [len(ids) // 3, len(ids) // 2])
    content = token_blocks.encode_segment(cuts)
    back = token_blocks.Segment(content).documents()
    assert [list(b) for b in back] == [list(c) for c in cuts]
    for block in range(-(-len(ids) // token_blocks.BLOCK)):
        part = ids[block * token_blocks.BLOCK:(block + 1) * token_blocks.BLOCK]
        assert list(token_blocks.read_block(content, block)) == list(part)


def test_exceptions_keep_blocks_small():
    ids = np.random.default_rng(0).integers(0, 16, 4096).astype(np.uint32)
    ids[::500] = 2 ** 31
    assert len(token_blocks.encode_segment([ids])) < 4096


def test_token_files(spark, docs, encoder):
    rows = token_blocks.token_blocks(docs, default_vocabulary()).collect()
    expected = sorted([(i, t or "") for i, t in enumerate(TEXTS)] + [(4, "Same text"), (-1, "no id")])
    got = sorted(rows, key=lambda r: r["start"])
    start = 0
    for row, (name, text) in zip(got, expected, strict=True):
        ids = np.array(whole_ids(encoder, text), "<u4")
        assert (row["doc_id"] if row["doc_id"] is not None else -1, row["start"], row["n_tokens"], row["ids_crc32"]) == (
            name, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_of_no_documents(docs):
    assert token_blocks.token_blocks(docs.limit(0), default_vocabulary()).count() == 0


def check_windows(rows, lengths):
    windows, pieces = {}, {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    padding = 0
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= packing.CAPACITY
        padding += 0 if at & (at - 1) == 0 else packing.CAPACITY - at
    for name, n in lengths.items():
        covered = sorted(pieces[name])
        ends = [s + length for s, length in covered]
        assert [s for s, _ in covered] == [0, *ends[:-1]] and ends[-1] == n
    return padding


def test_packing_of_documents(spark, docs, encoder):
    once = docs.where("doc_id IS NULL OR NOT (doc_id = 4 AND start = 'b')")
    rows = packing.pack(once, default_vocabulary()).collect()
    ids = {i: np.array(whole_ids(encoder, t), "<u4") for i, t in enumerate(TEXTS)}
    ids[None] = np.array(whole_ids(encoder, "no id"), "<u4")
    check_windows(rows, {k: len(v) for k, v in ids.items()})
    for r in rows:
        piece = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(piece.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
    assert packing.pack(docs.limit(0), default_vocabulary()).count() == 0


def test_packing_repeats(spark):
    twice = spark.createDataFrame([(1, "one two")] * 3, "doc_id long, text string")
    rows = packing.pack(twice, default_vocabulary()).collect()
    assert sum(r["length"] for r in rows) == 9


@pytest.mark.parametrize("n", [0, 1, 2, 50, 3000])
def test_little_padding(n):
    rng = np.random.default_rng(n)
    sizes = (np.exp(rng.normal(6.5, 1.3, n)).astype(int) + 1).tolist()
    packer = packing.WindowPacker()
    made = [w for i, s in enumerate(sizes) for w in packer.add(i, s)] + list(packer.flush())
    rows = []
    for sequence, window in enumerate(made):
        offset = 0
        for name, start, length in window:
            rows.append({"sequence_id": sequence, "offset": offset, "length": length, "doc_id": name, "start": start})
            offset += length
    assert check_windows(rows, dict(enumerate(sizes))) <= 0.01 * sum(sizes) + packing.MARGIN


def test_differencing_balances():
    sizes = np.random.default_rng(2).integers(1, 256, 400).tolist()
    groups = packing.differencing(sizes, 16)
    assert sorted(i for g in groups for i in g) == list(range(400))
    sums = [sum(sizes[i] for i in g) for g in groups]
    assert max(sums) - min(sums) < 20
    assert packing.differencing([], 3) == [[], [], []] and packing.differencing([4], 1) == [[0]]


def test_the_count_rises_when_a_window_overflows():
    packer = packing.WindowPacker(capacity=10, piece=7, pool_windows=2, margin=0)
    made = [w for i in range(3) for w in packer.add(i, 7)] + list(packer.flush())
    assert all(sum(p[2] for p in w) <= 10 for w in made) and sum(p[2] for w in made for p in w) == 21
