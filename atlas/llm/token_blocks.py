"""Token ids in patched frame-of-reference blocks (operator 1).

A *segment* holds the ids of some documents in order and is the unit of the file format::

    "PFB1" | u32 documents | u64 ids | u32 blocks
    u32 ids of each document
    u64 byte at which each block starts (counted from the first block)
    block: u32 minimum | u8 width | u16 exceptions | packed | u16 positions | u32 values

A block covers ``BLOCK`` ids (the last one fewer). The minimum is subtracted, the differences are packed most
significant bit first at ``width`` bits, and the differences that do not fit are listed as exceptions. The
width is the bit length of one of the ``PERCENTILES`` of the block's differences, whichever gives the
smallest block. A start index makes any block readable alone (:func:`read_block`).

Spark can write to any store only through its own writers, so a file of segments is a Parquet file with one
segment in each row, beside what a reader needs for pruning: the shard (its place in the order), the ids of
the shard before the segment and the document ids.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atlas.llm.tokens import worker_encoder
from atlas.session import fresh_path

BLOCK = 1024  # ids in a block; positions of exceptions are 16 bits
PERCENTILES = (80, 90, 95, 98, 100)
SEGMENT_IDS = 1 << 18  # a segment is closed at the first document end beyond
CHUNK_BLOCKS = 256  # blocks packed at once, which bounds the memory for very long documents
HEAD = "<4sIQI"
BLOCK_HEAD = "<IBH"
MAGIC = b"PFB1"

SEGMENT_SCHEMA = "shard int, before long, n_ids long, doc_ids array<bigint>, content binary"
TOKEN_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1]  # exact for 32-bit values; 0 has length 0


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``values`` at ``width`` bits each, every row padded to whole bytes."""
    word = 16 if width <= 16 else 32
    wide = np.ascontiguousarray(values.astype(">u2" if word == 16 else ">u4"))
    bits = np.unpackbits(wide.view(np.uint8).reshape(*values.shape, word // 8), axis=-1)
    return np.packbits(bits[..., word - width:].reshape(len(values), -1), axis=1)


def _unpack(packed: np.ndarray, width: int, n: int) -> np.ndarray:
    word = 16 if width <= 16 else 32
    bits = np.unpackbits(packed, axis=1)[:, :n * width].reshape(len(packed), n, width)
    wide = np.zeros((len(packed), n, word), np.uint8)
    wide[..., word - width:] = bits
    return np.packbits(wide, axis=-1).view(">u2" if word == 16 else ">u4").reshape(len(packed), n).astype(np.uint32)


def _encode_rows(rows: np.ndarray) -> list[bytes]:
    """Blocks of equal length."""
    m, n = rows.shape
    low = rows.min(axis=1)
    diff = rows - low[:, None]
    lengths = _bit_lengths(diff)
    covered = np.cumsum(np.bincount((lengths + 33 * np.arange(m)[:, None]).ravel(), minlength=33 * m).reshape(m, 33), axis=1)
    best_width, best_size = np.zeros(m, int), np.full(m, np.inf)
    for p in PERCENTILES:
        width = np.argmax(covered >= np.ceil(n * p / 100), axis=1)
        over = n - covered[np.arange(m), width]
        size = (n * width + 7) // 8 + 6 * over
        better = size < best_size
        best_width[better], best_size[better] = width[better], size[better]
    out: list[bytes] = [b""] * m
    for width in np.unique(best_width):
        at = np.flatnonzero(best_width == width)
        mask = np.uint32((1 << int(width)) - 1)
        packed = _pack(diff[at] & mask, int(width)) if width else np.zeros((len(at), 0), np.uint8)
        for row, body in zip(at, packed):
            patched = np.flatnonzero(lengths[row] > width)
            out[row] = b"".join([
                struct.pack(BLOCK_HEAD, int(low[row]), int(width), len(patched)), body.tobytes(),
                patched.astype("<u2").tobytes(), diff[row][patched].astype("<u4").tobytes()])
    return out


def encode_segment(documents: list[np.ndarray]) -> bytes:
    """A segment of the uint32 ids of some documents."""
    ids = np.concatenate(documents).astype(np.uint32) if documents else np.zeros(0, np.uint32)
    whole = len(ids) // BLOCK
    blocks: list[bytes] = []
    for i in range(0, whole, CHUNK_BLOCKS):
        upto = min(whole, i + CHUNK_BLOCKS)
        blocks += _encode_rows(ids[i * BLOCK:upto * BLOCK].reshape(-1, BLOCK))
    if len(ids) % BLOCK:
        blocks += _encode_rows(ids[whole * BLOCK:].reshape(1, -1))
    starts = np.cumsum([0, *map(len, blocks)])[:-1] if blocks else np.zeros(0)
    return b"".join([
        struct.pack(HEAD, MAGIC, len(documents), len(ids), len(blocks)),
        np.array([len(d) for d in documents], "<u4").tobytes(), starts.astype("<u8").tobytes(), *blocks])


class Segment:
    """A parsed header and index; blocks are decoded on demand."""

    def __init__(self, content: bytes):
        magic, n_docs, self.n_ids, self.n_blocks = struct.unpack_from(HEAD, content)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = struct.calcsize(HEAD)
        self.lengths = np.frombuffer(content, "<u4", n_docs, at).astype(np.int64)
        at += 4 * n_docs
        self.starts = np.frombuffer(content, "<u8", self.n_blocks, at).astype(np.int64)
        self.at = at + 8 * self.n_blocks
        self.content = content

    def _parts(self, block: int):
        n = min(BLOCK, self.n_ids - block * BLOCK)
        at = self.at + int(self.starts[block])
        low, width, n_exceptions = struct.unpack_from(BLOCK_HEAD, self.content, at)
        at += struct.calcsize(BLOCK_HEAD)
        size = (n * width + 7) // 8
        packed = np.frombuffer(self.content, np.uint8, size, at)
        positions = np.frombuffer(self.content, "<u2", n_exceptions, at + size)
        values = np.frombuffer(self.content, "<u4", n_exceptions, at + size + 2 * n_exceptions)
        return n, low, width, packed, positions, values

    def _decode(self, blocks: range) -> list[np.ndarray]:
        parts = [self._parts(b) for b in blocks]
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(parts)
        alike: dict[tuple[int, int], list[int]] = {}
        for i, (n, _, width, *_rest) in enumerate(parts):
            alike.setdefault((n, width), []).append(i)
        for (n, width), at in alike.items():
            rows = (_unpack(np.stack([parts[i][3] for i in at]), width, n) if width
                    else np.zeros((len(at), n), np.uint32))
            for i, row in zip(at, rows):
                row[parts[i][4]] = parts[i][5]
                out[i] = row + np.uint32(parts[i][1])
        return out

    def ids(self) -> np.ndarray:
        chunks = [np.concatenate(self._decode(range(i, min(self.n_blocks, i + CHUNK_BLOCKS))))
                  for i in range(0, self.n_blocks, CHUNK_BLOCKS)]
        return np.concatenate(chunks) if chunks else np.zeros(0, np.uint32)

    def documents(self) -> list[np.ndarray]:
        return np.split(self.ids(), np.cumsum(self.lengths)[:-1]) if len(self.lengths) else []


def read_block(content: bytes, block: int) -> np.ndarray:
    """One block by the start index, without decoding the others."""
    return Segment(content)._decode(range(block, block + 1))[0]


def write_token_blocks(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id",
                       text_col: str = "text") -> None:
    """Encode every whole text and write segments in ascending ``id_col`` order.

    One range shuffle brings the documents in order; each task then streams its range and closes a segment
    at a document end. Nulls and empty texts give the end id alone; rows without an id come first; repeated
    ids stay as rows of their own, ordered by text. An empty table gives an empty folder.
    """
    ordered = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))

    def encode(batches):
        encoder = worker_encoder(vocabulary)
        shard, before = TaskContext.get().partitionId(), 0
        names: list = []
        held: list[np.ndarray] = []
        size = 0

        def close():
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "before": pa.array([before], pa.int64()),
                "n_ids": pa.array([size], pa.int64()), "doc_ids": pa.array([names], pa.list_(pa.int64())),
                "content": pa.array([encode_segment(held)], pa.binary())})

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.document(text.as_py())
                names.append(name)
                held.append(ids)
                size += len(ids)
                if size >= SEGMENT_IDS:
                    yield close()
                    before += size
                    names, held, size = [], [], 0
        if held:
            yield close()

    ordered.mapInArrow(encode, SEGMENT_SCHEMA).write.parquet(path)


def read_token_blocks(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files.

    ``start`` is the shard's base (a running sum over one row per shard) plus the ids before the document
    in its shard.
    """
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                documents = Segment(row["content"]).documents()
                n = np.array([len(d) for d in documents], np.int64)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "start": pa.array(row["base"] + row["before"] + np.cumsum(n) - n),
                    "n_tokens": pa.array(n),
                    "ids_crc32": pa.array([zlib.crc32(d.astype("<u4").tobytes()) for d in documents], pa.int64())})

    return segments.join(F.broadcast(bases), "shard").select(
        "base", "before", "doc_ids", "content").mapInArrow(decode, TOKEN_SCHEMA)


def token_blocks(docs: DataFrame, vocabulary: str, path: str | None = None) -> DataFrame:
    """Write, then read back: the digest of every document as the files hold it."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "token-blocks")
    write_token_blocks(docs, path, vocabulary)
    return read_token_blocks(spark, path)
