"""Near-full training windows by Karmarkar-Karp multiway differencing (operator 10).

A document's whole windows stand alone. What is left of it is cut into pieces of at most ``PIECE`` tokens,
which gather in a pool of fixed size. The pool goes into ``k`` windows by differencing: every piece starts as
a partition of its own (one loaded window, the rest empty); the two partitions with the largest spread merge
over and over, the fullest window of one onto the emptiest of the other, until one is left with windows of
near-equal load. If a window exceeds the capacity, ``k`` rises by one and the pool is parted again.

A pool is closed by cutting a piece where the load reaches ``k`` windows less a margin. The last pool of a
task rarely makes whole windows; its surplus goes into windows whose length is a power of two, which need no
padding.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlas.llm.tokens import worker_encoder

CAPACITY = 4096
PIECE = 256
POOL_WINDOWS = 64
MARGIN = 16  # tokens a window may lie above the mean of its pool
SHARD_BITS = 36  # window numbers of a task

PIECE_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
                "offset long, sequence_tokens long")


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``k`` groups of near-equal sums (Karmarkar-Karp, multiway)."""
    n = len(sizes)
    if k == 1 or n == 0:
        return [list(range(n)), *[[] for _ in range(k - 1)]]
    heap = []
    for i, size in enumerate(sizes):
        loads = np.zeros(k, np.int64)
        loads[0] = size
        heap.append((-size, i, loads))
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        _, one, a = heapq.heappop(heap)
        _, two, b = heapq.heappop(heap)
        loads = a + b[::-1]  # loads are kept fullest first
        order = np.argsort(-loads, kind="stable")
        loads = loads[order] - loads[order[-1]]
        heapq.heappush(heap, (-int(loads[0]), n + len(merges), loads))
        merges.append((one, two, order))
    # place[node][j]: the final window of the node's window j
    place: dict[int, np.ndarray] = {heap[0][1]: np.arange(k)}
    for at in range(len(merges) - 1, -1, -1):
        one, two, order = merges[at]
        final = place.pop(n + at)
        slot = np.empty(k, np.int64)
        slot[order] = final
        place[one], place[two] = slot, slot[::-1]
    groups: list[list[int]] = [[] for _ in range(k)]
    for i in range(n):
        groups[place[i][0]].append(i)
    return groups


class WindowPacker:
    """Streams documents into windows; holds one pool."""

    def __init__(self, capacity: int = CAPACITY, piece: int = PIECE, pool_windows: int = POOL_WINDOWS,
                 margin: int = MARGIN):
        self.capacity, self.piece, self.margin = capacity, min(piece, capacity), min(margin, capacity - 1)
        self.limit = pool_windows * (capacity - self.margin)
        self.pool: list[tuple] = []  # (document, start, length)
        self.load = 0

    def add(self, document, n: int) -> Iterator[list[tuple]]:
        """Windows that the document completes: lists of (document, start, length)."""
        whole = n - n % self.capacity
        for start in range(0, whole, self.capacity):
            yield [(document, start, self.capacity)]
        start = whole
        while start < n:
            length = min(self.piece, n - start, self.limit - self.load)
            self.pool.append((document, start, length))
            self.load += length
            start += length
            if self.load == self.limit:
                yield from self.flush()

    def flush(self) -> Iterator[list[tuple]]:
        """Windows of the pool, which is empty afterwards."""
        pool, load, self.pool, self.load = self.pool, self.load, [], 0
        if not load:
            return
        k = load // self.capacity
        spare = load - k * (self.capacity - self.margin)
        if spare > 0 and load != self.limit:
            tail, rest = self._take(pool, spare)
            power = 1
            while spare:  # binary digits of the surplus
                if spare & 1:
                    window, tail = self._take(tail, power)
                    yield window
                spare >>= 1
                power <<= 1
            pool, load = rest, k * (self.capacity - self.margin)
        if not load:
            return
        sizes = [length for _, _, length in pool]
        k = -(-load // self.capacity)
        while True:
            groups = differencing(sizes, k)
            if max(sum(sizes[i] for i in g) for g in groups) <= self.capacity:
                break
            k += 1
        for g in groups:
            if g:
                yield [pool[i] for i in g]

    @staticmethod
    def _take(pool: list[tuple], tokens: int) -> tuple[list[tuple], list[tuple]]:
        """The last pieces that hold ``tokens``, cut where needed, and the others."""
        rest, taken = list(pool), []
        while tokens:
            document, start, length = rest.pop()
            used = min(length, tokens)
            taken.append((document, start + length - used, used))
            if used < length:
                rest.append((document, start, length - used))
            tokens -= used
        return taken, rest


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, encoder: Callable | None = None) -> DataFrame:
    """Pieces of all documents with their place in a window (``PIECE_SCHEMA``).

    Each task tokenises and packs the documents it scans; nothing is shuffled and a task holds one pool. Every
    id (with the end id) lies in exactly one piece; offsets in a window run from 0 without gaps. Null and empty
    texts are the end id alone. Repeated rows are packed once per row. A retried task reads the same rows in
    the same order and gives the same windows. An empty table gives no rows.
    """
    encoder = encoder or worker_encoder

    def run(batches):
        encode = encoder(vocabulary)
        packer = WindowPacker(capacity)
        serial = TaskContext.get().partitionId() << SHARD_BITS
        documents: dict[int, tuple] = {}  # those with pieces in the pool
        rows: list[tuple] = []

        def place(windows):
            nonlocal serial
            for window in windows:
                offset, total = 0, sum(length for _, _, length in window)
                for number, start, length in window:
                    name, ids = documents[number]
                    rows.append((name, start, length, zlib.crc32(ids[start:start + length].tobytes()), len(ids),
                                 serial, offset, total))
                    offset += length
                serial += 1

        def emit():
            out = pa.RecordBatch.from_pydict({
                name: pa.array(column, pa.int64()) for name, column in
                zip([f.split()[0] for f in PIECE_SCHEMA.split(", ")], zip(*rows))})
            rows.clear()
            return out

        number = 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode.document(text.as_py())
                documents[number] = (name, ids)
                place(packer.add(number, len(ids)))
                if not packer.pool:
                    documents.clear()
                elif packer.pool[-1][0] != number:
                    documents.pop(number)  # it filled whole windows
                if number % 64 == 0 and len(documents) > len(packer.pool):
                    used = {piece[0] for piece in packer.pool}
                    documents = {k: v for k, v in documents.items() if k in used}
                number += 1
                if len(rows) > 20_000:
                    yield emit()
        place(packer.flush())
        if rows:
            yield emit()

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, PIECE_SCHEMA)
