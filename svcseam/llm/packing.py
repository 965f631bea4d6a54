"""Packing documents into sequences by Karmarkar-Karp multiway differencing.

A document's ids (with a closing id) are cut into full windows, which are sequences
of their own, and a tail; tails are cut into pieces of at most a quarter window.
Every task collects pieces to blocks of ``BLOCK_WINDOWS`` windows and splits each
block evenly: all pieces start as partial partitions of k windows, the two with the
largest imbalance are merged with opposing order (fullest to emptiest) until one is
left. If a window exceeds the capacity, k rises by one and the block is split again.
There is no shuffle, and a task holds one block at a time."""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import VOCABULARY, encode
from .words import slices

WINDOW, CLOSE = 1024, 0
BLOCK_WINDOWS = 128
PIECE = WINDOW // 4
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], k: int) -> tuple[np.ndarray, int]:
    """(window of each size, largest window) of a k-way split into near-equal windows."""
    n = len(sizes)
    sums = {}
    for i, s in enumerate(sizes):
        a = np.zeros(k, np.int64)
        a[0] = s
        sums[i] = a
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        s = sums.pop(a) + sums.pop(b)[::-1]  # both fullest first: opposing order
        order = np.argsort(-s, kind="stable")
        s = s[order]
        s -= s[-1]
        node = n + len(merges)
        merges.append((a, b, order))
        sums[node] = s
        heapq.heappush(heap, (-int(s[0]), node))
    window = np.zeros(n, np.int64)
    slots = {heap[0][1]: np.arange(k)}
    for m in range(len(merges) - 1, -1, -1):
        a, b, order = merges[m]
        own = slots.pop(n + m)
        left = np.empty(k, np.int64)
        left[order] = own
        for child, of in ((a, left), (b, left[::-1])):
            if child < n:
                window[child] = of[0]
            else:
                slots[child] = of
    if n == 1:
        window[0] = 0
    return window, int(np.bincount(window, weights=sizes, minlength=k).max())


def split_block(sizes: list[int], capacity: int = WINDOW) -> np.ndarray:
    """Windows of at most ``capacity`` for pieces that each fit one."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        window, most = differencing(sizes, k)
        if most <= capacity:
            return window
        k += 1


def _pack(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TaskContext.get().partitionId() << 40
        block: list[tuple] = []
        filled = 0
        out: list[tuple] = []

        def flush():
            nonlocal count, filled
            if block:
                window = split_block([len(p[2]) for p in block])
                at: dict[int, int] = {}
                for i in np.argsort(window, kind="stable"):
                    doc, start, ids, total = block[i]
                    w = int(window[i])
                    out.append((doc, start, len(ids), ids.astype("<u4").tobytes(), total, count + w, at.get(w, 0)))
                    at[w] = at.get(w, 0) + len(ids)
                count += int(window.max()) + 1
                block.clear()
                filled = 0

        def emit():
            cols = list(zip(*out))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            batch = pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)],
                                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            out.clear()
            return batch

        for batch in batches:
            for part in slices(batch, "text"):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = np.append(encode(text or "", True, vocabulary), np.uint32(CLOSE))
                    total = len(ids)
                    whole = total - total % WINDOW
                    for start in range(0, whole, WINDOW):
                        out.append((doc, start, WINDOW, ids[start:start + WINDOW].astype("<u4").tobytes(), total, count, 0))
                        count += 1
                    for start in range(whole, total, PIECE):
                        piece = ids[start:start + PIECE]
                        block.append((doc, start, piece, total))
                        filled += len(piece)
                        if filled >= BLOCK_WINDOWS * WINDOW:
                            flush()
                    if len(out) >= 2000:
                        yield emit()
        flush()
        if out:
            yield emit()

    return run


def pack(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of all rows of
    ``docs`` (doc_id, text; further columns are ignored).

    ``ids`` are the piece's token ids as little-endian uint32; a document's ids are those
    of its text and a closing id 0, so a null or empty text is one id. Each id lies in
    exactly one piece; a sequence holds at most 1024 ids, offsets in it are gapless from 0.
    Rows are packed each for itself, repeated or without doc_id too. An empty table gives
    an empty result."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pack(vocabulary), SCHEMA)


def with_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
