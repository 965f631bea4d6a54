"""Exact duplicates over a sharded cuckoo-filter index of live digests.

The index is a table with one row per shard of digests: a cuckoo filter (four
16-bit fingerprints a bucket, partial-key displacement) whose slots point at the
stored keys. A lookup reads the two buckets a digest can be in; a fingerprint hit
is verified against the full digest stored for that slot, a miss is inserted, a
delete frees the slot, and when an insert finds no place the filter is built anew
from the stored keys at twice the size. Shards are keyed by digest, so they grow
with the number of distinct texts only: copies are merged per batch before the
shuffle, and one text that makes up a third of all rows reaches its shard as one
row per batch.
"""

from __future__ import annotations

import hashlib
import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import kept
from .words import _tables, slices, string_buffers

SLOTS, KICKS = 4, 500
SHARD_KEYS = 100_000
INDEX_SCHEMA = "shard long, n_buckets long, fingerprints binary, slot_key binary, keys binary, keep_ids array<bigint>, sizes array<bigint>"
DIGEST = 32


class CuckooFilter:
    """Fingerprint buckets over stored keys (full digests)."""

    def __init__(self, n_buckets: int = 64):
        self.keys: list[bytes | None] = []
        self._clear(n_buckets)

    def _clear(self, n_buckets: int) -> None:
        self.n = n_buckets
        self.prints = array("H", bytes(2 * SLOTS * n_buckets))
        self.slot_key = array("q", bytes(8 * SLOTS * n_buckets))

    def _places(self, key: bytes) -> tuple[int, int, int]:
        fp = int.from_bytes(key[8:10], "little") or 1
        first = int.from_bytes(key[10:18], "little") & (self.n - 1)
        return fp, first, self._other(first, fp)

    def _other(self, bucket: int, fp: int) -> int:
        return bucket ^ ((fp * 0x5BD1E995 >> 3) & (self.n - 1))

    def find(self, key: bytes) -> int:
        """Slot of a live key, or -1; fingerprint hits are verified on the stored key."""
        fp, a, b = self._places(key)
        for bucket in (a, b):
            for s in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[s] == fp and self.keys[self.slot_key[s]] == key:
                    return s
        return -1

    def _place(self, number: int) -> bool:
        fp, a, b = self._places(self.keys[number])
        bucket = a
        for kick in range(KICKS):
            for bucket in ((a, b) if not kick else (bucket,)):
                for s in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                    if not self.prints[s]:
                        self.prints[s], self.slot_key[s] = fp, number
                        return True
            s = bucket * SLOTS + (number + kick) % SLOTS
            (fp, self.prints[s]), (number, self.slot_key[s]) = (self.prints[s], fp), (self.slot_key[s], number)
            bucket = self._other(bucket, fp)
        return False

    def insert(self, key: bytes) -> int:
        """Adds a key that ``find`` doesn't know; its number."""
        self.keys.append(key)
        if not self._place(len(self.keys) - 1):
            self.resize()
        return len(self.keys) - 1

    def resize(self) -> None:
        size = 2 * self.n
        while True:
            self._clear(size)
            if all(self._place(i) for i, k in enumerate(self.keys) if k is not None):
                return
            size *= 2

    def delete(self, key: bytes) -> int:
        """Frees the slot of a live key; its number, or -1."""
        s = self.find(key)
        if s < 0:
            return -1
        number = self.slot_key[s]
        self.prints[s], self.keys[number] = 0, None
        return number


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lower = _tables(1)["lower"]
    for batch in batches:
        for part in slices(batch, "text"):
            off, data = string_buffers(part.column("text"))
            low = memoryview(lower[data].tobytes())
            out = [hashlib.sha256(low[off[i]:off[i + 1]]).digest() for i in range(part.num_rows)]
            yield pa.record_batch([part.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "digest"])


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): sha256 of the text with A-Z lower-cased, null as empty."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _digests, "doc_id long, digest binary")


def _merge_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = pa.Table.from_batches([batch]).group_by("digest").aggregate([("doc_id", "max"), ("digest", "count")])
        yield from t.select(["digest", "doc_id_max", "digest_count"]).rename_columns(["digest", "keep_id", "size"]).to_batches()


def _shard(table: pa.Table):
    f, keep, sizes = CuckooFilter(), [], []
    if table.num_rows:
        row = table.slice(0, 1).to_pylist()[0]
        blob = row["keys"]
        f._clear(row["n_buckets"])
        f.prints, f.slot_key = array("H", row["fingerprints"]), array("q", row["slot_key"])
        f.keys = [blob[i:i + DIGEST] for i in range(0, len(blob), DIGEST)]
        keep, sizes = list(row["keep_ids"]), list(row["sizes"])
    return f, keep, sizes


def _apply(key: tuple, index: pa.Table, changes: pa.Table) -> pa.Table:
    """One shard: its stored filter, then the changes (deletes before inserts)."""
    f, keep, sizes = _shard(index)
    changes = changes.sort_by([("size", "ascending")])
    for digest, doc, n in zip(*(changes.column(c).to_pylist() for c in ("digest", "keep_id", "size"))):
        if n < 0:
            f.delete(digest)
            continue
        s = f.find(digest)
        if s < 0:
            f.insert(digest)
            keep.append(doc)
            sizes.append(n)
        else:
            i = f.slot_key[s]
            sizes[i] += n
            if doc is not None and (keep[i] is None or doc > keep[i]):
                keep[i] = doc
    if any(k is None for k in f.keys):  # numbers of deleted keys are given up when the shard is stored
        live = [i for i, k in enumerate(f.keys) if k is not None]
        number = {old: new for new, old in enumerate(live)}
        f.slot_key = array("q", (number.get(k, 0) if p else 0 for k, p in zip(f.slot_key, f.prints)))
        f.keys, keep, sizes = [f.keys[i] for i in live], [keep[i] for i in live], [sizes[i] for i in live]
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "n_buckets": pa.array([f.n], pa.int64()),
                     "fingerprints": pa.array([f.prints.tobytes()], pa.binary()),
                     "slot_key": pa.array([f.slot_key.tobytes()], pa.binary()),
                     "keys": pa.array([b"".join(f.keys)], pa.binary()),
                     "keep_ids": pa.array([keep], pa.list_(pa.int64())), "sizes": pa.array([sizes], pa.list_(pa.int64()))})


def shards_for(rows: int, parallel: int) -> int:
    return max(parallel, -(-rows // SHARD_KEYS), 1)


def _of_shard(df: DataFrame, shards: int) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("long"))


def update(index: DataFrame | None, inserts: DataFrame, shards: int, deletes: DataFrame | None = None) -> DataFrame:
    """The index after taking the digests of ``deletes`` (digest) out and the rows of
    ``inserts`` (doc_id, digest) in. ``shards`` must stay the same for one index."""
    changes = inserts.select("doc_id", "digest").mapInArrow(_merge_batch, "digest binary, keep_id long, size long")
    if deletes is not None:
        gone = deletes.select("digest").distinct()
        changes = changes.union(gone.select("digest", F.lit(None).cast("long"), F.lit(-1).cast("long")))
    changes = _of_shard(changes, shards)
    if index is None:
        index = inserts.sparkSession.createDataFrame([], INDEX_SCHEMA)
    return index.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(_apply, INDEX_SCHEMA)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            blob = row["keys"]
            yield pa.record_batch([pa.array([blob[i:i + DIGEST] for i in range(0, len(blob), DIGEST)], pa.binary()),
                                   pa.array(row["keep_ids"], pa.int64()), pa.array(row["sizes"], pa.int64())],
                                  ["digest", "keep_id", "group_size"])


def entries(index: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of the live digests."""
    return index.mapInArrow(_entries, "digest binary, keep_id long, group_size long")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) per row of ``docs`` (doc_id,
    text; further columns are ignored).

    Texts are equal when identical after lower-casing A-Z; null is the empty text,
    and empty texts are equal to each other. The row with the largest doc_id stays.
    Rows that repeat that doc_id with the same text all count as that row. A row with
    null doc_id goes if a copy has an id; without one keep_id is null and the row
    stays. An empty table gives an empty result."""
    rows = kept(digests(docs))
    parallel = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = update(None, rows, shards_for(rows.count(), parallel))
    copies = kept(entries(index).where("group_size > 1"))
    return (rows.join(copies, "digest", "left")
            .select("doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                    F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.lower(F.hex("digest")).alias("text_sha256"))
            .select("doc_id", "keep_id", "group_size",
                    F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
