"""Token ids in binary files with Elias-Fano document boundaries.

A dataset is a folder of files in ascending order of doc_id. A file (little-endian):

    magic "EFTOKENS"
    ids        n_tokens ids of ``width`` bytes (2 or 4), document after document
    ends       Elias-Fano code of the documents' ends in the ids
    names      Elias-Fano code of the doc_ids, less ``base``; the first ``unnamed``
               documents have none
    footer     n_docs, n_tokens, base, unnamed, width, bytes of ids, ends and names; magic

So a document's place costs about 2 + log2(mean tokens) bits, its name the like, and a
reader seeks to any document by two selects.

Rows are range-partitioned by doc_id, each task streams one file to the shared folder, under a
name of its own attempt, and only the files of finished tasks enter the list of
files: a lost executor's task is run again and its torn file is never read."""

from __future__ import annotations

import struct
import sys
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared_fs import opened
from . import bpe
from .elias_fano import EliasFano
from .elias_fano import encode as ef_encode
from .tables import kept, shared_folder
from .words import slices

MAGIC = b"EFTOKENS"
FOOTER = "<QQqQQQQQ8s"
FOOTER_BYTES = struct.calcsize(FOOTER)
END = 2
FILES = "file string, shard long, n_docs long, n_tokens long"
#: Documents a reading task takes at a time, and ids it holds at a time.
READ_DOCS = 4096
READ_TOKENS = 1 << 20


class Writer:
    """One file, written front to back; only a document's length and name are held."""

    def __init__(self, path: str, width: int):
        fs, at = opened(path)
        self.width, self.n_tokens = width, 0
        self.lengths: list[int] = []
        self.names: list[int | None] = []
        self._out = fs.open_output_stream(at)
        self._out.write(MAGIC)

    def add(self, name: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> 8 * self.width:
            raise ValueError(f"an id is wider than {self.width} bytes")
        if name is not None and self.names and self.names[-1] is not None and name < self.names[-1] or name is None and self.names and self.names[-1] is not None:
            raise ValueError("documents must ascend by name, those without first")
        self._out.write(ids.astype(f"<u{self.width}").tobytes())
        self.n_tokens += len(ids)
        self.lengths.append(len(ids))
        self.names.append(name)

    def close(self) -> tuple[int, int]:
        named = [x for x in self.names if x is not None]
        base = named[0] if named else 0
        ends = ef_encode(np.cumsum(self.lengths, dtype=np.uint64), self.n_tokens + 1)
        names = ef_encode(np.array([x - base for x in named], np.uint64), (named[-1] - base + 1) if named else 1)
        self._out.write(ends)
        self._out.write(names)
        n = len(self.names)
        self._out.write(struct.pack(FOOTER, n, self.n_tokens, base, n - len(named), self.width, self.n_tokens * self.width, len(ends), len(names), MAGIC))
        self._out.close()
        return n, self.n_tokens


class Reader:
    """A file: lengths and names of documents, and any span of ids."""

    def __init__(self, path: str):
        fs, at = opened(path)
        self._in = fs.open_input_file(at)
        size = self._in.size()
        if size < len(MAGIC) + FOOTER_BYTES or self._in.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} is no token file")
        (self.n_docs, self.n_tokens, self.base, self.unnamed, self.width, ids, ends, names, magic) = struct.unpack(FOOTER, self._in.read_at(FOOTER_BYTES, size - FOOTER_BYTES))
        if magic != MAGIC or len(MAGIC) + ids + ends + names + FOOTER_BYTES != size:
            raise ValueError(f"{path} is torn")
        self.ends = EliasFano(self._in.read_at(ends, len(MAGIC) + ids))
        self.names = EliasFano(self._in.read_at(names, len(MAGIC) + ids + ends))

    def offsets(self, first: int, stop: int) -> np.ndarray:
        """Places in the ids where the documents first to stop - 1 begin, and the last one's end."""
        head = self.ends.select(first - 1) if first else 0
        return np.concatenate([[head], self.ends.range(first, stop).astype(np.int64)])

    def doc_ids(self, first: int, stop: int) -> list[int | None]:
        none = [None] * max(0, min(stop, self.unnamed) - first)
        return none + [self.base + int(x) for x in self.names.range(first - self.unnamed, stop - self.unnamed)]

    def ids(self, start: int, stop: int) -> np.ndarray:
        return np.frombuffer(self._in.read_at((stop - start) * self.width, len(MAGIC) + start * self.width), f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        start, stop = self.offsets(i, i + 1)
        return self.ids(int(start), int(stop))

    def close(self) -> None:
        self._in.close()


def _write(folder: str, vocabulary: str, end: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, writer = TaskContext.get(), None
        path = f"{folder}/{task.partitionId():08d}-{uuid.uuid4().hex}.eft"
        for batch in batches:
            for part in slices(batch, "text"):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    writer = writer or Writer(path, width)
                    writer.add(doc, np.append(bpe.encode(text or "", True, vocabulary), np.uint32(end)))
        if writer:
            n_docs, n_tokens = writer.close()
            yield pa.record_batch([pa.array([path]), pa.array([task.partitionId()], pa.int64()), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64())],
                                  ["file", "shard", "n_docs", "n_tokens"])

    return run


def write_tokens(docs: DataFrame, folder: str, vocabulary: str = bpe.VOCABULARY, end: int = END, width: int = 2) -> DataFrame:
    """Writes the ids of every text of ``docs`` (doc_id, text; further columns are ignored),
    each document closed by ``end``, to files under ``folder`` in ascending doc_id order;
    returns the list of files (file, shard, n_docs, n_tokens, first: ids before the file).

    Null and empty texts are the end id alone. Rows without doc_id come first; repeated
    ids are documents each for itself, in the order of their texts' hashes. An id that
    ``width`` bytes can't hold is an error. An empty table gives no file. The special
    token's string in a text is that token, as the library reads it."""
    fs, at = opened(folder)
    fs.create_dir(at, recursive=True)
    order = ["doc_id", "tie", "row"]  # equal rows are told apart by place, so that a partition never needs all of them
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id()))
    files = kept(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
                 .mapInArrow(_write(folder, vocabulary, end, width), FILES))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return files.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _read():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, path = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != path:
                    if reader:
                        reader.close()
                    reader, path = Reader(row["file"]), row["file"]
                first, stop = row["doc"], min(row["doc"] + READ_DOCS, reader.n_docs)
                at = reader.offsets(first, stop)
                sums = []
                held, held_at = np.zeros(0, "<u4"), 0
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    crc = 0
                    while a < b:
                        if not held_at <= a < held_at + len(held):
                            held, held_at = reader.ids(a, min(int(at[-1]), a + READ_TOKENS)).astype("<u4"), a
                        span = held[a - held_at:b - held_at]
                        crc = zlib.crc32(span.tobytes(), crc)
                        a += len(span)
                    sums.append(crc)
                yield pa.record_batch([pa.array(reader.doc_ids(first, stop), pa.int64()), pa.array(at[:-1] + row["first"], pa.int64()),
                                       pa.array(np.diff(at), pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
        if reader:
            reader.close()

    return run


def read_index(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in ``files`` (the list that
    ``write_tokens`` gives), from the files: start counts the ids of all documents before
    it, ids_crc32 is the unsigned crc32 of its ids as little-endian uint32. Tasks read
    ``READ_DOCS`` documents of a file at a time, a bounded span of ids each."""
    spark = files.sparkSession
    pieces = files.select("file", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(READ_DOCS).cast("long"))).alias("doc"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return (pieces.repartition(tasks, "file", "doc").sortWithinPartitions("file", "doc")
            .mapInArrow(_read(), "doc_id long, start long, n_tokens long, ids_crc32 long"))


def token_index(docs: DataFrame, vocabulary: str = bpe.VOCABULARY, end: int = END) -> DataFrame:
    """``docs`` written to token files in the shared folder and read back: one row per
    document (see ``write_tokens`` and ``read_index``)."""
    return read_index(write_tokens(docs, shared_folder(docs.sparkSession, "token-files"), vocabulary, end))


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a dataset's folder."""
    fs, at = opened(folder)
    fs.delete_dir(at)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
