"""Token counts of documents in flat token files.

A flat file is a stream of token ids, one document after the other, each closed by the
end-of-text id; nothing says where documents begin. It is stored in blocks (stream,
block, tokens as little-endian uint16 or uint32). Each block is searched for the
separator in one vectorised comparison; a prefix scan over the blocks then stitches
documents that cross block boundaries: tokens and separators before each block, and the
place of the last separator before it. The scan has two levels (blocks in groups, then
groups), so that one huge file does not end in one task."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .bpe import END_OF_TEXT, VOCABULARY, encode
from .words import slices

BLOCK_TOKENS = 1 << 18
GROUP_BLOCKS = 256
FLAT_SCHEMA = "stream long, block long, tokens binary, first_doc long, doc_ids array<bigint>"


def _flatten(vocabulary: str, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, block, first, held = TaskContext.get().partitionId(), 0, 0, 0
        parts: list[np.ndarray] = []
        ends: list[tuple[int, int]] = []  # (place of the document's separator in the held tokens, doc_id)

        def cut(everything: bool):
            nonlocal parts, held, block, first, ends
            tokens = np.concatenate(parts) if parts else np.zeros(0, np.uint16)
            at = 0
            while held - at >= block_tokens or everything and at < held:
                size = min(block_tokens, held - at)
                here = [d for e, d in ends if at <= e < at + size]
                yield pa.record_batch([pa.array([stream], pa.int64()), pa.array([block], pa.int64()), pa.array([tokens[at:at + size].tobytes()], pa.binary()),
                                       pa.array([first], pa.int64()), pa.array([here], pa.list_(pa.int64()))],
                                      ["stream", "block", "tokens", "first_doc", "doc_ids"])
                block, first, at = block + 1, first + len(here), at + size
            ends = [(e - at, d) for e, d in ends if e >= at]
            parts, held = [tokens[at:]], held - at

        for batch in batches:
            for part in slices(batch, "text"):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = np.append(encode(text or "", False, vocabulary), np.uint32(END_OF_TEXT)).astype("<u2")
                    parts.append(ids)
                    held += len(ids)
                    ends.append((held - 1, doc))
                    if held >= 4 * block_tokens:
                        yield from cut(False)
        yield from cut(True)

    return run


def write_flat(docs: DataFrame, vocabulary: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS) -> str:
    """Writes the documents' tokens as flat files to the shared folder; its path. Only the
    order of the documents is kept beside the tokens (first_doc, doc_ids)."""
    path = f"{ensure_checkpoint_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
     .mapInArrow(_flatten(vocabulary, block_tokens), FLAT_SCHEMA).write.option("compression", "zstd").parquet(path))
    return path


def _search(separator: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(t or b"", f"<u{width}") for t in batch.column("tokens").to_pylist()]
            ends = [np.flatnonzero(t == separator) for t in tokens]
            yield pa.record_batch([batch.column("stream"), batch.column("block"), pa.array([len(t) for t in tokens], pa.int64()),
                                   pa.array(ends, pa.list_(pa.int64()))], ["stream", "block", "n", "ends"])

    return run


def separator_scan(blocks: DataFrame, separator: int = END_OF_TEXT, width: int = 2) -> DataFrame:
    """(stream, ordinal, start, n_tokens, closed) of every document in ``blocks`` (stream,
    block, tokens; ``width`` bytes a token). start is the document's first token in its
    stream, n_tokens leaves the separator out. Tokens after a stream's last separator are
    a document that isn't closed. Null and empty blocks hold no tokens; a stream's blocks
    are ordered by block; an empty table gives an empty result."""
    found = (blocks.select(F.col("stream").cast("long"), F.col("block").cast("long"), F.col("tokens").cast("binary"))
             .mapInArrow(_search(separator, width), "stream long, block long, n long, ends array<bigint>")
             .withColumn("g", F.floor(F.col("block") / GROUP_BLOCKS)).withColumn("n_ends", F.size("ends").cast("long"))
             .withColumn("last", F.when(F.col("n_ends") > 0, F.element_at("ends", -1))))
    inside = Window.partitionBy("stream", "g").orderBy("block")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = (found.withColumn("t0", F.coalesce(F.sum("n").over(before), F.lit(0)))
             .withColumn("d0", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
             .withColumn("p0", F.max(F.col("t0") + F.col("last")).over(before)))
    # Places inside a group are relative to the group; the group table is one row a group.
    groups = (local.groupBy("stream", "g").agg(F.sum("n").alias("gn"), F.sum("n_ends").alias("gd"), F.max(F.col("t0") + F.col("last")).alias("gp")))
    up_to = Window.partitionBy("stream").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    carried = (groups.withColumn("gt0", F.coalesce(F.sum("gn").over(up_to), F.lit(0))).withColumn("gd0", F.coalesce(F.sum("gd").over(up_to), F.lit(0)))
               .withColumn("gp0", F.max(F.col("gt0") + F.col("gp")).over(up_to))
               .withColumn("last_group", F.lead("g").over(Window.partitionBy("stream").orderBy("g")).isNull())
               .select("stream", "g", "gt0", "gd0", "gp0", "last_group"))
    at = (local.join(carried, ["stream", "g"])
          .withColumn("base", F.col("gt0") + F.col("t0"))
          .withColumn("open", F.coalesce(F.col("gt0") + F.col("p0"), F.col("gp0"), F.lit(-1)) + 1)
          .withColumn("final", F.col("last_group") & F.lead("block").over(inside).isNull()))
    closed = (at.where("n_ends > 0")
              .select("stream", "gd0", "d0", "base", "open", "ends", F.posexplode("ends").alias("i", "e"))
              .withColumn("start", F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("base") + F.get("ends", F.col("i") - 1) + 1))
              .select("stream", (F.col("gd0") + F.col("d0") + F.col("i")).alias("ordinal"), "start",
                      (F.col("base") + F.col("e") - F.col("start")).alias("n_tokens"), F.lit(True).alias("closed")))
    start = F.when(F.col("n_ends") > 0, F.col("base") + F.col("last") + 1).otherwise(F.col("open"))
    left = (at.where("final").select("stream", (F.col("gd0") + F.col("d0") + F.col("n_ends")).alias("ordinal"), start.alias("start"),
                                     (F.col("base") + F.col("n") - start).alias("n_tokens"), F.lit(False).alias("closed")).where("n_tokens > 0"))
    return closed.union(left)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, n_tokens, stream, start) per row of ``docs`` (doc_id, text; further columns
    are ignored), counted by a separator scan over flat files of their tokens. Null and
    empty texts have no token; rows are counted each for itself, repeated or without
    doc_id too; the special token's string in a text is ordinary text. An empty table
    gives an empty result."""
    flat = docs.sparkSession.read.schema(FLAT_SCHEMA).parquet(write_flat(docs, vocabulary, block_tokens))
    names = flat.select("stream", "first_doc", F.posexplode("doc_ids").alias("i", "doc_id")).select(
        "stream", (F.col("first_doc") + F.col("i")).alias("ordinal"), "doc_id")
    return (separator_scan(flat).join(names, ["stream", "ordinal"]).select("doc_id", "n_tokens", "stream", "start"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
