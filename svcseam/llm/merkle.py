"""Merkle manifest of a dataset: one leaf per row, one subtree per source, one root.

H is the lowercase hex sha256 of its inputs joined, digests as hex text. A leaf is H of
a row's fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value. The
leaves of a source ascend by id; while a tree has several nodes, every ``FANOUT``
consecutive ones (the last run has fewer, even one) become their H. The subroots,
ordered by source (null first, bytewise), become the root in the same way.

Per level, lag and lead columns of fixed offsets over windows of ``CHUNK`` consecutive
nodes, masked by slot and run length, give every node its siblings; the rows of first
children hash the parents. Runs never cross a chunk, so no window holds more than
``CHUNK`` rows and a source with a third of all rows is spread over many tasks. Paths
come back down level by level, a chunk at a time, on the partitioning of the windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import UPPER, kept

FANOUT = 16
CHUNK = FANOUT * FANOUT
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def framed(value: Column) -> Column:
    """``-`` for null, else byte count, ``:`` and the value as text."""
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def positions(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (0-based place of the row in its ``tree`` by ``order``) and
    ``n`` (rows of the tree). Rows are range-partitioned, numbered inside their
    partition, and shifted by the counts of the partitions before; only that table of
    one row per tree and partition is windowed. A full tie keeps any order."""
    placed = kept(rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
                  .withColumn("_at", F.monotonically_increasing_id())
                  .withColumn("_part", F.shiftright("_at", 33)))
    counts = placed.groupBy(tree, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(tree)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(tree, "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"),
                           F.sum("_rows").over(whole).alias("n"))
    return (placed.join(starts, [tree, "_part"]).withColumn("pos", F.col("_base") + F.col("_at") - F.col("_first"))
            .drop("_at", "_part", "_first", "_base"))


def siblings(nodes: DataFrame) -> DataFrame:
    """``nodes`` (tree, pos, n, hash) with ``chunk``, ``slot`` in the run, and the joined
    hashes of the run's nodes before (``left``) and after (``right``) each node."""
    chunked = (nodes.withColumn("chunk", F.expr(f"pos div {CHUNK}")).withColumn("slot", (F.col("pos") % FANOUT).cast("int"))
               .withColumn("run_length", F.least(F.lit(FANOUT).cast("long"), F.col("n") - (F.col("pos") - F.col("slot"))).cast("int")))
    w = Window.partitionBy("tree", "chunk").orderBy("pos")
    none = F.lit("")
    left = [F.when(F.col("slot") >= d, F.lag("hash", d).over(w)).otherwise(none) for d in range(FANOUT - 1, 0, -1)]
    right = [F.when(F.col("slot") + d < F.col("run_length"), F.lead("hash", d).over(w)).otherwise(none) for d in range(1, FANOUT)]
    return chunked.withColumns({"left": F.concat(*left), "right": F.concat(*right)})


def parents(nodes: DataFrame) -> DataFrame:
    """The level above: first children hash their run; the only node of a tree stays."""
    return (siblings(nodes).where("slot = 0")
            .select("tree", F.expr(f"pos div {FANOUT}").alias("pos"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"),
                    F.when(F.col("n") > 1, digest(F.col("hash"), F.col("right"))).otherwise(F.col("hash")).alias("hash")))


def levels(nodes: DataFrame) -> list[DataFrame]:
    """The levels (tree, pos, n, hash) from the given nodes up to one node a tree; each
    but the first is written to the checkpoint folder (a sixteenth of the one below)."""
    out = [nodes.select("tree", "pos", "n", "hash")]
    most = out[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        out.append(kept(parents(out[-1])))
        most = -(-most // FANOUT)
    return out


def paths(nodes: DataFrame, above: list[DataFrame], top: DataFrame) -> DataFrame:
    """``nodes`` (tree, pos, n, hash, ...) with ``path``: the (left, right) siblings of each
    level from the node up, then the path that ``top`` (tree, path, end) gives its tree; and
    ``end``, what ``top`` says of the tree's last node."""
    if not above:
        return nodes.join(top, "tree")
    upper = paths(above[0], above[1:], top)
    # The parents' paths, at most FANOUT a chunk, meet the chunk's window partitioning.
    gathered = (upper.groupBy("tree", F.expr(f"pos div {FANOUT}").alias("chunk"))
                .agg(F.first("end").alias("end"), F.map_from_entries(F.collect_list(F.struct("pos", "path"))).alias("_paths")))
    own = F.when(F.col("n") > 1, F.array(F.struct("left", "right"))).otherwise(F.array().cast("array<struct<left:string,right:string>>"))
    return (siblings(nodes).join(gathered, ["tree", "chunk"])
            .withColumn("path", F.concat(own, F.element_at("_paths", F.expr(f"pos div {FANOUT}"))))
            .drop("_paths", "left", "right", "chunk", "slot", "run_length"))


@dataclass
class Manifest:
    """``rows``: doc_id, leaf, changed (the tampered leaf, null if none), subroot, root, path.
    ``sources``: source, n (its leaves), subroot. ``root``: one row, one column root."""

    rows: DataFrame
    sources: DataFrame
    root: DataFrame


def manifest(docs: DataFrame, tampered: Column | None = None, changed_text: Column | None = None) -> Manifest:
    """The trees over ``docs`` (doc_id, source, lang, n_chars, text; further columns are
    ignored). Rows where ``tampered`` holds also get the leaf of ``changed_text``.

    Every row is a leaf, repeated ones and those without doc_id too (null ids come
    first, equal ids ascend by leaf). Null fields are framed as ``-`` and so differ from
    empty ones; a null source is a source of its own. Texts of any length are one leaf.
    An empty table has no rows and no root."""
    if tampered is None:
        tampered, changed_text = F.lit(False), F.col("text")
    fields = {c: framed(F.col(c)) for c in FIELDS}
    leaf = digest(*fields.values())
    changed = F.when(tampered, digest(*(fields | {"text": framed(changed_text)}).values()))
    # Null sources first, then bytewise: '-' is below ':'.
    tree = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit(":"), F.col("source").cast("string")))
    leaves = kept(docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), leaf.alias("hash"), changed.alias("changed"))
                  .withColumn("row", F.monotonically_increasing_id()))
    placed = kept(positions(leaves, "tree", ["doc_id", "hash", "row"]))
    below = levels(placed)
    subroots = below[-1].select("tree", F.col("hash").alias("subroot")) if len(below) > 1 else placed.select("tree", F.col("hash").alias("subroot"))
    # The subroots are one more tree, in the order of the sources.
    over = kept(positions(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source_key"), F.col("subroot").alias("hash")), "tree", ["source_key"]))
    upper = levels(over)
    start = upper[-1].select("tree", F.col("hash").alias("end"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    tops = paths(over, upper[1:], start).select(F.col("source_key").alias("tree"), F.struct(F.col("hash").alias("subroot"), F.col("end").alias("root")).alias("end"), "path")
    rows = paths(placed, below[1:], tops)
    name = F.when(F.col("tree") != "-", F.expr("substring(tree, 2)"))
    sources = placed.groupBy("tree").agg(F.count("*").alias("n")).join(tops, "tree").select(name.alias("source"), "n", "end.subroot")
    return Manifest(rows.select("doc_id", F.col("hash").alias("leaf"), "changed", "end.subroot", "end.root", "path"), sources,
                    upper[-1].select(F.col("hash").alias("root")))


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` gives under the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["left"], h, s["right"]))


def proof_digest(path: Column) -> Column:
    """H of a path's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def verify(m: Manifest) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row;
    folded_root starts from the changed leaf where there is one."""
    return (m.rows.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("path")))
            .select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified")))


def verify_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` checked against rows whose text is lower-cased (A-Z) where
    5 divides the crc32 of the id as text; rows without id are not changed."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return verify(manifest(docs, F.coalesce(hit, F.lit(False)), F.translate(F.col("text").cast("string"), UPPER, UPPER.lower())))
