"""Hard negatives by Kronecker-packed inner products.

A vector's components become integers, and scores are integer inner products, exact.
Several candidates' components, biased to be non-negative, go into separated fields of one
wide integer; one multiplication by an anchor's component multiplies all of them, and the
sum over the components holds the candidates' scores side by side, unpacked by shift and
mask. A field is as wide as the largest sum it can hold, so no carry leaves it. Words of up
to 53 bits are exact in a double, and their products are a matrix product; where not even one
field fits, words are Python integers of eight fields.

Two steps run over cells (group of rows x block of anchors) that Spark deals out by
shuffles: rows are dealt to groups by a hash, so a label with a third of all rows is spread
over all of them. Step one finds the best rows of the anchor's label, step two, for
each of these, the best rows of other labels inside its score band. A cell hands on at most
its own best few for each anchor, and windows take the best of those. Anchors, a stated
query set, are copied to every group of rows and rows to every block of anchors; both
counts come from the numbers of components, so that a cell's memory is bounded."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import kept

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # percent of the positive's score
GROUP_VALUES = 1 << 24  # components of a cell's rows
BLOCK_VALUES, BLOCK_ANCHORS = 1 << 22, 1 << 15  # components of a cell's anchors, and their number
STRIP, CHUNK = 512, 4096  # anchors and rows of one product
EXACT = 53  # bits of a double's integers
WIDE_FIELDS = 8
NO_ID = np.iinfo(np.int64).max  # in sorting, a missing id comes last
NONE = np.iinfo(np.int64).min
LIMIT = 1 << 62


# ------------------------------------------------------------------ packed products
def field_bits(dim: int, a: int, b: int) -> int:
    """Bits that hold a sum of ``dim`` products of values up to 2a and 2b."""
    return max(1, (4 * dim * a * b).bit_length())


def packed_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products (anchors x rows) of integer matrices, as int64 (as Python
    integers where a product could leave int64)."""
    n, dim = rows.shape
    if not n or not len(anchors) or not dim:
        return np.zeros((len(anchors), n), np.int64)
    a, b = int(np.abs(anchors).max()), int(np.abs(rows).max())
    bits = field_bits(dim, a, b)
    fields = EXACT // bits
    wide = fields < 1
    fields = WIDE_FIELDS if wide else min(fields, n)
    kind = object if wide else np.float64
    words = -(-n // fields)
    biased = np.full((words * fields, dim), b, object if wide else np.int64)
    biased[:n] += rows.astype(object) if wide else rows
    biased = biased.reshape(fields, words, dim)  # field f of word w is row f * words + w
    word = sum(biased[f].astype(kind) * kind(1 << f * bits) if not wide else biased[f] * (1 << f * bits) for f in range(fields))
    left = (anchors.astype(object) + a) if wide else (anchors + a).astype(kind)
    sums = left @ word.T  # one product per anchor component and word
    sums = sums if wide else sums.astype(np.int64)
    mask = (1 << bits) - 1
    out = np.concatenate([(sums >> f * bits) & mask for f in range(fields)], axis=1)[:, :n]
    exact = object if wide else np.int64
    bias = b * anchors.astype(exact).sum(axis=1)[:, None] + a * rows.astype(exact).sum(axis=1)[None, :] + dim * a * b
    out = out - bias
    if wide and max(abs(int(out.max())), abs(int(out.min()))) < LIMIT:
        out = out.astype(np.int64)
    return out


# ------------------------------------------------------------------ best rows
def _best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) places of the k best allowed scores of each anchor, ties by place."""
    n = scores.shape[1]
    if scores.dtype != object and n <= CHUNK and int(np.abs(scores).max(initial=0)) < 1 << 50:
        key = np.where(allowed, scores * n + (n - 1 - np.arange(n)), NONE)
        top = np.argpartition(key, n - k, axis=1)[:, n - k:] if k < n else np.broadcast_to(np.arange(n), key.shape)
        hit = np.take_along_axis(allowed, top, 1)
        return np.nonzero(hit)[0], top[hit]
    at, row = np.nonzero(allowed)
    order = np.lexsort((row, -scores[at, row], at))
    at, row = at[order], row[order]
    first = np.searchsorted(at, at, "left")
    good = np.arange(len(at)) - first < k
    return at[good], row[good]


class Top:
    """The k best (score, id) of each anchor so far: higher scores, then smaller ids."""

    def __init__(self, anchors: int, k: int):
        self.k = k
        self.at = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)
        self.least = np.full(anchors, NONE, np.int64)  # the k-th score, or none

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(at):
            return
        at, score, ids = np.concatenate([self.at, at]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        nth = np.arange(len(at)) - np.searchsorted(at, at, "left")
        good = nth < self.k
        self.at, self.score, self.id = at[good], score[good], ids[good]
        full = nth == self.k - 1
        self.least[at[full]] = score[full]


def _matrix(column: pa.ChunkedArray, width: pa.ChunkedArray) -> np.ndarray:
    """Integer vectors as a matrix of the widest type; shorter ones are filled with zeros."""
    widths = width.to_pylist()
    parts = [np.frombuffer(v, f"<i{w}") for v, w in zip(column.to_pylist(), widths)]
    out = np.zeros((len(parts), max((len(p) for p in parts), default=0)), f"<i{max(widths, default=2)}")
    for i, p in enumerate(parts):
        out[i, :len(p)] = p
    return out


def _pad(x: np.ndarray, dim: int) -> np.ndarray:
    return x if x.shape[1] == dim else np.pad(x, ((0, 0), (0, dim - x.shape[1])))


def _cell(table: pa.Table) -> dict:
    named = pa.compute.fill_null(table.column("vec_id"), NO_ID).to_numpy()
    return {"id": named, "row": table.column("row").to_numpy(), "label": table.column("label").to_numpy(), "v": _matrix(table.column("v"), table.column("width"))}


def _long(score: np.ndarray) -> np.ndarray:
    return score.astype(np.int64)  # an OverflowError where a score leaves the long range


def _chunks(rows: dict, anchors: dict) -> Iterator[tuple[np.ndarray, dict]]:
    dim = max(rows["v"].shape[1], anchors["v"].shape[1])
    anchors["v"] = _pad(anchors["v"], dim).astype(np.int64)
    order = np.argsort(rows["id"], kind="stable")
    for i in range(0, len(order), CHUNK):
        part = {k: x[order[i:i + CHUNK]] for k, x in rows.items()}
        part["v"] = _pad(part["v"], dim).astype(np.int64)
        yield part


def _positives(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, anchors = _cell(left), _cell(right)
        top = Top(len(anchors["id"]), k)
        for part in _chunks(rows, anchors):
            for label in np.intersect1d(part["label"], anchors["label"]):
                mine, theirs = np.flatnonzero(anchors["label"] == label), np.flatnonzero(part["label"] == label)
                for i in range(0, len(mine), STRIP):
                    strip = mine[i:i + STRIP]
                    scores = packed_scores(anchors["v"][strip], part["v"][theirs])
                    at, row = _best(scores, anchors["row"][strip][:, None] != part["row"][theirs][None, :], k)
                    top.add(strip[at], _long(scores[at, row]), part["id"][theirs][row])
        return pa.table({"anchor": pa.array(anchors["row"][top.at], pa.int64()), "score": pa.array(top.score, pa.int64()),
                         "id": pa.array(top.id, pa.int64(), mask=top.id == NO_ID)})

    return run


def _negatives(k: int, low: int, high: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, anchors = _cell(left), _cell(right)
        n = len(anchors["id"])
        given = right.column("positives").to_pylist()
        most = max((len(p) for p in given), default=0)
        # Bands of whole scores; a missing positive has an empty one.
        floor, ceiling = np.full((n, most), 1, np.int64), np.zeros((n, most), np.int64)
        for i, p in enumerate(given):
            for j, x in enumerate(p):
                floor[i, j], ceiling[i, j] = -(-low * x["score"] // 100), high * x["score"] // 100
        tops = [Top(n, k) for _ in range(most)]
        for part in _chunks(rows, anchors):
            for i in range(0, n, STRIP):
                strip = np.arange(i, min(n, i + STRIP))
                scores = packed_scores(anchors["v"][strip], part["v"])
                other = anchors["label"][strip][:, None] != part["label"][None, :]
                # What could still enter: scores in a band that reach the k-th so far.
                least = np.maximum(floor[strip], np.stack([t.least[strip] for t in tops], 1)) if most else floor[strip]
                if not most:
                    continue
                near = other & (scores >= least.min(axis=1)[:, None]) & (scores <= ceiling[strip].max(axis=1)[:, None])
                at, row = np.nonzero(near) if near.mean() < 0.02 else (None, None)
                for j, top in enumerate(tops):
                    if at is None:
                        a, r = _best(scores, near & (scores >= least[:, j, None]) & (scores <= ceiling[strip, j][:, None]), k)
                    else:
                        s = scores[at, row]
                        good = (s >= least[at, j]) & (s <= ceiling[strip[at], j])
                        a, r = at[good], row[good]
                    top.add(strip[a], _long(scores[a, r]), part["id"][r])
        out = [(t.at, np.full(len(t.at), j), t.score, t.id) for j, t in enumerate(tops)]
        at, nth, score, ids = (np.concatenate([o[c] for o in out] or [np.zeros(0, np.int64)]) for c in range(4))
        return pa.table({"anchor": pa.array(anchors["row"][at], pa.int64()), "nth": pa.array(nth, pa.int32()),
                         "score": pa.array(score, pa.int64()), "id": pa.array(ids, pa.int64(), mask=ids == NO_ID)})

    return run


# ------------------------------------------------------------------ rows and cells
def _quantise(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, vectors, widths = [], [], []
            for i, v in enumerate(batch.column("embedding")):
                if not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                q = np.floor(scale * x)
                size = float(np.abs(q).max(initial=0))
                if size >= LIMIT:
                    raise ValueError(f"a component of vec_id {batch.column('vec_id')[i]} is beyond 2^62 when scaled")
                width = 2 if size < 1 << 15 else 4 if size < 1 << 31 else 8
                good.append(i)
                widths.append(width)
                vectors.append(q.astype(f"<i{width}").tobytes())
            taken = batch.select(["vec_id", "label"]).take(pa.array(good, pa.int64()))
            yield pa.record_batch([*taken.columns, pa.array(widths, pa.int32()), pa.array(vectors, pa.binary())], ["vec_id", "label", "width", "v"])

    return run


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, label, width, v): floor(scale * component) as little-endian integers of
    ``width`` bytes; ``row`` numbers the rows. Rows with a null label, a null vector
    or a null or non-finite component are left out."""
    return kept(vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>")).where("label is not null")
                .mapInArrow(_quantise(scale), "vec_id long, label long, width int, v binary").withColumn("row", F.monotonically_increasing_id()))


def _cells(rows: DataFrame, anchors: DataFrame, groups: int, blocks: int, kernel, schema: str) -> DataFrame:
    """``kernel(rows, anchors)`` over every cell of row group and anchor block."""
    dealt = rows.withColumn("g", F.pmod(F.xxhash64("row"), F.lit(groups)))
    asked = anchors.withColumn("h", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    if blocks == 1:
        dealt = dealt.withColumn("h", F.lit(0).cast("long"))
    else:
        dealt = dealt.withColumn("h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    asked = asked.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    return dealt.groupBy("g", "h").cogroup(asked.groupBy("g", "h")).applyInArrow(kernel, schema)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors``: vec_id, label, embedding (further columns are ignored); anchors are the
    rows where ``is_anchor`` holds (an expression of vec_id and label). A score is the inner product
    of floor(scale * component); higher scores come first, ties by smaller vec_id. An
    anchor's positives are its best ``positives`` other rows of its label; for each, the
    best ``negatives`` rows of another label whose score is at least ``low`` and at most
    ``high`` percent of the positive's, ranked from 1; fewer where there are fewer.

    Rows with a null label, a null vector or a null or non-finite component take no part;
    a null vec_id is last in ties. Repeated rows are rows each for itself (a copy of an
    anchor can be its positive, and is an anchor too). A vector shorter than another
    counts as filled with zeros, an empty one scores 0. Scores must fit a long, or the
    job ends with an error. An empty table gives an empty result."""
    rows = integer_vectors(vectors, scale)
    anchor = F.coalesce(is_anchor, F.lit(False))
    asked = rows.where(anchor)
    values = F.expr("length(v) div width")
    n_values, n_asked, n_anchors = rows.agg(F.sum(values), F.sum(F.when(anchor, values)), F.count_if(anchor)).first()
    groups = max(vectors.sparkSession.sparkContext.defaultParallelism * 2, -(-(n_values or 0) // GROUP_VALUES))
    blocks = max(1, -(-(n_asked or 0) // BLOCK_VALUES), -(-n_anchors // BLOCK_ANCHORS))
    better = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    found = _cells(rows, asked, groups, blocks, _positives(positives), "anchor long, score long, id long")
    best = (found.withColumn("nth", F.row_number().over(Window.partitionBy("anchor").orderBy(*better)) - 1).where(F.col("nth") < positives)
            .groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("nth", "score", "id"))).alias("positives")))
    paired = kept(asked.join(best.withColumnRenamed("anchor", "row"), "row"))  # at most ``positives`` entries each
    found = _cells(rows, paired, groups, blocks, _negatives(negatives, low, high), "anchor long, nth int, score long, id long")
    ranked = (found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "nth").orderBy(*better))).where(F.col("rank") <= negatives))
    names = paired.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.inline("positives").alias("nth", "positive_score", "positive_id"))
    return (ranked.join(names, ["anchor", "nth"])
            .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))


def relabelled(vectors: DataFrame) -> DataFrame:
    """Every seventh id gets the next label of ten, as label noise does."""
    return vectors.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
