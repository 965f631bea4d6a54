"""MinHash near-duplicates with sequential Bayesian verification.

1. One pass over the texts gives each document its number of distinct 5-word
   shingles, a 128-bit fingerprint of its word sequence and a signature of 128
   32-bit MinHashes. Documents with equal word sequences share one representative.
2. Signatures are cut into bands of 4; documents that agree in a band are
   candidates. (A pair of similarity 0.75 misses all 32 bands with probability
   5e-6, one of 0.85 with 1e-10.)
3. Candidates' signatures are compared in batches of 16 hashes. After each batch
   the posterior of the similarity (uniform prior) is known; the pair goes when
   P(similarity >= threshold) falls below the chosen miss probability.
4. Survivors are verified on their full shingle sets.

The pairs of a bucket of more than ``SMALL`` members are not enumerated. Every member is
compared with the bucket's pivot (the member that agrees with most others), and linked
members merge into components; a group of g near copies costs about g comparisons. Where
the documents that large buckets connect (a family) still hold several components, the
members outside the largest one are a query set, compared with the whole family in
blocks inside the tasks, by the same test; only links leave a task. So no pair across
components is left out, and no rows of pairs are made.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import kept
from .words import bounds, constants, mix64, shingles, slices, tokens

HASHES, ROWS, BATCH = 128, 4, 16
THRESHOLD, MISS = 75, 1e-6
#: Buckets of at most this many members are compared pair by pair.
SMALL = 8
#: Blocks of a family hold about this many shingles (8 bytes each).
BLOCK_SHINGLES = 1_000_000
BLOCK_DOCS = 2048
#: Ids of candidates are broadcast to the scan up to this many (8 bytes each), and shuffled beyond.
BROADCAST_IDS = 1_000_000


def _signature(h: np.ndarray, xor: np.ndarray, mul: np.ndarray) -> np.ndarray:
    low = np.full(len(xor), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 512):
        x = (h[i:i + 512, None] ^ xor) * mul
        x ^= x >> np.uint32(16)
        np.minimum(low, x.min(axis=0), out=low)
    return low


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c = constants(2 * HASHES, 11)
    xor, mul = (c[:HASHES] >> np.uint64(32)).astype(np.uint32), (c[HASHES:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    for batch in batches:
        for part in slices(batch, "text"):
            row, _, _, word, _ = tokens(part.column("text"))
            wb = bounds(row, part.num_rows)
            srow, sh = shingles(row, word)
            sb = bounds(srow, part.num_rows)
            low32 = (sh >> np.uint64(32)).astype(np.uint32)
            place = constants(1, 12)[0] * np.arange(1, len(word) + 1, dtype=np.uint64)
            n, prints, sigs = [], [], []
            for i in range(part.num_rows):
                a, b = sb[i], sb[i + 1]
                n.append(int(np.unique(sh[a:b]).size))
                w = word[wb[i]:wb[i + 1]]
                at = place[:len(w)]
                f = np.array([len(w), (mix64(w + at)).sum(dtype=np.uint64), (mix64(w ^ mix64(at))).sum(dtype=np.uint64)], np.uint64)
                prints.append(mix64(f[1:] + f[0]).tobytes())
                sigs.append(_signature(low32[a:b], xor, mul).tobytes() if b > a else None)
            yield pa.record_batch([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(prints, pa.binary()),
                                   pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "fp", "sig"])


def profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, fp, sig) per row of (doc_id, text); sig is null without words."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _profiles, "doc_id long, n_shingles long, fp binary, sig binary")


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    many = HASHES // ROWS
    mult = constants(ROWS, 13) | np.uint64(1)
    band = constants(many, 14)
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, many, ROWS).astype(np.uint64)
        key = mix64((sig * mult).sum(axis=2, dtype=np.uint64) + band)
        ids = np.repeat(batch.column("doc_id").to_numpy(), many)
        yield pa.record_batch([pa.array(key.reshape(-1).view(np.int64)), pa.array(ids)], ["bucket", "doc_id"])


def least_matches(threshold: float, miss: float, hashes: int = HASHES, batch: int = BATCH) -> list[int]:
    """For batch, 2*batch, ... compared hashes: the fewest matches that keep
    P(similarity >= threshold) at or above ``miss`` under a uniform prior.
    With m of n matching the posterior is Beta(1+m, 1+n-m), and its upper tail at
    t is P(Binomial(n+1, t) <= m)."""
    out = []
    for n in range(batch, hashes + 1, batch):
        tail, m = (1 - threshold) ** (n + 1), 0
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _verify_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    need = least_matches(THRESHOLD / 100, MISS)
    for batch in batches:
        for i in range(0, batch.num_rows, 2048):
            part = batch.slice(i, 2048)
            a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("sa", "sb"))
            live, same = np.arange(part.num_rows), np.zeros(part.num_rows, np.int64)
            for k, least in enumerate(need):
                cut = slice(k * BATCH, (k + 1) * BATCH)
                same[live] += (a[live, cut] == b[live, cut]).sum(axis=1)
                live = live[same[live] >= least]
            yield pa.record_batch([part.column(c).take(pa.array(live)) for c in ("a", "b")], ["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            row, _, _, word, _ = tokens(part.column("text"))
            srow, sh = shingles(row, word)
            sb = bounds(srow, part.num_rows)
            sets = [np.unique(sh[sb[i]:sb[i + 1]]).view(np.int64) for i in range(part.num_rows)]
            yield pa.record_batch([part.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "shingles"])


def verified_links(pairs: DataFrame, sigs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full 5-word shingle sets reach the threshold."""
    both = (pairs.join(sigs.toDF("a", "na", "sa"), "a").join(sigs.toDF("b", "nb", "sb"), "b")
            .where(f"100 * least(na, nb) >= {THRESHOLD} * greatest(na, nb)"))
    likely = kept(both.select("a", "b", "sa", "sb").mapInArrow(_verify_signatures, "a long, b long"))
    inter = F.size(F.array_intersect("xa", "xb"))
    return (likely.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b")
            .select("a", "b", inter.alias("both"), (F.size("xa") + F.size("xb") - inter).alias("union"))
            .where(f"100 * both >= {THRESHOLD} * union").select("a", "b"))


def _to_compare(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b) for the pairs of small buckets, and for every member b of a large one and its
    pivot a, the member that agrees with most others in all its buckets."""
    sized = kept(members.join(members.groupBy("bucket").agg(F.count("*").alias("size")), "bucket"))
    few = sized.where(F.col("size") <= SMALL)
    small = (few.select("bucket", F.col("doc_id").alias("a")).join(few.select("bucket", F.col("doc_id").alias("b")), "bucket")
             .where("a < b").select("a", "b").distinct())
    many = sized.where(F.col("size") > SMALL)
    degree = many.groupBy("doc_id").agg(F.sum("size").alias("degree"))
    large = kept(many.select("bucket", "doc_id").join(degree, "doc_id"))
    pivots = large.groupBy("bucket").agg(F.max(F.struct("degree", F.col("doc_id").alias("a"))).alias("p")).select("bucket", "p.a")
    star = kept(large.join(pivots, "bucket").where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct())
    return small, star


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def _families(star: DataFrame, labels: DataFrame, sigs: DataFrame) -> DataFrame:
    """(doc_id, comp, family, query, qb, tb) for families, documents that large buckets
    connect, that hold several components. Every member outside the family's largest
    component is a query; qb and tb are the numbers of query and target blocks."""
    family = components(star.toDF("u", "v")).toDF("doc_id", "family")
    docs = kept(family.join(labels.toDF("doc_id", "component"), "doc_id", "left").join(sigs.select("doc_id", F.col("n_shingles").alias("n")), "doc_id")
                .select("doc_id", "family", "n", F.coalesce("component", "doc_id").alias("comp")))
    comps = docs.groupBy("family", "comp").agg(F.count("*").alias("docs"), F.sum("n").alias("n"))

    def blocks(shingles, rows):  # bounded in shingles and, for short documents, in rows
        return F.ceil(F.greatest(_col(shingles) / BLOCK_SHINGLES, _col(rows) / BLOCK_DOCS)).cast("int")

    largest = (comps.groupBy("family").agg(F.max(F.struct("docs", F.col("comp").alias("main"), F.col("n").alias("main_n"))).alias("m"),
                                           F.sum("n").alias("all_n"), F.sum("docs").alias("all_docs"), F.count("*").alias("comps")).where("comps > 1")
               .select("family", "m.main", blocks("all_n", "all_docs").alias("tb"),
                       blocks(F.col("all_n") - F.col("m.main_n"), F.col("all_docs") - F.col("m.docs")).alias("qb")))
    return docs.join(largest, "family").select("doc_id", "comp", "family", (F.col("comp") != F.col("main")).alias("query"), "qb", "tb")


def _compare_blocks(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between a block of queries and a block of targets of other components:
    signatures in batches of hashes, survivors exactly on their sets."""
    table = pa.Table.from_batches(list(batches))
    is_query = table.column("is_query").to_numpy()
    q, t = (table.filter(pa.array(m)) for m in (is_query, ~is_query))
    names = ["a", "b"]
    if not q.num_rows or not t.num_rows:
        return
    sig = [np.frombuffer(b"".join(x.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES) for x in (q, t)]
    ids = [x.column("doc_id").to_numpy() for x in (q, t)]
    comp = [x.column("comp").to_numpy() for x in (q, t)]
    lists = [x.column("shingles").combine_chunks() for x in (q, t)]
    sets = [x.flatten().to_numpy() for x in lists]
    cut = [np.r_[0, np.cumsum(pc.list_value_length(x).to_numpy())] for x in lists]
    size = [np.diff(c) for c in cut]
    vocabulary, number = np.unique(sets[1], return_inverse=True)
    need = least_matches(THRESHOLD / 100, MISS)
    out = []
    for i in range(q.num_rows):
        small, large = np.minimum(size[0][i], size[1]), np.maximum(size[0][i], size[1])
        live = np.flatnonzero((comp[1] != comp[0][i]) & (100 * small >= THRESHOLD * large))
        same = np.zeros(len(live), np.int64)
        for k, least in enumerate(need):
            h = slice(k * BATCH, (k + 1) * BATCH)
            same += (sig[1][live, h] == sig[0][i, h]).sum(axis=1)
            live, same = live[same >= least], same[same >= least]
        if len(live):
            mine = sets[0][cut[0][i]:cut[0][i + 1]]
            at = np.minimum(np.searchsorted(vocabulary, mine), len(vocabulary) - 1)
            has = np.zeros(len(vocabulary), np.int64)
            has[at[vocabulary[at] == mine]] = 1
            for j in live:
                both = int(has[number[cut[1][j]:cut[1][j + 1]]].sum())
                if 100 * both >= THRESHOLD * (size[0][i] + size[1][j] - both):
                    out.append((ids[0][i], ids[1][j]))
    if out:
        a, b = zip(*out)
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names)


def _family_links(families: DataFrame, sigs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components of a family: blocks of queries against blocks of targets, of
    about ``BLOCK_SHINGLES`` shingles and ``BLOCK_DOCS`` documents at most, so that no task
    holds a family."""
    full = kept(families.join(sigs.select("doc_id", "sig"), "doc_id").join(sets, "doc_id"))
    block = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["family", "q", "t", "is_query", "doc_id", "comp", "sig", "shingles"]
    queries = full.where("query").withColumn("q", block("qb")).withColumn("t", every("tb")).withColumn("is_query", F.lit(True))
    targets = full.withColumn("t", block("tb")).withColumn("q", every("qb")).withColumn("is_query", F.lit(False))
    return (queries.select(*columns).union(targets.select(*columns)).groupBy("family", "q", "t")
            .applyInArrow(_compare_blocks, "a long, b long"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs`` (doc_id, text,
    any further columns are ignored).

    A document's set are its distinct 5-word shingles, or its whole word sequence
    if it has fewer words; without words (or with null text) the set is empty and
    the document is linked with nothing. Links are pairs with
    100 * intersection >= 75 * union; component_id is the smallest doc_id
    reachable. Repeated rows are equal documents (each input row gives an output
    row; rows of one doc_id are one document). A row with null doc_id is kept and
    linked with nothing (component_id null). An empty table gives an empty result."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prof = kept(profiles(docs))
    full = prof.where("n_shingles > 0 and doc_id is not null")
    groups = kept(full.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    # Rows of one doc_id are one document: each of its texts counts once, or links multiply.
    repeated = not full.groupBy("doc_id").count().where("count > 1").isEmpty()
    once = (lambda df, *key: df.dropDuplicates(["doc_id", *key])) if repeated else (lambda df, *key: df)
    reps = once(full.join(groups.select("fp", F.col("rep").alias("doc_id")), ["fp", "doc_id"], "left_semi"), "fp")
    rows = reps.select("doc_id", "sig").mapInArrow(_bands, "bucket long, doc_id long")
    rows = kept(rows)
    shared = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = kept(rows.join(shared.select("bucket"), "bucket"))
    ids = members.select("doc_id").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sigs = kept(once(full.join(ids, "doc_id", "left_semi"), "fp").select("doc_id", "n_shingles", "sig"))
    sets = kept(once(docs.join(ids, "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, shingles array<bigint>"), "shingles").where("size(shingles) > 0"))
    small, star = _to_compare(members)
    labels = components(verified_links(small.union(star).distinct(), sigs, sets).toDF("u", "v"))
    rest = _family_links(_families(star, labels, sigs), sigs, sets)
    labels = components(labels.toDF("u", "v").union(rest.toDF("u", "v")))
    of = (groups.join(labels, groups.rep == labels.node, "left")
          .select("fp", "rep", F.coalesce("component", "rep").alias("component_id")))
    out = (prof.withColumn("key", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("fp")))
           .join(of.select(F.col("fp").alias("key"), "component_id"), "key", "left")
           .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
