"""Benchmark decontamination: short test items inside long documents.

Containment of an item in a document is the share of the item's distinct 5-word
shingles that the document has. Items are partitioned by size (powers of two); each
keeps a bottom-k MinHash sketch, the k of its shingles that come first under a fixed
hash order, with k set by its size class: an item of n shingles at containment 0.75
misses at most n - ceil(0.75 n) of them, so with k larger than that every leaked
item shares at least k - (n - ceil(0.75 n)) sketch members with the document and the
search has no false negatives. Documents are never sketched or cut: their shingles
meet the sketches in one equi-join, pairs with too few sketch matches are dropped,
and the rest is verified on all shingles. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import kept

WIDTH, THRESHOLD, EXTRA = 5, 75, 4
SPACE = " \t\n\x0b\f\r"
#: Item shingles are broadcast up to this many rows (24 bytes each) and shuffled beyond.
BROADCAST_ROWS = 400_000


def words(text: Column) -> Column:
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(SPACE))
    return F.when(trimmed != "", F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def shingle_rows(df: DataFrame, key: str) -> DataFrame:
    """(key, h): one row per run of five words; texts with fewer words give none."""
    w = F.col("w")
    parts = [w] + [F.slice(w, j + 1, F.greatest(F.size(w), F.lit(1))) for j in range(1, WIDTH)]
    run = F.arrays_zip(*[p.alias(f"w{j}") for j, p in enumerate(parts)])
    return (df.select(F.col(key), words(F.col("text")).alias("w")).where(F.size("w") >= WIDTH)
            .select(key, F.explode(run).alias("s")).where(F.col(f"s.w{WIDTH - 1}").isNotNull())
            .select(key, F.xxhash64(*[F.col(f"s.w{j}") for j in range(WIDTH)]).alias("h")))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contained_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, containment) for every document and
    item with 100 * shared >= 75 * item_shingles.

    Null texts and texts under five words have no shingles: such items are not
    searched (too short to tell a leak from chance), such documents contain nothing.
    Rows with a null id are left out; rows that share an id are one document or item;
    further columns are ignored; empty tables give an empty result."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    full = kept(shingle_rows(items, "item_id").distinct())
    sizes = full.groupBy("item_id").agg(F.count("*").alias("n"))
    spare = F.col("n") - F.ceil(F.col("n") * THRESHOLD / 100)  # shingles a leak may miss
    top = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1  # largest size of the class
    k = F.least(F.col("n"), (top - F.ceil(top * THRESHOLD / 100) + 1 + EXTRA).cast("long"))
    order = Window.partitionBy("item_id").orderBy(F.xxhash64("h", F.lit(9)), "h")
    sketch = kept(full.join(sizes, "item_id").withColumn("rank", F.row_number().over(order))
                  .withColumn("k", k).where("rank <= k")
                  .select("h", "item_id", (F.col("k") - spare).cast("int").alias("need")))
    full_rows = full.count()
    met = (shingle_rows(docs, "doc_id").join(_small(sketch, full_rows), "h")
           .groupBy("doc_id", "item_id", "need", "h").agg(F.lit(1).alias("one"))
           .groupBy("doc_id", "item_id").agg(F.count("*").alias("met"), F.max("need").alias("need")))
    candidates = kept(met.where("met >= need").select("doc_id", "item_id"))
    suspects = docs.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    shared = (shingle_rows(suspects, "doc_id").join(_small(full, full_rows), "h")
              .groupBy("doc_id", "item_id", "h").agg(F.lit(1).alias("one"))
              .groupBy("doc_id", "item_id").agg(F.count("*").alias("shared")))
    return (shared.join(candidates, ["doc_id", "item_id"], "left_semi").join(_small(sizes, full_rows), "item_id")
            .where(100 * F.col("shared") >= THRESHOLD * F.col("n"))
            .select("doc_id", "item_id", F.col("n").alias("item_shingles"), "shared", (F.col("shared") / F.col("n")).alias("containment")))
