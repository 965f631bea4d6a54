"""From raw documents to packed training sequences.

Each stage calls one operator of ``svcseam.llm`` on all that its predecessor kept.
All stages but the last return the columns of ``documents``; the last returns the
pieces of the packed sequences. Toxicity is scored in the scan; the other filters
decide for rows, so texts that share a doc_id or have none are told apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from svcseam.llm import containment, exact_dup, near_dup, packing, toxicity
from svcseam.llm.tables import UPPER, fold, kept, read, remove, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches 0.5 go; scored in the scan, nothing is shuffled."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) == 0)
    return docs.select(*COLUMNS).where(toxicity.toxicity_score(model, F.col("text")) < 0.5)


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``key``, a number of each row's own, so that decisions hold for rows: the
    doc_id where every row has one of its own, else the row's place in a stored copy."""
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return docs.withColumn("key", F.col("doc_id"))
    return kept(docs.withColumn("key", F.monotonically_increasing_id()))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays (one row of it, if it is
    repeated; a row without doc_id only if none has one)."""
    found = exact_dup.exact_duplicates(docs)
    stay = found.where("kept").select(F.col("text_sha256").alias("digest"), _id(F.col("doc_id")).alias("id")).distinct()
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, UPPER.lower())
    rows = docs.select(*COLUMNS).withColumn("digest", F.sha2(text, 256)).withColumn("id", _id(F.col("doc_id")))
    return rows.join(stay, ["digest", "id"], "left_semi").dropDuplicates(["digest", "id"]).select(*COLUMNS)


def _id(doc_id):
    return F.coalesce(doc_id.cast("string"), F.lit("-"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the smallest doc_id (rows without
    one come last)."""
    rows = _keyed(docs)
    groups = near_dup.near_duplicates(rows.select(F.col("key").alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    first = groups.join(rows.select("key", "doc_id"), "key").groupBy("component_id").agg(F.min(order).alias("o")).select("o.key")
    return rows.join(groups.select("key").join(first, "key", "left_anti"), "key", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    rows = _keyed(docs)
    leaks = containment.contained_items(rows.select(F.col("key").alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    return rows.join(leaks.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 1024 ids."""
    return packing.with_digest(packing.pack(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", pack),
]

#: Classifiers, MinHash components and tokenisers cannot be said in SQL; the tests hold
#: the pipeline against brute-force versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    base, before = shared_folder(spark, "pipeline"), None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
