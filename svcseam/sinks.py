"""Sinks S6–S12. Every sink is a distributed write (no driver collect),
partitioned by project so a corpus lands as one folder per project.

* S6 ``write_json``: the step-1 artifacts as JSON lines per table.
* S7–S9 the three matrix sheets as CSV with their headings; the by-domain
  sheet is sorted (O1) and split per domain (the reference's blank spacer
  row becomes the folder boundary).
* S10 normalised / TF-IDF / composite: long parquet and one wide CSV sheet per
  project, under that project's own header.
* S11 report metrics; S12 artifact manifest from a ``binaryFile`` listing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rules
from .operators import features as M
from .operators import matrix as X
from .sources import files
from .sources import wide_csv as wide_csv_source


def _by_project(df: DataFrame, partition_by: str | None):
    """A writer with one folder per project: rows are brought together by project first, so
    that a project has few files (AQE splits a large project and joins small ones)."""
    if partition_by and partition_by in df.columns:
        return df.hint("rebalance", partition_by).write.mode("overwrite").partitionBy(partition_by)
    return df.write.mode("overwrite")


def write_json(df: DataFrame, path: str, partition_by: str | None = "project_id") -> None:
    _by_project(df, partition_by).json(path)


def _csv(df: DataFrame, path: str, partition_by: str | None = "project_id") -> None:
    _by_project(df, partition_by).option("header", True).csv(path)


def write_matrix_raw(matrix: DataFrame, path: str) -> None:
    """14 columns, null table → ``none``."""
    _csv(X.matrix_raw(matrix).select("project_id", *rules.MATRIX_COLUMNS), path)


def write_matrix_readable(matrix: DataFrame, path: str) -> None:
    """10 headings; flag → Oui/Non; null table → ``aucune``."""
    r = X.matrix_readable(matrix)
    src = ["class_name", "domain", "stereotype", "related_table", "calls_out", "calls_in", "injected",
           "db_columns", "db_relations", "log_frequency"]
    _csv(r.select("project_id", *[F.col(c).alias(h) for c, h in zip(src, rules.READABLE_HEADINGS)]), path)


def write_matrix_by_domain(matrix: DataFrame, path: str) -> None:
    """S9 + O1: sorted by (domain, stereotype rank, class); one folder per domain."""
    b = X.matrix_by_domain(matrix)
    src = ["domain", "class_name", "stereotype", "related_table", "calls_out", "calls_in", "injected", "log_frequency"]
    # A range partition on the sheet's row splits a hot domain over several
    # tasks and keeps the order across part files.
    out = (b.repartitionByRange("project_id", "sheet_row").sortWithinPartitions("project_id", "sheet_row")
           .select("project_id", F.col("domain").alias("_domain"),
                   *[F.col(c).alias(h) for c, h in zip(src, rules.BY_DOMAIN_HEADINGS)]))
    out.write.mode("overwrite").option("header", True).partitionBy("project_id", "_domain").csv(path)


def write_features(long: DataFrame, path: str, wide_csv: bool = True) -> None:
    """Long parquet (scalable form) and one wide CSV sheet per project, whose columns
    are that project's own features in order (a class listed twice has one row)."""
    _by_project(long, "project_id").parquet(path + "/long")
    if wide_csv:
        wide_csv_source.write_sheets(M.wide_rows(long, [c for c in ("class_name", "related_table") if c in long.columns]), path + "/wide")


def write_report(metrics: DataFrame, path: str) -> None:
    """The long metrics table."""
    _csv(metrics, path, partition_by=None)


def manifest(spark: SparkSession, out_dir: str, expected=rules.ARTIFACTS) -> DataFrame:
    """For each expected artifact: exists?, size in KB (summed over the
    part files of a folder), step. Only file metadata is read. ``out_dir`` may be relative,
    absolute or a URI; a folder that doesn't exist holds no artifact."""
    names = F.array(*[F.struct(F.lit(n).alias("artifact"), F.lit(s).alias("step")) for n, s in expected])
    exp = spark.range(1).select(F.inline(names))
    root = files.qualified(spark, out_dir)
    if files.existing(spark, [root]):
        listing = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
                   .select(F.split_part(files.below_root(F.col("_metadata.file_path"), root), F.lit("/"), F.lit(1)).alias("artifact"), "length"))
    else:
        listing = spark.createDataFrame([], "artifact string, length long")
    sizes = listing.groupBy("artifact").agg(F.sum("length").alias("bytes"))
    return (exp.join(sizes, "artifact", "left")
            .select("artifact", "step", F.col("bytes").isNotNull().alias("exists"),
                    F.round(F.col("bytes") / 1024.0, 1).alias("size_kb")))
