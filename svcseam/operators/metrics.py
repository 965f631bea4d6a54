"""Per-class and per-table metrics feeding the matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules

KEY = ["project_id"]


def call_metrics(edges: DataFrame, fixed: bool = False) -> DataFrame:
    """A1–A4 per (project, class): calls_out, calls_in, deps_unique, has_autowired.

    compat (default): ``calls_in`` matches callee text to class names exactly
    (K10), ``deps_unique`` is 0 (K11). fixed: case-insensitive ``calls_in``,
    ``deps_unique`` = distinct callees.

    compat takes one aggregate: an edge counts once for the name that calls and once for the
    name that is called, and the names that call are the classes.
    """
    if not fixed:
        injects = F.col("call_type").isin(*rules.INJECTION_CALL_TYPES).cast("int")
        caller = F.struct(F.col("from_class").alias("class_name"), F.lit(1).alias("out"), F.lit(0).alias("inc"), injects.alias("injects"))
        callee = F.struct(F.col("to_class").alias("class_name"), F.lit(0).alias("out"), F.lit(1).alias("inc"), F.lit(None).cast("int").alias("injects"))
        named = F.col("project_id").isNotNull() & F.col("class_name").isNotNull()  # nothing is equal to a missing name
        return (edges.select(*KEY, F.inline(F.array(caller, callee))).groupBy(*KEY, "class_name")
                .agg(F.sum("out").alias("calls_out"), F.sum("inc").alias("inc"), F.max("injects").alias("has_autowired")).filter("calls_out > 0")
                .select(*KEY, "class_name", "calls_out", F.when(named, F.col("inc")).otherwise(F.lit(0).cast("long")).alias("calls_in"),
                        F.lit(0).cast("long").alias("deps_unique"), "has_autowired"))
    out = edges.groupBy(*KEY, F.col("from_class").alias("class_name")).agg(
        F.count("*").cast("long").alias("calls_out"),
        F.count_distinct("to_class").cast("long").alias("deps_unique"),
        F.max(F.col("call_type").isin(*rules.INJECTION_CALL_TYPES).cast("int")).alias("has_autowired"))
    inc = edges.groupBy(*KEY, F.lower(F.col("to_class")).alias("_k")).agg(F.count("*").cast("long").alias("calls_in"))
    o = out.withColumn("_k", F.lower(F.col("class_name")))
    return (o.join(inc, [*KEY, "_k"], "left")
            .select(*KEY, "class_name", "calls_out", F.coalesce("calls_in", F.lit(0).cast("long")).alias("calls_in"),
                    "deps_unique", "has_autowired"))


def table_metrics(tbls: DataFrame, cols: DataFrame, fks: DataFrame, table_freq: DataFrame | None) -> DataFrame:
    """A5–A8 per (project, table): db_columns, db_fk_out, db_fk_in,
    db_relations (= graph list length, i.e. fk_out) and log_frequency.
    Every declared table is a row, also one whose columns were all dropped."""
    cnt = cols.groupBy(*KEY, "table_name").agg(F.count("*").cast("long").alias("db_columns"))
    ncols = (tbls.select(*KEY, "table_name").join(cnt, [*KEY, "table_name"], "left")
             .select(*KEY, "table_name", F.coalesce("db_columns", F.lit(0).cast("long")).alias("db_columns")))
    fout = (fks.filter(F.col("from_table").isNotNull())
            .groupBy(*KEY, F.col("from_table").alias("table_name")).agg(F.count("*").cast("long").alias("db_fk_out")))
    fin = (fks.filter(F.col("references_table").isNotNull())
           .groupBy(*KEY, F.col("references_table").alias("table_name")).agg(F.count("*").cast("long").alias("db_fk_in")))
    t = ncols.join(fout, [*KEY, "table_name"], "left").join(fin, [*KEY, "table_name"], "left")
    if table_freq is not None:
        lf = table_freq.select(*KEY, "table_name", F.col("n").cast("long").alias("log_frequency"))
        t = t.join(lf, [*KEY, "table_name"], "left")
    else:
        t = t.withColumn("log_frequency", F.lit(None).cast("long"))
    z = F.lit(0).cast("long")
    return t.select(*KEY, "table_name", "db_columns",
                    F.coalesce("db_fk_out", z).alias("db_fk_out"), F.coalesce("db_fk_in", z).alias("db_fk_in"),
                    F.coalesce("db_fk_out", z).alias("db_relations"),
                    F.coalesce("log_frequency", z).alias("log_frequency"))
