"""Step 2B — DDL scripts → tables, columns, foreign keys, domains.

Input ``ddl_scripts(project_id, path, ddl)``, one row per schema script, or the numbered
lines of scripts of any size (``statements_of_lines``). The
regex scan runs per script or chunk inside the tasks; everything after it (dedup,
inference, graph) is ordinary aggregation and joins keyed by project.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as TX
from ..session import cut_lineage

KEY = ["project_id"]


def pick_ddl(candidates: DataFrame, priorities: Sequence[str] = rules.DDL_CANDIDATES) -> DataFrame:
    """S3: per project keep the script whose path below the project's folder (the first
    part of ``path``) is the highest-priority candidate; other paths, those of nested
    modules too, are ignored."""
    below = F.regexp_replace("path", "^[^/]+/", "")
    prio = None
    for i, candidate in enumerate(priorities):
        cond = below == candidate
        prio = F.when(cond, F.lit(i)) if prio is None else prio.when(cond, F.lit(i))
    w = Window.partitionBy(*KEY).orderBy(F.col("_prio"), F.col("path"))
    return (candidates.withColumn("_prio", prio).filter(F.col("_prio").isNotNull())
            .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1)
            .drop("_prio", "_rn"))


def statements(ddl_scripts: DataFrame) -> DataFrame:
    """D1 (before dedup): every ``CREATE TABLE name (...);`` with its position."""
    m = F.regexp_extract_all(F.col("ddl"), F.lit(rules.CREATE_TABLE_PATTERN), 0)
    return (ddl_scripts.select(*KEY, F.posexplode(m).alias("stmt_pos", "stmt"))
            .select(*KEY, "stmt_pos",
                    F.lower(F.regexp_extract("stmt", rules.CREATE_TABLE_PATTERN, 1)).alias("table_name"),
                    F.regexp_extract("stmt", rules.CREATE_TABLE_PATTERN, 2).alias("body")))


CHUNK_LINES = 4096
#: After ``);`` with something other than ``(`` before it (a chunk begins after a line's end)
#: no statement is open, so a script may be cut there.
_FIRST_CUT = r"(?s)\A(\);|.*?[^(]\);)"
_AFTER_LAST_CUT = r"(?s)\A(?:.*[^(]|)\);(.*)\z"
_START = r"(?is)(CREATE\s+TABLE\s+\w+\s*\(.*)\z"
_PARTIAL = r"(?is)(CREATE(?:\s+TABLE(?:\s+\w+)?)?\s*)\z"


def statements_of_lines(lines: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """D1 like ``statements`` for scripts of any size, from their numbered lines
    ``(project_id, path, line_no, line)``: a script is never in one row.

    Lines are joined to chunks. What lies between a chunk's first and last cut is searched in
    place; what lies across chunks is stitched: a prefix count of the chunks with a cut names the
    segment that each chunk's head, tail or (without a cut) whole belongs to, and a
    segment's pieces are joined in order. Pieces are first shortened to where a statement can
    begin, so a stitched row is about as long as its statement. Positions are counts of
    earlier statements, summed over chunks."""
    script = [*KEY, "path"]
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    chunks = (lines.withColumn("chunk", F.floor(F.col("line_no") / F.lit(chunk_lines)).cast("long")).groupBy(*script, "chunk")
              .agg(F.concat(text, F.lit("\n")).alias("text"))
              .withColumn("head", F.regexp_extract("text", _FIRST_CUT, 1)).withColumn("cut", F.col("head") != ""))
    tail = F.regexp_extract("text", _AFTER_LAST_CUT, 1)
    chunks = cut_lineage(chunks.withColumn("tail", F.when(F.col("cut"), tail)))  # read for both kinds of matches
    inside = F.expr("substring(text, length(head) + 1, length(text) - length(head) - length(tail))")
    found = F.regexp_extract_all(F.col("s"), F.lit(rules.CREATE_TABLE_PATTERN), 0)
    middle = chunks.filter("cut").select(*script, F.col("chunk").alias("at"), F.lit(1).alias("part"), inside.alias("s"))

    # One row a chunk, without its text: the segment that ends in it or passes through it.
    earlier = Window.partitionBy(*script).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    segments = chunks.select(*script, "chunk", "cut").withColumn("segment", F.coalesce(F.sum(F.col("cut").cast("long")).over(earlier), F.lit(0)))
    numbered = chunks.drop("cut").join(segments, [*script, "chunk"])
    pieces = (numbered.select(*script, "chunk", "segment", F.when(F.col("cut"), F.col("head")).otherwise(F.col("text")).alias("piece"), F.col("cut").alias("ends"))
              .union(numbered.filter("cut").select(*script, "chunk", F.col("segment") + 1, "tail", F.lit(False))))
    # One row a piece, without its text: whether a statement may be open before it.
    blank = F.col("piece").rlike(r"\A\s*\z")
    seen = (pieces.select(*script, "segment", "chunk", F.when(~blank, F.col("piece").rlike(_START) | F.col("piece").rlike(_PARTIAL)).alias("may")))
    so_far = Window.partitionBy(*script, "segment").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    opened = seen.select(*script, "segment", "chunk", F.coalesce(F.max("may").over(so_far), F.lit(False)).alias("open"))
    begin = F.regexp_extract("piece", _START, 1)
    short = (F.when(F.col("open"), F.col("piece")).when(begin != "", begin).otherwise(F.regexp_extract("piece", _PARTIAL, 1)))
    stitched = (pieces.join(opened, [*script, "segment", "chunk"]).withColumn("short", short).filter((F.col("short") != "") | F.col("ends"))
                .groupBy(*script, "segment").agg(F.max("chunk").alias("at"), F.max("ends").alias("ends"),
                                                 F.sort_array(F.collect_list(F.struct("chunk", "short"))).alias("p"))
                # before what is inside the chunk that ends it; the script's open end comes last
                .select(*script, "at", F.when(F.col("ends"), 0).otherwise(2).alias("part"), F.array_join(F.transform("p", lambda x: x["short"]), "").alias("s")))
    matches = cut_lineage(middle.union(stitched).select(*script, "at", "part", found.alias("m")).filter(F.size("m") > 0))
    before = Window.partitionBy(*script).orderBy("at", "part").rowsBetween(Window.unboundedPreceding, -1)
    base = matches.select(*script, "at", "part", F.coalesce(F.sum(F.size("m")).over(before), F.lit(0)).alias("base"))
    return (matches.join(base, [*script, "at", "part"]).select(*KEY, "base", F.posexplode("m").alias("i", "stmt"))
            .select(*KEY, (F.col("base") + F.col("i")).cast("int").alias("stmt_pos"),
                    F.lower(F.regexp_extract("stmt", rules.CREATE_TABLE_PATTERN, 1)).alias("table_name"),
                    F.regexp_extract("stmt", rules.CREATE_TABLE_PATTERN, 2).alias("body")))


def tables(stmts: DataFrame) -> DataFrame:
    """One row per table; a repeated name keeps the *last* body at the
    *first* position (insert-ordered map semantics)."""
    return (stmts.groupBy(*KEY, "table_name")
            .agg(F.min("stmt_pos").alias("table_pos"), F.max_by("body", "stmt_pos").alias("body")))


def columns(tbls: DataFrame) -> DataFrame:
    """Split a body on comma + newline, trim, drop empty segments and
    constraint lines (quirk K5), then name / type / nullable / primary key
    (quirk K6: the type is the second token minus ``(...)``)."""
    kw = "|".join(rules.CONSTRAINT_KEYWORDS)
    seg = TX.java_trim(F.col("seg"))
    parts = F.split(F.col("s"), r"\s+")
    name = F.get(parts, 0)
    up = F.upper(F.col("s"))
    return (tbls.select(*KEY, "table_name", "table_pos",
                        F.posexplode(F.split(F.col("body"), rules.COLUMN_SPLIT_PATTERN)).alias("ordinal", "seg"))
            .select(*KEY, "table_name", "table_pos", "ordinal", seg.alias("s"))
            .filter((F.col("s") != "") & ~F.upper(F.col("s")).rlike(rf"\A({kw}).*\z"))
            .filter(F.size(parts) >= 2)
            .select(*KEY, "table_name", "table_pos", F.col("ordinal").cast("int").alias("ordinal"),
                    name.alias("name"),
                    F.regexp_replace(F.get(parts, 1), r"\(.*\)", "").alias("type"),
                    (~up.contains("NOT NULL")).alias("nullable"),
                    (up.contains("PRIMARY KEY") | (F.lower(name) == "id")).alias("primary_key")))


def explicit_foreign_keys(stmts: DataFrame) -> DataFrame:
    """``FOREIGN KEY (c) REFERENCES t(c2)`` inside CREATE bodies; every
    body of a repeated table contributes."""
    m = F.regexp_extract_all(F.col("body"), F.lit(rules.FOREIGN_KEY_PATTERN), 0)
    p = rules.FOREIGN_KEY_PATTERN
    return (stmts.select(*KEY, "stmt_pos", "table_name", F.posexplode(m).alias("fk_pos", "fk"))
            .select(*KEY, F.col("table_name").alias("from_table"),
                    F.regexp_extract("fk", p, 1).alias("column"),
                    F.lower(F.regexp_extract("fk", p, 2)).alias("references_table"),
                    F.regexp_extract("fk", p, 3).alias("references_column"),
                    F.lit(False).alias("inferred"),
                    F.struct(F.lit(0).alias("k"), F.col("stmt_pos").cast("int").alias("a"),
                             F.col("fk_pos").cast("int").alias("b")).alias("fk_order")))


def inferred_foreign_keys(cols: DataFrame, tbls: DataFrame, explicit: DataFrame,
                          also_plural: bool = False) -> DataFrame:
    """A column ``<t>_id`` (not ``id``) whose prefix is exactly an existing
    table (quirk K7; ``also_plural`` also tries ``<t>s``), not already an
    explicit key of that (table, column) → key to ``<t>.id``."""
    low = F.lower(F.col("name"))
    cand = (cols.filter(low.endswith("_id") & (low != "id"))
                .select(*KEY, F.col("table_name").alias("from_table"), "table_pos", "ordinal",
                        F.col("name").alias("column"),
                        F.expr("substring(lower(name), 1, length(name) - 3)").alias("prefix")))
    names = tbls.select(*KEY, F.col("table_name").alias("references_table"))
    hit = cand.join(names, (cand.project_id == names.project_id) & (cand.prefix == names.references_table),
                    "inner").drop(names.project_id)
    if also_plural:
        hit2 = cand.join(names, (cand.project_id == names.project_id)
                         & (F.concat(cand.prefix, F.lit("s")) == names.references_table), "inner").drop(names.project_id)
        hit = hit.unionByName(hit2)
        w = Window.partitionBy(*KEY, "from_table", "column").orderBy(F.length("references_table"))
        hit = hit.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    ex = explicit.select(*KEY, "from_table", "column")
    kept = hit.join(ex, [*KEY, "from_table", "column"], "left_anti")
    # A column name repeated inside one table is inferred once.
    return (kept.groupBy(*KEY, "from_table", "column", "references_table")
            .agg(F.min(F.struct("table_pos", "ordinal")).alias("o"))
            .select(*KEY, "from_table", "column", "references_table",
                    F.lit("id").alias("references_column"), F.lit(True).alias("inferred"),
                    F.struct(F.lit(1).alias("k"), F.col("o.table_pos").cast("int").alias("a"),
                             F.col("o.ordinal").cast("int").alias("b")).alias("fk_order")))


def all_foreign_keys(explicit: DataFrame, inferred: DataFrame) -> DataFrame:
    """Explicit keys, then inferred ones (order kept in ``fk_order``)."""
    return explicit.unionByName(inferred)


def table_domains(tbls: DataFrame, rules_list=rules.TABLE_DOMAIN_RULES,
                  default=rules.TABLE_DOMAIN_DEFAULT) -> DataFrame:
    """Domain of each table."""
    return tbls.select(*KEY, "table_name", "table_pos",
                       TX.table_domain(F.col("table_name"), rules_list, default).alias("domain"))


def domain_groups(domains: DataFrame) -> DataFrame:
    """Domain → tables in table order (domains in order of first table)."""
    return (domains.groupBy(*KEY, "domain")
            .agg(F.min("table_pos").alias("first_pos"),
                 F.sort_array(F.collect_list(F.struct("table_pos", "table_name"))).alias("_t"),
                 F.count("*").alias("n_tables"))
            .select(*KEY, "domain", F.transform("_t", lambda x: x["table_name"]).alias("tables"),
                    "n_tables", "first_pos"))


def table_graph(fks: DataFrame) -> DataFrame:
    """Source table → referenced tables in key order, duplicates kept."""
    return (fks.groupBy(*KEY, "from_table")
            .agg(F.sort_array(F.collect_list(F.struct("fk_order", "references_table"))).alias("_t"),
                 F.count("*").alias("n_targets"))
            .select(*KEY, "from_table", F.transform("_t", lambda x: x["references_table"]).alias("targets"),
                    "n_targets"))


def schema_summary(tbls: DataFrame, fks: DataFrame) -> DataFrame:
    """Tables, keys (explicit + inferred) and table names per project."""
    t = (tbls.groupBy(*KEY)
         .agg(F.count("*").alias("total_tables"),
              F.sort_array(F.collect_list(F.struct("table_pos", "table_name"))).alias("_t"))
         .select(*KEY, "total_tables", F.transform("_t", lambda x: x["table_name"]).alias("table_names")))
    k = fks.groupBy(*KEY).agg(F.count("*").alias("total_fks"),
                              F.count_if(F.col("inferred")).alias("inferred_fks"))
    return (t.join(k, KEY, "left")
            .select(*KEY, "total_tables", F.coalesce("total_fks", F.lit(0)).alias("total_fks"),
                    F.coalesce("inferred_fks", F.lit(0)).alias("inferred_fks"), "table_names"))
