"""File sources S1–S5.

* S1 ``source_files``: recursive ``*.java`` scan of the projects' source roots, one row per file.
* S2 ``log_lines``: text lines numbered from 1 *per file*, exact even when a
  file is split across many tasks: lines are ordered by (file, split start,
  position in split); per-split line counts become offsets through a small
  window over the split table (one row per 128 MB split).
* S3 lives in ``operators.ddl.pick_ddl`` (path priority per project).
* S4/S5 JSON and CSV ingest with explicit schemas; a missing path is ``None``, malformed
  JSON a side table that makes its project's source absent.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules
from ..operators.ddl import pick_ddl


SOURCE_ROOT = "src/main/java"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def _fs_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, root: str) -> str:
    """``root`` as the file system names it: absolute, with scheme, not encoded."""
    p, fs = _fs_path(spark, root.rstrip("/") or "/")
    return p.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()


def existing(spark: SparkSession, globs: list[str]) -> list[str]:
    """Those of the path globs that match something."""
    out = []
    for g in globs:
        p, fs = _fs_path(spark, g)
        if fs.globStatus(p):
            out.append(g)
    return out


def below_root(path: Column, root: str) -> Column:
    """The decoded path below the qualified ``root``; a path outside it is an error."""
    base = re.sub(_SCHEME, "", root).rstrip("/") + "/"
    plain = F.url_decode(F.replace(F.regexp_replace(path, _SCHEME, ""), F.lit("+"), F.lit("%2B")))
    return F.when(plain.startswith(base), F.substring(plain, F.lit(len(base) + 1), F.length(plain))) \
            .otherwise(F.raise_error(F.concat(F.lit(f"not below {base}: "), plain)))


def project_of_path(path: Column, root: str) -> Column:
    """First directory below the qualified ``root``: the project of a file in a corpus
    laid out as ``root/<project>/...``."""
    return F.split_part(below_root(path, root), F.lit("/"), F.lit(1))


def source_files(spark: SparkSession, root: str, project_id: str | None = None,
                 glob: str = "*.java", source_root: str = SOURCE_ROOT) -> DataFrame:
    """Every file matching ``glob`` below the projects' ``source_root`` as
    (project_id, path, content); with ``project_id``, ``root`` is that project's folder.
    Test sources and other trees are not read; no match gives no rows."""
    root = qualified(spark, root)
    places = existing(spark, [f"{root}/{'' if project_id is not None else '*/'}{source_root}"])
    if not places:
        return spark.createDataFrame([], "project_id string, path string, content string")
    df = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
          .text(places, wholetext=True)
          .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))
    proj = F.lit(project_id) if project_id is not None else project_of_path(F.col("path"), root)
    return df.select(proj.alias("project_id"), "path", "content")


def corpus_logs(spark: SparkSession, root: str, glob: str = "*.log") -> DataFrame:
    """S2 over a corpus: every log at any depth below ``root/<project>``; none gives no rows."""
    root = qualified(spark, root)
    if not existing(spark, [f"{root}/*"]):
        return spark.createDataFrame([], "project_id string, session_id string, line_no long, line string")
    return log_lines(spark, root, root=root, glob=glob)


def log_lines(spark: SparkSession, paths: str | list[str], project_id: str | Column | None = None,
              root: str | None = None, session_per_file: bool = True, glob: str | None = None, line_sep: str | None = None) -> DataFrame:
    """(project_id, session_id, line_no, line), ``line_no`` from 1 per file.

    ``session_per_file`` makes each file its own correlation session; False
    gives one session per project (the reference's single-log behaviour)."""
    reader = spark.read if line_sep is None else spark.read.option("lineSep", line_sep)
    if glob is not None:  # files matching it at any depth
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    root = qualified(spark, root) if root is not None else None
    raw = (reader.text(paths)
           .select(F.col("_metadata.file_path").alias("path"),
                   F.col("_metadata.file_block_start").alias("block"),
                   F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line")))
    # Local number inside a split: rows of one split are read in file order
    # and ids grow within a task.
    w = Window.partitionBy("path", "block").orderBy("pos")
    local = raw.withColumn("local_no", F.row_number().over(w))
    counts = local.groupBy("path", "block").agg(F.max("local_no").alias("n"))
    wb = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("path", "block", F.coalesce(F.sum("n").over(wb), F.lit(0)).alias("offset"))
    numbered = local.join(offsets, ["path", "block"]).withColumn("line_no", (F.col("offset") + F.col("local_no")).cast("long"))
    if project_id is None:
        proj = project_of_path(F.col("path"), root) if root else F.lit("default")
    elif isinstance(project_id, str):
        proj = F.lit(project_id)
    else:
        proj = project_id
    session = F.col("path") if session_per_file else F.lit("all")
    return numbered.select(proj.alias("project_id"), session.alias("session_id"), "line_no", "line")


def ddl_candidates(spark: SparkSession, root: str, project_id: str | None = None,
                   candidates=rules.DDL_CANDIDATES) -> DataFrame:
    """The projects' candidate scripts as (project_id, path, ddl), ``path`` from the
    project's folder on; other ``*.sql`` files (data dumps) are not read. Feed to
    ``operators.ddl.pick_ddl`` to keep the highest-priority one per project."""
    root = qualified(spark, root)
    places = existing(spark, [f"{root}/{'' if project_id is not None else '*/'}{c}" for c in candidates])
    if not places:
        return spark.createDataFrame([], "project_id string, path string, ddl string")
    df = (spark.read.text(places, wholetext=True)
          .select(below_root(F.col("_metadata.file_path"), root).alias("path"), F.col("value").alias("ddl")))
    if project_id is not None:
        return df.select(F.lit(project_id).alias("project_id"), F.concat(F.lit(f"{project_id}/"), "path").alias("path"), "ddl")
    return df.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("project_id"), "path", "ddl")


def picked_scripts(spark: SparkSession, root: str, project_id: str | None = None, candidates=rules.DDL_CANDIDATES) -> tuple[DataFrame, DataFrame]:
    """S3 without a size limit: (scripts, lines): the highest-priority script of each project
    as (project_id, path), and its numbered lines as (project_id, path, line_no, line), read
    by as many tasks as its size asks for. Paths are those of ``ddl_candidates``."""
    full = qualified(spark, root)
    places = existing(spark, [f"{full}/{'' if project_id is not None else '*/'}{c}" for c in candidates])
    if not places:
        return (spark.createDataFrame([], "project_id string, path string"),
                spark.createDataFrame([], "project_id string, path string, line_no long, line string"))

    def named(path: Column) -> tuple[Column, Column]:
        below = below_root(path, full)
        if project_id is not None:
            return F.lit(project_id), F.concat(F.lit(f"{project_id}/"), below)
        return F.split_part(below, F.lit("/"), F.lit(1)), below

    def columns(path: Column) -> list[Column]:
        return [c.alias(n) for c, n in zip(named(path), ("project_id", "path"))]

    listed = spark.read.format("binaryFile").load(places).select(*columns(F.col("_metadata.file_path")))  # names only
    scripts = pick_ddl(listed)
    lines = log_lines(spark, places, project_id="", line_sep="\n").select(*columns(F.col("session_id")), "line_no", "line")
    return scripts, lines.join(scripts, ["project_id", "path"], "left_semi")


class MissingInput(FileNotFoundError):
    """Q10: an input that a step can't do without is absent."""


CORRUPT = "_corrupt_record"


def read_json_checked(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = True) -> tuple[DataFrame, DataFrame] | None:
    """(rows, corrupt) of JSON with an explicit schema (absent keys → null); ``None`` if
    nothing is at ``path``. ``corrupt`` (project_id, path, record) holds the records
    that can't be read; a project with one has no rows, as a tool that loads the
    project's file in one piece has none. Projects are the ``project_id`` of the schema or of
    the folders; a corrupt record whose project can't be told counts for the rows
    without project."""
    if not existing(spark, [path]):
        return None
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    text = spark.read.option("wholetext", multiline).text(path).select("value", F.col("_metadata.file_path").alias("_file")).filter(F.trim("value") != "")
    one = F.array(F.from_json("value", full, options))
    if multiline:  # a file holds one object or a list of them
        one = F.when(F.ltrim("value").startswith("["), F.coalesce(F.from_json("value", T.ArrayType(full), options), F.array(F.lit(None).cast(full)))).otherwise(one)
    found = text.select("_file", "value", F.explode(one).alias("r"))
    folder = F.regexp_extract("_file", "/project_id=([^/]*)/", 1)
    for _ in range(2):  # the path is encoded, and the folder's name before it
        folder = F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))
    own = F.col("r.project_id") if "project_id" in schema.names else F.lit(None).cast("string")
    project = F.when(F.col("_file").rlike("/project_id=[^/]*/"), F.nullif(folder, F.lit("__HIVE_DEFAULT_PARTITION__"))).otherwise(own)
    bad = F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull()
    corrupt = found.filter(bad).select(project.alias("project_id"), F.col("_file").alias("path"), F.coalesce(f"r.{CORRUPT}", "value").alias("record"))
    lost = corrupt.select(F.struct("project_id").alias("_project")).distinct()
    rows = (found.filter(~bad).withColumn("_project", F.struct(project.alias("project_id"))).join(lost, "_project", "left_anti")
            .select(*[F.col("_project.project_id") if c == "project_id" else F.col(f"r.{c}") for c in schema.names]))
    return rows, corrupt


def read_json(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = True) -> DataFrame | None:
    """The rows of ``read_json_checked``."""
    found = read_json_checked(spark, path, schema, multiline)
    return found[0] if found is not None else None


MATRIX_CSV_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in rules.MATRIX_COLUMNS[:2]]
    + [T.StructField(c, T.LongType() if c in rules.COUNT_COLUMNS else T.IntegerType()) for c in rules.NUMERIC_COLUMNS])


def read_matrix_csv(spark: SparkSession, path: str, project_id: str = "default") -> DataFrame | None:
    """The raw feature-matrix CSV. The header is read as data-less schema
    first, so missing / extra columns can be reported (Q1) before typing. Nothing at
    ``path`` gives ``None``."""
    if not existing(spark, [path]):
        return None
    header = spark.read.option("header", True).csv(path).columns
    fields = {f.name: f for f in MATRIX_CSV_SCHEMA.fields}
    schema = T.StructType([fields.get(c, T.StructField(c, T.StringType())) for c in header])
    df = spark.read.schema(schema).option("header", True).csv(path)
    df = df.withColumn("related_table", F.when(F.col("related_table") == "none", None)
                       .otherwise(F.col("related_table"))) if "related_table" in header else df
    return df.select(F.lit(project_id).alias("project_id"), *df.columns)
