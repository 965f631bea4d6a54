"""Step 2A — Java source text → call edges (C1–C11), as a lexical Spark job.

Accepted grammar (documented limit of a lexical scan, quirk K8):

* comments, string, char and text-block literals are blanked for matching;
* a call is ``scope.name(`` where ``scope`` is any expression: a dotted name, a call
  chain at any nesting and over any lines, ``new X(...)`` also with a class body, a new
  array with its values, an index, a string or text block, a bracketed expression; the
  scope is its source text with spacing normalised outside literals; the line is the
  one the whole expression begins on; unscoped calls are ``this`` calls and are dropped
  (C2: scope ``this`` or shorter than 2 characters is dropped);
* the links of a chain come outer first: a call, the calls in its arguments, then those in
  its scope;
* an injected field is ``@Autowired``/``@Inject``, written so, among annotations and
  modifiers, at any distance before a type and a name; its edge goes to the type,
  method = field name, line = where the declaration begins;
* the owner class is the last ``class``/``interface`` declared before the call in the
  same file, ``Unknown`` before any, so also in enum, record and annotation files
  (K9 reset per file);
* a file is an error file (C6) if it can't be read, its brackets don't balance or a
  comment or quote is left open; it gives no edges, as the parser this replaces rejects it.

Per-file work is row-local and linear in the file, the text is never shuffled.
Aggregates afterwards are keyed by ``project_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import javalex as JL
from .ranks import positions

KEY = ["project_id"]


def parse_sources(source_files: DataFrame) -> DataFrame:
    """Per file: package (C5), parsed? (C6) and the sites that one pass over the text finds."""
    return (source_files.select(*KEY, "path", JL.package_of(F.col("content")).alias("from_package"), JL.scan_column(F.col("content")).alias("scan"))
            .select(*KEY, "path", F.coalesce("from_package", F.lit("default")).alias("from_package"),
                    F.coalesce("scan.good", F.lit(False)).alias("parsed"), "scan.sites"))


def call_edges(parsed: DataFrame, annotations=rules.INJECTION_ANNOTATIONS, min_scope_len: int = 2) -> DataFrame:
    """Method-call edges (``method_call``) and injected-field edges (``autowired``)
    with owner class, package, line and position (``call_idx``: outer link of a chain first).

    The owner (C4) is the last type declared before the site, carried along the file's
    sites; a call is dropped (C2) if its scope is ``this`` or too short; a field
    counts (C3) if one of its annotations is written as one of ``annotations``."""
    sites = parsed.filter("parsed").select(*KEY, "path", "from_package", F.posexplode("sites").alias("at", "s"))
    call = (F.col("s.kind") == "call") & (F.col("s.target") != "this") & (F.length("s.target") >= min_scope_len)
    field = (F.col("s.kind") == "field") & F.arrays_overlap("s.annotations", F.array(*[F.lit(a) for a in annotations]))
    # Only what an edge or an owner needs is shuffled, as columns of their own: a consumer that reads no target moves none.
    call_type = F.when(call, "method_call").when(field, "autowired")
    sites = (sites.select(*KEY, "path", "at", "from_package", F.when(F.col("s.kind") == "type", F.col("s.name")).alias("type"), call_type.alias("call_type"),
                          F.col("s.target").alias("to_class"), F.col("s.name").alias("method_name"),
                          F.col("s.line").alias("line_number"), F.col("s.idx").alias("call_idx"))
             .filter(F.col("type").isNotNull() | F.col("call_type").isNotNull()))
    before = Window.partitionBy(*KEY, "path").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owner = F.last("type", ignorenulls=True).over(before)
    return (sites.withColumn("from_class", F.coalesce(owner, F.lit("Unknown"))).filter(F.col("call_type").isNotNull())
            .select(*KEY, "path", "from_class", "from_package", "to_class", "method_name", "call_type", "line_number", "call_idx"))


def injected_edges(edges: DataFrame) -> DataFrame:
    """C3 alone."""
    return edges.filter(F.col("call_type") == "autowired")


def file_status(parsed: DataFrame) -> DataFrame:
    """Files, parsed and error counts per project."""
    return parsed.groupBy(*KEY).agg(F.count("*").alias("total_files"),
                                   F.count_if("parsed").alias("parsed_files"),
                                   F.count_if(~F.col("parsed")).alias("error_files"))


def _position():
    return F.struct("path", "call_idx", "line_number")


def adjacency_edges(edges: DataFrame) -> DataFrame:
    """C7, without order: each distinct (class, target) with its first position and
    call count."""
    return edges.groupBy(*KEY, "from_class", "to_class").agg(F.min(_position()).alias("first"),
                                                             F.count("*").alias("n_calls"))


def adjacency(edges: DataFrame) -> DataFrame:
    """The distinct targets of each class, ``rank`` = place in first-seen order from 1.
    Long form: a hub class with millions of targets is spread over many tasks (ranks come
    from ranges of first positions and the counts of earlier ranges), never in one row."""
    first = adjacency_edges(edges)
    ranked = positions(first, [*KEY, "from_class"], ["first", "to_class"], size="n_targets", keep=[*KEY, "from_class", "to_class", "n_calls"])
    return ranked.select(*KEY, "from_class", (F.col("pos") + 1).alias("rank"), "to_class", "n_calls", "n_targets")


def class_list(edges: DataFrame) -> DataFrame:
    """classes = distinct callers (a class with no outgoing edge is absent)."""
    return edges.select(*KEY, "from_class").distinct().withColumnRenamed("from_class", "class_name")


def call_summary(edges: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """Files, parsed, errors, classes and calls per project."""
    s = edges.groupBy(*KEY).agg(F.count_distinct("from_class").alias("total_classes"),
                               F.count("*").alias("total_calls"))
    if status is None:
        status = edges.groupBy(*KEY).agg(F.count_distinct("path").alias("total_files")) \
                      .select(*KEY, "total_files", F.col("total_files").alias("parsed_files"),
                              F.lit(0).cast("long").alias("error_files"))
    return (status.join(s, KEY, "left")
            .select(*KEY, "total_files", "parsed_files", "error_files",
                    F.coalesce("total_classes", F.lit(0)).alias("total_classes"),
                    F.coalesce("total_calls", F.lit(0)).alias("total_calls")))


def call_type_histogram(edges: DataFrame) -> DataFrame:
    """Edges per call type (missing type → ``?``)."""
    return edges.groupBy(*KEY, F.coalesce("call_type", F.lit("?")).alias("call_type")).agg(F.count("*").alias("n"))


def first_calls(edges: DataFrame, k: int = rules.PREVIEW_ROWS) -> DataFrame:
    """C11: the first ``k`` edges of each project by position."""
    w = Window.partitionBy(*KEY).orderBy("path", "call_idx", "line_number", "to_class", "method_name")
    return edges.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
