"""Registered queries: name → (spark, sf_dir) → DataFrame.

Each query derives its inputs from the driver's tables (``sources.fixtures``)
and runs one operator family over the *whole* tables. Presentation for the
oracle comparison only: arrays are joined with ``,`` (order matters and is
kept), doubles are rounded (``+ 0.0`` folds ``-0.0``), and ranks are ints.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..operators import calls as C
from ..operators import ddl as D
from ..operators import features as M
from ..operators import logs as L
from ..operators import matrix as X
from ..operators import metrics as A
from ..operators import quality as Q
from ..operators import similarity as S
from ..operators import text_weights as W
from ..session import ensure_checkpoint_dir
from ..sources import fixtures as FX
from ..sources import wide_csv
from . import run
from .extraction import Extraction

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ROUND = 6


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _once(spark, sf, from_text: bool = False) -> Extraction:
    """For queries that read every intermediate table once: nothing is written in between."""
    return Extraction.from_fixtures(spark, sf, from_text=from_text, materialize=False)


def _x(spark, sf) -> Extraction:
    return Extraction.from_fixtures(spark, sf)


def _joined(c: str, alias: str | None = None):
    return F.array_join(F.col(c), ",").alias(alias or c)


def _r(c, d: int = ROUND, alias: str | None = None):
    return (F.round(F.col(c) if isinstance(c, str) else c, d) + F.lit(0.0)).alias(alias or c)


# ---------------------------------------------------------------- logs (L*)
@query
def log_events(spark, sf):
    return _once(spark, sf).events


@query
def log_events_fixed_update(spark, sf):
    """K1 fixed: an UPDATE's table is the word after UPDATE."""
    return L.log_events(FX.log_lines(spark, sf), fixed_update_table=True)


@query
def log_correlation(spark, sf):
    return _once(spark, sf).correlation


@query
def resource_table_map(spark, sf):
    return _once(spark, sf).resource_tables.select("project_id", "resource", _joined("tables"), "n_tables", "first_seen")


@query
def resource_table_pairs(spark, sf):
    return L.resource_table_pairs(_once(spark, sf).correlation)


@query
def endpoint_frequency(spark, sf):
    return _once(spark, sf).endpoint_freq


@query
def table_frequency(spark, sf):
    return _once(spark, sf).table_freq


@query
def log_totals(spark, sf):
    return L.log_totals(_once(spark, sf).events)


@query
def top_endpoints(spark, sf):
    return L.top_k(_once(spark, sf).endpoint_freq, "endpoint")


@query
def first_endpoints(spark, sf):
    return L.first_seen(_once(spark, sf).endpoint_freq, "endpoint")


@query
def top_tables(spark, sf):
    return L.top_k(_once(spark, sf).table_freq, "table_name")


@query
def first_tables(spark, sf):
    return L.first_seen(_once(spark, sf).table_freq, "table_name")


# ---------------------------------------------------------------- schema (D*)
@query
def ddl_pick(spark, sf):
    """S3 over two candidates per project (the real script and a lower-priority one)."""
    s = FX.ddl_scripts(spark, sf)
    other = s.select("project_id", F.regexp_replace("path", "schema\\.sql$", "db/mysql/schema.sql").alias("path"),
                     F.lit("").alias("ddl"))
    return D.pick_ddl(s.unionByName(other)).select("project_id", "path", F.length("ddl").alias("ddl_length"))


@query
def ddl_tables(spark, sf):
    return _once(spark, sf).tables


@query
def ddl_columns(spark, sf):
    return _once(spark, sf).columns.drop("table_pos")


def _fk(df):
    return df.select("project_id", "from_table", "column", "references_table", "references_column", "inferred")


@query
def ddl_foreign_keys(spark, sf):
    return _fk(_once(spark, sf).explicit_fks)


@query
def inferred_foreign_keys(spark, sf):
    return _fk(_x(spark, sf).inferred_fks)


@query
def inferred_foreign_keys_plural(spark, sf):
    """K7 fixed: ``<t>_id`` also matches a table ``<t>s``."""
    x = _x(spark, sf)
    return _fk(D.inferred_foreign_keys(x.columns, x.tables, x.explicit_fks, also_plural=True))


@query
def all_foreign_keys(spark, sf):
    return _fk(_x(spark, sf).foreign_keys)


@query
def table_domains(spark, sf):
    return D.table_domains(_once(spark, sf).tables).drop("table_pos")


@query
def domain_groups(spark, sf):
    return D.domain_groups(D.table_domains(_once(spark, sf).tables)).select(
        "project_id", "domain", _joined("tables"), "n_tables")


@query
def table_graph(spark, sf):
    return D.table_graph(_x(spark, sf).foreign_keys).select("project_id", "from_table", _joined("targets"), "n_targets")


@query
def schema_summary(spark, sf):
    x = _x(spark, sf)
    return D.schema_summary(x.tables, x.foreign_keys).select(
        "project_id", "total_tables", "total_fks", "inferred_fks", _joined("table_names"))


# ---------------------------------------------------------------- calls (C*)
_EDGE_COLS = ["project_id", "path", "from_class", "from_package", "to_class", "method_name", "call_type", "line_number", "call_idx"]


@query
def call_edges(spark, sf):
    """The lexical job over generated Java text."""
    return _once(spark, sf, from_text=True).edges.select(*_EDGE_COLS)


@query
def call_edges_fluent(spark, sf):
    """C1, C3, C4, C6 on chains over lines, nested arguments, constructors, spread annotations, enum files, long lines."""
    return C.call_edges(C.parse_sources(FX.fluent_files(spark, sf))).select(*_EDGE_COLS)


@query
def injected_edges(spark, sf):
    return C.injected_edges(_once(spark, sf, from_text=True).edges).select(*_EDGE_COLS)


def _text_edges(spark, sf) -> DataFrame:
    """The edges of all generated Java text: plain files and those with chains."""
    return C.call_edges(C.parse_sources(FX.source_files(spark, sf).unionByName(FX.fluent_files(spark, sf))))


@query
def adjacency(spark, sf):
    return C.adjacency(_text_edges(spark, sf))


@query
def adjacency_edges(spark, sf):
    return C.adjacency_edges(_text_edges(spark, sf)).select(
        "project_id", "from_class", "to_class", F.col("first.path").alias("first_path"),
        F.col("first.line_number").alias("first_line"), "n_calls")


@query
def class_list(spark, sf):
    return _once(spark, sf, from_text=True).classes


@query
def call_summary(spark, sf):
    x = Extraction.from_fixtures(spark, sf, from_text=True)  # edges and file counts both read the parsed files
    return C.call_summary(x.edges, C.file_status(x.parsed_sources))


@query
def call_type_histogram(spark, sf):
    return C.call_type_histogram(_once(spark, sf).edges)


@query
def first_calls(spark, sf):
    return C.first_calls(_text_edges(spark, sf)).select("project_id", "path", "line_number", "from_class",
                                                        "to_class", "method_name", "rank")


@query
def page_links(spark, sf):
    """C1 shape on real text: href edges of ``pages``."""
    return FX.page_link_edges(spark, sf).select("project_id", "path", "from_class", "to_class", "line_number")


@query
def page_link_metrics(spark, sf):
    """A1–A4 over the real link graph (fixed form: case-insensitive in-links)."""
    return A.call_metrics(FX.page_link_edges(spark, sf), fixed=True)


@query
def page_link_adjacency(spark, sf):
    """C7 over the real link graph."""
    return C.adjacency(FX.page_link_edges(spark, sf))


@query
def page_resources(spark, sf):
    """L3 on real URL paths."""
    from ..functions import text as TX
    u = FX.page_urls(spark, sf)
    return u.select("page_id", "project_id", "path", TX.resource_of(F.col("path")).alias("resource"))


# ---------------------------------------------------------------- metrics (A*)
@query
def calls_out_in(spark, sf):
    """A1–A4 from Java text."""
    return _once(spark, sf, from_text=True).call_metrics


@query
def deps_unique_fixed(spark, sf):
    return A.call_metrics(_x(spark, sf).edges, fixed=True)


@query
def table_metrics(spark, sf):
    return _x(spark, sf).table_metrics


# ---------------------------------------------------------------- matrix (J*, F*, S7–S9)
@query
def related_table(spark, sf):
    x = _x(spark, sf)
    return X.related_table(x.classes, x.tables)


@query
def class_domain(spark, sf):
    return X.classify(_once(spark, sf).classes).select("project_id", "class_name", "domain", "stereotype",
                                                    "stereotype_rank")


@query
def stereotype_flags(spark, sf):
    return X.classify(_once(spark, sf).classes).select("project_id", "class_name", "is_controller", "is_service",
                                                    "is_repository")


@query
def feature_matrix(spark, sf):
    return X.matrix_raw(_x(spark, sf).matrix)


@query
def matrix_readable(spark, sf):
    return X.matrix_readable(_x(spark, sf).matrix)


@query
def matrix_by_domain(spark, sf):
    return X.matrix_by_domain(_x(spark, sf).matrix)


@query
def classes_by_domain(spark, sf):
    return X.classes_by_domain(_x(spark, sf).matrix)


# ---------------------------------------------------------------- features (M*)
@query
def zscore_features(spark, sf):
    z = _x(spark, sf).zscores
    return z.select("project_id", "class_name", *[_r(f"num_{c}") for c in rules.NUMERIC_COLUMNS])


@query
def camel_tokens(spark, sf):
    return M.camel_tokens(_once(spark, sf).classes)


@query
def tfidf(spark, sf):
    return _x(spark, sf).tfidf.select("project_id", "class_name", "token", "tf", "df", _r("value"))


@query
def composite_features(spark, sf):
    return _x(spark, sf).composite.select("project_id", "class_name", "related_table", "feature", _r("value"))


@query
def wide_sheets(spark, sf):
    """The composite sheets as written and read back, the header and the number of classes of each."""
    path = f"{ensure_checkpoint_dir(spark)}/sheets-{uuid.uuid4().hex}"
    ids = ["class_name", "related_table"]
    x = _x(spark, sf)
    wide_csv.write_sheets(M.wide_rows(x.composite_cells, ids, names=M.composite_names(x.matrix)), path)
    head = F.col("value").startswith(",".join(ids) + ",")
    return (spark.read.text(path).groupBy("project_id").agg(F.max(F.when(head, F.col("value"))).alias("header"), F.count_if(~head).alias("n_classes")))


@query
def nearest_pairs(spark, sf):
    return _x(spark, sf).nearest


DOCUMENT_TOKEN = r"[\p{L}\p{N}_]{2,}"


def _documents_by_language(spark, sf) -> DataFrame:
    return FX.read(spark, sf, "documents").select(F.col("lang").alias("project_id"), "doc_id", "text")


def documents_tfidf_long(spark, sf) -> DataFrame:
    """M3 on free text: documents grouped by language, Unicode word tokens."""
    return W.tfidf_of_texts(_documents_by_language(spark, sf), "doc_id", "text", DOCUMENT_TOKEN)


@query
def tfidf_documents(spark, sf):
    return documents_tfidf_long(spark, sf).select("project_id", "doc_id", "token", "tf", "df", _r("value"))


@query
def nearest_documents(spark, sf):
    v = W.vectors_of_texts(_documents_by_language(spark, sf), "doc_id", "text", DOCUMENT_TOKEN)
    return S.nearest_pairs(v, "doc_id").select("project_id", F.col("class_a").alias("doc_a"),
                                               F.col("class_b").alias("doc_b"), "similarity", "rank")


# ---------------------------------------------------------------- quality (Q*, S11)
@query
def dq_profile(spark, sf):
    return Q.profile(_x(spark, sf).matrix).select("project_id", "n_rows", "column", "mean", "max", "zeros")


@query
def dq_duplicates(spark, sf):
    """Q2 over one class row per part (project = brand), where names repeat."""
    part = FX.read(spark, sf, "part")
    rows = part.select(F.col("p_brand").alias("project_id"),
                       FX.class_of(F.col("p_name"), F.col("p_partkey")).alias("class_name"),
                       F.col("p_partkey").alias("row_order"))
    return Q.duplicates(rows)


@query
def dq_negatives(spark, sf):
    return Q.negatives(_x(spark, sf).matrix)


@query
def dq_isolated(spark, sf):
    """Q4 on a matrix that also holds classes without any call (one per nation)."""
    x = _x(spark, sf)
    metrics = x.call_metrics  # first: they hold the classes
    classes = x.classes.unionByName(FX.idle_classes(spark, sf))
    return Q.isolated(X.feature_matrix(classes, metrics, x.tables, x.table_metrics))


@query
def dq_constant(spark, sf):
    return Q.constant_features(_x(spark, sf).matrix).select("project_id", "column", _r("std"), "constant")


@query
def dq_zscore(spark, sf):
    return Q.zscore_check(_x(spark, sf).zscores).select("project_id", "column", _r("mean"), _r("std"), "mean_ok")


@query
def dq_zero_tfidf(spark, sf):
    """Q8 with TF-IDF over the classes that make calls: idle classes have no row in it."""
    x = _x(spark, sf)
    return Q.zero_tfidf(x.classes.unionByName(FX.idle_classes(spark, sf)), x.tfidf)


@query
def dq_missing_inputs(spark, sf):
    """Q10: projects with classes but no schema script (required here) or no log (optional)."""
    x = _x(spark, sf)
    projects = x.classes.unionByName(FX.idle_classes(spark, sf))
    return Q.missing_inputs(projects, {"ddl_scripts": (x.ddl_scripts, True), "log_lines": (x.log_lines, False)})


@query
def dq_empty_projects(spark, sf):
    """Q9: projects with a schema script or a nation's name that have no class in the call graph."""
    x = _x(spark, sf)
    projects = x.ddl_scripts.select("project_id").unionByName(FX.idle_classes(spark, sf).select("project_id"))
    return Q.empty_projects(projects, x.classes)


@query
def step_status(spark, sf):
    x = _x(spark, sf)
    x.matrix  # first: its call metrics hold the classes
    projects = (x.classes.select("project_id").unionByName(x.ddl_scripts.select("project_id"))
                .unionByName(FX.idle_classes(spark, sf).select("project_id")))
    return run.step_status(x, projects)


@query
def report_metrics(spark, sf):
    return run.report_counts(_x(spark, sf))
