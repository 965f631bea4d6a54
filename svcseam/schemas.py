"""Explicit schemas of every table the operators exchange.

Every table carries ``project_id`` first: all grouping, windows and joins are
keyed by it, so a corpus of many projects spreads over the cluster.
"""

from pyspark.sql import types as T

from . import rules

S, L, I, B, D = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DoubleType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SOURCE_FILES = _struct(("project_id", S), ("path", S), ("content", S))
LOG_LINES = _struct(("project_id", S), ("session_id", S), ("line_no", L), ("line", S))
DDL_SCRIPTS = _struct(("project_id", S), ("path", S), ("ddl", S))

LOG_EVENTS = _struct(
    ("project_id", S), ("session_id", S), ("line_no", L), ("seq", I), ("type", S),
    ("method", S), ("endpoint", S), ("resource", S), ("table_name", S), ("operation", S),
)

CALLS = _struct(
    ("project_id", S), ("path", S), ("from_class", S), ("from_package", S), ("to_class", S),
    ("method_name", S), ("call_type", S), ("line_number", I), ("call_idx", I),
)

DB_COLUMNS = _struct(
    ("project_id", S), ("table_name", S), ("table_pos", I), ("ordinal", I), ("name", S),
    ("type", S), ("nullable", B), ("primary_key", B),
)

DB_TABLES = _struct(("project_id", S), ("table_name", S), ("table_pos", I))
TABLE_FREQUENCY = _struct(("project_id", S), ("table_name", S), ("n", L), ("first_seen", L))

# fk_order sorts explicit keys (k=0: statement, match) before inferred ones
# (k=1: table position, column ordinal).
FK_ORDER = T.StructType([T.StructField("k", I, True), T.StructField("a", I, True), T.StructField("b", I, True)])
FOREIGN_KEYS = _struct(
    ("project_id", S), ("from_table", S), ("column", S), ("references_table", S),
    ("references_column", S), ("inferred", B), ("fk_order", FK_ORDER),
)

FEATURE_MATRIX = _struct(
    ("project_id", S), *((c, S) for c in rules.MATRIX_COLUMNS[:2]),
    *((c, L if c in rules.COUNT_COLUMNS else I) for c in rules.NUMERIC_COLUMNS),
)

# Long feature form: one row per (class, feature); pivot only at the sink.
LONG_FEATURES = _struct(("project_id", S), ("class_name", S), ("feature", S), ("value", D))
