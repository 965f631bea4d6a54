"""Step 2C — log lines → HTTP/SQL events, correlation, frequencies.

Input ``log_lines(project_id, session_id, line_no, line)``. ``session_id`` is
the correlation scope: a constant session reproduces the single-file
behaviour (quirk K3); a real session id stops interleaved requests from
mixing. Order inside a line: the HTTP event (seq 0) precedes the SQL one (seq 1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as TX
from .carry import DEFAULT_BUCKET_ROWS, carry_forward, carry_forward_window

KEY = ["project_id"]
SESSION = ["project_id", "session_id"]


def _null_s():
    return F.lit(None).cast("string")


def log_events(log_lines: DataFrame, fixed_update_table: bool = False) -> DataFrame:
    """L1–L4: each line gives 0, 1 or 2 events, HTTP first."""
    line = F.col("line")
    method = TX.http_method(line)
    endpoint = TX.http_endpoint(line)
    op = TX.sql_operation(line)
    table = TX.sql_table_fixed(line) if fixed_update_table else TX.sql_table(line)
    http = F.when(method != "", F.struct(
        F.lit(0).alias("seq"), F.lit("HTTP").alias("type"), method.alias("method"),
        endpoint.alias("endpoint"), TX.resource_of(endpoint).alias("resource"),
        _null_s().alias("table_name"), _null_s().alias("operation")))
    sql = F.when(op != "", F.struct(
        F.lit(1).alias("seq"), F.lit("SQL").alias("type"), _null_s().alias("method"),
        _null_s().alias("endpoint"), _null_s().alias("resource"),
        table.alias("table_name"), op.alias("operation")))
    evs = F.filter(F.array(http, sql), lambda e: e.isNotNull())
    return (log_lines.select(*SESSION, "line_no", F.explode(evs).alias("e"))
                     .select(*SESSION, "line_no", "e.*"))


def event_order(df: DataFrame) -> DataFrame:
    """A single sortable position: line number then HTTP-before-SQL."""
    return df.withColumn("ord", F.col("line_no") * 2 + F.col("seq"))


def log_correlation(events: DataFrame, bucketed: bool = True,
                    bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """Each SQL event → resource of the latest earlier HTTP event in its
    session (an as-of backward join, done as a carry-forward window). SQL events
    before any HTTP event get no pair."""
    value = F.when(F.col("type") == "HTTP", F.col("resource"))
    order = ["line_no", "seq"]
    if bucketed:
        carried = carry_forward(events, SESSION, order, value, "http_resource", bucket_rows=bucket_rows)
    else:
        carried = carry_forward_window(events, SESSION, order, value, "http_resource")
    return (carried.filter((F.col("type") == "SQL") & F.col("http_resource").isNotNull()
                           & F.col("table_name").isNotNull())
                   .select(*SESSION, "line_no", "seq", F.col("http_resource").alias("resource"),
                           "table_name", "operation"))


def resource_table_pairs(pairs: DataFrame) -> DataFrame:
    """L6, long form: each distinct (resource, table) with its first position
    and number of correlated SQL events — the scalable form (no list)."""
    return (event_order(pairs).groupBy(*KEY, "resource", "table_name")
            .agg(F.min("ord").alias("first_ord"), F.count("*").alias("n_events")))


def resource_table_map(pairs: DataFrame) -> DataFrame:
    """Resource → distinct tables in first-seen order (plus the resource's
    first_seen); list form for the sink, bounded by one project's tables."""
    first = resource_table_pairs(pairs)
    return (first.groupBy(*KEY, "resource")
                 .agg(F.min("first_ord").alias("first_seen"),
                      F.sort_array(F.collect_list(F.struct("first_ord", "table_name"))).alias("_t"),
                      F.count("*").alias("n_tables"))
                 .select(*KEY, "resource", F.transform("_t", lambda x: x["table_name"]).alias("tables"),
                         "n_tables", "first_seen"))


def endpoint_frequency(events: DataFrame) -> DataFrame:
    """Count per full endpoint (query string included) and where it was first seen."""
    return (event_order(events).filter((F.col("type") == "HTTP") & F.col("endpoint").isNotNull())
            .groupBy(*KEY, "endpoint")
            .agg(F.count("*").alias("n"), F.min("ord").alias("first_seen")))


def table_frequency(events: DataFrame) -> DataFrame:
    """Count per SQL table."""
    return (event_order(events).filter((F.col("type") == "SQL") & F.col("table_name").isNotNull())
            .groupBy(*KEY, "table_name")
            .agg(F.count("*").alias("n"), F.min("ord").alias("first_seen")))


def log_totals(events: DataFrame) -> DataFrame:
    """HTTP, SQL and all events per project."""
    return events.groupBy(*KEY).agg(
        F.count_if(F.col("type") == "HTTP").alias("total_http"),
        F.count_if(F.col("type") == "SQL").alias("total_sql"),
        F.count("*").alias("total_events"))


def first_seen(freq: DataFrame, key: str, k: int = rules.PREVIEW_ROWS) -> DataFrame:
    """L10 as the reference prints it: the first ``k`` keys *seen* (quirk K4)."""
    w = Window.partitionBy(*KEY).orderBy(F.col("first_seen"), F.col(key))
    return freq.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k(freq: DataFrame, key: str, k: int = rules.PREVIEW_ROWS) -> DataFrame:
    """L10 fixed: the true top ``k`` by count, ties by key. The rank filter lets
    Spark insert a partial per-partition limit before the shuffle."""
    w = Window.partitionBy(*KEY).orderBy(F.col("n").desc(), F.col(key))
    return freq.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
