"""Structured Streaming form of the log operators.

* L1–L4 are stateless column expressions: ``operators.logs.log_events``
  applies unchanged to a streaming DataFrame of log lines.
* L5 (correlation) keeps one value of state per (project, session): the
  resource of the latest HTTP event. ``applyInPandasWithState`` sorts each
  micro-batch's rows of a session by (line_no, seq), carries the state
  through them and emits the correlated SQL events (append mode). Lines are
  expected in order per session across batches; an event older than the
  state's position is emitted with the state as it was when it arrived.
* L7/L8 frequencies are plain streaming aggregates (update mode).

Keyed state is sequential per session by nature, so one session's rows of a
micro-batch meet in one task; the batch size is bounded by the trigger
(``maxFilesPerTrigger`` / ``maxOffsetsPerTrigger``), and the state per
session is one string and one number (RocksDB state store at scale).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Python workers receive this module's functions by value, so executors need
# no installed copy of the package (also when the job is started elsewhere).
import sys as _sys  # noqa: E402

from pyspark import cloudpickle as _cloudpickle  # noqa: E402

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from ..operators import logs as L

PAIR_SCHEMA = ("project_id string, session_id string, line_no long, seq int, resource string, "
               "table_name string, operation string")
STATE_SCHEMA = "resource string, last_ord long"


def _correlate(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    resource, last_ord = (state.get if state.exists else (None, -1))
    project_id, session_id = key
    frames = list(batches)
    pdf = pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0]
    pdf = pdf.sort_values(["line_no", "seq"], kind="stable")
    out_rows = []
    for line_no, seq, typ, res, table, op in zip(pdf["line_no"], pdf["seq"], pdf["type"], pdf["resource"],
                                                pdf["table_name"], pdf["operation"]):
        if typ == "HTTP":
            resource = res
        elif typ == "SQL" and resource is not None and table is not None:
            out_rows.append((project_id, session_id, int(line_no), int(seq), resource, table, op))
        last_ord = max(last_ord, int(line_no) * 2 + int(seq))
    state.update((resource, last_ord))
    yield pd.DataFrame(out_rows, columns=["project_id", "session_id", "line_no", "seq", "resource",
                                          "table_name", "operation"])


def stream_correlation(events: DataFrame) -> DataFrame:
    """L5 on a stream of events: (project, session)-keyed state."""
    ev = events.select("project_id", "session_id", "line_no", "seq", "type", "resource", "table_name", "operation")
    return ev.groupBy("project_id", "session_id").applyInPandasWithState(
        _correlate, PAIR_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def stream_events(lines: DataFrame) -> DataFrame:
    """L1–L4 on a stream of log lines."""
    return L.log_events(lines)


def stream_table_frequency(events: DataFrame) -> DataFrame:
    """L8 as a running aggregate (update / complete output mode)."""
    return (events.filter((F.col("type") == "SQL") & F.col("table_name").isNotNull())
            .groupBy("project_id", "table_name").agg(F.count("*").alias("n"),
                                                     F.min(F.col("line_no") * 2 + F.col("seq")).alias("first_seen")))
