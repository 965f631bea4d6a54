"""The whole extraction as lazily built DataFrames.

``Extraction`` takes the three evidence sources (call edges or Java text, DDL
scripts or the statements read from them, log lines) and exposes every intermediate table as a property. Each
property is a lazy DataFrame; Catalyst prunes whatever a consumer does not
read. Nothing is collected.

The log events, the DDL scripts, the tables, the call edges, the call metrics or the class list, and the
matrix each feed several consumers, so with ``materialize=True`` they are written once to
the shared checkpoint folder instead of being recomputed per consumer; queries that read
them once say ``materialize=False``. The call metrics, the class list and the call types are one pass
over the edges each, which no more than they need is read for, so the edges are not written for them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import calls as C
from ..operators import ddl as D
from ..operators import features as M
from ..operators import logs as L
from ..operators import matrix as X
from ..operators import metrics as A
from ..operators import similarity as S
from ..session import cut_lineage
from ..sources import fixtures as FX


class Extraction:
    def __init__(self, log_lines: DataFrame, ddl_scripts: DataFrame, edges: DataFrame,
                 source_files: DataFrame | None = None, bucket_rows: int | None = None,
                 materialize: bool = True, statements: DataFrame | None = None):
        self._statements = statements
        self.log_lines = log_lines
        self._ddl_scripts = ddl_scripts
        self._edges = edges
        self.source_files = source_files
        self.bucket_rows = bucket_rows
        self.materialize = materialize

    def _keep(self, df: DataFrame) -> DataFrame:
        return cut_lineage(df) if self.materialize else df

    # -- fixtures -------------------------------------------------------------
    @classmethod
    def from_fixtures(cls, spark: SparkSession, sf_dir: str, from_text: bool = False, materialize: bool = True) -> "Extraction":
        src = FX.source_files(spark, sf_dir) if from_text else None
        edges = None if from_text else FX.calls(spark, sf_dir)
        return cls(FX.log_lines(spark, sf_dir), FX.ddl_scripts(spark, sf_dir), edges, src, materialize=materialize)

    # -- step 2C: logs --------------------------------------------------------
    @cached_property
    def events(self) -> DataFrame:
        # correlation, frequencies, totals and sinks all read the events:
        # scan and regex-parse the log once
        return self._keep(L.log_events(self.log_lines))

    @cached_property
    def correlation(self) -> DataFrame:
        kw = {} if self.bucket_rows is None else {"bucket_rows": self.bucket_rows}
        return L.log_correlation(self.events, **kw)

    @cached_property
    def resource_tables(self) -> DataFrame:
        return L.resource_table_map(self.correlation)

    @cached_property
    def endpoint_freq(self) -> DataFrame:
        return L.endpoint_frequency(self.events)

    @cached_property
    def table_freq(self) -> DataFrame:
        return L.table_frequency(self.events)

    # -- step 2B: schema ------------------------------------------------------
    @cached_property
    def ddl_scripts(self) -> DataFrame:
        # statements, tables, columns, keys, metrics and project lists all
        # start here: read (or derive) the scripts once
        return self._keep(self._ddl_scripts)

    @cached_property
    def statements(self) -> DataFrame:
        return self._statements if self._statements is not None else D.statements(self.ddl_scripts)

    @cached_property
    def tables(self) -> DataFrame:
        return self._keep(D.tables(self.statements))

    @cached_property
    def columns(self) -> DataFrame:
        return D.columns(self.tables)

    @cached_property
    def explicit_fks(self) -> DataFrame:
        return D.explicit_foreign_keys(self.statements)

    @cached_property
    def inferred_fks(self) -> DataFrame:
        return D.inferred_foreign_keys(self.columns, self.tables, self.explicit_fks)

    @cached_property
    def foreign_keys(self) -> DataFrame:
        return D.all_foreign_keys(self.explicit_fks, self.inferred_fks)

    # -- step 2A: calls -------------------------------------------------------
    @cached_property
    def parsed_sources(self) -> DataFrame:
        return self._keep(C.parse_sources(self.source_files))

    @cached_property
    def edges(self) -> DataFrame:
        if self._edges is not None:
            return self._keep(self._edges)
        return C.call_edges(self.parsed_sources)  # an explode of the kept files

    @property
    def _passed_edges(self) -> DataFrame:
        """The edges for a single pass: as given, not written, unless they have been."""
        if "calls" in vars(self):
            return self.calls
        return self._edges if self._edges is not None and "edges" not in vars(self) else self.edges

    @cached_property
    def calls(self) -> DataFrame:
        """Who calls whom and how, kept for where more than one pass reads it."""
        return self._keep(self._passed_edges.select("project_id", "from_class", "to_class", "call_type"))

    @cached_property
    def classes(self) -> DataFrame:
        if self.materialize and "call_metrics" in vars(self):  # one row for each distinct caller (C8)
            return self.call_metrics.select("project_id", "class_name")
        return self._keep(C.class_list(self._passed_edges))

    @cached_property
    def call_types(self) -> DataFrame:
        return C.call_type_histogram(self._passed_edges)

    # -- step 2D: matrix ------------------------------------------------------
    @cached_property
    def call_metrics(self) -> DataFrame:
        return self._keep(A.call_metrics(self._passed_edges))

    @cached_property
    def table_metrics(self) -> DataFrame:
        return A.table_metrics(self.tables, self.columns, self.foreign_keys, self.table_freq)

    @cached_property
    def matrix(self) -> DataFrame:
        return self._keep(X.feature_matrix(self.call_metrics, None, self.tables, self.table_metrics))

    # -- step 3: features -----------------------------------------------------
    @cached_property
    def zscores(self) -> DataFrame:
        return M.zscores(self.matrix)

    @cached_property
    def tfidf(self) -> DataFrame:
        return M.class_tfidf(self.classes)

    @cached_property
    def composite(self) -> DataFrame:
        ids = ["related_table"]
        return M.composite_long(M.zscores_long(M.zscores(self.matrix, ids=ids), ids=ids), self.tfidf, ids=self.matrix)

    @cached_property
    def composite_cells(self) -> DataFrame:
        return M.composite_cells(M.zscores(self.matrix, ids=["related_table"]), self.tfidf)

    @cached_property
    def nearest(self) -> DataFrame:
        return S.nearest_pairs(self.tfidf, "class_name")
