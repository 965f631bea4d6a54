"""Physical-plan checks on the registered queries."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["top_endpoints", "first_endpoints", "top_tables", "first_calls"])
def test_top_k_has_partial_limit(spark, name):
    p = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert p.count("WindowGroupLimit") >= 2  # partial (before the shuffle) and final


@pytest.mark.parametrize("name", ["nearest_pairs", "nearest_documents", "related_table", "feature_matrix"])
def test_no_pairwise_join(spark, name):
    p = _final_plan(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p


def test_scans_are_pruned(spark):
    df = E.queries()["tfidf_documents"](spark, SF)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in p


def test_correlation_never_single_partition(spark):
    p = _final_plan(E.queries()["log_correlation"](spark, SF))
    assert "SinglePartition" not in p


def test_call_edges_parse_once(spark):
    """The Java text is blanked by one Python pass; all edge kinds come from it."""
    from svcseam.operators import calls as C
    src = spark.createDataFrame([("p", "A.java", "class A { void f() { a.b().c(); } @Autowired B bb; }")],
                                "project_id string, path string, content string")
    p = _final_plan(C.call_edges(C.parse_sources(src)))
    assert p.count("ArrowEvalPython") == 1
    # the text is parsed before the one exchange, which holds only the sites found
    assert p.count("Exchange hashpartitioning") == 1 and p.index("Exchange hashpartitioning") < p.index("ArrowEvalPython")
    assert p.index("Exchange hashpartitioning") < p.index("Generate posexplode(sites")


def test_call_rows_are_numbered_as_keys(spark):
    """The sort and window that number the call rows hold keys and two names, no texts made of them."""
    from svcseam.sources import fixtures as FX
    p = FX.calls(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    below = p[p.rindex("Window [row_number()") if "Window [row_number()" in p else p.index("row_number()"):]
    assert "com.shop" not in below and "/Order" not in below and "method_call" not in below
