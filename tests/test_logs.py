"""Log operators L1–L10 and carry-forward W1: goldens, quirks, properties, plans."""

import pytest
from pyspark.sql import functions as F

from svcseam.operators import carry, logs as L


def _lines(spark, lines, session="s"):
    rows = [("p", session, i + 1, t) for i, t in enumerate(lines)]
    return spark.createDataFrame(rows, "project_id string, session_id string, line_no long, line string")


def test_edge_lines(spark):
    ev = L.log_events(_lines(spark, [
        "GET /owners/1?x=1 select o from owners",   # two events, HTTP first
        "update owners set name=1",                 # K1: table is the word after SET
        "delete from Pets",
        "insert into t select a from b",
        "WIDGET /x",                                # no word boundary: GET
        "GET /", "GET /?a=b", "GET /?", "POST //",  # K2: resource '' and no failure
        "nothing here",
    ])).orderBy("line_no", "seq").collect()
    got = [(r.line_no, r.type, r.method, r.endpoint, r.resource, r.table_name, r.operation) for r in ev]
    assert got == [
        (1, "HTTP", "GET", "/owners/1?x=1", "owners", None, None),
        (1, "SQL", None, None, None, "owners", "SELECT"),
        (2, "SQL", None, None, None, "name", "UPDATE"),
        (3, "SQL", None, None, None, "pets", "DELETE"),
        (4, "SQL", None, None, None, "t", "INSERT"),
        (5, "HTTP", "GET", "/x", "x", None, None),
        (6, "HTTP", "GET", "/", "", None, None),
        (7, "HTTP", "GET", "/?a=b", "", None, None),
        (8, "HTTP", "GET", "/?", "", None, None),
        (9, "HTTP", "POST", "//", "", None, None),
    ]


def test_fixed_update_table(spark):
    ev = L.log_events(_lines(spark, ["update owners set name=1"]), fixed_update_table=True).collect()
    assert ev[0].table_name == "owners"


def _golden_events(spark):
    """One line per recorded event."""
    lines = ["GET /owners", "select * from owners", "GET /owners/1", "select * from owners", "select * from pets", "POST /owners/new",
             "insert into owners values (1)", "GET /owners/1/pets/new", "POST /owners/1/pets/new", "insert into pets values (1)",
             "GET /owners/1/pets/1/visits/new", "POST /owners/1/pets/1/visits/new", "insert into visits values (1)", "GET /vets",
             "select * from vets", "select * from specialties", "GET /owners?lastName=Davis", "select * from owners"]
    return L.log_events(_lines(spark, lines))


def test_recorded_log_golden(spark):
    """The 18 recorded events: correlation, counts and totals."""
    ev = _golden_events(spark)
    rtm = L.resource_table_map(L.log_correlation(ev)).orderBy("first_seen").collect()
    assert [(r.resource, r.tables) for r in rtm] == [
        ("owners", ["owners", "pets", "visits"]), ("vets", ["vets", "specialties"])]
    tf = {r.table_name: r.n for r in L.table_frequency(ev).collect()}
    assert tf == {"owners": 4, "pets": 2, "visits": 1, "vets": 1, "specialties": 1}
    tot = L.log_totals(ev).collect()[0]
    assert (tot.total_http, tot.total_sql, tot.total_events) == (9, 9, 18)
    ef = L.first_seen(L.endpoint_frequency(ev), "endpoint").orderBy("rank").collect()
    assert [r.endpoint for r in ef] == ["/owners", "/owners/1", "/owners/new", "/owners/1/pets/new",
                                        "/owners/1/pets/1/visits/new"]
    top = L.top_k(L.endpoint_frequency(ev), "endpoint", 2).orderBy("rank").collect()
    assert [(r.endpoint, r.n) for r in top] == [("/owners/1/pets/1/visits/new", 2), ("/owners/1/pets/new", 2)]


def test_sql_before_http_has_no_pair(spark):
    ev = L.log_events(_lines(spark, ["select a from t", "GET /x", "select b from u"]))
    pairs = L.log_correlation(ev).collect()
    assert [(r.resource, r.table_name) for r in pairs] == [("x", "u")]


@pytest.mark.parametrize("bucket_rows", [1, 7, 100, 1 << 20])
def test_bucketed_equals_plain(spark, sf_small, bucket_rows):
    from svcseam.sources import fixtures as FX
    ev = L.log_events(FX.log_lines(spark, sf_small))
    a = L.log_correlation(ev, bucketed=True, bucket_rows=bucket_rows)
    b = L.log_correlation(ev, bucketed=False)
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_partition_invariance(spark, sf_small):
    from svcseam.sources import fixtures as FX
    ll = FX.log_lines(spark, sf_small)
    a = L.resource_table_map(L.log_correlation(L.log_events(ll)))
    b = L.resource_table_map(L.log_correlation(L.log_events(ll.repartition(7).orderBy(F.rand(1)))))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_carry_no_single_partition(spark, sf_small):
    from svcseam.sources import fixtures as FX
    pairs = L.log_correlation(L.log_events(FX.log_lines(spark, sf_small)))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_carry_forward_generic(spark):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate([None, "a", None, None, "b", None])],
                               "k string, o long, v string")
    out = carry.carry_forward(df, ["k"], ["o"], F.col("v"), "c", bucket_rows=2).orderBy("o").collect()
    assert [r.c for r in out] == [None, "a", "a", "a", "b", "b"]
