"""Randomised properties against plain-Python brute force (small inputs)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from svcseam.operators import logs as L

EVENT = st.one_of(
    st.tuples(st.just("HTTP"), st.sampled_from(["a", "b", "c", ""])),
    st.tuples(st.just("SQL"), st.sampled_from(["t1", "t2", "t3"])),
)
SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))


def _brute_correlation(rows):
    """rows: (session, line_no, seq, type, value) → {(session, line_no, seq): resource}."""
    out = {}
    for s in sorted({r[0] for r in rows}):
        cur = None
        for _, line_no, seq, typ, val in sorted(r for r in rows if r[0] == s):
            if typ == "HTTP":
                cur = val
            elif cur is not None:
                out[(s, line_no, seq)] = (cur, val)
    return out


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["s1", "s2", "hot"]), EVENT), min_size=1, max_size=60),
       st.sampled_from([1, 3, 8, 1000]))
def test_correlation_matches_brute_force(spark, events, bucket_rows):
    rows = []
    for i, (session, (typ, val)) in enumerate(events):
        line_no = i // 2 + 1   # two events may share a line
        seq = 0 if typ == "HTTP" else 1
        rows.append((session, line_no, seq, typ, val))
    rows = list({(r[0], r[1], r[2]): r for r in rows}.values())  # one event per (session, line, seq)
    df = spark.createDataFrame(
        [("p", s, n, q, t, None, None, v if t == "HTTP" else None, v if t == "SQL" else None, None)
         for s, n, q, t, v in rows],
        "project_id string, session_id string, line_no long, seq int, type string, method string, "
        "endpoint string, resource string, table_name string, operation string")
    got = {(r.session_id, r.line_no, r.seq): (r.resource, r.table_name)
           for r in L.log_correlation(df, bucket_rows=bucket_rows).collect()}
    assert got == _brute_correlation(rows)


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["p", "q"]), st.text("xyz/", min_size=1, max_size=3)),
                min_size=1, max_size=80), st.integers(1, 4))
def test_top_k_matches_brute_force(spark, hits, k):
    rows = [(p, i, 0, "HTTP", "GET", e, "", None, None) for i, (p, e) in enumerate(hits)]
    df = spark.createDataFrame(rows, "project_id string, line_no long, seq int, type string, method string, "
                                     "endpoint string, resource string, table_name string, operation string")
    got = sorted((r.project_id, r.rank, r.endpoint, r.n) for r in L.top_k(L.endpoint_frequency(df), "endpoint", k).collect())
    exp = []
    for p in sorted({h[0] for h in hits}):
        counts = {}
        for q, e in hits:
            if q == p:
                counts[e] = counts.get(e, 0) + 1
        ranked = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:k]
        exp += [(p, i + 1, e, n) for i, (e, n) in enumerate(ranked)]
    assert got == sorted(exp)
