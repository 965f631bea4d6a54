"""Every registered query against its DuckDB oracle on the smallest fixture."""

import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as E
from svcseam.plans.registry import REGISTRY
from svcseam.sources.fixtures import TABLES

SF = "/root/testdata/sf0.001"


def _norm(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


def _digest(rows):
    return hashlib.sha256("\n".join(sorted("|".join(_norm(x) for x in r) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    missing = set(REGISTRY) - set(E.oracle_sql())
    assert missing == set()


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    srows = [tuple(r[c] for c in cols) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(ocols) == cols
    orows = [tuple(r[ocols.index(c)] for c in cols) for r in res.fetchall()]
    assert len(srows) == len(orows)
    assert _digest(srows) == _digest(orows)


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["project_id", "class_name", "related_table", "feature", "value"]
    assert df.count() > 0
