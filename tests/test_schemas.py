"""The tables the operators exchange keep their declared schemas."""

import pytest

from svcseam import schemas as SC
from svcseam.plans.extraction import Extraction

CASES = [("log_lines", SC.LOG_LINES), ("events", SC.LOG_EVENTS), ("ddl_scripts", SC.DDL_SCRIPTS),
         ("edges", SC.CALLS), ("columns", SC.DB_COLUMNS), ("foreign_keys", SC.FOREIGN_KEYS),
         ("matrix", SC.FEATURE_MATRIX)]


@pytest.fixture(scope="module")
def extraction(spark, sf_small):
    return Extraction.from_fixtures(spark, sf_small)


@pytest.mark.parametrize("prop,schema", CASES)
def test_schema(extraction, prop, schema):
    got = [(f.name, f.dataType.simpleString()) for f in getattr(extraction, prop).schema.fields]
    assert got == [(f.name, f.dataType.simpleString()) for f in schema.fields]


def test_text_edges_schema(spark, sf_small):
    x = Extraction.from_fixtures(spark, sf_small, from_text=True)
    got = [(f.name, f.dataType.simpleString()) for f in x.edges.schema.fields]
    assert got == [(f.name, f.dataType.simpleString()) for f in SC.CALLS.fields]
