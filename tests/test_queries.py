"""Every registered query: against its SQL twin where it has one, else rows and schema."""

import pytest

import __spark_entry__ as entry
from check import compare, views
from broadloom.plans.catalogue import CATALOGUE

WITH_SQL = sorted(n for n, q in CATALOGUE.items() if q.sql)
ROWS_ONLY = sorted(n for n, q in CATALOGUE.items() if not q.sql)


@pytest.fixture(scope="module")
def con(sf):
    return views(sf)


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_sql(spark, sf, con, name):
    assert compare(entry.queries()[name](spark, sf), con, entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_has_rows(spark, sf, name):
    out = entry.queries()[name](spark, sf)
    assert len(set(out.columns)) == len(out.columns)
    assert out.count() > 0


def test_flagship_schema(spark):
    assert entry.entry(spark).columns == ["ID", "model", "pred"]
