"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_matches_sql(spark, con, name):
    ok, text = check.compare(spark, con, name, SF)
    assert ok, text


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r["eta_s"] > 0 for r in rows)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
