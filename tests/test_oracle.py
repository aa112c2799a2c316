"""Every registered query against its SQL on DuckDB, on the smallest tables."""

from pathlib import Path

import pytest

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")

from rewardloom.catalog import QUERIES, SQL  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    from check import connect

    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees(spark, duck, name):
    from check import compare

    df = QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    cursor = duck.execute(SQL[name])
    assert compare(df.columns, rows, [d[0] for d in cursor.description], cursor.fetchall()) == ""


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert SQL.keys() <= entry.oracle_sql().keys()
