"""Every registered query with SQL equals DuckDB on the same files."""

import os

import oracle
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(name, spark, con):
    df = entry.queries()[name](spark, FOLDER)
    if name in SQL:
        assert oracle.compare(df, con, SQL[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
