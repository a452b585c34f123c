"""Every registered query of the core against its SQL on the smallest tables, or at least run."""

import pytest

from lorewell.plans import registry
from tests.compare import connect, spark_rows, sql_rows

QUERIES, SQL = registry.queries(), registry.sql()


@pytest.fixture(scope="module")
def database(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, data, database, name):
    rows, columns = spark_rows(QUERIES[name](spark, data))
    expected, names = sql_rows(database, SQL[name])
    assert columns == names
    assert rows == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).columns


def test_entry_names_match():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert registry.FLAGSHIP in entry.queries()
