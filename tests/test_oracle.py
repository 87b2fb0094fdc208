"""Every registered query with an SQL equivalent, against DuckDB on the same files."""

import pytest

from checks import REGISTRY
from checks.compare import connect, difference, oracle_rows, spark_rows

WITH_SQL = [name for name, (_, sql) in REGISTRY.items() if sql is not None]


@pytest.fixture(scope="module")
def con(sf):
    connection = connect(sf)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_sql(spark, sf, con, name):
    run, sql = REGISTRY[name]
    assert difference(spark_rows(run(spark, sf)), oracle_rows(con, sql)) is None


def test_entry_has_rows(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
