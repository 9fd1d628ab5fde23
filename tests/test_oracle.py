"""Every core query that SQL can state, against that SQL."""

import pytest
from compare import check, tables

from foliant.plans.catalog import oracle_sql, queries

SQL = oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return tables(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, con, name):
    check(queries()[name](spark, data), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries()) - set(SQL)))
def test_runs(spark, data, name):
    assert queries()[name](spark, data).columns


def test_entry(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
