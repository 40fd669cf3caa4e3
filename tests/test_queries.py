"""Every core query runs over its whole tables, and equals its SQL where it has one."""

import pytest
from sqlcheck import DATA, same

from hypomill.plans.queries import QUERIES
from hypomill.plans.sql import SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    same(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
