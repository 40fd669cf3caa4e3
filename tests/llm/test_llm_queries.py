"""Registered training-data queries: equal to SQL where they have it, else they run; exact columns of pN_found."""

import pytest
from sqlcheck import DATA, same

from hypomill.llm.queries import QUERIES
from hypomill.llm.sql import SQL

COLUMNS = {
    "p2_found": ["exchange_id", "defect"], "p3_found": ["record_table", "record_id"], "p4_found": ["row_a", "row_b"], "p5_found": ["first_line_id", "line_id"],
    "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "kind"],
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    same(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns == COLUMNS.get(name, df.columns)
    assert df.count() > 0
