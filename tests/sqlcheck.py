"""Compares a query with its SQL over the same tables."""

import glob
import os

import duckdb

DATA = os.environ.get("HYPOMILL_TEST_DATA", "/root/testdata/sf0.001")


def connection(d=DATA):
    c = duckdb.connect()
    for f in glob.glob(f"{d}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def rows(table):
    names = sorted(table.column_names)

    def text(v):
        if v is None or (isinstance(v, float) and v != v):
            return "~"
        return repr(round(v, 9)) if isinstance(v, float) else str(v)

    return names, sorted("|".join(text(r[n]) for n in names) for r in table.to_pylist())


def same(spark, query, sql, d=DATA):
    got, want = rows(query(spark, d).toArrow()), rows(connection(d).sql(sql).to_arrow_table())
    assert got[0] == want[0]
    assert got[1] == want[1]
