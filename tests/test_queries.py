"""Every query with SQL against DuckDB on the smallest tables; the others give rows."""

import math
import os

import duckdb
import pytest

import tallyforge.plans as plans

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, DIR)
    got = [tuple(r) for r in df.collect()]
    if name not in plans.SQL:
        assert df.columns and (got or name == "jn11_fuzzy_join")
        return
    want = duck.sql(plans.SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert plain(got, df.columns) == plain(want.fetchall(), want.columns)
