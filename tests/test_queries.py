"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from riskgauge.plans.registry import entries

SF = "/root/testdata/sf0.001"
ENTRIES = entries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(df):
    def value(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    out = [tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False)]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


@pytest.mark.parametrize("name", sorted(k for k, (_, sql) in ENTRIES.items() if sql))
def test_query_equals_sql(spark, con, name):
    query, sql = ENTRIES[name]
    got, want = query(spark, SF).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for p, q in zip(x, y, strict=True):
            assert p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-9 * max(1, abs(p))), (x, y)


@pytest.mark.parametrize("name", sorted(k for k, (_, sql) in ENTRIES.items() if not sql))
def test_query_without_sql_gives_rows(spark, name):
    assert ENTRIES[name][0](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5 and set(e.oracle_sql()) <= set(e.queries())
