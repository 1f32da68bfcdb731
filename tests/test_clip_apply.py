"""Clipping to the last bit of its SQL, on rows that the given tables don't hold."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from riskgauge.functions import scalars as sc
from riskgauge.operators import prep
from riskgauge.plans.registry import entries

SF = "/root/testdata/sf0.001"
INF = float("inf")

#: Prices of five decimals; rows whose discount, price, quantity or day is unknown or no number; no row to train on.
ODD = {
    "decimals": "* REPLACE (l_extendedprice + 0.00005 AS l_extendedprice)",
    "unknown": """* REPLACE (CASE l_orderkey % 11 WHEN 0 THEN NULL ELSE l_discount END AS l_discount,
      CASE l_orderkey % 11 WHEN 1 THEN NULL WHEN 2 THEN 'Infinity'::DOUBLE WHEN 3 THEN '-Infinity'::DOUBLE WHEN 4 THEN 'NaN'::DOUBLE WHEN 5 THEN -l_extendedprice ELSE l_extendedprice END AS l_extendedprice,
      CASE l_orderkey % 11 WHEN 6 THEN NULL WHEN 7 THEN 25 ELSE l_quantity END AS l_quantity, CASE l_orderkey % 11 WHEN 8 THEN NULL ELSE l_shipdate END AS l_shipdate)""",
    "no_train": "* REPLACE (l_shipdate + INTERVAL 20 YEAR AS l_shipdate)",
}


@pytest.mark.parametrize("kind", sorted(ODD))
def test_clip_apply_equals_sql_exactly(spark, tmp_path, kind):
    query, sql = entries()["clip_apply"]
    con = duckdb.connect()
    con.execute(f"COPY (SELECT {ODD[kind]} FROM '{SF}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    query(spark, str(tmp_path)).write.parquet(f"{tmp_path}/got")
    con.execute(f"CREATE TABLE want AS {sql}")
    cols = ", ".join(r[0] for r in con.execute("DESCRIBE want").fetchall())
    con.execute(f"CREATE TABLE got AS SELECT {cols} FROM '{tmp_path}/got/*.parquet'")
    assert con.execute("SELECT count(*) FROM got").fetchone() == con.execute("SELECT count(*) FROM want").fetchone()
    assert con.execute("FROM got EXCEPT ALL FROM want").fetchall() == con.execute("FROM want EXCEPT ALL FROM got").fetchall() == []


def test_bounds_equal_sql_quantiles_to_the_last_bit(spark):
    r = random.Random(4)
    columns = {f"c{i}": [round(r.uniform(900, 105_000), 2) / r.choice((0.01, 0.03, 0.07, 0.08)) * r.choice((1, 1, -1)) for _ in range(r.randint(1, 30))] for i in range(30)}
    columns |= {"one": [5.0] * 9, "zeros": [0.0, -3.0, 0.0, 2.0], "empty": []}
    rows = [tuple(v[k] if k < len(v) else x for v in columns.values()) for x in (INF, -INF) for k in range(40)]
    rows = [(True, *row) for row in rows[:40]] + [(False, *row) for row in rows[40:]]
    df = spark.createDataFrame(rows, "train boolean, " + ", ".join(f"{c} double" for c in columns))
    got = {b["column"]: (b["upper"], b["lower"]) for b in prep.clip_bounds(df, list(columns), F.col("train")).collect()}
    con = duckdb.connect()
    for c, v in columns.items():
        v = [x for t, x in ((row[0], row[1 + list(columns).index(c)]) for row in rows) if t and math.isfinite(x)]
        assert got[c] == con.execute("SELECT quantile_cont(x, 0.999) * 3, quantile_cont(x, 0.001) * 3 FROM unnest(?::DOUBLE[]) t(x)", [v]).fetchone(), c


def test_rounding_is_that_of_the_sql(spark):
    r = random.Random(5)
    xs = [r.randint(-(10**11), 10**11) / 10**5 for _ in range(2000)] + [0.5, -0.5, 0.00005, -0.00005, 0.49999999999999994, 2.0**53 + 2, 1e300, -1e308, INF, -INF, 45974.30625, 45228.86624999999, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = [a["y"] for a in df.select("i", sc.scaled_round(F.col("x"), 4).alias("y")).orderBy("i").collect()]
    assert got == duckdb.connect().execute("SELECT list_transform(?::DOUBLE[], lambda x: round(x, 4))", [xs]).fetchone()[0]
