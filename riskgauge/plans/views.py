"""Deterministic views of the benchmark tables, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import observation_group
from ..operators import risk


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*(F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def rounded_sql(columns: str, sql: str, digits: int = 9) -> str:
    """``sql`` with its double ``columns`` rounded, as ``rounded`` does."""
    head, with_, rest = "", "", sql.strip()
    return f"{head}{with_}SELECT * REPLACE ({', '.join(f'round({c}, {digits}) AS {c}' for c in columns.split())}) FROM ({rest})"


# Factors of the score ticks by seed.
SEEDS = {42: (37, 911), 43: (41, 907), 44: (53, 883), 45: (59, 877)}
BUDGETS = (0.01, 0.02, 0.05, 0.1, 0.2)


def scored(spark: SparkSession, sf_dir: str, seed: int = 42) -> DataFrame:
    """Events with a score of 1001 ticks; every class of event is labelled, two of them are observations only."""
    a, b = SEEDS[seed]
    e = read(spark, sf_dir, "events")
    k = F.pmod(F.round(F.col("value") * 100).cast("bigint") * a + F.col("event_id") % 7 * b, F.lit(1001))
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").cast("date").alias("day"), kind.alias("label"), observation_group(kind, kind == "signup", kind == "view").alias("observation_group"),
        (kind == "error").cast("int").alias("binary_label"), k.alias("k")).withColumn("p", F.col("k") / 1000)


def pred(spark: SparkSession, sf_dir: str, seed: int = 42) -> DataFrame:
    """Predictions on all rows. Confidence comes from the integer tick, so that ties are exact."""
    p = risk.predictions(scored(spark, sf_dir, seed))
    return p.withColumn("confidence", F.greatest("k", 1000 - F.col("k")) / 1000)


def target(spark: SparkSession, sf_dir: str, seed: int = 42) -> DataFrame:
    return pred(spark, sf_dir, seed).where("observation_group = 'none'")


def pred_sql(seed: int = 42, where: str = "true") -> str:
    a, b = SEEDS[seed]
    return f"""(SELECT id, day, label, observation_group, binary_label, k, k / 1000 AS p, (k >= 500)::INT AS predicted, greatest(k, 1000 - k) / 1000 AS confidence,
      ((k >= 500)::INT <> binary_label)::INT AS is_error FROM (
      SELECT event_id AS id, ts::DATE AS day, event_type AS label, CASE event_type WHEN 'signup' THEN 'attempted' WHEN 'view' THEN 'invalid_class' ELSE 'none' END AS observation_group,
        (event_type = 'error')::INT AS binary_label, (((round(value * 100)::BIGINT * {a} + event_id % 7 * {b}) % 1001) + 1001) % 1001 AS k FROM events) WHERE {where})"""


TARGET = "observation_group = 'none'"


def groups_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as labelled rows with a composite key: duplicates, label conflicts and days."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        "l_partkey", "l_quantity", F.concat("l_returnflag", "l_linestatus").alias("label"), F.col("l_linenumber").alias("day"),
        F.md5(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("bigint"))).alias("id"), (F.concat("l_returnflag", "l_linestatus") == "NO").alias("is_benign"))


GROUPS = """(SELECT l_partkey, l_quantity, l_returnflag || l_linestatus AS label, l_linenumber AS day,
  md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT)) AS id, (l_returnflag || l_linestatus) = 'NO' AS is_benign FROM lineitem)"""
KEY = ["l_partkey", "l_quantity"]
