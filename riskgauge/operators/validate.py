"""Validation checks as rows (name, passed, level, detail), and their roll-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check(df: DataFrame, name: str, count, level: str = "error") -> DataFrame:
    """One row: passed if the counted offenders are none."""
    return df.agg(F.coalesce(count, F.lit(0)).cast("long").alias("detail")).select(F.lit(name).alias("name"), (F.col("detail") == 0).alias("passed"), F.lit(level).alias("level"), "detail")


def crossing_groups(rows: DataFrame, group: str = "group_id") -> DataFrame:
    g = rows.groupBy(group).agg(F.count_distinct("split").alias("n"))
    return check(g, "group_in_one_split", F.count_if(F.col("n") > 1))


def shared_ids(rows: DataFrame, key: list[str], a: str = "train", b: str = "calib") -> DataFrame:
    g = rows.where(F.col("split").isin(a, b)).groupBy(*key).agg(F.count_distinct("split").alias("n"))
    return check(g, "row_in_train_or_calib", F.count_if(F.col("n") > 1))


def one_sided(groups: DataFrame, by: list[str]) -> DataFrame:
    g = groups.groupBy(*by).agg(F.count_distinct("split").alias("n"))
    return check(g, "split_skew", F.count_if(F.col("n") == 1), "warning")


def left_out_absent(groups: DataFrame, labels: list[str], label: str = "attack_label") -> DataFrame:
    return check(groups, "left_out_absent_from_train", F.count_if(F.col(label).isin(*labels) & F.col("split").isin("train", "calib")))


def no_duplicates(rows: DataFrame, cols: list[str]) -> DataFrame:
    g = rows.groupBy(*cols).agg(F.count("*").alias("n"))
    return check(g, "no_exact_duplicates", F.sum(F.col("n") - 1))


def flag_count(rows: DataFrame, flag: str, expected: int, name: str) -> DataFrame:
    return check(rows, name, F.abs(F.count_if(flag) - expected))


def column_apart(rows: DataFrame, side: DataFrame, column: str) -> DataFrame:
    spark = rows.sparkSession
    bad = int(column in rows.columns) + int(column not in side.columns)
    return spark.sql(f"SELECT 'column_reserved' AS name, {bad} = 0 AS passed, 'error' AS level, CAST({bad} AS BIGINT) AS detail")


def key_absent(spark, manifest: dict, key: str) -> DataFrame:
    bad = int(key in manifest)
    return spark.sql(f"SELECT 'manifest_key_absent' AS name, {bad} = 0 AS passed, 'error' AS level, CAST({bad} AS BIGINT) AS detail")


def run_all(*checks: DataFrame) -> DataFrame:
    """All checks, each with the overall verdict: no check of level error fails."""
    c = reduce(DataFrame.unionByName, checks)
    whole = c.agg(F.coalesce(F.bool_and(F.col("passed") | (F.col("level") != "error")), F.lit(True)).alias("all_passed"))
    return c.crossJoin(F.broadcast(whole))  # one row
