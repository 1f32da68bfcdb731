"""Label inventories, shortcut scans, what-if scenarios and consistency checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from .profile import long_form


def counts(rows: DataFrame, *by: str) -> DataFrame:
    """Rows by values; null is a value."""
    return rows.groupBy(*by).agg(F.count("*").alias("rows"))


def sentinel_check(rows: DataFrame, attempted: Column, category: str) -> DataFrame:
    """Whether rows that aren't attempted share one category, and how many attempted rows have it too."""
    s = rows.agg(F.array_sort(F.collect_set(F.when(~attempted, F.col(category)))).alias("other_categories"), F.count_if(attempted).alias("attempted_rows"))
    single = s.where(F.size("other_categories") == 1).select(F.col("other_categories")[0].alias("sentinel"))
    j = rows.withColumn("a", attempted).join(F.broadcast(single), F.col(category).eqNullSafe(F.col("sentinel")))  # one row at most
    m = j.agg(F.count_if("a").alias("mismatches"))
    return s.crossJoin(F.broadcast(m)).select(F.size("other_categories").cast("long").alias("n_other_categories"), F.col("other_categories")[0].alias("sentinel"), "attempted_rows", "mismatches", (F.size("other_categories") != 1).alias("ambiguous"))


def sentinel_examples(rows: DataFrame, attempted: Column, category: str, sentinel, key: list[str], n: int = 20) -> DataFrame:
    return rows.where(attempted & (F.col(category) == sentinel)).select(*key, category).orderBy(*key).limit(n)


def value_occurrences(rows: DataFrame, col: str, values: list, target: Column, benign: Column, label: str = "label") -> DataFrame:
    """For each value: rows in all, of the target, of others, and the other labels."""
    v = rows.where(F.col(col).isin(*values))
    return v.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("rows"), F.count_if(target).alias("target_rows"), F.count_if(~target).alias("other_rows"), F.count_if(benign).alias("benign_rows"), F.array_join(F.array_sort(F.collect_set(F.when(~target, F.col(label)))), ",").alias("other_labels"))


def outside_values(rows: DataFrame, col: str, values: list, target: Column) -> DataFrame:
    return rows.agg(F.count_if(target).alias("target_rows"), F.count_if(target & ~F.coalesce(F.col(col).isin(*values), F.lit(False))).alias("outside_rows"))


def top_values(rows: DataFrame, col: str, n: int = 20) -> DataFrame:
    """The most common values and their shares (a report of n)."""
    c = counts(rows, col)
    total = c.agg(F.sum("rows").alias("total"))
    return c.orderBy(F.desc("rows"), col).limit(n).crossJoin(F.broadcast(total)).select(F.col(col).alias("value"), "rows", ratio(F.col("rows"), F.col("total")).alias("share"))


def shortcut_scan(rows: DataFrame, label: str, cols: list[str], top: int = 10, coverage: float = 0.9) -> DataFrame:
    """Columns of which ``top`` values cover most rows of a label."""
    c = long_form(rows, cols, [label]).groupBy(label, "column", "value").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy(label, "column").orderBy(F.desc("n"), "value"))
    s = c.withColumn("nth", nth).groupBy(label, "column").agg(F.sum(F.when(F.col("nth") <= top, F.col("n"))).alias("top_rows"), F.sum("n").alias("rows"))
    return s.withColumn("coverage", ratio(F.col("top_rows"), F.col("rows"))).withColumn("shortcut", F.col("coverage") >= coverage)


def scenario_names(special: Column, attempted: Column, category: Column, codes: list | None) -> Column:
    """The what-if tables that a row is in: S0 all, S1 without the special class, S3 also without attempts, S4 as S1, S2 with attempts of some codes."""
    kept = ~attempted | F.coalesce(category.isin(*codes), F.lit(False)) if codes else F.lit(False)
    tests = {"S0": F.lit(True), "S1": ~special, "S2": ~special & kept, "S3": ~special & ~attempted, "S4": ~special}
    return F.filter(F.array(*(F.when(t, k) for k, t in tests.items())), lambda x: x.isNotNull())


def with_scenarios(rows: DataFrame, names: Column) -> DataFrame:
    return rows.withColumn("scenario", F.explode(names))


def scenario_summary(rows: DataFrame, benign: Column, label: str = "label") -> DataFrame:
    return rows.groupBy("scenario").agg(F.count("*").alias("rows"), F.count_if(benign).alias("benign_rows"), F.count_if(~benign).alias("attack_rows"), F.count_distinct(F.when(~benign, F.col(label))).alias("attack_labels"))


def labels_dropped(rows: DataFrame, label: str = "label", base: str = "S0") -> DataFrame:
    """Labels of the base table that a scenario has none of."""
    has = rows.select("scenario", label).distinct()
    want = has.where(F.col("scenario") == base).select(label).crossJoin(F.broadcast(has.select("scenario").distinct()))  # five scenarios
    return want.join(has, ["scenario", label], "left_anti").select("scenario", label)


def contamination(rows: DataFrame, shortcut: Column, benign: Column, limit: float = 0.001) -> DataFrame:
    s = rows.agg(F.count_if(shortcut & benign).alias("benign_shortcut_rows"), F.count_if(benign).alias("benign_rows"))
    r = ratio(F.col("benign_shortcut_rows"), F.col("benign_rows"))
    return s.withColumn("ratio", r).withColumn("stop", F.coalesce(r > limit, F.lit(False)))


def denominators(rows: DataFrame, definitions: dict[str, Column]) -> DataFrame:
    return rows.agg(*(F.count_if(c).alias(k) for k, c in definitions.items()))


def codebook(rows: DataFrame, code: str, rules: dict) -> DataFrame:
    """For each code, how many of its rows obey its rule and how many others do too."""
    hit = reduce(lambda w, kv: w.when(F.col(code) == kv[0], kv[1]), rules.items(), F.when(F.lit(False), F.lit(False)))
    own = rows.where(F.col(code).isin(*rules)).groupBy(F.col(code).alias("code")).agg(F.count("*").alias("rows"), F.count_if(hit).alias("obeying"))
    all_ = rows.agg(*(F.count_if(c).alias(f"r{i}") for i, c in enumerate(rules.values()))).select(F.inline(F.array(*(F.struct(F.lit(k).alias("code"), F.col(f"r{i}").alias("matching_anywhere")) for i, k in enumerate(rules)))))
    return own.join(F.broadcast(all_), "code")  # one row a code
