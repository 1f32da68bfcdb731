"""Exact groups over composite keys: duplicates, label conflicts, leakage and overlap.

Keys are grouped as they are (null and NaN are values), so no hash needs verification; hashes are offered for
pre-filters. Group facts are one aggregate, and scope facts an aggregate of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import SIZE_BINS, group_id, ratio, size_bin


def group_labels(rows: DataFrame, key: list[str], label: str = "label") -> DataFrame:
    return rows.groupBy(*key, label).agg(F.count("*").alias("rows"))


def group_facts(rows: DataFrame, key: list[str], benign: Column, label: str = "label", day: str = "day") -> DataFrame:
    """One row for each distinct key."""
    return rows.groupBy(*key).agg(
        F.count("*").alias("group_size"), F.count_distinct(label).alias("n_labels"), F.count_if(benign).alias("benign_rows"), F.count_if(~benign).alias("attack_rows"),
        F.array_sort(F.collect_set(F.col(day))).alias("days")).withColumn(
        "n_binary_labels", (F.col("benign_rows") > 0).cast("long") + (F.col("attack_rows") > 0).cast("long"))


def duplicate_scope(facts: DataFrame) -> DataFrame:
    """Totals over groups of two rows or more."""
    d = facts.where("group_size >= 2")
    conflict, within = F.col("n_binary_labels") > 1, F.size("days") == 1
    rows = lambda c: F.coalesce(F.sum(F.when(c, F.col("group_size"))), F.lit(0)).alias
    return d.agg(
        F.count("*").alias("duplicate_groups"), rows(F.lit(True))("duplicate_rows"), F.count_if(~conflict).alias("match_groups"), rows(~conflict)("match_rows"),
        F.count_if(conflict).alias("conflict_groups"), rows(conflict)("conflict_rows"), F.count_if(within).alias("within_day_groups"), F.count_if(~within).alias("cross_day_groups"),
        F.count_if(F.col("n_labels") > 1).alias("multi_label_groups"), F.coalesce(F.max("group_size"), F.lit(0)).alias("largest_group"))


def size_histogram(facts: DataFrame) -> DataFrame:
    """Groups and rows in six bins, empty ones too."""
    spark = facts.sparkSession
    bins = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({i}, '{b}')" for i, b in enumerate(SIZE_BINS)) + " AS t(bin_no, size_bin)")
    s = facts.where("group_size >= 2").groupBy(size_bin(F.col("group_size")).alias("size_bin")).agg(F.count("*").alias("n_groups"), F.sum("group_size").alias("n_rows"))
    return bins.join(F.broadcast(s), "size_bin", "left").select("size_bin", F.coalesce("n_groups", F.lit(0)).alias("n_groups"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))  # six rows


def conflicting(rows: DataFrame, key: list[str], facts: DataFrame) -> DataFrame:
    """Rows of groups with both binary labels."""
    return rows.join(facts.where("n_binary_labels > 1").select(*key, "group_size"), key)


def conflict_labels(rows: DataFrame, key: list[str], facts: DataFrame, label: str = "label") -> DataFrame:
    return conflicting(rows, key, facts).groupBy(label).agg(F.count("*").alias("rows"))


def conflict_day_combinations(facts: DataFrame) -> DataFrame:
    combo = F.array_join(F.transform("days", lambda d: d.cast("string")), "+")
    return facts.where("n_binary_labels > 1").groupBy(combo.alias("days")).agg(F.count("*").alias("n_groups"), F.sum("group_size").alias("n_rows"))


def numbered(rows: DataFrame, key: list[str], position: list[str]) -> DataFrame:
    """Groups in the order of their first rows: (key, first, number). Numbers need a whole order, made in two levels."""
    g = rows.groupBy(*key).agg(F.min(F.struct(*position)).alias("first"))
    bucket = g.withColumn("bucket", F.col("first")[position[0]])
    sizes = bucket.groupBy("bucket").agg(F.count("*").alias("size"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row for each value of the first position column
    offsets = sizes.select("bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy("first", *key))
    return bucket.withColumn("inside", inside).join(offsets, "bucket").select(*key, "first", (F.col("inside") + F.col("offset") - 1).alias("number"))


def stable_ids(rows: DataFrame, key: list[str], position: list[str]) -> DataFrame:
    return numbered(rows, key, position).select(*key, group_id(F.col("number")).alias("group_id"))


def top_conflicts(facts: DataFrame, key: list[str], n: int = 20) -> DataFrame:
    """The largest conflict groups (a report of n)."""
    return facts.where("n_binary_labels > 1").select(*key, "group_size", "n_labels", "benign_rows", "attack_rows").orderBy(F.desc("group_size"), *(F.desc(k) for k in key)).limit(n)


def conflict_sample(rows: DataFrame, key: list[str], facts: DataFrame, label: str = "label", order: tuple[str, ...] = ("day", "id"), per_group: int = 20) -> DataFrame:
    """Up to ``per_group`` rows of each conflict group: one of each label first, then others in order."""
    c = conflicting(rows, key, facts)
    c = c.withColumn("nth", F.row_number().over(Window.partitionBy(*key, label).orderBy(*order)))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy((F.col("nth") == 1).desc(), label, *order))
    return c.withColumn("rank", rank).where(F.col("rank") <= per_group).select(*key, label, *order, "group_size", F.col("rank").cast("long").alias("rank"))


def label_statistics(rows: DataFrame, key: list[str], facts: DataFrame, label: str = "label", fraction: float = 0.25) -> DataFrame:
    """Per label: rows, groups, duplicates, conflicts, and whether its largest group fits a split of ``fraction``."""
    g = group_labels(rows, key, label).join(facts.select(*key, "group_size", "n_binary_labels"), key)
    s = g.groupBy(label).agg(
        F.sum("rows").alias("rows"), F.count("*").alias("groups"), F.count_if(F.col("group_size") >= 2).alias("duplicate_groups"),
        F.count_if(F.col("n_binary_labels") > 1).alias("conflict_groups"), F.max("rows").alias("largest_group_rows"))
    return s.withColumn("largest_ratio", ratio(F.col("largest_group_rows"), F.col("rows"))).withColumn("feasible", F.col("largest_group_rows") <= F.col("rows") * fraction)


def repeated_values(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur twice or more."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n >= 2")


def candidate_rows(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key occurs twice or more."""
    return rows.join(repeated_values(rows, key).select(*key), key, "left_semi")


def collisions(rows: DataFrame, hashed: Column, key: list[str]) -> DataFrame:
    """Distinct keys beyond the first under each hash value."""
    s = rows.select(hashed.alias("h"), *key).distinct().groupBy("h").agg(F.count("*").alias("n"))
    return s.agg(F.count("*").alias("n_hashes"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("collisions"))


def overlap_of_sets(members: DataFrame, name: str, item: list[str]) -> DataFrame:
    """Sizes, common items and Jaccard of every two named sets, from (name, item): items are reduced to name sets first."""
    sets = members.select(name, *item).distinct().groupBy(*item).agg(F.array_sort(F.collect_set(name)).alias("names"))
    kinds = sets.groupBy("names").agg(F.count("*").alias("n"))  # at most 2 to the number of names
    each = kinds.select("n", F.explode("names").alias("x")).groupBy("x").agg(F.sum("n").alias("size"))
    pairs = kinds.select("n", F.explode("names").alias("a"), "names").select("n", "a", F.explode("names").alias("b")).where("a < b")
    both = pairs.groupBy("a", "b").agg(F.sum("n").alias("common"))
    names = each.select(F.col("x").alias("a"), F.col("size").alias("n_a")).join(each.select(F.col("x").alias("b"), F.col("size").alias("n_b")), F.col("a") < F.col("b"))
    out = names.join(both, ["a", "b"], "left").withColumn("common", F.coalesce("common", F.lit(0)))
    return out.withColumn("jaccard", ratio(F.col("common"), F.col("n_a") + F.col("n_b") - F.col("common")))


def leakage(rows: DataFrame, key: list[str], is_test: Column, benign: Column, label: str = "label") -> DataFrame:
    """How much of a row-level split's test rows stand in training groups: same label, opposite binary label."""
    t = rows.withColumn("t", is_test).withColumn("b", benign)
    g = t.groupBy(*key, label, "b").agg(F.count_if("t").alias("test"), F.count_if(~F.col("t")).alias("train"))
    w = Window.partitionBy(*key)
    g = g.withColumn("train_all", F.sum("train").over(w)).withColumn("test_all", F.sum("test").over(w)).withColumn("train_benign", F.sum(F.when(F.col("b"), F.col("train")).otherwise(0)).over(w))
    opposite = F.when(F.col("b"), F.col("train_all") - F.col("train_benign")).otherwise(F.col("train_benign")) > 0
    crossing = (F.col("train_all") > 0) & (F.col("test_all") > 0)
    per = g.groupBy(*key).agg(F.max(crossing.cast("int")).alias("crossing"), F.sum(F.col("test") + F.col("train")).alias("rows"), F.sum("test").alias("test"),
        F.sum(F.when(F.col("train_all") > 0, F.col("test")).otherwise(0)).alias("seen"), F.sum(F.when(F.col("train") > 0, F.col("test")).otherwise(0)).alias("same"), F.sum(F.when(opposite, F.col("test")).otherwise(0)).alias("opposite"))
    s = per.agg(F.sum("crossing").cast("long").alias("crossing_groups"), F.coalesce(F.sum(F.when(F.col("crossing") == 1, F.col("rows"))), F.lit(0)).alias("crossing_rows"), F.sum("test").alias("test_rows"), F.sum("seen").alias("seen_rows"), F.sum("same").alias("same_label_rows"), F.sum("opposite").alias("opposite_label_rows"))
    return s.withColumn("seen_ratio", ratio(F.col("seen_rows"), F.col("test_rows")))


def conflict_table(rows: DataFrame, key: list[str], facts: DataFrame, splits: DataFrame, methods: list[str], label: str = "label") -> DataFrame:
    """Conflict groups with their label counts as JSON and the split that each method gives them. splits: (method, key, is_test)."""
    g = group_labels(rows, key, label).join(facts.where("n_binary_labels > 1").select(*key, "group_size", "benign_rows", "attack_rows"), key)
    wide = g.groupBy(*key, "group_size", "benign_rows", "attack_rows").agg(F.array_join(F.array_sort(F.collect_list(F.concat(label, F.lit("="), F.col("rows").cast("string")))), ",").alias("label_counts"))
    s = splits.groupBy(*key).pivot("method", methods).agg(F.when(F.bool_and("is_test"), "test").when(~F.bool_or("is_test"), "train").otherwise("crossing"))
    return wide.join(s.withColumnsRenamed({m: f"split_{m}" for m in methods}), key, "left")
