"""Deterministic train and test splits: by row, by whole groups, by time; their checks.

Shuffles are md5 orders, so membership depends on nothing but the seed and the rows. Whole groups are chosen by a
distributed prefix sum up to the target, and only the few groups that could still fill the rest are folded.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bucket_hash, ratio, shuffled


def stratified_rows(rows: DataFrame, by: str, key: list[str], fraction: float, seed: int = 42) -> DataFrame:
    """``rows`` with is_test: of each stratum the first round(n * fraction) rows (half to even) in md5 order.

    Ranks are made in buckets of the md5's first two digits, so a stratum of any size is ordered in parallel.
    """
    r = rows.withColumn("order", shuffled(seed, *map(F.col, key))).withColumn("bucket", F.substring("order", 1, 2))
    sizes = r.groupBy(by, "bucket").agg(F.count("*").alias("size"))
    before = Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(by).alias("by"), F.col("bucket").alias("bu"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"), F.sum("size").over(Window.partitionBy(by)).alias("total"))  # 256 rows a stratum
    inside = F.row_number().over(Window.partitionBy(by, "bucket").orderBy("order", *key))
    out = r.withColumn("inside", inside).join(offsets, F.col(by).eqNullSafe(F.col("by")) & (F.col("bucket") == F.col("bu")))
    return out.withColumn("is_test", F.col("inside") + F.col("offset") <= F.bround(F.col("total") * fraction, 0)).drop("order", "bucket", "inside", "offset", "total", "by", "bu")


def first_fit(groups: DataFrame, targets: DataFrame, label: str, key: list[str], seed: int = 42) -> DataFrame:
    """Keys of whole groups chosen for each label's target of rows. groups: (label, key, size); targets: (label, target).

    In md5 order, groups of two rows or more are taken while they fit, skipping those that don't; single rows fill
    the rest; if rows are still missing, the smallest unchosen group is added where that comes strictly closer.
    """
    g = groups.withColumn("order", shuffled(seed, *map(F.col, key))).withColumn("bucket", F.substring("order", 1, 2)).withColumn("single", F.col("size") == 1)
    part = [label, "single", "bucket"]
    inside = Window.partitionBy(*part).orderBy("order", *key).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(label, "single").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = g.groupBy(*part).agg(F.sum("size").alias("s")).select(*part, F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"))  # 512 rows a label
    ordered = g.withColumn("cum", F.sum("size").over(inside)).join(F.broadcast(offsets), part).withColumn("cum", F.col("cum") + F.col("offset"))
    ordered = ordered.join(F.broadcast(targets), label).persist()  # one target a label; each step below reads this
    multi, singles = ordered.where("not single"), ordered.where("single")
    bulk = multi.where("cum <= target")
    sums = ordered.groupBy(label).agg(F.max(F.when(~F.col("single") & (F.col("cum") <= F.col("target")), F.col("cum"))).alias("taken"), F.max(F.when(F.col("single"), F.col("cum"))).alias("singles"))
    rest = targets.join(sums, label, "left").select(label, (F.col("target") - F.coalesce("taken", F.lit(0))).alias("left"), F.coalesce("singles", F.lit(0)).alias("singles"))
    # of each size s at most left // s groups can follow, the first ones in order: a set bounded by the largest group
    tail = multi.where("cum > target").join(F.broadcast(rest), label).where("size <= left")
    tail = tail.withColumn("nth", F.row_number().over(Window.partitionBy(label, "size").orderBy("order", *key))).where(F.col("nth") <= F.floor(F.col("left") / F.col("size")))
    packed = tail.groupBy(label, "left").agg(F.array_sort(F.collect_list(F.struct("order", F.struct(*key).alias("key"), F.col("size").cast("long").alias("size")))).alias("all"))
    start = F.struct(F.expr("slice(all, 1, 0)").alias("got"), F.col("left").cast("long").alias("left"))
    fold = F.aggregate("all", start, lambda a, x: F.when(x["size"] <= a["left"], F.struct(F.concat(a["got"], F.array(x)).alias("got"), (a["left"] - x["size"]).alias("left"))).otherwise(a))
    more = packed.select(label, fold.alias("f")).persist()
    chosen = bulk.select(label, *key).unionByName(more.select(label, F.explode("f.got").alias("x")).select(label, "x.key.*"))
    rest = rest.join(more.select(label, F.col("f.left").alias("after")), label, "left").select(label, F.coalesce("after", "left").alias("left"), "singles").persist()
    filled = singles.join(F.broadcast(rest.select(label, "left")), label).where("cum <= left").select(label, *key)
    short = rest.select(label, (F.col("left") - F.least("left", "singles")).alias("left")).where("left > 0")
    chosen_all = chosen.unionByName(filled)
    if short.isEmpty():
        return chosen_all
    free = multi.join(F.broadcast(short), label).where(F.col("size") - F.col("left") < F.col("left")).join(chosen, [label, *key], "left_anti")
    over = free.withColumn("nth", F.row_number().over(Window.partitionBy(label).orderBy("size", "order", *key))).where("nth = 1").select(label, *key)
    return chosen_all.unionByName(over)


def choose_conflict_groups(matrix: dict[str, list[int]], targets: list[int], seed: int = 42) -> set[str]:
    """Which of a few multi-label groups go to test, on the driver. matrix: group to its rows by label.

    Up to 20 groups: the best of all subsets; up to 5,000: greedy in md5 order with one pass of single changes.
    """
    names = sorted(matrix, key=lambda k: hashlib.md5(f"{seed}|{k}".encode()).hexdigest())
    if len(names) > 5000:
        raise ValueError("too many groups for the driver: use proportional_conflict_groups")
    total = sum(targets)

    def cost(sums: list[int]) -> float:
        return sum(((s - t) / max(t, 1)) ** 2 for s, t in zip(sums, targets, strict=True)) / max(1, len(targets)) + ((sum(sums) - total) / max(total, 1)) ** 2

    add = lambda s, k, sign=1: [a + sign * b for a, b in zip(s, matrix[k], strict=True)]
    zero = [0] * len(targets)
    if len(names) <= 20:
        best, pick = cost(zero), 0
        for bits in range(1, 1 << len(names)):
            s = zero
            for i, k in enumerate(names):
                if bits >> i & 1:
                    s = add(s, k)
            if (c := cost(s)) < best:
                best, pick = c, bits
        return {k for i, k in enumerate(names) if pick >> i & 1}
    chosen, sums, best = set(), zero, cost(zero)
    for k in [*names, *names]:
        trial = add(sums, k, -1 if k in chosen else 1)
        if (c := cost(trial)) < best:
            chosen ^= {k}
            sums, best = trial, c
    return chosen


def proportional_conflict_groups(multi: DataFrame, key: list[str], signature: str, fraction: float, seed: int = 42) -> DataFrame:
    """Multi-label groups for test, any number of them: of equal label counts, the same share (half to even) in md5 order."""
    return stratified_rows(multi, signature, key, fraction, seed).where("is_test").select(*key)


def group_split(rows: DataFrame, key: list[str], label: str = "label", fraction: float = 0.25, seed: int = 42) -> DataFrame:
    """Keys of whole groups for test: no group is split, and each label's rows come close to ``fraction``."""
    g = rows.groupBy(*key, label).agg(F.count("*").alias("n")).persist()  # read six times below; far smaller than the rows
    per = g.groupBy(*key).agg(F.count("*").alias("n_labels"), F.sum("n").alias("size"), F.min(label).alias(label), F.array_join(F.array_sort(F.collect_list(F.concat(label, F.lit("="), F.col("n").cast("string")))), ",").alias("signature")).persist()
    multi = per.where("n_labels > 1")
    conflict = proportional_conflict_groups(multi.select(*key, "signature"), key, "signature", fraction, seed).persist()
    used = g.join(conflict, key, "left_semi").groupBy(label).agg(F.sum("n").alias("used"))
    targets = g.groupBy(label).agg(F.bround(F.sum("n") * F.lit(fraction), 0).cast("long").alias("goal")).join(used, label, "left")
    targets = targets.select(label, F.greatest(F.col("goal") - F.coalesce("used", F.lit(0)), F.lit(0)).alias("target")).persist()
    return conflict.unionByName(first_fit(per.where("n_labels = 1").select(label, *key, "size"), targets, label, key, seed).select(*key))


def marked(rows: DataFrame, test_keys: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with is_test by membership of their key."""
    return rows.join(test_keys.withColumn("is_test", F.lit(True)), key, "left").withColumn("is_test", F.coalesce("is_test", F.lit(False)))


def per_label(rows: DataFrame, label: str = "label", fraction: float = 0.25) -> DataFrame:
    s = rows.groupBy(label).agg(F.count_if(~F.col("is_test")).alias("train_rows"), F.count_if("is_test").alias("test_rows"))
    r = ratio(F.col("test_rows"), F.col("train_rows") + F.col("test_rows"))
    return s.withColumn("test_ratio", r).withColumn("deviation", F.abs(r - fraction))


def crossings(rows: DataFrame, key: list[str]) -> DataFrame:
    """Groups with rows on both sides, and totals."""
    g = rows.groupBy(*key).agg(F.count_if("is_test").alias("t"), F.count("*").alias("n"))
    return g.agg(F.count("*").alias("groups"), F.count_if((F.col("t") > 0) & (F.col("t") < F.col("n"))).alias("crossing_groups"), F.sum("t").alias("test_rows"), (F.sum("n") - F.sum("t")).alias("train_rows"))


def verify(rows: DataFrame, plan: DataFrame, key: list[str], position: list[str]) -> DataFrame:
    """A saved assignment (position, is_test) against the plan: duplicates, missing rows, differences."""
    s = rows.select(*position, F.col("is_test").alias("saved"))
    j = s.join(plan.select(*position, F.col("is_test").alias("planned")), position, "full")
    twice = s.groupBy(*position).agg(F.count("*").alias("n"))
    return j.agg(F.count_if(F.col("saved").isNull()).alias("missing"), F.count_if(F.col("planned").isNull()).alias("unplanned"), F.count_if(F.col("saved") != F.col("planned")).alias("different"), F.count("*").alias("rows")).crossJoin(
        F.broadcast(twice.agg(F.count_if(F.col("n") > 1).alias("duplicate_keys"))))  # one row each


def time_groups(rows: DataFrame, parts: list[Column], label: Column, day: Column, ts: str, seconds: int) -> DataFrame:
    """Groups of rows with equal parts in a stretch of time: (group_id, day, attack_label, rep_time, n_flows_in_group)."""
    t = F.col(ts).cast("timestamp")
    return rows.select(bucket_hash(parts, t, seconds).alias("group_id"), day.alias("day"), label.alias("attack_label"), t.alias("t")).groupBy("group_id").agg(
        F.min_by("day", "t").alias("day"), F.min_by("attack_label", "t").alias("attack_label"), F.min("t").alias("rep_time"), F.count("*").alias("n_flows_in_group"))


def time_cut(groups: DataFrame, by: list[str], order: list[str], ratios=(0.6, 0.2), least: int = 10) -> DataFrame:
    """Groups in time order: the first part train, the next calib, the rest test; strata with few groups are all test."""
    w = Window.partitionBy(*by)
    g = groups.withColumn("nth", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n", F.count("*").over(w))
    a = F.floor(F.col("n") * ratios[0])
    b = a + F.floor(F.col("n") * ratios[1])
    split = F.when(F.col("n") < least, "test").when(F.col("nth") < a, "train").when(F.col("nth") < b, "calib").otherwise("test")
    return groups_with(g, split, least)


def groups_with(g: DataFrame, split: Column, least: int) -> DataFrame:
    return g.withColumn("split", split).withColumn("original_split", split).withColumn("below_min", F.col("n") < least).drop("nth", "n")


def leave_out(groups: DataFrame, labels: list[str], label: str = "attack_label") -> DataFrame:
    """Target labels leave train and calib for test, from the original split each time: repeated calls don't add up."""
    return groups.withColumn("split", F.when(F.col(label).isin(*labels) & F.col("original_split").isin("train", "calib"), "test").otherwise(F.col("original_split")))


def split_report(groups: DataFrame, by: list[str]) -> DataFrame:
    return groups.groupBy(*by, "split").agg(F.count("*").alias("n_groups"), F.sum("n_flows_in_group").alias("n_flows"), F.bool_or("below_min").alias("below_min"))


def skew(groups: DataFrame, by: list[str]) -> DataFrame:
    """Strata whose groups all stand in one split (a warning)."""
    s = groups.groupBy(*by).agg(F.count("*").alias("n"), *(F.count_if(F.col("split") == k).alias(k) for k in ("train", "calib", "test")))
    return s.withColumn("one_sided", F.greatest("train", "calib", "test") == F.col("n"))
