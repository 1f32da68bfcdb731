"""Data preparation: duplicates, infinities and clipping, constant and duplicate columns, reserved columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import INF, finite, infinite_to_nan, is_infinite


def exact_dedup(rows: DataFrame, ignore: list[str], order: list[str]) -> DataFrame:
    """The first row (by ``order``) of rows equal in all columns but ``ignore``."""
    key = [c for c in rows.columns if c not in ignore]
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__nth", first).where("__nth = 1").drop("__nth")


def relaxed_dedup(rows: DataFrame, key: list[str], label: str, order: list[str]) -> DataFrame:
    """Rows equal in ``key``: one label, the first stays; more labels, all stay and are flagged. Null keys are never touched.

    Group facts are aggregated and joined, so a large group is never held by one task.
    """
    has_key = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in key))
    facts = rows.where(has_key).groupBy(*key).agg(F.count("*").alias("__n"), F.count_distinct(F.coalesce(F.col(label).cast("string"), F.lit("\0"))).alias("__labels"), F.min(F.struct(*order)).alias("__first"))
    j = rows.join(facts, key, "left")
    conflict = F.coalesce((F.col("__n") > 1) & (F.col("__labels") > 1), F.lit(False))
    drop = F.coalesce((F.col("__n") > 1) & (F.col("__labels") == 1) & (F.struct(*order) != F.col("__first")), F.lit(False))
    return j.where(~drop).withColumn("label_conflict", conflict).drop("__n", "__labels", "__first").select(*rows.columns, "label_conflict")


def numeric_columns(rows: DataFrame, but: list[str] = []) -> list[str]:  # noqa: B006
    return [f.name for f in rows.schema if isinstance(f.dataType, T.NumericType) and f.name not in but]


def prunable_columns(rows: DataFrame, keep: list[str]) -> list[str]:
    return [c for c in rows.columns if c not in keep]


def infinities_to_nan(rows: DataFrame, cols: list[str]) -> DataFrame:
    return rows.withColumns({c: infinite_to_nan(F.col(c)) for c in cols})


def count_infinities(rows: DataFrame, cols: list[str]) -> DataFrame:
    return rows.agg(*(F.count_if(is_infinite(F.col(c))).alias(c) for c in cols))


def negative_infinity_flags(rows: DataFrame, cols: list[str], duration: str) -> DataFrame:
    """Rows with -Infinity anywhere, parted by the sign of their duration."""
    has = F.exists(F.array(*(F.col(c).cast("double") for c in cols)), lambda x: x == -INF)
    has = F.coalesce(has, F.lit(False))
    return rows.withColumn("invalid_negative_duration", has & (F.col(duration) < 0)).withColumn("zero_duration", has & (F.col(duration) == 0))


def _value_bucket(v: Column) -> Column:
    """Rises with a finite double: 64 buckets for each power of two, on both sides of zero."""
    return F.when(v == 0, 0).otherwise(F.signum(v) * (F.floor(F.log2(F.abs(v)) * 64) + 70_000)).cast("long")


def _ranked(counts: DataFrame, shares: list[float]) -> DataFrame:
    """Rows of ``counts`` (column, value, n) in the buckets that hold the ``shares`` quantiles, with ``before`` (smaller values' rows) and ``all_n``.

    Only bucket totals are summed in order over all values; a task sorts the distinct values of one bucket at most.
    """
    b = counts.withColumn("bucket", _value_bucket(F.col("value")))
    whole = Window.partitionBy("k_column")
    earlier = whole.orderBy("k_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = b.groupBy(F.col("column").alias("k_column"), F.col("bucket").alias("k_bucket")).agg(F.sum("n").alias("s"))
    sums = sums.withColumns({"off": F.coalesce(F.sum("s").over(earlier), F.lit(0)), "all_n": F.sum("s").over(whole)})
    at = [(F.col("all_n") - 1) * F.lit(q) for q in shares]
    held = reduce(lambda x, y: x | y, ((F.floor(p) < F.col("off") + F.col("s")) & (F.ceil(p) >= F.col("off")) for p in at))
    inside = Window.partitionBy("column", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    j = b.join(F.broadcast(sums.where(held)), F.col("column").eqNullSafe(F.col("k_column")) & F.col("bucket").eqNullSafe(F.col("k_bucket")))  # a few rows a column; a plain equality would push a filter below the counts, which then run twice
    return j.select("column", "value", "n", "all_n", (F.sum("n").over(inside) - F.col("n") + F.col("off")).alias("before"))


def _between(low: Column, high: Column, part: Column) -> Column:
    """low * (1 - part) + high * part, the first product not rounded before the sum: DuckDB's quantile_cont to the last bit."""
    fused = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), *(F.coalesce(c, F.lit(0.0)) for c in (low, 1.0 - part, high * part))).cast("double")
    return F.when(part > 0, fused).otherwise(low)


def clip_bounds(rows: DataFrame, cols: list[str], train: Column, upper=(0.999, 3.0), lower=(0.001, 3.0)) -> DataFrame:
    """One row a column: bounds from finite training values, where all rows have such an infinity. Values are counted first, ranks are exact."""
    has = rows.agg(*(F.max((F.col(c) == x).cast("int")).alias(f"has_{k}{i}") for i, c in enumerate(cols) for k, x in (("u", INF), ("l", -INF))))
    each = F.array(*(F.struct(F.lit(c).alias("column"), finite(F.col(c).cast("double")).alias("value")) for c in cols))
    counts = rows.where(train).select(F.inline(each)).where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    shares = {"u": upper[0], "l": lower[0]}
    found = _ranked(counts, list(shares.values()))
    of = lambda x, c, *more: F.max(F.when(reduce(lambda a, b: a & b, more, F.col("column") == c), x))
    hit = lambda rank: (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))
    aggs = []
    for i, c in enumerate(cols):
        for k, q in shares.items():
            p = (F.col("all_n") - 1) * F.lit(q)
            aggs += [of(p - F.floor(p), c).alias(f"part_{k}{i}"), of(F.col("value"), c, hit(F.floor(p))).alias(f"lo_{k}{i}"), of(F.col("value"), c, hit(F.ceil(p))).alias(f"hi_{k}{i}")]
    one = has.crossJoin(F.broadcast(found.agg(*aggs)))  # one row each
    one = one.select(*(F.when(F.col(f"has_{k}{i}") == 1, _between(F.col(f"lo_{k}{i}"), F.col(f"hi_{k}{i}"), F.col(f"part_{k}{i}")) * times).alias(f"{k}{i}") for i in range(len(cols)) for k, times in (("u", upper[1]), ("l", lower[1]))))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"u{i}").alias("upper"), F.col(f"l{i}").alias("lower")) for i, c in enumerate(cols)))))


def apply_clip(rows: DataFrame, bounds: DataFrame, cols: list[str], invalid: str | None = None) -> DataFrame:
    """+Infinity to the upper bound, -Infinity to the lower one unless the row is flagged."""
    wide = bounds.groupBy().agg(*(F.max(F.when(F.col("column") == c, F.col(b))).alias(f"__{b}_{c}") for c in cols for b in ("upper", "lower")))
    j = rows.crossJoin(F.broadcast(wide))  # one row
    flag = F.col(invalid) if invalid else F.lit(False)
    out = j.withColumns({c: F.when((F.col(c) == INF) & F.col(f"__upper_{c}").isNotNull(), F.col(f"__upper_{c}")).when((F.col(c) == -INF) & ~flag & F.col(f"__lower_{c}").isNotNull(), F.col(f"__lower_{c}")).otherwise(F.col(c)) for c in cols})
    return out.select(*rows.columns)


def constant_columns(rows: DataFrame, cols: list[str]) -> DataFrame:
    """(column, n_values, constant); a null is a value. All columns in one aggregate."""
    text = lambda c: F.col(f"`{c}`").cast("string")
    one = rows.agg(*(F.struct(F.min(text(c)).alias("lo"), F.max(text(c)).alias("hi"), F.max(text(c).isNull().cast("int")).alias("nulls")).alias(c) for c in cols))
    n = lambda c: (F.when(F.col(f"`{c}`.lo").isNull(), 0).when(F.col(f"`{c}`.lo") == F.col(f"`{c}`.hi"), 1).otherwise(2) + F.coalesce(F.col(f"`{c}`.nulls"), F.lit(0)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), (n(c) <= 1).alias("constant")) for c in cols))))


def duplicate_columns(rows: DataFrame, cols: list[str], key: list[str]) -> DataFrame:
    """(column, same_as): columns that equal an earlier one in every row. Signatures first, then a check of the candidates."""
    typed = {f.name: f.dataType for f in rows.schema}
    sums = rows.agg(*(F.sum(F.xxhash64(*key, F.col(f"`{c}`")).cast("decimal(38,0)")).cast("string").alias(c) for c in cols)).first()
    pairs = [(b, a) for i, b in enumerate(cols) for a in cols[:i] if typed[a] == typed[b] and sums is not None and sums[a] == sums[b]]
    if not pairs:
        return rows.sparkSession.createDataFrame([], "column string, same_as string")
    equal = rows.agg(*(F.count_if(~F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`"))).alias(f"d{i}") for i, (b, a) in enumerate(pairs)))
    found = equal.select(F.inline(F.array(*(F.struct(F.lit(b).alias("column"), F.lit(a).alias("same_as"), F.col(f"d{i}").alias("d"), F.lit(cols.index(a)).alias("at")) for i, (b, a) in enumerate(pairs)))))
    return found.where("d = 0").groupBy("column").agg(F.min_by("same_as", "at").alias("same_as"))


def reserve(rows: DataFrame, key: str, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """The table without ``cols``, and a side table (key, cols) to join back."""
    return rows.drop(*cols), rows.select(key, *cols)
