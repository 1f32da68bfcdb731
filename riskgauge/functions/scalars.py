"""Scalar column expressions. All are built-in functions, so they stay within generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
EULER = 0.57721566490153286
_SMALL = 64


def ratio(n: Column, d: Column) -> Column:
    """n / d, null where d is zero."""
    return F.try_divide(n.cast("double"), d.cast("double"))


def ratio_reason(d: Column) -> Column:
    """Why ``ratio`` is null."""
    return F.when(d == 0, "zero_denominator")


def observation_group(label: Column, attempted: Column, invalid: Column) -> Column:
    """none, attempted or invalid_class; a label that is both is an error."""
    both = F.when(attempted & invalid, F.raise_error(F.concat(F.lit("two observation groups: "), label)))
    return F.coalesce(both.cast("string"), F.when(attempted, "attempted").when(invalid, "invalid_class").otherwise("none"))


def flow_observation_group(label: Column) -> Column:
    """Of flow labels: a suffix marks attempts, one exact label an invalid class."""
    return observation_group(label, label.endswith("- Attempted"), label == "DoS Hulk")


def is_target(label: Column) -> Column:
    return ~(label.endswith("- Attempted") | (label == "DoS Hulk"))


def binary_label(label: Column, benign: str, target: Column) -> Column:
    """0 for the benign label and 1 for others on target rows, else null."""
    return F.when(target, (label != benign).cast("int"))


def code_map(code: Column, names: dict[int, str]) -> Column:
    """Name of a code; an unknown or missing code is an error. A name stays."""
    out = F.when(code.cast("string").isin(*names.values()), code.cast("string"))
    for k, v in names.items():
        out = out.when(code.cast("string") == str(k), v)
    return out.otherwise(F.raise_error(F.concat(F.lit("unexpected code: "), F.coalesce(code.cast("string"), F.lit("null")))))


# Transport protocol numbers.
PROTOCOLS = {6: "TCP", 17: "UDP", 1: "ICMP", 0: "UNKNOWN"}


def is_infinite(c: Column) -> Column:
    return F.coalesce(c.isin(INF, -INF), F.lit(False))


def scaled_round(c: Column, digits: int) -> Column:
    """c * 10^digits rounded half away from zero, and scaled back: DuckDB's round. Spark's rounds the shortest decimal text, which parts from it at ties."""
    y = c * 10.0**digits
    size = F.abs(y)
    down = F.floor(size).cast("double")
    whole = F.when(size < 2.0**52, F.signum(y) * (down + F.when(size - down >= 0.5, 1.0).otherwise(0.0))).otherwise(y)
    out = whole / 10.0**digits
    return F.when(is_infinite(out) | F.isnan(out), c).otherwise(out)


def infinite_to_nan(c: Column) -> Column:
    return F.when(is_infinite(c), F.lit(float("nan"))).otherwise(c)


def finite(c: Column) -> Column:
    """The value where it is a number, else null."""
    return F.when(~is_infinite(c) & ~F.isnan(c), c)


def contains_ci(c: Column, word: str) -> Column:
    return F.coalesce(F.lower(c).contains(word.lower()), F.lit(False))


def name_patterns(label: Column) -> dict[str, Column]:
    return {
        "attempt_suffix": label.rlike(r"-\s*Attempted\s*$"),
        "double_space": label.contains("  "),
        "dash_parts": F.size(F.split(label, " - ")).cast("long"),
    }


def size_bin(n: Column) -> Column:
    return F.when(n <= 4, n.cast("string")).when(n <= 10, "5-10").when(n <= 100, "11-100").otherwise(">100")


SIZE_BINS = ("2", "3", "4", "5-10", "11-100", ">100")


def group_id(n: Column) -> Column:
    return F.format_string("fg_%010d", n)


def bucket_hash(parts: list[Column], ts: Column, seconds: int) -> Column:
    """md5 of the parts and the time bucket, joined by a pipe."""
    bucket = F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds).cast("string")
    return F.md5(F.concat_ws("|", *(p.cast("string") for p in parts), bucket))


def label_seed(base: int, label: str) -> int:
    """A seed for each label that doesn't depend on the process."""
    import hashlib

    return (base + int.from_bytes(hashlib.sha256(label.encode()).digest()[:4], "little")) % 2**32


def shuffled(seed: int, *key: Column) -> Column:
    """A total order that looks random: md5 of seed and key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in key)))


def row_hash(*cols: Column) -> Column:
    """Candidate id of equal rows; null, NaN and both zeros as grouping sees them. Verify by the columns themselves."""
    return F.xxhash64(*cols)


def same_row(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, (p.eqNullSafe(q) for p, q in zip(a, b, strict=True)))


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n; 0 for n = 0. A table up to 64, then the asymptotic series (error under 1e-16)."""
    table = [0.0]
    for i in range(1, _SMALL + 1):
        table.append(table[-1] + 1 / i)
    x = F.greatest(n, F.lit(1)).cast("double")
    far = F.log(x) + EULER + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x)
    return F.when(n <= _SMALL, F.element_at(F.array(*map(F.lit, table)), F.least(n, F.lit(_SMALL)).cast("int") + 1)).otherwise(far)


def extract_group_hash(name: Column) -> Column:
    """The 16 hex digits of an id like g_0123456789abcdef_0, as an unsigned decimal in text."""
    return F.conv(F.regexp_extract(name, r"g_([0-9a-f]{16})_", 1), 16, 10)
