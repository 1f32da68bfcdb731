"""Selective-prediction evaluation: risk and coverage, budgets, thresholds, metrics and verdicts.

Predictions are reduced to one row for each distinct confidence (a tie block) before anything is ordered, and
ordered sums run in two levels: within buckets of confidence in parallel, then over the few buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import harmonic, ratio, ratio_reason

COUNTS = ("n", "errors", "benign", "attack", "fp", "fn")


def predictions(scored: DataFrame, p: str = "p", threshold: float = 0.5, target: Column | None = None) -> DataFrame:
    """Adds predicted, confidence and is_error (null off target). A score outside 0 to 1 is an error."""
    c = F.col(p)
    bad = c.isNull() | F.isnan(c) | (c < 0) | (c > 1)
    checked = F.when(bad, F.raise_error("score outside 0 to 1").cast("double")).otherwise(c)
    on = F.lit(True) if target is None else target
    out = scored.withColumn(p, checked).withColumn("predicted", (F.col(p) >= threshold).cast("int"))
    return out.withColumn("confidence", F.greatest(F.col(p), 1 - F.col(p))).withColumn(
        "is_error", F.when(on, (F.col("predicted") != F.col("binary_label")).cast("int")))


def tie_blocks(pred: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """One row for each confidence (and ``by``): counts of rows, errors and classes."""
    fp = ((F.col("binary_label") == 0) & (F.col("predicted") == 1)).cast("long")
    fn = ((F.col("binary_label") == 1) & (F.col("predicted") == 0)).cast("long")
    attack = F.sum(F.col("binary_label").cast("long"))
    return pred.groupBy(*by, "confidence").agg(
        F.count("*").alias("n"), F.sum(F.col("is_error").cast("long")).alias("errors"), (F.count("binary_label") - attack).alias("benign"),
        attack.alias("attack"), F.sum(fp).alias("fp"), F.sum(fn).alias("fn"))


def confidence_bucket(c: Column) -> Column:
    """Rises with confidence; finer towards 1, where most confidences are."""
    near = 256 + F.floor(-16 * F.log2(1 - c + F.lit(2.0**-53)))
    return F.when(c < 0.996, F.floor(c * 256)).otherwise(near).cast("long")


def running(blocks: DataFrame, by: list[str] = [], ascending: bool = True, counts=COUNTS) -> DataFrame:  # noqa: B006
    """``blocks`` with running totals ``cum_*`` (own block included) and group totals ``all_*``."""
    b = blocks.withColumn("bucket", confidence_bucket(F.col("confidence")))
    order = (lambda c: F.col(c).asc()) if ascending else (lambda c: F.col(c).desc())
    whole = Window.partitionBy(*by)
    before = whole.orderBy(order("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    sums = b.groupBy(*by, "bucket").agg(*(F.sum(c).alias(f"s_{c}") for c in counts))
    sums = sums.select(*by, F.col("bucket").alias("b"), *(F.coalesce(F.sum(f"s_{c}").over(before), F.lit(0)).alias(f"off_{c}") for c in counts), *(F.sum(f"s_{c}").over(whole).alias(f"all_{c}") for c in counts))
    sums = sums.withColumnsRenamed({k: f"k_{k}" for k in by})
    on = F.col("bucket") == F.col("b")
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"k_{k}"))
    inside = Window.partitionBy(*by, "bucket").orderBy(order("confidence")).rowsBetween(Window.unboundedPreceding, 0)
    joined = b.withColumns({f"in_{c}": F.sum(c).over(inside) for c in counts}).join(F.broadcast(sums), on)  # about 1,100 rows a group at most
    return joined.select(*by, "confidence", *counts, *((F.col(f"in_{c}") + F.col(f"off_{c}")).cast("long").alias(f"cum_{c}") for c in counts), *(F.col(f"all_{c}").cast("long").alias(f"all_{c}") for c in counts))


def risk_curve(pred: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """One row for each distinct confidence, most confident first: what is accepted down to it, and its risk."""
    r = running(tie_blocks(pred, by), by, ascending=False)
    return r.select(
        *by, F.col("confidence").alias("threshold"), F.col("cum_n").alias("n_accepted"), ratio(F.col("cum_n"), F.col("all_n")).alias("coverage"),
        F.col("cum_errors").cast("double").alias("expected_errors_accepted"), ratio(F.col("cum_errors"), F.col("cum_n")).alias("selective_risk"))


def aurc(pred: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Tie-aware area under the risk-coverage curve, with its random and oracle bounds.

    Within a block of m rows and q errors after (k0, e0), the risks sum to q + (e0 - k0 q / m)(H(k0 + m) - H(k0)).
    """
    r = running(tie_blocks(pred, by), by, ascending=False, counts=("n", "errors"))
    m, q = F.col("n").cast("double"), F.col("errors").cast("double")
    k0, e0 = F.col("cum_n") - F.col("n"), (F.col("cum_errors") - F.col("errors")).cast("double")
    area = q + (e0 - k0 * q / m) * (harmonic(F.col("cum_n")) - harmonic(k0))
    s = r.groupBy(*by).agg(F.sum(area).alias("area"), F.max("all_n").alias("n"), F.max("all_errors").alias("errors"))
    n, e = F.col("n"), F.col("errors")
    risk = ratio(e, n)
    best = ratio(e - (n - e) * (harmonic(n) - harmonic(n - e)), n)
    value = ratio(F.col("area"), n)
    return s.where("n > 0").select(*by, n.alias("n"), e.alias("errors"), value.alias("aurc"), risk.alias("random_aurc"), best.alias("oracle_aurc"), F.when(e > 0, (risk - value) / risk).alias("relative_improvement"))


def budgets(spark, rates) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({r!r}D)" for r in rates) + " AS t(target_rate)")


def _accepted(extra: list) -> list:
    a = {c: F.col(f"abst_{c}") for c in COUNTS}
    t = {c: F.col(f"all_{c}") for c in COUNTS}
    k = {c: t[c] - a[c] for c in COUNTS}
    capture, actual = ratio(a["errors"], t["errors"]), ratio(a["n"], t["n"])
    shares = {
        "selective_risk": (k["errors"], k["n"]), "error_capture": (a["errors"], t["errors"]), "selective_fpr": (k["fp"], k["benign"]), "selective_fnr": (k["fn"], k["attack"]),
        "residual_fpr": (k["fp"], t["benign"]), "residual_fnr": (k["fn"], t["attack"]), "benign_coverage": (k["benign"], t["benign"]), "attack_coverage": (k["attack"], t["attack"]),
    }
    return [
        *extra, t["n"].alias("n"), a["n"].alias("n_abstained"), k["n"].alias("n_accepted"), actual.alias("actual_rate"), ratio(k["n"], t["n"]).alias("coverage"),
        a["errors"].alias("abstained_errors"), *(k[c].alias(f"accepted_{c}") for c in COUNTS[1:]), *(t[c].alias(f"total_{c}") for c in COUNTS[1:4]),
        F.when(actual > 0, capture / actual).alias("enrichment"), *(ratio(*s).alias(c) for c, s in shares.items()), *(ratio_reason(s[1]).alias(f"{c}_reason") for c, s in shares.items()),
    ]


def budget_metrics(pred: DataFrame, rates: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """For each target rate the largest set of whole tie blocks, least confident first, within the budget, and its metrics."""
    r = running(tie_blocks(pred, by), by).crossJoin(F.broadcast(rates))  # rates: a few constants
    fits = F.col("cum_n") <= F.col("target_rate") * F.col("all_n") + 1e-12
    s = r.groupBy(*by, "target_rate").agg(
        F.max(F.when(fits, F.col("confidence"))).alias("confidence_threshold"), F.min(F.when(~fits, F.col("cum_n"))).alias("next_n"),
        *(F.coalesce(F.max(F.when(fits, F.col(f"cum_{c}"))), F.lit(0)).alias(f"abst_{c}") for c in COUNTS), *(F.max(f"all_{c}").alias(f"all_{c}") for c in COUNTS))
    t = F.col("confidence_threshold")
    return s.select(*_accepted([
        *by, "target_rate", t.alias("confidence_threshold"), F.when(t.isNull(), "confidence_resolution_insufficient").alias("threshold_reason"),
        (F.col("target_rate") - ratio(F.col("abst_n"), F.col("all_n"))).alias("budget_shortfall"), (1 - t).alias("band_low"), t.alias("band_high"), ratio(F.col("next_n"), F.col("all_n")).alias("next_tie_rate")]))


def fixed_threshold_metrics(pred: DataFrame, thresholds: DataFrame, by: list[str] = [], low: float = 0.95, high: float = 1.05) -> DataFrame:  # noqa: B006
    """Thresholds (target_rate, threshold) from elsewhere: what they abstain here, against the target and its band."""
    x = tie_blocks(pred, by).crossJoin(F.broadcast(thresholds))  # thresholds: a few constants
    on = F.col("confidence") <= F.col("threshold")
    s = x.groupBy(*by, "target_rate", "threshold").agg(
        *(F.sum(F.when(on, F.col(c)).otherwise(0)).cast("long").alias(f"abst_{c}") for c in COUNTS), *(F.sum(c).cast("long").alias(f"all_{c}") for c in COUNTS))
    goal = F.floor(F.col("target_rate") * F.col("all_n")).cast("long")
    actual, rate = ratio(F.col("abst_n"), F.col("all_n")), F.col("target_rate")
    return s.select(*_accepted([
        *by, "target_rate", "threshold", goal.alias("target_rows"), (F.col("abst_n") - goal).alias("row_delta"), (actual - rate).alias("rate_delta"),
        ((actual >= rate * low) & (actual <= rate * high)).alias("within_band")]))


def confusion(pred: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    y, p = F.col("binary_label"), F.col("predicted")
    s = pred.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))
    wrong = F.col("fp") + F.col("fn")
    return s.select(*by, "n", "tn", "fp", "fn", "tp", wrong.alias("errors"), ratio(wrong, F.col("n")).alias("risk"), ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"), ratio(F.col("fn"), F.col("fn") + F.col("tp")).alias("fnr"))


def _score_blocks(pred: DataFrame, score: str) -> DataFrame:
    """Running counts by distinct score, highest first."""
    b = pred.groupBy(F.col(score).alias("confidence")).agg(F.count("*").alias("n"), F.sum(F.col("binary_label").cast("long")).alias("pos"))
    return running(b, [], ascending=False, counts=("n", "pos"))


def auroc(pred: DataFrame, score: str = "p") -> DataFrame:
    """Mean rank form: a tie counts one half."""
    r = _score_blocks(pred, score)
    neg, above = F.col("n") - F.col("pos"), F.col("cum_pos") - F.col("pos")
    s = r.agg(F.sum(neg * (above + F.col("pos") / 2.0)).alias("won"), F.max("all_pos").alias("n_pos"), F.max(F.col("all_n") - F.col("all_pos")).alias("n_neg"))
    return s.select("n_pos", "n_neg", F.try_divide(F.col("won"), F.col("n_pos").cast("double") * F.col("n_neg")).alias("auroc"))


def average_precision(pred: DataFrame, score: str = "p") -> DataFrame:
    r = _score_blocks(pred, score)
    s = r.agg(F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")).alias("area"), F.max("all_pos").alias("n_pos"))
    return s.select("n_pos", ratio(F.col("area"), F.col("n_pos")).alias("average_precision"))


def log_loss(pred: DataFrame, score: str = "p", eps: float = 1e-15) -> DataFrame:
    p = F.least(F.greatest(F.col(score), F.lit(eps)), F.lit(1 - eps))
    y = F.col("binary_label")
    return pred.agg(F.count("*").alias("n"), F.avg(-F.log(F.when(y == 1, p).otherwise(1 - p))).alias("log_loss"))


# Quantiles of a profile.
QUANTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def quantile_aggs(col: str) -> list[Column]:
    c = F.when(~F.isnan(col), F.col(col))
    q = F.percentile(c, F.array(*map(F.lit, QUANTILES.values())))
    return [F.min(c).alias(f"{col}_min"), *(q[i].alias(f"{col}_{k}") for i, k in enumerate(QUANTILES)), F.max(c).alias(f"{col}_max")]


def saturation(pred: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    return pred.groupBy(*by).agg(
        F.count("*").alias("n"), *quantile_aggs("confidence"), F.avg((F.col("confidence") >= 0.99999).cast("double")).alias("saturated_share"),
        F.avg(F.col("p").between(0.01, 0.99).cast("double")).alias("middle_share"), F.count_distinct("confidence").alias("n_confidences"))


def abstention_summary(pred: DataFrame, thresholds: DataFrame, by: list[str]) -> DataFrame:
    """For each ``by`` and budget (a base row with a null threshold included): rows, errors and rates."""
    blocks = pred.groupBy(*by, "confidence").agg(F.count("*").alias("rows"), F.count_if(F.col("is_error") == 1).alias("wrong"))
    x = blocks.crossJoin(F.broadcast(thresholds))  # thresholds: a few constants
    kept = ~F.coalesce(F.col("confidence") <= F.col("threshold"), F.lit(False))
    total = lambda c, on=F.lit(True): F.sum(F.when(on, F.col(c)).otherwise(0)).cast("long")  # noqa: B008, E731
    s = x.groupBy(*by, "target_rate").agg(
        total("rows").alias("n"), total("rows", kept).alias("n_accepted"), total("rows", ~kept).alias("n_abstained"),
        total("wrong", kept).alias("accepted_errors"), total("wrong").alias("errors"))
    return s.withColumn("abstention_rate", ratio(F.col("n_abstained"), F.col("n"))).withColumn("accepted_error_rate", ratio(F.col("accepted_errors"), F.col("n_accepted")))


def observation_sets(pred: DataFrame, thresholds: DataFrame, group: str, category: str, detailed: str) -> DataFrame:
    """Grouping sets (group) and (group, category), the second for one group only, by budget. No label metrics."""
    blocks = pred.groupBy(group, category, "confidence").agg(F.count("*").alias("rows"))
    x = blocks.crossJoin(F.broadcast(thresholds))  # thresholds: a few constants
    off = F.coalesce(F.col("confidence") <= F.col("threshold"), F.lit(False))
    s = x.groupingSets([["target_rate", group], ["target_rate", group, category]], "target_rate", group, category).agg(
        F.grouping(category).alias("whole"), F.sum("rows").alias("n"), F.sum(F.when(off, F.col("rows")).otherwise(0)).cast("long").alias("n_abstained"),
        (F.sum(F.col("confidence") * F.col("rows")) / F.sum("rows")).alias("mean_confidence"))
    return s.where((F.col("whole") == 1) | (F.col(group) == detailed)).withColumn("abstention_rate", ratio(F.col("n_abstained"), F.col("n")))


def scope_distribution(pred: DataFrame) -> DataFrame:
    """Profiles of all rows, of right and wrong ones, and of either class."""
    s = pred.groupingSets([[], ["is_error"], ["binary_label"]], "is_error", "binary_label").agg(
        F.grouping("is_error").alias("ge"), F.grouping("binary_label").alias("gb"), F.count("*").alias("n"), *quantile_aggs("p"))
    scope = F.when(F.col("ge") == 0, F.when(F.col("is_error") == 1, "error").otherwise("correct")).when(F.col("gb") == 0, F.when(F.col("binary_label") == 1, "attack").otherwise("benign")).otherwise("all")
    return s.withColumn("scope", scope).drop("ge", "gb", "is_error", "binary_label")


def with_scopes(pred: DataFrame, inside: Column, names=("with", "without", "only")) -> DataFrame:
    """Every row in the scopes that it belongs to: all rows, those outside, those inside."""
    whole, outside, only = map(F.lit, names)
    return pred.withColumn("scope", F.explode(F.when(inside, F.array(whole, only)).otherwise(F.array(whole, outside))))


def final_status(m: DataFrame) -> DataFrame:
    """One row of metrics to a verdict. Needs relative_improvement, actual_rate_5, enrichment_5, selective_risk_5, full_risk, n_improved, errors."""
    c = F.col
    good = (c("relative_improvement") >= 0.10) & (c("actual_rate_5") >= 0.04) & (c("enrichment_5") >= 2) & (c("selective_risk_5") < c("full_risk")) & (c("n_improved") >= 3)
    unknown = (c("errors") < 10) | c("relative_improvement").isNull() | c("enrichment_5").isNull()
    return m.withColumn("final_status", F.when(unknown, "inconclusive").when(good, "success").otherwise("failure"))


def rank_verdict(by_seed: DataFrame, reference: float, factor: float = 3.0, least_errors: int = 10) -> DataFrame:
    """(seed, errors, aurc, random_aurc) to a verdict for each seed and over all."""
    r = ratio(F.col("aurc"), F.col("random_aurc"))
    v = F.when(F.col("errors") < least_errors, "unassessable").when(r <= factor * reference, "maintained").otherwise("failed")
    return _over_all(by_seed.withColumn("ratio", r).withColumn("seed_verdict", v), lambda ok, bad, odd, n: (
        F.when(odd > 0, "inconclusive").when(ok == n, "maintained").when(ok == n - 1, "inconclusive").otherwise("failed")))


def throughput_verdict(fixed: DataFrame) -> DataFrame:
    """(seed, within_band) rows, two or more a seed, to a verdict for each seed and over all."""
    s = fixed.groupBy("seed").agg(F.count_if("within_band").alias("n_within"), F.count("*").alias("n_thresholds"))
    v = F.when(F.col("n_within") == F.col("n_thresholds"), "maintained").when(F.col("n_within") == 0, "failed").otherwise("inconclusive")
    return _over_all(s.withColumn("seed_verdict", v), lambda ok, bad, odd, n: F.when(ok == n, "maintained").when(bad >= 2, "failed").otherwise("inconclusive"))


def _over_all(seeds: DataFrame, rule) -> DataFrame:
    count = lambda *v: F.count_if(F.col("seed_verdict").isin(*v))
    whole = seeds.agg(rule(count("maintained"), count("failed"), count("unassessable"), F.count("*")).alias("verdict"))
    return seeds.crossJoin(F.broadcast(whole))  # one row


def self_check(pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Recomputed prediction columns that differ from the stored ones."""
    label = (F.col("p") >= threshold).cast("int")
    conf = F.greatest(F.col("p"), 1 - F.col("p"))
    wrong = (F.col("predicted") != F.col("binary_label")).cast("int")
    return pred.agg(
        F.count("*").alias("n"), F.count_if(~label.eqNullSafe(F.col("predicted"))).alias("label_mismatches"),
        F.count_if(F.abs(conf - F.col("confidence")) > 1e-12).alias("confidence_mismatches"), F.count_if(F.col("is_error").isNotNull() & ~wrong.eqNullSafe(F.col("is_error"))).alias("error_mismatches"))


def reliability(pred: DataFrame, bins: int = 15) -> DataFrame:
    """Equal-width bins of the score: mean score, positive rate and gap."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("long")
    s = pred.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_score"), F.avg(F.col("binary_label").cast("double")).alias("positive_rate"))
    return s.withColumn("gap", F.abs(F.col("mean_score") - F.col("positive_rate")))


def calibration(pred: DataFrame, bins: int = 15) -> DataFrame:
    """Expected and greatest calibration error, and Brier score."""
    r = reliability(pred, bins).agg(F.sum(F.col("n") * F.col("gap")).alias("g"), F.sum("n").alias("n"), F.max("gap").alias("mce"))
    b = pred.agg(F.avg((F.col("p") - F.col("binary_label")) ** 2).alias("brier"))
    return r.crossJoin(F.broadcast(b)).select("n", ratio(F.col("g"), F.col("n")).alias("ece"), "mce", "brier")  # one row each


def adaptive_calibration(pred: DataFrame, bins: int = 15) -> DataFrame:
    """Bins of about equal counts; a tie is never split: its block goes where its middle rank stands."""
    b = pred.groupBy(F.col("p").alias("confidence")).agg(F.count("*").alias("n"), F.sum(F.col("binary_label").cast("long")).alias("pos"))
    r = running(b, [], counts=("n", "pos"))
    middle = (F.col("cum_n") - F.col("n") / 2.0) / F.col("all_n")
    k = F.least(F.floor(middle * bins), F.lit(bins - 1)).cast("long")
    s = r.groupBy(k.alias("bin")).agg(F.sum("n").alias("n"), F.sum(F.col("confidence") * F.col("n")).alias("s"), F.sum("pos").alias("pos"))
    gap = F.abs(F.col("s") - F.col("pos"))
    return s.agg(F.sum("n").alias("n"), F.count("*").alias("n_bins"), (F.sum(gap) / F.sum("n")).alias("adaptive_ece"))


def histogram(pred: DataFrame, bins: int = 20) -> DataFrame:
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("long")
    return pred.groupBy("binary_label", b.alias("bin")).agg(F.count("*").alias("n"))


def mass(pred: DataFrame, by: list[str]) -> DataFrame:
    """Where scores lie: low, middle and high mass, extremes and quartiles."""
    p = F.col("p")
    q = F.percentile(p, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    avg = lambda c: F.avg(c.cast("double"))
    return pred.groupBy(*by).agg(F.count("*").alias("n"), avg(p < 0.1).alias("low"), avg(p.between(0.1, 0.9)).alias("middle"), avg(p > 0.9).alias("high"), avg((p < 0.01) | (p > 0.99)).alias("extreme"), q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"))


def error_by_confidence(pred: DataFrame, bins: int = 10) -> DataFrame:
    b = F.least(F.floor((F.col("confidence") - 0.5) * 2 * bins), F.lit(bins - 1)).cast("long")
    return pred.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col("is_error").cast("double")).alias("error_rate"))


def baselines(pred: DataFrame, seed: int = 7, digits: int = 4) -> DataFrame:
    """AURC of orders by greatest probability, entropy, distance to the threshold, and a shuffle. Long form, one pass."""
    p = F.col("p")
    h = lambda x: F.when(x > 0, -x * F.log2(x)).otherwise(0.0)
    own = {
        "max_prob": F.col("confidence"), "entropy": F.round(1 - h(p) - h(1 - p), digits), "band": F.round(F.abs(p - 0.5) * 2, digits),
        "random": F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(1000003)) / 1000003.0,
    }
    long = pred.withColumn("m", F.explode(F.array(*(F.struct(F.lit(k).alias("method"), v.cast("double").alias("c")) for k, v in own.items()))))
    return aurc(long.withColumn("method", F.col("m.method")).withColumn("confidence", F.col("m.c")), ["method"])
