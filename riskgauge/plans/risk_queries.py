"""Selective-prediction queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import risk
from .views import BUDGETS, SEEDS, TARGET, pred, pred_sql, rounded, rounded_sql, target

P = pred_sql(where=TARGET)
RATES = "(VALUES " + ", ".join(f"({r}::DOUBLE)" for r in BUDGETS) + ") AS b(target_rate)"
RATE_COLUMNS = "actual_rate coverage selective_risk error_capture enrichment selective_fpr selective_fnr residual_fpr residual_fnr benign_coverage attack_coverage"
#: Thresholds that were fixed elsewhere, by target rate.
FIXED = ((0.01, 0.505), (0.05, 0.52), (0.1, 0.55))
FIXED_SQL = "(VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in FIXED) + ") AS f(target_rate, threshold)"


def thresholds(spark, rows=FIXED, base: bool = False):
    values = [f"({a!r}D, {b!r}D)" for a, b in rows] + (["(0.0D, CAST(NULL AS DOUBLE))"] if base else [])
    return spark.sql("SELECT * FROM VALUES " + ", ".join(values) + " AS t(target_rate, threshold)")


BASE_SQL = FIXED_SQL.replace(") AS f", ", (0.0::DOUBLE, NULL::DOUBLE)) AS f")


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN NULL ELSE ({a})::DOUBLE / ({b}) END"


def _metrics(t: str) -> str:
    """Columns of a budget row, from all rows ``t`` of a group and those at or below the threshold."""
    off = "coalesce(confidence <= threshold, false)"
    s = lambda c: f"sum(CASE WHEN {off} THEN {c} ELSE 0 END)"
    fp, fn = "(CASE WHEN binary_label = 0 AND predicted = 1 THEN 1 ELSE 0 END)", "(CASE WHEN binary_label = 1 AND predicted = 0 THEN 1 ELSE 0 END)"
    w = {"n": "1", "e": "is_error", "b": "(1 - binary_label)", "a": "binary_label", "fp": fp, "fn": fn}
    out = [f"{s(v)}::BIGINT AS x_{k}, sum({v})::BIGINT AS t_{k}" for k, v in w.items()]
    return ", ".join(out)


def _final(cols: str) -> str:
    r = _ratio
    of = {"selective_risk": "t_n - x_n", "error_capture": "t_e", "selective_fpr": "t_b - x_b", "selective_fnr": "t_a - x_a", "residual_fpr": "t_b", "residual_fnr": "t_a", "benign_coverage": "t_b", "attack_coverage": "t_a"}
    reasons = ", ".join(f"CASE WHEN {d} = 0 THEN 'zero_denominator' END AS {c}_reason" for c, d in of.items())
    return f"""{cols}, t_n AS n, x_n AS n_abstained, t_n - x_n AS n_accepted, {r('x_n', 't_n')} AS actual_rate, {r('t_n - x_n', 't_n')} AS coverage, x_e AS abstained_errors, t_e - x_e AS accepted_errors,
      t_b - x_b AS accepted_benign, t_a - x_a AS accepted_attack, t_fp - x_fp AS accepted_fp, t_fn - x_fn AS accepted_fn, t_b AS total_benign, t_a AS total_attack, t_e AS total_errors, {reasons},
      {r('t_e - x_e', 't_n - x_n')} AS selective_risk, {r('x_e', 't_e')} AS error_capture, CASE WHEN x_n > 0 AND t_e > 0 THEN (x_e::DOUBLE / t_e) / (x_n::DOUBLE / t_n) END AS enrichment,
      {r('t_fp - x_fp', 't_b - x_b')} AS selective_fpr, {r('t_fn - x_fn', 't_a - x_a')} AS selective_fnr, {r('t_fp - x_fp', 't_b')} AS residual_fpr, {r('t_fn - x_fn', 't_a')} AS residual_fnr,
      {r('t_b - x_b', 't_b')} AS benign_coverage, {r('t_a - x_a', 't_a')} AS attack_coverage"""


def budget_sql(p: str = P, by: str = "") -> str:
    b, on = (f"{by}, ", f" AND z.{by} = x.{by}") if by else ("", "")
    part = f"PARTITION BY {by}" if by else ""
    return f"""WITH r AS (SELECT * FROM {p}), c AS (SELECT DISTINCT {b}confidence, count(*) OVER ({part} ORDER BY confidence RANGE UNBOUNDED PRECEDING) AS cum, count(*) OVER ({part}) AS n FROM r),
      z AS (SELECT {b}target_rate, max(CASE WHEN cum <= target_rate * n + 1e-12 THEN confidence END) AS threshold, min(CASE WHEN cum > target_rate * n + 1e-12 THEN cum END)::DOUBLE / max(n) AS next_tie_rate FROM c, {RATES} GROUP BY ALL),
      m AS (SELECT {'z.' + by + ', ' if by else ''}target_rate, threshold, next_tie_rate, {_metrics('r')} FROM r x JOIN z ON true{on} GROUP BY ALL)
      SELECT {_final(f"{b}target_rate, threshold AS confidence_threshold, CASE WHEN threshold IS NULL THEN 'confidence_resolution_insufficient' END AS threshold_reason, target_rate - x_n::DOUBLE / t_n AS budget_shortfall, 1 - threshold AS band_low, threshold AS band_high, next_tie_rate")} FROM m"""


def aurc_sql(p: str = P, by: str = "") -> str:
    b, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    g = f"GROUP BY {by}" if by else ""
    return f"""WITH t AS (SELECT {b}confidence, count(*)::DOUBLE AS m, sum(is_error)::DOUBLE AS q FROM {p} GROUP BY ALL),
      c AS (SELECT *, sum(m) OVER w - m AS k0, sum(q) OVER w - q AS e0 FROM t WINDOW w AS ({part} ORDER BY confidence DESC)),
      a AS (SELECT {b}sum(list_sum(list_transform(range(1, m::BIGINT + 1), lambda j: (e0 + j * q / m) / (k0 + j)))) AS area, sum(m) AS n, sum(q) AS e FROM c {g})
      SELECT {b}n::BIGINT AS n, e::BIGINT AS errors, area / n AS aurc, e / n AS random_aurc,
        coalesce(list_sum(list_transform(range(1, e::BIGINT + 1), lambda i: i / (n - e + i))), 0) / n AS oracle_aurc, CASE WHEN e > 0 THEN (e / n - area / n) / (e / n) END AS relative_improvement FROM a"""


AURC_COLUMNS = "aurc random_aurc oracle_aurc relative_improvement"


def by_seed(spark, sf_dir, where: str = TARGET):
    out = None
    for s in SEEDS:
        one = pred(spark, sf_dir, s).where(where).withColumn("seed", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out


SEEDED = "(" + " UNION ALL ".join(f"SELECT {s} AS seed, * FROM {pred_sql(s, TARGET)}" for s in SEEDS) + ")"


def _q(c: str, out: str | None = None) -> str:
    from ..operators.risk import QUANTILES

    o = out or c
    return f"min({c}) AS {o}_min, " + ", ".join(f"quantile_cont({c}, {v}) AS {o}_{k}" for k, v in QUANTILES.items()) + f", max({c}) AS {o}_max"


def _q_names(c: str) -> str:
    return " ".join([f"{c}_min", *(f"{c}_{k}" for k in risk.QUANTILES), f"{c}_max"])


def overlap(df):
    """A tenth of the rows as the class-overlap subset."""
    return risk.with_scopes(df, F.col("id") % 10 == 3)


OVERLAP = f"(SELECT unnest(CASE WHEN id % 10 = 3 THEN ['with', 'only'] ELSE ['with', 'without'] END) AS scope, * FROM {P})"


def status_row(spark, sf_dir):
    t = target(spark, sf_dir)
    b = risk.budget_metrics(t, risk.budgets(spark, BUDGETS))
    a = risk.aurc(t)
    five = F.col("target_rate") == 0.05
    m = b.agg(F.max(F.when(five, F.col("actual_rate"))).alias("actual_rate_5"), F.max(F.when(five, F.col("enrichment"))).alias("enrichment_5"), F.max(F.when(five, F.col("selective_risk"))).alias("selective_risk_5"),
              F.max(F.col("abstained_errors") + F.col("accepted_errors")).alias("errors"), F.count_if(F.col("selective_risk") < (F.col("abstained_errors") + F.col("accepted_errors")) / F.col("n")).alias("n_improved"))
    return risk.final_status(m.crossJoin(F.broadcast(a.select("relative_improvement", F.col("random_aurc").alias("full_risk")))))  # one row each


def entries() -> dict:
    """name: (query, SQL)."""
    rs = lambda f: (lambda spark, d: rounded(f(spark, d)))
    fp = "(binary_label = 0 AND predicted = 1)"
    band = "actual_rate >= target_rate * 0.95 AND actual_rate <= target_rate * 1.05"
    fixed_sql = lambda p, by: f"""SELECT *, floor(target_rate * n)::BIGINT AS target_rows, n_abstained - floor(target_rate * n)::BIGINT AS row_delta, actual_rate - target_rate AS rate_delta, ({band}) AS within_band FROM (
        SELECT {_final(f"{by}target_rate, threshold")} FROM (SELECT {by}target_rate, threshold, {_metrics('')} FROM {p}, {FIXED_SQL} GROUP BY ALL))"""  # noqa: E731
    return {
        "budget_metrics": (rs(lambda s, d: risk.budget_metrics(target(s, d), risk.budgets(s, BUDGETS))), rounded_sql("confidence_threshold band_low band_high next_tie_rate budget_shortfall " + RATE_COLUMNS, budget_sql())),
        "fixed_threshold_metrics": (rs(lambda s, d: risk.fixed_threshold_metrics(target(s, d), thresholds(s))), rounded_sql("rate_delta " + RATE_COLUMNS, fixed_sql(P, ""))),
        "aurc_summary": (rs(lambda s, d: risk.aurc(target(s, d))), rounded_sql(AURC_COLUMNS, aurc_sql())),
        "aurc_by_seed": (rs(lambda s, d: risk.aurc(by_seed(s, d), ["seed"])), rounded_sql(AURC_COLUMNS, aurc_sql(SEEDED, "seed"))),
        "aurc_curve": (rs(lambda s, d: risk.risk_curve(target(s, d))), rounded_sql("coverage selective_risk", f"""SELECT confidence AS threshold, n_accepted, n_accepted::DOUBLE / n AS coverage, e::DOUBLE AS expected_errors_accepted, e::DOUBLE / n_accepted AS selective_risk FROM (
            SELECT DISTINCT confidence, count(*) OVER w AS n_accepted, sum(is_error) OVER w AS e, count(*) OVER () AS n FROM {P} WINDOW w AS (ORDER BY confidence DESC RANGE UNBOUNDED PRECEDING))""")),
        "confusion_metrics": (rs(lambda s, d: risk.confusion(target(s, d))), rounded_sql("risk fpr fnr", f"""SELECT *, fp + fn AS errors, (fp + fn)::DOUBLE / n AS risk, fp::DOUBLE / (fp + tn) AS fpr, fn::DOUBLE / (fn + tp) AS fnr FROM (SELECT count(*) AS n,
            count(*) FILTER (binary_label = 0 AND predicted = 0) AS tn, count(*) FILTER {fp} AS fp, count(*) FILTER (binary_label = 1 AND predicted = 0) AS fn, count(*) FILTER (binary_label = 1 AND predicted = 1) AS tp FROM {P})""")),
        "auroc": (rs(lambda s, d: risk.auroc(target(s, d))), rounded_sql("auroc", f"""WITH r AS (SELECT binary_label AS y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS rk FROM {P}),
            c AS (SELECT sum(y)::BIGINT AS n_pos, (count(*) - sum(y))::BIGINT AS n_neg, sum(CASE WHEN y = 1 THEN rk END) AS s FROM r) SELECT n_pos, n_neg, (s - n_pos * (n_pos + 1) / 2) / (n_pos::DOUBLE * n_neg) AS auroc FROM c""")),
        "average_precision": (rs(lambda s, d: risk.average_precision(target(s, d))), rounded_sql("average_precision", f"""WITH t AS (SELECT p, sum(binary_label) AS pos, count(*) AS n FROM {P} GROUP BY p), c AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS k FROM t WINDOW w AS (ORDER BY p DESC))
            SELECT sum(pos)::BIGINT AS n_pos, sum(pos * (tp::DOUBLE / k)) / sum(pos) AS average_precision FROM c""")),
        "logloss": (rs(lambda s, d: risk.log_loss(target(s, d))), rounded_sql("log_loss", f"SELECT count(*) AS n, avg(-ln(CASE WHEN binary_label = 1 THEN greatest(least(p, 1 - 1e-15), 1e-15) ELSE 1 - greatest(least(p, 1 - 1e-15), 1e-15) END)) AS log_loss FROM {P}")),
        "confidence_quantiles": (rs(lambda s, d: target(s, d).agg(*risk.quantile_aggs("p"), *risk.quantile_aggs("confidence"))), rounded_sql(f"{_q_names('p')} {_q_names('confidence')}", f"SELECT {_q('p')}, {_q('confidence')} FROM {P}")),
        "saturation_row": (rs(lambda s, d: risk.saturation(target(s, d))), rounded_sql(f"{_q_names('confidence')} saturated_share middle_share", f"SELECT count(*) AS n, {_q('confidence')}, avg((confidence >= 0.99999)::INT) AS saturated_share, avg((p BETWEEN 0.01 AND 0.99)::INT) AS middle_share, count(DISTINCT confidence) AS n_confidences FROM {P}")),
        "label_budget_summary": (rs(lambda s, d: risk.abstention_summary(target(s, d), thresholds(s, base=True), ["label"])), rounded_sql("abstention_rate accepted_error_rate", f"""SELECT *, n_abstained::DOUBLE / n AS abstention_rate, {_ratio('accepted_errors', 'n_accepted')} AS accepted_error_rate FROM (SELECT label, target_rate, count(*) AS n,
            count(*) FILTER (NOT off) AS n_accepted, count(*) FILTER (off) AS n_abstained, count(*) FILTER (NOT off AND is_error = 1) AS accepted_errors, count(*) FILTER (is_error = 1) AS errors FROM (SELECT *, coalesce(confidence <= threshold, false) AS off FROM {P}, {BASE_SQL}) GROUP BY ALL)""")),
        "observation_grouping_sets": (rs(lambda s, d: risk.observation_sets(pred(s, d).where("observation_group <> 'none'").withColumn("category", (F.col("id") % 7).cast("string")), thresholds(s, base=True), "observation_group", "category", "attempted").withColumn("whole", F.col("whole").cast("int"))),
            rounded_sql("mean_confidence abstention_rate", f"""SELECT *, n_abstained::DOUBLE / n AS abstention_rate FROM (SELECT target_rate, observation_group, category, grouping(category)::INT AS whole, count(*) AS n, count(*) FILTER (coalesce(confidence <= threshold, false)) AS n_abstained, avg(confidence) AS mean_confidence
            FROM (SELECT *, (id % 7)::VARCHAR AS category FROM {pred_sql(where="observation_group <> 'none'")}, {BASE_SQL}) GROUP BY GROUPING SETS ((target_rate, observation_group), (target_rate, observation_group, category))) WHERE whole = 1 OR observation_group = 'attempted'""")),
        "prediction_scope_distribution": (rs(lambda s, d: risk.scope_distribution(target(s, d))), rounded_sql(_q_names("p"), " UNION ALL ".join(f"SELECT '{k}' AS scope, count(*) AS n, {_q('p')} FROM {P} WHERE {w}" for k, w in (("all", "true"), ("error", "is_error = 1"), ("correct", "is_error = 0"), ("attack", "binary_label = 1"), ("benign", "binary_label = 0"))))),
        "overlap_scope_budgets": (rs(lambda s, d: risk.fixed_threshold_metrics(overlap(target(s, d)), thresholds(s), ["scope"])), rounded_sql("rate_delta " + RATE_COLUMNS, fixed_sql(OVERLAP, "scope, "))),
        "overlap_scope_aurc": (rs(lambda s, d: risk.aurc(overlap(target(s, d)), ["scope"])), rounded_sql(AURC_COLUMNS, aurc_sql(OVERLAP, "scope"))),
        "rank_verdict": (rs(lambda s, d: risk.rank_verdict(risk.aurc(by_seed(s, d), ["seed"]).select("seed", "errors", "aurc", "random_aurc"), 0.4)), rounded_sql("aurc random_aurc ratio", f"""WITH a AS (SELECT seed, errors, aurc, random_aurc, {_ratio('aurc', 'random_aurc')} AS ratio FROM ({aurc_sql(SEEDED, 'seed')})),
            v AS (SELECT *, CASE WHEN errors < 10 THEN 'unassessable' WHEN ratio <= 3 * 0.4::DOUBLE THEN 'maintained' ELSE 'failed' END AS seed_verdict FROM a)
            SELECT *, (SELECT CASE WHEN count(*) FILTER (seed_verdict = 'unassessable') > 0 THEN 'inconclusive' WHEN count(*) FILTER (seed_verdict = 'maintained') = count(*) THEN 'maintained' WHEN count(*) FILTER (seed_verdict = 'maintained') = count(*) - 1 THEN 'inconclusive' ELSE 'failed' END FROM v) AS verdict FROM v""")),
        "throughput_verdict": (rs(lambda s, d: risk.throughput_verdict(risk.fixed_threshold_metrics(by_seed(s, d), thresholds(s), ["seed"]))), f"""WITH f AS ({fixed_sql(SEEDED, 'seed, ')}), v AS (SELECT *, CASE WHEN n_within = n_thresholds THEN 'maintained' WHEN n_within = 0 THEN 'failed' ELSE 'inconclusive' END AS seed_verdict FROM (SELECT seed, count(*) FILTER (within_band) AS n_within, count(*) AS n_thresholds FROM f GROUP BY seed))
            SELECT *, (SELECT CASE WHEN count(*) FILTER (seed_verdict = 'maintained') = count(*) THEN 'maintained' WHEN count(*) FILTER (seed_verdict = 'failed') >= 2 THEN 'failed' ELSE 'inconclusive' END FROM v) AS verdict FROM v"""),
        "final_status": (rs(status_row), rounded_sql("actual_rate_5 enrichment_5 selective_risk_5 relative_improvement full_risk", f"""WITH b AS ({budget_sql()}), a AS ({aurc_sql()}), m AS (SELECT max(CASE WHEN target_rate = 0.05 THEN actual_rate END) AS actual_rate_5, max(CASE WHEN target_rate = 0.05 THEN enrichment END) AS enrichment_5, max(CASE WHEN target_rate = 0.05 THEN selective_risk END) AS selective_risk_5,
            max(abstained_errors + accepted_errors) AS errors, count(*) FILTER (selective_risk < (abstained_errors + accepted_errors)::DOUBLE / n) AS n_improved FROM b) SELECT m.*, relative_improvement, random_aurc AS full_risk,
            CASE WHEN m.errors < 10 OR relative_improvement IS NULL OR enrichment_5 IS NULL THEN 'inconclusive' WHEN relative_improvement >= 0.10 AND actual_rate_5 >= 0.04 AND enrichment_5 >= 2 AND selective_risk_5 < random_aurc AND n_improved >= 3 THEN 'success' ELSE 'failure' END AS final_status FROM m, a""")),
        "prediction_self_check": (lambda s, d: risk.self_check(pred(s, d)), f"SELECT count(*) AS n, count(*) FILTER ((p >= 0.5)::INT <> predicted) AS label_mismatches, count(*) FILTER (abs(greatest(p, 1 - p) - confidence) > 1e-12) AS confidence_mismatches, count(*) FILTER ((predicted <> binary_label)::INT <> is_error) AS error_mismatches FROM {pred_sql()}"),
        "risk_reduction": (rs(lambda s, d: risk.budget_metrics(target(s, d), risk.budgets(s, BUDGETS)).select("target_rate", "actual_rate", F.when(F.col("abstained_errors") + F.col("accepted_errors") > 0, 1 - F.col("selective_risk") / ((F.col("abstained_errors") + F.col("accepted_errors")) / F.col("n"))).alias("risk_reduction")).unionByName(s.sql("SELECT 0.0D AS target_rate, 0.0D AS actual_rate, 0.0D AS risk_reduction"))),
            rounded_sql("actual_rate risk_reduction", f"SELECT target_rate, actual_rate, 1 - selective_risk / ((abstained_errors + accepted_errors)::DOUBLE / n) AS risk_reduction FROM ({budget_sql()}) UNION ALL SELECT 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE")),
        "ece_bins": (rs(lambda s, d: risk.reliability(target(s, d))), rounded_sql("mean_score positive_rate gap", f"SELECT *, abs(mean_score - positive_rate) AS gap FROM (SELECT least(floor(p * 15), 14)::BIGINT AS bin, count(*) AS n, avg(p) AS mean_score, avg(binary_label) AS positive_rate FROM {P} GROUP BY 1)")),
        "calibration_summary": (rs(lambda s, d: risk.calibration(target(s, d))), rounded_sql("ece mce brier", f"SELECT sum(n)::BIGINT AS n, sum(n * gap) / sum(n) AS ece, max(gap) AS mce, (SELECT avg((p - binary_label) * (p - binary_label)) FROM {P}) AS brier FROM (SELECT *, abs(s - r) AS gap FROM (SELECT least(floor(p * 15), 14) AS bin, count(*) AS n, avg(p) AS s, avg(binary_label) AS r FROM {P} GROUP BY 1))")),
        "adaptive_ece": (rs(lambda s, d: risk.adaptive_calibration(target(s, d))), rounded_sql("adaptive_ece", f"""WITH t AS (SELECT p, count(*) AS n, sum(binary_label) AS pos FROM {P} GROUP BY p), c AS (SELECT *, (sum(n) OVER (ORDER BY p) - n / 2) / (sum(n) OVER ()) AS mid FROM t),
            b AS (SELECT least(floor(mid * 15), 14) AS bin, sum(n) AS n, abs(sum(p * n) - sum(pos)) AS g FROM c GROUP BY 1) SELECT sum(n)::BIGINT AS n, count(*) AS n_bins, sum(g) / sum(n) AS adaptive_ece FROM b""")),
        "prob_histogram": (lambda s, d: risk.histogram(target(s, d)), f"SELECT binary_label, least(floor(p * 20), 19)::BIGINT AS bin, count(*) AS n FROM {P} GROUP BY ALL"),
        "probability_mass": (rs(lambda s, d: risk.mass(pred(s, d), ["label"])), rounded_sql("low middle high extreme q25 q50 q75", f"SELECT label, count(*) AS n, avg((p < 0.1)::INT) AS low, avg((p BETWEEN 0.1 AND 0.9)::INT) AS middle, avg((p > 0.9)::INT) AS high, avg((p < 0.01 OR p > 0.99)::INT) AS extreme, quantile_cont(p, 0.25) AS q25, quantile_cont(p, 0.5) AS q50, quantile_cont(p, 0.75) AS q75 FROM {pred_sql()} GROUP BY 1")),
        "error_by_confidence": (rs(lambda s, d: risk.error_by_confidence(target(s, d))), rounded_sql("error_rate", f"SELECT least(floor((confidence - 0.5) * 2 * 10), 9)::BIGINT AS bin, count(*) AS n, avg(is_error) AS error_rate FROM {P} GROUP BY 1")),
        "risk_coverage_baselines": (rs(lambda s, d: risk.baselines(target(s, d))), rounded_sql(AURC_COLUMNS, aurc_sql(f"""(SELECT m.method AS method, m.c AS confidence, is_error FROM (SELECT is_error, unnest([{{'method': 'max_prob', 'c': confidence::DOUBLE}},
            {{'method': 'entropy', 'c': round(1 - (CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END) - (CASE WHEN p < 1 THEN -(1 - p) * log2(1 - p) ELSE 0 END), 4)::DOUBLE}}, {{'method': 'band', 'c': round(abs(p - 0.5) * 2, 4)::DOUBLE}},
            {{'method': 'random', 'c': (('0x' || substr(md5(concat_ws('|', '7', id)), 1, 8))::BIGINT % 1000003) / 1000003.0::DOUBLE}}]) AS m FROM {P}))""", "method"))),
        "daily_window_budgets": (rs(lambda s, d: risk.budget_metrics(target(s, d).withColumn("day", F.col("day").cast("string")), risk.budgets(s, (0.05, 0.1)), ["day"])), rounded_sql("confidence_threshold band_low band_high next_tie_rate budget_shortfall " + RATE_COLUMNS, budget_sql(f"(SELECT * REPLACE (day::VARCHAR AS day) FROM {P})", "day").replace(RATES, "(VALUES (0.05::DOUBLE), (0.1::DOUBLE)) AS b(target_rate)"))),
    }
