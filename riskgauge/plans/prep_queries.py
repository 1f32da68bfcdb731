"""Preparation, profile, scenario and validation queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import groups, prep, profile, scenario, splits, validate
from .group_queries import TCUT, tcut
from .views import GROUPS, KEY, groups_view, pred, pred_sql, read, rounded, rounded_sql, target

#: Labelled events for scenario work: attempts are signups, the special class is views, the benign class is purchases.
EV = "(SELECT event_id AS id, event_type AS label, ts::DATE AS day, event_type = 'signup' AS attempted, event_type = 'view' AS special, event_type = 'purchase' AS benign, CASE WHEN event_type = 'signup' THEN event_id % 7 WHEN event_id % 1000 = 1 THEN NULL ELSE -1 END AS category, event_id % 23 AS port, value FROM events)"


def ev(s, d):
    e, k = read(s, d, "events"), F.col("event_type")
    return e.select(
        F.col("event_id").alias("id"), k.alias("label"), F.col("ts").cast("date").alias("day"), (k == "signup").alias("attempted"), (k == "view").alias("special"), (k == "purchase").alias("benign"),
        F.when(k == "signup", F.col("event_id") % 7).when(F.col("event_id") % 1000 == 1, None).otherwise(F.lit(-1)).cast("bigint").alias("category"), (F.col("event_id") % 23).alias("port"), "value")


def text_category(df):
    """Nullable whole numbers as text, which compares alike in every engine."""
    return df.withColumn("category", F.col("category").cast("string"))


#: A rate with both infinities, and a duration whose sign tells what a negative one means.
RATES = "(SELECT l_orderkey, l_linenumber, l_shipdate < TIMESTAMP '1997-01-01' AS train, CASE WHEN l_discount = 0 THEN 'Infinity'::DOUBLE WHEN l_discount = 0.1 THEN '-Infinity'::DOUBLE ELSE l_extendedprice / l_discount END AS rate, l_quantity - 25 AS duration, l_extendedprice AS price FROM lineitem)"


def rates(s, d):
    x = F.col("l_discount")
    inf = float("inf")
    return read(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz")).alias("train"),
        F.when(x == 0, F.lit(inf)).when(x == 0.1, F.lit(-inf)).otherwise(F.try_divide(F.col("l_extendedprice"), x)).alias("rate"), (F.col("l_quantity") - 25).alias("duration"), F.col("l_extendedprice").alias("price"))


RC = ["rate", "price"]


def clipped(s, d):
    """As in the SQL: only the rate is clipped and rounded, a missing bound gives null, and what a null rate would be stays unknown."""
    rate, duration, inf = F.col("rate"), F.col("duration"), float("inf")
    r = prep.negative_infinity_flags(rates(s, d), ["rate"], "duration")
    unknown = F.when(rate.isNotNull(), False)
    r = r.withColumns({"invalid_negative_duration": F.col("invalid_negative_duration") | unknown & (duration < 0), "zero_duration": F.col("zero_duration") | unknown & (duration == 0)})
    out = prep.apply_clip(r, prep.clip_bounds(r, ["rate"], F.col("train")), ["rate"], "invalid_negative_duration")
    unbounded = (rate == inf) | (rate == -inf) & (duration >= 0)
    return out.withColumn("rate", sc.scaled_round(F.when(~F.coalesce(unbounded, F.lit(False)), rate), 4))


WIDE = ["o_orderkey", "o_custkey", "o_totalprice"]


def wide(s, d):
    o = read(s, d, "orders")
    return o.withColumn("one", F.lit(1)).withColumn("price_copy", F.col("o_totalprice")).withColumn("cust_copy", F.col("o_custkey")).withColumn("none", F.lit(None).cast("double"))


def relaxed_rows(s, d):
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey", "l_extendedprice")


RELAXED = """(SELECT * FROM (SELECT l_orderkey, l_linenumber, l_returnflag, l_partkey, l_suppkey, l_extendedprice, n > 1 AND m > 1 AS label_conflict, n, m, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS nth
  FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) JOIN (SELECT l_orderkey, l_linenumber, count(DISTINCT l_returnflag) AS m FROM lineitem GROUP BY ALL) USING (l_orderkey, l_linenumber)) WHERE m > 1 OR nth = 1)"""


def relaxed(s, d):
    return prep.relaxed_dedup(relaxed_rows(s, d), ["l_orderkey", "l_linenumber"], "l_returnflag", ["l_partkey", "l_suppkey", "l_extendedprice"])


def scenarios(s, d):
    e = ev(s, d)
    return scenario.with_scenarios(e, scenario.scenario_names(F.col("special"), F.col("attempted"), F.col("category"), [2, 3]))


SCEN = f"""(SELECT * FROM (SELECT *, unnest(list_filter(['S0', CASE WHEN NOT special THEN 'S1' END, CASE WHEN NOT special AND (NOT attempted OR coalesce(category IN (2, 3), false)) THEN 'S2' END, CASE WHEN NOT special AND NOT attempted THEN 'S3' END, CASE WHEN NOT special THEN 'S4' END], lambda x: x IS NOT NULL)) AS scenario FROM {EV}))"""


def below_min(s, d):
    x = scenarios(s, d).withColumn("g", F.concat_ws("|", "label", F.col("port").cast("string"), F.col("day").cast("string")))
    g = x.groupBy("scenario", "label", "day", "g").agg(F.count("*").alias("n_flows_in_group"), F.min("id").alias("rep_time"))
    c = splits.time_cut(g, ["scenario", "day", "label"], ["rep_time", "g"], least=20)
    return c.where("below_min").select("scenario", "day", "label").distinct().groupBy("scenario").agg(F.count("*").alias("strata_below_min"))


def checks(s, d):
    g = splits.leave_out(tcut(s, d), ["error"])
    rows = relaxed_rows(s, d)
    main, side = prep.reserve(rows, "l_orderkey", ["l_suppkey"])
    li = read(s, d, "lineitem")
    return validate.run_all(
        validate.crossing_groups(g), validate.shared_ids(g.withColumnRenamed("group_id", "row_uid"), ["row_uid"]), validate.one_sided(g, ["day", "attack_label"]),
        validate.left_out_absent(g, ["error"]), validate.no_duplicates(li, li.columns), validate.flag_count(relaxed(s, d), "label_conflict", 0, "label_conflicts_preserved"),
        validate.flag_count(prep.negative_infinity_flags(rates(s, d), RC, "duration"), "invalid_negative_duration", 0, "negative_durations_preserved"),
        validate.column_apart(main, side, "l_suppkey"), validate.key_absent(s, {"created": "now"}, "original_download_date"))


TL = f"(SELECT * REPLACE (CASE WHEN attack_label = 'error' AND split IN ('train', 'calib') THEN 'test' ELSE split END AS split) FROM {TCUT})"
CHECKS = f"""WITH c AS (
  SELECT 'group_in_one_split' AS name, 'error' AS level, 0::BIGINT AS detail UNION ALL SELECT 'row_in_train_or_calib', 'error', 0
  UNION ALL SELECT 'split_skew', 'warning', count(*) FILTER (n = 1) FROM (SELECT count(DISTINCT split) AS n FROM {TL} GROUP BY day, attack_label)
  UNION ALL SELECT 'left_out_absent_from_train', 'error', count(*) FILTER (attack_label = 'error' AND split IN ('train', 'calib')) FROM {TL}
  UNION ALL SELECT 'no_exact_duplicates', 'error', (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem))
  UNION ALL SELECT 'label_conflicts_preserved', 'error', count(*) FILTER (label_conflict) FROM {RELAXED}
  UNION ALL SELECT 'negative_durations_preserved', 'error', count(*) FILTER (rate = '-Infinity'::DOUBLE AND duration < 0) FROM {RATES}
  UNION ALL SELECT 'column_reserved', 'error', 0 UNION ALL SELECT 'manifest_key_absent', 'error', 0)
  SELECT name, detail = 0 AS passed, level, detail::BIGINT AS detail, (SELECT bool_and(detail = 0 OR level <> 'error') FROM c) AS all_passed FROM c"""


def _profile_sql(t: str, c: str) -> str:
    return f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_values, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, avg(({c} = 0)::INT) AS zero_ratio, coalesce(bool_and({c} = floor({c})), true) AS whole_numbers, count(*) FILTER ({c} IS NULL) AS n_missing, 0::BIGINT AS n_infinite FROM {t}"


def entries() -> dict:
    rs = lambda f: (lambda s, d: rounded(f(s, d)))
    q = lambda p: f"quantile_cont(rate, {p}) FILTER (train AND isfinite(rate)) * 3"
    bounds = f"(SELECT CASE WHEN bool_or(rate = 'Infinity'::DOUBLE) THEN {q(0.999)} END AS u, CASE WHEN bool_or(rate = '-Infinity'::DOUBLE) THEN {q(0.001)} END AS l FROM {RATES})"
    wide_cols = ["o_custkey", "o_totalprice", "one", "price_copy", "cust_copy", "none", "o_orderpriority"]
    ident = lambda n, a, b: f"SELECT '{n}' AS identity, count(*) AS n, avg((abs(({a}) - ({b})) <= 1e-9)::INT) AS match_share, max(abs(({a}) - ({b}))) AS max_abs_diff, max(abs(({a}) - ({b})) / abs(nullif({b}, 0))) AS max_rel_diff FROM lineitem"
    knn_q = lambda s, d: read(s, d, "embeddings").where("vec_id % 100 = 0")
    occ = "SELECT port AS value, count(*) AS rows, count(*) FILTER (special) AS target_rows, count(*) FILTER (NOT special) AS other_rows, count(*) FILTER (benign) AS benign_rows, array_to_string(list_sort(list_distinct(list(label) FILTER (NOT special))), ',') AS other_labels"
    return {
        "exact_dedup": (lambda s, d: prep.exact_dedup(read(s, d, "documents").select("doc_id", "text", "lang"), ["doc_id"], ["doc_id"]).select("doc_id", "lang"), "SELECT min(doc_id) AS doc_id, lang FROM documents GROUP BY text, lang"),
        "relaxed_dedup": (lambda s, d: relaxed(s, d), f"SELECT l_orderkey, l_linenumber, l_returnflag, l_partkey, l_suppkey, l_extendedprice, label_conflict FROM {RELAXED}"),
        "negative_infinity_flags": (lambda s, d: prep.negative_infinity_flags(rates(s, d), RC, "duration").agg(F.count_if("invalid_negative_duration").alias("invalid"), F.count_if("zero_duration").alias("zero")), f"SELECT count(*) FILTER (rate = '-Infinity'::DOUBLE AND duration < 0) AS invalid, count(*) FILTER (rate = '-Infinity'::DOUBLE AND duration = 0) AS zero FROM {RATES}"),
        "infinities_to_nan": (lambda s, d: prep.count_infinities(rates(s, d), RC).withColumn("stage", F.lit("before")).unionByName(prep.count_infinities(prep.infinities_to_nan(rates(s, d), RC), RC).withColumn("stage", F.lit("after"))), f"SELECT 'before' AS stage, count(*) FILTER (isinf(rate)) AS rate, 0::BIGINT AS price FROM {RATES} UNION ALL SELECT 'after', 0, 0"),
        "clip_bounds": (rs(lambda s, d: prep.clip_bounds(rates(s, d), RC, F.col("train"))), rounded_sql("upper lower", f"SELECT 'rate' AS \"column\", u AS upper, l AS lower FROM {bounds} UNION ALL SELECT 'price', NULL, NULL")),
        "clip_apply": (clipped, rounded_sql("rate", f"SELECT l_orderkey, l_linenumber, train, CASE WHEN rate = 'Infinity'::DOUBLE THEN u WHEN rate = '-Infinity'::DOUBLE AND duration >= 0 THEN l ELSE rate END AS rate, duration, price, rate = '-Infinity'::DOUBLE AND duration < 0 AS invalid_negative_duration, rate = '-Infinity'::DOUBLE AND duration = 0 AS zero_duration FROM {RATES}, {bounds}", 4)),
        "constant_columns": (lambda s, d: prep.constant_columns(wide(s, d), wide_cols), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {'true' if c in ('one', 'none') else f'count(DISTINCT {src}) <= 1'} AS constant FROM orders" + (" GROUP BY ()" if c in ("one", "none") else "") for c, src in zip(wide_cols, ["o_custkey", "o_totalprice", "1", "o_totalprice", "o_custkey", "1", "o_orderpriority"], strict=True))),
        "duplicate_columns": (lambda s, d: prep.duplicate_columns(wide(s, d), wide_cols, ["o_orderkey"]), "SELECT 'price_copy' AS \"column\", 'o_totalprice' AS same_as UNION ALL SELECT 'cust_copy', 'o_custkey'"),
        "reserve_rejoin": (lambda s, d: (lambda m, x: m.join(x, "o_orderkey"))(*prep.reserve(read(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", ["o_custkey"])), "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"),
        "observation_group": (lambda s, d: scenario.counts(pred(s, d), "observation_group", "label"), f"SELECT observation_group, label, count(*) AS rows FROM {pred_sql()} GROUP BY ALL"),
        "label_inventory": (lambda s, d: scenario.counts(ev(s, d), "label").withColumn("is_attempted", sc.contains_ci(F.col("label"), "SIGN")), "SELECT event_type AS label, count(*) AS rows, event_type ILIKE '%sign%' AS is_attempted FROM events GROUP BY ALL"),
        "label_day_crosstab": (lambda s, d: scenario.counts(ev(s, d).withColumn("day", F.col("day").cast("string")), "label", "day"), f"SELECT label, day::VARCHAR AS day, count(*) AS rows FROM {EV} GROUP BY ALL"),
        "label_pivot": (lambda s, d: ev(s, d).groupBy("label").pivot("port", list(range(23))).count().na.fill(0).withColumnsRenamed({str(i): f"port_{i}" for i in range(23)}), f"SELECT label, {', '.join(f'count(*) FILTER (port = {i}) AS port_{i}' for i in range(23))} FROM {EV} GROUP BY 1"),
        "label_name_patterns": (lambda s, d: scenario.counts(groups_view(s, d).withColumn("label", F.concat("label", F.lit(" - Attempted"))), "label").select("label", *(c.alias(k) for k, c in sc.name_patterns(F.col("label")).items())), f"SELECT DISTINCT label || ' - Attempted' AS label, true AS attempt_suffix, false AS double_space, 2::BIGINT AS dash_parts FROM {GROUPS}"),
        "category_counts": (lambda s, d: scenario.counts(text_category(ev(s, d)), "category"), f"SELECT category::VARCHAR AS category, count(*) AS rows FROM {EV} GROUP BY ALL"),
        "label_category_crosstab": (lambda s, d: scenario.counts(text_category(ev(s, d)), "label", "category"), f"SELECT label, category::VARCHAR AS category, count(*) AS rows FROM {EV} GROUP BY ALL"),
        "sentinel_consistency": (lambda s, d: scenario.sentinel_check(ev(s, d).where("category is not null"), F.col("attempted"), "category"), f"SELECT 1::BIGINT AS n_other_categories, -1::BIGINT AS sentinel, count(*) FILTER (attempted) AS attempted_rows, count(*) FILTER (attempted AND category = -1) AS mismatches, false AS ambiguous FROM {EV} WHERE category IS NOT NULL"),
        "sentinel_examples": (lambda s, d: scenario.sentinel_examples(ev(s, d), F.col("attempted"), "category", 3, ["id"]), f"SELECT id, category FROM {EV} WHERE attempted AND category = 3 ORDER BY id LIMIT 20"),
        "shortcut_values": (lambda s, d: scenario.value_occurrences(ev(s, d), "port", [3, 7, 11], F.col("special"), F.col("benign")), f"{occ} FROM {EV} WHERE port IN (3, 7, 11) GROUP BY port"),
        "outside_shortcut": (lambda s, d: scenario.outside_values(ev(s, d), "port", [3, 7, 11], F.col("special")), f"SELECT count(*) FILTER (special) AS target_rows, count(*) FILTER (special AND port NOT IN (3, 7, 11)) AS outside_rows FROM {EV}"),
        "value_distribution": (rs(lambda s, d: scenario.top_values(ev(s, d).where("special"), "port")), rounded_sql("share", f"SELECT port AS value, rows, rows / total AS share FROM (SELECT port, count(*) AS rows, sum(count(*)) OVER () AS total FROM {EV} WHERE special GROUP BY port ORDER BY rows DESC, port LIMIT 20)")),
        "shortcut_scan": (rs(lambda s, d: scenario.shortcut_scan(ev(s, d).withColumn("flag", F.col("id") % 3), "label", ["port", "flag"])), rounded_sql("coverage", f"""WITH l AS (SELECT label, u.c AS "column", u.v AS value FROM (SELECT label, unnest([{{'c': 'port', 'v': port}}, {{'c': 'flag', 'v': id % 3}}]) AS u FROM {EV})), c AS (SELECT *, row_number() OVER (PARTITION BY label, "column" ORDER BY n DESC, value) AS nth FROM (SELECT label, "column", value, count(*) AS n FROM l GROUP BY ALL))
            SELECT *, top_rows::DOUBLE / rows AS coverage, top_rows::DOUBLE / rows >= 0.9 AS shortcut FROM (SELECT label, "column", sum(n) FILTER (nth <= 10)::BIGINT AS top_rows, sum(n)::BIGINT AS rows FROM c GROUP BY ALL)""")),
        "scenario_summary": (lambda s, d: scenario.scenario_summary(scenarios(s, d), F.col("benign")), f"SELECT scenario, count(*) AS rows, count(*) FILTER (benign) AS benign_rows, count(*) FILTER (NOT benign) AS attack_rows, count(DISTINCT label) FILTER (NOT benign) AS attack_labels FROM {SCEN} GROUP BY 1"),
        "scenario_label_counts": (lambda s, d: scenario.counts(scenarios(s, d), "scenario", "label"), f"SELECT scenario, label, count(*) AS rows FROM {SCEN} GROUP BY ALL"),
        "labels_dropped": (lambda s, d: scenario.labels_dropped(scenarios(s, d)), f"SELECT b.scenario, a.label FROM (SELECT DISTINCT label FROM {SCEN} WHERE scenario = 'S0') a, (SELECT DISTINCT scenario FROM {SCEN}) b EXCEPT SELECT DISTINCT scenario, label FROM {SCEN}"),
        "below_min_groups": (below_min, f"SELECT scenario, count(*) AS strata_below_min FROM (SELECT scenario, day, label, count(DISTINCT port) AS n FROM {SCEN} GROUP BY ALL) WHERE n < 20 GROUP BY 1"),
        "benign_contamination": (rs(lambda s, d: scenario.contamination(ev(s, d), F.col("port") == 3, F.col("benign"))), rounded_sql("ratio", f"SELECT *, benign_shortcut_rows / benign_rows AS ratio, benign_shortcut_rows / benign_rows > 0.001 AS stop FROM (SELECT count(*) FILTER (port = 3 AND benign) AS benign_shortcut_rows, count(*) FILTER (benign) AS benign_rows FROM {EV})")),
        "candidate_denominators": (lambda s, d: scenario.denominators(ev(s, d), {"all_rows": F.lit(True), "special": F.col("special"), "special_or_attempted": F.col("special") | F.col("attempted"), "not_benign": ~F.col("benign")}), f"SELECT count(*) AS all_rows, count(*) FILTER (special) AS special, count(*) FILTER (special OR attempted) AS special_or_attempted, count(*) FILTER (NOT benign) AS not_benign FROM {EV}"),
        "codebook_conformance": (lambda s, d: scenario.codebook(ev(s, d), "category", {3: F.col("id") % 7 == 3, 4: F.col("port") < 9}), f"SELECT code, rows, obeying, matching_anywhere FROM (SELECT category AS code, count(*) AS rows, count(*) FILTER (CASE category WHEN 3 THEN id % 7 = 3 ELSE port < 9 END) AS obeying FROM {EV} WHERE category IN (3, 4) GROUP BY 1) JOIN (SELECT 3 AS code, count(*) FILTER (id % 7 = 3) AS matching_anywhere FROM {EV} UNION ALL SELECT 4, count(*) FILTER (port < 9) FROM {EV}) USING (code)"),
        "protocol_map": (lambda s, d: scenario.counts(ev(s, d).select(sc.code_map(F.element_at(F.array(*map(F.lit, (0, 1, 6, 17))), (F.col("id") % 4 + 1).cast("int")), sc.PROTOCOLS).alias("protocol")), "protocol"), "SELECT ['UNKNOWN', 'ICMP', 'TCP', 'UDP'][event_id % 4 + 1] AS protocol, count(*) AS rows FROM events GROUP BY 1"),
        "group_hash_parse": (lambda s, d: ev(s, d).select("id", sc.extract_group_hash(F.format_string("g_%016x_0", F.col("id") * 7919)).alias("hash")), "SELECT event_id AS id, (event_id * 7919)::VARCHAR AS hash FROM events"),
        "column_profile": (rs(lambda s, d: profile.column_profile(read(s, d, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_partkey"])), rounded_sql("min max zero_ratio", " UNION ALL ".join(_profile_sql("lineitem", c) for c in ("l_quantity", "l_discount", "l_tax", "l_partkey")))),
        "mode_ratio": (rs(lambda s, d: profile.mode_ratio(read(s, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])), rounded_sql("mode_ratio", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", max(n) AS mode_rows, sum(n)::BIGINT AS rows, max(n)::DOUBLE / sum(n) AS mode_ratio FROM (SELECT count(*) AS n FROM lineitem GROUP BY {c})" for c in ("l_quantity", "l_discount", "l_tax")))),
        "spearman_nonzero": (rs(lambda s, d: profile.spearman(read(s, d, "lineitem"), "l_quantity", "l_extendedprice", (F.col("l_discount") != 0) & (F.col("l_tax") != 0))), rounded_sql("rho", "SELECT count(*) AS n, corr(ra, rb) AS rho FROM (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS ra, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS rb FROM lineitem WHERE l_discount <> 0 AND l_tax <> 0)")),
        "identity_checks": (rs(lambda s, d: profile.identities(read(s, d, "lineitem"), {"sum": (F.col("l_quantity") + F.col("l_discount"), F.col("l_discount") + F.col("l_quantity")), "greatest": (F.greatest(F.col("l_discount"), F.col("l_tax")), F.col("l_tax")), "product": (F.col("l_extendedprice") * F.col("l_discount"), F.col("l_extendedprice") * F.col("l_tax"))})), rounded_sql("match_share max_abs_diff max_rel_diff", " UNION ALL ".join((ident("sum", "l_quantity + l_discount", "l_discount + l_quantity"), ident("greatest", "greatest(l_discount, l_tax)", "l_tax"), ident("product", "l_extendedprice * l_discount", "l_extendedprice * l_tax"))))),
        "wrap16": (rs(lambda s, d: profile.wrap16(read(s, d, "lineitem"), F.col("l_quantity") * 2000 - 60000, F.col("l_quantity"))), rounded_sql("median_unwrapped", "SELECT count(*) AS n, count(*) FILTER (l_quantity * 2000 - 60000 < 0) AS n_negative, quantile_cont((l_quantity * 2000 - 60000 + 65536) / l_quantity, 0.5) FILTER (l_quantity * 2000 - 60000 < 0) AS median_unwrapped, count(*) FILTER (l_quantity * 2000 - 60000 > 32767) AS n_near_limit FROM lineitem")),
        "set_equivalence": (lambda s, d: profile.equivalence(ev(s, d), F.col("attempted"), F.col("category") >= 0), f"SELECT *, only_a = 0 AND only_b = 0 AS equivalent FROM (SELECT count(*) FILTER (attempted) AS n_a, count(*) FILTER (category >= 0) AS n_b, count(*) FILTER (attempted AND NOT category >= 0) AS only_a, count(*) FILTER (category >= 0 AND NOT attempted) AS only_b FROM {EV})"),
        "validation_checks": (checks, CHECKS),
        "ood_knn": (lambda s, d: rounded(profile.nearest_distance(read(s, d, "embeddings"), knn_q(s, d)), 6), rounded_sql("mean_distance nearest", "SELECT q, avg(d) AS mean_distance, min(d) AS nearest FROM (SELECT a.vec_id AS q, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS nth FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) WHERE nth <= 5 GROUP BY q", 6)),
        "ood_mahalanobis": (lambda s, d: rounded(profile.diagonal_mahalanobis(read(s, d, "embeddings")), 6), rounded_sql("distance", """WITH l AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), st AS (SELECT label, i, avg(x) AS m, var_pop(x) + 1e-6 AS v FROM l GROUP BY ALL),
            dd AS (SELECT vec_id, st.label, sqrt(sum((x - m) * (x - m) / v)) AS d FROM l JOIN st USING (i) GROUP BY ALL) SELECT vec_id, min(d) AS distance FROM dd GROUP BY 1""", 6)),
        "ood_gate_overlap": (lambda s, d: profile.equivalence(target(s, d), F.col("confidence") <= 0.55, F.col("id") % 10 == 3), f"SELECT *, only_a = 0 AND only_b = 0 AS equivalent FROM (SELECT count(*) FILTER (confidence <= 0.55) AS n_a, count(*) FILTER (id % 10 = 3) AS n_b, count(*) FILTER (confidence <= 0.55 AND id % 10 <> 3) AS only_a, count(*) FILTER (confidence > 0.55 AND id % 10 = 3) AS only_b FROM {pred_sql(where=chr(39).join(['observation_group = ', 'none', '']))})"),
        "latency_percentiles": (rs(lambda s, d: read(s, d, "events").agg(F.count("*").alias("n"), *(F.percentile("value", F.lit(p)).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)))), rounded_sql("p50 p95 p99", "SELECT count(*) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM events")),
        "union_distinct_keys": (lambda s, d: groups_view(s, d).where("label = 'NO'").select(*KEY).union(groups_view(s, d).where("label = 'RF'").select(*KEY)).distinct().agg(F.count("*").alias("n")), f"SELECT count(*) AS n FROM (SELECT l_partkey, l_quantity FROM {GROUPS} WHERE label = 'NO' UNION SELECT l_partkey, l_quantity FROM {GROUPS} WHERE label = 'RF')"),
        "composite_membership": (lambda s, d: groups.leakage(groups_view(s, d), KEY, F.col("day") > 4, F.col("is_benign")).drop("seen_ratio"), f"""WITH r AS (SELECT *, day > 4 AS is_test FROM {GROUPS}), tr AS (SELECT * FROM r WHERE NOT is_test), te AS (SELECT * FROM r WHERE is_test)
            SELECT (SELECT count(*) FROM (SELECT 1 FROM r GROUP BY l_partkey, l_quantity HAVING bool_or(is_test) AND bool_or(NOT is_test))) AS crossing_groups, (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM r GROUP BY l_partkey, l_quantity HAVING bool_or(is_test) AND bool_or(NOT is_test))) AS crossing_rows, count(*) AS test_rows,
            count(*) FILTER ((l_partkey, l_quantity) IN (SELECT (l_partkey, l_quantity) FROM tr)) AS seen_rows, count(*) FILTER ((l_partkey, l_quantity, label) IN (SELECT (l_partkey, l_quantity, label) FROM tr)) AS same_label_rows, count(*) FILTER ((l_partkey, l_quantity, is_benign) IN (SELECT (l_partkey, l_quantity, NOT is_benign) FROM tr)) AS opposite_label_rows FROM te"""),
    }
