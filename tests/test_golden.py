"""Small cases with known results."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import PythonException  # noqa: F401

from riskgauge.functions import scalars as sc
from riskgauge.operators import groups, learn, prep, profile, risk, scenario, splits, validate
from riskgauge.sources import artifacts, flows
from riskgauge.streaming import budgets

INF, NAN = float("inf"), float("nan")


def table(spark, conf, err, y=(0, 0, 1, 1), p=(0, 1, 1, 0)):
    data = [(i, float(c), e, y[i], p[i]) for i, (c, e) in enumerate(zip(conf, err, strict=True))]
    return spark.createDataFrame(data, "id long, confidence double, is_error int, binary_label int, predicted int")


def one(df):
    return df.collect()[0].asDict()


def test_ties_share_their_risk_and_order_does_not_matter(spark):
    t = table(spark, [0.9, 0.8, 0.8, 0.6], [0, 0, 1, 1])
    a = one(risk.aurc(t))
    assert a["aurc"] == pytest.approx(0.2708333333333333, abs=1e-12)
    assert one(risk.aurc(t.orderBy(F.desc("id")))) == a
    assert a["oracle_aurc"] <= a["aurc"] and a["random_aurc"] == 0.5


def test_curve_ends_at_full_coverage(spark):
    c = risk.risk_curve(table(spark, [0.9, 0.8, 0.8, 0.6], [0, 0, 1, 1])).orderBy("n_accepted").collect()
    assert [(r["n_accepted"], r["expected_errors_accepted"]) for r in c] == [(1, 0.0), (3, 1.0), (4, 2.0)] and c[-1]["coverage"] == 1.0


def test_budget_never_splits_a_tie(spark):
    b = {r["target_rate"]: r for r in risk.budget_metrics(table(spark, [0.51, 0.51, 0.9, 0.95], [1, 0, 0, 0]), risk.budgets(spark, (0.25, 0.5))).collect()}
    assert b[0.25]["n_abstained"] == 0 and b[0.25]["confidence_threshold"] is None and b[0.25]["threshold_reason"] == "confidence_resolution_insufficient" and b[0.25]["next_tie_rate"] == 0.5
    assert b[0.5]["n_abstained"] == 2 and b[0.5]["error_capture"] == 1.0 and b[0.5]["threshold_reason"] is None


def test_fixed_threshold(spark):
    f = one(risk.fixed_threshold_metrics(table(spark, [0.51, 0.6, 0.9, 0.95], [1, 0, 0, 0]), spark.sql("SELECT 0.5D AS target_rate, 0.6D AS threshold")))
    assert (f["n_abstained"], f["row_delta"], f["within_band"]) == (2, 0, True)


def test_no_errors_and_one_class_give_nulls(spark):
    t = table(spark, [0.9, 0.8], [0, 0], (0, 0), (0, 0))
    assert one(risk.aurc(t))["relative_improvement"] is None
    b = one(risk.budget_metrics(t, risk.budgets(spark, (0.5,))))
    assert b["error_capture"] is None and b["enrichment"] is None and b["residual_fnr"] is None


def test_many_confidences_run_in_buckets(spark):
    t = spark.range(3000).select(F.col("id"), (1 - 0.5 / (F.col("id") * F.col("id") + 1)).alias("confidence"), (F.col("id") % 3 == 0).cast("int").alias("is_error"), F.lit(0).alias("binary_label"), F.lit(0).alias("predicted"))
    got = one(risk.aurc(t))["aurc"]
    rows = sorted(t.select("confidence", "is_error").collect(), key=lambda r: -r[0])
    e = total = 0.0
    blocks = {}
    for c, x in rows:
        m, q = blocks.get(c, (0, 0))
        blocks[c] = (m + 1, q + x)
    k0 = e = 0
    for c in sorted(blocks, reverse=True):
        m, q = blocks[c]
        total += sum((e + j * q / m) / (k0 + j) for j in range(1, m + 1))
        k0, e = k0 + m, e + q
    assert got == pytest.approx(total / 3000, abs=1e-12)


def test_bad_scores_are_errors(spark):
    for bad in (1.5, -0.1, NAN, None):
        df = spark.createDataFrame([(bad, 1)], "p double, binary_label int")
        with pytest.raises(Exception, match="outside"):
            risk.predictions(df).collect()


def test_verdicts(spark):
    seeds = spark.createDataFrame([(43, 18, 0.02, 1.0), (44, 20, 0.5, 1.0), (45, 350, 0.01, 1.0)], "seed int, errors long, aurc double, random_aurc double")
    v = {r["seed"]: r for r in risk.rank_verdict(seeds, 0.01).collect()}
    assert v[44]["seed_verdict"] == "failed" and v[43]["verdict"] == "inconclusive"
    few = seeds.withColumn("errors", F.lit(3))
    assert {r["verdict"] for r in risk.rank_verdict(few, 0.01).collect()} == {"inconclusive"}
    band = spark.createDataFrame([(1, True), (1, True), (2, True), (2, False), (3, False), (3, False)], "seed int, within_band boolean")
    assert {(r["seed"], r["seed_verdict"], r["verdict"]) for r in risk.throughput_verdict(band).collect()} == {(1, "maintained", "inconclusive"), (2, "inconclusive", "inconclusive"), (3, "failed", "inconclusive")}


def test_protocol_codes(spark):
    df = spark.createDataFrame([(6,), (17,), (1,), (0,)], "c int")
    assert [r[0] for r in df.select(sc.code_map(F.col("c"), sc.PROTOCOLS)).collect()] == ["TCP", "UDP", "ICMP", "UNKNOWN"]
    with pytest.raises(Exception, match="unexpected code"):
        spark.createDataFrame([(99,)], "c int").select(sc.code_map(F.col("c"), sc.PROTOCOLS)).collect()


def test_nan_and_infinity_are_equal_as_keys(spark):
    df = spark.createDataFrame([(NAN, 1.0), (NAN, 1.0), (INF, 2.0)], "a double, b double")
    assert groups.repeated_values(df, ["a", "b"]).count() == 1


def test_class_overlap(spark):
    df = spark.createDataFrame([(INF, "BENIGN", "mon"), (INF, "Attack", "tue"), (3.0, "BENIGN", "mon"), (3.0, "BENIGN", "mon")], "rate double, label string, day string")
    f = groups.group_facts(df, ["rate"], F.col("label") == "BENIGN")
    s = one(groups.duplicate_scope(f))
    assert (s["duplicate_groups"], s["duplicate_rows"], s["conflict_groups"], s["conflict_rows"], s["cross_day_groups"]) == (2, 4, 1, 2, 1)
    assert [r["days"] for r in groups.conflict_day_combinations(f).collect()] == ["mon+tue"]
    assert one(groups.collisions(df, F.lit(99), ["rate"]))["collisions"] == 1


def test_first_fit_hits_the_target(spark):
    g = spark.createDataFrame([("A", 1, 2), ("A", 2, 2), ("A", 3, 1), ("A", 4, 1)], "label string, k long, size long")
    t = spark.createDataFrame([("A", 3)], "label string, target long")
    chosen = {r["k"] for r in splits.first_fit(g, t, "label", ["k"]).collect()}
    assert sum({1: 2, 2: 2, 3: 1, 4: 1}[k] for k in chosen) == 3


def test_first_fit_overshoots_only_if_closer(spark):
    g = spark.createDataFrame([("A", 1, 5), ("B", 2, 9)], "label string, k long, size long")
    t = spark.createDataFrame([("A", 4), ("B", 4)], "label string, target long")
    assert [r["k"] for r in splits.first_fit(g, t, "label", ["k"]).collect()] == [1]


def test_conflict_choice_is_the_best_subset():
    m = {"g10": [10, 2], "g20": [0, 8]}
    assert splits.choose_conflict_groups(m, [0, 8]) == {"g20"}
    many = {f"g{i}": [i % 3, 1] for i in range(40)}
    chosen = splits.choose_conflict_groups(many, [10, 10])
    assert sum(many[k][1] for k in chosen) in range(8, 13)


def test_leakage(spark):
    df = spark.createDataFrame([(1, "B", False), (1, "B", True), (2, "B", False), (2, "A", True), (3, "A", True)], "h long, label string, t boolean")
    s = one(groups.leakage(df, ["h"], F.col("t"), F.col("label") == "B"))
    assert (s["crossing_groups"], s["seen_rows"], s["same_label_rows"], s["opposite_label_rows"]) == (2, 2, 1, 1)


def test_stratified_rows_are_deterministic(spark):
    df = spark.createDataFrame([("A", i) for i in range(8)] + [("B", i + 8) for i in range(4)], "label string, id long")
    a = splits.stratified_rows(df, "label", ["id"], 0.25).where("is_test").collect()
    assert sorted(r["label"] for r in a) == ["A", "A", "B"]
    assert {r["id"] for r in a} == {r["id"] for r in splits.stratified_rows(df.repartition(7), "label", ["id"], 0.25).where("is_test").collect()}


def test_group_split_keeps_groups_whole(spark):
    df = spark.range(400).select((F.col("id") % 130).alias("k"), F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("label"), "id")
    m = splits.marked(df, splits.group_split(df, ["k"]), ["k"])
    c = one(splits.crossings(m, ["k"]))
    assert c["crossing_groups"] == 0 and 70 <= c["test_rows"] <= 130


def test_observation_groups(spark):
    df = spark.createDataFrame([("BENIGN",), ("Portscan",), ("DoS Hulk",), ("DoS Hulk - Attempted",)], "l string")
    assert [r[0] for r in df.select(sc.flow_observation_group(F.col("l"))).collect()] == ["none", "none", "invalid_class", "attempted"]
    assert [r[0] for r in df.select(sc.is_target(F.col("l"))).collect()] == [True, True, False, False]


def test_dedup(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, "b", "y"), (5, None, "x"), (6, None, "x")], "id long, k string, label string")
    assert [r["id"] for r in prep.exact_dedup(df, ["id"], ["id"]).orderBy("id").collect()] == [1, 3, 4, 5]
    got = {r["id"]: r["label_conflict"] for r in prep.relaxed_dedup(df, ["k"], "label", ["id"]).collect()}
    assert got == {1: False, 3: True, 4: True, 5: False, 6: False}


def test_clipping_ignores_what_is_not_train(spark):
    base = [(True, float(i), 1.0) for i in range(1, 101)]
    df = spark.createDataFrame(base + [(False, INF, 1.0), (False, -INF, -1.0), (False, -INF, 0.0), (False, 1e9, 1.0)], "train boolean, r double, d double")
    b = one(prep.clip_bounds(df, ["r"], F.col("train")))
    assert b["upper"] == pytest.approx(3 * 99.901) and b["lower"] == pytest.approx(3 * 1.099)
    flagged = prep.negative_infinity_flags(df, ["r"], "d")
    out = prep.apply_clip(flagged, prep.clip_bounds(df, ["r"], F.col("train")), ["r"], "invalid_negative_duration")
    rows = [(r["d"], r["r"]) for r in out.where("not train").collect()]
    assert (-1.0, -INF) in rows and (0.0, b["lower"]) in rows and (1.0, b["upper"]) in rows


def test_column_pruning(spark):
    df = spark.createDataFrame([(1, 5, 1.0, 1.0, None), (2, 5, 2.0, 2.0, None), (3, 5, NAN, NAN, None)], "id long, c int, a double, b double, n string")
    assert {r["column"] for r in prep.constant_columns(df, ["c", "a", "n"]).where("constant").collect()} == {"c", "n"}
    assert [tuple(r) for r in prep.duplicate_columns(df, ["c", "a", "b"], ["id"]).collect()] == [("b", "a")]
    assert prep.numeric_columns(df, ["id"]) == ["c", "a", "b"] and prep.prunable_columns(df, ["id"]) == ["c", "a", "b", "n"]


@pytest.mark.parametrize("n,want", [(10, {"train": 6, "calib": 2, "test": 2}), (3, {"test": 3})])
def test_time_cut(spark, n, want):
    g = spark.createDataFrame([(f"g{i}", "mon", "A", i, 1) for i in range(n)], "group_id string, day string, attack_label string, rep_time int, n_flows_in_group int")
    s = splits.time_cut(g, ["day", "attack_label"], ["rep_time", "group_id"])
    assert {r["split"]: r["count"] for r in s.groupBy("split").count().collect()} == want


def test_leave_out_does_not_add_up(spark):
    g = spark.createDataFrame([("A", "train", "train"), ("B", "calib", "calib"), ("C", "test", "test")], "attack_label string, split string, original_split string")
    twice = splits.leave_out(splits.leave_out(g, ["A"]), ["B"])
    assert [r["split"] for r in twice.orderBy("attack_label").collect()] == ["train", "test", "test"]


def test_checks_roll_up(spark):
    g = spark.createDataFrame([("g1", "mon", "A", "train"), ("g1", "mon", "A", "test"), ("g2", "mon", "B", "train")], "group_id string, day string, attack_label string, split string")
    c = {r["name"]: r for r in validate.run_all(validate.crossing_groups(g), validate.one_sided(g, ["day", "attack_label"]), validate.key_absent(spark, {}, "x")).collect()}
    assert not c["group_in_one_split"]["passed"] and not c["split_skew"]["passed"] and c["manifest_key_absent"]["passed"] and not c["split_skew"]["all_passed"]
    ok = validate.run_all(validate.one_sided(g, ["day", "attack_label"]), validate.left_out_absent(g, ["Z"]))
    assert all(r["all_passed"] for r in ok.collect())


def test_scenarios_without_codes(spark):
    df = spark.createDataFrame([("x", True, False, -1), ("y", False, True, 2), ("z", False, False, -1)], "label string, s boolean, a boolean, c int")
    s = scenario.with_scenarios(df, scenario.scenario_names(F.col("s"), F.col("a"), F.col("c"), None))
    assert {r["scenario"]: r["count"] for r in s.groupBy("scenario").count().collect()} == {"S0": 3, "S1": 2, "S3": 1, "S4": 2}


def test_profile_sees_missing_and_infinite(spark):
    df = spark.createDataFrame([(1.0,), (NAN,), (INF,), (None,), (0.0,)], "a double")
    r = one(profile.column_profile(df, ["a"]))
    assert (r["n_missing"], r["n_infinite"], r["min"], r["max"], r["whole_numbers"]) == (2, 1, 0.0, 1.0, True)


def test_flow_files(spark, tmp_path):
    for day, rows in (("monday", ["1,a,6,2017-07-03 08:00:00.000001,0.5,BENIGN", "2,,17,2017-07-03 08:00:01.000000,Infinity,X"]), ("tuesday", ["1,c,6,2017-07-04 08:00:00.000000,1.5,BENIGN"])):
        (tmp_path / f"{day}.csv").write_text("\n".join(["id,Flow ID,Protocol,Timestamp,Rate,Label", *rows]) + "\n")
    paths = [str(tmp_path / f"{d}.csv") for d in ("monday", "tuesday")]
    assert flows.read_header(spark, paths[0])[-1] == "Label" and flows.header_mismatches(spark, paths) == {}
    m = flows.merged_days(spark, paths)
    assert {r["row_uid"] for r in m.collect()} == {"monday_1", "monday_2", "tuesday_1"}
    assert [r["Flow ID"] for r in m.where("row_uid = 'monday_2'").collect()] == [""]
    assert artifacts.data_rows(spark, paths[0]) == 2
    a = m.select("day", "id", "Label", F.lit("train").alias("split"))
    assert flows.aligned(m, a, ["day", "id"]).count() == 3
    with pytest.raises(Exception, match="doesn't fit"):
        flows.aligned(m, a.where("id = 1"), ["day", "id"]).collect()


def test_columns_and_whitelists(tmp_path):
    assert flows.resolve_column(["Flow Bytes/s", "Label"], "bytes", "FLOW") == "Flow Bytes/s"
    with pytest.raises(flows.ColumnResolutionError):
        flows.resolve_column(["a1", "a2"], "a")
    (tmp_path / "w.json").write_text(json.dumps({"include": ["Protocol", "A"], "exclude": {"B": {"code": "NO_IMPACT"}}}))
    w = flows.load_whitelist(str(tmp_path / "w.json"))
    w.check(["A", "B", "Protocol"], 2)
    for bad in (["A", "B"], ["A", "B", "C", "Protocol"]):
        with pytest.raises(ValueError):
            w.check(bad)


def test_artifacts(spark, tmp_path):
    with pytest.raises(ValueError):
        artifacts.write_json(str(tmp_path / "x.json"), {"a": NAN})
    df = spark.createDataFrame([(1, 0.1, "m", "mon")], "id long, p double, method string, day string")
    back = artifacts.write_verified(df, str(tmp_path / "p"))
    assert back.count() == 1
    artifacts.write_assignments(df, str(tmp_path / "a"))
    with pytest.raises(Exception, match="(?i)exist"):
        artifacts.write_assignments(df, str(tmp_path / "a"))
    (tmp_path / "out").mkdir()
    (tmp_path / "out/f.txt").write_text("hello")
    m = artifacts.output_manifest(str(tmp_path / "out"))
    assert m["files"] == {"f.txt": "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"}
    assert artifacts.missing_artifacts(str(tmp_path / "out"), ["f.txt"], ["{method}.csv"], ["m"]) == ["m.csv"]
    d = artifacts.file_digests(spark, str(tmp_path / "out/f.txt")).select(F.lit("f").alias("name"), "sha256")
    artifacts.require(artifacts.integrity(d, {"f": m["files"]["f.txt"]}))
    with pytest.raises(ValueError, match="f"):
        artifacts.require(artifacts.integrity(d, {"f": "0"}))
    assert "original_download_date" not in artifacts.dataset_manifest({"mon": str(tmp_path / "out/f.txt")}, str(tmp_path))


def test_experiment_settings():
    raw = {"exp_id": "e", "output_dir": "o", "seeds": [1, 2], "budgets": [0.01, 0.05], "test_fraction": 0.25}
    assert artifacts.Experiment.of(raw).threshold == 0.5
    for bad in ({**raw, "more": 1}, {k: v for k, v in raw.items() if k != "seeds"}, {**raw, "budgets": [0.05, 0.01]}, {**raw, "seeds": [1, 1]}):
        with pytest.raises(ValueError):
            artifacts.Experiment.of(bad)


def test_label_seed_and_harmonic(spark):
    assert sc.label_seed(0, "a") == int.from_bytes(bytes.fromhex("ca978112"), "little")
    got = spark.range(1, 400, 37).select("id", sc.harmonic(F.col("id")).alias("h")).collect()
    assert all(r["h"] == pytest.approx(sum(1 / i for i in range(1, r["id"] + 1)), abs=1e-13) for r in got)


def test_calibration_and_search(spark):
    rows = spark.range(400).select("id", (F.col("id") % 20 / 20.0).alias("x"), ((F.col("id") * 7919) % 400 / 400.0 < F.col("id") % 20 / 20.0).cast("int").alias("binary_label"))
    history, best = learn.search(rows.where("id % 4 > 0"), rows.where("id % 4 = 0"), ["x"], [{"rounds": 2, "depth": 2}, {"rounds": 3, "depth": 3}])
    assert history.count() == 2 and best in ({"rounds": 2, "depth": 2}, {"rounds": 3, "depth": 3})
    p = rows.withColumn("p", F.col("x"))
    for fit in (learn.platt, learn.isotonic):
        out = fit(p)(p).agg(F.min("calibrated").alias("a"), F.max("calibrated").alias("b")).first()
        assert 0 <= out["a"] <= out["b"] <= 1


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    pred = spark.range(500).select((F.timestamp_seconds(F.col("id") * 7)).alias("ts"), (0.5 + F.col("id") % 50 / 100).alias("confidence"), (F.col("id") % 9 == 0).cast("int").alias("is_error"))
    end = spark.sql("SELECT timestamp_seconds(999999) AS ts, 0.9D AS confidence, 0 AS is_error")
    pred.write.parquet(str(src))
    end.write.mode("append").parquet(str(src))
    q = budgets.start_counts(spark.readStream.schema(pred.schema).parquet(str(src)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = budgets.sliced_counts(pred)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert budgets.sliced_budgets(got, 0.1).count() == want.select("slice").distinct().count()
