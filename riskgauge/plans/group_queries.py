"""Exact-group and split queries and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import row_hash, shuffled
from ..operators import groups, splits
from ..session import settled
from .views import GROUPS, KEY, groups_view, read, rounded, rounded_sql

K = ", ".join(KEY)
FACTS = f"""(SELECT {K}, count(*) AS group_size, count(DISTINCT label) AS n_labels, count(*) FILTER (is_benign) AS benign_rows, count(*) FILTER (NOT is_benign) AS attack_rows,
  list_sort(list_distinct(list(day))) AS days, (count(*) FILTER (is_benign) > 0)::BIGINT + (count(*) FILTER (NOT is_benign) > 0)::BIGINT AS n_binary_labels FROM {GROUPS} GROUP BY {K})"""


def facts(s, d):
    return groups.group_facts(groups_view(s, d), KEY, F.col("is_benign"))


def md5_sql(seed: int, cols: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {cols}))"


def rowsplit(s, d, seed: int = 42):
    return splits.stratified_rows(groups_view(s, d), "label", ["id"], 0.25, seed)


def rowsplit_sql(seed: int = 42) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY label ORDER BY {md5_sql(seed, 'id')}, id) <= round_even(count(*) OVER (PARTITION BY label) * 0.25, 0) AS is_test FROM {GROUPS})"


def key_md5() -> str:
    # the key's second column is a double with whole values, which Spark writes with a decimal
    return "l_partkey, printf('%.1f', l_quantity)"


def groupsplit_sql(seed: int = 42, src: str = GROUPS) -> str:
    """Test keys: whole multi-label groups by signature, then first fit by a plain fold over all groups of two or more."""
    m = md5_sql(seed, key_md5())
    return f"""(WITH g AS (SELECT {K}, label, count(*) AS n FROM {src} GROUP BY ALL),
      per AS (SELECT {K}, count(*) AS n_labels, sum(n)::BIGINT AS size, min(label) AS label, array_to_string(list_sort(list(label || '=' || n)), ',') AS sig, {m} AS o FROM g GROUP BY {K}),
      conflict AS (SELECT {K} FROM (SELECT {K}, row_number() OVER (PARTITION BY sig ORDER BY o, {K}) <= round_even(count(*) OVER (PARTITION BY sig) * 0.25, 0) AS t FROM per WHERE n_labels > 1) WHERE t),
      targets AS (SELECT label, greatest(goal - coalesce(used, 0), 0)::BIGINT AS target FROM (SELECT label, round_even(sum(n) * 0.25, 0) AS goal FROM g GROUP BY label) LEFT JOIN (SELECT label, sum(n) AS used FROM g SEMI JOIN conflict USING ({K}) GROUP BY label) USING (label)),
      multi AS (SELECT label, list({{'o': o, 'a': l_partkey, 'b': l_quantity, 's': size}} ORDER BY o, {K}) AS xs FROM per WHERE n_labels = 1 AND size >= 2 GROUP BY label),
      fold AS (SELECT label, target, list_reduce(list_transform(xs, lambda x: {{'left': 0::BIGINT, 'x': x, 'got': []::BIGINT[]}}), lambda acc, e, i: {{'left': CASE WHEN e.x.s <= acc.left THEN acc.left - e.x.s ELSE acc.left END, 'x': e.x, 'got': CASE WHEN e.x.s <= acc.left THEN list_append(acc.got, i) ELSE acc.got END}},
        {{'left': target, 'x': {{'o': '', 'a': 0::BIGINT, 'b': 0.0::DOUBLE, 's': 0::BIGINT}}, 'got': []::BIGINT[]}}) AS f, xs FROM targets JOIN multi USING (label)),
      picked AS (SELECT label, xs[unnest(f.got)] AS x FROM fold),
      lft AS (SELECT label, coalesce(f.left, target) AS r FROM targets LEFT JOIN (SELECT label, f FROM fold) USING (label)),
      single AS (SELECT label, {K}, nth FROM (SELECT label, {K}, row_number() OVER (PARTITION BY label ORDER BY o, {K}) AS nth FROM per WHERE n_labels = 1 AND size = 1) JOIN lft USING (label) WHERE nth <= r),
      miss AS (SELECT label, r - count(nth) AS r FROM lft LEFT JOIN single USING (label) GROUP BY label, r),
      over_ AS (SELECT {K} FROM (SELECT {K}, row_number() OVER (PARTITION BY label ORDER BY size, o, {K}) AS nth FROM per JOIN miss USING (label) WHERE n_labels = 1 AND size >= 2 AND r > 0 AND size - r < r AND ({K}) NOT IN (SELECT (x.a, x.b) FROM picked)) WHERE nth = 1)
      SELECT {K} FROM conflict UNION ALL SELECT x.a, x.b FROM picked UNION ALL SELECT {K} FROM single UNION ALL SELECT {K} FROM over_)"""


def marked(s, d, seed: int = 42):
    rows = groups_view(s, d)
    return splits.marked(rows, splits.group_split(rows, KEY, seed=seed), KEY)


def marked_sql(seed: int = 42) -> str:
    return f"(SELECT r.*, t.l_partkey IS NOT NULL AS is_test FROM {GROUPS} r LEFT JOIN {groupsplit_sql(seed)} t ON r.l_partkey = t.l_partkey AND r.l_quantity = t.l_quantity)"


SEEDS = (43, 44, 45)


def seed_sets(s, d):
    """The test groups of each seed's split."""
    rows = groups_view(s, d)
    return reduce(DataFrame.unionByName, (splits.group_split(rows, KEY, seed=k).withColumn("seed", F.lit(k)) for k in SEEDS))


SEED_SETS = "(" + " UNION ALL ".join(f"SELECT *, {k} AS seed FROM {groupsplit_sql(k)}" for k in SEEDS) + ")"


def outer_train(s, d):
    rows = groups_view(s, d)
    return rows.join(settled(splits.group_split(rows, KEY)), KEY, "left_anti")


DAY = 86_400


def tgroups(s, d):
    e = read(s, d, "events")
    return splits.time_groups(e, [F.col("user_id"), F.col("event_type")], F.col("event_type"), F.date_format("ts", "yyyy-MM-dd"), "ts", DAY)


TGROUPS = f"""(SELECT md5(concat_ws('|', user_id, event_type, (floor(epoch(ts) / {DAY}))::BIGINT)) AS group_id, arg_min(strftime(ts, '%Y-%m-%d'), ts) AS day, arg_min(event_type, ts) AS attack_label, min(ts) AS rep_time, count(*) AS n_flows_in_group FROM events GROUP BY 1)"""
TCUT = f"""(SELECT * EXCLUDE (nth, n), CASE WHEN n < 10 THEN 'test' WHEN nth < floor(n * 0.6) THEN 'train' WHEN nth < floor(n * 0.6) + floor(n * 0.2) THEN 'calib' ELSE 'test' END AS split, n < 10 AS below_min FROM (
  SELECT *, row_number() OVER (PARTITION BY day, attack_label ORDER BY rep_time, group_id) - 1 AS nth, count(*) OVER (PARTITION BY day, attack_label) AS n FROM {TGROUPS}))"""


def tcut(s, d):
    return splits.time_cut(tgroups(s, d), ["day", "attack_label"], ["rep_time", "group_id"])


def text_time(df):
    return df.withColumn("rep_time", F.date_format("rep_time", "yyyy-MM-dd HH:mm:ss"))


def entries() -> dict:
    gv = groups_view
    rs = lambda f: (lambda s, d: rounded(f(s, d)))
    dup = f"(SELECT * FROM {FACTS} WHERE group_size >= 2)"
    conflict = f"(SELECT r.*, f.group_size FROM {GROUPS} r JOIN {FACTS} f ON r.l_partkey = f.l_partkey AND r.l_quantity = f.l_quantity WHERE f.n_binary_labels > 1)"
    bins = "CASE WHEN group_size <= 4 THEN group_size::VARCHAR WHEN group_size <= 10 THEN '5-10' WHEN group_size <= 100 THEN '11-100' ELSE '>100' END"
    leak = f"""WITH r AS (SELECT * FROM {rowsplit_sql()}), g AS (SELECT {K}, bool_or(is_test) AND bool_or(NOT is_test) AS crossing, bool_or(NOT is_test) AS in_train, bool_or(NOT is_test AND is_benign) AS tb, bool_or(NOT is_test AND NOT is_benign) AS ta, count(*) AS n FROM r GROUP BY {K}),
        l AS (SELECT {K}, label, bool_or(NOT is_test) AS in_train_label FROM r GROUP BY ALL)
        SELECT *, seen_rows::DOUBLE / test_rows AS seen_ratio FROM (SELECT (SELECT count(*) FROM g WHERE crossing) AS crossing_groups, (SELECT coalesce(sum(n), 0)::BIGINT FROM g WHERE crossing) AS crossing_rows, count(*) AS test_rows,
        count(*) FILTER (in_train) AS seen_rows, count(*) FILTER (in_train_label) AS same_label_rows, count(*) FILTER (CASE WHEN is_benign THEN ta ELSE tb END) AS opposite_label_rows FROM r JOIN g USING ({K}) JOIN l USING ({K}, label) WHERE is_test)"""
    per_label = lambda src: f"SELECT *, test_rows / (train_rows + test_rows) AS test_ratio, abs(test_rows / (train_rows + test_rows) - 0.25) AS deviation FROM (SELECT label, count(*) FILTER (NOT is_test) AS train_rows, count(*) FILTER (is_test) AS test_rows FROM {src} GROUP BY label)"
    cross = lambda src: f"SELECT count(*) AS groups, count(*) FILTER (t > 0 AND t < n) AS crossing_groups, sum(t)::BIGINT AS test_rows, (sum(n) - sum(t))::BIGINT AS train_rows FROM (SELECT count(*) FILTER (is_test) AS t, count(*) AS n FROM {src} GROUP BY {K})"
    tcut_sql = f"SELECT * REPLACE (strftime(rep_time, '%Y-%m-%d %H:%M:%S') AS rep_time), split AS original_split FROM {TCUT}"
    train = f"(SELECT * EXCLUDE (is_test) FROM {marked_sql()} WHERE NOT is_test)"
    return {
        "group_label_counts": (lambda s, d: groups.group_labels(gv(s, d), KEY), f"SELECT {K}, label, count(*) AS rows FROM {GROUPS} GROUP BY ALL"),
        "group_summary": (lambda s, d: facts(s, d).drop("days"), f"SELECT * EXCLUDE (days) FROM {FACTS}"),
        "duplicate_scope_summary": (lambda s, d: groups.duplicate_scope(facts(s, d)), f"""SELECT count(*) AS duplicate_groups, sum(group_size)::BIGINT AS duplicate_rows, count(*) FILTER (n_binary_labels <= 1) AS match_groups, coalesce(sum(group_size) FILTER (n_binary_labels <= 1), 0)::BIGINT AS match_rows,
            count(*) FILTER (n_binary_labels > 1) AS conflict_groups, coalesce(sum(group_size) FILTER (n_binary_labels > 1), 0)::BIGINT AS conflict_rows, count(*) FILTER (len(days) = 1) AS within_day_groups, count(*) FILTER (len(days) > 1) AS cross_day_groups, count(*) FILTER (n_labels > 1) AS multi_label_groups, max(group_size) AS largest_group FROM {dup}"""),
        "duplicate_scope_by_target": (lambda s, d: groups.duplicate_scope(groups.group_facts(gv(s, d).where("label <> 'RF'"), KEY, F.col("is_benign"))).withColumn("scope", F.lit("target")).unionByName(groups.duplicate_scope(facts(s, d)).withColumn("scope", F.lit("full"))).select("scope", "duplicate_groups", "duplicate_rows", "conflict_groups", "conflict_rows"),
            " UNION ALL ".join(f"SELECT '{n}' AS scope, count(*) AS duplicate_groups, sum(group_size)::BIGINT AS duplicate_rows, count(*) FILTER (n_binary_labels > 1) AS conflict_groups, coalesce(sum(group_size) FILTER (n_binary_labels > 1), 0)::BIGINT AS conflict_rows FROM {src} WHERE group_size >= 2" for n, src in (("full", FACTS), ("target", FACTS.replace(f"FROM {GROUPS}", f"FROM (SELECT * FROM {GROUPS} WHERE label <> 'RF')"))))),
        "group_size_histogram": (lambda s, d: groups.size_histogram(facts(s, d)), f"SELECT v.b AS size_bin, coalesce(n_groups, 0) AS n_groups, coalesce(n_rows, 0)::BIGINT AS n_rows FROM (VALUES ('2'), ('3'), ('4'), ('5-10'), ('11-100'), ('>100')) AS v(b) LEFT JOIN (SELECT {bins} AS b, count(*) AS n_groups, sum(group_size) AS n_rows FROM {dup} GROUP BY 1) x USING (b)"),
        "conflict_label_distribution": (lambda s, d: groups.conflict_labels(gv(s, d), KEY, facts(s, d)), f"SELECT label, count(*) AS rows FROM {conflict} GROUP BY 1"),
        "conflict_day_combos": (lambda s, d: groups.conflict_day_combinations(facts(s, d)), f"SELECT array_to_string(days, '+') AS days, count(*) AS n_groups, sum(group_size)::BIGINT AS n_rows FROM {FACTS} WHERE n_binary_labels > 1 GROUP BY 1"),
        "top_conflict_groups": (lambda s, d: groups.top_conflicts(facts(s, d), KEY), f"SELECT {K}, group_size, n_labels, benign_rows, attack_rows FROM {FACTS} WHERE n_binary_labels > 1 ORDER BY group_size DESC, l_partkey DESC, l_quantity DESC LIMIT 20"),
        "conflict_group_sample": (lambda s, d: groups.conflict_sample(gv(s, d), KEY, facts(s, d), per_group=20), f"""SELECT {K}, label, day, id, group_size, rank FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY nth = 1 DESC, label, day, id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY {K}, label ORDER BY day, id) AS nth FROM {conflict})) WHERE rank <= 20"""),
        "label_group_stats": (rs(lambda s, d: groups.label_statistics(gv(s, d), KEY, facts(s, d))), rounded_sql("largest_ratio", f"""SELECT *, largest_group_rows::DOUBLE / rows AS largest_ratio, largest_group_rows <= rows * 0.25 AS feasible FROM (SELECT label, sum(n)::BIGINT AS rows, count(*) AS groups, count(*) FILTER (group_size >= 2) AS duplicate_groups, count(*) FILTER (n_binary_labels > 1) AS conflict_groups, max(n) AS largest_group_rows
            FROM (SELECT {K}, label, count(*) AS n FROM {GROUPS} GROUP BY ALL) JOIN {FACTS} USING ({K}) GROUP BY label)""")),
        "stable_group_ids": (lambda s, d: groups.stable_ids(gv(s, d), KEY, ["day", "id"]), f"SELECT {K}, printf('fg_%010d', row_number() OVER (ORDER BY f.day, f.id) - 1) AS group_id FROM (SELECT {K}, min({{'day': day, 'id': id}}) AS f FROM {GROUPS} GROUP BY {K})"),
        "repeated_keys": (lambda s, d: groups.repeated_values(gv(s, d), KEY), f"SELECT {K}, count(*) AS n FROM {GROUPS} GROUP BY {K} HAVING count(*) >= 2"),
        "candidate_rows": (lambda s, d: groups.candidate_rows(gv(s, d), KEY), f"SELECT * FROM {GROUPS} WHERE ({K}) IN (SELECT ({K}) FROM {GROUPS} GROUP BY {K} HAVING count(*) >= 2)"),
        "hash_collisions": (lambda s, d: groups.collisions(gv(s, d), row_hash(*map(F.col, KEY)), KEY), f"SELECT count(*) AS n_hashes, 0::BIGINT AS collisions FROM (SELECT DISTINCT {K} FROM {GROUPS})"),
        "forced_collisions": (lambda s, d: groups.collisions(gv(s, d), F.col("l_partkey") % 97, KEY), f"SELECT count(*) AS n_hashes, (sum(n) - count(*))::BIGINT AS collisions FROM (SELECT l_partkey % 97 AS h, count(DISTINCT (l_partkey, l_quantity)) AS n FROM {GROUPS} GROUP BY 1)"),
        "document_duplicates": (lambda s, d: groups.duplicate_scope(groups.group_facts(read(s, d, "documents"), ["text"], F.col("source") == "src0", "source", "lang")), """WITH f AS (SELECT text, count(*) AS g, count(DISTINCT source) AS l, count(DISTINCT lang) AS dd, bool_or(source = 'src0') AND bool_or(source <> 'src0') AS c FROM documents GROUP BY text HAVING count(*) >= 2)
            SELECT count(*) AS duplicate_groups, coalesce(sum(g), 0)::BIGINT AS duplicate_rows, count(*) FILTER (NOT c) AS match_groups, coalesce(sum(g) FILTER (NOT c), 0)::BIGINT AS match_rows, count(*) FILTER (c) AS conflict_groups, coalesce(sum(g) FILTER (c), 0)::BIGINT AS conflict_rows, count(*) FILTER (dd = 1) AS within_day_groups, count(*) FILTER (dd > 1) AS cross_day_groups, count(*) FILTER (l > 1) AS multi_label_groups, coalesce(max(g), 0) AS largest_group FROM f"""),
        "seed_overlap_jaccard": (rs(lambda s, d: groups.overlap_of_sets(seed_sets(s, d), "seed", KEY)), rounded_sql("jaccard", f"""WITH m AS (SELECT * FROM {SEED_SETS}), n AS (SELECT seed, count(*) AS c FROM m GROUP BY seed), p AS (SELECT a.seed AS a, b.seed AS b, a.c AS n_a, b.c AS n_b FROM n a, n b WHERE a.seed < b.seed)
            SELECT a, b, n_a, n_b, common, common::DOUBLE / (n_a + n_b - common) AS jaccard FROM (SELECT p.*, (SELECT count(*) FROM m x JOIN m y ON x.l_partkey = y.l_partkey AND x.l_quantity = y.l_quantity WHERE x.seed = p.a AND y.seed = p.b) AS common FROM p)""")),
        "row_random_split": (lambda s, d: rowsplit(s, d).select("id", "label", "is_test"), f"SELECT id, label, is_test FROM {rowsplit_sql()}"),
        "row_random_leakage": (rs(lambda s, d: groups.leakage(rowsplit(s, d), KEY, F.col("is_test"), F.col("is_benign"))), rounded_sql("seen_ratio", leak)),
        "row_random_crossings": (lambda s, d: splits.crossings(rowsplit(s, d), KEY), cross(rowsplit_sql())),
        "group_stratified_split": (lambda s, d: splits.group_split(gv(s, d), KEY), f"SELECT * FROM {groupsplit_sql()}"),
        "split_per_label": (rs(lambda s, d: splits.per_label(marked(s, d))), rounded_sql("test_ratio deviation", per_label(marked_sql()))),
        "split_crossings": (lambda s, d: splits.crossings(marked(s, d), KEY), cross(marked_sql())),
        "internal_validation": (rs(lambda s, d: splits.per_label(splits.marked(t := outer_train(s, d), splits.group_split(t, KEY, seed=1042), KEY))), rounded_sql("test_ratio deviation", per_label(f"(SELECT r.*, t.l_partkey IS NOT NULL AS is_test FROM {train} r LEFT JOIN {groupsplit_sql(1042, train)} t ON r.l_partkey = t.l_partkey AND r.l_quantity = t.l_quantity)"))),
        "conflict_assignment": (lambda s, d: marked(s, d).join(facts(s, d).where("n_binary_labels > 1").select(*KEY), KEY, "left_semi").groupBy(*KEY, "label", "is_test").agg(F.count("*").alias("rows")).withColumn("split", F.when(F.col("is_test"), "test").otherwise("train")).drop("is_test"),
            f"SELECT {K}, label, CASE WHEN is_test THEN 'test' ELSE 'train' END AS split, count(*) AS rows FROM {marked_sql()} SEMI JOIN (SELECT * FROM {FACTS} WHERE n_binary_labels > 1) USING ({K}) GROUP BY ALL"),
        "conflict_wide_table": (lambda s, d: groups.conflict_table(gv(s, d), KEY, facts(s, d), marked(s, d).select(*KEY, "is_test", F.lit("group").alias("method")).unionByName(rowsplit(s, d).select(*KEY, "is_test", F.lit("row").alias("method"))), ["group", "row"]),
            f"""WITH f AS (SELECT * FROM {FACTS} WHERE n_binary_labels > 1), l AS (SELECT {K}, array_to_string(list_sort(list(label || '=' || n)), ',') AS label_counts FROM (SELECT {K}, label, count(*) AS n FROM {GROUPS} GROUP BY ALL) GROUP BY {K}),
            a AS (SELECT {K}, CASE WHEN bool_and(is_test) THEN 'test' WHEN NOT bool_or(is_test) THEN 'train' ELSE 'crossing' END AS split_group FROM {marked_sql()} GROUP BY {K}), b AS (SELECT {K}, CASE WHEN bool_and(is_test) THEN 'test' WHEN NOT bool_or(is_test) THEN 'train' ELSE 'crossing' END AS split_row FROM {rowsplit_sql()} GROUP BY {K})
            SELECT {K}, group_size, benign_rows, attack_rows, label_counts, split_group, split_row FROM f JOIN l USING ({K}) JOIN a USING ({K}) JOIN b USING ({K})"""),
        "test_index": (lambda s, d: marked(s, d).where("is_test").select("day", "id", *KEY), f"SELECT day, id, {K} FROM {marked_sql()} WHERE is_test"),
        "split_verification": (lambda s, d: splits.verify(rowsplit(s, d), rowsplit(s, d, 43), KEY, ["day", "id"]), f"SELECT 0::BIGINT AS missing, 0::BIGINT AS unplanned, count(*) FILTER (a.is_test <> b.is_test) AS different, count(*) AS rows, 0::BIGINT AS duplicate_keys FROM {rowsplit_sql()} a JOIN {rowsplit_sql(43)} b USING (day, id)"),
        "split_label_summary": (lambda s, d: rowsplit(s, d).withColumn("method", F.lit("row")).unionByName(marked(s, d).select(*rowsplit(s, d).columns).withColumn("method", F.lit("group"))).groupBy("method", "is_test", "label").agg(F.count("*").alias("rows")), f"SELECT 'row' AS method, is_test, label, count(*) AS rows FROM {rowsplit_sql()} GROUP BY ALL UNION ALL SELECT 'group', is_test, label, count(*) FROM {marked_sql()} GROUP BY ALL"),
        "time_bucket_group_index": (lambda s, d: text_time(tgroups(s, d)), f"SELECT * REPLACE (strftime(rep_time, '%Y-%m-%d %H:%M:%S') AS rep_time) FROM {TGROUPS}"),
        "time_ratio_split": (lambda s, d: text_time(tcut(s, d)), tcut_sql),
        "split_summary_report": (lambda s, d: splits.split_report(tcut(s, d), ["day", "attack_label"]), f"SELECT day, attack_label, split, count(*) AS n_groups, sum(n_flows_in_group)::BIGINT AS n_flows, bool_or(below_min) AS below_min FROM {TCUT} GROUP BY ALL"),
        "split_skew": (lambda s, d: splits.skew(tcut(s, d), ["day", "attack_label"]), f"SELECT *, greatest(train, calib, test) = n AS one_sided FROM (SELECT day, attack_label, count(*) AS n, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'calib') AS calib, count(*) FILTER (split = 'test') AS test FROM {TCUT} GROUP BY ALL)"),
        "loao_mask": (lambda s, d: text_time(splits.leave_out(splits.leave_out(tcut(s, d), ["view"]), ["error"])), f"SELECT * REPLACE (strftime(rep_time, '%Y-%m-%d %H:%M:%S') AS rep_time, CASE WHEN attack_label = 'error' AND split IN ('train', 'calib') THEN 'test' ELSE split END AS split), split AS original_split FROM {TCUT}"),
        "stable_label_seed": (lambda s, d: gv(s, d).select("label").distinct().withColumn("seed", F.pmod(F.lit(42) + F.conv(F.concat(*(F.substring(F.sha2("label", 256), i, 2) for i in (7, 5, 3, 1))), 16, 10).cast("bigint"), F.lit(2**32))), "SELECT label, (42 + ('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT) % 4294967296 AS seed FROM (SELECT DISTINCT label, sha256(label) AS h FROM " + GROUPS + ")"),
        "shuffle_order": (lambda s, d: gv(s, d).select("id", shuffled(7, F.col("id")).alias("order")), f"SELECT id, {md5_sql(7, 'id')} AS \"order\" FROM {GROUPS}"),
    }

