"""Queries for evidence tables (B*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from statewell.common import materialise
from statewell.operators import evidence as b
from statewell.operators.contracts import BENCH_COLUMNS
from statewell.plans import inputs as src
from statewell.plans.inputs import BENCH, FIRST, SECOND
from statewell.plans.registry import query, rounded, table

RULES = b.Rules(draws="mix")

METRIC3 = ["shared_recovery_error", "exclusive_leakage", "projection_error"]


def exact(spark, sf, split="calibration"):
    return b.exact_rows(src.bench_rows(spark, sf).filter(F.col("split") == split))


GRID = """grid AS (SELECT f, s, n, row_number() OVER (ORDER BY f, s, n) AS canonical_index FROM
             (SELECT DISTINCT l_returnflag AS f FROM lineitem), (SELECT DISTINCT l_linestatus AS s FROM lineitem),
             (SELECT DISTINCT l_linenumber AS n FROM lineitem))"""


@query("b1_grid_strata", f"WITH {GRID} SELECT f AS l_returnflag, s AS l_linestatus, n AS l_linenumber, canonical_index FROM grid")
def b1(spark, sf):
    return b.grid_from_table(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query(
    "b2_task_table",
    """WITH grid AS (SELECT f, n, row_number() OVER (ORDER BY f, n) AS canonical_index FROM
             (SELECT DISTINCT l_returnflag AS f FROM lineitem), (SELECT DISTINCT l_linenumber AS n FROM lineitem))
       SELECT s_suppkey AS seed, canonical_index, f AS l_returnflag, n AS l_linenumber,
              sha256('{"l_linenumber":' || n || ',"l_returnflag":"' || f || '","seed":' || s_suppkey || '}') AS task_key
       FROM grid, supplier""",
)
def b2(spark, sf):
    fields = ["l_returnflag", "l_linenumber"]
    seeds = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("seed"))
    return b.task_table(b.grid_from_table(table(spark, sf, "lineitem"), fields), seeds, fields)


@query(
    "b3_seed_split",
    """SELECT l_orderkey, l_linenumber, l_suppkey AS seed, CASE WHEN s_nationkey < 13 THEN 'calibration'
              WHEN s_nationkey < 24 THEN 'holdout' END AS split FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
)
def b3(spark, sf):
    seeds = table(spark, sf, "supplier").filter("s_nationkey < 24").select(
        F.col("s_suppkey").alias("seed"), F.when(F.col("s_nationkey") < 13, "calibration").otherwise("holdout").alias("split")
    )
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("seed"))
    return b.seed_split(rows, seeds)


@query(
    "b4_eligibility",
    f"""WITH {BENCH} SELECT candidate, bool_and(NOT (candidate = '{FIRST}' AND ln = 7)) AS eligible, count(*) AS n_rows
        FROM bench GROUP BY candidate""",
)
def b4(spark, sf):
    broken = (F.col("candidate") == FIRST) & (F.col("ln") == 7)
    rows = src.bench_rows(spark, sf)
    rows = rows.withColumn("gate_observed", F.when(broken, "failure").otherwise(F.col("gate_observed")))
    return b.eligibility(rows.withColumn("gate_passed", ~broken))


@query(
    "b5_metric_violations",
    f"""WITH {BENCH} SELECT 'metric_not_finite' AS "check", candidate || '|' || stratum_digest || '|' || seed AS key, m AS detail
        FROM (SELECT *, unnest(['shared_recovery_error', 'response_recovery_error', 'exclusive_leakage', 'projection_error']) AS m
              FROM bench) WHERE projection_case = 'missing_id'""",
)
def b5(spark, sf):
    return b.metric_violations(src.bench_rows(spark, sf))


EXACT = f"{BENCH}, ex AS MATERIALIZED (SELECT * FROM bench WHERE split = 'calibration' AND projection_case = 'exact_ids')"
MEANS = """pm AS (SELECT candidate, stratum_digest, avg(shared_recovery_error) AS a, avg(exclusive_leakage) AS b, avg(projection_error) AS c
             FROM ex GROUP BY ALL), sm AS (SELECT candidate, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM pm GROUP BY candidate)"""


@query(
    "b6_stratum_means",
    f"""WITH {EXACT}, {MEANS} SELECT candidate, round(a, 9) AS shared_recovery_error, round(b, 9) AS exclusive_leakage,
        round(c, 9) AS projection_error FROM sm""",
)
def b6(spark, sf):
    return rounded(b.stratum_means(exact(spark, sf), METRIC3), 9, *METRIC3)


PAIRS = f"""pr AS MATERIALIZED (SELECT stratum_digest, seed, count(*) FILTER (WHERE candidate = '{FIRST}') AS n_first,
             count(*) FILTER (WHERE candidate = '{SECOND}') AS n_second,
             max(CASE WHEN candidate = '{FIRST}' THEN shared_recovery_error END) -
             max(CASE WHEN candidate = '{SECOND}' THEN shared_recovery_error END) AS difference FROM ex GROUP BY ALL)"""


@query(
    "b7_paired_differences",
    f"WITH {EXACT}, {PAIRS} SELECT stratum_digest, seed, n_first, n_second, round(difference, 9) + 0.0 AS difference FROM pr",
)
def b7(spark, sf):
    return rounded(b.paired_differences(exact(spark, sf), "shared_recovery_error", FIRST, SECOND), 9, "difference")


@query(
    "b7_unpaired",
    f"""WITH {EXACT}, x AS (SELECT * FROM ex WHERE ln <> 3 OR candidate = '{FIRST}')
        SELECT 'unpaired' AS "check", stratum_digest || '|' || seed AS key, '1/0' AS detail FROM x GROUP BY stratum_digest, seed HAVING count(*) = 1""",
)
def b7_bad(spark, sf):
    rows = exact(spark, sf).filter((F.col("ln") != 3) | (F.col("candidate") == FIRST))
    return b.unpaired_violations(b.paired_differences(rows, "shared_recovery_error", FIRST, SECOND))


BOOT = """ls AS (SELECT stratum_digest, list(difference ORDER BY seed) AS v, count(*) AS n FROM pr GROUP BY stratum_digest),
       bm AS (SELECT stratum_digest, rep, avg(v[1 + i]) AS m
              FROM (SELECT stratum_digest, v, rep, (((y * y) % 2147483647 + y * 48271 + 104729) % 2147483647) % n AS i FROM
                (SELECT *, (x * x % 2147483647 + x * 48271 + 104729) % 2147483647 AS y FROM
                  (SELECT *, (11001 * 48271 + k % 2147483647 + rep * 69621 + d * 104729) % 2147483647 AS x FROM
                    (SELECT stratum_digest, v, n, CAST(('0x' || substr(md5(stratum_digest), 1, 8)) AS BIGINT) AS k, rep, unnest(range(n)) AS d
                     FROM ls, (SELECT unnest(range(10000)) AS rep))))) GROUP BY ALL),
       be AS (SELECT rep, avg(m) AS e FROM bm GROUP BY rep),
       ci AS (SELECT quantile_cont(e, 0.025) AS ci_lower, quantile_cont(e, 0.975) AS ci_upper FROM be)"""


@query(
    "b8_paired_bootstrap_interval",
    f"WITH {EXACT}, {PAIRS}, {BOOT} SELECT round(ci_lower, 9) + 0.0 AS ci_lower, round(ci_upper, 9) + 0.0 AS ci_upper FROM ci",
)
def b8(spark, sf):
    pairs = b.paired_differences(exact(spark, sf), "shared_recovery_error", FIRST, SECOND)
    return rounded(b.paired_bootstrap_interval(pairs, 10_000, 11001, "mix"), 9, "ci_lower", "ci_upper")


@query(
    "b9_median_ratio",
    f"""WITH {EXACT} SELECT round(median(elapsed_sec) FILTER (WHERE candidate = '{FIRST}') /
        median(elapsed_sec) FILTER (WHERE candidate = '{SECOND}'), 9) AS ratio FROM ex""",
)
def b9(spark, sf):
    return rounded(b.median_ratio(exact(spark, sf), "elapsed_sec", FIRST, SECOND), 9, "ratio")


@query(
    "b10_select_candidate",
    f"""WITH {EXACT}, {MEANS}, {PAIRS}, {BOOT},
       d AS (SELECT max(CASE WHEN candidate = '{FIRST}' THEN a END) - max(CASE WHEN candidate = '{SECOND}' THEN a END) AS a,
                    max(CASE WHEN candidate = '{FIRST}' THEN b END) - max(CASE WHEN candidate = '{SECOND}' THEN b END) AS b,
                    max(CASE WHEN candidate = '{FIRST}' THEN c END) - max(CASE WHEN candidate = '{SECOND}' THEN c END) AS c FROM sm),
       r AS (SELECT median(elapsed_sec) FILTER (WHERE candidate = '{FIRST}') /
                    median(elapsed_sec) FILTER (WHERE candidate = '{SECOND}') AS ratio FROM ex),
       k AS (SELECT TRUE AS both_eligible, a <= -0.03 AS shared_advantage, ci_upper < 0 AS shared_ci_below_zero,
                    b <= 0.02 AS leakage_not_worse, c <= 0.02 AS projection_not_worse, ratio <= 1.5 AS elapsed_within_limit,
                    a, b, c, ratio, ci_lower, ci_upper FROM d, r, ci)
       SELECT TRUE AS first_eligible, TRUE AS second_eligible, round(a, 8) + 0.0 AS shared_difference, round(ci_lower, 8) + 0.0 AS shared_ci_lower,
              round(ci_upper, 8) + 0.0 AS shared_ci_upper, round(b, 8) + 0.0 AS leakage_difference, round(c, 8) + 0.0 AS projection_difference,
              round(ratio, 8) + 0.0 AS elapsed_ratio, both_eligible, shared_advantage, shared_ci_below_zero, leakage_not_worse,
              projection_not_worse, elapsed_within_limit,
              CASE WHEN shared_advantage AND shared_ci_below_zero AND leakage_not_worse AND projection_not_worse AND elapsed_within_limit
                   THEN '{FIRST}' ELSE '{SECOND}' END AS selected_candidate, 'selected' AS decision FROM k""",
)
def b10(spark, sf):
    rows = src.bench_rows(spark, sf).filter("split = 'calibration'")
    out = b.select_candidate(rows, FIRST, SECOND, RULES)
    return rounded(
        out, 8, "shared_difference", "shared_ci_lower", "shared_ci_upper", "leakage_difference", "projection_difference", "elapsed_ratio"
    )


@query(
    "b10_refusals",
    f"""WITH {EXACT}, cal AS (SELECT * FROM bench WHERE split = 'calibration')
        SELECT 'other_split' AS "check", '' AS key, count(*) || ' rows' AS detail FROM cal WHERE ln = 3 HAVING count(*) > 0
        UNION ALL SELECT 'other_tier', '', count(*) || ' rows' FROM cal WHERE ln = 2 HAVING count(*) > 0
        UNION ALL SELECT 'mixed_generator', '', 'more than one value' FROM cal WHERE ln = 1 HAVING count(*) > 0
        UNION ALL SELECT 'other_candidate', 'C3', count(*) || ' rows' FROM cal WHERE ln = 4 AND candidate = '{SECOND}' HAVING count(*) > 0
        UNION ALL SELECT 'metric_not_finite', CASE WHEN ln = 4 AND candidate = '{SECOND}' THEN 'C3' ELSE candidate END || '|' || stratum_digest || '|' || seed,
               'projection_error' FROM ex WHERE ln = 5
        UNION ALL SELECT 'unpaired', stratum_digest || '|' || seed, '1/0' FROM ex WHERE ln = 4 AND candidate = '{FIRST}'""",
)
def b10_bad(spark, sf):
    """Planted faults, one a line number: split, tier, an identity that is partly null, candidate and pairs, a value that is not finite."""
    rows, line = src.bench_rows(spark, sf).filter("split = 'calibration'"), F.col("ln")
    rows = rows.withColumns(
        {
            "split": F.when(line == 3, "holdout").otherwise(F.col("split")),
            "tier": F.when(line == 2, "development").otherwise(F.col("tier")),
            "generator": F.when(line == 1, F.lit(None)).otherwise(F.col("generator")),
            "candidate": F.when((line == 4) & (F.col("candidate") == SECOND), "C3").otherwise(F.col("candidate")),
            "projection_error": F.when(line == 5, F.lit(float("nan"))).otherwise(F.col("projection_error")),
        }
    )
    return b.selection_violations(rows, FIRST, SECOND)


HOLD = f"""{BENCH}, ho AS MATERIALIZED (SELECT * FROM bench WHERE split = 'holdout' AND candidate = '{FIRST}'),
       ix AS (SELECT DISTINCT stratum, (strpos('ANR', regexp_extract(stratum, 'flag = (.)', 1)) - 1) * 7 + ln AS k FROM ho),
       lg AS MATERIALIZED (SELECT stratum_digest, stratum, projection_case, shared_signal, noise_sd, seed, k,
              unnest(['shared_recovery_error', 'response_recovery_error', 'exclusive_leakage', 'projection_error', 'elapsed_sec', 'peak_vcells_bytes']) AS metric,
              unnest([shared_recovery_error, response_recovery_error, exclusive_leakage, projection_error, elapsed_sec, peak_vcells_bytes]) AS value
              FROM ho JOIN ix USING (stratum) WHERE projection_case = 'exact_ids'),
       vs AS (SELECT stratum_digest, stratum, projection_case, shared_signal, noise_sd, metric, k, list(value ORDER BY seed) AS v,
                     count(*) AS n, median(value) AS estimate FROM lg GROUP BY ALL)"""

HOLD_BOOT = """bb AS (SELECT stratum_digest, metric, rep, median(v[1 + i]) AS m
              FROM (SELECT stratum_digest, metric, v, rep, ((y * y % 2147483647 + y * 48271 + 104729) % 2147483647) % n AS i FROM
                (SELECT *, (x * x % 2147483647 + x * 48271 + 104729) % 2147483647 AS y FROM
                  (SELECT *, ((11002 + k) * 48271 + mark % 2147483647 + rep * 69621 + d * 104729) % 2147483647 AS x FROM
                    (SELECT stratum_digest, metric, v, n, k, CAST(('0x' || substr(md5(stratum_digest || '|' || metric), 1, 8)) AS BIGINT) AS mark,
                            rep, unnest(range(n)) AS d FROM vs, (SELECT unnest(range(10000)) AS rep))))) GROUP BY ALL),
       bc AS (SELECT stratum_digest, metric, quantile_cont(m, 0.025) AS ci_lower, quantile_cont(m, 0.975) AS ci_upper FROM bb GROUP BY ALL),
       su AS MATERIALIZED (SELECT stratum_digest, stratum, projection_case, shared_signal, noise_sd, metric, estimate, ci_lower, ci_upper, n
              FROM vs JOIN bc USING (stratum_digest, metric)
              UNION ALL SELECT stratum_digest, stratum, projection_case, shared_signal, noise_sd, 'typed_control_pass_rate',
                     avg(CASE WHEN gate_observed = 'typed_failure' THEN 1.0::DOUBLE ELSE 0 END), NULL, NULL, count(*) FROM ho
              WHERE projection_case = 'missing_id' GROUP BY ALL)"""


def holdout(spark, sf):
    """Holdout rows, kept because checks and statistics read them several times, and the frozen index."""
    rows = src.bench_rows(spark, sf).filter((F.col("split") == "holdout") & (F.col("candidate") == FIRST))
    return materialise(rows.select(*[c for c in rows.columns if c in BENCH_COLUMNS])), src.frozen_index(spark).drop("line")


@query(
    "b11_b12_holdout_summary",
    f"""WITH {HOLD}, {HOLD_BOOT} SELECT stratum_digest, stratum, projection_case, shared_signal, noise_sd, metric, round(estimate, 7) AS estimate,
        round(ci_lower, 7) AS ci_lower, round(ci_upper, 7) AS ci_upper, n FROM su""",
)
def b11(spark, sf):
    return rounded(b.holdout_summary(*holdout(spark, sf), FIRST, RULES), 7, "estimate", "ci_lower", "ci_upper")


@query(
    "b11_refusals",
    f"""WITH {HOLD}
        SELECT 'failed_gate' AS "check", candidate || '|' || stratum_digest || '|' || seed AS key, 'failure' AS detail FROM ho WHERE ln = 7
        UNION ALL SELECT DISTINCT 'stratum_outside_grid', stratum_digest, stratum FROM ho WHERE ln = 6
        UNION ALL SELECT 'metric_not_finite', candidate || '|' || stratum_digest || '|' || seed, 'elapsed_sec' FROM ho
                  WHERE ln = 5 AND projection_case = 'exact_ids'
        UNION ALL SELECT 'other_candidate', '', count(*) || ' rows' FROM bench WHERE split = 'holdout' AND candidate <> '{FIRST}' HAVING count(*) > 0
        UNION ALL SELECT 'failed_gate', candidate || '|' || stratum_digest || '|' || seed, 'failure' FROM bench
                  WHERE split = 'holdout' AND candidate <> '{FIRST}' AND ln = 7
        UNION ALL SELECT 'metric_not_finite', candidate || '|' || stratum_digest || '|' || seed, 'elapsed_sec' FROM bench
                  WHERE split = 'holdout' AND candidate <> '{FIRST}' AND ln = 5 AND projection_case = 'exact_ids'
        UNION ALL SELECT DISTINCT 'stratum_outside_grid', stratum_digest, stratum FROM bench
                  WHERE split = 'holdout' AND candidate <> '{FIRST}' AND ln = 6 AND stratum_digest NOT IN (SELECT stratum_digest FROM ho)""",
)
def b11_bad(spark, sf):
    """Planted faults: gates of line 7, strata of line 6 left out of the grid, times of line 5 infinite, the other candidate."""
    rows, line = src.bench_rows(spark, sf).filter("split = 'holdout'"), F.col("ln")
    rows = rows.withColumns(
        {
            "gate_observed": F.when(line == 7, "failure").otherwise(F.col("gate_observed")),
            "elapsed_sec": F.when(line == 5, F.lit(float("inf"))).otherwise(F.col("elapsed_sec")),
        }
    )
    index = src.frozen_index(spark).filter("line != 6").drop("line")
    return b.holdout_violations(rows, index, FIRST)


@query("b12_holdout_summary_full")
def b12(spark, sf):
    """The declared 10 000 resamples with counter-based draws."""
    return rounded(b.holdout_summary(*holdout(spark, sf), FIRST, b.Rules()), 7, "estimate", "ci_lower", "ci_upper")


REQUIRED = """rq AS (SELECT stratum_digest, metric, estimate, CASE metric WHEN 'shared_recovery_error' THEN 0.25 ELSE 0.30 END AS lim
             FROM {t} WHERE projection_case = 'exact_ids' AND shared_signal = 24 AND noise_sd = 1
             AND metric IN ('shared_recovery_error', 'projection_error'))"""


@query(
    "b13_accept_holdout",
    f"""WITH {HOLD}, {REQUIRED.format(t='vs')}, per AS (SELECT stratum_digest, count(*) AS c, bool_and(estimate <= lim) AS ok FROM rq GROUP BY 1)
        SELECT count(*) AS required_strata, coalesce(bool_and(c = 2), FALSE) AS required_complete, TRUE AS all_gates_passed,
               coalesce(bool_and(c = 2 AND ok), FALSE) AS thresholds_passed,
               CASE WHEN coalesce(bool_and(c = 2 AND ok), FALSE) THEN 'accepted' ELSE 'failed' END AS decision FROM per""",
)
def b13(spark, sf):
    rows, index = holdout(spark, sf)
    return b.accept_holdout(b.holdout_estimates(rows, index, FIRST, RULES), rows, RULES)


@query(
    "b14_worst_medians",
    f"""WITH {HOLD}, {REQUIRED.format(t='vs')} SELECT metric, count(DISTINCT stratum_digest) AS exact_id_strata, round(max(estimate), 9) AS worst_median,
        max(lim)::DOUBLE AS threshold, bool_and(estimate <= lim) AS all_strata_pass FROM rq GROUP BY metric""",
)
def b14(spark, sf):
    return rounded(b.worst_medians(b.holdout_estimates(*holdout(spark, sf), FIRST, RULES), RULES), 9, "worst_median")


@query(
    "b15_parse_stratum",
    rf"""WITH {BENCH} SELECT candidate, seed, stratum, CAST(regexp_extract(stratum, 'K = ([0-9]+)', 1) AS INTEGER) AS "K",
        regexp_matches(stratum, 'missing_block_rate = 0\.[1-9]') AS missing_block,
        'signal ' || shared_signal || ' / noise ' || noise_sd AS signal_noise,
        CASE WHEN shared_signal = 24 AND noise_sd = 1 THEN 'decisive' WHEN shared_signal = 24 THEN 'high signal, high noise'
             WHEN noise_sd = 1 THEN 'low signal, low noise' ELSE 'low signal, high noise' END AS emphasis FROM bench""",
)
def b15(spark, sf):
    out = b.parse_stratum(src.bench_rows(spark, sf))
    return out.select("candidate", "seed", "stratum", "K", "missing_block", "signal_noise", "emphasis")


@query(
    "b16_run_inventory",
    f"""WITH {BENCH} SELECT count(DISTINCT stratum_digest || '|' || seed) AS completed_tasks, count(*) AS result_rows,
        count(*) FILTER (WHERE elapsed_sec > 30) AS failed_gate_rows FROM bench""",
)
def b16(spark, sf):
    return b.run_inventory(src.bench_rows(spark, sf).withColumn("gate_passed", F.col("elapsed_sec") <= 30))


@query(
    "b17_progress",
    """WITH l AS (SELECT count(*) FILTER (WHERE l_linestatus = 'F') AS c, count(*) FILTER (WHERE l_linestatus = 'O' AND l_returnflag = 'A') AS f,
                         count(*) AS t FROM lineitem)
       SELECT c AS completed, f AS failed, t AS total, round(c / t, 9) AS proportion, round(c / 4000.5, 9) AS rate_per_sec,
              round((t - c) / (c / 4000.5), 6) AS eta_sec,
              CASE WHEN e >= 3600 THEN printf('%dh %02dm %02ds', e // 3600, e % 3600 // 60, e % 60) ELSE printf('%dm %02ds', e // 60, e % 60) END AS eta_text
       FROM (SELECT *, CAST(round_even((t - c) / (c / 4000.5), 0) AS BIGINT) AS e FROM l)""",
)
def b17(spark, sf):
    status = F.when(F.col("l_linestatus") == "F", "complete").when(F.col("l_returnflag") == "A", "failed").otherwise("running")
    li = table(spark, sf, "lineitem")
    out = b.progress(li.select("l_orderkey"), li.select(status.alias("status")), 4000.5)
    return rounded(rounded(out, 9, "proportion", "rate_per_sec"), 6, "eta_sec")


@query(
    "b18_log_violations",
    """WITH t AS (SELECT o_orderkey AS k FROM orders), l AS (SELECT l_orderkey AS k, l_linestatus = 'F' AS ok FROM lineitem),
       g AS (SELECT k, count(*) AS n FROM l GROUP BY k)
       SELECT CASE WHEN n IS NULL THEN 'task_missing' ELSE 'task_repeated' END AS "check", CAST(t.k AS VARCHAR) AS key,
              CAST(coalesce(n, 0) AS VARCHAR) AS detail FROM t LEFT JOIN g USING (k) WHERE n IS NULL OR n > 1
       UNION ALL SELECT 'task_incomplete', CAST(k AS VARCHAR), 'failed' FROM l WHERE NOT ok""",
)
def b18(spark, sf):
    tasks = table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_key"))
    log = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("task_key"), F.when(F.col("l_linestatus") == "F", "complete").otherwise("failed").alias("status")
    )
    return b.log_violations(tasks, log)


@query(
    "b19_wrong_split_or_tier",
    f"""WITH {BENCH} SELECT 'other_split' AS "check", '' AS key, count(*) || ' rows' AS detail FROM bench WHERE split <> 'holdout' HAVING count(*) > 0
        UNION ALL SELECT 'other_tier', '', count(*) || ' rows' FROM bench WHERE ln = 2 HAVING count(*) > 0""",
)
def b19(spark, sf):
    from statewell.operators.contracts import bench_violations

    rows = src.bench_rows(spark, sf).withColumn("tier", F.when(F.col("ln") == 2, "development").otherwise("full"))
    return bench_violations(rows, "holdout", None, "full")
