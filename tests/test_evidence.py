import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statewell.common import ContractError
from statewell.operators import contracts as con, evidence as ev

C1, C2 = "C1_symmetric_consensus", "C2_block_scaled_svd"


def bench(spark, seeds, split, strata=("s1", "s2")):
    rows = []
    for stratum in strata:
        for seed in seeds:
            for cand in (C1, C2):
                rows.append(
                    dict(
                        candidate=cand, seed=seed, split=split, stratum_digest=stratum, stratum=f"list(K = 2L, {stratum})",
                        protocol_id="p", generator="g", protocol_digest="pd", generator_digest="gd", tier="full",
                        gate_expected="success", gate_observed="success", gate_passed=True, projection_case="exact_ids",
                        shared_signal=24.0, noise_sd=1.0, shared_recovery_error=0.10 if cand == C1 else 0.20,
                        response_recovery_error=0.1, exclusive_leakage=0.1, projection_error=0.1,
                        elapsed_sec=1.0 if cand == C1 else 1.1, peak_vcells_bytes=1.0,
                    )
                )
    return spark.createDataFrame(pd.DataFrame(rows))


RULES = ev.Rules(resamples=300)


def test_first_candidate_is_selected(spark):
    row = ev.select_candidate(bench(spark, (1001, 1002), "calibration"), C1, C2, RULES).first()
    assert row.selected_candidate == C1 and row.decision == "selected"
    assert all(row[c] for c in ("both_eligible", "shared_advantage", "shared_ci_below_zero", "elapsed_within_limit"))


@pytest.mark.parametrize("broken,want", [((C1,), C2), ((C1, C2), None)])
def test_failed_gates_fall_back(spark, broken, want):
    rows = bench(spark, (1001, 1002), "calibration")
    rows = rows.withColumn("gate_passed", ~F.col("candidate").isin(*broken))
    row = ev.select_candidate(rows, C1, C2, RULES).first()
    assert row.selected_candidate == want
    assert row.decision == ("selected" if want else "no_eligible_candidate")


@pytest.mark.parametrize(
    "spoil,check",
    [
        (lambda r: r.filter(F.col("candidate") == C1), "candidate_missing_2"),
        (lambda r: r.filter((F.col("candidate") == C1) | (F.col("seed") == 1001)), "unpaired"),
        (lambda r: r.withColumn("split", F.lit("holdout")), "other_split"),
        (lambda r: r.withColumn("tier", F.lit("development")), "other_tier"),
        (lambda r: r.withColumn("generator", F.when(F.col("seed") == 1001, "g")), "mixed_generator"),
        (lambda r: r.withColumn("projection_error", F.when(F.col("seed") == 1001, float("nan")).otherwise(0.1)), "metric_not_finite"),
    ],
)
def test_selection_refuses(spark, spoil, check):
    with pytest.raises(ContractError, match=check):
        ev.select_candidate(spoil(bench(spark, (1001, 1002), "calibration")), C1, C2, RULES)


def test_holdout_refuses_strata_outside_the_grid(spark):
    rows = bench(spark, (1021, 1022), "holdout").filter(F.col("candidate") == C1)
    index = ev.grid_from_table(rows.filter("stratum_digest = 's1'"), ["stratum_digest"])
    with pytest.raises(ContractError, match="stratum_outside_grid"):
        ev.holdout_summary(rows, index, C1, RULES)


def test_protocol_sized_table(spark):
    """1,024 strata in a table, indexed and summed up."""
    rows = bench(spark, (1021, 1022), "holdout", [f"s{i:04d}" for i in range(1024)]).filter(F.col("candidate") == C1)
    index = ev.grid_from_table(rows, ["stratum_digest"])
    assert index.count() == 1024
    out = ev.holdout_summary(rows, index, C1, ev.Rules(resamples=20), ["shared_recovery_error"])
    assert out.count() == 1024 and out.filter("abs(ci_upper - 0.1) > 1e-9").isEmpty()


def test_holdout_acceptance(spark):
    rows = bench(spark, (1021, 1022), "holdout").filter(F.col("candidate") == C1)
    index = ev.grid_from_table(rows, ["stratum_digest"])
    summary = ev.holdout_summary(rows, index, C1, RULES)
    assert ev.accept_holdout(summary, rows, RULES).first().decision == "accepted"
    worse = summary.withColumn(
        "estimate", F.when((F.col("metric") == "projection_error") & (F.col("stratum_digest") == "s2"), 0.31).otherwise(F.col("estimate"))
    )
    assert ev.accept_holdout(worse, rows, RULES).first().decision == "failed"
    lost = summary.filter("NOT (metric = 'projection_error' AND stratum_digest = 's2')")
    row = ev.accept_holdout(lost, rows, RULES).first()
    assert not row.required_complete and row.decision == "failed"
    assert not con.bench_violations(rows, "holdout", C1, "full").take(1)
    assert {r["check"] for r in con.bench_violations(rows, "calibration", C2).collect()} == {"other_split", "other_candidate"}


def test_protocol_grid_and_tasks(spark):
    strata = ev.grid_strata(spark, ev.PROTOCOL_GRID)
    pdf = strata.toPandas().sort_values("canonical_index")
    assert len(pdf) == 1024 and list(pdf.canonical_index) == list(range(1, 1025))
    fields = list(ev.PROTOCOL_GRID)
    assert pdf[fields].apply(tuple, axis=1).is_monotonic_increasing
    seeds = ev.protocol_seeds(spark)
    tasks = ev.task_table(strata, seeds, fields)
    assert tasks.count() == 40_960
    assert tasks.select("task_key").distinct().count() == 40_960
    twice = tasks.unionByName(tasks.filter("seed = 1001 AND canonical_index = 1")).filter("seed < 1040")
    found = con.coverage_violations(tasks, twice, ["canonical_index", "seed"]).groupBy("check").count().collect()
    assert {r["check"]: r["count"] for r in found} == {"task_missing": 1024, "task_repeated": 1}
    wrong = tasks.withColumn("split", F.lit("holdout"))
    assert con.coverage_violations(tasks, wrong, ["canonical_index", "seed"]).count() == 20_480


def values(spark, **groups):
    parts = [pd.DataFrame({"k": k, "seed": np.arange(len(v)), "value": v}) for k, v in groups.items()]
    return spark.createDataFrame(pd.concat(parts)).repartition(4)


@pytest.mark.parametrize("block", [100, 1999, 2000, 50_000])
def test_groups_resample_alike_whatever_the_block(spark, block):
    """Blocks must give the distribution of the plain resampling scheme."""
    x = np.random.default_rng(31).exponential(size=2000)
    data = values(spark, a=x, b=x[:50])
    got = ev.bootstrap_means(data, ["k"], 400, 5, block=block).toPandas()
    a = got[got.k == "a"]["mean"]
    assert len(a) == 400 and sorted(got[got.k == "a"]["rep"]) == list(range(400))
    assert abs(a.mean() - x.mean()) < 4 * x.std() / np.sqrt(2000 * 400) + 1e-3
    assert abs(a.std() / (x.std() / np.sqrt(2000)) - 1) < 0.15


@pytest.mark.parametrize("n", [1000, 1001])
def test_medians_resample_alike(spark, n):
    x = np.random.default_rng(32).normal(size=n)
    data = values(spark, a=x).withColumn("s", F.lit(7))
    plain = ev.bootstrap_medians(data, ["k"], 1500, "s", "mix").toPandas()["median"]
    ranks = ev.bootstrap_medians(data, ["k"], 1500, "s").toPandas()["median"]
    assert len(plain) == len(ranks) == 1500
    assert abs(plain.mean() - ranks.mean()) < 0.01
    assert abs(plain.std() / ranks.std() - 1) < 0.15


def test_mix_draws_are_even():
    x = ev.mix_indexes(11001, 12345, 50, range(4000))
    counts = np.bincount(x.ravel(), minlength=50)
    assert abs(counts - 4000).max() < 5 * np.sqrt(4000)
    assert abs(np.corrcoef(x[:, 0], x[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(x[:-1, 0], x[1:, 0])[0, 1]) < 0.06


def test_mix_refuses_what_it_cannot_hold(spark, monkeypatch):
    monkeypatch.setattr(ev, "MIX_LIMIT", 10)
    with pytest.raises(ContractError, match="philox"):
        ev.bootstrap_means(values(spark, a=np.arange(11.0)), ["k"], 5, 1, "mix")


def test_draws_do_not_depend_on_partitions(spark):
    x = np.random.default_rng(33).normal(size=60)
    runs = [
        ev.bootstrap_means(values(spark, a=x).repartition(p), ["k"], 250, 3, draws).toPandas().sort_values("rep")["mean"].to_numpy()
        for draws in ("mix", "philox") for p in (1, 6)
    ]
    assert np.allclose(runs[0], runs[1]) and np.allclose(runs[2], runs[3])


def test_duration_text_and_progress(spark):
    df = spark.createDataFrame([(5.0,), (125.4,), (3723.0,), (float("inf"),), (None,)], "s double")
    got = [r[0] for r in df.select(ev.duration_text(F.col("s"))).collect()]
    assert got == ["0m 05s", "2m 05s", "1h 02m 03s", "unknown", "unknown"]
    tasks = spark.createDataFrame([(str(i),) for i in range(10)], "task_key string")
    log = spark.createDataFrame([("0", "complete"), ("1", "complete"), ("2", "failed")], "task_key string, status string")
    row = ev.progress(tasks, log, 4.0).first()
    assert (row.completed, row.failed, row.total, row.rate_per_sec, row.eta_sec) == (2, 1, 10, 0.5, 16.0)
    assert ev.progress(tasks, log.limit(0), 4.0).first().eta_text == "unknown"
    bad = {(r["check"]) for r in ev.log_violations(tasks, log).collect()}
    assert bad == {"task_missing", "task_incomplete"}
