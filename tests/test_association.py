"""Associations, proposal, bootstrap stability, longitudinal quantities and floors against brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statewell.common import ContractError
from statewell.operators import association as assoc, floors, longitudinal as lng, stability as stab


def average_ranks(v):
    v = np.asarray(v, float)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def pairs_frame(spark, groups, partitions=4):
    rows = [(g, float(a), float(b)) for g, (x, y) in groups.items() for a, b in zip(x, y)]
    return spark.createDataFrame(rows, "g string, x double, y double").repartition(partitions)


def tau_b(x, y):
    dx, dy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    return (dx * dy).sum() / math.sqrt((dx != 0).sum() * (dy != 0).sum())


# --- X1, X2, X3 -------------------------------------------------------------------------


def test_ranks_of_ties_that_cross_partitions(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 9, 400)
    frame = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 1.0)], "g string, x double").repartition(7)
    got = {(r["g"], r["x"]): (r["ties"], r["rank"]) for r in assoc.value_ranks(frame, ["g"], "x").collect()}
    ranks = average_ranks(x)
    assert got[("b", 1.0)] == (1, 1.0) and len(got) == len(set(x)) + 1
    assert all(got[("a", float(v))] == ((x == v).sum(), r) for v, r in zip(x, ranks))


def test_spearman_atlas(spark):
    rng = np.random.default_rng(2)
    n = 60
    u = rng.normal(size=(n, 2)).round(1)
    samples = pd.DataFrame({"sample_id": range(n), "age": (u[:, 0] * 3).round(), "mouse_id": range(n), "flat": 1.0, "burden": -u[:, 1]})
    samples.loc[::7, "burden"] = np.nan
    scores = spark.createDataFrame([(i, c + 1, float(u[i, c])) for i in range(n) for c in range(2)], "sample_id long, component int, coord double")
    meta = spark.createDataFrame(samples).withColumn("burden", F.when(~F.isnan("burden"), F.col("burden"))).withColumn("name", F.lit("x"))
    got = {(r["component"], r["field"]): r for r in assoc.spearman_atlas(scores, meta, identifiers=["mouse_id"], roles={"age": "target"}).collect()}
    assert {f for _, f in got} == {"age", "flat", "burden"}
    for (c, f), r in got.items():
        y = samples[f].to_numpy()
        there = ~np.isnan(y)
        assert r["n"] == there.sum() and r["role"] == ("target" if f == "age" else "discovered")
        if f == "flat":
            assert r["spearman"] is None
        else:
            want = np.corrcoef(average_ranks(u[there, c - 1]), average_ranks(y[there]))[0, 1]
            assert r["spearman"] == pytest.approx(want, abs=1e-12) and r["z"] == pytest.approx(want * math.sqrt(there.sum() - 1))
    with pytest.raises(ContractError):
        assoc.spearman_atlas(scores, meta, design="longitudinal")
    with pytest.raises(ContractError):
        assoc.spearman_atlas(scores, meta, fields=["mouse_id"], identifiers=["mouse_id"])


def test_group_separation(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 80)
    x = (rng.normal(size=80) + y).round(1)
    frame = pairs_frame(spark, {"g": (x, y), "one": (x[:5], np.ones(5)), "flat": (np.ones(6), [0, 1] * 3)})
    got = {r["g"]: r for r in assoc.group_separation(frame, ["g"]).collect()}
    a, b = x[y == 0], x[y == 1]
    u = sum((p > q) + 0.5 * (p == q) for p in b for q in a)
    n = len(x)
    ties = sum(c**3 - c for c in np.unique(x, return_counts=True)[1])
    spread = len(a) * len(b) / 12 * (n + 1 - ties / (n * (n - 1)))
    r = got["g"]
    assert (r["n0"], r["n1"], r["u"]) == (len(a), len(b), u)
    assert r["rank_biserial"] == pytest.approx(2 * u / (len(a) * len(b)) - 1)
    assert r["z"] == pytest.approx((u - len(a) * len(b) / 2) / math.sqrt(spread)) and r["point_biserial"] == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert got["one"]["rank_biserial"] is None and got["one"]["z"] is None
    assert got["flat"]["rank_biserial"] == 0 and got["flat"]["z"] is None
    with pytest.raises(Exception, match="other than 0 and 1"):
        assoc.group_separation(pairs_frame(spark, {"g": ([1, 2], [0, 2])}), ["g"]).collect()


def test_weighted_inversions():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 17, 64, 65):
        v, w = rng.permutation(n), rng.integers(1, 5, n)
        want = sum(int(w[i] * w[j]) for i in range(n) for j in range(i + 1, n) if v[i] > v[j])
        assert assoc.weighted_inversions(v, w) == want


@pytest.mark.parametrize("block", [3, 10, 250_000])
def test_kendall_by_all_pairs(spark, block):
    """Blocks of three points make every pair of blocks count; ties on either side, both, and none; no spread."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, 90).astype(float)
    groups = {"ties": (x, (x + rng.integers(0, 4, 90)) // 2), "free": (rng.normal(size=70), rng.normal(size=70)), "hot": (np.r_[np.zeros(60), x[:30]], rng.integers(0, 3, 90)),
              "flat": (np.ones(5), np.arange(5.0)), "up": (np.arange(40.0), np.arange(40.0)), "down": (np.arange(40.0), -np.arange(40.0)), "single": ([1.0], [2.0])}
    got = {r["g"]: r for r in assoc.ordered_trend(pairs_frame(spark, groups), ["g"], block).collect()}
    for g in ("ties", "free", "hot", "up", "down"):
        a, b = (np.asarray(v, float) for v in groups[g])
        assert got[g]["kendall"] == pytest.approx(tau_b(a, b), abs=1e-12)
        assert got[g]["spearman"] == pytest.approx(np.corrcoef(average_ranks(a), average_ranks(b))[0, 1], abs=1e-12)
    assert got["up"]["kendall"] == 1 and got["down"]["kendall"] == -1
    assert got["flat"]["kendall"] is None and got["single"]["kendall"] is None and got["single"]["n"] == 1
    n = 40
    assert got["up"]["kendall_z"] == pytest.approx((n * (n - 1) / 2) / math.sqrt(n * (n - 1) * (2 * n + 5) / 18))


def test_kendall_of_a_million_rows(spark):
    """Five ordered states; the discordant pairs follow from how often each state comes before a lower one."""
    rows = spark.range(1_000_000).select(
        F.lit("g").alias("g"), F.pmod(F.xxhash64("id"), F.lit(300_007)).cast("double").alias("x"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)).cast("double").alias("level"),
    ).select("g", "x", F.when(F.col("x") > 200_000, F.greatest("level", F.lit(2.0))).otherwise(F.col("level")).alias("y"))
    r = assoc.ordered_trend(rows, ["g"], 100_000).first()
    pdf = rows.toPandas()
    x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
    seen = np.zeros((int(x.max()) + 1, 5), np.int64)
    np.add.at(seen, (x.astype(int), y.astype(int)), 1)
    before = np.cumsum(seen, 0) - seen
    up = sum(int((seen[:, b] * before[:, a]).sum()) for a in range(5) for b in range(a + 1, 5))
    down = sum(int((seen[:, b] * before[:, a]).sum()) for a in range(5) for b in range(a))
    n0 = len(x) * (len(x) - 1) // 2
    tied = lambda v: int(sum(int(c) * (int(c) - 1) // 2 for c in np.unique(v, return_counts=True)[1]))
    assert r["n"] == len(x)
    assert r["kendall"] == pytest.approx((up - down) / math.sqrt(n0 - tied(x)) / math.sqrt(n0 - tied(y)), abs=1e-12)


def test_no_rows(spark):
    empty = pairs_frame(spark, {})
    assert assoc.spearman(empty, ["g"]).collect() == [] and assoc.ordered_trend(empty, ["g"]).collect() == []
    assert assoc.group_separation(empty, ["g"]).collect() == []


# --- X8 -------------------------------------------------------------------------------------


def test_concordance_and_a_layer_that_runs_against(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=40)
    layers = {"a": base, "b": base + 0.3 * rng.normal(size=40), "c": (base + 0.3 * rng.normal(size=40)).round(0), "turned": -base + 0.3 * rng.normal(size=40)}
    rows = [(n, i, float(v)) for n, x in layers.items() for i, v in enumerate(x) if not (n == "b" and i % 8 == 0)] + [("a", 99, 0.5), ("a", 98, float("nan"))]
    frame = spark.createDataFrame(rows, "layer string, sample_id long, coord double").repartition(3)
    r = assoc.layer_concordance(frame).first()
    kept = [i for i in range(40) if i % 8]
    ranks = {n: average_ranks(np.asarray(x)[kept]) for n, x in layers.items()}
    total = sum(ranks.values())
    n, m = len(kept), 4
    ties = sum(c**3 - c for x in layers.values() for c in np.unique(np.asarray(x)[kept], return_counts=True)[1])
    w = 12 * ((total - total.mean()) ** 2).sum() / (m * m * (n**3 - n) - m * ties)
    assert (r["layers"], r["units"], r["complete"]) == (4, 41, n) and r["w"] == pytest.approx(w) and r["chi2"] == pytest.approx(m * (n - 1) * w)
    profile = {p["layer"]: p for p in assoc.layer_profile(frame).collect()}
    for name in layers:
        want = np.corrcoef(ranks[name], average_ranks(total - ranks[name]))[0, 1]
        assert profile[name]["agreement"] == pytest.approx(want, abs=1e-12)
    assert profile["turned"]["direction"] == "against" and profile["a"]["direction"] == "with"
    with pytest.raises(Exception, match="twice in a layer"):
        assoc.layer_concordance(frame.union(frame)).collect()


# --- X5 ---------------------------------------------------------------------------------------


def atlas_of(spark, rows):
    return spark.createDataFrame(rows, "component int, field string, role string, design string, n long, spearman double, z double")


ATLAS = [(1, "t", "target", "c", 50, 0.3, 1.0), (1, "w", "nuisance", "c", 50, -0.5, 1.0), (2, "t", "target", "c", 50, -0.8, 1.0), (2, "w", "nuisance", "c", 50, 0.1, 1.0),
         (3, "t", "target", "c", 50, None, None), (3, "w", "nuisance", "c", 50, 0.9, 1.0), (2, "other", "discovered", "c", 40, 0.99, 1.0)]


def test_proposal_and_abstention(spark):
    atlas = atlas_of(spark, ATLAS)
    got = {r["component"]: r for r in assoc.propose_component(atlas, "t", ["w"]).collect()}
    assert [got[c]["rank"] for c in (2, 1, 3)] == [1, 2, 3] and [got[c]["recommended"] for c in (1, 2, 3)] == [False, True, False]
    assert got[2]["direction"] == -1 and got[1]["alert"] and not got[2]["alert"] and got[1]["nuisance_score"] == 0.5
    assert not got[3]["eligible"]
    for changed in ({"margin": 0.6}, {"floor": 0.9}, {"unstable": spark.createDataFrame([(2,), (1,)], "component int")}):
        assert not any(r["recommended"] for r in assoc.propose_component(atlas, "t", ["w"], **changed).collect())
    moved = assoc.propose_component(atlas, "t", ["w"], unstable=spark.createDataFrame([(2,)], "component int")).collect()
    assert {r["component"] for r in moved if r["recommended"]} == {1} and {r["component"]: r["rank"] for r in moved}[2] == 1


def test_confirmation_breaks_with_its_atlas(spark):
    atlas = atlas_of(spark, ATLAS)
    proposal = assoc.propose_component(atlas, "t", ["w"])
    record = assoc.confirm_component(proposal, 2, "clear of weeks", "aml", "t")
    r = record.first()
    assert (r["id"], r["decision"], r["selected_component"]) == ("aml_t_PC2", "accepted", 2)
    assert assoc.confirm_component(proposal, 1, "why", "d", "t").first()["decision"] == "overridden"
    assert assoc.confirm_component(assoc.propose_component(atlas, "t", ["w"], floor=0.9), 2, "why", "d", "t").first()["decision"] == "chosen"
    assert assoc.confirmation_violations(record, atlas.repartition(3), proposal).collect() == []
    late = atlas_of(spark, [*ATLAS[:-1], (2, "other", "discovered", "c", 40, 0.98, 1.0)])
    assert {v["check"] for v in assoc.confirmation_violations(record, late, proposal).collect()} == {"stale_atlas", "proposal_of_other_atlas"}
    fresh = assoc.propose_component(late, "t", ["w"])
    assert {v["check"] for v in assoc.confirmation_violations(record, late, fresh).collect()} == {"stale_atlas", "stale_proposal"}
    for component in (3, 9):
        with pytest.raises(Exception, match="not an eligible component"):
            assoc.confirm_component(proposal, component, "why", "d", "t").collect()
    with pytest.raises(ContractError):
        assoc.confirm_component(proposal, 2, " ", "d", "t")


# --- X4, X9 -------------------------------------------------------------------------------------


def longitudinal(rng, subjects=14):
    rows = []
    for s in range(subjects):
        for t in np.sort(rng.uniform(0, 20, rng.integers(1, 12))):
            rows.append((s, s % 2, float(t), float(0.5 * s + (0.3 if s % 2 else 0.1) * t + rng.normal())))
    return rows


def test_interaction_by_clustered_regression(spark):
    rng = np.random.default_rng(7)
    rows = longitudinal(rng)
    odd = [(99, None, 1.0, 1.0), (None, 1, 1.0, 1.0), (3, 1, None, 2.0), (3, 1, 4.0, float("nan"))]
    frame = spark.createDataFrame([("l", *r) for r in rows + odd], "layer string, subject long, condition int, t double, x double").repartition(3)
    got = lng.trajectory_divergence(frame, ["layer"]).first()
    slope, var, means = {}, {}, {0: [], 1: []}
    for c in (0, 1):
        t_, u, g = 0.0, {}, 0
        sx = 0.0
        for s in sorted({r[0] for r in rows if r[1] == c}):
            mine = np.array([r[2:] for r in rows if r[0] == s])
            means[c].append(mine[:, 1].mean())
            tc, xc = mine[:, 0] - mine[:, 0].mean(), mine[:, 1] - mine[:, 1].mean()
            if len(mine) > 1:
                u[s] = (tc @ xc, tc @ tc)
                t_, sx, g = t_ + tc @ tc, sx + tc @ xc, g + 1
        slope[c] = sx / t_
        var[c] = sum((a - slope[c] * b) ** 2 for a, b in u.values()) / t_**2 * g / (g - 1)
    assert got["slope_0"] == pytest.approx(slope[0]) and got["slope_1"] == pytest.approx(slope[1])
    assert got["interaction"] == pytest.approx(slope[1] - slope[0]) and got["interaction_se"] == pytest.approx(math.sqrt(var[0] + var[1]))
    assert got["interaction_z"] > 1.96
    se = math.sqrt(sum(np.var(m, ddof=1) / len(m) for m in means.values()))
    assert got["separation"] == pytest.approx(np.mean(means[1]) - np.mean(means[0])) and got["separation_se"] == pytest.approx(se)
    with pytest.raises(Exception, match="two conditions"):
        lng.trajectory_divergence(spark.createDataFrame([(1, 0, 1.0, 1.0), (1, 1, 2.0, 1.0)], "subject long, condition int, t double, x double")).collect()


def test_few_subjects_give_no_error_bars(spark):
    frame = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 0, 1.0, 2.0), (2, 1, 0.0, 1.0)], "subject long, condition int, t double, x double")
    r = lng.trajectory_divergence(frame).first()
    assert r["slope_0"] == 1 and r["slope_1"] is None and r["interaction"] is None and r["interaction_se"] is None and r["separation_se"] is None
    assert lng.mean_squared_displacement(frame, [], 2.0, 1.0).first()["se"] is None


def test_displacement_by_all_pairs(spark):
    rng = np.random.default_rng(8)
    rows = longitudinal(rng, 9) + [(3, 1, 5.0, 1.0), (3, 1, 5.0, 2.0), (3, 1, 8.0, 3.0), (3, 1, 11.0, 3.5)]
    frame = spark.createDataFrame(rows, "subject long, condition int, t double, x double").repartition(5)
    for max_lag, width in ((6.0, 1.5), (5.0, 2.0), (100.0, 100.0)):
        got = {r["lag_class"]: r for r in lng.mean_squared_displacement(frame, [], max_lag, width).collect()}
        per = {}
        for a in rows:
            for b in rows:
                lag = b[2] - a[2]
                if a[0] == b[0] and 0 < lag <= max_lag:
                    k = max(math.ceil(lag / width) - 1, 0)
                    m, s = per.setdefault(k, {}).get(a[0], (0, 0.0))
                    per[k][a[0]] = (m + 1, s + (b[3] - a[3]) ** 2)
        assert set(got) == set(per)
        for k, subjects in per.items():
            m, s = (sum(v[i] for v in subjects.values()) for i in (0, 1))
            g = len(subjects)
            assert (got[k]["pairs"], got[k]["subjects"]) == (m, g) and got[k]["msd"] == pytest.approx(s / m)
            if g > 1:
                want = math.sqrt(sum((b - s / m * a) ** 2 for a, b in subjects.values()) * g / (g - 1)) / m
                assert got[k]["se"] == pytest.approx(want, abs=1e-9)
        assert max(r["lag_to"] for r in got.values()) <= max_lag
    with pytest.raises(ContractError):
        lng.mean_squared_displacement(frame, [], 1.0, 2.0)


def test_diffusion_of_random_walks(spark):
    """Walks with coefficient 0.5 give it back within three standard errors; still values scatter around no line."""
    rng = np.random.default_rng(9)
    rows = []
    for s in range(60):
        t = np.cumsum(rng.uniform(0.2, 1.0, 60))
        rows += [("walk", s, float(a), float(b)) for a, b in zip(t, np.cumsum(rng.normal(size=60) * np.sqrt(np.diff(np.r_[0, t]))))]
        rows += [("still", s, float(a), float(b)) for a, b in zip(t, rng.normal(size=60))]
    frame = spark.createDataFrame(rows, "layer string, subject long, t double, x double")
    got = {r["layer"]: r for r in lng.diffusion(lng.mean_squared_displacement(frame, ["layer"], 4.0, 0.25), ["layer"]).collect()}
    assert abs(got["walk"]["diffusion"] - 0.5) < 0.1 and got["walk"]["classes"] == 16
    assert not got["still"]["adequate"]


# --- X6, X7 -----------------------------------------------------------------------------------------


def test_bootstrap_equals_resampled_matrices(spark):
    rng = np.random.default_rng(10)
    x = {"a": rng.normal(size=(40, 6)) * np.arange(6, 0, -1), "b": rng.normal(size=(40, 6))}
    rows = [(n, f"u{i}", v.tolist()) for n, m in x.items() for i, v in enumerate(m)]
    frame = spark.createDataFrame(rows, "layer string, sample_id string, vec array<double>").repartition(5)
    boot = stab.bootstrap_spectrum(frame, ["layer"], 3, 8, 5)
    marks = {r["sample_id"]: r["m"] for r in frame.select("sample_id", stab.unit_mark(F.col("sample_id")).alias("m")).distinct().collect()}
    w = stab.unit_weights(np.array([marks[f"u{i}"] for i in range(40)]), np.arange(9), 5)
    w[:, 0] = 1
    assert 0.7 < w[:, 1:].mean() < 1.3 and len({tuple(c) for c in w.T}) == 9
    same = frame.select(stab.weight_column(stab.unit_mark(F.col("sample_id")), F.lit(3), 5).alias("w"), "sample_id").distinct().collect()
    assert {r["sample_id"]: r["w"] for r in same} == {f"u{i}": int(w[i, 3]) for i in range(40)}
    sigma = {(r["layer"], r["rep"], r["component"]): r["sigma"] for r in boot.spectrum.collect()}
    axes = {(r["layer"], r["rep"], r["component"]): np.array(r["vec"]) for r in boot.loadings.collect()}
    assert len(sigma) == 2 * 9 * 3
    for n, m in x.items():
        for rep in range(9):
            copies = np.repeat(m, w[:, rep], axis=0)  # both layers with the weights of the same units
            _, d, vt = np.linalg.svd(copies - copies.mean(0), full_matrices=False)
            for c in range(3):
                assert sigma[n, rep, c + 1] == pytest.approx(d[c])
                assert abs(axes[n, rep, c + 1] @ vt[c]) == pytest.approx(1)
    again = stab.bootstrap_spectrum(frame.repartition(2), ["layer"], 3, 8, 5)
    for r in again.spectrum.collect():
        assert sigma[r["layer"], r["rep"], r["component"]] == pytest.approx(r["sigma"])


def test_replicates_in_chunks(spark, monkeypatch):
    rng = np.random.default_rng(11)
    frame = spark.createDataFrame([("a", f"u{i}", rng.normal(size=4).tolist()) for i in range(30)], "layer string, sample_id string, vec array<double>")
    whole = {(r["rep"], r["component"]): r["sigma"] for r in stab.bootstrap_spectrum(frame, ["layer"], 4, 10, 2).spectrum.collect()}
    monkeypatch.setattr(stab, "HELD_DOUBLES", 75)
    monkeypatch.setattr(stab, "ROW_DOUBLES", 5)
    cut = {(r["rep"], r["component"]): r["sigma"] for r in stab.bootstrap_spectrum(frame, ["layer"], 4, 10, 2).spectrum.collect()}
    assert set(whole) == set(cut) and all(cut[k] == pytest.approx(v) for k, v in whole.items())


def test_best_matching_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(12)
    for rows, columns in ((1, 1), (3, 3), (4, 4), (3, 5), (5, 5)):
        for _ in range(20):
            gain = rng.random((rows, columns)).round(1)
            found = stab.best_matching(gain)
            assert len(set(found)) == rows
            best = max(sum(gain[i, p[i]] for i in range(rows)) for p in permutations(range(columns), rows))
            assert sum(gain[i, j] for i, j in enumerate(found)) == pytest.approx(best)


def axes_frame(spark, rows, rep=True):
    return spark.createDataFrame(rows, "rep int, component int, vec array<double>" if rep else "component int, vec array<double>")


def test_swaps_flips_and_rotations(spark):
    """Axes 1 and 2 swap and flip but recur; 3 and 4 rotate in their plane, so the plane is stable and neither axis is."""
    q = np.linalg.qr(np.random.default_rng(13).normal(size=(12, 4)))[0].T
    reference = axes_frame(spark, [(i + 1, q[i].tolist()) for i in range(4)], rep=False)
    rows = []
    for r in range(10):
        a = 0.3 + 0.25 * r
        three, four = np.cos(a) * q[2] + np.sin(a) * q[3], -np.sin(a) * q[2] + np.cos(a) * q[3]
        order = [-q[1], q[0]] if r % 2 else [q[0], q[1]]
        rows += [(r, i + 1, v.tolist()) for i, v in enumerate([*order, three, four])]
    aligned = stab.align_components(reference, axes_frame(spark, rows))
    by = {(r["rep"], r["component"]): r for r in aligned.collect()}
    assert (by[1, 1]["matched"], by[1, 1]["sign"], by[1, 2]["matched"], by[1, 2]["sign"]) == (2, 1, 1, -1)
    got = {r["component"]: r for r in stab.axis_stability(aligned).collect()}
    assert [got[c]["result"] for c in (1, 2, 3, 4)] == ["stable_axis", "stable_axis", "stable_subspace", "stable_subspace"]
    assert got[1]["axis_share"] == 1 and got[1]["index_share"] == 0.5 and got[2]["orientation_share"] == 0.5 and got[3]["axis_share"] < 0.8
    noise = [(r, c + 1, v.tolist()) for r in range(10) for c, v in enumerate(np.random.default_rng(r).normal(size=(4, 12)))]
    assert {r["result"] for r in stab.axis_stability(stab.align_components(reference, axes_frame(spark, noise))).collect()} == {"unstable"}


def test_equal_values_have_no_stable_axis(spark):
    """End to end: the second and third singular values are equal, so their axes rotate from resample to resample."""
    rng = np.random.default_rng(14)
    u = np.linalg.qr(rng.normal(size=(300, 3)))[0]
    v = np.linalg.qr(rng.normal(size=(8, 3)))[0]
    x = u @ np.diag([60.0, 20.0, 20.0]) @ v.T + 0.05 * rng.normal(size=(300, 8))
    frame = spark.createDataFrame([("a", f"u{i}", r.tolist()) for i, r in enumerate(x)], "layer string, sample_id string, vec array<double>")
    axes = stab.bootstrap_spectrum(frame, ["layer"], 3, 30, 1).loadings
    aligned = stab.align_components(axes.filter("rep = 0").drop("rep"), axes.filter("rep > 0"), ["layer"])
    got = {r["component"]: r["result"] for r in stab.axis_stability(aligned, ["layer"], 0.95).collect()}
    assert got[1] == "stable_axis" and got[2] == got[3] == "stable_subspace"


def test_replicate_with_fewer_axes(spark):
    reference = axes_frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])], rep=False)
    got = {r["component"]: r for r in stab.align_components(reference, axes_frame(spark, [(1, 1, [0.0, -2.0])])).collect()}
    assert got[1]["matched"] is None and got[1]["overlap"] == 0 and (got[2]["matched"], got[2]["sign"]) == (1, -1) and got[2]["overlap"] == 1


# --- X10 ----------------------------------------------------------------------------------------------


def test_rank_interval_is_binomial():
    for n in (1, 5, 30, 200):
        p = [math.comb(n, k) * 0.9**k * 0.1 ** (n - k) for k in range(n + 1)]
        cdf = np.cumsum(p)
        for k in range(1, n + 1):
            assert floors.below(k, n, 0.9) == pytest.approx(cdf[k - 1], abs=1e-12)
        low, high = floors.rank_interval(n, 0.9, 0.95)
        want_low = max([k for k in range(1, n + 1) if cdf[k - 1] <= 0.025], default=None)
        want_high = min([k for k in range(1, n + 1) if cdf[k - 1] >= 0.975], default=None)
        assert (low, high) == (want_low, want_high)
    low, high = floors.rank_interval(10**9, 0.9, 0.95)
    assert abs((high - low) - 2 * 1.96 * math.sqrt(10**9 * 0.09)) < 50


def test_floor_thresholds_and_their_use(spark):
    rng = np.random.default_rng(15)
    e = {20: rng.random(500), 40: rng.random(30) / 2}
    rows = [(n, "sre", float(v)) for n, x in e.items() for v in x] + [(20, "sre", None), (20, "other", 1.0)]
    frame = spark.createDataFrame(rows, "n_samples int, metric string, value double").repartition(4)
    table = floors.floor_thresholds(frame, ["n_samples"], {"sre": 0.02})
    got = {r["n_samples"]: r for r in table.collect()}
    for n, x in e.items():
        low, high = floors.rank_interval(len(x), 0.9, 0.95)
        s = np.sort(x)
        assert got[n]["n"] == len(x) and got[n]["floor"] == pytest.approx(np.quantile(x, 0.9)) and got[n]["threshold"] == pytest.approx(np.quantile(x, 0.9) + 0.02)
        assert got[n]["floor_low"] == s[low - 1] and got[n]["floor_high"] == (s[high - 1] if high else None)
    medians = spark.createDataFrame([("c1", 20, "sre", 0.1), ("c1", 40, "sre", 0.9), ("c2", 20, "sre", None), ("c2", 60, "sre", 0.1)], "candidate string, n_samples int, metric string, median double")
    bad = {(r["check"], r["key"]) for r in floors.floor_violations(medians, table, ["n_samples"]).collect()}
    assert bad == {("above_floor", "c1|40|sre"), ("no_value", "c2|20|sre"), ("no_floor", "c2|60|sre")}
    for margins in ({}, {"sre": 0.0}):
        with pytest.raises(ContractError):
            floors.floor_thresholds(frame, ["n_samples"], margins)
