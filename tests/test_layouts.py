"""Layouts for large groups give what the plain forms give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from statewell.common import ContractError
from statewell.operators.decompose import project_cohort, same_features
from statewell.operators.evidence import _paths, block_shares, bootstrap_means
from statewell.operators.landscape import DENSITY_FLOOR, add_kernels
from statewell.operators.linalg import gram_blocks
from statewell.operators.quantiles import rank_sketch, refine_quantiles
from statewell.operators.ranking import grouped_running_sum


def test_running_sum_over_many_partitions(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), "id", (F.col("id") % 7).alias("v"))
    got = grouped_running_sum(df, ["g"], ["id"], "v", partitions=9).toPandas().sort_values(["g", "id"])
    assert (got["running_sum"] == got.groupby("g")["v"].cumsum()).all() and len(got) == 5000


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_quantiles_in_both_layouts(spark, accuracy):
    rng = np.random.default_rng(3)
    x = np.round(np.concatenate([rng.normal(size=3000), rng.exponential(size=900), [0.5] * 700]), 2)
    df = spark.createDataFrame([("a" if i % 9 else "b", float(v)) for i, v in enumerate(x)], "g string, x double")
    probs = [0.0, 0.1, 0.5, 0.999, 1.0]
    sketch = rank_sketch(df, ["g"], "x", probs, accuracy)
    pdf = df.toPandas()
    for most in (0, 10**9):
        rows = refine_quantiles(df, sketch, ["g"], "x", probs, accuracy, ordered_rows=most).collect()
        assert len(rows) == 10
        for r in rows:
            assert r["q"] == pytest.approx(np.quantile(pdf[pdf.g == r["g"]].x, r["prob"]), abs=1e-12)
    alone = refine_quantiles(df, rank_sketch(df, [], "x", probs, accuracy), [], "x", probs, accuracy, ordered_rows=0).collect()
    assert {r["prob"]: pytest.approx(r["q"], abs=1e-12) for r in alone} == {p: np.quantile(pdf.x, p) for p in probs}


@pytest.mark.parametrize("h", [0.002, 0.3, 50.0])
def test_kernels_within_reach_are_all_that_count(h):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=4000), rng.normal(9, 0.1, size=30), [40.0]])
    xs = np.linspace(x.min() - 2 * h, x.max() + 2 * h, 512)
    mass = 1 / (len(x) * h * np.sqrt(2 * np.pi))
    want = np.zeros(512)
    for v in x:
        want += np.exp(-0.5 * ((xs - v) / h) ** 2) * mass
    got = np.zeros(512)
    add_kernels(got, xs, x[:50], h, mass)
    add_kernels(got, xs, x[50:], h, mass)
    u = lambda p: -np.log(np.maximum(p, DENSITY_FLOOR))
    assert np.abs(u(got) - u(want)).max() < 1e-8


def test_block_shares_add_up(spark):
    sizes = {"a": [3, 40, 0, 7, 1, 90, 5], "b": [4], "c": [0, 0, 0, 0, 0, 6]}
    rows = [(g, i, n) for g, ns in sizes.items() for i, n in enumerate(ns) if n]
    paths = _paths(spark.createDataFrame(rows, "g string, _block int, _size int"), ["g"]).collect()
    assert len(paths) == len(rows)
    for g, ns in sizes.items():
        shares = {p["_block"]: block_shares(sum(ns), p["_path"], 4000, 11, 5) for p in paths if p["g"] == g}
        assert (sum(shares.values()) == sum(ns)).all()
        for b, s in shares.items():
            assert s.mean() == pytest.approx(ns[b], rel=0.1)
    spread = {b: s.var() for b, s in ((p["_block"], block_shares(146, p["_path"], 4000, 11, 5)) for p in paths if p["g"] == "a")}
    assert spread[5] == pytest.approx(146 * (90 / 146) * (56 / 146), rel=0.1)


def test_means_of_many_blocks_follow_sampling_theory(spark):
    x = np.random.default_rng(2).exponential(size=900)
    df = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate(x)], "g string, seed long, value double")
    got = bootstrap_means(df, ["g"], 3000, 7, block=20).toPandas()["mean"].to_numpy()
    again = bootstrap_means(df.repartition(5), ["g"], 3000, 7, block=20).toPandas()["mean"].to_numpy()
    assert len(got) == 3000 and np.allclose(np.sort(got), np.sort(again))
    assert got.mean() == pytest.approx(x.mean(), abs=4 * x.std() / np.sqrt(900 * 3000))
    assert got.std() == pytest.approx(x.std() / 30, rel=0.06)


def test_features_of_a_cohort(spark):
    cell = "layer string, sample_id string, feature_id string, value double"
    full = [("l", f"s{i}", f"f{j}", float(i * j)) for i in range(4) for j in range(3)]
    loadings = spark.createDataFrame([("l", k, f"f{j}", 0.5) for k in (1, 2) for j in range(3)], "layer string, component int, feature_id string, loading double")
    assert same_features(spark.createDataFrame(full, cell), loadings)
    bad = {
        "missing": [r for r in full if r[1:3] != ("s1", "f2")],
        "twice": full + [full[0]],
        "swapped": [r for r in full if r[1:3] != ("s1", "f2")] + [("l", "s1", "f1", 0.0)],
        "extra": full + [("l", f"s{i}", "f9", 0.0) for i in range(4)],
        "absent": [r for r in full if r[2] != "f0"],
        "layer": full + [("m", "s0", f"f{j}", 0.0) for j in range(3)],
        "null": [(a, b, None if c == "f1" else c, d) for a, b, c, d in full],
    }
    for name, rows in bad.items():
        cells = spark.createDataFrame(rows, cell)
        assert not same_features(cells, loadings), name
        if name != "layer":
            with pytest.raises(ContractError):
                project_cohort(cells, loadings, centre="own").count()


@pytest.mark.parametrize("center", ["columns", "none"])
def test_cross_products_summed_in_lanes(spark, center):
    x = np.random.default_rng(4).normal(3, 1, size=(500, 6))
    rows = spark.createDataFrame([("a" if i < 400 else "b", v.tolist()) for i, v in enumerate(x)], "g string, vec array<double>").repartition(11)
    for r in gram_blocks(rows, ["g"], center, lanes=3).collect():
        own = x[:400] if r["g"] == "a" else x[400:]
        own = own - own.mean(axis=0) if center == "columns" else own
        assert r["n"] == len(own) and np.allclose(np.reshape(r["gram"], (6, 6)), own.T @ own)
    assert gram_blocks(rows, ["g"], center, lanes=3).count() == 2
