import numpy as np
import pandas as pd
import pytest

from statewell.common import ContractError
from statewell.operators import landscape as ls
from statewell.operators.quantiles import grouped_quantiles
from statewell.operators.ranking import grouped_row_number
from tests.helpers import double_well


def observations(spark, **groups):
    pdf = pd.concat([pd.DataFrame({"g": k, "x": np.asarray(v, dtype=float)}) for k, v in groups.items()])
    return spark.createDataFrame(pdf).repartition(5)


def test_double_well_is_recovered(spark):
    x = double_well(np.random.default_rng(21), 300)
    land = ls.landscape(observations(spark, a=x), ["g"])
    pts = land.critical.toPandas()
    wells = pts[pts.kind == "well"].x.to_numpy()
    barriers = pts[pts.kind == "barrier"].x.to_numpy()
    assert len(wells) >= 2 and len(barriers) >= 1
    assert np.mean([np.abs(wells - w).min() for w in (-1, 1)]) < 0.15
    assert np.abs(barriers).min() < 0.3
    heights = land.barriers.toPandas()
    assert np.isfinite(heights[["left_height", "right_height"]].to_numpy(dtype=float)).any()


def test_curve_is_the_exact_density(spark):
    rng = np.random.default_rng(22)
    groups = {"big": rng.normal(size=900), "small": rng.normal(5, 2, size=40)}
    obs = observations(spark, **groups)
    bw = ls.plugin_bandwidth(obs, ["g"])
    h = {r.g: r.h for r in bw.collect()}
    curve = ls.density_curve(obs, bw, ["g"]).toPandas()
    for g, x in groups.items():
        c = curve[curve.g == g].sort_values("i")
        grid = np.linspace(x.min() - 2 * h[g], x.max() + 2 * h[g], 512)
        want = np.exp(-0.5 * ((grid[:, None] - x) / h[g]) ** 2).sum(1) / (len(x) * h[g] * np.sqrt(2 * np.pi))
        assert np.allclose(c.x, grid) and np.allclose(c.density, want, rtol=1e-9, atol=1e-300)
    assert 0.2 < h["big"] < 0.35


def test_small_groups_and_designs_are_refused(spark):
    obs = observations(spark, few=[1, 2, 3, 4], enough=np.arange(30.0) ** 1.5)
    land = ls.landscape(obs, ["g"])
    assert [r["key"] for r in land.violations.collect()] == ["few"]
    assert {r.g for r in land.curve.select("g").distinct().collect()} == {"enough"}
    with pytest.raises(ContractError):
        ls.landscape(obs, ["g"], design="longitudinal")
    with pytest.raises(ContractError):
        ls.select_coordinates(obs, 3, available=2)


def test_exact_zero_slopes_are_dropped(spark):
    u = [3.0, 2.0, 2.0, 3.0, 1.0, 4.0]
    curve = spark.createDataFrame([("a", i, float(i), v) for i, v in enumerate(u)], "g string, i int, x double, u_raw double")
    got = [(r.kind, r.x) for r in ls.critical_points(curve, ["g"]).orderBy("x").collect()]
    # slopes -1 0 1 -2 3: the flat bottom gives no point, then a barrier and a well
    assert [k for k, _ in got] == ["barrier", "well"]


def test_polynomial_meets_its_constraints():
    x = np.linspace(0, 10, 400)
    u = np.cos(x) + 0.01 * x * x
    for points in ([np.pi], [np.pi, 2 * np.pi], [np.pi, 2 * np.pi, 3 * np.pi]):
        fit = ls.constrained_polynomial(x, u, np.array(points))
        if len(points) < 2:
            assert fit is u
            continue
        assert np.allclose(np.interp(points, x, fit), np.interp(points, x, u), atol=1e-3)
        step = 1e-2
        slope = (np.interp(np.array(points) + step, x, fit) - np.interp(np.array(points) - step, x, fit)) / (2 * step)
        assert np.abs(slope).max() < 0.02
    # more constraints than coefficients: plain least squares on all powers
    many = np.linspace(1, 9, 6)
    t, span = 2 * many / 10 - 1, 10.0
    v = t[:, None] ** np.arange(7)
    d = np.array([[k * tt ** (k - 1) * 2 / span if k else 0.0 for k in range(7)] for tt in t])
    coef = np.linalg.lstsq(np.vstack([v, d]), np.r_[np.interp(many, x, u), np.zeros(6)], rcond=None)[0]
    assert np.allclose(ls.constrained_polynomial(x, u, many), ((2 * x / 10 - 1)[:, None] ** np.arange(7)) @ coef, atol=1e-8)


def test_quantiles_with_ties_outliers_and_skew(spark):
    rng = np.random.default_rng(23)
    groups = {
        "ties": rng.integers(0, 3, 500), "outlier": np.r_[rng.normal(size=99), 1e12], "one": [4.0], "two": [1.0, 2.0],
        "hot": np.r_[np.full(3000, 7.0), rng.normal(size=1500)],
    }
    probs = [0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0]
    got = grouped_quantiles(observations(spark, **groups), ["g"], "x", probs).toPandas()
    for g, x in groups.items():
        for p in probs:
            q = got[(got.g == g) & (got.prob == p)].q.iloc[0]
            assert np.isclose(q, np.quantile(np.asarray(x, float), p), rtol=1e-12), (g, p)


def test_coarse_sketch_still_gives_exact_quantiles(spark):
    x = np.random.default_rng(24).normal(size=20_000)
    got = grouped_quantiles(observations(spark, a=x), ["g"], "x", [0.1, 0.5], accuracy=100).toPandas()
    for p in (0.1, 0.5):
        assert np.isclose(got[got.prob == p].q.iloc[0], np.quantile(x, p), rtol=1e-12)


def test_row_numbers_over_many_partitions(spark):
    rng = np.random.default_rng(25)
    pdf = pd.DataFrame({"g": rng.choice(["a", "a", "a", "b"], 2000), "v": rng.integers(0, 50, 2000), "id": np.arange(2000)})
    got = grouped_row_number(spark.createDataFrame(pdf), ["g"], ["v", "id"], "rn", partitions=9).toPandas()
    pdf = pdf.sort_values(["g", "v", "id"])
    pdf["want"] = pdf.groupby("g").cumcount() + 1
    merged = pdf.merge(got, on=["g", "v", "id"])
    assert len(merged) == 2000 and (merged.want == merged.rn).all()


def test_density_2d_integrates_to_one(spark):
    rng = np.random.default_rng(26)
    pdf = pd.DataFrame({"g": "a", "x": rng.normal(size=400), "y": rng.normal(size=400)})
    got = ls.density_2d(spark.createDataFrame(pdf), ["g"], "x", "y", 60).toPandas()
    area = (np.ptp(pdf.x) / 59) * (np.ptp(pdf.y) / 59)
    assert 0.85 < got.density.sum() * area < 1.05
    assert got.count().min() == 3600
