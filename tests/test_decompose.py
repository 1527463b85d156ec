import numpy as np
import pytest
from pyspark.sql import functions as F

from statewell.common import ContractError
from statewell.operators import decompose as dec
from statewell.operators.sketch import sketch_components
from tests.helpers import angle, cells, matrix, planted, projector_gap


def scores_of(d, layer=None):
    s = d.scores if layer is None else d.scores.filter(F.col("layer") == layer)
    return matrix(s, "sample_id", "component", "coord")


@pytest.mark.parametrize("side", ["features", "samples"])
@pytest.mark.parametrize("center", [True, False])
def test_svd_equals_numpy(spark, side, center):
    x = np.random.default_rng(1).normal(size=(18, 11)) + 3
    d = dec.svd(cells(spark, {"A": x}), k=4, center=center, side=side)
    u, s, vt = np.linalg.svd(x - x.mean(0) if center else x, full_matrices=False)
    sigma = [r.sigma for r in d.spectrum.orderBy("component").collect()]
    assert np.allclose(sigma, s[:4], atol=1e-8)
    v = matrix(d.loadings, "feature_id", "component", "loading")
    sign = np.sign((v * vt[:4].T).sum(0))
    assert np.allclose(v * sign, vt[:4].T, atol=1e-7)
    assert np.allclose(scores_of(d) * sign, u[:, :4] * s[:4], atol=1e-7)
    assert all(c[np.argmax(np.abs(c))] > 0 for c in v.T)


@pytest.mark.parametrize("center", [True, False])
def test_array_rows_give_the_scores_of_cells_without_a_shuffle(spark, center):
    """Two layers of different means; a repeated row has scores of its own."""
    rng = np.random.default_rng(14)
    layers = {"A": rng.normal(size=(12, 5)) + 3, "B": rng.normal(size=(9, 5)) * 4 - 1}
    layers["A"][3] = layers["A"][2]
    long = cells(spark, layers)
    rows = spark.createDataFrame(
        [(layer, f"s{i:03d}", row.tolist()) for layer, x in layers.items() for i, row in enumerate(x)],
        "layer string, sample_id string, vec array<double>",
    )
    d = dec.svd(long, k=3, center=center, rows=rows, feature_ids=[f"f{j:04d}" for j in range(5)])
    plain = dec.svd(long, k=3, center=center, side="features")
    for layer in layers:
        assert np.allclose(scores_of(d, layer), scores_of(plain, layer), atol=1e-9)
    assert "Exchange hashpartitioning" not in d.scores._jdf.queryExecution().executedPlan().toString()


def test_partitioning_does_not_change_results(spark):
    x = np.random.default_rng(2).normal(size=(15, 8))
    got = [scores_of(dec.svd(cells(spark, {"A": x}, p), k=3, side="features")) for p in (1, 7)]
    assert np.allclose(got[0], got[1], atol=1e-9)


def test_rank_is_capped_by_centring(spark):
    x = np.random.default_rng(3).normal(size=(4, 9))
    d = dec.svd(cells(spark, {"A": x}), k=6, side="features")
    assert d.spectrum.count() == 3
    warned = dec.rank_warnings(d.spectrum, 6).collect()
    assert [w.code for w in warned] == ["rank_deficient"]


def test_sketch_recovers_leading_components(spark):
    rng = np.random.default_rng(4)
    left, right = np.linalg.qr(rng.normal(size=(40, 4)))[0], np.linalg.qr(rng.normal(size=(30, 4)))[0]
    x = left @ np.diag([50, 30, 20, 10.0]) @ right.T + 0.01 * rng.normal(size=(40, 30))
    d = sketch_components(cells(spark, {"A": x}), ["layer"], 3, oversample=6, power=1)
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose([r.sigma for r in d.spectrum.orderBy("component").collect()], s[:3], rtol=1e-6)
    v = matrix(d.loadings, "feature_id", "component", "loading")
    assert max(angle(v[:, j], vt[j]) for j in range(3)) < 0.01
    assert np.allclose(np.abs(scores_of(d)), np.abs(u[:, :3] * s[:3]), atol=1e-3)


def test_planted_axis_is_recovered(spark):
    layers, v = planted(np.random.default_rng(5), 10, 30, 100, 0.001, specific=5)
    d = dec.decompose(cells(spark, layers), "averaged", k=2)
    got = d.axis(1).orderBy("feature_id").toPandas()["loading"].to_numpy()
    assert angle(got, v) < 1


def test_angle_falls_with_signal(spark):
    rng = np.random.default_rng(6)
    angles = []
    for signal in (10, 50):
        layers, v = planted(rng, 20, 50, signal, 1)
        d = dec.decompose(cells(spark, layers), "averaged", k=1, side="samples")
        angles.append(angle(d.axis(1).orderBy("feature_id").toPandas()["loading"].to_numpy(), v))
    assert angles[1] < angles[0]


def test_averaging_aligns_signs(spark):
    """Opposite arbitrary signs must not cancel the shared axis."""
    layers, v = planted(np.random.default_rng(7), 12, 6, 20, 0.01)
    d = dec.svd(cells(spark, layers), k=1, side="features")
    flipped = d.loadings.withColumn("loading", F.when(F.col("layer") == "L1", -F.col("loading")).otherwise(F.col("loading")))
    axis = dec.average_axes(flipped, d.spectrum).orderBy("feature_id").toPandas()["loading"].to_numpy()
    assert angle(axis, v) < 1


def test_argument_failures(spark):
    data = cells(spark, {"A": np.eye(3)})
    for bad in ({"center": None}, {"k": 0}, {"k": 1.5}, {"k": True}, {"keys": ()}):
        with pytest.raises(ContractError):
            dec.svd(data, side="features", **bad)
    with pytest.raises(ContractError):
        dec.decompose(data, "averaged")
    with pytest.raises(ContractError):
        dec.decompose(cells(spark, {"A": np.eye(3), "B": np.eye(3)}), "svd")


def test_missing_and_infinite_cells_are_refused(spark):
    x = np.random.default_rng(8).normal(size=(6, 4))
    data = cells(spark, {"A": x})
    with pytest.raises(Exception, match="missing cells|reshape"):
        dec.svd(data.filter("NOT (sample_id = 's001' AND feature_id = 'f0002')"), side="features")
    x[2, 1] = np.inf
    with pytest.raises(Exception, match="finite"):
        dec.svd(cells(spark, {"A": x}), side="features")


def test_holes_and_repeats_are_found_while_sizing(spark):
    data = cells(spark, {"A": np.random.default_rng(14).normal(size=(6, 4))})
    for bad in (data.filter("NOT (sample_id = 's001' AND feature_id = 'f0002')"), data.union(data.filter("sample_id = 's001'"))):
        with pytest.raises(ContractError, match="missing cells or repeated"):
            dec.svd(bad)


def test_wide_matrices_use_blocks_and_bounded_tasks(spark):
    """p = 600: several row blocks per matrix and coalesced partials."""
    x = np.random.default_rng(17).normal(size=(700, 600)).astype("float32").astype(float)
    ids = [f"f{j:04d}" for j in range(600)]
    rows = spark.createDataFrame([("A", f"s{i:03d}", [float(v) for v in x[i]]) for i in range(700)], "layer string, sample_id string, vec array<double>")
    d = dec.svd(None, k=5, rows=rows.repartition(40), feature_ids=ids, vectors=False)
    want = np.linalg.svd(x - x.mean(0))[1][:5]
    assert np.allclose([r.sigma for r in d.spectrum.orderBy("component").collect()], want, rtol=1e-9)


def test_many_components_take_several_passes(spark):
    x = np.random.default_rng(15).normal(size=(90, 80))
    d = dec.svd(cells(spark, {"A": x}), k=None, side="features")
    u = scores_of(d)
    v = matrix(d.loadings, "feature_id", "component", "loading")
    assert u.shape[1] == 80 and np.allclose(u @ v.T, x - x.mean(0), atol=1e-7)


def test_pooled_layers_equal_dense(spark):
    rng = np.random.default_rng(16)
    layers = {"A": rng.normal(size=(13, 5)), "B": rng.normal(size=(13, 6))}
    own = dec.svd(cells(spark, layers), k=2, side="features")
    got = matrix(dec.pooled_layer_scores(own.scores, own.spectrum), "sample_id", "component", "coord")
    us = [np.linalg.svd(x - x.mean(0), full_matrices=False)[0][:, :2] for x in layers.values()]
    want = np.linalg.svd(np.hstack(us))[0][:, :2]
    assert projector_gap(got, want) < 1e-6


def test_projection_uses_chosen_means(spark):
    rng = np.random.default_rng(9)
    old, new = rng.normal(size=(9, 5)), rng.normal(size=(7, 5)) + 2
    d = dec.svd(cells(spark, {"A": old}), k=2, side="features")
    v = matrix(d.loadings, "feature_id", "component", "loading")
    for source, mean in ((old, old.mean(0)), (new, new.mean(0))):
        got = dec.project(
            cells(spark, {"A": new}), d.loadings, means=dec.feature_means(cells(spark, {"A": source}))
        )
        assert np.allclose(matrix(got, "sample_id", "component", "coord"), (new - mean) @ v, atol=1e-9)


def test_concatenation_equals_numpy(spark):
    rng = np.random.default_rng(10)
    layers = {"A": rng.normal(size=(14, 5)), "B": 9 * rng.normal(size=(14, 8))}
    blocks = [(x - x.mean(0)) / np.linalg.norm(x - x.mean(0)) for x in layers.values()]
    want = np.linalg.svd(np.hstack(blocks))[1][:2]
    for side in ("features", "samples"):
        got = dec.concatenated_svd(cells(spark, layers), side=side).spectrum.orderBy("component").collect()
        assert np.allclose([r.sigma for r in got], want, atol=1e-9)


def test_every_group_takes_its_own_side(spark, monkeypatch):
    """A tall and a wide group in one call, both exact; beyond the limit on both sides only the sketch."""
    rng = np.random.default_rng(77)
    layers = {"tall": rng.normal(size=(30, 5)), "wide": rng.normal(size=(5, 30))}
    monkeypatch.setattr(dec, "MAX_SIDE", 10)
    d = dec.svd(cells(spark, layers), k=3)
    for name, x in layers.items():
        got = [r.sigma for r in d.spectrum.filter(f"layer = '{name}'").orderBy("component").collect()]
        assert np.allclose(got, np.linalg.svd(x - x.mean(0), compute_uv=False)[:3])
    with pytest.raises(ContractError, match="sketch"):
        dec.svd(cells(spark, {"A": rng.normal(size=(12, 12))}), k=2)


def test_feature_contracts(spark):
    rng = np.random.default_rng(78)
    data = cells(spark, {"A": rng.normal(size=(8, 6)), "B": rng.normal(size=(8, 6))})
    with pytest.raises(ContractError, match="unequal_features"):
        dec.decompose(data.filter("NOT (layer = 'A' AND feature_id = 'f0002')"), "averaged", k=1)
    one = data.filter("layer = 'A'")
    d = dec.svd(one, k=1)
    with pytest.raises(ContractError, match="means"):
        dec.project_cohort(one, d.loadings)
    with pytest.raises(ContractError, match="missing_feature"):
        dec.project_cohort(one.filter("feature_id <> 'f0001'"), d.loadings, dec.feature_means(one))
    assert dec.project_cohort(one, d.loadings, dec.feature_means(one)).count() == 8
