import numpy as np
import pytest
from pyspark.sql import functions as F

from statewell.common import ContractError
from statewell.operators import consensus as con, evaluate as ev
from tests.helpers import cells, projector_gap


def brute_consensus(blocks, rank, rounds=100):
    """The dense textbook loop: align, sum, orthonormalise."""
    us = [np.linalg.svd(b, full_matrices=False)[0][:, :rank] for b in blocks]

    def aligned(c):
        total = 0
        for u in us:
            a, _, bt = np.linalg.svd(u.T @ c)
            total = total + u @ (a @ bt)
        return np.linalg.qr(total)[0]

    c = aligned(us[0])
    for _ in range(rounds):
        new = aligned(c)
        gap = np.linalg.norm(new @ new.T - c @ c.T)
        c = new
        if gap < 1e-8:
            break
    return c


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    n, r = 16, 2
    shared = np.linalg.qr(rng.normal(size=(n, r)) - 0)[0]
    shared = np.linalg.qr(shared - shared.mean(0))[0]
    layers, responses = {}, {}
    for name, p in (("A", 7), ("B", 12)):
        b = rng.normal(size=(p, r)) * 6
        layers[name], responses[name] = shared @ b.T + rng.normal(size=(n, p)), b
    return layers, responses, shared


def blocks_of(layers):
    return [(x - x.mean(0)) / np.linalg.norm(x - x.mean(0)) for x in layers.values()]


def narrow(spark, m):
    rows = [(f"s{i:03d}", [float(v) for v in row]) for i, row in enumerate(m)]
    return spark.createDataFrame(rows, "sample_id string, vec array<double>")


def dense(rows):
    return np.array([r.vec for r in rows.orderBy("sample_id").collect()])


@pytest.mark.parametrize("method", ["consensus", "concatenated"])
def test_fit_equals_dense_algorithm(spark, data, method):
    layers, _, _ = data
    fit = con.fit_candidate(cells(spark, layers), method, ["A", "B"], 2, side="features")
    got = dense(fit.scores)
    blocks = blocks_of(layers)
    want = brute_consensus(blocks, 2) if method == "consensus" else np.linalg.svd(np.hstack(blocks))[0][:, :2]
    assert np.allclose(got.T @ got, np.eye(2), atol=1e-8)
    assert projector_gap(got, want) < 1e-6
    responses = {(r.layer, r.feature_id): r.vec for r in fit.responses.collect()}
    for name, block, x in zip(layers, blocks, layers.values()):
        scale = np.linalg.norm(x - x.mean(0))
        expect = np.linalg.solve(got.T @ got, got.T @ block) * scale
        have = np.array([responses[(name, f"f{j:04d}")] for j in range(x.shape[1])]).T
        assert np.allclose(have, expect, atol=1e-7)


def test_projection_equals_dense(spark, data):
    layers, _, _ = data
    fit = con.fit_candidate(cells(spark, layers), "concatenated", ["A", "B"], 2, side="features")
    rng = np.random.default_rng(12)
    new = {k: rng.normal(size=(9, x.shape[1])) for k, x in layers.items()}
    got = dense(con.project_samples(cells(spark, new), fit))
    scores, total = dense(fit.scores), 0
    for name, x in layers.items():
        mean, scale = x.mean(0), np.linalg.norm(x - x.mean(0))
        b = np.linalg.solve(scores.T @ scores, scores.T @ ((x - mean) / scale))
        total = total + ((new[name] - mean) / scale) @ b.T @ np.linalg.inv(b @ b.T)
    assert projector_gap(got, total) < 1e-6
    assert np.allclose(got.T @ got, np.eye(2), atol=1e-9)


@pytest.mark.parametrize("case", ["missing", "extra", "duplicate"])
def test_projection_refuses_other_features(spark, data, case):
    layers, _, _ = data
    fit = con.fit_candidate(cells(spark, layers), "concatenated", ["A", "B"], 2, side="features")
    new = cells(spark, layers)
    if case == "missing":
        new = new.filter("feature_id <> 'f0003'")
    elif case == "extra":
        new = new.union(new.filter("feature_id = 'f0001'").withColumn("feature_id", F.lit("odd")))
    else:
        new = new.union(new.filter("feature_id = 'f0001'"))
    with pytest.raises(ContractError, match=f"{case}_feature"):
        con.project_samples(new, fit)


def test_metrics_equal_dense(spark, data):
    layers, responses, shared = data
    fit = con.fit_candidate(cells(spark, layers), "consensus", ["A", "B"], 2, side="features")
    got = dense(fit.scores)
    truth = narrow(spark, shared)
    share = ev.shared_recovery_error(fit.scores, truth, 2).first()[0]
    assert abs(share - projector_gap(got, shared) / 2) < 1e-8
    rows = [(k, f"f{j:04d}", [float(v) for v in b[j]]) for k, b in responses.items() for j in range(len(b))]
    true_b = spark.createDataFrame(rows, "layer string, feature_id string, vec array<double>")
    have = ev.response_recovery_error(fit.scores, fit.responses, truth, true_b, 2).first()[0]
    fitted = {(r.layer, r.feature_id): r.vec for r in fit.responses.collect()}
    errors = []
    for k, b in responses.items():
        hat = got @ np.array([fitted[(k, f"f{j:04d}")] for j in range(len(b))]).T
        errors.append(np.linalg.norm(hat - shared @ b.T) / np.linalg.norm(shared @ b.T))
    assert abs(have - np.mean(errors)) < 1e-8
    other = np.linalg.qr(np.random.default_rng(13).normal(size=(16, 2)))[0]
    leak = ev.exclusive_leakage(fit.scores, narrow(spark, other).withColumn("layer", F.lit("A")), 2).first()[0]
    assert abs(leak - np.linalg.norm(got.T @ other) / np.sqrt(2)) < 1e-9


def test_row_order_does_not_matter(spark, data):
    layers, _, _ = data
    fits = [con.fit_candidate(cells(spark, layers, p), "consensus", ["A", "B"], 2, side="features") for p in (1, 5)]
    row = con.permutation_invariant(fits[0].scores, fits[1].scores, 2).first()
    assert row.invariant and row.distance < 1e-8
