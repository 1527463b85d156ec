import numpy as np
import pytest
from pyspark.sql import functions as F

from statewell.operators import sketch
from tests.helpers import cells, matrix


@pytest.mark.parametrize("broadcast,dense", [(4_000_000, 8), (0, 0)])
def test_blocks_give_the_svd(spark, monkeypatch, broadcast, dense):
    """Two layers over several blocks of both sides, with vectors broadcast or copied to blocks. One is narrower than the
    number of directions."""
    for name, value in (("BLOCK_CELLS", 60), ("BLOCK_FEATURES", 7), ("BLOCK_SAMPLES", 16), ("CELLS_AT_ONCE", 10)):
        monkeypatch.setattr(sketch, name, value)
    monkeypatch.setattr(sketch, "BROADCAST_VALUES", broadcast)
    monkeypatch.setattr(sketch, "DENSE", dense)
    rng = np.random.default_rng(41)
    layers = {"A": rng.normal(size=(50, 20)) @ np.diag(np.linspace(9, 1, 20)), "B": rng.normal(size=(30, 12)) @ np.diag(np.linspace(5, 1, 12))}
    d = sketch.sketch_components(cells(spark, layers), ["layer"], 3, oversample=20, power=1)
    for name, x in layers.items():
        u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
        here = F.col("layer") == name
        assert np.allclose([r.sigma for r in d.spectrum.filter(here).orderBy("component").collect()], s[:3])
        v = matrix(d.loadings.filter(here), "feature_id", "component", "loading")
        sign = np.sign((v * vt[:3].T).sum(0))
        assert np.allclose(v * sign, vt[:3].T, atol=1e-7)
        scores = matrix(d.scores.filter(here), "sample_id", "component", "coord")
        assert np.allclose(scores * sign, u[:, :3] * s[:3], atol=1e-6)


def test_missing_cells_count_as_their_feature_mean(spark):
    rng = np.random.default_rng(42)
    x, there = rng.normal(size=(40, 9)), rng.random((40, 9)) < 0.4
    long = cells(spark, {"A": np.where(there, x, -99.0)}).filter("value != -99")
    d = sketch.sketch_components(long, ["layer"], 2, oversample=7, power=1)
    mean = (x * there).sum(0) / there.sum(0)
    want = np.linalg.svd(np.where(there, x - mean, 0.0), compute_uv=False)[:2]
    assert np.allclose([r.sigma for r in d.spectrum.orderBy("component").collect()], want)


def test_products_agree():
    rng = np.random.default_rng(43)
    s, f = np.nonzero(rng.random((30, 40)) < 0.1)
    v, w = rng.normal(size=len(s)), rng.normal(size=(40, 5))
    full = np.zeros((30, 40))
    full[s, f] = v
    for dense in (1, 1_000):
        sketch.DENSE, kept = dense, sketch.DENSE
        assert np.allclose(sketch._product(s, f, v, 30, 40, w), full @ w)
        sketch.DENSE = kept
