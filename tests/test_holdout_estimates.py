import pytest

from statewell.operators import evidence as ev
from statewell.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["b13_accept_holdout", "b14_worst_medians"])
def test_decisions_resample_nothing(spark, monkeypatch, name):
    """Medians decide; before, every decision waited for 10,000 resamples of every group and refused groups too large for ``mix``."""
    def drawn(*args, **kwargs):
        raise AssertionError("resampled")

    want = catalog.queries()[name](spark, SF).collect()
    monkeypatch.setattr(ev, "bootstrap_medians", drawn)
    monkeypatch.setattr(ev, "MIX_LIMIT", 1)
    assert want and catalog.queries()[name](spark, SF).collect() == want
