import numpy as np
import pytest

from statewell.operators import evidence as ev


def plain_indexes(seed, mark, n, reps):
    """The formula as SQL writes it."""
    p, a, b, c = 2_147_483_647, 48_271, 104_729, 69_621
    rep, d = np.array(reps, np.int64)[:, None], np.arange(n, dtype=np.int64)[None, :]
    x = (seed * a + mark % p + rep * c + d * b) % p
    for _ in range(2):
        x = (x * x % p + x * a + b) % p
    return x % n


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000, 16_384, 16_385, 70_001, 1_000_000])
def test_draws_follow_the_formula(n):
    for seed, mark, first in ((11001, 0, 0), (11042, 0xFFFFFFFF, 9_990), (0, 2_147_483_646, 5)):
        reps = range(first, first + max(2, min(300, 200_000 // n)))
        assert np.array_equal(ev.mix_indexes(seed, mark, n, reps), plain_indexes(seed, mark, n, reps))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 100, 101, 5_000, 20_001])
@pytest.mark.parametrize("kind", ["normal", "ties", "equal"])
def test_medians_of_draws(n, kind):
    rng = np.random.default_rng(n)
    v = {"normal": rng.normal(size=n), "ties": rng.integers(0, 3, n) / 7, "equal": np.full(n, 0.1)}[kind]
    reps = range(3, 43)
    want = np.median(v[plain_indexes(11007, 99, n, reps)], axis=1)
    assert np.array_equal(ev.mix_medians(v, 11007, 99, reps), want)


def test_medians_outside_the_bracket(monkeypatch):
    """Draws that are not even: a resample whose middle lies far from the group's middle is ordered whole."""
    def slabs(seed, mark, n, reps):
        yield slice(0, len(reps)), slice(0, n), np.stack([np.arange(n) * (r % 3) // 2 % n for r in reps])

    monkeypatch.setattr(ev, "_mix_slabs", slabs)
    v = np.random.default_rng(5).permutation(9_001).astype(float)
    v.sort()
    want = [np.median(v[np.arange(9_001) * (r % 3) // 2 % 9_001]) for r in range(9)]
    assert np.array_equal(ev.mix_medians(v, 1, 1, range(9)), want)


def test_draws_keep_to_little_memory():
    """A task held 2,000,000 draws at a time in several arrays; now about 131,072, whatever the group's size."""
    import tracemalloc

    v = np.random.default_rng(6).normal(size=1_000)
    tracemalloc.start()
    ev.mix_medians(v, 11001, 7, range(4_000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20
