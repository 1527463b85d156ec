"""Near copies are linked by their exact shingles, wherever the prints propose them."""

from itertools import combinations

import numpy as np

from statewell.llm import near_copies

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, words=5):
    w = (text or "").translate(LOW).split()
    return {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def kept(spark, rows, **more):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(r["doc_id"] for r in near_copies.keep_first(frame, **more).collect())


def firsts(rows, similarity=0.8):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    find = lambda i: i if root[i] == i else find(root[i])
    for a, b in combinations(sorted(sets), 2):
        if jaccard(sets[a], sets[b]) >= similarity:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted({find(i) for i in sets})


def words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 5000, n)]


def test_collision_alone_does_not_drop(spark, monkeypatch):
    """Every print is the same, so all texts are compared; only the true copies go."""
    base = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "end"])), (3, " ".join(f"v{i}" for i in range(300))), (4, "a few words"), (5, None), (6, " \n")]
    monkeypatch.setattr(near_copies, "prints_of", lambda h, prints, bits: np.zeros(prints, np.int64))
    assert kept(spark, rows) == [1, 3, 4, 5]


def test_threshold_is_exact():
    texts = ["a b c d e", "a b c d", "a b c", None, ""]
    a, b = near_copies.similar(texts, 1, 0.8)
    assert set(zip(a.tolist(), b.tolist())) == {(0, 1), (3, 4)}


def test_counts_of_common_shingles(monkeypatch):
    monkeypatch.setattr(near_copies, "COLUMNS", 3)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 30, rng.integers(0, 25)).astype(np.uint64)) for _ in range(12)]
    got = near_copies.shared_counts(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(12) for j in range(12) if i != j)


def test_forest_joins_what_all_edges_join():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = int(rng.integers(2, 30))
        a, b = rng.integers(0, n, (2, 60))
        d = rng.integers(1, 5, 60)
        keep = near_copies.forest(n, a, b, d)
        whole, part = near_copies._roots(n, a, b), near_copies._roots(n, a[keep], b[keep])
        assert (whole == part).all() and len(keep) == n - len(set(whole.tolist()))
        # as short as a forest grown edge by edge from the shortest
        root, total = list(range(n)), 0
        for x, y, w in sorted(zip(a, b, d), key=lambda e: e[2]):
            rx, ry = root[x], root[y]
            if rx != ry:
                total += w
                root = [ry if r == rx else r for r in root]
        assert d[keep].sum() == total


def test_near_prints_join_every_close_pair(spark):
    rng = np.random.default_rng(3)
    bits = 16
    fps = np.unique(rng.integers(0, 1 << bits, 120))
    got = near_copies.near_prints(spark.createDataFrame([(t, int(f)) for f in fps for t in (0, 3)], "turn int, fp long"), bits).collect()
    assert {r["turn"] for r in got} == {0, 3}
    assert all((r["a"] ^ r["b"]).bit_count() <= 4 for r in got)
    at = {int(f): i for i, f in enumerate(fps)}
    close = [(i, j) for i, j in combinations(range(len(fps)), 2) if int(fps[i] ^ fps[j]).bit_count() <= 4]
    want = near_copies._roots(len(fps), *np.array(close).T)
    for turn in (0, 3):
        edges = np.array([(at[r["a"]], at[r["b"]]) for r in got if r["turn"] == turn])
        assert (near_copies._roots(len(fps), *edges.T) == want).all()


def test_chain_and_star_of_edits(spark):
    """Neighbours of a chain are similar, its ends are not; a star's copies are similar to the centre, hardly to each other."""
    rng = np.random.default_rng(4)
    rows, text = [], words(rng, 300)
    for i in range(6):
        rows.append((10 + i, " ".join(text)))
        text = [*text[12:], *words(rng, 12)]
    centre = words(rng, 300)
    rows.append((150, " ".join(centre)))
    for i in range(20):
        copy = list(centre)
        for at in rng.choice(300, 6, replace=False):
            copy[at] = f"x{i}-{at}"
        rows.append((100 + i, " ".join(copy)))
    rows += [(200 + i, " ".join(words(rng, 200))) for i in range(30)] + [(200, rows[-1][1]), (7, rows[0][1])]
    rows = list(dict(rows).items())
    want = firsts(rows)
    assert 10 not in want and len([i for i in want if 100 <= i < 200]) == 1
    assert kept(spark, rows) == want


def test_blocks_of_a_large_group(spark, monkeypatch):
    """A group of a hundred texts in blocks of eight gives the same as all pairs at once, whatever is linked through whom."""
    rng = np.random.default_rng(5)
    base = words(rng, 120)
    rows = []
    for i in range(100):
        copy = list(base)
        for at in rng.choice(120, int(rng.integers(1, 5)), replace=False):
            copy[at] = f"y{rng.integers(1000)}"
        rows.append((i, " ".join(copy)))
    monkeypatch.setattr(near_copies.links, "__defaults__", (8,))
    assert kept(spark, rows) == firsts(rows)
