"""Near-duplicate vectors through a pivot-permutation index.

Reference vectors (pivots) are spread over a bounded sample. Every vector is described by its nearest pivots in order;
the inverted lists are kept by sets of ``shared`` pivots, so that vectors meet in a list exactly when they have that many
of their nearest pivots in common. Whoever meets is verified by cosine in double precision; a pair that meets in several
lists is counted in the one of its smallest common pivots. Lists give counts and one star per group, never their pairs.

Definitions:
* vectors that are null, zero, empty or hold null or non-finite components link with nothing and stand alone; so do
  vectors of different lengths from each other;
* equal vectors are one class with a count, so copies of any number cost one entry; its other copies are links of each;
* the component id is the smallest id reachable, null ids never name one unless there is no other;
* every row gives one row, repeated rows included; other columns are not read and cannot clash; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewell.llm.base import stored
from statewell.llm.components import components

#: Bound of the sample that the pivots are chosen from, their number, how many describe a vector, how many must be shared.
SAMPLE, PIVOTS, NEAREST, SHARED = 4096, 512, 6, 3
#: Members of a list up to which it stays one task; longer lists become pairs of blocks of this size.
BLOCK = 512
#: Members up to which the cells of many lists are compared together.
SMALL = 24
BITS = 10


def usable(vector):
    """Neither null nor zero, all components finite numbers."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, good) & F.exists(vector, lambda x: x != 0), F.lit(False))


def levelled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component near 1: squares neither overflow nor vanish, cosines stay."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def spread(sample: np.ndarray, n: int, closest: float) -> np.ndarray:
    """Farthest-first choice of up to n directions, none with a cosine above ``closest`` to another.

    Pivots closer than twice the angle searched for would cut groups of near vectors apart.
    """
    x = levelled(sample)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    chosen, nearest = [0], x @ x[0]
    while len(chosen) < min(n, len(x)):
        at = int(np.argmin(nearest))
        if nearest[at] > closest:
            break
        chosen.append(at)
        nearest = np.maximum(nearest, x @ x[at])
    return x[chosen]


def choose_pivots(vectors: DataFrame, least: float, n: int = PIVOTS, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Pivots by vector length, from the ``sample`` usable vectors that come first by a hash: a bounded set on the driver."""
    rows = vectors.orderBy(F.xxhash64("vector")).limit(sample).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r["vector"]), []).append(r["vector"])
    return {d: spread(np.array(v, float), n, 2 * least * least - 1) for d, v in by.items()}


def random_pivots(dim: int, n: int) -> np.ndarray:
    """For vector lengths that the sample has not met."""
    x = np.random.default_rng(dim).normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def describe(vectors: list, pivots: dict[int, np.ndarray], nearest: int, shared: int) -> tuple[list[int], list[list[int]]]:
    """Of each vector its nearest pivots packed into one number, and the keys of its lists."""
    tops, keys = [0] * len(vectors), [[] for _ in vectors]
    dims = np.array([len(v) for v in vectors])
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        x = levelled(np.array([vectors[i] for i in at], float))
        p = pivots.get(dim)
        p = random_pivots(dim, PIVOTS) if p is None else p
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        k, m = min(nearest, len(p)), min(shared, len(p))
        near = np.sort(np.argsort(-np.round(x @ p.T, 12), axis=1, kind="stable")[:, :k], axis=1)
        packed = np.zeros(len(at), np.int64)
        for j in range(k):
            packed = packed << BITS | (near[:, j] + 1)
        sets = []
        for c in combinations(range(k), m):
            key = np.zeros(len(at), np.int64)
            for j in c:
                key = key << BITS | near[:, j]
            sets.append(key | dim << BITS * shared)
        for i, t, own in zip(at.tolist(), packed.tolist(), np.stack(sets, axis=1).tolist()):
            tops[i], keys[i] = t, own
    return tops, keys


def verify(key: int, cid: np.ndarray, top: np.ndarray, weight: np.ndarray, x: np.ndarray, side: np.ndarray | None, least: float, shared: int):
    """``(cid, links, root)`` of the members of a list that link; links count copies and only pairs that belong to this list.

    With ``side`` the list is a pair of blocks and only pairs across them are looked at.
    """
    n = len(cid)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    links, root = np.zeros(n, np.int64), np.arange(n)
    pivots = unpacked(top)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, n, 1024):
        cos = (x[at:at + 1024] @ x.T) / (norm[at:at + 1024, None] * norm[None, :])
        a, b = np.nonzero(cos >= least)
        a += at
        good = a < b
        if side is not None:
            good &= side[a] != side[b]
        a, b = a[good], b[good]
        if len(a):
            mine = smallest_common(pivots[a], pivots[b], shared) == key & ((1 << BITS * shared) - 1)
            a, b = a[mine], b[mine]
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
            found.append((a, b))
    if found:
        a, b = (np.concatenate(z) for z in zip(*found))
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if np.array_equal(new, root):
                break
            root = new
    hit = links > 0
    return cid[hit], links[hit], cid[root[hit]]


def looker(least: float, shared: int):
    """Task over members sorted by list: cells of up to SMALL members are taken many at once, larger ones one by one."""

    def found(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        columns = [np.concatenate(z) if parts else np.empty(0, np.int64) for z in (zip(*parts) if parts else ((), (), ()))]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cid", "links", "root"])

    def cells(t: pa.Table) -> pa.RecordBatch:
        key, low, high, side, cid, top, weight = (t.column(i).to_numpy() for i in range(7))
        bounds = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]), [True])))
        size = np.diff(bounds)
        cell = np.repeat(np.arange(len(size)), size)
        vectors = t.column(7).combine_chunks()
        values, offsets = vectors.values.to_numpy().astype(float), vectors.offsets.to_numpy()
        row = lambda i, dim: levelled(values[offsets[i][:, None] + np.arange(dim)[None, :]])
        parts = []
        small = np.flatnonzero(np.repeat(size <= SMALL, size))
        for d in range(1, min(SMALL, int(size.max()))):
            a = small[small + d < len(cell)]
            a = a[cell[a] == cell[a + d]]
            b = a + d
            cross = (low[a] == high[a]) | (side[a] != side[b])
            a, b = a[cross], b[cross]
            for dim in np.unique(key[a] >> np.int64(BITS * shared)).tolist():
                mine = key[a] >> np.int64(BITS * shared) == dim
                for at in range(0, int(mine.sum()), 4096):
                    i, j = a[mine][at:at + 4096], b[mine][at:at + 4096]
                    n = int(offsets[i[0] + 1] - offsets[i[0]])
                    x, y = row(i, n), row(j, n)
                    cos = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
                    i, j = i[cos >= least], j[cos >= least]
                    own = smallest_common(unpacked(top[i]), unpacked(top[j]), shared) == key[i] & ((1 << BITS * shared) - 1)
                    i, j = i[own], j[own]
                    parts += [(cid[i], weight[j], cid[i]), (cid[j], weight[i], cid[i])]
        for c in np.flatnonzero(size > SMALL).tolist():
            i = np.arange(bounds[c], bounds[c + 1])
            n = int(offsets[i[0] + 1] - offsets[i[0]])
            across = None if low[i[0]] == high[i[0]] else side[i]
            parts.append(verify(int(key[i[0]]), cid[i], top[i], weight[i], row(i, n), across, least, shared))
        return found(parts)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            key, low, high = (held.column(i).to_numpy() for i in range(3))
            last = np.flatnonzero((key != key[-1]) | (low != low[-1]) | (high != high[-1])) if len(key) else []
            if len(last):
                yield cells(held.slice(0, int(last[-1]) + 1))
                held = held.slice(int(last[-1]) + 1)
        if held is not None and held.num_rows:
            yield cells(held)

    return look


def unpacked(top: np.ndarray) -> np.ndarray:
    return np.stack([(top >> np.int64(BITS * j)) & ((1 << BITS) - 1) for j in range(NEAREST - 1, -1, -1)], axis=1)


def smallest_common(p: np.ndarray, q: np.ndarray, shared: int) -> np.ndarray:
    """The list key (without the vector length) of the smallest pivots that both rows have; rows hold pivot + 1, 0 for none."""
    both = ((p[:, :, None] == q[:, None, :]).any(axis=2)) & (p > 0)
    width = np.minimum(shared, (p > 0).sum(axis=1))
    rank = np.cumsum(both, axis=1)
    out = np.zeros(len(p), np.int64)
    for j in range(p.shape[1]):
        take = both[:, j] & (rank[:, j] <= width)
        out = np.where(take, out << BITS | (p[:, j] - 1), out)
    return out


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.95, nearest: int = NEAREST, shared: int = SHARED
) -> DataFrame:
    """``(key, n_links, component_id, kept)`` for every row of ``vectors``."""
    if nearest > NEAREST:
        raise ValueError(f"at most {NEAREST} pivots describe a vector")
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("vector"))
    rows = rows.withColumn("usable", usable("vector"))
    classes = stored(
        rows.filter("usable").groupBy("vector").agg(F.min("id").alias("first"), F.count("*").alias("n"))
        .withColumn("cid", F.monotonically_increasing_id()), "vector-classes",
    )
    pivots = choose_pivots(classes, least)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            top, keys = describe(batch.column(1).to_pylist(), pivots, nearest, shared)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(top, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["cid", "top", "keys"])

    indexed = stored(classes.select("cid", "vector").mapInArrow(index, "cid long, top long, keys array<long>"), "vector-index")
    entries = indexed.select("cid", "top", F.explode("keys").alias("list"))
    shared_lists = entries.groupBy("list").agg(F.count("*").alias("members")).filter("members > 1")
    met = entries.join(shared_lists, "list").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    block = F.pmod(F.xxhash64("cid", "list"), F.col("blocks")).cast("int")
    cells = met.withColumn("side", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other"))
    members = cells.join(classes.select("cid", "vector", "n"), "cid").select("list", "low", "high", "side", "cid", "top", "n", "vector")

    schema = "cid long, links long, root long"
    laid = members.repartition("list", "low", "high").sortWithinPartitions("list", "low", "high", "cid")
    linked = stored(laid.mapInArrow(looker(least, shared), schema), "vector-links")
    group = components(linked.select(F.col("cid").alias("a"), F.col("root").alias("b")), "vector-edges")
    counted = linked.groupBy("cid").agg(F.sum("links").alias("links"))
    named = (
        classes.join(counted, "cid", "left").join(group.withColumnRenamed("vertex", "cid"), "cid", "left")
        .select("vector", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root"))
    )
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    known = named.join(smallest, "root").select("vector", "n_links", "component_id")
    good = rows.filter("usable").join(known, "vector").select("id", "n_links", "component_id")
    alone = rows.filter("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionByName(alone).select(
        F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
