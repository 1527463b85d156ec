"""Near duplicates by SimHash: meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits exactly if some value lies within r bits of both. So every fingerprint emits
all values of its ball of radius r, equal values meet, and whoever meets is linked; no pair of distant fingerprints is
compared. A ball of radius 2 has 2,081 values of 64 bits, too many to shuffle one by one. They are shuffled by their
leading bits: a fingerprint is sent once for each leading part that values of its ball have (1 + k + k(k-1)/2 rows for
k bits), and the task of that part lays out those values of the ball that start with it.

Definitions:
* a null text is an empty one; a text without words has fingerprint 0, linked like any other;
* texts of fewer words than a shingle are one shingle; shingles count as often as they occur;
* equal fingerprints are joined first, so copies of any number cost one ball;
* the component id is the smallest id reachable; null ids are members but never name a component, unless all are null;
* every row gives one output row; other columns are not read, so their names cannot clash; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewell.llm.base import LOWER_BYTES, stored
from statewell.llm.components import components

BITS = 64
#: Values of all balls that one leading part should hold; with fewer fingerprints the parts only get smaller.
PART_VALUES = 1 << 22
LEAST_LEADING = 10
CHUNK = 1 << 14


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64; shingles are runs of words joined by one blank."""
    return sketch(text, words, 1, seed)[0]


def sketch(text: str | None, words: int, prints: int, seed: int = 42) -> list[int]:
    """Several fingerprints: the first of the hashes themselves, each further one of the hashes mixed anew."""
    found = text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split() if text else []
    if not found:
        return [0] * prints
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - words + 1)
    last = ends[words - 1:] if len(found) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros((prints, BITS), np.int64)
    spans = list(zip(starts[:n].tolist(), last.tolist()))
    for at in range(0, n, CHUNK):
        h = np.fromiter((digest(joined[a:b], seed) for a, b in spans[at:at + CHUNK]), np.uint64, min(CHUNK, n - at))
        for i in range(prints):
            mixed = h if i == 0 else remixed(h, i)
            ones[i] += np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return [int(np.packbits((2 * o > n).astype(np.uint8), bitorder="little").view(np.uint64)[0]) for o in ones]


def remixed(h: np.ndarray, turn: int) -> np.ndarray:
    """Other bits for the same hashes: multiply by an odd number of the turn between two xor-shifts."""
    odd = np.uint64((0x9E3779B97F4A7C15 * (2 * turn + 1)) & 0xFFFFFFFFFFFFFFFF)
    out = (h ^ (h >> np.uint64(32))) * odd
    return out ^ (out >> np.uint64(29))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, carry: list[Column] | None = None, prints: int = 1) -> DataFrame:
    """``(row, id, fp, more)``: the columns ``carry`` of every row, its id, its fingerprint as a signed long and any further ones."""

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([sketch(t.as_py(), words, prints) for t in batch.column(2)], dtype=np.uint64).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1, dtype=np.int32) * prints), pa.array(fps.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["row", "id", "fps"])

    source = docs.select(F.struct(*(carry or [F.col(key)])).alias("row"), F.col(key).alias("id"), F.col(text).alias("text"))
    schema = source.select("row", "id", F.array(F.lit(0).cast("long")).alias("fps")).schema
    found = source.mapInArrow(sketches, schema)
    return found.select("row", "id", F.col("fps")[0].alias("fp"), F.slice("fps", 2, max(1, prints - 1)).alias("more"))


def leading_bits(n: int) -> int:
    """Number of leading bits so that a part holds about PART_VALUES ball values."""
    ball = 1 + BITS + BITS * (BITS - 1) // 2
    return max(LEAST_LEADING, int(np.ceil(np.log2(max(1, n * ball / PART_VALUES)))))


def flips(bits: int, most: int) -> list[np.ndarray]:
    """Masks with exactly 0, 1 .. ``most`` of the lowest ``bits`` bits set."""
    return [
        np.array([sum(1 << b for b in c) for c in combinations(range(bits), r)], dtype=np.uint64) for r in range(most + 1)
    ]


def _sent(fps: DataFrame, leading: int, radius: int) -> DataFrame:
    """``(part, fp)`` for each leading part that the ball of the fingerprint reaches."""
    low = BITS - leading

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = np.concatenate(flips(leading, radius)).astype(np.int64)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 2048):
                piece = fp[at:at + 2048]
                part = ((piece.view(np.uint64) >> np.uint64(low)).astype(np.int64)[:, None] ^ masks[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.repeat(piece, len(masks)))], names=["part", "fp"])

    return fps.select("fp").mapInArrow(send, "part long, fp long")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n vertices; minima and pointer jumps, no loop over edges."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def meet(
    part: int, fp: np.ndarray, leading: int, radius: int, values: int = 2 * PART_VALUES, masks: list[np.ndarray] | None = None, stars: bool = True,
    bits: int = BITS, hubs: bool = False,
) -> tuple[np.ndarray, np.ndarray]:
    """``(fingerprint, root)`` of those that share a ball value starting with ``part``; root is one they reach.

    Without ``stars`` the neighbours at each shared value, or with ``hubs`` each owner beside the smallest one; all of them are
    within twice the radius of each other.

    Values are laid out in passes over a hash of the value, so memory stays bounded whatever meets here.
    """
    low = bits - leading
    fp = np.unique(fp)
    high = np.bitwise_count((fp >> np.uint64(low)) ^ np.uint64(part))
    masks = flips(low, radius) if masks is None else masks
    sets = [(np.nonzero(high == j)[0], np.concatenate(masks[: radius - j + 1])) for j in range(radius + 1)]
    total = sum(len(i) * len(m) for i, m in sets)
    passes = -(-total // values) or 1
    cut = np.uint64((1 << low) - 1)
    links: list[np.ndarray] = []
    for p in range(passes):
        laid, owner = [], []
        for index, mask in sets:
            step = max(1, (1 << 20) // len(mask))
            for at in range(0, len(index), step):
                i = index[at:at + step]
                v = ((fp[i] & cut)[:, None] ^ mask[None, :]).ravel()
                o = np.repeat(i.astype(np.int32), len(mask))
                if passes > 1:
                    mine = (v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(passes) == p
                    v, o = v[mine], o[mine]
                laid.append(v)
                owner.append(o)
        value, owns = np.concatenate(laid), np.concatenate(owner)
        order = np.sort(value)
        shared = order[1:][order[1:] == order[:-1]]
        if not len(shared):
            continue
        shared = np.unique(shared)
        at = np.minimum(np.searchsorted(shared, value), len(shared) - 1)
        hit = shared[at] == value
        at, owns = at[hit], owns[hit]
        turn = np.lexsort((owns, at)) if hubs else np.argsort(at, kind="stable")
        at, owns = at[turn], owns[turn].astype(np.int64)
        same = at[1:] == at[:-1]
        if hubs:
            first = np.flatnonzero(np.r_[True, ~same])
            hub = np.repeat(owns[first], np.diff(np.r_[first, len(owns)]))
            links.append(np.unique((hub * len(fp) + owns)[hub != owns]))
        else:
            links.append(np.unique(owns[:-1][same] * len(fp) + owns[1:][same]))
    if not links:
        return fp[:0], fp[:0]
    pair = np.unique(np.concatenate(links))
    if not stars:
        return fp[pair // len(fp)], fp[pair % len(fp)]
    root = _roots(len(fp), pair // len(fp), pair % len(fp))
    touched = np.unique(np.concatenate([pair // len(fp), pair % len(fp)]))
    moved = touched[root[touched] != touched]
    return fp[moved], fp[root[moved]]


def linked(fps: DataFrame, leading: int, radius: int = 2, stars: bool = True) -> DataFrame:
    """Edges ``(a, b)`` that join all distinct fingerprints within ``2 * radius`` bits; within a part one star per group.

    The groups that a part finds may join fingerprints further apart than that, through others; as components they
    are the same, and the edges stay as few as their members.
    """

    masks = flips(BITS - leading, radius)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = meet(int(pdf["part"].iat[0]), pdf["fp"].to_numpy().view(np.uint64), leading, radius, masks=masks, stars=stars)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return _sent(fps, leading, radius).groupBy("part").applyInPandas(join, "a long, b long")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, distance: int = 4, carry: list[Column] | None = None, prints: int = 1
) -> DataFrame:
    """``(row, id, fp, component_id, root)`` for every row; fingerprints link at ``distance`` or fewer differing bits (an even number).

    With several ``prints`` texts link where any of their fingerprints do.

    ``row`` holds the columns ``carry`` (the id, if none are named); ``root`` is the fingerprint that names the group.
    """
    if distance % 2:
        raise ValueError("distance must be even: a ball has half of it as its radius")
    found = stored(fingerprints(docs, key, text, words, carry, prints), "simhash-prints")
    distinct = stored(found.groupBy("fp").agg(F.min("id").alias("first")), "simhash-distinct")
    edges = linked(distinct, leading_bits(distinct.count()), distance // 2)
    for i in range(1, prints):
        edges = edges.unionByName(bridged(found.select("fp", F.col("more")[i - 1].alias("other")).distinct(), i, distance // 2))
    root = components(edges, "simhash-edges")
    named = distinct.join(root, distinct["fp"] == root["vertex"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    first = named.groupBy("root").agg(F.min("first").alias("component_id"))
    member = named.join(first, "root").select("fp", "root", "component_id")
    return found.join(member, "fp").select("row", "id", "fp", "component_id", "root")


def bridged(pairs: DataFrame, turn: int, radius: int) -> DataFrame:
    """Edges of a further fingerprint ``other``, each of its values a vertex of its own that bridges the first ones it stands beside.

    Only values that link, or stand beside several first fingerprints, become vertices.
    """
    pairs = stored(pairs, "simhash-pairs")
    values = stored(pairs.groupBy("other").agg(F.min("fp").alias("low"), F.max("fp").alias("high")), "simhash-others")
    links = stored(linked(values.select(F.col("other").alias("fp")), leading_bits(values.count()), radius), "simhash-links")
    active = links.select("a").union(links.select("b")).union(values.filter("low < high").select("other")).distinct()
    bridges = pairs.join(active.withColumnRenamed("a", "other"), "other", "left_semi")
    vertex = lambda c: F.xxhash64(F.lit(turn), F.col(c))
    return links.select(vertex("a").alias("a"), vertex("b").alias("b")).unionByName(
        bridges.select(F.col("fp").alias("a"), vertex("other").alias("b"))
    )


def fingerprint_text(fp):
    """16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
