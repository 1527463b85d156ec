"""Near copies among documents: ball hashing on several short SimHash prints proposes, exact shingles decide.

Texts whose word shingles have a Jaccard similarity of 0.8 differ in about 15 % of SimHash bits. One print of 64 bits then
differs in some ten, out of reach of a ball of radius two. A print of 40 bits differs in four or fewer of them with
probability 0.26 at a similarity of 0.8 (0.57 at 0.9), and twelve prints taken from different bits find 97 % (over 99.9 %).

1. Texts are reduced to their digest; copies of a text are one from here on, and no body travels with them.
2. Every print emits the values of its ball, sent by their leading bits (see ``simhash``). Whoever shares a value is within
   four bits. A part keeps a forest of shortest distances of those pairs, and the forests of the parts that a cluster reaches
   are thinned where the smaller print of an edge belongs: about as many edges as members, however hot a cluster is.
3. Edges whose whole sketches (all 480 bits) are not near either are dropped, so that chance never chains groups together.
4. Components of the edges left over are groups of texts that must be compared. Groups are cut into blocks, each pair of
   blocks is a task, and every pair of its texts is compared by its exact shingles. A task returns its links as a forest.
5. Components of the links are the groups of near copies.

Definitions:
* a null text is an empty one; texts without words have equal, empty shingle sets, which are similar; a text of fewer words than
  a shingle is one shingle; shingles are compared as sets, by 64-bit hashes;
* of each group the row with the smallest id stays (null last); of equal rows one stays;
* texts of any length are read whole; extra columns are carried and not read; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statewell.common import small_side
from statewell.llm.base import LOWER_BYTES, identity, stored
from statewell.llm.components import components
from statewell.llm.simhash import CHUNK, _roots, flips, meet, remixed

PRINTS, BITS, RADIUS = 12, 40, 2
#: Ball values that one leading part should hold.
PART_VALUES = 1 << 22
LEAST_LEADING = 6
#: Prints of one turn whose edges are thinned together.
HOME_PRINTS = 1 << 17
#: Texts of a block; a task compares two blocks. Columns of a block of shingles that are multiplied at once.
BLOCK, COLUMNS = 256, 8192


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle, repeats included; none for a text without words."""
    found = text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - words + 1)
    last = ends[words - 1:] if len(found) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)


def prints_of(hashes: np.ndarray, prints: int = PRINTS, bits: int = BITS) -> np.ndarray:
    """Short SimHash prints from different bits of the hashes and of their remixes; zeros for a text without shingles."""
    total = prints * bits
    ones = np.zeros((-(-total // 64), 64), np.int64)
    for at in range(0, len(hashes), CHUNK):
        h = hashes[at:at + CHUNK]
        for i in range(len(ones)):
            mixed = h if i == 0 else remixed(h, i)
            ones[i] += np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bit = (2 * ones.ravel()[:total] > len(hashes)).astype(np.int64).reshape(prints, bits)
    return (bit << np.arange(bits)).sum(1)


def sketches(docs: DataFrame, key: str, text: str, words: int, prints: int, bits: int) -> DataFrame:
    """``(_k, _no, _h, t, fps)``: identity of the row, digest of its text, its prints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([prints_of(shingle_hashes(t.as_py(), words), prints, bits) for t in batch.column(4)], np.int64).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * prints), pa.array(fps))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], lists], names=["_k", "_no", "_h", "t", "fps"])

    digest = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    source = docs.select(*identity(key, text), digest.alias("t"), F.col(text).alias("text"))
    return source.mapInArrow(run, "_k long, _no boolean, _h long, t binary, fps array<long>")


def forest(n: int, a: np.ndarray, b: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Indexes of the edges of a forest of lowest levels that joins the same vertices as all edges."""
    root, kept = np.arange(n), np.zeros(0, np.int64)
    for lowest in np.unique(level):
        live = np.flatnonzero(level == lowest)
        while len(live):
            ra, rb = root[a[live]], root[b[live]]
            live = live[ra != rb]
            if not len(live):
                break
            ra, rb = root[a[live]], root[b[live]]
            best = np.full(n, len(live))
            order = np.arange(len(live))
            np.minimum.at(best, ra, order)
            np.minimum.at(best, rb, order)
            kept = np.concatenate([kept, live[np.unique(best[best < len(live)])]])
            root = _roots(n, a[kept], b[kept])
    return kept


def thinned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges of a forest of smallest distances among pairs of prints, the smaller print first."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    fp = np.unique(np.concatenate([a, b]))
    i, j = np.searchsorted(fp, a), np.searchsorted(fp, b)
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    kept = forest(len(fp), i, j, np.bitwise_count(fp[i] ^ fp[j]))
    return fp[i[kept]], fp[j[kept]]


def near_prints(values: DataFrame, bits: int, radius: int = RADIUS) -> DataFrame:
    """``(turn, a, b)`` for ``values(turn, fp)``: pairs of one turn within ``2 * radius`` bits that join all such pairs."""
    ball = sum(len(m) for m in flips(bits, radius))
    most = values.groupBy("turn").count().agg(F.max("count")).first()[0] or 0
    leading = max(LEAST_LEADING, int(np.ceil(np.log2(max(1, most * ball / PART_VALUES)))))
    wide = max(1, int(np.ceil(np.log2(max(1, most / HOME_PRINTS)))))
    low = bits - leading
    masks = flips(low, radius)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = np.concatenate(flips(leading, radius)).astype(np.int64)
        for batch in batches:
            turn, fp = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            for at in range(0, len(fp), 2048):
                t, f = turn[at:at + 2048], fp[at:at + 2048]
                part = ((t << leading)[:, None] | ((f >> low)[:, None] ^ near[None, :])).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.repeat(f, len(near)))], names=["part", "fp"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        part, fp = int(pdf["part"].iat[0]), np.unique(pdf["fp"].to_numpy())
        a, b = meet(part & ((1 << leading) - 1), fp.view(np.uint64), leading, radius, masks=masks, stars=False, bits=bits, hubs=True)
        a, b = thinned(a.view(np.int64), b.view(np.int64))
        # the parts of a cluster find much the same edges; they meet where the smaller print of an edge belongs
        return pd.DataFrame({"home": ((part >> leading) << wide) | (a >> (bits - wide)), "a": a, "b": b})

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = thinned(pdf["a"].to_numpy(), pdf["b"].to_numpy())
        return pd.DataFrame({"turn": np.int32(pdf["home"].iat[0] >> wide), "a": a, "b": b})

    sent = values.select("turn", "fp").mapInArrow(send, "part long, fp long")
    found = sent.groupBy("part").applyInPandas(join, "home long, a long, b long")
    return found.groupBy("home").applyInPandas(thin, "turn int, a long, b long")


def proposed(distinct: DataFrame, bits: int, least_share: float = 0.25) -> DataFrame:
    """``(a, b)``, texts that a print brings together and whose sketches differ in at most that share of all bits.

    ``distinct(t, fps)``. Texts of one print hang on the smallest of them; near prints are joined through those.
    """
    member = distinct.select(F.posexplode("fps").alias("turn", "fp"), "t")
    centre = stored(member.groupBy("turn", "fp").agg(F.min("t").alias("c"), F.count("*").alias("n")), "near-centres")
    star = member.join(centre.filter("n > 1").select("turn", "fp", "c"), ["turn", "fp"]).filter("t <> c").select(F.col("t").alias("a"), F.col("c").alias("b"))
    near = stored(near_prints(centre, bits), "near-prints")
    one, two = (centre.select("turn", F.col("fp").alias(f), F.col("c").alias(c)) for f, c in (("a", "x"), ("b", "y")))
    joined = near.join(one, ["turn", "a"]).join(two, ["turn", "b"]).select(F.col("x").alias("a"), F.col("y").alias("b"))
    pairs = stored(star.unionByName(joined).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")
    left, right = (distinct.select(F.col("t").alias(c), F.col("fps").alias(f)) for c, f in (("a", "fa"), ("b", "fb")))
    apart = F.aggregate(F.zip_with("fa", "fb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    both = pairs.join(left, "a").join(right, "b")
    return both.filter(apart <= least_share * bits * F.size("fa")).select("a", "b")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Number of common elements of every two sets of hashes, by products of their 0-1 columns."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    value, at, count = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    common = count[at] > 1
    owner, column = owner[common], number[at[common]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        block = np.zeros((len(sets), COLUMNS), np.float32)
        block[owner[a:b], column[a:b] - first] = 1
        out += (block @ block.T).astype(np.int64)
    return out


def similar(texts: list[str | None], words: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of texts whose shingle sets have at least that Jaccard similarity; two empty sets have 1."""
    sets = [np.unique(shingle_hashes(t, words)) for t in texts]
    size = np.array([len(s) for s in sets])
    common = shared_counts(sets)
    union = size[:, None] + size[None, :] - common
    good = np.where(union > 0, common / np.maximum(union, 1), 1.0) >= similarity
    a, b = np.nonzero(np.triu(good, 1))
    return a, b


def links(edges: DataFrame, texts, words: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """``(a, b)``: a forest of the exact links in every group of the edges' components; ``texts(wanted)`` fetches ``(t, text)``.

    Groups of up to a block share tasks; larger ones are dealt by pairs of blocks, so a task holds two blocks at most and
    no link inside a group is lost.
    """
    group = stored(components(edges, "near-groups").select(F.col("vertex").alias("t"), "root"), "near-members")
    size = stored(group.groupBy("root").agg(F.ceil(F.count("*") / block).alias("blocks"), F.count("*").alias("n")), "near-sizes")
    small = size.filter("blocks = 1").agg(F.ceil(F.sum("n") / block)).first()[0] or 1
    mine = F.pmod(F.xxhash64("t"), F.col("blocks"))
    others = F.expr("sequence(0L, blocks - 1)")
    name = F.when(F.col("blocks") == 1, F.array(F.concat(F.lit("s"), F.pmod(F.xxhash64("root"), F.lit(small)).cast("string")))).otherwise(
        F.transform(others, lambda o: F.concat_ws(":", F.hex("root"), F.least(mine, o).cast("string"), F.greatest(mine, o).cast("string")))
    )
    # a hot group's rows meet one row of sizes; run-time skew splitting deals them
    placed = group.join(small_side(size), "root").select("t", F.explode(name).alias("task"))
    bodies = stored(texts(group.select("t")), "near-texts")

    def hold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("t")
        t = pdf["t"].to_numpy()
        a, b = similar(pdf["text"].tolist(), words, similarity)
        root = _roots(len(t), a, b)
        moved = np.flatnonzero(root != np.arange(len(t)))
        return pd.DataFrame({"a": t[moved], "b": t[root[moved]]})

    return placed.join(bodies, "t").groupBy("task").applyInPandas(hold, "a binary, b binary")


def keep_first(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, prints: int = PRINTS, bits: int = BITS
) -> DataFrame:
    """One row of each group of near copies, the one with the smallest id (null last); same columns."""
    named = ["_k", "_no", "_h"]
    found = stored(sketches(docs, key, text, words, prints, bits), "near-sketches")
    order = F.struct(F.col("_no").alias("no"), F.col("_k").alias("k"), F.col("_h").alias("h"))
    distinct = stored(found.groupBy("t").agg(F.first("fps").alias("fps"), F.min(order).alias("r")), "near-distinct")
    ident = identity(key, text)

    def texts(wanted: DataFrame) -> DataFrame:
        """Bodies of the wanted texts, each from its first row: no other copy of a text is moved."""
        row = stored(distinct.join(wanted, "t", "left_semi").select("t", F.col("r.k").alias("_k"), F.col("r.no").alias("_no"), F.col("r.h").alias("_h")), "near-wanted")
        return docs.select(F.col(text).alias("text"), *ident).join(small_side(row), named).select("t", "text").dropDuplicates(["t"])

    edges = stored(proposed(distinct.select("t", "fps"), bits), "near-edges")
    root = components(links(edges, texts, words, similarity), "near-links")
    grouped = distinct.join(root, distinct["t"] == root["vertex"], "left").select(F.coalesce("root", "t").alias("root"), "r")
    first = grouped.groupBy("root").agg(F.min("r").alias("r")).select(F.col("r.k").alias("_k"), F.col("r.no").alias("_no"), F.col("r.h").alias("_h"))
    rows = docs.select(F.struct("*").alias("row"), *ident).join(first, named, "left_semi")
    same = Window.partitionBy(*named).orderBy(F.lit(1))
    return rows.withColumn("copy", F.row_number().over(same)).filter("copy = 1").select("row.*")
