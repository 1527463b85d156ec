"""Mixing sources to target weights by balanced sampling (the cube method).

A source's target over its size says how often each of its documents is taken: the whole part always, the rest as an
inclusion probability. The probabilities walk inside the unit cube along directions that keep the weighted document and
word totals (the null space of the constraints) until at most two per block are left between 0 and 1. What is left of
all blocks forms the blocks of the next round, some hundred times fewer rows; the last eight of a source land as near to
their expected words as they can.

Definitions:
* size is the number of words; a null text has none; documents without words can be taken but add nothing;
* sources go by code point with null last; null is a source like any other;
* draws are a fixed function of seed, id, size and block, so reruns agree whatever the number of tasks or lost executors;
* rows with equal id, size and text are interchangeable but walk one by one: each row keeps a decision of its own;
* rows are streamed through a block, so a block's size bounds no memory; other columns are carried in a struct and
  cannot clash; an empty table, or one without words, takes nothing and gives an empty or untouched result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewell.llm.base import identity, stored, word_count

WEIGHTS = (5, 2, 1)
BLOCK = 512
#: Open units that a source's last block leaves to the landing.
LANDING = 8
EPS = 1e-9


def source_sizes(sized: DataFrame) -> DataFrame:
    """``(source, source_size, n, rank)``; ranks from 0 by code point, null last. One row per source."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    return sums.withColumn("rank", F.row_number().over(order) - 1)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Add ``target``: weighted shares of ``share`` times all words, none above ``most`` times its source.

    Sources that reach their limit are fixed there and the excess goes to the others by weight, until none is above;
    each turn is one aggregation over the sources.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    now = stored(sizes.withColumn("weight", weight).withColumn("full", F.lit(False)), "mix-sources")
    whole = share * (now.agg(F.sum("source_size")).first()[0] or 0)
    limit = most * F.col("source_size")
    while True:
        open_ = F.col("full") == F.lit(False)
        left, free, n_full = now.agg(
            F.lit(float(whole)) - F.coalesce(F.sum(F.when(F.col("full"), limit)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(open_, F.col("weight"))), F.lit(0.0)),
            F.count_if("full"),
        ).first()
        unit = left / free if free else 0.0
        now = now.withColumn("full", F.col("full") | (F.lit(unit) * F.col("weight") > limit))
        if now.filter("full").count() == n_full:
            break
    target = F.when(F.col("full"), limit).otherwise(F.lit(unit) * F.col("weight"))
    return now.withColumn("target", target.cast("double")).drop("weight", "full")


def uniform(*parts: object) -> float:
    """A number in [0, 1) fixed by the parts."""
    digest = hashlib.blake2b("|".join(map(str, parts)).encode(), digest_size=8).digest()
    return int.from_bytes(digest, "big") / 2**64


def direction(units: list[list]) -> list[float] | None:
    """A vector orthogonal to the rows (p) and (p * size) over three units, or over two to (p * size) alone.

    The constraints of a balanced draw are sum(s * a / p) with a = p and a = p * size, that is sums of s and of
    s * size; p cancels, which leaves rows (1) and (size).
    """
    if len(units) == 3:
        a, b, c = (u[1] for u in units)
        return [b - c, c - a, a - b] if not a == b == c else [1.0, -1.0, 0.0]
    return None


def move(units: list[list], v: list[float], draw: float) -> None:
    """Walk along +v or -v to the wall of the cube; which way is drawn so that every expectation stays."""
    up = min((1 - u[0]) / x if x > 0 else u[0] / -x for u, x in zip(units, v) if x)
    down = min(u[0] / x if x > 0 else (1 - u[0]) / -x for u, x in zip(units, v) if x)
    step = up if draw * (up + down) < down else -down
    for u, x in zip(units, v):
        u[0] = min(1.0, max(0.0, u[0] + step * x))
        if u[0] < EPS:
            u[0] = 0.0
        elif u[0] > 1 - EPS:
            u[0] = 1.0


def land(units: list[list], draw: float) -> None:
    """Landing: of all ways to take or leave the last units, the one whose words come nearest to what is expected of them.

    The number of documents decides between ways that are equally near, then the draw.
    """
    n = len(units)
    words, docs = sum(u[0] * u[1] for u in units), sum(u[0] for u in units)
    best = None
    for way in range(1 << n):
        taken = [u for i, u in enumerate(units) if way >> i & 1]
        off = (round(abs(sum(u[1] for u in taken) - words), 6), round(abs(len(taken) - docs), 6), (way + int(draw * (1 << n))) % (1 << n))
        best = min(best, (off, way)) if best else (off, way)
    for i, u in enumerate(units):
        u[0] = float(best[1] >> i & 1)


class Walk:
    """The open units of one block; a unit is [p, size, id text, handle]."""

    def __init__(self, seed: int, label: str, last: bool):
        self.seed, self.label, self.last, self.open, self.turn = seed, label, last, [], 0

    def _draw(self) -> float:
        self.turn += 1
        return uniform(self.seed, self.label, self.turn, *(u[2] for u in self.open))

    def add(self, unit: list) -> list[list]:
        """Take a unit in; returns those that are decided now. Three open units walk, in the last block once it has more than it lands."""
        self.open.append(unit)
        if 0.0 < unit[0] < 1.0 and len(self.open) > (LANDING if self.last else 2):
            move(self.open[:3], direction(self.open[:3]), self._draw())
        return self._settled()

    def end(self) -> list[list]:
        """Close the block: the last block of a source lands, others hand their open units on."""
        if self.last and self.open:
            land(self.open, self._draw())
        done, self.open = self.open, []
        return done

    def _settled(self) -> list[list]:
        done = [u for u in self.open if not 0.0 < u[0] < 1.0]
        self.open = [u for u in self.open if 0.0 < u[0] < 1.0]
        return done


def flight(units: DataFrame, seed: int, turn: int, block: int = BLOCK) -> DataFrame:
    """One round: every block of a source walks until at most two of its probabilities are open.

    ``units`` has ``(row, source, size, id, hash, p, rank, n)``, n being the source's open units. The rows come back
    with their new p. Larger documents walk first, so that those handed on are small; in a source's last block they come last,
    so that the landing has the documents whose sums differ most to choose from.
    """
    names, schema = units.columns, units.schema
    p_at, size_at, id_at, rank_at = (names.index(c) for c in ("p", "size", "id", "rank"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, walker, waiting = None, None, {}
        for batch in batches:
            key = list(zip(batch.column(rank_at).to_pylist(), batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()))
            p, size, ident = (batch.column(i).to_pylist() for i in (p_at, size_at, id_at))
            rows = pa.RecordBatch.from_arrays(batch.columns[: len(names)], schema=pa.schema(list(batch.schema)[: len(names)]))
            result: list[float | None] = [None] * len(key)
            held: list[pa.RecordBatch] = []

            def settle(units: list[list]) -> None:
                for u in units:
                    if u[3] is None:
                        held.append(repriced(waiting.pop(id(u)), [u[0]], p_at))
                    else:
                        result[u[3]] = u[0]

            for i, k in enumerate(key):
                if k != now:
                    if walker:
                        settle(walker.end())
                    now, walker = k, Walk(seed, f"{turn}/{k[0]}/{k[1]}", k[2] == 1)
                settle(walker.add([p[i], size[i], ident[i], i]))
            for u in walker.open if walker else []:  # these wait for the next batch with a copy of their row
                if u[3] is not None:
                    waiting[id(u)] = rows.slice(u[3], 1)
                    u[3] = None
            done = [i for i, x in enumerate(result) if x is not None]
            if done:
                yield repriced(rows.take(pa.array(done)), [result[i] for i in done], p_at)
            yield from held
        for u in walker.end() if walker else []:
            yield repriced(waiting.pop(id(u)), [u[0]], p_at)

    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("long")
    laid = units.withColumn("_block", F.pmod(F.col("hash"), blocks)).withColumn("_blocks", blocks)
    turn_order = F.when(F.col("_blocks") == 1, F.col("size")).otherwise(-F.col("size"))
    spread = laid.repartition("rank", "_block").sortWithinPartitions("rank", "_block", turn_order, "hash", "id")
    return spread.mapInArrow(walk, schema)


def repriced(rows: pa.RecordBatch, p: list[float], at: int) -> pa.RecordBatch:
    return rows.set_column(at, rows.schema.field(at), pa.array(p, pa.float64()))


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5, most: float = 2.0, seed: int = 17, block: int = BLOCK, carry: list[str] | None = None, size: Column | None = None,
) -> DataFrame:
    """``(row, source, size, source_size, target, copies)`` for every row; ``copies`` is how often the mix takes it."""
    sized = stored(
        docs.select(
            F.struct(*(docs.columns if carry is None else carry)).alias("row"),
            F.col(source).alias("source"),
            (word_count(F.col(text)) if size is None else size).cast("long").alias("size"),
            F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"),
            F.xxhash64(F.col(key), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")), F.lit(seed)).alias("hash"),
        ),
        "mix-sizes",
    )
    goal = stored(targets(source_sizes(sized.select("source", "size")), weights, share, most), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = goal.select(
        F.col("source").alias("goal_source"), "source_size", "target", "rank", "n",
        F.floor(ratio + EPS).cast("int").alias("whole"), F.greatest(F.lit(0.0), ratio - F.floor(ratio + EPS)).alias("p"),
    )
    same = sized["source"].eqNullSafe(plan["goal_source"])
    units = sized.join(plan, same).select("row", "source", "size", "id", "hash", "p", "rank", "n", "source_size", "target", "whole")
    done, turn = [], 0
    while True:
        moved = stored(flight(units, seed, turn, block), f"mix-flight-{turn}")
        left = F.col("p").between(EPS, 1 - EPS)
        done.append(moved.filter(~left))
        open_ = moved.filter(left)
        if open_.isEmpty():
            break
        units = open_.drop("n").join(open_.groupBy("rank").agg(F.count("*").alias("n")), "rank").select(*units.columns)
        turn += 1
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole.select("row", "source", "size", "source_size", "target", (F.col("whole") + F.round("p").cast("int")).alias("copies"))


def mix_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5,
    most: float = 2.0, seed: int = 17, block: int = BLOCK,
) -> DataFrame:
    """The mix itself: every row as often as it is taken; same columns.

    The walk has ids, sizes and hashes only; the texts are shuffled once, to meet their counts. Equal rows can only differ
    by one copy, so the number of those with the higher count settles them all.
    """
    ident = identity(key, text, source)
    taken = mix(docs.select(key, text, source, *ident), key, text, source, weights, share, most, seed, block, carry=["_k", "_no", "_h"])
    counts = taken.select("row.*", "copies").groupBy("_k", "_no", "_h").agg(F.min("copies").alias("low"), F.max("copies").alias("high"), F.sum("copies").alias("sum"), F.count("*").alias("n"))
    more = F.when(F.col("high") > F.col("low"), F.col("sum") - F.col("n") * F.col("low")).otherwise(F.lit(0))
    counts = counts.filter("high > 0").select("_k", "_no", "_h", "low", more.alias("more"))
    same = Window.partitionBy("_k", "_no", "_h").orderBy(F.lit(1))
    rows = docs.select(F.struct("*").alias("row"), *ident).join(counts, ["_k", "_no", "_h"]).withColumn("nth", F.row_number().over(same))
    copies = F.col("low") + (F.col("nth") <= F.col("more")).cast("int")
    return rows.withColumn("copies", copies).filter("copies > 0").select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")
