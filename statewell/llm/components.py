"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewell.llm.base import stored


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
    return row[0], row[1] or 0


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """``(vertex, root)`` for every vertex that has an edge; the root is the smallest vertex it reaches.

    ``edges`` has the columns ``a, b``; direction, repetition and loops do not matter, null ends are ignored. A round
    hangs every vertex's larger neighbours under its smallest one, then its smaller ones; the minima are formed before
    the shuffle and joins leave a hot vertex to be split at run time. Long chains shrink geometrically. Edges only are
    shuffled, and each round is stored. An empty table gives an empty result.
    """
    now = stored(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name
    )
    state = _state(now)
    for _ in range(rounds):
        if state[0] == 0:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.greatest("b", "m").alias("x"), F.col("m").alias("y"), "a", "m")
        pairs = small.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        now = stored(pairs.filter("a <> b").distinct(), name)
        before, state = state, _state(now)
        if before == state:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("root")).unionByName(roots)
