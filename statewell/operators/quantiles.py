"""Exact grouped quantiles without holding a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewell.common import ContractError, materialise, small_side
from statewell.operators.ranking import grouped_running_sum

#: Rows of a bracket up to which one task orders them; wider brackets are ordered in a range-partitioned layout.
ORDERED_ROWS = 1_000_000


def _marks(probs: Sequence[float], accuracy: int) -> list[tuple[float, float]]:
    if not probs or any(not 0.0 <= p <= 1.0 for p in probs):
        raise ContractError("probabilities must lie in [0, 1]")
    margin = 3.0 / accuracy
    return [(max(0.0, p - margin), min(1.0, p + margin)) for p in probs]


def rank_sketch(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], accuracy: int = 10_000, *extra: Column
) -> DataFrame:
    """First pass: count, range, ``extra`` aggregates and a bracket per quantile.

    One materialised row per group, so that later passes can be joined to it
    without shuffling the data while the groups are few.
    """
    flat = [q for pair in _marks(probs, accuracy) for q in pair]
    x = F.col(value).cast("double")
    data = df.select(*keys, x.alias("_x")).filter(F.col("_x").isNotNull())
    return materialise(
        data.groupBy(*keys).agg(
            F.count("_x").alias("_n"),
            F.min("_x").alias("_min"),
            F.max("_x").alias("_max"),
            F.percentile_approx("_x", flat, accuracy).alias("_q"),
            *extra,
        )
    )


def refine_quantiles(
    df: DataFrame, sketch: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], accuracy: int = 10_000,
    ordered_rows: int = ORDERED_ROWS,
) -> DataFrame:
    """Second pass: exact quantiles inside the brackets of ``rank_sketch``."""
    keys = list(keys)
    data = df.select(*keys, F.col(value).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    brackets = ", ".join(
        f"struct({float(p)}D AS prob, {'_min' if lo == 0.0 else f'_q[{2 * i}]'} AS lo, "
        f"{'_max' if hi == 1.0 else f'_q[{2 * i + 1}]'} AS hi)"
        for i, (p, (lo, hi)) in enumerate(zip(probs, _marks(probs, accuracy)))
    )
    bracketed = sketch.select(*keys, "_n", F.expr(f"array({brackets}) AS _b"))
    if keys:
        joined = data.join(small_side(bracketed), keys)
    else:
        joined = data.withColumn("_s", bracketed.select(F.struct("_n", "_b")).scalar()).select("_x", "_s._n", "_s._b")
    # side -1 and 1 hold everything outside the bracket as one row each, with the
    # value next to it: for small groups a wanted rank may be one step outside
    inside = (
        joined.select(*keys, "_n", "_x", F.expr("inline(_b)"))
        .withColumn("_side", F.expr("CASE WHEN _x < lo THEN -1 WHEN _x > hi THEN 1 ELSE 0 END"))
        .groupBy(*keys, "_n", "prob", "_side", F.expr("CASE WHEN _side = 0 THEN _x END AS _v"))
        .agg(F.expr("count(*) AS _c"), F.expr("min(_x) AS _lowest"), F.expr("max(_x) AS _highest"))
    )
    largest = sketch.agg(F.max("_n")).first()[0] or 0
    if largest * 6 / accuracy > ordered_rows:
        summed = grouped_running_sum(inside, [*keys, "prob"], ["_side", "_v"], "_c", "_end")
    else:
        by = ", ".join([*[f"`{k}`" for k in keys], "prob"])
        summed = inside.selectExpr("*", f"sum(_c) OVER (PARTITION BY {by} ORDER BY _side, _v) AS _end")
    ranked = summed.selectExpr("*", "_end - _c AS _start", "(_n - 1) * prob AS _h")

    def at(rank: str) -> str:
        return (
            f"max(CASE WHEN _side = 0 AND _start <= {rank} AND {rank} < _end THEN _v "
            f"WHEN _side = -1 AND {rank} = _end - 1 THEN _highest WHEN _side = 1 AND {rank} = _start THEN _lowest END)"
        )

    picked = ranked.groupBy(*keys, "_n", "prob", "_h").agg(
        F.expr(f"{at('floor(_h)')} AS _a"), F.expr(f"{at('least(floor(_h) + 1, _n - 1)')} AS _b")
    )
    lost = F.raise_error(F.lit("a quantile's rank lies outside its bracket")).cast("double")
    picked = picked.withColumns({c: F.coalesce(c, lost) for c in ("_a", "_b")})
    return picked.select(*keys, "prob", F.expr("_a + (_h - floor(_h)) * (_b - _a) AS q"), F.expr("_n AS n"))


def grouped_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], accuracy: int = 10_000
) -> DataFrame:
    """Exact linear-interpolated (type 7) quantiles: rows ``keys.., prob, q, n``.

    A quantile sketch brackets each wanted rank with a guaranteed rank error of
    ``1/accuracy``; one more pass counts the values outside the bracket and
    groups the distinct values inside it. Only those, about ``6/accuracy`` of a
    group, are ordered, in one task while they are few and else over many.
    """
    return refine_quantiles(df, rank_sketch(df, keys, value, probs, accuracy), keys, value, probs, accuracy)


def grouped_median(df: DataFrame, keys: Sequence[str], value: str, out: str = "median") -> DataFrame:
    got = grouped_quantiles(df, keys, value, [0.5])
    return got.select(*keys, F.col("q").alias(out), F.col("n"))
