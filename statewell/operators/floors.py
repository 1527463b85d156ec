"""Thresholds from an oracle's floor: quantiles per condition with order-statistic intervals."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewell.common import ContractError, failed_checks, key_text, materialise, small_side
from statewell.operators.quantiles import grouped_quantiles
from statewell.operators.ranking import grouped_row_number


def beta_part(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_part(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(abs(1.0 - (a + b) * x / (a + 1)), tiny)
    out = d
    for m in range(1, 100_000):
        up = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1.0 / (1.0 + up * d), 1.0 + up / c
        out *= d * c
        down = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1.0 / (1.0 + down * d), 1.0 + down / c
        out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * out


def below(k: int, n: int, q: float) -> float:
    """Probability that fewer than ``k`` of ``n`` observations fall under the quantile ``q``."""
    return 0.0 if k <= 0 else 1.0 if k > n else 1.0 - beta_part(k, n - k + 1, q)


def rank_interval(n: int, q: float, level: float) -> tuple[int | None, int | None]:
    """Ranks from 1 whose values enclose the quantile with probability ``level`` at least, each side's error halved.

    None on a side where ``n`` is too small for any rank. Binary search, so ``n`` may be of any size.
    """
    tail = (1 - level) / 2

    def first(test) -> int:
        low, high = 1, n + 1
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if test(mid) else (mid + 1, high)
        return low

    lower = first(lambda k: below(k, n, q) > tail) - 1
    upper = first(lambda k: below(k, n, q) >= 1 - tail)
    return (lower if lower >= 1 else None), (upper if upper <= n else None)


def floor_thresholds(
    errors: DataFrame, conditions: Sequence[str], margins: Mapping[str, float], metric: str = "metric", value: str = "value", q: float = 0.9,
    level: float = 0.95,
) -> DataFrame:
    """``conditions.., metric, n, median, floor, floor_low, floor_high, margin, threshold`` of an oracle's errors.

    ``errors(conditions.., metric, value)`` has one row per replicate. ``floor`` is the exact ``q`` quantile, its interval
    the order statistics of binomial ranks (null where the replicates are too few), ``threshold`` the floor plus the metric's
    declared margin. Metrics without a margin are left out, null and NaN values too; margins must be positive.
    """
    if not margins or any(not m > 0 for m in margins.values()):
        raise ContractError("margins must be declared and positive")
    keys = [*conditions, metric]
    kept = errors.select(*keys, F.col(value).cast("double").alias("value")).filter(F.col(metric).isin(*margins) & F.col("value").isNotNull() & ~F.isnan("value"))
    found = materialise(grouped_quantiles(kept, keys, "value", [0.5, q]))
    at = lambda p: F.max(F.when(F.abs(F.col("prob") - p) < 1e-12, F.col("q")))
    floor = found.groupBy(*keys).agg(F.max("n").alias("n"), at(0.5).alias("median"), at(q).alias("floor"))

    @F.pandas_udf("struct<low long, high long>")
    def interval(n: pd.Series) -> pd.DataFrame:
        known = {size: rank_interval(int(size), q, level) for size in n.unique()}
        return pd.DataFrame({"low": [known[v][0] for v in n], "high": [known[v][1] for v in n]}).astype("Int64")

    ranked = materialise(floor.withColumn("_k", interval("n")))
    numbered = grouped_row_number(kept, keys, ["value"], "_rank").join(small_side(ranked.select(*keys, "_k")), keys)
    ends = numbered.filter((F.col("_rank") == F.col("_k.low")) | (F.col("_rank") == F.col("_k.high"))).groupBy(*keys).agg(
        F.max(F.when(F.col("_rank") == F.col("_k.low"), F.col("value"))).alias("floor_low"),
        F.max(F.when(F.col("_rank") == F.col("_k.high"), F.col("value"))).alias("floor_high"),
    )
    margin = F.create_map(*[F.lit(v) for v in chain.from_iterable((m, float(x)) for m, x in margins.items())])[F.col(metric)]
    return ranked.join(ends, keys, "left").select(
        *keys, "n", "median", "floor", "floor_low", "floor_high", margin.alias("margin"), (F.col("floor") + margin).alias("threshold")
    )


def floor_violations(medians: DataFrame, thresholds: DataFrame, conditions: Sequence[str], metric: str = "metric", value: str = "median") -> DataFrame:
    """Candidates whose median error of a condition exceeds its threshold, lacks one, or is missing: ``check, key, detail``.

    ``medians(candidate, conditions.., metric, value)``.
    """
    keys = [*conditions, metric]
    limit = small_side(materialise(thresholds.select(*keys, "threshold")))
    both = medians.select("candidate", *keys, F.col(value).alias("_m")).join(limit, keys, "left")
    return failed_checks(both, key_text(["candidate", *keys]), {
        "no_floor": (F.col("threshold").isNull(), "the condition has no floor"),
        "no_value": (F.col("_m").isNull() | F.isnan("_m"), "the candidate has no finite median"),
        "above_floor": (F.col("_m") > F.col("threshold"), F.format_string("%.6f over %.6f", F.col("_m"), F.col("threshold"))),
    })
