"""Shared helpers: errors, violation rows, lineage cuts, scalar attachment."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Numbers (rows times components) up to which component arrays are broadcast: 32 MB.
BROADCAST_VALUES = 4_000_000

VIOLATION_COLUMNS = ("check", "key", "detail")

#: Rows up to which a small side may be broadcast. Always compared with a real
#: count of a materialised table, never with an estimate.
BROADCAST_ROWS = 200_000


class ContractError(ValueError):
    """A data or argument contract was broken."""


def cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def key_text(names: Sequence[str]) -> Column:
    """One printable key out of several columns; nulls print as NULL."""
    parts = [F.coalesce(F.col(n).cast("string"), F.lit("NULL")) for n in names]
    return F.concat_ws("|", *parts) if parts else F.lit("")


def violation(df: DataFrame, check: str, key: Column | str, detail: Column | str) -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return df.select(
        F.lit(check).alias("check"),
        key.cast("string").alias("key"),
        detail.cast("string").alias("detail"),
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def enforce(violations: DataFrame, shown: int = 5) -> None:
    """Strict mode: raise when a violations table is not empty."""
    rows = violations.take(shown)
    if rows:
        text = "; ".join(f"{r['check']}[{r['key']}]: {r['detail']}" for r in rows)
        raise ContractError(text)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    else:
        raise ContractError("set spark.checkpoint.dir to a folder all executors can reach")


def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(materialised: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a materialised table when its counted size allows it.

    Above the limit the table is returned as it is and the join shuffles, with
    adaptive execution free to split skewed partitions.
    """
    return F.broadcast(materialised) if materialised.limit(limit + 1).count() <= limit else materialised


def with_scalar(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """Attach a one-row, one-column result as a scalar subquery."""
    return df.withColumn(name, one_row.scalar())


def failed_checks(summary: DataFrame, key: Column, checks: dict[str, tuple[Column, Column | str]]) -> DataFrame:
    """Turn one aggregated row per key into violation rows, in a single pass."""
    entries = [
        F.struct(
            F.lit(name).alias("check"),
            key.cast("string").alias("key"),
            (F.lit(detail) if isinstance(detail, str) else detail).cast("string").alias("detail"),
            F.coalesce(bad, F.lit(False)).alias("bad"),
        )
        for name, (bad, detail) in checks.items()
    ]
    return summary.select(F.inline(F.array(*entries))).filter("bad").drop("bad")
