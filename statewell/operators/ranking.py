"""Row numbers and running sums within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewell.common import materialise


def grouped_row_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str = "row_number", partitions: int | None = None
) -> DataFrame:
    """Exact ``row_number`` per group without a task per group.

    Rows are range-partitioned on keys and order, so a hot group is spread over
    many tasks. The sorted layout is checkpointed, numbered inside each
    partition and shifted by the counts of the partitions before it.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    named = df.withColumns({f"_o{i}": o for i, o in enumerate(order)})
    by = [*[F.col(k) for k in keys], *[F.col(f"_o{i}") for i in range(len(order))]]
    spread = named.repartitionByRange(partitions, *by) if partitions else named.repartitionByRange(*by)
    laid = materialise(spread.withColumn("_pid", F.spark_partition_id()))
    counts = laid.groupBy(*keys, "_pid").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*keys, "_pid", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*keys, "_pid").orderBy(*[F.col(f"_o{i}") for i in range(len(order))])
    numbered = laid.withColumn("_rn", F.row_number().over(inside)).join(shift, [*keys, "_pid"])
    return numbered.withColumn(out, F.col("_rn") + F.col("_shift")).drop(
        "_rn", "_shift", "_pid", *[f"_o{i}" for i in range(len(order))]
    )


def grouped_running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str = "running_sum", partitions: int | None = None
) -> DataFrame:
    """Sum of ``value`` up to and with each row, per group, in the layout of ``grouped_row_number``; orders must not tie."""
    by = [*[F.col(k) for k in keys], *[F.col(o) for o in order]]
    spread = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    laid = materialise(spread.withColumn("_pid", F.spark_partition_id()))
    sums = laid.groupBy(*keys, "_pid").agg(F.sum(value).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select(*keys, "_pid", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*keys, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = laid.withColumn("_rs", F.sum(value).over(inside)).join(shift, [*keys, "_pid"])
    return summed.withColumn(out, F.col("_rs") + F.col("_shift")).drop("_rs", "_shift", "_pid")
