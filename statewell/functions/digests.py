"""Digests of declarations and table contents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_digest(columns: Sequence[str]) -> Column:
    """SHA-256 over the JSON of the columns in name order."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def hex_number(c: Column, digits: int = 8) -> Column:
    return F.conv(F.substring(c, 1, digits), 16, 10).cast("bigint")


def row_text(columns: Sequence[str]) -> Column:
    """One text for a row: every value after its length, a null as N, so that no two rows share it."""
    parts = [F.col(c).cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("N")) for p in parts])


def content_digest(df: DataFrame, columns: Sequence[str], buckets: int = 256) -> DataFrame:
    """One order-free digest row of a table's content.

    Rows are hashed where they lie and added up per bucket, so only ``buckets``
    rows are shuffled and the result does not depend on partitioning. Added
    hashes keep multiplicity: a repeated row changes the digest.
    """
    hashed = df.select(F.md5(row_text(columns)).alias("_h")).select(
        hex_number(F.col("_h"), 2).alias("_b"), hex_number(F.col("_h"), 15).cast("decimal(38,0)").alias("_v")
    )
    summed = hashed.groupBy(F.pmod("_b", F.lit(buckets)).alias("_b")).agg(
        F.sum("_v").alias("_s"), F.count("*").alias("_n")
    )
    line = F.concat_ws(":", F.lpad(F.col("_b").cast("string"), 3, "0"), F.col("_s").cast("string"), F.col("_n").cast("string"))
    return summed.agg(
        F.sum("_n").alias("n_rows"),
        F.sha2(F.concat_ws(";", F.array_sort(F.collect_list(line))), 256).alias("digest"),
    )
