"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statewell.common import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A-Z to a-z on UTF-8 bytes; bytes.split() without arguments then cuts at \x20 and \x09-\x0D.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it again.

    Cuts the lineage like ``checkpoint()``, but the files are compressed and
    columnar, so later passes read only the columns they need. An executor that
    is lost afterwards costs nothing. The files stay in the checkpoint folder.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(modulus: int, remainder: int, key: str = "doc_id") -> Column:
    """crc32 of the key as text modulo ``modulus`` equals ``remainder``; a null key counts as the empty text."""
    digest = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    return digest % modulus == remainder


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def identity(key: str, *parts: str) -> list[Column]:
    """Columns that name a row of a table by value: its id, whether that is null, and a hash of further columns.

    Equal rows share them; whoever joins by them tells equal rows apart by counting.
    """
    empty = F.lit(0).cast("long")
    number = F.col(key).cast("long")
    other = F.when(number.isNull(), F.col(key).cast("string"))
    return [
        F.coalesce(number, empty).alias("_k"), number.isNull().alias("_no"),
        F.xxhash64(other, *[F.col(p) for p in parts], *[F.col(p).isNull() for p in parts]).alias("_h"),
    ]
