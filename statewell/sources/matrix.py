"""Matrix sources and reshaping: files, arrays and long cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statewell.common import ContractError, union_all, violation

CELLS = T.StructType(
    [
        T.StructField("layer", T.StringType()),
        T.StructField("sample_id", T.StringType()),
        T.StructField("feature_id", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)
SAMPLE_MAP = T.StructType([T.StructField(c, T.StringType()) for c in ("layer", "primary_id", "sample_id")])


def read_wide_matrix(
    spark: SparkSession, path: str, layer: str, sep: str = "\t", quote: str = '"', gap: str | None = None
) -> DataFrame:
    """Delimited matrix (gzip by extension) to long cells.

    The first column holds feature ids, the other headers are sample ids. Only
    the header is read on the driver, for the column names.
    """
    header = spark.read.option("sep", sep).option("quote", quote).option("header", True).csv(path).columns
    if len(header) < 2 or len(set(header)) != len(header):
        raise ContractError("a matrix needs a feature column and uniquely named samples")
    schema = T.StructType(
        [T.StructField(header[0], T.StringType())] + [T.StructField(c, T.DoubleType()) for c in header[1:]]
    )
    reader = spark.read.schema(schema).option("sep", sep).option("quote", quote).option("header", True)
    wide = reader.option("mode", "FAILFAST").option("nullValue", gap or "NA").csv(path)
    return wide_to_cells(wide, header[0], layer)


def wide_to_cells(wide: DataFrame, feature: str, layer: str) -> DataFrame:
    """Feature rows and sample columns to long cells."""
    samples = [c for c in wide.columns if c != feature]
    long = wide.select(F.col(feature).cast("string").alias("feature_id"), *[F.col(f"`{c}`").cast("double").alias(c) for c in samples])
    return long.unpivot("feature_id", samples, "sample_id", "value").select(
        F.lit(layer).alias("layer"), "sample_id", "feature_id", "value"
    )


def cells_to_wide(cells: DataFrame, features: Sequence[str], keys: Sequence[str] = ("layer",)) -> DataFrame:
    """Long cells to one row per sample; for a short, listed set of features."""
    return cells.groupBy(*keys, "sample_id").pivot("feature_id", list(features)).agg(F.first("value"))


def transpose_cells(cells: DataFrame) -> DataFrame:
    """Swap the roles of samples and features; no data moves."""
    swap = {"sample_id": "feature_id", "feature_id": "sample_id"}
    return cells.select(*[F.col(swap.get(c, c)).alias(c) for c in cells.columns])


def cells_from_arrays(
    df: DataFrame, sample: str, vector: str, layer: str = "all", prefix: str = "d", width: int = 3
) -> DataFrame:
    """Array column to long cells with zero-padded feature ids."""
    pos = F.lpad(F.col("pos").cast("string"), width, "0")
    return df.select(F.col(sample).cast("string").alias("sample_id"), F.posexplode(vector).alias("pos", "v")).select(
        F.lit(layer).alias("layer"),
        "sample_id",
        F.concat(F.lit(prefix), pos).alias("feature_id"),
        F.col("v").cast("double").alias("value"),
    )


def column_set_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Column names (with position) by which two wide matrices differ."""
    spark = a.sparkSession

    def listed(df: DataFrame) -> list[str]:
        return [f"{i}|{c}" for i, c in enumerate(df.columns)]

    left, right = listed(a), listed(b)
    rows = [("column_left_only", c) for c in left if c not in set(right)]
    rows += [("column_right_only", c) for c in right if c not in set(left)]
    return spark.createDataFrame(rows, "check string, key string").withColumn("detail", F.lit("columns differ"))


def id_set_differences(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """S9 on long tables: ids present on one side only, repeats counted."""
    left, right = a.select(column), b.select(column)
    return union_all(
        [
            violation(left.exceptAll(right), "left_only", F.col(column), "absent on the right"),
            violation(right.exceptAll(left), "right_only", F.col(column), "absent on the left"),
        ]
    )


@dataclass(frozen=True)
class Cohort:
    """The tables of one cohort or of many cohorts keyed alike."""

    cells: DataFrame
    sample_map: DataFrame
    samples: DataFrame
    schema_version: str = "1"


def assemble_cohort(
    layers: Mapping[str, DataFrame], samples: DataFrame, sample_map: DataFrame | None = None, schema_version: str = "1"
) -> Cohort:
    """Union of layers' cells; without a map every sample is its own primary."""
    tagged = [
        cells.select(F.lit(name).alias("layer"), "sample_id", "feature_id", F.col("value").cast("double").alias("value"))
        for name, cells in layers.items()
    ]
    cells = union_all(tagged)
    if sample_map is None:
        sample_map = cells.select("layer", F.col("sample_id").alias("primary_id"), "sample_id").distinct()
    return Cohort(cells, sample_map, samples, schema_version)
