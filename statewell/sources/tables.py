"""Metadata and result tables, and digest manifests of files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statewell.common import ContractError, failed_checks, key_text, union_all, violation
from statewell.functions.digests import content_digest
from statewell.operators.prep import duplicate_violations

# Column names and order of the sample-time mapping file.
SAMPLE_TIMES = T.StructType(
    [
        T.StructField("expression_name", T.StringType()),
        T.StructField("library_id", T.StringType()),
        T.StructField("source_cohort", T.StringType()),
        T.StructField("prepared_layer", T.StringType()),
        T.StructField("mouse_id", T.StringType()),
        T.StructField("sample_weeks", T.DoubleType()),
    ]
)
# Column names and order of the experiment metadata file.
EXPERIMENT_METADATA = T.StructType(
    [
        T.StructField("experiment", T.StringType()),
        T.StructField("matrix_sample_id", T.StringType()),
        T.StructField("include", T.BooleanType()),
        T.StructField("exclusion_reason", T.StringType()),
        T.StructField("genotype", T.StringType()),
        T.StructField("temperature_c", T.IntegerType()),
        T.StructField("stage", T.StringType()),
        T.StructField("day", T.IntegerType()),
        T.StructField("tissue", T.StringType()),
        T.StructField("biological_unit", T.StringType()),
        T.StructField("source_group", T.StringType()),
        T.StructField("source_deg_id", T.StringType()),
        T.StructField("metadata_status", T.StringType()),
    ]
)


def read_strict_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """Header must equal the schema, and every field must parse."""
    header = spark.read.option("header", True).option("sep", sep).csv(path).columns
    if header != schema.fieldNames():
        raise ContractError(f"unexpected schema: {header}")
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("sep", sep)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def completeness_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls, and NaN or infinite numbers, counted per column in one pass."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def bad(c: str):
        is_bad = F.col(c).isNull()
        if isinstance(kinds[c], (T.DoubleType, T.FloatType)):
            is_bad = is_bad | F.isnan(c) | (F.abs(c) == float("inf"))
        return F.count_if(is_bad).alias(c)

    summary = df.agg(*[bad(c) for c in columns])
    checks = {f"incomplete_{c}": (F.col(c) > 0, F.format_string("%d rows", F.col(c))) for c in columns}
    return failed_checks(summary, F.lit(""), checks)


def read_sample_times(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The sample-time mapping and its violations."""
    df = read_strict_csv(spark, path, SAMPLE_TIMES)
    bad = union_all(
        [
            completeness_violations(df, SAMPLE_TIMES.fieldNames()),
            duplicate_violations(df, ["expression_name"], "duplicate_expression_name"),
            duplicate_violations(df, ["library_id"], "duplicate_library_id"),
        ]
    )
    return df, bad


def conform(df: DataFrame, schema: T.StructType = EXPERIMENT_METADATA) -> DataFrame:
    """S3: the schema's columns, in order and typed; absent ones are null."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Parallel sink; CSV gets a header per part file."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).option("nullValue", "").csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ContractError(f"unknown format {fmt}")


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet") -> DataFrame:
    if fmt == "csv":
        if schema is None:
            raise ContractError("a CSV table needs its schema")
        return spark.read.schema(schema).option("header", True).csv(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


# --- digest manifests -----------------------------------------------------------


def digest_manifest(spark: SparkSession, root: str, skip: Sequence[str] = ("hashes.csv",)) -> DataFrame:
    """Relative path and SHA-256 of every file below ``root``.

    Files are read and hashed in the tasks; one file must fit a task (2 GiB).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    name = F.element_at(F.split("path", base, 2), 2)
    out = files.select(name.alias("file"), F.sha2("content", 256).alias("sha256"))
    return out.filter(~F.col("file").isin(list(skip)))


def payload_digest(manifest: DataFrame) -> DataFrame:
    """One digest over all files, independent of their listing order."""
    return content_digest(manifest, ["file", "sha256"]).select(
        F.col("n_rows").alias("files"), F.col("digest").alias("payload_digest")
    )


def verify_manifest(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """Status of every declared or observed file."""
    d = declared.select("file", F.col("sha256").alias("declared"))
    o = observed.select("file", F.col("sha256").alias("observed"))
    d1 = d.groupBy("file").agg(F.count("*").alias("_n"), F.min("declared").alias("declared"))
    status = (
        F.when(F.col("file").rlike(r"(^/|\.\.)"), "unsafe_path")
        .when(F.col("_n") > 1, "duplicate")
        .when(F.col("observed").isNull(), "missing")
        .when(F.col("_n").isNull(), "undeclared")
        .when(F.col("declared").eqNullSafe(F.col("observed")), "ok")
        .otherwise("altered")
    )
    return d1.join(o, "file", "full_outer").select("file", status.alias("status"))


def manifest_problems(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """The failing files as violation rows."""
    bad = verify_manifest(declared, observed).filter(F.col("status") != "ok")
    return violation(bad, "manifest", key_text(["file"]), F.col("status"))
