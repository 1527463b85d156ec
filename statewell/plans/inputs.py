"""The given tables in the roles the operators need."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statewell.operators.evidence import grid_strata
from statewell.plans.registry import table
from statewell.sources.matrix import cells_from_arrays

WIDTH = 64
FEATURES = [f"d{i:03d}" for i in range(WIDTH)]
HALF = WIDTH // 2


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """One layer: embeddings as a sample-by-feature matrix."""
    long = cells_from_arrays(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return long.withColumn("layer", _layer("sample_id"))


def _layer(column: str):
    """The layer as a data column, as it is when cells are read from storage."""
    return F.when(F.col(column).isNotNull(), "all")


def rows(spark: SparkSession, sf: str) -> DataFrame:
    """The same matrix as array rows, read without regrouping."""
    return table(spark, sf, "embeddings").select(
        _layer("vec_id").alias("layer"), F.col("vec_id").cast("string").alias("sample_id"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


def two_layers(spark: SparkSession, sf: str) -> DataFrame:
    """Two layers over shared feature names: first and second half of the vector."""
    pos = F.col("pos")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("sample_id"), F.posexplode("embedding").alias("pos", "v")
    ).select(
        F.when(pos < HALF, "A").otherwise("B").alias("layer"), "sample_id",
        F.concat(F.lit("f"), F.lpad((pos % HALF).cast("string"), 3, "0")).alias("feature_id"),
        F.col("v").cast("double").alias("value"),
    )


def narrow(spark: SparkSession, sf: str, *positions: int) -> DataFrame:
    """A few vector positions as narrow sample rows ``sample_id, vec``."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("sample_id"),
        F.array(*[F.col("embedding")[p].cast("double") for p in positions]).alias("vec"),
    )


def label_loadings(spark: SparkSession, sf: str) -> DataFrame:
    """One axis a label: the mean vectors of all labels."""
    labelled = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    return labelled.groupBy(
        F.lit("all").alias("layer"), (F.col("label") + 1).alias("component"),
        F.concat(F.lit("d"), F.lpad(F.col("pos").cast("string"), 3, "0")).alias("feature_id"),
    ).agg(F.avg(F.col("v").cast("double")).alias("loading"))


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """One-dimensional coordinates per group: balances by market segment."""
    return table(spark, sf, "customer").select(F.col("c_mktsegment").alias("g"), F.col("c_acctbal").alias("x"))


# --- the same inputs in SQL ----------------------------------------------------------

CELLS = """cells AS (SELECT 'all' AS layer, CAST(vec_id AS VARCHAR) AS sample_id, i - 1 AS pos, label,
             'd' || lpad(CAST(i - 1 AS VARCHAR), 3, '0') AS feature_id, CAST(embedding[i] AS DOUBLE) AS value
             FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""

TWO = """cells AS (SELECT CASE WHEN i <= 32 THEN 'A' ELSE 'B' END AS layer, CAST(vec_id AS VARCHAR) AS sample_id,
             'f' || lpad(CAST((i - 1) % 32 AS VARCHAR), 3, '0') AS feature_id, CAST(embedding[i] AS DOUBLE) AS value, label
             FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""

CENTRED = """centred AS (SELECT layer, sample_id, feature_id,
             value - avg(value) OVER (PARTITION BY layer, feature_id) AS v FROM cells)"""

GRAM = """g1 AS MATERIALIZED (SELECT a.layer, a.feature_id AS i, b.feature_id AS j, sum(a.v * b.v) AS v
             FROM centred a JOIN centred b ON a.layer = b.layer AND a.sample_id = b.sample_id GROUP BY ALL)"""


def eigen_sql(k: int, squarings: int = 13, tag: str = "") -> str:
    """CTEs for the ``k`` leading eigenpairs of ``g1(layer, i, j, v)``.

    Repeated squaring of the trace-normalised matrix converges to the projector
    on the leading eigenvector; deflation gives the next one. The results are
    ``loadings`` and ``spectrum``; ``tag`` prefixes every name, the input's too.
    """
    out = []
    for c in range(1, k + 1):
        prev = f"g{c}"
        for t in range(squarings):
            src = (
                f"(SELECT layer, i, j, v / sum(CASE WHEN i = j THEN v END) OVER (PARTITION BY layer) AS v FROM {prev})"
            )
            out.append(f"n{c}_{t} AS MATERIALIZED {src}")
            out.append(
                f"m{c}_{t} AS MATERIALIZED (SELECT a.layer, a.i, b.j, sum(a.v * b.v) AS v FROM n{c}_{t} a "
                f"JOIN n{c}_{t} b ON a.layer = b.layer AND a.j = b.i GROUP BY ALL)"
            )
            prev = f"m{c}_{t}"
        out.append(f"p{c} AS (SELECT layer, arg_max(i, v) AS p, max(v) AS d FROM {prev} WHERE i = j GROUP BY layer)")
        out.append(
            f"r{c} AS (SELECT m.layer, m.i, m.v / sqrt(p.d) AS v FROM {prev} m JOIN p{c} p ON m.layer = p.layer AND m.j = p.p)"
        )
        out.append(
            f"axis{c} AS MATERIALIZED (SELECT layer, i, v / sqrt(sum(v * v) OVER (PARTITION BY layer)) AS v FROM r{c})"
        )
        out.append(
            f"lam{c} AS MATERIALIZED (SELECT g.layer, sum(g.v * a.v * b.v) AS v FROM g{c} g JOIN axis{c} a ON g.layer = a.layer "
            f"AND g.i = a.i JOIN axis{c} b ON g.layer = b.layer AND g.j = b.i GROUP BY g.layer)"
        )
        if c < k:
            out.append(
                f"g{c + 1} AS MATERIALIZED (SELECT g.layer, g.i, g.j, g.v - l.v * a.v * b.v AS v FROM g{c} g JOIN lam{c} l "
                f"ON g.layer = l.layer JOIN axis{c} a ON g.layer = a.layer AND g.i = a.i "
                f"JOIN axis{c} b ON g.layer = b.layer AND g.j = b.i)"
            )
    axes = " UNION ALL ".join(f"SELECT layer, {c} AS component, i AS feature_id, v AS loading FROM axis{c}" for c in range(1, k + 1))
    lams = " UNION ALL ".join(f"SELECT layer, {c} AS component, sqrt(v) AS sigma FROM lam{c}" for c in range(1, k + 1))
    out.append(f"loadings AS MATERIALIZED ({axes})")
    out.append(f"spectrum AS MATERIALIZED ({lams})")
    text = ", ".join(out)
    return re.sub(r"\b([gnmpr]\d+(?:_\d+)?|axis\d+|lam\d+|loadings|spectrum)\b", rf"{tag}\1", text) if tag else text


SCORES = """scores AS MATERIALIZED (SELECT c.layer, c.sample_id, l.component, sum(c.v * l.loading) AS coord
             FROM centred c JOIN loadings l ON c.layer = l.layer AND c.feature_id = l.feature_id GROUP BY ALL)"""


# --- benchmark rows -------------------------------------------------------------------

FIRST, SECOND = "C1_symmetric_consensus", "C2_block_scaled_svd"

BENCH = f"""bench AS MATERIALIZED (
       SELECT candidate, seed, CASE WHEN s_nationkey < 13 THEN 'calibration' ELSE 'holdout' END AS split,
              sha256(stratum) AS stratum_digest, stratum, 'protocol-2' AS protocol_id, 'lineitem' AS generator,
              'p' AS protocol_digest, 'g' AS generator_digest, 'full' AS tier,
              CASE WHEN projection_case = 'missing_id' THEN 'typed_failure' ELSE 'success' END AS gate_expected,
              CASE WHEN projection_case = 'missing_id' THEN 'typed_failure' ELSE 'success' END AS gate_observed,
              TRUE AS gate_passed, projection_case, ln, shared_signal, noise_sd,
              CASE WHEN projection_case = 'exact_ids' THEN disc END AS shared_recovery_error,
              CASE WHEN projection_case = 'exact_ids' THEN price END AS response_recovery_error,
              CASE WHEN projection_case = 'exact_ids' THEN tax END AS exclusive_leakage,
              CASE WHEN projection_case = 'exact_ids' THEN disc + tax END AS projection_error, qty AS elapsed_sec,
              peak AS peak_vcells_bytes
       FROM (SELECT CASE WHEN l_linestatus = 'F' THEN '{FIRST}' ELSE '{SECOND}' END AS candidate, l_suppkey AS seed,
                    l_linenumber AS ln, 'list(K = ' || (2 + l_linenumber % 2) || 'L, missing_block_rate = ' ||
                      CASE WHEN l_linenumber > 5 THEN '0.2' ELSE '0' END || ', flag = ' || l_returnflag || ', line = ' ||
                      l_linenumber || ')' AS stratum,
                    CASE WHEN l_returnflag = 'N' THEN 'missing_id' ELSE 'exact_ids' END AS projection_case,
                    CASE WHEN l_linenumber >= 4 THEN 24.0::DOUBLE ELSE 12.0::DOUBLE END AS shared_signal,
                    CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS noise_sd,
                    avg(l_discount) AS disc, avg(l_tax) AS tax, avg(l_extendedprice) / 100000 AS price,
                    avg(l_quantity) AS qty, max(l_extendedprice) AS peak
             FROM lineitem GROUP BY ALL) JOIN supplier ON seed = s_suppkey)"""


FLAGS, LINES = ("A", "N", "R"), range(1, 8)


def stratum_text(line, flag):
    return F.concat(
        F.lit("list(K = "), (line % 2 + 2).cast("string"), F.lit("L, missing_block_rate = "),
        F.when(line > 5, "0.2").otherwise("0"), F.lit(", flag = "), flag, F.lit(", line = "), line.cast("string"), F.lit(")"),
    )


def frozen_index(spark: SparkSession) -> DataFrame:
    """Strata of the frozen grid of flags and lines with their index, whether rows were seen for them or not."""
    stratum = stratum_text(F.col("line"), F.col("flag"))
    return grid_strata(spark, {"flag": FLAGS, "line": LINES}).select(
        stratum.alias("stratum"), F.sha2(stratum, 256).alias("stratum_digest"), "canonical_index", "line"
    )


def bench_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as benchmark rows: status = candidate, flag and line = stratum, supplier = seed."""
    line = F.col("l_linenumber")
    stratum = stratum_text(line, F.col("l_returnflag"))
    per = table(spark, sf, "lineitem").groupBy(
        F.when(F.col("l_linestatus") == "F", FIRST).otherwise(SECOND).alias("candidate"),
        F.col("l_suppkey").alias("seed"), line.alias("ln"), stratum.alias("stratum"),
        F.when(F.col("l_returnflag") == "N", "missing_id").otherwise("exact_ids").alias("projection_case"),
        F.when(line >= 4, 24.0).otherwise(12.0).alias("shared_signal"),
        F.when(F.col("l_returnflag") == "A", 1.0).otherwise(2.0).alias("noise_sd"),
    ).agg(
        F.avg("l_discount").alias("disc"), F.avg("l_tax").alias("tax"), (F.avg("l_extendedprice") / 100000).alias("price"),
        F.avg("l_quantity").alias("elapsed_sec"), F.max("l_extendedprice").alias("peak_vcells_bytes"),
    )
    split = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("seed"), F.when(F.col("s_nationkey") < 13, "calibration").otherwise("holdout").alias("split")
    )
    exact = F.col("projection_case") == "exact_ids"
    gate = F.when(exact, "success").otherwise("typed_failure")
    return per.join(split, "seed").select(
        "candidate", "seed", "split", F.sha2("stratum", 256).alias("stratum_digest"), "stratum",
        F.lit("protocol-2").alias("protocol_id"), F.lit("lineitem").alias("generator"), F.lit("p").alias("protocol_digest"),
        F.lit("g").alias("generator_digest"), F.lit("full").alias("tier"), gate.alias("gate_expected"),
        gate.alias("gate_observed"), F.lit(True).alias("gate_passed"), "projection_case", "ln", "shared_signal", "noise_sd",
        F.when(exact, F.col("disc")).alias("shared_recovery_error"), F.when(exact, F.col("price")).alias("response_recovery_error"),
        F.when(exact, F.col("tax")).alias("exclusive_leakage"),
        F.when(exact, F.col("disc") + F.col("tax")).alias("projection_error"), "elapsed_sec", "peak_vcells_bytes",
    )
