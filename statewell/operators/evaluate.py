"""Recovery metrics against known truth."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewell.common import materialise, union_all, violation
from statewell.operators.consensus import Fit, project_samples, projector_distance, stacked_gram
from statewell.operators.linalg import small_grams


def subspace_angle(axis: DataFrame, truth: DataFrame, keys: Sequence[str] = (), on: str = "feature_id") -> DataFrame:
    """Angle in degrees between two loading vectors, and their raw cosine."""
    joined = axis.select(*keys, on, F.col("loading").alias("_a")).join(
        truth.select(*keys, on, F.col("loading").alias("_b")), [*keys, on]
    )
    a, b = F.col("_a"), F.col("_b")
    cosine = F.sum(a * b) / (F.sqrt(F.sum(a * a)) * F.sqrt(F.sum(b * b)))
    return joined.groupBy(*keys).agg(cosine.alias("cosine")).withColumn(
        "angle_deg", F.degrees(F.acos(F.least(F.lit(1.0), F.abs("cosine"))))
    )


def potential_recovery(
    critical: DataFrame, barriers: DataFrame, truth: DataFrame, keys: Sequence[str], sign: DataFrame | None = None
) -> DataFrame:
    """Distances of recovered wells, barriers and heights from the truth.

    ``truth(keys.., true_wells ARRAY, true_barrier, true_height)``; ``sign``
    (keys.., sign) turns recovered positions towards the truth. The well error
    needs two recovered wells; metrics without support are null.
    """
    keys = list(keys)
    spots = critical.groupBy(*keys).agg(
        F.collect_list(F.when(F.col("kind") == "well", F.col("x"))).alias("_w"),
        F.collect_list(F.when(F.col("kind") == "barrier", F.col("x"))).alias("_b"),
    )
    heights = barriers.select(*keys, F.explode(F.array("left_height", "right_height")).alias("_h")).groupBy(*keys).agg(
        F.collect_list("_h").alias("_h")
    )
    joined = truth.join(spots, keys, "left").join(heights, keys, "left")
    joined = joined.join(sign, keys, "left") if sign is not None else joined.withColumn("sign", F.lit(1.0))
    empty = F.array().cast("array<double>")
    joined = joined.withColumns({c: F.coalesce(c, empty) for c in ("_w", "_b", "_h")}).withColumn(
        "sign", F.coalesce("sign", F.lit(1.0))
    )

    def nearest(points: str, target):
        return F.array_min(F.transform(points, lambda p: F.abs(p * F.col("sign") - target)))

    per_well = F.aggregate(
        F.transform("true_wells", lambda t: nearest("_w", t)), F.lit(0.0), lambda s, v: s + v
    ) / F.size("true_wells")
    height = F.array_min(F.transform("_h", lambda h: F.abs(h - F.col("true_height"))))
    return joined.select(
        *keys,
        F.when(F.size("_w") >= 2, per_well).alias("well_error"),
        F.when(F.size("_b") >= 1, nearest("_b", F.col("true_barrier"))).alias("barrier_error"),
        F.when(F.size("_h") >= 1, height).alias("barrier_height_error"),
        F.size("_w").alias("n_wells_found"),
        F.size("_b").alias("n_barriers_found"),
    )


def shared_recovery_error(scores: DataFrame, truth: DataFrame, rank: int) -> DataFrame:
    """Projector distance over ``sqrt(2 r)``; truth is orthonormal."""
    return projector_distance(scores, truth, rank).select(
        (F.col("distance") / F.sqrt(F.lit(2.0 * rank))).alias("shared_recovery_error")
    )


def response_recovery_error(
    scores: DataFrame, responses: DataFrame, true_scores: DataFrame, true_responses: DataFrame, rank: int
) -> DataFrame:
    """Mean over layers of the relative error of ``U B`` without building it.

    With ``S = [U_hat U]`` and ``R = [B_hat; -B]`` the squared error is
    ``sum(S'S * RR')``: two small cross-products replace every n x p product.
    """
    s = materialise(
        scores.select("sample_id", F.col("vec").alias("_a"))
        .join(true_scores.select("sample_id", F.col("vec").alias("_b")), "sample_id")
        .select(F.concat("_a", "_b").alias("vec"))
    )
    r = materialise(
        responses.select("layer", "feature_id", F.col("vec").alias("_a"))
        .join(true_responses.select("layer", "feature_id", F.col("vec").alias("_b")), ["layer", "feature_id"])
        .select("layer", F.concat("_a", F.transform("_b", lambda x: -x)).alias("vec"))
    )
    gs = stacked_gram(s, 2 * rank)
    out = []
    for (layer,), gr in sorted(small_grams(r, ["layer"], 2 * rank).items()):
        error = max(0.0, float((gs * gr).sum()))
        target = float((gs[rank:, rank:] * gr[rank:, rank:]).sum())
        out.append((layer, float(np.sqrt(error / target))))
    per = scores.sparkSession.createDataFrame(out, "layer string, error double")
    return per.agg(F.avg("error").alias("response_recovery_error"))


def exclusive_leakage(scores: DataFrame, exclusive: DataFrame, rank: int) -> DataFrame:
    """E5: mean over layers of ``||U_hat' U_ex||_F / sqrt(r)``."""
    joined = scores.select("sample_id", F.col("vec").alias("_a")).join(
        exclusive.select("layer", "sample_id", F.col("vec").alias("_b")), "sample_id"
    )
    cross = joined.groupBy("layer").agg(
        *[F.sum(F.col("_a")[i] * F.col("_b")[j]).alias(f"c{i}_{j}") for i in range(rank) for j in range(rank)]
    )
    squares = sum((F.col(f"c{i}_{j}") * F.col(f"c{i}_{j}") for i in range(rank) for j in range(rank)), F.lit(0.0))
    return cross.select((F.sqrt(squares) / F.sqrt(F.lit(float(rank)))).alias("_l")).agg(
        F.avg("_l").alias("exclusive_leakage")
    )


def projection_error(fit: Fit, holdout: DataFrame, holdout_truth: DataFrame) -> DataFrame:
    """Shared error of held-out samples projected with the fit."""
    projected = project_samples(holdout, fit)
    return projector_distance(projected, holdout_truth, fit.rank).select(
        (F.col("distance") / F.sqrt(F.lit(2.0 * fit.rank))).alias("projection_error")
    )


def recovery_rows(
    axis: DataFrame, truth: DataFrame, first_sigma: DataFrame, threshold: DataFrame, warnings: DataFrame,
    keys: Sequence[str], digits: tuple[int, int] = (2, 2),
) -> DataFrame:
    """Angle, detectability and warnings of every cohort in one job."""
    keys = list(keys)
    warned = warnings.groupBy(*keys).agg(F.count("*").alias("_w"))
    return (
        subspace_angle(axis, truth, keys)
        .join(first_sigma.select(*keys, F.col("sigma")), keys)
        .join(threshold.select(*keys, "threshold"), keys)
        .join(warned, keys, "left")
        .select(
            *keys,
            F.round("angle_deg", digits[0]).alias("angle_deg"),
            F.round("threshold", digits[1]).alias("threshold"),
            (F.col("sigma") >= F.col("threshold")).alias("signal_above_threshold"),
            F.coalesce("_w", F.lit(0)).alias("n_warnings"),
        )
    )


def landscape_recovery_rows(metrics: DataFrame, params: DataFrame, keys: Sequence[str], digits: int = 3) -> DataFrame:
    """Stage-2 recovery of every cohort, rounded for the report."""
    return metrics.join(params, list(keys)).select(
        *keys, "n_obs", F.col("h").alias("bandwidth"),
        *[F.round(c, digits).alias(c) for c in ("well_error", "barrier_error", "barrier_height_error")],
        "n_wells_found", "n_barriers_found",
    )


def calibration_rows(
    axis: DataFrame, true_axis: DataFrame, critical: DataFrame, barriers: DataFrame, truth: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Angle, orientation and Stage-2 metrics; the flip precedes E2."""
    keys = list(keys)
    angle = subspace_angle(axis, true_axis, keys)
    sign = angle.select(*keys, F.when(F.col("cosine") < 0, -1.0).otherwise(1.0).alias("sign"))
    metrics = potential_recovery(critical, barriers, truth, keys, sign)
    return (
        angle.select(*keys, F.col("angle_deg").alias("subspace_angle_deg"), (F.col("cosine") < 0).alias("orientation_flipped"))
        .join(truth.select(*keys, F.col("true_height").alias("true_barrier_height")), keys)
        .join(metrics, keys)
    )


# Failure reasons written to benchmark rows.
CONTROL_FAILED_AS_EXPECTED = "expected projection feature-ID typed failure"
CONTROL_DID_NOT_FAIL = "missing-ID negative control did not produce a typed failure"

NUMERIC_METRICS = ("shared_recovery_error", "response_recovery_error", "exclusive_leakage", "projection_error")


def gate_columns(rows: DataFrame) -> DataFrame:
    """Expected and observed gate, pass flag, metrics and failure reason.

    Needs booleans ``sample_map_aligned``, ``heterogeneous_features``,
    ``extra_rejected``, ``missing_rejected``, ``permutation_invariant`` and
    ``projection_case``. Negative controls (``missing_id``) carry no metrics.
    """
    negative = F.col("projection_case") == "missing_id"
    base = (
        F.col("sample_map_aligned") & F.col("heterogeneous_features") & F.col("extra_rejected")
        & F.col("permutation_invariant")
    )
    passed = F.when(negative, F.col("missing_rejected")).otherwise(base & F.col("missing_rejected"))
    out = rows.withColumns(
        {
            "gate_expected": F.when(negative, "typed_failure").otherwise("success"),
            "gate_observed": F.when(negative, F.when(passed, "typed_failure").otherwise("unexpected_success")).otherwise(
                F.when(passed, "success").otherwise("failure")
            ),
            "gate_passed": passed,
            "failure_reason": F.when(
                negative,
                F.when(passed, CONTROL_FAILED_AS_EXPECTED).otherwise(CONTROL_DID_NOT_FAIL),
            ),
        }
    )
    return out.withColumns({m: F.when(~negative, F.col(m)) for m in NUMERIC_METRICS if m in rows.columns})


def alignment_gates(cohort: DataFrame, samples: DataFrame, cells: DataFrame) -> DataFrame:
    """Cohort ids known to the metadata; layers differ in feature count."""
    lost = cohort.join(samples.select("primary_id"), "primary_id", "left_anti").agg(F.count("*").alias("n"))
    per = cells.select("layer", "feature_id").distinct().groupBy("layer").agg(F.count("*").alias("p"))
    return per.agg((F.min("p") != F.max("p")).alias("heterogeneous_features")).select(
        (lost.scalar() == 0).alias("sample_map_aligned"), "heterogeneous_features"
    )


def gate_violations(gates: DataFrame) -> DataFrame:
    return union_all(
        [violation(gates.filter(~F.col(c)), "gate", F.lit(c), "gate is false") for c in gates.columns]
    )
