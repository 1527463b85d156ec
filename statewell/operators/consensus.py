"""Multi-layer consensus, responses and projection of new samples.

Sample scores are rows ``sample_id, vec`` with a narrow array of ``rank``
numbers. All iterations run on the small cross-products of the stacked layer
scores, because every iterate is a combination of them; the data are read once
for those products and once for the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewell.common import ContractError, enforce, materialise, violation
from statewell.operators.contracts import feature_identity_violations
from statewell.operators.decompose import _sums, block_scale, layer_scaling, svd, unit_scores
from statewell.operators.linalg import linear_map, small_grams


def pack(long: DataFrame, by: str, width_order: Sequence[str], value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Long components to one narrow array per row, ordered by ``width_order``."""
    return long.groupBy(*keys, by).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(*width_order, F.col(value).alias("_v")))), lambda s: s["_v"]
        ).alias("vec")
    )


def unpack(rows: DataFrame, by: str, value: str = "coord", keys: Sequence[str] = ()) -> DataFrame:
    return rows.select(*keys, by, F.posexplode("vec").alias("_p", value)).select(
        *keys, by, (F.col("_p") + 1).alias("component"), value
    )


def _sole(grams: dict) -> np.ndarray:
    return next(iter(grams.values()))


def stacked_gram(rows: DataFrame, width: int) -> np.ndarray:
    return _sole(small_grams(rows.withColumn("_one", F.lit(1)), ["_one"], width))


def _orthonormal(coef: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Coefficients of an orthonormal basis of the same span (Cholesky QR)."""
    for _ in range(2):
        upper = np.linalg.cholesky(coef.T @ gram @ coef).T
        coef = np.linalg.solve(upper.T, coef.T).T
    return coef


def _projector_gap(a: np.ndarray, b: np.ndarray, gram: np.ndarray) -> float:
    """``||P_a - P_b||_F`` for orthonormal coefficient blocks, by the residual."""
    rest = b - a @ (a.T @ gram @ b)
    return float(np.sqrt(max(0.0, 2 * np.trace(rest.T @ gram @ rest))))


@dataclass(frozen=True)
class Consensus:
    scores: DataFrame
    iterations: int


def consensus_scores(
    layer_scores: DataFrame, layers: Sequence[str], rank: int = 2, tolerance: float = 1e-8, limit: int = 100,
    align_start: bool = True,
) -> Consensus:
    """Symmetric consensus of per-layer unit scores.

    ``layer_scores(layer, sample_id, component, coord)`` are left singular
    vectors. Each round aligns every layer to the consensus by orthogonal
    Procrustes and orthonormalises the sum, until the projector settles.

    The signs of singular vectors are arbitrary and a plain sum of them can
    start, and stay, at a difference of layers. By default the layers are
    therefore turned towards the first one before the first sum;
    ``align_start=False`` sums them as they come.
    """
    width = len(layers) * rank
    wanted = layer_scores.filter(F.col("component") <= rank).withColumn(
        "_l", F.array_position(F.array(*[F.lit(x) for x in layers]), F.col("layer"))
    )
    rows = materialise(pack(wanted, "sample_id", ["_l", "component"], "coord"))
    uneven = rows.filter(F.size("vec") != width)
    enforce(violation(uneven, "incomplete_sample", "sample_id", F.format_string("%d of %d layer scores", F.size("vec"), F.lit(width))))
    gram = stacked_gram(rows, width)
    parts = [np.eye(width)[:, i * rank : (i + 1) * rank] for i in range(len(layers))]

    def aligned(target: np.ndarray) -> np.ndarray:
        total = np.zeros_like(target)
        for part in parts:
            u, _, vt = np.linalg.svd(part.T @ gram @ target)
            total += part @ (u @ vt)
        return total

    coef = _orthonormal(aligned(parts[0]) if align_start else sum(parts), gram)
    rounds = 0
    for rounds in range(1, limit + 1):
        new = _orthonormal(aligned(coef), gram)
        gap = _projector_gap(coef, new, gram)
        coef = new
        if gap < tolerance:
            break
    return Consensus(rows.select("sample_id", linear_map("vec", coef)), rounds)


@dataclass(frozen=True)
class Fit:
    """One fitted candidate: scores, responses and the scaling they rest on."""

    scores: DataFrame
    responses: DataFrame
    scaling: DataFrame
    rank: int
    iterations: int | None


def _small_inverse(gram: np.ndarray, what: str) -> np.ndarray:
    if np.linalg.cond(gram) > 1e14:
        raise ContractError(f"{what} are not linearly independent")
    return np.linalg.inv(gram)


def response_regression(prepared: DataFrame, scores: DataFrame, scaling: DataFrame, rank: int) -> DataFrame:
    """``(S'S)^-1 S'X`` times the block scale, one array per feature."""
    inverse = _small_inverse(stacked_gram(scores, rank), "scores")
    sums = (
        prepared.join(scores.withColumnRenamed("vec", "w"), "sample_id")
        .groupBy("layer", "feature_id")
        .agg(*_sums("w", F.col("value"), rank))
    )
    raw = sums.select("layer", "feature_id", F.array(*[F.col(f"_s{j}") for j in range(rank)]).alias("vec"))
    mapped = raw.select("layer", "feature_id", linear_map("vec", inverse))
    scale = F.col("block_scale")
    return mapped.join(scaling.select("layer", "feature_id", "block_scale"), ["layer", "feature_id"]).select(
        "layer", "feature_id", F.transform("vec", lambda x: x * scale).alias("vec")
    )


def fit_candidate(
    cells: DataFrame, method: str, layers: Sequence[str], rank: int = 2, side: str | None = None
) -> Fit:
    """Scale the layers, fit C1 (``consensus``) or C2 (``concatenated``), regress."""
    scaling = materialise(layer_scaling(cells))
    prepared = block_scale(cells, scaling)
    rounds = None
    if method == "consensus":
        own = svd(prepared, ("layer",), rank, center=False, side=side)
        found = consensus_scores(unit_scores(own.scores, own.spectrum), layers, rank)
        scores, rounds = found.scores, found.iterations
    elif method == "concatenated":
        joined = prepared.select(
            F.lit("all").alias("layer"), "sample_id",
            F.concat_ws(":", "layer", "feature_id").alias("feature_id"), "value",
        )
        both = svd(joined, ("layer",), rank, center=False, side=side)
        scores = pack(unit_scores(both.scores, both.spectrum), "sample_id", ["component"], "coord")
    else:
        raise ContractError(f"unknown candidate {method}")
    scores = materialise(scores)
    responses = materialise(response_regression(prepared, scores, scaling, rank))
    return Fit(scores, responses, scaling, rank, rounds)


def project_samples(new: DataFrame, fit: Fit, strict: bool = True) -> DataFrame:
    """Orthonormal scores of new samples by pseudo-inverse responses.

    Uses discovery means and scales; feature ids must match them exactly.
    """
    if strict:
        per_feature = new.groupBy("layer", "feature_id", "sample_id").agg(F.count("*").alias("_n"))
        ids = per_feature.groupBy("layer", "feature_id").agg(F.max("_n").alias("_n")).select(
            "layer", "feature_id", F.explode(F.array_repeat(F.lit(1), F.least("_n", F.lit(2)).cast("int"))).alias("_x")
        )
        enforce(feature_identity_violations(ids, fit.scaling))
    rank = fit.rank
    scaled = fit.responses.join(fit.scaling, ["layer", "feature_id"]).select(
        "layer", "feature_id", "mean", "block_scale",
        F.transform("vec", lambda x: x / F.col("block_scale")).alias("b"),
    )
    grams = small_grams(scaled.withColumnRenamed("b", "vec"), ["layer"], rank)
    inverses = {k[0]: _small_inverse(g, "responses") for k, g in grams.items()}
    value = (F.col("value") - F.col("mean")) / F.col("block_scale")
    sums = new.join(scaled, ["layer", "feature_id"]).groupBy("layer", "sample_id").agg(*_sums("b", value, rank))
    raw = sums.select("layer", "sample_id", F.array(*[F.col(f"_s{j}") for j in range(rank)]).alias("vec"))
    mapped = F.lit(None).cast("array<double>")
    for layer, inverse in inverses.items():
        mapped = F.when(F.col("layer") == layer, linear_map("vec", inverse)).otherwise(mapped)
    total = materialise(
        raw.select("sample_id", mapped.alias("vec"))
        .groupBy("sample_id")
        .agg(F.array(*[F.sum(F.col("vec")[j]) for j in range(rank)]).alias("vec"))
    )
    return orthonormalise(total, rank)


def orthonormalise(rows: DataFrame, rank: int) -> DataFrame:
    """Orthonormal columns with the same span (Cholesky QR, applied twice)."""
    for _ in range(2):
        gram = stacked_gram(rows, rank)
        upper = np.linalg.cholesky(gram).T
        rows = rows.select("sample_id", linear_map("vec", np.linalg.inv(upper)))
    return rows


def projector_distance(a: DataFrame, b: DataFrame, rank_a: int, rank_b: int | None = None) -> DataFrame:
    """``||P_a - P_b||_F`` of two orthonormal score sets, one row.

    Residual form for equal ranks: the small cross-product is formed first and
    one more pass sums squared residuals, which keeps digits near zero.
    """
    rank_b = rank_b or rank_a
    if rank_a != rank_b:
        raise ContractError("projector distance needs equal ranks")
    both = a.select("sample_id", F.col("vec").alias("_a")).join(
        b.select("sample_id", F.col("vec").alias("_b")), "sample_id", "full_outer"
    )
    zero = F.array(*[F.lit(0.0)] * rank_a)
    both = both.select(F.coalesce("_a", zero).alias("_a"), F.coalesce("_b", zero).alias("_b"))
    cross = both.agg(
        F.array(*[F.sum(F.col("_a")[i] * F.col("_b")[j]) for i in range(rank_a) for j in range(rank_b)]).alias("c")
    ).scalar()
    with_cross = both.withColumn("_c", cross)
    rest = [
        F.col("_b")[j] - sum((F.col("_a")[i] * F.col("_c")[i * rank_b + j] for i in range(rank_a)), F.lit(0.0))
        for j in range(rank_b)
    ]
    squares = sum((r * r for r in rest), F.lit(0.0))
    return with_cross.agg(F.sqrt(2 * F.sum(squares)).alias("distance"))


def permutation_invariant(a: DataFrame, b: DataFrame, rank: int, tolerance: float = 1e-8) -> DataFrame:
    """Whether two fits of differently ordered data span the same space."""
    return projector_distance(a, b, rank).withColumn("invariant", F.col("distance") < tolerance)
