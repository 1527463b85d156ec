"""Stage 2: densities, quasi-potentials and critical points.

Input is a table of observations ``keys.., x``. Every step runs for all groups
at once. Observations are only ever reduced by partial aggregation: to moments,
to at most 401 bins, or to one partial density per grid point.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statewell.common import ContractError, key_text, materialise, small_side, union_all, violation
from statewell.operators.linalg import _FLUSH_BYTES, _group_codes
from statewell.operators.quantiles import rank_sketch, refine_quantiles

#: Smallest density kept before the logarithm (double machine epsilon).
DENSITY_FLOOR = 2.220446049250313e-16
GRID_POINTS = 512
BIN_POINTS = 401
MIN_OBSERVATIONS = 5
POLY_DEGREE = 6
_STRETCH = 16


# --- K1, K2: the observations ---------------------------------------------


def select_coordinates(
    scores: DataFrame,
    component: int = 1,
    keys: Sequence[str] = (),
    layer: str | None = None,
    available: int | None = None,
) -> DataFrame:
    """K1: one component's coordinates, pooled over layers or of one layer."""
    if component < 1 or (available is not None and component > available):
        raise ContractError(f"there is no component {component}, the scores have {available}")
    picked = scores.filter(F.col("component") == component)
    if layer is not None:
        picked = picked.filter(F.col("layer") == layer)
    return picked.select(*keys, F.col("coord").cast("double").alias("x"))


def minimum_n_violations(obs: DataFrame, keys: Sequence[str], minimum: int = MIN_OBSERVATIONS) -> DataFrame:
    """K2: groups with too few coordinates for a density."""
    return _too_few(obs.groupBy(*keys).agg(F.count("x").alias("n_obs")), keys, minimum)


def _too_few(counts: DataFrame, keys: Sequence[str], minimum: int = MIN_OBSERVATIONS) -> DataFrame:
    small = counts.filter(F.col("n_obs") < minimum)
    text = F.format_string("%d coordinate values, need %d", F.col("n_obs"), F.lit(minimum))
    return violation(small, "minimum_n", key_text(keys), text)


# --- K3: bandwidths -----------------------------------------------------------


def spread(obs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, mean, sd, range and interquartile range of every group.

    Two passes over the observations; the result is one materialised row per
    group. Groups without values do not appear.
    """
    keys = list(keys)
    probs = [0.25, 0.75]
    base = rank_sketch(
        obs, keys, "x", probs, 10_000, F.avg("_x").alias("x_mean"), F.stddev_samp("_x").alias("x_sd")
    )
    quart = refine_quantiles(obs, base, keys, "x", probs)
    high, low = (F.max(F.when(F.col("prob") == p, F.col("q"))) for p in (0.75, 0.25))
    iqr = quart.groupBy(*keys).agg((high - low).alias("x_iqr"))
    return materialise(
        base.select(
            *keys, F.col("_n").alias("n_obs"), "x_mean", "x_sd", F.col("_min").alias("x_min"), F.col("_max").alias("x_max")
        ).join(iqr, keys)
    )


def linear_bins(obs: DataFrame, stats: DataFrame, keys: Sequence[str], m: int = BIN_POINTS) -> DataFrame:
    """Linear binning onto ``m`` points between each group's min and max."""
    joined = obs.join(stats.select(*keys, "x_min", "x_max"), list(keys)).filter("x_max > x_min")
    placed = joined.select(*keys, F.expr(f"(x - x_min) / (x_max - x_min) * {m - 1} AS _pos")).select(
        *keys, "_pos", F.expr(f"CAST(least(floor(_pos), {m - 2}) AS INT) AS _lo")
    )
    shares = "inline(array(struct(_lo AS bin, 1 - (_pos - _lo) AS w), struct(_lo + 1 AS bin, _pos - _lo AS w)))"
    return placed.select(*keys, F.expr(shares)).groupBy(*keys, "bin").agg(F.sum("w").alias("w"))


def _functional(counts: np.ndarray, delta: float, g: float, order: int) -> float:
    """Mean of the ``order``-th normal-kernel derivative over all bin pairs."""
    n, m = counts.sum(), len(counts)
    reach = m - 1
    u = np.arange(reach + 1) * delta / g
    older, hermite = np.ones_like(u), u.copy()
    for i in range(2, order + 1):
        older, hermite = hermite, u * hermite - (i - 1) * older
    kernel = hermite * np.exp(-u * u / 2) / np.sqrt(2 * np.pi) / g ** (order + 1)
    full = np.concatenate([kernel[:0:-1], kernel])
    return float(counts @ np.convolve(counts, full)[reach : reach + m]) / n**2


def plugin_bandwidth(obs: DataFrame, keys: Sequence[str], stats: DataFrame | None = None, m: int = BIN_POINTS) -> DataFrame:
    """K3: two-stage direct plug-in bandwidth (Wand and Jones 1995).

    The pilot scale is ``min(sd, IQR / 1.349)``; pair sums run over at most
    ``m`` linear bins per group, so their cost does not grow with the data.
    """
    keys = list(keys)
    stats = stats if stats is not None else spread(obs, keys)
    bins = linear_bins(obs, small_side(stats), keys, m)
    # a constant group has no bins and keeps a null bandwidth
    packed = stats.join(bins.groupBy(*keys).agg(F.collect_list(F.struct("bin", "w")).alias("_bins")), keys, "left")

    @F.pandas_udf("double")
    def solve(bins_, n_obs, sd, iqr, lo, hi):
        import pandas as pd

        out = []
        for b, n, s, q, a, z in zip(bins_, n_obs, sd, iqr, lo, hi):
            scale = min(s, q / 1.349)
            if not scale > 0:
                out.append(None)
                continue
            counts = np.zeros(m)
            for item in b:
                counts[item["bin"]] = item["w"]
            delta = (z - a) / scale / (m - 1)
            g6 = (2 * np.sqrt(2.0) ** 9 / (7 * n)) ** (1 / 9)
            psi6 = _functional(counts, delta, g6, 6)
            g4 = (-3 * np.sqrt(2 / np.pi) / (psi6 * n)) ** (1 / 7)
            psi4 = _functional(counts, delta, g4, 4)
            out.append(scale * (1 / (4 * np.pi)) ** 0.1 * (1 / (psi4 * n)) ** 0.2)
        return pd.Series(out, dtype="float64")

    h = solve("_bins", "n_obs", "x_sd", "x_iqr", "x_min", "x_max")
    return packed.select(*keys, h.alias("h"), "n_obs", "x_min", "x_max")


def normal_reference_bandwidth(obs: DataFrame, keys: Sequence[str], stats: DataFrame | None = None) -> DataFrame:
    """Rule-of-thumb bandwidth ``0.9 min(sd, IQR/1.34) n^(-1/5)``."""
    s = stats if stats is not None else spread(obs, keys)
    scale = F.least(F.col("x_sd"), F.col("x_iqr") / 1.34)
    scale = F.when(scale > 0, scale).otherwise(
        F.coalesce(F.nullif(F.col("x_sd"), F.lit(0.0)), F.nullif(F.abs(F.col("x_mean")), F.lit(0.0)), F.lit(1.0))
    )
    return s.select(*keys, (0.9 * scale * F.pow(F.col("n_obs"), F.lit(-0.2))).alias("h"), "n_obs", "x_min", "x_max")


def bandwidths(obs: DataFrame, keys: Sequence[str], method: str = "dpi", stats: DataFrame | None = None) -> DataFrame:
    if method == "dpi":
        return plugin_bandwidth(obs, keys, stats)
    if method == "nrd0":
        return normal_reference_bandwidth(obs, keys, stats)
    raise ContractError(f"unknown bandwidth method {method}")


# --- K4-K6: density on a grid --------------------------------------------------


def evaluation_grid(bw: DataFrame, keys: Sequence[str], n_grid: int = GRID_POINTS, reach: float = 2.0) -> DataFrame:
    """K4: equally spaced points on ``[min - 2h, max + 2h]``."""
    lo = F.col("x_min") - reach * F.col("h")
    hi = F.col("x_max") + reach * F.col("h")
    return bw.select(*keys, "n_obs", "h", lo.alias("lo"), ((hi - lo) / (n_grid - 1)).alias("step")).select(
        *keys, "n_obs", "h", "lo", "step", F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1))).alias("i")
    ).withColumn("x", F.col("lo") + F.col("i") * F.col("step"))


def add_kernels(total: np.ndarray, xs: np.ndarray, x: np.ndarray, h: float, mass: float) -> None:
    """Add ``mass * exp(-z^2 / 2)`` of every observation to ``total`` at the equally spaced, ascending ``xs``.

    A stretch of grid points looks only at the observations within ``reach`` bandwidths of it.
    """
    reach = h * np.sqrt(2 * max(np.log(1e9 / (DENSITY_FLOOR * h * np.sqrt(2 * np.pi))), 1.0))
    x = np.sort(x)
    points = len(xs) if len(x) < 64 else _STRETCH
    for start in range(0, len(xs), points):
        at = xs[start : start + points]
        lo, hi = np.searchsorted(x, [at[0] - reach, at[-1] + reach])
        for first in range(lo, hi, 8192):
            z = (at[None, :] - x[first : min(first + 8192, hi), None]) / h
            total[start : start + points] += np.exp(-0.5 * z * z).sum(axis=0) * mass


def density_curve(
    obs: DataFrame, bw: DataFrame, keys: Sequence[str], n_grid: int = GRID_POINTS, reach: float = 2.0
) -> DataFrame:
    """K5, K6: exact Gaussian density and ``u_raw = -log p`` on the grid.

    Groups without a bandwidth have no curve; ``degenerate_violations`` lists them.

    Each task adds its observations' kernels into one vector per group; only
    those vectors are shuffled, however unequal the groups are. A kernel is only
    evaluated where it counts: what is left out adds up to less than 1e-9 of the
    density floor, so ``u_raw`` stays exact to rounding.
    """
    keys = list(keys)
    if not keys:
        raise ContractError("density_curve needs at least one key column")
    span = f"((x_max - x_min + {2 * reach} * h) / {n_grid - 1})"
    frame = materialise(
        bw.filter("h > 0").select(
            *keys, "h", F.expr(f"x_min - {reach} * h AS lo"), F.expr(f"{span} AS step"),
            F.expr("1 / (n_obs * h * sqrt(2 * pi())) AS mass"),
        )
    )
    joined = obs.join(small_side(frame), keys).select(*keys, "x", "h", "lo", "step", "mass")
    n_keys = len(keys)
    schema = T.StructType(
        [joined.schema[k] for k in keys]
        + [T.StructField("i", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("s", T.DoubleType())]
    )
    grid = np.arange(n_grid)

    def emit(states):
        index = pa.array(grid, pa.int32())
        for key, (xs, total) in states.items():
            fixed = [pa.array([k] * n_grid) for k in key]
            yield pa.RecordBatch.from_arrays(
                [*fixed, index, pa.array(xs), pa.array(total)], names=schema.fieldNames()
            )

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict = {}
        for batch in batches:
            x, h, lo_, step, mass_ = (batch.column(n_keys + j).to_numpy() for j in range(5))
            for key, idx in _group_codes(batch, n_keys):
                f = idx[0]
                if key not in states:
                    states[key] = (lo_[f] + grid * step[f], np.zeros(n_grid))
                xs, total = states[key]
                add_kernels(total, xs, x[idx], h[f], mass_[f])
            if len(states) * n_grid * 8 > _FLUSH_BYTES:
                yield from emit(states)
                states = {}
        yield from emit(states)

    sums = joined.mapInArrow(partials, schema).groupBy(*keys, "i").agg(F.min("x").alias("x"), F.sum("s").alias("density"))
    return sums.withColumn("u_raw", quasi_potential(F.col("density")))


def quasi_potential(density) -> F.Column:
    """K6: ``-log(max(p, eps))``."""
    return -F.log(F.greatest(density, F.lit(DENSITY_FLOOR)))


# --- K7-K10: critical points ----------------------------------------------------


def slopes(curve: DataFrame, keys: Sequence[str], u: str = "u_raw") -> DataFrame:
    """K7: finite-difference slope and midpoint of every grid interval."""
    by = ", ".join(f"`{k}`" for k in keys)
    ahead = curve.selectExpr(
        *[f"`{k}`" for k in keys], "i", "x", f"`{u}` AS _u",
        f"lead(x) OVER (PARTITION BY {by} ORDER BY i) AS _x1", f"lead(`{u}`) OVER (PARTITION BY {by} ORDER BY i) AS _u1",
        f"min(x) OVER (PARTITION BY {by}) AS _lo", f"max(x) OVER (PARTITION BY {by}) AS _hi",
    )
    return ahead.filter("_x1 IS NOT NULL").select(
        *keys, "i", F.expr("(_u1 - _u) / (_x1 - x) AS slope"), F.expr("(_x1 + x) / 2 AS mid"), "_lo", "_hi"
    )


def critical_points(curve: DataFrame, keys: Sequence[str], u: str = "u_raw") -> DataFrame:
    """Sign changes of the slope, refined and classified.

    Minus to plus is a well, plus to minus a barrier; a change that touches an
    exact zero slope is neither and is dropped.
    """
    by = ", ".join(f"`{k}`" for k in keys)
    steps = slopes(curve, keys, u).selectExpr(
        "*", f"lead(slope) OVER (PARTITION BY {by} ORDER BY i) AS _s1", f"lead(mid) OVER (PARTITION BY {by} ORDER BY i) AS _m1"
    )
    kind = "CASE WHEN slope < 0 AND _s1 > 0 THEN 'well' WHEN slope > 0 AND _s1 < 0 THEN 'barrier' END AS kind"
    found = steps.filter("signum(slope) <> signum(_s1)").select(
        *keys, F.expr(kind), F.expr("mid - slope * (_m1 - mid) / (_s1 - slope) AS _x"), "_lo", "_hi"
    ).filter("kind IS NOT NULL")
    placed = found.select(*keys, "kind", F.expr("greatest(_lo, least(_hi, _x)) AS x"))
    return placed.selectExpr("*", f"row_number() OVER (PARTITION BY {by}, kind ORDER BY x) AS ordinal")


# --- K11-K13: interpolation, smoothing, heights ---------------------------------


def interpolate(points: DataFrame, curve: DataFrame, keys: Sequence[str], u: str = "u", out: str = "u") -> DataFrame:
    """Linear interpolation of a uniform-grid curve at ``x``.

    The grid interval follows from arithmetic, so this is an equi-join on the
    interval index; points outside the grid get null.
    """
    keys = list(keys)
    by = ", ".join(f"`{k}`" for k in keys)
    seg = curve.selectExpr(
        *[f"`{k}`" for k in keys], "i", "x AS _x0", f"lead(x) OVER (PARTITION BY {by} ORDER BY i) AS _x1",
        f"`{u}` AS _u0", f"lead(`{u}`) OVER (PARTITION BY {by} ORDER BY i) AS _u1",
    )
    frame = curve.groupBy(*keys).agg(F.expr("min(x) AS _lo"), F.expr("max(x) AS _hi"), F.expr("count(*) AS _n"))
    placed = points.join(frame, keys).withColumn(
        "i", F.expr("CAST(greatest(0, least(floor((x - _lo) / (_hi - _lo) * (_n - 1)), _n - 2)) AS INT)")
    )
    value = "CASE WHEN x >= _lo AND x <= _hi THEN _u0 + (x - _x0) / (_x1 - _x0) * (_u1 - _u0) END"
    return placed.join(seg, [*keys, "i"], "left").withColumn(out, F.expr(value)).drop(
        "i", "_x0", "_x1", "_u0", "_u1", "_lo", "_hi", "_n"
    )


def _independent_columns(system: np.ndarray, tolerance: float = 1e-7) -> list[int]:
    """Columns, first come first kept, that are not combinations of earlier ones."""
    kept: list[int] = []
    basis: list[np.ndarray] = []
    for j in range(system.shape[1]):
        rest = system[:, j].copy()
        for _ in range(2):
            for q in basis:
                rest -= q * (q @ rest)
        size = np.linalg.norm(rest)
        if size >= tolerance * np.linalg.norm(system[:, j]) and len(kept) < system.shape[0]:
            kept.append(j)
            basis.append(rest / size)
    return kept


def constrained_polynomial(x: np.ndarray, u: np.ndarray, points: np.ndarray, degree: int = POLY_DEGREE) -> np.ndarray:
    """Polynomial through the critical points with zero slope there.

    ``x`` is scaled to [-1, 1]. With too few constraints for all coefficients
    the lowest independent powers are used, one per constraint; with more it is
    a least-squares fit; a singular system returns the raw curve.
    """
    points = np.sort(points)
    if len(points) < 2 or points[0] < x[0] or points[-1] > x[-1]:
        return u
    at = np.interp(points, x, u)
    span = x[-1] - x[0]
    t = 2 * (points - x[0]) / span - 1
    powers = np.arange(degree + 1)
    value = t[:, None] ** powers
    slope = np.where(powers == 0, 0.0, powers * t[:, None] ** np.maximum(powers - 1, 0)) * (2 / span)
    system = np.vstack([value, slope])
    kept = _independent_columns(system)
    if len(kept) < min(system.shape):
        return u
    target = np.concatenate([at, np.zeros(len(points))])
    coef = np.linalg.lstsq(system[:, kept], target, rcond=None)[0]
    grid = 2 * (x - x[0]) / span - 1
    return (grid[:, None] ** powers[kept]) @ coef


def smooth_curve(curve: DataFrame, critical: DataFrame, keys: Sequence[str], degree: int = POLY_DEGREE) -> DataFrame:
    """Adds ``u``, the constrained polynomial, next to ``u_raw``.

    One small solve per group on the grid rows, whose number is fixed.
    """
    keys = list(keys)
    points = critical.groupBy(*keys).agg(F.collect_list("x").alias("_cp"))
    joined = curve.join(points, keys, "left")
    schema = T.StructType([*curve.schema.fields, T.StructField("u", T.DoubleType())])

    def fit(pdf):
        pdf = pdf.sort_values("i")
        cps = pdf["_cp"].iloc[0]
        cps = np.asarray(cps if cps is not None else [], dtype="float64")
        pdf["u"] = constrained_polynomial(pdf["x"].to_numpy(), pdf["u_raw"].to_numpy(), cps, degree)
        return pdf.drop(columns="_cp")

    return joined.groupBy(*keys).applyInPandas(fit, schema)


def nearest_wells(critical: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Barriers with the closest well on either side (null when absent)."""
    before = Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy("x").rowsBetween(1, Window.unboundedFollowing)
    well = F.when(F.col("kind") == "well", F.col("x"))
    return (
        critical.withColumn("left_well", F.last(well, ignorenulls=True).over(before))
        .withColumn("right_well", F.first(well, ignorenulls=True).over(after))
        .filter(F.col("kind") == "barrier")
        .select(*keys, "ordinal", "x", "left_well", "right_well")
    )


def barrier_heights(critical: DataFrame, curve: DataFrame, keys: Sequence[str], u: str = "u") -> DataFrame:
    """Height of every barrier above its left and right well."""
    keys = list(keys)
    near = nearest_wells(critical, keys)
    spots = near.select(
        *keys,
        "ordinal",
        F.inline(
            F.array(
                F.struct(F.lit("at").alias("_side"), F.col("x").alias("x")),
                F.struct(F.lit("left").alias("_side"), F.col("left_well").alias("x")),
                F.struct(F.lit("right").alias("_side"), F.col("right_well").alias("x")),
            )
        ),
    )
    valued = interpolate(spots.filter(F.col("x").isNotNull()), curve, keys, u, "_u")

    def side(name: str, column: str):
        return F.max(F.when(F.col("_side") == name, F.col(column)))

    return (
        valued.groupBy(*keys, "ordinal")
        .agg(
            side("at", "x").alias("x"),
            side("at", "_u").alias("u"),
            side("left", "x").alias("left_well"),
            side("right", "x").alias("right_well"),
            side("left", "_u").alias("_l"),
            side("right", "_u").alias("_r"),
        )
        .select(
            *keys, "ordinal", "x", "u", "left_well", "right_well",
            (F.col("u") - F.col("_l")).alias("left_height"),
            (F.col("u") - F.col("_r")).alias("right_height"),
        )
    )


# --- K14: end to end -----------------------------------------------------------


@dataclass(frozen=True)
class Landscape:
    curve: DataFrame
    critical: DataFrame
    barriers: DataFrame
    params: DataFrame
    violations: DataFrame
    keys: tuple[str, ...]


def _not_finite():
    return F.col("x").isNull() | F.isnan("x") | (F.abs("x") == float("inf"))


def _broken_groups(obs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return obs.filter(_not_finite()).select(*keys).distinct()


def not_finite_violations(obs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups with null, NaN or infinite observations."""
    bad = obs.groupBy(*keys).agg(F.count_if(_not_finite()).alias("_n")).filter("_n > 0")
    return violation(bad, "observation_not_finite", key_text(keys), F.format_string("%d observations", F.col("_n")))


def degenerate_violations(bw: DataFrame, keys: Sequence[str]) -> DataFrame:
    """K3: groups whose spread (standard deviation or quartile range) is zero, so that they have no bandwidth."""
    flat = bw.filter(~F.coalesce(F.col("h") > 0, F.lit(False)))
    return violation(flat, "degenerate_spread", key_text(keys), F.format_string("%d observations", F.col("n_obs")))


def landscape(
    obs: DataFrame,
    keys: Sequence[str],
    n_grid: int = GRID_POINTS,
    degree: int = POLY_DEGREE,
    bandwidth: str = "dpi",
    design: str = "cross_sectional",
) -> Landscape:
    """Bandwidth, density, critical points, smooth curve and heights.

    The observations are read four times (ranges, quartiles, bins, density), so
    they are materialised first; the curve (``n_grid`` rows per group) is what
    everything after it works on. Every group is in ``curve`` or in ``violations``:
    those below the minimum size, those with observations that are null or not
    finite, and those whose spread gives no bandwidth.
    """
    if design != "cross_sectional":
        raise ContractError(f"the density estimator does not support a {design} design")
    keys = list(keys)
    obs = materialise(obs.select(*keys, "x"))
    odd = materialise(not_finite_violations(obs, keys))
    if not odd.isEmpty():
        obs = materialise(obs.join(_broken_groups(obs, keys), keys, "left_anti"))
    stats = spread(obs, keys)
    usable = stats.filter(F.col("n_obs") >= MIN_OBSERVATIONS)
    params = materialise(bandwidths(obs, keys, bandwidth, usable))
    found = union_all([_too_few(stats, keys), odd, degenerate_violations(params, keys)])
    curve = materialise(density_curve(obs, params, keys, n_grid))
    critical = critical_points(curve, keys)
    smooth = smooth_curve(curve, critical, keys, degree)
    barriers = barrier_heights(critical, smooth, keys)
    return Landscape(
        smooth, critical, barriers, params.select(*keys, "h", "n_obs"), found, tuple(keys)
    )


# --- K15, K16: descriptive densities ---------------------------------------------


def empirical_density(obs: DataFrame, keys: Sequence[str], n_grid: int = GRID_POINTS, reach: float = 3.0) -> DataFrame:
    """Rule-of-thumb density per group (gallery panels)."""
    bw = normal_reference_bandwidth(obs, keys)
    return density_curve(obs, bw, keys, n_grid, reach).select(*keys, "i", "x", "density")


def _two_columns(points: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    return points.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna()


def _bandwidths_2d(data: DataFrame, keys: Sequence[str], n_grid: int) -> DataFrame:
    def reference(column: str, tag: str) -> DataFrame:
        s = spread(data.select(*keys, F.col(column).alias("x")), keys)
        scale = F.least(F.col("x_sd"), F.col("x_iqr") / 1.34)
        return s.select(
            *keys, F.col("n_obs").alias(f"n{tag}"), F.col("x_min").alias(f"lo{tag}"),
            ((F.col("x_max") - F.col("x_min")) / (n_grid - 1)).alias(f"st{tag}"),
            (1.06 * scale * F.pow(F.col("n_obs"), F.lit(-0.2))).alias(f"h{tag}"),
        )

    return reference("_x", "x").join(reference("_y", "y").drop("ny"), list(keys))


def density_2d_violations(points: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Groups without spread in one of the two columns."""
    bw = _bandwidths_2d(_two_columns(points, keys, x, y), keys, 2)
    flat = bw.filter(~F.coalesce((F.col("hx") > 0) & (F.col("hy") > 0), F.lit(False)))
    return violation(flat, "degenerate_spread", key_text(keys), F.format_string("%d points", F.col("nx")))


def density_2d(
    points: DataFrame, keys: Sequence[str], x: str, y: str, n_grid: int = 100
) -> DataFrame:
    """Product-kernel density of two columns on an ``n_grid^2`` grid.

    Bandwidths follow the normal reference rule of the usual contour plot
    (``4 * 1.06 * min(sd, IQR/1.34) * n^(-1/5)``, used as a quarter). Tasks sum
    ``Kx' Ky`` blocks by matrix product; only one grid per group is shuffled.
    Groups without spread in one column have no density; ``density_2d_violations`` lists them.
    """
    keys = list(keys)
    data = _two_columns(points, keys, x, y)
    frame = materialise(_bandwidths_2d(data, keys, n_grid).filter("hx > 0 AND hy > 0"))
    joined = data.join(small_side(frame.drop("nx")), keys).select(*keys, "_x", "_y", "lox", "stx", "hx", "loy", "sty", "hy")
    n_keys = len(keys)
    schema = T.StructType(
        [joined.schema[k] for k in keys]
        + [T.StructField("i", T.IntegerType()), T.StructField("row", T.ArrayType(T.DoubleType()))]
    )
    grid = np.arange(n_grid)

    def emit(states):
        for key, total in states.items():
            fixed = [pa.array([k] * n_grid) for k in key]
            yield pa.RecordBatch.from_arrays(
                [*fixed, pa.array(grid, pa.int32()), pa.array(list(total), pa.list_(pa.float64()))],
                names=schema.fieldNames(),
            )

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict = {}
        for batch in batches:
            c = [batch.column(n_keys + j).to_numpy() for j in range(8)]
            for key, idx in _group_codes(batch, n_keys):
                f = idx[0]
                gx, gy = c[2][f] + grid * c[3][f], c[5][f] + grid * c[6][f]
                kx = np.exp(-0.5 * ((c[0][idx][:, None] - gx[None, :]) / c[4][f]) ** 2)
                ky = np.exp(-0.5 * ((c[1][idx][:, None] - gy[None, :]) / c[7][f]) ** 2)
                total = states.setdefault(key, np.zeros((n_grid, n_grid)))
                total += kx.T @ ky
            if len(states) * n_grid * n_grid * 8 > _FLUSH_BYTES:
                yield from emit(states)
                states = {}
        yield from emit(states)

    sums = joined.mapInArrow(partials, schema).select(*keys, "i", F.posexplode("row").alias("j", "s"))
    total = sums.groupBy(*keys, "i", "j").agg(F.sum("s").alias("s"))
    norm = F.col("nx") * F.col("hx") * F.col("hy") * F.lit(float(2 * np.pi))
    return total.join(frame, keys).select(
        *keys, "i", "j",
        (F.col("lox") + F.col("i") * F.col("stx")).alias("x"),
        (F.col("loy") + F.col("j") * F.col("sty")).alias("y"),
        (F.col("s") / norm).alias("density"),
    )


def curve_with_points(ls: Landscape) -> DataFrame:
    """Curve rows and critical points in one table (``kind`` is null for the curve)."""
    pts = interpolate(ls.critical, ls.curve, ls.keys, "u", "u").select(*ls.keys, "kind", "ordinal", "x", "u")
    line = ls.curve.select(
        *ls.keys, F.lit(None).cast("string").alias("kind"), F.col("i").alias("ordinal"), "x", "u"
    )
    return union_all([line, pts])
