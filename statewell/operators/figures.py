"""Tables behind the figures (G1-G8); drawing is left to the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statewell.common import ContractError, enforce, materialise, union_all
from statewell.operators.contracts import alignment, alignment_violations
from statewell.operators.decompose import detectability, spectrum
from statewell.operators.landscape import empirical_density, interpolate
from statewell.operators.ranking import grouped_row_number


def gallery(
    scores: DataFrame, sample_map: DataFrame, samples: DataFrame, field: str | None, n: int = 6,
    layer: str | None = None, strict: bool = True,
) -> DataFrame:
    """G1: coordinates of the first ``n`` components with aligned metadata."""
    if n < 1:
        raise ContractError("n must be a positive integer")
    if field is not None and field not in samples.columns:
        raise ContractError(f"field {field} was not found in the samples")
    picked = scores.filter(F.col("component") <= n)
    if layer is not None:
        picked = picked.filter(F.col("layer") == layer)
    named = picked.withColumn("panel", F.concat(F.lit("PC"), F.col("component").cast("string")))
    if field is None:
        return named.select("layer", "sample_id", "component", "panel", "coord")
    if strict:
        enforce(alignment_violations(picked, sample_map, samples))
    placed = alignment(picked, sample_map, samples).filter(F.col("reason").isNull()).join(
        samples.select("primary_id", F.col(field).alias("metadata_value")), "primary_id"
    )
    return named.join(placed.select("layer", "sample_id", "metadata_value"), ["layer", "sample_id"]).select(
        "layer", "sample_id", "component", "panel", "coord", "metadata_value"
    )


def gallery_density(table: DataFrame, by_metadata: bool = True) -> DataFrame:
    """Density per component, and per metadata value when categorical."""
    keys = ["layer", "component"] + (["metadata_value"] if by_metadata else [])
    return empirical_density(table.select(*keys, F.col("coord").alias("x")), keys)


def rank_ordered(scores: DataFrame, component: int = 1, keys: Sequence[str] = ("layer",)) -> DataFrame:
    """Coordinates ranked within each layer, ties by sample id."""
    picked = scores.filter(F.col("component") == component).select(*keys, "sample_id", "coord")
    return grouped_row_number(picked, keys, ["coord", "sample_id"], "sample_ord")


def clip_component(scores: DataFrame, requested: int, keys: Sequence[str] = ("layer",)) -> DataFrame:
    """The component to draw, limited to what every layer has, with a warning."""
    per = scores.groupBy(*keys).agg(F.max("component").alias("k"))
    low = per.agg(F.min("k").alias("available"))
    used = F.least(F.lit(requested), F.col("available"))
    text = F.format_string(
        "no component %d in every layer; component %d is drawn instead", F.lit(requested), used
    )
    return low.select(
        F.lit(requested).alias("requested"), "available", used.alias("component"),
        F.when(F.lit(requested) > F.col("available"), text).alias("warning"),
    )


def potential_table(
    curve: DataFrame, critical: DataFrame, keys: Sequence[str], show_points: bool = False
) -> DataFrame:
    """Curve rows; critical points with their ``u`` only when asked for."""
    line = curve.select(*keys, F.lit("curve").alias("kind"), F.col("i").alias("position"), "x", "u")
    if not show_points:
        return line
    pts = interpolate(critical, curve, keys).select(*keys, "kind", F.col("ordinal").alias("position"), "x", "u")
    return union_all([line, pts])


def barrier_segments(critical: DataFrame, curve: DataFrame, keys: Sequence[str], u: str = "u") -> DataFrame:
    """One vertical segment per barrier and neighbouring well."""
    before = Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy("x").rowsBetween(1, Window.unboundedFollowing)
    well = F.when(F.col("kind") == "well", F.col("x"))
    near = (
        critical.withColumn("_l", F.max(well).over(before))
        .withColumn("_r", F.min(well).over(after))
        .filter(F.col("kind") == "barrier")
        .withColumnRenamed("x", "barrier_x")
    )
    sides = near.select(
        *keys, "ordinal", "barrier_x",
        F.inline(
            F.array(
                F.struct(F.lit("left").alias("side"), F.col("_l").alias("x")),
                F.struct(F.lit("right").alias("side"), F.col("_r").alias("x")),
            )
        ),
    ).filter(F.col("x").isNotNull())
    low = interpolate(sides, curve, keys, u, "y")
    top = interpolate(critical.filter(F.col("kind") == "barrier").select(*keys, "ordinal", "x"), curve, keys, u, "yend")
    return low.join(top.select(*keys, "ordinal", "yend"), [*keys, "ordinal"]).select(
        *keys, "ordinal", "side", "x", F.col("x").alias("xend"), "y", "yend"
    )


def rug(
    scores: DataFrame, metadata: DataFrame | None = None, field: str | None = None, component: int = 1, layer: str | None = None
) -> DataFrame:
    """Sample positions on one component, metadata joined per layer."""
    picked = scores.filter(F.col("component") == component)
    if layer is not None:
        picked = picked.filter(F.col("layer") == layer)
    marks = picked.select("layer", "sample_id", F.col("coord").alias("x"))
    if field is None:
        return marks
    on = [c for c in ("layer", "sample_id") if c in metadata.columns]
    return marks.join(metadata.select(*on, F.col(field).alias("metadata_value")), on, "left")


def group_mean_path(points: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean coordinates per stage and branch."""
    return points.groupBy(*by).agg(*[F.avg(v).alias(v) for v in values])


def spectrum_table(cells: DataFrame, keys: Sequence[str] = ("layer",), n_values: int = 20, side: str | None = None) -> DataFrame:
    """Leading uncentred singular values with each layer's threshold."""
    values = spectrum(cells, keys, n_values, center=False, side=side)
    thr = materialise(detectability(cells, keys).select(*keys, "threshold"))
    return values.join(thr, list(keys)).withColumn("detectable", F.col("sigma") >= F.col("threshold"))
