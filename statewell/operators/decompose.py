"""Stage 1: centring, distributed SVD and multi-layer axes.

Tables: ``cells(keys.., sample_id, feature_id, value)`` in; ``loadings``,
``scores`` and ``spectrum`` out. ``keys`` always holds ``layer`` and may hold
cohort or replicate columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewell.common import BROADCAST_VALUES, ContractError, enforce, key_text, materialise, small_side, union_all, violation
from statewell.operators.contracts import feature_identity_violations
from statewell.operators.linalg import MAX_SIDE, eigen_components, gram_blocks, gram_tasks, rows_from_cells

LAYER = ("layer",)


@dataclass(frozen=True)
class Decomposition:
    """Tables of one decomposition; a values-only one has no loadings and scores."""

    loadings: DataFrame | None
    scores: DataFrame | None
    spectrum: DataFrame
    warnings: DataFrame
    keys: tuple[str, ...]

    def axis(self, component: int = 1) -> DataFrame:
        """Loadings of one component."""
        return self.loadings.filter(F.col("component") == component)


# --- centring and scaling -------------------------------------------------


def feature_means(cells: DataFrame, keys: Sequence[str] = LAYER) -> DataFrame:
    """Mean of every feature, computed with map-side partial sums."""
    return cells.groupBy(*keys, "feature_id").agg(F.avg("value").alias("mean"))


def center_cells(cells: DataFrame, means: DataFrame, keys: Sequence[str] = LAYER) -> DataFrame:
    on = [*keys, "feature_id"]
    return cells.join(means, on).withColumn("value", F.col("value") - F.col("mean")).drop("mean")


def layer_scaling(cells: DataFrame, keys: Sequence[str] = LAYER) -> DataFrame:
    """Per feature mean and per layer Frobenius norm of the centred block.

    One pass over the cells; the norm is the root of the summed per-feature
    centred squares, so the centred block itself is never built for it.
    """
    per_feature = cells.groupBy(*keys, "feature_id").agg(
        F.avg("value").alias("mean"),
        (F.var_pop("value") * F.count("value")).alias("_ss"),
    )
    norm = per_feature.groupBy(*keys).agg(F.sqrt(F.sum("_ss")).alias("block_scale"))
    return per_feature.drop("_ss").join(norm, list(keys))


def block_scale(cells: DataFrame, scaling: DataFrame, keys: Sequence[str] = LAYER) -> DataFrame:
    """Centred cells divided by the block norm; a zero norm is refused."""
    scaled = F.when(
        F.col("block_scale") > 0, (F.col("value") - F.col("mean")) / F.col("block_scale")
    ).otherwise(F.raise_error(F.lit("a layer without any spread cannot be scaled to unit size")).cast("double"))
    return cells.join(scaling, [*keys, "feature_id"]).withColumn("value", scaled).drop("mean", "block_scale")


def dimensions(cells: DataFrame, keys: Sequence[str] = LAYER) -> DataFrame:
    return cells.groupBy(*keys).agg(
        F.countDistinct("sample_id").alias("n"), F.countDistinct("feature_id").alias("p"), F.count("*").alias("n_cells")
    )


def detectability(cells: DataFrame, keys: Sequence[str] = LAYER) -> DataFrame:
    """Smallest detectable singular value ``(n p)^(1/4)`` per layer."""
    return dimensions(cells, keys).drop("n_cells").withColumn("threshold", F.pow(F.col("n") * F.col("p").cast("double"), F.lit(0.25)))


# --- the SVD kernel --------------------------------------------------------


def choose_side(dims: DataFrame) -> tuple[str, int]:
    """The side whose square fits one task, and its width, when one side suits every group; see ``side_plan``."""
    plan = side_plan(dims)
    if len(plan) == 1:
        return plan[0]
    raise ContractError("the groups need different sides; decompose them without naming one")


def side_plan(dims: DataFrame) -> list[tuple[str, int]]:
    """``(side, largest width)`` of the groups summed over features and of those summed over samples.

    Each group takes its own smaller side. A group beyond ``MAX_SIDE`` on both is
    refused: the sketch is an approximation and has to be asked for.
    """
    sized = dims.groupBy(_own_side().alias("side")).agg(
        F.count("*").alias("groups"), F.max("n").alias("n"), F.max("p").alias("p"), _holes().alias("holes")
    ).collect()
    if not sized:
        raise ContractError("no cells to decompose")
    holes = sum(r["holes"] for r in sized)
    if holes:
        raise ContractError(f"{holes} groups have missing cells or repeated cells")
    for r in sized:
        if r["side"] == "none":
            raise ContractError(f"{r['groups']} groups are larger than {MAX_SIDE} on both sides; ask for side='sketch'")
    return sorted((r["side"], r["n"] if r["side"] == "samples" else r["p"]) for r in sized)


def _holes():
    """Groups that are not complete matrices of one cell per sample and feature."""
    return F.count_if(F.col("n_cells") != F.col("n") * F.col("p"))


def _own_side():
    n, p = F.col("n"), F.col("p")
    return (
        F.when((p <= MAX_SIDE) & (p <= n), "features").when(n <= MAX_SIDE, "samples").when(p <= MAX_SIDE, "features").otherwise("none")
    )


def _wide(long: DataFrame, keys: Sequence[str], by: str, value: str) -> DataFrame:
    """(keys, by, component, value) to one array of components per key."""
    return long.groupBy(*keys, by).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("component", F.col(value).alias("v")))), lambda s: s["v"]
        ).alias("w")
    )


def _sums(weights: str, value, k: int) -> list:
    return [F.sum(value * F.get(F.col(weights), j)).alias(f"_s{j}") for j in range(k)]


def _long_components(df: DataFrame, keep: Sequence[str], k: int, out: str) -> DataFrame:
    packed = F.array(*[F.struct(F.lit(j + 1).alias("component"), F.col(f"_s{j}").alias(out)) for j in range(k)])
    return df.select(*keep, F.inline(packed)).filter(F.col(out).isNotNull())


#: Components summed in one pass over the cells (keeps generated code compact).
_PASS = 64


def _fits_broadcast(rows: int | None, k: int | None) -> bool:
    return (rows or 0) * (k or 0) <= BROADCAST_VALUES


def apply_components(
    cells: DataFrame,
    weights: DataFrame,
    keys: Sequence[str],
    on: str,
    by: str,
    weight: str,
    out: str,
    k: int,
    means: DataFrame | None = None,
    small: bool = False,
) -> DataFrame:
    """``sum_on (x - mean) * weight`` per ``by`` and component.

    All components of a pass travel in one array, so the cells are read once
    per 64 components: one join and one partially aggregated group-by.
    """
    parts = []
    for first in range(1, k + 1, _PASS):
        last = min(first + _PASS - 1, k)
        chosen = weights.filter(F.col("component").between(first, last)) if k > _PASS else weights
        axes = _wide(chosen, keys, on, weight)
        value = F.col("value")
        if means is not None:
            axes = axes.join(means, [*keys, on])
            value = value - F.col("mean")
        axes = F.broadcast(axes) if small else axes
        n = last - first + 1
        sums = cells.join(axes, [*keys, on]).groupBy(*keys, by).agg(*_sums("w", value, n))
        long = _long_components(sums, [*keys, by], n, out)
        parts.append(long.withColumn("component", F.col("component") + (first - 1)) if first > 1 else long)
    return union_all(parts)


def project(
    cells: DataFrame,
    loadings: DataFrame,
    keys: Sequence[str] = LAYER,
    means: DataFrame | None = None,
    k: int | None = None,
    small: bool = False,
) -> DataFrame:
    """Scores ``sum_f (x - mean) * loading`` per sample and component.

    The kernel below ``project_cohort``: it centres with the ``means`` it is given and
    checks nothing. ``small`` states that the loadings have been counted and fit a broadcast.
    """
    if k is None:
        k = loadings.agg(F.max("component")).first()[0] or 0
    if k < 1:
        raise ContractError("no components to project on")
    return apply_components(cells, loadings, keys, "feature_id", "sample_id", "loading", "coord", k, means, small)


def project_cohort(
    cells: DataFrame, loadings: DataFrame, means: DataFrame | None = None, keys: Sequence[str] = LAYER, centre: str = "discovery",
    k: int | None = None,
) -> DataFrame:
    """Project a new cohort; its features must be those of the loadings, each once.

    ``centre`` is ``discovery`` (the default: ``means`` of the cohort that gave the axes) or ``own`` (the new cohort's).
    Missing, extra or repeated features are refused.
    """
    if centre == "discovery" and means is None:
        raise ContractError("centring on the discovery cohort needs its means")
    if centre not in ("discovery", "own"):
        raise ContractError(f"unknown centring {centre}")
    if not same_features(cells, loadings, keys):
        enforce(projection_violations(cells, loadings, keys))
    return project(cells, loadings, keys, means if centre == "discovery" else feature_means(cells, keys), k)


def same_features(cells: DataFrame, loadings: DataFrame, keys: Sequence[str] = LAYER) -> bool:
    """Whether every sample has exactly the features of its group's loadings, each once.

    Samples are compared by count, sum and exclusive or of hashed feature ids, so one aggregated row a sample is shuffled
    and no cell; ``projection_violations`` names what differs.
    """
    keys = list(keys)
    mark = F.xxhash64("feature_id")
    marks = {"_c": F.count("feature_id"), "_s": F.sum(F.pmod(mark, F.lit(1 << 31))), "_x": F.bit_xor(mark)}
    own = cells.groupBy(*keys, "sample_id").agg(F.count("*").alias("_all"), *[m.alias(c) for c, m in marks.items()])
    own = own.groupBy(*keys).agg(
        F.bool_or(F.col("_all") != F.col("_c")).alias("_null"),
        *[f(c).alias(f"{c}_{name}") for c in marks for name, f in (("lo", F.min), ("hi", F.max))],
    )
    wanted = loadings.select(*keys, "feature_id").distinct().groupBy(*keys).agg(*[m.alias(c) for c, m in marks.items()])
    differs = F.coalesce(F.col("_null"), F.lit(True))
    for c in marks:
        differs |= ~(F.col(c).eqNullSafe(F.col(f"{c}_lo")) & F.col(c).eqNullSafe(F.col(f"{c}_hi")))
    return own.join(wanted, keys, "full_outer").filter(differs).isEmpty()


def projection_violations(cells: DataFrame, loadings: DataFrame, keys: Sequence[str] = LAYER) -> DataFrame:
    """Features of a new cohort that are missing, extra, repeated or incomplete over its samples."""
    keys = list(keys)
    samples = cells.groupBy(*keys, "sample_id").agg(F.count("*").alias("_f"), F.countDistinct("feature_id").alias("_d"))
    own = cells.select(*keys, "feature_id").distinct()
    width = own.groupBy(*keys).agg(F.count("*").alias("_w"))
    uneven = samples.join(width, keys).filter((F.col("_f") != F.col("_w")) | (F.col("_d") != F.col("_w")))
    return feature_identity_violations(own, loadings, keys).unionByName(
        violation(uneven, "uneven_sample", key_text([*keys, "sample_id"]), F.format_string("%d of %d features", F.col("_d"), F.col("_w")))
    )


def svd(
    cells: DataFrame,
    keys: Sequence[str] = LAYER,
    k: int | None = 6,
    center: bool = True,
    side: str | None = None,
    vectors: bool = True,
    rows: DataFrame | None = None,
    feature_ids: Sequence[str] | None = None,
    width: int | None = None,
    dims: DataFrame | None = None,
) -> Decomposition:
    """Truncated SVD of every group's sample-by-feature matrix.

    Without a ``side`` every group is solved exactly on its own smaller side.

    ``features`` sums a p x p matrix over samples, ``samples`` an n x n matrix
    over features, ``sketch`` is a randomised range finder for matrices large
    on both sides; it is used only when asked for. ``rows`` may supply the matrix as array rows
    (``sample_id, vec`` with ``feature_ids`` naming the positions) so that long
    cells need not be regrouped. Only the solved components are materialised.
    With an explicit ``side``, ``width`` tells its largest size when it is known.
    """
    if not isinstance(center, bool):
        raise ContractError("center is either True or False")
    if k is not None and (not isinstance(k, int) or isinstance(k, bool) or k < 1):
        raise ContractError("k is a whole number from 1 up, or None")
    keys = list(keys)
    if not keys:
        raise ContractError("at least one key column (layer) is needed")
    if rows is not None and feature_ids is None:
        raise ContractError("array rows need feature_ids")
    if rows is not None:
        side, width = side or "features", len(feature_ids)
    elif side is None:
        dims = materialise(dimensions(cells, keys)) if dims is None else dims
        plan = side_plan(dims)
        if len(plan) > 1:
            return _join_decompositions(
                [
                    svd(cells.join(small_side(materialise(dims.filter(_own_side() == s).select(*keys))), keys), keys, k, center, s, vectors, width=w)
                    for s, w in plan
                ]
            )
        side, width = plan[0]
    lost = 1 if center else 0
    if side == "sketch":
        from statewell.operators.sketch import sketch_components

        if k is None:
            raise ContractError("a sketched decomposition needs k")
        return sketch_components(cells, keys, k, center)
    if side == "features":
        source = rows if rows is not None else rows_from_cells(cells, keys, "sample_id", "feature_id")
        blocks = gram_blocks(source, keys, "columns" if center else "none", tasks=gram_tasks(source, width))
        model = materialise(eigen_components(blocks, keys, k, lost, side))
        shape = model.select(*keys, F.col("n"), F.col("m").cast("long").alias("p"), "component", "sigma")
        if not vectors:
            return Decomposition(None, None, shape.select(*keys, "component", "sigma"), threshold_warnings(shape, keys), tuple(keys))
        if feature_ids is not None:
            ids = F.array(*[F.lit(f) for f in feature_ids])
            named = model.withColumn("ids", ids)
        else:
            named = model.join(_ids(cells, keys, "feature_id"), keys)
        pairs = F.arrays_zip("ids", "axis", "mean")
        long = named.select(*keys, "component", F.explode(pairs).alias("z")).select(
            *keys,
            "component",
            F.col("z.ids").alias("feature_id"),
            F.col("z.axis").alias("loading"),
            F.col("z.mean").alias("mean"),
        )
        loadings = long.drop("mean")
        means = long.filter(F.col("component") == 1).drop("loading", "component") if center else None
        size = model.agg(
            F.sum(F.when(F.col("component") == 1, F.col("m"))).alias("m"), F.max("component").alias("k")
        ).first()
        small = _fits_broadcast(size["m"], size["k"])
        if rows is not None and "sample_id" in rows.columns:
            scores = row_scores(rows, model, keys, center, small)
        else:
            scores = project(cells, loadings, keys, means, size["k"], small)
    else:
        source = rows_from_cells(cells, keys, "feature_id", "sample_id")
        blocks = gram_blocks(source, keys, "rows" if center else "none", tasks=gram_tasks(source, width))
        model = materialise(eigen_components(blocks, keys, k, lost, side))
        shape = model.select(*keys, F.col("m").cast("long").alias("n"), F.col("n").alias("p"), "component", "sigma")
        if not vectors:
            return Decomposition(None, None, shape.select(*keys, "component", "sigma"), threshold_warnings(shape, keys), tuple(keys))
        left = model.join(_ids(cells, keys, "sample_id"), keys).select(
            *keys, "component", "sigma", F.explode(F.arrays_zip("ids", "axis")).alias("z")
        ).select(*keys, "component", "sigma", F.col("z.ids").alias("sample_id"), F.col("z.axis").alias("u"))
        size = model.agg(
            F.sum(F.when(F.col("component") == 1, F.col("m"))).alias("m"), F.max("component").alias("k")
        ).first()
        by_sigma = left.withColumn("u", F.col("u") / F.col("sigma"))
        # centred u is orthogonal to the ones vector, so raw values suffice
        loadings = materialise(
            apply_components(
                cells, by_sigma, keys, "sample_id", "feature_id", "u", "loading", size["k"],
                small=_fits_broadcast(size["m"], size["k"]),
            )
        )
        sign = leading_sign(loadings, [*keys, "component"])
        loadings = loadings.join(sign, [*keys, "component"]).withColumn(
            "loading", F.col("loading") * F.col("sign")
        ).drop("sign")
        scores = left.join(sign, [*keys, "component"]).select(
            *keys, "sample_id", "component", (F.col("u") * F.col("sigma") * F.col("sign")).alias("coord")
        )
    spectrum = shape.select(*keys, "component", "sigma")
    warnings = threshold_warnings(shape, keys)
    return Decomposition(loadings, scores, spectrum, warnings, tuple(keys))


def row_scores(rows: DataFrame, model: DataFrame, keys: Sequence[str], center: bool, small: bool) -> DataFrame:
    """Scores of array rows, a dot product in the row; with broadcast axes nothing is shuffled."""
    axes = model.select(*keys, "component", "axis", "mean")
    x = F.col("vec").cast("array<double>")
    if center:
        x = F.zip_with(x, "mean", lambda v, m: v - m)
    coord = F.aggregate(F.zip_with(x, "axis", lambda v, a: v * a), F.lit(0.0), lambda total, v: total + v)
    return rows.join(F.broadcast(axes) if small else axes, list(keys)).select(*keys, "sample_id", "component", coord.alias("coord"))


def _join_decompositions(parts: Sequence[Decomposition]) -> Decomposition:
    """Decompositions of different groups as one."""
    tables = [
        None if getattr(parts[0], name) is None else union_all([getattr(p, name) for p in parts])
        for name in ("loadings", "scores", "spectrum", "warnings")
    ]
    return Decomposition(*tables, parts[0].keys)


def _ids(cells: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Sorted ids of the solved side, at most ``MAX_SIDE`` per group."""
    return materialise(cells.groupBy(*keys).agg(F.array_sort(F.collect_set(column)).alias("ids")))


def leading_sign(loadings: DataFrame, by: Sequence[str]) -> DataFrame:
    """+1 or -1 so that the largest absolute loading (first id on ties) is positive."""
    order = F.struct(-F.round(F.abs("loading"), 12), F.col("feature_id"))
    return loadings.groupBy(*by).agg(
        F.when(F.min_by("loading", order) < 0, -1.0).otherwise(1.0).alias("sign")
    )


def threshold_warnings(shape: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One warning row per layer whose first value is undetectable."""
    thr = F.pow(F.col("n") * F.col("p").cast("double"), F.lit(0.25))
    return shape.filter((F.col("component") == 1) & (F.col("sigma") < thr)).select(
        *keys,
        F.lit("below_threshold").alias("code"),
        F.format_string(
            "Dominant singular value %.2f is below the detectability threshold %.2f (n=%d, p=%d)",
            F.col("sigma"), thr, F.col("n"), F.col("p"),
        ).alias("message"),
    )


def rank_warnings(spectrum: DataFrame, k: int, keys: Sequence[str] = LAYER) -> DataFrame:
    """One warning row per layer with fewer than ``k`` components."""
    return spectrum.groupBy(*keys).agg(F.count("*").alias("k_eff")).filter(F.col("k_eff") < k).select(
        *keys,
        F.lit("rank_deficient").alias("code"),
        F.format_string("only %d of %d requested components available", F.col("k_eff"), F.lit(k)).alias("message"),
    )


def spectrum(cells: DataFrame, keys: Sequence[str] = LAYER, n_values: int = 20, center: bool = False, side: str | None = None) -> DataFrame:
    """Leading singular values per layer, uncentred unless asked; no vectors."""
    return svd(cells, keys, n_values, center, side, vectors=False).spectrum


# --- several layers --------------------------------------------------------


def _cohort_keys(keys: Sequence[str]) -> list[str]:
    return [c for c in keys if c != "layer"]


def common_components(spectrum_: DataFrame, keys: Sequence[str] = LAYER) -> DataFrame:
    """Components present in every layer of a cohort."""
    cohort = _cohort_keys(keys)
    top = spectrum_.groupBy(*keys).agg(F.max("component").alias("k"))
    return top.groupBy(*cohort).agg(F.min("k").alias("k"), F.count("*").alias("layers"))


def feature_set_violations(loadings: DataFrame, keys: Sequence[str] = LAYER) -> DataFrame:
    """Features that not every layer of a cohort has; layers are only averaged over equal feature sets."""
    cohort = _cohort_keys(keys)
    one = loadings.filter(F.col("component") == 1).select(*keys, "feature_id")
    per = one.groupBy(*cohort, "feature_id").agg(F.count("*").alias("_c"))
    layers = one.select(*keys).distinct().groupBy(*cohort).agg(F.count("*").alias("_l"))
    if cohort:
        both = per.join(layers, cohort)
    else:
        both = per.withColumn("_l", layers.select("_l").scalar())
    return violation(
        both.filter(F.col("_c") != F.col("_l")), "unequal_features", key_text([*cohort, "feature_id"]),
        F.format_string("in %d of %d layers", F.col("_c"), F.col("_l")),
    )


def average_axes(
    loadings: DataFrame, spectrum_: DataFrame, keys: Sequence[str] = LAYER, align_signs: bool = True
) -> DataFrame:
    """Shared axis ``V_j``: unit vector along ``sum_i sigma_ij^2 v_ij``.

    Layers are joined by feature id. Per-layer signs are arbitrary, so each
    layer is first turned towards the layer with the largest ``sigma``;
    ``align_signs=False`` averages them as they come.
    """
    cohort = _cohort_keys(keys)
    by = [*cohort, "component"]
    complete = spectrum_.groupBy(*by).agg(F.count("*").alias("_c"))
    layers = spectrum_.groupBy(*cohort).agg(F.countDistinct("layer").alias("_l"))
    if cohort:
        shared = complete.join(layers, cohort).filter(F.col("_c") == F.col("_l")).select(*by)
    else:
        shared = complete.filter(F.col("_c") == layers.select("_l").scalar()).select(*by)
    weighted = loadings.join(spectrum_, [*keys, "component"]).join(shared, by)
    if align_signs:
        lead = spectrum_.groupBy(*by).agg(F.max_by("layer", "sigma").alias("layer"))
        ref = loadings.join(lead, [*keys, "component"], "left_semi").select(
            *by, "feature_id", F.col("loading").alias("_ref")
        )
        turn = loadings.join(ref, [*by, "feature_id"]).groupBy(*keys, "component").agg(
            F.when(F.sum(F.col("loading") * F.col("_ref")) < 0, -1.0).otherwise(1.0).alias("_turn")
        )
        weighted = weighted.join(turn, [*keys, "component"])
    else:
        weighted = weighted.withColumn("_turn", F.lit(1.0))
    summed = weighted.groupBy(*by, "feature_id").agg(
        F.sum(F.col("sigma") * F.col("sigma") * F.col("_turn") * F.col("loading")).alias("_v")
    )
    norm = summed.groupBy(*by).agg(F.sqrt(F.sum(F.col("_v") * F.col("_v"))).alias("_norm"))
    return summed.join(norm, by).select(*by, "feature_id", (F.col("_v") / F.col("_norm")).alias("loading"))


def strongest_layer_axes(loadings: DataFrame, spectrum_: DataFrame, keys: Sequence[str] = LAYER) -> DataFrame:
    """Axes of the layer with the largest first singular value."""
    cohort = _cohort_keys(keys)
    first = spectrum_.filter(F.col("component") == 1)
    best = first.groupBy(*cohort).agg(F.max_by("layer", "sigma").alias("layer"))
    return loadings.join(best, list(keys), "left_semi").select(*cohort, "component", "feature_id", "loading")


def rescale_scores(
    scores: DataFrame, loadings: DataFrame, shared: DataFrame, keys: Sequence[str] = LAYER
) -> DataFrame:
    """Per-layer scores scaled by the overlap of own and shared axes."""
    by = [*_cohort_keys(keys), "component"]
    overlap = loadings.join(shared.withColumnRenamed("loading", "_shared"), [*by, "feature_id"]).groupBy(
        *keys, "component"
    ).agg(F.sum(F.col("loading") * F.col("_shared")).alias("overlap"))
    return scores.join(overlap, [*keys, "component"]).withColumn(
        "coord", F.col("coord") * F.col("overlap")
    ).drop("overlap")


def decompose(
    cells: DataFrame,
    strategy: str = "averaged",
    keys: Sequence[str] = LAYER,
    k: int = 6,
    center: bool = True,
    side: str | None = None,
    align_signs: bool = True,
) -> Decomposition:
    """Stage 1 entry point: ``svd`` (D4), ``averaged`` (D5) or ``strongest``."""
    if strategy not in ("svd", "averaged", "strongest"):
        raise ContractError(f"unknown decomposition {strategy}")
    cohort = _cohort_keys(keys)
    dims = materialise(dimensions(cells, keys))
    per_cohort = dims.groupBy(*cohort).agg(
        F.count("*").alias("l"), F.max("n").alias("n"), F.max("p").alias("p"), _holes().alias("holes")
    )
    size = per_cohort.agg(
        F.min("l").alias("few"), F.max("l").alias("many"), F.max("n").alias("n"), F.max("p").alias("p"), F.sum("holes").alias("holes")
    ).first()
    if strategy == "svd" and size["many"] != 1:
        raise ContractError("svd takes one layer a cohort")
    if strategy != "svd" and (size["few"] or 0) < 2:
        raise ContractError(f"{strategy} needs two layers or more in every cohort")
    if side and size["holes"]:
        raise ContractError(f"{size['holes']} groups have missing cells or repeated cells")
    width = size["n"] if side == "samples" else size["p"]
    own = svd(cells, keys, k, center, side, width=width if side else None, dims=dims)
    warnings = own.warnings.unionByName(rank_warnings(own.spectrum, k, keys))
    if strategy == "svd":
        return Decomposition(own.loadings, own.scores, own.spectrum, warnings, tuple(keys))
    enforce(feature_set_violations(own.loadings, keys))
    if strategy == "averaged":
        shared = average_axes(own.loadings, own.spectrum, keys, align_signs)
    else:
        shared = strongest_layer_axes(own.loadings, own.spectrum, keys)
    shared = materialise(shared)
    coords = rescale_scores(own.scores, own.loadings, shared, keys)
    return Decomposition(shared, coords, own.spectrum, warnings, tuple(keys))


def concatenated_svd(
    cells: DataFrame, keys: Sequence[str] = (), rank: int = 2, side: str | None = None,
    scaling: DataFrame | None = None, vectors: bool = True,
) -> Decomposition:
    """SVD of all block-scaled layers side by side.

    The feature key becomes (layer, feature); the sample-side matrix is then
    the sum of the layers' matrices and the wide block is never built.
    """
    layer_keys = [*keys, "layer"]
    scaling = scaling if scaling is not None else layer_scaling(cells, layer_keys)
    joined = block_scale(cells, scaling, layer_keys).select(
        *keys,
        F.lit("all").alias("layer"),
        "sample_id",
        F.concat_ws(":", "layer", "feature_id").alias("feature_id"),
        "value",
    )
    return svd(joined, layer_keys, rank, center=False, side=side, vectors=vectors)


def unit_scores(scores: DataFrame, spectrum_: DataFrame, keys: Sequence[str] = LAYER) -> DataFrame:
    """Left singular vectors: scores divided by their singular value."""
    return scores.join(spectrum_, [*keys, "component"]).withColumn(
        "coord", F.col("coord") / F.col("sigma")
    ).drop("sigma")


def pooled_layer_scores(scores: DataFrame, spectrum_: DataFrame, keys: Sequence[str] = LAYER, rank: int = 2) -> DataFrame:
    """Leading directions of the sum of per-layer projectors.

    Equal to the SVD of all layers' unit scores stacked as features.
    """
    cohort = _cohort_keys(keys)
    stacked = unit_scores(scores, spectrum_, keys).select(
        *cohort,
        F.lit("pool").alias("layer"),
        "sample_id",
        F.concat_ws(":", "layer", "component").alias("feature_id"),
        F.col("coord").alias("value"),
    )
    pooled = svd(stacked, [*cohort, "layer"], rank, center=False, side="features")
    return unit_scores(pooled.scores, pooled.spectrum, [*cohort, "layer"]).drop("layer")


# --- reading axes ----------------------------------------------------------


def top_loadings(
    loadings: DataFrame, by: Sequence[str], n: int = 18, positive: str = "positive", negative: str = "negative"
) -> DataFrame:
    """Largest absolute loadings with a direction label.

    ``row_number() <= n`` lets Spark cut every map task to n rows per group
    before the shuffle, so a group of any size is safe.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(*by).orderBy(F.abs("loading").desc(), F.col("feature_id"))
    return (
        loadings.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= n)
        .withColumn("direction", F.when(F.col("loading") >= 0, positive).otherwise(negative))
    )


def assign_axes(scores: DataFrame, truth: DataFrame, fields: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Match components 1, 2 to two fields by correlation and orient them.

    Returns one row per group and field with the chosen component, its
    correlation and the sign to multiply with.
    """
    if len(fields) != 2:
        raise ContractError("axis assignment needs two fields")
    wide = scores.filter(F.col("component").isin(1, 2)).groupBy(*keys, "sample_id").agg(
        F.max(F.when(F.col("component") == 1, F.col("coord"))).alias("_c1"),
        F.max(F.when(F.col("component") == 2, F.col("coord"))).alias("_c2"),
    )
    joined = wide.join(truth, [*keys, "sample_id"])
    corr = joined.groupBy(*keys).agg(
        *[F.corr(f"_c{c}", f).alias(f"_r{c}{i}") for c in (1, 2) for i, f in enumerate(fields)]
    )
    direct = F.abs("_r10") + F.abs("_r21") >= F.abs("_r11") + F.abs("_r20")
    out = [
        corr.select(
            *keys,
            F.lit(f).alias("field"),
            F.when(direct, i + 1).otherwise(2 - i).alias("component"),
            F.when(direct, F.col(f"_r{i + 1}{i}")).otherwise(F.col(f"_r{2 - i}{i}")).alias("correlation"),
        )
        for i, f in enumerate(fields)
    ]
    return union_all(out).withColumn("sign", F.signum("correlation"))


def orient(scores: DataFrame, signs: DataFrame, on: Sequence[str]) -> DataFrame:
    """Multiply scores (or loadings) by the chosen signs."""
    value = "coord" if "coord" in scores.columns else "loading"
    return scores.join(signs.select(*on, "sign"), list(on)).withColumn(
        value, F.col(value) * F.col("sign")
    ).drop("sign")

