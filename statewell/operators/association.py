"""Associations between components and sample metadata (X1-X3, X8) and the component proposal.

Observations are long: ``keys.., x, y`` with one group of ``keys`` for each component and field. Ranks, ties and inversions
are counted over range-partitioned values, so a group of any size and a value of any frequency are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewell.common import ContractError, materialise, small_side, union_all, violation
from statewell.operators.ranking import grouped_row_number

#: Largest block of an inversion count, and the most blocks of one group: their counts form one small matrix.
BLOCK_ROWS, MOST_BLOCKS = 250_000, 1_000


def _finite(name: str) -> Column:
    return F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(name) != float("inf"))


def _corr(x: str, y: str) -> Column:
    """Correlation as an aggregate; null where a side has no spread."""
    spread = F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))
    return F.try_divide(F.covar_pop(x, y), F.when(spread > 0, spread))


# --- ranks ---------------------------------------------------------------------------


def value_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``(keys.., value, ties, rank)`` for every distinct value: how often it occurs and its average rank.

    Equal values are counted before anything is ordered, so a value that a third of the rows share is one row. The distinct
    values are range-partitioned; the sums of the partitions before one shift the running sums inside it.
    """
    keys = list(keys)
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("ties"))
    laid = materialise(counted.repartitionByRange(*keys, value).withColumn("_pid", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = laid.groupBy(*keys, "_pid").agg(F.sum("ties").alias("_n"))
    shift = parts.select(*keys, "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*keys, "_pid").orderBy(value)
    placed = laid.withColumn("_end", F.sum("ties").over(inside)).join(small_side(materialise(shift)), [*keys, "_pid"])
    return placed.select(*keys, value, "ties", (F.col("_shift") + F.col("_end") - (F.col("ties") - 1) / 2).alias("rank"))


def with_ranks(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The rows with the average rank of each of ``values`` inside its group, as ``rank_<value>``.

    The join meets one row per distinct value; run-time skew splitting deals a frequent value over tasks.
    """
    for v in values:
        ranks = value_ranks(df, keys, v).drop("ties").withColumnRenamed("rank", f"rank_{v}")
        df = df.join(ranks, [*keys, v])
    return df


def tie_sum(df: DataFrame, keys: Sequence[str], value: str, term: Column, out: str) -> DataFrame:
    """Sum of a function of the tie counts ``ties`` over the distinct values of a group."""
    return df.groupBy(*keys, value).agg(F.count("*").cast("double").alias("ties")).groupBy(*keys).agg(F.sum(term).alias(out))


# --- X1: Spearman atlas ----------------------------------------------------------------


def pairs_of(scores: DataFrame, samples: DataFrame, fields: Sequence[str], unit: str = "sample_id") -> DataFrame:
    """``(component, field, unit, x, y)``: every component beside every numeric field, rows without either dropped pairwise.

    ``scores(unit, component, coord)`` meets the samples once; the fields travel as one array.
    """
    listed = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("y")) for f in fields])
    beside = scores.select(unit, "component", F.col("coord").cast("double").alias("x")).join(samples.select(unit, listed.alias("_f")), unit)
    return beside.select("component", unit, "x", F.inline("_f")).filter(_finite("x") & _finite("y")).select("component", "field", unit, "x", "y")


def eligible_fields(samples: DataFrame, identifiers: Sequence[str], unit: str = "sample_id") -> list[str]:
    """Numeric columns that are not identifiers."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return [n for n, t in samples.dtypes if (t in numeric or t.startswith("decimal")) and n not in {unit, *identifiers}]


def spearman(pairs: DataFrame, keys: Sequence[str] = ("component", "field")) -> DataFrame:
    """``(keys.., n, spearman, z)``; null where a side has no spread. ``z`` is the statistic times ``sqrt(n - 1)``."""
    rows = materialise(pairs.select(*keys, "x", "y"))
    found = with_ranks(rows, keys, ["x", "y"]).groupBy(*keys).agg(
        F.count("*").alias("n"), _corr("rank_x", "rank_y").alias("_r"), F.min("x").alias("_x0"), F.max("x").alias("_x1"),
        F.min("y").alias("_y0"), F.max("y").alias("_y1"),
    )
    r = F.when((F.col("_x0") < F.col("_x1")) & (F.col("_y0") < F.col("_y1")), F.col("_r"))
    return found.select(*keys, "n", r.alias("spearman"), (r * F.sqrt(F.col("n") - 1)).alias("z"))


def spearman_atlas(
    scores: DataFrame, samples: DataFrame, fields: Sequence[str] | None = None, identifiers: Sequence[str] = (),
    design: str = "cross_sectional", roles: Mapping[str, str] | None = None, unit: str = "sample_id",
) -> DataFrame:
    """Every component against every eligible numeric field: ``component, field, role, design, n, spearman, z``.

    Identifier fields are left out. ``roles`` names fields declared before the analysis (``target``, ``nuisance``), all others
    are ``discovered``. Repeated observations of a subject are refused; see ``trajectory_divergence``.
    """
    if design != "cross_sectional":
        raise ContractError(f"rank associations take independent observations, not a {design} design")
    fields = eligible_fields(samples, identifiers, unit) if fields is None else [f for f in fields if f not in set(identifiers)]
    if not fields:
        raise ContractError("no eligible field")
    role = F.lit("discovered")
    for f, r in (roles or {}).items():
        role = F.when(F.col("field") == f, r).otherwise(role)
    found = spearman(pairs_of(scores, samples, fields, unit))
    return found.select("component", "field", role.alias("role"), F.lit(design).alias("design"), "n", "spearman", "z")


# --- X2: separation of two groups --------------------------------------------------------


def group_separation(pairs: DataFrame, keys: Sequence[str] = ("component", "field")) -> DataFrame:
    """``(keys.., n0, n1, u, rank_biserial, z, point_biserial)`` for ``y`` in 0 and 1; other values are refused.

    ``u`` counts how often a value of group 1 exceeds one of group 0, ties half, from the rank sum. ``z`` uses the variance
    corrected for ties. Null where a group is empty or nothing varies.
    """
    keys = list(keys)
    odd = F.raise_error(F.lit("a binary field holds values other than 0 and 1")).cast("double")
    rows = materialise(pairs.select(*keys, "x", F.when(F.col("y").isin(0.0, 1.0), F.col("y")).otherwise(odd).alias("y")))
    ties = F.col("ties")
    tied = tie_sum(rows, keys, "x", ties * ties * ties - ties, "_t")
    found = with_ranks(rows, keys, ["x"]).groupBy(*keys).agg(
        F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"),
        F.sum(F.when(F.col("y") == 1, F.col("rank_x")).otherwise(0.0)).alias("_r1"), _corr("x", "y").alias("_c"),
    ).join(small_side(materialise(tied)), keys)
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    n = n0 + n1
    u = F.col("_r1") - n1 * (n1 + 1) / 2
    both = (n0 > 0) & (n1 > 0)
    spread = n0 * n1 / 12 * (n + 1 - F.try_divide(F.col("_t"), n * (n - 1)))
    return found.select(
        *keys, "n0", "n1", F.when(both, u).alias("u"), F.when(both, F.try_divide(2 * u, n0 * n1) - 1).alias("rank_biserial"),
        F.when(both & (spread > 0), F.try_divide(u - n0 * n1 / 2, F.sqrt(spread))).alias("z"),
        F.when(both & (spread > 0), F.col("_c")).alias("point_biserial"),
    )


# --- X3: ordered trend -------------------------------------------------------------------


def weighted_inversions(value: np.ndarray, weight: np.ndarray) -> int:
    """Sum of ``w_i w_j`` over ``i < j`` with ``value_i > value_j``; the values are a permutation of ``0 .. n-1``.

    Bit by bit from the highest: inside a group of equal higher bits every pair with a one before a zero is inverted.
    """
    v, w = value.astype(np.int64), weight.astype(np.int64)
    total = 0
    for bit in range(max(1, int(len(v)).bit_length()) - 1, -1, -1):
        one = (v >> bit) & 1
        ones = np.cumsum(w * one)
        group = v >> (bit + 1)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(v) else np.zeros(0, np.int64)
        start = np.repeat((ones - w * one)[first], np.diff(np.r_[first, len(v)]))
        total += int(((ones - start) * w * (1 - one)).sum())
        order = np.argsort(v >> bit, kind="stable")
        v, w = v[order], w[order]
    return total


def _dense(values: np.ndarray) -> np.ndarray:
    """Distinct numbers as ``0 .. n-1`` in their order."""
    out = np.empty(len(values), np.int64)
    out[np.argsort(values, kind="stable")] = np.arange(len(values))
    return out


def discordant(points: DataFrame, keys: Sequence[str], block: int = BLOCK_ROWS, most: int = MOST_BLOCKS) -> DataFrame:
    """``(keys.., discordant)``: weighted pairs with ``x_i < x_j`` and ``y_i > y_j`` among distinct points ``keys.., x, y, w``.

    Points are numbered once by (x, y) and once by (y, x); a pair is discordant if the two orders disagree, and ties never
    do. Both orders are cut into blocks of equal size. Pairs in different blocks of both orders follow from the counts per
    pair of blocks; pairs in one block of an order are counted in a task each; those in one block of both are taken off
    once. A group has at most ``most`` blocks each way, so the counts form a small matrix. Counts are exact for groups
    of up to 4 * 10^9 observations.
    """
    keys = list(keys)
    first = grouped_row_number(points, keys, ["x", "y"], "_a")
    both = materialise(grouped_row_number(first, keys, ["y", "x"], "_b"))
    size = materialise(both.groupBy(*keys).agg(F.greatest(F.lit(block), F.ceil(F.count("*") / most)).alias("_size")))
    a, b = (F.floor((F.col(c) - 1) / F.col("_size")).cast("int").alias(n) for c, n in (("_a", "p"), ("_b", "q")))
    laid = materialise(both.join(small_side(size), keys).select(*keys, "w", "_a", "_b", a, b))
    kind = ", ".join(f"`{k}` {laid.schema[k].dataType.simpleString()}" for k in keys)
    head = kind + ", " if kind else ""

    def by_x(pdf: pd.DataFrame) -> pd.DataFrame:
        """Counts of the block's points per block of the other order, and its own inversions less those of shared blocks."""
        pdf = pdf.sort_values("_a")
        own = weighted_inversions(_dense(pdf["_b"].to_numpy()), pdf["w"].to_numpy())
        rows = []
        for q, cell in pdf.groupby("q", sort=True):
            shared = weighted_inversions(_dense(cell["_b"].to_numpy()), cell["w"].to_numpy())
            rows.append((int(q), int(cell["w"].sum()), own - shared))
            own = 0
        out = pd.DataFrame(rows, columns=["q", "c", "inv"])
        for i, k in enumerate(keys):
            out.insert(i, k, [pdf[k].iat[0]] * len(out))
        out.insert(len(keys), "p", int(pdf["p"].iat[0]))
        return out

    def by_y(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_a")
        out = pd.DataFrame({"inv": [weighted_inversions(_dense(pdf["_b"].to_numpy()), pdf["w"].to_numpy())]})
        for i, k in enumerate(keys):
            out.insert(i, k, [pdf[k].iat[0]])
        return out

    def matrix(pdf: pd.DataFrame) -> pd.DataFrame:
        c = np.zeros((int(pdf["p"].max()) + 1, int(pdf["q"].max()) + 1), dtype=object)
        c[pdf["p"].to_numpy(), pdf["q"].to_numpy()] = [int(x) for x in pdf["c"]]
        # for each pair of blocks: points of later blocks by x that lie in earlier blocks by y
        later = np.cumsum(c[::-1], axis=0)[::-1]
        later = np.vstack([later[1:], np.zeros((1, c.shape[1]), dtype=object)])
        lower = np.cumsum(later, axis=1) - later
        out = pd.DataFrame({"inv": [int((c * lower).sum()) + int(pdf["inv"].sum())]})
        for i, k in enumerate(keys):
            out.insert(i, k, [pdf[k].iat[0]])
        return out

    cells = materialise(laid.groupBy(*keys, "p").applyInPandas(by_x, f"{head}p int, q int, c long, inv long"))
    apart = cells.groupBy(*keys).applyInPandas(matrix, f"{head}inv long")
    beside = laid.groupBy(*keys, "q").applyInPandas(by_y, f"{head}inv long")
    return apart.unionByName(beside).groupBy(*keys).agg(F.sum("inv").alias("discordant"))


def ordered_trend(pairs: DataFrame, keys: Sequence[str] = ("component", "field"), block: int = BLOCK_ROWS) -> DataFrame:
    """``(keys.., n, spearman, kendall, kendall_z)`` of ``x`` along the ordered states ``y``.

    Kendall's tau-b from an inversion count, no pairs; ``kendall_z`` uses the variance corrected for ties on both sides.
    Null where a side has no spread.
    """
    keys = list(keys)
    pairs = materialise(pairs.select(*keys, "x", "y"))
    points = materialise(pairs.groupBy(*keys, "x", "y").agg(F.count("*").alias("w")))
    joint = points.groupBy(*keys).agg(F.sum("w").cast("double").alias("n"), F.sum(F.col("w").cast("double") * (F.col("w") - 1) / 2).alias("n3"))
    found = joint.join(discordant(points, keys, block), keys)
    for side in ("x", "y"):
        t = F.col("t").cast("double")
        tied = points.groupBy(*keys, side).agg(F.sum("w").alias("t")).groupBy(*keys).agg(
            F.sum(t * (t - 1) / 2).alias(f"pairs_{side}"), F.sum(t * (t - 1) * (t - 2)).alias(f"threes_{side}"),
            F.sum(t * (t - 1) * (2 * t + 5)).alias(f"var_{side}"),
        )
        found = found.join(tied, keys)
    n = F.col("n")
    n0 = n * (n - 1) / 2
    s = n0 - F.col("pairs_x") - F.col("pairs_y") + F.col("n3") - 2 * F.col("discordant")
    left, right = n0 - F.col("pairs_x"), n0 - F.col("pairs_y")
    spread = (left > 0) & (right > 0)
    variance = (
        (n * (n - 1) * (2 * n + 5) - F.col("var_x") - F.col("var_y")) / 18
        + F.try_divide(2 * F.col("pairs_x") * F.col("pairs_y"), n * (n - 1))
        + F.when(n > 2, F.try_divide(F.col("threes_x") * F.col("threes_y"), 9 * n * (n - 1) * (n - 2))).otherwise(0.0)
    )
    kendall = found.select(
        *keys, F.when(spread, F.try_divide(s, F.sqrt(left) * F.sqrt(right))).alias("kendall"), F.when(spread, F.try_divide(s, F.sqrt(variance))).alias("kendall_z")
    )
    return spearman(pairs, keys).drop("z").join(kendall, keys).select(*keys, "n", "spearman", "kendall", "kendall_z")


# --- X8: layers on one axis -----------------------------------------------------------------


def layer_concordance(coords: DataFrame, keys: Sequence[str] = (), layer: str = "layer", unit: str = "sample_id", coord: str = "coord") -> DataFrame:
    """Coefficient of concordance over layers: ``keys.., layers, units, complete, w, chi2``.

    ``units`` counts all units, ``complete`` those that every layer of the group has; only these are ranked. ``w`` is
    Kendall's coefficient corrected for ties, ``chi2`` its statistic with ``complete - 1`` degrees of freedom. A unit that
    occurs twice in a layer is refused. Null where fewer than two layers or units remain or nothing varies.
    """
    ranked, shape = _layer_ranks(coords, list(keys), layer, unit, coord)
    keys = list(keys)
    total = ranked.groupBy(*keys, "unit").agg(F.sum("rank_x").alias("r"))
    spread = total.groupBy(*keys).agg((F.var_pop("r") * F.count("*")).alias("s"))
    ties = F.col("ties")
    tied = tie_sum(ranked, [*keys, "layer"], "x", ties * ties * ties - ties, "t").groupBy(*keys).agg(F.sum("t").alias("t"))
    m, n = F.col("layers").cast("double"), F.col("complete").cast("double")
    room = m * m * (n * n * n - n) - m * F.col("t")
    w = F.when((m >= 2) & (n >= 2) & (room > 0), F.try_divide(12 * F.col("s"), room))
    found = _on(_on(shape, spread, keys), tied, keys)
    return found.select(*keys, "layers", "units", "complete", w.alias("w"), (m * (n - 1) * w).alias("chi2"))


def layer_profile(coords: DataFrame, keys: Sequence[str] = (), layer: str = "layer", unit: str = "sample_id", coord: str = "coord") -> DataFrame:
    """Each layer against the rank sum of the others: ``keys.., layer, complete, agreement, z, direction``.

    ``direction`` is ``against`` for a layer that runs the other way by more than 1.96 standard errors, ``with`` for one that
    agrees by as much, else ``unclear``. Such a layer is reported, never averaged away or flipped.
    """
    keys = list(keys)
    ranked, _ = _layer_ranks(coords, keys, layer, unit, coord)
    whole = ranked.groupBy(*keys, "unit").agg(F.sum("rank_x").alias("_all"))
    others = ranked.join(whole, [*keys, "unit"]).select(*keys, "layer", "x", (F.col("_all") - F.col("rank_x")).alias("y"))
    found = spearman(others, [*keys, "layer"])
    z = F.col("z")
    said = F.when(z < -1.96, "against").when(z > 1.96, "with").when(z.isNotNull(), "unclear")
    return found.select(*keys, F.col("layer").alias(layer), F.col("n").alias("complete"), F.col("spearman").alias("agreement"), "z", said.alias("direction"))


def _on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on the keys; of two one-row tables without keys the columns side by side."""
    return left.join(right, keys, "left") if keys else left.withColumn("_r", right.select(F.struct("*")).scalar()).select("*", "_r.*").drop("_r")


def _layer_ranks(coords: DataFrame, keys: list[str], layer: str, unit: str, coord: str) -> tuple[DataFrame, DataFrame]:
    rows = materialise(coords.select(*keys, F.col(layer).alias("layer"), F.col(unit).alias("unit"), F.col(coord).cast("double").alias("x")).filter(_finite("x")))
    layers = materialise(rows.groupBy(*keys).agg(F.countDistinct("layer").alias("layers"), F.countDistinct("unit").alias("units")))
    seen = rows.groupBy(*keys, "unit").agg(F.count("*").alias("_c"), F.countDistinct("layer").alias("_l"))
    twice = F.raise_error(F.lit("a unit occurs twice in a layer")).cast("boolean")
    whole = _on(seen, small_side(layers.drop("units")), keys).filter(F.when(F.col("_c") != F.col("_l"), twice).otherwise(F.col("_l") == F.col("layers")))
    complete = materialise(whole.select(*keys, "unit"))
    shape = _on(layers, complete.groupBy(*keys).agg(F.count("*").alias("complete")), keys).withColumn("complete", F.coalesce("complete", F.lit(0)))
    kept = rows.join(complete, [*keys, "unit"], "left_semi")
    return materialise(with_ranks(kept, [*keys, "layer"], ["x"])), shape


# --- X5: proposal and confirmation -------------------------------------------------------------


def table_digest(table: DataFrame, columns: Sequence[str], digits: int = 6) -> Column:
    """An aggregate: SHA-256 of the rows' texts in order; for small tables (one row per component and field)."""
    kinds = dict(table.dtypes)
    texts = [
        F.coalesce(F.format_string(f"%.{digits}f", F.col(c)) if kinds[c] in ("double", "float") else F.col(c).cast("string"), F.lit("-")) for c in columns
    ]
    return F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", *texts))), "\n"), 256)


ATLAS_COLUMNS = ("component", "field", "role", "n", "spearman")


def propose_component(atlas: DataFrame, target: str, nuisance: Sequence[str] = (), margin: float = 0.05, floor: float = 0.1, unstable: DataFrame | None = None) -> DataFrame:
    """Components ranked by the size of their association with the target.

    Columns ``component, rank, score, direction, nuisance_field, nuisance_score, alert, eligible, recommended, atlas_digest``.
    Nuisance associations stand beside the score and never change it; ``alert`` marks one at least as strong. Nothing is
    recommended (an abstention) if the best eligible score is under ``floor`` or leads by less than ``margin``. Components in
    ``unstable(component)`` are ranked but not eligible. The atlas is one row per component and field, so the ranking is small.
    """
    digest = atlas.agg(table_digest(atlas, ATLAS_COLUMNS))
    size = F.abs("spearman")
    wanted = atlas.filter(F.col("field") == target).select("component", size.alias("score"), F.signum("spearman").cast("int").alias("direction"))
    beside = atlas.filter(F.col("field").isin(*nuisance)) if nuisance else atlas.filter(F.lit(False))
    worst = beside.groupBy("component").agg(F.max(F.struct(size.alias("s"), F.col("field").alias("f"))).alias("w"))
    rows = wanted.join(worst, "component", "left").select(
        "component", "score", "direction", F.col("w.f").alias("nuisance_field"), F.col("w.s").alias("nuisance_score")
    )
    if unstable is None:
        rows = rows.withColumn("eligible", F.col("score").isNotNull())
    else:
        marked = unstable.select("component").distinct().withColumn("_u", F.lit(True))
        rows = rows.join(marked, "component", "left").withColumn("eligible", F.col("score").isNotNull() & F.col("_u").isNull()).drop("_u")
    best = Window.orderBy(F.col("score").desc_nulls_last(), "component")
    able = Window.orderBy(F.col("eligible").desc(), F.col("score").desc_nulls_last(), "component")
    ranked = rows.withColumn("rank", F.row_number().over(best)).withColumn("_e", F.row_number().over(able)).withColumn("_next", F.lead(F.when(F.col("eligible"), F.col("score"))).over(able))
    clear = F.col("eligible") & (F.col("_e") == 1) & (F.col("score") >= floor) & (F.col("score") - F.coalesce("_next", F.lit(0.0)) >= margin)
    return ranked.select(
        "component", "rank", "score", "direction", "nuisance_field", "nuisance_score",
        F.coalesce(F.col("nuisance_score") >= F.col("score"), F.lit(False)).alias("alert"), "eligible", F.coalesce(clear, F.lit(False)).alias("recommended"),
        digest.scalar().alias("atlas_digest"),
    )


PROPOSAL_COLUMNS = ("component", "rank", "score", "direction", "nuisance_field", "nuisance_score", "alert", "eligible", "recommended", "atlas_digest")


def confirm_component(proposal: DataFrame, component: int, rationale: str, dataset: str, target: str) -> DataFrame:
    """The record of a person's choice: one row that names the choice and the digests it rests on.

    ``decision`` is ``accepted`` if the component was recommended, ``chosen`` after an abstention, else ``overridden``. A
    component that is not in the proposal or not eligible, and an empty rationale, are refused.
    """
    if not rationale.strip():
        raise ContractError("a confirmation needs a rationale")
    mine = F.col("component") == component
    refused = F.raise_error(F.lit(f"component {component} is not an eligible component of the proposal")).cast("string")
    return proposal.agg(
        F.max(F.when(mine & F.col("eligible"), F.col("recommended").cast("int"))).alias("_r"), F.max(F.col("recommended").cast("int")).alias("_any"),
        F.max("atlas_digest").alias("atlas_digest"), table_digest(proposal, PROPOSAL_COLUMNS).alias("proposal_digest"),
    ).select(
        F.lit(f"{dataset}_{target}_PC{component}").alias("id"), F.lit(target).alias("target"), F.lit(component).alias("selected_component"),
        F.when(F.col("_r").isNull(), refused).when(F.col("_r") == 1, "accepted").when(F.col("_any") == 0, "chosen").otherwise("overridden").alias("decision"),
        F.lit(rationale).alias("rationale"), "atlas_digest", "proposal_digest",
    )


def confirmation_violations(record: DataFrame, atlas: DataFrame, proposal: DataFrame) -> DataFrame:
    """Links of the chain atlas -> proposal -> confirmation that no longer hold, as ``check, key, detail``."""
    now = record.select(
        "id", "atlas_digest", "proposal_digest", atlas.agg(table_digest(atlas, ATLAS_COLUMNS)).scalar().alias("_atlas"),
        proposal.agg(table_digest(proposal, PROPOSAL_COLUMNS)).scalar().alias("_proposal"), proposal.agg(F.max("atlas_digest")).scalar().alias("_rests"),
    )
    return union_all([
        violation(now.filter("_atlas <> atlas_digest"), "stale_atlas", "id", "the atlas is not the one the confirmation rests on"),
        violation(now.filter("_proposal <> proposal_digest"), "stale_proposal", "id", "the proposal is not the one that was confirmed"),
        violation(now.filter("_rests <> _atlas"), "proposal_of_other_atlas", "id", "the proposal was made from another atlas"),
    ])
