"""Preparation of measurement tables and sample metadata."""

from __future__ import annotations

from functools import reduce
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewell.common import ContractError, key_text, union_all, violation


@dataclass(frozen=True)
class Checked:
    """A result table and the rows that broke its contract."""

    table: DataFrame
    violations: DataFrame


# --- features and keys -------------------------------------------------------


def shared_features(cells: DataFrame, n_layers: int | None = None, cohort: Sequence[str] = ()) -> DataFrame:
    """Features present in every layer, by one partially aggregated pass."""
    seen = cells.select(*cohort, "layer", "feature_id").distinct()
    counted = seen.groupBy(*cohort, "feature_id").agg(F.count("*").alias("_l"))
    if n_layers is not None:
        return counted.filter(F.col("_l") == n_layers).drop("_l")
    if cohort:
        total = seen.groupBy(*cohort).agg(F.countDistinct("layer").alias("_k"))
        return counted.join(total, list(cohort)).filter(F.col("_l") == F.col("_k")).drop("_l", "_k")
    total = seen.agg(F.countDistinct("layer").alias("_k"))
    return counted.filter(F.col("_l") == total.scalar()).drop("_l")


def keep_features(cells: DataFrame, features: DataFrame) -> DataFrame:
    on = [c for c in features.columns if c in cells.columns]
    return cells.join(features, on, "left_semi")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def duplicate_violations(df: DataFrame, keys: Sequence[str], check: str = "duplicate_key") -> DataFrame:
    return violation(duplicate_keys(df, keys), check, key_text(keys), F.format_string("%d rows", F.col("n")))


# --- metadata joins -------------------------------------------------------------


def attach_one_to_one(
    meta: DataFrame, mapping: DataFrame, on: Sequence[str], attach: Sequence[str], agree: Sequence[str] = ()
) -> Checked:
    """Attach columns one to one, with every mismatch as a violation row.

    Both sides are first reduced to one row per key, so a key repeated a
    million times costs one row in the join and one violation.
    """
    on = list(on)

    def reduced(df: DataFrame, values: Sequence[str], side: str) -> DataFrame:
        aggs = [F.min(v).alias(f"{side}_{v}") for v in values]
        return df.groupBy(*on).agg(F.count("*").alias(f"{side}_n"), *aggs)

    both = reduced(meta, agree, "l").join(reduced(mapping, [*agree, *attach], "r"), on, "full_outer")
    kinds = [
        F.when(F.col("l_n") > 1, F.lit("duplicate_sample")),
        F.when(F.col("r_n") > 1, F.lit("duplicate_mapping")),
        F.when(F.col("r_n").isNull(), F.lit("unmatched_sample")),
        F.when(F.col("l_n").isNull(), F.lit("unmatched_mapping")),
    ]
    matched = F.col("l_n").isNotNull() & F.col("r_n").isNotNull()
    kinds += [
        F.when(matched & ~F.col(f"l_{a}").eqNullSafe(F.col(f"r_{a}")), F.lit(f"mismatched_{a}")) for a in agree
    ]
    broken = both.select(key_text(on).alias("key"), F.explode(F.array_compact(F.array(*kinds))).alias("check"))
    good = both.filter((F.col("l_n") == 1) & (F.col("r_n") == 1)).select(
        *on, *[F.col(f"r_{a}").alias(a) for a in attach]
    )
    detail = F.lit("one-to-one attach").alias("detail")
    return Checked(meta.join(good, on), broken.select("check", "key", detail))


def build_mapping(
    names: DataFrame, source: DataFrame, key: str, subject: str, layer_name: str, rename: Mapping[str, str]
) -> Checked:
    """Mapping of expression names to source rows, joined on the library key.

    ``names`` holds ``sample_id``, ``key`` and the parsed ``subject``; ``source``
    is already filtered to one cohort and assay. ``rename`` maps source columns
    to output columns.
    """
    dup = duplicate_violations(source, [key], "duplicate_library")
    missing = violation(names.join(source, key, "left_anti"), "missing_library", F.col("sample_id"), F.col(key))
    src = source.select(key, F.col(subject).cast("string").alias("_src"), *[F.col(a).alias(b) for a, b in rename.items()])
    joined = names.join(src, key)
    wrong = violation(
        joined.filter(~F.col(subject).eqNullSafe(F.col("_src"))), "subject_mismatch", F.col("sample_id"), F.col("_src")
    )
    table = joined.select(
        F.col("sample_id").alias("expression_name"),
        F.col(key).alias("library_id"),
        F.lit(layer_name).alias("prepared_layer"),
        F.col("_src").alias("subject_id"),
        *rename.values(),
    )
    return Checked(table, union_all([dup, missing, wrong]))


def in_contract_order(df: DataFrame, layer: str, layers: Sequence[str], subject: str, time: str) -> DataFrame:
    """P10: explicit layer order, then subject, then time (a total sort)."""
    rank = F.array_position(F.array(*[F.lit(x) for x in layers]), F.col(layer))
    return df.withColumn("layer_rank", rank).orderBy("layer_rank", subject, time)


def union_metadata(frames: Sequence[DataFrame]) -> DataFrame:
    """cohorts' metadata by column name; absent columns become null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def matched_pairs(a: DataFrame, b: DataFrame, key: str = "pair_key") -> Checked:
    """Keys present once on both sides, and repeated keys as violations."""
    na = a.groupBy(key).agg(F.count("*").alias("na"), F.min("sample_id").alias("sample_a"))
    nb = b.groupBy(key).agg(F.count("*").alias("nb"), F.min("sample_id").alias("sample_b"))
    bad = union_all(
        [
            violation(na.filter("na > 1"), "duplicate_pair_key_a", F.col(key), F.col("na").cast("string")),
            violation(nb.filter("nb > 1"), "duplicate_pair_key_b", F.col(key), F.col("nb").cast("string")),
        ]
    )
    pairs = na.filter("na = 1").join(nb.filter("nb = 1"), key).select(key, "sample_a", "sample_b")
    return Checked(pairs, bad)


def rekey_pairs(cells: DataFrame, pairs: DataFrame, sample_column: str, key: str = "pair_key") -> DataFrame:
    """Keep paired samples' cells under the shared key."""
    names = pairs.select(F.col(sample_column).alias("sample_id"), F.col(key).alias("_key"))
    return cells.join(names, "sample_id").withColumn("sample_id", F.col("_key")).drop("_key")


def with_constants(df: DataFrame, constants: Mapping[str, object], null_strings: Sequence[str] = ()) -> DataFrame:
    """Constant and null metadata columns."""
    new = {k: F.lit(v) for k, v in constants.items()}
    new |= {k: F.lit(None).cast("string") for k in null_strings}
    return df.withColumns(new)


def count_contract(df: DataFrame, by: str, expected: DataFrame) -> DataFrame:
    """Groups whose row count differs from ``expected(by, n_expected)``."""
    got = df.groupBy(by).agg(F.count("*").alias("n"))
    both = got.join(expected, by, "full_outer").filter(~F.col("n").eqNullSafe(F.col("n_expected")))
    return violation(
        both,
        "expected_count",
        F.col(by),
        F.concat(
            F.coalesce(F.col("n").cast("string"), F.lit("0")),
            F.lit(" of "),
            F.coalesce(F.col("n_expected").cast("string"), F.lit("none")),
        ),
    )


def flag_conflicts(df: DataFrame, left: Column, right: Column, reason: str, status: str) -> DataFrame:
    """Rows whose two labels disagree are kept but excluded with a reason."""
    same = left.eqNullSafe(right)
    return df.withColumns(
        {
            "include": same,
            "exclusion_reason": F.when(same, "").otherwise(reason),
            "metadata_status": F.when(same, "matched").otherwise(status),
        }
    )


def join_with_reasons(
    ids: DataFrame, source: DataFrame, on: str, marker: str, reason: str, otherwise: str, label: str, unknown: str
) -> DataFrame:
    """P20: left join that keeps unmatched ids with an exclusion reason.

    An unmatched id whose lower-cased text contains ``marker`` gets ``reason``
    and the tissue ``label``; the others get ``otherwise`` and ``unknown``.
    """
    found = source.withColumn("_hit", F.lit(True))
    joined = ids.join(found, on, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    marked = F.lower(F.col(on).cast("string")).contains(marker)
    out = joined.withColumns(
        {
            "include": hit,
            "exclusion_reason": F.when(hit, "").when(marked, reason).otherwise(otherwise),
            "metadata_status": F.when(hit, "matched").otherwise("unmatched"),
        }
    )
    tissue = F.col("tissue") if "tissue" in out.columns else F.lit(None).cast("string")
    return out.withColumn("tissue", F.when(hit, tissue).when(marked, label).otherwise(unknown)).drop("_hit")


def order_agreement(matrix_ids: DataFrame, meta_ids: DataFrame) -> DataFrame:
    """Positions at which two ``(position, id)`` lists differ."""
    a = matrix_ids.select("position", F.col("id").alias("matrix_id"))
    b = meta_ids.select("position", F.col("id").alias("meta_id"))
    diff = a.join(b, "position", "full_outer").filter(~F.col("matrix_id").eqNullSafe(F.col("meta_id")))
    return violation(
        diff,
        "row_order",
        F.col("position"),
        F.concat_ws(" vs ", F.coalesce("matrix_id", F.lit("NULL")), F.coalesce("meta_id", F.lit("NULL"))),
    )


# --- audits ---------------------------------------------------------------------


def prepared_audit(
    cells: DataFrame, samples: DataFrame, subject: str, time: str, keys: Sequence[str] = ("layer",)
) -> DataFrame:
    """Features, observations, subjects, time range and gaps per layer.

    Cells and samples are aggregated apart; only one row per layer is joined.
    """
    c = cells.groupBy(*keys).agg(
        F.countDistinct("feature_id").alias("features"), F.count_if(F.col("value").isNull()).alias("missing_values")
    )
    s = samples.groupBy(*keys).agg(
        F.count("*").alias("observations"),
        F.countDistinct(subject).alias("subjects"),
        F.min(time).alias("min_time"),
        F.max(time).alias("max_time"),
        F.count_if(F.col(time).isNull()).alias("missing_time"),
    )
    return c.join(s, list(keys), "full_outer")


def time_order_violations(
    df: DataFrame, subject: str, time: str, row_index: str | None = None, chunk: int = 1_000_000
) -> DataFrame:
    """Subjects whose time does not strictly increase.

    Without a stored order this is a tie check. With ``row_index`` every row is
    compared with the one stored before it; long subjects are cut into index
    chunks whose borders are compared in a second, much smaller window.
    """
    if row_index is None:
        ties = df.groupBy(subject, time).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
        return ties.groupBy(subject).agg(F.sum(F.col("n") - 1).alias("breaks"))
    data = df.select(subject, F.col(time).alias("_t"), F.col(row_index).alias("_i")).withColumn(
        "_chunk", F.floor(F.col("_i") / chunk)
    )
    inner = Window.partitionBy(subject, "_chunk").orderBy("_i")
    step = data.withColumn("_bad", (F.col("_t") <= F.lag("_t").over(inner)).cast("int"))
    per_chunk = step.groupBy(subject, "_chunk").agg(
        F.sum(F.coalesce("_bad", F.lit(0))).alias("_bad"),
        F.min_by("_t", "_i").alias("_first"),
        F.max_by("_t", "_i").alias("_last"),
    )
    outer = Window.partitionBy(subject).orderBy("_chunk")
    border = (F.col("_first") <= F.lag("_last").over(outer)).cast("int")
    return (
        per_chunk.withColumn("_border", F.coalesce(border, F.lit(0)))
        .groupBy(subject)
        .agg(F.sum(F.col("_bad") + F.col("_border")).alias("breaks"))
        .filter(F.col("breaks") > 0)
    )


def cap_rows(
    df: DataFrame, by: Sequence[str], order: Sequence[str], cap: int, smaller: Mapping[str | tuple, int] | None = None
) -> DataFrame:
    """First ``cap`` rows of every group; listed groups (a value, or a tuple for several columns) get a smaller cap.

    Spark trims each map task to the cap before the shuffle.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    limit = F.lit(cap)
    for group, n in (smaller or {}).items():
        values = group if isinstance(group, tuple) else (group,)
        if len(values) != len(by):
            raise ContractError("a smaller cap needs one value per grouping column")
        same = reduce(lambda a, b: a & b, [F.col(c).cast("string").eqNullSafe(F.lit(v)) for c, v in zip(by, values)])
        limit = F.when(same, F.least(F.lit(n), F.lit(cap))).otherwise(limit)
    ranked = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= cap)
    return ranked.filter(F.col("_rn") <= limit).drop("_rn")


def forbidden_fields(df: DataFrame, pattern: str = "endpoint|event") -> list[str]:
    """P25: column names that must not be present."""
    import re

    return [c for c in df.columns if re.search(pattern, c)]


def require_no_forbidden(df: DataFrame, pattern: str = "endpoint|event") -> None:
    found = forbidden_fields(df, pattern)
    if found:
        raise ContractError(f"forbidden fields: {', '.join(found)}")
