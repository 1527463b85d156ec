"""Table contracts as queries: each returns violation rows.

An empty table means the contract holds; ``statewell.common.enforce`` is the
strict mode that raises.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statewell.common import ContractError, failed_checks, key_text, union_all, violation
from statewell.functions.digests import canonical_digest, content_digest


def _no_key():
    return F.lit("")



def _schema_violations(spark, rows: list[tuple[str, str, str]]) -> DataFrame:
    """Findings known from the schema alone, as a violations table."""
    if not rows:
        return spark.range(0).select(*[F.lit("").alias(c) for c in ("check", "key", "detail")])
    entries = [F.struct(*[F.lit(v).alias(c) for c, v in zip(("check", "key", "detail"), r)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*entries)))


def missing_columns(df: DataFrame, needed: Sequence[str], check: str = "missing_column") -> list[tuple[str, str, str]]:
    return [(check, c, "column not found") for c in needed if c not in df.columns]


# --- V1: sampling design ----------------------------------------------------------


def longitudinal_violations(
    samples: DataFrame, subject: str, time: str, ordered_levels: Sequence[str] | None = None
) -> DataFrame:
    """V1: a longitudinal cohort: keys present, time usable, visits repeated once.

    Times may be numeric, dates or timestamps, or strings with declared ordered
    levels. "At least one subject with two times" is ``min < max`` per subject,
    so no distinct set is built for any subject.
    """
    spark = samples.sparkSession
    absent = missing_columns(samples, [subject, time])
    if absent:
        return _schema_violations(spark, absent)
    kind = samples.schema[time].dataType
    usable = isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))
    if not usable and not ordered_levels:
        return _schema_violations(spark, [("time_type", time, "must be numeric, date, timestamp or ordered")])
    nulls = samples.agg(
        F.count_if(F.col(subject).isNull()).alias("s"), F.count_if(F.col(time).isNull()).alias("t")
    )
    null_rows = failed_checks(
        nulls,
        _no_key(),
        {
            "subject_null": (F.col("s") > 0, F.format_string("%d null subjects", F.col("s"))),
            "time_null": (F.col("t") > 0, F.format_string("%d null times", F.col("t"))),
        },
    )
    visits = samples.groupBy(subject, time).agg(F.count("*").alias("n"))
    repeated = violation(
        visits.filter(F.col("n") > 1), "duplicate_visit", key_text([subject, time]), F.format_string("%d rows", F.col("n"))
    )
    spans = visits.groupBy(subject).agg((F.min(time) < F.max(time)).alias("repeats"))
    none = failed_checks(
        spans.agg(F.count_if("repeats").alias("r")),
        _no_key(),
        {"no_repeated_subject": (F.col("r") == 0, "needs a subject with distinct repeated times")},
    )
    return union_all([null_rows, repeated, none])


# --- V3-V6: declared fields and matrices --------------------------------------------


def target_violations(
    samples: DataFrame, field: str, kind: str, levels: Sequence[str] | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """V3: binary/ordered levels equal the declared set; continuous varies."""
    if field not in samples.columns:
        return _schema_violations(samples.sparkSession, missing_columns(samples, [field]))
    key = key_text(list(keys))
    value = F.col(field)
    if kind in ("binary", "ordered"):
        if not levels or (kind == "binary" and len(levels) != 2):
            raise ContractError("declare the levels of the target")
        # one row per observed level: bounded by the number of distinct values
        seen = samples.groupBy(*keys, value.cast("string").alias("_level")).agg(F.count("*").alias("_n"))
        declared = [F.lit(x) for x in levels]
        known = F.col("_level").isin(list(levels))
        summary = seen.groupBy(*keys).agg(
            F.coalesce(F.sum(F.when(F.col("_level").isNull(), F.col("_n"))), F.lit(0)).alias("nulls"),
            F.count_if(~known).alias("foreign"),
            F.sort_array(F.array_except(F.array(*declared), F.collect_set(F.when(known, F.col("_level"))))).alias("unseen"),
        )
        return failed_checks(
            summary,
            key,
            {
                "target_null": (F.col("nulls") > 0, F.format_string("%d nulls", F.col("nulls"))),
                "target_undeclared_level": (F.col("foreign") > 0, F.format_string("%d levels", F.col("foreign"))),
                "target_unseen_level": (F.size("unseen") > 0, F.concat_ws(",", "unseen")),
            },
        )
    if kind == "continuous":
        return _varying(samples, field, keys, "target")
    raise ContractError(f"unknown target type {kind}")


def anchor_violations(samples: DataFrame, field: str, keys: Sequence[str] = ()) -> DataFrame:
    """V4: the orientation anchor is finite and varies."""
    if field not in samples.columns:
        return _schema_violations(samples.sparkSession, missing_columns(samples, [field]))
    return _varying(samples, field, keys, "anchor")


def _varying(samples: DataFrame, field: str, keys: Sequence[str], name: str) -> DataFrame:
    if not isinstance(samples.schema[field].dataType, T.NumericType):
        return _schema_violations(samples.sparkSession, [(f"{name}_type", field, "must be numeric")])
    v = F.col(field).cast("double")
    odd = F.isnan(v) | (F.abs(v) == float("inf"))
    # range, not variance: exact, and immune to rounding for constant fields
    ok = F.when(~F.coalesce(odd, F.lit(True)), v)
    summary = samples.groupBy(*keys).agg(
        F.count_if(v.isNull()).alias("nulls"),
        F.count_if(odd).alias("odd"),
        F.count("*").alias("n"),
        F.coalesce(F.max(ok) - F.min(ok), F.lit(0.0)).alias("range"),
    )
    return failed_checks(
        summary,
        key_text(list(keys)),
        {
            f"{name}_null": (F.col("nulls") > 0, F.format_string("%d nulls", F.col("nulls"))),
            f"{name}_not_finite": (F.col("odd") > 0, F.format_string("%d values", F.col("odd"))),
            f"{name}_too_few": (F.col("n") < 2, "fewer than two values"),
            f"{name}_constant": ((F.col("n") >= 2) & (F.col("range") == 0), "zero variance"),
        },
    )


def component_violations(
    loadings: DataFrame, selected: int, lifecycle: str = "confirmed", keys: Sequence[str] = ("layer",)
) -> DataFrame:
    """V5: the selected component exists and the declaration is confirmed."""
    state = [] if lifecycle == "confirmed" else [("lifecycle", lifecycle, "a confirmed declaration is required")]
    have = loadings.groupBy(*keys).agg(F.max("component").alias("k"))
    return union_all(
        [
            _schema_violations(loadings.sparkSession, state),
            violation(
                have.filter((F.col("k") < selected) | F.lit(selected < 1)),
                "component_unavailable",
                key_text(keys),
                F.format_string("component %d of %d", F.lit(selected), F.col("k")),
            ),
        ]
    )


def finite_violations(cells: DataFrame, keys: Sequence[str] = ("layer",)) -> DataFrame:
    """V6: null, NaN or infinite cells, counted per layer."""
    v = F.col("value")
    bad = F.count_if(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).alias("n")
    got = cells.groupBy(*keys).agg(bad).filter(F.col("n") > 0)
    return violation(got, "not_finite", key_text(keys), F.format_string("%d cells", F.col("n")))


# --- V7-V10: sample maps -------------------------------------------------------------


def sample_map_violations(cells: DataFrame, sample_map: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """V7: one-to-one per layer, every layer mapped, no dangling entries."""
    have = cells.select("layer", "sample_id").distinct()
    out = [
        violation(
            sample_map.groupBy("layer", c).agg(F.count("*").alias("n")).filter("n > 1"),
            f"map_duplicate_{c}",
            key_text(["layer", c]),
            F.format_string("%d rows", F.col("n")),
        )
        for c in ("primary_id", "sample_id")
    ]
    layers = have.select("layer").distinct().join(sample_map.select("layer").distinct(), "layer", "left_anti")
    out.append(violation(layers, "layer_unmapped", "layer", "no sample-map rows"))
    dangling = sample_map.join(have, ["layer", "sample_id"], "left_anti")
    out.append(violation(dangling, "map_absent_sample", key_text(["layer", "sample_id"]), "no such measured sample"))
    if samples is not None:
        orphan = sample_map.join(samples.select("primary_id"), "primary_id", "left_anti")
        out.append(violation(orphan, "map_absent_primary", key_text(["layer", "primary_id"]), "no such sample"))
    return union_all(out)


def complete_cohort(sample_map: DataFrame, n_layers: int | None = None, cohort: Sequence[str] = ()) -> DataFrame:
    """V8: primary samples measured in every layer."""
    keys = [*cohort, "primary_id"]
    per = sample_map.select(*keys, "layer").distinct().groupBy(*keys).agg(F.count("*").alias("_l"))
    if n_layers is not None:
        return per.filter(F.col("_l") == n_layers).select(*keys)
    total = sample_map.agg(F.count_distinct("layer").alias("l"))
    return per.filter(F.col("_l") == total.scalar()).select(*keys)


def cohort_size_violations(cohort: DataFrame, minimum: int = 12) -> DataFrame:
    """V8: fewer complete paired samples than allowed."""
    return failed_checks(
        cohort.agg(F.count("*").alias("n")),
        _no_key(),
        {"too_few_complete": (F.col("n") < minimum, F.format_string("%d of %d", F.col("n"), F.lit(minimum)))},
    )


def exclusions(samples: DataFrame, cohort: DataFrame) -> DataFrame:
    """V9: samples left out of the complete cohort."""
    return samples.select("primary_id").join(cohort, "primary_id", "left_anti")


def alignment(cells: DataFrame, sample_map: DataFrame, samples: DataFrame) -> DataFrame:
    """Every measured sample with its primary id and a reason when it fails.

    Reasons, in order: missing_mapping, ambiguous_mapping, duplicate_primary,
    missing_primary. All three inputs are reduced to one row per key first.
    """
    have = cells.select("layer", "sample_id").distinct()
    mapped = sample_map.groupBy("layer", "sample_id").agg(
        F.count("*").alias("_m"), F.min("primary_id").alias("primary_id")
    )
    prim = samples.groupBy("primary_id").agg(F.count("*").alias("_p"))
    joined = have.join(mapped, ["layer", "sample_id"], "left").join(prim, "primary_id", "left")
    reason = (
        F.when(F.col("_m").isNull(), "missing_mapping")
        .when(F.col("_m") > 1, "ambiguous_mapping")
        .when(F.col("_p") > 1, "duplicate_primary")
        .when(F.col("_p").isNull(), "missing_primary")
    )
    return joined.select("layer", "sample_id", "primary_id", reason.alias("reason"))


def alignment_violations(cells: DataFrame, sample_map: DataFrame, samples: DataFrame) -> DataFrame:
    bad = alignment(cells, sample_map, samples).filter(F.col("reason").isNotNull())
    return bad.select(
        F.col("reason").alias("check"), key_text(["layer", "sample_id"]).alias("key"),
        F.coalesce("primary_id", F.lit("NULL")).alias("detail"),
    )


def feature_identity_violations(new: DataFrame, known: DataFrame, keys: Sequence[str] = ("layer",)) -> DataFrame:
    """Duplicate, missing or extra feature ids against the known ones.

    ``new`` is one row per feature column of the data to project; repeated rows
    are duplicates.
    """
    keys = list(keys)
    got = new.groupBy(*keys, "feature_id").agg(F.count("*").alias("n"))
    want = known.select(*keys, "feature_id").distinct().withColumn("_w", F.lit(True))
    both = got.join(want, [*keys, "feature_id"], "full_outer")
    check = (
        F.when(F.col("n").isNull(), "missing_feature")
        .when(F.col("_w").isNull(), "extra_feature")
        .when(F.col("n") > 1, "duplicate_feature")
    )
    return both.select(
        check.alias("check"), key_text([*keys, "feature_id"]).alias("key"),
        F.coalesce(F.col("n"), F.lit(0)).cast("string").alias("detail"),
    ).filter(F.col("check").isNotNull())


# --- V12-V14, V19: benchmark tables ----------------------------------------------------

# The required columns of a benchmark table.
BENCH_COLUMNS = (
    "candidate", "seed", "split", "stratum_digest", "stratum", "protocol_id", "generator", "protocol_digest",
    "generator_digest", "tier", "gate_expected", "gate_observed", "gate_passed", "projection_case",
    "shared_signal", "noise_sd", "shared_recovery_error", "response_recovery_error", "exclusive_leakage",
    "projection_error", "elapsed_sec", "peak_vcells_bytes",
)


def bench_violations(rows: DataFrame, split: str | None = None, selected: str | None = None, tier: str | None = None) -> DataFrame:
    """Columns, single split, candidate, tier and identity, unique rows."""
    absent = missing_columns(rows, BENCH_COLUMNS, "bench_schema")
    if absent:
        return _schema_violations(rows.sparkSession, absent)
    identity = ["protocol_id", "generator", "protocol_digest", "generator_digest"]
    aggs = [
        (F.min(c).eqNullSafe(F.max(c)) & F.count_if(F.col(c).isNull()).isin(0, F.count("*"))).alias(f"one_{c}") for c in identity
    ]
    aggs += [
        F.count_if(~F.col("split").eqNullSafe(F.lit(split))).alias("other_split") if split else F.lit(0).alias("other_split"),
        F.count_if(~F.col("candidate").eqNullSafe(F.lit(selected))).alias("other_candidate")
        if selected
        else F.lit(0).alias("other_candidate"),
        F.count_if(~F.col("tier").eqNullSafe(F.lit(tier))).alias("other_tier") if tier else F.lit(0).alias("other_tier"),
        F.count_if(F.col("stratum_digest").isNull() | F.col("seed").isNull()).alias("null_key"),
    ]
    summary = rows.agg(*aggs)
    checks = {f"mixed_{c}": (~F.col(f"one_{c}"), "more than one value") for c in identity}
    checks |= {
        name: (F.col(name) > 0, F.format_string("%d rows", F.col(name).cast("bigint")))
        for name in ("other_split", "other_candidate", "other_tier", "null_key")
    }
    dup = rows.groupBy("candidate", "stratum_digest", "seed").agg(F.count("*").alias("n")).filter("n > 1")
    return union_all(
        [
            failed_checks(summary, _no_key(), checks),
            violation(
                dup, "duplicate_row", key_text(["candidate", "stratum_digest", "seed"]), F.format_string("%d rows", F.col("n"))
            ),
        ]
    )


def strata_outside_grid(rows: DataFrame, grid: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Strata that the frozen grid does not contain."""
    odd = rows.select(*fields).distinct().join(grid.select(*fields), list(fields), "left_anti")
    return violation(odd, "stratum_outside_grid", key_text(fields), "not in the frozen grid")


def coverage_violations(expected: DataFrame, rows: DataFrame, keys: Sequence[str], split: str | None = "split") -> DataFrame:
    """Every expected task exactly once, and its split as declared."""
    keys = list(keys)
    extra = [F.min(split).alias("_split")] if split else []
    got = rows.groupBy(*keys).agg(F.count("*").alias("n"), *extra)
    want = expected.select(*keys, *([F.col(split).alias("_want")] if split else [])).withColumn("_e", F.lit(True))
    both = got.join(want, keys, "full_outer")
    check = F.when(F.col("n").isNull(), "task_missing").when(F.col("_e").isNull(), "task_undeclared").when(
        F.col("n") > 1, "task_repeated"
    )
    if split:
        check = check.when(~F.col("_split").eqNullSafe(F.col("_want")), "task_wrong_split")
    return both.select(
        check.alias("check"), key_text(keys).alias("key"), F.coalesce("n", F.lit(0)).cast("string").alias("detail")
    ).filter(F.col("check").isNotNull())


def manifest_violations(manifest: DataFrame, frozen: DataFrame) -> DataFrame:
    """Rows by which a manifest table differs from the frozen protocol."""
    names = frozen.columns
    extra = manifest.select(*names).exceptAll(frozen)
    lost = frozen.exceptAll(manifest.select(*names))
    return union_all(
        [
            violation(extra, "manifest_extra", key_text(names), "not in the protocol"),
            violation(lost, "manifest_missing", key_text(names), "required by the protocol"),
        ]
    )


# --- V15, V17, V18, V20, V21 ----------------------------------------------------------


def version_violations(table: DataFrame, current: str, column: str = "schema_version") -> DataFrame:
    """Rows that carry another schema version."""
    if column not in table.columns:
        return _schema_violations(table.sparkSession, [("schema_version", column, "column not found")])
    other = table.groupBy(column).agg(F.count("*").alias("n")).filter(~F.col(column).eqNullSafe(F.lit(current)))
    return violation(other, "schema_version", F.col(column), F.format_string("%d rows", F.col("n")))


def _upgrade_path(steps: Mapping[str, tuple], start: str, current: str) -> list[str] | None:
    """Versions from ``start`` to the one before ``current``, or None when the chain ends elsewhere."""
    path: list[str] = []
    while start != current:
        if start not in steps or start in path:
            return None
        path.append(start)
        start = steps[start][0]
    return path


def upgrade_version(
    table: DataFrame, steps: Mapping[str, tuple[str, Mapping[str, object]]], current: str, column: str = "schema_version"
) -> DataFrame:
    """Apply declared one-version steps ``{from: (to, {new column: default})}`` along the chain to ``current``.

    New columns keep a value they already have, so an upgrade can be repeated. Rows from whose version no chain leads
    to ``current`` stay as they are; ``upgrade_violations`` reports them.
    """
    paths = {v: _upgrade_path(steps, v, current) for v in steps}
    order = sorted((v for v, path in paths.items() if path is not None), key=lambda v: -len(paths[v]))
    out = table
    version = F.col(column)
    for old in order:
        new, defaults = steps[old]
        for name, default in defaults.items():
            have = F.col(name) if name in out.columns else F.lit(None)
            out = out.withColumn(name, F.when(version == old, F.coalesce(have, F.lit(default))).otherwise(have))
        out = out.withColumn(column, F.when(version == old, F.lit(new)).otherwise(version))
    return out


def upgrade_violations(
    table: DataFrame, steps: Mapping[str, tuple[str, Mapping[str, object]]], current: str, column: str = "schema_version"
) -> DataFrame:
    """Versions in the table from which no chain of steps leads to ``current``."""
    good = [current, *(v for v in steps if _upgrade_path(steps, v, current) is not None)]
    other = table.groupBy(column).agg(F.count("*").alias("n")).filter(~F.coalesce(F.col(column).isin(good), F.lit(False)))
    return violation(other, "no_upgrade_path", F.col(column), F.format_string("%d rows", F.col("n")))


def with_digest(df: DataFrame, columns: Sequence[str], out: str = "digest") -> DataFrame:
    """Canonical digest column of a declaration or stratum."""
    return df.withColumn(out, canonical_digest(columns))


def shape_violations(
    loadings: DataFrame, scores: DataFrame, spectrum: DataFrame, keys: Sequence[str] = ("layer",)
) -> DataFrame:
    """Components are 1..k without gaps and agree between the tables."""
    keys = list(keys)

    def top(df: DataFrame, name: str) -> DataFrame:
        on = [k for k in keys if k in df.columns]
        per = df.groupBy(*on, "component").agg(F.count("*").alias("_n"))
        return per.groupBy(*on).agg(F.max("component").alias(name), F.count("*").alias(f"{name}_c"))

    both = top(spectrum, "ks")
    for df, name in ((scores, "kc"), (loadings, "kl")):
        on = [k for k in keys if k in df.columns]
        other = top(df, name)
        if on:
            both = both.join(other, on, "full_outer")
        else:
            both = both.withColumns({c: other.select(c).scalar() for c in (name, f"{name}_c")})
    names = ("ks", "kc", "kl")
    gaps = [(F.col(n) != F.col(f"{n}_c")) | F.col(n).isNull() | (F.col(n) < 1) for n in names]
    return failed_checks(
        both,
        key_text(keys),
        {
            "component_gap": (gaps[0] | gaps[1] | gaps[2], "components must be 1..k in every table"),
            "component_disagreement": (
                ~(F.col("ks").eqNullSafe(F.col("kc")) & F.col("ks").eqNullSafe(F.col("kl"))),
                F.concat_ws("/", *[F.col(n).cast("string") for n in names]),
            ),
        },
    )


def input_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Digest of a stage's input, independent of row order."""
    return content_digest(df, columns)


def provenance_step(
    digest: DataFrame, step: str, operator: str, params: Mapping[str, object]
) -> DataFrame:
    """One provenance row; it carries no wall-clock time."""
    pairs = [x for k in sorted(params) for x in (F.lit(k), F.lit(str(params[k])))]
    mapping = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return digest.select(
        F.lit(step).alias("step"), F.lit(operator).alias("operator"), mapping.alias("params"),
        F.col("digest").alias("input_digest"), F.col("n_rows").alias("input_rows"),
    )


def append_provenance(log: DataFrame | None, step: DataFrame) -> DataFrame:
    return step if log is None else log.unionByName(step)
