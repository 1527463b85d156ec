"""Repeated observations of subjects: trajectory divergence (X4) and mean squared displacement.

A subject is the unit of uncertainty. Its observations enter as sums that tasks form before anything is shuffled, so a
subject with a third of all rows is one partial sum per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewell.common import ContractError, failed_checks, key_text

DAY = 86_400.0


def days(time: Column) -> Column:
    """A timestamp as days, to the microsecond; one without zone is read in the session's."""
    return F.unix_micros(time.cast("timestamp")) / F.lit(DAY * 1e6)


def _usable(*names: str) -> Column:
    ok = F.lit(True)
    for n in names:
        ok = ok & F.col(n).isNotNull() & ~F.isnan(n)
    return ok


# --- X4 ---------------------------------------------------------------------------------


def subject_slopes(obs: DataFrame, keys: Sequence[str], subject: str, condition: str, time: str, value: str) -> DataFrame:
    """``(keys.., subject, condition, n, mean, stt, stx, slope)``: least squares of each subject from its sums, in one aggregation.

    ``stt`` and ``stx`` are centred sums, merged pairwise. Observations without condition, time or value are left out; a
    subject with a single time has no slope and adds nothing to those of its condition. A subject in two conditions is refused.
    """
    rows = obs.select(*keys, F.col(subject).alias("subject"), F.col(condition).cast("int").alias("condition"), F.col(time).cast("double").alias("t"),
                      F.col(value).cast("double").alias("x")).filter(_usable("t", "x") & F.col("condition").isNotNull() & F.col("subject").isNotNull())
    found = rows.groupBy(*keys, "subject").agg(
        F.min("condition").alias("condition"), F.max("condition").alias("_c"), F.count("*").alias("n"), F.avg("x").alias("mean"),
        F.regr_sxx("x", "t").alias("stt"), F.regr_sxy("x", "t").alias("stx"),
    )
    both = F.raise_error(F.lit("a subject belongs to two conditions")).cast("int")
    return found.select(
        *keys, "subject", F.when(F.col("condition") == F.col("_c"), F.col("condition")).otherwise(both).alias("condition"), "n", "mean", "stt", "stx",
        F.when(F.col("stt") > 0, F.try_divide("stx", "stt")).alias("slope"),
    )


def trajectory_divergence(
    obs: DataFrame, keys: Sequence[str] = (), subject: str = "subject", condition: str = "condition", time: str = "t", value: str = "x"
) -> DataFrame:
    """Condition by time interaction with subjects as fixed effects and clusters; ``condition`` is 0 or 1.

    Columns ``keys.., subjects_0, subjects_1, n, slope_0, slope_1, interaction, interaction_se, interaction_z, separation,
    separation_se, separation_z``. A condition's slope is the common within-subject slope; its variance sums the squared
    scores of the subjects, times G / (G - 1). ``separation`` is the difference of the mean of subject means. Null where a
    condition has fewer than two subjects, or no subject with two times.
    """
    keys = list(keys)
    per = subject_slopes(obs, keys, subject, condition, time, value)
    # sum of (stx - b stt)^2 from three sums, so one more aggregation does for all
    sums = []
    for c in (0, 1):
        mine = F.col("condition") == c
        moves = mine & (F.col("stt") > 0)
        for name, what in (("t", F.col("stt")), ("x", F.col("stx")), ("tt", F.col("stt") ** 2), ("tx", F.col("stt") * F.col("stx")), ("xx", F.col("stx") ** 2)):
            sums.append(F.sum(F.when(moves, what)).alias(f"_{name}{c}"))
        sums += [F.count_if(moves).alias(f"_g{c}"), F.count_if(mine).alias(f"subjects_{c}"), F.avg(F.when(mine, F.col("mean"))).alias(f"_m{c}"),
                 F.var_samp(F.when(mine, F.col("mean"))).alias(f"_v{c}")]
    found = per.groupBy(*keys).agg(*sums, F.sum("n").alias("n"))

    def slope(c: int) -> Column:
        return F.when(F.col(f"_t{c}") > 0, F.try_divide(f"_x{c}", f"_t{c}"))

    def variance(c: int) -> Column:
        b, g = slope(c), F.col(f"_g{c}")
        scores = F.col(f"_xx{c}") - 2 * b * F.col(f"_tx{c}") + b * b * F.col(f"_tt{c}")
        return F.when(g > 1, F.try_divide(F.greatest(scores, F.lit(0.0)) * g, F.col(f"_t{c}") ** 2 * (g - 1)))

    gap, se = slope(1) - slope(0), F.sqrt(variance(0) + variance(1))
    apart = F.col("_m1") - F.col("_m0")
    apart_se = F.sqrt(F.try_divide("_v0", "subjects_0") + F.try_divide("_v1", "subjects_1"))
    return found.select(
        *keys, "subjects_0", "subjects_1", "n", slope(0).alias("slope_0"), slope(1).alias("slope_1"), gap.alias("interaction"), se.alias("interaction_se"),
        F.when(se > 0, F.try_divide(gap, se)).alias("interaction_z"), apart.alias("separation"), apart_se.alias("separation_se"),
        F.when(apart_se > 0, F.try_divide(apart, apart_se)).alias("separation_z"),
    )


# --- X9 ---------------------------------------------------------------------------------


def displacements(
    obs: DataFrame, keys: Sequence[str], max_lag: float, width: float, subject: str = "subject", time: str = "t", value: str = "x"
) -> DataFrame:
    """``(keys.., subject, lag_class, pairs, squares)``: squared displacements of pairs of a subject's observations within ``max_lag``.

    Times are cut into buckets of ``max_lag``; an observation looks for later ones in its own bucket and the next, so the
    join is on subject and bucket and no subject meets itself whole. Pairs are summed where they are found. A lag of 0 does
    not count; class ``i`` holds lags in ``(i width, (i + 1) width]``.
    """
    if not 0 < width <= max_lag:
        raise ContractError("the width of a lag class must be positive and at most the largest lag")
    rows = obs.select(*keys, F.col(subject).alias("subject"), F.col(time).cast("double").alias("t"), F.col(value).cast("double").alias("x")).filter(
        _usable("t", "x") & F.col("subject").isNotNull()
    ).withColumn("b", F.floor(F.col("t") / max_lag))
    later = rows.select(*keys, "subject", F.col("t").alias("t2"), F.col("x").alias("x2"), F.explode(F.array(F.col("b"), F.col("b") - 1)).alias("b"))
    lag = F.col("t2") - F.col("t")
    found = rows.join(later, [*keys, "subject", "b"]).filter((lag > 0) & (lag <= max_lag))
    last = int(-(-max_lag // width)) - 1
    step = F.least(F.greatest(F.ceil(lag / width) - 1, F.lit(0)), F.lit(last)).cast("int")
    return found.groupBy(*keys, "subject", step.alias("lag_class")).agg(F.count("*").alias("pairs"), F.sum((F.col("x2") - F.col("x")) ** 2).alias("squares"))


def mean_squared_displacement(
    obs: DataFrame, keys: Sequence[str] = (), max_lag: float = 1.0, width: float = 0.25, subject: str = "subject", time: str = "t", value: str = "x",
    z: float = 1.959964,
) -> DataFrame:
    """``(keys.., lag_class, lag_from, lag_to, subjects, pairs, msd, se, low, high)`` for irregular times.

    ``msd`` is the mean over all pairs of a class; its standard error is that of a ratio over subjects, the independent
    units, times G / (G - 1). Null with a single subject. ``low`` does not go under 0.
    """
    keys = list(keys)
    per = displacements(obs, keys, max_lag, width, subject, time, value)
    found = per.groupBy(*keys, "lag_class").agg(
        F.count("*").alias("subjects"), F.sum("pairs").alias("pairs"), F.sum("squares").alias("_s"), F.sum(F.col("squares") ** 2).alias("_ss"),
        F.sum(F.col("squares") * F.col("pairs")).alias("_sm"), F.sum(F.col("pairs").cast("double") ** 2).alias("_mm"),
    )
    msd, g = F.col("_s") / F.col("pairs"), F.col("subjects")
    scatter = F.greatest(F.col("_ss") - 2 * msd * F.col("_sm") + msd * msd * F.col("_mm"), F.lit(0.0))
    se = F.when(g > 1, F.sqrt(F.try_divide(scatter * g, g - 1)) / F.col("pairs"))
    return found.select(
        *keys, "lag_class", (F.col("lag_class") * width).alias("lag_from"), F.least((F.col("lag_class") + 1) * F.lit(width), F.lit(float(max_lag))).alias("lag_to"),
        "subjects", "pairs", msd.alias("msd"), se.alias("se"), F.greatest(msd - z * se, F.lit(0.0)).alias("low"), (msd + z * se).alias("high"),
    )


def diffusion(msd: DataFrame, keys: Sequence[str] = (), z: float = 1.959964) -> DataFrame:
    """``(keys.., classes, diffusion, se, chi2, adequate)``: the constant diffusion coefficient that the displacements support.

    ``msd = 2 D lag`` is fitted through the middles of the lag classes by least squares with weights 1 / se^2. ``adequate``
    says whether the classes scatter around the line no more than chance (chi2 within ``z`` standard deviations of its
    degrees of freedom); an inadequate line is reported, not replaced.
    """
    keys = list(keys)
    rows = msd.filter(F.col("se") > 0).withColumns({"_l": F.col("lag_from") + F.col("lag_to"), "_w": 1 / F.col("se") ** 2})
    line = rows.groupBy(*keys).agg(
        F.count("*").alias("classes"), F.sum(F.expr("_w * _l * msd")).alias("_a"), F.sum(F.expr("_w * _l * _l")).alias("_b"), F.sum(F.expr("_w * msd * msd")).alias("_c")
    )
    d, free = F.col("_a") / F.col("_b"), F.col("classes") - 1
    chi2 = F.greatest(F.col("_c") - d * F.col("_a"), F.lit(0.0))
    return line.select(
        *keys, "classes", d.alias("diffusion"), (1 / F.sqrt("_b")).alias("se"), chi2.alias("chi2"),
        F.when(free > 0, chi2 <= free + z * F.sqrt(2 * free)).alias("adequate"),
    )


def sparse_subjects(obs: DataFrame, keys: Sequence[str], least: int, subject: str = "subject", time: str = "t") -> DataFrame:
    """Violations: subjects with fewer than ``least`` different times, which say nothing about change."""
    seen = obs.groupBy(*keys, subject).agg(F.countDistinct(time).alias("n"))
    return failed_checks(seen, key_text([*keys, subject]), {"too_few_times": (F.col("n") < least, F.format_string("%d times", F.col("n")))})
