"""Evidence tables: grids, stratified means, bootstrap, decision rules."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statewell.common import ContractError, enforce, failed_checks, key_text, materialise, union_all, violation
from statewell.functions.digests import canonical_digest
from statewell.operators.contracts import BENCH_COLUMNS, bench_violations, coverage_violations
from statewell.operators.quantiles import grouped_quantiles
from statewell.operators.ranking import grouped_row_number

#: Values of a block of a resampled group; every group is cut into such blocks.
BLOCK = 50_000
#: Values of a group that may be drawn by ``mix``, which needs the group in one row.
MIX_LIMIT = 1_000_000
#: Bootstrap replicates computed per task row; every such row carries its group's values.
REP_CHUNK = 500
#: Draws computed at once, and draws of which a task holds the values at once.
MIX_SLAB, MIX_HELD = 16_384, 131_072

# The metrics of the evidence table.
METRICS = (
    "shared_recovery_error", "response_recovery_error", "exclusive_leakage", "projection_error", "elapsed_sec",
    "peak_vcells_bytes",
)


@dataclass(frozen=True)
class Rules:
    """Thresholds of the selection and acceptance rules."""

    # Protocol thresholds.
    resamples: int = 10_000
    bootstrap_seed: int = 11001
    report_seed_start: int = 11002
    shared_advantage: float = -0.03
    maximum_disadvantage: float = 0.02
    maximum_elapsed_ratio: float = 1.5
    accept_signal: float = 24.0
    accept_noise: float = 1.0
    limits: Mapping[str, float] = field(
        default_factory=lambda: {"shared_recovery_error": 0.25, "projection_error": 0.30}
    )
    draws: str = "philox"


# The protocol grid, in declared order, and the seed ranges.
PROTOCOL_GRID = {
    "n": [20, 60],
    "K": [2, 3],
    "shared_signal": [12.0, 24.0],
    "exclusive_signal": [0.0, 12.0],
    "confounder_signal": [0.0, 12.0],
    "noise_sd": [1.0, 2.0],
    "missing_block_rate": [0.0, 0.2],
    "sample_order": ["canonical", "permuted"],
    "feature_order": ["canonical", "permuted"],
    "projection_case": ["exact_ids", "missing_id"],
}
PROTOCOL_SEEDS = {"calibration": range(1001, 1021), "holdout": range(1021, 1041)}


# --- B1-B3: grids, tasks, splits -------------------------------------------------


def grid_strata(spark: SparkSession, grid: Mapping[str, Sequence]) -> DataFrame:
    """B1: every combination of the listed values, with its lexicographic index."""
    one = spark.range(1).select(*[F.array_sort(F.array(*[F.lit(v) for v in vs])).alias(f) for f, vs in grid.items()])
    return _expand_grid(one, list(grid))


def grid_from_table(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """B1: every combination of the values observed per field, nulls apart.

    The distinct values are reduced in the tasks; nothing passes the driver.
    """
    return _expand_grid(df.agg(*[F.array_sort(F.collect_set(f)).alias(f) for f in fields]), list(fields))


def _expand_grid(one: DataFrame, fields: list[str]) -> DataFrame:
    index = F.lit(0).cast("long")
    out = one.withColumns({f"_n_{f}": F.size(f) for f in fields})
    for f in fields:
        out = out.select(*[c for c in out.columns if c != f], F.posexplode(f).alias(f"_i_{f}", f))
        index = index * F.col(f"_n_{f}") + F.col(f"_i_{f}")
    return out.select(*fields, (index + 1).alias("canonical_index"))


def task_table(strata: DataFrame, seeds: DataFrame, fields: Sequence[str], buckets: int = 32) -> DataFrame:
    """B2: one task per stratum and seed, with a digest key.

    Strata are dealt into buckets and every seed meets every bucket in an
    ordinary join, so neither side travels whole.
    """
    dealt = strata.select("canonical_index", *fields, F.pmod("canonical_index", F.lit(buckets)).cast("int").alias("_b"))
    spread = seeds.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))).join(dealt, "_b")
    tasks = spread.select(*seeds.columns, "canonical_index", *fields)
    return tasks.withColumn("task_key", canonical_digest([*fields, "seed"]))


def seed_split(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """Attach the declared split of every seed; undeclared seeds get null."""
    return rows.join(seeds.select("seed", "split"), "seed", "left")


def protocol_seeds(spark: SparkSession, ranges: Mapping[str, range] | None = None) -> DataFrame:
    parts = [
        spark.range(r.start, r.stop).select(F.col("id").cast("int").alias("seed"), F.lit(name).alias("split"))
        for name, r in (ranges or PROTOCOL_SEEDS).items()
    ]
    return union_all(parts)


# --- B4-B7: eligibility and stratified means ----------------------------------------


def _gate_as_expected():
    both = (F.col("gate_expected") == "success") & (F.col("gate_observed") == "success")
    neither = (F.col("gate_expected") == "typed_failure") & (F.col("gate_observed") == "typed_failure")
    return both | neither


def eligibility(rows: DataFrame) -> DataFrame:
    """Candidates all of whose gates passed as expected (and that have rows)."""
    ok = F.coalesce(F.col("gate_passed") & _gate_as_expected(), F.lit(False))
    return rows.groupBy("candidate").agg(F.bool_and(ok).alias("eligible"), F.count("*").alias("n_rows"))


def exact_rows(rows: DataFrame, case: str = "exact_ids") -> DataFrame:
    """Rows of the exact-ID projection case."""
    return rows.filter(F.col("projection_case") == case)


def metric_violations(rows: DataFrame, metrics: Sequence[str] = METRICS[:5]) -> DataFrame:
    """Exact rows with null, NaN or infinite metrics."""
    long = rows.select(
        key_text(["candidate", "stratum_digest", "seed"]).alias("_k"),
        F.inline(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("v")) for m in metrics])),
    )
    bad = long.filter(F.col("v").isNull() | F.isnan("v") | (F.abs("v") == float("inf")))
    return violation(bad, "metric_not_finite", F.col("_k"), F.col("m"))


def stratum_means(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean over strata of the stratum means, per candidate."""
    per = rows.groupBy("candidate", "stratum_digest").agg(*[F.avg(m).alias(m) for m in metrics])
    return per.groupBy("candidate").agg(*[F.avg(m).alias(m) for m in metrics])


def paired_differences(rows: DataFrame, metric: str, first: str, second: str) -> DataFrame:
    """``first - second`` per stratum and seed, in one aggregation.

    Unpaired rows keep a null difference; ``unpaired_violations`` reports them.
    """
    a, b = F.col("candidate") == first, F.col("candidate") == second
    return rows.filter(a | b).groupBy("stratum_digest", "seed").agg(
        F.count_if(a).alias("n_first"), F.count_if(b).alias("n_second"),
        (F.max(F.when(a, F.col(metric))) - F.max(F.when(b, F.col(metric)))).alias("difference"),
    )


def unpaired_violations(pairs: DataFrame) -> DataFrame:
    bad = pairs.filter((F.col("n_first") != 1) | (F.col("n_second") != 1))
    return violation(
        bad, "unpaired", key_text(["stratum_digest", "seed"]),
        F.concat_ws("/", F.col("n_first").cast("string"), F.col("n_second").cast("string")),
    )


# --- B8, B12: bootstrap ---------------------------------------------------------------


def _key_mark(key: Sequence) -> int:
    """A number for a group: the first eight hex digits of its text's md5."""
    return int(hashlib.md5("|".join(str(k) for k in key).encode()).hexdigest()[:8], 16)


# The modulus and factors of ``mix``.
MIX_P, MIX_A, MIX_B, MIX_C = 2_147_483_647, 48_271, 104_729, 69_621


@lru_cache(maxsize=2)
def _mix_steps(n: int) -> np.ndarray:
    return np.arange(n, dtype=np.uint64) * np.uint64(MIX_B) % np.uint64(MIX_P)


def _mix_slabs(seed: int, mark: int, n: int, reps: range) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """The draws of ``mix_indexes`` as slabs, each with its replicates and draws and valid until the next one.

    P is ``2^31 - 1``, so a number is congruent to its low 31 bits plus the rest. With ``h = A / 2`` a step is
    ``(x + h)^2 + B - h^2``; what is squared lies between ``-1.5 * 2^31`` and ``1.5 * 2^31``, so that no square leaves 64 bits
    and only the last sum is brought below P. ``x % n`` takes the quotient from a product with ``2^k / n`` rounded up,
    exact below ``2^31``. A slab stays in a core's cache from step to step.
    """
    half = MIX_A * pow(2, -1, MIX_P) % MIX_P
    shift = (MIX_B - half * half) % MIX_P
    starts = np.array([(seed * MIX_A + mark % MIX_P + rep * MIX_C + half) % MIX_P - MIX_P for rep in reps], np.int64).view(np.uint64)[:, None]
    # congruent to shift + half, and nearest to the middle of what it is added to, taken away
    middle = (shift + half + MIX_P + (1 << 30)) % MIX_P - (1 << 30) - MIX_P
    steps, bits = _mix_steps(n), 31 + (n - 1).bit_length()
    p, c, low, size, k, inverse = (np.uint64(v) for v in (MIX_P, shift, 31, n, bits, (1 << bits) // n + 1))
    middle = np.int64(middle).view(np.uint64)
    wide, tall = min(n, MIX_SLAB), max(1, MIX_SLAB // n)
    both = np.empty((2, tall * wide), np.uint64)

    def fold(x: np.ndarray, y: np.ndarray) -> None:
        np.right_shift(x, low, out=y)
        x &= p
        x += y

    for i in range(0, len(starts), tall):
        for j in range(0, n, wide):
            rows, draws = slice(i, min(i + tall, len(starts))), slice(j, min(j + wide, n))
            shape = rows.stop - i, draws.stop - j
            x, y = both[:, : shape[0] * shape[1]]
            np.add(starts[rows], steps[draws], out=x.reshape(shape))
            x *= x
            fold(x, y)
            x += middle
            x *= x
            fold(x, y)
            x += c
            fold(x, y)
            # below P the difference wraps around to a larger number
            np.minimum(x, np.subtract(x, p, out=y), out=x)
            np.multiply(x, inverse, out=y)
            y >>= k
            y *= size
            x -= y
            yield rows, draws, x.reshape(shape).view(np.int64)


def mix_indexes(seed: int, mark: int, n: int, reps: range) -> np.ndarray:
    """Draws ``(replicates, n)`` in whole-number arithmetic that any SQL engine can repeat.

    ``x = (seed * A + mark % P + rep * C + d * B) % P``, twice ``x = (x * x + x * A + B) % P``, then ``x % n``.
    """
    out = np.empty((len(reps), n), np.int64)
    for rows, draws, at in _mix_slabs(seed, mark, n, reps):
        out[rows, draws] = at
    return out


def mix_means(v: np.ndarray, seed: int, mark: int, reps: range) -> np.ndarray:
    """Mean of every replicate's draws of ``v``."""
    step = max(1, MIX_HELD // len(v))
    return np.concatenate([v[mix_indexes(seed, mark, len(v), reps[i : i + step])].mean(axis=1) for i in range(0, len(reps), step)])


def mix_medians(v: np.ndarray, seed: int, mark: int, reps: range) -> np.ndarray:
    """Median of every replicate's draws of ``v``.

    Draws are compared as ranks of their values. A resample's median lies within 4 sqrt(n) ranks of the middle in all but
    about one of 10^15 cases, so only the draws there are ordered; replicates of which that is not true are ordered whole.
    """
    n = len(v)
    order = np.argsort(v, kind="stable")
    rank = np.empty(n, np.int32)
    rank[order] = np.arange(n, dtype=np.int32)
    ordered, lower, upper = v[order], (n - 1) // 2, n // 2
    reach = 4 * math.isqrt(n) + 4
    lo, span = max(0, lower - reach), 2 * reach + 1
    step, out = max(1, MIX_HELD // n), np.empty(len(reps))
    held = np.empty((step, n), np.int32)
    for i in range(0, len(reps), step):
        drawn = held[: len(reps[i : i + step])]
        for rows, draws, at in _mix_slabs(seed, mark, n, reps[i : i + step]):
            drawn[rows, draws] = rank[at]
        below = np.count_nonzero(drawn < lo, axis=1)
        drawn -= np.int32(lo)
        # ranks before the bracket wrap around and lie beyond it
        at = np.flatnonzero(drawn.view(np.uint32).ravel() < span)
        row = at // n
        among = np.bincount(row, minlength=len(drawn))
        inside = np.sort(row * span + drawn.ravel()[at]) % span
        first = np.cumsum(among) - among - below
        middle = np.empty((2, len(drawn)), np.int64)
        good = (below <= lower) & (upper < below + among)
        for m, place in enumerate((lower, upper)):
            middle[m, good] = inside[first[good] + place]
        for r in np.flatnonzero(~good):
            middle[:, r] = np.partition(drawn[r], (lower, upper))[[lower, upper]]
        out[i : i + step] = np.mean(ordered[middle + lo], axis=0)
    return out


def _packed(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every group as one array row, for ``mix``; larger groups are refused by name of the other draws."""
    sizes = values.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > MIX_LIMIT)
    if not sizes.isEmpty():
        raise ContractError(f"mix draws take groups of at most {MIX_LIMIT} values; use philox")
    return values.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seed", "value"))), lambda s: s["value"]).alias("_v")
    )


def _mix_resample(values: DataFrame, keys: list[str], resamples: int, seed: int | str, statistic: str) -> DataFrame:
    """Statistic of every resample of every group: ``keys.., rep, statistic``."""
    by = [*keys, seed] if isinstance(seed, str) else keys
    fixed = F.col(seed) if isinstance(seed, str) else F.lit(seed)
    chunks = F.explode(F.sequence(F.lit(0), F.lit((resamples - 1) // REP_CHUNK)))
    work = _packed(values, by).select(*keys, fixed.cast("bigint").alias("_seed"), "_v").withColumn("_chunk", chunks)
    # rows are few and long: more partitions than cores, so that cores that are done take more
    work = work.repartition(4 * values.sparkSession.sparkContext.defaultParallelism, *keys, "_chunk")
    schema = T.StructType(
        [work.schema[k] for k in keys]
        + [T.StructField("rep", T.IntegerType()), T.StructField(statistic, T.DoubleType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        take = mix_means if statistic == "mean" else mix_medians
        for pdf in batches:
            for row in pdf.to_dict("records"):
                v, mark = np.asarray(row["_v"], dtype="float64"), _key_mark([row[k] for k in keys])
                first = int(row["_chunk"]) * REP_CHUNK
                reps = range(first, min(first + REP_CHUNK, resamples))
                out = pd.DataFrame({"rep": list(reps), statistic: take(v, int(row["_seed"]), mark, reps)})
                for i, k in enumerate(keys):
                    out.insert(i, k, row[k])
                yield out

    return work.mapInPandas(run, schema)


def bootstrap_means(
    values: DataFrame, keys: Sequence[str], resamples: int, seed: int, draws: str = "philox", block: int = BLOCK
) -> DataFrame:
    """Means of ``resamples`` resamples with replacement of every group.

    ``values(keys.., seed, value)``, one row per seed. ``philox`` cuts every
    group, whatever its size, into blocks: how many draws of a replicate fall
    into each block is multinomial, drawn down a tree by each block for itself;
    the block then draws its share on its own. ``mix`` can be repeated in SQL.
    """
    keys = list(keys)
    if draws == "mix":
        return _mix_resample(values, keys, resamples, seed, "mean")
    if draws != "philox":
        raise ContractError(f"unknown draws {draws}")
    sizes = values.groupBy(*keys).agg(F.count("*").alias("_n"))
    cut = values.join(sizes, keys).withColumn("_block", F.pmod(F.xxhash64("seed"), F.ceil(F.col("_n") / block)).cast("int"))
    blocks = materialise(cut.groupBy(*keys, "_block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seed", "value"))), lambda s: s["value"]).alias("_v"), F.max("_n").alias("_total")
    ))
    paths = _paths(blocks.select(*keys, "_block", F.size("_v").alias("_size")), keys)
    work = blocks.join(paths, [*keys, "_block"])
    schema = T.StructType(
        [work.schema[k] for k in keys]
        + [T.StructField("rep", T.IntegerType()), T.StructField("s", T.DoubleType()), T.StructField("n", T.LongType())]
    )

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                v, mark = np.asarray(row["_v"]), _key_mark([row[k] for k in keys])
                shares = block_shares(int(row["_total"]), row["_path"], resamples, seed, mark)
                stream = np.random.SeedSequence([seed, mark, int(row["_block"])])
                rng = np.random.Generator(np.random.Philox(stream))
                sums = [float(v[rng.integers(0, len(v), share)].sum()) for share in shares.tolist()]
                out = pd.DataFrame({"rep": np.arange(len(sums), dtype="int32"), "s": sums, "n": int(row["_total"])})
                for i, k in enumerate(keys):
                    out.insert(i, k, row[k])
                yield out

    parts = work.select(*keys, "_block", "_v", "_path", "_total").mapInPandas(draw, schema)
    return parts.groupBy(*keys, "rep").agg((F.sum("s") / F.max("n")).alias("mean"))


def _paths(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys.., _block, _path)``: from the root of a binary tree over the blocks to each block, what lies left and right.

    One short row per block and level; nothing of a group comes together in one row.
    """
    deep = sizes.groupBy(*keys).agg(F.length(F.bin(F.max("_block"))).alias("_depth"))
    steps = sizes.join(deep, keys).withColumn("_level", F.explode(F.sequence(F.lit(1), F.col("_depth"))))
    node = F.expr("shiftright(_block, _depth - _level)")
    steps = steps.withColumns({"_node": F.expr("shiftright(_block, _depth - _level + 1)"), "_right": node % 2 == 1})
    held = steps.groupBy(*keys, "_level", "_node").agg(
        F.sum(F.when(F.col("_right"), 0).otherwise(F.col("_size"))).alias("_lo"), F.sum(F.when(F.col("_right"), F.col("_size")).otherwise(0)).alias("_hi")
    )
    return steps.drop("_size", "_depth").join(held, [*keys, "_level", "_node"]).groupBy(*keys, "_block").agg(
        F.array_sort(F.collect_list(F.struct("_level", "_node", "_right", "_lo", "_hi"))).alias("_path")
    )


def block_shares(total: int, path: Sequence, resamples: int, seed: int, mark: int) -> np.ndarray:
    """Draws of every replicate that fall into one block: a binomial at each fork on the way to it.

    A fork's draws depend on seed, group and fork alone, so all blocks below it see the same ones and their shares add up.
    """
    share = np.full(resamples, total)
    for step in path:
        rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, mark, 1, int(step["_level"]), int(step["_node"])])))
        left = rng.binomial(share, int(step["_lo"]) / (int(step["_lo"]) + int(step["_hi"])))
        share = share - left if step["_right"] else left
    return share


def bootstrap_medians(
    values: DataFrame, keys: Sequence[str], resamples: int, seed_column: str, draws: str = "philox"
) -> DataFrame:
    """Medians of ``resamples`` resamples of every group; the seed is a column.

    A resample's median needs only the ranks of its middle draws. These are
    order statistics of uniform draws and are drawn directly, whatever the
    group's size; the values at the drawn ranks are looked up in the
    distributed ordering. ``mix`` draws every value and can be repeated in SQL.
    """
    keys = list(keys)
    if draws == "mix":
        return _mix_resample(values, keys, resamples, seed_column, "median")
    if draws != "philox":
        raise ContractError(f"unknown draws {draws}")
    sizes = values.groupBy(*keys).agg(F.count("*").alias("_n"))
    return _rank_medians(values.join(sizes, keys), keys, resamples, seed_column)


def _rank_medians(sized: DataFrame, keys: list[str], resamples: int, seed_column: str) -> DataFrame:
    # equal values are told apart by seed, so that no repeated value lands in one task
    ordered = grouped_row_number(sized.select(*keys, seed_column, "seed", "_n", "value"), keys, ["value", "seed"], "_rank")
    groups = ordered.groupBy(*keys).agg(F.min(seed_column).alias("_seed"), F.max("_n").alias("_n"))
    schema = T.StructType(
        [groups.schema[k] for k in keys] + [T.StructField("rep", T.IntegerType()), T.StructField("_rank", T.LongType())]
    )

    def ranks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                n = int(row["_n"])
                mark = _key_mark([row[k] for k in keys])
                rng = np.random.default_rng([int(row["_seed"]), mark])
                k = (n + 1) // 2
                low = rng.beta(k, n - k + 1, resamples)
                high = low if n % 2 else low + (1 - low) * rng.beta(1, n - k, resamples)
                for u in (low, high):
                    out = pd.DataFrame({"rep": range(resamples), "_rank": np.clip(np.ceil(u * n), 1, n).astype("int64")})
                    for i, name in enumerate(keys):
                        out.insert(i, name, row[name])
                    yield out

    wanted = groups.mapInPandas(ranks, schema)
    return wanted.join(ordered.select(*keys, "_rank", "value"), [*keys, "_rank"]).groupBy(*keys, "rep").agg(
        F.avg("value").alias("median")
    )


def percentile_interval(estimates: DataFrame, keys: Sequence[str], column: str, probs=(0.025, 0.975)) -> DataFrame:
    """Type-7 percentile interval of bootstrap estimates (one row per replicate)."""
    q = estimates.groupBy(*keys).agg(F.percentile(column, list(probs)).alias("_q"))
    return q.select(*keys, F.col("_q")[0].alias("ci_lower"), F.col("_q")[1].alias("ci_upper"))


def paired_bootstrap_interval(pairs: DataFrame, resamples: int, seed: int, draws: str = "philox") -> DataFrame:
    """Interval of the equal-stratum mean of paired differences."""
    values = pairs.select("stratum_digest", "seed", F.col("difference").alias("value"))
    means = bootstrap_means(values, ["stratum_digest"], resamples, seed, draws)
    per_rep = means.groupBy("rep").agg(F.avg("mean").alias("estimate"))
    return percentile_interval(per_rep, [], "estimate")


# --- B9, B10: selection -----------------------------------------------------------------


def median_ratio(rows: DataFrame, column: str, first: str, second: str) -> DataFrame:
    """Ratio of two candidates' medians."""
    q = grouped_quantiles(rows, ["candidate"], column, [0.5])
    a = F.max(F.when(F.col("candidate") == first, F.col("q")))
    b = F.max(F.when(F.col("candidate") == second, F.col("q")))
    return q.agg((a / b).alias("ratio"))


def selection_violations(rows: DataFrame, first: str, second: str, split: str = "calibration", tier: str = "full") -> DataFrame:
    """What keeps rows from being selected on: split, tier, identity, candidates, pairs, values that are not finite."""
    exact = exact_rows(rows)
    named = rows.groupBy("candidate").agg(F.count("*").alias("n"))
    odd = named.filter(~F.coalesce(F.col("candidate").isin(first, second), F.lit(False)))
    here = rows.agg(*[F.count_if(F.col("candidate") == c).alias(f"c{i}") for i, c in enumerate((first, second))])
    absent = {f"candidate_missing_{i + 1}": (F.col(f"c{i}") == 0, c) for i, c in enumerate((first, second))}
    return union_all(
        [
            bench_violations(rows, split, None, tier),
            violation(odd, "other_candidate", "candidate", F.format_string("%d rows", F.col("n"))),
            failed_checks(here, F.lit(""), absent),
            metric_violations(exact, ["shared_recovery_error", "exclusive_leakage", "projection_error", "elapsed_sec"]),
            unpaired_violations(paired_differences(exact, "shared_recovery_error", first, second)),
        ]
    )


def select_candidate(
    rows: DataFrame, first: str, second: str, rules: Rules = Rules(), split: str = "calibration", tier: str = "full"
) -> DataFrame:
    """One row with the six conditions and the selected candidate.

    Rows that break the contract are refused, see ``selection_violations``.

    All six true selects ``first``; otherwise an eligible ``second`` is the
    fallback; otherwise nothing is selected. The rows are materialised once for
    the statistics that read them.
    """
    rows = materialise(rows.select(*[c for c in rows.columns if c in BENCH_COLUMNS]))
    enforce(selection_violations(rows, first, second, split, tier))
    exact = exact_rows(rows)
    metrics = ["shared_recovery_error", "exclusive_leakage", "projection_error"]
    means = stratum_means(exact, metrics)

    def gap(m: str):
        one = F.max(F.when(F.col("candidate") == first, F.col(m)))
        two = F.max(F.when(F.col("candidate") == second, F.col(m)))
        return (one - two).alias(m)

    gaps = means.agg(*[gap(m) for m in metrics])
    able = eligibility(rows).agg(
        F.coalesce(F.bool_or(F.when(F.col("candidate") == first, F.col("eligible"))), F.lit(False)).alias("e1"),
        F.coalesce(F.bool_or(F.when(F.col("candidate") == second, F.col("eligible"))), F.lit(False)).alias("e2"),
    )
    interval = paired_bootstrap_interval(
        paired_differences(exact, "shared_recovery_error", first, second), rules.resamples, rules.bootstrap_seed, rules.draws
    )
    ratio = median_ratio(exact, "elapsed_sec", first, second)
    joined = gaps.withColumns(
        {
            "_a": able.select(F.struct("e1", "e2")).scalar(),
            "_c": interval.select(F.struct("ci_lower", "ci_upper")).scalar(),
            "elapsed_ratio": ratio.scalar(),
        }
    )
    report = joined.select(
        F.col("_a.e1").alias("first_eligible"),
        F.col("_a.e2").alias("second_eligible"),
        F.col("shared_recovery_error").alias("shared_difference"),
        F.col("_c.ci_lower").alias("shared_ci_lower"),
        F.col("_c.ci_upper").alias("shared_ci_upper"),
        F.col("exclusive_leakage").alias("leakage_difference"),
        F.col("projection_error").alias("projection_difference"),
        "elapsed_ratio",
    ).withColumns(
        {
            "both_eligible": F.col("first_eligible") & F.col("second_eligible"),
            "shared_advantage": F.col("shared_difference") <= rules.shared_advantage,
            "shared_ci_below_zero": F.col("shared_ci_upper") < 0,
            "leakage_not_worse": F.col("leakage_difference") <= rules.maximum_disadvantage,
            "projection_not_worse": F.col("projection_difference") <= rules.maximum_disadvantage,
            "elapsed_within_limit": F.col("elapsed_ratio") <= rules.maximum_elapsed_ratio,
        }
    )
    # The names of the six conditions, and the words of the decision below.
    names = (
        "both_eligible", "shared_advantage", "shared_ci_below_zero", "leakage_not_worse", "projection_not_worse",
        "elapsed_within_limit",
    )
    every = F.lit(True)
    for c in names:
        every = every & F.coalesce(F.col(c), F.lit(False))
    chosen = F.when(every, first).when(F.col("second_eligible"), second)
    return report.withColumn("selected_candidate", chosen).withColumn(
        "decision", F.when(chosen.isNull(), "no_eligible_candidate").otherwise("selected")
    )


# --- B11-B14: holdout ---------------------------------------------------------------------

STRATUM = ("stratum_digest", "stratum", "projection_case", "shared_signal", "noise_sd")


def failed_gate_violations(rows: DataFrame) -> DataFrame:
    """Holdout rows whose gate failed or was not as expected."""
    ok = F.coalesce(F.col("gate_passed") & _gate_as_expected(), F.lit(False))
    return violation(rows.filter(~ok), "failed_gate", key_text(["candidate", "stratum_digest", "seed"]), F.col("gate_observed"))


def holdout_violations(
    rows: DataFrame, index: DataFrame, selected: str, metrics: Sequence[str] = METRICS, split: str = "holdout", tier: str = "full"
) -> DataFrame:
    """What keeps holdout rows from being summed up: split, candidate, tier, identity, gates, grid, values."""
    outside = rows.select("stratum_digest", "stratum").distinct().join(index.select("stratum_digest"), "stratum_digest", "left_anti")
    return union_all(
        [
            bench_violations(rows, split, selected, tier),
            failed_gate_violations(rows),
            violation(outside, "stratum_outside_grid", "stratum_digest", F.col("stratum")),
            metric_violations(exact_rows(rows), metrics),
        ]
    )


def _metric_values(rows: DataFrame, index: DataFrame, selected: str, rules: Rules, metrics: Sequence[str]) -> DataFrame:
    """Exact rows as one long table of metrics, with the bootstrap seed of each stratum; bad rows are refused."""
    enforce(holdout_violations(rows, index, selected, metrics))
    exact = exact_rows(rows).join(index.select("stratum_digest", "canonical_index"), "stratum_digest")
    return materialise(
        exact.select(
            *STRATUM, "seed", (F.col("canonical_index") + rules.report_seed_start).alias("boot_seed"),
            F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])),
        )
    )


def _medians(long: DataFrame) -> DataFrame:
    med = grouped_quantiles(long, [*STRATUM, "metric"], "value", [0.5])
    return med.select(*STRATUM, "metric", F.col("q").alias("estimate"), "n")


def _pass_rates(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("projection_case") == "missing_id").groupBy(*STRATUM).agg(
        F.avg((F.col("gate_observed") == "typed_failure").cast("double")).alias("estimate"), F.count("*").alias("n")
    ).select(*STRATUM, F.lit("typed_control_pass_rate").alias("metric"), "estimate", "n")


def holdout_estimates(
    rows: DataFrame, index: DataFrame, selected: str, rules: Rules = Rules(), metrics: Sequence[str] = METRICS
) -> DataFrame:
    """``holdout_summary`` without intervals, which the decisions (B13, B14) do not ask for; nothing is resampled."""
    return _medians(_metric_values(rows, index, selected, rules, metrics)).unionByName(_pass_rates(rows))


def holdout_summary(
    rows: DataFrame, index: DataFrame, selected: str, rules: Rules = Rules(), metrics: Sequence[str] = METRICS
) -> DataFrame:
    """Median and interval per stratum and metric, or the pass rate.

    Rows that break the contract are refused, see ``holdout_violations``; the checks read ``rows`` several times, so rows that
    cost work are materialised by the caller.

    ``index(stratum_digest, canonical_index)`` gives each stratum its bootstrap
    seed. All metrics travel in one long table and one pass per statistic.
    """
    long = _metric_values(rows, index, selected, rules, metrics)
    keys = ["stratum_digest", "metric"]
    boots = bootstrap_medians(long.select(*keys, "boot_seed", "seed", "value"), keys, rules.resamples, "boot_seed", rules.draws)
    interval = percentile_interval(boots, keys, "median")
    positive = _medians(long).join(interval, keys).select(*STRATUM, "metric", "estimate", "ci_lower", "ci_upper", "n")
    none = F.lit(None).cast("double")
    negative = _pass_rates(rows).select(*STRATUM, "metric", "estimate", none.alias("ci_lower"), none.alias("ci_upper"), "n")
    return positive.unionByName(negative)


def _required(summary: DataFrame, rules: Rules) -> DataFrame:
    return summary.filter(
        (F.col("projection_case") == "exact_ids") & (F.col("shared_signal") == rules.accept_signal)
        & (F.col("noise_sd") == rules.accept_noise) & F.col("metric").isin(list(rules.limits))
    )


def _limit(rules: Rules):
    out = F.lit(None).cast("double")
    for m, v in rules.limits.items():
        out = F.when(F.col("metric") == m, F.lit(v)).otherwise(out)
    return out


def accept_holdout(summary: DataFrame, rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Accepted when all gates passed and every required stratum is good."""
    per = _required(summary, rules).groupBy("stratum_digest").agg(
        F.count("*").alias("_n"), F.bool_and(F.col("estimate") <= _limit(rules)).alias("_ok")
    )
    ok = F.coalesce(F.col("gate_passed") & _gate_as_expected(), F.lit(False))
    gates = rows.agg(F.bool_and(ok)).scalar()
    return per.agg(
        F.count("*").alias("required_strata"),
        F.coalesce(F.bool_and(F.col("_n") == len(rules.limits)), F.lit(False)).alias("required_complete"),
        F.coalesce(F.bool_and("_ok"), F.lit(False)).alias("_ok"),
    ).select(
        "required_strata",
        "required_complete",
        gates.alias("all_gates_passed"),
        (F.col("required_complete") & F.col("_ok")).alias("thresholds_passed"),
    ).withColumn(
        "decision", F.when(F.col("all_gates_passed") & F.col("thresholds_passed"), "accepted").otherwise("failed")
    )


def worst_medians(summary: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Worst required median per metric against its limit."""
    return _required(summary, rules).groupBy("metric").agg(
        F.countDistinct("stratum_digest").alias("exact_id_strata"),
        F.max("estimate").alias("worst_median"),
        F.max(_limit(rules)).alias("threshold"),
        F.bool_and(F.col("estimate") <= _limit(rules)).alias("all_strata_pass"),
    )


# --- B15-B19: inventories -------------------------------------------------------------------


def parse_stratum(df: DataFrame, column: str = "stratum") -> DataFrame:
    """Layer count, missing-block flag and label out of a stratum text."""
    c = F.col(column)
    k = F.nullif(F.regexp_extract(c, r"K = ([0-9]+)", 1), F.lit("")).cast("int")
    label = F.format_string("signal %s / noise %s", F.col("shared_signal").cast("string"), F.col("noise_sd").cast("string"))
    emphasis = (
        F.when((F.col("shared_signal") == 24) & (F.col("noise_sd") == 1), "decisive")
        .when(F.col("shared_signal") == 24, "high signal, high noise")
        .when(F.col("noise_sd") == 1, "low signal, low noise")
        .otherwise("low signal, high noise")
    )
    return df.withColumns(
        {
            "K": k, "missing_block": c.rlike(r"missing_block_rate = 0\.[1-9]"), "signal_noise": label,
            "emphasis": emphasis,
        }
    )


def run_inventory(rows: DataFrame) -> DataFrame:
    """Distinct tasks, rows and failed gates."""
    per = rows.groupBy("stratum_digest", "seed").agg(
        F.count("*").alias("_n"), F.count_if(~F.col("gate_passed")).alias("_f")
    )
    return per.agg(
        F.count("*").alias("completed_tasks"), F.sum("_n").alias("result_rows"), F.sum("_f").alias("failed_gate_rows")
    )


def progress(tasks: DataFrame, log: DataFrame, elapsed_sec: float) -> DataFrame:
    """Completed, failed, total, proportion, rate and time left.

    ``elapsed_sec`` is given by the caller, so the table is reproducible.
    """
    if elapsed_sec < 0:
        raise ContractError("elapsed time cannot be negative")
    total = tasks.agg(F.count("*")).scalar()
    got = log.agg(
        F.count_if(F.col("status") == "complete").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed")
    ).withColumn("total", total)
    rate = F.lit(float(elapsed_sec))
    per_sec = F.when(rate > 0, F.col("completed") / rate).otherwise(F.lit(0.0))
    out = got.withColumn("proportion", F.col("completed") / F.col("total")).withColumn("rate_per_sec", per_sec)
    out = out.withColumn(
        "eta_sec", F.when(F.col("rate_per_sec") > 0, (F.col("total") - F.col("completed")) / F.col("rate_per_sec"))
    )
    return out.withColumn("eta_text", duration_text(F.col("eta_sec")))


def duration_text(seconds) -> F.Column:
    """``1h 02m 03s`` or ``2m 03s``; ``unknown`` when not finite."""
    s = F.greatest(F.lit(0), F.rint(seconds).cast("bigint"))
    h, m, r = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    text = F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, r)).otherwise(F.format_string("%dm %02ds", m, r))
    bad = seconds.isNull() | F.isnan(seconds) | (F.abs(seconds) == float("inf"))
    return F.when(bad, "unknown").otherwise(text)


def log_violations(tasks: DataFrame, log: DataFrame, key: str = "task_key") -> DataFrame:
    """Undeclared, repeated, failed or missing tasks in a task log."""
    failed = violation(log.filter(~F.col("status").eqNullSafe(F.lit("complete"))), "task_incomplete", F.col(key), F.col("status"))
    return coverage_violations(tasks, log, [key], split=None).unionByName(failed)
