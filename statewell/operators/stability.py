"""Bootstrap of Stage 1 over biological units and the stability of its axes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewell.common import ContractError, materialise, small_side
from statewell.operators.evidence import MIX_A, MIX_B, MIX_C, MIX_P
from statewell.operators.linalg import MAX_SIDE

#: The Poisson(1) distribution function times the modulus of the draws.
POISSON = tuple(int(v) for v in np.floor(np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 11)])) * MIX_P))
#: Doubles of partial cross-products a task holds: replicates are cut into chunks that fit.
HELD_DOUBLES = 16_000_000
#: Doubles of one shuffled row of partial cross-products.
ROW_DOUBLES = 8_192


def unit_weights(mark: np.ndarray, reps: np.ndarray, seed: int) -> np.ndarray:
    """``(units, replicates)``: how often a unit is drawn, Poisson with mean one, from whole-number arithmetic SQL can repeat.

    ``x = (seed * A + mark + rep * C) % P``, three times ``x = (x * x + x * A + B) % P``; the weight counts the thresholds up to x.
    """
    x = (seed * MIX_A + mark[:, None] + reps[None, :] * MIX_C) % MIX_P
    for _ in range(3):
        x = (x * x % MIX_P + x * MIX_A + MIX_B) % MIX_P
    return np.searchsorted(np.array(POISSON), x.ravel(), side="right").reshape(x.shape)


def unit_mark(unit: Column) -> Column:
    """A number under the modulus for a unit: the first seven hex digits of its md5. All layers of a unit share it."""
    return F.conv(F.substring(F.md5(unit.cast("string")), 1, 7), 16, 10).cast("long")


def weight_column(mark: Column, rep: Column, seed: int) -> Column:
    """The weight of ``unit_weights`` as a column; replicate 0 weighs one."""
    x = (F.lit(seed * MIX_A).cast("long") + mark + rep.cast("long") * MIX_C) % MIX_P
    for _ in range(3):
        x = F.transform(F.array(x), lambda v: (v * v % MIX_P + v * MIX_A + MIX_B) % MIX_P)[0]
    drawn = F.size(F.filter(F.array(*[F.lit(v).cast("long") for v in POISSON]), lambda v: v <= x))
    return F.when(rep == 0, 1).otherwise(drawn)


# --- X6 ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class BootstrapSpectrum:
    """``spectrum(keys.., rep, component, sigma)``, ``loadings(keys.., rep, component, vec)``, ``totals(keys.., rep, weight, total)``."""

    spectrum: DataFrame
    loadings: DataFrame
    totals: DataFrame


def replicate_grams(rows: DataFrame, keys: Sequence[str], unit: str, vec: str, replicates: int, seed: int) -> DataFrame:
    """``(keys.., rep, block, gram)`` summed over all rows: weighted sums and cross-products of each replicate.

    One pass over the rows: a task adds the cross-products of its rows to one matrix per replicate, with the units' integer
    weights. The row's own entries are extended by a one, so that the sums needed for centring ride along. Units travel as
    weights only; nothing is resampled by copying. Replicate 0 has all weights one: the data themselves.
    """
    keys = list(keys)
    width = rows.select(F.max(F.size(vec))).first()[0]
    if not width or width < 1:
        width = 1
    if width > MAX_SIDE:
        raise ContractError(f"rows wider than {MAX_SIDE} are reduced to scores first")
    side = width + 1
    chunk = max(1, HELD_DOUBLES // (side * side))
    source = rows.select(*keys, unit_mark(F.col(unit)).alias("_m"), F.col(vec).cast("array<double>").alias("_v"))
    if replicates + 1 > chunk:  # wide rows: each chunk of replicates is a pass of its own over the rows
        source = source.withColumn("_first", F.explode(F.sequence(F.lit(0), F.lit(replicates), F.lit(chunk))))
    else:
        source = source.withColumn("_first", F.lit(0))
    n_keys = len(keys)
    span = max(1, ROW_DOUBLES // side)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (key, first), gram in held.items():
                for i, g in enumerate(gram):
                    for b, at in enumerate(range(0, side, span)):
                        piece = g[at:at + span].ravel()
                        yield pa.RecordBatch.from_arrays(
                            [*[pa.array([k], kind) for k, kind in zip(key, kinds)], pa.array([first + i], pa.int32()), pa.array([b], pa.int32()), pa.array([piece.tolist()])],
                            names=[*keys, "rep", "block", "gram"],
                        )

        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(n_keys)]
            frame = batch.select([*range(n_keys), n_keys, n_keys + 2]).to_pandas()
            lists = batch.column(n_keys + 1)
            if lists.null_count or any(n != width for n in pa.compute.list_value_length(lists).to_pylist()):
                raise ContractError("rows differ in length")
            x = np.column_stack([np.ones(len(frame)), lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)])
            for key, idx in frame.groupby([*keys, "_first"], sort=False, dropna=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                first = int(key[-1])
                name = (tuple(None if v is pd.NA or v != v else v for v in key[:-1]), first)
                reps = np.arange(first, min(first + chunk, replicates + 1))
                if name not in held:
                    if held and (sum(g.size for g in held.values()) + len(reps) * side * side) > HELD_DOUBLES:
                        yield from out()
                        held.clear()
                    held[name] = np.zeros((len(reps), side, side))
                gram = held[name]
                for at in range(0, len(idx), 4096):
                    part = idx[at:at + 4096]
                    xs = x[part]
                    w = unit_weights(frame["_m"].to_numpy()[part], reps, seed)
                    w[:, reps == 0] = 1
                    for r in range(len(reps)):
                        gram[r] += (xs * w[:, r:r + 1]).T @ xs
        yield from out()

    head = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    parts = source.mapInArrow(add, f"{head}rep int, block int, gram array<double>")
    return parts.groupBy(*keys, "rep", "block").agg(_array_sum("gram"))


def _array_sum(name: str) -> Column:
    """Element-wise sum of arrays as an aggregate: tasks have added their rows, so a group holds one short array per task."""
    add = lambda a, b: F.when(a.isNull(), b).otherwise(F.zip_with(a, b, lambda x, y: x + y))
    return F.reduce(F.collect_list(name), F.lit(None).cast("array<double>"), add).alias(name)


def bootstrap_spectrum(
    rows: DataFrame, keys: Sequence[str] = ("layer",), k: int = 6, replicates: int = 200, seed: int = 1, unit: str = "sample_id", vec: str = "vec",
    center: bool = True,
) -> BootstrapSpectrum:
    """Stage 1 on ``replicates`` resamples of whole units, in one pass; replicate 0 is the data themselves.

    Units are drawn with Poisson weights of mean one, fixed by seed, unit and replicate: layers of one unit are drawn
    together, whatever task or table they are in. Each replicate is centred on its own weighted means. At most ``k``
    components above the numerical rank are kept; a replicate whose weights are all zero gives none.
    """
    keys = list(keys)
    grams = replicate_grams(rows, keys, unit, vec, replicates, seed)
    head = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keys)
    packed = grams.groupBy(*keys, "rep").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "gram"))), lambda s: s["gram"])).alias("gram"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for i in range(table.num_rows):
                row = table.slice(i, 1)
                flat = row["gram"].combine_chunks().flatten().to_numpy()
                side = int(round(len(flat) ** 0.5))
                g = flat.reshape(side, side)
                weight = g[0, 0]
                own = g[1:, 1:] - (np.outer(g[0, 1:], g[0, 1:]) / weight if center and weight > 0 else 0.0)
                total = float(np.trace(own)) if weight > 0 else 0.0
                value, vector = np.linalg.eigh((own + own.T) / 2)
                value, vector = value[::-1], vector[:, ::-1]
                kept = int(min(k, (value > max(value[0], 0.0) * np.finfo(float).eps * len(value)).sum())) if weight > 0 else 0
                turn = np.sign(vector[np.abs(vector).argmax(0), np.arange(vector.shape[1])])
                vector = vector * np.where(turn == 0, 1, turn)
                axes = [vector[:, c].tolist() for c in range(kept)]
                yield pa.RecordBatch.from_arrays(
                    [*[row[c].combine_chunks() for c in keys], row["rep"].combine_chunks(), pa.array([float(weight)]), pa.array([total]),
                     pa.array([np.sqrt(value[:kept]).tolist()], pa.list_(pa.float64())), pa.array([axes], pa.list_(pa.list_(pa.float64())))],
                    names=[*keys, "rep", "weight", "total", "sigma", "axes"],
                )

    solved = materialise(packed.mapInArrow(solve, f"{head}rep int, weight double, total double, sigma array<double>, axes array<array<double>>"))
    one = solved.select(*keys, "rep", F.posexplode("sigma").alias("c", "sigma"))
    two = solved.select(*keys, "rep", F.posexplode("axes").alias("c", "vec"))
    number = (F.col("c") + 1).alias("component")
    return BootstrapSpectrum(
        one.select(*keys, "rep", number, "sigma"), two.select(*keys, "rep", number, "vec"), solved.select(*keys, "rep", "weight", "total")
    )


# --- X7 ---------------------------------------------------------------------------------


def best_matching(gain: np.ndarray) -> list[int]:
    """One-to-one assignment of rows to columns with the largest total gain (rows <= columns), by shortest augmenting paths."""
    rows, columns = gain.shape
    cost = gain.max(initial=0.0) - gain
    up, down = np.zeros(rows + 1), np.zeros(columns + 1)
    owner = np.zeros(columns + 1, int)  # row (from 1) that has a column, 0 for none
    for row in range(1, rows + 1):
        owner[0], at = row, 0
        least, came, done = np.full(columns + 1, np.inf), np.zeros(columns + 1, int), np.zeros(columns + 1, bool)
        while owner[at]:
            done[at] = True
            slack = cost[owner[at] - 1] - up[owner[at]] - down[1:]
            better = ~done[1:] & (slack < least[1:])
            least[1:][better], came[1:][better] = slack[better], at
            open_ = np.where(done[1:], np.inf, least[1:])
            step, nxt = open_.min(), int(open_.argmin()) + 1
            up[owner[done]] += step
            down[done] -= step
            least[~done] -= step
            at = nxt
        while at:
            owner[at] = owner[came[at]]
            at = came[at]
    out = [-1] * rows
    for column in range(1, columns + 1):
        if owner[column]:
            out[owner[column] - 1] = column - 1
    return out


def align_components(reference: DataFrame, replicates: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each replicate's axes matched one to one with the reference's: ``keys.., rep, component, matched, overlap, sign, subspace``.

    ``reference(keys.., component, vec)`` and ``replicates(keys.., rep, component, vec)`` hold the axes in one order of
    features. The matching maximises the sum of the absolute cosines. ``sign`` turns the matched axis to the reference's
    direction. ``subspace`` is the smallest cosine of the principal angles between the span of the reference axis with one
    neighbour and the span of the replicate's two best axes for it; the better neighbour counts. A reference component
    without a match (fewer axes in the replicate) has null in ``matched``, overlap 0.
    """
    keys = list(keys)
    # a replicate's axes are components x features, bounded like the reference's
    ref = reference.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("component", "vec"))).alias("_ref"))
    rep = replicates.groupBy(*keys, "rep").agg(F.array_sort(F.collect_list(F.struct("component", "vec"))).alias("_rep"))
    both = rep.join(small_side(materialise(ref)), keys) if keys else rep.withColumn("_ref", ref.scalar())
    head = "".join(f"`{c}` {reference.schema[c].dataType.simpleString()}, " for c in keys)

    def unit(rows) -> np.ndarray:
        v = np.array([r["vec"] for r in rows], float)
        size = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(size > 0, size, 1.0)

    def smallest_cosine(a: np.ndarray, b: np.ndarray) -> float:
        qa, qb = np.linalg.qr(a.T)[0], np.linalg.qr(b.T)[0]
        return float(np.linalg.svd(qa.T @ qb, compute_uv=False)[-1])

    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                a, b = unit(row["_ref"]), unit(row["_rep"])
                overlap = a @ b.T
                size = np.abs(overlap)
                wide = size if size.shape[1] >= size.shape[0] else np.pad(size, ((0, 0), (0, size.shape[0] - size.shape[1])))
                found = best_matching(wide)
                for i, j in enumerate(found):
                    near = [n for n in (i - 1, i + 1) if 0 <= n < len(a)]
                    span = None
                    for n in near:
                        if len(b) >= 2:
                            best = np.argsort(-(size[i] ** 2 + size[n] ** 2), kind="stable")[:2]
                            span = max(span or 0.0, smallest_cosine(a[[i, n]], b[best]))
                    there = j < len(b)
                    out.append([*[row[k] for k in keys], row["rep"], row["_ref"][i]["component"], row["_rep"][j]["component"] if there else None,
                                float(size[i, j]) if there else 0.0, int(np.sign(overlap[i, j])) if there else 0, span])
            made = pd.DataFrame(out, columns=[*keys, "rep", "component", "matched", "overlap", "sign", "subspace"])
            yield made.astype({"matched": "Int32", "sign": "int32", "component": "int32"})

    return both.mapInPandas(match, f"{head}rep int, component int, matched int, overlap double, sign int, subspace double")


def axis_stability(aligned: DataFrame, keys: Sequence[str] = (), overlap: float = 0.9, share: float = 0.8) -> DataFrame:
    """How often each reference axis recurs, from ``align_components``.

    Columns ``keys.., component, replicates, axis_share, index_share, orientation_share, subspace_share, mean_overlap, result``.
    An axis recurs where its match overlaps by ``overlap`` or more, wherever it stands; index and orientation are reported
    apart from it. ``result`` is ``stable_axis``, ``stable_subspace`` (the enclosing pair recurs, no single axis does: a
    proposal must abstain) or ``unstable``; at least ``share`` of the replicates must agree.
    """
    keys = list(keys)
    seen = aligned.groupBy(*keys, "component").agg(
        F.count("*").alias("replicates"), F.avg((F.col("overlap") >= overlap).cast("double")).alias("axis_share"),
        F.avg(F.coalesce(F.col("matched") == F.col("component"), F.lit(False)).cast("double")).alias("index_share"),
        F.avg((F.col("sign") > 0).cast("double")).alias("orientation_share"),
        F.avg(F.coalesce(F.col("subspace") >= overlap, F.lit(False)).cast("double")).alias("subspace_share"), F.avg("overlap").alias("mean_overlap"),
    )
    result = F.when(F.col("axis_share") >= share, "stable_axis").when(F.col("subspace_share") >= share, "stable_subspace").otherwise("unstable")
    return seen.withColumn("result", result)
