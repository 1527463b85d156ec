"""Distributed kernels for matrices held as rows of a DataFrame.

A matrix is one row per record with an array column of bounded width. The
kernels read Arrow batches, keep one small partial per group and task, and let
Spark add the partials; nothing but ``m x m`` blocks is ever shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statewell.common import ContractError

#: Largest side of a matrix that is solved exactly in one task (128 MiB).
MAX_SIDE = 4096
#: Doubles per shuffled block row.
_BLOCK_DOUBLES = 65_536
#: Bytes of partial matrices a task may hold before it flushes them.
_FLUSH_BYTES = 256 << 20


def rows_from_cells(cells: DataFrame, keys: Sequence[str], row: str, column: str) -> DataFrame:
    """Long cells to one dense array per row, ordered by column id.

    ``ids_hash`` fingerprints the column ids, so that a later kernel can refuse
    rows that lack a cell. A row holds at most ``MAX_SIDE`` cells.
    """
    packed = cells.groupBy(*keys, row).agg(
        F.array_sort(F.collect_list(F.struct(F.col(column).alias("id"), F.col("value").alias("v")))).alias("_c")
    )
    return packed.select(
        *keys,
        row,
        F.col("_c.v").alias("vec"),
        F.xxhash64(F.col("_c.id")).alias("ids_hash"),
    )


def _slices(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their dense copies stay near 16 MiB."""
    for batch in batches:
        if batch.num_rows:
            width = max(1, len(batch.column(n_keys)[0]))
            step = max(1, 2_000_000 // width)
            for start in range(0, batch.num_rows, step):
                yield batch.slice(start, step)


def _list_matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False)
    return flat.reshape(len(column), -1)


def _group_codes(batch: pa.RecordBatch, n_keys: int) -> list[tuple[tuple, np.ndarray]]:
    if n_keys == 0:
        return [((), np.arange(batch.num_rows))]
    keys = batch.select(list(range(n_keys))).to_pandas()
    groups = keys.groupby(list(keys.columns), sort=False, dropna=False).indices
    return [(k if isinstance(k, tuple) else (k,), idx) for k, idx in groups.items()]


def _merge(state, n, mean, gram):
    """Pairwise update of count, mean and centred cross-products."""
    if state is None:
        return [n, mean, gram]
    n0, m0, g0 = state
    total = n0 + n
    d = mean - m0
    g0 += gram
    g0 += np.outer(d, d) * (n0 * n / total)
    state[0], state[1] = total, m0 + d * (n / total)
    return state


def _partial_schema(df: DataFrame, keys: Sequence[str]) -> T.StructType:
    fields = [df.schema[k] for k in keys]
    fields += [
        T.StructField("block", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("m", T.IntegerType()),
        T.StructField("ids_hash", T.LongType()),
        T.StructField("mean", T.ArrayType(T.DoubleType())),
        T.StructField("gram", T.ArrayType(T.DoubleType())),
    ]
    return T.StructType(fields)


def gram_tasks(rows: DataFrame, width: int | None) -> int | None:
    """Bound on the number of partial matrices, for matrices beyond 1 MiB.

    Every task emits one partial per group. For wide matrices a partial weighs
    as much as a small input split, so splits are read by a few tasks per core.
    """
    if width is None or width * width * 8 <= 1 << 20:
        return None
    return 4 * rows.sparkSession.sparkContext.defaultParallelism


def sum_lanes(rows: DataFrame) -> int:
    """Groups of tasks whose partial matrices are summed among themselves first, so that no task sums those of all tasks."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return math.isqrt(cores) if cores > 64 else 1


def gram_blocks(
    rows: DataFrame, keys: Sequence[str] = (), center: str = "none", vec: str = "vec", tasks: int | None = None, lanes: int | None = None
) -> DataFrame:
    """Cross-products ``sum(v v')`` of array rows, per group, in row blocks.

    ``center``: ``columns`` subtracts the group mean vector, merged pairwise so
    that one pass is both exact and free of cancellation; ``rows`` subtracts
    each array's own mean; ``none`` leaves values as they are. ``tasks`` bounds
    the number of partial matrices (see ``gram_tasks``). They are summed in two
    steps, over the tasks of a lane and over the ``lanes`` (see ``sum_lanes``).
    """
    if center not in ("columns", "rows", "none"):
        raise ContractError("center must be columns, rows or none")
    keys = list(keys)
    n_keys = len(keys)
    if "ids_hash" not in rows.columns:
        rows = rows.withColumn("ids_hash", F.lit(0).cast("long"))
    schema = _partial_schema(rows, keys)
    arrow_names = schema.fieldNames()

    def emit(states) -> Iterator[pa.RecordBatch]:
        for key, (ids_hash, (n, mean, gram)) in states.items():
            m = gram.shape[0]
            step = max(1, _BLOCK_DOUBLES // m)
            for block, start in enumerate(range(0, m, step)):
                part = gram[start : start + step].ravel()
                columns = [pa.array([k]) for k in key]
                columns += [
                    pa.array([block], pa.int32()),
                    pa.array([n], pa.int64()),
                    pa.array([m], pa.int32()),
                    pa.array([ids_hash], pa.int64()),
                    pa.array([mean], pa.list_(pa.float64())),
                    pa.array([part], pa.list_(pa.float64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=arrow_names)

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict = {}
        held = 0
        for batch in _slices(batches, n_keys):
            vectors, hashes = batch.column(n_keys), batch.column(n_keys + 1).to_numpy()
            for key, idx in _group_codes(batch, n_keys):
                x = _list_matrix(vectors.take(pa.array(idx)) if n_keys else vectors)
                m = x.shape[1]
                if m > MAX_SIDE:
                    raise ContractError(f"array width {m} exceeds {MAX_SIDE}")
                ids_hash = int(hashes[idx[0]])
                known = states.get(key)
                if (hashes[idx] != ids_hash).any() or (known and known[0] != ids_hash):
                    raise ContractError("rows of one matrix differ in their column ids (missing cells)")
                if not np.isfinite(x).all():
                    raise ContractError("matrix values must be finite")
                mean = np.zeros(m)
                if center == "columns":
                    mean = x.mean(axis=0)
                    x = x - mean
                elif center == "rows":
                    x = x - x.mean(axis=1, keepdims=True)
                if known is None:
                    held += m * m * 8
                states[key] = (ids_hash, _merge(known[1] if known else None, len(idx), mean, x.T @ x))
            if held > _FLUSH_BYTES:
                yield from emit(states)
                states, held = {}, 0
        yield from emit(states)

    narrow = rows.select(*keys, F.col(vec).cast("array<double>").alias("vec"), "ids_hash")
    partial = (narrow.coalesce(tasks) if tasks else narrow).mapInArrow(partials, schema)

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        first = None
        for batch in batches:
            first = first if first is not None else batch.slice(0, 1)
            names = batch.schema.names
            m = batch.column(names.index("m"))[0].as_py()
            block = batch.column(names.index("block"))[0].as_py()
            step = max(1, _BLOCK_DOUBLES // m)
            lo, hi = block * step, min(m, (block + 1) * step)
            ns = batch.column(names.index("n")).to_numpy()
            means = _list_matrix(batch.column(names.index("mean")))
            grams = _list_matrix(batch.column(names.index("gram")))
            hashes = batch.column(names.index("ids_hash")).to_numpy()
            for n, mean, gram, ids_hash in zip(ns, means, grams, hashes):
                gram = gram.reshape(hi - lo, m)
                if total is None:
                    total = [int(n), mean.copy(), gram.copy(), ids_hash]
                    continue
                if total[3] != ids_hash:
                    raise ContractError("rows of one matrix differ in their column ids (missing cells)")
                d = mean - total[1]
                both = total[0] + int(n)
                total[2] += gram + np.outer(d[lo:hi], d) * (total[0] * int(n) / both)
                total[1] = total[1] + d * (int(n) / both)
                total[0] = both
        columns = [first.column(i) for i in range(n_keys + 1)]
        columns += [
            pa.array([total[0]], pa.int64()),
            first.column(n_keys + 2),
            pa.array([int(total[3])], pa.int64()),
            pa.array([total[1]], pa.list_(pa.float64())),
            pa.array([total[2].ravel()], pa.list_(pa.float64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=arrow_names)

    lanes = sum_lanes(rows) if lanes is None else lanes
    if lanes > 1:
        laned = partial.withColumn("_lane", F.spark_partition_id() % lanes)
        partial = laned.groupBy(*keys, "block", "_lane").applyInArrow(merge, schema)
    return partial.groupBy(*keys, "block").applyInArrow(merge, schema)


def _whole(pdf) -> tuple[int, np.ndarray, np.ndarray]:
    pdf = pdf.sort_values("block")
    m = int(pdf["m"].iloc[0])
    gram = np.concatenate([np.asarray(g, dtype="float64") for g in pdf["gram"]]).reshape(m, m)
    return int(pdf["n"].iloc[0]), np.asarray(pdf["mean"].iloc[0], dtype="float64"), (gram + gram.T) / 2


def eigen_components(blocks: DataFrame, keys: Sequence[str], k: int | None, lost: int = 0, side: str = "features") -> DataFrame:
    """Leading eigenpairs of each group's cross-product matrix.

    One row per component: ``sigma`` (square root of the eigenvalue) and
    ``axis``, the unit eigenvector whose largest entry is positive. ``n`` is
    the number of rows that were summed and ``m`` their width. ``lost`` is the
    rank taken away by centring the samples.
    """
    keys = list(keys)
    fields = [blocks.schema[c] for c in keys] + [
        T.StructField("component", T.IntegerType()),
        T.StructField("sigma", T.DoubleType()),
        T.StructField("axis", T.ArrayType(T.DoubleType())),
        T.StructField("mean", T.ArrayType(T.DoubleType())),
        T.StructField("n", T.LongType()),
        T.StructField("m", T.IntegerType()),
    ]

    def solve(pdf):
        import pandas as pd

        n, mean, gram = _whole(pdf)
        lam, vec = np.linalg.eigh(gram)
        lam, vec = lam[::-1], vec[:, ::-1]
        m = len(lam)
        # a bound of rounding in the solved matrix; it does not grow with the rows that were summed
        floor = max(lam[0], 0.0) * np.finfo(float).eps * m
        rank = int((lam > floor).sum())
        samples, features = (n, m) if side == "features" else (m, n)
        rank = min(rank, samples - lost, features)
        keep = rank if k is None else min(k, rank)
        out = []
        for j in range(keep):
            axis = vec[:, j]
            lead = axis[np.argmax(np.round(np.abs(axis), 12))]
            axis = axis if lead >= 0 else -axis
            out.append((j + 1, float(np.sqrt(lam[j])), axis, mean, n, m))
        res = pd.DataFrame(out, columns=["component", "sigma", "axis", "mean", "n", "m"])
        for pos, name in enumerate(keys):
            res.insert(pos, name, pdf[name].iloc[0])
        return res

    return blocks.groupBy(*keys).applyInPandas(solve, T.StructType(fields)) if keys else (
        blocks.groupBy(F.lit(0)).applyInPandas(solve, T.StructType(fields))
    )


def small_grams(rows: DataFrame, keys: Sequence[str], width: int, vec: str = "vec") -> dict[tuple, np.ndarray]:
    """Collect cross-products of narrow arrays, one ``width x width`` per group.

    For layer-level keys only: the number of groups and the width are both
    small by construction and are checked before anything reaches the driver.
    """
    if width > 64:
        raise ContractError("small_grams is for narrow arrays (at most 64)")
    blocks = gram_blocks(rows, keys, "none", vec)
    got = blocks.select(*keys, "gram").take(1025)
    if len(got) > 1024:
        raise ContractError("small_grams is for at most 1024 groups")
    return {tuple(r[k] for k in keys): np.array(r["gram"]).reshape(width, width) for r in got}


def linear_map(vec: str, matrix: np.ndarray, out: str = "vec") -> Column:
    """Right-multiply an array column by a small fixed matrix, in the JVM."""
    terms = []
    for j in range(matrix.shape[1]):
        parts = [F.col(vec)[i] * F.lit(float(matrix[i, j])) for i in range(matrix.shape[0])]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        terms.append(total)
    return F.array(*terms).alias(out)
