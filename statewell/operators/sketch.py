"""Randomised SVD for matrices too large on both sides (Halko et al. 2011)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statewell.common import BROADCAST_VALUES, materialise, small_side
from statewell.operators.decompose import Decomposition, _long_components, center_cells, leading_sign, threshold_warnings
from statewell.operators.linalg import eigen_components, gram_blocks

#: Cells of a block of the matrix, features that share one, and samples that do at most.
BLOCK_CELLS, BLOCK_FEATURES, BLOCK_SAMPLES = 131_072, 2_048, 16_384
#: A block is multiplied as a dense matrix if at least one in so many of its cells is there, else over so many cells at once.
DENSE, CELLS_AT_ONCE = 8, 16_384

BLOCK_OF = {"sample_id": "_sb", "feature_id": "_fb"}


def _normal(column: str, j: int, seed: int):
    """A standard normal number that depends only on the id, column and seed."""
    def uniform(tag: int):
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(j), F.lit(tag), F.col(column)), F.lit(1 << 52)) + 0.5) / float(1 << 52)

    return F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * np.pi * uniform(2))


def _dims(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blocks of features and of samples of every group, from rough counts: they only size the blocks."""
    rough = cells.groupBy(*keys).agg(
        F.count("*").alias("c"), F.approx_count_distinct("sample_id").alias("n"), F.approx_count_distinct("feature_id").alias("p")
    )
    parts = F.ceil(F.col("p") / BLOCK_FEATURES)
    return materialise(rough.withColumn("_fbs", parts.cast("int")).withColumn(
        "_sbs", F.greatest(F.ceil(F.col("c") / (F.col("_fbs") * BLOCK_CELLS)), F.ceil(F.col("n") / BLOCK_SAMPLES)).cast("int")
    ).select(*keys, "_fbs", "_sbs"))


def _place(rows: DataFrame, dims: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """The block that an id is dealt to, by its hash."""
    block = BLOCK_OF[by]
    return rows.join(small_side(dims.select(*keys, f"{block}s")), list(keys)).withColumn(
        block, F.pmod(F.xxhash64(by), F.col(f"{block}s")).cast("int")
    ).drop(f"{block}s")


def _blocks(cells: DataFrame, dims: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The matrix, one row a block: its ids, and place and value of each of its cells. The cells are shuffled here only."""
    keys = list(keys)
    placed = _place(_place(cells, dims, keys, "sample_id"), dims, keys, "feature_id").select(
        *keys, "_fb", "_sb", "sample_id", "feature_id", F.col("value").cast("double").alias("value")
    )
    by = [*keys, "_fb", "_sb"]
    fields = [placed.schema[k] for k in by] + [
        T.StructField("sample_id", T.ArrayType(placed.schema["sample_id"].dataType)),
        T.StructField("feature_id", T.ArrayType(placed.schema["feature_id"].dataType)),
        T.StructField("s", T.ArrayType(T.IntegerType())), T.StructField("f", T.ArrayType(T.IntegerType())),
        T.StructField("v", T.ArrayType(T.DoubleType())),
    ]
    names = [f.name for f in fields]

    def pack(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = pa.Table.from_batches(batches)
        ids, places = [], []
        for name in ("sample_id", "feature_id"):
            column = cells[name].combine_chunks()
            kinds = pc.unique(column)
            kinds = kinds.take(pc.sort_indices(kinds))
            ids.append(kinds)
            places.append(pc.index_in(column, value_set=kinds).to_numpy(zero_copy_only=False))
        order = np.lexsort(places[::-1])
        value = cells["value"].combine_chunks().fill_null(0.0).to_numpy(zero_copy_only=False)
        lists = [*ids, *[pa.array(x[order].astype(np.int32)) for x in places], pa.array(value[order])]
        columns = [cells[k].combine_chunks().slice(0, 1) for k in by]
        columns += [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    return materialise(placed.groupBy(*by).applyInArrow(pack, T.StructType(fields)))


def _pack(rows: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Vectors of ids, one row a block: ``keys.., block, ids, vecs``."""
    packed = rows.groupBy(*keys, BLOCK_OF[by]).agg(F.array_sort(F.collect_list(F.struct(F.col(by).alias("id"), "vec"))).alias("_p"))
    return materialise(packed.select(*keys, BLOCK_OF[by], F.col("_p.id").alias("ids"), F.col("_p.vec").alias("vecs")))


def _rows(packs: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    return packs.select(*keys, BLOCK_OF[by], F.inline(F.arrays_zip("ids", "vecs"))).withColumnsRenamed({"ids": by, "vecs": "vec"})


def _product(s: np.ndarray, f: np.ndarray, v: np.ndarray, n: int, p: int, weights: np.ndarray) -> np.ndarray:
    """``X W`` of a block whose cells are ordered by sample."""
    if len(v) * DENSE >= n * p:
        return np.bincount(s.astype(np.int64) * p + f, v, n * p).reshape(n, p) @ weights
    out = np.zeros((n, weights.shape[1]))
    for i in range(0, len(v), CELLS_AT_ONCE):
        at = s[i : i + CELLS_AT_ONCE]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        out[at[first]] += np.add.reduceat(v[i : i + CELLS_AT_ONCE, None] * weights[f[i : i + CELLS_AT_ONCE]], first)
    return out


def _numbers(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)


def _apply(blocks: DataFrame, packs: DataFrame, dims: DataFrame, keys: Sequence[str], on: str, by: str, width: int) -> DataFrame:
    """Packs of ``sum_on value * vec`` for every ``by``: each block meets the vectors of its ids, the partial sums are added.

    Few vectors are broadcast; else every block gets its own copy of those it needs, a few hundredths of its cells.
    """
    keys = list(keys)
    given = packs.withColumnsRenamed({"ids": "_ids", "vecs": "_vecs"})
    values = packs.agg(F.sum(F.size("ids"))).first()[0] or 0
    if values * width <= BROADCAST_VALUES:
        joined = blocks.join(F.broadcast(given), [*keys, BLOCK_OF[on]])
    else:
        others = F.sequence(F.lit(0), F.col(f"{BLOCK_OF[by]}s") - 1)
        copied = given.join(small_side(dims.select(*keys, f"{BLOCK_OF[by]}s")), keys).withColumn(BLOCK_OF[by], F.explode(others))
        joined = blocks.join(copied.drop(f"{BLOCK_OF[by]}s"), [*keys, "_fb", "_sb"])
    joined = joined.select(*keys, BLOCK_OF[by], by, on, "s", "f", "v", "_ids", "_vecs")
    fields = [joined.schema[k] for k in (*keys, BLOCK_OF[by])]
    fields += [T.StructField(by, joined.schema[by].dataType.elementType), T.StructField("vec", T.ArrayType(T.DoubleType()))]
    names, m = [f.name for f in fields], len(keys) + 1

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids, own, s, f, v, have, vecs = (row.column(m + j)[0] for j in range(7))
                s, f, v = (_numbers(x) for x in (s, f, v))
                matrix = vecs.values.flatten().to_numpy(zero_copy_only=False).reshape(len(vecs.values), -1)
                weights = matrix[pc.index_in(own.values, value_set=have.values).to_numpy(zero_copy_only=False)]
                if by == "sample_id":
                    got = _product(s, f, v, len(ids.values), len(own.values), weights)
                else:
                    order = np.argsort(f, kind="stable")
                    got = _product(f[order], s[order], v[order], len(ids.values), len(own.values), weights)
                size = len(got)
                columns = [pa.array(row.column(j).to_pylist() * size, row.column(j).type) for j in range(m)]
                ends = pa.array(np.arange(size + 1, dtype=np.int32) * got.shape[1])
                columns += [ids.values, pa.ListArray.from_arrays(ends, pa.array(got.ravel()))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    parts = joined.mapInArrow(multiply, T.StructType(fields))
    sums = parts.groupBy(*keys, BLOCK_OF[by], by).agg(*[F.sum(F.get("vec", F.lit(j))).alias(f"_s{j}") for j in range(width)])
    vec = F.array(*[F.coalesce(F.col(f"_s{j}"), F.lit(0.0)) for j in range(width)])
    return _pack(sums.select(*keys, BLOCK_OF[by], by, vec.alias("vec")), keys, by)


def _turn(packs: DataFrame, pairs: DataFrame, keys: Sequence[str], by: str, divide: bool) -> DataFrame:
    """Packed vectors times the axes of their group, each divided or multiplied by its singular value."""
    axes = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("component", "sigma", "axis"))).alias("_e"))
    joined = packs.join(axes, list(keys)).select(*packs.columns, F.col("_e.sigma").alias("_sigma"), F.col("_e.axis").alias("_axis"))
    names, m = packs.columns, len(packs.columns) - 1

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                vecs, sigma, axis = (row.column(m + j)[0].values for j in range(3))
                matrix = vecs.flatten().to_numpy(zero_copy_only=False).reshape(len(vecs), -1)
                axes = axis.flatten().to_numpy(zero_copy_only=False).reshape(len(axis), -1).T
                scale = sigma.to_numpy(zero_copy_only=False)
                # directions beyond the rank of a basis are zero
                axes = axes[: matrix.shape[1]]
                got = matrix @ (axes / scale if divide else axes * scale)
                ends = pa.array(np.arange(len(got) + 1, dtype=np.int32) * got.shape[1])
                inner = pa.ListArray.from_arrays(ends, pa.array(got.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*row.columns[:m], pa.ListArray.from_arrays(pa.array([0, len(got)], pa.int32()), inner)], names=names
                )

    return joined.mapInArrow(turn, packs.schema)


def _basis(packs: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Orthonormal basis of the columns of packed vectors."""
    pairs = materialise(eigen_components(gram_blocks(_rows(packs, keys, by), keys, "none"), keys, None))
    return materialise(_turn(packs, pairs, keys, by, divide=True))


def sketch_components(
    cells: DataFrame, keys: Sequence[str], k: int, center: bool = True, oversample: int = 10, power: int = 2, seed: int = 1
) -> Decomposition:
    """D3, both sides large: range finder with ``power`` passes.

    The cells are dealt into blocks once. Each pass multiplies every block by the
    vectors of its ids and adds the partial sums of ``k + oversample`` numbers per
    sample or feature; what is kept between passes is one such array each,
    checkpointed so that a lost executor costs one pass.
    """
    keys = list(keys)
    width = k + oversample
    dims = _dims(cells, keys)
    means = materialise(cells.groupBy(*keys, "feature_id").agg(F.avg("value").alias("mean")))
    if center:
        cells = center_cells(cells, small_side(means), keys)
    blocks = _blocks(cells, dims, keys)
    random = F.array(*[_normal("feature_id", j, seed) for j in range(width)])
    start = _pack(_place(means, dims, keys, "feature_id").select(*keys, "_fb", "feature_id", random.alias("vec")), keys, "feature_id")
    basis = _basis(_apply(blocks, start, dims, keys, "feature_id", "sample_id", width), keys, "sample_id")
    for _ in range(power):
        back = _basis(_apply(blocks, basis, dims, keys, "sample_id", "feature_id", width), keys, "feature_id")
        basis = _basis(_apply(blocks, back, dims, keys, "feature_id", "sample_id", width), keys, "sample_id")
    # B = Q'X is narrow; its right singular vectors are the loadings
    small = _apply(blocks, basis, dims, keys, "sample_id", "feature_id", width)
    pairs = materialise(eigen_components(gram_blocks(_rows(small, keys, "feature_id"), keys, "none"), keys, k))
    right = _rows(_turn(small, pairs, keys, "feature_id", divide=True), keys, "feature_id")
    left = _rows(_turn(basis, pairs, keys, "sample_id", divide=False), keys, "sample_id")
    loadings = _explode(right, keys, "feature_id", "loading", k)
    sign = leading_sign(loadings, [*keys, "component"])
    loadings = loadings.join(sign, [*keys, "component"]).withColumn("loading", F.col("loading") * F.col("sign")).drop("sign")
    scores = _explode(left, keys, "sample_id", "coord", k).join(sign, [*keys, "component"]).withColumn(
        "coord", F.col("coord") * F.col("sign")
    ).drop("sign")
    n = basis.groupBy(*keys).agg(F.sum(F.size("ids")).alias("n"))
    p = small.groupBy(*keys).agg(F.sum(F.size("ids")).alias("p"))
    spectrum = pairs.select(*keys, "component", "sigma")
    shape = spectrum.join(n, keys).join(p, keys)
    return Decomposition(loadings, scores, spectrum, threshold_warnings(shape, keys), tuple(keys))


def _explode(rows: DataFrame, keys: Sequence[str], by: str, value: str, k: int) -> DataFrame:
    wide = rows.select(*keys, by, *[F.get("vec", j).alias(f"_s{j}") for j in range(k)])
    return _long_components(wide, [*keys, by], k, value)
