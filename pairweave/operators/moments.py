"""Moments of pairs of features that add up: over slices of a study's rows, and over arrivals.

A pair's moments over some rows are n, the means and sums of squared deviations of both features, and
the sum of products of deviations, over the rows in which both have values. Two disjoint sets of rows
combine into the moments of their union without the values themselves, and without the cancellation of
plain sums of squares, as only deviations from means are squared.

Scale: features are numbered within a study and cut into blocks, rows are dealt by hash into slices. A
task holds two blocks of features of one slice, at most slice_rows x 2 block cells, whatever the size
of the study; its moments are matrix products. A pair has one row of moments per slice, which one
shuffle by pair combines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairweave.operators.clean import unique_cells

PAIR = ["study_id", "feature_1", "feature_2"]
MOMENTS = ["mean_1", "mean_2", "m2_1", "m2_2", "c_12"]
#: Spread relative to the mean that rounding alone leaves of equal values.
_FLAT = 1e-13


def dealt_blocks(obs: DataFrame, block: int, slice_rows: int | None = None) -> DataFrame:
    """study_id, i, j, slice, row, feature, f, value: each cell once for each two blocks i <= j of its study that need it.

    f numbers a study's features in order from 0. Repeated cells of a row are averaged.
    """
    order = F.row_number().over(Window.partitionBy("study_id").orderBy("feature")) - 1
    features = obs.select("study_id", "feature").distinct().withColumn("f", order.cast("int"))
    last = features.groupBy("study_id").agg(F.floor(F.max("f") / F.lit(block)).cast("int").alias("last"))
    cells = unique_cells(obs)
    if slice_rows is None:
        last = last.withColumn("slices", F.lit(1))
    else:
        rows = cells.select("study_id", "row").distinct().groupBy("study_id").agg(F.count(F.lit(1)).alias("k"))
        last = last.join(rows, "study_id").select("study_id", "last", F.ceil(F.col("k") / F.lit(slice_rows)).cast("int").alias("slices"))
    cells = cells.join(features, ["study_id", "feature"]).join(last, "study_id").withColumn("b", F.floor(F.col("f") / F.lit(block)).cast("int"))
    both = F.transform(F.sequence(F.lit(0), F.col("last")), lambda k: F.struct(F.least("b", k).alias("i"), F.greatest("b", k).alias("j")))
    own = F.pmod(F.xxhash64("row"), F.col("slices")).cast("int").alias("slice")
    return cells.withColumn("t", F.explode(both)).select("study_id", "t.i", "t.j", own, "row", "feature", "f", "value")


def _block_moments(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """``MOMENTS`` and n of the columns of x with those of y; NaN is missing."""
    here = [~np.isnan(v) for v in (x, y)]
    shift = [np.where(m, v, 0).sum(0) / np.maximum(1, m.sum(0)) for v, m in zip((x, y), here, strict=True)]
    x, y = (np.where(m, v - s, 0) for v, m, s in zip((x, y), here, shift, strict=True))
    mx, my = (m.astype(float) for m in here)
    n = mx.T @ my
    some = np.maximum(n, 1)
    sx, sy, qx, qy = x.T @ my, mx.T @ y, (x * x).T @ my, mx.T @ (y * y)
    spread = lambda q, s: np.where(q - s * s / some <= _FLAT * q, 0, q - s * s / some)
    return shift[0][:, None] + sx / some, shift[1] + sy / some, spread(qx, sx), spread(qy, sy), x.T @ y - sx * sy / some, n


def partial_moments(obs: DataFrame, block: int = 256, slice_rows: int = 1 << 15) -> DataFrame:
    """Moments of every pair of features of a study, one row per slice in which a row has both."""
    out = pa.schema([(c, pa.string()) for c in PAIR] + [("n", pa.int64())] + [(c, pa.float64()) for c in MOMENTS])

    def run(group: pa.Table) -> pa.Table:
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        rows = group.column("row").combine_chunks().dictionary_encode()
        place_of = np.empty(len(rows.dictionary), np.int64)  # sums in one order, however the rows come
        place_of[np.argsort(np.array(rows.dictionary.to_pylist(), object))] = np.arange(len(place_of))
        column = group.column("f").to_numpy()
        numbers, at, place = np.unique(column, return_index=True, return_inverse=True)
        names = np.array(group.column("feature").take(pa.array(at)).to_pylist(), object)
        wide = np.full((len(rows.dictionary), len(numbers)), np.nan)
        wide[place_of[rows.indices.to_numpy()], place] = group.column("value").to_numpy()
        first, second = numbers // block == i, numbers // block == j
        *found, n = _block_moments(wide[:, first], wide[:, second])
        a, b = np.nonzero((n > 0) & (numbers[first][:, None] < numbers[second]))
        ends = [pa.array(names[s][k].tolist(), pa.string()) for s, k in ((first, a), (second, b))]
        study = pa.array([group.column("study_id")[0].as_py()] * len(a), pa.string())
        return pa.Table.from_arrays([study, *ends, pa.array(n[a, b].astype(np.int64)), *(pa.array(c[a, b]) for c in found)], schema=out)

    ddl = ", ".join([f"{c} string" for c in PAIR] + ["n long"] + [f"{c} double" for c in MOMENTS])
    return dealt_blocks(obs, block, slice_rows).groupBy("study_id", "i", "j", "slice").applyInArrow(run, ddl)


def merge_moments(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per pair from the moments of disjoint sets of rows, the same in whatever order they come."""
    by = by or PAIR
    held = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("n", *MOMENTS))).alias("s"))
    total = lambda f: F.aggregate("s", F.lit(0.0), lambda a, x: a + f(x))
    held = held.withColumn("n", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x.n))
    means = {f"mean_{k}": F.when(F.size("s") == 1, F.col("s")[0][f"mean_{k}"]).otherwise(total(lambda x, k=k: x.n * x[f"mean_{k}"]) / F.col("n")) for k in (1, 2)}
    held = held.withColumns(means)
    between = lambda x, a, b: x.n * (x[f"mean_{a}"] - F.col(f"mean_{a}")) * (x[f"mean_{b}"] - F.col(f"mean_{b}"))
    sums = {name: total(lambda x, name=name, a=a, b=b: x[name] + between(x, a, b)) for name, a, b in (("m2_1", 1, 1), ("m2_2", 2, 2), ("c_12", 1, 2))}
    return held.withColumns(sums).select(*by, "n", *MOMENTS)


def moments_r() -> Column:
    """Pearson's r of a row of moments; NULL for constants and for fewer than two rows."""
    flat = lambda k: F.col(f"m2_{k}") <= _FLAT * _FLAT * F.col("n") * F.col(f"mean_{k}") * F.col(f"mean_{k}")
    r = F.try_divide("c_12", F.sqrt("m2_1") * F.sqrt("m2_2"))
    return F.when((F.col("n") > 1) & ~flat(1) & ~flat(2) & r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
