"""A layout in the plane of graphs beyond a dense matrix: t-SNE on nearest neighbours, in rounds of Spark jobs.

Attraction acts between near neighbours only, whose affinities are a sparse table in blocks of nodes on
the executors. Repulsion comes from a pyramid of grids: a node meets the cells around it exactly, cells
farther off by their centre of mass, ever larger ones with distance. A round ships the positions, 16
bytes a node, and gets back forces of the same size; everything that grows with the neighbours stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairweave.plans.scratch import materialized

#: Nodes of a block of affinities; nodes in the mean cell of the finest grid; pairs of near nodes held at a time.
BLOCK, LEAF, PAIRS = 2048, 4, 1 << 20
#: Cells this near are not met as wholes: their parts are, and in the finest grid their nodes.
NEAR = 2


def row_affinities(d: np.ndarray, perplexity: float) -> np.ndarray:
    """Of each row of distances to neighbours (NaN beyond a row's own), their probabilities at this perplexity."""
    square = np.where(np.isnan(d), np.inf, d) ** 2
    square = square - square.min(1, keepdims=True)
    goal = np.log(np.minimum(perplexity, np.maximum(1, np.isfinite(square).sum(1))))
    low, high, beta = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    for _ in range(60):
        e = np.exp(-np.where(np.isinf(square), np.inf, square * beta[:, None]))
        q = e / e.sum(1, keepdims=True)
        entropy = -(q * np.log(np.maximum(q, 1e-300))).sum(1)
        wide = entropy > goal
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    return q


def affinities(pairs: DataFrame, perplexity: float) -> DataFrame:
    """i, j, p: symmetric affinities of nodes and their 3 x perplexity nearest; ``pairs`` (i, j, d) has both directions."""
    count = int(3 * perplexity)
    order = Window.partitionBy("i").orderBy("d", "j")
    near = pairs.filter("i != j").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= count)
    rows = near.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("d", "j"))).alias("s")).select("i", F.col("s.j").alias("j"), F.col("s.d").alias("d"))
    out = pa.schema([("i", pa.int32()), ("j", pa.list_(pa.int32())), ("p", pa.list_(pa.float64()))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for own in (part.slice(a, 500) for a in range(0, part.num_rows, 500)):
                d = own.column("d")
                sizes = np.diff(d.offsets.to_numpy())
                wide = np.full((len(sizes), sizes.max(initial=1)), np.nan)
                inside = np.arange(wide.shape[1]) < sizes[:, None]
                wide[inside] = d.flatten().to_numpy()
                p = row_affinities(wide, perplexity)[inside]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(p))
                yield pa.RecordBatch.from_arrays([own.column("i"), own.column("j"), lists], schema=out)

    told = rows.mapInArrow(run, "i int, j array<int>, p array<double>").select("i", F.explode(F.arrays_zip("j", "p")).alias("e")).select("i", "e.j", "e.p")
    return told.union(told.select("j", "i", "p")).groupBy("i", "j").agg(F.sum("p").alias("p"))


def packed_blocks(links: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per block of nodes: i, j, p of its links as binary columns, in order."""
    kind = pa.schema([("b", pa.int32()), ("i", pa.binary()), ("j", pa.binary()), ("p", pa.binary())])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("i", "ascending"), ("j", "ascending")])
        packed = [pa.array([group.column(c).to_numpy().astype(t).tobytes()], pa.binary()) for c, t in (("i", "<i4"), ("j", "<i4"), ("p", "<f8"))]
        return pa.Table.from_arrays([group.column("b").slice(0, 1).combine_chunks(), *packed], schema=kind)

    return links.withColumn("b", F.floor(F.col("i") / F.lit(block)).cast("int")).groupBy("b").applyInArrow(run, "b int, i binary, j binary, p binary")


def repulsion(y: np.ndarray, start: int, stop: int, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """For nodes start..stop of the positions y: the sums over all others of t and of t**2 times the difference, t = 1 / (1 + distance**2)."""
    n, own = len(y), y[start:stop]
    depth = max(1, min(10, int(np.ceil(np.log(max(1, n / leaf)) / np.log(4)))))
    low = y.min(0)
    side = max(float((y.max(0) - low).max()), 1e-12) * (1 + 1e-9)
    force, total = np.zeros_like(own), np.zeros(len(own))

    def meet(diff: np.ndarray, mass) -> tuple[np.ndarray, np.ndarray]:
        t = 1 / (1 + (diff**2).sum(1))
        return (mass * t * t)[:, None] * diff, mass * t

    for level in range(2, depth + 1):
        width = 1 << level
        cell = np.minimum((y - low) / side * width, width - 1).astype(np.int64)
        number = cell[:, 0] * width + cell[:, 1]
        mass = np.bincount(number, minlength=width * width).astype(float)
        centre = np.stack([np.bincount(number, y[:, k], minlength=width * width) for k in (0, 1)], 1) / np.maximum(mass, 1)[:, None]
        mine = cell[start:stop]
        first = 2 * ((mine >> 1) - NEAR)  # the children of the parent's neighbours begin here
        for a in range(4 * NEAR + 2):
            for b in range(4 * NEAR + 2):
                other = first + (a, b)
                far = (np.abs(other - mine).max(1) > NEAR) & (other >= 0).all(1) & (other < width).all(1)
                at = other[far, 0] * width + other[far, 1]
                f, t = meet(own[far] - centre[at], mass[at])
                force[far] += f
                total[far] += t
    width = 1 << depth
    cell = np.minimum((y - low) / side * width, width - 1).astype(np.int64)
    number = cell[:, 0] * width + cell[:, 1]
    order = np.argsort(number, kind="stable")
    starts = np.searchsorted(number[order], np.arange(width * width + 1))
    mine = cell[start:stop]
    for dx in range(-NEAR, NEAR + 1):  # cells side by side in a column are next to each other in the order
        row = mine[:, 0] + dx
        some = np.flatnonzero((row >= 0) & (row < width))
        begin = starts[row[some] * width + np.maximum(mine[some, 1] - NEAR, 0)]
        sizes = starts[row[some] * width + np.minimum(mine[some, 1] + NEAR, width - 1) + 1] - begin
        cuts = np.unique(np.append(np.searchsorted(np.cumsum(sizes), np.arange(PAIRS, sizes.sum(), PAIRS)) + 1, len(sizes)))
        for lo, hi in zip([0, *cuts[:-1]], cuts, strict=True):
            s, b = sizes[lo:hi], begin[lo:hi]
            who = np.repeat(some[lo:hi], s)
            partner = order[np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s) + np.repeat(b, s)]
            f, t = meet(own[who] - y[partner], (partner != who + start).astype(float))
            for k in (0, 1):
                force[:, k] += np.bincount(who, f[:, k], minlength=len(own))
            total += np.bincount(who, t, minlength=len(own))
    return total, force


def spread(pairs: DataFrame, n: int, perplexity: float = 30.0, seed: int = 0, rounds: int = 500, block: int = BLOCK) -> np.ndarray:
    """Positions of n numbered nodes from distances (i, j, d) in both directions; pairs that aren't there are not near.

    The schedule of steps is that of the exact layout. Blocks of affinities are kept on the executors and
    made again from their table where one is lost.
    """
    spark = pairs.sparkSession
    perplexity = max(1.0, min(perplexity, (n - 1) / 3))
    number = -(-n // block)
    blocks = materialized(packed_blocks(affinities(pairs, perplexity), block)).repartition(number).persist()
    out = pa.schema([("b", pa.int32()), ("f", pa.binary())])
    y = np.random.default_rng(seed).normal(0, 1e-4, (n, 2))
    speed, gain, rate = np.zeros_like(y), np.ones_like(y), max(n / 12 / 4, 50.0)

    def step(shipped):
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = shipped.value
            for part in parts:
                for row in part.to_pylist():
                    start, stop = row["b"] * block, min(n, (row["b"] + 1) * block)
                    i, j, p = (np.frombuffer(row[c], t) for c, t in (("i", "<i4"), ("j", "<i4"), ("p", "<f8")))
                    diff = at[i] - at[j]
                    pull = p / (2 * n) / (1 + (diff**2).sum(1))
                    total, push = repulsion(at, start, stop)
                    pulled = np.stack([np.bincount(i - start, pull * diff[:, k], minlength=stop - start) for k in (0, 1)], 1)
                    yield pa.RecordBatch.from_arrays([pa.array([row["b"]], pa.int32()), pa.array([np.hstack((pulled, push, total[:, None])).tobytes()])], schema=out)

        return run

    try:
        for k in range(rounds):
            shipped = spark.sparkContext.broadcast(y)
            forces = np.zeros((n, 5))
            for row in blocks.mapInArrow(step(shipped), "b int, f binary").collect():  # 40 bytes a node
                own = np.frombuffer(row["f"]).reshape(-1, 5)
                forces[row["b"] * block : row["b"] * block + len(own)] = own
            shipped.unpersist()
            grad = 4 * (forces[:, :2] * (12 if k < 100 else 1) - forces[:, 2:4] / max(forces[:, 4].sum(), 1e-300))
            gain = np.maximum(np.where(np.sign(grad) == np.sign(speed), gain * 0.8, gain + 0.2), 0.01)
            speed = (0.5 if k < 250 else 0.8) * speed - rate * gain * grad
            y = y + speed
    finally:
        blocks.unpersist()
    return y - y.mean(0)
