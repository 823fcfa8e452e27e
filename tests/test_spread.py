"""The layout beyond a dense matrix against the exact one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairweave.operators import cluster, spread


def exact_repulsion(y):
    diff = y[:, None] - y[None]
    t = 1 / (1 + (diff**2).sum(2))
    np.fill_diagonal(t, 0)
    return t.sum(1), ((t * t)[:, :, None] * diff).sum(1)


@pytest.mark.parametrize(("kind", "n"), [("even", 3000), ("clusters", 3000), ("few", 5), ("same", 40), ("line", 400)])
def test_repulsion(kind, n):
    rng = np.random.default_rng(1)
    y = rng.normal(size=(n, 2)) * 8
    if kind == "clusters":
        y = rng.normal(size=(12, 2))[rng.integers(0, 12, n)] * 30 + rng.normal(size=(n, 2))
    if kind == "same":
        y[:] = 3.0
    if kind == "line":
        y[:, 1] = 0
    total, force = exact_repulsion(y)
    half = [spread.repulsion(y, a, b) for a, b in ((0, n // 3), (n // 3, n))]
    got_total, got_force = (np.concatenate([h[k] for h in half]) for k in (0, 1))
    assert np.abs(got_total / total - 1).max() < 0.05
    assert np.linalg.norm(got_force - force) <= 0.03 * np.linalg.norm(force) + 1e-9


def test_pairs_are_met_in_parts(monkeypatch):
    y = np.random.default_rng(2).normal(size=(300, 2))
    want = spread.repulsion(y, 50, 200)
    monkeypatch.setattr(spread, "PAIRS", 37)
    got = spread.repulsion(y, 50, 200)
    assert np.allclose(got[0], want[0]) and np.allclose(got[1], want[1])


def test_row_affinities():
    d = np.array([[1.0, 2.0, 3.0, np.nan], [1.0, 1.0, 1.0, 1.0], [0.1, 5.0, 5.0, 5.0]])
    p = spread.row_affinities(d, 2.0)
    assert np.allclose(p.sum(1), 1) and p[0, 3] == 0 and np.allclose(p[1], 0.25) and p[0, 0] > p[0, 1] > p[0, 2]
    assert np.exp(-(p[0, :3] * np.log(p[0, :3])).sum()) == pytest.approx(2.0, rel=1e-3)


def kept_neighbours(d, at, k=8):
    """The share of each node's k nearest in d that are among its k nearest in the plane."""
    flat = np.linalg.norm(at[:, None] - at[None], axis=2)
    near = [np.argsort(m + np.diag(np.full(len(m), np.inf)), 1)[:, :k] for m in (d, flat)]
    return np.mean([len(set(a) & set(b)) / k for a, b in zip(*near, strict=True)])


def test_neighbourhoods_are_kept_as_by_the_exact_layout(spark):
    rng = np.random.default_rng(3)
    n, groups = 240, 6
    points = rng.normal(size=(groups, 5))[np.arange(n) % groups] * 6 + rng.normal(size=(n, 5))
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    rows = [(f"n{i:03d}", f"n{j:03d}", float(d[i, j])) for i in range(n) for j in range(n)]
    distances = spark.createDataFrame(rows, "source string, target string, d double")
    in_order = lambda df: np.array([(r["x"], r["y"]) for r in df.orderBy("node_id").collect()])
    exact = in_order(cluster.layout(distances, perplexity=12, rounds=150))
    near = in_order(cluster.layout(distances, perplexity=12, rounds=150, max_nodes=100))
    assert np.isfinite(near).all() and near.shape == (n, 2)
    assert kept_neighbours(d, near) >= 0.9 * kept_neighbours(d, exact) > 0.2
    centres = np.array([near[np.arange(n) % groups == g].mean(0) for g in range(groups)])
    within = np.mean([np.linalg.norm(near[i] - centres[i % groups]) for i in range(n)])
    assert np.linalg.norm(centres[:, None] - centres[None], axis=2)[np.triu_indices(groups, 1)].min() > within


def test_sparse_distances(spark):
    """A ring of nodes that know their next ones only, in several blocks."""
    n = 60
    pairs = spark.range(n).select(F.col("id").cast("int").alias("i"), F.explode(F.array(*(F.lit(k) for k in (-2, -1, 0, 1, 2)))).alias("k"))
    pairs = pairs.select("i", F.pmod(F.col("i") + F.col("k"), F.lit(n)).cast("int").alias("j"), F.abs("k").cast("double").alias("d"))
    at = spread.spread(pairs, n, perplexity=3, rounds=30, block=16)
    assert at.shape == (n, 2) and np.isfinite(at).all() and np.allclose(at.mean(0), 0)
    assert (at == spread.spread(pairs, n, perplexity=3, rounds=30, block=16)).all()
