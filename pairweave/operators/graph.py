"""The correlation network: edges, nodes, components and distances.

edges: source < target, weight, distance, distance_signed, r, ci_low, ci_high; one row per pair.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairweave.operators.components import connect
from pairweave.plans.scratch import materialized


def significant_edges(pooled: DataFrame) -> DataFrame:
    """Pairs whose random-effect interval excludes zero, with edge attributes."""
    kept = pooled.filter("ci_r_random_low > 0 OR ci_r_random_high < 0")
    return edge_attributes(kept.select(F.col("feature_1").alias("source"), F.col("feature_2").alias("target"), F.col("r_random").alias("r"), F.col("ci_r_random_low").alias("ci_low"), F.col("ci_r_random_high").alias("ci_high")))


def edge_attributes(edges: DataFrame) -> DataFrame:
    r = F.col("r")
    return edges.select("source", "target", F.abs(r).alias("weight"), (1 - F.abs(r)).alias("distance"), ((1 - r * r * r) / 2).alias("distance_signed"), "r", "ci_low", "ci_high")


def positive_edges(edges: DataFrame) -> DataFrame:
    return edges.filter("r > 0")


def end_points(edges: DataFrame) -> DataFrame:
    """One row per edge and end: node_id."""
    return edges.select(F.explode(F.array("source", "target")).alias("node_id"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return end_points(edges).distinct()


def annotated_nodes(edges: DataFrame, annotation: DataFrame) -> DataFrame:
    """node_id and the annotation's columns (its key: feature), where there are any."""
    return nodes_of(edges).join(annotation.withColumnRenamed("feature", "node_id"), "node_id", "left")


def degrees(edges: DataFrame) -> DataFrame:
    return end_points(edges).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def smallest_labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component: minima over links, then jumps to the label's label."""
    label = np.arange(n)
    while True:
        low, new = np.minimum(label[u], label[v]), label.copy()
        for end in (u, v):
            np.minimum.at(new, label[end], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def components(edges: DataFrame, max_bytes: int = 32 << 20) -> DataFrame:
    """node_id and component (its smallest node); what ``edges`` stands for is computed once.

    Links of up to ``max_bytes`` are labelled as arrays on the driver, more of them by rounds on tables
    (``components.connect``); both give the same.
    """
    links = materialized(edges.select(F.col("source").alias("a"), F.col("target").alias("b")))
    size = links.agg(F.coalesce(F.sum(F.octet_length("a") + F.octet_length("b") + 8), F.lit(0))).first()[0]
    if size <= max_bytes:
        held = links.toArrow()
        names = pc.unique(pa.chunked_array([*held.column("a").chunks, *held.column("b").chunks], pa.string())).sort()
        label = smallest_labels(*(pc.index_in(held.column(c), names).to_numpy().astype(np.int64) for c in "ab"), len(names))
        return edges.sparkSession.createDataFrame(pa.table({"node_id": names, "component": names.take(pa.array(label))}))
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    found = connect(materialized(nodes.withColumn("root", F.col("node"))), links)
    return found.select(F.col("node").alias("node_id"), F.col("root").alias("component"))


def direct_distances(edges: DataFrame, weight: str = "distance") -> DataFrame:
    """All ordered pairs of nodes: an edge's weight, 0 on the diagonal, else neutral (0.5 signed, 1 otherwise)."""
    neutral = 0.5 if weight == "distance_signed" else 1.0
    nodes = nodes_of(edges)
    both = edges.select("source", "target", F.col(weight).alias("d")).union(edges.select("target", "source", weight))
    grid = nodes.withColumnRenamed("node_id", "source").crossJoin(nodes.withColumnRenamed("node_id", "target"))  # the result itself is this square
    d = F.when(F.col("source") == F.col("target"), 0.0).otherwise(F.coalesce("d", F.lit(neutral)))
    return grid.join(both, ["source", "target"], "left").select("source", "target", d.alias("d"))


#: Lengths that a task relaxes at a time; rounds after which Dijkstra takes over.
CELLS, MOST_ROUNDS = 1 << 22, 100


@dataclass(frozen=True)
class Adjacency:
    """A graph as arrays: the neighbours of node i are ends[starts[i] : starts[i + 1]]."""

    names: pa.Array
    starts: np.ndarray
    ends: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, links: pa.Table) -> Adjacency:
        names = pc.unique(pa.chunked_array([*links.column("source").chunks, *links.column("target").chunks], pa.string())).sort()
        u, v = (pc.index_in(links.column(c), names).to_numpy().astype(np.int32) for c in ("source", "target"))
        w = links.column("w").to_numpy()
        begin, ends, weights = np.concatenate((u, v)), np.concatenate((v, u)), np.concatenate((w, w))
        order = np.argsort(begin, kind="stable")
        return cls(names, np.searchsorted(begin[order], np.arange(len(names) + 1)), ends[order], weights[order])

    def paths(self, source: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes that ``source`` reaches, and the lengths of the shortest paths there, by Dijkstra."""
        best, heap, done = {source: 0.0}, [(0.0, source)], set()
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            near = slice(self.starts[u], self.starts[u + 1])
            for v, w in zip(self.ends[near].tolist(), self.weights[near].tolist(), strict=True):
                if d + w < best.get(v, float("inf")):
                    best[v] = d + w
                    heapq.heappush(heap, (d + w, v))
        return np.fromiter(best.keys(), np.int64, len(best)), np.fromiter(best.values(), float, len(best))


    def lengths(self, sources: np.ndarray) -> np.ndarray | None:
        """Shortest lengths from each of ``sources`` to all nodes, infinite where there is no path; None if paths have too many links.

        All sources relax all links at once, a link's end taking the least over its neighbours, until
        nothing changes: as many rounds as the longest shortest path has links.
        """
        best = np.full((len(sources), len(self.names)), np.inf)
        best[np.arange(len(sources)), sources] = 0.0
        linked = np.flatnonzero(np.diff(self.starts))  # reduceat needs nodes that have links
        if not len(linked):
            return best
        for _ in range(MOST_ROUNDS):
            come = np.minimum.reduceat(best[:, self.ends] + self.weights, self.starts[linked], axis=1)
            shorter = come < best[:, linked]
            if not shorter.any():
                return best
            best[:, linked] = np.where(shorter, come, best[:, linked])
        return None

    def rows_of(self, sources: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each source the nodes that it reaches and the lengths, for some sources at a time."""
        step = max(1, CELLS // max(1, len(self.ends), len(self.names)))
        for start in range(0, len(sources), step):
            some = sources[start : start + step]
            best = self.lengths(some)
            for k, source in enumerate(some.tolist()):
                if best is None:
                    yield source, *self.paths(source)
                else:
                    to = np.flatnonzero(np.isfinite(best[k]))
                    yield source, to, best[k, to]


def shortest_paths(edges: DataFrame, weight: str = "distance", max_bytes: int = 64 << 20) -> DataFrame:
    """Lengths of shortest paths between connected nodes, both directions and the diagonal.

    A graph whose arrays and names take up to ``max_bytes`` is shipped to every task, which relaxes all
    links from a block of its sources at once (and runs Dijkstra from each where paths have very many
    links); the paths of a larger graph get shorter by joins until no row changes. All give the same
    lengths but for the order in which a path's weights add up.
    """
    links = materialized(edges.select("source", "target", F.col(weight).alias("w")))
    size = links.agg(F.coalesce(F.sum(F.octet_length("source") + F.octet_length("target") + 24), F.lit(0))).first()[0]
    if size > max_bytes:
        return _relaxed(links)
    graph = Adjacency.of(links.toArrow())
    shipped = edges.sparkSession.sparkContext.broadcast(graph)
    out = pa.schema([("source", pa.string()), ("target", pa.string()), ("d", pa.float64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = shipped.value
        for part in parts:
            for source, to, d in near.rows_of(part.column("id").to_numpy()):
                yield pa.RecordBatch.from_arrays([near.names.take(pa.array(np.full(len(to), source))), near.names.take(pa.array(to)), pa.array(d)], schema=out)

    spark = edges.sparkSession
    sources = spark.range(0, len(graph.names), 1, max(1, min(len(graph.names), 4 * spark.sparkContext.defaultParallelism)))
    return sources.mapInArrow(run, "source string, target string, d double")


def _relaxed(links: DataFrame) -> DataFrame:
    """Rounds extend the paths that the round before has made shorter, by one edge, until there is none."""
    both = materialized(links.union(links.select("target", "source", "w")).select(F.col("source").alias("target"), F.col("target").alias("next"), "w"))
    best = materialized(nodes_of(links).select(F.col("node_id").alias("source"), F.col("node_id").alias("target"), F.lit(0.0).alias("d")))
    changed = best
    while not changed.isEmpty():
        longer = changed.join(both, "target").groupBy("source", F.col("next").alias("target")).agg(F.min(F.col("d") + F.col("w")).alias("e"))
        changed = materialized(longer.join(best, ["source", "target"], "left").filter("d IS NULL OR e < d").select("source", "target", F.col("e").alias("d")))
        best = materialized(best.union(changed).groupBy("source", "target").agg(F.min("d").alias("d")))
    return best


def symmetrize(distances: DataFrame) -> DataFrame:
    """The mean of both directions, for both directions."""
    pair = [F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")]
    mean = distances.groupBy(*pair).agg(F.avg("d").alias("d"))
    return mean.select(F.col("a").alias("source"), F.col("b").alias("target"), "d").union(mean.filter("a != b").select("b", "a", "d"))


def restrict_connected(distances: DataFrame, edges: DataFrame, on_disconnected: str = "error", cap: float = 1.0) -> DataFrame:
    """Distances among all pairs of a graph that may have several components.

    "error" refuses, "largest" keeps the largest component (the smallest id on ties), "cap" gives
    pairs without a path the distance ``cap`` plus the largest there is.
    """
    parts = components(edges)
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component")
    if len(sizes.take(2)) < 2:
        return distances
    if on_disconnected == "error":
        raise ValueError("the graph has several components")
    if on_disconnected == "largest":
        kept = parts.join(F.broadcast(sizes.limit(1)), "component").select("node_id")
        inside = distances.join(kept.withColumnRenamed("node_id", "source"), "source", "left_semi")
        return inside.join(kept.withColumnRenamed("node_id", "target"), "target", "left_semi").select("source", "target", "d")
    if on_disconnected != "cap":
        raise ValueError(f"on_disconnected must be 'error', 'largest' or 'cap', not {on_disconnected!r}")
    far = distances.agg(F.max("d")).first()[0] + cap
    nodes = parts.select("node_id")
    grid = nodes.withColumnRenamed("node_id", "source").crossJoin(nodes.withColumnRenamed("node_id", "target"))
    return grid.join(distances, ["source", "target"], "left").select("source", "target", F.coalesce("d", F.lit(far)).alias("d"))


@dataclass(frozen=True)
class Scenario:
    """A way to turn edges into distances."""

    name: str
    weight: str
    positive_only: bool
    direct_fill: bool


SCENARIOS = {s.name: s for s in (Scenario("abs", "distance", False, False), Scenario("signed", "distance_signed", False, True), Scenario("posonly", "distance", True, False))}


def scenario_distances(edges: DataFrame, name: str) -> DataFrame:
    """Distances between nodes under the scenario "abs", "signed" or "posonly"."""
    s = SCENARIOS[name]
    edges = positive_edges(edges) if s.positive_only else edges
    return direct_distances(edges, s.weight) if s.direct_fill else shortest_paths(edges, s.weight)


def is_edge_visible(active: list[str], source_class: Column, target_class: Column) -> Column:
    """An edge shows if the classes of both ends are active."""
    return source_class.isin(active) & target_class.isin(active)
