"""The six steps as chained plans over tables; parameters are keyword arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairweave.functions.special import adjust_bh
from pairweave.operators import clean, cluster, correlate, enrich, graph, pooling
from pairweave.plans.scratch import materialized
from pairweave.sources import writers


def ingest(cells: DataFrame, name_map: DataFrame, ids: DataFrame, aliases: DataFrame | None = None, join: str = "outer", below_limit: str = "zero") -> DataFrame:
    """Raw cells of all analyses (study_id, analysis_id, sample_id, raw_name, raw) to one value per cell."""
    parsed = clean.parse_cells(clean.standardize_names(cells, name_map, ids, aliases), below_limit)
    merged = clean.merge_analyses(parsed, cells.select("study_id", "analysis_id", "sample_id").distinct(), join)
    return clean.average_duplicates(merged)


def correlate_studies(obs: DataFrame, methods: tuple[str, ...] = ("pearson", "spearman"), transform: str | None = "log", pqn: bool = False, keep_unmapped: bool = False, min_unique: int | None = 3) -> DataFrame:
    return correlate.correlations(materialized(clean.prepare(obs, keep_unmapped, transform, pqn, min_unique)), methods)


def correlate_missing(obs: DataFrame, path: str, methods: tuple[str, ...] = ("pearson", "spearman"), **options) -> None:
    """Correlate and write, per method, the studies that aren't under ``path`` yet."""
    for method in methods:
        todo = materialized(writers.without_correlated(obs, path, method))
        writers.write_correlations(correlate_studies(todo, (method,), **options), path, overwrite=True)


def combine(corr: DataFrame, method: str) -> DataFrame:
    return corr.filter(F.col("method") == method).orderBy("feature_1", "feature_2", "study_id")


def pool_method(corr: DataFrame, method: str = "pearson", min_studies: int = 4, existing: DataFrame | None = None, overwrite: bool = True, limit: int | None = None, id_pattern: str | None = pooling.ID_PATTERN) -> DataFrame:
    """Pooled pairs of one method. The random effect always needs four studies."""
    rows = pooling.eligible(corr.filter(F.col("method") == method), id_pattern)
    return pooling.pool_new(rows, existing, overwrite, limit, min_studies=min_studies, min_studies_random=4).withColumn("method", F.lit(method))


def network(pooled: DataFrame, annotation: DataFrame, scenarios: tuple[str, ...] = ("abs", "signed", "posonly")) -> dict[str, DataFrame]:
    """edges, nodes, and the distances of each scenario."""
    edges = materialized(graph.significant_edges(pooled))
    out = {"edges": edges, "nodes": graph.annotated_nodes(edges, annotation)}
    return out | {f"distances_{s}": graph.scenario_distances(edges, s) for s in scenarios}


def cluster_and_enrich(edges: DataFrame, distances: DataFrame, xref: DataFrame, sets: DataFrame, n_clusters: int = 30, threshold: float = 0.05, n_sets: int | None = None, permutations: int = 999, alpha: float = 0.05, seed: int = 0, positive_only: bool = True) -> dict[str, DataFrame]:
    """Clusters, their connectivity with adjusted p values, enrichment, top sets, abundance and significance."""
    inside = graph.positive_edges(edges) if positive_only else edges
    clusters = cluster.cluster_nodes(distances, n_clusters)
    tested = cluster.permutation_test(inside, clusters, permutations=permutations, seed=seed)
    tested = adjust_bh(tested, "p", "p_adj", [], ["cluster_i", "cluster_j"]).withColumn("significant", F.col("p_adj") < alpha)
    found = enrich.enrich_clusters(xref, clusters, sets, threshold)
    best = enrich.top_sets(found, n_sets)
    chosen = sets.join(best.select("set_id"), "set_id", "left_semi")
    return {
        "clusters": clusters, "connectivity": tested, "enrichment": found, "top_sets": best,
        "abundance": enrich.set_abundance(xref, clusters, chosen), "significance": enrich.set_significance(found, clusters, chosen, threshold),
    }
