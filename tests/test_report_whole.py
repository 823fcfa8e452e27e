"""Pages hold all rows of their tables, however many."""

import json
import re

import pytest
from pyspark.sql import functions as F

from pairweave.operators import report


def drawn(page):
    return json.loads(re.search(r"const D=(.*), on=D\.classes", page)[1])


def test_network_page(spark):
    n = 325  # fully linked: 52,650 edges
    ids = spark.range(n).select(F.format_string("n%03d", "id").alias("node_id"), "id")
    positions = ids.select("node_id", F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    nodes = ids.select("node_id", F.lit("c").alias("class"), F.lit(0).alias("code"), F.lit(1).alias("degree"), F.lit(3.0).alias("marker_size"))
    edges = ids.select(F.col("node_id").alias("source")).crossJoin(ids.select(F.col("node_id").alias("target"))).filter("source < target").withColumn("r", F.lit(0.5))
    page = report.network_html(nodes, edges, positions)
    assert len(drawn(page)["edges"]) == n * (n - 1) // 2 and len(drawn(page)["nodes"]) == n
    assert page == report.network_html(nodes.repartition(7), edges.repartition(5), positions)
    with pytest.raises(ValueError, match="more than 50000"):
        report.network_html(nodes, edges, positions, limit=50_000)
    assert len(drawn(report.network_html(nodes, edges, positions, limit=n * (n - 1) // 2))["edges"]) == n * (n - 1) // 2


def test_cluster_page(spark):
    k = 110  # 5,995 pairs
    clusters = spark.range(k).select(F.col("id").cast("int").alias("cluster"))
    sizes = clusters.withColumn("n", F.lit(3))
    positions = clusters.select("cluster", F.col("cluster").cast("double").alias("x"), F.lit(0.0).alias("y"))
    edges = clusters.select(F.col("cluster").alias("cluster_i")).crossJoin(clusters.select(F.col("cluster").alias("cluster_j"))).filter("cluster_i < cluster_j").select("*", F.lit(0.5).alias("similarity"), F.lit(1.0).alias("width"))
    cells = spark.range(200).select(F.format_string("s%03d", "id").alias("set_id")).crossJoin(clusters.filter("cluster < 30")).withColumn("abundance", F.lit(0.1))
    page = report.cluster_html(sizes, edges, positions, cells)
    assert len(drawn(page)["edges"]) == k * (k - 1) // 2 and page.count("<tr>") == 6000 and "<td>s199<td>" in page
    with pytest.raises(ValueError, match="more than 5000"):
        report.cluster_html(sizes, edges, positions, cells, limit=5000)


def test_hover_groups_and_sets(spark):
    edges = spark.createDataFrame([("a", "b", 0.5, None, 3), ("a", "c", -0.5, "x", 1), ("b", "c", 0.1, "</script>", 2)], "source string, target string, r double, kind string, k int")
    annotation = spark.createDataFrame([("a", "one", 7, None), ("b", "two", 8, "B")], "feature string, super_class string, size int, name string")
    nodes = report.viewer_nodes(edges, annotation, "size", constant=6)
    assert {(r["node_id"], r["class"], r["code"], r["marker_size"]) for r in nodes.collect()} == {("a", "7", 0, 6.0), ("b", "8", 1, 6.0), ("c", "unknown", 2, 6.0)}
    hover = report.hover_text(nodes, annotation, ["super_class", "size"], "name")
    assert {r["node_id"]: r["hover"] for r in hover.collect()} == {"a": "a\nsuper_class: one\nsize: 7\ndegree: 2", "b": "b\nB\nsuper_class: two\nsize: 8\ndegree: 2", "c": "c\nsuper_class: unknown\nsize: unknown\ndegree: 2"}
    groups = report.edge_groups(edges, "kind")
    assert {(r["label"], r["code"]) for r in groups.collect()} == {("</script>", 0), ("unknown", 1), ("x", 2)}
    assert {(r["source"], r["target"], r["code"]) for r in report.edge_groups(edges, "r", threshold=2, bins=4).collect()} == {("a", "b", 3), ("a", "c", 0), ("b", "c", 2)}
    assert {r["label"] for r in report.edge_groups(edges, "k").collect()} == {"1", "2", "3"} and report.edge_groups(edges.withColumn("k", F.lit(None).cast("int")), "k", "continuous").count() == 0
    with pytest.raises(ValueError):
        report.edge_groups(edges, "k", "other")
    positions = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 0.0), ("c", 0.0, 1.0)], "node_id string, x double, y double")
    page = report.network_html(hover, edges, positions, groups=groups)
    data = drawn(page)
    assert [n["h"].split("\n")[0] for n in data["nodes"]] == ["a", "b", "c"] and [g["label"] for g in data["groups"]] == ["</script>", "unknown", "x"]
    assert [e["g"] for e in data["edges"]] == [1, 2, 0] and page.count("</script>") == 1 and "%%" not in page


def test_sets_of_clusters(spark):
    sizes = spark.createDataFrame([(1, 4), (2, 9)], "cluster int, n long")
    positions = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 1.0)], "cluster int, x double, y double")
    edges = spark.createDataFrame([(1, 2, 0.5, 2.0)], "cluster_i int, cluster_j int, similarity double, width double")
    abundance = spark.createDataFrame([(1, "s1", 0.25), (2, "s1", 0.5), (2, "s2", 1.0), (9, "s2", 1.0)], "cluster int, set_id string, abundance double")
    significance = spark.createDataFrame([(2, "s1", True), (1, "s1", False)], "cluster int, set_id string, significant boolean")
    names = spark.createDataFrame([("s1", "first")], "set_id string, set_name string")
    data = drawn(report.cluster_html(sizes, edges, positions, abundance, significance=significance, names=names))
    assert data["sets"] == [{"label": "s1: first", "values": [0.25, 0.5], "significant": [False, True]}, {"label": "s2", "values": [0.0, 1.0], "significant": [False, False]}]
    assert data["nodes"][1]["h"] == "cluster 2\nn=9" and "sets" not in drawn(report.cluster_html(sizes, edges, positions))
