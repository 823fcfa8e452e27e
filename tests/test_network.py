import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairweave.functions.special import t_two_sided  # noqa: F401
from pairweave.operators import cluster, enrich, graph, report
from pairweave.plans import steps
from pairweave.sources import readers, writers


def edges_of(spark, rows):
    base = spark.createDataFrame([(a, b, float(r), float(r), float(r)) for a, b, r in rows], "source string, target string, r double, ci_low double, ci_high double")
    return graph.edge_attributes(base)


@pytest.fixture(scope="module")
def edges(spark):
    rng = np.random.default_rng(3)
    rows = [(f"n{a}", f"n{b}", rng.uniform(-0.9, 0.9)) for a, b in itertools.combinations(range(8), 2) if rng.random() < 0.5]
    return edges_of(spark, [*rows, ("x0", "x1", 0.5)])


def square(df):
    return {(r["source"], r["target"]): r["d"] for r in df.collect()}


def test_paths_against_floyd(spark, edges):
    got = square(graph.shortest_paths(edges))
    nodes = sorted({n for pair in got for n in pair})
    d = {(a, b): 0.0 if a == b else np.inf for a in nodes for b in nodes}
    for r in edges.collect():
        d[r["source"], r["target"]] = d[r["target"], r["source"]] = r["distance"]
    for k, i, j in itertools.product(nodes, nodes, nodes):
        d[i, j] = min(d[i, j], d[i, k] + d[k, j])
    want = {k: v for k, v in d.items() if v < np.inf}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    by_joins = square(graph.shortest_paths(edges, max_bytes=0))
    assert by_joins.keys() == want.keys() and all(by_joins[k] == pytest.approx(want[k]) for k in want)


def test_components_and_disconnected(spark, edges):
    parts = {r["node_id"]: r["component"] for r in graph.components(edges).collect()}
    assert parts["x1"] == "x0" and parts["n0"] != "x0"
    paths = graph.shortest_paths(edges)
    with pytest.raises(ValueError):
        graph.restrict_connected(paths, edges)
    largest = square(graph.restrict_connected(paths, edges, "largest"))
    assert all(a[0] == "n" and b[0] == "n" for a, b in largest)
    capped = square(graph.restrict_connected(paths, edges, "cap"))
    assert len(capped) == len(parts) ** 2
    line = edges_of(spark, [(f"k{i:02d}", f"k{i + 1:02d}", 0.5) for i in range(20)])
    assert {r["component"] for r in graph.components(line).collect()} == {"k00"}


def test_direct_and_symmetric(spark):
    e = edges_of(spark, [("a", "b", -0.5), ("b", "c", 0.5)])
    d = square(graph.direct_distances(e, "distance_signed"))
    assert d["a", "a"] == 0 and d["a", "c"] == 0.5 and d["b", "a"] == pytest.approx((1 + 0.125) / 2)
    skew = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 3.0), ("a", "a", 0.0)], "source string, target string, d double")
    assert square(graph.symmetrize(skew)) == {("a", "b"): 2.0, ("b", "a"): 2.0, ("a", "a"): 0.0}


def naive_linkage(d, method):
    groups, heights, dist = {i: [i] for i in range(len(d))}, [], {(i, j): d[i, j] for i in range(len(d)) for j in range(i)}
    get = lambda a, b: dist[max(a, b), min(a, b)]
    nxt = len(d)
    while len(groups) > 1:
        a, b = min(itertools.combinations(sorted(groups), 2), key=lambda p: get(*p))
        h = get(a, b)
        heights.append(h)
        for c in groups:
            if c not in (a, b):
                na, nb, nc = len(groups[a]), len(groups[b]), len(groups[c])
                if method == "ward":
                    v = np.sqrt(max(0, ((na + nc) * get(a, c) ** 2 + (nb + nc) * get(b, c) ** 2 - nc * h * h) / (na + nb + nc)))
                else:
                    v = (na * get(a, c) + nb * get(b, c)) / (na + nb)
                dist[nxt, c] = v
        groups[nxt] = groups.pop(a) + groups.pop(b)
        nxt += 1
    return heights


@pytest.mark.parametrize("method", ["ward", "average"])
def test_linkage(method):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(14, 3))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    steps_ = cluster.linkage(d, method)
    assert np.allclose(steps_[:, 2], naive_linkage(d, method))
    assert (np.diff(steps_[:, 2]) >= -1e-12).all() and steps_[-1, 3] == 14
    for k in (1, 3, 14, 20):
        assert len(set(cluster.flat_clusters(steps_, k))) == min(k, 14)
    assert sorted(cluster.leaf_order(steps_)) == list(range(14))
    assert "<svg" in report.dendrogram_svg([tuple(s[:3]) for s in steps_.astype(object)], [str(i) for i in range(14)])


@pytest.mark.parametrize("method", ["ward", "average"])
def test_linkage_on_tables(spark, method):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(13, 3))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    rows = [(f"n{i:02d}", f"n{j:02d}", float(d[i, j])) for i in range(13) for j in range(13)]
    distances = spark.createDataFrame(rows, "source string, target string, d double")
    dense, tables = ([tuple(r) for r in cluster.linkage_table(distances, method, max_nodes=m).orderBy("step").collect()] for m in (100, 5))
    assert [r[:3] + r[4:] for r in dense] == [r[:3] + r[4:] for r in tables] and np.allclose([r[3] for r in dense], [r[3] for r in tables])
    by_matrix, by_tables = ({r["node_id"]: r["cluster"] for r in cluster.cluster_nodes(distances, 4, method, max_nodes=m).collect()} for m in (100, 5))
    assert by_matrix == by_tables
    with pytest.raises(ValueError):
        cluster.cluster_nodes(distances.filter("source != 'n03' OR target != 'n05'").filter("source != 'n05' OR target != 'n03'"), 4, max_nodes=5)


def test_weights_between_clusters():
    rng = np.random.default_rng(2)
    w = rng.normal(size=(12, 12))
    w = np.triu(w * (rng.random((12, 12)) < 0.5), 1)
    u, v = np.nonzero(w)
    labels = rng.integers(0, 4, (5, 12))
    for label, got in zip(labels, cluster.between_clusters(u, v, w[u, v], labels, 4, cells=12), strict=True):
        whole = w + w.T
        assert np.allclose(got, [[whole[np.ix_(label == a, label == b)].sum() for b in range(4)] for a in range(4)])


def test_permutation_parts(spark, edges):
    nodes = [r["node_id"] for r in graph.nodes_of(edges).orderBy("node_id").collect()]
    clusters = spark.createDataFrame([(n, i % 3 + 1) for i, n in enumerate(nodes)], "node_id string, cluster int")
    one = cluster.permutation_test(edges, clusters, permutations=40, blocks=1).orderBy("cluster_i", "cluster_j").collect()
    many = cluster.permutation_test(edges, clusters, permutations=40, part_edges=3, blocks=7).orderBy("cluster_i", "cluster_j").collect()
    assert [(r[0], r[1], r[3]) for r in one] == [(r[0], r[1], r[3]) for r in many]
    assert all(a[2] == pytest.approx(b[2]) for a, b in zip(one, many, strict=True))


def test_relaxed_paths_stop_by_rows(spark):
    ring = [(f"k{i:02d}", f"k{(i + 1) % 12:02d}", 0.9 - 1e-13 * i) for i in range(12)]
    e = edges_of(spark, ring)
    a, b = square(graph.shortest_paths(e)), square(graph.shortest_paths(e, max_bytes=0))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-15) for k in a)


def test_jaccard_and_permutation(spark):
    e = edges_of(spark, [("a", "c", 0.5), ("a", "d", -0.5), ("b", "e", 0.25), ("a", "b", 0.9)])
    clusters = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 2), ("e", 3), ("z", 4)], "node_id string, cluster int")
    got = {(r["cluster_i"], r["cluster_j"]): r["similarity"] for r in cluster.cluster_jaccard(e, clusters).collect()}
    assert got == {(1, 2): 0.0, (1, 3): 1.0, (1, 4): 0.0, (2, 3): 0.0, (2, 4): 0.0, (3, 4): 0.0}
    tested = cluster.permutation_test(e, clusters, permutations=50, seed=1).collect()
    again = cluster.permutation_test(e, clusters, permutations=50, seed=1).collect()
    assert tested == again and all(0 < r["p"] <= 1 for r in tested)
    assert all(r["similarity"] == pytest.approx(got[r["cluster_i"], r["cluster_j"]]) for r in tested)


def test_tsne_separates():
    d = np.full((12, 12), 10.0)
    d[:6, :6] = d[6:, 6:] = 1.0
    np.fill_diagonal(d, 0)
    y = cluster.tsne(d, 4)
    near = np.linalg.norm(y[:6] - y[:6].mean(0), axis=1).max()
    assert np.isfinite(y).all() and np.linalg.norm(y[:6].mean(0) - y[6:].mean(0)) > near
    assert (cluster.tsne(d, 4) == y).all()


def test_ora_exact(spark):
    from math import comb

    sets = spark.createDataFrame([("s1", "one", ["C1", "C2", "C3", "C3"]), ("s2", "two", ["C9"]), ("s3", "three", ["C4", "C5", None])], "set_id string, set_name string, members array<string>")
    background = spark.createDataFrame([(f"C{i}",) for i in range(1, 9)], "member_id string")
    hits = spark.createDataFrame([(1, "C1"), (1, "C2"), (1, "C4"), (1, "C1"), (1, "X"), (2, "C8")], "cluster int, member_id string")
    got = {(r["cluster"], r["set_id"]): r for r in enrich.over_representation(hits, sets, background).collect()}
    assert set(got) == {(1, "s1"), (1, "s3"), (2, "s1"), (2, "s3")}
    want = sum(comb(3, i) * comb(5, 3 - i) for i in (2, 3)) / comb(8, 3)
    assert got[1, "s1"]["pval"] == pytest.approx(want) and got[1, "s1"]["hit_ids"] == ["C1", "C2"]
    assert got[2, "s1"]["pval"] == 1.0 and got[2, "s1"]["hit_ids"] == []
    assert all(r["padj"] >= r["pval"] - 1e-12 for r in got.values())


def test_gsea(spark):
    scores = spark.createDataFrame([(f"C{i}", 10.0 - i) for i in range(10)] + [("C0", 10.0), ("C99", None)], "member_id string, score double")
    sets = spark.createDataFrame([("top", "t", ["C0", "C1"]), ("low", "l", ["C8", "C9"]), ("one", "o", ["C3"])], "set_id string, set_name string, members array<string>")
    got = {r["set_id"]: r for r in enrich.ranked_enrichment(scores, sets, permutations=200).collect()}
    assert set(got) == {"top", "low"} and got["top"]["es"] == pytest.approx(1.0) and got["low"]["es"] == pytest.approx(-1.0)
    assert got["top"]["nes"] > 0 > got["low"]["nes"] and 0 <= got["top"]["q"] <= 1
    assert got["top"]["lead"] == ["C0", "C1"] and got["low"]["lead"] == ["C8", "C9"] and got["low"]["set_name"] == "l"
    assert enrich.ranked_enrichment(scores.limit(0), sets, permutations=5).count() == 0


def test_null_scores_against_a_plain_version(spark):
    """Random sets drawn as the operator draws them, scored by the running sum over the whole ranking."""
    rng = np.random.default_rng(2)
    values = np.round(rng.normal(size=300), 2)
    scores = spark.createDataFrame([(f"C{i:03d}", float(v)) for i, v in enumerate(values)], "member_id string, score double").repartition(7)
    sets = spark.createDataFrame([(f"s{k}", "x", [f"C{i:03d}" for i in rng.choice(300, n, replace=False)]) for k, n in enumerate((4, 4, 30))], "set_id string, set_name string, members array<string>")
    order = sorted(range(300), key=lambda i: (-values[i], f"C{i:03d}"))
    ranked = {r["member_id"]: r["rank"] for r in enrich.ranks(scores).collect()}
    assert [ranked[f"C{i:03d}"] for i in order] == list(range(1, 301))

    def score(members):
        inside = np.array([i in members for i in order])
        weight = np.where(inside, np.abs(values[order]), 0)
        run = np.cumsum(weight / weight.sum() - ~inside / (300 - inside.sum()))
        return min(run.min(), 0.0) if abs(run.min()) > abs(run.max()) else run.max()

    null = {}
    for size in (4, 30):
        draws = np.random.default_rng([9, size])
        null[size] = [score({order[a] for a in draws.choice(300, size, replace=False)}) for _ in range(40)]
    found = {r["set_id"]: r for r in enrich.ranked_enrichment(scores, sets, permutations=40, seed=9).collect()}
    for r in sets.collect():
        es = score({int(m[1:]) for m in r["members"]})
        same = [x for x in null[len(r["members"])] if (x >= 0) == (es >= 0)]
        got = found[r["set_id"]]
        assert got["es"] == pytest.approx(es) and got["nes"] == pytest.approx(es / abs(np.mean(same)))
        assert got["p"] == pytest.approx(np.mean([abs(x) >= abs(es) for x in same]))


def test_ranking_and_null_have_no_single_task(spark):
    scores = spark.range(1000).select(F.col("id").cast("string").alias("member_id"), F.rand(1).alias("score"))
    sets = spark.createDataFrame([("s", "x", ["1", "2", "3"])], "set_id string, set_name string, members array<string>")
    plan = enrich.enrichment_scores(scores, sets, prefix=None)._jdf.queryExecution().executedPlan().toString()
    single = plan.split("Exchange SinglePartition")
    assert len(single) == 2 and "HashAggregate(keys=[_part" in single[1].splitlines()[1]  # a row per partition


def test_discovery_rate():
    import pandas as pd

    rng = np.random.default_rng(1)
    nulls = pd.DataFrame({"sets": [2, 1], "null": [list(rng.normal(size=30)), list(rng.normal(size=30) * 3)]})
    pooled, nes = enrich._null_shares(nulls), np.array([0.4, -0.9, 2.5])
    normal = [(x / np.mean([abs(y) for y in null if (y >= 0) == (x >= 0)]), k) for k, null in zip(nulls["sets"], nulls["null"], strict=True) for x in null]
    want = [sum(k for x, k in normal if x * v >= 0 and abs(x) >= abs(v)) / sum(k for x, k in normal if x * v >= 0) for v in nes]
    assert np.allclose(enrich._share_beyond(pooled, nes), want)


def test_background(spark):
    hits = spark.createDataFrame([(1, "C1"), (1, "X"), (1, "X"), (2, None)], "cluster int, member_id string")
    known = spark.createDataFrame([("C1",), (None,)], "member_id string")
    assert {tuple(r) for r in enrich.outside_background(hits.filter("member_id IS NOT NULL"), known).collect()} == {(1, "X")}


def test_large_background_tail(spark):
    n = 200_000
    df = spark.createDataFrame([(3, 50, 100, n), (0, 5, 5, 10), (60, 60, 60, n)], "k long, m long, d long, n long")
    got = [r["p"] for r in df.select(enrich.hypergeometric_tail(*(F.col(c) for c in "kmdn")).alias("p")).collect()]
    from math import comb

    assert got[0] == pytest.approx(float(sum(comb(50, i) * comb(n - 50, 100 - i) for i in range(3, 51)) / comb(n, 100)), rel=1e-6) and got[1] == 1.0 and 0 <= got[2] < 1e-100


def test_existing_studies_are_skipped_before_the_work(spark, tmp_path):
    rows = [(s, str(i), f, float(i * k % 7)) for s in ("s1", "s2") for i in range(6) for k, f in enumerate(("a", "b", "c"), 2)]
    obs, path = spark.createDataFrame(rows, "study_id string, sample_id string, feature string, value double"), str(tmp_path / "corr")
    steps.correlate_missing(obs.filter("study_id = 's1'"), path, ("pearson",), min_unique=None)
    assert {r["study_id"] for r in writers.without_correlated(obs, path, "pearson").collect()} == {"s2"} and writers.without_correlated(obs, path, "kendall").count() == 36
    steps.correlate_missing(obs, path, ("pearson", "kendall"), min_unique=None)
    assert spark.read.parquet(path).groupBy("method", "study_id").count().count() == 4


def test_files(spark, tmp_path, edges):
    folder = str(tmp_path / "net")
    writers.write_network(edges, graph.nodes_of(edges), graph.direct_distances(edges), folder)
    e, n, d = readers.read_network(spark, folder)
    assert e.count() == edges.count() and d.count() == n.count() ** 2
    corr = spark.createDataFrame([("a", "b", "pearson", 0.1, 0.5, 5.0, "s1"), ("a", "b", "pearson", 0.2, 0.5, 5.0, "s2")], "feature_1 string, feature_2 string, method string, corr double, p_value double, n double, study_id string")
    path = str(tmp_path / "corr")
    writers.write_correlations(corr.filter("study_id = 's1'"), path)
    writers.write_correlations(corr.withColumn("corr", F.lit(0.9)), path)
    assert {r["study_id"]: r["corr"] for r in spark.read.parquet(path).collect()} == {"s1": 0.1, "s2": 0.9}
    longs = str(tmp_path / "kendall")
    corr.withColumn("n", F.col("n").cast("long")).write.parquet(longs)
    writers.write_sorted(corr, str(tmp_path / "sorted"))
    assert readers.read_correlations(spark, longs, str(tmp_path / "sorted")).count() == 4
    empty = spark.createDataFrame([], "cluster int, set_id string, hit_ids array<string>")
    writers.write_enrichment(empty, str(tmp_path / "enrich"))
    assert spark.read.text(str(tmp_path / "enrich")).first()[0] == "cluster,set_id,hit_ids"
    (tmp_path / "sets.tsv").write_text("s1\tone\tC1\tC2\t\ns2\ttwo\n")
    assert {r["set_id"]: list(r["members"]) for r in readers.read_sets(spark, str(tmp_path / "sets.tsv")).collect()} == {"s1": ["C1", "C2"], "s2": []}


def test_chain_and_pages(spark, tmp_path):
    from pairweave.plans import fixtures as fx

    obs = fx.obs_vectors(spark, "/root/testdata/sf0.001")
    corr = steps.correlate_studies(obs, ("pearson",), transform=None)
    made = steps.network(steps.pool_method(corr), fx.annotation(spark), ("signed", "posonly"))
    distances = graph.restrict_connected(made["distances_posonly"], graph.positive_edges(made["edges"]), "largest")
    out = steps.cluster_and_enrich(made["edges"], distances, fx.xref(spark), fx.sets(spark), n_clusters=4, threshold=1.1, permutations=20)
    assert out["clusters"].select("cluster").distinct().count() <= 4 and out["top_sets"].count() > 0
    assert out["abundance"].filter("abundance < 0 OR abundance > 1").count() == 0
    positions = cluster.layout(made["distances_signed"], seed=0)
    page = report.network_html(report.viewer_nodes(made["edges"], fx.annotation(spark)), made["edges"], positions)
    writers.write_page(spark, page, str(tmp_path / "net.html"))
    assert (tmp_path / "net.html").read_text() == page and page.count("canvas") >= 2 and "unknown" in page
    jac = cluster.cluster_jaccard(made["edges"], out["clusters"])
    page = report.cluster_html(cluster.cluster_sizes(out["clusters"]), report.cluster_edges(jac), cluster.cluster_layout(jac), out["abundance"])
    assert "<table>" in page
    assert report.is_categorical(made["edges"], "source") and not report.is_categorical(made["edges"], "r", 3)
    assert report.pivot_matrix(jac, "cluster_i", "cluster_j", "similarity").count() >= 1


def test_stream(spark, tmp_path):
    from pairweave.plans import fixtures as fx
    from pairweave.streaming.incremental import follow_studies

    fx.obs_vectors(spark, "/root/testdata/sf0.001").filter("study_id IN ('ST0', 'ST1')").coalesce(1).write.parquet(str(tmp_path / "in"))
    follow_studies(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), methods=("pearson",), transform=None).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2 * 2016


@pytest.mark.parametrize("links", [0, 1, 30, 60, 200])
def test_components_as_arrays_and_as_tables(spark, links):
    rng = np.random.default_rng(links)
    ids = [f"n{k:03d}" for k in rng.permutation(80)]
    pairs = sorted({tuple(sorted(rng.choice(80, 2, replace=False))) for _ in range(links)} | ({(a, a + 1) for a in range(60, 79)} if links == 30 else set()))
    edges = spark.createDataFrame([(*sorted((ids[a], ids[b])), 0.5) for a, b in pairs], "source string, target string, r double")
    found = [{r["node_id"]: r["component"] for r in graph.components(edges, m).collect()} for m in (1 << 20, -1)]
    assert found[0] == found[1] and len(found[0]) == len({ids[x] for p in pairs for x in p})
    for a, b in pairs:
        assert found[0][ids[a]] == found[0][ids[b]] <= min(ids[a], ids[b])


def test_blocks_of_sources_against_dijkstra(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    u = rng.integers(0, 400, 700)
    v = rng.integers(0, 400, 700)
    keep = u != v
    chain = np.arange(400, 700)  # a path of 300 links apart from the rest: more rounds than relaxing takes
    table = pa.table({"source": [f"n{k:04d}" for k in [*u[keep], *chain[:-1]]], "target": [f"n{k:04d}" for k in [*v[keep], *chain[1:]]], "w": np.round(rng.random(int(keep.sum()) + 299), 3)})
    near = graph.Adjacency.of(table)
    assert near.lengths(np.array([len(near.names) - 1])) is None
    monkeypatch.setattr(graph, "CELLS", 20 * len(near.ends))
    sources = rng.permutation(len(near.names))
    seen = 0
    for source, to, d in near.rows_of(sources):
        want = dict(zip(*(x.tolist() for x in near.paths(source)), strict=True))
        assert dict(zip(to.tolist(), d.tolist(), strict=True)) == want
        seen += 1
    assert seen == len(sources)
    assert graph.Adjacency.of(table.slice(0, 0)).lengths(np.zeros(0, np.int64)).shape == (0, 0)
