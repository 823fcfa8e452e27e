"""Both jobs: twins of their queries, reruns, growing input, stops on the way, command lines."""

import json
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F
from test_catalogue import rows

from jobs import queries, sample_feed, term_network
from jobs.common import settings

DATA, TOP = "/root/testdata/sf0.001", os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_twin(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    got, want = rows(queries.QUERIES[name](spark, DATA).toPandas()), rows(con.sql(queries.ORACLES[name]).df())
    assert len(got) == len(want) > 100
    for a, b in zip(got, want, strict=True):
        assert all(u == v or (isinstance(u, float) and abs(u - v) < 2e-4) for u, v in zip(a, b, strict=True)), (a, b)


def files(folder):
    """Every file of a table with the time it was written."""
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def table(spark, path):
    df = spark.read.parquet(f"file://{path}")
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*sorted(c for c in df.columns if c != "through")).collect()), key=str)


KIND = "doc_id long, text string, source string, n_chars long, feature string"


def test_terms(spark):
    docs = spark.createDataFrame([(1, "Red red, BLUE-naïve 12 x", "s", 0, "own"), (1, "red", "s", 0, ""), (2, None, "s", 0, ""), (3, "", "t", 0, ""), (4, "été", None, 0, "")], KIND)
    got = {(r["sample_id"], r["study_id"], r["feature"], r["k"], r["words"]) for r in term_network.term_counts(docs, settings("term_network")).collect()}
    assert got == {("1", "s", "red", 2, 5), ("1", "s", "blue", 1, 5), ("1", "s", "naïve", 1, 5), ("1", "s", "x", 1, 5), ("1", "s", "red", 1, 1), ("4", None, "été", 1, 1)}


def test_term_network_replaces_its_output(spark, tmp_path):
    docs, out, config = f"file://{tmp_path}/docs", f"file://{tmp_path}/out", settings("term_network", min_share=0.2)
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    all_docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 50 != 3, F.concat(F.lit("s/"), (F.col("doc_id") % 5).cast("string"))))
    names = ("terms", "correlations", "pooled", "edges", "nodes")
    all_docs.write.parquet(docs)
    term_network.run(spark, docs, out, config)
    first = {x: table(spark, tmp_path / "out" / x) for x in names}
    assert all(first.values()) and {r.split("=")[1] for r in os.listdir(tmp_path / "out/correlations/method=pearson") if "=" in r} == {f"s%2F{k}" for k in range(5)}
    term_network.run(spark, docs, out, config)
    assert {x: table(spark, tmp_path / "out" / x) for x in names} == first
    all_docs.filter("source != 's/2'").write.mode("overwrite").parquet(docs)  # a source that is gone leaves nothing behind
    term_network.run(spark, docs, out, config)
    assert len(os.listdir(tmp_path / "out/correlations/method=pearson")) == 4
    assert {r["n_studies"] for r in spark.read.parquet(f"{out}/pooled").collect()} == {4}
    spark.createDataFrame([], KIND).write.mode("overwrite").parquet(docs)
    term_network.run(spark, docs, out, config)
    assert spark.read.parquet(f"{out}/pooled").count() == 0 == spark.read.parquet(f"{out}/nodes").count()
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == mode


@pytest.fixture
def arrivals(spark, tmp_path):
    """Copies of the vectors in three parts, and a function that lets one of them arrive."""
    whole = spark.read.parquet(f"{DATA}/embeddings.parquet").withColumn("label", F.when(F.col("vec_id") % 97 != 5, F.col("label") % 6))
    parts = [whole.filter("vec_id < 200"), whole.filter("vec_id >= 200 AND vec_id < 350 AND label % 6 < 4"), whole.filter("vec_id >= 350 AND label < 5").union(whole.filter("vec_id < 60"))]
    (tmp_path / "in").mkdir()

    def arrive(k):
        parts[k].coalesce(1).write.parquet(f"file://{tmp_path}/part{k}")
        (one,) = [f for f in os.listdir(tmp_path / f"part{k}") if f.endswith(".parquet")]
        os.rename(tmp_path / f"part{k}" / one, tmp_path / "in" / f"{k}-{one}")

    return arrive


OUTPUT = ("correlations", "pooled")


def test_feed_of_growing_input(spark, tmp_path, arrivals, monkeypatch):
    at = lambda name: (f"file://{tmp_path}/in", f"file://{tmp_path}/{name}", f"file://{tmp_path}/{name}-checkpoint", settings("sample_feed", buckets=8))
    arrivals(0)
    sample_feed.run(spark, *at("grown"))
    first = files(tmp_path / "grown")
    sample_feed.run(spark, *at("grown"))  # nothing new: nothing is written
    assert files(tmp_path / "grown") == first

    arrivals(1)
    sample_feed.run(spark, *at("grown"))
    second = files(tmp_path / "grown")
    untouched = [f for f in first if "correlations/study_id=ST4" in f or "correlations/study_id=ST5" in f or "/batch=0/" in f]
    assert len(untouched) >= 4 and all(second[f] == first[f] for f in untouched)  # its studies have no new samples; old batches stay
    assert not [f for f in first if "correlations/study_id=ST1" in f and f in second]

    arrivals(2)  # with samples that have been counted
    put, lost = sample_feed._put, []

    def stops(df, path, by):
        if path.endswith("correlations"):
            lost.append(path)
            raise OSError("stopped")
        put(df, path, by)

    monkeypatch.setattr(sample_feed, "_put", stops)
    with pytest.raises(OSError):
        sample_feed.run(spark, *at("grown"))
    monkeypatch.setattr(sample_feed, "_put", put)
    sample_feed.run(spark, *at("grown"))
    sample_feed.run(spark, *at("whole"))
    assert lost and {x: table(spark, tmp_path / "grown" / x) for x in OUTPUT} == {x: table(spark, tmp_path / "whole" / x) for x in OUTPUT}
    seen = spark.read.parquet(f"file://{tmp_path}/grown/samples")
    assert seen.count() == seen.select("sample_id").distinct().count() and {r["batch"] for r in seen.select("batch").distinct().collect()} == {0, 1, 2}

    with pytest.raises(ValueError, match="checkpoint"):
        sample_feed.run(spark, *at("grown")[:2], f"file://{tmp_path}/another", settings("sample_feed"))


def test_a_batch_that_is_repeated(spark, tmp_path):
    out, config = f"file://{tmp_path}/out", settings("sample_feed", study_prefix="s", values="v", sample="id", study="k")
    frame = lambda rows: spark.createDataFrame(rows, "id long, k string, v array<double>, batch long, value double")
    a = [(i, "x", [float(i % 3), float(i % 5), None if i % 4 else float("nan")], 9, 0.0) for i in range(20)]
    odd = [(None, "x", [1.0], 9, 0.0), (50, None, [1.0], 9, 0.0), (51, "x", None, 9, 0.0), (3, "x", [9.0, 9.0], 9, 0.0), (60, "y", [], 9, 0.0), (3, "z", [1.0, 2.0], 9, 0.0)]
    for rows_, number in ((a + odd, 0), (a[:5] + [(70, "x", [1.0, 2.0, 3.0], 9, 0.0)], 1)):
        for _ in range(2):
            sample_feed.take_batch(frame(rows_), number, out, config)
    sample_feed.refresh(spark, out, config)
    got = {(r["feature_1"], r["feature_2"]): (r["n"], r["through"]) for r in spark.read.parquet(f"{out}/correlations").filter("study_id = 'sx'").collect()}
    assert spark.read.parquet(f"{out}/correlations").filter("study_id = 'sz'").first()["n"] == 1  # another study's sample of the same id
    assert got == {("RM0000001", "RM0000002"): (21, 1), ("RM0000001", "RM0000003"): (1, 1), ("RM0000002", "RM0000003"): (1, 1)}
    assert spark.read.parquet(f"{out}/samples").groupBy("batch").count().orderBy("batch").collect() == [(0, 22), (1, 1)]


def test_empty_input(spark, tmp_path):
    spark.read.parquet(f"{DATA}/embeddings.parquet").limit(0).write.parquet(f"file://{tmp_path}/in")
    sample_feed.run(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/c", settings("sample_feed"))
    assert not os.path.exists(tmp_path / "out/pooled") or spark.read.parquet(f"file://{tmp_path}/out/pooled").count() == 0


def test_settings(tmp_path):
    (tmp_path / "own.json").write_text(json.dumps({"min_share": 0.5}))
    assert settings("term_network", str(tmp_path / "own.json"))["min_share"] == 0.5
    with pytest.raises(ValueError, match="shares"):
        settings("term_network", shares=1)


@pytest.mark.parametrize(("name", "source", "more"), [("term_network", "documents", []), ("sample_feed", "embeddings", ["checkpoint"])])
def test_command_line(tmp_path, name, source, more):
    (tmp_path / "own.json").write_text(json.dumps({"min_share": 0.3} if name == "term_network" else {"buckets": 3}))
    line = [sys.executable, "-m", f"jobs.{name}", f"{DATA}/{source}.parquet", str(tmp_path / "out"), *(str(tmp_path / x) for x in more)]
    done = subprocess.run([*line, "--config", str(tmp_path / "own.json"), "--scratch", str(tmp_path / "scratch"), "--master", "local[2]"], cwd=TOP, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read" in done.stderr and "wrote" in done.stderr and len(files(tmp_path / "out/pooled")) > 0
