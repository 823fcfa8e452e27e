import duckdb
import pytest

from pairweave.llm.compaction import OP8_SQL, Conflict, Shard, ShardStore, merge_runs, op8_sharding, shard_corpus


def test_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = sorted(con.sql(OP8_SQL).fetchall())
    assert sorted(tuple(r) for r in op8_sharding(spark, folder).select("doc_id", "n_bytes", "text_sha256", "tiered", "versioned", "merged").collect()) == want


def test_merges_are_seen(spark, monkeypatch):
    """Without compaction the query's rows differ from the SQL."""
    monkeypatch.setattr(ShardStore, "compact", lambda store, *_: store.manifest())
    rows = op8_sharding(spark, "/root/testdata/sf0.001").select("tiered", "merged").distinct().collect()
    assert [tuple(r) for r in rows] == [(False, False)]


def test_rows_survive_merges(spark, tmp_path):
    rows = [(i % 90, f"text {i}" if i % 10 else None, i) for i in range(400)] + [(None, None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard long").withColumnRenamed("shard", "extra").repartition(8)
    store = shard_corpus(docs, str(tmp_path / "store"), arrivals=3, target_bytes=12_000, rows_per_shard=10)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r)[:3] for r in store.read().collect()), key=key) == sorted(rows, key=key)
    versions = store.versions()
    assert len(versions) > 3 and len(store.manifest().shards) < len(store.manifest(versions[0]).shards) * 3
    assert store.read(versions[0]).count() < len(rows)
    assert merge_runs(store.manifest().shards, 12_000, 4) == []


def test_one_writer_wins(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path / "store"))
    seen = store.append(spark.range(5).selectExpr("id AS doc_id", "'a' AS text"))
    store.commit(seen, seen.schema, seen.shards)
    with pytest.raises(Conflict):
        store.commit(seen, seen.schema, [])
    assert store.manifest().version == 2 and store.read().count() == 5
    assert store.append(spark.range(5, 8).selectExpr("id AS doc_id", "'b' AS text")).version == 3
    assert store.read().count() == 8


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert shard_corpus(docs, str(tmp_path / "store")).read().count() == 0


def test_tiers():
    small, middle = [Shard(f"a{i}", 1, 100 + i) for i in range(9)], [Shard(f"b{i}", 1, 30_000) for i in range(3)]
    runs = merge_runs(small + middle + [Shard("c", 1, 900_000)], 1_000_000, 4)
    assert runs == [small]
    assert [len(r) for r in merge_runs(small, 450, 4)] == [4, 4]


def test_manifest_and_files_agree(spark, tmp_path):
    store = shard_corpus(spark.range(600).selectExpr("id AS doc_id", "repeat('x', int(id)) AS text").repartition(6), str(tmp_path / "store"), arrivals=3, target_bytes=4000, rows_per_shard=20)
    seen = store.manifest()
    held = {r["shard"]: (r["n"], r["b"], r["v"]) for r in store.read().groupBy("shard").agg({"doc_id": "count", "shard_bytes": "max", "version": "max"}).toDF("shard", "n", "b", "v").select("shard", "n", "b", "v").collect()}
    listed = {s.name: s for s in seen.shards}
    assert held.keys() == listed.keys() and sum(s.rows for s in seen.shards) == 600
    for name, s in listed.items():
        n = store.read().filter(f"shard = '{name}'").count()
        assert n == s.rows
    assert store.shards().filter(f"version = {seen.version}").count() == len(listed) and seen.version == store.versions()[-1]


def test_vacuum(spark, tmp_path):
    store = shard_corpus(spark.range(300).selectExpr("id AS doc_id", "'t' AS text").repartition(4), str(tmp_path / "store"), arrivals=2, target_bytes=1 << 20, rows_per_shard=10)
    before, shards = sorted(r["doc_id"] for r in store.read().collect()), len(store.manifest().shards)
    assert len(store.versions()) > 2 and store.vacuum() > 0 and len(store.versions()) == 1
    assert sorted(r["doc_id"] for r in store.read().collect()) == before and len(list((tmp_path / "store" / "data").rglob("*.parquet"))) == shards and store.vacuum() == 0


def test_clashing_and_long(spark, tmp_path):
    rows = [(i, "y" * (200_000 if i == 3 else i), "own") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _pairweave_bin string").repartition(8)
    store = shard_corpus(docs, str(tmp_path / "store"), rows_per_shard=2, target_bytes=1 << 20)
    assert sorted(tuple(r)[:3] for r in store.read().collect()) == rows and len(store.versions()) > 2
