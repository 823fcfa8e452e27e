import duckdb
import pytest
from pyspark.sql import functions as F

from pairweave.llm.mixing import OP3_SQL, mix, mixed_documents, op3_mix_sources, share_targets


def against_sql(rows, got):
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    names = ["doc_id", "size", "source_size", "target", "taken", "finish"]
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted((tuple(r[n] for n in names) for r in con.sql(OP3_SQL).df().astype(object).where(lambda d: d.notna(), None).to_dict("records")), key=key)
    assert sorted((tuple(r[n] for n in names) for r in got), key=key) == [tuple(w) for w in want]


@pytest.mark.parametrize(("digits", "few"), [(2, 1), (3, 100_000), (0, 5)])
def test_against_sql(spark, digits, few):
    rows = [(i, "w " * (i * 7 % 23), ["a", "b", "c", None, "é", "tiny"][0 if i % 3 == 0 else i % 6]) for i in range(200)] + [(900, None, "a"), (901, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    against_sql(rows, mix(docs, digits=digits, few=few).collect())


def test_driver_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source").collect()]
    got = op3_mix_sources(spark, "/root/testdata/sf0.001").collect()
    against_sql(rows, got)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    largest = max(r["size"] for r in got)
    assert abs(sum(r["taken"] for r in got) - sum(r["size"] for r in got)) <= largest


def test_targets(spark):
    sizes = spark.createDataFrame([(False, "a", 10), (False, "b", 1000), (True, "", 100)], "_absent boolean, _source string, source_size long")
    got = {r["_source"]: r["target"] for r in share_targets(sizes).collect()}
    assert got["a"] == 30 and got[""] == 300 and got["b"] == pytest.approx(1110 - 330)


def test_documents_repeat(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", 1), (2, "d " * 200, "t", 2)], "doc_id long, text string, source string, copies int")
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    assert {(r["doc_id"], r["copies"]) for r in out.collect()} <= {(1, 1), (2, 2)}  # the input's own column
    assert out.groupBy("doc_id").count().filter("count > 3").isEmpty()
    assert mixed_documents(docs.filter(F.lit(False))).count() == 0


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "s")] * 5 + [(None, "q", None)], "doc_id long, text string, source string")
    assert mix(docs).count() == 6


def test_written_in_order(spark):
    rows = [(i, "w " * (i * 7 % 23), "abc"[i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("finish", F.lit("own"))
    times = {r["doc_id"]: r for r in mix(docs.drop("finish")).collect()}
    out = [r for part in mixed_documents(docs, few=3).rdd.glom().collect() for r in part]
    assert {r["finish"] for r in out} == {"own"} and len(out) == sum(r["copies"] for r in times.values())
    seen, order = {}, []
    for r in out:
        k = seen[r["doc_id"]] = seen.get(r["doc_id"], -1) + 1
        t = times[r["doc_id"]]
        order.append(t["finish"] + k * t["source_size"] / t["target"])
    assert all(a <= b + 1e-9 for a, b in zip(order, order[1:]))


def test_one_source_of_ties(spark):
    rows = [(i, "a b", "s") for i in range(500)] + [(1000, "word " * 40_000, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    against_sql(rows, mix(docs, few=1, digits=1).collect())
