"""Answers of a compound service: storage, records, requests."""

from urllib.parse import quote

from pyspark.sql import functions as F

from pairweave.sources import responses as rs

KIND = "kind string, id string, part string, status int, body string"


def test_quoted(spark):
    names = ["PC 18:2_19:0", "a/b;c:d", "x*~+%", "é β", "(R)-x.y_z", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    rows = df.select("n", rs.quoted(F.col("n")).alias("a"), rs.quoted(F.col("n"), ":;/").alias("b")).collect()
    assert [(r["a"], r["b"]) for r in rows] == [(quote(n, safe=""), quote(n, safe=":;/")) for n in names]
    paths = [r["path"] for r in rs.match_requests(spark.createDataFrame([("Cer 18:2;O2/16:0",), (None,)], "ref_name string")).collect()]
    assert paths == ["match/Cer%2018:2;O2/16:0/name"]


def test_records(spark):
    rows = [
        ("RM0000001", "all", 200, '{"refmet_id":"RM0000001","name":"a","formula":"C","pubchem_cid":"7"}'), ("RM0000001", "kegg_id", 200, '{"kegg_id":"C1"}'), ("RM0000001", "smiles", None, "[]"),
        ("b c", "all", 500, None), ("b c", "all", 200, '{"refmet_id":"RM0000002"}'), ("b c", "kegg_id", 200, '{"kegg_id":" "}'), ("b c", "smiles", 200, '{"smiles":"N"}'),
        ("bad", "all", 404, ""), ("bad", "kegg_id", 200, "{}"), ("none", "all", 200, "[]"), ("half", "all", 200, '{"refmet_id":"RM0000003"}'), ("half", "smiles", 503, None), ("only", "smiles", 200, "{}"),
    ]
    records, failed = rs.read_compounds(spark.createDataFrame([("compound", *r) for r in rows], KIND))
    got = {r["query"]: r for r in records.collect()}
    assert set(got) == {"RM0000001", "b c"} and got["RM0000001"]["id_type"] == "refmet_id" and got["b c"]["id_type"] == "name"
    assert (got["RM0000001"]["kegg_id"], got["RM0000001"]["smiles"], got["RM0000001"]["pubchem_cid"], got["b c"]["smiles"]) == ("C1", None, "7", "N")
    assert {r["query"]: r["reason"] for r in failed.collect()} == {"bad": "status 404", "none": "no entry", "half": "no answer: kegg_id, smiles", "only": "no answer: all, kegg_id"}
    assert {tuple(r) for r in rs.compound_xref(records).collect()} == {("RM0000001", "C1"), ("RM0000002", None)}


def test_storage_prunes_and_replaces(spark, tmp_path):
    path = f"file://{tmp_path}/answers"
    frame = lambda rows: spark.createDataFrame(rows, KIND)
    rs.write_answers(frame([("compound", f"RM{i:07d}", "all", 200, str(i)) for i in range(200)] + [("match", "x", "name", 404, None)]), path, 16)
    rs.write_answers(frame([("compound", "RM0000003", "all", 503, "worse"), ("compound", "RM0000003", "all", 200, "new"), ("compound", "RM0000900", "all", 200, "more")]), path, 16)
    whole = {r["id"]: r["body"] for r in rs.read_answers(spark, path, "compound").collect()}
    assert len(whole) == 201 and whole["RM0000003"] == "new" and whole["RM0000004"] == "4"
    some = rs.read_answers(spark, path, "compound", ["RM0000003", "RM0000900", "no"], 16)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "kind#" in plan.split("PartitionFilters")[1].split("]")[0] and "bucket#" in plan.split("PartitionFilters")[1]
    assert {r["body"] for r in some.collect()} == {"new", "more"}
    files = len(some.inputFiles()), len(rs.read_answers(spark, path, "compound").inputFiles())
    assert some.count() == 2 and files[1] >= 16
    wanted = rs.read_answers(spark, path, "compound", spark.createDataFrame([("RM0000004",), ("RM0000004",)], "id string"), 16)
    assert [r["body"] for r in wanted.collect()] == ["4"]
    assert rs.read_answers(spark, path, "match").count() == 1
