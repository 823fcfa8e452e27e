"""Each stage of the pipeline on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairweave.llm.common import materialize
from pairweave.llm.mixing import mix

LONG = "the house and the garden " * 20_000
ROWS = [
    (1, "the house and the garden with water in the morning", "en", "a", 1),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, " \n\t ", None, "b", 4),
    (5, "12 34", "en", None, 5),
    (6, LONG, "en", "b", 6),
    (7, "das haus und der garten mit dem wasser", "de", "a", 7),
    (7, "das haus und der garten mit dem wasser", "de", "a", 7),
    (None, "the water and the morning of the house", None, None, None),
    (None, None, None, None, None),
    (8, "benchmark question about seven wonders of the ancient world and more words here", "en", "c", 8),
]
OWN = ["lang_pred", "score", "confidence", "n_shingles", "component_id", "kept", "size", "target", "taken", "copies", "finish", "contaminated", "n_hit", "shard", "shard_bytes", "version", "_place", "_key", "_source"]
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('cases')}"
    items = [("i1", "Question about seven wonders of the ancient world and more words"), ("i2", None), (None, "completely other words that occur in no document of this small table"), ("i3", "")]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return materialize(df.withColumns({c: F.concat(F.lit("own "), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))) for c in OWN}))


KEPT = {
    "language_id": [None, 1, 6, 7, 7, 8],  # without letters: 2 to 5 and a null text
    "near_dedup": [None, None, 1, 2, 3, 4, 5, 6, 7, 8],  # one row of identifier 7; rows without identifier or words are in no group
    "decontaminate": [None, None, 1, 2, 3, 4, 5, 6, 7, 7],  # item i1 is in 8
}


@pytest.mark.parametrize("name", [n for n in STAGES if n != "sharding"])
def test_stage(spark, docs, folder, name):
    out = STAGES[name](spark, docs, folder)
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(r[c] == f"own {'?' if r['doc_id'] is None else r['doc_id']}" for r in rows for c in OWN)  # columns of the input stay as they are
    got = sorted((r["doc_id"] for r in rows), key=lambda x: (x is not None, x))
    if name in KEPT:
        assert got == KEPT[name]
    else:  # texts of size 0 aren't taken; the long one is most of its source
        assert set(got) <= {None, 1, 5, 6, 7, 8} and all(r["text"] and r["text"].split() for r in rows)
    assert {r["text"] for r in rows if r["doc_id"] == 6} <= {LONG}


def test_sharding(spark, docs, folder):
    rows = STAGES["sharding"](spark, docs, folder).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"]) for r in rows) == sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode())) for r in ROWS)


@pytest.mark.parametrize("name", list(STAGES))
def test_empty(spark, docs, folder, name):
    out = STAGES[name](spark, materialize(docs.limit(0)), folder)
    assert out.count() == 0 and (name == "sharding" or out.columns == docs.columns)


def test_mix_keeps_other_columns(spark, docs):
    out = mix(docs)
    assert out.columns == [c for c in docs.columns if c not in ("size", "target", "taken", "copies", "finish")] + ["size", "source_size", "target", "copies", "taken", "finish"]
    assert all(r[c].startswith("own ") for r in out.collect() for c in ("_key", "_source", "_place", "kept"))


def test_all_stages_in_a_row(spark, docs, folder):
    df = docs
    for _, stage in corpus_pipeline.STAGES:
        df = materialize(stage(spark, df, folder))
    assert set(df.columns) >= {"doc_id", "shard", "n_bytes", "text_sha256"} and df.count() > 0
