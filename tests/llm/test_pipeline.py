"""The pipeline's stages against plain versions of each, on its own input."""

import hashlib

import pytest

import __spark_entry__
import corpus_pipeline
from pairweave.llm.common import materialize, table
from pairweave.llm.decontam import brute_force
from tests_llm_helpers import mixed_counts, near_duplicate_roots

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, FOLDER, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, FOLDER))
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def test_shape(stages):
    assert list(stages) == ["language_id", "near_dedup", "decontaminate", "mix_sources", "sharding"]
    for name, (before, after) in stages.items():
        assert name == "sharding" or after.columns == before.columns


def test_language_keeps_texts(stages):
    before, after = stages["language_id"]
    assert after.count() >= 0.98 * before.filter("text RLIKE '[a-zA-Z]'").count()


def test_language_id(spark, stages):
    """Kept are texts whose words are sure enough of their spans' languages, by a plain version of model and path."""
    import math
    from zlib import crc32

    from test_langid import brute_model, brute_path, brute_scores

    before, after = stages["language_id"]
    rows = before.collect()
    learned = [(r["text"], r["lang"]) for r in rows if r["text"] is not None and r["lang"] is not None and crc32(str(r["doc_id"]).encode()) % 3 != 1]
    counts, scripts = brute_model(learned)
    score, want, margin = brute_scores(counts, scripts), set(), 1.0
    for r in rows:
        _, values, path = brute_path(r["text"], counts, scripts, score=score)
        sure = sum(math.exp(v[p]) for v, p in zip(values, path, strict=True)) / len(path) if path else 0.0
        margin = min(margin, abs(sure - corpus_pipeline.LEAST_LANGUAGE_SCORE))
        if path and sure >= corpus_pipeline.LEAST_LANGUAGE_SCORE:
            want.add(r["doc_id"])
    assert margin > 1e-4 and {r["doc_id"] for r in after.collect()} == want


def test_near_dedup(stages):
    before, after = stages["near_dedup"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(i for i, root in near_duplicate_roots(texts, 5).items() if i == root)


def test_decontaminate(spark, stages):
    before, after = stages["decontaminate"]
    rows = before.orderBy("doc_id").collect()
    items = {str(r["item_id"]): r["text"] for r in table(spark, FOLDER, "benchmark").collect()}
    found = brute_force([r["text"] for r in rows], items)
    assert sorted(r["doc_id"] for r in after.collect()) == [r["doc_id"] for r, f in zip(rows, found, strict=True) if not f[1]]


def test_mix(stages):
    before, after = stages["mix_sources"]
    want = mixed_counts([(r["doc_id"], r["text"], r["source"]) for r in before.collect()])
    got = {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_sharding(stages):
    before, after = stages["sharding"]
    want = sorted((r["doc_id"], len((r["text"] or "").encode()), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in before.collect())
    assert sorted((r["doc_id"], r["n_bytes"], r["text_sha256"]) for r in after.collect()) == want


def test_registered():
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert {f"op{k}" for k in range(1, 13)} <= {name.split("_")[0] for name in __spark_entry__.queries()}
