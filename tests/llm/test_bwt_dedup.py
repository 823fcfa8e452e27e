import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pairweave.llm.bwt_dedup import op9_repeated_bytes, remove_repeats, repeated_windows


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
    return out


def run(spark, texts, length, gram, limit=500):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(3)
    rows = remove_repeats(docs, length, gram, limit).orderBy("doc_id").collect()
    return [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in rows]


def pieces(seed, letters="abcé \n", n=40):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice(letters) for _ in range(k))
    shared = [text(rng.randrange(15, 60)) for _ in range(5)]
    return ["".join(rng.choice([text(rng.randrange(40)), rng.choice(shared)]) for _ in range(rng.randrange(1, 6))) for _ in range(n)]


@pytest.mark.parametrize(("seed", "limit"), [(1, 500), (2, 2), (3, 1)])
def test_against_brute_force(spark, seed, limit):
    texts = pieces(seed) + [None, "", "short", "a" * 90, "ab" * 70, "same text in full, twice over", "same text in full, twice over"]
    assert run(spark, texts, 20, 8, limit) == brute(texts, 20)


def test_one_passage_in_many(spark):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh") for _ in range(60))
    texts = ["".join(rng.choice("abcdefgh") for _ in range(30)) + passage + "".join(rng.choice("abcdefgh") for _ in range(30)) for _ in range(60)]
    assert run(spark, texts, 20, 8, 10) == brute(texts, 20)


def test_long_text_is_cut(spark):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh") for _ in range(1_100_000))
    texts = [long, "x" * 50 + long[1_048_400:1_048_900] + "y" * 50, long[5:400]]
    assert run(spark, texts, 200, 80) == brute(texts, 200)


def test_driver_tables(spark):
    folder = "/root/testdata/sf0.001"
    texts = [r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()]
    rows = op9_repeated_bytes(spark, folder).orderBy("doc_id").collect()
    assert [tuple(r)[1:5] for r in rows] == [w[:4] for w in brute(texts, 200)]


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "q" * 30), (1, "q" * 30), (1, "w" * 10), (1, "w" * 10)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in remove_repeats(docs, 20, 8).collect()) == [0, 0, 30, 30]


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_columns_of_one_collection():
    strings, offs, counts = [b"abcdeXfgh", b"bcdeXfg", b"zzdeXqq"], [5, 4, 4], [4, 2, 2]
    found = repeated_windows(strings, offs, counts, 6)
    assert [f.tolist() for f in found] == [[False, True, True, False], [True, True], [False, False]]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "q" * 30, "own", 5), (2, "w" * 10, "own", 5)], "doc_id long, text string, kept string, h int")
    assert sorted((r["doc_id"], r["n_removed"]) for r in remove_repeats(docs, 20, 8).collect()) == [(1, 30), (2, 0)]


def test_many_kinds_of_one_key(spark):
    rng = random.Random(3)
    core = "".join(rng.choice("abcdefgh") for _ in range(60))
    texts = ["".join(rng.choice("klmnop") for _ in range(30)) + core + "".join(rng.choice("klmnop") for _ in range(30)) for _ in range(70)]
    assert run(spark, texts, 40, 16, limit=9) == brute(texts, 40)
