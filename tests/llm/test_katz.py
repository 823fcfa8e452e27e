import math
import zlib
from collections import Counter, defaultdict

import pytest

from pairweave.llm.katz import good_turing, katz_scores, op5_katz_scores

CUT = 5


class Brute:
    def __init__(self, texts, held):
        self.tokens = [(t or "").encode().lower().split() + [None] for t in texts]
        self.c, self.pairs, self.context = Counter(), Counter(), Counter()
        for own, h in zip(self.tokens, held, strict=True):
            if not h:
                self.c.update(own)
                for v, w in zip(["begin", *own[:-1]], own, strict=True):
                    self.pairs[v, w] += 1
                    self.context[v] += 1
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.d1, self.d2 = (good_turing([0, *(Counter(x.values())[r] for r in range(1, CUT + 2))], CUT) for x in (self.c, self.pairs))
        left = self.n - sum(self.d(self.d1, k) * k for k in self.c.values())
        self.over, self.left = (self.n, left / self.n) if left > 1e-9 else (self.n + 1, 1 / (self.n + 1))
        follow = defaultdict(list)
        for (v, w), k in self.pairs.items():
            follow[v].append((w, k))
        self.total, self.alpha = {}, {}
        for v, own in follow.items():
            kept = sum(self.d(self.d2, k) * k for _, k in own)
            self.total[v] = self.context[v] + (self.context[v] - kept <= 1e-9)
            self.alpha[v] = (1 - kept / self.total[v]) / (1 - sum(self.p(w) for w, _ in own))

    def d(self, d, k):
        return d[k] if k <= CUT else 1.0

    def p(self, w):
        return self.d(self.d1, self.c[w]) * self.c[w] / self.over if w in self.c else self.left

    def cond(self, v, w):
        k = self.pairs.get((v, w), 0)
        return self.d(self.d2, k) * k / self.total[v] if k else self.alpha.get(v, 1.0) * self.p(w)

    def score(self, own):
        return sum(math.log10(self.cond(v, w)) for v, w in zip(["begin", *own[:-1]], own, strict=True))

    def base(self, own):
        return sum(math.log10((self.c[w] + 1) / (self.n + self.v + 1)) for w in own)


def same(spark, texts, held, **options):
    docs = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(zip(texts, held, strict=True))], "doc_id long, text string, held boolean")
    got = {r["doc_id"]: r for r in katz_scores(docs, **options).collect()}
    model = Brute(texts, held)
    assert len(got) == len(texts)
    for i, own in enumerate(model.tokens):
        r = got[i]
        assert r["score"] == pytest.approx(model.score(own), rel=1e-9, abs=1e-9) and r["base_score"] == pytest.approx(model.base(own), rel=1e-9, abs=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(w in model.c for w in own), model.n)
    return model


def test_cases(spark):
    texts = [None, "", "The the THE", "the cat sat", "the cat ran\nthe dog sat", "never seen words", "a " * 4000, "the é É\x00", "the cat sat"]
    same(spark, texts, [False, False, False, False, False, True, False, True, False])
    same(spark, texts, [True] * len(texts))
    same(spark, ["x"] * 30, [False] * 30)


def test_tables_and_sums(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    held = [zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in rows]
    # small chunks and shards: contexts are dealt over many shards
    model = same(spark, [r["text"] for r in rows], held, chunk_tokens=3000, shard_tokens=500)
    for v in ["begin", b"the", b"of", rows[0]["text"].encode().lower().split()[0]]:
        assert sum(model.cond(v, w) for w in model.c) + model.cond(v, "unseen") == pytest.approx(1)
    got = op5_katz_scores(spark, folder).filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"]


def test_empty(spark):
    assert katz_scores(spark.createDataFrame([], "doc_id long, text string, held boolean")).count() == 0


def test_long_text_and_clashing_columns(spark):
    texts = ["a b c " * 40_000, "a b d", "é " * 3, None]
    docs = spark.createDataFrame([(i, t, i == 1, "own", "own") for i, t in enumerate(texts)], "doc_id long, text string, held boolean, score string, chunk string")
    got = {r["doc_id"]: r for r in katz_scores(docs, chunk_tokens=1000).collect()}
    model = Brute(texts, [False, True, False, False])
    assert all(got[i]["n_tokens"] == len(own) and got[i]["score"] == pytest.approx(model.score(own), rel=1e-9) for i, own in enumerate(model.tokens))
