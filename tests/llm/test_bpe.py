"""The codec against tiktoken, and the query against it on a whole table."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairweave.llm import bpe

P = pytest.importorskip("public_tokenizers")
HOW = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN


@pytest.fixture(scope="module")
def plain():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(HOW[0]), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(HOW[0]), P.PATTERN)


def ids(codec, text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


def test_random_texts(plain, codec):
    rng = np.random.default_rng(3)
    parts = [" ", "  ", "\n", "\r\n", "\t", "a", "th", "e", "Bé", "1", "123", "'s", "'", "’re", "!", "?!", "日本", "語", "\x85", "\x1c", "▁", " ", "\U0001f600", "и", "ა", "é", "<unk>", "<|endoftext|>", "\x00", "\xad"]
    for _ in range(4000):
        text = "".join(rng.choice(parts, rng.integers(0, 24)))
        assert ids(codec, text) == plain.encode_ordinary(text)
        assert codec.decode(codec.encode(text)) == text.encode()


def test_every_token_and_code_point(plain, codec):
    for raw in codec.whole:
        text = raw.decode("utf-8", "replace")
        assert ids(codec, text) == plain.encode_ordinary(text)
    for start in range(0, 0x30000, 64):
        text = "".join(chr(c) + "x " for c in range(start, start + 64) if not 0xD800 <= c < 0xE000)
        assert ids(codec, text) == plain.encode_ordinary(text)


def test_long_words_and_texts(plain, codec, monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["ab" * 3000, "".join(rng.choice(list("etaoins"), 20_000)), " " * 5000 + "x", "word 12 ' s\n" * 500]
    for at_once in (bpe.AT_ONCE, 7):
        monkeypatch.setattr(bpe, "AT_ONCE", at_once)
        assert [ids(codec, t) for t in texts] == [plain.encode_ordinary(t) for t in texts]


def test_memo_is_bounded(plain, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 20_000)
    small, rng = bpe.Codec(bpe.read_ranks(HOW[0]), P.PATTERN), np.random.default_rng(5)
    for _ in range(50):
        text = " ".join("".join(rng.choice(list("abcde"), rng.integers(1, 9))) for _ in range(60))
        assert ids(small, text) == plain.encode_ordinary(text)
        assert small.held < 21_000 and len(small) < 120


def test_other_ranks_and_faults():
    ranks = {bytes([b]): 2 * b for b in range(256)} | {b"ab": 601, b"bc": 600, b"abc": 900, b"zzz": 950}
    codec = bpe.Codec(ranks, r"\S+|\s+")
    assert ids(codec, "abcd xabc") == [900, 200, 64, 240, 900]  # b and c first, then a
    assert ids(codec, "zzz zzzz") == [950, 64, 244, 244, 244, 244]  # no merge leads to zzz: only a whole pre-token is it
    with pytest.raises(ValueError, match="identifier"):
        codec.decode(np.array([1], "<u4").tobytes())
    with pytest.raises(ValueError):
        codec.decode(b"abc")
    with pytest.raises(ValueError, match="no rank"):
        bpe.model_file({b"a": 1})
    with pytest.raises(ValueError, match="distinct"):
        bpe.model_file({bytes([b]): b // 2 for b in range(256)})


def test_cases(spark, plain):
    texts = [None, "", "plain words", "plain words", "x" * 50_000, "naïve 日本"]
    docs = spark.createDataFrame([(i % 5, t, "mine", b"own") for i, t in enumerate(texts)], "doc_id long, text string, ids string, decoded binary")
    out = docs.withColumn("out", bpe.encoded(F.col("text"), *HOW)).withColumn("back", bpe.decoded(F.col("out"), *HOW)).collect()
    want = {t: np.array(plain.encode_ordinary(t or ""), "<u4").tobytes() for t in texts}
    assert [(bytes(r["out"]), bytes(r["back"]), r["ids"], bytes(r["decoded"])) for r in out] == [(want[r["text"]], (r["text"] or "").encode(), "mine", b"own") for r in out]
    assert docs.limit(0).select(bpe.encoded(F.col("text"), *HOW)).count() == 0
    assert docs.limit(1).select(bpe.decoded(F.lit(None).cast("binary"), *HOW).alias("x")).first()["x"] is None
    odd = docs.limit(1).select(F.expr("cast(unhex('61FF62') as string)").alias("text")).select(bpe.encoded(F.col("text"), *HOW).alias("x")).first()["x"]
    assert np.frombuffer(bytes(odd), "<u4").tolist() == plain.encode_ordinary("a�b")


def test_query_on_a_whole_table(spark, plain):
    folder = "/root/testdata/sf0.001"
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for doc_id, text in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        found = plain.encode_ordinary(text or "")
        want.append((doc_id, len(found), sha(np.array(found, "<u4").tobytes()), sha((text or "").encode())))
    assert sorted(map(tuple, bpe.op11_byte_bpe(spark, folder).collect())) == sorted(want)
