import numpy as np
import pytest

from pairweave.llm.sstable import Encoder, Reader, read_tokens, write_tokens

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def path():
    return P.path("byte_bpe_50k.json")


def test_pieces_encode_as_the_whole(path):
    from tokenizers import Tokenizer

    plain, fast = Tokenizer.from_file(path), Encoder(path)
    rng = np.random.default_rng(1)
    parts = [" ", "  ", "\n", "\t", "a", "Bé", "1", "'s", "<|endoftext|>", "!", "日", "\x85", "\r\n", "\x1c", " ", "word"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(3000)]
    assert [x.tolist() for x in fast.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_round_trip(spark, path):
    texts = [None, "", "hello world", "x" * 300_000, "a b c", "a b c", "tail "]
    ids = [5, -3, 0, 2**62, 9, 9, None]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    manifest = write_tokens(docs, path, shard_bytes=200)
    assert manifest.agg({"documents": "sum"}).first()[0] == 7
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    rows = sorted(read_tokens(manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, -3, 0, 5, 9, 9, 2**62]
    at = 0
    by_id = dict(zip(ids, texts, strict=True))
    for r in rows:
        want = plain.encode(by_id[r["doc_id"]] or "", add_special_tokens=False).ids + [2]
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["start"] == at and r["n_tokens"] == len(want)
        at += len(want)
    found = {}
    for row in manifest.collect():
        reader = Reader(row["path"])
        for key in (5, 9, None, 123456):
            found.setdefault(key, []).extend(reader.get(key))
        reader.close()
    assert len(found[5]) == 1 and len(found[9]) == 2 and len(found[None]) == 1 and not found[123456]


def test_empty(spark, path):
    docs = spark.createDataFrame([], "doc_id long, text string, start long")
    assert read_tokens(write_tokens(docs, path)).count() == 0


def test_clashing_columns_and_long_texts(spark, path):
    rows = [(2, "word " * 60_000, 5, "x", 1), (1, "a b", 6, "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long, ids string, n_tokens long")
    out = sorted(read_tokens(write_tokens(docs, path)).collect(), key=lambda r: r["start"])
    assert [(r["doc_id"], r["start"]) for r in out] == [(1, 0), (2, out[0]["n_tokens"])] and out[1]["n_tokens"] > 60_000
    with pytest.raises(TypeError):
        write_tokens(docs.withColumn("doc_id", docs["doc_id"].cast("string")), path)


def test_memo_is_bounded_by_bytes(path, monkeypatch):
    from tokenizers import Tokenizer

    from pairweave.llm import sstable

    monkeypatch.setattr(sstable, "MEMO", 50_000)
    plain, fast, rng = Tokenizer.from_file(path), Encoder(path), np.random.default_rng(2)
    for _ in range(40):
        texts = [" ".join("".join(rng.choice(list("abcde"), rng.integers(1, 9))) for _ in range(60)) + " " + "y" * 3000 for _ in range(3)]
        assert [x.tolist() for x in fast.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert fast.held <= 50_000 + sum(len(t) + 200 * len(t.split()) for t in texts)
        assert len(fast.index) == fast.known


def test_slices_are_bounded_by_bytes():
    import pyarrow as pa

    from pairweave.llm.common import slices

    texts = ["x" * n for n in (10, 10, 500, 1, 1, 1)] + [None]
    parts = list(slices(pa.RecordBatch.from_pydict({"text": texts}), rows=3, size=20))
    assert [p.column("text").to_pylist() for p in parts] == [texts[:2], texts[2:3], texts[3:6], texts[6:]]
    assert list(slices(pa.RecordBatch.from_pydict({"text": pa.array([], pa.string())}))) == []


def test_query_against_whole_texts(spark, path):
    import zlib

    from tokenizers import Tokenizer

    from pairweave.llm.sstable import op7_token_shards

    folder = "/root/testdata/sf0.001"
    plain, at, want = Tokenizer.from_file(path), 0, []
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect():
        ids = np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = op7_token_shards(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()
    assert [tuple(r) for r in got] == want


def test_identifiers_must_be_integers(spark, path):
    with pytest.raises(TypeError):
        write_tokens(spark.createDataFrame([("a", "b")], "doc_id string, text string"), path)
    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id int, text string, start string")
    assert [r["n_tokens"] for r in read_tokens(write_tokens(docs, path)).collect()] == [3]
