import itertools
import random

import pytest

from pairweave.llm.common import materialize
from pairweave.operators.components import connect
from pairweave.llm.neardup import drop_near_duplicates, near_duplicates, op6_near_duplicates


def sets(text, width):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x0b", " ").split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(texts, width, percent=80):
    shingles = [sets(t, width) for t in texts]
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = shingles[i], shingles[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((top(i), top(j)))
            root[y] = x
    return [(len(s), top(i), top(i) == i) for i, s in enumerate(shingles)]


def copies(seed, groups=6, size=8, words=60, edits=8):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(edits)):
                own[rng.randrange(len(own))] = word()
            out.append(" ".join(own))
    rng.shuffle(out)
    return out


def run(spark, texts, width, **options):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(3)
    rows = near_duplicates(docs, width, **options).orderBy("doc_id").collect()
    return [(r["n_shingles"], r["component_id"], r["kept"]) for r in rows]


@pytest.mark.parametrize(("width", "block", "few"), [(2, 800, 32), (5, 800, 32), (2, 3, 2), (2, 3, 0)])
def test_against_brute_force(spark, width, block, few):
    texts = copies(width) + [None, "", " \n", "one", "ONE", "two words", "two words", "Two  words", "x " * 3000]
    assert run(spark, texts, width, block=block, few=few) == brute(texts, width)


def test_driver_tables(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in op6_near_duplicates(spark, "/root/testdata/sf0.001").collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 2)


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (7, "a b c"), (9, "z")], "doc_id long, text string")
    rows = near_duplicates(docs, 2).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in rows) == [("3", "3", True), ("3", "3", True), ("7", "3", False), ("9", "9", True), ("None", "None", True)]
    kept = drop_near_duplicates(docs, 2)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "9", "None"]


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_connect(spark):
    nodes = spark.range(60).selectExpr("id AS node", "id AS root")
    links = [(i, i + 1) for i in range(0, 39)] + [(50, 45), (45, 59), (59, 50)]
    labels = connect(materialize(nodes), spark.createDataFrame(links, "a long, b long"))
    got = {r["node"]: r["root"] for r in labels.collect()}
    assert all(got[i] == 0 for i in range(40)) and got[59] == got[50] == got[45] == 45 and got[44] == 44


def test_repeated_rows_go(spark):
    rows = [(3, "a b c", "x"), (3, "a b c", "x"), (3, "d e f", "y"), (4, "a b c", "z"), (None, "a b c", "n"), (None, "a b c", "n"), (5, None, None), (5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    kept = drop_near_duplicates(docs, 2)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "5", "None", "None"]


def chain(n, step=4, size=12):
    """Each text shares about half of its shingles with the next: neighbours meet by chance, none is linked."""
    return [" ".join(f"w{k}" for k in range(i * step, i * step + size)) for i in range(n)]


def test_chance_meetings_grow_in_proportion(spark):
    from pairweave.llm import neardup

    found = {}
    for n in (2500, 10_000):
        docs = spark.createDataFrame(list(enumerate(chain(n))), "doc_id long, text string").repartition(4)
        made = materialize(neardup.sketch(docs, 2, 14, 3))
        met = neardup._meetings(made.selectExpr("doc_id AS node", "a", "b"), 14)
        labels = materialize(made.selectExpr("doc_id AS node", "doc_id AS root"))
        assert neardup._hub_groups(met, labels, 32).isEmpty()
        found[n] = (met.select("node", "pivot").distinct().count(), neardup._chance_pairs(met, labels, 32).count())
    print(found)
    assert found[2500][0] > 1000 and found[10_000][0] < 4.4 * found[2500][0] and found[10_000][1] <= 4.4 * found[2500][1] + 100


def test_recall_near_the_threshold(spark):
    rng, texts, linked = random.Random(11), [], 0
    for k in range(600):
        base = [f"v{k}x{i}" for i in range(rng.randrange(40, 90))]
        other = base[: len(base) - rng.randrange(len(base) // 8, len(base) // 4)] + [f"v{k}y0"]
        a, b = sets(" ".join(base), 2), sets(" ".join(other), 2)
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            texts += [" ".join(base), " ".join(other)]
            linked += 1
    got = run(spark, texts, 2)
    assert linked > 60 and sum(a[1] == b[1] for a, b in zip(got[::2], got[1::2], strict=True)) == linked


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, 6), (2, "a b c", 5, 6)], "doc_id long, text string, n_shingles int, component_id int")
    assert sorted(tuple(r) for r in near_duplicates(docs, 2).collect()) == [(1, 2, 1, True), (2, 2, 1, False)]
    assert drop_near_duplicates(docs, 2).collect() == [docs.first()]
