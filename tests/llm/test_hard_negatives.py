"""Mining against a plain version over all pairs."""

import math

import pytest
from pyspark.sql import functions as F

from pairweave.llm import hard_negatives as hn

KIND = "id long, label string, vector array<double>"


def brute(rows, anchor, positives=5, negatives=10, low=30, high=90):
    """rows: id, label, components or None."""
    good = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            one = (label, [math.floor(256 * x) for x in v])
            good[i] = min(good.get(i, one), one)
    out = []
    for a in filter(anchor, good):
        label, v = good[a]
        score = lambda i: sum(x * y for x, y in zip(v, good[i][1]))  # noqa: B023, E731
        order = sorted((i for i in good if i != a), key=lambda i: (-score(i), i))
        for p in [i for i in order if good[i][0] == label][:positives]:
            fit = [i for i in order if good[i][0] != label and low * score(p) <= 100 * score(i) <= high * score(p)]
            out += [(a, p, k, i, score(p), score(i)) for k, i in enumerate(fit[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, KIND).select("id", "label", hn.quantized(F.col("vector")).alias("vector"))
    return sorted(map(tuple, hn.hard_negatives(df, F.col("id") % 5 == 0, **options).collect()))


@pytest.fixture
def random_rows():
    import random

    rng = random.Random(8)
    kinds = [[round(rng.uniform(-0.2, 1), 2) for _ in range(3)] for _ in range(12)]
    return [(i, rng.choice("aaab"), rng.choice(kinds)) for i in range(-20, 90)]


@pytest.mark.parametrize("block", [(512, 32_768), (7, 7)])
def test_random(spark, random_rows, monkeypatch, block):
    monkeypatch.setattr(hn, "BLOCK_ROWS", block)
    monkeypatch.setattr(hn, "BLOCK_ANCHORS", 6 if block[0] == 7 else 1024)
    monkeypatch.setattr(hn, "SCORES", 20)
    want = brute(random_rows, lambda i: i % 5 == 0)
    assert len(want) > 200 and mined(spark, random_rows) == want
    assert mined(spark, random_rows, positives=2, negatives=3, low=50, high=100) == brute(random_rows, lambda i: i % 5 == 0, 2, 3, 50, 100)


def test_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, "x", [1.0, 0.5]), (1, "x", [1.0, 0.5]), (2, "y", [0.5, 0.5]), (2, "y", [0.4, 0.5]), (2, "z", [0.9, 0.5]), (3, "y", [0.5]), (4, "y", []),
        (5, "only", [1.0, 1.0]), (6, None, [1.0, 1.0]), (7, "y", None), (8, "y", [1.0, None]), (9, "y", [inf, 0.1]), (10, "x", [nan, 1.0]), (None, "y", [0.5, 0.5]),
        (11, "y", [0.5, 0.5, 9.0]), (12, "y", [0.5, 0.5]), (15, "n", [-1.0, -1.0]), (16, "n", [1.0, 1.0]),
    ]
    want = brute(rows, lambda i: i % 5 == 0)
    assert {r[0] for r in want} == {0} and mined(spark, rows) == want
    assert mined(spark, rows[:0]) == [] and mined(spark, rows[1:3]) == []
    with pytest.raises(TypeError):
        hn.hard_negatives(spark.createDataFrame([("a", "x", [1])], "id string, label string, vector array<bigint>"), F.lit(True))


def test_large_scores_are_exact(spark):
    big = [(0, "x", [2.0**22, 1.0]), (1, "x", [2.0**22, 3.0]), (2, "y", [2.0**21, 5.0]), (3, "y", [2.0**21, 6.0]), (4, "y", [2.0**21, 6.0])]
    assert mined(spark, big) == brute(big, lambda i: i % 5 == 0) and len(mined(spark, big)) == 3
    huge = [(i, k, [x * 2.0**1 for x in v]) for i, k, v in big]
    assert mined(spark, huge) == brute(huge, lambda i: i % 5 == 0)
    for odd in (2.0**40, 2.0**60):
        with pytest.raises(Exception, match="64-bit|too large|Overflow"):
            mined(spark, [(0, "x", [odd]), (1, "x", [odd]), (2, "y", [1.0])])


def test_group_limits_come_before_the_shuffle(spark, random_rows, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_ROWS", (20, 20))
    df = spark.createDataFrame(random_rows, KIND).select("id", "label", hn.quantized(F.col("vector")).alias("vector"))
    plan = hn.hard_negatives(df, F.col("id") % 5 == 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Cartesian" not in plan and "NestedLoop" not in plan
