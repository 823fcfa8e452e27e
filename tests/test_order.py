"""Places and medians by range partitions against plain versions."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from pairweave.operators.clean import normalize_pqn
from pairweave.operators.order import exact_medians, numbered


def test_numbered(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice([None, 0.0, 0.0, 0.0, rng.random()])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    out = sorted(numbered(df, "g", F.desc_nulls_last("v")).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in out] == list(range(1, 3001))
    key = lambda r: (r[0], r[1] is None, -(r[1] or 0))
    assert [key(r) for r in out] == sorted(map(key, rows))
    assert numbered(df.limit(0), "v").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_medians(spark, seed):
    rng = random.Random(seed)
    rows = [(g, None if g is None or rng.random() < 0.8 else "x", rng.choice([None, 0.0, 1.5, -2.0, rng.gauss(0, 1)])) for g in ["a"] * 900 + ["b"] * 7 + ["c"] + [None] * 30 for _ in range(1)]
    want = {}
    for g, h, v in rows:
        want.setdefault((g, h), []).append(v)
    want = {k: median(x for x in vs if x is not None) for k, vs in want.items() if any(x is not None for x in vs)}
    df = spark.createDataFrame(rows, "g string, h string, v double").repartition(3)
    assert {(r["g"], r["h"]): r["m"] for r in exact_medians(df, ["g", "h"], "v", "m").collect()} == pytest.approx(want)


def test_a_frequent_value_is_dealt_over_partitions(spark):
    df = spark.range(40_000).select(F.lit("g").alias("g"), F.lit(0.0).alias("v"), "id")
    dealt = df.repartitionByRange(8, "g", "v", F.xxhash64("g", "v", "id")).groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == 8 and max(r["count"] for r in dealt) < 10_000
    assert exact_medians(df, ["g"], "v", "m").first()["m"] == 0.0


def test_pqn_is_the_same_as_with_aggregated_medians(spark):
    rng = random.Random(4)
    rows = [("s", f"{i}", f"f{k}", rng.choice([0.0, None, rng.random()])) for i in range(60) for k in range(9)]
    df = spark.createDataFrame(rows, "study_id string, sample_id string, feature string, value double")
    total, share = {}, {}
    for _, i, _, v in rows:
        total[i] = total.get(i, 0.0) + (v or 0.0)
    for _, i, f, v in rows:
        if v is not None and total[i]:
            share.setdefault(f, {})[i] = v / total[i]
    typical = {f: median(x.values()) for f, x in share.items()}
    for r in normalize_pqn(df).collect():
        quotients = [share[f][r["sample_id"]] / typical[f] for f in share if r["sample_id"] in share[f] and typical[f]]
        v = next(x[3] for x in rows if x[1] == r["sample_id"] and x[2] == r["feature"])
        dilution = median(quotients) if quotients else None
        assert r["value"] == (pytest.approx(v / dilution) if v is not None and dilution else None)
