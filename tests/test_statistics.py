import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairweave.functions.special import adjust_bh, adjust_p, corr_p_value, hommel, inversions, kendall_tau, normal_quantile, t_two_sided
from pairweave.operators import correlate, pooling


def long(spark, table, study="s"):
    rows = [(study, str(i), f, None if v is None else float(v)) for f, col in table.items() for i, v in enumerate(col)]
    return spark.createDataFrame(rows, "study_id string, sample_id string, feature string, value double")


def by_pair(df):
    return {(r["feature_1"], r["feature_2"]): r for r in df.collect()}


def test_t_tail():
    assert t_two_sided(np.array([2.0]), np.array([10.0]))[0] == pytest.approx(0.07338803, rel=1e-6)
    assert t_two_sided(np.array([12.0]), np.array([100.0]))[0] == pytest.approx(4.4e-21, rel=0.02)
    assert t_two_sided(np.array([0.0, np.nan]), np.array([5.0, 5.0]))[0] == pytest.approx(1.0)


@pytest.mark.parametrize("plan", ["join", "gram"])
def test_pearson_edges(spark, plan):
    df = long(spark, {"a": [1, 2, 3, 4, None], "b": [2, 4, 6, 8, 1], "c": [5, 5, 5, 5, 5], "d": [None, None, None, None, 1], "e": [0.1, 0.1, 0.1, 0.1, 0.1]})
    out = by_pair(correlate.pearson(df, plan))
    assert len(out) == 10
    assert out["a", "b"]["corr"] == pytest.approx(1.0) and out["a", "b"]["n"] == 4
    assert out["a", "c"]["corr"] is None and out["a", "c"]["n"] == 4
    assert out["a", "e"]["corr"] is None
    assert out["a", "d"]["corr"] is None and out["a", "d"]["n"] == 0
    assert out["b", "d"]["n"] == 1


def test_p_value_rules(spark):
    df = spark.createDataFrame([(1.0, 2.0), (0.9, 2.0), (0.5, 3.0), (None, 9.0), (-1.0, 5.0)], "corr double, n double")
    got = [r["p"] for r in df.select(corr_p_value(F.col("corr"), F.col("n")).alias("p")).collect()]
    assert got[0] == 0.0 and got[1] is None and got[2] == pytest.approx(2 / 3, rel=1e-6) and got[3] is None and got[4] == 0.0


def test_plans_agree(spark):
    rng = np.random.default_rng(0)
    table = {f"f{k:02d}": [None if rng.random() < 0.1 else float(x) for x in rng.normal(size=40) + k] for k in range(7)}
    a, b = (by_pair(correlate.pearson(long(spark, table), p)) for p in ("join", "gram"))
    assert all(a[k]["corr"] == pytest.approx(b[k]["corr"], abs=1e-9) and a[k]["n"] == b[k]["n"] for k in a)


def test_spearman_ranks_within_pairs(spark):
    x, y = [1, 2, 2, 5, None, 9], [3, 1, 4, None, 2, 8]
    got = by_pair(correlate.spearman(long(spark, {"x": x, "y": y})))["x", "y"]
    pairs = [(a, b) for a, b in zip(x, y, strict=True) if a is not None and b is not None]
    rank = lambda v: [sum(o < w for o in v) + (sum(o == w for o in v) + 1) / 2 for w in v]
    want = np.corrcoef(rank([p[0] for p in pairs]), rank([p[1] for p in pairs]))[0, 1]
    assert got["corr"] == pytest.approx(want) and got["n"] == 4


def test_spearman_plans_agree(spark):
    rng = np.random.default_rng(7)
    table = {f"f{k}": [None if rng.random() < 0.15 else float(x) for x in rng.integers(0, 12, size=80)] for k in range(5)} | {"c": [1.0] * 80, "none": [None] * 80}
    df = long(spark, table).union(long(spark, {"f0": [1, 2, 3], "f1": [3, 1, 2]}, "t"))
    key = lambda out: {(r["study_id"], r["feature_1"], r["feature_2"]): r for r in out.collect()}
    a, b = key(correlate.spearman(df)), key(correlate.spearman(df, plan="sorted"))
    assert set(a) == set(b) and len(a) == 22
    for k in a:
        assert a[k]["n"] == b[k]["n"] and (a[k]["corr"] is None) == (b[k]["corr"] is None) and (a[k]["corr"] is None or a[k]["corr"] == pytest.approx(b[k]["corr"]))
    with pytest.raises(ValueError):
        correlate.spearman(df, plan="other")


def test_kendall():
    x, y = np.array([1.0, 2, 3, 4, 5]), np.array([2.0, 1, 4, 3, 5])
    tau, p = kendall_tau(x, y)
    assert tau == pytest.approx(0.6)
    ways = [sum((a - b) * (c - d) > 0 for (a, c), (b, d) in itertools.combinations(enumerate(q), 2)) for q in itertools.permutations(range(5))]
    assert p == pytest.approx(sum(w >= 8 or w <= 2 for w in ways) / len(ways))
    assert math.isnan(kendall_tau(np.ones(4), np.arange(4.0))[0])
    tied, q = kendall_tau(np.array([1.0, 1, 2, 3, 3, 4]), np.array([1.0, 2, 2, 3, 5, 4]))
    assert -1 <= tied <= 1 and 0 <= q <= 1


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        correlate.correlations(long(spark, {"a": [1, 2]}), ("cosine",))


def corr(spark, rows):
    return spark.createDataFrame([("RM0000001", "RM0000002", r, float(n), 0.5) for r, n in rows], "feature_1 string, feature_2 string, corr double, n double, p_value double")


def test_pool_against_numpy(spark):
    rows = [(0.3, 10), (0.5, 20), (-0.2, 15), (0.9999999999999, 30), (0.1, 8), (0.7, 3)]
    got = pooling.pool(corr(spark, rows)).first()
    use = [(np.arctanh(min(r, 1 - 1e-10)), n - 3) for r, n in rows if n > 3]
    z, w = (np.array(v, float) for v in zip(*use, strict=True))
    zf = (w * z).sum() / w.sum()
    q = (w * (z - zf) ** 2).sum()
    tau2 = max(0, (q - 4) / (w.sum() - (w**2).sum() / w.sum()))
    wr = 1 / (1 / w + tau2)
    zr = (wr * z).sum() / wr.sum()
    assert got["n_studies"] == 5 and got["z_fixed"] == pytest.approx(zf) and got["Q"] == pytest.approx(q) and got["df"] == 4
    assert got["tau2"] == pytest.approx(tau2) and got["z_random"] == pytest.approx(zr) and got["se_random"] == pytest.approx(wr.sum() ** -0.5)
    assert got["ci_r_random_low"] <= got["r_random"] <= got["ci_r_random_high"] and 0 <= got["I2"] <= 100


def test_pool_few_studies(spark):
    one = pooling.pool(corr(spark, [(0.3, 10)])).first()
    assert one["n_studies"] == 1 and one["Q"] is None and one["I2"] is None and one["z_random"] is None
    same = pooling.pool(corr(spark, [(0.3, 10)] * 4)).first()
    assert same["tau2"] == 0.0 and same["I2"] == 0.0 and same["z_random"] == pytest.approx(same["z_fixed"])
    assert pooling.pool(corr(spark, [(0.3, 3), (0.4, 2)])).count() == 0
    assert pooling.with_enough_studies(corr(spark, [(0.3, 10)] * 3)).count() == 0


def test_id_pattern(spark):
    rows = [("RM12345", "RM1234567"), ("RM1234567", "RM12345678"), ("RM1234566", "RM1234567")]
    df = spark.createDataFrame([(a, b, 0.1, 9.0, 0.5) for a, b in rows], "feature_1 string, feature_2 string, corr double, n double, p_value double")
    assert pooling.eligible(df).count() == 1


def test_pool_resume(spark):
    both = corr(spark, [(0.3, 10)] * 4).union(corr(spark, [(0.1, 9)] * 4).withColumn("feature_2", F.lit("RM0000003")))
    existing = pooling.pool(corr(spark, [(0.9, 10)] * 4))
    out = by_pair(pooling.pool_new(both, existing, overwrite=False))
    assert out["RM0000001", "RM0000002"]["r_fixed"] == pytest.approx(0.9) and len(out) == 2
    assert by_pair(pooling.pool_new(both, existing))["RM0000001", "RM0000002"]["r_fixed"] == pytest.approx(0.3)
    assert pooling.pool_new(both, None, limit=1).count() == 1


def test_bh(spark):
    p = [0.01, 0.04, 0.04, 0.5, None, 0.9]
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(p)], "id string, p double")
    got = {r["id"]: r["q"] for r in adjust_bh(df, "p", "q", [], ["id"]).collect()}
    some = sorted(v for v in p if v is not None)
    for i, v in enumerate(p):
        want = None if v is None else min(min(s * 5 / (k + 1) for k, s in enumerate(some) if s >= v), 1.0)
        assert got[str(i)] == (None if want is None else pytest.approx(want))


def test_other_adjustments(spark):
    p = [0.01, 0.02, 0.03, 0.5]
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(p)], "id string, p double")
    got = lambda m: [r["q"] for r in adjust_p(df, "p", "q", [], ["id"], m).orderBy("id").collect()]
    assert got("bonferroni") == pytest.approx([0.04, 0.08, 0.12, 1.0])
    assert got("holm") == pytest.approx([0.04, 0.06, 0.06, 0.5])
    assert got("simes-hochberg") == pytest.approx([0.04, 0.06, 0.06, 0.5])
    assert got("sidak") == pytest.approx([1 - (1 - v) ** 4 for v in p])
    assert got("holm-sidak")[0] == pytest.approx(1 - 0.99**4)
    assert got("fdr_by") == pytest.approx([min(1, v * (1 + 1 / 2 + 1 / 3 + 1 / 4)) for v in got("fdr_bh")])
    with pytest.raises(ValueError):
        got("none")


def test_one_pair(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 1.0), (3, 4.0), (4, 3.0), (5, 5.0), (None, 1.0)], "a int, b double")
    assert correlate.one_pair(df, "a", "b").first()["corr"] == pytest.approx(0.6)
    row = correlate.one_pair(df, "a", "b", "spearman").first()
    assert row["corr"] == pytest.approx(0.8) and row["n"] == 5
    assert row["p_value"] == pytest.approx(correlate.one_pair(df, "a", "b", "spearman").first()["p_value"])
    ties = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 2.0), (2, float("nan")), (3, 5.0)], "a int, b double")
    both = [(1, 1.0), (1, 2.0), (2, 2.0), (3, 5.0)]
    rank = lambda v: [sum(o < w for o in v) + (sum(o == w for o in v) + 1) / 2 for w in v]
    assert correlate.one_pair(ties, "a", "b", "spearman").first()["corr"] == pytest.approx(np.corrcoef(rank([x for x, _ in both]), rank([y for _, y in both]))[0, 1])
    for method in ("pearson", "spearman", "kendall"):
        row = correlate.one_pair(df.limit(0), "a", "b", method).first()
        assert row["n"] == 0 and row["corr"] is None and row["p_value"] is None


def test_inversions():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 7, 60):
        v = rng.integers(0, max(1, n // 2) + 1, n)
        assert inversions(v) == sum(a > b for a, b in itertools.combinations(v.tolist(), 2))


def test_kendall_against_pairs():
    rng = np.random.default_rng(6)
    for n in (2, 5, 40, 300):
        x, y = rng.integers(0, n, n).astype(float), rng.normal(size=n).round(1)
        sign = [(np.sign(a - b), np.sign(c - d)) for (a, c), (b, d) in itertools.combinations(zip(x, y, strict=True), 2)]
        spread = math.sqrt(sum(u != 0 for u, _ in sign) * sum(v != 0 for _, v in sign))
        tau = kendall_tau(x, y)[0]
        assert math.isnan(tau) if not spread else tau == pytest.approx(sum(u * v for u, v in sign) / spread)


@pytest.mark.parametrize("block", [2, 3, 32])
def test_spearman_and_kendall_blocks(spark, block):
    rng = np.random.default_rng(8)
    table = {f"f{k}": [None if rng.random() < 0.3 else float(x) for x in rng.integers(0, 6, 25)] for k in range(7)} | {"g": [None] * 25}
    obs = long(spark, table)
    rank = lambda v: [sum(o < w for o in v) + (sum(o == w for o in v) + 1) / 2 for w in v]
    rho, tau = by_pair(correlate.spearman(obs, block)), by_pair(correlate.kendall(obs, block))
    assert len(rho) == len(tau) == 28
    for (a, b), r in rho.items():
        both = [(x, y) for x, y in zip(table[a], table[b], strict=True) if x is not None and y is not None]
        assert r["n"] == tau[a, b]["n"] == len(both)
        if both:
            want = np.corrcoef(rank([x for x, _ in both]), rank([y for _, y in both]))[0, 1]
            assert r["corr"] == pytest.approx(want)
            got = kendall_tau(*np.array(both).T)
            assert (tau[a, b]["corr"], tau[a, b]["p_value"]) == (pytest.approx(got[0]), pytest.approx(got[1]))
        else:
            assert r["corr"] is None and tau[a, b]["corr"] is None


def test_near_constant_columns_by_both_plans(spark):
    table = {"a": [1.0, 1.0, 1.0, 1.0], "b": [1.0, 1.0, 1.0, 1.0 + 1e-4], "c": [3.0, 1.0, 2.0, 5.0], "d": [1e9, 1e9, 1e9, 1e9 + 1]}
    x, y = (by_pair(correlate.pearson(long(spark, table), plan)) for plan in ("join", "gram"))
    for k in x:
        assert x[k]["corr"] == (None if y[k]["corr"] is None else pytest.approx(y[k]["corr"], abs=1e-6)), k


def hommel_by_sets(p):
    """The closed test: the largest Simes level of all sets that hold the test."""
    n, out = len(p), np.array(p, float)
    for size in range(1, n + 1):
        for own in itertools.combinations(range(n), size):
            level = min(size * v / (j + 1) for j, v in enumerate(sorted(p[i] for i in own)))
            for i in own:
                out[i] = max(out[i], level)
    return np.minimum(out, 1)


def test_hommel():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 8):
        p = np.sort(rng.random(n) ** 3)
        assert np.allclose(hommel(p), hommel_by_sets(p.tolist()))


def test_two_stage_and_hommel_by_group(spark):
    p = [0.001, 0.01, 0.02, 0.3, 0.9, None]
    df = spark.createDataFrame([(str(i), g, v) for g in "ab" for i, v in enumerate(p)], "id string, g string, p double")
    got = lambda m: [r["q"] for r in adjust_p(df, "p", "q", ["g"], ["id"], m).filter("g = 'b'").orderBy("id").collect()]
    bh = got("fdr_bh")
    assert got("fdr_tsbh") == [None if v is None else pytest.approx(min(1, v * 2 / 5)) for v in bh]  # three of five are rejected
    assert got("fdr_tsbky") == [None if v is None else pytest.approx(min(1, v * 2 / 5 * 1.05)) for v in bh]
    assert got("hommel")[:5] == pytest.approx(hommel(np.array(p[:5], float)).tolist()) and got("hommel")[5] is None


def test_normal_quantile(spark):
    df = spark.createDataFrame([(0.5,), (0.975,), (0.0,), (None,)], "p double")
    got = [r["z"] for r in df.select(normal_quantile(F.col("p")).alias("z")).collect()]
    assert got[0] == pytest.approx(0) and got[1] == pytest.approx(1.959964, abs=1e-6) and got[2] is None and got[3] is None


def test_moments_of_slices_and_arrivals_add_up(spark):
    from pairweave.operators.moments import merge_moments, moments_r, partial_moments

    rng = np.random.default_rng(5)
    table = {f"f{k}": [None if rng.random() < 0.2 else float(x) for x in 1e6 + rng.normal(size=60) * (k > 0)] for k in range(5)}
    df = long(spark, table)
    whole = by_pair(correlate.pearson(df, all_pairs=False))
    sliced = partial_moments(df, block=2, slice_rows=7)
    assert sliced.groupBy("feature_1", "feature_2").count().filter("count > 1").count() == 10
    late = df.filter(F.col("sample_id").cast("int") % 3 == 0)
    arrived = partial_moments(late).union(partial_moments(df.join(late, ["study_id", "sample_id"], "left_anti"), slice_rows=11))
    for parts in (sliced, arrived):
        got = by_pair(merge_moments(parts).withColumn("corr", moments_r()))
        assert set(got) == set(whole)
        for k, r in got.items():
            assert r["n"] == whole[k]["n"] and (r["corr"] == pytest.approx(whole[k]["corr"], abs=1e-9) if "f0" not in k else True)
            x, y = (np.array([v for v, w in zip(table[a], table[b], strict=True) if v is not None and w is not None]) for a, b in (k, k[::-1]))
            assert r["mean_1"] == pytest.approx(x.mean()) and r["m2_2"] == pytest.approx(((y - y.mean()) ** 2).sum(), rel=1e-6, abs=1e-6)
    assert merge_moments(partial_moments(df.limit(0))).count() == 0
    constant = long(spark, {"a": [0.1] * 30, "b": [float(i) for i in range(30)]})
    assert merge_moments(partial_moments(constant, slice_rows=4)).select(moments_r().alias("r")).first()["r"] is None


def test_pool_state_is_refreshed(spark, tmp_path):
    import os

    from pairweave.sources.writers import refresh_pool_state

    rng = np.random.default_rng(6)

    def study(name, features, n=12.0):
        return [(f"f{a}", f"f{b}", name, float(rng.uniform(-0.9, 0.9)), n) for a, b in itertools.combinations(features, 2)]

    frame = lambda rows: spark.createDataFrame(rows, "feature_1 string, feature_2 string, study_id string, corr double, n double")
    path, by = f"file://{tmp_path}/state", lambda df: {tuple(r[c] for c in ("feature_1", "feature_2")): tuple(r) for r in df.collect()}
    first = {k: study(k, range(6)) for k in "abcd"}
    refresh_pool_state(frame(sum(first.values(), [])), path, 16)
    stamp = lambda: {d: sorted(os.listdir(tmp_path / "state" / d)) for d in os.listdir(tmp_path / "state") if d.startswith("bucket")}
    before = stamp()
    again = {"b": study("b", (1, 2, 3)), "e": study("e", (2, 3, 9)), "x": study("x", (2, 3), n=3.0)}  # b has lost pairs; x can't be pooled
    numbers = refresh_pool_state(frame(sum(again.values(), [])), path, 16)
    now = stamp()
    assert {d for d in now if now[d] != before.get(d)} == {f"bucket={k}" for k in numbers}
    want = pooling.pool(frame(sum((first | again).values(), [])))
    assert by(pooling.pool_from_state(spark.read.parquet(path))) == by(want)
    refresh_pool_state(frame(again["e"]), path, 16)
    assert by(pooling.pool_from_state(spark.read.parquet(path))) == by(want)
    small = study("e", (2, 3))
    assert len(refresh_pool_state(frame(small), path, 16)) <= 2  # buckets of f2 and f3 only
    assert by(pooling.pool_from_state(spark.read.parquet(path))) == by(pooling.pool(frame(sum((first | again | {"e": small}).values(), []))))
