"""Spearman for studies of any number of rows."""

import numpy as np
import pytest
from test_statistics import by_pair, long

from pairweave.operators import correlate, order


def _ranks(v):
    return [sum(o < w for o in v) + (sum(o == w for o in v) + 1) / 2 for w in v]


def _table(rows, features):
    rng = np.random.default_rng(9)
    return {f"f{k:02d}": [None if rng.random() < 0.3 else float(x) for x in rng.integers(0, 6, rows) * (-1) ** k] for k in range(features)}


def _check(got, table):
    assert len(got) == len(table) * (len(table) - 1) // 2
    for (a, b), r in got.items():
        both = [p for p in zip(table[a], table[b], strict=True) if None not in p]
        assert r["n"] == len(both) and r["corr"] == pytest.approx(np.corrcoef(*(_ranks(v) for v in zip(*both, strict=True)))[0, 1])


def test_sorted_plan_never_writes_the_rows_of_pairs(spark, monkeypatch):
    table, written = _table(120, 9), []

    def noted(df):
        held = order_materialized(df)
        written.append(held.count())
        return held

    order_materialized = order.materialized
    monkeypatch.setattr(order, "materialized", noted)
    monkeypatch.setattr(correlate, "materialized", noted)
    _check(by_pair(correlate.spearman(long(spark, table), plan="sorted")), table)
    assert written and max(written) <= 120 * 9  # cells, where the rows of pairs are four times as many


def test_sorted_plan_over_several_blocks(spark):
    table = _table(50, 9)
    for block in (2, 4):
        found = by_pair(correlate._spearman_sorted(long(spark, table), block))
        _check(found, table)


def _nested(rows):
    """Values that are all different: features without gaps, with gaps within those of another, and with gaps elsewhere."""
    table = {f"f{k:02d}": v.tolist() for k, v in enumerate(np.random.default_rng(4).normal(size=(9, rows)))}
    for name, gone in (("f06", lambda i: i % 5 == 0), ("f07", lambda i: i % 5 < 3), ("f08", lambda i: i % 7 < 2)):
        table[name] = [None if gone(i) else x for i, x in enumerate(table[name])]
    return table


@pytest.mark.parametrize("gaps", [False, True])
def test_sorted_plan_writes_no_row_per_cell_and_other_feature(spark, monkeypatch, gaps):
    table, written, write = _nested(60), [], order.materialized
    table = table if gaps else {k: v for k, v in table.items() if None not in v}

    def noted(df):
        held = write(df)
        written.append(held.count())
        return held

    monkeypatch.setattr(order, "materialized", noted)
    monkeypatch.setattr(correlate, "materialized", noted)
    _check(by_pair(correlate.spearman(long(spark, table), plan="sorted")), table)
    assert written and max(written) <= 60 * len(table)  # cells, though no value comes twice


def test_sorted_plan_with_gaps_within_gaps(spark):
    table = _nested(40)
    for block in (2, 5):
        _check(by_pair(correlate._spearman_sorted(long(spark, table), block)), table)


def test_missed_features(spark):
    sets = [([(0, 0b11), (1, 0b01)], 3), ([(0, 0b01), (1, 0b01)], 2), ([(1, 0b10)], 1)]  # rows with f0 f1 f2, with f0 f2, with f3
    rows = [("s", m) for m, k in sets for _ in range(k)]
    found = correlate._missed(spark.createDataFrame(rows, "study_id string, masks array<struct<there int, mask bigint>>"), 2)
    assert sorted(tuple(r) for r in found.collect()) == [("s", 0, 0, 0b10), ("s", 2, 0, 0b10)]


def test_totals_before_of_several_amounts(spark):
    rows = [("a", v, v % 3, v % 5) for v in range(90)]
    out = order.totals_before(spark.createDataFrame(rows, "g string, v long, k long, m long").repartition(5), ["g"], "v", ["k", "m"], ["k_less", "m_less"], ["k_all", "m_all"]).collect()
    assert len(out) == 90
    for r in out:
        v = r["v"]
        assert (r["k_less"], r["m_less"], r["k_all"], r["m_all"]) == (sum(x % 3 for x in range(v)), sum(x % 5 for x in range(v)), 90, 180)


def test_totals_before(spark):
    rng = np.random.default_rng(3)
    rows = [(g, int(v), int(rng.integers(1, 9))) for g in "abc" for v in rng.permutation(200)[: {"a": 150, "b": 30, "c": 1}[g]]]
    out = order.totals_before(spark.createDataFrame(rows, "g string, v long, k long").repartition(6), ["g"], "v", "k", "less", "all").collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r["less"], r["all"]) == (sum(k for g, v, k in rows if g == r["g"] and v < r["v"]), sum(k for g, v, k in rows if g == r["g"]))


def test_tasks_in_python_hold_no_long_study(spark, monkeypatch):
    table, short, held = _table(60, 5), _table(20, 4), []
    by_blocks = correlate._by_blocks

    def noted(obs, *more):
        held.extend(r["study_id"] for r in obs.select("study_id").distinct().collect())
        return by_blocks(obs, *more)

    monkeypatch.setattr(correlate, "_by_blocks", noted)
    found = correlate.spearman(long(spark, table, "long").union(long(spark, short, "short")), max_rows=40)
    assert held == ["short"]
    _check(by_pair(found.filter("study_id = 'long'")), table)
    _check(by_pair(found.filter("study_id = 'short'")), short)
