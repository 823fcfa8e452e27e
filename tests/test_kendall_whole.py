"""Kendall of all pairs of features against brute force, on the smallest tables."""

import itertools
import math
from collections import defaultdict

import pytest

from pairweave import catalogue
from pairweave.plans import fixtures as fx

DATA = "/root/testdata/sf0.001"


def test_kendall_p_values_of_all_pairs(spark):
    cells = defaultdict(dict)
    for r in fx.obs_lines(spark, DATA).collect():
        cells[r["study_id"], r["feature"]][r["sample_id"]] = r["value"]
    want = {}
    for study in {s for s, _ in cells}:
        for a, b in itertools.combinations(sorted(f for s, f in cells if s == study), 2):
            both = [k for k in cells[study, a] if cells[study, a][k] is not None and cells[study, b].get(k) is not None]
            x, y = ([float(cells[study, f][k]) for k in both] for f in (a, b))
            sign = [((x[i] > x[j]) - (x[i] < x[j]), (y[i] > y[j]) - (y[i] < y[j])) for i, j in itertools.combinations(range(len(both)), 2)]
            spread = math.sqrt(sum(u != 0 for u, _ in sign) * sum(v != 0 for _, v in sign))
            want[study, a, b] = (len(both), sum(u * v for u, v in sign) / spread if spread else None)
    got = {(r["study_id"], r["feature_1"], r["feature_2"]): (r["n"], r["corr"]) for r in catalogue.QUERIES["kendall_p_values"](spark, DATA).collect()}
    assert got.keys() == want.keys() and len({f for k in got for f in k[1:]}) > 5
    for k, (n, tau) in want.items():
        assert got[k] == (n, tau if tau is None else pytest.approx(tau, abs=2e-6)), k
