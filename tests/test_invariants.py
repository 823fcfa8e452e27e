"""Properties that hold for any input."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairweave.functions.special import kendall_tau, t_two_sided
from pairweave.operators.cluster import flat_clusters, linkage


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=2, max_size=25))
def test_kendall_by_pairs(pairs):
    x, y = (np.array(v, float) for v in zip(*pairs, strict=True))
    tau, p = kendall_tau(x, y)
    sign = [(np.sign(x[i] - x[j]), np.sign(y[i] - y[j])) for i in range(len(x)) for j in range(i)]
    over = np.sqrt(sum(a != 0 for a, _ in sign) * sum(b != 0 for _, b in sign))
    if over == 0:
        assert np.isnan(tau)
    else:
        assert tau == pytest.approx(sum(a * b for a, b in sign) / over)
        assert np.isnan(p) or 0 <= p <= 1
        assert kendall_tau(x, -y)[0] == pytest.approx(-tau)


@settings(max_examples=60, deadline=None)
@given(st.floats(0, 30), st.integers(1, 400))
def test_t_tail_is_a_probability(t, df):
    p = t_two_sided(np.array([t, t + 0.5]), np.array([df, df]))
    assert 0 <= p[1] <= p[0] <= 1
    if df == 1:
        assert p[0] == pytest.approx(1 - 2 / np.pi * np.arctan(t), abs=1e-12)
    if df == 2:
        assert p[0] == pytest.approx(1 - t / np.sqrt(2 + t * t), abs=1e-12)


@settings(max_examples=40, deadline=None)
@given(st.integers(2, 16), st.integers(0, 1000), st.sampled_from(["ward", "average", "single", "complete"]), st.integers(1, 16))
def test_linkage_is_a_tree(n, seed, method, k):
    x = np.random.default_rng(seed).normal(size=(n, 2))
    steps = linkage(np.linalg.norm(x[:, None] - x[None], axis=2), method)
    assert (np.diff(steps[:, 2]) >= -1e-9).all() and steps[-1, 3] == n
    assert sorted(steps[:, :2].ravel().tolist()) == list(range(2 * n - 2))
    assert len(set(flat_clusters(steps, k).tolist())) == min(k, n)
