"""Distribution functions that Spark lacks, and multiple-testing adjustment."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|): regularised incomplete beta I_x(df / 2, 1 / 2) at x = df / (df + t ** 2), by Lentz's fraction."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(t) & (df > 0)
    a, b = df[ok] / 2, np.full(int(ok.sum()), 0.5)
    x = df[ok] / (df[ok] + t[ok] ** 2)
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, t[ok] ** 2 / (df[ok] + t[ok] ** 2), x)
    gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(gamma(p + q) - gamma(p) - gamma(q) + p * np.log(y) + q * np.log1p(-y)) / p if len(p) else p
    value = np.where(y > 0, front * _beta_fraction(p, q, y), 0.0)
    out[ok] = np.clip(np.where(swap, 1 - value, value), 0, 1)
    return out


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    tiny = 1e-300
    keep = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(x)
    d = 1 / keep(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / keep(1 + step * d)
            c = keep(1 + step / c)
            h *= d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def corr_p_value(corr: Column, n: Column) -> Column:
    """Two-sided p of a correlation over n pairs: null below three pairs, but 0 once |corr| reaches 1."""

    @F.pandas_udf("double")
    def t_sf2(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(t_two_sided(t.to_numpy(float), df.to_numpy(float)))

    t = corr * F.sqrt(F.try_divide(n - 2, 1 - corr * corr))
    usable = (n >= 3) & (F.abs(corr) < 1)
    p = F.when(usable, F.nanvl(t_sf2(F.when(usable, t), F.when(usable, n - 2)), F.lit(None).cast("double")))
    return F.when(F.abs(corr) >= 1, F.lit(0.0)).otherwise(p)


def adjust_bh(tests: DataFrame, p: str, out: str, by: list[str], ties: list[str]) -> DataFrame:
    """Benjamini-Hochberg; see ``adjust_p``."""
    return adjust_p(tests, p, out, by, ties, "fdr_bh")


def adjust_p(tests: DataFrame, p: str, out: str, by: list[str], ties: list[str], method: str = "fdr_bh", alpha: float = 0.05) -> DataFrame:
    """Adjusted p values within ``by``; null p values are not tests: they stay null and don't count.

    With m tests and rank i: fdr_bh, the least p * m / j over ranks j from i on; fdr_by, the same
    times 1 + 1/2 + ... + 1/m; simes-hochberg, the least p * (m - j + 1) over these; holm, the
    largest p * (m - j + 1) over ranks up to i; holm-sidak, the same of 1 - (1 - p) ** (m - j + 1);
    bonferroni, p * m; sidak, 1 - (1 - p) ** m; hommel, the least level at which Hommel's closed test
    of Simes tests rejects; fdr_tsbh and fdr_tsbky, fdr_bh times the share of tests that it does not
    reject in a first stage at ``alpha`` (at alpha / (1 + alpha), and times 1 + alpha). None exceeds 1.
    """
    if method == "hommel":
        return _adjust_hommel(tests, p, out, by)
    if method in ("fdr_tsbh", "fdr_tsbky"):
        return _adjust_two_stage(tests, p, out, by, ties, alpha, method == "fdr_tsbky")
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    order = group.orderBy(F.col(p).asc_nulls_last(), *ties)
    m, i, x = F.count(p).over(group), F.row_number().over(order), F.col(p)
    ranked = tests.withColumn("_m", m.cast("double")).withColumn("_i", i)
    left = F.col("_m") - F.col("_i") + 1
    harmonic = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("_m").cast("int"), F.lit(1))), F.lit(0.0), lambda a, k: a + 1.0 / k)
    scaled = {
        "fdr_bh": x * F.col("_m") / F.col("_i"), "fdr_by": x * F.col("_m") / F.col("_i") * harmonic, "simes-hochberg": x * left, "holm": x * left,
        "holm-sidak": 1 - F.pow(1 - x, left), "bonferroni": x * F.col("_m"), "sidak": 1 - F.pow(1 - x, F.col("_m")),
    }
    if method not in scaled:
        raise ValueError(f"unknown method {method!r}")
    ranked = ranked.withColumn("_x", F.when(x.isNotNull(), scaled[method]))
    if method in ("fdr_bh", "fdr_by", "simes-hochberg"):
        value = F.min("_x").over(group.orderBy(F.col("_i").desc()).rowsBetween(Window.unboundedPreceding, 0))
    elif method in ("holm", "holm-sidak"):
        value = F.max("_x").over(group.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    else:
        value = F.col("_x")
    return ranked.withColumn(out, F.when(x.isNotNull(), F.least(value, F.lit(1.0)))).drop("_m", "_i", "_x")


def _adjust_two_stage(tests: DataFrame, p: str, out: str, by: list[str], ties: list[str], alpha: float, bky: bool) -> DataFrame:
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    first, factor = (alpha / (1 + alpha), 1 + alpha) if bky else (alpha, 1.0)
    staged = adjust_p(tests, p, "_bh", by, ties, "fdr_bh")
    staged = staged.withColumn("_m", F.count("_bh").over(group)).withColumn("_r", F.count_if(F.col("_bh") <= first).over(group))
    share = F.when((F.col("_r") == 0) | (F.col("_r") == F.col("_m")), 1.0).otherwise(1 - F.col("_r") / F.col("_m"))
    return staged.withColumn(out, F.least(F.col("_bh") * share * factor, F.when(F.col("_bh").isNotNull(), 1.0))).drop("_bh", "_m", "_r")


def hommel(p: np.ndarray) -> np.ndarray:
    """Hommel's adjusted p values of ascending ``p``.

    A set of k tests is rejected at its Simes level. For each k the least favourable sets hold the
    k largest p values, or the k - 1 largest and the test itself.
    """
    m = len(p)
    out, place = p.astype(float), np.arange(m)
    for k in range(m, 1, -1):
        level = (k * p[m - k :] / np.arange(1, k + 1)).min()
        out = np.maximum(out, np.minimum(level, np.where(place < m - k, k * p, np.inf)))
    return np.minimum(out, 1)


def _adjust_hommel(tests: DataFrame, p: str, out: str, by: list[str]) -> DataFrame:
    """Quadratic in the tests of a group, which one task holds."""
    schema = T.StructType([f for f in tests.schema.fields if f.name != out] + [T.StructField(out, T.DoubleType())])

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        value = pdf[p].to_numpy(float)
        order = np.argsort(value, kind="stable")[: int((~np.isnan(value)).sum())]
        found = np.full(len(value), None, object)
        found[order] = hommel(value[order])
        return pdf.drop(columns=[out], errors="ignore").assign(**{out: found})

    return tests.groupBy(*by).applyInPandas(kernel, schema)


def normal_quantile(share: Column) -> Column:
    """z with P(Z <= z) = share; NULL outside (0, 1)."""

    @F.pandas_udf("double")
    def ppf(x: pd.Series) -> pd.Series:
        quantile = NormalDist().inv_cdf
        return pd.Series([quantile(v) if 0 < v < 1 else None for v in x.to_numpy(float)], dtype=float)

    found = ppf(share.cast("double"))
    return F.nanvl(found, F.lit(None).cast("double"))


def inversions(ranks: np.ndarray) -> int:
    """Pairs i < j with ranks[i] > ranks[j], bit by bit from the highest: O(n log n).

    Values that agree in the higher bits stand together in their original order; of two of them the
    bit decides, so each one-bit counts the zero-bits of its group behind it.
    """
    ranks = np.asarray(ranks, np.int64)
    total, order = 0, np.arange(len(ranks))
    for bit in range(int(ranks.max(initial=0)).bit_length() - 1, -1, -1):
        values = ranks[order]
        one = (values >> bit & 1).astype(bool)
        high = values >> bit + 1
        start = np.concatenate(([True], high[1:] != high[:-1]))
        ones = np.cumsum(one)
        before = ones - one  # ones in front, in all groups so far
        base = before[start][np.cumsum(start) - 1]
        total += int((before - base)[~one].sum())
        order = order[np.lexsort((one, high))]
    return total


def kendall_tau(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """tau-b and its two-sided p: exact without ties up to 33 pairs, else normal with tie-corrected variance.

    With the pairs in order of x (of y where x ties), discordant ones are inversions of y.
    """
    n = len(x)
    if n < 2:
        return math.nan, math.nan
    (rx, nx), (ry, ny) = (np.unique(v, return_inverse=True, return_counts=True)[1:] for v in (x, y))
    tx, ty = nx.astype(float), ny.astype(float)
    txy = np.unique(rx * np.int64(len(ny)) + ry, return_counts=True)[1].astype(float)
    pairs = n * (n - 1) / 2
    same_x, same_y, same_both = (float((t * (t - 1) / 2).sum()) for t in (tx, ty, txy))
    if same_x == pairs or same_y == pairs:
        return math.nan, math.nan
    balance = pairs - same_x - same_y + same_both - 2.0 * inversions(ry[np.lexsort((ry, rx))])
    tau = max(-1.0, min(1.0, balance / math.sqrt((pairs - same_x) * (pairs - same_y))))
    if same_x == 0 and same_y == 0 and (n <= 33 or min(pairs + balance, pairs - balance) / 2 <= 1):
        return tau, _exact_kendall(n, int(min(pairs + balance, pairs - balance) / 2))
    m = n * (n - 1.0)
    v = lambda t, k: float((t * (t - 1) * k(t)).sum())
    var = (m * (2 * n + 5) - v(tx, lambda t: 2 * t + 5) - v(ty, lambda t: 2 * t + 5)) / 18
    var += 2 * same_x * same_y / m
    if n > 2:
        var += v(tx, lambda t: t - 2) * v(ty, lambda t: t - 2) / (9 * m * (n - 2))
    return tau, math.erfc(abs(balance) / math.sqrt(var) / math.sqrt(2)) if var > 0 else math.nan


def _exact_kendall(n: int, c: int) -> float:
    """P of at most c or at least as many discordant pairs, from counts of permutations by inversions."""
    ways = np.zeros(c + 1)
    ways[0] = 1
    for k in range(2, n + 1):
        run = np.cumsum(ways)
        run[k:] -= np.cumsum(ways)[:-k]
        ways = run / k
    return min(1.0, 2 * float(ways.sum()))
