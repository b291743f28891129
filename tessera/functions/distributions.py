"""Distribution functions that Spark lacks, as plain Python and as pandas UDFs.

They run on aggregated rows, a handful for each statistic, never on the data itself.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The incomplete beta function's continued fraction, by the modified Lentz method."""
    tiny, c, d = 1e-300, 1.0, 1.0 / max(1e-300, abs(1.0 - (a + b) * x / (a + 1))) * math.copysign(1.0, 1.0 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def f_quantile(p: float, df1: float, df2: float) -> float:
    """Inverse of the F distribution function, by bisection of the beta argument."""
    low, high = 0.0, 1.0
    for _ in range(200):
        x = 0.5 * (low + high)
        low, high = (x, high) if beta_cdf(x, df1 / 2, df2 / 2) < p else (low, x)
    x = 0.5 * (low + high)
    return math.inf if x >= 1 else df2 * x / (df1 * (1 - x))


def signed_rank_p(w: float, n: int, ties: float = 0.0, exact_most: int = 15) -> float | None:
    """Two-sided p of the signed-rank statistic (sum of positive ranks) of n differences.

    Exact by counting subsets of 1..n while n is small and ranks are whole, else normal
    with tie correction (``ties``: sum of t**3 - t) and without continuity correction.
    """
    if n == 0:
        return None
    if n <= exact_most and not ties and float(w).is_integer():
        ways = [1]
        for rank in range(1, n + 1):
            ways = [(ways[s] if s < len(ways) else 0) + (ways[s - rank] if 0 <= s - rank < len(ways) else 0) for s in range(len(ways) + rank)]
        low = sum(ways[: int(min(w, n * (n + 1) / 2 - w)) + 1])
        return min(1.0, 2.0 * low / 2**n)
    variance = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    if variance <= 0:
        return None
    return min(1.0, 2.0 * normal_cdf(-abs(w - n * (n + 1) / 4) / math.sqrt(variance)))


def f_quantile_udf():
    @F.pandas_udf("double")
    def quantile(p: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
        return pd.Series([f_quantile(*x) if x[1] > 0 and x[2] > 0 else None for x in zip(p, df1, df2, strict=True)], dtype="float64")

    return quantile


def signed_rank_p_udf():
    @F.pandas_udf("double")
    def p_value(w: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x[0]) else signed_rank_p(float(x[0]), int(x[1]), float(x[2])) for x in zip(w, n, ties, strict=True)], dtype="float64")

    return p_value
