"""Tail probabilities for result tables of a few rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi2_tail(x: float, df: int) -> float:
    """Upper tail by the finite sums that hold for whole degrees of freedom."""
    if x <= 0:
        return 1.0
    half, total = x / 2.0, 0.0
    if df % 2 == 0:
        term = math.exp(-half)
        for i in range(df // 2):
            total += term
            term *= half / (i + 1)
        return min(1.0, total)
    total, term = math.erfc(math.sqrt(half)), math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
    for i in range((df - 1) // 2):
        total += term
        term *= half / (i + 1.5)
    return min(1.0, total)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0) or tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / (1.0 + num * d or tiny)
            c = 1.0 + num / c or tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return h


def t_two_sided(t: float, df: float) -> float:
    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if pd.isna(v) else normal_two_sided(v))


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else chi2_tail(a, int(b)) for a, b in zip(x, df)], dtype=float)


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else t_two_sided(a, b) for a, b in zip(t, df)], dtype=float)
