"""Tail probabilities Spark lacks. Each runs on aggregate rows only, Arrow-batched."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            out *= step
        if abs(step - 1.0) < 1e-15:
            break
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def t_quantile(p_two_sided: float, df: float) -> float:
    """The t with P(|T| > t) = p, by bisection on a monotone function."""
    lo, hi = 0.0, 1.0
    while t_two_sided(hi, df) > p_two_sided:
        hi *= 2.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        if t_two_sided(mid, df) > p_two_sided:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2.0


def _map2(fn, left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(x) or pd.isna(y) else fn(float(x), float(y)) for x, y in zip(left, right)],
        dtype="float64",
    )


@F.pandas_udf(DoubleType())
def student_t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of a t statistic."""
    return _map2(t_two_sided, t, df)


@F.pandas_udf(DoubleType())
def student_t_critical(p: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided critical t value."""
    return _map2(t_quantile, p, df)


@F.pandas_udf(DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else math.erfc(v)).astype("float64")


def chi2_1df_p(statistic: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom."""
    return erfc(F.sqrt(statistic / 2.0))


@F.pandas_udf(DoubleType())
def exact_binomial_p(b: pd.Series, c: pd.Series) -> pd.Series:
    """min(1, 2 P(X <= min(b, c))) for X ~ Bin(b + c, 1/2), as P(X <= k) = I_1/2(n - k, k + 1)."""

    def tail(x: float, y: float) -> float:
        k = min(x, y)
        return 1.0 if x == y else min(1.0, 2.0 * beta_inc(x + y - k, k + 1.0, 0.5))

    return _map2(tail, b, c)
