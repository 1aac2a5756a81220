"""Small numeric helpers evaluated on k x k pair tables (never on the data rows)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: From so many degrees of freedom on, Student's t is mapped to the normal distribution (error below 1e-9).
NORMAL_FROM = 100_000


def _fraction_term(m: int, a: float, b: float, x: float) -> float:
    """Term m of the incomplete beta function's continued fraction 1 / (1 + t1 / (1 + t2 / (1 + ...)))."""
    k = m // 2
    if m % 2:
        return -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
    return k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The fraction's value, by the recurrence of its convergents' ratios."""
    up, down, value = 1.0, 0.0, 1.0
    for m in range(1, 20_000):
        t = _fraction_term(m, a, b, x)
        up = 1.0 + t / up
        down = 1.0 / (1.0 + t * down)
        value *= up * down
        if abs(up * down - 1.0) < 4e-16:
            return 1.0 / value
    raise ArithmeticError(f"the incomplete beta function does not converge for {a}, {b}, {x}")


def reg_inc_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def pearson_pvalue(r: float | None, n: int | None) -> float | None:
    """Two-sided p-value of a Pearson r on n complete pairs: I_{1-r^2}((n-2)/2, 1/2).

    n < 2 or r null -> null; n = 2 -> 1; |r| = 1 -> 0.
    """
    if r is None or n is None or (isinstance(r, float) and math.isnan(r)) or n < 2:
        return None
    if n == 2:
        return 1.0
    r = max(-1.0, min(1.0, float(r)))
    if abs(r) == 1.0:
        return 0.0
    nu = n - 2.0
    if nu >= NORMAL_FROM:
        # The square of the normal score that a t of so many degrees corresponds to is about nu * log(1 + t^2 / nu).
        return math.erfc(math.sqrt(-math.log1p(-r * r) * (nu - 0.5) / 2.0))
    return reg_inc_beta(nu / 2.0, 0.5, 1.0 - r * r)


@F.pandas_udf(T.DoubleType())
def pearson_pvalue_udf(r: pd.Series, n: pd.Series) -> pd.Series:
    """Arrow-batched p-values for a pair table (k^2 rows at most)."""
    return pd.Series([
        pearson_pvalue(None if pd.isna(a) else float(a), None if pd.isna(b) else int(b))
        for a, b in zip(r, n)
    ], dtype="float64")
