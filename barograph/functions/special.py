"""Distribution functions.

Normal and chi-square tails with one or three degrees of freedom are column
expressions. Student t and F tails need the incomplete beta function and run as Arrow
UDFs, always on rows that hold one finished test each.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Erf approximation 7.1.26 of Abramowitz and Stegun (error below 1.5e-7).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

# Standard normal quantile and density at the usual tail levels.
NORMAL_QUANTILE = {0.05: -1.6448536269514722, 0.01: -2.3263478740408408}


def erf(x: Column) -> Column:
    u = F.abs(x)
    k = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * u)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * k
    return F.signum(x) * (F.lit(1.0) - poly * F.exp(-u * u))


def norm_cdf(x: Column) -> Column:
    return (F.lit(1.0) + erf(x / F.lit(math.sqrt(2.0)))) / 2


def norm_tail2(x: Column) -> Column:
    """Two-sided normal p-value."""
    return F.lit(1.0) - erf(F.abs(x) / F.lit(math.sqrt(2.0)))


def chi2_tail_1(x: Column) -> Column:
    x = F.greatest(x, F.lit(0.0))
    return F.lit(1.0) - erf(F.sqrt(x / 2))


def chi2_tail_3(x: Column) -> Column:
    x = F.greatest(x, F.lit(0.0))
    return chi2_tail_1(x) + F.sqrt(x * F.lit(2.0 / math.pi)) * F.exp(-x / 2)


# Acklam's rational approximation of the normal quantile (relative error 1.2e-9).
QUANTILE_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
              1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
QUANTILE_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
              6.680131188771972e01, -1.328068155288572e01, 1.0)
QUANTILE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
              -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
QUANTILE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
              3.754408661907416e00, 1.0)
QUANTILE_TAIL = 0.02425


def _poly(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def norm_quantile(p: Column) -> Column:
    """Standard normal quantile of a probability strictly between 0 and 1."""
    q = p - 0.5
    middle = q * _poly(QUANTILE_A, q * q) / _poly(QUANTILE_B, q * q)
    s = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    tail = _poly(QUANTILE_C, s) / _poly(QUANTILE_D, s)
    return (
        F.when(p < QUANTILE_TAIL, tail).when(p > 1 - QUANTILE_TAIL, -tail).otherwise(middle)
    )


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for even in (True, False):
            if even:
                num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            else:
                num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    return h


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    x = np.clip(x, 0.0, 1.0)
    gam = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(
            gam(a + b) - gam(a) - gam(b) + a * np.log(x) + b * np.log1p(-x)
        )
        swap = x > (a + 1.0) / (a + b + 2.0)
        left = front * _beta_fraction(a, b, np.where(swap, 0.0, x)) / a
        right = 1.0 - front * _beta_fraction(b, a, np.where(swap, 1.0 - x, 0.0)) / b
    out = np.where(swap, right, left)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


@F.pandas_udf(DoubleType())
def t_tail2(stat: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided Student t p-value."""
    t, v = stat.astype(float).to_numpy(), dof.astype(float).to_numpy()
    ok = np.isfinite(t) & (v > 0)
    out = np.full(len(t), np.nan)
    out[ok] = beta_inc(v[ok] / 2, np.full(ok.sum(), 0.5), v[ok] / (v[ok] + t[ok] ** 2))
    return pd.Series(out).where(ok, None)


@F.pandas_udf(DoubleType())
def f_tail(stat: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper tail of the F distribution."""
    f = stat.astype(float).to_numpy()
    a, b = d1.astype(float).to_numpy(), d2.astype(float).to_numpy()
    ok = np.isfinite(f) & (a > 0) & (b > 0)
    out = np.full(len(f), np.nan)
    g = np.maximum(f[ok], 0.0)
    out[ok] = beta_inc(b[ok] / 2, a[ok] / 2, b[ok] / (b[ok] + a[ok] * g))
    return pd.Series(out).where(ok, None)


def chi2_tail_even_odd(x: Column, dof: int) -> Column:
    """Upper chi-square tail for a fixed whole number of degrees of freedom.

    Finite sums: powers of x/2 over factorials (even), half-integer steps on top of the
    one-degree tail (odd).
    """
    x = F.greatest(x, F.lit(0.0))
    half = x / 2
    if dof % 2 == 0:
        total, term = F.lit(0.0), F.lit(1.0)
        for i in range(dof // 2):
            total = total + F.pow(half, F.lit(float(i))) / math.factorial(i)
        return F.exp(-half) * total
    total = F.lit(0.0)
    for i in range(1, (dof - 1) // 2 + 1):
        total = total + F.pow(half, F.lit(i - 0.5)) / math.gamma(i + 0.5)
    return chi2_tail_1(x) + F.exp(-half) * total
