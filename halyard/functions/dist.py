"""Distribution functions in numpy and the standard library; scalars on the driver, vectors in pandas UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

SQRT2, LOG_2PI = math.sqrt(2.0), math.log(2 * math.pi)
_erfc = np.frompyfunc(math.erfc, 1, 1)
_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def normal_cdf(x):
    return 0.5 * _erfc(-np.asarray(x, float) / SQRT2).astype(float)


def normal_pdf(x):
    return np.exp(-0.5 * np.asarray(x, float) ** 2 - 0.5 * LOG_2PI)


def log_normal_cdf(x):
    """ln of the normal CDF; far in the lower tail by the asymptotic series."""
    x = np.asarray(x, float)
    low = x < -20
    out = np.log(np.maximum(normal_cdf(np.where(low, 0.0, x)), 1e-300))
    if low.any():
        z2 = np.where(low, x, -30.0) ** 2
        tail = -0.5 * z2 - 0.5 * LOG_2PI - 0.5 * np.log(z2) + np.log1p(-1 / z2 + 3 / z2**2 - 15 / z2**3)
        out = np.where(low, tail, out)
    return out


def mills(x):
    """pdf/cdf, stable in the lower tail."""
    return np.exp(-0.5 * np.asarray(x, float) ** 2 - 0.5 * LOG_2PI - log_normal_cdf(x))


def lgamma(x):
    return _lgamma(np.asarray(x, float)).astype(float)


def digamma_far(x):
    """The digamma function's asymptotic series, for arguments of a thousand and more."""
    return np.log(x) - 0.5 / x - 1 / (12 * x * x) + 1 / (120 * x**4)


def normal_quantile(p: float) -> float:
    """By bisection and Newton steps on the CDF."""
    if not 0 < p < 1:
        return math.nan if not 0 <= p <= 1 else math.copysign(math.inf, p - 0.5)
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / SQRT2) < p else (lo, mid)
    return (lo + hi) / 2


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * (1 if 1 - (a + b) * x / (a + 1) >= 0 else -1)
    value = d
    for m in range(1, 1000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * value


def gamma_cdf(x: float, a: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return min(1.0, front * total)
    tiny = 1e-300
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d, c = an * d + b, b + an / c
        d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return max(0.0, 1 - front * h)


def t_two_sided(t: float, df: float) -> float:
    if math.isnan(t) or df <= 0:
        return math.nan
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def t_quantile(p: float, df: float) -> float:
    if not 0 < p < 1:
        return math.nan
    if p < 0.5:
        return -t_quantile(1 - p, df)
    lo, hi = 0.0, 1.0
    while 1 - t_two_sided(hi, df) / 2 < p and hi < 1e12:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_two_sided(mid, df) / 2 < p else (lo, mid)
    return (lo + hi) / 2


def f_upper(f: float, df1: float, df2: float) -> float:
    return math.nan if math.isnan(f) else beta_cdf(df2 / (df2 + df1 * max(f, 0.0)), df2 / 2, df1 / 2)


def chi2_upper(x: float, df: float) -> float:
    return math.nan if math.isnan(x) else 1 - gamma_cdf(max(x, 0.0) / 2, df / 2)


def z_two_sided(z: float) -> float:
    return math.erfc(abs(z) / SQRT2)


@pandas_udf(DoubleType())
def normal_cdf_udf(x: pd.Series) -> pd.Series:
    return pd.Series(np.where(x.isna(), np.nan, normal_cdf(x.fillna(0.0)))).where(x.notna(), None)


def _fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The incomplete beta function's continued fraction, from its last level inwards, for x below the mean."""
    value = np.zeros_like(x)
    for m in range(200, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = even / (1 + odd / (1 + value))
    first = -(a + b) * x / (a + 1)
    return 1 / (1 + first / (1 + value))


def beta_cdfs(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta functions of arrays; where a parameter is over 1,000, one by one."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b)))
    out = np.where(x <= 0, 0.0, 1.0)
    inside = (x > 0) & (x < 1)
    for i in np.flatnonzero(inside & (np.maximum(a, b) > 1000)):
        out[i] = beta_cdf(float(x[i]), float(a[i]), float(b[i]))
    some = np.flatnonzero(inside & (np.maximum(a, b) <= 1000))
    if len(some):
        x, a, b = x[some], a[some], b[some]
        turn = x > (a + 1) / (a + b + 2)
        y, p, q = np.where(turn, 1 - x, x), np.where(turn, b, a), np.where(turn, a, b)
        front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
        v = front * _fraction(y, p, q)
        out[some] = np.where(turn, 1 - v, v)
    return out


def t_two_sideds(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    return beta_cdfs(df / (df + t * t), df / 2, np.full(len(t), 0.5))


def t_quantiles(p: np.ndarray, df: np.ndarray) -> np.ndarray:
    """By bisection of all at once, on the upper half."""
    upper = np.maximum(p, 1 - p)
    low, high = np.zeros(len(p)), np.ones(len(p))
    while (short := (1 - t_two_sideds(high, df) / 2 < upper) & (high < 1e12)).any():
        high = np.where(short, high * 2, high)
    for _ in range(80):
        middle = (low + high) / 2
        below = 1 - t_two_sideds(middle, df) / 2 < upper
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return np.where(p < 0.5, -1.0, 1.0) * (low + high) / 2


def _where_fine(fine: pd.Series, values, *columns: pd.Series) -> pd.Series:
    out = np.full(len(fine), np.nan)
    at = np.flatnonzero(fine.to_numpy())
    if len(at):
        out[at] = values(*[c.to_numpy(dtype=float)[at] for c in columns])
    return pd.Series(out)


@pandas_udf(DoubleType())
def t_pvalue_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided; null beyond |t| > 1e6 or outside 1 <= df <= 1e6."""
    return _where_fine((t.abs() <= 1e6) & df.between(1, 1e6), t_two_sideds, t, df)


@pandas_udf(DoubleType())
def t_quantile_udf(p: pd.Series, df: pd.Series) -> pd.Series:
    return _where_fine((p > 0) & (p < 1) & df.between(1, 1e6), t_quantiles, p, df)
