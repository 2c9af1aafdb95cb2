"""Predicted columns of limited-outcome, selection, duration, panel and count fits. All are lazy projections."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..functions import dist
from ..functions.safe import finite_or_null, number
from ..plans.moments import linear
from .linear import Fit
from .panel import unit_effects
from .rows import q


def index(fit: Fit) -> Column:
    x = ([F.lit(1.0)] if fit.design.constant else []) + [t.column() for t in fit.design.terms]
    return linear(x, fit.beta[: len(x)])


def _pdf(z: Column) -> Column:
    return F.exp(-0.5 * z * z - 0.5 * dist.LOG_2PI)


def limited(fit: Fit, df: DataFrame, name: str, kind: str = "mean", lower: float = 0.0) -> DataFrame:
    """tobit: mean of the censored outcome, or pr of being above the limit; truncreg: mean above it, or pr."""
    s = math.exp(fit.beta[-1])
    xb = index(fit)
    z = (xb - lower) / s
    above = dist.normal_cdf_udf(z)
    if kind == "pr":
        out = above
    elif fit.kind == "tobit":
        out = lower * (1 - above) + above * xb + s * _pdf(z)
    else:
        out = xb + s * _pdf(z) / above
    return df.withColumn(name, finite_or_null(out))


def selection(fit: Fit, df: DataFrame, name: str, kind: str = "ycond") -> DataFrame:
    """heckman: mills, ycond (if selected) or yexpected (outcome 0 if not)."""
    first = fit.info["first"]
    zg = index(first)
    chance = dist.normal_cdf_udf(zg)
    mills = _pdf(zg) / chance
    terms = [t.column() for t in fit.design.terms[:-1]]
    cond = linear([F.lit(1.0), *terms], fit.beta[:-1]) + float(fit.beta[-1]) * mills
    return df.withColumn(name, finite_or_null({"mills": mills, "ycond": cond, "yexpected": chance * cond}[kind]))


def duration(fit: Fit, df: DataFrame, name: str, kind: str = "survival") -> DataFrame:
    """Weibull, Gompertz, exponential: hazard, cumhaz or survival at each row's time."""
    t, xb = number(q(fit.design.outcome)), index(fit)
    if fit.kind == "weibull":
        p = math.exp(fit.beta[-1])
        h, cum = F.exp(xb) * p * F.pow(t, F.lit(p - 1)), F.exp(xb) * F.pow(t, F.lit(p))
    elif fit.kind == "gompertz":
        g = float(fit.beta[-1])
        h, cum = F.exp(xb + g * t), F.exp(xb) * (F.expm1(g * t) / g if abs(g) > 1e-12 else t)
    else:
        h, cum = F.exp(xb), F.exp(xb) * t
    return df.withColumn(name, finite_or_null({"hazard": h, "cumhaz": cum, "survival": F.exp(-cum)}[kind]))


def panel_values(fit: Fit, df: DataFrame, unit: str, name: str, kind: str = "xbu") -> DataFrame:
    """Fixed effects: xb, u (the unit's effect), xbu or residuals; units outside the fit are null but for xb."""
    effects = unit_effects(fit).toDF("__unit", "__u")
    joined = df.join(effects, q(unit) == F.col("__unit"), "left")
    xb = index(fit)
    y = number(q(fit.design.outcome))
    out = {"xb": xb, "u": F.col("__u"), "xbu": xb + F.col("__u"), "residuals": y - xb - F.col("__u")}[kind]
    return joined.withColumn(name, out).drop("__unit", "__u")


def count_chance(fit: Fit, df: DataFrame, name: str, k: int | str, cumulative: bool = False) -> DataFrame:
    """Poisson or NB2: probability of exactly (or at most) k events; k is a number or a column."""
    alpha = float(fit.stats.get("alpha", 0.0))

    @pandas_udf(DoubleType())
    def chance(mu: pd.Series, n: pd.Series) -> pd.Series:
        out = np.full(len(mu), np.nan)
        for i, (m, c) in enumerate(zip(mu, n, strict=True)):
            if m != m or c != c or c < 0 or c != math.floor(c) or not math.isfinite(m):
                continue
            total = 0.0
            for j in range(0 if cumulative else int(c), int(c) + 1):
                if alpha:
                    r = 1 / alpha
                    total += math.exp(math.lgamma(r + j) - math.lgamma(r) - math.lgamma(j + 1) + r * math.log(r / (r + m)) + j * math.log(m / (r + m)))
                else:
                    total += math.exp(j * math.log(m) - m - math.lgamma(j + 1))
            out[i] = total
        return pd.Series(out)

    at = number(q(k)) if isinstance(k, str) else F.lit(float(k))
    return df.withColumn(name, finite_or_null(chance(F.exp(index(fit)), at)))
