"""Linear least squares, tests on coefficients, and t-tests."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.safe import finite, finite_or_null, number, truth
from ..plans.moments import Design, cross_products, design, linear, meat, solved
from .rows import need, q


@dataclass
class Fit:
    """Coefficients with their covariance. df is None where inference is normal."""

    kind: str
    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    n: int
    df: float | None = None
    stats: dict[str, float] = field(default_factory=dict)
    design: Design | None = None
    info: dict = field(default_factory=dict)

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.cov), 0, None))

    def __getitem__(self, name: str) -> float:
        return float(self.beta[self.names.index(name)])

    def table(self, spark, level: float = 0.95) -> DataFrame:
        """term, estimate, se, statistic, p, low, high."""
        edge = dist.normal_quantile(0.5 + level / 2) if self.df is None else dist.t_quantile(0.5 + level / 2, self.df)
        rows = []
        for name, b, s in zip(self.names, self.beta.tolist(), self.se.tolist(), strict=True):
            t = b / s if s else math.nan
            p = dist.z_two_sided(t) if self.df is None else dist.t_two_sided(t, self.df)
            rows.append((name, b, s, t, p, b - edge * s, b + edge * s))
        return spark.createDataFrame(rows, "term string, estimate double, se double, statistic double, p double, low double, high double")


def sandwich(fit_rows: DataFrame, scores: list[Column], bread: np.ndarray, n: int, k: int, robust: bool, cluster: bool) -> tuple[np.ndarray, float | None]:
    """HC1 or cluster covariance of least squares, and the degrees of freedom if clusters set them."""
    groups, middle = meat(fit_rows, scores, cluster)
    if cluster:
        if groups < 2:
            raise ValueError("two clusters at least")
        return bread @ middle @ bread * groups / (groups - 1) * (n - 1) / (n - k), groups - 1
    return bread @ middle @ bread * n / (n - k), None


def regress(df: DataFrame, y: str, *terms: str, predicate: str | Column | None = None, robust: bool = False, cluster: str | None = None, constant: bool = True, wls: str | None = None, gls: str | None = None, outcome: Column | None = None) -> Fit:
    """Least squares; weights are wls, or the inverse of gls. Factor terms are i.v or ib(level).v."""
    d = design(df, y, terms, predicate, constant, wls or gls, cluster, outcome=outcome)
    if gls:
        d.rows = d.rows.withColumn("w", 1 / F.col("w"))
    return fit_rows(d, robust, cluster is not None, bool(wls or gls))


def fit_rows(d: Design, robust: bool = False, cluster: bool = False, weighted: bool = False) -> Fit:
    rows, x, k = d.rows, d.x(), d.k
    weight = F.col("w") if weighted else None
    if weighted and rows.where("w <= 0").limit(1).count():
        raise ValueError("weights must be positive")
    n, m = cross_products(rows, [*x, F.col("y")], weight)
    if n <= k:
        raise ValueError("too few observations")
    bread = solved(m[:k, :k], d.names)
    beta = bread @ m[:k, k]
    w = F.lit(1.0) if weight is None else weight
    e = F.col("y") - linear(x, beta)
    sums = rows.agg(F.sum(w * e * e).alias("rss"), F.sum(w).alias("w"), F.sum(w * F.col("y")).alias("wy"), F.sum(F.log(w)).alias("logw")).first()
    rss, tss = sums["rss"], m[k, k] - (sums["wy"] ** 2 / sums["w"] if d.constant else 0.0)
    if robust or cluster:
        cov, df = sandwich(rows, [w * e * c for c in x], bread, n, k, robust, cluster)
    else:
        cov, df = bread * rss / (n - k), None
    r2 = min(1.0, max(0.0, 1 - rss / tss)) if tss > 0 else 0.0
    slopes = k - d.constant
    stats = {"rss": rss, "tss": tss, "r2": r2, "r2_adjusted": 1 - (rss / (n - k)) / (tss / (n - d.constant)) if tss > 0 else 0.0, "rmse": math.sqrt(rss / (n - k)), "ll": -n / 2 * (1 + math.log(2 * math.pi * rss / n)) if rss > 0 else math.inf}
    if d.constant and slopes and rss > 0:
        stats["f"] = ((tss - rss) / slopes) / (rss / (n - k))
        stats["f_p"] = dist.f_upper(stats["f"], slopes, n - k)
    return Fit("linear", d.names, beta, cov, n, float(df if df is not None else n - k), stats, d, {"gram": m, "bread": bread})


def predicted(fit: Fit, df: DataFrame, name: str, kind: str = "xb") -> DataFrame:
    """Adds fitted values or residuals for the current rows; an unseen factor level gives null."""
    need(df, *{t.variable for t in fit.design.terms})
    seen: dict[str, list] = {}
    for t in fit.design.terms:
        if t.factor:
            seen.setdefault(t.variable, []).append(t.level)
    x = ([F.lit(1.0)] if fit.design.constant else []) + [t.column() for t in fit.design.terms]
    xb = linear(x, fit.beta[: len(x)])
    return df.withColumn(name, xb if kind == "xb" else number(q(fit.design.outcome)) - xb)


def lincom(fit: Fit, weights: dict[str, float], constant: float = 0.0) -> dict[str, float]:
    """An affine combination of coefficients, with its 95 % interval."""
    a = np.array([weights.get(n, 0.0) for n in fit.names])
    value, se = float(a @ fit.beta + constant), math.sqrt(max(0.0, float(a @ fit.cov @ a)))
    edge = dist.normal_quantile(0.975) if fit.df is None else dist.t_quantile(0.975, fit.df)
    t = value / se if se else math.nan
    return {"estimate": value, "se": se, "statistic": t, "p": dist.z_two_sided(t) if fit.df is None else dist.t_two_sided(t, fit.df), "low": value - edge * se, "high": value + edge * se}


def wald(fit: Fit, restrictions: Sequence[tuple[dict[str, float], float]]) -> dict[str, float]:
    """Joint test of (weights, value) restrictions: F, or chi-squared where inference is normal."""
    r = np.array([[w.get(n, 0.0) for n in fit.names] for w, _ in restrictions])
    gap = r @ fit.beta - np.array([v for _, v in restrictions])
    stat, q_ = float(gap @ np.linalg.solve(r @ fit.cov @ r.T, gap)), len(r)
    if fit.df is None:
        return {"chi2": stat, "df": q_, "p": dist.chi2_upper(stat, q_)}
    return {"f": stat / q_, "df1": q_, "df2": fit.df, "p": dist.f_upper(stat / q_, q_, fit.df)}


def vif(fit: Fit) -> dict[str, float]:
    """Variance inflation from the inverse of the predictors' centred cross products."""
    d, k = fit.design, fit.design.k
    m = cross_products(d.rows, d.x())[1] if "w" in d.rows.columns else fit.info["gram"][:k, :k]
    inner = m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) / m[0, 0] if d.constant else m
    inverse = np.linalg.inv(inner)
    return {t.name: float(inner[i, i] * inverse[i, i]) for i, t in enumerate(d.terms)}


def _moments(x: Column, suffix: str = "") -> list[Column]:
    return [F.count(x).alias("n" + suffix), F.avg(x).alias("mean" + suffix), F.stddev_samp(x).alias("sd" + suffix)]


def _test(diff: float, se: float, df: float, **more) -> dict[str, float]:
    t = diff / se if se else math.nan
    edge = dist.t_quantile(0.975, df) if df > 0 else math.nan
    return {"difference": diff, "se": se, "t": t, "df": df, "p": dist.t_two_sided(t, df) if df > 0 else math.nan, "low": diff - edge * se if se else diff, "high": diff + edge * se if se else diff, **more}


def ttest(df: DataFrame, x: str, value: float | None = None, other: str | None = None, by: str | None = None, welch: bool = False, predicate: str | Column | None = None) -> dict[str, float]:
    """One-sample against a value, paired against another variable, or two groups; one aggregation."""
    need(df, x, *[n for n in (other, by) if n])
    rows = df if predicate is None else df.where(truth(predicate))
    if by is None:
        gap = finite_or_null(q(x)) - (finite_or_null(q(other)) if other else F.lit(float(value or 0.0)))
        r = rows.agg(*_moments(gap)).first()
        if not r["n"]:
            raise ValueError("no observations")
        return _test(r["mean"], (r["sd"] / math.sqrt(r["n"])) if r["n"] > 1 else math.nan, r["n"] - 1, n=r["n"])
    groups = rows.where(finite(q(x)) & q(by).isNotNull()).groupBy(q(by).alias("g")).agg(*_moments(number(q(x)))).orderBy(F.col("g").cast("string")).limit(3).collect()
    if len(groups) != 2:
        raise ValueError("two groups are needed")
    a, b = groups
    va, vb = ((g["sd"] or 0.0) ** 2 for g in groups)
    if welch:
        sa, sb = va / a["n"], vb / b["n"]
        se, free = math.sqrt(sa + sb), (sa + sb) ** 2 / (sa**2 / (a["n"] - 1) + sb**2 / (b["n"] - 1))
    else:
        free = a["n"] + b["n"] - 2
        se = math.sqrt(((a["n"] - 1) * va + (b["n"] - 1) * vb) / free * (1 / a["n"] + 1 / b["n"]))
    return _test(a["mean"] - b["mean"], se, free, n1=a["n"], n2=b["n"])


def compare(spark, fits: dict[str, Fit]) -> DataFrame:
    """Several fits side by side: model, term, estimate, se, p, n, in the models' and terms' order."""
    rows = []
    for model, f in fits.items():
        for name, b, s in zip(f.names, f.beta.tolist(), f.se.tolist(), strict=True):
            t = b / s if s else math.nan
            rows.append((model, name, b, s, dist.z_two_sided(t) if f.df is None else dist.t_two_sided(t, f.df), f.n))
    return spark.createDataFrame(rows, "model string, term string, estimate double, se double, p double, n bigint")
