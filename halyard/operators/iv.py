"""Instrumental variables: everything but the sandwiches comes from one matrix of cross products."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..plans.moments import Design, cross_products, design, linear, meat, solved
from .linear import Fit, sandwich


def _setup(df: DataFrame, y: str, exog: Sequence[str], endog: Sequence[str], iv: Sequence[str], predicate, constant: bool, cluster: str | None) -> tuple[Design, list[int], list[int], list[int]]:
    """Columns are the constant, exogenous, endogenous, instruments; their places in the cross products."""
    d = design(df, y, [*exog, *endog, *iv], predicate, constant, None, cluster)
    e, first = len(endog), int(constant) + len(d.terms) - len(endog) - len(iv)
    if len(iv) < e or not e:
        raise ValueError("at least as many instruments as endogenous variables are needed")
    w, n, z = list(range(first)), list(range(first, first + e)), list(range(first + e, first + e + len(iv)))
    return d, w, n, z


def ivregress(df: DataFrame, y: str, *exog: str, endog: Sequence[str], iv: Sequence[str], predicate=None, robust: bool = False, cluster: str | None = None, constant: bool = True) -> Fit:
    """Two-stage least squares; coefficients in the order constant, exogenous, endogenous."""
    d, w, e, z = _setup(df, y, exog, endog, iv, predicate, constant, cluster)
    cols, k = d.x(), d.k
    n, m = cross_products(d.rows, [*cols, F.col("y")])
    x, allz = w + e, w + z
    first = solved(m[np.ix_(allz, allz)], [d.names[i] for i in allz]) @ m[np.ix_(allz, x)]
    bread = solved(first.T @ m[np.ix_(allz, x)], [d.names[i] for i in x])
    beta = bread @ (first.T @ m[allz, k])
    p = len(x)
    if n <= p:
        raise ValueError("too few observations")
    names, chosen = [d.names[i] for i in x], [cols[i] for i in x]
    error = F.col("y") - linear(chosen, beta)
    rss = float(m[k, k] - 2 * beta @ m[x, k] + beta @ m[np.ix_(x, x)] @ beta)
    fitted = [linear([cols[i] for i in allz], first[:, j]) for j in range(p)]
    if robust or cluster:
        cov, df_ = sandwich(d.rows, [error * f for f in fitted], bread, n, p, robust, cluster is not None)
    else:
        cov, df_ = bread * rss / (n - p), None
    tss = m[k, k] - (m[0, k] ** 2 / m[0, 0] if constant else 0.0)
    stats = {"rss": rss, "r2": 1 - rss / tss, "rmse": math.sqrt(rss / (n - p))}
    return Fit("iv", names, beta, cov, n, float(df_ if df_ is not None else n - p), stats, d, {"m": m, "w": w, "e": e, "z": z, "x": x, "first": first, "robust": robust})


def _fit_on(m: np.ndarray, x: list[int], y: int) -> tuple[np.ndarray, float]:
    b = np.linalg.solve(m[np.ix_(x, x)], m[x, y])
    return b, float(m[y, y] - b @ m[x, y])


def first_stage(fit: Fit) -> list[dict[str, float]]:
    """Per endogenous variable: F of the excluded instruments, partial R-squared, Shea's R-squared."""
    i = fit.info
    m, w, e, z, x = i["m"], i["w"], i["e"], i["z"], i["x"]
    out = []
    full, proj = np.linalg.inv(m[np.ix_(x, x)]), np.linalg.inv(i["first"].T @ m[np.ix_(w + z, x)])
    for v in e:
        short, long_ = (_fit_on(m, w, v)[1] if w else m[v, v]), _fit_on(m, w + z, v)[1]
        free = fit.n - len(w) - len(z)
        f = ((short - long_) / len(z)) / (long_ / free)
        at = x.index(v)
        out.append({"variable": fit.design.names[v], "f": f, "df1": len(z), "df2": free, "p": dist.f_upper(f, len(z), free), "partial_r2": 1 - long_ / short, "shea_r2": min(1.0, max(0.0, full[at, at] / proj[at, at]))})
    return out


def overid(fit: Fit) -> dict[str, float]:
    """Sargan's statistic, or the score test if the fit is robust."""
    i = fit.info
    m, w, e, z, x = i["m"], i["w"], i["e"], i["z"], i["x"]
    free = len(z) - len(e)
    if free < 1:
        raise ValueError("not over-identified")
    k, allz = fit.design.k, w + z
    if not i["robust"]:
        g = m[allz, k] - m[np.ix_(allz, x)] @ fit.beta
        stat = fit.n * float(g @ np.linalg.solve(m[np.ix_(allz, allz)], g)) / fit.stats["rss"]
    else:
        cols = fit.design.x()
        error = F.col("y") - linear([cols[j] for j in x], fit.beta)
        spare = z[:free]
        first = i["first"]
        hat = [linear([cols[j] for j in allz], first[:, j]) for j in range(len(x))]
        gram = first.T @ m[np.ix_(allz, allz)] @ first
        rest = []
        for v in spare:
            unit = np.zeros(len(allz))
            unit[allz.index(v)] = 1
            b = np.linalg.solve(gram, first.T @ m[np.ix_(allz, allz)] @ unit)
            rest.append(cols[v] - linear(hat, b))
        u = [error * c for c in rest]
        _, middle = meat(fit.design.rows, u)
        total = np.array([v for v in fit.design.rows.agg(*[F.sum(c) for c in u]).first()])
        stat = float(total @ np.linalg.solve(middle, total))
    return {"chi2": stat, "df": free, "p": dist.chi2_upper(stat, free)}


def endogeneity(fit: Fit) -> dict[str, float]:
    """Wu-Hausman F: first-stage residuals added to least squares."""
    i = fit.info
    m, w, e, z, x = i["m"], i["w"], i["e"], i["z"], i["x"]
    k, allz = fit.design.k, w + z
    size = len(m)
    lift = np.zeros((size + len(e), size))
    lift[:size] = np.eye(size)
    for j, v in enumerate(e):
        lift[size + j, v] = 1
        lift[size + j, allz] = -i["first"][:, x.index(v)]
    big = lift @ m @ lift.T
    _, short = _fit_on(big, x, k)
    _, long_ = _fit_on(big, x + list(range(size, size + len(e))), k)
    free = fit.n - len(x) - len(e)
    f = ((short - long_) / len(e)) / (long_ / free)
    return {"f": f, "df1": len(e), "df2": free, "p": dist.f_upper(f, len(e), free)}


def anderson_rubin(fit: Fit, null: Sequence[float]) -> dict[str, float]:
    """F test of the endogenous coefficients against null, whatever the instruments' strength."""
    i = fit.info
    m, w, e, z = i["m"], i["w"], i["e"], i["z"]
    k = fit.design.k
    lift = np.zeros((len(m) + 1, len(m)))
    lift[:-1] = np.eye(len(m))
    lift[-1, k] = 1
    lift[-1, e] = -np.array(null, float)
    big, at = lift @ m @ lift.T, len(m)
    short = _fit_on(big, w, at)[1] if w else big[at, at]
    long_ = _fit_on(big, w + z, at)[1]
    free = fit.n - len(w) - len(z)
    f = ((short - long_) / len(z)) / (long_ / free)
    return {"f": f, "df1": len(z), "df2": free, "p": dist.f_upper(f, len(z), free)}


def anderson_rubin_set(fit: Fit, level: float = 0.95) -> dict[str, object]:
    """Confidence set of a single endogenous coefficient: the solutions of a quadratic inequality."""
    i = fit.info
    m, w, e, z = i["m"], i["w"], i["e"], i["z"]
    if len(e) != 1:
        raise ValueError("one endogenous variable only")
    k, v, free, q = fit.design.k, i["e"][0], fit.n - len(w) - len(z), len(z)
    lo, hi = 0.0, 1.0
    while dist.f_upper(hi, q, free) > 1 - level:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if dist.f_upper(mid, q, free) > 1 - level else (lo, mid)
    c = 1 + q * (lo + hi) / 2 / free

    def left(rows: list[int]) -> np.ndarray:
        two = [v, k]
        base = m[np.ix_(two, two)]
        return base - m[np.ix_(two, rows)] @ np.linalg.solve(m[np.ix_(rows, rows)], m[np.ix_(rows, two)]) if rows else base

    r, u = left(w), left(w + z)
    a, b, d = r[0, 0] - c * u[0, 0], -2 * (r[0, 1] - c * u[0, 1]), r[1, 1] - c * u[1, 1]
    disc = b * b - 4 * a * d
    if abs(a) < 1e-12 * r[0, 0]:
        return {"shape": "ray", "low": -math.inf if b > 0 else -d / b, "high": -d / b if b > 0 else math.inf}
    if disc < 0:
        return {"shape": "empty" if a > 0 else "all", "low": math.nan if a > 0 else -math.inf, "high": math.nan if a > 0 else math.inf}
    x1, x2 = sorted(((-b - math.sqrt(disc)) / (2 * a), (-b + math.sqrt(disc)) / (2 * a)))
    return {"shape": "bounded" if a > 0 else "disjoint", "low": x1, "high": x2}


def gmm(df: DataFrame, y: str, endog: Sequence[str], iv: Sequence[str], cluster: str, predicate=None) -> Fit:
    """Two-step GMM with clustered moments, no constant, no included exogenous variables."""
    d, _, e, z = _setup(df, y, [], endog, iv, predicate, False, cluster)
    cols = d.x()
    n, m = cross_products(d.rows, [*cols, F.col("y")])
    a, b = m[np.ix_(z, e)], m[z, d.k]
    first = np.linalg.solve(m[np.ix_(z, z)], a)
    beta = np.linalg.solve(first.T @ a, first.T @ b)

    def spread(beta: np.ndarray) -> tuple[int, np.ndarray]:
        error = F.col("y") - linear([cols[i] for i in e], beta)
        return meat(d.rows, [error * cols[i] for i in z], True)

    groups, s = spread(beta)
    if groups <= len(z):
        raise ValueError("more clusters than instruments are needed")
    weight = np.linalg.inv(s)
    beta = np.linalg.solve(a.T @ weight @ a, a.T @ weight @ b)
    _, s2 = spread(beta)
    bread = np.linalg.inv(a.T @ weight @ a)
    cov = bread @ a.T @ weight @ s2 @ weight @ a @ bread
    gap = b - a @ beta
    stats = {"j": float(gap @ weight @ gap), "groups": groups}
    if len(z) > len(e):
        stats["j_p"] = dist.chi2_upper(stats["j"], len(z) - len(e))
    return Fit("gmm", [d.names[i] for i in e], beta, cov, n, None, stats, d)
