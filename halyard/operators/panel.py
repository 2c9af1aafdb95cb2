"""Panels: within, between, first differences, random effects and population-averaged fits.

Group means are aggregated before they meet the rows again, so a large group
costs no more than its rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist
from ..plans.moments import Design, cross_products, design, linear, meat, solved
from .linear import Fit, fit_rows, sandwich
from .rows import need, q


def check_keys(df: DataFrame, unit: str, time: str) -> None:
    """Keys must be there, times whole numbers, and each pair unique."""
    need(df, unit, time)
    groups = df.groupBy(q(unit).alias("u"), q(time).alias("t")).agg(F.count("*").alias("c"))
    r = groups.agg(F.count_if(F.col("u").isNull() | F.col("t").isNull()).alias("gap"), F.count_if(F.col("c") > 1).alias("twice")).first()
    if r["gap"] or r["twice"]:
        raise ValueError("keys are missing" if r["gap"] else "keys repeat")


def _prepared(df: DataFrame, y: str, terms, unit: str, predicate, outcome=None) -> tuple[Design, DataFrame]:
    """Complete cases with g as unit, and per unit the size t and the means."""
    d = design(df, y, terms, predicate, True, None, unit, outcome=outcome)
    names = ["y", *[f"x{i}" for i in range(len(d.terms))]]
    means = d.rows.groupBy("g").agg(F.count("*").alias("t"), *[F.avg(c).alias(f"m_{c}") for c in names])
    return d, means


def _within(d: Design, means: DataFrame) -> Design:
    names = ["y", *[f"x{i}" for i in range(len(d.terms))]]
    rows = d.rows.join(means, "g").select("g", "t", *[(F.col(c) - F.col(f"m_{c}")).alias(c) for c in names])
    return Design(rows, d.outcome, d.terms, False, d.source)


def xtreg_fe(df: DataFrame, y: str, *terms: str, unit: str, predicate=None, robust: bool = False, cluster: bool = False, outcome: Column | None = None) -> Fit:
    """Within regression; degrees of freedom N-G-K, clusters are the units. Has the normalised constant and the test of unit effects."""
    d, means = _prepared(df, y, terms, unit, predicate, outcome)
    inner = _within(d, means)
    x, p = inner.x(), inner.k
    n, m = cross_products(inner.rows, [*x, F.col("y")])
    g = means.count()
    if n - g - p <= 0:
        raise ValueError("too few observations within units")
    bread = solved(m[:p, :p], inner.names)
    beta = bread @ m[:p, p]
    rss = float(m[p, p] - beta @ m[:p, p])
    sigma2 = rss / (n - g - p)
    error = F.col("y") - linear(x, beta)
    df_ = float(n - g - p)
    if cluster:
        cov, df_ = sandwich(inner.rows, [error * c for c in x], bread, n, p, False, True)
    elif robust:
        cov = bread @ meat(inner.rows, [error * c for c in x])[1] @ bread * n / (n - g - p)
    else:
        cov = bread * sigma2
    centre = d.rows.agg(F.avg("y").alias("y"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(d.x()[1:])]).first()
    mean = np.array([centre[f"m{i}"] for i in range(p)])
    full = np.zeros((p + 1, p + 1))
    full[1:, 1:] = cov
    full[0, 1:] = full[1:, 0] = -mean @ cov
    full[0, 0] = sigma2 / n + mean @ cov @ mean
    pooled = fit_rows(Design(d.rows, y, d.terms, True, d.source))
    f = ((pooled.stats["rss"] - rss) / (g - 1)) / sigma2
    stats = {"rss": rss, "groups": g, "sigma_e": math.sqrt(sigma2), "r2_within": 1 - rss / m[p, p], "f_units": f, "f_units_p": dist.f_upper(f, g - 1, n - g - p)}
    return Fit("fe", d.names, np.r_[centre["y"] - mean @ beta, beta], full, n, float(df_), stats, d, {"means": means, "slopes": cov})


def unit_effects(fit: Fit) -> DataFrame:
    """g and u: each unit's mean residual."""
    means = fit.info["means"]
    x = [F.lit(1.0)] + [F.col(f"m_x{i}") for i in range(len(fit.design.terms))]
    return means.select("g", (F.col("m_y") - linear(x, fit.beta)).alias("u"))


def xtreg_be(df: DataFrame, y: str, *terms: str, unit: str, predicate=None) -> Fit:
    """Least squares on unit means."""
    d, means = _prepared(df, y, terms, unit, predicate)
    rows = means.select("g", F.col("m_y").alias("y"), *[F.col(f"m_x{i}").alias(f"x{i}") for i in range(len(d.terms))])
    return fit_rows(Design(rows, y, d.terms, True, d.source))


def xtreg_fd(df: DataFrame, y: str, *terms: str, unit: str, time: str, predicate=None, constant: bool = False) -> Fit:
    """Least squares on differences from the unit's previous row in time."""
    need(df, y, *terms, unit, time)
    w = Window.partitionBy(q(unit)).orderBy(q(time))
    gap = df.select(q(unit).alias("__unit"), *[(q(c).cast("double") - F.lag(q(c).cast("double")).over(w)).alias(c) for c in (y, *terms)])
    return fit_rows(design(gap, y, terms, predicate, constant))


def xtreg_re(df: DataFrame, y: str, *terms: str, unit: str, predicate=None, equal_group: bool = False, outcome: Column | None = None) -> Fit:
    """Swamy-Arora random effects, balanced or not; normal inference."""
    fe = xtreg_fe(df, y, *terms, unit=unit, predicate=predicate, outcome=outcome)
    d, means = fe.design, fe.info["means"]
    p, g, n, se2 = len(d.terms), fe.stats["groups"], fe.n, fe.stats["sigma_e"] ** 2
    z = [F.lit(1.0)] + [F.col(f"m_x{i}") for i in range(p)]
    r = means.agg(F.min("t").alias("a"), F.max("t").alias("b"), F.avg(1 / F.col("t")).alias("inv")).first()
    balanced = r["a"] == r["b"]
    weight = None if balanced or equal_group else F.col("t").cast("double")
    _, m = cross_products(means, [*z, F.col("m_y")], weight)
    k = p + 1
    b = solved(m[:k, :k], d.names) @ m[:k, k]
    rss = float(m[k, k] - b @ m[:k, k])
    if balanced:
        su2 = rss / (g - k) - se2 / r["a"]
    elif equal_group:
        su2 = rss / (g - k) - se2 * r["inv"]
    else:
        squared = cross_products(means, z, F.col("t").cast("double") ** 2)[1]
        su2 = (rss - (g - k) * se2) / (n - float(np.trace(np.linalg.solve(m[:k, :k], squared))))
    su2 = max(0.0, su2)
    theta = 1 - F.sqrt(F.lit(se2) / (F.lit(se2) + F.col("t") * F.lit(su2)))
    joined = d.rows.join(means, "g").withColumn("th", theta)
    rows = joined.select("g", (F.col("y") - F.col("th") * F.col("m_y")).alias("y"), (1 - F.col("th")).alias("x0"), *[(F.col(f"x{i}") - F.col("th") * F.col(f"m_x{i}")).alias(f"x{i + 1}") for i in range(p)])
    x = [F.col(f"x{i}") for i in range(k)]
    _, s = cross_products(rows, [*x, F.col("y")])
    bread = solved(s[:k, :k], d.names)
    beta = bread @ s[:k, k]
    rss = float(s[k, k] - beta @ s[:k, k])
    cov = bread * rss / (n - k)
    chi2 = float(beta[1:] @ np.linalg.solve(cov[1:, 1:], beta[1:]))
    stats = {"sigma_u": math.sqrt(su2), "sigma_e": math.sqrt(se2), "rho": su2 / (su2 + se2) if su2 + se2 else 0.0, "groups": g, "chi2": chi2, "chi2_p": dist.chi2_upper(chi2, p)}
    return Fit("re", d.names, beta, cov, n, None, stats, d, {"means": means, "fe": fe})


def hausman(fe: Fit, re: Fit) -> dict[str, float]:
    """Fixed against random effects, on the slopes; an error if the covariance gap isn't positive definite."""
    gap = fe.beta[1:] - re.beta[1:]
    v = fe.info["slopes"] - re.cov[1:, 1:]
    if np.linalg.eigvalsh(v)[0] <= 0:
        raise ValueError("the difference of the covariances isn't positive definite")
    stat = float(gap @ np.linalg.solve(v, gap))
    return {"chi2": stat, "df": len(gap), "p": dist.chi2_upper(stat, len(gap))}


def xtreg_ml(df: DataFrame, y: str, *terms: str, unit: str, predicate=None) -> Fit:
    """Gaussian random effects by maximum likelihood: rows are reduced to sums by group size, then solved on the driver."""
    d, means = _prepared(df, y, terms, unit, predicate)
    p = len(d.terms)
    k = p + 1
    inner = _within(d, means)
    n, within = cross_products(inner.rows, [*inner.x(), F.col("y")])
    z = [F.lit(1.0)] + [F.col(f"m_x{i}") for i in range(p)] + [F.col("m_y")]
    pairs = [F.sum(z[i] * z[j]).alias(f"s{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]
    sizes = means.groupBy("t").agg(F.count("*").alias("c"), *pairs).collect()
    blocks = []
    for r in sizes:
        m = np.zeros((k + 1, k + 1))
        for i in range(k + 1):
            for j in range(i, k + 1):
                m[i, j] = m[j, i] = r[f"s{i}_{j}"]
        blocks.append((r["t"], r["c"], m))
    base = np.zeros((k + 1, k + 1))
    base[1:, 1:] = within

    def profile(ratio: float):
        """ratio = unit variance over error variance."""
        s, logs = base.copy(), 0.0
        for t, c, m in blocks:
            s += t / (1 + t * ratio) * m
            logs += c * math.log1p(t * ratio)
        b = np.linalg.solve(s[:k, :k], s[:k, k])
        rss = float(s[k, k] - b @ s[:k, k])
        return -0.5 * (n * (1 + math.log(2 * math.pi * rss / n)) + logs), b, rss, s

    lo, hi = -30.0, 12.0
    golden = (math.sqrt(5) - 1) / 2
    while hi - lo > 1e-12:
        a, b_ = hi - golden * (hi - lo), lo + golden * (hi - lo)
        if profile(math.exp(a))[0] < profile(math.exp(b_))[0]:
            lo = a
        else:
            hi = b_
    ratio = math.exp((lo + hi) / 2)
    if profile(0.0)[0] >= profile(ratio)[0]:
        ratio = 0.0
    ll, beta, rss, s = profile(ratio)
    se2 = rss / n
    lr = max(0.0, 2 * (ll - profile(0.0)[0]))
    stats = {"ll": ll, "sigma_e": math.sqrt(se2), "sigma_u": math.sqrt(se2 * ratio), "groups": sum(c for _, c, _ in blocks), "lr_units": lr, "lr_units_p": dist.chi2_upper(lr, 1) / 2 if lr else 1.0}
    return Fit("re_ml", d.names, beta, np.linalg.inv(s[:k, :k]) * se2, n, None, stats, d)


def xtgee(df: DataFrame, y: str, *terms: str, unit: str, predicate=None, max_steps: int = 100) -> Fit:
    """Gaussian, identity link, exchangeable correlation; cov is the uncorrected group sandwich, info holds the working one."""
    d, means = _prepared(df, y, terms, unit, predicate)
    p = len(d.terms)
    k = p + 1
    beta = fit_rows(Design(d.rows, y, d.terms, True, d.source)).beta
    rows = d.rows.join(means, "g").persist()
    try:
        for _ in range(max_steps):
            e = F.col("y") - linear(d.x(), beta)
            per = rows.groupBy("g").agg(F.sum(e).alias("s"), F.sum(e * e).alias("q"), F.count("*").alias("t"))
            r = per.agg(F.sum("t").alias("n"), F.sum("q").alias("q"), F.sum(F.col("s") ** 2 - F.col("q")).alias("cross"), F.sum(F.col("t") * (F.col("t") - 1)).alias("pairs"), F.max("t").alias("most"), F.count("*").alias("g")).first()
            phi = r["q"] / r["n"]
            rho = r["cross"] / (phi * r["pairs"]) if r["pairs"] else 0.0
            if 1 + (r["most"] - 1) * rho <= 0 or rho >= 1:
                raise ValueError("no valid exchangeable correlation")
            theta = 1 - F.sqrt((1 - F.lit(rho)) / (1 + (F.col("t") - 1) * F.lit(rho)))
            scale = 1 / math.sqrt(phi * (1 - rho))
            x = [scale * (1 - theta)] + [scale * (F.col(f"x{i}") - theta * F.col(f"m_x{i}")) for i in range(p)]
            _, m = cross_products(rows, [*x, scale * (F.col("y") - theta * F.col("m_y"))])
            bread = solved(m[:k, :k], d.names)
            new = bread @ m[:k, k]
            done = np.abs(new - beta).max() <= 1e-12 * max(1.0, np.abs(new).max())
            beta = new
            if done:
                break
        error = scale * (F.col("y") - theta * F.col("m_y")) - linear(x, beta)
        groups, middle = meat(rows, [error * c for c in x], True)
    finally:
        rows.unpersist()
    return Fit("gee", d.names, beta, bread @ middle @ bread, r["n"], None, {"phi": phi, "rho": rho, "groups": groups}, d, {"working": bread})
