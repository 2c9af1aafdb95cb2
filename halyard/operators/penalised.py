"""Penalised least squares, its cross-validation, and double machine learning.

The rows are read twice, whatever the number of penalties, folds and steps: once for the means, once for the sums of
products of each fold.  A fold's training sums are the whole's less its own, and what a fold held out loses is a
quadratic form of its own sums, so paths and cross-validation are small algebra on matrices of the regressors.

Objectives: ``lasso`` and ``elasticnet`` minimise half the mean squared residual plus alpha times (l1_ratio times the
absolute values and half of (1 - l1_ratio) times the squares of the coefficients); ``ridge`` minimises the sum of squared
residuals plus alpha times the squares.  The intercept isn't penalised and columns aren't rescaled.  Folds come from a
hash of the row's place, or from a column of the caller's.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.moments import Design, design, linear, meat
from ..sources.tables import ROW
from .linear import Fit, fit_rows
from .rows import need

SWEEPS, TIGHT = 100_000, 1e-13


@dataclass
class Moments:
    """Number of rows, sums and sums of products of columns that were shifted by ``shift``."""

    n: int
    sums: np.ndarray
    products: np.ndarray
    shift: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.sums + other.sums, self.products + other.products, self.shift)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.sums - other.sums, self.products - other.products, self.shift)

    def centred(self, constant: bool) -> np.ndarray:
        """Sums of products about the means, or about zero."""
        if constant:
            return self.products - np.outer(self.sums, self.sums) / self.n
        m = self.shift
        return self.products + np.outer(m, self.sums) + np.outer(self.sums, m) + self.n * np.outer(m, m)

    def residual_products(self, a: np.ndarray, b: np.ndarray, constants: tuple[float, float]) -> float:
        """Sum of (a'z + constant) times (b'z + constant) over the rows, for weights of the unshifted columns."""
        c, d = constants[0] + a @ self.shift, constants[1] + b @ self.shift
        return float(a @ self.products @ b + c * (b @ self.sums) + d * (a @ self.sums) + self.n * c * d)

    def intercept(self, beta: np.ndarray, outcome: int, constant: bool) -> float:
        if not constant:
            return 0.0
        mean = self.shift + self.sums / self.n
        return float(mean[outcome] - beta @ mean[: len(beta)])


def fold_of(folds: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(ROW)), F.lit(folds))


def moments_by_fold(rows: DataFrame, columns: Sequence[str], fold: str | None = None) -> dict[object, Moments]:
    """Moments of the columns in each fold, or of all rows under the key None."""
    means = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns]).first()
    if not means["n"]:
        raise ValueError("no observations")
    shift, k = np.array([means[c] for c in columns]), len(columns)
    z = [F.col(c) - F.lit(float(m)) for c, m in zip(columns, shift, strict=True)]
    sums = [F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(z)], *[F.sum(z[i] * z[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]]
    out = {}
    for r in (rows.groupBy(fold) if fold else rows.groupBy()).agg(*sums).collect():
        products = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                products[i, j] = products[j, i] = r[f"p{i}_{j}"]
        out[r[fold] if fold else None] = Moments(r["n"], np.array([r[f"s{i}"] for i in range(k)]), products, shift)
    return out


def descend(gram: np.ndarray, target: np.ndarray, alpha: float, l1_ratio: float, start: np.ndarray | None = None) -> np.ndarray:
    """Coordinate descent on mean products: each coefficient in turn at its own best, until none moves."""
    beta = np.zeros(len(target)) if start is None else start.copy()
    rest = target - gram @ beta
    cut, ridge, diagonal = alpha * l1_ratio, alpha * (1 - l1_ratio), np.diag(gram)
    for _ in range(SWEEPS):
        moved = 0.0
        for j in range(len(beta)):
            old, pull = beta[j], rest[j] + diagonal[j] * beta[j]
            size = diagonal[j] + ridge
            beta[j] = math.copysign(max(abs(pull) - cut, 0.0), pull) / size if size > 0 else 0.0
            if beta[j] != old:
                rest -= gram[:, j] * (beta[j] - old)
                moved = max(moved, abs(beta[j] - old) * math.sqrt(max(size, 0.0)))
        if moved <= TIGHT * max(1.0, math.sqrt(float(np.max(np.abs(target), initial=0.0)))):
            return beta
    raise ValueError("coordinate descent did not settle")


def kkt_gap(gram: np.ndarray, target: np.ndarray, beta: np.ndarray, alpha: float, l1_ratio: float) -> float:
    """How far the first-order conditions are from holding: the gradient equals alpha times the sign where a coefficient isn't zero and lies within alpha elsewhere."""
    slope = target - gram @ beta - alpha * (1 - l1_ratio) * beta
    gap = np.where(beta != 0, np.abs(slope - alpha * l1_ratio * np.sign(beta)), np.maximum(np.abs(slope) - alpha * l1_ratio, 0))
    return float(gap.max(initial=0.0))


def ridge_solution(products: np.ndarray, target: np.ndarray, alpha: float) -> np.ndarray:
    return np.linalg.solve(products + alpha * np.eye(len(target)), target) if len(target) else np.zeros(0)


def path_of(m: Moments, alphas: Sequence[float], l1_ratio: float, constant: bool, k: int, outcome: int) -> list[np.ndarray]:
    """Coefficients at each alpha, from the largest down, each started at the one before."""
    c = m.centred(constant) / m.n
    found, beta = {}, None
    for alpha in sorted(set(alphas), reverse=True):
        beta = descend(c[:k, :k], c[:k, outcome], alpha, l1_ratio, beta)
        found[alpha] = beta.copy()
    return [found[a] for a in alphas]


def penalties(m: Moments, l1_ratio: float, constant: bool, k: int, outcome: int, number: int = 100, least: float = 1e-3) -> list[float]:
    """A grid from the smallest alpha that leaves no coefficient, evenly in logarithms."""
    most = float(np.max(np.abs(m.centred(constant)[:k, outcome]), initial=0.0)) / m.n / max(l1_ratio, 1e-3)
    return [most * least ** (i / (number - 1)) for i in range(number)] if most > 0 else [0.0]


def _columns(d: Design) -> list[str]:
    return [f"x{i}" for i in range(len(d.terms))] + ["y"]


def _fit(kind: str, d: Design, m: Moments, beta: np.ndarray, constant: bool, **info) -> Fit:
    """Penalised coefficients have no covariance."""
    k = len(beta)
    a = m.intercept(beta, k, constant)
    weights = np.append(-beta, 1.0)
    rss = m.residual_products(weights, weights, (-a, -a))
    c = m.centred(constant)
    full = np.append(a, beta) if constant else beta
    stats = {"rss": rss, "r2": 1 - rss / c[k, k] if c[k, k] > 0 else 0.0, "nonzero": int((beta != 0).sum())}
    return Fit(kind, d.names, full, np.full((len(full), len(full)), math.nan), m.n, None, stats, d, {"moments": m, **info})


def _one(df: DataFrame, y: str, terms: Sequence[str], predicate, constant: bool) -> tuple[Design, Moments, int]:
    d = design(df, y, terms, predicate, constant)
    return d, moments_by_fold(d.rows, _columns(d))[None], len(d.terms)


def elasticnet(df: DataFrame, y: str, *terms: str, alpha: float, l1_ratio: float, predicate: str | Column | None = None, constant: bool = True) -> Fit:
    if alpha < 0 or not 0 <= l1_ratio <= 1:
        raise ValueError("alpha must not be negative, l1_ratio must lie between 0 and 1")
    d, m, k = _one(df, y, terms, predicate, constant)
    beta = path_of(m, [alpha], l1_ratio, constant, k, k)[0]
    c = m.centred(constant) / m.n
    return _fit("elasticnet", d, m, beta, constant, alpha=alpha, l1_ratio=l1_ratio, kkt=kkt_gap(c[:k, :k], c[:k, k], beta, alpha, l1_ratio))


def lasso(df: DataFrame, y: str, *terms: str, alpha: float, **options) -> Fit:
    fit = elasticnet(df, y, *terms, alpha=alpha, l1_ratio=1.0, **options)
    fit.kind = "lasso"
    return fit


def ridge(df: DataFrame, y: str, *terms: str, alpha: float, predicate: str | Column | None = None, constant: bool = True) -> Fit:
    if alpha < 0:
        raise ValueError("alpha must not be negative")
    d, m, k = _one(df, y, terms, predicate, constant)
    c = m.centred(constant)
    return _fit("ridge", d, m, ridge_solution(c[:k, :k], c[:k, k], alpha), constant, alpha=alpha)


def postlasso(df: DataFrame, y: str, *terms: str, alpha: float, robust: bool = False, predicate: str | Column | None = None, constant: bool = True) -> Fit:
    """Least squares on the columns that the lasso keeps; standard errors take the choice as given."""
    chosen = lasso(df, y, *terms, alpha=alpha, predicate=predicate, constant=constant)
    d = chosen.design
    kept = [i for i, b in enumerate(chosen.beta[constant:]) if b != 0]
    if not kept and not constant:
        raise ValueError("the lasso keeps no column")
    rows = d.rows.select("y", *[F.col(f"x{i}").alias(f"x{at}") for at, i in enumerate(kept)])
    fit = fit_rows(Design(rows, d.outcome, [d.terms[i] for i in kept], constant, d.source), robust)
    fit.kind = "postlasso"
    return fit


def lasso_path(df: DataFrame, y: str, *terms: str, alphas: Sequence[float] | None = None, l1_ratio: float = 1.0, predicate: str | Column | None = None, constant: bool = True) -> DataFrame:
    """alpha, term, estimate along a grid of penalties."""
    d, m, k = _one(df, y, terms, predicate, constant)
    alphas = list(alphas) if alphas is not None else penalties(m, l1_ratio, constant, k, k)
    rows = []
    for alpha, beta in zip(alphas, path_of(m, alphas, l1_ratio, constant, k, k), strict=True):
        full = [m.intercept(beta, k, constant), *beta.tolist()] if constant else beta.tolist()
        rows += [(float(alpha), n, float(b)) for n, b in zip(d.names, full, strict=True)]
    return df.sparkSession.createDataFrame(rows, "alpha double, term string, estimate double")


@dataclass
class Validated:
    """Losses of each candidate in each fold, and the fit at the best candidate."""

    fit: Fit
    losses: list[tuple]

    def table(self, spark) -> DataFrame:
        """l1_ratio, alpha, fold, loss (mean squared error of the rows held out)."""
        return spark.createDataFrame(self.losses, "l1_ratio double, alpha double, fold long, loss double")


def _folded(df: DataFrame, y: str, terms: Sequence[str], folds: int, seed: int, fold: str | None, predicate, constant: bool, also: str | None = None, cluster: str | None = None) -> tuple[Design, list[str], dict[object, Moments]]:
    if folds < 2:
        raise ValueError("two folds at least")
    need(df, *[n for n in (fold, also) if n])
    part = F.col(fold) if fold else fold_of(folds, seed)
    extra = {"fold": part.cast("double")} | ({"d": F.col(also).cast("double")} if also else {})
    d = design(df, y, terms, predicate, constant, None, cluster, extra)
    names = _columns(d) + (["d"] if also else [])
    parts = moments_by_fold(d.rows, names, "fold")
    if len(parts) < 2:
        raise ValueError("the rows lie in one fold")
    return d, names, dict(sorted(parts.items()))


def _total(parts: dict[object, Moments]) -> Moments:
    first, *others = parts.values()
    return sum(others, first)


def _loss(m: Moments, beta: np.ndarray, a: float) -> float:
    weights = np.append(-beta, 1.0)
    return m.residual_products(weights, weights, (-a, -a)) / m.n


def cv_elasticnet(df: DataFrame, y: str, *terms: str, l1_ratio: float | Sequence[float], folds: int = 5, alphas: Sequence[float] | None = None, seed: int = 1, fold: str | None = None, predicate: str | Column | None = None, constant: bool = True) -> Validated:
    """The candidate whose mean loss over folds is least; ties go to the larger penalty."""
    d, _, parts = _folded(df, y, terms, folds, seed, fold, predicate, constant)
    whole, k = _total(parts), len(d.terms)
    losses, best = [], None
    for ratio in [l1_ratio] if isinstance(l1_ratio, (int, float)) else list(l1_ratio):
        grid = list(alphas) if alphas is not None else penalties(whole, ratio, constant, k, k)
        table = np.empty((len(parts), len(grid)))
        for i, (name, m) in enumerate(parts.items()):
            train = whole - m
            for j, beta in enumerate(path_of(train, grid, ratio, constant, k, k)):
                table[i, j] = _loss(m, beta, train.intercept(beta, k, constant))
                losses.append((float(ratio), float(grid[j]), int(name), float(table[i, j])))
        for j, alpha in enumerate(grid):
            if best is None or (table[:, j].mean(), -alpha) < best[0]:
                best = (table[:, j].mean(), -alpha), ratio, alpha
    (loss, _), ratio, alpha = best
    beta = path_of(whole, [alpha], ratio, constant, k, k)[0]
    return Validated(_fit("cvelasticnet", d, whole, beta, constant, alpha=alpha, l1_ratio=ratio, loss=loss), losses)


def cv_lasso(df: DataFrame, y: str, *terms: str, **options) -> Validated:
    out = cv_elasticnet(df, y, *terms, l1_ratio=1.0, **options)
    out.fit.kind = "cvlasso"
    return out


def cv_ridge(df: DataFrame, y: str, *terms: str, folds: int = 5, alphas: Sequence[float] = tuple(10.0**i for i in range(-3, 4)), seed: int = 1, fold: str | None = None, predicate: str | Column | None = None, constant: bool = True) -> Validated:
    d, _, parts = _folded(df, y, terms, folds, seed, fold, predicate, constant)
    whole, k = _total(parts), len(d.terms)
    losses, means = [], []
    for alpha in alphas:
        own = []
        for name, m in parts.items():
            train = whole - m
            c = train.centred(constant)
            beta = ridge_solution(c[:k, :k], c[:k, k], alpha)
            own.append(_loss(m, beta, train.intercept(beta, k, constant)))
            losses.append((0.0, float(alpha), int(name), own[-1]))
        means.append((float(np.mean(own)), -alpha))
    loss, alpha = min(means)[0], -min(means)[1]
    c = whole.centred(constant)
    return Validated(_fit("cvridge", d, whole, ridge_solution(c[:k, :k], c[:k, k], alpha), constant, alpha=alpha, loss=loss), losses)


@dataclass
class CrossFit:
    """The partial effect of a treatment, and its nuisance coefficients for each fold held out."""

    fit: Fit
    nuisance: dict[float, tuple[np.ndarray, float, np.ndarray, float]]

    def residuals(self) -> DataFrame:
        """fold, outcome and treatment less their predictions from the other folds."""
        return self.fit.design.rows.select("fold", *_out_of_fold(self.fit.design, self.nuisance), *(["g"] if "g" in self.fit.design.rows.columns else []))


def _out_of_fold(d: Design, nuisance: dict[float, tuple[np.ndarray, float, np.ndarray, float]]) -> list[Column]:
    x = [F.col(f"x{i}") for i in range(len(d.terms))]
    out = []
    for name, at, value in (("u", 0, "y"), ("v", 2, "d")):
        guess = F.lit(None).cast("double")
        for fold, own in nuisance.items():
            guess = F.when(F.col("fold") == fold, linear(x, own[at]) + F.lit(own[at + 1])).otherwise(guess)
        out.append((F.col(value) - guess).alias(name))
    return out


def dml(df: DataFrame, y: str, treatment: str, *controls: str, folds: int = 5, alpha: float = 1.0, seed: int = 1, fold: str | None = None, cluster: str | None = None, predicate: str | Column | None = None, constant: bool = True) -> CrossFit:
    """Partially linear model: outcome and treatment are predicted by the lasso from the other folds' rows, and the residuals of
    one are regressed on those of the other. The score is orthogonal, so its sandwich, by row or by cluster, needs no term for the nuisance."""
    d, names, parts = _folded(df, y, controls, folds, seed, fold, predicate, constant, treatment, cluster)
    whole, k = _total(parts), len(d.terms)
    nuisance, top, bottom = {}, 0.0, 0.0
    for name, m in parts.items():
        train = whole - m
        if train.n < 2:
            raise ValueError("a fold leaves too few rows")
        by, bd = (path_of(train, [alpha], 1.0, constant, k, at)[0] for at in (k, k + 1))
        ay, ad = train.intercept(by, k, constant), train.intercept(bd, k + 1, constant)
        nuisance[name] = by, ay, bd, ad
        u, v = np.concatenate([-by, [1.0, 0.0]]), np.concatenate([-bd, [0.0, 1.0]])
        top += m.residual_products(u, v, (-ay, -ad))
        bottom += m.residual_products(v, v, (-ad, -ad))
    if bottom <= 0:
        raise ValueError("the treatment doesn't vary beyond its controls")
    theta = top / bottom
    rows = d.rows.select(*_out_of_fold(d, nuisance), *(["g"] if cluster else []))
    groups, middle = meat(rows, [F.col("v") * (F.col("u") - F.lit(theta) * F.col("v"))], cluster is not None)
    scale = groups / (groups - 1) if cluster else 1.0
    fit = Fit("dml", [treatment], np.array([theta]), middle / bottom**2 * scale, whole.n, None, {"alpha": alpha, "folds": len(parts)}, d)
    return CrossFit(fit, nuisance)
