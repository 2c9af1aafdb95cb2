"""Likelihoods of two equations: zero-inflated counts, and sample selection by maximum likelihood.

Both are row models for the Newton steps of ``likelihood.maximise``: one job a step, whatever the number of rows, with
model, robust or cluster covariance.  The second equation's columns travel as extras of the sample.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.safe import number, truth
from ..plans.moments import Design, design, partial_sums
from .likelihood import RowModel, _counts, _log_odds, _split, maximise, negative_binomial_rows
from .linear import Fit
from .other import heckman
from .rows import q

EM_STEPS = 20


def _logistic(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def zero_inflated_rows(k: int, m: int, negative_binomial: bool) -> RowModel:
    """Parameters: k of the count, m of the odds of a certain zero, and for NB2 the log of alpha."""

    def rows(b, x, y, extra):
        z = extra[:, :m]
        eta, odds = x @ b[:k], z @ b[k : k + m]
        mu, share = np.exp(eta), _logistic(odds)
        log_rest, zero = -np.logaddexp(0, odds), y == 0
        if negative_binomial:
            own = np.r_[b[:k], b[-1]]
            ll, score = negative_binomial_rows(own, x, y, extra)
        else:
            ll, score = y * eta - mu - dist.lgamma(y + 1), (y - mu)[:, None] * x
        # a zero is of the count with this chance, given that it is a zero
        certain = odds + log_rest
        of_zero = np.logaddexp(certain, log_rest + ll)
        of_count = np.where(zero, np.exp(np.where(zero, log_rest + ll - of_zero, 0.0)), 1.0)
        score = of_count[:, None] * score
        by_odds = (1 - of_count - share)[:, None] * z
        parts = [score[:, :k], by_odds, score[:, k:]] if negative_binomial else [score, by_odds]
        return np.where(zero, of_zero, log_rest + ll), np.column_stack(parts)

    return rows


def _em_sums(b: np.ndarray, k: int, m: int):
    """Scores and information of both parts, each zero dealt between them by its chance."""

    def run(values: np.ndarray) -> np.ndarray:
        x, y, z = _split(values, k)
        mu, share = np.exp(np.clip(x @ b[:k], -30, 30)), _logistic(z @ b[k:])
        zero = y == 0
        certain = np.where(zero, share / np.maximum(share + (1 - share) * np.exp(-mu), 1e-300), 0.0)
        w = 1 - certain
        v = share * (1 - share)
        return np.r_[x.T @ (w * (y - mu)), (x.T @ (x * (w * mu)[:, None])).ravel(), z.T @ (certain - share), (z.T @ (z * v[:, None])).ravel()]

    return run


def _inflated(df: DataFrame, y: str, terms: Sequence[str], inflate: Sequence[str], kind: str, predicate, robust: bool, cluster: str | None, constant: bool) -> Fit:
    sample = df if predicate is None else df.where(truth(predicate))
    second = design(sample, y, inflate, None, True, outcome=F.lit(0.0))
    extra = {f"z{i}": t.column() for i, t in enumerate(second.terms)}
    d = design(sample, y, terms, None, constant, None, cluster, {"z_cons": F.lit(1.0), **extra})
    n, mean = _counts(d)
    zeros = d.rows.agg(F.avg((F.col("y") == 0).cast("double"))).first()[0]
    if not 0 < zeros < 1:
        raise ValueError("the outcome needs zeros and others")
    k, m, z = d.k, second.k, ["z_cons", *extra]
    b = np.zeros(k + m)
    if constant:
        b[0] = math.log(mean / max(1 - zeros / 2, 0.05))
    b[k] = _log_odds(min(max(zeros - math.exp(-mean), 0.05), 0.95))
    columns = [*d.x(), F.col("y"), *map(F.col, z)]
    d.rows = d.rows.persist()
    try:
        for _ in range(EM_STEPS):
            s = partial_sums(d.rows, columns, _em_sums(b, k, m))
            h, g = s[k : k + k * k].reshape(k, k), s[k + k * k + m :].reshape(m, m)
            step = np.r_[np.linalg.lstsq(h, s[:k], rcond=None)[0], np.linalg.lstsq(g, s[k + k * k : k + k * k + m], rcond=None)[0]]
            b = b + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-3:
                break
        start = np.r_[b, 0.0] if kind == "zinb" else b
        names = [*d.names, *[f"inflate:{t}" for t in second.names], *(["lnalpha"] if kind == "zinb" else [])]
        fit = maximise(d, zero_inflated_rows(k, m, kind == "zinb"), start, names, kind, z, robust, cluster is not None)
    finally:
        d.rows.unpersist()
    fit.stats |= {"zeros": zeros, "n": n}
    fit.info |= {"k": k, "m": m, "inflate": z}
    return fit


def zip_(df: DataFrame, y: str, *terms: str, inflate: Sequence[str] = (), predicate=None, robust: bool = False, cluster: str | None = None, constant: bool = True) -> Fit:
    """Zero-inflated Poisson; ``inflate`` has a constant always. EM steps lead to where Newton steps end."""
    return _inflated(df, y, terms, inflate, "zip", predicate, robust, cluster, constant)


def zinb(df: DataFrame, y: str, *terms: str, inflate: Sequence[str] = (), predicate=None, robust: bool = False, cluster: str | None = None, constant: bool = True) -> Fit:
    """Zero-inflated NB2; the last parameter is the log of alpha."""
    return _inflated(df, y, terms, inflate, "zinb", predicate, robust, cluster, constant)


def selection_rows(k: int, m: int) -> RowModel:
    """Parameters: k of the outcome, m of selection, log sigma, atanh rho. Extras: m columns and whether the row is selected."""

    def rows(b, x, y, extra):
        z, chosen = extra[:, :m], extra[:, m] == 1
        s, rho = math.exp(b[-2]), math.tanh(b[-1])
        if 1 - rho * rho < 1e-12:
            # too far: the step is halved
            return np.full(len(y), -np.inf), np.zeros((len(y), len(b)))
        c = 1 / math.sqrt(1 - rho * rho)
        zg = z @ b[k : k + m]
        e = np.where(chosen, (y - x @ b[:k]) / s, 0.0)
        a = np.where(chosen, c * (zg + rho * e), -zg)
        ll = dist.log_normal_cdf(a) + np.where(chosen, -0.5 * e * e - b[-2] - 0.5 * dist.LOG_2PI, 0.0)
        mills = dist.mills(a)
        by_e = np.where(chosen, mills * rho * c - e, 0.0)
        by_rho = np.where(chosen, mills * (e * c + (zg + rho * e) * rho * c**3), 0.0)
        return ll, np.column_stack([(-by_e / s)[:, None] * x, (np.where(chosen, mills * c, -mills))[:, None] * z, np.where(chosen, -by_e * e - 1, 0.0), by_rho * (1 - rho * rho)])

    return rows


def heckman_ml(df: DataFrame, y: str, *terms: str, selected: str, select: Sequence[str], predicate=None, robust: bool = False, cluster: str | None = None) -> Fit:
    """Selection and outcome in one likelihood, from the two-step estimates. Outcome and terms need to be there in selected rows
    only. Statistics: sigma, rho and the Wald test of rho = 0. Terms are plain variables."""
    if any("." in t for t in terms):
        raise ValueError("factor terms are for the selection equation only")
    first = heckman(df, y, *terms, selected=selected, select=select, predicate=predicate)
    probit = first.info["first"]
    sample = df if predicate is None else df.where(truth(predicate))
    chosen = number(q(selected)) == 1
    # what a row that isn't selected has there doesn't count
    names = [f"__term_{i}" for i in range(len(terms))]
    sample = sample.withColumns({n: F.when(chosen, number(q(t))).otherwise(0.0) for n, t in zip(names, terms, strict=True)})
    outcome = F.when(chosen, number(q(y))).otherwise(0.0)
    extra = {"z_cons": F.lit(1.0), **{f"z{i}": t.column() for i, t in enumerate(probit.design.terms)}, "chosen": number(q(selected))}
    d = design(sample, y, names, None, True, None, cluster, extra, outcome=outcome)
    k, m = d.k, probit.design.k
    rho = min(max(first.stats["rho"], -0.9), 0.9)
    start = np.r_[first.beta[:k], probit.beta, math.log(first.stats["sigma"]), math.atanh(rho)]
    labels = ["_cons", *terms, *[f"select:{n}" for n in probit.names], "lnsigma", "athrho"]
    fit = maximise(d, selection_rows(k, m), start, labels, "heckman_ml", list(extra), robust, cluster is not None)
    wald = (fit["athrho"] / fit.se[-1]) ** 2
    fit.stats |= {"sigma": math.exp(fit["lnsigma"]), "rho": math.tanh(fit["athrho"]), "rho_chi2": wald, "rho_p": dist.chi2_upper(wald, 1), "selected": first.n}
    return fit
