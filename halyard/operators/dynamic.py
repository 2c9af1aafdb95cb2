"""Dynamic panels: difference GMM with lagged levels as instruments.

A unit is one short list of (period, outcome, regressors), so a row for each period at most.  Each step adds up blocks of
units in numpy and the blocks in Spark: what comes to the driver are matrices of the instruments and regressors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..plans.moments import Design, design
from .linear import Fit
from .rows import need, q

#: More periods, or more instruments, are an error.
MAX_PERIODS, MAX_INSTRUMENTS = 200, 2_000


def _unit_sums(units: DataFrame, kernel: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], k: int) -> np.ndarray:
    """Adds up kernel(periods, outcomes, regressors) over units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            lists = batch.column(0)
            edge, rows = np.asarray(lists.offsets), lists.values
            columns = np.column_stack([np.asarray(rows.field(i), float) for i in range(k + 2)])
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                part = kernel(columns[a:b, 0].astype(int), columns[a:b, 1], columns[a:b, 2:])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "value"])

    out = units.select("rows").mapInArrow(run, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(len(out))
    for r in out:
        total[r["at"]] = r["value"]
    return total


class _Layout:
    """Columns of a unit's differenced equations and instruments."""

    def __init__(self, periods: int, k: int, lags: int, first: int, last: int, collapse: bool):
        self.periods, self.k, self.lags, self.first = periods, k, lags, first
        pairs = [(p, s) for p in range(lags + 1, periods) for s in range(first, min(last, p) + 1)]
        self.place = {x: (x[1] - first if collapse else i) for i, x in enumerate(pairs)}
        self.n_levels = max(self.place.values(), default=-1) + 1
        self.size = self.n_levels + k
        self.last = last

    def equations(self, t: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Periods, differenced outcome, differenced lags and regressors, instruments."""
        level = np.full(self.periods, np.nan)
        level[t] = y
        wide = np.full((self.periods, self.k), np.nan)
        wide[t] = x
        dy, dx = np.full(self.periods, np.nan), np.full((self.periods, self.k), np.nan)
        dy[1:], dx[1:] = np.diff(level), np.diff(wide, axis=0)
        at = np.arange(self.lags + 1, self.periods)
        design_ = np.column_stack([*[dy[at - j] for j in range(1, self.lags + 1)], dx[at]])
        good = np.isfinite(dy[at]) & np.isfinite(design_).all(1)
        at, design_ = at[good], design_[good]
        z = np.zeros((len(at), self.size))
        for i, p in enumerate(at):
            for s in range(self.first, min(self.last, p) + 1):
                if np.isfinite(level[p - s]):
                    z[i, self.place[p, s]] = level[p - s]
        z[:, self.n_levels :] = dx[at]
        return at, dy[at], design_, z


def _products(layout: _Layout):
    def run(t, y, x):
        at, dy, dx, z = layout.equations(t, y, x)
        # neighbouring differences share an error: 2 on the diagonal, -1 beside it
        h = 2.0 * np.eye(len(at)) - (np.abs(at[:, None] - at[None, :]) == 1)
        return np.concatenate([(z.T @ dx).ravel(), z.T @ dy, (z.T @ h @ z).ravel(), [len(at), float(len(at) > 0)]])

    return run


def _residual_sums(layout: _Layout, beta: np.ndarray):
    def run(t, y, x):
        at, dy, dx, z = layout.equations(t, y, x)
        e = dy - dx @ beta
        score = z.T @ e
        out = [np.outer(score, score).ravel(), score, [e @ e]]
        for j in (1, 2):
            earlier = np.zeros(len(at))
            same = at[:, None] == at[None, :] + j
            earlier[same.any(1)] = (same @ e)[same.any(1)]
            w = earlier @ e
            out += [[w, w * w], earlier @ dx, score * w]
        return np.concatenate(out)

    return run


def _inverse(a: np.ndarray) -> np.ndarray:
    scale = np.sqrt(np.clip(np.diag(a), 1e-300, None))
    return np.linalg.pinv(a / np.outer(scale, scale), rcond=1e-12, hermitian=True) / np.outer(scale, scale)


def xtabond(df: DataFrame, y: str, *terms: str, unit: str, time: str, lags: int = 1, first: int = 2, last: int | None = None, collapse: bool = False, twostep: bool = False, robust: bool = True, predicate: str | Column | None = None) -> Fit:
    """Differences of y on its own lagged differences and those of the terms.

    Instruments are the levels of y from ``first`` periods before on, up to ``last``, for each period apart (with
    ``collapse``: for each lag), and the terms' differences. One step weighs by the differences' own pattern, two steps by
    the first residuals' products. Statistics: ``sargan`` with ``sargan_df`` (from residuals' products in two steps: Hansen's),
    ``m1`` and ``m2`` for correlation of the residuals one and two periods apart. ``time`` is a whole number; periods that a
    unit lacks break its differences; a unit with a period twice is an error.
    """
    if lags < 1 or first < 2:
        raise ValueError("one lag at least, and instruments from two periods before on")
    need(df, unit, time)
    d = design(df, y, terms, predicate, constant=False, cluster=unit, extra={"t": q(time)})
    k, names = len(d.terms), [f"L{j}.{y}" for j in range(1, lags + 1)]
    low, high, n = d.rows.agg(F.min("t"), F.max("t"), F.count("*")).first()
    if not n:
        raise ValueError("no observations")
    periods = int(high - low) + 1
    if periods > MAX_PERIODS:
        raise ValueError(f"more than {MAX_PERIODS} periods")
    if d.rows.groupBy("g", "t").agg(F.count("*").alias("n")).where("n > 1 OR t <> floor(t)").limit(1).count():
        raise ValueError("a unit has a period twice, or a period is no whole number")
    layout = _Layout(periods, k, lags, first, last or periods, collapse)
    if layout.size > MAX_INSTRUMENTS:
        raise ValueError(f"more than {MAX_INSTRUMENTS} instruments")
    values = F.struct((F.col("t") - low).alias("t"), "y", *[F.col(f"x{i}") for i in range(k)])
    units = d.rows.groupBy("g").agg(F.sort_array(F.collect_list(values)).alias("rows"))
    s, p = layout.size, lags + k
    total = _unit_sums(units, _products(layout), k)
    zx, zy, zhz, (used, groups) = total[: s * p].reshape(s, p), total[s * p : s * p + s], total[s * p + s : s * p + s + s * s].reshape(s, s), total[-2:]
    if used <= p:
        raise ValueError("too few observations")
    live = np.diag(zhz) > 0
    if live.sum() < p:
        raise ValueError("fewer instruments than regressors")

    def solve(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bread = zx.T @ w @ zx
        if np.linalg.matrix_rank(bread / np.sqrt(np.outer(np.diag(bread), np.diag(bread)))) < p:
            raise ValueError("the instruments don't tell the regressors apart")
        bread = np.linalg.inv(bread)
        return bread, bread @ zx.T @ w @ zy

    def measured(beta: np.ndarray) -> dict:
        out = _unit_sums(units, _residual_sums(layout, beta), k)
        found, at = {"middle": out[: s * s].reshape(s, s), "score": out[s * s : s * s + s], "rss": out[s * s + s]}, s * s + s + 1
        for j in (1, 2):
            found[j] = out[at], out[at + 1], out[at + 2 : at + 2 + p], out[at + 2 + p : at + 2 + p + s]
            at += 2 + p + s
        return found

    weight = _inverse(zhz)
    bread, beta = solve(weight)
    step = measured(beta)
    sigma2 = step["rss"] / (2 * (used - p))
    cov = bread @ zx.T @ weight @ step["middle"] @ weight @ zx @ bread if robust or twostep else bread * sigma2
    sargan = step["score"] @ weight @ step["score"] / sigma2
    if twostep:
        weight = _inverse(step["middle"])
        bread, beta = solve(weight)
        cov, step = bread, measured(beta)
        sargan = step["score"] @ weight @ step["score"]
    stats = {"sargan": float(sargan), "sargan_df": int(live.sum() - p), "groups": int(groups), "instruments": int(live.sum()), "sigma2": sigma2}
    stats["sargan_p"] = dist.chi2_upper(stats["sargan"], stats["sargan_df"]) if stats["sargan_df"] else math.nan
    for j in (1, 2):
        w, ww, wx, zw = step[j]
        spread = ww - 2 * wx @ bread @ zx.T @ weight @ zw + wx @ cov @ wx
        stats[f"m{j}"] = float(w / math.sqrt(spread)) if spread > 0 else math.nan
        stats[f"m{j}_p"] = dist.z_two_sided(stats[f"m{j}"])
    fit = Fit("xtabond", names + d.names, beta, cov, int(used), None, stats, Design(d.rows, y, d.terms, False, df))
    return fit
