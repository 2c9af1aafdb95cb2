"""Bootstraps of count and binary models, all replicates in the same passes over the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.safe import number
from ..plans.draws import hashed_counts
from ..plans.moments import Design, design
from ..sources.tables import ROW
from .likelihood import logit, poisson
from .linear import Fit
from .rows import q

#: Replicates, and weights of one batch of rows in memory.
MOST_REPS, CELLS = 5000, 2_000_000

#: Of linear predictors and outcomes: log likelihood, its first derivative and minus its second.
Kernel = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _poisson(v: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mu = np.exp(np.minimum(v, 700))
    return y * v - mu, y - mu, mu


def _logit(v: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-np.clip(v, -700, 700)))
    return y * v - np.logaddexp(0, v), y - p, p * (1 - p)


def _pass(d: DataFrame, columns: list[str], kernel: Kernel, which: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihood, score and curvature of the given replicates, each at its own coefficients: one job."""
    k = b.shape[1]
    at = np.triu_indices(k)
    wide = 1 + k + len(at[0])
    batch_rows = max(1, CELLS // max(1, len(which)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(which), wide))
        for batch in batches:
            ids = batch.column(0).to_numpy().view(np.uint64)
            values = np.column_stack([c.to_numpy() for c in batch.columns[1:]])
            for low in range(0, len(ids), batch_rows):
                part = values[low : low + batch_rows]
                x, y, shift = part[:, :k], part[:, k], part[:, k + 1]
                times = hashed_counts(ids[low : low + batch_rows], which)
                ll, first, second = kernel(b @ x.T + shift, y)
                total[:, 0] += (times * ll).sum(axis=1)
                total[:, 1 : 1 + k] += (times * first) @ x
                total[:, 1 + k :] += (times * second) @ (x[:, at[0]] * x[:, at[1]])
        rep, place = np.divmod(np.arange(total.size), wide)
        yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(place), pa.array(total.ravel())], ["rep", "at", "value"])

    sums = np.zeros((len(which), wide))
    for r in d.select(*columns).mapInArrow(run, "rep bigint, at bigint, value double").groupBy("rep", "at").agg(F.sum("value").alias("value")).collect():
        sums[r["rep"], r["at"]] = r["value"]
    info = np.zeros((len(which), k, k))
    info[:, at[0], at[1]] = info[:, at[1], at[0]] = sums[:, 1 + k :]
    return sums[:, 0], sums[:, 1 : 1 + k], info


def _resampled(base: Fit, d: Design, kernel: Kernel, reps: int, seed: int, cluster: bool, offset: bool, max_passes: int) -> Fit:
    if not 2 <= reps <= MOST_REPS:
        raise ValueError(f"2 to {MOST_REPS} replicates")
    unit = F.xxhash64(F.lit(seed), F.col("g") if cluster else F.col("row"))
    shift = F.col("offset") if offset else F.lit(0.0)
    cells = [*d.x(), F.col("y"), shift]
    rows = d.rows.select(unit.alias("u"), *[c.cast("double").alias(f"c{i}") for i, c in enumerate(cells)]).persist()
    columns = ["u", *[f"c{i}" for i in range(len(cells))]]
    try:
        b = np.tile(base.beta, (reps, 1))
        good, step, ll = b.copy(), np.zeros_like(b), np.full(reps, -np.inf)
        open_ = np.arange(reps)
        for _ in range(max_passes):
            now, score, info = _pass(rows, columns, kernel, open_, b[open_])
            left = []
            for i, r in enumerate(open_.tolist()):
                if np.isfinite(now[i]) and now[i] >= ll[r] - 1e-10 * abs(now[i]):
                    good[r], ll[r] = b[r], now[i]
                    try:
                        step[r] = np.linalg.solve(info[i], score[i])
                    except np.linalg.LinAlgError:
                        raise ValueError(f"replicate {r + 1} failed: its columns are collinear") from None
                else:
                    step[r] /= 2
                if np.abs(step[r]).max() > 1e-9 * max(1.0, np.abs(good[r]).max()):
                    left.append(r)
                    b[r] = good[r] + step[r]
            open_ = np.array(left, int)
            if not left:
                break
        else:
            raise ValueError(f"replicate {open_[0] + 1} failed: no maximum was reached")
    finally:
        rows.unpersist()
    base.kind, base.cov, base.df = f"bootstrap {base.kind}", np.atleast_2d(np.cov(good.T, ddof=1)), None
    base.info |= {"percentiles": np.percentile(good, [2.5, 97.5], axis=0), "mean": good.mean(axis=0), "bias": good.mean(axis=0) - base.beta}
    return base


def bootstrap_poisson(df: DataFrame, y: str, *terms: str, reps: int = 200, seed: int = 1, cluster: str | None = None, predicate=None, offset: str | None = None, max_passes: int = 60) -> Fit:
    """Pairs or whole-cluster bootstrap of a Poisson model; a Newton step of all replicates is one job.

    Rows or clusters have independent Poisson(1) counts, from a hash of the seed and of the cluster or the row's place.
    Each replicate starts at the estimates of all rows, has steps of its own and leaves when it is done.  A replicate
    without a maximum is an error: none is drawn again or left out.
    """
    base = poisson(df, y, *terms, predicate=predicate, offset=offset)
    d = design(df, y, terms, predicate, True, None, cluster, {"row": F.xxhash64(ROW), **({"offset": number(q(offset))} if offset else {})})
    return _resampled(base, d, _poisson, reps, seed, cluster is not None, offset is not None, max_passes)


def bootstrap_logit(df: DataFrame, y: str, *terms: str, reps: int = 200, seed: int = 1, cluster: str | None = None, predicate=None, max_passes: int = 60) -> Fit:
    """As ``bootstrap_poisson``, for a logit; a replicate whose outcome is told apart by the terms has no maximum."""
    base = logit(df, y, *terms, predicate=predicate)
    d = design(df, y, terms, predicate, True, None, cluster, {"row": F.xxhash64(ROW)})
    return _resampled(base, d, _logit, reps, seed, cluster is not None, False, max_passes)
