"""Treatment effects in two groups and two periods, and fixed-effects logit.

``drdid`` stacks the equations of its steps (least squares, logit, weighted means) and takes the covariance of the whole
stack, by row or by cluster: two jobs beyond the steps themselves.  ``xtlogit_fe`` conditions on each group's number of
successes; the sum over all ways to place them is a recursion over the group's rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.safe import number
from ..plans.moments import Design, design, linear, partial_sums
from .likelihood import _cluster_meat, _kernel, logit_rows, maximise
from .linear import Fit, fit_rows, regress
from .rows import names_of, q

#: Rows of a group whose successes are placed in all ways; more are an error.
MAX_GROUP = 10_000
#: Numbers of one array while groups are worked on together.
TOGETHER = 200_000
METHODS = ("or", "ipw", "aipw")


def did(df: DataFrame, y: str, *controls: str, treatment: str, post: str, predicate=None, robust: bool = True, cluster: str | None = None) -> Fit:
    """Least squares on treatment, post, their product and controls; the product's coefficient is the effect."""
    if taken := {"__treated_post"} & set(names_of(df)):
        raise ValueError(f"reserved name: {taken}")
    with_product = df.withColumn("__treated_post", number(q(treatment)) * number(q(post)))
    fit = regress(with_product, y, treatment, post, "__treated_post", *controls, predicate=predicate, robust=robust and cluster is None, cluster=cluster)
    fit.names = ["did" if n == "__treated_post" else n for n in fit.names]
    fit.kind = "did"
    return fit


def _stack(method: str, k: int):
    """Estimating equations: parameters are logit and least squares coefficients as the method needs them, then cell means."""

    def rows(b, x, y, extra):
        treated, post = extra[:, 0], extra[:, 1]
        parts, at = [], 0
        odds = late = early = None
        if method != "or":
            odds = np.exp(x @ b[:k])
            parts.append((treated - odds / (1 + odds))[:, None] * x)
            at = k
        if method != "ipw":
            late, early = x @ b[at : at + k], x @ b[at + k : at + 2 * k]
            parts += [((1 - treated) * post * (y - late))[:, None] * x, ((1 - treated) * (1 - post) * (y - early))[:, None] * x]
            at += 2 * k
        if method == "or":
            parts.append(np.column_stack([treated * post * (y - b[at]), treated * (1 - post) * (y - b[at + 1]), treated * (late - early - b[at + 2])]))
        else:
            r = y if method == "ipw" else y - np.where(post == 1, late, early)
            w = np.where(treated == 1, 1.0, odds)
            cells = (treated * post, treated * (1 - post), (1 - treated) * post, (1 - treated) * (1 - post))
            parts.append(np.column_stack([w * c * (r - b[at + i]) for i, c in enumerate(cells)]))
        return np.zeros(len(y)), np.column_stack(parts)

    return rows


def drdid(df: DataFrame, y: str, *covariates: str, treatment: str, post: str, method: str = "aipw", predicate: str | Column | None = None, cluster: str | None = None) -> Fit:
    """The effect on the treated by outcome regressions of the untreated (or), by weights from a logit (ipw), or by both (aipw),
    which holds if either is right. Rows are of two periods, of the same units (then name them as cluster) or others.

    Standard errors count every step's own uncertainty.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    d = design(df, y, covariates, predicate, True, None, cluster, {"treated": number(q(treatment)), "post": number(q(post))})
    k, x = d.k, d.x()
    cells = {(r["treated"], r["post"]): r["n"] for r in d.rows.groupBy("treated", "post").agg(F.count("*").alias("n")).limit(5).collect()}
    if set(cells) != {(0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (1.0, 1.0)}:
        raise ValueError("treatment and post must be 0 and 1, and each of the four groups needs rows")
    start: list[np.ndarray] = []
    d.rows = d.rows.persist()
    try:
        if method != "or":
            chance = Design(d.rows.withColumn("y", F.col("treated")), treatment, d.terms, True, d.source)
            first = maximise(chance, logit_rows, np.zeros(k), d.names, "logit")
            d.rows.persist()
            start.append(first.beta)
        if method != "ipw":
            for period in (1.0, 0.0):
                start.append(fit_rows(Design(d.rows.where((F.col("treated") == 0) & (F.col("post") == period)), y, d.terms, True, d.source)).beta)
        late, early = (linear(x, start[-2]), linear(x, start[-1])) if method != "ipw" else (F.lit(0.0), F.lit(0.0))
        one, two = F.col("treated") == 1, F.col("post") == 1
        if method == "or":
            means = d.rows.agg(F.avg(F.when(one & two, F.col("y"))), F.avg(F.when(one & ~two, F.col("y"))), F.avg(F.when(one, late - early))).first()
            sign = np.array([1.0, -1.0, -1.0])
        else:
            r = F.col("y") if method == "ipw" else F.col("y") - F.when(two, late).otherwise(early)
            w = F.when(one, 1.0).otherwise(F.exp(linear(x, start[0])))
            means = d.rows.agg(*[F.sum(F.when(a & c, w * r)) / F.sum(F.when(a & c, w)) for a, c in ((one, two), (one, ~two), (~one, two), (~one, ~two))]).first()
            sign = np.array([1.0, -1.0, -1.0, 1.0])
        theta = np.concatenate([*start, np.array(list(means), float)])
        columns, model, p = [*x, F.col("y"), F.col("treated"), F.col("post")], _stack(method, k), len(theta)
        now = partial_sums(d.rows, columns, _kernel(model, theta, k, "all"))
        slope = now[2 + p :].reshape(p, p).T
        if cluster:
            groups, middle = _cluster_meat(d, columns, model, theta, k)
            middle = middle * groups / (groups - 1)
        else:
            middle = partial_sums(d.rows, columns, _kernel(model, theta, k, "meat")).reshape(p, p)
        bread = np.linalg.inv(slope)
        cov = bread @ middle @ bread.T
        pick = np.concatenate([np.zeros(p - len(sign)), sign])
        return Fit("drdid", ["att"], np.array([pick @ theta]), np.array([[pick @ cov @ pick]]), int(now[1]), None, {"treated": cells[1.0, 0.0] + cells[1.0, 1.0]}, d, {"stack": theta, "stack_cov": cov, "method": method})
    finally:
        d.rows.unpersist()


def placed(w: np.ndarray, x: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For groups of equally many rows (groups by rows, by columns for x): of all choices of s rows, each weighing the product of
    its w, the log of the total weight, and mean and second moment of the chosen rows' sum of x.

    Weights are scaled so that choices of s rows weigh most, and the sums once more where they grow.
    """
    count, n, k = x.shape
    logs = np.log(w)
    low, high = np.full(count, -60.0), np.full(count, 60.0)
    for _ in range(60):
        middle = (low + high) / 2
        few = (1 / (1 + np.exp(-np.clip(logs + middle[:, None], -500, 500)))).sum(1) < s
        low, high = np.where(few, middle, low), np.where(few, high, middle)
    shift = (low + high) / 2
    w = np.exp(logs + shift[:, None])
    total, first, second, scale = np.zeros((count, s + 1)), np.zeros((count, s + 1, k)), np.zeros((count, s + 1, k, k)), np.zeros(count)
    total[:, 0] = 1.0
    for i in range(n):
        a, wi = x[:, i], w[:, i]
        outer = a[:, :, None] * a[:, None, :]
        cross = a[:, None, :, None] * first[:, :-1, None, :]
        second[:, 1:] += wi[:, None, None, None] * (second[:, :-1] + cross + cross.swapaxes(2, 3) + outer[:, None] * total[:, :-1, None, None])
        first[:, 1:] += wi[:, None, None] * (first[:, :-1] + a[:, None] * total[:, :-1, None])
        total[:, 1:] += wi[:, None] * total[:, :-1]
        top = total.max(1)
        if (top > 1e100).any():
            total, first, second, scale = total / top[:, None], first / top[:, None, None], second / top[:, None, None, None], scale + np.log(top)
    return np.log(total[:, s]) + scale - s * shift, first[:, s] / total[:, s, None], second[:, s] / total[:, s, None, None]


def _alike(x: np.ndarray, chosen: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums over groups of equally many rows and successes."""
    s, n = int(chosen[0].sum()), chosen.shape[1]
    # the rarer outcome is placed
    sign, s, picked = (1.0, s, chosen) if 2 * s <= n else (-1.0, n - s, ~chosen)
    eta = x @ b
    middle = eta.mean(1)
    size, first, second = placed(np.exp(sign * (eta - middle[:, None])), sign * x, s)
    sums = sign * (x * picked[:, :, None]).sum(1)
    ll = sums @ b - (size + s * sign * middle)
    return np.concatenate([[ll.sum()], (sums - first).sum(0), (second - first[:, :, None] * first[:, None, :]).sum(0).ravel()])


def _conditional(groups: DataFrame, b: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Log likelihood, score and information over groups."""
    k = len(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + k + k * k)
        for batch in batches:
            lists = batch.column(0)
            edge, rows = np.asarray(lists.offsets), lists.values
            y = np.asarray(rows.field(0), float)
            x = np.column_stack([np.asarray(rows.field(i + 1), float) for i in range(k)]) - mean
            sizes = np.diff(edge)
            successes = np.diff(np.concatenate([[0.0], np.cumsum(y)])[edge - edge[0]]).astype(int)
            # groups of equally many rows and successes go together, a bounded number at a time
            for n, s in sorted(set(zip(sizes.tolist(), successes.tolist(), strict=True))):
                alike = np.flatnonzero((sizes == n) & (successes == s))
                step = max(1, TOGETHER // (n * k * k))
                for at in range(0, len(alike), step):
                    rows_at = edge[alike[at : at + step]][:, None] + np.arange(n)
                    total += _alike(x[rows_at], y[rows_at] == 1, b)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "value"])

    out = groups.select("rows").mapInArrow(run, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(1 + k + k * k)
    for r in out:
        total[r["at"]] = r["value"]
    return total


def xtlogit_fe(df: DataFrame, y: str, *terms: str, group: str, predicate: str | Column | None = None) -> Fit:
    """Logit conditional on each group's number of successes, whatever it is. Groups of one outcome only tell nothing and drop out."""
    d = design(df, y, terms, predicate, False, None, group)
    k = d.k
    if not k:
        raise ValueError("a term at least")
    sums = d.rows.groupBy("g").agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.count_if(~F.col("y").isin(0.0, 1.0)).alias("bad"))
    r = sums.agg(F.sum("bad").alias("bad"), F.count_if((F.col("s") > 0) & (F.col("s") < F.col("n"))).alias("groups"), F.max(F.when((F.col("s") > 0) & (F.col("s") < F.col("n")), F.col("n"))).alias("most"), F.sum(F.when((F.col("s") > 0) & (F.col("s") < F.col("n")), F.col("n"))).alias("n")).first()
    if r["bad"]:
        raise ValueError("the outcome must be 0 and 1")
    if not r["groups"]:
        raise ValueError("no group with both outcomes")
    if r["most"] > MAX_GROUP:
        raise ValueError(f"a group has more than {MAX_GROUP} rows")
    both = d.rows.join(sums.where("s > 0 AND s < n").select("g"), "g")
    mean = np.array(list(both.agg(*[F.avg(c) for c in d.x()]).first()), float)
    groups = both.groupBy("g").agg(F.collect_list(F.struct("y", *[c.alias(f"x{i}") for i, c in enumerate(d.x())])).alias("rows")).persist()
    try:
        b = np.zeros(k)
        now = _conditional(groups, b, mean)
        for _ in range(100):
            info = now[1 + k :].reshape(k, k)
            if np.linalg.matrix_rank(info / np.sqrt(np.outer(np.diag(info), np.diag(info)))) < k if (np.diag(info) > 0).all() else True:
                raise ValueError("no variation within groups")
            step = np.linalg.solve(info, now[1 : 1 + k])
            part = 1.0
            while True:
                after = _conditional(groups, b + part * step, mean)
                if np.isfinite(after).all() and after[0] >= now[0] - 1e-9 * abs(now[0]):
                    break
                part /= 2
                if part < 1e-6:
                    raise ValueError("no convergence")
            b, now = b + part * step, after
            if np.abs(step).max() < 1e-9 * max(1.0, np.abs(b).max()):
                break
        else:
            raise ValueError("no convergence")
        return Fit("xtlogit_fe", d.names, b, np.linalg.inv(now[1 + k :].reshape(k, k)), int(r["n"]), None, {"ll": float(now[0]), "groups": r["groups"]}, d)
    finally:
        groups.unpersist()


__all__: Sequence[str] = ["METHODS", "did", "drdid", "placed", "xtlogit_fe"]
