"""Maximum likelihood by Newton steps. Every step is one Spark job that adds up log likelihood, score and curvature."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.safe import number
from ..plans.moments import Design, design, linear, partial_sums
from .linear import Fit
from .rows import need, q

#: (parameters, X, y, extra) to log likelihoods and scores of the rows.
RowModel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
MAX_STEPS, TOLERANCE = 100, 1e-9
TABLED = 4096


def logit_rows(b, x, y, extra):
    eta = x @ b
    return y * eta - np.logaddexp(0, eta), (y - 1 / (1 + np.exp(-eta)))[:, None] * x


def probit_rows(b, x, y, extra):
    sign = 2 * y - 1
    z = sign * (x @ b)
    return dist.log_normal_cdf(z), (sign * dist.mills(z))[:, None] * x


def poisson_rows(b, x, y, extra):
    eta = x @ b + (extra[:, 0] if extra.shape[1] else 0.0)
    mu = np.exp(eta)
    return y * eta - mu - dist.lgamma(y + 1), (y - mu)[:, None] * x


def negative_binomial_rows(b, x, y, extra):
    """NB2; the last parameter is the log of alpha."""
    r = math.exp(-b[-1])
    mu = np.exp(x @ b[:-1])
    # sums of log(r + j) and of 1 / (r + j) below y: a table up to TABLED, differences of lgamma and digamma beyond
    steps = r + np.arange(min(int(y.max(initial=0)), TABLED) + 1)
    n = np.minimum(y, TABLED).astype(int)
    logs, inverse = np.r_[0.0, np.cumsum(np.log(steps))][n], np.r_[0.0, np.cumsum(1 / steps)][n]
    far = y > TABLED
    if far.any():
        logs[far] += dist.lgamma(r + y[far]) - dist.lgamma(np.array([r + TABLED]))
        inverse[far] += dist.digamma_far(r + y[far]) - dist.digamma_far(r + TABLED)
    ll = logs - dist.lgamma(y + 1) + r * np.log(r / (r + mu)) + y * np.log(mu / (r + mu))
    by_r = inverse + np.log(r / (r + mu)) + 1 - (r + y) / (r + mu)
    return ll, np.column_stack([((y - mu) * r / (r + mu))[:, None] * x, -r * by_r])


def tobit_rows(lower: float) -> RowModel:
    """Censored from below; the last parameter is the log of sigma."""

    def rows(b, x, y, extra):
        s, eta = math.exp(b[-1]), x @ b[:-1]
        z, c, cut = (y - eta) / s, (lower - eta) / s, y <= lower
        m = dist.mills(np.where(cut, c, 0.0))
        ll = np.where(cut, dist.log_normal_cdf(np.where(cut, c, 0.0)), -b[-1] - 0.5 * dist.LOG_2PI - 0.5 * z * z)
        return ll, np.column_stack([np.where(cut, -m, z)[:, None] / s * x, np.where(cut, -m * c, z * z - 1)])

    return rows


def truncated_rows(lower: float) -> RowModel:
    def rows(b, x, y, extra):
        s, eta = math.exp(b[-1]), x @ b[:-1]
        z, c = (y - eta) / s, (lower - eta) / s
        m = dist.mills(-c)
        ll = -b[-1] - 0.5 * dist.LOG_2PI - 0.5 * z * z - dist.log_normal_cdf(-c)
        return ll, np.column_stack([((z - m) / s)[:, None] * x, z * z - 1 - m * c])

    return rows


def weibull_rows(b, x, t, extra):
    """Proportional hazards; extra holds the failure flag, the last parameter is the log of the shape."""
    d, p, eta, lt = extra[:, 0], math.exp(b[-1]), x @ b[:-1], np.log(t)
    h = np.exp(eta + p * lt)
    return d * (eta + b[-1] + (p - 1) * lt) - h, np.column_stack([(d - h)[:, None] * x, d * (1 + p * lt) - h * p * lt])


def gompertz_rows(b, x, t, extra):
    d, g, eta = extra[:, 0], b[-1], x @ b[:-1]
    u = g * t
    near = np.abs(u) < 1e-4
    safe = np.where(near, 1.0, u)
    ratio = np.where(near, 1 + u / 2 + u * u / 6, np.expm1(safe) / safe)
    slope = np.where(near, 0.5 + u / 3 + u * u / 8, (safe * np.exp(safe) - np.expm1(safe)) / safe**2)
    h = np.exp(eta) * t * ratio
    return d * (eta + u) - h, np.column_stack([(d - h)[:, None] * x, d * t - np.exp(eta) * t * t * slope])


def exponential_rows(b, x, t, extra):
    eta = x @ b
    h = np.exp(eta) * t
    return extra[:, 0] * eta - h, (extra[:, 0] - h)[:, None] * x


def multinomial_rows(levels: int) -> RowModel:
    """y is coded from 0, the base; parameters are the other levels' coefficients in turn."""

    def rows(b, x, y, extra):
        eta = np.column_stack([np.zeros(len(x)), x @ b.reshape(levels - 1, -1).T])
        eta -= eta.max(1, keepdims=True)
        p = np.exp(eta)
        p /= p.sum(1, keepdims=True)
        n = y.astype(int)
        gap = (n[:, None] == np.arange(1, levels)) - p[:, 1:]
        return np.log(p[np.arange(len(x)), n]), (gap[:, :, None] * x[:, None, :]).reshape(len(x), -1)

    return rows


def _split(v: np.ndarray, k: int):
    return v[:, :k], v[:, k], v[:, k + 1 :]


def _kernel(model: RowModel, b: np.ndarray, k: int, what: str):
    """ll, score and curvature (by central differences of the score), or outer products of scores."""

    def run(values: np.ndarray) -> np.ndarray:
        x, y, extra = _split(values, k)
        ll, s = model(b, x, y, extra)
        if what == "ll":
            return np.array([ll.sum(), len(ll)])
        if what == "meat":
            return np.r_[(s.T @ s).ravel()]
        h = np.empty((len(b), len(b)))
        for j in range(len(b)):
            step = 1e-5 * max(1.0, abs(b[j]))
            up, down = b.copy(), b.copy()
            up[j] += step
            down[j] -= step
            h[j] = (model(up, x, y, extra)[1].sum(0) - model(down, x, y, extra)[1].sum(0)) / (2 * step)
        return np.r_[ll.sum(), len(ll), s.sum(0), h.ravel()]

    return run


def _cluster_meat(d: Design, columns: list[Column], model: RowModel, b: np.ndarray, k: int) -> tuple[int, np.ndarray]:
    p, kind = len(b), d.rows.schema["g"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
                s = model(b, *_split(v, k))[1]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(s[:, j]) for j in range(p))], ["g", *(f"u{j}" for j in range(p))])

    rows = d.rows.select("g", *[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(run, f"g {kind}, " + ", ".join(f"u{j} double" for j in range(p)))
    from ..plans.moments import meat

    return meat(rows, [F.col(f"u{j}") for j in range(p)], True)


def maximise(d: Design, model: RowModel, start: np.ndarray, names: list[str], kind: str, extra: Sequence[str] = (), robust: bool = False, cluster: bool = False) -> Fit:
    """Newton with halved steps. The sample is kept in memory or on disk while it iterates."""
    columns, k = [*d.x(), F.col("y"), *map(F.col, extra)], d.k
    d.rows = d.rows.persist()
    try:
        b, size = start.astype(float), len(start)
        now = partial_sums(d.rows, columns, _kernel(model, b, k, "all"))
        if not len(now):
            raise ValueError("no observations")
        for _ in range(MAX_STEPS):
            score, h = now[2 : 2 + size], now[2 + size :].reshape(size, size)
            info = -(h + h.T) / 2
            scale = np.sqrt(np.clip(np.abs(np.diag(info)), 1e-300, None))
            unit = info / np.outer(scale, scale)
            low = np.linalg.eigvalsh(unit)[0]
            if low < 1e-12:
                unit = unit + np.eye(size) * (1e-6 - low)
            step = np.linalg.solve(unit, score / scale) / scale
            if abs(score @ step) < TOLERANCE * max(1.0, abs(now[0])) * 1e-3 and np.abs(step).max() < 1e-7 * max(1.0, np.abs(b).max()):
                break
            part = 1.0
            while True:
                after = partial_sums(d.rows, columns, _kernel(model, b + part * step, k, "all"))
                if np.isfinite(after).all() and after[0] >= now[0] - 1e-10 * abs(now[0]):
                    break
                part /= 2
                if part < 1e-6:
                    raise ValueError("no convergence")
            b, now = b + part * step, after
        else:
            raise ValueError("no convergence")
        n = int(now[1])
        bread = np.linalg.inv(unit) / np.outer(scale, scale)
        if np.linalg.cond(unit) > 1e12:
            raise ValueError("collinear or separated")
        cov, free = bread, None
        if cluster:
            groups, middle = _cluster_meat(d, columns, model, b, k)
            cov = bread @ middle @ bread * groups / (groups - 1)
        elif robust:
            cov = bread @ partial_sums(d.rows, columns, _kernel(model, b, k, "meat")).reshape(size, size) @ bread * n / (n - 1)
        return Fit(kind, names, b, cov, n, free, {"ll": float(now[0])}, d, {"bread": bread})
    finally:
        d.rows.unpersist()


def _log_odds(share: float) -> float:
    share = min(max(share, 1e-9), 1 - 1e-9)
    return math.log(share / (1 - share))


def _compare(fit: Fit, null: float, slopes: int) -> Fit:
    lr = max(0.0, 2 * (fit.stats["ll"] - null))
    fit.stats |= {"ll_null": null, "lr": lr, "lr_p": dist.chi2_upper(lr, slopes) if slopes else math.nan, "pseudo_r2": 1 - fit.stats["ll"] / null if null else math.nan}
    return fit


def _binary(kind: str, model: RowModel, first, df, y, terms, predicate, robust, cluster, constant) -> Fit:
    d = design(df, y, terms, predicate, constant, None, cluster)
    r = d.rows.agg(F.count("*").alias("n"), F.avg("y").alias("p"), F.count_if(~F.col("y").isin(0.0, 1.0)).alias("bad")).first()
    if r["bad"] or not r["n"] or not 0 < r["p"] < 1:
        raise ValueError("the outcome must be 0 and 1")
    start = np.zeros(d.k)
    if constant:
        start[0] = first(r["p"])
    fit = maximise(d, model, start, d.names, kind, (), robust, cluster is not None)
    p = r["p"] if constant else 0.5
    return _compare(fit, r["n"] * (r["p"] * math.log(p) + (1 - r["p"]) * math.log(1 - p)), d.k - constant)


def logit(df: DataFrame, y: str, *terms: str, predicate=None, robust=False, cluster=None, constant=True) -> Fit:
    return _binary("logit", logit_rows, _log_odds, df, y, terms, predicate, robust, cluster, constant)


def probit(df: DataFrame, y: str, *terms: str, predicate=None, robust=False, cluster=None, constant=True) -> Fit:
    return _binary("probit", probit_rows, dist.normal_quantile, df, y, terms, predicate, robust, cluster, constant)


def _counts(d: Design) -> tuple[int, float]:
    r = d.rows.agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.count_if((F.col("y") < 0) | (F.col("y") != F.floor("y"))).alias("bad")).first()
    if r["bad"] or not r["n"] or not r["m"]:
        raise ValueError("the outcome must be counts, not all 0")
    return r["n"], r["m"]


def poisson(df: DataFrame, y: str, *terms: str, predicate=None, robust=False, cluster=None, constant=True, offset: str | None = None) -> Fit:
    d = design(df, y, terms, predicate, constant, None, cluster, {"offset": number(q(offset))} if offset else None)
    _, mean = _counts(d)
    base = math.log(d.rows.agg((F.sum("y") / F.sum(F.exp("offset"))).alias("r")).first()["r"]) if offset else math.log(mean)
    start = np.zeros(d.k)
    if constant:
        start[0] = base
    fit = maximise(d, poisson_rows, start, d.names, "poisson", ["offset"] if offset else [], robust, cluster is not None)
    shift = F.col("offset") if offset else F.lit(0.0)
    mu = F.exp(linear(d.x(), fit.beta) + shift)
    null = F.exp(F.lit(base) + shift) if constant else F.exp(shift)
    dev = F.when(F.col("y") > 0, F.col("y") * F.log(F.col("y") / mu)).otherwise(0.0) - (F.col("y") - mu)
    r = d.rows.agg(F.sum(2 * dev).alias("deviance"), F.sum((F.col("y") - mu) ** 2 / mu).alias("pearson"), F.sum(F.col("y") * F.log(mu / null) - mu + null).alias("gain")).first()
    fit.stats |= {"deviance": r["deviance"], "pearson": r["pearson"] / (fit.n - d.k)}
    return _compare(fit, fit.stats["ll"] - r["gain"], d.k - constant)


def nbreg(df: DataFrame, y: str, *terms: str, predicate=None, robust=False, cluster=None, constant=True) -> Fit:
    """NB2; tests alpha = 0 with the 50:50 mixture."""
    simple = poisson(df, y, *terms, predicate=predicate, constant=constant)
    d = design(df, y, terms, predicate, constant, None, cluster)
    fit = maximise(d, negative_binomial_rows, np.r_[simple.beta, -1.0], [*d.names, "lnalpha"], "nbreg", (), robust, cluster is not None)
    lr = max(0.0, 2 * (fit.stats["ll"] - simple.stats["ll"]))
    fit.stats |= {"alpha": math.exp(fit.beta[-1]), "lr_alpha": lr, "lr_alpha_p": dist.chi2_upper(lr, 1) / 2 if lr else 1.0}
    return fit


def _normal_start(d: Design) -> np.ndarray:
    from .linear import fit_rows

    ols = fit_rows(Design(d.rows, d.outcome, d.terms, d.constant, d.source))
    return np.r_[ols.beta, 0.5 * math.log(max(ols.stats["rss"] / ols.n, 1e-12))]


def tobit(df: DataFrame, y: str, *terms: str, lower: float = 0.0, predicate=None, robust=False, cluster=None, constant=True) -> Fit:
    d = design(df, y, terms, predicate, constant, None, cluster)
    return maximise(d, tobit_rows(float(lower)), _normal_start(d), [*d.names, "lnsigma"], "tobit", (), robust, cluster is not None)


def truncreg(df: DataFrame, y: str, *terms: str, lower: float = 0.0, predicate=None, constant=True) -> Fit:
    d = design(df, y, terms, predicate, constant)
    if d.rows.where(F.col("y") <= float(lower)).limit(1).count():
        raise ValueError("outcomes at or below the limit")
    return maximise(d, truncated_rows(float(lower)), _normal_start(d), [*d.names, "lnsigma"], "truncreg")


def streg(df: DataFrame, time: str, *terms: str, failure: str, distribution: str = "weibull", predicate=None, robust=False, cluster=None, constant=True) -> Fit:
    d = design(df, time, terms, predicate, constant, None, cluster, {"failed": number(q(failure))})
    r = d.rows.agg(F.sum("failed").alias("d"), F.sum("y").alias("t"), F.min("y").alias("least")).first()
    if r["least"] is None or r["least"] <= 0 or not r["d"]:
        raise ValueError("times must be positive, and some must end in failure")
    start = np.zeros(d.k)
    if constant:
        start[0] = math.log(r["d"] / r["t"])
    model, more = {"weibull": (weibull_rows, ["lnp"]), "gompertz": (gompertz_rows, ["gamma"]), "exponential": (exponential_rows, [])}[distribution]
    return maximise(d, model, np.r_[start, np.zeros(len(more))], [*d.names, *more], distribution, ["failed"], robust, cluster is not None)


def mlogit(df: DataFrame, y: str, *terms: str, base: object = None, predicate=None, constant=True, max_levels: int = 16) -> Fit:
    need(df, y)
    levels = [r[0] for r in df.select(q(y)).where(q(y).isNotNull()).distinct().orderBy(y).limit(max_levels + 1).collect()]
    if not 2 <= len(levels) <= max_levels:
        raise ValueError(f"2 to {max_levels} levels are needed")
    first = levels[0] if base is None else base
    order = [first, *[x for x in levels if x != first]]
    code = F.lit(None).cast("double")
    for i, x in enumerate(order):
        code = F.when(q(y) == F.lit(x), float(i)).otherwise(code)
    d = design(df, y, terms, predicate, constant, outcome=code)
    shares = {int(r["y"]): r["n"] for r in d.rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    start = np.zeros((len(order) - 1, d.k))
    if constant:
        start[:, 0] = [math.log(max(shares.get(j, 0), 0.5) / max(shares.get(0, 0), 0.5)) for j in range(1, len(order))]
    names = [f"{x}:{n}" for x in order[1:] for n in d.names]
    fit = maximise(d, multinomial_rows(len(order)), start.ravel(), names, "mlogit")
    fit.info["levels"] = order
    total = sum(shares.values())
    return _compare(fit, sum(n * math.log(n / total) for n in shares.values()), (len(order) - 1) * (d.k - constant))


def response(fit: Fit, df: DataFrame, name: str) -> DataFrame:
    """Adds the expected response for the current rows: a probability or a mean count; null if not finite."""
    from ..functions.safe import finite_or_null

    x = ([F.lit(1.0)] if fit.design.constant else []) + [t.column() for t in fit.design.terms]
    xb = linear(x, fit.beta[: len(x)])
    if fit.kind == "logit":
        out = 1 / (1 + F.exp(-xb))
    elif fit.kind == "probit":
        out = dist.normal_cdf_udf(xb)
    elif fit.kind in ("poisson", "nbreg"):
        out = F.exp(xb)
    else:
        out = xb
    return df.withColumn(name, finite_or_null(out))


def margins(fit: Fit) -> dict[str, tuple[float, float]]:
    """Average marginal effects with delta-method standard errors, conditional on the predictors."""
    d, k = fit.design, fit.design.k
    kind, b = fit.kind, fit.beta[:k]

    def kernel(x: np.ndarray) -> np.ndarray:
        eta = x @ b
        if kind == "logit":
            p = 1 / (1 + np.exp(-eta))
            f, slope = p * (1 - p), p * (1 - p) * (1 - 2 * p)
        elif kind == "probit":
            f = dist.normal_pdf(eta)
            slope = -eta * f
        else:
            f = slope = np.exp(eta)
        return np.r_[len(eta), f.sum(), (slope[:, None] * x).sum(0)]

    total = partial_sums(d.rows, d.x(), kernel)
    mean, slope = total[1] / total[0], total[2:] / total[0]
    out = {}
    for j, name in enumerate(d.names):
        if name == "_cons":
            continue
        gradient = np.zeros(len(fit.beta))
        gradient[:k] = b[j] * slope
        gradient[j] += mean
        out[name] = float(b[j] * mean), math.sqrt(float(gradient @ fit.cov @ gradient))
    return out


def _group_softmax(df: DataFrame, y: str, terms: Sequence[str], group: str, kind: str, predicate=None) -> Fit:
    """Counts conditional on their group's total: a two-level aggregation in each Newton step, partial sums first."""
    d = design(df, y, terms, predicate, False, None, group)
    k = d.k
    mean = np.array([v or 0.0 for v in d.rows.agg(*[F.avg(c) for c in d.x()]).first()])
    x = [c - F.lit(float(m)) for c, m in zip(d.x(), mean, strict=True)]
    totals = d.rows.groupBy("g").agg(F.sum("y").alias("s")).where("s > 0")
    rows = d.rows.join(totals, "g").persist()
    try:
        b, last = np.zeros(k), -math.inf
        for _ in range(MAX_STEPS):
            e = F.exp(linear(x, b))
            sums = [F.sum(e).alias("a"), F.first("s").alias("s"), F.count("*").alias("n"), F.sum(F.col("y") * linear(x, b)).alias("l")]
            sums += [F.sum(e * x[i]).alias(f"a{i}") for i in range(k)] + [F.sum(F.col("y") * x[i]).alias(f"y{i}") for i in range(k)]
            sums += [F.sum(e * x[i] * x[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]
            per = rows.groupBy("g").agg(*sums)
            ratio = lambda i: F.col(f"a{i}") / F.col("a")
            total = per.agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum(F.col("l") - F.col("s") * F.log("a")).alias("ll"), *[F.sum(F.col(f"y{i}") - F.col("s") * ratio(i)).alias(f"u{i}") for i in range(k)], *[F.sum(F.col("s") * (F.col(f"a{i}_{j}") / F.col("a") - ratio(i) * ratio(j))).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]).first()
            if not total["groups"]:
                raise ValueError("no group with a positive total")
            score = np.array([total[f"u{i}"] for i in range(k)])
            info = np.zeros((k, k))
            for i in range(k):
                for j in range(i, k):
                    info[i, j] = info[j, i] = total[f"h{i}_{j}"]
            if np.linalg.cond(info) > 1e12:
                raise ValueError("no variation within groups")
            step = np.linalg.solve(info, score)
            if np.abs(step).max() < 1e-9 or total["ll"] < last - 1e-6 * abs(last):
                break
            b, last = b + step, total["ll"]
        return Fit(kind, d.names, b, np.linalg.inv(info), total["n"], None, {"ll": total["ll"], "groups": total["groups"]}, d)
    finally:
        rows.unpersist()


def clogit(df: DataFrame, chosen: str, *terms: str, group: str, predicate=None) -> Fit:
    """McFadden's conditional logit: one choice in each set."""
    return _group_softmax(df, chosen, terms, group, "clogit", predicate)


def xtpoisson_fe(df: DataFrame, y: str, *terms: str, group: str, predicate=None) -> Fit:
    """Conditional Poisson; groups without events drop out."""
    return _group_softmax(df, y, terms, group, "xtpoisson_fe", predicate)


def count_probabilities(fit: Fit, top: int = 10) -> list[tuple[int, float, float]]:
    """k, observed share and mean fitted probability of k events; the last row is the tail."""
    d, k = fit.design, fit.design.k
    alpha = fit.stats.get("alpha", 0.0)
    b = fit.beta[:k]

    def kernel(v: np.ndarray) -> np.ndarray:
        x, y, _ = _split(v, k)
        mu = np.exp(x @ b)
        out = [len(y)]
        log_fact = np.r_[0.0, np.cumsum(np.log(np.arange(1, top + 1)))]
        for n in range(top):
            if alpha:
                r = 1 / alpha
                lp = dist.lgamma(np.array([r + n]))[0] - math.lgamma(r) - log_fact[n] + r * np.log(r / (r + mu)) + n * np.log(mu / (r + mu))
            else:
                lp = n * np.log(mu) - mu - log_fact[n]
            out += [(y == n).sum(), np.exp(lp).sum()]
        return np.array(out, float)

    total = partial_sums(d.rows, [*d.x(), F.col("y")], kernel)
    n = total[0]
    rows = [(i, total[1 + 2 * i] / n, total[2 + 2 * i] / n) for i in range(top)]
    return [*rows, (top, 1 - sum(r[1] for r in rows), 1 - sum(r[2] for r in rows))]




def class_probabilities(fit: Fit, df: DataFrame, prefix: str = "pr_") -> DataFrame:
    """Adds a multinomial fit's probability of each level for the current rows."""
    x = ([F.lit(1.0)] if fit.design.constant else []) + [t.column() for t in fit.design.terms]
    levels, b = fit.info["levels"], fit.beta.reshape(-1, fit.design.k)
    odds = [F.lit(1.0), *[F.exp(linear(x, row)) for row in b]]
    total = sum(odds[1:], odds[0])
    return df.withColumns({f"{prefix}{level}": o / total for level, o in zip(levels, odds, strict=True)})


def choice_probabilities(fit: Fit, df: DataFrame, group: str, name: str) -> DataFrame:
    """Adds a conditional logit's probability within each set; a missing predictor makes its whole set null."""
    e = F.exp(linear([t.column() for t in fit.design.terms], fit.beta))
    rows = df.withColumn("__e", e)
    sets = rows.groupBy(q(group).alias("__set")).agg(F.sum("__e").alias("__sum"), F.count_if(F.col("__e").isNull()).alias("__gap"))
    joined = rows.join(sets, q(group).eqNullSafe(F.col("__set")), "left")
    return joined.withColumn(name, F.when(F.col("__gap") == 0, F.col("__e") / F.col("__sum"))).drop("__e", "__set", "__sum", "__gap")
