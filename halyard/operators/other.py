"""Selection, quantile and nonlinear regression, and the bootstrap."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.safe import all_finite, number, truth
from ..plans.draws import drawn_sums, hashed_counts
from ..plans.moments import Design, cross_products, design, linear, meat, solved
from ..plans.ranks import quantiles
from ..plans.sequence import replayed_sums
from ..sources.tables import ROW, ranked
from .likelihood import probit
from .linear import Fit, fit_rows
from .rows import need, q


def heckman(df: DataFrame, y: str, *terms: str, selected: str, select: Sequence[str], predicate=None) -> Fit:
    """Two steps: probit for selection, then least squares with the inverse Mills ratio; generated-regressor covariance."""
    first = probit(df, selected, *select, predicate=predicate)
    k, z = first.design.k, [F.lit(1.0), *[t.column() for t in first.design.terms]]
    zg = linear(z, first.beta)
    ratio = F.exp(-0.5 * zg * zg - 0.5 * dist.LOG_2PI) / dist.normal_cdf_udf(zg)
    use = df if predicate is None else df.where(truth(predicate))
    use = use.where(number(q(selected)) == 1).withColumn("__zg", zg).withColumn("__mills", ratio)
    d = design(use, y, [*terms, "__mills"], None, True, None, None, {f"z{i}": c for i, c in enumerate(z)} | {"zg": F.col("__zg")})
    ols = fit_rows(d)
    w = d.x()
    m, n1 = F.col(f"x{len(d.terms) - 1}"), ols.n
    delta = m * (m + F.col("zg"))
    alpha = float(ols.beta[-1])
    mean = d.rows.agg(F.avg(delta).alias("d")).first()["d"]
    sigma2 = ols.stats["rss"] / n1 + alpha**2 * mean
    p = d.k
    sums = d.rows.agg(*[F.sum(delta * w[i] * w[j]).alias(f"a{i}_{j}") for i in range(p) for j in range(p)], *[F.sum(delta * w[i] * F.col(f"z{j}")).alias(f"f{i}_{j}") for i in range(p) for j in range(k)]).first()
    a = np.array([[sums[f"a{i}_{j}"] for j in range(p)] for i in range(p)])
    f = np.array([[sums[f"f{i}_{j}"] for j in range(k)] for i in range(p)])
    bread, gram = ols.info["bread"], ols.info["gram"][:p, :p]
    cov = bread @ (sigma2 * gram - alpha**2 * a + alpha**2 * f @ first.cov @ f.T) @ bread
    names = [n if n != "__mills" else "lambda" for n in d.names]
    return Fit("heckman", names, ols.beta, cov, n1, None, {"sigma": math.sqrt(sigma2), "rho": alpha / math.sqrt(sigma2), "selected": n1, "n": first.n}, d, {"first": first})


def qreg(df: DataFrame, y: str, *terms: str, quantile: float = 0.5, predicate=None, constant: bool = True) -> Fit:
    """Quantile regression by majorising steps, each a weighted least squares in one job; then the vertex of K exact fits.

    Covariance for identical errors with the Hall-Sheather sparsity.
    """
    d = design(df, y, terms, predicate, constant)
    rows, k, x, tau = d.rows.persist(), d.k, d.x(), float(quantile)
    try:
        beta = fit_rows(Design(rows, y, d.terms, constant, d.source)).beta
        if constant:
            e = F.col("y") - linear(x, beta)
            beta[0] += quantiles(rows, [e], [tau])[0][0]

        def loss(b: np.ndarray) -> float:
            e = F.col("y") - linear(x, b)
            return rows.agg(F.sum(F.when(e >= 0, tau * e).otherwise((tau - 1) * e))).first()[0]

        scale = rows.agg(F.stddev_samp("y")).first()[0] or 1.0
        best, eps, now = beta, 0.1 * scale, loss(beta)
        shift = np.array(list(rows.agg(*[F.sum(c) for c in x]).first()))
        # a constant alone is the sample quantile already
        while eps > 1e-7 * scale and not (constant and k == 1):
            e = F.col("y") - linear(x, beta)
            _, m = cross_products(rows, [*x, F.col("y")], 1 / (F.lit(eps) + F.abs(e)))
            beta = np.linalg.solve(m[:k, :k], m[:k, k] + (2 * tau - 1) * shift)
            eps /= 1.5
        after = loss(beta)
        if after < now:
            best, now = beta, after
        near = rows.select(F.abs(F.col("y") - linear(x, best)).alias("e"), "y", *[c.alias(f"c{i}") for i, c in enumerate(x)]).orderBy("e").limit(4 * k).toPandas()
        points, chosen = near[[f"c{i}" for i in range(k)]].to_numpy(), []
        for i in range(len(points)):
            if np.linalg.matrix_rank(points[[*chosen, i]]) == len(chosen) + 1:
                chosen.append(i)
            if len(chosen) == k:
                break
        if len(chosen) == k:
            corner = np.linalg.solve(points[chosen], near["y"].to_numpy()[chosen])
            if loss(corner) <= now * (1 + 1e-9):
                best, now = corner, loss(corner)
        n = rows.count()
        z = dist.normal_quantile(tau)
        h = n ** (-1 / 3) * dist.normal_quantile(0.975) ** (2 / 3) * (1.5 * float(dist.normal_pdf(z)) ** 2 / (2 * z * z + 1)) ** (1 / 3)
        e = F.col("y") - linear(x, best)
        lo, hi = quantiles(rows, [e], [max(0.0, tau - h), min(1.0, tau + h)])[0]
        sparsity = (hi - lo) / (min(1.0, tau + h) - max(0.0, tau - h))
        cov = tau * (1 - tau) * sparsity**2 * solved(cross_products(rows, x)[1], d.names)
        return Fit("qreg", d.names, best, cov, n, float(n - k), {"loss": now, "sparsity": sparsity}, d)
    finally:
        rows.unpersist()


def nl(df: DataFrame, y: str, formula: str, start: dict[str, float], variables: Sequence[str], predicate=None, robust: bool = False, max_steps: int = 200) -> Fit:
    """Gauss-Newton. formula is SQL with parameters in braces; every step is one job of sums of Jacobian columns."""
    names = list(start)
    need(df, y, *variables)
    rows = (df if predicate is None else df.where(truth(predicate))).where(all_finite([q(y), *[q(v) for v in variables]]))
    rows = rows.select(number(q(y)).alias("__y"), *[number(q(v)).alias(v) for v in variables]).persist()
    b = np.array([start[n] for n in names], float)

    def value(b: np.ndarray) -> Column:
        return F.expr(formula.format(**{n: f"({v!r}D)" for n, v in zip(names, b.tolist(), strict=True)})).cast("double")

    def parts(b: np.ndarray) -> tuple[Column, list[Column]]:
        jac = []
        for j in range(len(b)):
            step = 1e-6 * max(1.0, abs(b[j]))
            up, down = b.copy(), b.copy()
            up[j] += step
            down[j] -= step
            jac.append((value(up) - value(down)) / (2 * step))
        return F.col("__y") - value(b), jac

    def rss(b: np.ndarray) -> float:
        r = rows.agg(F.sum((F.col("__y") - value(b)) ** 2)).first()[0]
        return math.inf if r is None or math.isnan(r) else r

    try:
        now = rss(b)
        for _ in range(max_steps):
            e, jac = parts(b)
            n, m = cross_products(rows, [*jac, e])
            k = len(b)
            step = solved(m[:k, :k], names) @ m[:k, k]
            part = 1.0
            while part > 1e-12 and not (after := rss(b + part * step)) <= now:
                part /= 2
            if part <= 1e-12:
                break
            small = np.abs(part * step).max() <= 1e-11 * max(1.0, np.abs(b).max()) or now - after <= 1e-14 * now
            b, now = b + part * step, after
            if small:
                break
        e, jac = parts(b)
        n, m = cross_products(rows, [*jac, e])
        bread = solved(m[:k, :k], names)
        cov = bread @ meat(rows, [e * c for c in jac])[1] @ bread * n / (n - k) if robust else bread * now / (n - k)
        return Fit("nl", names, b, cov, n, float(n - k), {"rss": now})
    finally:
        rows.unpersist()


def bootstrap(df: DataFrame, y: str, *terms: str, reps: int = 200, seed: int = 1, cluster: str | None = None, predicate=None, constant: bool = True, fixed: bool = False, replay: bool = False) -> Fit:
    """Pairs or whole-cluster bootstrap of least squares, all replicates in one pass over the rows.

    Each row or cluster has an independent Poisson(1) count in each replicate, drawn from a hash of the seed and of the
    cluster or the row's values and number, so results don't depend on the partitioning; replicates add up
    their own cross products. With ``fixed`` each replicate draws exactly as many rows or clusters as there are, at the
    price of numbering them: one range shuffle. info["drawn"] holds each replicate's rows.
    With ``replay`` the draws are those of one sequence of numbers from the seed, replicate after replicate, over the rows in
    their order or the clusters in the order of their first rows: the same samples as a program that draws one by one.
    """
    # a design's columns are doubles, so places beyond their whole numbers are numbered anew, as lists of places are
    if replay and (dict(df.dtypes)[ROW] != "bigint" or (df.agg(F.max(ROW)).first()[0] or 0) >= 1 << 53):
        df = ranked(df.withColumnRenamed(ROW, "__was"), "__was").drop("__was")
    d = design(df, y, terms, predicate, constant, None, cluster, {"row": F.col(ROW) if replay else F.xxhash64(ROW)})
    k = d.k
    columns = [*d.x(), F.col("y")]
    size = k + 1
    at = np.triu_indices(size)
    if fixed or replay:
        return _resampled_fit(d, _fixed_sums(d, columns, reps, seed, cluster, replay), at)
    unit = F.xxhash64(F.lit(seed), F.col("g") if cluster else F.col("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((reps, len(at[0])))
        for batch in batches:
            ids = batch.column(0).to_numpy().view(np.uint64)
            v = np.column_stack([c.to_numpy() for c in batch.columns[1:]])
            for lo in range(0, len(ids), 4096):
                part, own = v[lo : lo + 4096], ids[lo : lo + 4096]
                products = part[:, at[0]] * part[:, at[1]]
                counts = hashed_counts(own, np.arange(reps))
                total += counts @ products
        rep, place = np.divmod(np.arange(total.size), total.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(place), pa.array(total.ravel())], ["rep", "at", "value"])

    sums = d.rows.select(unit.alias("u"), *[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(run, "rep bigint, at bigint, value double").groupBy("rep", "at").agg(F.sum("value").alias("value"))
    total = np.zeros((reps, len(at[0])))
    for r in sums.collect():
        total[r["rep"], r["at"]] = r["value"]
    return _resampled_fit(d, total, at)


def _fixed_sums(d: Design, columns: list[Column], reps: int, seed: int, cluster: str | None, replay: bool = False) -> np.ndarray:
    """Cross products of each replicate: rows or clusters are numbered, and their counts add up to their number."""
    if replay and not cluster:
        return replayed_sums(d.rows.select(F.col("row").alias("u"), *[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)]), "u", [f"c{i}" for i in range(len(columns))], reps, seed, products=True)
    pairs = [(columns[i] * columns[j]).cast("double") for i in range(len(columns)) for j in range(i, len(columns))]
    names = [f"c{i}" for i in range(len(pairs))]
    if cluster:
        first = F.min("row") if replay else F.xxhash64("g")
        units = d.rows.groupBy("g").agg(first.alias("u"), *[F.sum(p).alias(n) for p, n in zip(pairs, names, strict=True)])
        if replay:
            return replayed_sums(units, "u", names, reps, seed)
        numbers = ranked(units, "u", "g")
    else:
        numbers = ranked(d.rows.select(F.col("row").alias("u"), *[p.alias(n) for p, n in zip(pairs, names, strict=True)]), "u", *names)
    return drawn_sums(numbers, ROW, names, numbers.count(), reps, seed)


def _resampled_fit(d: Design, total: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> Fit:
    """The fit on all rows with the covariance of the fits on each replicate's cross products."""
    reps, k = len(total), d.k
    draws = np.empty((reps, k))
    for i in range(reps):
        m = np.zeros((k + 1, k + 1))
        m[at] = total[i]
        m = m + np.triu(m, 1).T
        draws[i] = solved(m[:k, :k], d.names) @ m[:k, k]
    fit = fit_rows(d)
    fit.kind, fit.cov, fit.df = "bootstrap", np.atleast_2d(np.cov(draws.T, ddof=1)), None
    fit.info["percentiles"] = np.percentile(draws, [2.5, 97.5], axis=0)
    if d.constant:
        fit.info["drawn"] = total[:, 0]
    return fit


def pooled(estimates: DataFrame) -> DataFrame:
    """Rubin's rules: (imputation, parameter, estimate, se) to pooled estimate, se, and the two variances."""
    rows = estimates.groupBy("parameter").agg(F.count("*").alias("m"), F.avg("estimate").alias("estimate"), F.avg(F.col("se") ** 2).alias("within"), F.var_samp("estimate").alias("between"))
    return rows.withColumn("se", F.sqrt(F.col("within") + (1 + 1 / F.col("m")) * F.col("between")))


def resampled(df: DataFrame, seed: int, replicate: int, cluster: str | None = None) -> DataFrame:
    """One bootstrap sample: every row or whole cluster as often as its hashed Poisson(1) count; copies of a cluster get a key of their own."""
    who = q(cluster) if cluster else F.col(ROW)
    u = F.pmod(F.xxhash64(F.lit(seed), F.lit(replicate), who), F.lit(1 << 53)) / float(1 << 53)
    edges = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])
    times = sum((F.when(u >= float(e), 1).otherwise(0) for e in edges[1:]), F.when(u >= float(edges[0]), 1).otherwise(0))
    out = df.withColumn("__times", times).where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return out.withColumn("__cluster", F.concat_ws("/", who.cast("string"), F.col("__copy").cast("string"))).drop("__times", "__copy")


def bootstrap_fit(df: DataFrame, fit, reps: int = 50, seed: int = 1, cluster: str | None = None) -> Fit:
    """The bootstrap of any estimator: fit(rows, cluster column or None) returns a Fit. Replicates run one after another, each on the whole cluster."""
    if not 2 <= reps <= 500:
        raise ValueError("2 to 500 replicates")
    base = fit(df, cluster)
    draws = np.array([fit(resampled(df, seed, r, cluster), "__cluster" if cluster else None).beta for r in range(reps)])
    base.cov, base.df, base.kind = np.atleast_2d(np.cov(draws.T, ddof=1)), None, f"bootstrap {base.kind}"
    base.info |= {"percentiles": np.percentile(draws, [2.5, 97.5], axis=0), "mean": draws.mean(axis=0), "bias": draws.mean(axis=0) - base.beta}
    return base


def bootstrap_quantiles(df: DataFrame, y: str, *terms: str, quantiles: Sequence[float], contrast: str | None = None, reps: int = 50, seed: int = 1, cluster: str | None = None, predicate=None) -> Fit:
    """Quantile regressions at several quantiles on the same samples, with the joint covariance of all their coefficients.

    Coefficients are named q<quantile>:term, quantiles ascending. With two of them, ``contrast`` adds contrast:term, the
    higher quantile's coefficient less the lower one's, with its covariance. Replicates run one after another, each on the whole cluster.
    """
    if contrast is not None and len(quantiles) != 2:
        raise ValueError("a contrast needs two quantiles")
    if len(set(quantiles)) != len(quantiles) or not quantiles:
        raise ValueError("distinct quantiles are needed")
    quantiles = sorted(quantiles)

    def joint(rows: DataFrame, _: str | None) -> Fit:
        fits = [qreg(rows, y, *terms, quantile=t, predicate=predicate) for t in quantiles]
        names = [f"q{t:g}:{n}" for t, f in zip(quantiles, fits, strict=True) for n in f.names]
        beta = np.concatenate([f.beta for f in fits])
        if contrast is not None:
            names.append(f"contrast:{contrast}")
            beta = np.append(beta, fits[1][contrast] - fits[0][contrast])
        return Fit("qreg", names, beta, np.zeros((len(beta), len(beta))), fits[0].n)

    return bootstrap_fit(df, joint, reps, seed, cluster)
