"""Counts with shared group effects, and population-averaged counts.

A group enters the likelihood through a few sums only (events, expected events
and their derivatives), so each step is one two-level aggregation, with partial sums
before the exchange: a large group never meets one task as rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.safe import number
from ..plans.moments import Design, design, linear, partial_sums
from .likelihood import _counts, poisson
from .linear import Fit
from .rows import q

Effect = Callable[[np.ndarray, np.ndarray, float], np.ndarray]


def gamma_effect(s: np.ndarray, m: np.ndarray, t: float) -> np.ndarray:
    """Log of the mean likelihood of s events under m expected, over a gamma effect of mean 1 and variance exp(t)."""
    r = math.exp(-t)
    return dist.lgamma(r + s) - math.lgamma(r) + r * math.log(r) - (r + s) * np.log(r + m)


_NODES, _WEIGHTS = np.polynomial.hermite.hermgauss(48)


def normal_effect(s: np.ndarray, m: np.ndarray, t: float) -> np.ndarray:
    """The same for a normal log effect of standard deviation exp(t): Gauss-Hermite around each group's mode."""
    v = math.exp(2 * t)
    u = np.zeros(len(s))
    for _ in range(60):
        e = m * np.exp(u)
        step = np.clip((s - e - u / v) / (e + 1 / v), -1, 1)
        u += step
        if np.abs(step).max(initial=0) < 1e-12:
            break
    scale = 1 / np.sqrt(m * np.exp(u) + 1 / v)
    at = u[:, None] + math.sqrt(2) * scale[:, None] * _NODES
    f = s[:, None] * at - m[:, None] * np.exp(at) - at * at / (2 * v) + _NODES**2 + np.log(_WEIGHTS)
    top = f.max(1, keepdims=True)
    return top[:, 0] + np.log(np.exp(f - top).sum(1)) + np.log(math.sqrt(2) * scale) - 0.5 * math.log(2 * math.pi * v)


def _group_sums(d: Design, b: np.ndarray) -> DataFrame:
    """Per group: s, m and the first and second derivatives of m, and the group's linear terms."""
    x, k = d.x(), d.k
    xb = linear(x, b)
    mu = F.exp(xb)
    sums = [F.sum("y").alias("s"), F.sum(mu).alias("m"), F.sum(F.col("y") * xb).alias("l")]
    sums += [F.sum(mu * x[i]).alias(f"a{i}") for i in range(k)] + [F.sum(F.col("y") * x[i]).alias(f"y{i}") for i in range(k)]
    sums += [F.sum(mu * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
    return d.rows.groupBy("g").agg(*sums)


def _columns(k: int) -> list:
    return [F.col(c) for c in ["s", "m", "l", *[f"a{i}" for i in range(k)], *[f"y{i}" for i in range(k)], *[f"h{i}_{j}" for i in range(k) for j in range(i, k)]]]


def _kernel(effect: Effect, t: float, k: int):
    def run(v: np.ndarray) -> np.ndarray:
        s, m, l, a, y, h = v[:, 0], v[:, 1], v[:, 2], v[:, 3 : 3 + k], v[:, 3 + k : 3 + 2 * k], v[:, 3 + 2 * k :]
        dm, dt = 1e-4 * np.maximum(m, 1e-8), 1e-4
        f = {(i, j): effect(s, m + i * dm, t + j * dt) for i in (-1, 0, 1) for j in (-1, 0, 1)}
        fm, ft = (f[1, 0] - f[-1, 0]) / (2 * dm), (f[0, 1] - f[0, -1]) / (2 * dt)
        fmm, ftt = (f[1, 0] - 2 * f[0, 0] + f[-1, 0]) / dm**2, (f[0, 1] - 2 * f[0, 0] + f[0, -1]) / dt**2
        fmt = (f[1, 1] - f[1, -1] - f[-1, 1] + f[-1, -1]) / (4 * dm * dt)
        hess = np.zeros((k + 1, k + 1))
        second = (fm[:, None] * h).sum(0)
        hess[np.triu_indices(k)] = second
        hess[:k, :k] = hess[:k, :k] + np.triu(hess[:k, :k], 1).T + (fmm[:, None] * a).T @ a
        hess[:k, k] = hess[k, :k] = (fmt[:, None] * a).sum(0)
        hess[k, k] = ftt.sum()
        return np.r_[(l + f[0, 0]).sum(), len(s), (y + fm[:, None] * a).sum(0), ft.sum(), hess.ravel()]

    return run


def xtpoisson_re(df: DataFrame, y: str, *terms: str, group: str, distribution: str = "gamma", predicate=None, max_steps: int = 100) -> Fit:
    """Poisson with a gamma or normal group effect; the last coefficient is ln alpha or ln sigma. Tests it with the 50:50 mixture."""
    simple = poisson(df, y, *terms, predicate=predicate)
    d = design(df, y, terms, predicate, True, None, group)
    _counts(d)
    effect, name = {"gamma": (gamma_effect, "lnalpha"), "normal": (normal_effect, "lnsigma")}[distribution]
    k, b = d.k, np.r_[simple.beta, -1.0]
    d.rows = d.rows.persist()
    try:
        constant = d.rows.groupBy("y").agg(F.count("*").alias("n"))
        fixed = float(partial_sums(constant, [F.col("y"), F.col("n")], lambda v: np.array([(dist.lgamma(v[:, 0] + 1) * v[:, 1]).sum()]))[0])

        def at(b: np.ndarray) -> np.ndarray:
            return partial_sums(_group_sums(d, b[:k]), _columns(k), _kernel(effect, float(b[k]), k))

        now = at(b)
        for _ in range(max_steps):
            score, info = now[2 : 3 + k], -now[3 + k :].reshape(k + 1, k + 1)
            low = np.linalg.eigvalsh(info)[0]
            step = np.linalg.solve(info + np.eye(k + 1) * max(0.0, 1e-6 - low) * (1 if low < 1e-6 else 0), score)
            if np.abs(step).max() < 1e-7 * max(1.0, np.abs(b).max()):
                break
            part = min(1.0, 1.0 / max(1e-12, abs(step[k])))
            while part > 1e-6:
                after = at(b + part * step)
                if np.isfinite(after).all() and after[0] >= now[0] - 1e-9 * abs(now[0]):
                    break
                part /= 2
            else:
                break
            b, now = b + part * step, after
            if b[k] < -12:
                break
        ll = float(now[0]) - fixed
        lr = max(0.0, 2 * (ll - simple.stats["ll"]))
        return Fit(f"xtpoisson_{distribution}", [*d.names, name], b, np.linalg.inv(-now[3 + k :].reshape(k + 1, k + 1)), simple.n, None, {"ll": ll, "groups": now[1], "lr_effect": lr, "lr_effect_p": dist.chi2_upper(lr, 1) / 2 if lr else 1.0}, d)
    finally:
        d.rows.unpersist()


def xtgee_poisson(df: DataFrame, y: str, *terms: str, group: str, predicate=None, max_steps: int = 100) -> Fit:
    """Log link, exchangeable correlation (mean product of pairs within groups over the mean square), groups of any sizes, scale 1; group sandwich with G/(G-1)."""
    start = poisson(df, y, *terms, predicate=predicate)
    d = design(df, y, terms, predicate, True, None, group)
    k, b = d.k, start.beta
    d.rows = d.rows.persist()
    try:
        t = F.col("t")
        sizes = d.rows.groupBy("g").agg(F.count("*").alias("t")).agg(F.max("t").alias("most"), F.sum("t").alias("n"), F.sum(t * (t - 1)).alias("pairs"), F.count("*").alias("g")).first()
        most, groups = sizes["most"], sizes["g"]
        if not sizes["pairs"]:
            raise ValueError("some group must have 2 rows at least")
        pairs = [(i, j) for i in range(k) for j in range(i, k)]

        def per_group(b: np.ndarray) -> DataFrame:
            x = d.x()
            root = F.exp(linear(x, b) / 2)
            e = F.col("y") / root - root
            z = [root * c for c in x]
            return d.rows.groupBy("g").agg(F.count("*").alias("t"), F.sum(e).alias("e"), F.sum(e * e).alias("q"), *[F.sum(c).alias(f"z{i}") for i, c in enumerate(z)], *[F.sum(c * e).alias(f"w{i}") for i, c in enumerate(z)], *[F.sum(z[i] * z[j]).alias(f"h{i}_{j}") for i, j in pairs])

        for _ in range(max_steps):
            sums = per_group(b)
            r = sums.agg(F.sum(F.col("e") ** 2).alias("a"), F.sum("q").alias("q")).first()
            rho = (r["a"] / r["q"] - 1) * sizes["n"] / sizes["pairs"]
            if rho >= 1 or 1 + (most - 1) * rho <= 0:
                raise ValueError("no valid exchangeable correlation")
            c = F.lit(rho) / (1 + (t - 1) * rho)
            u = [(F.col(f"w{i}") - c * F.col(f"z{i}") * F.col("e")) / (1 - rho) for i in range(k)]
            row = sums.agg(*[F.sum(v).alias(f"u{i}") for i, v in enumerate(u)], *[F.sum((F.col(f"h{i}_{j}") - c * F.col(f"z{i}") * F.col(f"z{j}")) / (1 - rho)).alias(f"i{i}_{j}") for i, j in pairs], *[F.sum(u[i] * u[j]).alias(f"m{i}_{j}") for i, j in pairs]).first()
            info, middle = np.zeros((k, k)), np.zeros((k, k))
            for i, j in pairs:
                info[i, j] = info[j, i] = row[f"i{i}_{j}"]
                middle[i, j] = middle[j, i] = row[f"m{i}_{j}"]
            step = np.linalg.solve(info, np.array([row[f"u{i}"] for i in range(k)]))
            if np.abs(step).max() < 1e-10 * max(1.0, np.abs(b).max()):
                break
            b = b + step
        bread = np.linalg.inv(info)
        return Fit("gee_poisson", d.names, b, bread @ middle @ bread * groups / (groups - 1), start.n, None, {"rho": rho, "groups": groups}, d, {"working": bread})
    finally:
        d.rows.unpersist()


MAX_NESTS = 20


def nlogit(df: DataFrame, chosen: str, *terms: str, group: str, nest: str, predicate=None, max_steps: int = 60, form: str = "common", nest_terms: Sequence[str] = (), test: bool = False) -> Fit:
    """Nested logit in two forms; nest_terms are columns that are constant within each nest of a set.

    "common": utilities are divided by one dissimilarity for all nests, whose log is the last coefficient.
    "nonnormalized": utilities stay as they are and each nest's inclusive value has a coefficient iv_<nest> of its own
    (at most MAX_NESTS nests). With ``test``, stats hold the likelihood ratio against inclusive values of one.

    Log likelihoods at all points of a difference stencil are columns of one two-level aggregation: by set and nest, then by set.
    """
    if form not in ("common", "nonnormalized"):
        raise ValueError(f"no such form: {form}")
    code = F.xxhash64(q(nest)).cast("double")
    extra = {"nest": code, **{f"z{i}": number(q(z)) for i, z in enumerate(nest_terms)}}
    d = design(df.where(q(nest).isNotNull()), chosen, terms, predicate, False, None, group, extra)
    k, m = d.k, len(nest_terms)
    d.rows = d.rows.persist()

    def ll(points: list[np.ndarray]) -> np.ndarray:
        first = [f(f"z{i}").alias(f"{n}{i}") for i in range(m) for f, n in ((F.min, "z"), (F.max, "o"))]
        for i, p in enumerate(points):
            v = linear(d.x(), p[:k] / scale(p))
            first += [F.sum(F.exp(v)).alias(f"a{i}"), F.sum(F.col("y") * v).alias(f"u{i}")]
        nests = d.rows.groupBy("g", "nest").agg(F.sum("y").alias("c"), *first)
        uneven = F.max(sum((F.when(F.col(f"z{i}") != F.col(f"o{i}"), 1).otherwise(0) for i in range(m)), F.lit(0)))
        second = []
        for i, p in enumerate(points):
            top = linear([F.col(f"z{j}") for j in range(m)], p[k : k + m]) + inclusive(p) * F.log(f"a{i}")
            second += [F.log(F.sum(F.exp(top))).alias(f"d{i}"), F.sum(F.col(f"u{i}") + F.col("c") * (top - F.log(f"a{i}"))).alias(f"n{i}")]
        sets = nests.groupBy("g").agg(F.sum("c").alias("c"), uneven.alias("uneven"), *second)
        row = sets.agg(F.count_if(F.col("c") != 1).alias("bad"), F.max("uneven").alias("uneven"), F.count("*").alias("sets"), *[F.sum(F.col(f"n{i}") - F.col(f"d{i}")).alias(f"l{i}") for i in range(len(points))]).first()
        if row["bad"] or not row["sets"]:
            raise ValueError("each set needs one choice")
        if row["uneven"]:
            raise ValueError("nest terms must be constant within each nest of a set")
        return np.array([row[f"l{i}"] for i in range(len(points))], float)

    def stencil(b: np.ndarray, n: int):
        h = 1e-4
        unit = np.eye(len(b)) * h
        points = [b] + [b + s * unit[i] for i in range(n) for s in (1, -1)]
        cross = [(i, j) for i in range(n) for j in range(i)]
        points += [b + s * unit[i] + t * unit[j] for i, j in cross for s in (1, -1) for t in (1, -1)]
        f = ll(points)
        grad = (f[1 : 2 * n : 2] - f[2 : 2 * n + 1 : 2]) / (2 * h)
        hess = np.diag((f[1 : 2 * n : 2] - 2 * f[0] + f[2 : 2 * n + 1 : 2]) / h**2)
        for c, (i, j) in enumerate(cross):
            four = f[2 * n + 1 + 4 * c : 2 * n + 5 + 4 * c]
            hess[i, j] = hess[j, i] = (four[0] - four[1] - four[2] + four[3]) / (4 * h * h)
        return f[0], grad, hess

    def climbed(b: np.ndarray, n: int):
        """The maximum over the first n coefficients: it, its log likelihood and curvature."""
        for _ in range(max_steps):
            value, grad, hess = stencil(b, n)
            low = np.linalg.eigvalsh(-hess)[0]
            step = np.zeros(len(b))
            step[:n] = np.linalg.solve(-hess + np.eye(n) * max(0.0, 1e-3 - low), grad)
            step *= min(1.0, 1.0 / np.abs(step).max()) if np.abs(step).max() > 0 else 1.0
            if np.abs(step).max() < 1e-6:
                break
            tries = ll([b + step / 2**i for i in range(8)])
            best = int(np.nanargmax(tries))
            if tries[best] <= value:
                break
            b = b + step / 2**best
        return b, float(value), hess

    try:
        if form == "common":
            labels, codes, start = ["lntau"], [], np.zeros(k + m + 1)
        else:
            used = d.rows.select(F.col("nest").alias("__code")).distinct()
            named = df.select(q(nest).cast("string").alias("label"), code.alias("__code")).distinct().join(F.broadcast(used.limit(MAX_NESTS + 1)), "__code").orderBy("label").limit(MAX_NESTS + 1).collect()
            if len(named) > MAX_NESTS:
                raise ValueError(f"more than {MAX_NESTS} nests")
            labels, codes = [f"iv_{r['label']}" for r in named], [r["__code"] for r in named]
            start = np.concatenate([np.zeros(k + m), np.ones(len(codes))])
        scale, inclusive = _nest_scales(codes, k + m)
        b, value, hess = climbed(start, len(start))
        stats = {"ll": value} | ({"dissimilarity": math.exp(b[-1])} if form == "common" else {})
        if test:
            _, plain, _ = climbed(start, k + m)
            stats |= {"ll_iv1": plain, "lr_iv1": 2 * (value - plain), "lr_df": len(start) - k - m}
            stats["lr_p"] = dist.chi2_upper(max(0.0, stats["lr_iv1"]), stats["lr_df"])
        n = d.rows.count()
        return Fit("nlogit", [*d.names, *nest_terms, *labels], b, np.linalg.inv(-hess), n, None, stats, d, {"codes": codes, "nest_terms": list(nest_terms)})
    finally:
        d.rows.unpersist()


def _nest_scales(codes: list[float], before: int) -> tuple[Callable[[np.ndarray], float], Callable[[np.ndarray], Column]]:
    """What divides utilities, and the coefficient of a nest's inclusive value, given all coefficients."""
    if not codes:
        return lambda p: math.exp(p[before]), lambda p: F.lit(math.exp(p[before]))
    return lambda p: 1.0, lambda p: F.coalesce(*[F.when(F.col("nest") == c, F.lit(float(v))) for c, v in zip(codes, p[before:], strict=True)])


def nested_probabilities(fit: Fit, df: DataFrame, group: str, nest: str, name: str) -> DataFrame:
    """Adds a nested logit's probability within each set; a missing predictor, or a nest not in the fit, makes its whole set null."""
    k, zs = fit.design.k, fit.info["nest_terms"]
    scale, inclusive = _nest_scales(fit.info["codes"], k + len(zs))
    v = linear([t.column() for t in fit.design.terms], fit.beta[:k] / scale(fit.beta))
    z = linear([number(q(c)) for c in zs], fit.beta[k : k + len(zs)])
    rows = df.withColumns({"__e": F.exp(v), "__z": z})
    inside = rows.groupBy(q(group).alias("__set"), q(nest).alias("__nest")).agg(F.sum("__e").alias("__a"), F.max("__z").alias("__w"), F.count_if(F.col("__e").isNull() | F.col("__z").isNull()).alias("__gap"))
    inside = inside.withColumn("nest", F.xxhash64("__nest").cast("double"))
    inside = inside.withColumn("__top", F.exp(F.col("__w") + inclusive(fit.beta) * F.log("__a"))).drop("nest")
    sets = inside.groupBy(F.col("__set").alias("__own")).agg(F.sum("__top").alias("__all"), F.sum(F.col("__gap") + F.when(F.col("__top").isNull(), 1).otherwise(0)).alias("__gaps"))
    tops = inside.join(sets, F.col("__set").eqNullSafe(F.col("__own"))).select("__set", "__nest", "__a", "__top", "__all", "__gaps")
    joined = rows.join(tops, q(group).eqNullSafe(F.col("__set")) & q(nest).eqNullSafe(F.col("__nest")), "left")
    share = F.col("__e") / F.col("__a") * F.col("__top") / F.col("__all")
    return joined.withColumn(name, F.when(F.col("__gaps") == 0, share)).drop("__e", "__z", "__set", "__nest", "__a", "__top", "__all", "__gaps")
