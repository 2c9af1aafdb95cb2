"""Effects on the treated against refits without each row; fixed-effects logit against enumeration."""

import itertools

import numpy as np
import pytest

from halyard.operators import effects, likelihood, linear
from halyard.sources.tables import ROW

rng = np.random.default_rng(44)
N = 400
X = rng.normal(0, 1, N)
D = (rng.random(N) < 1 / (1 + np.exp(-0.8 * X))).astype(float)
T = (rng.random(N) < 0.5).astype(float)
Y = 1 + X + T * (0.5 + 0.7 * X) + D * 0.3 + 2.0 * D * T + rng.normal(0, 1, N)


def plain(keep, method):
    x, d, t, y = np.column_stack([np.ones(keep.sum()), X[keep]]), D[keep], T[keep], Y[keep]
    b = np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-(x @ b)))
        b = b + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]), x.T @ (d - p))
    ols = [np.linalg.lstsq(x[(d == 0) & (t == s)], y[(d == 0) & (t == s)], rcond=None)[0] for s in (1, 0)]
    if method == "or":
        return y[(d == 1) & (t == 1)].mean() - y[(d == 1) & (t == 0)].mean() - (x[d == 1] @ (ols[0] - ols[1])).mean()
    r = y - np.where(t == 1, x @ ols[0], x @ ols[1]) if method == "aipw" else y
    w = np.where(d == 1, 1, np.exp(x @ b))
    mean = lambda a, s: np.average(r[(d == a) & (t == s)], weights=w[(d == a) & (t == s)])
    return mean(1, 1) - mean(1, 0) - mean(0, 1) + mean(0, 0)


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, float(Y[i]), float(X[i]), int(D[i]), int(T[i]), i // 4) for i in range(N)] + [(N, None, 0.0, 1, 1, 0), (N + 1, 1.0, 0.0, None, 1, 0)]
    return spark.createDataFrame(rows, f"{ROW} long, y double, x double, d int, t int, g int").repartition(4)


@pytest.mark.parametrize("method", effects.METHODS)
def test_against_refits(table, method):
    every = np.ones(N, bool)
    fit = effects.drdid(table, "y", "x", treatment="d", post="t", method=method)
    assert fit.n == N and np.isclose(fit["att"], plain(every, method), rtol=1e-6)
    without = []
    for i in range(N):
        every[i] = False
        without.append(plain(every, method))
        every[i] = True
    without = np.array(without)
    jackknife = np.sqrt((N - 1) / N * ((without - without.mean()) ** 2).sum())
    assert abs(fit.se[0] / jackknife - 1) < 0.05
    assert abs(fit["att"] - 2.0) < 4 * fit.se[0]


def test_clusters_and_did(table):
    rows = effects.drdid(table, "y", treatment="d", post="t")
    groups = effects.drdid(table, "y", treatment="d", post="t", cluster="g")
    assert np.isclose(rows["att"], groups["att"]) and rows.se[0] != groups.se[0]
    by_hand = linear.regress(table.selectExpr("*", "d * t AS dt"), "y", "d", "t", "dt", "x", robust=True)
    fit = effects.did(table, "y", "x", treatment="d", post="t")
    assert np.isclose(fit["did"], by_hand["dt"]) and np.allclose(fit.se, by_hand.se)


def test_placing():
    x = rng.normal(0, 2, (9, 2))
    w = np.exp(rng.normal(0, 3, 9))
    for s in range(1, 9):
        sets = list(itertools.combinations(range(9), s))
        weight = np.array([np.prod(w[list(c)]) for c in sets])
        sums = np.array([x[list(c)].sum(0) for c in sets])
        size, first, second = (v[1] for v in effects.placed(np.stack([w[::-1], w]), np.stack([x, x]), s))
        assert np.isclose(size, np.log(weight.sum())) and np.allclose(first, weight @ sums / weight.sum())
        assert np.allclose(second, np.einsum("c,ci,cj->ij", weight, sums, sums) / weight.sum())
    # thousands of rows neither overflow nor vanish
    size, first, second = (v[0] for v in effects.placed(np.ones((1, 3000)), np.ones((1, 3000, 1)), 1500))
    from math import lgamma

    assert np.isclose(size, lgamma(3001) - 2 * lgamma(1501)) and np.isclose(first[0], 1500) and np.isclose(second[0, 0], 1500.0**2)


def test_fixed_effects_logit(spark):
    groups = np.repeat(np.arange(300), rng.integers(1, 8, 300))
    x = rng.normal(0, 1, (len(groups), 2))
    effect = rng.normal(0, 1, 300)[groups]
    y = (rng.random(len(groups)) < 1 / (1 + np.exp(-(x @ [1.0, -0.5] + effect)))).astype(int)
    df = spark.createDataFrame([(i, int(groups[i]), int(y[i]), *map(float, x[i])) for i in range(len(groups))], f"{ROW} long, g long, y int, a double, b double").repartition(3)
    fit = effects.xtlogit_fe(df, "y", "a", "b", group="g")
    score, info, ll = np.zeros(2), np.zeros((2, 2)), 0.0
    for g in range(300):
        own, s = x[groups == g], int(y[groups == g].sum())
        if 0 < s < len(own):
            sums = np.array([own[list(c)].sum(0) for c in itertools.combinations(range(len(own)), s)])
            p = np.exp(sums @ fit.beta)
            ll += own[y[groups == g] == 1].sum(0) @ fit.beta - np.log(p.sum())
            p /= p.sum()
            score += own[y[groups == g] == 1].sum(0) - p @ sums
            info += sums.T @ (sums * p[:, None]) - np.outer(p @ sums, p @ sums)
    assert np.abs(score).max() < 1e-6 and np.isclose(fit.stats["ll"], ll) and np.allclose(fit.cov, np.linalg.inv(info), rtol=1e-6)
    assert (np.abs(fit.beta - [1.0, -0.5]) < 4 * fit.se).all()
    single = df.where("y = 1 OR b < 0")
    pairs = single.groupBy("g").agg({"y": "sum"}).where("`sum(y)` = 1").select("g")
    assert np.allclose(effects.xtlogit_fe(single.join(pairs, "g"), "y", "a", "b", group="g").beta, likelihood.clogit(single.join(pairs, "g"), "y", "a", "b", group="g").beta, atol=1e-5)


def test_refusals(table):
    with pytest.raises(ValueError, match="four groups"):
        effects.drdid(table.where("d = 1"), "y", treatment="d", post="t")
    with pytest.raises(ValueError, match="method"):
        effects.drdid(table, "y", treatment="d", post="t", method="x")
    with pytest.raises(ValueError, match="both outcomes"):
        effects.xtlogit_fe(table.where("d = 1"), "d", "x", group="g")
    with pytest.raises(ValueError, match="0 and 1"):
        effects.xtlogit_fe(table, "y", "x", group="g")
