"""Penalised least squares: first-order conditions, folds against refits in numpy, odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.operators import linear, penalised
from halyard.sources.tables import ROW

rng = np.random.default_rng(9)
N, K = 600, 6
X = rng.normal(50, 3, (N, K)) @ (np.eye(K) + 0.4 * np.ones((K, K)))
Y = 4 + X @ np.array([1.5, -2, 0, 0, 0.3, 0]) + rng.normal(0, 4, N)
D = 0.5 * X[:, 0] - 0.2 * X[:, 1] + rng.normal(0, 1, N)
NAMES = [f"v{i}" for i in range(K)]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, float(Y[i]), *map(float, X[i]), float(D[i]), i % 3, i % 40) for i in range(N)]
    odd = [(N, None, *[1.0] * K, 0.0, 0, 0), (N + 1, 1.0, float("nan"), *[1.0] * (K - 1), 0.0, 1, 0)]
    return spark.createDataFrame(rows + odd, f"{ROW} long, y double, {', '.join(n + ' double' for n in NAMES)}, d double, f int, g int").repartition(4)


def centred(x, y):
    return (x - x.mean(0)).T @ (x - x.mean(0)) / len(x), (x - x.mean(0)).T @ (y - y.mean()) / len(x)


@pytest.mark.parametrize("ratio", [1.0, 0.5, 0.0])
@pytest.mark.parametrize("alpha", [0.0, 0.3, 5.0, 1e4])
def test_first_order_conditions(table, alpha, ratio):
    fit = penalised.elasticnet(table, "y", *NAMES, alpha=alpha, l1_ratio=ratio)
    gram, target = centred(X, Y)
    assert fit.n == N and penalised.kkt_gap(gram, target, fit.beta[1:], alpha, ratio) < 1e-6
    assert np.isclose(fit.beta[0], Y.mean() - X.mean(0) @ fit.beta[1:])
    assert np.isclose(fit.stats["rss"], ((Y - fit.beta[0] - X @ fit.beta[1:]) ** 2).sum())


def test_without_constant_and_path(table):
    fit = penalised.lasso(table, "y", *NAMES, alpha=2.0, constant=False)
    assert fit.names == NAMES and penalised.kkt_gap(X.T @ X / N, X.T @ Y / N, fit.beta, 2.0, 1.0) < 1e-5
    grid = penalised.lasso_path(table, "y", *NAMES).toPandas()
    sizes = grid[grid.term != "_cons"].groupby("alpha").estimate.apply(lambda b: (b != 0).sum()).sort_index(ascending=False).to_numpy()
    assert len(sizes) == 100 and sizes[0] == 0 and sizes[-1] >= 3


def test_least_squares_at_no_penalty(table):
    plain = linear.regress(table, "y", *NAMES)
    assert np.allclose(penalised.lasso(table, "y", *NAMES, alpha=0.0).beta, plain.beta, atol=1e-6)
    assert np.allclose(penalised.ridge(table, "y", *NAMES, alpha=0.0).beta, plain.beta, atol=1e-6)


def test_postlasso(table):
    chosen = penalised.lasso(table, "y", *NAMES, alpha=3.0)
    kept = [n for n, b in zip(NAMES, chosen.beta[1:], strict=True) if b != 0]
    assert 0 < len(kept) < K
    after, plain = penalised.postlasso(table, "y", *NAMES, alpha=3.0, robust=True), linear.regress(table, "y", *kept, robust=True)
    assert after.names == ["_cons", *kept] and np.allclose(after.beta, plain.beta) and np.allclose(after.se, plain.se)
    assert penalised.postlasso(table, "y", *NAMES, alpha=1e6).names == ["_cons"]


def test_cross_validation(table):
    grid = [30.0, 3.0, 0.3, 0.03]
    out = penalised.cv_elasticnet(table, "y", *NAMES, l1_ratio=[0.5, 1.0], fold="f", alphas=grid)
    fold, means = np.arange(N) % 3, {}
    for ratio, alpha, f, loss in out.losses:
        train, own = fold != f, fold == f
        gram, target = centred(X[train], Y[train])
        b = penalised.descend(gram, target, alpha, ratio)
        a = Y[train].mean() - X[train].mean(0) @ b
        assert np.isclose(loss, ((Y[own] - a - X[own] @ b) ** 2).mean(), rtol=1e-6)
        means.setdefault((ratio, alpha), []).append(loss)
    assert min(means, key=lambda k: np.mean(means[k])) == (out.fit.info["l1_ratio"], out.fit.info["alpha"])
    hashed = penalised.cv_ridge(table, "y", *NAMES, folds=4, seed=5)
    again = penalised.cv_ridge(table.repartition(7), "y", *NAMES, folds=4, seed=5)
    assert len({x[2] for x in hashed.losses}) == 4 and np.allclose([x[3] for x in hashed.losses], [x[3] for x in again.losses])


@pytest.mark.parametrize("cluster", [None, "g"])
def test_dml(table, cluster):
    out = penalised.dml(table, "y", "d", *NAMES, fold="f", alpha=0.5, cluster=cluster)
    fold, u, v = np.arange(N) % 3, np.empty(N), np.empty(N)
    for f in range(3):
        train, own = fold != f, fold == f
        gram, target = centred(X[train], Y[train])
        for values, into in ((Y, u), (D, v)):
            b = penalised.descend(gram, centred(X[train], values[train])[1], 0.5, 1.0)
            into[own] = values[own] - values[train].mean() - (X[own] - X[train].mean(0)) @ b
    theta = (u @ v) / (v @ v)
    score = v * (u - theta * v)
    sums = score if cluster is None else np.bincount(np.arange(N) % 40, score)
    assert np.isclose(out.fit["d"], theta) and np.isclose(out.fit.se[0] ** 2, (sums**2).sum() / (v @ v) ** 2 * (1 if cluster is None else 40 / 39))
    got = out.residuals().agg(F.sum(F.col("u") * F.col("v"))).first()[0]
    assert np.isclose(got, u @ v)


def test_refusals(table):
    with pytest.raises(ValueError, match="no observations"):
        penalised.lasso(table.limit(0), "y", "v0", alpha=1.0)
    with pytest.raises(ValueError, match="one fold"):
        penalised.cv_ridge(table.where("f = 1"), "y", "v0", fold="f")
    with pytest.raises(ValueError, match="two folds"):
        penalised.dml(table, "y", "d", "v0", folds=1)
    with pytest.raises(ValueError, match="negative"):
        penalised.ridge(table, "y", "v0", alpha=-1.0)
