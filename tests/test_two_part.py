"""Zero inflation and selection: scores against differences, estimates against the truth and the full-sample Hessian."""

import math
import time

import numpy as np
import pytest

from halyard.functions import dist
from halyard.operators import likelihood, two_part
from halyard.sources.tables import ROW

rng = np.random.default_rng(33)


def differences(model, b, *data):
    out = np.empty((len(data[1]), len(b)))
    for j in range(len(b)):
        h = 1e-6 * max(1, abs(b[j]))
        up, down = b.copy(), b.copy()
        up[j] += h
        down[j] -= h
        out[:, j] = (model(up, *data)[0] - model(down, *data)[0]) / (2 * h)
    return out


N = 4000
X = np.column_stack([np.ones(N), rng.normal(0, 1, N)])
Z = np.column_stack([np.ones(N), rng.normal(0, 1, N)])
MU = np.exp(X @ [0.8, 0.5])
CERTAIN = rng.random(N) < 1 / (1 + np.exp(-(Z @ [-0.5, 1.0])))
COUNTS = np.where(CERTAIN, 0, rng.poisson(MU))
WILD = np.where(CERTAIN, 0, rng.poisson(MU * rng.gamma(2.0, 0.5, N)))
ERRORS = rng.multivariate_normal([0, 0], [[1, 0.6 * 2], [0.6 * 2, 4]], N)
CHOSEN = (Z @ [0.3, 1.0] + ERRORS[:, 0] > 0).astype(float)
OUTCOME = X @ [1.0, 2.0] + ERRORS[:, 1]


@pytest.mark.parametrize("model, b, y, extra", [
    (two_part.zero_inflated_rows(2, 2, False), [0.7, 0.4, -0.3, 0.9], COUNTS, Z),
    (two_part.zero_inflated_rows(2, 2, True), [0.7, 0.4, -0.3, 0.9, -0.5], WILD, Z),
    (two_part.selection_rows(2, 2), [0.9, 1.8, 0.2, 0.9, 0.6, 0.5], OUTCOME, np.column_stack([Z, CHOSEN])),
])
def test_scores(model, b, y, extra):
    b = np.array(b)
    assert np.allclose(model(b, X, y.astype(float), extra)[1], differences(model, b, X, y.astype(float), extra), atol=1e-5)


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, int(COUNTS[i]), int(WILD[i]), float(X[i, 1]), float(Z[i, 1]), float(OUTCOME[i]) if CHOSEN[i] else None, int(CHOSEN[i]), i % 50) for i in range(N)]
    rows.append((N, None, None, 1.0, float("nan"), 1.0, 1, 0))
    return spark.createDataFrame(rows, f"{ROW} long, y long, w long, x double, z double, out double, s int, g int").repartition(4)


def information(model, b, *data):
    h = np.empty((len(b), len(b)))
    for j in range(len(b)):
        e = 1e-5 * max(1, abs(b[j]))
        up, down = b.copy(), b.copy()
        up[j] += e
        down[j] -= e
        h[j] = (model(up, *data)[1].sum(0) - model(down, *data)[1].sum(0)) / (2 * e)
    return -(h + h.T) / 2


def settled(fit, model, truth, *data):
    score = model(fit.beta, *data)[1]
    info = information(model, fit.beta, *data)
    assert np.abs(score.sum(0) / np.sqrt(np.diag(info))).max() < 1e-4
    assert np.isclose(fit.stats["ll"], model(fit.beta, *data)[0].sum())
    assert np.allclose(fit.se, np.sqrt(np.diag(np.linalg.inv(info))), rtol=1e-4)
    assert (np.abs(fit.beta - truth) < 4.5 * fit.se).all()


def test_zip(table):
    fit = two_part.zip_(table, "y", "x", inflate=["z"])
    assert fit.names == ["_cons", "x", "inflate:_cons", "inflate:z"] and fit.n == N
    settled(fit, two_part.zero_inflated_rows(2, 2, False), [0.8, 0.5, -0.5, 1.0], X, COUNTS.astype(float), Z)
    clustered = two_part.zip_(table, "y", "x", inflate=["z"], cluster="g")
    score = two_part.zero_inflated_rows(2, 2, False)(fit.beta, X, COUNTS.astype(float), Z)[1]
    sums = np.array([score[np.arange(N) % 50 == g].sum(0) for g in range(50)])
    assert np.allclose(clustered.cov, fit.info["bread"] @ (sums.T @ sums) @ fit.info["bread"] * 50 / 49, rtol=1e-3)


def test_zinb(table):
    fit = two_part.zinb(table, "w", "x", inflate=["z"])
    settled(fit, two_part.zero_inflated_rows(2, 2, True), [0.8, 0.5, -0.5, 1.0, math.log(0.5)], X, WILD.astype(float), Z)


def test_selection(table):
    fit = two_part.heckman_ml(table, "out", "x", selected="s", select=["z"])
    truth = [1.0, 2.0, 0.3, 1.0, math.log(2), math.atanh(0.6)]
    settled(fit, two_part.selection_rows(2, 2), truth, X, np.where(CHOSEN == 1, OUTCOME, 0), np.column_stack([Z, CHOSEN]))
    assert fit.names[-2:] == ["lnsigma", "athrho"] and abs(fit.stats["rho"] - 0.6) < 0.2 and fit.stats["selected"] == CHOSEN.sum()


def test_refusals(table):
    with pytest.raises(ValueError, match="zeros"):
        two_part.zip_(table, "y", "x", predicate="y > 0")
    with pytest.raises(ValueError, match="factor"):
        two_part.heckman_ml(table, "out", "i.g", selected="s", select=["z"])


def test_counts_of_any_size():
    y = np.array([0.0, 5, 4096, 4097, 10_000, 3e8])
    began = time.time()
    b, x = np.array([2.0, -0.7]), np.ones((6, 1))
    ll, score = likelihood.negative_binomial_rows(b, x, y, np.zeros((6, 0)))
    assert time.time() - began < 1
    r, mu = math.exp(0.7), math.exp(2.0)
    direct = [math.lgamma(v + r) - math.lgamma(r) - math.lgamma(v + 1) + r * math.log(r / (r + mu)) + v * math.log(mu / (r + mu)) for v in y]
    assert np.allclose(ll, direct, rtol=1e-9)
    assert np.allclose(score, differences(likelihood.negative_binomial_rows, b, x, y, np.zeros((6, 0))), rtol=1e-4, atol=1e-4)
    assert abs(dist.digamma_far(np.array([4096.0]))[0] - 8.317642) < 1e-5
