"""Spatial models against dense matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.operators import spatial
from halyard.sources.tables import ROW

SIDE = 24


@pytest.fixture(scope="module")
def data(spark):
    """A grid with a = 0.4 and r = 0.5, one island, and units whose y or x is missing."""
    rng = np.random.default_rng(3)
    n = SIDE * SIDE
    place = [(i // SIDE, i % SIDE) for i in range(n)]
    w = np.array([[float(p != q and max(abs(p[0] - q[0]), abs(p[1] - q[1])) == 1) for q in place] for p in place])
    x = rng.normal(size=(n, 2)) * 2
    row = w / w.sum(axis=1, keepdims=True)
    u = np.linalg.solve(np.eye(n) - 0.5 * row, rng.normal(size=n))
    y = np.linalg.solve(np.eye(n) - 0.4 * row, 1 + x @ [1.5, -1.0] + u)
    table = [(i, i, *place[i], float(y[i]) if i != 40 else None, float(x[i, 0]) if i != 77 else float("nan"), float(x[i, 1])) for i in range(n)]
    table.append((n, n, 1000, 1000, 3.0, 1.0, 1.0))
    df = spark.createDataFrame(table, f"{ROW} long, cell long, r long, c long, y double, x double, z double").repartition(5)
    keep = [i for i in range(n) if i not in (40, 77)]
    y, x, w = np.append(y[keep], 3.0), np.vstack([x[keep], [1.0, 1.0]]), np.pad(w[np.ix_(keep, keep)], (0, 1))
    total = w.sum(axis=1, keepdims=True)
    return df, y, np.column_stack([np.ones(len(y)), x]), np.divide(w, total, out=np.zeros_like(w), where=total > 0)


def two_stages(y, x, h, robust=False):
    p = h @ np.linalg.lstsq(h, x, rcond=None)[0]
    bread = np.linalg.inv(p.T @ p)
    b = bread @ p.T @ y
    e, n, k = y - x @ b, *x.shape
    return b, np.sqrt(np.diag(bread @ (p.T * e * e) @ p @ bread) * n / (n - k)) if robust else np.sqrt(np.diag(bread) * (e @ e) / (n - k))


def moments(e, w):
    """The moments' distance by a fine search."""
    f, g, n, t = w @ e, w @ w @ e, len(e), (w * w).sum()
    left = np.array([[2 * e @ f, -f @ f, n], [2 * f @ g, -g @ g, t], [e @ g + f @ f, -f @ g, 0]]) / n
    right = np.array([e @ e, f @ f, e @ f]) / n
    def away(r):
        part = right - left[:, 0] * r - left[:, 1] * r * r
        s = left[:, 2] @ part / (left[:, 2] @ left[:, 2])
        return ((part - left[:, 2] * s) ** 2).sum()
    low, high = -1.0, 1.0
    for _ in range(6):
        grid = np.linspace(low, high, 401)
        best = min(grid, key=away)
        step = (high - low) / 400
        low, high = max(-1.0, best - step), min(1.0, best + step)
    return best


def fit(spark, data, **options):
    df = data[0]
    return spatial.spregress(df, "y", "x", "z", unit="cell", edges=spatial.contiguous(df, "cell", "r", "c"), **options)


@pytest.mark.parametrize("robust", [False, True])
def test_lag(spark, data, robust):
    _, y, x, w = data
    got = fit(spark, data, robust=robust)
    b, se = two_stages(y, np.column_stack([x, w @ y]), np.column_stack([x, w @ x[:, 1:], w @ w @ x[:, 1:]]), robust)
    assert got.names == ["_cons", "x", "z", "W.y"] and got.n == len(y)
    assert np.allclose(got.beta, b, atol=1e-8) and np.allclose(got.se, se, atol=1e-8)
    assert abs(got["W.y"] - 0.4) < 0.15
    assert spatial.effects(got)["x"] == pytest.approx(b[1] / (1 - b[3]))


def test_error(spark, data):
    _, y, x, w = data
    got = fit(spark, data, model="error")
    r = moments(y - x @ np.linalg.lstsq(x, y, rcond=None)[0], w)
    assert got.stats["error_weight"] == pytest.approx(r, abs=1e-6)
    b, se = two_stages(y - r * w @ y, x - r * w @ x, x - r * w @ x)
    assert got.names == ["_cons", "x", "z"]
    assert np.allclose(got.beta, b, atol=1e-5) and np.allclose(got.se, se, atol=1e-5)


def test_sarar(spark, data):
    _, y, x, w = data
    got = fit(spark, data, model="sarar")
    z, h = np.column_stack([x, w @ y]), np.column_stack([x, w @ x[:, 1:], w @ w @ x[:, 1:]])
    r = moments(y - z @ two_stages(y, z, h)[0], w)
    assert got.stats["error_weight"] == pytest.approx(r, abs=1e-6) and abs(r - 0.5) < 0.25
    b, se = two_stages(y - r * w @ y, z - r * w @ z, h)
    assert got.names == ["_cons", "x", "z", "W.y"]
    assert np.allclose(got.beta, b, atol=1e-5) and np.allclose(got.se, se, atol=1e-5)


def test_edges(spark, data):
    df = data[0]
    rook = spatial.contiguous(df, "cell", "r", "c", "rook")
    assert rook.count() == 4 * SIDE * (SIDE - 1)
    assert spatial.standardised(rook).groupBy("source").agg(F.round(F.sum("weight"), 12).alias("s")).where("s <> 1").count() == 0
    twice = rook.union(rook).unionByName(spark.createDataFrame([(5, 5, 9.0), (5, 10**9, 2.0), (6, 7, None)], "source long, target long, weight double"))
    one = spatial.spregress(df, "y", "x", unit="cell", edges=rook)
    assert np.allclose(one.beta, spatial.spregress(df, "y", "x", unit="cell", edges=twice).beta, atol=1e-9)
    with pytest.raises(ValueError):
        spatial.spregress(df.union(df), "y", "x", unit="cell", edges=rook)
    with pytest.raises(ValueError):
        spatial.contiguous(df, "cell", "r", "c", "bishop")
