"""Difference GMM against dense matrices of all units in numpy."""

import numpy as np
import pytest

from halyard.operators import dynamic
from halyard.sources.tables import ROW

rng = np.random.default_rng(21)


def made(units=80, periods=8):
    rows = []
    for u in range(units):
        effect, y = rng.normal(), rng.normal()
        for t in range(periods):
            x = 0.5 * effect + rng.normal()
            y = 0.5 * y + 1.2 * x + effect + rng.normal()
            if rng.random() > 0.07:
                rows.append((u, 2000 + t, y, x))
    return rows


ROWS = made()


def dense(rows, lags, first, last, collapse, twostep):
    """All differenced rows at once; instruments as one wide matrix."""
    value = {(u, t): (y, x) for u, t, y, x in rows}
    low, high = min(r[1] for r in rows), max(r[1] for r in rows)
    keys, dy, dx, z = [], [], [], []
    names = {}
    for u, t in sorted(value):
        need = [(u, t - j) for j in range(lags + 2)]
        if not all(k in value for k in need):
            continue
        keys.append((u, t))
        dy.append(value[u, t][0] - value[u, t - 1][0])
        dx.append([*[value[u, t - j][0] - value[u, t - j - 1][0] for j in range(1, lags + 1)], value[u, t][1] - value[u, t - 1][1]])
        own = {}
        for s in range(first, min(last, t - low) + 1):
            own[names.setdefault(s if collapse else (t, s), len(names))] = value.get((u, t - s), (0.0, 0))[0]
        z.append(own)
    wide = np.zeros((len(z), len(names) + 1))
    for i, own in enumerate(z):
        for j, v in own.items():
            wide[i, j] = v
    dy, dx = np.array(dy), np.array(dx)
    wide[:, -1] = dx[:, -1]
    wide = wide[:, np.abs(wide).max(0) > 0]
    unit = np.array([k[0] for k in keys])
    h = np.array([[(2.0 if a == b else -1.0 if abs(a[1] - b[1]) == 1 else 0.0) if a[0] == b[0] else 0.0 for b in keys] for a in keys])
    sums = lambda e: np.array([wide[unit == u].T @ e[unit == u] for u in np.unique(unit)])
    w = np.linalg.pinv(wide.T @ h @ wide)
    zx, zy = wide.T @ dx, wide.T @ dy
    solve = lambda w: np.linalg.solve(zx.T @ w @ zx, zx.T @ w @ zy)
    beta = solve(w)
    e = dy - dx @ beta
    middle = sums(e).T @ sums(e)
    bread = np.linalg.inv(zx.T @ w @ zx)
    cov = bread @ zx.T @ w @ middle @ w @ zx @ bread
    sargan = (wide.T @ e) @ w @ (wide.T @ e) / (e @ e / (2 * (len(e) - dx.shape[1])))
    if twostep:
        w = np.linalg.pinv(middle)
        beta = solve(w)
        e = dy - dx @ beta
        bread = cov = np.linalg.inv(zx.T @ w @ zx)
        sargan = (wide.T @ e) @ w @ (wide.T @ e)
    tests = []
    for j in (1, 2):
        before = np.array([e[keys.index((u, t - j))] if (u, t - j) in keys else 0.0 for u, t in keys])
        each = np.array([before[unit == u] @ e[unit == u] for u in np.unique(unit)])
        xe = before @ dx
        spread = each @ each - 2 * xe @ bread @ zx.T @ w @ (sums(e).T @ each) + xe @ cov @ xe
        tests.append(each.sum() / np.sqrt(spread))
    return beta, np.sqrt(np.diag(cov)), sargan, wide.shape[1] - dx.shape[1], tests, len(e)


@pytest.fixture(scope="module")
def table(spark):
    odd = [(500, 2003, None, 1.0), (501, 2001, 1.0, 1.0), (502, 2001, 1.0, 2.0), (502, 2005, 1.0, 2.0)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS + odd)], f"{ROW} long, u long, t long, y double, x double").repartition(5)


@pytest.mark.parametrize("lags, last, collapse, twostep", [(1, None, False, False), (1, 3, False, True), (2, 4, False, False), (1, 4, True, True)])
def test_against_dense_matrices(table, lags, last, collapse, twostep):
    fit = dynamic.xtabond(table, "y", "x", unit="u", time="t", lags=lags, last=last, collapse=collapse, twostep=twostep)
    beta, se, sargan, df, tests, n = dense(ROWS, lags, 2, last or 99, collapse, twostep)
    assert fit.names == [*[f"L{j}.y" for j in range(1, lags + 1)], "x"] and fit.n == n
    assert np.allclose(fit.beta, beta, rtol=1e-6) and np.allclose(fit.se, se, rtol=1e-6)
    assert np.isclose(fit.stats["sargan"], sargan, rtol=1e-6) and fit.stats["sargan_df"] == df
    assert np.allclose([fit.stats["m1"], fit.stats["m2"]], tests, rtol=1e-6)


def test_finds_the_truth(spark):
    rows = made(1500, 7)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{ROW} long, u long, t long, y double, x double")
    fit = dynamic.xtabond(df, "y", "x", unit="u", time="t", twostep=True)
    assert abs(fit["L1.y"] - 0.5) < 0.1 and abs(fit["x"] - 1.2) < 0.1
    assert fit.stats["m1_p"] < 0.01 < fit.stats["m2_p"] and fit.stats["sargan_p"] > 0.001


def test_refusals(spark, table):
    twice = table.union(table.where("u = 1"))
    with pytest.raises(ValueError, match="twice"):
        dynamic.xtabond(twice, "y", "x", unit="u", time="t")
    with pytest.raises(ValueError, match="no observations"):
        dynamic.xtabond(table.limit(0), "y", "x", unit="u", time="t")
    with pytest.raises(ValueError, match="too few"):
        dynamic.xtabond(table.where("u > 499"), "y", "x", unit="u", time="t")
    with pytest.raises(ValueError, match="periods"):
        dynamic.xtabond(table.withColumn("t", table["t"] * 1000), "y", "x", unit="u", time="t")
