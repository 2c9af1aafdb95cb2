"""Estimates on whole unbalanced panels against brute force in numpy."""

import pathlib

import duckdb
import numpy as np
import pytest

from halyard import queries
from halyard.operators import grouped

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no tables")


@pytest.fixture(scope="module")
def events():
    return duckdb.sql(f"SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, value AS x, 2 * value + (user_id % 5) * 3 + (event_id % 13) AS y, 1 + event_id % 9 AS k FROM '{SF}/events.parquet'").fetchnumpy()


def estimates(df):
    return {r["term"]: r["estimate"] for r in df.collect()}


def test_random_effects(spark, events):
    _, unit = np.unique(events["u"], return_inverse=True)
    x, y = events["x"].astype(float), events["y"].astype(float)
    t = np.bincount(unit).astype(float)
    n, g = len(x), len(t)
    assert t.min() != t.max()
    mx, my = np.bincount(unit, x) / t, np.bincount(unit, y) / t
    wx, wy = x - mx[unit], y - my[unit]
    se2 = ((wy - wx * (wx @ wy) / (wx @ wx)) ** 2).sum() / (n - g - 1)
    z = np.c_[np.ones(g), mx]
    a = z.T @ (z * t[:, None])
    left = my - z @ np.linalg.solve(a, z.T @ (t * my))
    su2 = max(0.0, (t @ left**2 - (g - 2) * se2) / (n - np.trace(np.linalg.solve(a, z.T @ (z * t[:, None] ** 2)))))
    th = (1 - np.sqrt(se2 / (se2 + t * su2)))[unit]
    b = np.linalg.lstsq(np.c_[1 - th, x - th * mx[unit]], y - th * my[unit], rcond=None)[0]
    got = estimates(queries.panel_re_whole(spark, SF))
    assert got == pytest.approx({"_cons": b[0], "x": b[1]}, abs=2e-6)


def test_conditional_poisson(spark, events):
    _, unit = np.unique(events["u"], return_inverse=True)
    x, y = np.c_[events["t"] == 2, events["x"] / 100].astype(float), events["k"].astype(float)
    total = np.bincount(unit, y)
    b = np.zeros(2)
    for _ in range(50):
        e = np.exp(x @ b)
        p = e / np.bincount(unit, e)[unit]
        mean = np.c_[np.bincount(unit, p * x[:, 0]), np.bincount(unit, p * x[:, 1])]
        gap = x - mean[unit]
        b += np.linalg.solve(gap.T @ (gap * (p * total[unit])[:, None]), x.T @ (y - p * total[unit]))
    got = estimates(queries.xtpoisson_fe_whole(spark, SF))
    assert got == pytest.approx({"second": b[0], "x": b[1]}, abs=2e-6)


def test_poisson_gee_on_groups_of_any_size(spark):
    rng = np.random.default_rng(5)
    unit = np.repeat(np.arange(40), rng.integers(1, 9, 40))
    x = np.c_[np.ones(len(unit)), rng.normal(size=len(unit))]
    y = rng.poisson(np.exp(0.5 + 0.3 * x[:, 1] + rng.normal(0, 0.5, 40)[unit])).astype(float)
    n, pairs, b = len(y), sum(t * (t - 1) for t in np.bincount(unit)), np.zeros(2)
    for _ in range(100):
        mean = np.exp(x @ b)
        e = (y - mean) / np.sqrt(mean)
        rho = (sum(e[unit == g].sum() ** 2 for g in range(40)) - e @ e) / pairs / (e @ e / n)
        info, score, middle = np.zeros((2, 2)), np.zeros(2), np.zeros((2, 2))
        for g in range(40):
            m, z = mean[unit == g], x[unit == g] * mean[unit == g][:, None]
            v = np.sqrt(np.outer(m, m)) * (rho + (1 - rho) * np.eye(len(m)))
            u = z.T @ np.linalg.solve(v, y[unit == g] - m)
            info, score, middle = info + z.T @ np.linalg.solve(v, z), score + u, middle + np.outer(u, u)
        b = b + np.linalg.solve(info, score)
    bread = np.linalg.inv(info)
    rows = spark.createDataFrame([(int(g), float(k), float(v), i) for i, (g, k, v) in enumerate(zip(unit, y, x[:, 1], strict=True))], "u long, y double, x double, __row long")
    fit = grouped.xtgee_poisson(rows, "y", "x", group="u")
    assert fit.beta[[fit.names.index("_cons"), fit.names.index("x")]] == pytest.approx(b, abs=1e-7)
    assert fit.stats["rho"] == pytest.approx(rho, abs=1e-7)
    at = [fit.names.index("_cons"), fit.names.index("x")]
    assert fit.cov[np.ix_(at, at)] == pytest.approx(bread @ middle @ bread * 40 / 39, rel=1e-5)


def test_counts_use_every_event(spark, events, monkeypatch):
    seen = []
    fit = grouped.xtpoisson_re
    monkeypatch.setattr(grouped, "xtpoisson_re", lambda df, *a, **k: seen.append(df.count()) or fit(df, *a, **k))
    queries.panel_counts(spark, SF)
    assert seen == [len(events["u"])] * 2
