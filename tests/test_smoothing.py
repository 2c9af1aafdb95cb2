"""Smoothing of groups of many blocks against the plain kernel, row by row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.operators import smoothing
from halyard.sources.tables import ROW


def plain(x, y, bandwidth, at):
    n = len(x)
    k = int((n * bandwidth - 0.5) // 2)
    out = []
    for i in at:
        if k <= 0:
            out.append(y[i])
            continue
        a, b = max(0, i - k), min(n, i + k + 1)
        u, v = x[a:b] - x[i], y[a:b]
        radius = max(abs(u[0]), abs(u[-1]))
        if radius == 0:
            out.append(v.mean())
            continue
        w = (1 - (np.abs(u) / (1.0001 * radius)) ** 3) ** 3
        m = np.array([[w.sum(), w @ u], [w @ u, w @ (u * u)]])
        out.append(np.linalg.solve(m, [w @ v, w @ (u * v)])[0] if np.linalg.det(m) > 1e-12 * m[0, 0] * m[1, 1] else w @ v / w.sum())
    return np.array(out)


def table(spark, n):
    """A group of n rows, one of 5,000 with heavy ties, small ones, a null group, and rows without values."""
    rng = np.random.default_rng(n)
    big = [(i, "big", float(v), float(np.sin(v) + e)) for i, (v, e) in enumerate(zip(rng.gamma(0.7, 3, n) + 1e4, rng.normal(0, 0.2, n), strict=True))]
    ties = [(n + i, "ties", float(rng.integers(0, 3)), float(rng.normal())) for i in range(5000)]
    odd = [(n + 6000, "one", 1.0, 7.0), (n + 6001, None, 2.0, 1.0), (n + 6002, None, 1.0, 5.0), (n + 6003, None, 3.0, 9.0), (n + 6004, "big", None, 1.0), (n + 6005, "big", 1e4, float("nan")), (n + 6006, "blank", None, None)]
    rows = big + ties + odd
    return rows, spark.createDataFrame(rows, f"{ROW} long, g string, x double, y double").repartition(7)


@pytest.mark.parametrize(("n", "bandwidth"), [(40_000, 2 / 3), (40_000, 0.9999), (40_000, 0.03), (40_000, 0.3), (3_000, 2 / 3)])
def test_equals_the_plain_kernel(spark, n, bandwidth):
    rows, df = table(spark, n)
    out = smoothing.lowess(df, "y", "x", "s", by="g", bandwidth=bandwidth)
    assert out.columns == [ROW, "g", "x", "y", "s"]
    got = {r[0]: r["s"] for r in out.collect()}
    assert len(got) == len(rows)
    for g in {r[1] for r in rows}:
        used = sorted((r for r in rows if r[1] == g and r[2] is not None and r[3] is not None and np.isfinite(r[3])), key=lambda r: (r[2], r[0]))
        x, y = np.array([r[2] for r in used]), np.array([r[3] for r in used])
        at = list(range(0, len(used), 97 if len(used) > 6000 else 11)) + ([len(used) - 1] if used else [])
        expected = plain(x, y, bandwidth, at)
        assert np.abs(np.array([got[used[i][0]] for i in at]) - expected).max(initial=0) < 2e-8
    blank = [r[0] for r in rows if r[2] is None or r[3] is None or not np.isfinite(r[3])]
    assert all(got[i] is None for i in blank)


def test_runs_of_blocks_are_covered_once():
    for low in range(0, 70, 3):
        for high in range(low, 700, 13):
            blocks = [b for level, i in smoothing.covering(low, high, 3) for b in range(i * smoothing.FAN**level, (i + 1) * smoothing.FAN**level)]
            assert sorted(blocks) == list(range(low, high))


def test_empty_and_bounds(spark):
    empty = spark.createDataFrame([], f"{ROW} long, x double, y double")
    assert smoothing.lowess(empty, "y", "x", "s").count() == 0
    with pytest.raises(ValueError):
        smoothing.lowess(empty, "y", "x", "s", bandwidth=1.5)


def test_order_of_places(spark):
    df = spark.range(200).select(F.array(F.lit(1), F.col("id")).alias(ROW), (F.col("id") % 5).alias("x"), F.col("id").alias("y"))
    assert smoothing.lowess(df, "y", "x", "s").where("s is null").count() == 0
