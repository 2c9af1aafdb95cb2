"""Exact quantiles and running sums against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.operators import survival
from halyard.plans import ranks

FRACTIONS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]


@pytest.mark.parametrize("few", [1, 10_000])
def test_quantiles(spark, monkeypatch, few):
    monkeypatch.setattr(ranks, "FEW", few)
    monkeypatch.setattr(ranks, "BINS", 64)
    rng = np.random.default_rng(3)
    n = 3000
    columns = {"wide": rng.normal(size=n) * 10.0 ** rng.integers(-200, 200, n), "ties": rng.integers(-3, 3, n).astype(float), "close": 1 + rng.integers(0, 50, n) * 2.0**-52, "one": np.full(n, 7.5)}
    rows = [tuple(float(columns[c][i]) for c in columns) + (None,) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns) + ", none double").repartition(3)
    got = ranks.quantiles(df, [F.col(c) for c in df.columns], FRACTIONS)
    for c, row in zip(columns, got, strict=False):
        assert row == pytest.approx(np.quantile(columns[c], FRACTIONS).tolist(), rel=1e-12), c
    assert got[-1] == [None] * len(FRACTIONS)


def test_survival_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BLOCKS", 7)
    rng = np.random.default_rng(4)
    t, d = np.round(rng.exponential(size=500), 2), rng.integers(0, 2, 500)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(t, d, strict=True)], "t double, d int")
    out = survival.survival_curve(df, "t", "d").orderBy("time").collect()
    s = h = None
    for r, time in zip(out, np.unique(t), strict=True):
        risk, failed = int((t >= time).sum()), int(d[t == time].sum())
        s, h = (1.0 if s is None else s) * (1 - failed / risk), (h or 0.0) + failed / risk
        assert (r["at_risk"], r["failed"]) == (risk, failed)
        assert (r["survival"], r["cumulative_hazard"]) == (pytest.approx(s, abs=1e-12), pytest.approx(h, abs=1e-12))
    fit = survival.stcox(df.withColumn("x", F.sin("t") + F.col("d")), "t", "x", failure="d")
    hazard = survival.baseline(fit).orderBy("time").collect()
    assert len(hazard) == len(np.unique(t[d == 1])) and [r[1] for r in hazard] == sorted(r[1] for r in hazard)
