"""Bootstraps in shared passes against refits of every replicate on its own counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.operators import resampling, rows
from halyard.plans.draws import hashed_counts
from halyard.sources.tables import ROW

REPS = 25


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(12)
    n = 900
    x, g = rng.normal(size=n), rng.integers(0, 50, n)
    y = rng.poisson(np.exp(0.3 + 0.6 * x))
    s = rng.random(n) < 1 / (1 + np.exp(0.4 - x))
    data = [(i, int(g[i]), float(x[i]) if i % 90 else None, int(y[i]), int(s[i]), float(i % 3) / 4) for i in range(n)]
    return spark.createDataFrame(data, f"{ROW} long, g long, x double, y long, s int, o double").repartition(5)


def refits(df, y, kind, seed, who, offset=False):
    ids = F.xxhash64(F.lit(seed), F.xxhash64(ROW).cast("double") if who == ROW else F.col(who))
    t = df.where("x is not null").select(ids.alias("u"), "x", y, "o").toPandas()
    counts = hashed_counts(t["u"].to_numpy().view(np.uint64), np.arange(REPS))
    x, o, v = np.column_stack([np.ones(len(t)), t["x"]]), t["o"].to_numpy() if offset else 0.0, t[y].to_numpy(float)
    out = []
    for w in counts:
        b = np.zeros(2)
        for _ in range(60):
            mu = np.exp(x @ b + o) if kind == "poisson" else 1 / (1 + np.exp(-x @ b))
            curve = mu if kind == "poisson" else mu * (1 - mu)
            b = b + np.linalg.solve((x.T * (w * curve)) @ x, x.T @ (w * (v - mu)))
        out.append(b)
    return np.array(out)


@pytest.mark.parametrize("offset", [False, True])
def test_poisson(df, offset):
    fit = resampling.bootstrap_poisson(df, "y", "x", reps=REPS, seed=4, offset="o" if offset else None)
    b = refits(df, "y", "poisson", 4, ROW, offset)
    assert np.allclose(fit.cov, np.cov(b.T, ddof=1), rtol=1e-6) and np.allclose(fit.info["percentiles"], np.percentile(b, [2.5, 97.5], axis=0))
    assert np.allclose(fit.info["bias"], b.mean(axis=0) - fit.beta, atol=1e-8)


def test_logit_and_splits(df):
    b = refits(df, "s", "logit", 9, ROW)
    for way in (df, df.repartition(2)):
        assert np.allclose(resampling.bootstrap_logit(way, "s", "x", reps=REPS, seed=9).cov, np.cov(b.T, ddof=1), rtol=1e-6)


def test_clusters_move_together(df):
    one = resampling.bootstrap_poisson(df, "y", "x", reps=REPS, seed=3, cluster="g")
    assert not np.allclose(one.cov, resampling.bootstrap_poisson(df, "y", "x", reps=REPS, seed=3).cov)
    b = refits(df, "y", "poisson", 3, "g")
    assert np.allclose(one.cov, np.cov(b.T, ddof=1), rtol=1e-6)


def test_failures(spark, df):
    apart = df.withColumn("s", (F.col("x") > 0).cast("int"))
    with pytest.raises(ValueError):
        resampling.bootstrap_logit(apart, "s", "x", reps=5)
    with pytest.raises(ValueError):
        resampling.bootstrap_poisson(df, "y", "x", reps=1)


def test_reshape_wide_has_a_limit(spark, monkeypatch):
    monkeypatch.setattr(rows, "MAX_COLUMNS", 3)
    table = spark.range(8).select(F.col("id").alias(ROW), (F.col("id") % 2).alias("i"), F.col("id").alias("j"), F.col("id").alias("v"))
    with pytest.raises(ValueError, match="more than 3"):
        rows.reshape_wide(table, ["v"], ["i"], "j")
