"""Resampling with a fixed number of draws."""

import math

import numpy as np
import pytest

from halyard.operators import linear, other
from halyard.plans.draws import block_counts
from halyard.sources import tables


@pytest.mark.parametrize("total, width", [(1, 4), (10, 4), (8, 4), (1000, 7), (5, 1)])
def test_counts_add_up(total, width):
    counts = np.concatenate([block_counts(3, 50, total, width, b) for b in range(-(-total // width))], axis=1)
    assert counts.shape == (50, total) and (counts.sum(axis=1) == total).all()


def test_counts_are_multinomial():
    counts = np.concatenate([block_counts(9, 4000, 20, 3, b) for b in range(7)], axis=1)
    assert np.abs(counts.mean(axis=0) - 1).max() < 6 * math.sqrt(0.95 / 4000)
    assert np.abs(counts.var(axis=0) - 0.95).max() < 0.2
    assert np.abs(np.cov(counts.T)[np.triu_indices(20, 1)] + 0.05).max() < 0.1


def test_bootstrap_fixed(spark):
    rng = np.random.default_rng(4)
    data = [(i % 60, float(rng.normal()), None if i % 97 == 0 else float(rng.normal())) for i in range(3000)]
    df = tables.numbered(spark.createDataFrame([(g, x, None if e is None else 1 + 2 * x + e) for g, x, e in data], "g int, x double, y double"))
    plain = other.bootstrap(df, "y", "x", reps=300, seed=2, fixed=True)
    assert (plain.info["drawn"] == plain.n).all() and plain.n == sum(e is not None for _, _, e in data)
    assert np.allclose(plain.se, linear.regress(df, "y", "x", robust=True).se, rtol=0.25)
    again = other.bootstrap(df.repartition(7), "y", "x", reps=300, seed=2, fixed=True)
    assert np.allclose(plain.cov, again.cov)
    groups = other.bootstrap(df, "y", "x", reps=300, seed=2, cluster="g", fixed=True)
    assert np.allclose(groups.se, linear.regress(df, "y", "x", cluster="g").se, rtol=0.3)


def test_bootstrap_quantiles(spark):
    rng = np.random.default_rng(4)
    df = tables.numbered(spark.createDataFrame([(float(v),) for v in rng.normal(size=200)], "y double"))
    fit = other.bootstrap_quantiles(df, "y", quantiles=[0.75, 0.25], contrast="_cons", reps=5, seed=3)
    assert fit.names == ["q0.25:_cons", "q0.75:_cons", "contrast:_cons"]
    c = np.array([-1.0, 1.0, 0.0])
    assert math.isclose(fit.beta[2], fit.beta[1] - fit.beta[0])
    assert math.isclose(fit.cov[2, 2], c @ fit.cov @ c, rel_tol=1e-9)
    with pytest.raises(ValueError, match="two quantiles"):
        other.bootstrap_quantiles(df, "y", quantiles=[0.5], contrast="_cons")
