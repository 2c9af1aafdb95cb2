"""Missing values, errors and numerical identities."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.functions import dist, safe
from halyard.operators import iv, likelihood, linear, other, panel, rows, summaries, survival
from halyard.sources import tables


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(5)
    n = 400
    x, z = rng.normal(size=n), rng.normal(size=n)
    g = rng.integers(0, 25, n)
    y = 1 + 2 * x - z + 0.3 * g / 25 + rng.normal(size=n)
    k = rng.poisson(np.exp(0.2 + 0.5 * x))
    b = (x + rng.logistic(size=n) > 0).astype(float)
    t = rng.exponential(np.exp(-0.5 * x))
    data = [(float(a), float(c), int(e), float(f), float(h), float(i), float(j)) for a, c, e, f, h, i, j in zip(x, z, g, y, k, b, t, strict=True)]
    data += [(None, 1.0, 1, 1.0, 1.0, 1.0, 1.0), (math.nan, 1.0, 1, 1.0, 1.0, 1.0, 1.0), (math.inf, 1.0, 1, 1.0, 1.0, 1.0, 1.0)]
    df = tables.numbered(spark.createDataFrame(data, "x double, z double, g int, y double, k double, b double, t double")).withColumn("one", F.lit(1.0))
    return df.persist(), dict(x=x, z=z, g=g, y=y, k=k, b=b, t=t)


def test_dist():
    assert dist.normal_quantile(0.975) == pytest.approx(1.959963984540054, abs=1e-12)
    assert dist.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert dist.t_quantile(0.975, 10) == pytest.approx(2.2281388519649385, abs=1e-9)
    assert dist.chi2_upper(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert dist.f_upper(4.964602743730711, 1, 10) == pytest.approx(0.05, abs=1e-9)
    assert dist.log_normal_cdf(np.array([-30.0]))[0] == pytest.approx(-454.3212439563, abs=1e-6)


def test_sql_functions(spark):
    safe.register(spark)
    r = spark.sql("SELECT isfinite(double('NaN')) a, isfinite(1.0D) b, isfinite(NULL) c, normal_cdf(0.0D) d, t_pvalue(2e6D, 5.0D) e").first()
    assert (r["a"], r["b"], r["c"], r["d"], r["e"]) == (False, True, False, 0.5, None)


def test_ols(sample):
    df, v = sample
    fit = linear.regress(df, "y", "x", "z")
    design = np.column_stack([np.ones(400), v["x"], v["z"]])
    b, rss = np.linalg.lstsq(design, v["y"], rcond=None)[:2]
    assert fit.n == 400
    assert fit.beta == pytest.approx(b, abs=1e-9)
    assert fit.se == pytest.approx(np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * rss[0] / 397), abs=1e-9)
    e = v["y"] - design @ b
    bread = np.linalg.inv(design.T @ design)
    u = np.zeros((25, 3))
    np.add.at(u, v["g"], e[:, None] * design)
    cov = bread @ (u.T @ u) @ bread * 25 / 24 * 399 / 397
    assert linear.regress(df, "y", "x", "z", cluster="g").cov == pytest.approx(cov, abs=1e-9)


def test_collinear_and_unknown(sample):
    df, _ = sample
    with pytest.raises(ValueError, match="collinear"):
        linear.regress(df.withColumn("x2", 2 * F.col("x")), "y", "x", "x2")
    with pytest.raises(ValueError, match="unknown"):
        linear.regress(df, "y", "nothing")


@pytest.mark.parametrize("fit,y,model", [(likelihood.logit, "b", likelihood.logit_rows), (likelihood.probit, "b", likelihood.probit_rows), (likelihood.poisson, "k", likelihood.poisson_rows)])
def test_likelihood_stationary(sample, fit, y, model):
    df, v = sample
    got = fit(df, y, "x", "z", robust=True)
    x = np.column_stack([np.ones(400), v["x"], v["z"]])
    _, s = model(got.beta, x, v[y], np.zeros((400, 0)))
    assert np.abs(s.sum(0)).max() < 1e-5
    assert got.stats["lr"] > 0


def test_scores_are_gradients():
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(30), rng.normal(size=30)])
    y, t, none = rng.poisson(3, 30).astype(float), rng.exponential(size=30) + 0.1, np.zeros((30, 0))
    failed = (rng.random((30, 1)) < 0.7).astype(float)
    cases = [(likelihood.negative_binomial_rows, y, none, 3), (likelihood.tobit_rows(2.0), y, none, 3), (likelihood.truncated_rows(-1.0), y, none, 3), (likelihood.weibull_rows, t, failed, 3), (likelihood.gompertz_rows, t, failed, 3), (likelihood.exponential_rows, t, failed, 2), (likelihood.multinomial_rows(3), (y % 3), none, 4)]
    for model, out, extra, size in cases:
        b = rng.normal(size=size) * 0.3
        s = model(b, x, out, extra)[1].sum(0)
        for j in range(size):
            up, down = b.copy(), b.copy()
            up[j] += 1e-6
            down[j] -= 1e-6
            slope = (model(up, x, out, extra)[0].sum() - model(down, x, out, extra)[0].sum()) / 2e-6
            assert s[j] == pytest.approx(slope, rel=1e-5, abs=1e-5)


def test_panel(sample):
    df, v = sample
    fe = panel.xtreg_fe(df, "y", "x", unit="g")
    w = lambda a: a - (np.bincount(v["g"], a) / np.bincount(v["g"]))[v["g"]]
    assert fe["x"] == pytest.approx(w(v["x"]) @ w(v["y"]) / (w(v["x"]) @ w(v["x"])), abs=1e-9)
    re, ml = panel.xtreg_re(df, "y", "x", unit="g"), panel.xtreg_ml(df, "y", "x", unit="g")
    assert re["x"] == pytest.approx(ml["x"], abs=0.05)
    assert panel.xtgee(df, "y", "x", unit="g")["x"] == pytest.approx(ml["x"], abs=0.05)


def test_iv_exactly_identified(sample):
    df, v = sample
    fit = iv.ivregress(df, "y", endog=["x"], iv=["z"])
    c = np.cov(np.vstack([v["z"], v["x"], v["y"]]))
    assert fit["x"] == pytest.approx(c[0, 2] / c[0, 1], rel=1e-8)
    assert iv.anderson_rubin(fit, [fit["x"]])["f"] == pytest.approx(0, abs=1e-8)


def test_cox_without_ties(sample):
    df, v = sample
    fit = survival.stcox(df, "t", "x", failure="one")
    order = np.argsort(-v["t"])
    x, e = v["x"][order], np.exp(v["x"][order] * fit["x"])
    score = (x - np.cumsum(x * e) / np.cumsum(e)).sum()
    assert abs(score) < 1e-6


def test_quantile(sample):
    df, v = sample
    fit = other.qreg(df, "y", "x", quantile=0.4)
    e = v["y"] - fit["_cons"] - fit["x"] * v["x"]
    assert (np.abs(e) < 1e-8).sum() >= 2
    assert (e < -1e-9).sum() <= 160 <= (e < 1e-9).sum()


def test_rows(spark):
    df = tables.numbered(spark.createDataFrame([(1, "b", 2.0), (2, None, None), (3, "a", math.nan), (4, "b", -1.0)], "i int, s string, v double"))
    assert [r["i"] for r in rows.keep_if(df, "v > 0").collect()] == [1, 3]  # NaN is above all numbers
    assert [r["i"] for r in rows.drop_if(df, "v > 0").orderBy("i").collect()] == [2, 4]
    assert [r["i"] for r in rows.gsort(df, "-s", "i").orderBy(tables.ROW).collect()] == [1, 4, 3, 2]
    coded, labels = rows.encode(df, "s", "c")
    assert {(r["s"], r["c"]) for r in coded.collect()} == {("a", 1), ("b", 2), (None, None)}
    assert rows.decode(coded, "c", labels, "back").where("NOT (s <=> back)").count() == 0
    assert rows.generate(df, "w", "try_divide(v, 0)").where("w is not null").count() == 0
    with pytest.raises(ValueError):
        rows.rename(df, "i", "s")
    with pytest.raises(ValueError):
        rows.append(df, df.drop("v"))


def test_empty(spark):
    df = tables.numbered(spark.createDataFrame([], "i int, v double"))
    assert summaries.summarize(df, "v").first()["n"] == 0
    assert summaries.missing(df, "v").first()["percent"] == 0
    assert summaries.duplicates(df, "i").first()["total"] == 0
    assert summaries.assert_rows(df, "v > 0").first()["failed"] == 0
    with pytest.raises(ValueError):
        linear.regress(df, "v", "i")


def test_csv_round_trip(spark, tmp_path):
    df = tables.numbered(spark.createDataFrame([(1, "x,y", None), (2, None, 1.5)], "i int, s string, v double"))
    tables.export(df, f"{tmp_path}/t.csv")
    back = tables.use(spark, f"{tmp_path}/t.csv")
    assert [tuple(r)[:3] for r in back.orderBy(tables.ROW).collect()] == [(1, "x,y", None), (2, None, 1.5)]
    with pytest.raises(ValueError):
        tables.use(spark, "x.dta")


def test_signature_depends_on_order(spark):
    df = tables.numbered(spark.createDataFrame([(1,), (2,)], "i int").coalesce(1))
    turned = rows.gsort(df, "-i")
    assert summaries.datasignature(df).first() != summaries.datasignature(turned).first()


def test_group_effects_integrate():
    from halyard.operators import grouped

    s, m = np.array([0.0, 3.0, 40.0]), np.array([0.5, 2.0, 35.0])
    u = np.linspace(-12, 12, 200_001)
    density = np.exp(-u * u / (2 * 0.64)) / math.sqrt(2 * math.pi * 0.64)
    step = u[1] - u[0]
    exact = [math.log((np.exp(a * u - b * np.exp(u)) * density).sum() * step) for a, b in zip(s, m, strict=True)]
    assert grouped.normal_effect(s, m, math.log(0.8)) == pytest.approx(exact, abs=1e-8)
    g = np.exp(u)
    r = 2.0
    prior = r**r / math.gamma(r) * g ** (r - 1) * np.exp(-r * g) * g
    exact = [math.log((np.exp(a * u - b * g) * prior).sum() * step) for a, b in zip(s, m, strict=True)]
    assert grouped.gamma_effect(s, m, -math.log(r)) == pytest.approx(exact, abs=1e-8)


def test_labels(spark):
    df = tables.numbered(spark.createDataFrame([(1,), (2,), (3,)], "c int"))
    df = rows.label_values(rows.label_variable(df, "c", "a code"), "c", {1: "one", 2: "two"})
    assert rows.labels_of(df)["c"]["label"] == "a code"
    assert [r["t"] for r in rows.labelled(df, "c", "t").orderBy(tables.ROW).collect()] == ["one", "two", None]


def test_nested_logit(spark):
    from halyard.operators import grouped

    rng = np.random.default_rng(2)
    sets, tau = 300, 0.6
    x = rng.normal(size=(sets, 4))
    a = np.exp(x * 0.8 / tau)
    top = np.stack([a[:, :2].sum(1), a[:, 2:].sum(1)], 1) ** tau
    p = np.concatenate([a[:, :2] / a[:, :2].sum(1, keepdims=True), a[:, 2:] / a[:, 2:].sum(1, keepdims=True)], 1) * np.repeat(top / top.sum(1, keepdims=True), 2, 1)
    pick = [rng.choice(4, p=r / r.sum()) for r in p]
    data = [(i, j, j // 2, float(pick[i] == j), float(x[i, j])) for i in range(sets) for j in range(4)]
    fit = grouped.nlogit(tables.numbered(spark.createDataFrame(data, "s int, a int, nest int, chosen double, x double")), "chosen", "x", group="s", nest="nest")

    def ll(b, t):
        a = np.exp(x * b / t)
        inside = np.stack([a[:, :2].sum(1), a[:, 2:].sum(1)], 1)
        n = np.array(pick) // 2
        return float((x[np.arange(sets), pick] * b / t + (t - 1) * np.log(inside[np.arange(sets), n]) - np.log((inside**t).sum(1))).sum())

    best = ll(fit["x"], fit.stats["dissimilarity"])
    assert fit.stats["ll"] == pytest.approx(best, abs=1e-6)
    assert all(ll(fit["x"] + u, fit.stats["dissimilarity"] + v) <= best + 1e-6 for u in (-0.01, 0, 0.01) for v in (-0.01, 0, 0.01))


def test_nested_logit_with_a_coefficient_for_each_nest(spark):
    from halyard.operators import grouped

    rng = np.random.default_rng(5)
    sets, lam = 500, np.array([0.5, 0.8])
    x, z = rng.normal(size=(sets, 4)), rng.normal(size=(sets, 2))

    def shares(b, g, lam):
        a = np.exp(x * b).reshape(sets, 2, 2)
        top = np.exp(g * z + lam * np.log(a.sum(2)))
        return (a / a.sum(2, keepdims=True) * (top / top.sum(1, keepdims=True))[:, :, None]).reshape(sets, 4)

    pick = np.array([rng.choice(4, p=r) for r in shares(0.9, 0.4, lam)])
    data = [(i, "ab"[j // 2], float(pick[i] == j), float(x[i, j]), float(z[i, j // 2])) for i in range(sets) for j in range(4)]
    df = tables.numbered(spark.createDataFrame(data, "s int, side string, chosen double, x double, z double"))
    fit = grouped.nlogit(df, "chosen", "x", group="s", nest="side", form="nonnormalized", nest_terms=["z"], test=True)
    assert fit.names == ["x", "z", "iv_a", "iv_b"]

    def ll(p):
        return float(np.log(shares(p[0], p[1], p[2:])[np.arange(sets), pick]).sum())

    best = ll(fit.beta)
    assert fit.stats["ll"] == pytest.approx(best, abs=1e-6)
    assert all(ll(fit.beta + s * u) <= best + 1e-6 for u in np.eye(4) for s in (-0.01, 0.01))
    assert fit.stats["lr_df"] == 2 and fit.stats["lr_iv1"] >= 0
    assert fit.stats["ll_iv1"] >= ll(np.array([0.9, 0.4, 1, 1]))
    out = grouped.nested_probabilities(fit, df, "s", "side", "pr").orderBy(tables.ROW).toPandas()
    assert np.allclose(out["pr"].to_numpy().reshape(sets, 4), shares(fit.beta[0], fit.beta[1], fit.beta[2:]))
    gap = df.withColumn("x", F.when((F.col("s") == 3) & (F.col("side") == "a"), None).otherwise(F.col("x")))
    assert grouped.nested_probabilities(fit, gap, "s", "side", "pr").where("pr is null").select("s").distinct().collect() == [(3,)]
    uneven = df.withColumn("z", F.col("z") + F.col("x"))
    with pytest.raises(ValueError, match="constant within"):
        grouped.nlogit(uneven, "chosen", "x", group="s", nest="side", form="nonnormalized", nest_terms=["z"])


def test_t_functions_of_arrays():
    rng = np.random.default_rng(8)
    t, df = rng.normal(size=300) * 10.0 ** rng.integers(-2, 3, 300), np.r_[rng.integers(1, 60, 250), rng.uniform(1, 1e5, 50)].astype(float)
    assert dist.t_two_sideds(t, df) == pytest.approx([dist.t_two_sided(a, b) for a, b in zip(t, df, strict=True)], rel=1e-10, abs=1e-300)
    p = rng.uniform(0.001, 0.999, 40)
    assert dist.t_quantiles(p, df[:40]) == pytest.approx([dist.t_quantile(a, b) for a, b in zip(p, df, strict=False)], rel=1e-9, abs=1e-9)


def test_named_tables(spark):
    named = safe.Relations()
    df = tables.numbered(spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, v double"))
    named.put("second", rows.rename(df, "v", "w"))
    out = named.sql(df, "SELECT a.k, v + w AS s FROM active a JOIN second USING (k)", into="both")
    assert sorted(tuple(r)[:2] for r in named.use("both").collect()) == [(1, 4.0), (2, 6.0)] and tables.ROW in out.columns
    assert named.sql(named.use("both"), "SELECT count(*) AS n FROM both").first()["n"] == 2
    named.drop("second")
    for bad in (lambda: named.use("second"), lambda: named.put("active", df), lambda: named.put("a b", df)):
        with pytest.raises(ValueError):
            bad()
