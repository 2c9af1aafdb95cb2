"""Registered queries of the penalised and later estimators, each with SQL that finds the same numbers another way."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import safe
from .operators import dynamic, effects, iv, likelihood, other, panel, penalised, resampling, rows, smoothing, spatial, summaries, time_joins, two_part
from .plans import sequence
from .queries import _FIRST, _MILLS, _STATUS, _newton, _panel, _rowwise, _slopes, _status, coefficients, load, query, rounded
from .sources import tables

_MADE = "SELECT (3 + 2 * l_quantity + l_tax * 100 + (l_partkey % 7))::DOUBLE AS y, l_quantity::DOUBLE AS q, l_tax::DOUBLE * 100 AS t, (l_partkey % 7)::DOUBLE AS p, (l_orderkey % 4)::DOUBLE AS f FROM lineitem"


def _made(spark, sf):
    made = ["3 + 2 * l_quantity + l_tax * 100 + (l_partkey % 7) AS y", "cast(l_quantity AS double) AS q", "cast(l_tax AS double) * 100 AS t", "cast(l_partkey % 7 AS double) AS p", "cast(l_orderkey % 4 AS double) AS f"]
    return load(spark, sf, "lineitem").selectExpr("*", *made)


def _descent(alphas: list[float], ratio: float, steps: int = 60) -> str:
    """Coordinate descent on three columns as a recursion, a row for each penalty."""
    g = lambda i, j: f"g{min(i, j)}{max(i, j)}"

    def best(j: int, values: dict[int, str]) -> str:
        pull = f"(c{j} - " + " - ".join(f"{g(i, j)} * {v}" for i, v in values.items()) + ")"
        return f"sign{pull} * greatest(abs{pull} - alpha * {ratio}, 0) / ({g(j, j)} + alpha * {1 - ratio})"

    names = ["q", "t", "p"]
    sums = ", ".join([f"covar_pop({names[i - 1]}, {names[j - 1]}) AS g{i}{j}" for i in (1, 2, 3) for j in range(i, 4)] + [f"covar_pop(y, {n}) AS c{i}, avg({n}) AS m{i}" for i, n in enumerate(names, 1)])
    terms = " UNION ALL ".join([f"SELECT alpha, '{n}' AS term, round(b{i}, 6) AS estimate FROM z" for i, n in enumerate(names, 1)] + ["SELECT alpha, '_cons', round(my - b1 * m1 - b2 * m2 - b3 * m3, 6) FROM z"])
    return f"""WITH RECURSIVE d AS ({_MADE}), m AS (SELECT {sums}, avg(y) AS my FROM d),
s AS (SELECT 0 AS step, alpha, 0::DOUBLE AS b1, 0::DOUBLE AS b2, 0::DOUBLE AS b3 FROM (VALUES {", ".join(f"({a}::DOUBLE)" for a in alphas)}) AS a(alpha)
UNION ALL SELECT step + 1, alpha, n1, n2, {best(3, {1: "n1", 2: "n2"})} FROM (SELECT *, {best(2, {1: "n1", 3: "b3"})} AS n2 FROM (SELECT s.*, m.*, {best(1, {2: "b2", 3: "b3"})} AS n1 FROM s, m WHERE step < {steps}))),
z AS (SELECT * FROM s, m WHERE step = {steps}) {terms}"""


@query(_descent([500, 100, 5, 2, 0.25], 1.0))
def lasso_path(spark, sf):
    return rounded(penalised.lasso_path(_made(spark, sf), "y", "q", "t", "p", alphas=[500.0, 100.0, 5.0, 2.0, 0.25]))


@query(_descent([8.0], 0.25))
def elasticnet_fit(spark, sf):
    fit = penalised.elasticnet(_made(spark, sf), "y", "q", "t", "p", alpha=8.0, l1_ratio=0.25)
    return rounded(fit.table(spark).select(F.lit(8.0).alias("alpha"), "term", "estimate"))


@query(f"""WITH m AS (SELECT count(*) AS n, var_pop(q) * count(*) + 50000 AS gq, var_pop(t) * count(*) + 50000 AS gt, covar_pop(q, t) * count(*) AS gc, covar_pop(y, q) * count(*) AS cq, covar_pop(y, t) * count(*) AS ct, avg(y) AS my, avg(q) AS mq, avg(t) AS mt FROM ({_MADE})),
s AS (SELECT *, (cq * gt - ct * gc) / (gq * gt - gc * gc) AS bq, (ct * gq - cq * gc) / (gq * gt - gc * gc) AS bt FROM m)
SELECT 'q' AS term, round(bq, 6) AS estimate FROM s UNION ALL SELECT 't', round(bt, 6) FROM s UNION ALL SELECT '_cons', round(my - bq * mq - bt * mt, 6) FROM s""")
def ridge_fit(spark, sf):
    return rounded(penalised.ridge(_made(spark, sf), "y", "q", "t", alpha=50000.0).table(spark).select("term", "estimate"))


@query(f"""WITH d AS ({_MADE}), m AS (SELECT count(*) AS n, var_pop(q) AS gq, var_pop(t) AS gt, covar_pop(q, t) AS gc, covar_pop(y, q) AS cq, covar_pop(y, t) AS ct, var_pop(y) AS vy, avg(y) AS my, avg(q) AS mq, avg(t) AS mt FROM d),
s AS (SELECT *, gq * gt - gc * gc AS det, (cq * gt - ct * gc) / (gq * gt - gc * gc) AS bq, (ct * gq - cq * gc) / (gq * gt - gc * gc) AS bt FROM m),
v AS (SELECT *, (vy - bq * cq - bt * ct) * n / (n - 3) AS s2 FROM s)
SELECT 'q' AS term, round(bq, 5) AS estimate, round(sqrt(s2 * gt / det / n), 5) AS se FROM v UNION ALL SELECT 't', round(bt, 5), round(sqrt(s2 * gq / det / n), 5) FROM v
UNION ALL SELECT '_cons', round(my - bq * mq - bt * mt, 5), round(sqrt(s2 * (1 + (mq * mq * gt - 2 * mq * mt * gc + mt * mt * gq) / det) / n), 5) FROM v""")
def postlasso_fit(spark, sf):
    return coefficients(spark, penalised.postlasso(_made(spark, sf), "y", "q", "t", "p", alpha=5.0), 5)


def _held_out(candidates: list[float], slope: str) -> str:
    """Losses by fold of one slope, which is told by sums n, sxx and sxy about the training rows' means."""
    return f"""WITH d AS ({_MADE}), k AS (SELECT DISTINCT f FROM d),
tr AS (SELECT k.f, count(*)::DOUBLE AS n, avg(q) AS mq, avg(y) AS my, var_pop(q) * count(*) AS sxx, covar_pop(y, q) * count(*) AS sxy FROM k JOIN d ON d.f <> k.f GROUP BY k.f),
b AS (SELECT tr.*, alpha, {slope} AS b FROM tr, (VALUES {", ".join(f"({a}::DOUBLE)" for a in candidates)}) AS a(alpha))
SELECT alpha, b.f::BIGINT AS fold, round(avg((d.y - b.my - b.b * (d.q - b.mq)) ** 2), 5) AS loss FROM b JOIN d ON d.f = b.f GROUP BY alpha, b.f"""


@query(_held_out([0.1, 1000.0, 1000000.0], "sxy / (sxx + alpha)"))
def cvridge_losses(spark, sf):
    out = penalised.cv_ridge(_made(spark, sf), "y", "q", fold="f", alphas=[0.1, 1000.0, 1000000.0])
    return rounded(out.table(spark).drop("l1_ratio"), 5)


@query(_held_out([300.0, 30.0, 3.0, 0.0], "sign(sxy) * greatest(abs(sxy) / n - alpha, 0) / (sxx / n)"))
def cvlasso_losses(spark, sf):
    out = penalised.cv_lasso(_made(spark, sf), "y", "q", fold="f", alphas=[300.0, 30.0, 3.0, 0.0])
    return rounded(out.table(spark).drop("l1_ratio"), 5)


@query(f"""WITH d AS ({_MADE}), k AS (SELECT DISTINCT f FROM d),
tr AS (SELECT k.f, regr_slope(y, q) AS sy, regr_intercept(y, q) AS cy, regr_slope(t, q) AS st, regr_intercept(t, q) AS ct FROM k JOIN d ON d.f <> k.f GROUP BY k.f),
r AS (SELECT d.y - cy - sy * q AS u, d.t - ct - st * q AS v FROM d JOIN tr USING (f)), s AS (SELECT sum(u * v) / sum(v * v) AS theta, sum(v * v) AS vv FROM r)
SELECT 't' AS term, round(any_value(theta), 6) AS estimate, round(sqrt(sum((v * (u - theta * v)) ** 2)) / any_value(vv), 6) AS se FROM r, s""")
def dml_fit(spark, sf):
    return coefficients(spark, penalised.dml(_made(spark, sf), "y", "t", "q", fold="f", alpha=0.0).fit)


# --- dynamic panels -----------------------------------------------------

_QUARTERS = "SELECT l_suppkey AS u, (year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) AS t, CAST(sum(l_quantity) AS DOUBLE) AS y, CAST(avg(l_tax) AS DOUBLE) * 1000 AS x FROM {0} GROUP BY 1, 2"


def _quarters(spark, sf):
    return tables.numbered(safe.sql(load(spark, sf, "lineitem"), _QUARTERS.format("active")))


@query(f"""WITH p AS ({_QUARTERS.format("lineitem")}), e AS (SELECT a.u, a.y - b.y AS dy, b.y - c.y AS dl, c.y AS z FROM p a JOIN p b ON b.u = a.u AND b.t = a.t - 1 JOIN p c ON c.u = a.u AND c.t = a.t - 2),
b AS (SELECT sum(z * dy) / sum(z * dl) AS rho, sum(z * dl) AS zx FROM e), g AS (SELECT u, sum(z * (dy - rho * dl)) AS s, any_value(rho) AS rho, any_value(zx) AS zx FROM e, b GROUP BY u)
SELECT 'L1.y' AS term, round(any_value(rho), 5) AS estimate, round(sqrt(sum(s * s)) / abs(any_value(zx)), 5) AS se FROM g""")
def xtabond_one_lag(spark, sf):
    """One instrument, the level two periods before, for one lag."""
    return coefficients(spark, dynamic.xtabond(_quarters(spark, sf), "y", unit="u", time="t", last=2, collapse=True), 5)


@query()
def xtabond_fit(spark, sf):
    """All levels of two to four periods before, for each period apart, in two steps."""
    return coefficients(spark, dynamic.xtabond(_quarters(spark, sf), "y", "x", unit="u", time="t", last=4, twostep=True), 5)


# --- two equations ------------------------------------------------------

_BACK = "SELECT l_orderkey AS k, CAST(sum(CASE WHEN l_returnflag <> 'N' AND l_orderkey % 5 < 3 THEN 1 ELSE 0 END) AS DOUBLE) AS y, CAST(count(*) AS DOUBLE) / 4 AS x, CAST(max(l_quantity) AS DOUBLE) / 50 AS z FROM {0} GROUP BY 1"
_OF_COUNT = "CASE WHEN y = 0 THEN (1 - p1) * exp(-mu) / (p1 + (1 - p1) * exp(-mu)) ELSE 1 END AS a"


def _back(spark, sf):
    return tables.numbered(safe.sql(load(spark, sf, "lineitem"), _BACK.format("active")))


@query(_newton(_rowwise(f"SELECT y, x, count(*) AS w FROM ({_BACK.format('lineitem')}) GROUP BY 1, 2", ["y - a * mu", "(y - a * mu) * x", "1 - a - p1"],
    {(0, 0): "a * mu - mu * mu * a * (1 - a)", (0, 1): "(a * mu - mu * mu * a * (1 - a)) * x", (1, 1): "(a * mu - mu * mu * a * (1 - a)) * x * x", (0, 2): "-mu * a * (1 - a)", (1, 2): "-mu * a * (1 - a) * x", (2, 2): "p1 * (1 - p1) - a * (1 - a)"},
    "exp(b0 + b1 * x) AS mu, 1 / (1 + exp(-b2)) AS p1", _OF_COUNT), ["_cons", "x", "inflate:_cons"], [0.5, 0, 0], 20))
def zip_fit(spark, sf):
    return coefficients(spark, two_part.zip_(_back(spark, sf), "y", "x"), 4)


@query()
def zinb_inflate(spark, sf):
    """NB2 with the odds of a certain zero by the order's largest quantity."""
    lines = load(spark, sf, "lineitem").selectExpr("cast(l_linenumber - 1 + (l_partkey % 3) * (l_linenumber % 2) as double) * (l_returnflag <> 'N')::int AS y", "cast(l_quantity as double) / 50 AS x", "cast(l_tax as double) * 10 AS z", tables.ROW)
    return coefficients(spark, two_part.zinb(lines, "y", "x", inflate=["z"]), 4)


_SEEN = "l_discount * 10 + (l_partkey % 101) / 50.0 > 1.3"
_PRICE = "CAST(l_extendedprice AS DOUBLE) / 20000 + (l_partkey % 101) / 50.0"


def _seen_prices(spark, sf):
    return load(spark, sf, "lineitem").selectExpr(f"CASE WHEN {_SEEN} THEN {_PRICE} END AS y", "cast(l_quantity as double) / 10 AS x", "cast(l_discount as double) * 10 AS z", f"({_SEEN})::int AS s", tables.ROW)


@query()
def heckman_joint(spark, sf):
    """Selection and outcome in one likelihood: a price that is seen where the discount and an unseen part of it are high."""
    lines = _seen_prices(spark, sf)
    return coefficients(spark, two_part.heckman_ml(lines, "y", "x", selected="s", select=["z"]), 4)


# --- effects ------------------------------------------------------------

_CELLS = "SELECT CAST(l_extendedprice AS DOUBLE) / 1000 + CASE WHEN l_suppkey % 2 = 1 AND year(l_shipdate) >= 1998 THEN 2 ELSE 0 END AS y, CAST(l_quantity AS DOUBLE) / 10 AS x, l_suppkey % 2 AS d, CASE WHEN year(l_shipdate) >= 1998 THEN 1 ELSE 0 END AS t, l_suppkey AS g FROM {0}"


def _cells(spark, sf):
    return tables.numbered(safe.sql(load(spark, sf, "lineitem"), _CELLS.format("active")))


def _att(spark, fits: dict):
    return rounded(spark.createDataFrame([(m, float(f.beta[0]), float(f.se[0])) for m, f in fits.items()], "method string, estimate double, se double"), 5)


@query(f"""WITH c AS (SELECT d, t, avg(y) AS m, var_pop(y) / count(*) AS v FROM ({_CELLS.format("lineitem")}) GROUP BY d, t), e AS (SELECT sum(m * (2 * d - 1) * (2 * t - 1)) AS b, sqrt(sum(v)) AS se FROM c)
SELECT unnest(['or', 'ipw', 'aipw']) AS method, round(b, 5) AS estimate, round(se, 5) AS se FROM e""")
def drdid_cells(spark, sf):
    """Without covariates all methods are differences of the four groups' means."""
    return _att(spark, {m: effects.drdid(_cells(spark, sf), "y", treatment="d", post="t", method=m) for m in effects.METHODS})


@query(f"""WITH s AS ({_CELLS.format("lineitem")}), b AS (SELECT t, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM s WHERE d = 0 GROUP BY t),
w AS (SELECT any_value(b) FILTER (t = 1) AS b1, any_value(a) FILTER (t = 1) AS a1, any_value(b) FILTER (t = 0) AS b0, any_value(a) FILTER (t = 0) AS a0 FROM b)
SELECT 'or' AS method, round(avg(y) FILTER (t = 1) - avg(y) FILTER (t = 0) - avg(a1 + b1 * x - a0 - b0 * x), 5) AS estimate FROM s, w WHERE d = 1""")
def drdid_regression(spark, sf):
    return _att(spark, {"or": effects.drdid(_cells(spark, sf), "y", "x", treatment="d", post="t", method="or", cluster="g")}).drop("se")


@query(f"""WITH c AS (SELECT d, t, avg(y) AS m, var_pop(y) / count(*) AS v, count(*) AS n FROM ({_CELLS.format("lineitem")}) GROUP BY d, t)
SELECT 'did' AS method, round(sum(m * (2 * d - 1) * (2 * t - 1)), 5) AS estimate, round(sqrt(sum(v) * sum(n) / (sum(n) - 4)), 5) AS se FROM c""")
def did_cells(spark, sf):
    fit = effects.did(_cells(spark, sf), "y", treatment="d", post="t")
    at = fit.names.index("did")
    return rounded(spark.createDataFrame([("did", float(fit.beta[at]), float(fit.se[at]))], "method string, estimate double, se double"), 5)


_SETS = """(SELECT g, sx, list_sum(list_transform(range(n), lambda i: CASE WHEN (mask >> i) & 1 = 1 THEN xs[i + 1] ELSE 0 END)) AS v
  FROM (SELECT *, unnest(range(0, 1 << n)) AS mask FROM (SELECT l_orderkey AS g, list(CAST(l_quantity AS DOUBLE) / 10) AS xs, sum((l_returnflag <> 'N')::INT) AS s, sum((l_returnflag <> 'N')::INT * CAST(l_quantity AS DOUBLE) / 10) AS sx, count(*) AS n FROM lineitem GROUP BY 1))
  WHERE s > 0 AND s < n AND bit_count(mask) = s)"""


@query(_newton(f"""SELECT step, b0, sum(sx - ev) AS g0, sum(vv - ev * ev) AS h00 FROM (SELECT step, b0, g, any_value(sx) AS sx, sum(exp(b0 * v) * v) / sum(exp(b0 * v)) AS ev, sum(exp(b0 * v) * v * v) / sum(exp(b0 * v)) AS vv FROM {{s}} AS p, {_SETS} AS m GROUP BY step, b0, g) GROUP BY step, b0""", ["x"], [0], 8, 5))
def xtlogit_fe_fit(spark, sf):
    """Every way to place the lines that came back within their order, told by masks in SQL."""
    lines = load(spark, sf, "lineitem").selectExpr("(l_returnflag <> 'N')::int AS y", "cast(l_quantity as double) / 10 AS x", "l_orderkey AS g", tables.ROW)
    return coefficients(spark, effects.xtlogit_fe(lines, "y", "x", group="g"), 5)


# --- joins by time ------------------------------------------------------

@query("""WITH l AS (SELECT l_suppkey % 10 AS k, l_shipdate AS at, l_orderkey AS line, l_linenumber AS part, l_partkey AS item FROM lineitem),
r AS (SELECT o_custkey % 10 AS k, o_orderdate AS at, max(o_orderkey) AS id FROM orders GROUP BY 1, 2)
SELECT l.k, l.at, l.line, l.part, l.item, r.id, r.at AS at_right FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.at >= r.at""")
def asof_backward(spark, sf):
    """Each line with the last order of its group of customers on or before its day."""
    lines = load(spark, sf, "lineitem").selectExpr("l_suppkey % 10 AS k", "l_shipdate AS at", "l_orderkey AS line", "l_linenumber AS part", "l_partkey AS item", tables.ROW)
    orders = load(spark, sf, "orders").selectExpr("o_custkey % 10 AS k", "o_orderdate AS at", "o_orderkey AS id").groupBy("k", "at").agg(F.max("id").alias("id"))
    return time_joins.asof_join(lines, orders, "at", by=["k"]).drop(tables.ROW)


@query("""WITH l AS (SELECT event_id, user_id, ts, value FROM events), r AS (SELECT event_id AS id, user_id, ts FROM events WHERE event_type = 'error')
SELECT l.event_id, l.user_id, l.ts, l.value, r.id, r.ts AS ts_right FROM l ASOF JOIN r ON l.user_id = r.user_id AND l.ts < r.ts""")
def asof_next_error(spark, sf):
    """Each event with its user's next error, if there is one."""
    events = load(spark, sf, "events").select("event_id", "user_id", "ts", "value", tables.ROW)
    errors = load(spark, sf, "events").where("event_type = 'error'").selectExpr("event_id AS id", "user_id", "ts", tables.ROW)
    return time_joins.asof_join(events, errors, "ts", by=["user_id"], direction="forward", strict=True, how="inner").drop(tables.ROW)


@query("""WITH p AS (SELECT event_id, user_id, ts FROM events), i AS (SELECT event_id AS id, user_id, ts AS start, ts + to_seconds(((event_id % 5) * (event_id % 5) * (event_id % 5) * 3600 + 60)::BIGINT) AS finish FROM events WHERE event_type = 'purchase')
SELECT p.event_id, p.user_id, p.ts, i.id, i.start, i.finish FROM p JOIN i ON p.user_id = i.user_id AND p.ts >= i.start AND p.ts < i.finish""")
def interval_sessions(spark, sf):
    """Events within a minute to two and a half days after a purchase of their user."""
    events = load(spark, sf, "events")
    spans = events.where("event_type = 'purchase'").selectExpr("event_id AS id", "user_id", "ts AS start", "ts + make_interval(0, 0, 0, 0, 0, 0, (event_id % 5) * (event_id % 5) * (event_id % 5) * 3600 + 60) AS finish")
    return time_joins.interval_join(events.select("event_id", "user_id", "ts"), spans, "ts", "start", "finish", by=["user_id"])


# --- labels and instruments ---------------------------------------------


@query("""SELECT l_linenumber, l_returnflag, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY l_linenumber), 6) AS row_percent,
  round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) AS column_percent, CASE l_linenumber WHEN 1 THEN 'first' WHEN 2 THEN 'second' WHEN 7 THEN 'last' ELSE l_linenumber::VARCHAR END AS l_linenumber_label, l_returnflag AS l_returnflag_label FROM lineitem GROUP BY 1, 2""")
def tabulate_labels(spark, sf):
    """Codes with their labels, and as they are where they have none."""
    lines = rows.label_values(load(spark, sf, "lineitem"), "l_linenumber", {1: "first", 2: "second", 7: "last"})
    return rounded(summaries.tabulate(lines, "l_linenumber", "l_returnflag", labels=True))


def _two_on(y: str, a: str, b: str) -> tuple[str, str]:
    """Least squares slopes of y on two columns, by moments."""
    det = f"(var_pop({a}) * var_pop({b}) - covar_pop({a}, {b}) * covar_pop({a}, {b}))"
    return f"(covar_pop({y}, {a}) * var_pop({b}) - covar_pop({y}, {b}) * covar_pop({a}, {b})) / {det}", f"(covar_pop({y}, {b}) * var_pop({a}) - covar_pop({y}, {a}) * covar_pop({a}, {b})) / {det}"


_INSTRUMENTS = "SELECT (5 + 2 * (l_quantity + l_tax * 50) + 30 * l_discount + (l_partkey % 11))::DOUBLE AS y, (l_quantity + l_tax * 50 + 20 * l_discount)::DOUBLE AS x, l_quantity::DOUBLE AS z, l_tax::DOUBLE AS z2 FROM lineitem"
_P, _E, _U = _two_on("x", "z", "z2"), _two_on("e", "z", "z2"), _two_on("y", "x", "v")


@query(f"""WITH d AS ({_INSTRUMENTS}), f AS (SELECT {_P[0]} AS p1, {_P[1]} AS p2 FROM d), h AS (SELECT d.*, p1 * z + p2 * z2 AS w FROM d, f),
b AS (SELECT covar_pop(w, y) / covar_pop(w, x) AS b, avg(y) AS my, avg(x) AS mx, var_pop(w) AS vw, count(*) AS n FROM h),
r AS (SELECT h.*, x - w AS v, y - my - b * (x - mx) AS e, b, my, mx, vw, n FROM h, b),
g AS (SELECT any_value(b) AS b, any_value(my) AS my, any_value(mx) AS mx, any_value(vw) AS vw, any_value(n) AS n, sum(e * e) / (any_value(n) - 2) AS s2, any_value(n) * (({_E[0]}) * covar_pop(e, z) + ({_E[1]}) * covar_pop(e, z2)) / (sum(e * e) / any_value(n)) AS sargan,
  var_pop(y) - covar_pop(y, x) * covar_pop(y, x) / var_pop(x) AS short, var_pop(y) - ({_U[0]}) * covar_pop(y, x) - ({_U[1]}) * covar_pop(y, v) AS long FROM r)
SELECT '_cons' AS term, round(my - b * mx, 5) AS estimate, round(sqrt(s2 * (1.0 / n + mx * mx / (n * vw))), 5) AS se FROM g UNION ALL SELECT 'x', round(b, 5), round(sqrt(s2 / (n * vw)), 5) FROM g
UNION ALL SELECT 'sargan', round(sargan, 4), NULL FROM g UNION ALL SELECT 'wu_hausman', round((short - long) / (long / (n - 3)), 2), NULL FROM g""")
def iv_two_instruments(spark, sf):
    """Estimates, standard errors, the test of the surplus instrument and that of exogeneity."""
    df = load(spark, sf, "lineitem").selectExpr("cast(5 + 2 * (l_quantity + l_tax * 50) + 30 * l_discount + (l_partkey % 11) AS double) AS y", "cast(l_quantity + l_tax * 50 + 20 * l_discount AS double) AS x", "l_quantity AS z", "l_tax AS z2", tables.ROW)
    fit = iv.ivregress(df, "y", endog=["x"], iv=["z", "z2"])
    more = [("sargan", round(float(iv.overid(fit)["chi2"]), 4), None), ("wu_hausman", round(float(iv.endogeneity(fit)["f"]), 2), None)]
    return coefficients(spark, fit, 5).union(spark.createDataFrame(more, "term string, estimate double, se double"))


def _solved(sql: str) -> str:
    """The part of a Newton query that holds its last parameters (z) and its sums there (e)."""
    return sql[: sql.index("SELECT '_cons' AS term")]


_LOGIT = _solved(_newton(_rowwise(_STATUS, ["y - p1", "(y - p1) * x"], _slopes("p1 * (1 - p1)"), "1 / (1 + exp(-(b0 + b1 * x))) AS p1"), ["_cons", "x"], [0, 0]))


@query(_LOGIT + f""", a AS (SELECT sum(w * p1 * (1 - p1)) / sum(w) AS f, sum(w * p1 * (1 - p1) * (1 - 2 * p1)) / sum(w) AS d0, sum(w * p1 * (1 - p1) * (1 - 2 * p1) * x) / sum(w) AS d1 FROM (SELECT w, x, 1 / (1 + exp(-(b0 + b1 * x))) AS p1 FROM z, ({_STATUS}) AS d)),
g AS (SELECT e.*, f, b1 * d0 AS k0, f + b1 * d1 AS k1, h00 * h11 - h01 * h01 AS det FROM a, e)
SELECT 'x' AS term, round(b1 * f, 6) AS effect, round(sqrt((k0 * k0 * h11 - 2 * k0 * k1 * h01 + k1 * k1 * h00) / det), 6) AS se FROM g""")
def logit_margins(spark, sf):
    """Mean marginal effect with its delta-method standard error."""
    found = likelihood.margins(likelihood.logit(_status(spark, sf), "y", "x"))
    return rounded(spark.createDataFrame([(n, *map(float, v)) for n, v in found.items()], "term string, effect double, se double"))


_PROBIT = _solved(_newton(_rowwise(f"SELECT ({_SEEN})::INT::DOUBLE AS y, CAST(l_discount AS DOUBLE) * 10 AS x, count(*) AS w FROM lineitem GROUP BY 1, 2", ["q * m", "q * m * x"], _slopes("m * (m + v)"), "2 * y - 1 AS q, (2 * y - 1) * (b0 + b1 * x) AS v", _MILLS), ["_cons", "x"], [0, 0], 12))
_RATIO = _two_on("y", "x", "m")


@query(_PROBIT + f""", r AS (SELECT y, x, {_MILLS} FROM (SELECT {_PRICE} AS y, CAST(l_quantity AS DOUBLE) / 10 AS x, b0 + b1 * CAST(l_discount AS DOUBLE) * 10 AS v FROM lineitem, z WHERE {_SEEN})),
t AS (SELECT {_RATIO[0]} AS bx, {_RATIO[1]} AS bm, avg(y) AS my, avg(x) AS mx, avg(m) AS mm FROM r)
SELECT '_cons' AS term, round(my - bx * mx - bm * mm, 3) AS estimate FROM t UNION ALL SELECT 'x', round(bx, 4) FROM t UNION ALL SELECT 'lambda', round(bm, 3) FROM t""")
def heckman_two_steps(spark, sf):
    """Probit for selection, then least squares with the inverse Mills ratio."""
    fit = other.heckman(_seen_prices(spark, sf), "y", "x", selected="s", select=["z"])
    digits = {"x": 4}
    return spark.createDataFrame([(n, round(float(b), digits.get(n, 3))) for n, b in zip(fit.names, fit.beta, strict=True)], "term string, estimate double")


# --- smoothing ----------------------------------------------------------


@query("""WITH d AS (SELECT o_orderkey AS k, o_totalprice + o_orderkey / 1048576 AS x, (o_custkey % 97)::DOUBLE AS y FROM orders), n AS (SELECT count(*) AS n, floor((count(*) * 0.3 - 0.5) / 2)::BIGINT AS h FROM d),
r AS (SELECT k, x, y, row_number() OVER (ORDER BY x) AS i FROM d), e AS (SELECT r.*, greatest(1, i - h) AS a, least(n, i + h) AS b FROM r, n),
m AS (SELECT e.k, e.x, e.a, e.b, 1.0001 * greatest(e.x - f.x, l.x - e.x) AS radius FROM e JOIN r AS f ON f.i = e.a JOIN r AS l ON l.i = e.b),
w AS (SELECT m.k, r.x - m.x AS u, r.y AS v, (1 - (abs(r.x - m.x) / radius) ** 3) ** 3 AS w FROM (SELECT *, unnest(range(a, b + 1)) AS j FROM m) AS m JOIN r ON r.i = j),
s AS (SELECT k, sum(w) AS s, sum(w * u) AS su, sum(w * u * u) AS suu, sum(w * v) AS sv, sum(w * u * v) AS suv FROM w GROUP BY k)
SELECT k, round((suu * sv - su * suv) / (s * suu - su * su), 4) AS smooth FROM s""")
def lowess_orders(spark, sf):
    """One group of all orders."""
    df = load(spark, sf, "orders").selectExpr("o_orderkey AS k", "o_totalprice + o_orderkey / 1048576 AS x", "cast(o_custkey % 97 AS double) AS y", tables.ROW)
    return rounded(smoothing.lowess(df, "y", "x", "smooth", bandwidth=0.3).select("k", "smooth"), 4)


# --- space --------------------------------------------------------------

_PLACES = "SELECT c_custkey AS u, c_custkey // 50 AS r, c_custkey % 50 AS c, c_nationkey::DOUBLE AS x, c_acctbal / 1000 AS e FROM customer"


@query(f"""WITH d AS ({_PLACES}), s AS (SELECT a.u, b.u AS v FROM d a JOIN (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) AS m(p, q) ON true JOIN d b ON b.r = a.r + p AND b.c = a.c + q),
l AS (SELECT s.u, avg(d.x) AS w FROM s JOIN d ON d.u = s.v GROUP BY s.u), f AS (SELECT d.*, 2 * x + 1.5 * coalesce(w, 0) + e AS y, coalesce(w, 0) AS wx FROM d LEFT JOIN l ON l.u = d.u),
g AS (SELECT s.u, avg(f.y) AS wy, avg(f.wx) AS wwx FROM s JOIN f ON f.u = s.v GROUP BY s.u), h AS (SELECT f.u, f.x, f.y, f.wx, coalesce(wy, 0) AS wy, coalesce(wwx, 0) AS wwx FROM f LEFT JOIN g ON g.u = f.u),
p AS (SELECT {", ".join(f"regr_slope({c}, x) AS s_{c}, regr_intercept({c}, x) AS a_{c}" for c in ("y", "wy", "wx", "wwx"))}, avg(x) AS mx, var_pop(x) AS vx, count(*) AS n FROM h),
o AS (SELECT {", ".join(f"h.{c} - a_{c} - s_{c} * x AS {c}" for c in ("y", "wy", "wx", "wwx"))} FROM h, p),
k AS (SELECT {_two_on("wy", "wx", "wwx")[0]} AS k1, {_two_on("wy", "wx", "wwx")[1]} AS k2 FROM o),
b AS (SELECT sum((k1 * wx + k2 * wwx) * y) / sum((k1 * wx + k2 * wwx) * wy) AS a, sum((k1 * wx + k2 * wwx) * wy) AS q FROM o, k),
z AS (SELECT a, sqrt(sum((y - a * wy) ** 2) / (count(*) - 3) / any_value(q)) AS se FROM o, b GROUP BY a)
SELECT 'W.y' AS term, round(a, 5) AS estimate, round(se, 5) AS se FROM z UNION ALL SELECT 'x', round(s_y - a * s_wy, 5), NULL FROM z, p UNION ALL SELECT '_cons', round(a_y - a * a_wy, 4), NULL FROM z, p""")
def spatial_lag(spark, sf):
    """Customers as cells of a grid 50 wide, whose outcome spills over from their neighbours."""
    df, edges = _grid(spark, sf)
    fit = spatial.spregress(df, "y", "x", unit="u", edges=edges)
    return spark.createDataFrame([(n, round(float(b), 4 if n == "_cons" else 5), round(float(s), 5) if n == "W.y" else None) for n, b, s in zip(fit.names, fit.beta, fit.se, strict=True)], "term string, estimate double, se double")


@query()
def spatial_sarar(spark, sf):
    """The same cells with a lag and errors that spill over."""
    df, edges = _grid(spark, sf)
    fit = spatial.spregress(df, "y", "x", unit="u", edges=edges, model="sarar")
    return coefficients(spark, fit, 5)


def _grid(spark, sf):
    cells = load(spark, sf, "customer").selectExpr("c_custkey AS u", "c_custkey div 50 AS r", "c_custkey % 50 AS c", "cast(c_nationkey AS double) AS x", "c_acctbal / 1000 AS e", tables.ROW)
    edges = spatial.contiguous(cells, "u", "r", "c", "rook")
    return spatial.lagged(cells, spatial.standardised(edges), "u", {"x": "wx"}).withColumn("y", F.expr("2 * x + 1.5 * wx + e")), edges


# --- seeded resampling --------------------------------------------------


@query()
def bootstrap_replay(spark, sf):
    """All lines, and suppliers as clusters, on the draws of one seeded sequence."""
    df = _made(spark, sf)
    alone = other.bootstrap(df, "y", "q", reps=40, seed=20240101, replay=True)
    groups = other.bootstrap(df, "y", "q", reps=40, seed=20240101, cluster="l_suppkey", replay=True)
    out = [(kind, n, float(b), float(s), *map(float, p)) for kind, fit in (("lines", alone), ("suppliers", groups)) for n, b, s, p in zip(fit.names, fit.beta, fit.se, fit.info["percentiles"].T, strict=True)]
    return rounded(spark.createDataFrame(out, "kind string, term string, estimate double, se double, low double, high double"), 8)


def _replay(reps: int, seed: int) -> str:
    """Least squares on resampled clusters, the sequence stepped one number at a time."""
    a, b, c, d = (f"{int(w)}::UHUGEINT" for w in sequence.seeded(seed))
    whole = "18446744073709551616::UHUGEINT"
    turned = lambda x, k: f"(({x}) * {2**k}::UHUGEINT % {whole} + ({x}) // {2 ** (64 - k)}::UHUGEINT)"
    return f"""WITH RECURSIVE v AS ({_MADE.replace("SELECT (", "SELECT l_suppkey AS k, (", 1)}), u AS (SELECT row_number() OVER (ORDER BY k) - 1 AS i, count(*) AS n, sum(q) AS sx, sum(q * q) AS sxx, sum(y) AS sy, sum(q * y) AS sxy FROM v GROUP BY k),
g AS (SELECT count(*) AS g FROM u), s AS (SELECT 0 AS j, {a} AS a, {b} AS b, {c} AS c, {d} AS d
UNION ALL SELECT j + 1, xor(a, xor(d, b)), xor(b, xor(c, a)), xor(xor(c, a), b * 131072 % {whole}), {turned("xor(d, b)", 45)} FROM s, g WHERE j + 1 < {reps} * g),
p AS (SELECT j // g AS rep, (({turned(f"(a + d) % {whole}", 23)} + a) % {whole} % g::UHUGEINT)::BIGINT AS i FROM s, g),
t AS (SELECT rep, sum(n) AS n, sum(sx) AS sx, sum(sxx) AS sxx, sum(sy) AS sy, sum(sxy) AS sxy FROM p JOIN u USING (i) GROUP BY rep),
e AS (SELECT (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b1, (sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n AS b0 FROM t)
SELECT '_cons' AS term, round(stddev_samp(b0), 8) AS se, round(quantile_cont(b0, 0.025), 8) AS low, round(quantile_cont(b0, 0.975), 8) AS high FROM e UNION ALL SELECT 'q', round(stddev_samp(b1), 8), round(quantile_cont(b1, 0.025), 8), round(quantile_cont(b1, 0.975), 8) FROM e"""


@query(_replay(40, 2024))
def bootstrap_replay_clusters(spark, sf):
    """Suppliers in ascending order as clusters."""
    df = rows.sort(_made(spark, sf), "l_suppkey")
    fit = other.bootstrap(df, "y", "q", reps=40, seed=2024, cluster="l_suppkey", replay=True)
    out = [(n, float(s), *map(float, p)) for n, s, p in zip(fit.names, fit.se, fit.info["percentiles"].T, strict=True)]
    return rounded(spark.createDataFrame(out, "term string, se double, low double, high double"), 8)


@query()
def bootstrap_counts(spark, sf):
    """A Poisson model with suppliers as clusters and a logit of lines, each replicate's steps in shared passes."""
    df = _made(spark, sf).withColumns({"back": F.expr("l_linenumber + cast(l_returnflag = 'R' AS int)"), "late": F.expr("cast(l_linestatus = 'O' AS int)")})
    fits = {"poisson": resampling.bootstrap_poisson(df, "back", "q", "t", reps=40, seed=5, cluster="l_suppkey"), "logit": resampling.bootstrap_logit(df, "late", "q", reps=40, seed=5)}
    out = [(kind, n, float(b), float(s)) for kind, fit in fits.items() for n, b, s in zip(fit.names, fit.beta, fit.se, strict=True)]
    return rounded(spark.createDataFrame(out, "kind string, term string, estimate double, se double"), 5)


# --- random effects and moments -----------------------------------------


def _gls(sums: str) -> str:
    """Least squares of y on c and x without a constant, from rows of ``sums``."""
    return f"(SELECT *, (scy * sxx - sxy * scx) / (scc * sxx - scx * scx) AS b0, (sxy * scc - scy * scx) / (scc * sxx - scx * scx) AS b1 FROM (SELECT count(*) AS n, sum(c * c) AS scc, sum(c * x) AS scx, sum(x * x) AS sxx, sum(c * y) AS scy, sum(x * y) AS sxy, sum(y * y) AS syy FROM {sums}))"


@query(f"""WITH f AS {_FIRST}, m AS (SELECT u, count(*) AS t, avg(x) AS mx, avg(y) AS my FROM f GROUP BY u),
w AS (SELECT (sum(yy) - sum(xy) * sum(xy) / sum(xx)) / (sum(t) - count(*) - 1) AS se2, sum(t) AS n, count(*) AS g FROM (SELECT u, count(*) AS t, regr_syy(y, x) AS yy, regr_sxy(y, x) AS xy, regr_sxx(y, x) AS xx FROM f GROUP BY u)),
b AS (SELECT sum(t) AS a0, sum(t * mx) AS a1, sum(t * mx * mx) AS a2, sum(t * t) AS q0, sum(t * t * mx) AS q1, sum(t * t * mx * mx) AS q2, sum(t * my) AS c0, sum(t * mx * my) AS c1, sum(t * my * my) AS c2 FROM m),
v AS (SELECT se2, n, greatest(0, (c2 - (c0 * c0 * a2 - 2 * c0 * c1 * a1 + c1 * c1 * a0) / (a0 * a2 - a1 * a1) - (g - 2) * se2) / (n - (a2 * q0 - 2 * a1 * q1 + a0 * q2) / (a0 * a2 - a1 * a1))) AS su2 FROM w, b),
h AS (SELECT u, mx, my, 1 - sqrt(se2 / (se2 + t * su2)) AS th FROM m, v), r AS (SELECT 1 - th AS c, x - th * mx AS x, y - th * my AS y FROM f JOIN h USING (u)),
z AS (SELECT *, (syy - b0 * scy - b1 * sxy) / (n - 2) AS s2, scc * sxx - scx * scx AS det FROM {_gls("r")})
SELECT '_cons' AS term, round(b0, 5) AS estimate, round(sqrt(s2 * sxx / det), 6) AS se FROM z UNION ALL SELECT 'x', round(b1, 5), round(sqrt(s2 * scc / det), 6) FROM z""")
def panel_re_unbalanced(spark, sf):
    """Every event of every user, with standard errors."""
    return rounded(panel.xtreg_re(_panel(spark, sf, False), "y", "x", unit="u").table(spark).select("term", "estimate", "se"), 5, se=6)


_MOMENTS = "SELECT l_suppkey AS g, (5 * (l_quantity + l_tax * 50) + (l_partkey % 11) - 5)::DOUBLE AS y, (l_quantity + l_tax * 50 + 20 * l_discount)::DOUBLE AS x, l_quantity::DOUBLE AS z, l_tax::DOUBLE * 100 AS w FROM lineitem"


def _spread(beta: str, out: str) -> str:
    """Clustered moments at an estimate, and their inverse's parts."""
    return f"SELECT sum(p * p) AS {out}11, sum(p * q) AS {out}12, sum(q * q) AS {out}22 FROM (SELECT g, sum(z * (y - b * x)) AS p, sum(w * (y - b * x)) AS q FROM d, (SELECT {beta} AS b FROM last) GROUP BY g)"


@query(f"""WITH d AS ({_MOMENTS}), a AS (SELECT sum(z * x) AS a1, sum(w * x) AS a2, sum(z * y) AS c1, sum(w * y) AS c2, sum(z * z) AS m11, sum(z * w) AS m12, sum(w * w) AS m22 FROM d),
one AS (SELECT ((m22 * a1 - m12 * a2) * c1 + (m11 * a2 - m12 * a1) * c2) / ((m22 * a1 - m12 * a2) * a1 + (m11 * a2 - m12 * a1) * a2) AS b1 FROM a),
s AS ({_spread("b1", "s").replace("FROM last", "FROM one")}),
k AS (SELECT *, (s22 * a1 - s12 * a2) / (s11 * s22 - s12 * s12) AS h1, (s11 * a2 - s12 * a1) / (s11 * s22 - s12 * s12) AS h2 FROM a, s),
two AS (SELECT *, (h1 * c1 + h2 * c2) / (h1 * a1 + h2 * a2) AS b2 FROM k), t AS ({_spread("b2", "t").replace("FROM last", "FROM two")}),
r AS (SELECT *, sqrt(h1 * h1 * t11 + 2 * h1 * h2 * t12 + h2 * h2 * t22) / abs(h1 * a1 + h2 * a2) AS se, c1 - a1 * b2 AS e1, c2 - a2 * b2 AS e2 FROM two, t)
SELECT 'x' AS term, round(b2, 6) AS estimate, round(se, 6) AS se FROM r UNION ALL SELECT 'j', round((s22 * e1 * e1 - 2 * s12 * e1 * e2 + s11 * e2 * e2) / (s11 * s22 - s12 * s12), 4), NULL FROM r""")
def gmm_two_steps(spark, sf):
    """Clustered two-step moments with a surplus instrument, and the test of it."""
    df = load(spark, sf, "lineitem").selectExpr("l_suppkey AS g", "cast(5 * (l_quantity + l_tax * 50) + (l_partkey % 11) - 5 AS double) AS y", "cast(l_quantity + l_tax * 50 + 20 * l_discount AS double) AS x", "cast(l_quantity AS double) AS z", "cast(l_tax AS double) * 100 AS w", tables.ROW)
    fit = iv.gmm(df, "y", ["x"], ["z", "w"], "g")
    return spark.createDataFrame([("x", round(float(fit.beta[0]), 6), round(float(fit.se[0]), 6)), ("j", round(float(fit.stats["j"]), 4), None)], "term string, estimate double, se double")
