"""Registered queries over the driver's tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import safe
from .operators import grouped, iv, likelihood, linear, other, panel, predictions, rows, smoothing, summaries, survival
from .sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.use(spark, f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, **more: int) -> DataFrame:
    return df.select(*[F.round(c, more.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    return rounded(df.drop(tables.ROW), digits)


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with missing and non-finite values put in, and a constructed outcome."""
    df = load(spark, sf_dir, "lineitem")
    return df.withColumns({
        "price": F.expr("CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 4 THEN double('NaN') WHEN l_linenumber = 5 AND l_suppkey % 2 = 0 THEN double('inf') ELSE l_extendedprice END"),
        "flag": F.expr("CASE WHEN l_linenumber = 2 THEN NULL ELSE l_returnflag END"),
        "y": F.expr("3 + 2 * l_quantity + l_tax * 100 + (l_partkey % 7)"),
    })


LINE = """(SELECT *, CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 4 THEN 'NaN'::DOUBLE WHEN l_linenumber = 5 AND l_suppkey % 2 = 0 THEN 'Infinity'::DOUBLE ELSE l_extendedprice END AS price,
  CASE WHEN l_linenumber = 2 THEN NULL ELSE l_returnflag END AS flag, (3 + 2 * l_quantity + l_tax * 100 + (l_partkey % 7))::DOUBLE AS y FROM lineitem)"""


# --- rows ---------------------------------------------------------------


@query(f"SELECT l_returnflag, count(*) AS n FROM {LINE} WHERE price > 30000 GROUP BY 1")
def filter_keep_if(spark, sf):
    return summaries.by_count(rows.keep_if(line(spark, sf), "price > 30000"), "l_returnflag")


@query(f"SELECT l_returnflag, count(*) AS n FROM {LINE} WHERE NOT coalesce(price > 30000, false) GROUP BY 1")
def filter_drop_if(spark, sf):
    return summaries.by_count(rows.drop_if(line(spark, sf), "price > 30000"), "l_returnflag")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount = 0 THEN NULL ELSE round(l_extendedprice * (1 - l_discount) / l_discount, 4) END AS net FROM lineitem WHERE l_partkey % 10 < 5")
def generate_arith(spark, sf):
    df = rows.keep_if(load(spark, sf, "lineitem"), "l_partkey % 10 < 5")
    out = rows.generate(df, "net", "try_divide(l_extendedprice * (1 - l_discount), l_discount)")
    return shown(rows.keep(out, "l_orderkey", "l_linenumber", "l_partkey", "net"), 4)


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount = 0 THEN NULL ELSE round(l_extendedprice * (1 - l_discount) / l_discount, 4) END AS net FROM lineitem")
def generate_arith_whole(spark, sf):
    out = rows.generate(load(spark, sf, "lineitem"), "net", "try_divide(l_extendedprice * (1 - l_discount), l_discount)")
    return shown(rows.keep(out, "l_orderkey", "l_linenumber", "l_partkey", "net"), 4)


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_retailprice * 2 ELSE p_retailprice END::DOUBLE AS p_retailprice FROM part")
def replace_if(spark, sf):
    return shown(rows.keep(rows.replace(load(spark, sf, "part"), "p_retailprice", "p_retailprice * 2", "p_size > 25"), "p_partkey", "p_retailprice"))


@query("SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'small' WHEN p_size BETWEEN 11 AND 30 THEN 'middle' WHEN p_size = 31 THEN 'odd' ELSE 'large' END AS band FROM part")
def recode_ranges(spark, sf):
    rules = [((None, 10), "small"), ((11, 30), "middle"), (31, "odd"), ("else", "large")]
    return shown(rows.keep(rows.recode(load(spark, sf, "part"), "p_size", rules, "band"), "p_partkey", "band"))


@query("SELECT c_nationkey AS nation, c_custkey FROM customer")
def rename_keep_drop(spark, sf):
    df = rows.rename(load(spark, sf, "customer"), "c_nationkey", "nation")
    return shown(rows.keep(rows.drop(df, "c_name"), "nation", "c_custkey"))


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice, o_orderkey LIMIT 50")
def sort_head(spark, sf):
    return shown(rows.head(rows.sort(rows.keep(load(spark, sf, "orders"), "o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderpriority", "o_totalprice", "o_orderkey"), 50))


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority ASC, o_totalprice DESC, o_orderkey LIMIT 40")
def gsort_tail(spark, sf):
    df = rows.keep(load(spark, sf, "orders"), "o_orderkey", "o_orderpriority", "o_totalprice")
    return shown(rows.tail(rows.gsort(df, "-o_orderpriority", "o_totalprice", "-o_orderkey"), 40))


@query("SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) AS code FROM customer")
def encode_segment(spark, sf):
    df, _ = rows.encode(load(spark, sf, "customer"), "c_mktsegment", "code")
    return shown(rows.keep(df, "c_custkey", "code"))


@query("SELECT c_custkey, c_mktsegment AS back FROM customer")
def decode_roundtrip(spark, sf):
    df, labels = rows.encode(load(spark, sf, "customer"), "c_mktsegment", "code")
    return shown(rows.keep(rows.decode(df, "code", labels, "back"), "c_custkey", "back"))


@query("SELECT o_orderkey, o_custkey, c_mktsegment, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, sf):
    right = rows.rename(load(spark, sf, "customer"), "c_custkey", "o_custkey")
    return shown(rows.keep(rows.join_tables(load(spark, sf, "orders"), right, ["o_custkey"]), "o_orderkey", "o_custkey", "c_mktsegment", "c_acctbal"))


@query("SELECT c_custkey, s_acctbal, n FROM (SELECT c_custkey, c_nationkey AS n FROM customer) LEFT JOIN (SELECT s_nationkey, s_acctbal FROM supplier WHERE s_nationkey < 12) ON n = s_nationkey")
def join_left(spark, sf):
    left = rows.rename(load(spark, sf, "customer"), "c_nationkey", "n")
    right = rows.rename(rows.keep_if(load(spark, sf, "supplier"), "s_nationkey < 12"), "s_nationkey", "n")
    return shown(rows.keep(rows.join_tables(left, right, ["n"], "left"), "c_custkey", "s_acctbal", "n"))


@query("SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def append_rows(spark, sf):
    df = load(spark, sf, "orders")
    keep = lambda x: rows.keep(x, "o_orderkey", "o_totalprice")
    return shown(rows.append(keep(df), keep(rows.keep_if(df, "o_orderstatus = 'F'"))))


@query("SELECT event_id, j, CASE j WHEN 'a' THEN value ELSE value * 2 END AS v FROM events CROSS JOIN (VALUES ('a'), ('b')) AS t(j)")
def reshape_long(spark, sf):
    df = load(spark, sf, "events").select("event_id", F.col("value").alias("v_a"), (F.col("value") * 2).alias("v_b"), tables.ROW)
    return shown(rows.reshape_long(df, ["v"], ["event_id"], "j"))


@query("SELECT l_suppkey, max(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS l_quantity_A, max(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS l_quantity_N, max(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS l_quantity_R FROM lineitem GROUP BY 1")
def reshape_wide(spark, sf):
    return shown(rows.reshape_wide(load(spark, sf, "lineitem"), ["l_quantity"], ["l_suppkey"], "l_returnflag"))


# --- summaries ----------------------------------------------------------


def _finite(v: str) -> str:
    return f"SELECT '{v}' AS variable, {v}::DOUBLE AS x FROM {LINE} WHERE isfinite({v}::DOUBLE)"


_SUMMARY = "SELECT variable, count(x) AS n, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS sd, min(x) AS min, max(x) AS max"
_TWO = f"({_finite('price')} UNION ALL {_finite('l_quantity')})"


@query(f"{_SUMMARY} FROM {_TWO} GROUP BY 1")
def summarize_finite(spark, sf):
    return rounded(summaries.summarize(line(spark, sf), "price", "l_quantity"), 4)


@query(f"{_SUMMARY}, " + ", ".join(f"round(quantile_cont(x, {p}), 4) AS p{round(100 * p)}" for p in summaries.PERCENTILES) + f" FROM {_TWO} GROUP BY 1")
def summarize_detail(spark, sf):
    return rounded(summaries.summarize(line(spark, sf), "price", "l_quantity", detail=True), 4)


@query(f"{_SUMMARY} FROM ({_finite('price')} AND l_discount > 0.05) GROUP BY 1")
def summarize_if(spark, sf):
    return rounded(summaries.summarize(line(spark, sf), "price", predicate="l_discount > 0.05"), 4)


@query(f"SELECT count(*) AS n FROM {LINE} WHERE price > 20000")
def count_if(spark, sf):
    return summaries.count_if(line(spark, sf), "price > 20000")


@query(f"SELECT 'flag' AS variable, count(*) AS total, count(*) - count(flag) AS missing, count(flag) AS nonmissing, round(100.0 * (count(*) - count(flag)) / count(*), 6) AS percent FROM {LINE} UNION ALL SELECT 'price', count(*), count(*) - count(price), count(price), round(100.0 * (count(*) - count(price)) / count(*), 6) FROM {LINE}")
def missing(spark, sf):
    return rounded(summaries.missing(line(spark, sf), "flag", "price"))


@query(f"SELECT 'flag' AS variable, count(flag) AS nonmissing, count(*) - count(flag) AS missing, count(DISTINCT flag) AS \"distinct\" FROM {LINE} UNION ALL SELECT 'l_suppkey', count(l_suppkey), 0, count(DISTINCT l_suppkey) FROM {LINE}")
def codebook(spark, sf):
    return summaries.codebook(line(spark, sf), "flag", "l_suppkey").select("variable", "nonmissing", "missing", "distinct")


@query("WITH g AS (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT sum(c)::BIGINT AS total, count(*) AS distinct_groups, count(*) FILTER (c > 1) AS duplicate_groups, (sum(c) FILTER (c > 1))::BIGINT AS duplicate_rows, sum(c - 1)::BIGINT AS surplus_rows, max(c) AS max_copies FROM g")
def duplicates(spark, sf):
    return summaries.duplicates(load(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT count(*) FILTER (c > 1) AS repeated_keys, 0::BIGINT AS missing_rows, count(*) FILTER (c > 1) = 0 AS \"unique\" FROM (SELECT count(*) AS c FROM orders GROUP BY o_orderkey)")
def isid(spark, sf):
    return summaries.isid(load(spark, sf, "orders"), "o_orderkey")


@query(f"SELECT count(*) AS checked, count(*) FILTER (NOT coalesce(price >= 1000, false)) AS failed FROM {LINE}")
def assert_rows(spark, sf):
    return summaries.assert_rows(line(spark, sf), "price >= 1000")


@query(f"SELECT flag, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM {LINE} WHERE flag IS NOT NULL GROUP BY 1")
def tabulate_oneway(spark, sf):
    return rounded(summaries.tabulate(line(spark, sf), "flag"))


@query(f"SELECT flag, l_linestatus, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY flag), 6) AS row_percent, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY l_linestatus), 6) AS column_percent FROM {LINE} GROUP BY 1, 2")
def tabulate_twoway(spark, sf):
    return rounded(summaries.tabulate(line(spark, sf), "flag", "l_linestatus", missing=True))


@query(f"SELECT flag, count(*) AS n FROM {LINE} GROUP BY 1")
def by_count(spark, sf):
    return summaries.by_count(line(spark, sf), "flag")


@query(f"SELECT flag, round(avg(l_quantity), 6) AS mean_l_quantity, round(avg(y), 6) AS mean_y FROM {LINE} GROUP BY 1")
def by_means(spark, sf):
    return rounded(summaries.by_means(line(spark, sf), ["flag"], "l_quantity", "y"))


def _collapse(stat: str, sql: str):
    def f(spark, sf):
        out = summaries.collapse(line(spark, sf), stat, ["l_quantity", "l_partkey"], ["l_returnflag", "l_linestatus"]).drop(tables.ROW)
        return rounded(out.withColumns({c: F.col(c).cast("bigint") for c, t in out.dtypes if t.startswith("decimal")}))

    f.__name__ = f"collapse_{stat}"
    query(f"SELECT l_returnflag, l_linestatus, {sql.format('l_quantity')} AS {stat}_l_quantity, {sql.format('l_partkey')} AS {stat}_l_partkey FROM lineitem GROUP BY 1, 2")(f)


for _stat, _sql in (("count", "count({0})"), ("mean", "round(avg({0}), 6)"), ("min", "min({0})"), ("max", "max({0})")):
    _collapse(_stat, _sql)


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_l_quantity, sum(l_partkey)::BIGINT AS sum_l_partkey FROM lineitem GROUP BY 1, 2")
def collapse_sum(spark, sf):
    out = summaries.collapse(load(spark, sf, "lineitem"), "sum", ["l_quantity", "l_partkey"], ["l_returnflag", "l_linestatus"]).drop(tables.ROW)
    return rounded(out.withColumn("sum_l_partkey", F.col("sum_l_partkey").cast("bigint")), 2)


@query()
def datasignature(spark, sf):
    return summaries.datasignature(load(spark, sf, "lineitem"))


# --- SQL ----------------------------------------------------------------

_LAG = "SELECT user_id, event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS gap FROM {0}"


@query(_LAG.format("events"))
def sql_window_lag(spark, sf):
    return safe.sql(load(spark, sf, "events"), _LAG.format("active"))


_FILTER = "SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, round(avg(value) FILTER (WHERE value <= 50), 6) AS low FROM {0} GROUP BY event_type HAVING count(*) > 10"


@query(_FILTER.format("events"))
def sql_filter_agg(spark, sf):
    return safe.sql(load(spark, sf, "events"), _FILTER.format("active"))


_ROLLUP = "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {0} GROUP BY ROLLUP (l_returnflag, l_linestatus)"


@query(_ROLLUP.format("lineitem"))
def sql_rollup(spark, sf):
    return safe.sql(load(spark, sf, "lineitem"), _ROLLUP.format("active"))


_SETS = "SELECT user_id FROM {0} WHERE value > 90 INTERSECT SELECT user_id FROM {0} WHERE value < 10 EXCEPT SELECT user_id FROM {0} WHERE event_type = 'zzz'"


@query(_SETS.format("events"))
def sql_set_ops(spark, sf):
    return safe.sql(load(spark, sf, "events"), _SETS.format("active"))


@query("SELECT o_orderpriority, count(*) AS n, round(quantile_cont(o_totalprice, 0.5), 4) AS median FROM orders o WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 0) GROUP BY 1")
def sql_semi_join(spark, sf):
    text = "SELECT o_orderpriority, count(*) AS n, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice), 4) AS median FROM active o WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 0) GROUP BY 1"
    return safe.sql(load(spark, sf, "orders"), text, customer=load(spark, sf, "customer"))


# --- linear -------------------------------------------------------------


def coefficients(spark, fit, digits: int = 6) -> DataFrame:
    return rounded(fit.table(spark).select("term", "estimate", "se"), digits)


_OLS = f"WITH d AS (SELECT y, price AS x, l_suppkey AS g, l_quantity AS q FROM {LINE} WHERE isfinite(price)), m AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_slope(y, x) AS b FROM d), e AS (SELECT d.*, m.*, x - mx AS c, y - my - b * (x - mx) AS e FROM d, m)"


def _ols_oracle(kind: str) -> str:
    a = "(1.0 / n - c * mx / sxx)"
    if kind == "plain":
        s = "sum(e * e) / (any_value(n) - 2)"
        cons, slope = f"{s} * (1.0 / any_value(n) + any_value(mx * mx / sxx))", f"{s} / any_value(sxx)"
        source = ""
    elif kind == "hc1":
        s = "any_value(n) / (any_value(n) - 2.0)"
        cons, slope, source = f"{s} * sum(e * e * {a} * {a})", f"{s} * sum(e * e * c * c / sxx / sxx)", ""
    else:
        s = "count(*) / (count(*) - 1.0) * (any_value(n) - 1.0) / (any_value(n) - 2.0)"
        cons, slope = f"{s} * sum(ua * ua)", f"{s} * sum(ub * ub)"
        source = f", k AS (SELECT g, any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my, any_value(b) AS b, sum(e * {a}) AS ua, sum(e * c / sxx) AS ub FROM e GROUP BY g)"
    t = "k" if kind == "cluster" else "e"
    return _OLS + source + f" SELECT '_cons' AS term, round(any_value(my - b * mx), 5) AS estimate, round(sqrt({cons}), 5) AS se FROM {t} UNION ALL SELECT 'price', round(any_value(b) * 1000, 5), round(sqrt({slope}) * 1000, 5) FROM {t}"


def _simple(spark, sf, **options) -> DataFrame:
    fit = linear.regress(line(spark, sf), "y", "price", **options)
    scaled = fit.table(spark).select("term", *[F.when(F.col("term") == "price", F.col(c) * 1000).otherwise(F.col(c)).alias(c) for c in ("estimate", "se")])
    return rounded(scaled, 5)


@query(_ols_oracle("plain"))
def ols_simple(spark, sf):
    return _simple(spark, sf)


@query(_ols_oracle("hc1"))
def ols_hc1(spark, sf):
    return _simple(spark, sf, robust=True)


@query(_ols_oracle("cluster"))
def ols_cluster(spark, sf):
    return _simple(spark, sf, cluster="l_suppkey")


@query("""WITH m AS (SELECT covar_pop(y, x1) AS a, covar_pop(y, x2) AS b, var_pop(x1) AS p, var_pop(x2) AS r, covar_pop(x1, x2) AS c, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, corr(x1, x2) AS rho FROM
  (SELECT 3 + 2 * l_quantity + l_tax * 100 + (l_partkey % 7) AS y, l_quantity AS x1, l_discount AS x2 FROM lineitem)),
s AS (SELECT *, (a * r - b * c) / (p * r - c * c) AS b1, (b * p - a * c) / (p * r - c * c) AS b2 FROM m)
SELECT '_cons' AS term, round(my - b1 * m1 - b2 * m2, 6) AS estimate, NULL::DOUBLE AS vif FROM s UNION ALL SELECT 'l_quantity', round(b1, 6), round(1 / (1 - rho * rho), 6) FROM s UNION ALL SELECT 'l_discount', round(b2, 6), round(1 / (1 - rho * rho), 6) FROM s""")
def ols_two_vif(spark, sf):
    fit = linear.regress(line(spark, sf), "y", "l_quantity", "l_discount")
    vif = linear.vif(fit)
    return rounded(spark.createDataFrame([(n, float(b), vif.get(n)) for n, b in zip(fit.names, fit.beta, strict=True)], "term string, estimate double, vif double"))


@query("WITH d AS (SELECT 3 + 2 * l_quantity + l_tax * 100 + (l_partkey % 7) AS y, l_extendedprice / 1000 AS x, l_quantity AS w FROM lineitem), m AS (SELECT sum(w) AS w, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM d), s AS (SELECT sum(w_ * (x - mx) * (y - my)) / sum(w_ * (x - mx) * (x - mx)) AS b, any_value(mx) AS mx, any_value(my) AS my FROM (SELECT x, y, d.w AS w_, mx, my FROM d, m)) SELECT '_cons' AS term, round(my - b * mx, 6) AS estimate FROM s UNION ALL SELECT 'x', round(b, 6) FROM s")
def wls(spark, sf):
    df = line(spark, sf).withColumn("x", F.col("l_extendedprice") / 1000)
    return coefficients(spark, linear.regress(df, "y", "x", wls="l_quantity")).select("term", "estimate")


@query("WITH m AS (SELECT l_returnflag AS f, avg(3 + 2 * l_quantity + l_tax * 100 + (l_partkey % 7)) AS m FROM lineitem GROUP BY 1) SELECT CASE WHEN f = 'A' THEN '_cons' ELSE 'l_returnflag_' || f END AS term, round(CASE WHEN f = 'A' THEN m ELSE m - (SELECT m FROM m WHERE f = 'A') END, 6) AS estimate FROM m")
def ols_factor(spark, sf):
    return coefficients(spark, linear.regress(line(spark, sf), "y", "i.l_returnflag")).select("term", "estimate")


@query(f"WITH d AS (SELECT regr_slope(y, price / 1000) AS b, regr_intercept(y, price / 1000) AS a FROM {LINE} WHERE isfinite(price)) SELECT count(*) AS n, round(avg(y - a - b * price / 1000), 5) + 0.0 AS mean_residual, round(sum(a + b * price / 1000) / 1000, 4) AS total_fit FROM {LINE}, d WHERE isfinite(price)")
def ols_predict(spark, sf):
    df = line(spark, sf)
    fit = linear.regress(df, "y", "price")
    out = linear.predicted(fit, linear.predicted(fit, df, "xb"), "res", "residuals").where(safe.finite(F.col("price")))
    r = out.agg(F.count("*").alias("n"), F.avg("res").alias("mean_residual"), (F.sum("xb") / 1000).alias("total_fit"))
    return r.select("n", (F.round("mean_residual", 5) + 0.0).alias("mean_residual"), F.round("total_fit", 4).alias("total_fit"))


@query("WITH d AS (SELECT 3 + 2 * l_quantity + l_tax * 100 + (l_partkey % 7) AS y, l_quantity AS x FROM lineitem), m AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n, regr_sxx(y, x) AS sxx, regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x) AS rss, avg(x) AS mx FROM d) SELECT round(a + 10 * b, 6) AS estimate, round(sqrt(rss / (n - 2) * (1.0 / n + (10 - mx) * (10 - mx) / sxx)), 8) AS se, round((b - 2) * (b - 2) * sxx / (rss / (n - 2)), 6) AS f FROM m")
def lincom_wald(spark, sf):
    fit = linear.regress(line(spark, sf), "y", "l_quantity")
    one, two = linear.lincom(fit, {"_cons": 1, "l_quantity": 10}), linear.wald(fit, [({"l_quantity": 1}, 2.0)])
    return rounded(spark.createDataFrame([(one["estimate"], one["se"], float(two["f"]))], "estimate double, se double, f double"), se=8)


_ROW = "difference double, se double, t double, df double"


def _tests(spark, r: dict) -> DataFrame:
    return rounded(spark.createDataFrame([tuple(float(r[k]) for k in ("difference", "se", "t", "df"))], _ROW))


@query("SELECT round(avg(x) - 4500, 6) AS difference, round(stddev_samp(x) / sqrt(count(*)), 6) AS se, round((avg(x) - 4500) / (stddev_samp(x) / sqrt(count(*))), 6) AS t, (count(*) - 1)::DOUBLE AS df FROM (SELECT c_acctbal AS x FROM customer)")
def ttest_one(spark, sf):
    return _tests(spark, linear.ttest(load(spark, sf, "customer"), "c_acctbal", 4500))


@query("SELECT round(avg(x), 6) AS difference, round(stddev_samp(x) / sqrt(count(*)), 6) AS se, round(avg(x) / (stddev_samp(x) / sqrt(count(*))), 6) AS t, (count(*) - 1)::DOUBLE AS df FROM (SELECT l_quantity - l_tax * 600 AS x FROM lineitem)")
def ttest_paired(spark, sf):
    df = load(spark, sf, "lineitem").withColumn("other", F.col("l_tax") * 600)
    return _tests(spark, linear.ttest(df, "l_quantity", other="other"))


_TWO_GROUPS = "WITH g AS (SELECT o_orderstatus AS k, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1), t AS (SELECT a.m - b.m AS d, a.n AS na, b.n AS nb, a.v AS va, b.v AS vb FROM g a, g b WHERE a.k = 'F' AND b.k = 'O')"


@query(_TWO_GROUPS + ", s AS (SELECT d, sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0 / na + 1.0 / nb)) AS se, (na + nb - 2)::DOUBLE AS df FROM t) SELECT round(d, 6) AS difference, round(se, 6) AS se, round(d / se, 6) AS t, df FROM s")
def ttest_pooled(spark, sf):
    return _tests(spark, linear.ttest(load(spark, sf, "orders"), "o_totalprice", by="o_orderstatus", predicate="o_orderstatus IN ('F', 'O')"))


@query(_TWO_GROUPS + ", s AS (SELECT d, sqrt(va / na + vb / nb) AS se, (va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)) AS df FROM t) SELECT round(d, 6) AS difference, round(se, 6) AS se, round(d / se, 6) AS t, round(df, 6) AS df FROM s")
def ttest_welch(spark, sf):
    return _tests(spark, linear.ttest(load(spark, sf, "orders"), "o_totalprice", by="o_orderstatus", welch=True, predicate="o_orderstatus IN ('F', 'O')"))


# --- instruments --------------------------------------------------------

_IV = "(SELECT 5 + 2 * (l_quantity + l_tax * 50) + 30 * l_discount + (l_partkey % 11) AS y, l_quantity + l_tax * 50 + 20 * l_discount AS x, l_quantity AS z, l_tax AS z2, l_discount AS w FROM lineitem)"


def _iv_data(spark, sf) -> DataFrame:
    df = load(spark, sf, "lineitem")
    return df.select(F.expr("5 + 2 * (l_quantity + l_tax * 50) + 30 * l_discount + (l_partkey % 11) AS y"), F.expr("l_quantity + l_tax * 50 + 20 * l_discount AS x"), F.col("l_quantity").alias("z"), F.col("l_tax").alias("z2"), F.col("l_suppkey").alias("g"), tables.ROW)


@query(f"WITH m AS (SELECT count(*) AS n, covar_pop(z, y) / covar_pop(z, x) AS b, avg(y) AS my, avg(x) AS mx, regr_r2(x, z) AS r2 FROM {_IV}) SELECT '_cons' AS term, round(my - b * mx, 6) AS estimate, NULL::DOUBLE AS first_f FROM m UNION ALL SELECT 'x', round(b, 6), round(r2 / (1 - r2) * (n - 2), 3) FROM m")
def iv_2sls(spark, sf):
    fit = iv.ivregress(_iv_data(spark, sf), "y", endog=["x"], iv=["z"])
    f = iv.first_stage(fit)[0]["f"]
    return rounded(spark.createDataFrame([("_cons", fit["_cons"], None), ("x", fit["x"], float(f))], "term string, estimate double, first_f double"), first_f=3)


@query(f"WITH d AS (SELECT y - 2 * x AS u, z FROM {_IV}), m AS (SELECT regr_r2(u, z) AS r2, count(*) AS n FROM d) SELECT round(r2 / (1 - r2) * (n - 2), 4) AS f, 1::BIGINT AS df1, n - 2 AS df2 FROM m")
def iv_ar_test(spark, sf):
    r = iv.anderson_rubin(iv.ivregress(_iv_data(spark, sf), "y", endog=["x"], iv=["z"]), [2.0])
    return rounded(spark.createDataFrame([(float(r["f"]), r["df1"], r["df2"])], "f double, df1 bigint, df2 bigint"), 4)


@query()
def iv_overid(spark, sf):
    fit = iv.ivregress(_iv_data(spark, sf), "y", endog=["x"], iv=["z", "z2"])
    tests = [("sargan", iv.overid(fit)), ("wu_hausman", iv.endogeneity(fit))]
    out = [(n, float(r.get("chi2", r.get("f"))), float(r["p"])) for n, r in tests]
    s = iv.anderson_rubin_set(fit)
    return spark.createDataFrame([*out, ("ar_low", float(s["low"]), None), ("ar_high", float(s["high"]), None)], "test string, statistic double, p double")


@query()
def iv_gmm_cluster(spark, sf):
    return iv.gmm(_iv_data(spark, sf), "y", ["x"], ["z", "z2"], "g").table(spark)


# --- panels -------------------------------------------------------------

_FIRST = "(SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, value AS x, 2 * value + (user_id % 5) * 3 + (event_id % 13) AS y FROM events)"
_BAL = f"(SELECT * FROM {_FIRST} WHERE t <= 20 AND u IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 20))"


def _panel(spark, sf, balanced: bool = True) -> DataFrame:
    df = load(spark, sf, "events")
    text = "SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, value AS x, CAST(2 * value + (user_id % 5) * 3 + (event_id % 13) AS DOUBLE) AS y, count(*) OVER (PARTITION BY user_id) AS c FROM active"
    out = safe.sql(df, text)
    return tables.numbered(out.where("t <= 20 AND c >= 20") if balanced else out)


_WITHIN = f"(SELECT u, t, x - avg(x) OVER (PARTITION BY u) AS x, y - avg(y) OVER (PARTITION BY u) AS y FROM {_BAL})"


@query(f"WITH w AS (SELECT regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x) AS rss, count(*) AS n, count(DISTINCT u) AS g FROM {_WITHIN}), m AS (SELECT avg(y) AS my, avg(x) AS mx FROM {_BAL}) SELECT '_cons' AS term, round(my - b * mx, 6) AS estimate, round(sqrt(rss / (n - g - 1) / n + mx * mx * rss / (n - g - 1) / sxx), 7) AS se FROM w, m UNION ALL SELECT 'x', round(b, 6), round(sqrt(rss / (n - g - 1) / sxx), 7) FROM w")
def panel_fe(spark, sf):
    return rounded(panel.xtreg_fe(_panel(spark, sf), "y", "x", unit="u").table(spark).select("term", "estimate", "se"), se=7)


@query(f"WITH m AS (SELECT u, avg(x) AS x, avg(y) AS y FROM {_BAL} GROUP BY 1) SELECT '_cons' AS term, round(regr_intercept(y, x), 6) AS estimate FROM m UNION ALL SELECT 'x', round(regr_slope(y, x), 6) FROM m")
def panel_between(spark, sf):
    return coefficients(spark, panel.xtreg_be(_panel(spark, sf), "y", "x", unit="u")).select("term", "estimate")


@query(f"WITH d AS (SELECT x - lag(x) OVER w AS x, y - lag(y) OVER w AS y FROM {_BAL} WINDOW w AS (PARTITION BY u ORDER BY t)) SELECT 'x' AS term, round(sum(x * y) / sum(x * x), 6) AS estimate FROM d WHERE x IS NOT NULL")
def panel_fd(spark, sf):
    return coefficients(spark, panel.xtreg_fd(_panel(spark, sf), "y", "x", unit="u", time="t")).select("term", "estimate")


@query(f"""WITH w AS (SELECT (regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - count(DISTINCT u) - 1) AS se2 FROM {_WITHIN}),
g AS (SELECT u, avg(x) AS mx, avg(y) AS my, count(*) AS t FROM {_BAL} GROUP BY 1),
b AS (SELECT greatest(0, (regr_syy(my, mx) - regr_slope(my, mx) * regr_sxy(my, mx)) / (count(*) - 2) - any_value(se2) / any_value(t)) AS su2, any_value(se2) AS se2, any_value(t) AS t FROM g, w),
h AS (SELECT 1 - sqrt(se2 / (se2 + t * su2)) AS th FROM b),
q AS (SELECT (y - th * my) AS y, (x - th * mx) AS x, 1 - th AS c FROM {_BAL} JOIN g USING (u), h)
SELECT '_cons' AS term, round(regr_intercept(y, x) / any_value(c), 6) AS estimate FROM q UNION ALL SELECT 'x', round(regr_slope(y, x), 6) FROM q""")
def panel_re(spark, sf):
    return coefficients(spark, panel.xtreg_re(_panel(spark, sf), "y", "x", unit="u")).select("term", "estimate")


# Whole unbalanced panels: every event of every user.


_DEMEANED = f"(SELECT u, x - avg(x) OVER (PARTITION BY u) AS x, y - avg(y) OVER (PARTITION BY u) AS y FROM {_FIRST})"


@query(f"WITH w AS (SELECT regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x) AS rss, count(*) AS n, count(DISTINCT u) AS g FROM {_DEMEANED}), m AS (SELECT avg(y) AS my, avg(x) AS mx FROM {_FIRST}) SELECT '_cons' AS term, round(my - b * mx, 6) AS estimate, round(sqrt(rss / (n - g - 1) / n + mx * mx * rss / (n - g - 1) / sxx), 7) AS se, n FROM w, m UNION ALL SELECT 'x', round(b, 6), round(sqrt(rss / (n - g - 1) / sxx), 7), n FROM w")
def panel_fe_whole(spark, sf):
    fit = panel.xtreg_fe(_panel(spark, sf, False), "y", "x", unit="u")
    return rounded(fit.table(spark).select("term", "estimate", "se", F.lit(fit.n).cast("long").alias("n")), se=7)


@query(f"WITH m AS (SELECT u, avg(x) AS x, avg(y) AS y FROM {_FIRST} GROUP BY 1) SELECT '_cons' AS term, round(regr_intercept(y, x), 6) AS estimate FROM m UNION ALL SELECT 'x', round(regr_slope(y, x), 6) FROM m")
def panel_between_whole(spark, sf):
    return coefficients(spark, panel.xtreg_be(_panel(spark, sf, False), "y", "x", unit="u")).select("term", "estimate")


@query(f"WITH d AS (SELECT x - lag(x) OVER w AS x, y - lag(y) OVER w AS y FROM {_FIRST} WINDOW w AS (PARTITION BY u ORDER BY t)) SELECT 'x' AS term, round(sum(x * y) / sum(x * x), 6) AS estimate FROM d WHERE x IS NOT NULL")
def panel_fd_whole(spark, sf):
    return coefficients(spark, panel.xtreg_fd(_panel(spark, sf, False), "y", "x", unit="u", time="t")).select("term", "estimate")


@query()
def panel_re_whole(spark, sf):
    return coefficients(spark, panel.xtreg_re(_panel(spark, sf, False), "y", "x", unit="u")).select("term", "estimate")


@query()
def panel_ml_gee(spark, sf):
    df = _panel(spark, sf, False)
    ml, gee = panel.xtreg_ml(df, "y", "x", unit="u"), panel.xtgee(df, "y", "x", unit="u")
    return ml.table(spark).withColumn("model", F.lit("ml")).union(gee.table(spark).withColumn("model", F.lit("gee")))


# --- likelihoods --------------------------------------------------------


def _labelled(spark, sf) -> DataFrame:
    d, lab = load(spark, sf, "documents").select("doc_id", "n_chars", tables.ROW), load(spark, sf, "labels").drop(tables.ROW)
    return d.join(lab, "doc_id").withColumn("long", (F.col("n_chars") > 1500).cast("double")).withColumn("good", F.col("quality").cast("double"))


_CELLS = "(SELECT avg(quality) FILTER (n_chars > 1500) AS p1, avg(quality) FILTER (n_chars <= 1500) AS p0 FROM documents JOIN labels USING (doc_id))"


@query(f"SELECT '_cons' AS term, round(ln(p0 / (1 - p0)), 6) AS estimate FROM {_CELLS} UNION ALL SELECT 'long', round(ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)), 6) FROM {_CELLS}")
def logit_dummy(spark, sf):
    return coefficients(spark, likelihood.logit(_labelled(spark, sf), "good", "long")).select("term", "estimate")


@query(f"SELECT 0.0::DOUBLE AS long, round(p0, 6) AS pr FROM {_CELLS} UNION ALL SELECT 1.0::DOUBLE, round(p1, 6) FROM {_CELLS}")
def probit_dummy_pr(spark, sf):
    df = _labelled(spark, sf)
    return rounded(likelihood.response(likelihood.probit(df, "good", "long"), df, "pr").groupBy("long").agg(F.avg("pr").alias("pr")))


@query("WITH c AS (SELECT o_orderstatus AS s, count(*) FILTER (o_totalprice > 250000) AS n1, count(*) FILTER (o_totalprice <= 250000) AS n0 FROM orders GROUP BY 1), b AS (SELECT * FROM c WHERE s = 'F') SELECT c.s || ':_cons' AS term, round(ln(c.n0 / b.n0), 5) AS estimate FROM c, b WHERE c.s <> 'F' UNION ALL SELECT c.s || ':big', round(ln(c.n1 / b.n1) - ln(c.n0 / b.n0), 5) FROM c, b WHERE c.s <> 'F'")
def mlogit_dummy(spark, sf):
    df = load(spark, sf, "orders").withColumn("big", (F.col("o_totalprice") > 250000).cast("double"))
    return coefficients(spark, likelihood.mlogit(df, "o_orderstatus", "big"), 5).select("term", "estimate")


_MEANS = "(SELECT avg(l_linenumber) FILTER (l_returnflag = 'R') AS m1, avg(l_linenumber) FILTER (l_returnflag <> 'R') AS m0 FROM lineitem)"


def _returned(spark, sf) -> DataFrame:
    return load(spark, sf, "lineitem").withColumn("back", (F.col("l_returnflag") == "R").cast("double")).withColumn("k", F.col("l_linenumber").cast("double"))


@query(f"SELECT '_cons' AS term, round(ln(m0), 6) AS estimate FROM {_MEANS} UNION ALL SELECT 'back', round(ln(m1 / m0), 6) FROM {_MEANS}")
def poisson_dummy(spark, sf):
    return coefficients(spark, likelihood.poisson(_returned(spark, sf), "k", "back")).select("term", "estimate")


@query("SELECT '_cons' AS term, round(ln(sum(l_linenumber) / sum(l_quantity)), 6) AS estimate FROM lineitem")
def poisson_offset_rate(spark, sf):
    df = _returned(spark, sf).withColumn("exposure", F.log("l_quantity"))
    return coefficients(spark, likelihood.poisson(df, "k", offset="exposure")).select("term", "estimate")


_OVER = "(SELECT avg((event_id * 7) % 40) FILTER (value > 50) AS m1, avg((event_id * 7) % 40) FILTER (value <= 50) AS m0 FROM events)"


@query(f"SELECT '_cons' AS term, round(ln(m0), 5) AS estimate FROM {_OVER} UNION ALL SELECT 'high', round(ln(m1 / m0), 5) FROM {_OVER}")
def nbreg_dummy(spark, sf):
    df = load(spark, sf, "events").withColumn("k", F.expr("CAST((event_id * 7) % 40 AS DOUBLE)")).withColumn("high", (F.col("value") > 50).cast("double"))
    return coefficients(spark, likelihood.nbreg(df, "k", "high"), 5).select("term", "estimate").where("term != 'lnalpha'")


@query("WITH d AS (SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, 1 + event_id % 9 AS y FROM events), p AS (SELECT sum(y) FILTER (t = 1) AS a, sum(y) FILTER (t = 2) AS b FROM d WHERE t <= 2 AND u IN (SELECT u FROM d WHERE t = 2)) SELECT 'second' AS term, round(ln(b / a), 6) AS estimate FROM p")
def xtpoisson_fe_t2(spark, sf):
    text = "SELECT user_id AS u, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS t, CAST(1 + event_id % 9 AS DOUBLE) AS y, count(*) OVER (PARTITION BY user_id) AS c FROM active"
    df = tables.numbered(safe.sql(load(spark, sf, "events"), text).where("t <= 2 AND c >= 2")).withColumn("second", (F.col("t") == 2).cast("double"))
    return coefficients(spark, likelihood.xtpoisson_fe(df, "y", "second", group="u")).select("term", "estimate")


@query()
def xtpoisson_fe_whole(spark, sf):
    text = "SELECT user_id AS u, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 2 AS DOUBLE) AS second, CAST(1 + event_id % 9 AS DOUBLE) AS y, value / 100 AS x FROM active"
    df = tables.numbered(safe.sql(load(spark, sf, "events"), text))
    return coefficients(spark, likelihood.xtpoisson_fe(df, "y", "second", "x", group="u")).select("term", "estimate")


@query("SELECT '_cons' AS term, round(regr_intercept(y, x), 4) AS estimate FROM (SELECT l_quantity + 100 AS y, l_discount * 100 AS x FROM lineitem) UNION ALL SELECT 'x', round(regr_slope(y, x), 4) FROM (SELECT l_quantity + 100 AS y, l_discount * 100 AS x FROM lineitem)")
def tobit_uncensored(spark, sf):
    df = load(spark, sf, "lineitem").selectExpr("l_quantity + 100 AS y", "l_discount * 100 AS x", tables.ROW)
    return coefficients(spark, likelihood.tobit(df, "y", "x", lower=0.0), 4).select("term", "estimate").where("term != 'lnsigma'")


@query()
def limited_outcomes(spark, sf):
    df = load(spark, sf, "lineitem").selectExpr("greatest(l_quantity - 20 + l_discount * 50, 0.0) AS y", "l_discount * 100 AS x", "cast(l_tax > 0.03 as double) AS s", "l_tax * 100 AS z", tables.ROW)
    fits = {"tobit": likelihood.tobit(df, "y", "x"), "truncreg": likelihood.truncreg(df, "y", "x", predicate="y > 0"), "heckman": other.heckman(df.withColumn("s", F.expr("cast(y > 5 as double)")), "y", "x", selected="s", select=["x", "z"])}
    out = None
    for n, f in fits.items():
        t = f.table(spark).withColumn("model", F.lit(n))
        out = t if out is None else out.union(t)
    return out


@query()
def durations(spark, sf):
    df = load(spark, sf, "lineitem").selectExpr("l_quantity AS t", "cast(l_linestatus = 'F' as double) AS d", "l_discount * 10 AS x", tables.ROW)
    out = survival.stcox(df, "t", "x", failure="d").table(spark).withColumn("model", F.lit("cox"))
    for kind in ("weibull", "gompertz", "exponential"):
        out = out.union(likelihood.streg(df, "t", "x", failure="d", distribution=kind).table(spark).withColumn("model", F.lit(kind)))
    return out


@query("WITH r AS (SELECT l_quantity AS \"time\", count(*) AS n, (count(*) FILTER (l_linestatus = 'F'))::BIGINT AS failed FROM lineitem GROUP BY 1), k AS (SELECT *, sum(n) OVER (ORDER BY \"time\" DESC) AS at_risk FROM r) SELECT \"time\", at_risk::BIGINT AS at_risk, failed, round(CASE WHEN max((failed >= at_risk)::INT) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN failed < at_risk THEN ln(1 - failed / at_risk) ELSE 0 END) OVER w) END, 6) AS survival, round(sum(failed / at_risk) OVER w, 6) AS cumulative_hazard FROM k WINDOW w AS (ORDER BY \"time\")")
def km_curve(spark, sf):
    df = load(spark, sf, "lineitem").selectExpr("l_quantity AS t", "cast(l_linestatus = 'F' as double) AS d")
    return rounded(survival.survival_curve(df, "t", "d"))


@query("SELECT '_cons' AS term, quantile_disc(o_totalprice, 0.3003) AS estimate FROM orders")
def qreg_intercept(spark, sf):
    return coefficients(spark, other.qreg(load(spark, sf, "orders"), "o_totalprice", quantile=0.3003)).select("term", "estimate")


@query("SELECT 'a' AS term, round(regr_intercept(p_retailprice, p_size), 4) AS estimate FROM part UNION ALL SELECT 'b', round(regr_slope(p_retailprice, p_size), 4) FROM part")
def nl_linear(spark, sf):
    fit = other.nl(load(spark, sf, "part"), "p_retailprice", "{a} + {b} * p_size", {"a": 1.0, "b": 1.0}, ["p_size"])
    return coefficients(spark, fit, 4).select("term", "estimate")


@query()
def smooth_and_resample(spark, sf):
    df = load(spark, sf, "events")
    smooth = smoothing.lowess(df, "value", "event_id", "smooth", by="user_id").groupBy("user_id").agg(F.avg("smooth").alias("smooth"))
    fit = other.bootstrap(line(spark, sf), "y", "l_quantity", reps=100, seed=7, cluster="l_suppkey")
    return smooth.select(F.concat(F.lit("smooth:"), F.col("user_id").cast("string")).alias("what"), F.col("smooth").alias("value")).union(fit.table(spark).select(F.concat(F.lit("se:"), "term"), "se"))


@query("SELECT (o_totalprice > 250000)::INT::DOUBLE AS big, round(avg((o_orderstatus = 'F')::INT), 5) AS pr_f, round(avg((o_orderstatus = 'O')::INT), 5) AS pr_o FROM orders GROUP BY 1")
def mlogit_pr(spark, sf):
    df = load(spark, sf, "orders").withColumn("big", (F.col("o_totalprice") > 250000).cast("double"))
    out = likelihood.class_probabilities(likelihood.mlogit(df, "o_orderstatus", "big"), df)
    return rounded(out.groupBy("big").agg(F.avg("pr_F").alias("pr_f"), F.avg("pr_O").alias("pr_o")), 5)


@query("SELECT least(floor((l_quantity - 1) / 7), 6)::BIGINT AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 GROUP BY 1")
def histogram(spark, sf):
    return summaries.histogram(load(spark, sf, "lineitem"), "l_quantity", 1.0, 50.0, 7).select("bin", "n")


@query()
def estimates_table(spark, sf):
    df = line(spark, sf)
    return linear.compare(spark, {"plain": linear.regress(df, "y", "l_quantity"), "robust": linear.regress(df, "y", "l_quantity", "l_discount", robust=True)})


@query()
def panel_counts(spark, sf):
    text = "SELECT user_id AS u, CAST(event_id % 7 + user_id % 4 AS DOUBLE) AS y, value / 100 AS x FROM active"
    df = tables.numbered(safe.sql(load(spark, sf, "events"), text))
    fits = {"gamma": grouped.xtpoisson_re(df, "y", "x", group="u"), "normal": grouped.xtpoisson_re(df, "y", "x", group="u", distribution="normal"), "gee": grouped.xtgee_poisson(df, "y", "x", group="u"), "fixed": likelihood.xtpoisson_fe(df, "y", "x", group="u")}
    return linear.compare(spark, fits)


@query("WITH c AS (SELECT count(*) FILTER (l_linenumber = 1) AS a, count(*) AS n FROM lineitem WHERE l_linenumber <= 2) SELECT 'first' AS term, round(ln(a / (n - a)), 6) AS estimate FROM c")
def clogit_pairs(spark, sf):
    df = load(spark, sf, "lineitem").where("l_linenumber <= 2").select(F.col(tables.ROW).alias("s"), "l_linenumber", tables.ROW)
    both = df.select("s", tables.ROW, F.explode(F.array(F.lit(1), F.lit(2))).alias("alternative"), "l_linenumber")
    both = both.selectExpr("s", tables.ROW, "cast(alternative = 1 as double) AS first", "cast(alternative = l_linenumber as double) AS chosen")
    return coefficients(spark, likelihood.clogit(both, "chosen", "first", group="s")).select("term", "estimate")


@query("WITH c AS (SELECT count(*) FILTER (l_linenumber = 1) AS a, count(*) AS n, max(l_linenumber) AS k FROM lineitem) SELECT 'first' AS term, round(ln(a * (k - 1) / (n - a)), 6) AS estimate FROM c")
def clogit_lines(spark, sf):
    """Every line chooses its number among all line numbers."""
    df = load(spark, sf, "lineitem").select(F.col(tables.ROW).alias("s"), "l_linenumber", tables.ROW)
    most = int(df.agg(F.max("l_linenumber")).first()[0])
    long = df.select("s", tables.ROW, F.explode(F.sequence(F.lit(1), F.lit(most))).alias("alternative"), "l_linenumber")
    long = long.selectExpr("s", tables.ROW, "cast(alternative = 1 as double) AS first", "cast(alternative = l_linenumber as double) AS chosen")
    return coefficients(spark, likelihood.clogit(long, "chosen", "first", group="s")).select("term", "estimate")


@query()
def nested_choice(spark, sf):
    text = """WITH long AS (SELECT o_orderkey AS s, a, a % 3 + o_totalprice / 300000 * ((o_orderkey + a) % 5) AS price, -ln(-ln((pmod(xxhash64(o_orderkey, a), 998) + 1) / 1000D)) AS noise
      FROM active LATERAL VIEW explode(array(0, 1, 2, 3)) AS a)
      SELECT s, CAST(a < 2 AS INT) AS nest, CAST(a = 1 AS DOUBLE) AS one, price, CAST(row_number() OVER (PARTITION BY s ORDER BY noise - price DESC, a) = 1 AS DOUBLE) AS chosen FROM long"""
    long = tables.numbered(safe.sql(load(spark, sf, "orders"), text))
    return grouped.nlogit(long, "chosen", "one", "price", group="s", nest="nest").table(spark)


@query("""WITH long AS (SELECT o_orderkey AS s, a, ((o_custkey * (a + 3)) % 101) / 50.0 AS price FROM orders, (SELECT unnest(range(4)) AS a)),
  best AS (SELECT s, CASE WHEN s % 10 < 7 THEN arg_min(a, price * 10 + a / 1000.0) ELSE (s // 10) % 4 END AS a FROM long GROUP BY s)
  SELECT (a // 2)::BIGINT AS nest, round(count(*)::DOUBLE, 2) AS chosen FROM best GROUP BY 1""")
def nested_choice_each(spark, sf):
    """With a constant of its own, a nest's probabilities add up to its choices at the maximum."""
    text = """WITH long AS (SELECT o_orderkey AS s, a, (o_custkey * (a + 3)) % 101 / 50D AS price FROM active LATERAL VIEW explode(array(0, 1, 2, 3)) AS a),
      best AS (SELECT s AS s1, CASE WHEN s % 10 < 7 THEN min_by(a, price * 10 + a / 1000D) ELSE s DIV 10 % 4 END AS best FROM long GROUP BY s)
      SELECT s, CAST(a DIV 2 AS BIGINT) AS nest, price, CAST(a DIV 2 = 1 AS DOUBLE) AS second, CAST(a = best AS DOUBLE) AS chosen FROM long JOIN best ON s = s1"""
    long = tables.numbered(safe.sql(load(spark, sf, "orders"), text))
    fit = grouped.nlogit(long, "chosen", "price", group="s", nest="nest", form="nonnormalized", nest_terms=["second"])
    out = grouped.nested_probabilities(fit, long, "s", "nest", "pr")
    return rounded(out.groupBy("nest").agg(F.sum("pr").alias("chosen")), 2)


@query()
def predicted_outcomes(spark, sf):
    df = load(spark, sf, "lineitem").selectExpr("greatest(l_quantity - 20 + l_discount * 50, 0.0) AS y", "l_discount * 100 AS x", "l_quantity AS t", "cast(l_linestatus = 'F' as double) AS d", "cast(l_linenumber as double) AS k", tables.ROW)
    out = predictions.limited(likelihood.tobit(df, "y", "x"), df, "mean")
    out = predictions.duration(likelihood.streg(df, "t", "x", failure="d"), out, "survival")
    out = predictions.count_chance(likelihood.poisson(df, "k", "x"), out, "pr_2", 2)
    return out.groupBy("x").agg(F.avg("mean").alias("mean"), F.avg("survival").alias("survival"), F.avg("pr_2").alias("pr_2"))


@query()
def bootstrap_quantile(spark, sf):
    df = load(spark, sf, "part")
    fit = other.bootstrap_fit(df, lambda rows_, _: other.qreg(rows_, "p_retailprice", quantile=0.25), reps=3, seed=3)
    return fit.table(spark)


@query("SELECT rep, count(*) AS drawn FROM lineitem, (SELECT unnest(range(20)) AS rep) GROUP BY rep")
def bootstrap_fixed(spark, sf):
    fit = other.bootstrap(line(spark, sf), "y", "l_quantity", reps=20, seed=5, fixed=True)
    return spark.createDataFrame([(i, int(n)) for i, n in enumerate(fit.info["drawn"])], "rep long, drawn long")


# --- likelihoods with continuous regressors: the same estimates and standard errors by Newton steps in SQL ----------


def _phi(z: str) -> str:
    """The normal CDF as a series in DuckDB SQL."""
    k = f"(2 * k + 1) * ln(greatest(abs({z}), 1e-300)) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1)"
    return f"(0.5 + sign({z}) * exp(-0.5 * ({z}) * ({z})) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120), lambda k: exp({k}))))"


def _inverse(k: int) -> tuple[str, list[list[str]]]:
    """Determinant and cofactors of the symmetric matrix h00, h01, ... of up to three rows."""
    h = lambda i, j: f"h{min(i, j)}{max(i, j)}"
    if k == 1:
        return "h00", [["1.0"]]
    if k == 2:
        return "(h00 * h11 - h01 * h01)", [["h11", "-h01"], ["-h01", "h00"]]
    minor = lambda i, j: "({0} * {1} - {2} * {3})".format(*[h(a, b) for a, b in [(r, c) for r in range(3) if r != i for c in range(3) if c != j]][:1], *[h(a, b) for a, b in [(r, c) for r in range(3) if r != i for c in range(3) if c != j]][3:], *[h(a, b) for a, b in [(r, c) for r in range(3) if r != i for c in range(3) if c != j]][1:3])
    cofactor = [[("" if (i + j) % 2 == 0 else "-") + minor(i, j) for j in range(3)] for i in range(3)]
    return "(" + " + ".join(f"h0{j} * {cofactor[0][j]}" for j in range(3)) + ")", cofactor


def _newton(sums: str, names: list[str], start: list[float], steps: int = 15, digits: int = 4) -> str:
    """SQL of the estimates: ``sums`` selects step, b0.., scores g0.. and information h00.. from a table {s} of parameters."""
    k = len(names)
    b, det = [f"b{i}" for i in range(k)], _inverse(k)
    step = ", ".join(f"b{i} + (" + " + ".join(f"{det[1][i][j]} * g{j}" for j in range(k)) + f") / {det[0]} AS b{i}" for i in range(k))
    first = ", ".join(f"{v}::DOUBLE AS {n}" for n, v in zip(b, start, strict=True))
    rows = " UNION ALL ".join(f"SELECT '{n}' AS term, round(b{i}, {digits}) AS estimate, round(sqrt({det[1][i][i]} / {det[0]}), {digits}) AS se FROM e" for i, n in enumerate(names))
    at = lambda t: sums.replace("{s}", t)
    return f"WITH RECURSIVE s AS (SELECT 0 AS step, {first} UNION ALL SELECT step + 1 AS step, {step} FROM ({at('(SELECT * FROM s WHERE step < ' + str(steps) + ')')})), z AS (SELECT * FROM s WHERE step = {steps}), e AS ({at('z')}) {rows}"


def _rowwise(source: str, score: list[str], info: dict[tuple[int, int], str], more: str = "0 AS unused", most: str = "0 AS unused2") -> str:
    """Sums of scores and information over the rows of a source with weight w; ``more`` and then ``most`` add columns of each row."""
    k = len(score)
    b = ", ".join(f"b{i}" for i in range(k))
    g = ", ".join(f"sum(w * ({x})) AS g{i}" for i, x in enumerate(score))
    h = ", ".join(f"sum(w * ({x})) AS h{i}{j}" for (i, j), x in info.items())
    return f"SELECT step, {b}, {g}, {h} FROM (SELECT *, {most} FROM (SELECT *, {more} FROM {{s}} AS p, ({source}) AS d)) GROUP BY step, {b}"


def _slopes(factor: str) -> dict[tuple[int, int], str]:
    return {(0, 0): factor, (0, 1): f"({factor}) * x", (1, 1): f"({factor}) * x * x"}


_STATUS = "SELECT (l_linestatus = 'F')::INT::DOUBLE AS y, l_quantity / 10 AS x, count(*) AS w FROM lineitem GROUP BY 1, 2"


def _status(spark, sf) -> DataFrame:
    return load(spark, sf, "lineitem").selectExpr("cast(l_linestatus = 'F' as double) AS y", "l_quantity / 10 AS x", "cast(l_linenumber as double) AS k", tables.ROW)


@query(_newton(_rowwise(_STATUS, ["y - p1", "(y - p1) * x"], _slopes("p1 * (1 - p1)"), "1 / (1 + exp(-(b0 + b1 * x))) AS p1"), ["_cons", "x"], [0, 0]))
def logit_fit(spark, sf):
    return coefficients(spark, likelihood.logit(_status(spark, sf), "y", "x"), 4)


_MILLS = "exp(-0.5 * v * v) / sqrt(2 * pi()) / " + _phi("v") + " AS m"


@query(_newton(_rowwise(_STATUS, ["q * m", "q * m * x"], _slopes("m * (m + v)"), "2 * y - 1 AS q, (2 * y - 1) * (b0 + b1 * x) AS v", _MILLS), ["_cons", "x"], [0, 0], 8))
def probit_fit(spark, sf):
    return coefficients(spark, likelihood.probit(_status(spark, sf), "y", "x"), 4)


@query(_newton(_rowwise("SELECT l_linenumber::DOUBLE AS y, l_quantity / 10 AS x, count(*) AS w FROM lineitem GROUP BY 1, 2", ["y - mu", "(y - mu) * x"], _slopes("mu"), "exp(b0 + b1 * x) AS mu"), ["_cons", "x"], [1, 0]))
def poisson_fit(spark, sf):
    return coefficients(spark, likelihood.poisson(_status(spark, sf), "k", "x"), 4)


_BY_R = "list_sum(list_transform(range(0, y::BIGINT), lambda j: 1 / (r + j)))"
_BY_R2 = "list_sum(list_transform(range(0, y::BIGINT), lambda j: 1 / (r + j) / (r + j)))"


@query(_newton(
    _rowwise(
        "SELECT ((event_id * 7) % 40)::DOUBLE AS y, round(value / 10) / 10 AS x, count(*) AS w FROM events GROUP BY 1, 2",
        ["(y - mu) * r / (r + mu)", "(y - mu) * r / (r + mu) * x", "-r * t"],
        _slopes("r * mu * (r + y) / (r + mu) / (r + mu)") | {(0, 2): "r * (y - mu) * mu / (r + mu) / (r + mu)", (1, 2): "r * (y - mu) * mu / (r + mu) / (r + mu) * x", (2, 2): f"-r * (t + r * (1 / r - 1 / (r + mu) - (mu - y) / (r + mu) / (r + mu) - coalesce({_BY_R2}, 0)))"},
        "exp(-b2) AS r, exp(b0 + b1 * x) AS mu",
        f"coalesce({_BY_R}, 0) + ln(r / (r + mu)) + 1 - (r + y) / (r + mu) AS t",
    ),
    ["_cons", "x", "lnalpha"], [2.97, 0, -0.9], 20, 3,
))
def nbreg_fit(spark, sf):
    df = load(spark, sf, "events").selectExpr("cast((event_id * 7) % 40 AS double) AS y", "round(value / 10) / 10 AS x", tables.ROW)
    return coefficients(spark, likelihood.nbreg(df, "y", "x"), 3)


_CENSORED = "SELECT greatest(l_quantity - 20 + l_discount * 50, 0.0) AS y, l_discount * 100 AS x, count(*) AS w FROM lineitem GROUP BY 1, 2"
_OUTCOME = ["greatest(l_quantity - 20 + l_discount * 50, 0.0) AS y", "l_discount * 100 AS x", "l_quantity AS t", "cast(l_linestatus = 'F' as double) AS d"]


def _two(cut: str, then: str, other: str) -> str:
    return f"CASE WHEN {cut} THEN {then} ELSE {other} END"


_CUT = "y <= 0"


@query(_newton(
    _rowwise(
        _CENSORED,
        [_two(_CUT, "-m / sd", "z / sd"), _two(_CUT, "-m / sd * x", "z / sd * x"), _two(_CUT, "-m * v", "z * z - 1")],
        _slopes(_two(_CUT, "m * (m + v) / sd / sd", "1 / sd / sd")) | {(0, 2): _two(_CUT, "(m * (m + v) * v - m) / sd", "2 * z / sd"), (1, 2): _two(_CUT, "(m * (m + v) * v - m) / sd * x", "2 * z / sd * x"), (2, 2): _two(_CUT, "m * (m + v) * v * v - m * v", "2 * z * z")},
        "exp(b2) AS sd, (y - b0 - b1 * x) / exp(b2) AS z, -(b0 + b1 * x) / exp(b2) AS v", _MILLS,
    ),
    ["_cons", "x", "lnsigma"], [5, 0.5, 2.7], 12, 3,
))
def tobit_fit(spark, sf):
    df = load(spark, sf, "lineitem").selectExpr(*_OUTCOME, tables.ROW)
    return coefficients(spark, likelihood.tobit(df, "y", "x"), 3)


@query(_newton(
    _rowwise(
        f"SELECT * FROM ({_CENSORED}) WHERE y > 0",
        ["(z - m) / sd", "(z - m) / sd * x", "z * z - 1 + m * v"],
        _slopes("(1 - m * (m + v)) / sd / sd") | {(0, 2): "(2 * z + m * (m + v) * v - m) / sd", (1, 2): "(2 * z + m * (m + v) * v - m) / sd * x", (2, 2): "2 * z * z - m * (m + v) * v * v + m * v"},
        "exp(b2) AS sd, (y - b0 - b1 * x) / exp(b2) AS z, (b0 + b1 * x) / exp(b2) AS v", _MILLS,
    ),
    ["_cons", "x", "lnsigma"], [12, 0.5, 2.4], 15, 3,
))
def truncreg_fit(spark, sf):
    df = load(spark, sf, "lineitem").selectExpr(*_OUTCOME, tables.ROW)
    return coefficients(spark, likelihood.truncreg(df, "y", "x", predicate="y > 0"), 3)


_SPELLS = "SELECT l_quantity AS t, (l_linestatus = 'F')::INT::DOUBLE AS d, l_discount * 10 AS x, count(*) AS w FROM lineitem GROUP BY 1, 2, 3"


def _spells(spark, sf) -> DataFrame:
    return load(spark, sf, "lineitem").selectExpr("l_quantity AS t", "cast(l_linestatus = 'F' as double) AS d", "l_discount * 10 AS x", tables.ROW)


@query(_newton(_rowwise(_SPELLS, ["d - h", "(d - h) * x"], _slopes("h"), "exp(b0 + b1 * x) * t AS h"), ["_cons", "x"], [-4, 0]))
def exponential_fit(spark, sf):
    return coefficients(spark, likelihood.streg(_spells(spark, sf), "t", "x", failure="d", distribution="exponential"), 4)


@query(_newton(_rowwise(_SPELLS, ["d - h", "(d - h) * x", "d * (1 + u) - h * u"], _slopes("h") | {(0, 2): "h * u", (1, 2): "h * u * x", (2, 2): "h * u * u + h * u - d * u"}, "exp(b2) * ln(t) AS u", "exp(b0 + b1 * x + u) AS h"), ["_cons", "x", "lnp"], [-5, 0, 0.3], 20))
def weibull_fit(spark, sf):
    return coefficients(spark, likelihood.streg(_spells(spark, sf), "t", "x", failure="d"), 4)


@query(_newton(
    _rowwise(
        _SPELLS, ["d - e * (a - 1) / b2", "(d - e * (a - 1) / b2) * x", "d * t - e * f"],
        _slopes("e * (a - 1) / b2") | {(0, 2): "e * f", (1, 2): "e * f * x", (2, 2): "e * (t * t * a / b2 - 2 * t * a / b2 / b2 + 2 * (a - 1) / b2 / b2 / b2)"},
        "exp(b0 + b1 * x) AS e, exp(b2 * t) AS a", "t * a / b2 - (a - 1) / b2 / b2 AS f",
    ),
    ["_cons", "x", "gamma"], [-4.5, 0, 0.03], 20,
))
def gompertz_fit(spark, sf):
    return coefficients(spark, likelihood.streg(_spells(spark, sf), "t", "x", failure="d", distribution="gompertz"), 4)


_RISK = "SELECT step, b0, t, sum(w * d) AS dead, sum(w * d * x) AS dx, sum(w * exp(b0 * x)) AS a, sum(w * x * exp(b0 * x)) AS a1, sum(w * x * x * exp(b0 * x)) AS a2 FROM {s} AS p, (" + _SPELLS + ") AS d GROUP BY step, b0, t"
_SWEEP = f"SELECT step, b0, sum(dx - dead * c1 / c) AS g0, sum(dead * (c2 / c - c1 / c * c1 / c)) AS h00 FROM (SELECT step, b0, dead, dx, sum(a) OVER w AS c, sum(a1) OVER w AS c1, sum(a2) OVER w AS c2 FROM ({_RISK}) WINDOW w AS (PARTITION BY step ORDER BY t DESC)) GROUP BY step, b0"


@query(_newton(_SWEEP, ["x"], [0]))
def cox_fit(spark, sf):
    return coefficients(spark, survival.stcox(_spells(spark, sf), "t", "x", failure="d"), 4)


def _conditional(source: str) -> str:
    per = f"SELECT step, b0, g, sum(y) AS n, sum(y * x) AS yx, sum(exp(b0 * x)) AS a, sum(x * exp(b0 * x)) AS a1, sum(x * x * exp(b0 * x)) AS a2 FROM {{s}} AS p, ({source}) AS d GROUP BY step, b0, g"
    return f"SELECT step, b0, sum(yx - n * a1 / a) AS g0, sum(n * (a2 / a - a1 / a * a1 / a)) AS h00 FROM ({per}) GROUP BY step, b0"


@query(_newton(_conditional("SELECT user_id AS g, (1 + event_id % 9)::DOUBLE AS y, value / 100 AS x FROM events"), ["x"], [0]))
def xtpoisson_fe_fit(spark, sf):
    df = load(spark, sf, "events").selectExpr("user_id AS u", "cast(1 + event_id % 9 AS double) AS y", "value / 100 AS x", tables.ROW)
    return coefficients(spark, likelihood.xtpoisson_fe(df, "y", "x", group="u"), 4)


@query(_newton(_conditional("SELECT l_orderkey AS g, (l_linenumber = 1)::INT::DOUBLE AS y, l_quantity / 10 AS x FROM lineitem"), ["x"], [0]))
def clogit_fit(spark, sf):
    df = load(spark, sf, "lineitem").selectExpr("l_orderkey AS g", "cast(l_linenumber = 1 AS double) AS y", "l_quantity / 10 AS x", tables.ROW)
    return coefficients(spark, likelihood.clogit(df, "y", "x", group="g"), 4)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load, filter, derive, collapse."""
    df = rows.generate(rows.keep_if(load(spark, sf_dir, "lineitem"), "l_quantity > 10"), "net", "l_extendedprice * (1 - l_discount)")
    return summaries.collapse(df, "mean", ["net", "l_quantity"], ["l_returnflag", "l_linestatus"]).drop(tables.ROW)


from . import more_queries  # noqa: E402, F401  registers its queries here
