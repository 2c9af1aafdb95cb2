"""Row order and row counts on tables of several partitions, whatever columns are read."""

import pathlib

import pytest
from pyspark.sql import functions as F

from halyard.operators import rows, smoothing, summaries
from halyard.sources import tables

SF = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no tables")


def load(spark, name, parts=None):
    df = tables.use(spark, f"{SF}/{name}.parquet")
    return df.repartition(parts) if parts else df


def count(df):
    r = df.agg(F.count("*").alias("n"), F.count_distinct(tables.ROW).alias("d")).first()
    return r["n"], r["d"]


@pytest.mark.parametrize("columns,coalesce", [(["l_extendedprice"], "true"), (None, "true"), (["l_extendedprice", "l_partkey"], "false")])
def test_sort(spark, columns, coalesce):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        df = load(spark, "lineitem", 7)
        columns = [c for c in columns or df.columns[:-1] if c in df.columns]
        out = rows.gsort(rows.keep(df, *columns), "-l_extendedprice")
        assert count(out) == (600_000, 600_000)
        down = [r[0] for r in out.orderBy(tables.ROW).select("l_extendedprice").limit(2000).collect()]
        assert down == sorted(down, reverse=True)
        assert down == [r[0] for r in df.orderBy(F.desc("l_extendedprice")).select("l_extendedprice").limit(2000).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_joins_keep_all_rows(spark):
    orders, customer = load(spark, "orders", 5), rows.rename(load(spark, "customer", 3), "c_custkey", "o_custkey")
    for how in ("inner", "left"):
        joined = rows.join_tables(orders, customer, ["o_custkey"], how)
        assert count(joined) == (150_000, 150_000)
        assert count(rows.keep(joined, "c_acctbal")) == (150_000, 150_000)
    some = rows.join_tables(rows.keep(orders, "o_orderkey", "o_custkey"), rows.keep_if(customer, "o_custkey % 2 = 0"), ["o_custkey"], "left")
    keys = [r[0] for r in rows.head(some, 300).select("o_orderkey").collect()]
    assert keys == [r[0] for r in rows.head(orders, 300).select("o_orderkey").collect()]


def test_join_order_is_left_then_right(spark):
    left = tables.numbered(spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (None, "c")], "k int, l string").coalesce(1)).withColumn("k", F.when(F.col("l") == "a", 1).otherwise(F.col("k")))
    right = tables.numbered(spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n")], "k int, r string").coalesce(1))
    out = tables.ordered(rows.join_tables(left, right, ["k"], "left")).collect()
    assert [(r["l"], r["r"]) for r in out] == [("a", "x"), ("a", "y"), ("b", "z"), ("a", "x"), ("a", "y"), ("c", None)]


def test_pairs_of_one_key_are_split(spark):
    """A key with millions of pairs goes to several tasks; rare, missing and unmatched keys keep their rows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = tables.numbered(spark.range(20_000).selectExpr("CASE WHEN id % 1000 = 1 THEN NULL WHEN id % 1000 = 2 THEN 7 WHEN id % 1000 = 3 THEN 9 ELSE 5 END AS k", "id AS l"))
        right = tables.numbered(spark.range(803).selectExpr("CASE WHEN id < 800 THEN 5 WHEN id < 802 THEN 7 END AS k", "id AS r"))
        for how, more in (("inner", 0), ("left", 40)):
            joined = rows.join_tables(left, right, ["k"], how)
            tasks = [r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
            assert sum(tasks) == 19_940 * 800 + 40 + more
            assert len(tasks) > 1 and max(tasks) < 0.9 * sum(tasks)
            assert joined.where("k = 5").select("l", "r").distinct().count() == 19_940 * 800
            assert joined.where("k IS NULL OR k = 9").where("r IS NULL").count() == more
            first = rows.head(joined, 1601).select("l", "r").collect()
            assert [r["r"] for r in first[:800]] == list(range(800)) and first[0]["l"] == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_append_and_reshape(spark):
    orders = rows.keep(load(spark, "orders", 5), "o_orderkey", "o_totalprice")
    part = rows.keep_if(orders, "o_orderkey % 3 = 0")
    n = part.count()
    both = rows.append(orders, part)
    assert count(both) == (150_000 + n, 150_000 + n)
    again = rows.append(both, orders)
    assert count(again)[0] == 300_000 + n
    assert [r[0] for r in rows.tail(again, 5).select("o_orderkey").collect()] == [r[0] for r in rows.tail(orders, 5).select("o_orderkey").collect()]
    wide = orders.withColumnRenamed("o_totalprice", "v_a").withColumn("v_b", F.col("v_a") * 2)
    long = rows.reshape_long(wide, ["v"], ["o_orderkey"], "j")
    assert count(long) == (300_000, 300_000)
    first = rows.head(long, 4).collect()
    assert [r["j"] for r in first] == ["a", "b", "a", "b"] and first[0]["o_orderkey"] == first[1]["o_orderkey"]
    back = rows.reshape_wide(long, ["v"], ["o_orderkey"], "j")
    assert count(back) == (150_000, 150_000)
    assert [r[0] for r in rows.head(back, 50).select("o_orderkey").collect()] == [r[0] for r in rows.head(orders, 50).select("o_orderkey").collect()]


def test_encode_many_levels(spark):
    df = rows.keep(load(spark, "lineitem", 6).withColumn("s", F.format_string("k%09d", F.col("l_orderkey"))), "s", "l_orderkey")
    coded, labels = rows.encode(df, "s", "code")
    r = coded.agg(F.count("*").alias("n"), F.min("code").alias("a"), F.max("code").alias("b"), F.count_distinct("code").alias("d"), F.count_distinct("s").alias("s")).first()
    assert (r["n"], r["a"], r["b"], r["d"]) == (600_000, 1, r["s"], r["s"])
    assert labels.count() == r["s"]
    assert rows.decode(coded, "code", labels, "back").where("NOT (s <=> back)").count() == 0


def test_signature_depends_on_rows_alone(spark):
    df = load(spark, "orders")
    one = summaries.datasignature(df).first()
    assert one["rows"] == 150_000
    assert one == summaries.datasignature(df.repartition(9)).first()
    assert one == summaries.datasignature(df.withColumn(tables.ROW, F.col(tables.ROW) * 7 + 3)).first()
    assert one != summaries.datasignature(rows.sort(df, "o_totalprice")).first()
    assert one != summaries.datasignature(df.withColumn("o_totalprice", F.when(F.col("o_orderkey") == 1, 0.0).otherwise(F.col("o_totalprice")))).first()


def test_lowess_after_a_sort(spark):
    events = tables.use(spark, "/root/testdata/sf0.01/events.parquet").withColumn("value", F.when(F.col("event_id") % 50 != 3, F.col("value")))
    plain = smoothing.lowess(events, "value", "event_id", "s", by="user_id").select("event_id", F.round("s", 9).alias("s"))
    turned = smoothing.lowess(rows.sort(events, "value"), "value", "event_id", "s", by="user_id").select("event_id", F.round("s", 9).alias("s"))
    assert plain.count() == events.count() and plain.exceptAll(turned).count() == 0
    assert plain.where("s is null").count() == events.where("value is null").count()
