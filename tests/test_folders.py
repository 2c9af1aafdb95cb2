"""Tables of several files: their order survives saving, splits of any size, and resampling."""

import pytest

from halyard.operators import other, rows
from halyard.sources import tables

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("saved"))
    orders = tables.use(spark, f"{SF}/orders.parquet").select("o_orderkey", "o_totalprice", "o_custkey", tables.ROW)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.save(rows.sort(orders, "o_totalprice"), f"{place}/orders.parquet")
        tables.export(rows.sort(orders, "o_totalprice"), f"{place}/orders.csv")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return place


def ascending(df):
    prices = [r[0] for r in tables.ordered(df).select("o_totalprice").collect()]
    return len(prices) == 150_000 and prices == sorted(prices)


@pytest.mark.parametrize("kind", ["parquet", "csv"])
@pytest.mark.parametrize("size", ["128m", "300k"])
def test_order_survives(spark, folder, kind, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        df = tables.use(spark, f"{folder}/orders.{kind}")
        assert len(df.inputFiles()) == 8
        assert df.columns == ["o_orderkey", "o_totalprice", "o_custkey", tables.ROW]
        assert ascending(df)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_names_with_blanks(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/a b%25c.parquet")
    got = [r[0] for r in tables.ordered(tables.use(spark, f"{tmp_path}/a b%25c.parquet")).collect()]
    assert sorted(got) == list(range(30)) and all(got[i] % 10 == i % 10 for i in range(30))


def test_bootstrap_does_not_depend_on_splits(spark, folder):
    found = []
    for size in ("128m", "300k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        df = tables.use(spark, f"{folder}/orders.parquet")
        found.append((df.rdd.getNumPartitions(), other.bootstrap(df, "o_totalprice", "o_custkey", reps=10, seed=4).cov))
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0][0] != found[1][0]
    assert abs(found[0][1] / found[1][1] - 1).max() < 1e-6
