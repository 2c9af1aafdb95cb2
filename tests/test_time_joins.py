"""As-of and interval joins against loops, with ties, nulls, hot keys and keys that span many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from halyard.operators import time_joins
from halyard.sources.tables import ROW

rng = random.Random(55)
LEFT = [(i, rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([None, *range(40)]), f"l{i}") for i in range(400)] + [(400, "alone", 5, "x"), (401, "hot", 1000, "end")]
RIGHT = [(i, rng.choice(["hot"] * 2 + ["a", "c", None]), rng.choice([None, *range(0, 40, 3)]), f"r{i}") for i in range(60)]


@pytest.fixture(scope="module")
def sides(spark):
    make = lambda rows, name: spark.createDataFrame(rows, f"{ROW} long, k string, t long, {name} string").repartition(5)
    return make(LEFT, "v"), make(RIGHT, "v")


def plain(direction, strict, away=None):
    out = []
    for _, k, t, v in LEFT:
        fits = [(u, i, w) for i, key, u, w in RIGHT if None not in (k, t, u) and key == k and ((u < t if strict else u <= t) if direction == "backward" else (u > t if strict else u >= t)) and (away is None or abs(u - t) <= away)]
        best = (max(fits) if direction == "backward" else min(fits)) if fits else None
        out.append((v, best[2] if best else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("ranges", ["1", "23"])
def test_asof(spark, sides, direction, strict, ranges):
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = time_joins.asof_join(*sides, "t", by=["k"], direction=direction, strict=strict)
        assert got.columns == [ROW, "k", "t", "v", "t_right", "v_right"]
        assert sorted(((r["v"], r["v_right"]) for r in got.collect()), key=str) == plain(direction, strict)
        inner = time_joins.asof_join(*sides, "t", by=["k"], direction=direction, strict=strict, how="inner")
        assert inner.count() == sum(x[1] is not None for x in plain(direction, strict))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_tolerance_and_no_key(spark, sides):
    got = time_joins.asof_join(*sides, "t", by=["k"], tolerance=F.lit(4))
    want = plain("backward", False, 4)
    assert sorted(((r["v"], r["v_right"]) for r in got.collect()), key=str) == want
    left, right = sides
    whole = time_joins.asof_join(left.drop("k"), right.drop("k"), "t")
    best = {t: max((u, i, w) for i, _, u, w in RIGHT if u is not None and u <= t)[2] for t in range(40)}
    assert all(r["v_right"] == (best.get(min(r["t"], 39)) if r["t"] is not None else None) for r in whole.collect())


def test_asof_empty_sides(sides):
    left, right = sides
    assert time_joins.asof_join(left, right.limit(0), "t", by=["k"]).where("v_right IS NOT NULL").count() == 0
    assert time_joins.asof_join(left, right.limit(0), "t", by=["k"]).count() == len(LEFT)
    assert time_joins.asof_join(left.limit(0), right, "t", by=["k"]).count() == 0


SPANS = [(i, rng.choice(["hot"] * 3 + ["a", None]), a, None if i == 7 else a + rng.choice([-2, 0, 1, 2, 3, 15, 16, 17, 1000]), f"s{i}") for i, a in enumerate(rng.randrange(-5, 45) for _ in range(80))]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_intervals(spark, sides, how):
    spans = spark.createDataFrame([x[1:] for x in SPANS], "k string, a long, b long, name string")
    got = time_joins.interval_join(sides[0], spans, "t", "a", "b", by=["k"], how=how)
    want = []
    for _, k, t, v in LEFT:
        own = [n for _, key, a, b, n in SPANS if None not in (k, t, b) and key == k and a <= t < b]
        want += [(v, n) for n in own] or ([(v, None)] if how == "left" else [])
    assert sorted(((r["v"], r["name"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_interval_makes_two_rows_at_most(spark, sides):
    spans = spark.createDataFrame([("hot", 0, 1 << 40, "long"), ("hot", 3, 4, "short")], "k string, a long, b long, name string")
    got = time_joins.interval_join(sides[0], spans, "t", "a", "b", by=["k"])
    hot = [t for _, k, t, _ in LEFT if k == "hot" and t is not None]
    assert got.count() == len(hot) + sum(t == 3 for t in hot)
    assert time_joins.interval_join(sides[0], spans.limit(0), "t", "a", "b", by=["k"]).count() == 0
    assert time_joins.interval_join(sides[0], spans.limit(0), "t", "a", "b", by=["k"], how="left").count() == len(LEFT)


def test_fractions(spark):
    points = spark.createDataFrame([(i, i / 100) for i in range(100)], f"{ROW} long, t double")
    spans = spark.createDataFrame([(0.1, 0.1001, "tiny"), (0.25, 0.5, "half"), (-1e9, 0.05, "early")], "a double, b double, name string")
    got = time_joins.interval_join(points, spans, "t", "a", "b")
    assert {n: got.where(f"name = '{n}'").count() for n in ("tiny", "half", "early")} == {"tiny": 1, "half": 25, "early": 5}
