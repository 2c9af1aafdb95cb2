"""The seeded sequence against a generator that steps one number at a time, and bootstraps on its draws."""

import numpy as np
import pytest

from halyard.operators import other, rows
from halyard.plans import sequence
from halyard.sources import tables

M = 2**64 - 1


def stepped(seed):
    """The sequence in whole numbers, one by one."""
    s = [int(w) for w in sequence.seeded(seed)]
    turn = lambda x, k: ((x << k) | (x >> (64 - k))) & M
    while True:
        yield (turn((s[0] + s[3]) & M, 23) + s[0]) & M
        t = (s[1] << 17) & M
        s[2] ^= s[0]
        s[3] ^= s[1]
        s[1] ^= s[2]
        s[0] ^= s[3]
        s[2] ^= t
        s[3] = turn(s[3], 45)


def drawn(seed, total, reps):
    numbers, limit = stepped(seed), M - M % total
    return [[next(v for v in numbers if v < limit) % total for _ in range(total)] for _ in range(reps)]


def test_first_draws():
    # fixed values: known draws of this generator
    assert drawn(18446744073709551615, 12, 2) == [[6, 4, 7, 7, 5, 8, 0, 7, 5, 11, 11, 4], [1, 9, 9, 1, 3, 0, 3, 9, 8, 1, 11, 9]]


def test_jumps():
    numbers = stepped(42)
    plain = np.array([next(numbers) for _ in range(2 * sequence.CHUNK)], np.uint64)
    assert (np.concatenate([sequence.chunk(42, 0), sequence.chunk(42, 1)]) == plain).all()
    far = sequence.jumped(sequence.seeded(7)[None], 10**15)
    assert (sequence.jumped(sequence.jumped(sequence.seeded(7)[None], 10**15 - 12345), 12345) == far).all()


@pytest.mark.parametrize(("total", "reps", "width"), [(12, 30, 5), (1, 3, 1), (3000, 200, 512)])
def test_draws_by_block(spark, total, reps, width):
    got = [[] for _ in range(reps)]
    for r in sequence.replayed_draws(spark, 5, total, reps, width).collect():
        got[r["rep"]] += [r["block"] * width + a for a in r["at"]]
    assert [sorted(g) for g in got] == [sorted(d) for d in drawn(5, total, reps)]


def test_rejected_numbers_move_the_draws(spark, monkeypatch):
    """With a low limit, which workers are told by value, numbers are rejected often."""
    seed, total, reps = 11, 10, 40
    lost = [i for i, v in zip(range(2000), stepped(seed), strict=False) if v % 7 == 3]
    monkeypatch.setattr(sequence, "_rejected", lambda *a: [p for p in lost if p < 1000])
    numbers = [v for i, v in zip(range(1000), stepped(seed), strict=False) if v % 7 != 3]
    got = [[] for _ in range(reps)]
    for r in sequence.replayed_draws(spark, seed, total, reps, 4).collect():
        got[r["rep"]] += [r["block"] * 4 + a for a in r["at"]]
    assert [sorted(g) for g in got] == [sorted(v % total for v in numbers[i * total : (i + 1) * total]) for i in range(reps)]


def test_bootstraps(spark):
    rng = np.random.default_rng(8)
    data = [(i, int(rng.integers(0, 40)), float(rng.normal()), None if i % 50 == 7 else float(rng.normal())) for i in range(1500)]
    df = spark.createDataFrame([(i, g, x, None if e is None else 1 + 2 * x + e) for i, g, x, e in data], f"{tables.ROW} long, g int, x double, y double")
    used = [(g, x, 1 + 2 * x + e) for _, g, x, e in data if e is not None]
    m = np.array([[1, x, y] for _, x, y in used])

    def spread(samples):
        b = [np.linalg.lstsq(m[at, :2], m[at, 2], rcond=None)[0] for at in samples]
        return np.cov(np.array(b).T, ddof=1), np.percentile(b, [2.5, 97.5], axis=0)

    seed = 2**63 + 5
    cov, edges = spread(drawn(seed, len(used), 60))
    for way in (df, df.repartition(6), rows.gsort(df.withColumn("at", -df[tables.ROW]), "-at"), df.withColumn(tables.ROW, df[tables.ROW] + (1 << 60))):
        fit = other.bootstrap(way, "y", "x", reps=60, seed=seed, replay=True)
        assert np.allclose(fit.cov, cov, rtol=1e-8) and np.allclose(fit.info["percentiles"], edges)
    order = list(dict.fromkeys(g for g, _, _ in used))
    members = {g: [i for i, r in enumerate(used) if r[0] == g] for g in order}
    cov, edges = spread([[i for u in d for i in members[order[u]]] for d in drawn(9, len(order), 50)])
    fit = other.bootstrap(df, "y", "x", reps=50, seed=9, cluster="g", replay=True)
    assert np.allclose(fit.cov, cov, rtol=1e-8) and np.allclose(fit.info["percentiles"], edges)


def test_replay_shuffles_little(spark):
    """A draw takes under two bytes of shuffles, rows included; it took 4.3 here when each was a number in a list for its block."""
    df = spark.range(200_000).selectExpr(f"id AS {tables.ROW}", "cast(id % 50 AS double) AS x", "cast(id % 50 * 2 + id % 7 AS double) AS y")
    empty, jvm = spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm
    stages = lambda: jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, empty, jvm.java.util.ArrayList()))
    seen = {s.stageId() for s in stages()}
    other.bootstrap(df, "y", "x", reps=40, seed=3, replay=True)
    assert 0 < sum(s.shuffleWriteBytes() for s in stages() if s.stageId() not in seen) < 2 * 40 * 200_000


@pytest.mark.parametrize("most", [1 << 20, 3])
def test_sums_in_rounds(spark, monkeypatch, most):
    """Several ranges and rounds, rejected numbers, and places with gaps, numbered anew where they lie in too many blocks."""
    n, reps, seed = 9000, 7, 21
    lost = [3, 4, 8999, 9002, 40_000, n * reps]
    monkeypatch.setattr(sequence, "_rejected", lambda *a: lost)
    monkeypatch.setattr(sequence, "ROUND", 3)
    monkeypatch.setattr(sequence, "MAX_BLOCKS", most)
    rng = np.random.default_rng(4)
    place, values = np.sort(rng.choice(1 << 16, n, replace=False)) + (1 << 40), rng.normal(size=(n, 2))
    order = rng.permutation(n)
    df = spark.createDataFrame([(int(place[i]), *map(float, values[i])) for i in order], "u long, a double, b double").repartition(3)
    numbers = [v for i, v in zip(range(n * reps + len(lost)), stepped(seed), strict=False) if i not in set(lost)]
    rows = np.array([v % n for v in numbers[: n * reps]]).reshape(reps, n)
    a, b = values.T
    assert np.allclose(sequence.replayed_sums(df, "u", ["a", "b"], reps, seed), np.stack([[a[r].sum(), b[r].sum()] for r in rows]))
    assert np.allclose(sequence.replayed_sums(df, "u", ["a", "b"], reps, seed, products=True), np.stack([[(a * a)[r].sum(), (a * b)[r].sum(), (b * b)[r].sum()] for r in rows]))
