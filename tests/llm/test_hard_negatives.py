"""Hard negatives: against all pairs in numpy, the query's SQL, and bounds against exact scores."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.llm import hard_negatives as hn
from halyard.llm import queries

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, q string, part int"


def brute(rows, positives=5, negatives=5):
    """rows: distinct (id, label, tuple of ints)."""
    width = max((len(r[2]) for r in rows), default=0)
    vectors = [np.array(list(r[2]) + [0] * (width - len(r[2])), object) for r in rows]
    key = lambda j: (rows[j][0] is None, rows[j][0] or 0)
    out = []
    for a, (ident, label, _) in enumerate(rows):
        if ident is None or ident % 100:
            continue
        score = [int(v @ vectors[a]) if width else 0 for v in vectors]
        near = sorted((j for j in range(len(rows)) if j != a and rows[j][1] == label), key=lambda j: (-score[j], key(j)))[:positives]
        for p in near:
            far = [j for j in range(len(rows)) if rows[j][1] != label and 80 * score[p] <= 100 * score[j] <= 100 * score[p]]
            for rank, j in enumerate(sorted(far, key=lambda j: (-score[j], key(j)))[:negatives], 1):
                out.append((ident, rows[p][0], rank, rows[j][0], score[p], score[j]))
    return sorted(out, key=str)


def quantise(rows):
    kept = [(i, label, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)) for i, v, label in rows if label is not None and v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    return sorted(set(kept), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(12)
    centres = rng.normal(0, 0.3, (4, 20))
    made = [(i, (centres[i % 4] + rng.normal(0, 0.15, 20)).tolist(), int(rng.integers(4))) for i in range(0, 1300, 3)]
    hot = [(10_000 + i, made[0][1], i % 3) for i in range(150)]
    odd = [(None, made[1][1], 1), (None, made[1][1], 1), (200, None, 1), (300, [1.0, None], 1), (300, [1.0, float("nan")], 2), (400, [float("inf")], 1), (500, made[3][1], None), (600, [], 2), (700, [0.5], 1), (700, [0.5, 0.5], 1), (700, [0.5, 0.5], 2), (800, made[5][1] * 2, 3), made[0], made[0], (-100, [-x for x in made[7][1]], 0), (900, [0.0] * 20, 9)]
    return made + hot + odd


def test_against_all_pairs(spark, rows):
    df = spark.createDataFrame([(*r, "own", 1) for r in rows], SCHEMA).repartition(5)
    got = hn.mine_hard_negatives(hn.quantised(df), F.col("vec_id") % 100 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(quantise(rows))


def test_many_cells(spark, rows, monkeypatch):
    monkeypatch.setattr(hn, "CHUNK_ROWS", 40)
    monkeypatch.setattr(hn, "ANCHOR_ROWS", 3)
    df = spark.createDataFrame([(*r, "own", 1) for r in rows], SCHEMA)
    got = hn.mine_hard_negatives(hn.quantised(df), F.col("vec_id") % 100 == 0, positives=3, negatives=2)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(quantise(rows), 3, 2)


def test_bounds_hold_and_rule_out():
    rng = np.random.default_rng(5)
    import pyarrow as pa

    # neighbouring components are alike, so that segments of three say much
    centre = np.repeat(rng.normal(0, 60, 16), 3)
    made = [(i, i % 2, (centre * (1 if i < 30 else -1) + rng.normal(0, 15, 48)).astype(int).tolist()) for i in range(400)]
    table = hn._packer(48)(pa.table({"part": [0] * 400, "vec_id": [r[0] for r in made], "label": [r[1] for r in made], "q": pa.array([r[2] for r in made], pa.list_(pa.int32()))}))
    block = hn.Block.read(table.to_pylist()[0])
    every = np.arange(400)
    exact = block.scores(every, block, 7)
    width = []
    for level in range(3):
        lower, upper = block.bounds(level, every, block, 7)
        assert (lower <= exact).all() and (exact <= upper).all()
        width.append(float((upper - lower).mean()))
    assert width[0] > width[1] > width[2]
    lower, upper = block.bounds(2, every, block, 7)
    assert (upper >= np.partition(lower, -5)[-5]).sum() < 100


def test_large_components(spark):
    rows = [(0, [8e6, -8e6], 1), (1, [8e6, 8e6], 1), (2, [-8e6, -8e6], 1), (3, [7e6, -7.5e6], 2), (4, [0.0, 0.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = hn.mine_hard_negatives(hn.quantised(df), F.col("vec_id") % 100 == 0)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(quantise(rows))
    wide = spark.createDataFrame([(0, [8e6] * 4, 1), (1, [8e6] * 4, 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(Exception, match="64 bits"):
        hn.mine_hard_negatives(hn.quantised(wide), F.col("vec_id") % 100 == 0).collect()


def test_empty_table(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hn.mine_hard_negatives(hn.quantised(none), F.col("vec_id") % 100 == 0).collect() == []
    one = spark.createDataFrame([(100, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert hn.mine_hard_negatives(hn.quantised(one), F.col("vec_id") % 100 == 0).collect() == []


def test_query(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = queries.op12_hard_negatives(spark, SF)
    want = con.sql(queries.oracle_sql()["op12_hard_negatives"])
    assert got.columns == want.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())
