"""Every registered query of the library's own against its SQL, on the smallest tables."""

import pathlib

import duckdb
import pytest

from halyard.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(f"{r[i] + 0.0:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    assert df.columns
    if name in ORACLES:
        expected = duck.sql(ORACLES[name])
        assert sorted(df.columns) == sorted(expected.columns)
        assert canonical(got, df.columns) == canonical(expected.fetchall(), expected.columns)
    else:
        assert got
