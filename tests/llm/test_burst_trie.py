"""The prefix trie against a plain trie of dicts, with small pieces and little room, and against the query's SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from halyard.llm import burst_trie, queries

SF = "/root/testdata/sf0.001"
rng = random.Random(11)


def tid(role, text):
    role, text = role or "", text or ""
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def plain(rows, mend=True):
    """rows: conv, turn, role, text. Sequences are rebuilt, then every prefix is a node."""
    turns = {}
    for c, t, r, x in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, tid(r, x), len((x or "").encode())))
    own = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    sequences = own
    if mend:
        sequences = {}
        for c, v in own.items():
            h = zlib.crc32(str(c).encode()) % 9
            sequences[c] = own.get(c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5)), [])[:h] + v[h:]
    nodes = {}
    for c, v in sequences.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    out, children = {}, {}
    for k in nodes:
        if k:
            children.setdefault(k[:-1], []).append(k)
    for k in sorted(nodes, key=len, reverse=True):
        below = [out[x] for x in children.get(k, [])]
        ends = sorted(c for c in nodes[k] if len(sequences[c]) == len(k))
        gain = (len(nodes[k]) - 1) * k[-1][1] if k else 0
        out[k] = (min(nodes[k]), len(k), min(nodes[k[:-1]]) if k else None, len(nodes[k]), len(below), sum(x[5] for x in below) or 1, gain + sum(x[6] for x in below), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return sorted(out.values(), key=str)


def conversations():
    rows = []
    for c in [*range(-12, 60), *range(200, 420), 1003, 1004]:
        opening = rng.choice(["s1", "s1", "s2", "é\n"])
        for t in range(rng.randrange(1, 12)):
            text = opening if t == 0 else rng.choice("ab") if t < 5 else rng.choice(["x", "y", "", None])
            rows.append((c, t, rng.choice(["user", "user", "assistant", None]) if t > 2 else "user", text))
    rows += [(c, t, "user", f"hot {t}") for c in range(2000, 2400) for t in range(9)]
    rows += [(3000, t, "user", "long" if t % 7 else f"{t}") for t in range(420)] + [(3001, t, "user", "long" if t % 7 else f"{t}") for t in range(300)] + [(3002, t, "user", "long" if t % 7 else f"{t}") for t in range(300)]
    rows += [(5, None, "user", "before all"), (5, None, "user", "before all"), (6, 3, "user", "tie"), (6, 3, "assistant", "tie"), (6, 3, "assistant", "tie"), (None, 1, "user", "nobody's"), (7777, 1, "", ""), (7, 2, None, "user")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def table(spark):
    rows = conversations()
    return rows, spark.createDataFrame([(*r, 1, "own") for r in rows], "conv_id long, turn long, role string, text string, depth int, seg string").repartition(5)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("piece, room", [(4096, 1024), (256, 2), (200, 50)])
def test_trie(table, piece, room):
    rows, df = table
    nodes = burst_trie.prefix_trie(burst_trie.rebuilt(burst_trie.numbered_turns(df)), piece=piece, room=room)
    assert nodes.columns == burst_trie.NAMES
    assert found(nodes) == plain(rows)


def test_without_rebuilding(table, spark):
    rows, df = table
    turns = burst_trie.numbered_turns(df)
    whole = turns.union(turns.where("pos = 1").select("conv", F.lit(0).cast("long"), F.lit(None).cast("binary")))
    assert found(burst_trie.prefix_trie(whole, piece=300, room=8)) == plain(rows, mend=False)


def test_empty_and_turnless(spark):
    schema = "conv_id long, turn long, role string, text string"
    empty = spark.createDataFrame([], schema)
    assert burst_trie.prefix_trie(burst_trie.rebuilt(burst_trie.numbered_turns(empty))).collect() == []
    # conversations whose other has no turns and who lose all of their own
    rows = [(c, 0, "user", "a") for c in range(1, 5)]
    got = burst_trie.prefix_trie(burst_trie.rebuilt(burst_trie.numbered_turns(spark.createDataFrame(rows, schema))))
    assert found(got) == plain(rows)
    assert any(r[1] == 0 and r[7] != burst_trie.NO_ENDS for r in found(got))


def test_query(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    got = queries.op11_prefix_trie(spark, SF)
    want = con.sql(queries.oracle_sql()["op11_prefix_trie"])
    assert got.columns == want.columns
    assert found(got) == sorted(want.fetchall(), key=str)


def test_sql_on_odd_rows(table):
    rows, df = table
    con = duckdb.connect()
    conversations = df.select("conv_id", "turn", "role", "text").where("conv_id IS NULL OR conv_id < 2020").toPandas().astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    got = con.sql(queries.oracle_sql()["op11_prefix_trie"]).fetchall()
    assert sorted(got, key=str) == plain([r for r in rows if r[0] is None or r[0] < 2020])
