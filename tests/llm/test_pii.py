"""Personal data: against plain regular expressions, the query's SQL and planted cases."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from halyard.llm import pii, queries

rng = random.Random(13)
SF = "/root/testdata/sf0.001"
PLANTED = [
    "a@b.cx%y@d.e, 1.2.3.4.5.6.7.8", None, "", " \n", "a@b.c@d.e a@b. @x.y a@-.-.-", "é\U0001F600a@b.c\n5\n212 555 1234",
    "00300.1.2.3 0000.0.0.0 256.1.1.1 007.255.255.00255 1.2.3 1.2.3.4. 1..2.3.4 9" + "9" * 40 + ".1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 0000000000000000 411111111111 1 - 2 4111  1111", "49927398716 79927398713 5 " + "4" * 500,
    "+1 (988) 555-2485 +12 3 +1 2345678 +123456789 ++1 234 567 89 +1(2)3.4-5 6 7 8 9 0 1 2 3 4 5 6 +", "tel (212) 555-1234, and then further on (212) 555-1234 stands alone among other words, phone: 212.555.1234x",
    "IBAN GB82 WEST 1234 5698 7654 32 IS MY, GB82WEST12345698765432 GB82WEST12345698765433 DE89370400440532013000 XX82WEST12345698765432 aGB82WEST12345698765432",
    "ssn 123-45-6789 SSN: 000-12-3456, 123-45-6789 far from a word " + "x " * 40 + " 219-09-9999 social security\n666-12-1234 ssn 1123-45-6789", "5" * 3000 + " " + "a" * 50_000 + " z@y.x",
]
ALPHABET = ["1", "23", "4111111111111111", " ", "-", ".", "+", "(", ")", "a", "b@c.d", "@", "x.y", "\n", "é", "\U0001F600", "GB82WEST12345698765432", " tel ", " ssn ", "123-45-6789", "255", "%"]
TEXTS = PLANTED + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1, 60))) for _ in range(300)] + PLANTED[:3]
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                found.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(found)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, i % 3, "own") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_email int, findings string").repartition(4)


def test_base_spans(docs):
    for r in pii.pii_digests(pii.find_pii(docs)).collect():
        want = base_spans(TEXTS[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (TEXTS[r["doc_id"]], want, r["spans"])
        assert [r[f"n_{k}"] for k in BASE] == [sum(x.startswith(k + ":") for x in want) for k in BASE]
        assert set(want) <= set(r["spans"].split(","))


def test_sql_agrees(docs):
    con = duckdb.connect()
    documents = docs.select("doc_id", "text").toPandas()  # noqa: F841
    want = sorted(con.sql(pii.oracle_sql()).fetchall())
    assert sorted(tuple(r) for r in pii.pii_digests(pii.find_pii(docs)).collect()) == want


def test_added_kinds(docs):
    found = {r["doc_id"]: [TEXTS[r["doc_id"]][f["start"] : f["end"]] for f in r["findings"] if not f["base"]] for r in pii.find_pii(docs).collect()}
    assert found[10] == ["(212) 555-1234"]
    assert found[11] == ["GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432", "DE89370400440532013000"]
    assert found[12] == ["123-45-6789", "219-09-9999"]
    assert found[9] == []


def test_columns_stay(docs):
    out = pii.find_pii(docs)
    assert out.columns == ["doc_id", "text", "n_email", "findings"] and out.where("n_email <> doc_id % 3").count() == 0
    clean = out.where(F.size("findings") == 0)
    assert clean.count() > 0 and out.count() == len(TEXTS)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.pii_digests(pii.find_pii(none)).count() == 0


def test_many_matches_in_one_text(spark):
    text = " ".join(f"{i % 256}.1.2.{i % 300}" for i in range(4000))
    got = pii.pii_digests(pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert got["spans"] == ",".join(base_spans(text))


def test_query(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = sorted(tuple(r) for r in queries.op13_pii(spark, SF).collect())
    assert got == sorted(con.sql(queries.oracle_sql()["op13_pii"]).fetchall())
    assert sum(r[1] + r[2] + r[3] + r[4] > 0 for r in got) > 5


def test_native(docs):
    assert "Python" not in pii.find_pii(docs)._jdf.queryExecution().executedPlan().toString()
