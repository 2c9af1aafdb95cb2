"""The corpus pipeline, stage by stage and as a whole, against plain versions."""

import hashlib
import math
import pathlib
import re
import zlib
from collections import Counter

import brute
import pytest

import corpus_pipeline
from halyard.llm import mixing, queries, repetition
from halyard.llm._store import new_path

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no tables")


def kept_by_rules(text):
    """The verdict, from the words and lines themselves."""
    t = text or ""
    x = brute.WORD.findall(t)
    chars = sum(map(len, x))
    if brute.quality([(0, t)])[0][-1]:
        return False
    for n, limit in repetition.NGRAM_LIMITS.items():
        grams = Counter(tuple(x[k : k + n]) for k in range(len(x) - n + 1))
        hit = {j for k in range(len(x) - n + 1) if grams[tuple(x[k : k + n])] > 1 for j in range(k, k + n)}
        if sum(len(x[j]) for j in hit) > limit * chars:
            return False
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(brute.WORD, line):
            dup += sum(map(len, brute.WORD.findall(line))) if line in seen else 0
            seen.add(line)
    return dup <= repetition.LINE_LIMIT * chars


def one_of_each(docs):
    classes = {r[0]: r[1] for r in brute.jaccard([(d["doc_id"], d["text"]) for d in docs])}
    seen, out = set(), []
    for d in docs:
        if classes[d["doc_id"]] == d["doc_id"] and d["doc_id"] not in seen:
            seen.add(d["doc_id"])
            out.append(d)
    return out


def digest(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16)


def mixed(docs):
    sizes = Counter(d["source"] for d in docs)
    weight = {s: n**corpus_pipeline.TEMPER for s, n in sizes.items()}
    out = []
    for d in docs:
        rate = weight[d["source"]] / sum(weight.values()) * len(docs) / sizes[d["source"]]
        draws = max(1, math.ceil(rate / mixing.STEP))
        out += [d] * sum(brute.poisson(digest(mixing.SEED, k, d["doc_id"]) / (1 << 52), rate / draws) for k in range(1, draws + 1))
    return out


def token_rows(docs):
    from tokenizers import Tokenizer

    to, copies, rows, start = Tokenizer.from_file(queries.tokenizer_path()), Counter(), [], 0
    for d in docs:
        copies[d["doc_id"]] += 1
        rows.append((digest(mixing.SEED, "order", copies[d["doc_id"]], d["doc_id"]), d))
    out = []
    for _, d in sorted(rows, key=lambda r: r[0]):
        ids = [*to.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        out.append((d["doc_id"], start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


@pytest.fixture(scope="module")
def table(spark):
    """The documents and odd rows: null and empty texts, repeated rows, an extra column named like a result."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    least = max(r["doc_id"] for r in rows) + 1
    long = " ".join(f"word{i}" for i in range(30_000))
    more = [rows[3], rows[3], *({**rows[0], "doc_id": least + i, "text": t, "source": s} for i, (t, s) in enumerate([(None, None), ("", "web"), (long, None), ("short text", "web")]))]
    path = new_path(spark, "docs")
    spark.createDataFrame([(*(r[c] for c in docs.columns), i) for i, r in enumerate([*rows, *more])], ", ".join(f"{n} {t}" for n, t in [*docs.dtypes, ("n_copies", "int")])).coalesce(3).write.parquet(path)
    return spark.read.parquet(path)


def plain(df):
    return [r.asDict() for r in df.orderBy("doc_id").collect()]


def key(rows):
    return sorted((r["doc_id"], r["text"] or "", str(r["source"])) for r in rows)


def test_stages(spark, table):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    versions = {
        "quality_rules": lambda docs: [d for d in docs if kept_by_rules(d["text"])],
        "jaccard_join": one_of_each,
        "decontamination": lambda docs: [d for d, r in zip(docs, brute.contamination([(d["doc_id"], d["text"]) for d in docs], items), strict=True) if not r[5]],
        "mixing": mixed,
    }
    docs = table
    for name, stage in corpus_pipeline.STAGES:
        before = plain(docs)
        out = stage(spark, docs, SF)
        if name not in versions:
            assert sorted(map(tuple, out.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == sorted(token_rows(before))
            break
        assert out.columns == table.columns
        path = new_path(spark, name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert key(plain(docs)) == key(versions[name](before)), name
        assert docs.count()


def test_run(spark, table):
    got = corpus_pipeline.run(spark, SF)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = one_of_each([d for d in plain(spark.read.parquet(f"{SF}/documents.parquet")) if kept_by_rules(d["text"])])
    docs = [d for d, r in zip(docs, brute.contamination([(d["doc_id"], d["text"]) for d in docs], items), strict=True) if not r[5]]
    assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == sorted(token_rows(mixed(docs)))


def test_empty_table(spark, table):
    docs = table.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0, name
