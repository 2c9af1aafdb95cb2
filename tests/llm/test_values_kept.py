"""Large ids through the archives, and callers' columns through mixing."""

from halyard.llm import warc
from halyard.llm._store import new_path

import corpus_pipeline

SF = "/root/testdata/sf0.001"
IDS = [(1 << 63) - 1, -(1 << 63), 10**18, -(10**18), 1 << 62, 999_999_999_999_999_999, 0, -1]


def test_page_ids_of_64_bits(spark):
    pages = spark.createDataFrame([(i, "u", f"<p>{k}</p>") for k, i in enumerate(IDS)] + [(5, "u", "<p>0</p>"), (6, "u", "<p>1</p>")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.through_warc(pages, min_revisit_bytes=0).collect()}
    want = {i: ("response", None) for i in IDS} | {5: ("revisit", IDS[0]), 6: ("response", None), IDS[1]: ("revisit", 6)}
    assert got == want


def test_names_beyond_64_bits_are_no_page():
    assert warc._page(b"<urn:page:9223372036854775807>") == IDS[0] and warc._page(b"<urn:page:-9223372036854775808>") == IDS[1]
    assert warc._page(b"<urn:page:9223372036854775808>") is None and warc._page(b"<urn:page:1x>") is None and warc._page(None) is None


def test_mixing_keeps_columns(spark):
    rows = [(i, f"text {i}", "web" if i % 3 else None, "mine", 77, f"k{i}") for i in range(60)]
    path = new_path(spark, "docs")
    spark.createDataFrame(rows, "doc_id long, text string, source string, copy string, N_Copies int, shuffle_key string").write.parquet(path)
    docs = spark.read.parquet(path)
    out = corpus_pipeline.mix(spark, docs, SF)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) > 20 and set(map(tuple, got)) <= set(rows)
