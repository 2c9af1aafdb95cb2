"""The corpus operators against plain versions, on small tables with odd rows."""

import math
import pathlib
import random
import textwrap

import brute
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from halyard.llm import chat, decontaminate, jaccard_forest, licenses, line_join, mixing, queries, repetition, substring_rlz, token_store, warc
from halyard.llm._store import new_path, stored

SF = "/root/testdata/sf0.001"
rng = random.Random(3)
VOCABULARY = ["ab", "Cd", "ef'", "gh,", "né", "naïve", "x1", "日本", "#tag", "<b>", "zz", "qq"] + [f"w{i}" for i in range(300)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


PASSAGE = prose(60)
LONG = prose(30_000)


def changed(text, k):
    words = text.split(" ")
    for _ in range(k):
        words[rng.randrange(len(words))] = f"new{rng.randrange(999)}"
    return " ".join(words)


BASE = prose(120)
TEXTS = [None, "", " \t\n", "one", "one two\nthree\n\none two\n one two", "x " * 90, "\n".join([prose(8)] * 5 + [prose(12)]), PASSAGE, prose(20) + " " + PASSAGE + "\n" + prose(40), prose(5) + "\n" + PASSAGE, LONG, LONG, changed(LONG, 200), BASE, BASE, changed(BASE, 2), changed(BASE, 3), changed(BASE, 60), "a\rb\x0bc\x0cd  e f g", "\x1c \x85 tail ", "</s> <|endoftext|> \\ <|turn|>", "ß İ ẞ ǅ", *[prose(rng.randrange(1, 200)) for _ in range(25)]]
DOCS = [(i * 3, t) for i, t in enumerate(TEXTS)]
ITEMS = [(0, PASSAGE.upper()), (1, prose(15)), (2, "one"), (3, "one two"), (4, None), (5, ""), (6, " ".join(BASE.split()[10:24])), (7, " ".join(BASE.split()[10:24]))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 3}" if i % 4 else None, len(t or ""), 1, True, 2.0) for i, t in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, n_words int, kept boolean, PART double").repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, n_chars long")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_substring(docs):
    got = substring_rlz.remove_repeated_spans(docs)
    assert rows(got.select("doc_id", "n_words", "n_removed", "kept_sha256")) == sorted(brute.substring(DOCS))
    assert {r["kept_text"] for r in got.where("doc_id = 30").collect()} == {""}


def test_substring_repeated_rows_and_ids(spark):
    text = prose(50)
    pairs = [(1, text), (1, text), (1, prose(50)), (None, prose(40))]
    got = substring_rlz.remove_repeated_spans(spark.createDataFrame(pairs, "doc_id long, text string"))
    assert sorted(r["n_removed"] for r in got.collect()) == [0, 0, 50, 50]


@pytest.mark.parametrize("window,seed", [(5, 3), (9, 4)])
def test_substring_small_windows(spark, window, seed):
    few = ["a", "b", "c"]
    pairs = [(i, " ".join(rng.choice(few) for _ in range(40))) for i in range(12)]
    got = substring_rlz.remove_repeated_spans(spark.createDataFrame(pairs, "doc_id long, text string"), window=window, seed=seed)
    assert rows(got.select("doc_id", "n_words", "n_removed", "kept_sha256")) == sorted(brute.substring(pairs, window))


def test_factor():
    assert substring_rlz.factor([(0, 3, "a", 5), (3, 2, "a", 8), (5, 1, "b", 0), (9, 1, "a", 1)]) == [(0, 5, "a", 5), (5, 1, "b", 0), (9, 1, "a", 1)]


@pytest.mark.parametrize("block_words", [10, 500_000])
def test_decontamination(spark, docs, block_words):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.match_items(docs.select("doc_id", "text"), items, block_words=block_words)
    got = got.select("doc_id", "n_words", F.size("hits"), F.size("items"), decontaminate.items_digest(F.col("items")), F.size("hits") > 0)
    assert rows(got) == sorted(brute.contamination(DOCS, ITEMS))


def test_decontamination_keeps_clean_rows(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    dirty = {r[0] for r in brute.contamination(DOCS, ITEMS) if r[5]}
    got = decontaminate.decontaminate(docs, items)
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect()} == {i for i, _ in DOCS} - dirty
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == len(DOCS)


def test_spans_are_cut():
    assert decontaminate.without_spans("Ab, cd! ef", [1]) == "Ab, ! ef"


def test_span_limits(spark):
    items = spark.createDataFrame([(5, prose(12)), (5, "zz9 zz8"), (6, PASSAGE)], "item_id long, text string")
    texts = [(1, "zz9 zz8 a b c d"), (2, prose(5) + " " + PASSAGE + " tail"), (3, "clean"), (4, None)]
    df = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, hits int")
    for block in (3, 500_000):
        found = decontaminate.match_items(df, items.union(items.limit(1)), block_words=block)
        assert {r["doc_id"]: r["items"] for r in found.collect()} == {1: ["5"], 2: ["6"], 3: [], 4: []}
    got = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(df, items, max_coverage=1.0, max_span=5).collect()}
    assert got[1] == texts[0][1] and got[2].endswith(" tail") and len(got[2].split()) == 6 and got[3] == "clean" and got[4] is None
    assert {r["doc_id"] for r in decontaminate.decontaminate(df, items, max_coverage=0.5, max_span=5).collect()} == {1, 3, 4}


def test_lines(spark):
    base = [prose(12) for _ in range(6)]
    texts = ["\n".join(rng.choice([b, changed(b, 1), changed(b, 2), changed(b, 4), b.lower(), ""]) for b in rng.choices(base, k=6)) for _ in range(30)] + [None, "", "a\na", "a b c d\na b c d e", " \r\n"]
    pairs = list(enumerate(texts))
    got = line_join.dedup_lines(spark.createDataFrame(pairs, "doc_id long, text string"))
    assert rows(got.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256))) == sorted(brute.lines(pairs))


def test_lines_of_odd_texts(docs):
    got = line_join.dedup_lines(docs)
    assert rows(got.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256))) == sorted(brute.lines(DOCS))


def test_lines_of_many_near_copies(spark, monkeypatch):
    """Near copies of one another, none of the earliest line that has their words: work tables hold rows by word, not by pair."""
    base = [f"b{i}" for i in range(40)]
    # the first line has the rarer words of all, but not enough; the others come often, so they are in no prefix
    texts = [" ".join(base[:31])] + [" ".join(f"u{n}x{i}" if i in (n % 40, (n * 7 + 1) % 40) else w for i, w in enumerate(base)) for n in range(150)] + [" ".join(base[31:])] * 300
    pairs, held = list(enumerate(texts)), []

    def counted(df, name):
        out = stored(df, name)
        held.append((out.count(), name))
        return out

    monkeypatch.setattr(line_join, "stored", counted)
    got = line_join.dedup_lines(spark.createDataFrame(pairs, "doc_id long, text string"))
    assert rows(got.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256))) == sorted(brute.lines(pairs))
    # 11,175 pairs; a prefix has 9 words, 12 at most
    assert held and max(n for n, name in held if name != "lines") <= 152 * 12


def test_lines_parted_by_any_space(spark):
    got = line_join.dedup_lines(spark.createDataFrame([(1, "a b\tc\vd\fe\r\na b c d e\n\n"), (2, "a b c d e f")], "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, 4, 1, "a b\tc\vd\fe\r\n\n"), (2, 1, 1, "")]


def test_lines_with_repeated_and_null_ids(spark):
    data = [(2, "a b c d e\nx y"), (2, "a b c d e\nx y"), (None, "x y\nq"), (2, "q\nz"), (1, "z w\na b c d e f")]
    got = line_join.dedup_lines(spark.createDataFrame(data, "doc_id long, text string").withColumn("line", F.lit(1)).withColumn("Node", F.lit("n")))
    want = [(None, 2, 0, "x y\nq"), (1, 2, 0, "z w\na b c d e f"), (2, 2, 1, "z"), (2, 2, 2, ""), (2, 2, 2, "")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_tokens(docs):
    path = queries.tokenizer_path()
    got = token_store.token_output(docs, path)
    assert rows(got.select("doc_id", "start", "n_tokens", "ids_crc32")) == sorted(brute.tokens(DOCS, path))


def test_token_files(spark, docs):
    path = new_path(spark, "t")
    token_store.write_tokens(docs, path, queries.tokenizer_path())
    back = token_store.read_tokens(spark, path)
    assert {"source", "n_chars", "kept", "tokens", "start"} <= set(back.columns)
    name = next(f for f in back.inputFiles() if f.endswith(".parquet")).removeprefix("file://")
    group = pq.ParquetFile(name).metadata.row_group(0)
    column = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in column["doc_id"].encodings
    assert column["tokens.list.element"].has_dictionary_page
    assert all(c.has_offset_index for c in column.values())


def test_jaccard(docs):
    got = jaccard_forest.jaccard_classes(docs)
    assert rows(got) == sorted(brute.jaccard(DOCS))


def test_jaccard_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_forest, "BLOCK_SETS", 7)
    base = prose(150)
    pairs = [(i, changed(base, 1 + i % 4)) for i in range(60)] + [(100 + i, prose(60)) for i in range(5)]
    got = jaccard_forest.jaccard_classes(spark.createDataFrame(pairs, "doc_id long, text string"))
    assert rows(got) == sorted(brute.jaccard(pairs))


def test_one_of_each(spark, docs):
    kept = jaccard_forest.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in brute.jaccard(DOCS) if r[0] == r[1]}


def test_one_of_each_with_repeated_and_null_ids(spark):
    one, other = prose(120), prose(120)
    data = [(7, other), (7, changed(one, 1)), (None, changed(one, 1)), (5, one), (5, other), (None, prose(90)), (None, ""), (8, None)]
    kept = jaccard_forest.one_of_each(spark.createDataFrame(data, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([data[3], data[4], data[5], data[7]], key=str)


def test_depth_follows_the_target():
    depth = jaccard_forest.prefix_depth()
    assert jaccard_forest.found_chance(0.8, depth) >= jaccard_forest.RECALL
    assert jaccard_forest.prefix_depth(recall=0.5) == jaccard_forest.MAX_DEPTH


def test_prefixes_are_shortened_where_links_are_weak(spark, monkeypatch):
    seen = []
    verify = jaccard_forest._verify
    monkeypatch.setattr(jaccard_forest, "_verify", lambda s, depth, trees: seen.append(depth) or verify(s, depth, trees))
    base = [f"w{i}" for i in range(400)]
    near = [(i, " ".join(f"x{i}_{k}" if k == 77 * i % 400 else w for k, w in enumerate(base))) for i in range(4)]
    jaccard_forest.jaccard_classes(spark.createDataFrame(near, "doc_id long, text string")).collect()
    assert seen == [8]  # links of about 0.97
    seen.clear()
    weak = [(i, " ".join(f"x{i}_{k}" if (k + 50 * i) % 100 == 7 else w for k, w in enumerate(base))) for i in range(2)]
    got = jaccard_forest.jaccard_classes(spark.createDataFrame(weak, "doc_id long, text string"), recall=0.9999)
    assert [r["class_id"] for r in got.collect()] == [0, 0]
    assert len(seen) > 1  # links of about 0.8


@pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no tables")
def test_recall_on_the_tables(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = {r[0]: r[1:] for r in brute.jaccard([tuple(r) for r in table.collect()])}
    got = {r[0]: tuple(r[1:]) for r in jaccard_forest.jaccard_classes(table).collect()}
    links = sum(v[1] for v in want.values())
    assert links and sum(min(got[i][1], v[1]) for i, v in want.items()) >= 0.99 * links
    assert sum(got[i][0] == v[0] for i, v in want.items()) >= 0.99 * len(want)
    assert all(got[i][1] <= v[1] and got[i][2] == v[2] for i, v in want.items())


def test_quality(docs):
    got = repetition.quality_rules(docs)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert rows(got.select(*names)) == sorted(brute.quality(DOCS))
    kept = {r["doc_id"] for r in got.where("kept").collect()}
    assert 39 in kept and 15 not in kept and 18 not in kept
    same = repetition.kept_by_rules(docs)
    assert same.columns == docs.columns and {r["doc_id"] for r in same.collect()} == kept


def test_long_ngrams_reject(spark):
    def text(n, total):
        """n words twice, among words that occur once: total words of five characters each."""
        words = [f"w{i:04}" for i in range(total - n)]
        return " ".join([*words, *words[:n]])

    short, seven, ten, few = text(5, 80), text(8, 100), text(10, 150), text(10, 220)  # shares: 0.125; 0.16; 0.133; 0.09
    got = repetition.quality_rules(spark.createDataFrame([(1, short), (2, seven), (3, ten), (4, few)], "doc_id long, text string"))
    assert rows(got.select("doc_id", "base_failed", "kept")) == [(1, False, True), (2, False, False), (3, False, False), (4, False, True)]
    assert rows(got.select("doc_id", "dup_7gram_chars", "dup_10gram_chars")) == [(1, 0, 0), (2, 80, 0), (3, 100, 100), (4, 100, 100)]


@pytest.mark.parametrize("least", [0, 3])
def test_warc(spark, least):
    magic = "<p>WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"
    pages = [(5, None), (3, ""), (1, "<p>é</p>"), (2, "<p>é</p>"), (9, "<p>é</p>"), (4, magic), (6, magic), (7, "WARC/1.1\r\n"), (8, "\r\n\r\n"), (10, "x" * 200_000), (11, "ab"), (12, "ab"), (2, "<p>é</p>")]
    df = spark.createDataFrame([(i, "http://a/\r\nb", h) for i, h in pages], "page_id long, url string, html string")
    assert rows(warc.through_warc(df, min_revisit_bytes=least).select("page_id", "payload_bytes", "payload_digest", "record_type", F.coalesce("refers_to", F.lit(-1)))) == sorted((*r[:4], -1 if r[4] is None else r[4]) for r in brute.warc(pages, least))


def test_warc_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500b")
    try:
        pages = [(i, ("WARC/1.1\r\n" if i % 7 == 0 else "y") * (i % 90)) for i in range(120)]
        df = spark.createDataFrame([(i, "u", h) for i, h in pages], "page_id long, url string, html string").coalesce(1)
        got = warc.through_warc(df)
        assert rows(got.select("page_id", "payload_bytes", "payload_digest")) == sorted(r[:3] for r in brute.warc(pages))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_warc_odd_tables(spark, monkeypatch):
    pages = [(i, "z" * (i % 4)) for i in range(20)] + [(99, "long " * 500_000)]
    df = spark.createDataFrame(pages, "page_id long, html string")
    expected = sorted((r[0], r[1], r[3]) for r in brute.warc(pages))
    clashing = df.withColumn("digest", F.lit("d")).withColumn("size", F.lit(-1)).withColumn("refers_to", F.lit(0)).withColumn("first", F.lit("f"))
    assert rows(warc.through_warc(clashing).select("page_id", "payload_bytes", "record_type")) == expected
    # more repeated payloads than are broadcast
    monkeypatch.setattr(warc, "FIRST_ROWS", 1)
    assert rows(warc.through_warc(df).select("page_id", "payload_bytes", "record_type")) == expected
    assert rows(warc.through_warc(df.limit(0))) == []


def test_mixing(spark):
    data = [(i, f"s{i % 3}" if i % 10 else None, f"text {i}") for i in range(900)] + [(None, "s0", "n"), (7, "s1", "text 7")]
    df = spark.createDataFrame(data, "doc_id long, source string, text string")
    got = mixing.replicate(df.withColumn("draws", F.lit(9)).withColumn("Cdf", F.lit("x")), {"s0": 5.0, None: 40.0}).drop("draws", "Cdf").collect()
    share = {s: sum(r["source"] == s for r in got) for s in ("s0", "s1", "s2", None)}
    for s, w in (("s0", 5), ("s1", 1), ("s2", 1), (None, 40)):
        expected = 902 * w / 47
        assert abs(share[s] - expected) < 6 * math.sqrt(expected)
    assert all(1 <= r["copy"] <= r["n_copies"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.replicate(df.repartition(3), {"s0": 5.0, None: 40.0}).collect()))


def test_mixing_splits_many_copies(spark):
    df = spark.createDataFrame([(i, "big", "t") for i in range(6000)] + [(-1, "rare", None)], "doc_id long, source string, text string")
    got = mixing.replicate(df).groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("doc_id", "copy").alias("d"), F.max("n_copies").alias("m")).collect()
    by = {r["source"]: r for r in got}
    assert by["rare"]["n"] == by["rare"]["d"] == by["rare"]["m"] and abs(by["rare"]["n"] - 3000.5) < 6 * 55
    assert by["big"]["n"] == by["big"]["d"]
    keys = [r[0] for r in mixing.replicate(df).select("shuffle_key").collect()]
    assert keys == sorted(keys)


def test_poisson_inversion(spark):
    table = mixing.rates(spark.createDataFrame([("a",)] * 3 + [("b",)], "source string"), None)
    for r in table.collect():
        for u in (0.0, 0.1, 0.5, 0.9, 0.999999):
            assert sum(c <= u for c in r["cdf"]) == brute.poisson(u, r["rate"] / r["draws"])


def test_licenses(spark):
    mit = licenses.KNOWN["MIT"]
    odd = "Copyright (c) 2020 Somebody\n\n" + mit.replace('"Software"', "“Software”").lower().replace("\n\n", "\n \n")
    data = [(1, mit), (2, odd), (3, mit + " more"), (4, None), (5, ""), (6, licenses.KNOWN["ISC"].replace("and/or", "and / or"))]
    got = licenses.scan_licenses(spark.createDataFrame(data, "doc_id long, text string"))
    assert {r["doc_id"]: r["license_id"] for r in got.collect()} == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 6: "ISC"}


TITLES = {"MIT": ["MIT License", "The MIT License (MIT)"], "MIT-0": ["MIT No Attribution"], "ISC": ["ISC License", "The ISC License"], "0BSD": ["Zero-Clause BSD", "BSD Zero Clause License"], "BSD-2-Clause": ["BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'], "BSD-3-Clause": ["BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'], "Zlib": ["zlib License"]}
HOLDERS = ["Copyright (c) 2020, Jane Doe", "Copyright 2019-2021 The Halyard Authors. All rights reserved.", "Copyright Halyard Contributors", "(c) 2001 Doe\nAll rights reserved.", "© 2015 Doe", "Copyright (c) <year> <owner>."]


def test_licenses_in_their_layouts(spark):
    texts, want = [], []
    for name, titles in TITLES.items():
        for width in (40, 56, 70, 72, 79):
            body = "\n\n".join(textwrap.fill(p, width) for p in licenses.KNOWN[name].split("\n\n"))
            plain = [body, *[f"{title}\n\n{holder}\n\n{body}\n" for title in titles for holder in HOLDERS], *[f"{holder}\n\n{body}" for holder in HOLDERS], f"{HOLDERS[0]}\n{titles[0]}\n\n{body}"]
            for text in [*plain, plain[1].replace("\n", "\r\n"), "/*\n" + "".join(f" * {row}\n" for row in plain[1].split("\n")) + " */\n"]:
                texts.append(text)
                want.append(name)
    full = {k: v for k, v in licenses.known_texts().items() if k not in licenses.KNOWN}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense", "CC0-1.0", "CC-BY-SA-4.0"} <= set(full)
    for name, text in full.items():
        for layout in (text, text.replace("\n", "\r\n"), "".join(f"# {row}\n" for row in text.split("\n")), text.upper()):
            texts.append(layout)
            want.append(name)
        texts += [text + " more", text[: len(text) // 2]]
        want += [None, None]
    # lines of a body that begin with the word stay, so other bodies stay different
    texts += ["copyright notice and this permission notice\nappear", "appear", "copyright holders be liable", "MIT License", ""]
    want += [None] * 5
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {r["doc_id"]: r for r in got}
    assert [(texts[i][:99], found[i]["license_id"], w) for i, w in enumerate(want) if found[i]["license_id"] != w] == []
    assert found[len(texts) - 5]["canonical_sha256"] != found[len(texts) - 4]["canonical_sha256"]


def test_chat_tree(spark):
    tree = [("c", 1, None, 0.0, "user", "hi <|turn|> \\<|"), ("c", 2, 1, 0.2, "assistant", "low"), ("c", 3, 1, 0.9, "assistant", "hé \\\\<\\|"), ("c", 4, 3, 0.5, "user", ""), ("c", 5, 4, 0.9, "assistant", "end"), ("d", 1, 9, 0.0, "assistant", "root"), (None, 1, None, 0.0, "user", "n"), ("e", 1, 2, 0.0, "user", "x"), ("e", 2, 1, 0.0, "user", "x")]
    messages = spark.createDataFrame(tree, "conv string, node long, parent long, score double, role string, text string")
    chats = chat.format_chats(messages)
    got = {r["conv"]: r for r in chats.select("conv", chat.parsed_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("l")).collect()}
    assert [tuple(x) for x in got["c"]["t"]] == [("user", "hi <|turn|> \\<|"), ("assistant", "hé \\\\<\\|"), ("user", ""), ("assistant", "end")]
    assert got["c"]["l"] == "hé \\\\<\\|end"
    assert set(got) == {"c", "d", None}
    assert chat.format_chats(messages, branches=2).where("conv = 'c'").count() == 2


def test_long_thread(spark):
    df = spark.createDataFrame([(1, t, "user" if t % 2 else "assistant", f"t{t}") for t in range(300)], "conv_id long, turn long, role string, text string")
    r = chat.through_format(chat.threads(df)).first()
    assert r["n_turns"] == 300 and r["turns_sha256"] == brute.sha("".join(f"{'user' if t % 2 else 'assistant'}\nt{t}\n" for t in range(300)))


def test_empty_tables(spark, none):
    items = spark.createDataFrame([], "item_id long, text string")
    assert substring_rlz.remove_repeated_spans(none).count() == 0
    assert decontaminate.match_items(none, items).count() == 0
    assert line_join.dedup_lines(none).count() == 0
    assert token_store.token_output(none, queries.tokenizer_path()).count() == 0
    assert jaccard_forest.jaccard_classes(none).count() == 0
    assert repetition.quality_rules(none).count() == 0
    assert mixing.replicate(none).count() == 0
    assert licenses.scan_licenses(none).count() == 0
    assert warc.through_warc(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert chat.through_format(chat.threads(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
