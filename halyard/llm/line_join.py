"""Line deduplication by an exact set-similarity join.

A line is the set of its words.  A line is removed if an earlier line of the
corpus, in order of id, content and line number, has a Jaccard similarity of
``similarity`` or more.

1. Word frequencies are counted over all texts, into ``BUCKETS`` hash buckets: a
   table of fixed size, which gives every word a rarity rank.
2. Equal sets are collapsed to the earliest line.  Of every distinct set, the
   words in order of rarity form its prefix: two sets as similar as asked share
   a word of their prefixes.
3. Sets that share a prefix word are candidates if their sizes (length filter),
   the places of the word (positional filter) and parity bitmaps of their words
   allow the similarity; these filters are conditions of the join itself.  The first
   pass compares every set with the earliest one of each word only, so a word shared
   by many near copies costs one row per copy; it takes the ``FIRST`` rarest words of the
   prefix, as it only spares the second pass work.  Its pairs are verified on all words.
4. The second pass compares the sets that are left with all earlier ones, by semi joins, which
   stop at the first match and list no pairs: which words of which sets have a candidate, which
   earlier sets are one of theirs, and, of these two alone and with all their words, which sets
   have an earlier one as similar as asked.

Words are found, hashed and ranked in numpy, for a slice of texts at once: the same
in DataFrame functions takes more CPU time, and more disk than allowed (README).  Everything
between, the joins and aggregations, is DataFrame operations.

Defined cases: null texts are empty; lines without words are kept; rows that repeat id and
text are one document, and get one result each; null ids come first; texts of any length are
read whole; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import dropped, stored
from ._text import PLAIN_WORD, Slice, find_words, mix, slices, word_hashes

SIMILARITY = 0.8
BUCKETS, SHELF = 1 << 20, 1 << 10
ROUNDS = 2
FIRST = 3
BITS = ("bits", "bits1", "bits2", "bits3")
_BUCKET = np.uint64(BUCKETS - 1)
_SALTS = np.random.default_rng(11).integers(1, 1 << 63, 2, dtype=np.uint64)


def _texts(docs: DataFrame, id_col: str, text_col: str, *names: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("content"), text.alias("text")).toDF(*names)


def line_words(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, the line of each (counted over the slice), and each text's first line (n + 1 values)."""
    words = find_words(part, PLAIN_WORD)
    breaks = np.flatnonzero(part.data == 10)
    before = np.searchsorted(breaks, part.offsets)
    bounds = before + np.arange(len(part) + 1)
    text = np.repeat(np.arange(len(part)), np.diff(words.bounds))
    return word_hashes(part, words), np.searchsorted(breaks, words.start) + text, bounds


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part in slices(batch.column(0)):
            total += np.bincount((word_hashes(part, find_words(part, PLAIN_WORD)) & _BUCKET).astype(np.int64), minlength=BUCKETS)
    shelves = total.reshape(-1, SHELF)
    full = np.flatnonzero(shelves.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([shelves[k].tobytes() for k in full], pa.binary())], ["shelf", "n"])


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shelf, counts) to a row per shelf with its ranks; a task holds one array of each of its shelves."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for shelf, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[shelf] = total.get(shelf, 0) + np.frombuffer(n, np.int64)
    ranks = [np.where(n > 0, np.floor(np.log2(np.maximum(n, 1)) * 4) + 1, 0).astype(np.uint8).tobytes() for n in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(ranks, pa.binary())], ["shelf", "r"])


def word_ranks(docs: DataFrame, text_col: str) -> np.ndarray:
    """BUCKETS ranks, low for rare words: a table of a megabyte, whatever the corpus."""
    counts = docs.select(text_col).mapInArrow(_count, "shelf int, n binary")
    table = counts.repartition("shelf").mapInArrow(_rank, "shelf int, r binary").toArrow()
    out = np.zeros(BUCKETS, np.uint64)
    for shelf, r in zip(table["shelf"].to_pylist(), table["r"].to_pylist(), strict=True):
        out[shelf * SHELF : (shelf + 1) * SHELF] = np.frombuffer(r, np.uint8)
    return out


def _set_rows(sent, similarity: float):
    """Rows (id, content, text) to a row per line: id, content, line, n words, hashes of the set, parity bits, prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = sent.value
        for batch in batches:
            for part in slices(batch.column(2)):
                h, line, bounds = line_words(part)
                code = (ranks[(h & _BUCKET).astype(np.int64)] << np.uint64(56)) | (h >> np.uint64(8))
                order = np.lexsort((code, line))
                code, line = code[order], line[order]
                new = np.r_[True, (code[1:] != code[:-1]) | (line[1:] != line[:-1])][: len(code)]
                code, line = code[new], line[new]
                lines = int(bounds[-1])
                n = np.bincount(line, minlength=lines)
                full = np.flatnonzero(n)
                start = (np.cumsum(n) - n)[full]
                k1, k2, *parity = (np.zeros(lines, np.uint64) for _ in range(6))
                if len(full):
                    for k, salt in zip((k1, k2), _SALTS, strict=True):
                        k[full] = mix(np.add.reduceat(mix(code ^ salt), start) + n[full].astype(np.uint64))
                    bit = np.uint64(1) << (code & np.uint64(63))
                    which = (code >> np.uint64(6)) & np.uint64(3)
                    for w, bits in enumerate(parity):
                        bits[full] = np.bitwise_xor.reduceat(np.where(which == w, bit, np.uint64(0)), start)
                size = np.where(n > 0, n - np.ceil(n * similarity - 1e-9).astype(np.int64) + 1, 0)
                ahead = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
                token = ((code >> np.uint64(20)) & np.uint64(0x7FFFFFFF)).astype(np.int32)[ahead < np.repeat(size, n)]
                prefix = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(token))
                text = np.repeat(np.arange(len(part)), np.diff(bounds))
                who = pa.array(text + part.first)
                number = np.arange(lines) - bounds[text]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(who), batch.column(1).take(who), pa.array(number.astype(np.int32)), pa.array(n.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (k1, k2, *parity)), prefix], ["id", "content", "line", "n", "k1", "k2", "bits", "bits1", "bits2", "bits3", "prefix"])

    return run


def _wanted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, lines, nodes) to (node, distinct word hashes)."""
    for batch in batches:
        for part in slices(batch.column(0)):
            h, line, bounds = line_words(part)
            lines, nodes = (batch.column(c).slice(part.first, len(part)) for c in (1, 2))
            at = lines.flatten().to_numpy() + np.repeat(bounds[:-1], np.array(lines.value_lengths()))
            first, past = np.searchsorted(line, at), np.searchsorted(line, at, "right")
            sets = [np.unique(h[a:b]).view(np.int64) for a, b in zip(first.tolist(), past.tolist(), strict=True)]
            edge = np.r_[0, np.cumsum([len(x) for x in sets])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([nodes.flatten(), pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))], ["node", "w"])


def _need(n: Column, m: Column, similarity: float) -> Column:
    """Words that sets of such sizes must share."""
    return F.ceil((n + m) * (similarity / (1 + similarity)) - 1e-9)


def _parity(n: Column, m: Column, bits: list[tuple[Column, Column]], similarity: float) -> Column:
    """The parity bitmaps differ in few enough bits: each word not in common shows in one at most."""
    return sum((F.bit_count(a.bitwiseXOR(b)) for a, b in bits), F.lit(0)) <= n + m - 2 * _need(n, m, similarity)


def _alike(n: Column, m: Column, p: Column, q: Column, bits: list[tuple[Column, Column]], similarity: float) -> Column:
    """What sets of n and m words that share a prefix word, at places p and q, need: the length, positional and parity filters."""
    ahead = F.least(p, q) + F.least(n - p, m - q) >= _need(n, m, similarity)
    return (m >= n * similarity - 1e-9) & (n >= m * similarity - 1e-9) & ahead & _parity(n, m, bits, similarity)


def _shape(n: Column, place: Column) -> Column:
    """Size and place of a word in one value."""
    return F.shiftleft(n.cast("long"), 32).bitwiseOR(place.cast("long")).alias("shape")


def _met(a: str, b: str, similarity: float) -> Column:
    """The same filters of two token rows."""
    n, m = (F.shiftright(f"{x}.shape", 32) for x in (a, b))
    p, q = (F.col(f"{x}.shape").bitwiseAND(F.lit(0xFFFFFFFF)) for x in (a, b))
    return _alike(n, m, p, q, [(F.col(f"{a}.{w}"), F.col(f"{b}.{w}")) for w in ("bits", "bits1")], similarity)


def _tokens(sets: DataFrame, key: str) -> DataFrame:
    """A row per prefix word: token, key, shape, bits, bits1."""
    return sets.select(key, "n", "bits", "bits1", F.posexplode("prefix").alias("place", "token")).select("token", key, _shape(F.col("n"), F.col("place")), "bits", "bits1")


def _words(docs: DataFrame, id_col: str, text_col: str, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """All words of the nodes: node, w."""
    place = sets.select("node", "id", "content", "line").join(nodes, "node")
    wanted = place.groupBy("id", "content").agg(F.collect_list(F.struct("line", "node")).alias("at"))
    texts = _texts(docs, id_col, text_col, "i", "c", "text")
    found = texts.join(wanted.hint("shuffle_hash"), texts["i"].eqNullSafe(wanted["id"]) & (texts["c"] == wanted["content"])).select("text", "at.line", "at.node")
    # stored, so that the joins with it are plain exchanges, which adaptive execution splits where one set has many pairs
    return stored(found.mapInArrow(_wanted_words, "node bigint, w array<bigint>").dropDuplicates(["node"]), "line-words")


def _same(v: Column, w: Column, similarity: float) -> Column:
    """The similarity itself."""
    common = F.size(F.array_intersect(v, w))
    return common >= similarity * (F.size(v) + F.size(w) - common) - 1e-9


def _verified(docs: DataFrame, id_col: str, text_col: str, sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Of candidate pairs (node, other): the nodes with a pair as similar as asked, by all bits and then by all words."""
    own = sets.select("node", F.struct("n", *BITS).alias("a"))
    pairs = stored(pairs.join(own, "node").join(own.toDF("other", "b"), "other").where(_parity(F.col("a.n"), F.col("b.n"), [(F.col(f"a.{w}"), F.col(f"b.{w}")) for w in BITS], similarity)).select("node", "other"), "line-pairs")
    words = _words(docs, id_col, text_col, sets, pairs.select("node").union(pairs.select("other")).distinct())
    same = stored(pairs.join(words.toDF("node", "w1"), "node").join(words.toDF("other", "w2"), "other").where(_same(F.col("w1"), F.col("w2"), similarity)).select("node").distinct(), "line-gone")
    dropped(words, pairs)
    return same


def _first_pass(docs: DataFrame, id_col: str, text_col: str, sets: DataFrame, similarity: float) -> DataFrame:
    """The nodes as similar as asked to the earliest set of one of their rarest words."""
    own = _tokens(sets.withColumn("prefix", F.slice("prefix", 1, FIRST)), "node")
    # the words in two sets or more, with the earliest of each
    heads = own.groupBy("token").agg(F.min("node").alias("head"), F.count("*").alias("c")).where("c > 1").select("token", "head")
    place = F.array_position("prefix", F.col("token")) - 1
    first = sets.select(F.col("node").alias("head"), "n", "bits", "bits1", "prefix")
    # stored, so that the join with it is of plain exchanges, which adaptive execution splits where a word is hot
    first = stored(heads.join(first, "head").select("token", "head", _shape(F.col("n"), place), "bits", "bits1"), "line-heads")
    met = own.alias("a").join(first.alias("b"), "token").where((F.col("a.node") > F.col("b.head")) & _met("a", "b", similarity))
    pairs = stored(met.select("a.node", F.col("b.head").alias("other")).distinct(), "line-pairs")
    gone = _verified(docs, id_col, text_col, sets, pairs, similarity)
    dropped(first, pairs)
    return gone


def _second_pass(docs: DataFrame, id_col: str, text_col: str, sets: DataFrame, gone: DataFrame, similarity: float) -> DataFrame:
    """The other nodes that are as similar as asked to any earlier set."""
    # a set that is gone asks no more: its key is negative; both sides of the join are one and the same exchange
    marked = sets.join(gone.withColumn("gone", F.lit(True)), "node", "left")
    asked = stored(marked.select(F.when(F.col("gone"), F.bitwise_not("node")).otherwise(F.col("node")).alias("key"), "n", "bits", "bits1", "prefix"), "line-asked")
    earlier = F.when(F.col("b.key") < 0, F.bitwise_not("b.key")).otherwise(F.col("b.key"))
    met = (F.col("a.token") == F.col("b.token")) & (F.col("a.key") > earlier) & _met("a", "b", similarity)
    asking, there = [], []
    # words are dealt in rounds, so that what is on disk at a time is a part of their rows
    for turn in range(ROUNDS):
        own = _tokens(asked, "key").where(F.pmod(F.xxhash64("token"), F.lit(ROUNDS)) == turn)
        asking.append(stored(own.alias("a").join(own.alias("b"), met, "left_semi"), "line-asking"))
        there.append(stored(own.alias("b").join(asking[-1].alias("a"), met, "left_semi").select("token", earlier.alias("node")), "line-there"))
    dropped(asked)
    asks, others = reduce(DataFrame.union, asking).select("token", F.col("key").alias("node")), reduce(DataFrame.union, there)
    words = _words(docs, id_col, text_col, sets, asks.select("node").union(others.select("node")).distinct())
    whole = stored(words.join(sets.select("node", "n", *BITS), "node"), "line-whole")
    dropped(words)
    alike = _parity(F.col("a.n"), F.col("b.n"), [(F.col(f"a.{w}"), F.col(f"b.{w}")) for w in BITS], similarity) & _same(F.col("a.w"), F.col("b.w"), similarity)
    pair = (F.col("a.token") == F.col("b.token")) & (F.col("a.node") > F.col("b.node")) & alike
    also = stored(asks.join(whole, "node").alias("a").join(others.join(whole, "node").alias("b"), pair, "left_semi").select("node").distinct(), "line-also")
    dropped(*asking, *there, whole)
    return also


def matched_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Every line of every distinct document: id, content, line, removed."""
    sent = docs.sparkSession.sparkContext.broadcast(word_ranks(docs, text_col))
    texts = _texts(docs, id_col, text_col, "id", "content", "text")
    kind = texts.schema["id"].dataType.simpleString()
    every = stored(texts.mapInArrow(_set_rows(sent, similarity), f"id {kind}, content bigint, line int, n int, k1 bigint, k2 bigint, bits bigint, bits1 bigint, bits2 bigint, bits3 bigint, prefix array<int>"), "lines")
    more = [*BITS, "prefix"]
    distinct = every.where("n > 0").groupBy("k1", "k2", "n").agg(F.min(F.struct("id", "content", "line")).alias("place"), F.first(F.struct(*more)).alias("own"))
    ordered = distinct.select("k1", "k2", "n", "place.*", "own.*").repartitionByRange("id", "content", "line").sortWithinPartitions("id", "content", "line")
    sets = stored(ordered.withColumn("node", F.monotonically_increasing_id()), "line-sets")

    gone = _first_pass(docs, id_col, text_col, sets, similarity)
    also = _second_pass(docs, id_col, text_col, sets, gone, similarity)
    removed = gone.union(also).withColumn("match", F.lit(True))
    marks = sets.select("k1", "k2", "n", F.struct("id", "content", "line").alias("first"), "node").join(removed, "node", "left").select("k1", "k2", "n", "first", F.coalesce("match", F.lit(False)).alias("match"))
    joined = every.select("id", "content", "line", "n", "k1", "k2").join(marks, ["k1", "k2", "n"], "left")
    is_first = F.struct("id", "content", "line").eqNullSafe(F.col("first"))
    return joined.select("id", "content", "line", F.when(F.col("n") == 0, False).otherwise(F.col("match") | ~is_first).alias("removed"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, lines to remove) to (id, lines, lines removed, the text without them)."""
    for batch in batches:
        n, removed, kept = [], [], []
        for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            lines, gone = text.split("\n"), set(gone or ())
            n.append(len(lines))
            removed.append(len(gone))
            kept.append("\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_lines", "n_removed", "kept_text"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Per row: id, n_lines, n_removed, kept_text: the lines that no earlier one matches."""
    flags = matched_lines(docs, id_col, text_col, similarity).where("removed").groupBy("id", "content").agg(F.collect_set("line").alias("gone"))
    texts = _texts(docs, id_col, text_col, "i", "c", "text")
    both = texts.join(flags.hint("shuffle_hash"), texts["i"].eqNullSafe(flags["id"]) & (texts["c"] == flags["content"]), "left").select("i", "text", "gone")
    kind = texts.schema["i"].dataType.simpleString()
    return both.mapInArrow(_kept, f"id {kind}, n_lines bigint, n_removed bigint, kept_text string").withColumnRenamed("id", id_col)
