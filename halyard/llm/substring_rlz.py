"""Substring deduplication by relative Lempel-Ziv factors.

A window is ``window`` consecutive words of one text.  Each window is assigned
to its anchor, the seed (``SEED`` words) with the smallest hash among those
inside it, so equal windows have equal seeds at equal places.  Consecutive
windows of one anchor form a reference block; about one word in fourteen is an
anchor, so the index holds far fewer rows than there are windows.

* Blocks are indexed by seed and by the hash of the whole block.  A block that
  occurs twice has all its windows repeated, and is represented by its first
  occurrence, whatever the number of copies.
* Blocks that share a seed but differ (where a repeated passage begins or ends,
  or a near copy deviates) are compared window by window, one occurrence of each.
* A text is then factored greedily from left to right against the index: a
  factor runs on while the next window's reference is the next place of the same
  text, otherwise a new factor begins.

Greedy factors alone can't give the windows asked for: a window that crosses the
boundary of two factors, or one inside a factor that another reference would have
continued, repeats as well.  So the look-up of every window in the index decides which
words go, and factors are the short form in which the spans and their references are kept.

Counting aggregates before it shuffles, and joins are plain equi-joins that
adaptive execution can split, so a passage in a third of all texts costs rows in
proportion to its occurrences only.  Blocks and windows are equal if two hashes
of 64 bits are.

Defined cases: null and empty texts have no words; texts shorter than a window
lose nothing; windows that overlap their own repetition count; rows repeated as
a whole remove all their windows; ids may be null or repeat, as a text is known
by its id and its content; very long texts are read whole; extra columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import dropped, stored
from ._text import PLAIN_WORD, Slice, covered, find_words, mix, prefix_hash, slices, span_hash, windows, word_hashes

WINDOW, SEED = 35, 8
_PLACE = np.uint64(24)
_CHECK = 0xA24BAED4963EE407


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :])


def anchors(part: Slice, window: int = WINDOW, seed: int = SEED) -> dict[str, np.ndarray]:
    """Per reference block: its text, first window, number of windows, the seed's distance, and both hashes."""
    words = find_words(part, PLAIN_WORD)
    prefix = prefix_hash(word_hashes(part, words))
    at, doc = windows(words, window)
    if not len(at):
        none = np.zeros(0, np.int64)
        return {"text": none, "start": none, "n": none, "lead": none, "seed": none, "block": none}
    i = np.arange(len(prefix) - seed)
    hashes = span_hash(prefix, i, i + seed)
    # a slice may hold one text longer than 2**24 words: places count from the start of such a stretch
    rank = (hashes >> _PLACE << _PLACE) | (i.astype(np.uint64) & np.uint64((1 << 24) - 1))
    best = _sliding_min(rank, window - seed + 1)[at]
    place = (best & np.uint64((1 << 24) - 1)).astype(np.int64)
    place += (at - place + (1 << 24) - 1 >> 24) << 24
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])
    start, last, place = at[first], at[np.r_[first[1:], len(at)] - 1], place[first]
    lead = place - start
    return {"text": doc[first], "start": start - words.bounds[doc[first]], "n": last - start + 1, "lead": lead, "seed": hashes[place].view(np.int64), "block": mix(span_hash(prefix, start, last + window) + lead.astype(np.uint64)).view(np.int64)}


def _index_rows(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(2)):
                found = anchors(part, window, seed)
                who = pa.array(found["text"] + part.first)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(who), batch.column(1).take(who), *(pa.array(found[n].astype(t)) for n, t in (("start", np.int32), ("n", np.int32), ("lead", np.int32), ("seed", np.int64), ("block", np.int64)))], ["id", "content", "start", "n", "lead", "seed", "block"])

    return run


def _window_rows(window: int):
    """Of the listed blocks of each text: a row per window, with a hash of its words, seed and place of the seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column(3)
            for part in slices(batch.column(2)):
                words = find_words(part, PLAIN_WORD)
                hashes = word_hashes(part, words)
                prefix, again = prefix_hash(hashes), prefix_hash(mix(hashes ^ np.uint64(_CHECK)), _CHECK)
                own = blocks.slice(part.first, len(part))
                flat, counts = own.flatten(), np.array(own.value_lengths())
                if not len(flat):
                    continue
                start, n, lead, seed, copies = (flat.field(c).to_numpy() for c in ("start", "n", "lead", "seed", "copies"))
                text = np.repeat(np.arange(len(part)), counts)
                which = np.repeat(np.arange(len(n)), n)
                step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                at = words.bounds[text[which]] + start[which] + step
                shift = lead[which] - step
                key = mix(span_hash(prefix, at, at + window) ^ mix(seed[which].astype(np.uint64) + shift.astype(np.uint64)))
                check = span_hash(again, at, at + window, _CHECK)
                who = pa.array(text[which] + part.first)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(who), batch.column(1).take(who), pa.array((start[which] + step).astype(np.int32)), pa.array(key.view(np.int64)), pa.array(check.view(np.int64)), pa.array(copies[which])], ["id", "content", "start", "key", "check", "copies"])

    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("content"), F.col(text_col).alias("text"))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Runs of windows that also start elsewhere: id, content, start, n, ref_id, ref_start (the first occurrence)."""
    texts = _texts(docs, id_col, text_col)
    kind = texts.schema["id"].dataType.simpleString()
    index = stored(texts.mapInArrow(_index_rows(window, seed), f"id {kind}, content bigint, start int, n int, lead int, seed bigint, block bigint"), "rlz-index")
    # stored first, so that both sides of the join are plain exchanges, which adaptive execution splits where one seed is hot
    shared = stored(index.groupBy("seed").agg(F.count("*").alias("rows"), (F.min("block") != F.max("block")).alias("differ")).where("rows > 1").drop("rows"), "rlz-seeds")
    hits = stored(index.join(shared, "seed"), "rlz-hits")
    dropped(index, shared)
    first = F.min(F.struct("id", "content", "start"))
    blocks = stored(hits.groupBy("seed", "block").agg(F.count("*").alias("copies"), first.alias("ref"), F.first("n").alias("n"), F.first("lead").alias("lead"), F.first("differ").alias("differ")), "rlz-blocks")
    whole = hits.select("id", "content", "start", "n", "seed", "block").join(blocks.where("copies > 1").select("seed", "block", "ref"), ["seed", "block"])
    whole = whole.select("id", "content", "start", "n", F.col("ref.id").alias("ref_id"), F.col("ref.start").alias("ref_start"))

    wanted = blocks.where("differ").groupBy(F.col("ref.id").alias("id"), F.col("ref.content").alias("content")).agg(F.collect_list(F.struct(F.col("ref.start").alias("start"), "n", "lead", "seed", "copies")).alias("blocks"))
    same_text = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["content"] == b["content"])
    listed = texts.join(wanted.hint("shuffle_hash"), same_text(texts, wanted)).select(texts["id"], texts["content"], "text", "blocks")
    parts = stored(listed.mapInArrow(_window_rows(window), f"id {kind}, content bigint, start int, key bigint, check bigint, copies bigint"), "rlz-windows")
    again = stored(parts.groupBy("key", "check").agg(F.count("*").alias("n"), F.min(F.struct("id", "start")).alias("ref")).where("n > 1").select("key", "check", "ref"), "rlz-again")
    single = parts.where("copies = 1").join(again, ["key", "check"]).select("id", "content", "start", F.lit(1).alias("n"), F.col("ref.id").alias("ref_id"), F.col("ref.start").alias("ref_start"))
    return whole.unionByName(single)


def factor(runs: list[tuple[int, int, object, int]]) -> list[tuple[int, int, object, int]]:
    """Greedy parse: (first window, windows, ref id, ref start), each as long as its reference runs on."""
    out: list[list] = []
    for start, n, ref, at in sorted(runs, key=lambda r: (r[0], -r[1])):
        if out:
            p = out[-1]
            skip = max(0, p[0] + p[1] - start)
            if skip >= n:
                continue
            start, n, at = start + skip, n - skip, at + skip
            if start == p[0] + p[1] and ref == p[2] and at == p[3] + p[1]:
                p[1] += n
                continue
        out.append([start, n, ref, at])
    return [tuple(x) for x in out]


def duplicate_factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """One row per text with such: id, content, and factors, an array of (start, n, ref_id, ref_start), in windows."""
    rows = repeated_windows(docs, id_col, text_col, window, seed)
    kind = rows.schema["ref_id"].dataType.simpleString()
    names = ("start", "n", "ref_id", "ref_start")
    runs = rows.groupBy("id", "content").agg(F.collect_set(F.struct(*names)).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(2)
            out = [[dict(zip(names, f, strict=True)) for f in factor([tuple(r[c] for c in names) for r in runs])] for runs in own.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, own.type)], ["id", "content", "factors"])

    id_kind = rows.schema["id"].dataType.simpleString()
    return runs.mapInArrow(run, f"id {id_kind}, content bigint, factors array<struct<start:int,n:int,ref_id:{kind},ref_start:int>>")


def _cut(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests, kept_texts = [], [], [], []
            factors = batch.column(2)
            for part in slices(batch.column(1)):
                words = find_words(part, PLAIN_WORD)
                own = factors.slice(part.first, len(part)).fill_null([])
                flat, counts = own.flatten(), np.array(own.value_lengths())
                text = np.repeat(np.arange(len(part)), counts)
                gone = covered(len(words.start), words.bounds[text] + flat.field("start").to_numpy(), flat.field("n").to_numpy() + window - 1)
                raw = part.data.tobytes()
                start, end, keep = words.start.tolist(), words.end.tolist(), ~gone
                for i in range(len(part)):
                    a, b = int(words.bounds[i]), int(words.bounds[i + 1])
                    kept = b" ".join(raw[start[j] : end[j]] for j in (np.flatnonzero(keep[a:b]) + a).tolist())
                    n_words.append(b - a)
                    n_removed.append(int(gone[a:b].sum()))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    kept_texts.append(kept.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests), pa.array(kept_texts, pa.string())], ["id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def remove_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED, with_text: bool = True) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 and kept_text, without the words of repeated windows; kept_text only if asked for."""
    texts = _texts(docs, id_col, text_col)
    found = duplicate_factors(docs, id_col, text_col, window, seed)
    joined = texts.join(found.hint("shuffle_hash"), texts["id"].eqNullSafe(found["id"]) & (texts["content"] == found["content"]), "left").select(texts["id"], "text", "factors")
    kind = texts.schema["id"].dataType.simpleString()
    return joined.mapInArrow(_cut(window, with_text), f"id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string").withColumnRenamed("id", id_col)
