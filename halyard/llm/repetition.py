"""Quality rules by repetition coverage.

Every text is read as words (runs of anything but ASCII white space) and lines.
Rolling hashes of several n-gram lengths, all computed in numpy for a slice of
texts at once, show which n-grams occur twice or more in one text; the measure
is the share of the text's word characters inside such n-grams, and inside
lines that repeat an earlier line.  Work and memory are linear in the text, rows
are independent, so Spark needs no shuffle.

Defined cases: a null or empty text has no words, all counts 0, and fails the
base rule; repeated rows get equal results; an input column named like a result
column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ._store import unclashed
from ._text import PLAIN_WORD, byte_class, covered, find_words, hash_spans, per_text, prefix_hash, slices, span_hash, windows, word_hashes

#: Largest share of word characters inside repeated n-grams of each length, and inside repeated lines. The words of
#: a repeated n-gram lie inside shorter repeated ones, so the limits must fall with length or the longer ones are idle.
#: The one of 5-grams is loose for the sake of short headings and closing lines.
NGRAM_LIMITS = {5: 0.20, 7: 0.15, 10: 0.10}
LINE_LIMIT = 0.20
MIN_WORDS, BASE_WINDOW, BASE_PERCENT = 10, 5, 20
SYMBOLS = byte_class(*[(ord(c), ord(c)) for c in "#*$%&|<>"])
_START_OF_POINT = ~byte_class((0x80, 0xBF))

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars"]


def repeated(values: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of values within texts: which occur twice or more, and which equal an earlier one. doc ascends."""
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    same = (v[1:] == v[:-1]) & (d[1:] == d[:-1])
    twice, later = np.zeros(len(v), bool), np.zeros(len(v), bool)
    twice[order[1:]] = same
    later[order[1:]] = same  # lexsort is stable: an equal, earlier one stands before
    twice[order[:-1]] |= same
    return twice, later


def measure(part, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    data, words = part.data, find_words(part, PLAIN_WORD)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_START_OF_POINT[data], out=points[1:])
    chars = points[words.end] - points[words.start]
    out = {"n_words": np.diff(words.bounds), "word_chars": per_text(words.bounds, chars), "n_symbols": per_text(part.offsets, SYMBOLS[data])}

    breaks = np.flatnonzero(data == 10)
    # an empty text shares its offset with its successor: count lines per text instead
    n_lines = np.searchsorted(breaks, part.offsets[1:]) - np.searchsorted(breaks, part.offsets[:-1]) + 1
    doc = np.repeat(np.arange(len(part)), n_lines)
    begin = np.cumsum(n_lines) - n_lines
    start = np.empty(n_lines.sum(), np.int64)
    start[begin] = part.offsets[:-1]
    inner = np.ones(len(start), bool)
    inner[begin] = False
    start[inner] = breaks + 1
    end = np.empty(len(start), np.int64)
    end[begin + n_lines - 1] = part.offsets[1:]
    inner[:] = True
    inner[begin + n_lines - 1] = False
    end[inner] = breaks
    first, past = np.searchsorted(words.start, start), np.searchsorted(words.start, end)
    line = np.flatnonzero(past > first)
    _, later = repeated(hash_spans(data, start[line], end[line]), doc[line])
    out["n_dup_lines"] = np.bincount(doc[line[later]], minlength=len(part))
    total = np.zeros(len(chars) + 1, np.int64)
    np.cumsum(chars, out=total[1:])
    twin = line[later]
    out["dup_line_chars"] = np.bincount(doc[twin], total[past[twin]] - total[first[twin]], len(part)).astype(np.int64)

    prefix = prefix_hash(word_hashes(part, words))
    for n in lengths:
        at, doc = windows(words, n)
        twice, _ = repeated(span_hash(prefix, at, at + n), doc)
        hit = covered(len(chars), at[twice], n)
        out[f"dup_{n}gram_chars"] = per_text(words.bounds, chars * hit)
        if n == BASE_WINDOW:
            out["n_repeat_words"] = per_text(words.bounds, hit)
    return out


def repetition(text: Column, lengths: tuple[int, ...] = tuple(NGRAM_LIMITS)) -> Column:
    """A struct of counts: COUNTS and, for each n, dup_<n>gram_chars."""
    names = [*COUNTS, *(f"dup_{n}gram_chars" for n in lengths)]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            parts = [measure(part, lengths) for part in slices(column)]
            yield pa.StructArray.from_arrays([pa.array(np.concatenate([p[n] for p in parts]) if parts else [], pa.int64()) for n in names], names)

    return arrow_udf(run, "struct<" + ",".join(f"{n}:bigint" for n in names) + ">")(text)


def quality_rules(docs: DataFrame, text_col: str = "text", ngram_limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """Adds the counts, base_failed and kept to every row."""
    limits = {BASE_WINDOW: 1.0} | (NGRAM_LIMITS if ngram_limits is None else ngram_limits)
    names = [*COUNTS, *(f"dup_{n}gram_chars" for n in limits)]
    text = "__text"
    df = docs.withColumn(text, F.col(text_col))
    df = unclashed(df, [*names, "base_failed", "kept", "__r"]).withColumn("__r", repetition(F.col(text), tuple(limits)))
    df = df.select("*", *[F.col(f"__r.{n}").alias(n) for n in names]).drop("__r", text)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_PERCENT * F.col("n_words"))
    fine = F.col("dup_line_chars") <= line_limit * F.col("word_chars")
    for n, most in limits.items():
        fine &= F.col(f"dup_{n}gram_chars") <= most * F.col("word_chars")
    return df.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & fine)


def kept_by_rules(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The rows that the rules keep, unchanged."""
    packed = docs.select(F.struct("*").alias("__row"), F.col(text_col).alias("__in"))
    return quality_rules(packed, "__in", **limits).where("kept").select("__row.*")
