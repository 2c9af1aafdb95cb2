"""Benchmark decontamination by a generalised suffix automaton.

The normalised words of all test items build one automaton per block of items.
Training texts stream through it; the automaton tells, word by word, the length
of the longest match that ends there, so a word lies inside an occurrence of a
window exactly where that length reaches the window.  Before that, numpy drops
every stretch of text whose word pairs don't occur in any item, as no match can
span such a place; only the few stretches left are streamed word by word.

An automaton is sent to the executors, so its size is bounded: items are cut
into blocks of at most ``block_words`` words, and texts meet the blocks in turn,
each block adding to the hits found so far.

Defined cases: null or empty texts have no words and no hits; an empty item
matches nothing; equal items with ids of their own all count, items of one id count once;
without items nothing is hit; input columns named like result columns are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ._store import stored, unclashed
from ._text import LOWER, NORMAL_WORD, Slice, find_words, prefix_hash, slices, span_hash, word_hashes

WINDOW = 10
BLOCK_WORDS = 500_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes(LOWER)


def normal_words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().translate(_LOWER))


class Automaton:
    """Suffix automaton of several word sequences, with the items that hold each window."""

    def __init__(self, items: list[list[bytes]], window: int = WINDOW):
        self.window = window
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for item in items for w in item))}
        coded = [[self.vocabulary[w] for w in item] for item in items]
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends = []
        for item in coded:
            at = 0
            for word in item:
                at = self._extend(at, word)
            ends.append(at)
        self._mark(coded, ends)
        self._prefilter(coded)

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, before: int, word: int, old: int) -> int:
        """The part of state old that is no longer than a step from before."""
        if self.length[old] == self.length[before] + 1:
            return old
        twin = self._new(self.length[before] + 1, dict(self.step[old]), self.link[old])
        self.link[old] = twin
        while before >= 0 and self.step[before].get(word) == old:
            self.step[before][word] = twin
            before = self.link[before]
        return twin

    def _extend(self, last: int, word: int) -> int:
        known = self.step[last].get(word)
        if known is not None:
            return self._split(last, word, known)
        new, at = self._new(self.length[last] + 1, {}, 0), last
        while at >= 0 and word not in self.step[at]:
            self.step[at][word] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, word, self.step[at][word])
        return new

    def _mark(self, coded: list[list[int]], ends: list[int]) -> None:
        """window_state: the ancestor whose strings include the last ``window`` words; held: its items."""
        n, self.held, self.short = len(self.link), {}, {}
        order = sorted(range(n), key=self.length.__getitem__)
        self.window_state, self.short_at = [-1] * n, [-1] * n
        for i, item in enumerate(coded):
            if 0 < len(item) < self.window:
                self.short.setdefault(ends[i], []).append(i)
        for s in order[1:]:
            up = self.link[s]
            if self.length[s] >= self.window:
                self.window_state[s] = s if self.length[up] < self.window else self.window_state[up]
            self.short_at[s] = s if s in self.short else self.short_at[up]
        for i, item in enumerate(coded):
            at = 0
            for word in item:
                at = self.step[at][word]
                if (w := self.window_state[at]) >= 0:
                    self.held.setdefault(w, set()).add(i)

    def _prefilter(self, coded: list[list[int]]) -> None:
        text = b" ".join(self.vocabulary)
        part = Slice(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 0)
        h = word_hashes(part, find_words(part, NORMAL_WORD))
        self.by_hash = np.argsort(h)
        self.hashes = h[self.by_hash]
        n = max(1, len(self.vocabulary))
        self.pairs = np.unique(np.array([a * n + b for item in coded for a, b in zip(item, item[1:], strict=False)], np.int64))
        self.short_hashes = {}
        for item in coded:
            if 0 < len(item) < self.window:
                p = prefix_hash(h[np.array(item)])
                self.short_hashes.setdefault(len(item), set()).add(int(span_hash(p, np.array([0]), np.array([len(item)]))[0]))

    def stretches(self, h: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
        """Word ranges outside of which nothing can match."""
        if not len(self.hashes) or not len(h):
            return []
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        code = np.where(self.hashes[at] == h, self.by_hash[at], -1)
        keep = np.zeros(len(h), bool)
        if len(self.pairs):
            pair = np.where((code[:-1] >= 0) & (code[1:] >= 0), code[:-1] * max(1, len(self.vocabulary)) + code[1:], -1)
            to = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            live = np.r_[self.pairs[to] == pair, False]
            live[bounds[1:-1][bounds[1:-1] > 0] - 1] = False
            edge = np.diff(np.r_[False, live].astype(np.int8))
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                if b - a + 1 >= self.window:
                    keep[a : b + 1] = True
        p = None
        for n, known in self.short_hashes.items():
            if len(h) < n:
                continue
            p = prefix_hash(h) if p is None else p
            i = np.arange(len(h) - n + 1)
            for a in i[np.isin(span_hash(p, i, i + n), np.array(sorted(known), np.uint64))].tolist():
                keep[a : a + n] = True
        edge = np.diff(np.r_[False, keep, False].astype(np.int8))
        return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))

    def stream(self, words: list[bytes]) -> Iterator[tuple[int, int, set[int]]]:
        """(first, past, items) of every occurrence of a window or of a whole short item."""
        at = length = 0
        for i, word in enumerate(words):
            code = self.vocabulary.get(word, -1)
            while at and code not in self.step[at]:
                at = self.link[at]
                length = self.length[at]
            if code in self.step[at]:
                at, length = self.step[at][code], length + 1
            else:
                at = length = 0
            if length >= self.window:
                yield i + 1 - self.window, i + 1, self.held[self.window_state[at]]
            s = self.short_at[at]
            while s > 0:
                if self.length[s] <= length:
                    yield i + 1 - self.length[s], i + 1, set(self.short[s])
                up = self.link[s]
                s = self.short_at[up] if up > 0 else -1


_FIELDS = [pa.field("n_words", pa.int64()), pa.field("hits", pa.list_(pa.int32())), pa.field("items", pa.list_(pa.string()))]


def _matches(automaton: Automaton, labels: list[str], column: pa.Array) -> pa.Array:
    n_words, hits, items = [], [], []
    for part in slices(column):
        data = LOWER[part.data]
        words = find_words(part, NORMAL_WORD, data)
        hit, found = [set() for _ in range(len(part))], [set() for _ in range(len(part))]
        raw = data.tobytes()
        for a, b in automaton.stretches(word_hashes(part, words, data), words.bounds):
            span = [raw[s:e] for s, e in zip(words.start[a:b].tolist(), words.end[a:b].tolist(), strict=True)]
            inner = words.bounds[(words.bounds > a) & (words.bounds < b)]
            cuts = [0, *sorted({int(c) - a for c in inner}), b - a]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                doc = int(np.searchsorted(words.bounds, a + lo, "right")) - 1
                base = a + lo - int(words.bounds[doc])
                for first, past, held in automaton.stream(span[lo:hi]):
                    hit[doc].update(range(base + first, base + past))
                    found[doc] |= held
        n_words += np.diff(words.bounds).tolist()
        hits += [sorted(x) for x in hit]
        items += [sorted({labels[i] for i in x}) for x in found]
    return pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip((n_words, hits, items), _FIELDS, strict=True)], fields=_FIELDS)


def _matcher(text: Column, sent) -> Column:
    """sent: the broadcast automaton and its items' labels."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield _matches(*sent.value, column)

    return arrow_udf(run, "struct<n_words:bigint,hits:array<int>,items:array<string>>")(text)


def item_blocks(items: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Blocks of items of at most so many words; only one block is on the driver at a time."""
    block, size = [], 0
    for item, text in items.select(item_col, text_col).toLocalIterator():
        words = normal_words(text)
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((item, words))
        size += len(words)
    if block:
        yield block


def match_items(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Adds n_words, hits (positions of words inside occurrences) and items (ids, as sorted strings)."""
    spark = docs.sparkSession
    df = unclashed(docs.withColumn("__text", F.col(text_col)), ["n_words", "hits", "items"])
    fresh = True
    for block in chain(item_blocks(items, item_col, item_text_col, block_words), [None]):
        if block is None and not fresh:
            break
        block = block or []
        sent = spark.sparkContext.broadcast((Automaton([words for _, words in block], window), ["" if i is None else str(i) for i, _ in block]))
        df = df.withColumn("__m", _matcher(F.col("__text"), sent))
        if fresh:
            df = df.select("*", "__m.n_words", "__m.hits", "__m.items")
        else:
            # stored, so that plans don't grow with the items
            df = stored(df.withColumns({c: F.array_sort(F.array_union(c, f"__m.{c}")) for c in ("hits", "items")}).drop("__m"), "hits")
        df, fresh = df.drop("__m"), False
    return df.drop("__text")


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = WINDOW, max_coverage: float = 0.0, max_span: int | None = None, **names) -> DataFrame:
    """Keeps the rows of which at most a share max_coverage of the words lies inside items' windows.

    With ``max_span``, spans of more than so many words inside windows are cut out of the texts kept. By default a row
    with any hit goes as a whole.
    """
    packed = docs.select(F.struct("*").alias("__row"), F.col(text_col).alias("__in"))
    found = match_items(packed, items, "__in", window=window, **names)
    kept = found.where(F.size("hits") <= max_coverage * F.col("n_words"))
    if max_span is None:
        return kept.select("__row.*")
    text = F.when(F.size("hits") > max_span, _cutter(F.col("__in"), F.col("hits"), max_span)).otherwise(F.col("__in"))
    return kept.select("__row.*", text.alias("__cut")).withColumn(text_col, F.col("__cut")).drop("__cut")


def without_spans(text: str | None, hits: list[int], max_span: int = 0) -> str:
    """The text without runs of more than max_span hit words; what stands between kept words stays."""
    raw = (text or "").encode()
    gone, run = set(), []
    for h in [*sorted(hits), -1]:
        if run and h != run[-1] + 1:
            gone.update(run if len(run) > max_span else ())
            run = []
        run.append(h)
    out, last = [], 0
    for i, m in enumerate(_WORD.finditer(raw.translate(_LOWER))):
        if i in gone:
            out.append(raw[last : m.start()])
            last = m.end()
    return b"".join([*out, raw[last:]]).decode()


def _cutter(text: Column, hits: Column, max_span: int) -> Column:
    def cut(texts: pa.Array, places: pa.Array) -> pa.Array:
        return pa.array([without_spans(t, h or [], max_span) for t, h in zip(texts.to_pylist(), places.to_pylist(), strict=True)], pa.string())

    cut.__annotations__ = {"texts": pa.Array, "places": pa.Array, "return": pa.Array}
    return arrow_udf(cut, "string")(text, hits)


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)
