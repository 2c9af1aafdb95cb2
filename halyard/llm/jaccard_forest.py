"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Texts become sets of hashed ``N``-word shingles.  Equal sets are collapsed first
(their rows stay as members), so copies never meet each other.  Every distinct
set gets ``TREES`` MinHash signatures; a tree is a prefix trie over its
signatures, and two sets are candidates where they share a prefix in some tree.
Prefixes start at ``MAX_DEPTH``.  A link of similarity s is found at a depth with
the chance ``1 - (1 - s**depth)**trees``, so the verified links and their similarities
tell how many links there must be in all; while the found ones are less than the
target recall of those, the matched prefixes are shortened by a level and the search
goes on.  It ends at the latest where the target holds for a pair right at the threshold.

Candidates that hang together are verified together: components of the candidate
links are found from star links (a row per set and prefix, never all pairs), and
each component's shingle sets are compared exactly, all against all, inside
tasks (a matrix product over the shared shingles; a long chain of sets is compared in full, too).  A component of more than ``BLOCK_SETS`` sets or ``BLOCK_SHINGLES``
shingles is cut into blocks, and each pair of blocks is a group of its own, so
neither a task nor the driver ever holds an unbounded group.  A task sends on
one row per set and block pair: its number of links there and the first set it
hangs together with; a second pass over those links gives the classes.

Defined cases: null and empty texts have no shingles and equal one another; a
text of fewer than N words is one shingle; ids may repeat or be null (null ids come
last), as a text is known by its id and its content, and rows with equal sets are members
of one representative; extra columns don't matter to the classes, and stay where rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ._store import dropped, stored
from ._text import PLAIN_WORD, Slice, find_words, mix, prefix_hash, slices, span_hash, windows, word_hashes
from .components import components

N, SIMILARITY = 5, 0.8
TREES, MAX_DEPTH, RECALL = 32, 8, 0.999
BLOCK_SETS, BLOCK_SHINGLES = 1024, 2_000_000
_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, 2 * TREES * MAX_DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def found_chance(similarity, depth: int, trees: int = TREES):
    """That two sets share a prefix in one of the trees."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(similarity: float = SIMILARITY, trees: int = TREES, deepest: int = MAX_DEPTH, recall: float = RECALL) -> int:
    """The longest prefix of which the expected recall right at the threshold reaches the target."""
    depth = deepest
    while depth > 1 and found_chance(similarity, depth, trees) < recall:
        depth -= 1
    return depth


def shingle_sets(part: Slice, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and each text's bounds in them."""
    words = find_words(part, PLAIN_WORD)
    prefix = prefix_hash(word_hashes(part, words))
    at, doc = windows(words, n)
    h = span_hash(prefix, at, at + n)
    size = np.diff(words.bounds)
    few = np.flatnonzero((size > 0) & (size < n))
    if len(few):
        h, doc = np.r_[h, span_hash(prefix, words.bounds[few], words.bounds[few + 1])], np.r_[doc, few]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])][: len(h)]
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(part) + 1))


def _fingerprints(h: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    out = []
    for salt in (1, 2):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h ^ _SEEDS[-salt]), out=total[1:])
        out.append(mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)))
    return [row.tobytes() for row in np.stack(out, 1)]


def _prefixes(h: np.ndarray, bounds: np.ndarray, trees: int, depths: list[int]) -> list[np.ndarray]:
    """For each depth, (texts, trees): a hash of each tree's signature prefix. Texts without shingles get any value."""
    full = np.flatnonzero(np.diff(bounds))
    out = [np.zeros((len(bounds) - 1, trees), np.uint64) for _ in depths]
    if not len(full):
        return out
    starts = bounds[:-1][full]
    for t in range(trees):
        key = np.full(len(full), _SEEDS[t])
        for d in range(max(depths)):
            k = 2 * (t * MAX_DEPTH + d) % (len(_SEEDS) - 2)
            key = mix(key + np.minimum.reduceat(h * _SEEDS[k] ^ _SEEDS[k + 1], starts))
            if d + 1 in depths:
                out[depths.index(d + 1)][full, t] = key
    return out


def _sketch(text: Column, n: int, trees: int, depths: list[int]) -> Column:
    names = [f"p{d}" for d in depths]
    fields = [pa.field("fp", pa.binary()), pa.field("size", pa.int32()), *(pa.field(p, pa.list_(pa.int64())) for p in names)]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            fp, size, prefixes = [], [], [[] for _ in depths]
            for part in slices(column):
                h, bounds = shingle_sets(part, n)
                fp += _fingerprints(h, bounds)
                size.append(np.diff(bounds))
                for to, found in zip(prefixes, _prefixes(h, bounds, trees, depths), strict=True):
                    to.append(found.view(np.int64).reshape(-1))
            edge = pa.array(np.arange(len(column) + 1, dtype=np.int32) * trees)
            lists = [pa.ListArray.from_arrays(edge, pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))) for x in prefixes]
            yield pa.StructArray.from_arrays([pa.array(fp, pa.binary()), pa.array(np.concatenate(size) if size else [], pa.int32()), *lists], fields=fields)

    return arrow_udf(run, "struct<fp:binary,size:int," + ",".join(f"{p}:array<bigint>" for p in names) + ">")(text)


def _wanted_sets(n: int):
    """Rows (text, fp, comp, blocks, block) to (comp, pair, fp, shingles): once for every block pair of the set's block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0), 1 << 20):
                h, bounds = shingle_sets(part, n)
                own = [batch.column(c).slice(part.first, len(part)) for c in range(1, 5)]
                fps, comps, counts, block = own[0].to_pylist(), own[1], np.array(own[2]), np.array(own[3])
                right = np.array([a == b for a, b in zip(fps, _fingerprints(h, bounds), strict=True)], bool)
                row = np.repeat(np.arange(len(part)), np.where(right, counts, 0))
                other = np.arange(len(row)) - np.searchsorted(row, row)
                lo, hi = np.minimum(block[row], other), np.maximum(block[row], other)
                sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([comps.take(take), pa.array((lo << 32 | hi).astype(np.int64)), own[0].take(take), pa.array(block[row].astype(np.int32)), sets.take(take)], ["comp", "pair", "fp", "block", "shingles"])

    return run


def linked(flat: np.ndarray, bounds: np.ndarray, similarity: float, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i in left, j in right, i < j where both hold both) of sets with at least that Jaccard similarity, and the similarity."""
    size = np.diff(bounds)
    doc = np.repeat(np.arange(len(size)), size)
    order = np.argsort(flat, kind="stable")
    value, doc = flat[order], doc[order]
    head = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if len(value) else np.zeros(0, np.int64)
    df = np.diff(np.r_[head, len(value)])
    column = np.repeat(np.cumsum(df > 1) - 1, df)
    seen = np.repeat(df > 1, df)
    doc, column = doc[seen], column[seen]
    rank_l, rank_r = np.full(len(size), -1), np.full(len(size), -1)
    rank_l[left], rank_r[right] = np.arange(len(left)), np.arange(len(right))
    common = np.zeros((len(left), len(right)), np.float32)
    width = max(1, int((df > 1).sum()))
    step = max(256, 8_000_000 // max(1, len(left) + len(right)))
    cut = np.searchsorted(column, np.arange(0, width + step, step))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if a == b:
            continue
        base, d = int(column[a]) // step * step, doc[a:b]
        hot = []
        for rank, rows in ((rank_l, len(left)), (rank_r, len(right))):
            m = np.zeros((rows, min(step, width - base)), np.float32)
            ok = rank[d] >= 0
            m[rank[d[ok]], column[a:b][ok] - base] = 1
            hot.append(m)
        common += hot[0] @ hot[1].T
    union = size[left][:, None] + size[right][None, :] - common
    i, j = np.nonzero(common >= similarity * union - 1e-6)
    alike = common[i, j] / np.maximum(union[i, j], 1)
    i, j = left[i], right[j]
    return i[i != j], j[i != j], alike[i != j]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest set each set hangs together with."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == before).all():
            return root


def _verify(similarity: float, depth: int, trees: int):
    """Streams rows that are sorted by (comp, pair, fp); compares the sets of each group.

    Per set: the first set it hangs together with, its links, and the links that each found one stands for at this depth.
    """

    def group(fps: list[bytes], blocks: np.ndarray, sets: list[np.ndarray], pair: int) -> tuple[list[bytes], list[bytes], list[int], list[float]]:
        lo, hi = pair >> 32, pair & 0xFFFFFFFF
        bounds = np.zeros(len(sets) + 1, np.int64)
        np.cumsum([len(s) for s in sets], out=bounds[1:])
        left, right = np.flatnonzero(blocks == lo), np.flatnonzero(blocks == hi)
        i, j, alike = linked(np.concatenate(sets), bounds, similarity, left, right)
        if lo == hi:
            i, j, alike = i[i < j], j[i < j], alike[i < j]
        weight = 1 / found_chance(alike.astype(float), depth, trees)
        links = np.bincount(i, minlength=len(sets)) + np.bincount(j, minlength=len(sets))
        stands = np.bincount(i, weight, len(sets)) + np.bincount(j, weight, len(sets))
        root = _roots(len(sets), i, j)
        some = np.flatnonzero(links)
        return [fps[k] for k in some], [fps[root[k]] for k in some], links[some].tolist(), stands[some].tolist()

    def packed(out) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.binary(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["fp", "root", "links", "stands"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fps, blocks, sets, out = None, [], [], [], ([], [], [], [])

        def close() -> None:
            if len(fps) > 1:
                for to, values in zip(out, group(fps, np.array(blocks), sets, key[1]), strict=True):
                    to.extend(values)

        for batch in batches:
            comp, pair, fp, block = (batch.column(c).to_pylist() for c in range(4))
            lists = batch.column(4)
            edge, flat = np.array(lists.offsets), lists.values.to_numpy()
            for r in range(len(comp)):
                if (comp[r], pair[r]) != key:
                    close()
                    key, fps, blocks, sets = (comp[r], pair[r]), [], [], []
                if not fps or fps[-1] != fp[r]:  # repeated rows have one set
                    fps.append(fp[r])
                    blocks.append(block[r])
                    sets.append(flat[edge[r] : edge[r + 1]].copy())
            if len(out[0]) > 50_000:
                yield packed(out)
                out = ([], [], [], [])
        close()
        yield packed(out)

    return run


def _links(texts: DataFrame, sets: DataFrame, n: int, similarity: float, trees: int, depth: int) -> DataFrame:
    """Verified links at one depth: fp, root, links, stands."""
    # nodes are 64-bit here: should two sets share one, they are merely compared as well
    nodes = sets.withColumn("node", F.xxhash64("fp"))
    leaves = nodes.where("size > 0").select("node", F.posexplode(f"p{depth}").alias("tree", "prefix"))
    shared = leaves.groupBy("tree", "prefix").agg(F.count("*").alias("c"), F.min("node").alias("root")).where("c > 1").drop("c")
    candidates = components(leaves.join(shared, ["tree", "prefix"]).where("node != root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    placed = candidates.union(candidates.select("root", "root").distinct()).toDF("node", "comp")
    member = placed.join(nodes.select("node", "fp", "first", "size"), "node").drop("node")
    need = member.groupBy("comp").agg(F.count("*").alias("c"), F.sum("size").alias("s")).select("comp", F.greatest(F.ceil(F.col("c") / BLOCK_SETS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = member.join(need, "comp").select("first", "fp", "comp", "blocks", F.pmod(F.xxhash64("fp"), "blocks").cast("int").alias("block"))
    placed = stored(placed, "forest-members")
    # by id and content, so that ids that many rows share don't pair all of them
    wanted = texts.join(placed.hint("shuffle_hash"), texts["id"].eqNullSafe(placed["first.id"]) & (texts["content"] == placed["first.content"])).select("text", "fp", "comp", "blocks", "block")
    pairs = wanted.mapInArrow(_wanted_sets(n), "comp bigint, pair bigint, fp binary, block int, shingles array<bigint>").repartition("comp", "pair").sortWithinPartitions("comp", "pair", "fp")
    verified = stored(pairs.mapInArrow(_verify(similarity, depth, trees), "fp binary, root binary, links bigint, stands double"), "forest-links")
    dropped(placed)
    return verified


def _classed(docs: DataFrame, id_col: str, text_col: str, n: int = N, similarity: float = SIMILARITY, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """Per row: id, content, first (gap, id, content of the class's first row), n_links, n_copies."""
    depths = list(range(MAX_DEPTH, prefix_depth(similarity, trees, MAX_DEPTH, recall) - 1, -1))
    text = F.col(text_col)
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("content"), text.alias("text"))
    sketches = stored(texts.select("id", "content", _sketch(F.col("text"), n, trees, depths).alias("s")).select("id", "content", "s.*"), "forest-sketches")
    place = F.struct(F.col("id").isNull().alias("gap"), "id", "content")
    names = ["size", *(f"p{d}" for d in depths)]
    sets = stored(sketches.groupBy("fp").agg(F.min(place).alias("first"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in names]), "forest-sets")

    for depth in depths:
        verified = _links(texts, sets, n, similarity, trees, depth)
        total = verified.agg(F.coalesce(F.sum("links"), F.lit(0)).alias("found"), F.coalesce(F.sum("stands"), F.lit(0.0)).alias("all")).first()
        if total["found"] >= recall * total["all"] or depth == depths[-1]:
            break
        dropped(verified)

    classes = components(verified.select(F.col("fp").alias("u"), F.col("root").alias("v")))
    links = verified.groupBy("fp").agg(F.sum("links").alias("n_links"))
    named = sets.select("fp", "first", "copies").join(classes.withColumnRenamed("node", "fp"), "fp", "left").join(links, "fp", "left")
    named = named.select("fp", "first", "copies", F.coalesce("root", "fp").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    least = named.groupBy("root").agg(F.min("first").alias("first"))
    named = stored(named.drop("first").join(least, "root").select("fp", "first", "n_links", F.col("copies").alias("n_copies")), "forest-classes")
    dropped(verified, sets)
    return sketches.select("id", "content", "fp").join(named, "fp").drop("fp")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: id, class_id (id of the class's first row), n_links (other distinct sets at least that similar), n_copies (rows with an equal set).

    Options: n, similarity, trees, recall.
    """
    return _classed(docs, id_col, text_col, **options).select(F.col("id").alias(id_col), F.col("first.id").alias("class_id"), "n_links", "n_copies")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The first row of each class, by id and then content, repeated rows once; all columns stay."""
    classes = _classed(docs, id_col, text_col, **options)
    first = classes.where(F.col("id").eqNullSafe(F.col("first.id")) & F.col("content").eqNullSafe(F.col("first.content"))).select(F.col("id").alias("__keep"), F.col("content").alias("__content")).distinct()
    rows = docs.withColumn("__own", F.xxhash64(text_col))
    kept = rows.join(first, rows[id_col].eqNullSafe(first["__keep"]) & (rows["__own"] == first["__content"]), "left_semi")
    return kept.dropDuplicates([id_col, "__own"]).drop("__own")
