"""Hard negatives by segment summaries.

Each vector is cut into 1, 4 and 16 segments, and the mean and the deviation of each segment are stored beside it.
Within a segment of L components two vectors' inner product is L times the product of their means, plus the product of
what is left of each, which is at most L times the product of their deviations.  So summaries alone give a lower and an
upper bound of a score.  For each anchor the bounds of one segment rule out most rows, those of 4 and 16 segments are
worked out for the rows left, and only what none of them rules out is scored, in exact integers.

Rows are dealt to chunks by a hash of their content and packed with their summaries; so are anchors.  Every chunk meets
every block of anchors in a cell of its own (the anchors are a stated query set, in blocks): a cell holds two packed
rows of bounded size whatever the labels, and hands on at most ``k`` rows of an anchor.  The first pass finds each
anchor's positives, the second, with the limits these set, its negatives.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part.  Rows equal in id,
label and vector count once; rows that share an id alone are different rows.  A null id takes part, is no anchor and
comes last among equal scores.  Vectors of different lengths are compared as if zeros followed the shorter one; an
empty vector scores 0.  Components beyond 32 bits after scaling, and scores beyond 64 bits, are errors.  An empty table
gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import stored

SEGMENTS = (1, 4, 16)
#: Rows of a chunk and anchors of a block: a share of the table, between these.
CHUNK_ROWS, MAX_CHUNK_ROWS, ANCHOR_ROWS = 2_048, 65_536, 2_048
_SAFE = 1 << 53

_PACKED = "part bigint, n bigint, ids binary, known binary, labels binary, q binary, means binary, deviations binary"
_RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """vec_id, label, q: the rows that take part, with components floor(scale * x)."""
    whole = ~F.exists(F.col(vec_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & whole)
    q = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale).cast("int"))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), q.alias("q"))


def _summaries(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of each row's segments, all levels side by side."""
    means, deviations = [], []
    for k in SEGMENTS:
        parts = q.reshape(len(q), k, -1).astype(np.float64)
        means.append(parts.mean(axis=2))
        deviations.append(parts.std(axis=2))
    return np.concatenate(means, axis=1), np.concatenate(deviations, axis=1)


def _packer(dims: int):
    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        n = len(table)
        lists = table["q"].combine_chunks() if isinstance(table["q"], pa.ChunkedArray) else table["q"]
        sizes = np.asarray(lists.value_lengths(), np.int64)
        q = np.zeros((n, dims), np.int32)
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        q[np.repeat(np.arange(n), sizes), place] = np.asarray(lists.flatten())
        ids, labels = np.asarray(table["vec_id"].fill_null(0), np.int64), np.asarray(table["label"], np.int64)
        known = np.asarray(table["vec_id"].is_valid())
        order = np.lexsort((ids, ~known, labels))
        means, deviations = _summaries(q[order])
        row = {"part": [table["part"][0].as_py()], "n": [n]}
        for name, values in (("ids", ids[order]), ("known", known[order]), ("labels", labels[order]), ("q", q[order]), ("means", means), ("deviations", deviations)):
            row[name] = pa.array([np.ascontiguousarray(values).tobytes()], pa.binary())
        return pa.table(row)

    return pack


def packed(rows: DataFrame, parts: int, dims: int) -> DataFrame:
    """One row a part: ids, labels, components and summaries of the vectors whose content hashes to it."""
    return rows.withColumn("part", F.pmod(F.xxhash64("vec_id", "label", "q"), F.lit(parts))).groupBy("part").applyInArrow(_packer(dims), _PACKED)


@dataclass
class Block:
    """A packed part as arrays; rows ascend by label."""

    ids: np.ndarray
    known: np.ndarray
    labels: np.ndarray
    q: np.ndarray
    means: list[np.ndarray]
    deviations: list[np.ndarray]
    largest: int

    @classmethod
    def read(cls, row: dict, prefix: str = "") -> Block:
        n, values = row[prefix + "n"], lambda name, kind: np.frombuffer(row[prefix + name], kind)
        cuts = np.cumsum(SEGMENTS)[:-1]
        means, deviations = (np.split(values(name, np.float64).reshape(n, -1), cuts, axis=1) for name in ("means", "deviations"))
        q = values("q", np.int32).reshape(n, -1)
        return cls(values("ids", np.int64), values("known", bool), values("labels", np.int64), q, [np.ascontiguousarray(m) for m in means], [np.ascontiguousarray(d) for d in deviations], int(np.abs(q.astype(np.int64)).max(initial=0)))

    def bounds(self, level: int, rows: np.ndarray, other: Block, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of these rows' scores with the other block's row i; rounding is allowed for."""
        size = self.q.shape[1] // SEGMENTS[level]
        middle = self.means[level][rows] @ (other.means[level][i] * size)
        spread = self.deviations[level][rows] @ (other.deviations[level][i] * size)
        spread = spread + 1e-9 * (np.abs(middle) + spread) + 1e-6
        return middle - spread, middle + spread

    def scores(self, rows: np.ndarray, other: Block, i: int) -> np.ndarray:
        if self.largest * other.largest * self.q.shape[1] < _SAFE:
            return (self.q[rows].astype(np.float64) @ other.q[i].astype(np.float64)).astype(np.int64)
        exact = self.q[rows].astype(object) @ other.q[i].astype(object)
        if len(exact) and max(abs(int(x)) for x in exact) >= 1 << 63:
            raise OverflowError("a score exceeds 64 bits")
        return exact.astype(np.int64)

    def best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places of the first k: higher scores first, then smaller ids, null ids last."""
        if len(rows) > 4 * k:
            near = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        else:
            near = np.arange(len(rows))
        return near[np.lexsort((self.ids[rows[near]], ~self.known[rows[near]], -scores[near]))[:k]]

    def id_of(self, row: int) -> int | None:
        return int(self.ids[row]) if self.known[row] else None


def _kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, -k)[-k]) if len(values) >= k else -np.inf


def positives_of(chunk: Block, anchors: Block, i: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and scores of the first k other rows of the anchor's label."""
    rows = np.arange(*np.searchsorted(chunk.labels, [anchors.labels[i], anchors.labels[i] + 1]))
    own = rows[chunk.known[rows] & (chunk.ids[rows] == anchors.ids[i])]
    rows = np.setdiff1d(rows, [r for r in own if np.array_equal(chunk.q[r], anchors.q[i])], assume_unique=True)
    for level in range(len(SEGMENTS)):
        if len(rows) > k:
            lower, upper = chunk.bounds(level, rows, anchors, i)
            rows = rows[upper >= _kth(lower, k)]
    scores = chunk.scores(rows, anchors, i)
    first = chunk.best(rows, scores, k)
    return rows[first], scores[first]


def negatives_of(chunk: Block, anchors: Block, i: int, limits: list[tuple[int, int]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each pair of limits, rows and scores of the first k rows of other labels within them."""
    first, last = np.searchsorted(chunk.labels, [anchors.labels[i], anchors.labels[i] + 1])
    rows = np.concatenate([np.arange(first), np.arange(last, len(chunk.labels))])
    for level in range(len(SEGMENTS)):
        if len(rows):
            lower, upper = chunk.bounds(level, rows, anchors, i)
            keep = np.zeros(len(rows), bool)
            for low, high in limits:
                within = (lower >= low) & (upper <= high)
                keep |= (upper >= max(low, _kth(lower[within], k))) & (lower <= high)
            rows = rows[keep]
    scores = chunk.scores(rows, anchors, i)
    for low, high in limits:
        inside = np.flatnonzero((scores >= low) & (scores <= high))
        places = inside[chunk.best(rows[inside], scores[inside], k)]
        yield rows[places], scores[places]


def _limits(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and greatest negative score: low * score <= 100 * negative <= high * score."""
    return -((-low * score) // 100), (high * score) // 100


_POSITIVES = pa.schema([("block", pa.int64()), ("place", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_NEGATIVES = pa.schema([("block", pa.int64()), ("place", pa.int64()), ("rank", pa.int64()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _positives(k: int):
    def run(chunks: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        for c in chunks.to_pylist():
            chunk = Block.read(c)
            for a in anchors.to_pylist():
                block = Block.read(a)
                for i in range(len(block.ids)):
                    for r, s in zip(*positives_of(chunk, block, i, k), strict=True):
                        out.append((a["part"], i, chunk.id_of(r), int(s)))
        return _table(out, _POSITIVES)

    return run


def _negatives(k: int, low: int, high: int):
    def run(chunks: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        for c in chunks.to_pylist():
            chunk = Block.read(c)
            for a in anchors.to_pylist():
                block, found = Block.read(a), {}
                for b in a["found"]:
                    found.setdefault(b["place"], []).append(b)
                for i, own in found.items():
                    limits = [_limits(b["score"], low, high) for b in own]
                    for b, (rows, scores) in zip(own, negatives_of(chunk, block, i, limits, k), strict=True):
                        out += [(a["part"], i, b["rank"], int(block.ids[i]), b["vec_id"], b["score"], chunk.id_of(r), int(s)) for r, s in zip(rows, scores, strict=True)]
        return _table(out, _NEGATIVES)

    return run


def _cells(table: DataFrame, own: str, other: str, others: int) -> DataFrame:
    """A packed table, repeated for each part of the other side."""
    return table.withColumn(own, F.col("part")).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))


def _met(chunks: DataFrame, anchors: DataFrame, parts: tuple[int, int], run, schema: pa.Schema) -> DataFrame:
    left, right = _cells(chunks, "chunk", "block", parts[1]), _cells(anchors, "block", "chunk", parts[0])
    names = ", ".join(f"{f.name} bigint" for f in schema)
    drop = lambda t: t.drop_columns(["chunk", "block"])
    return left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInArrow(lambda a, b: run(drop(a), drop(b)), names)


def _first(rows: DataFrame, by: list[str], score: str, ident: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.col(ident).asc_nulls_last())
    return rows.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= k)


def mine_hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """For quantised rows: each anchor's first positives and, for each of them, the first negatives whose score is within
    low and high percent of the positive's."""
    spark = rows.sparkSession
    rows = stored(rows.select("vec_id", "label", "q").distinct(), "vectors")
    total, anchors, longest = rows.agg(F.count("*"), F.count_if(is_anchor), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    if not anchors:
        return spark.createDataFrame([], _RESULT)
    share = min(MAX_CHUNK_ROWS, max(CHUNK_ROWS, total // 64))
    parts = -(-total // share), -(-anchors // ANCHOR_ROWS)
    dims = max(1, -(-longest // SEGMENTS[-1])) * SEGMENTS[-1]
    chunks = stored(packed(rows, parts[0], dims), "vector-chunks")
    blocks = stored(packed(rows.where(is_anchor), parts[1], dims), "vector-anchors")
    near = _first(_met(chunks, blocks, parts, _positives(positives), _POSITIVES), ["block", "place"], "score", "vec_id", positives)
    found = near.groupBy("block").agg(F.collect_list(F.struct("place", F.col("__place").cast("long").alias("rank"), "vec_id", "score")).alias("found"))
    limited = stored(blocks.join(found.withColumnRenamed("block", "part"), "part"), "vector-limits")
    mined = _met(chunks, limited, parts, _negatives(negatives, low, high), _NEGATIVES)
    best = _first(mined, ["block", "place", "rank"], "negative_score", "negative_id", negatives)
    return best.select("anchor_id", "positive_id", F.col("__place").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
