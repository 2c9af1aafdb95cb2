"""Resampling with a fixed number of draws, without a task that sees all rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of a block; a block's counts in all replicates stay near a million numbers.
WIDTH, COUNTS = 4096, 1_000_000


def block_counts(seed: int, reps: int, total: int, width: int, block: int) -> np.ndarray:
    """(replicates, rows of the block): how often each row is drawn when each replicate draws ``total`` of ``total`` rows.

    The draws are halved down a binary tree of blocks, each node by its own binomial, so that a block's counts follow
    from the seed and its number alone, and all blocks' counts add up to the draws.
    """
    low, high, left, node = 0, -(-total // width), np.full(reps, total), 1
    while high - low > 1:
        middle = (low + high) // 2
        share = (middle - low) * width / (min(high * width, total) - low * width)
        taken = _generator(seed, node).binomial(left, share)
        if block < middle:
            left, high, node = taken, middle, 2 * node
        else:
            left, low, node = left - taken, middle, 2 * node + 1
    rows = min(width, total - block * width)
    return _generator(seed, (1 << 62) + block).multinomial(left, np.full(rows, 1 / rows))


def _generator(seed: int, node: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=np.array([seed, node], np.uint64)))


def hashed_counts(ids: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """(replicates, ids): a Poisson(1) count for each 64-bit id in each replicate, mixed from both numbers."""
    edges = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])
    h = ids[None, :] + ((reps + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return np.searchsorted(edges, (h >> np.uint64(11)) / float(1 << 53), "right")


def drawn_sums(rows: DataFrame, number: str, columns: list[str], total: int, reps: int, seed: int) -> np.ndarray:
    """(replicates, columns): sums of the columns over the rows drawn in each replicate. ``number`` runs from 0 to total - 1."""
    width = max(1, min(WIDTH, COUNTS // reps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, kept, counts = np.zeros((reps, len(columns))), -1, None
        for batch in batches:
            at = batch.column(0).to_numpy()
            values = np.column_stack([c.to_numpy() for c in batch.columns[1:]])
            blocks = at // width
            for block in np.unique(blocks).tolist():
                if block != kept:
                    kept, counts = block, block_counts(seed, reps, total, width, block)
                mine = blocks == block
                sums += counts[:, at[mine] - block * width] @ values[mine]
        rep, place = np.divmod(np.arange(sums.size), sums.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(place), pa.array(sums.ravel())], ["rep", "at", "value"])

    named = rows.select(F.col(number).cast("long"), *[F.col(c).cast("double") for c in columns])
    out = named.mapInArrow(run, "rep bigint, at bigint, value double").groupBy("rep", "at").agg(F.sum("value").alias("value"))
    sums = np.zeros((reps, len(columns)))
    for r in out.collect():
        sums[r["rep"], r["at"]] = r["value"]
    return sums
