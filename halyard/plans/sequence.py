"""Resampling by one seeded sequence of numbers, as a program that draws one after another gives it.

The generator, xoshiro256++ with a splitmix64 seed (Blackman and Vigna), is linear over bits: a jump ahead is a product
with a power of its 256 x 256 bit matrix.  So each task starts in mid-sequence, at its own chunk.  Numbers that a draw
must reject (on average one in 2**64 / total) are found first, since each moves all later draws by one place.

A task sorts the draws of several chunks and sends each range of rows the gaps between its own, compressed: under a byte
a draw while a task's draws are a thirtieth of the rows or more.  Replicates go in rounds whose shuffles are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dropped, shuffles_freed, stored
from ..sources.tables import ROW, ranked

#: Sequences that run side by side in a chunk, and numbers of each.
LANES, STEPS = 1024, 256
CHUNK = LANES * STEPS
#: Chunks that a task sorts together, replicates of a round at most, and rows of a range.
RUN, ROUND, WIDE = 32, 25, 1 << 18
#: Places of rows that are counted together, and most such blocks that the driver takes.
BLOCK, MAX_BLOCKS = 4096, 1 << 20
_U = np.uint64


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << _U(by)) | (x >> _U(64 - by))


def seeded(seed: int) -> np.ndarray:
    """The four words of state that a seed of 64 bits stands for."""
    words = []
    for i in range(1, 5):
        z = (seed + i * 0x9E3779B97F4A7C15) % 2**64
        z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB % 2**64
        words.append(z ^ (z >> 31))
    return np.array(words, _U)


def following(s: np.ndarray) -> np.ndarray:
    """The next states of states (..., 4)."""
    a, b, c, d = (s[..., i] for i in range(4))
    c2, d2 = c ^ a, d ^ b
    return np.stack([a ^ d2, b ^ c2, c2 ^ (b << _U(17)), _turned(d2, 45)], axis=-1)


def _bits(s: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(s, "<u8").view(np.uint8), axis=-1, bitorder="little").astype(np.float32)


def _words(bits: np.ndarray) -> np.ndarray:
    return np.packbits((bits % 2).astype(np.uint8), axis=-1, bitorder="little").view("<u8").astype(_U)


@lru_cache(maxsize=1)
def _powers() -> list[np.ndarray]:
    """The bit matrix of 2**j steps, for each j below 64."""
    found = [_bits(following(_words(np.eye(256, dtype=np.float32))))]
    while len(found) < 64:
        found.append((found[-1] @ found[-1]) % 2)
    return found


def jumped(s: np.ndarray, steps: int) -> np.ndarray:
    """States after so many steps."""
    bits = _bits(s)
    for j, power in enumerate(_powers()):
        if steps >> j & 1:
            bits = (bits @ power) % 2
    return _words(bits)


def _stretch(seed: int, first: int, steps: int) -> np.ndarray:
    """LANES * ``steps`` numbers of the sequence from the place ``first`` on, as (steps, LANES): lane after lane."""
    lanes = jumped(seeded(seed)[None], first)
    while len(lanes) < LANES:
        lanes = np.concatenate([lanes, jumped(lanes, len(lanes) * steps)])
    a, b, c, d = (lanes[:, i].copy() for i in range(4))
    out, t = np.empty((steps, LANES), _U), np.empty(LANES, _U)
    for now in out:
        np.add(a, d, out=t)
        np.left_shift(t, _U(23), out=now)
        t >>= _U(41)
        now |= t
        now += a
        # as in following(), in place
        np.left_shift(b, _U(17), out=t)
        c ^= a
        d ^= b
        b ^= c
        a ^= d
        c ^= t
        np.left_shift(d, _U(45), out=t)
        d >>= _U(19)
        d |= t
    return out


def chunk(seed: int, number: int) -> np.ndarray:
    """The CHUNK numbers of the sequence from ``number`` * CHUNK on."""
    return _stretch(seed, number * CHUNK, STEPS).T.ravel()


def _limit(total: int) -> int:
    """Numbers from here on are rejected, which keeps remainders even."""
    return 2**64 - 1 - (2**64 - 1) % total


def _rejected(spark, seed: int, total: int, draws: int) -> list[int]:
    """Places of rejected numbers before the last draw, ascending: about draws * total / 2**64 of them."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c in batch["id"].tolist():
                steps = STEPS * min(RUN, wanted - c)
                step, lane = np.nonzero(_stretch(seed, c * CHUNK, steps) >= _U(_limit(total)))
                yield pd.DataFrame({"place": lane * steps + step + c * CHUNK})

    found: list[int] = []
    done, wanted = 0, -(-draws // CHUNK)
    while done < wanted:
        runs = -(-(wanted - done) // RUN)
        found += sorted(r[0] for r in spark.range(done, wanted, RUN, min(runs, 10_000)).mapInPandas(find, "place long").collect())
        # rejected numbers are made up for at the end
        done, wanted = wanted, -(-(draws + len(found)) // CHUNK)
    return found


def _packed(values: np.ndarray) -> bytes:
    """Values of one width, first bytes first, compressed."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, decompressed_size=n * width, codec="zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).view(kind).ravel()


def _summed(data: bytes, n: int) -> np.ndarray:
    """Places from packed gaps."""
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd"), np.uint8).reshape(4, n)
    gaps = planes[0].astype(np.int64)
    for i in range(1, 4):
        if planes[i].any():
            gaps += planes[i].astype(np.int64) << 8 * i
    return np.cumsum(gaps, out=gaps)


def _dealt(spark, seed: int, starts: np.ndarray, total: int, reps: range, lost: np.ndarray) -> DataFrame:
    """(range, rep, n, gaps): the draws of these replicates that fall into each range of rows, ascending, as the packed
    gaps between them. ``starts`` has the first number of each range."""
    before = lost - np.arange(len(lost))
    first, last = (d + int(np.searchsorted(before, d, "right")) for d in (reps.start * total, reps.stop * total - 1))
    low, high = first // CHUNK, last // CHUNK + 1
    kind = np.uint32 if total <= 1 << 32 else np.int64

    def sent(rep: int, rows: np.ndarray) -> pa.RecordBatch:
        rows = np.sort(rows)
        bounds = np.append(np.searchsorted(rows, starts.astype(kind)), len(rows))
        ranges = np.flatnonzero(np.diff(bounds))
        gaps = np.empty(len(rows), "<u4")
        np.subtract(rows[1:], rows[:-1], out=gaps[1:], casting="unsafe")
        gaps[bounds[ranges]] = rows[bounds[ranges]] - starts[ranges].astype(kind)
        data = [_packed(gaps[bounds[r] : bounds[r + 1]]) for r in ranges]
        return pa.RecordBatch.from_arrays([pa.array(ranges), pa.array(np.full(len(ranges), rep)), pa.array(np.diff(bounds)[ranges]), pa.array(data, pa.binary())], ["range", "rep", "n", "gaps"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.column(0).to_pylist():
                drawn = _stretch(seed, c * CHUNK, STEPS * min(RUN, high - c))
                drawn %= _U(total)
                rows = drawn.astype(kind).T.ravel()
                begin, end = max(first, c * CHUNK), min(last + 1, c * CHUNK + len(rows))
                rows = np.delete(rows[begin - c * CHUNK : end - c * CHUNK], lost[(lost >= begin) & (lost < end)] - begin)
                nth = begin - int(np.searchsorted(lost, begin))
                while len(rows):
                    rep, n = nth // total, min(len(rows), total - nth % total)
                    yield sent(rep, rows[:n])
                    rows, nth = rows[n:], nth + n

    runs = -(-(high - low) // RUN)
    return spark.range(low, high, RUN, min(runs, 10_000)).mapInArrow(deal, "range bigint, rep bigint, n bigint, gaps binary")


def replayed_draws(spark, seed: int, total: int, reps: int, width: int) -> DataFrame:
    """(block, rep, at): draws of each replicate in each block of ``width`` rows, as places in the block.

    Replicate after replicate draws ``total`` of ``total`` rows; nothing but the seed decides them.
    """

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [_summed(data, n).astype(np.int32) for n, data in zip(batch["n"].to_pylist(), batch["gaps"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["range"], batch["rep"], pa.array(at, pa.list_(pa.int32()))], ["block", "rep", "at"])

    lost = np.array(_rejected(spark, seed, total, total * reps), np.int64)
    return _dealt(spark, seed, np.arange(0, total, width), total, range(reps), lost).mapInArrow(plain, "block bigint, rep bigint, at array<int>")


def _ranges(placed: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """The first block and the rows of ranges of about WIDE rows, fewer in a small table; None beyond MAX_BLOCKS blocks."""
    with shuffles_freed(placed.sparkSession):
        found = placed.groupBy(F.shiftright("place", BLOCK.bit_length() - 1).alias("block")).agg(F.count("*").alias("n")).limit(MAX_BLOCKS + 1).toArrow()
    if len(found) > MAX_BLOCKS:
        return None
    if not len(found):
        raise ValueError("no observations")
    blocks, sizes = found["block"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(blocks)
    blocks, sizes = blocks[order], sizes[order]
    goal = min(WIDE, max(BLOCK, int(sizes.sum()) // 64))
    first = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // goal, prepend=-1))
    return blocks[first], np.add.reduceat(sizes, first)


def _sent_rows(placed: DataFrame, columns: list[str], blocks: np.ndarray) -> DataFrame:
    """(range, n, places, data): the rows of each range, many to a record."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= WIDE:
                yield packed(held)
                held = []
        if sum(b.num_rows for b in held):
            yield packed(held)

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        place, values = table["place"].to_numpy(), np.stack([table[c].to_numpy() for c in columns])
        order = np.argsort(place, kind="stable")
        place, values = place[order], values[:, order]
        bounds = np.append(np.searchsorted(place, blocks * BLOCK), len(place))
        ranges = np.flatnonzero(np.diff(bounds))
        cuts = [slice(bounds[r], bounds[r + 1]) for r in ranges]
        data = [[_packed(place[c].astype("<i8")) for c in cuts], [_packed(values[:, c].ravel().astype("<f8")) for c in cuts]]
        return pa.RecordBatch.from_arrays([pa.array(ranges), pa.array(np.diff(bounds)[ranges]), *[pa.array(d, pa.binary()) for d in data]], ["range", "n", "places", "data"])

    return placed.mapInArrow(send, "range bigint, n bigint, places binary, data binary")


def replayed_sums(rows: DataFrame, place: str, columns: list[str], reps: int, seed: int, products: bool = False) -> np.ndarray:
    """(replicates, columns): sums of the columns over the rows drawn in each replicate. Rows are numbered by ``place``, a bigint.

    With ``products`` the sums are of the products of all pairs of columns, (0, 0), (0, 1), ..., (1, 1), ...
    """
    spark = rows.sparkSession
    with shuffles_freed(spark):
        # one evaluation, so that places and their counts agree
        placed = stored(rows.select(F.col(place).cast("long").alias("place"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]), "replayed")
    names = [f"v{i}" for i in range(len(columns))]
    if (found := _ranges(placed)) is None:
        sparse, placed = placed, stored(ranked(placed, "place", *names).select(F.col(ROW).alias("place"), *names), "replayed")
        dropped(sparse)
        found = _ranges(placed)
    blocks, sizes = found
    starts, total = np.cumsum(sizes) - sizes, int(sizes.sum())
    pairs = np.triu_indices(len(columns)) if products else None
    width = len(pairs[0]) if products else len(columns)
    parts = min(len(sizes), 10_000)

    def add(mine: pa.Table, drawn: pa.Table) -> pa.Table:
        if not len(drawn):
            return pa.table({"rep": pa.array([], pa.int64()), "at": pa.array([], pa.int64()), "value": pa.array([], pa.float64())})
        many = mine["n"].to_pylist()
        n = int(sizes[drawn["range"][0].as_py()])
        if sum(many) != n:
            raise ValueError("rows changed while they were read")
        at = np.concatenate([_unpacked(d, m, "<i8") for m, d in zip(many, mine["places"].to_pylist(), strict=True)])
        values = np.concatenate([_unpacked(d, m * len(columns), "<f8").reshape(-1, m) for m, d in zip(many, mine["data"].to_pylist(), strict=True)], axis=1)
        # rows of one place by their values
        values = values[:, np.lexsort((*values[::-1], at))]
        values = values[pairs[0]] * values[pairs[1]] if products else values
        drawn = drawn.sort_by("rep")
        reps, lengths, gaps = drawn["rep"].to_numpy(), drawn["n"].to_pylist(), drawn["gaps"]
        own, first = np.unique(reps, return_index=True)
        sums = np.empty((len(own), width))
        for i, (low, high) in enumerate(zip(first, [*first[1:], len(reps)], strict=True)):
            rows = np.concatenate([_summed(gaps[j].as_py(), lengths[j]) for j in range(low, high)])
            sums[i] = values @ np.bincount(rows, minlength=n).astype(float)
        return pa.table({"rep": np.repeat(own, width), "at": np.tile(np.arange(width), len(own)), "value": sums.ravel()})

    lost = np.array(_rejected(spark, seed, total, total * reps), np.int64)
    sums, rounds = np.zeros((reps, width)), -(-reps // ROUND)
    for i in range(rounds):
        with shuffles_freed(spark):
            mine = _sent_rows(placed, names, blocks).repartition(parts, "range")
            drawn = _dealt(spark, seed, starts, total, range(reps * i // rounds, reps * (i + 1) // rounds), lost).repartition(parts, "range")
            out = mine.groupBy("range").cogroup(drawn.groupBy("range")).applyInArrow(add, "rep bigint, at bigint, value double")
            for r in out.groupBy("rep", "at").agg(F.sum("value").alias("value")).collect():
                sums[r["rep"], r["at"]] = r["value"]
    dropped(placed)
    return sums
