"""Exact quantiles and running sums without a task that sees all values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a bracket in one pass; values of brackets of at most FEW rows come to the driver themselves.
BINS, FEW = 4096, 10_000
#: Blocks of ordered values for running sums.
BLOCKS = 200


def _octave(x: Column) -> Column:
    """A number for each sign and power of two, ascending with x."""
    return F.when(x == 0, 0).when(x > 0, 2000 + F.floor(F.log2(x))).otherwise(-2000 - F.floor(F.log2(-x))).cast("int")


def _counted(df: DataFrame, keys: list[Column]) -> list[tuple]:
    """(column, bracket, bin, count, least, greatest) over all columns, from keys (bracket, bin, x) that are null where a row doesn't matter."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), k.alias("k")) for i, k in enumerate(keys)])).alias("e")).where("e.k is not null")
    rows = each.groupBy("e.i", "e.k.bracket", "e.k.bin").agg(F.count("*").alias("n"), F.min("e.k.x").alias("low"), F.max("e.k.x").alias("high")).collect()
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0], r[1], r[4]))


def quantiles(df: DataFrame, columns: Sequence[Column], fractions: Sequence[float]) -> list[list[float | None]]:
    """Linearly interpolated quantiles of each column's non-null, finite values; null without values.

    Values are counted by sign and power of two first. Then the bins that hold the ranks asked for are cut into BINS
    equal ones, pass after pass, until a bin holds one value or a few rows; a pass is one job with partial counts.
    """
    named = df.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    xs = [F.col(f"x{i}") for i in range(len(columns))]
    key = lambda x, bracket, at: F.struct(bracket.cast("int").alias("bracket"), at.cast("int").alias("bin"), x.alias("x"))
    counts = _counted(named, [F.when(x.isNotNull(), key(x, F.lit(0), _octave(x))) for x in xs])
    size = [sum(r[3] for r in counts if r[0] == i) for i in range(len(xs))]
    value: list[dict[int, float]] = [{} for _ in xs]
    wanted: list[set[int]] = []
    for n in size:
        at = [p * (n - 1) for p in fractions] if n else []
        wanted.append({int(a) for a in at} | {min(int(a) + 1, n - 1) for a in at})
    before = {(i, 0): 0 for i in range(len(xs))}
    while counts:
        open_: list[list[tuple[float, float, int, int]]] = [[] for _ in xs]
        seen = dict(before)
        for i, bracket, _, n, low, high in counts:
            start = seen[i, bracket]
            seen[i, bracket] = start + n
            inside = [r for r in wanted[i] if start <= r < start + n and r not in value[i]]
            if low == high:
                value[i] |= dict.fromkeys(inside, low)
            elif inside:
                open_[i].append((low, high, start, n))
        few = [(i, *b) for i, brackets in enumerate(open_) for b in brackets if b[3] <= FEW]
        for i, low, high, start, _ in few:
            values = sorted(r[0] for r in named.where((xs[i] >= low) & (xs[i] <= high)).select(xs[i]).collect())
            value[i] |= {r: values[r - start] for r in wanted[i] if start <= r < start + len(values)}
        open_ = [[b for b in brackets if b[3] > FEW] for brackets in open_]
        before = {(i, k): b[2] for i, brackets in enumerate(open_) for k, b in enumerate(brackets)}
        if not before:
            break
        keys = []
        for x, brackets in zip(xs, open_, strict=True):
            out = F.lit(None).cast("struct<bracket:int,bin:int,x:double>")
            for k, (low, high, _, _) in enumerate(brackets):
                width = (high - low) / BINS
                at = F.least(F.floor((x - low) / width), F.lit(BINS - 1)) if width > 0 else F.when(x == low, 0).otherwise(1)
                out = F.when((x >= low) & (x <= high), key(x, F.lit(k), at)).otherwise(out)
            keys.append(out)
        counts = _counted(named, keys)
    result: list[list[float | None]] = []
    for n, v in zip(size, value, strict=True):
        row: list[float | None] = []
        for p in fractions:
            at = p * (n - 1)
            low = int(at) if n else 0
            row.append(v[low] + (v[min(low + 1, n - 1)] - v[low]) * (at - low) if n else None)
        result.append(row)
    return result


def blocks(df: DataFrame, by: str) -> Column:
    """The number of a row's block of values of ``by``: BLOCKS ranges of about as many rows."""
    cuts = df.select(F.percentile_approx(by, [i / BLOCKS for i in range(1, BLOCKS)], 10 * BLOCKS)).first()[0]
    edges = sorted(set(cuts or []))
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda c: c < F.col(by))) if edges else F.lit(0)


def running(df: DataFrame, names: Sequence[str], by: str, later: bool = False) -> DataFrame:
    """Adds sum_<name>: the sums of all rows up to this one by ``by`` (or from this one on), within ``block`` by a window, before it by the blocks' sums."""
    sums = sorted(df.groupBy("block").agg(*[F.sum(n).alias(n) for n in names]).collect(), key=lambda r: r["block"], reverse=later)
    window = Window.partitionBy("block").orderBy(F.desc(by) if later else F.asc(by)).rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for n in names:
        total, base = 0, []
        for r in sums:
            base += [F.lit(r["block"]), F.lit(total)]
            total = total + (r[n] or 0)
        out[f"sum_{n}"] = F.sum(n).over(window) + (F.create_map(*base)[F.col("block")] if base else F.lit(0))
    return df.withColumns(out)
