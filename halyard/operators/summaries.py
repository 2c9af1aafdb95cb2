"""Counts, summaries, key checks, tables of categories and grouped means."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import finite, finite_or_null, is_numeric, number, truth
from ..plans.ranks import quantiles
from ..sources.tables import ROW
from .rows import labelled, names_of, need, q

PERCENTILES = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)


def _where(df: DataFrame, predicate: str | Column | None) -> DataFrame:
    return df if predicate is None else df.where(truth(predicate))


def count_if(df: DataFrame, predicate: str | Column | None = None) -> DataFrame:
    return _where(df, predicate).agg(F.count("*").alias("n"))


def _rows(one: DataFrame, names: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """A row per variable from one row of aggregates named field_i."""
    structs = [F.struct(F.lit(n).alias("variable"), *[F.col(f"{f}_{i}").alias(f) for f in fields]) for i, n in enumerate(names)]
    return one.select(F.inline(F.array(*structs)))


def summarize(df: DataFrame, *names: str, predicate: str | Column | None = None, detail: bool = False) -> DataFrame:
    """Per variable, over its own finite values: n, mean, sd, min, max, in one job; with detail also nine exact percentiles."""
    chosen = list(names) or [n for n, t in df.dtypes if n != ROW and is_numeric(t)]
    need(df, *chosen)
    aggs = []
    for i, n in enumerate(chosen):
        x = finite_or_null(q(n))
        aggs += [F.count(x).alias(f"n_{i}"), F.avg(x).alias(f"mean_{i}"), F.stddev_samp(x).alias(f"sd_{i}"), F.min(x).alias(f"min_{i}"), F.max(x).alias(f"max_{i}")]
    one = _where(df, predicate).agg(*aggs)
    fields = ["n", "mean", "sd", "min", "max"]
    rows = _rows(one, chosen, fields)
    if not detail:
        return rows
    found = quantiles(_where(df, predicate), [finite_or_null(q(n)) for n in chosen], PERCENTILES)
    of = lambda k: F.create_map(*[F.lit(v) for n, row in zip(chosen, found, strict=True) for v in (n, row[k])])[F.col("variable")].cast("double")
    return rows.select("variable", *fields, *[of(k).alias(f"p{round(100 * p)}") for k, p in enumerate(PERCENTILES)])


def missing(df: DataFrame, *names: str) -> DataFrame:
    chosen = list(names) or names_of(df)
    need(df, *chosen)
    aggs = [a for i, n in enumerate(chosen) for a in (F.count("*").alias(f"total_{i}"), F.count_if(q(n).isNull()).alias(f"missing_{i}"), F.count(q(n)).alias(f"nonmissing_{i}"))]
    rows = _rows(df.agg(*aggs), chosen, ["total", "missing", "nonmissing"])
    return rows.withColumn("percent", F.when(F.col("total") > 0, 100.0 * F.col("missing") / F.col("total")).otherwise(0.0))


def codebook(df: DataFrame, *names: str) -> DataFrame:
    """Type, non-null, null and distinct counts, and up to three examples in row order."""
    chosen = list(names) or names_of(df)
    need(df, *chosen)
    kinds = dict(df.dtypes)
    aggs = []
    for i, n in enumerate(chosen):
        aggs += [F.count(q(n)).alias(f"nonmissing_{i}"), F.count_if(q(n).isNull()).alias(f"missing_{i}"), F.count_distinct(q(n)).alias(f"distinct_{i}")]
    counts = _rows(df.agg(*aggs), chosen, ["nonmissing", "missing", "distinct"])
    seen = df.select(ROW, F.inline(F.array(*[F.struct(F.lit(n).alias("variable"), q(n).cast("string").alias("value")) for n in chosen]))).where("value is not null")
    first = seen.groupBy("variable", "value").agg(F.min(ROW).alias("at"))
    rank = F.row_number().over(Window.partitionBy("variable").orderBy("at"))
    examples = first.withColumn("k", rank).where("k <= 3").groupBy("variable").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]).alias("examples"))
    kind = F.create_map(*[F.lit(x) for n in chosen for x in (n, kinds[n])])
    return counts.join(examples, "variable", "left").select("variable", kind[F.col("variable")].alias("type"), "nonmissing", "missing", "distinct", F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def duplicates(df: DataFrame, *names: str) -> DataFrame:
    """Null keys are keys: total rows, groups, groups with copies, their rows, surplus rows, most copies."""
    keys = list(names) or names_of(df)
    need(df, *keys)
    groups = df.groupBy(*map(q, keys)).agg(F.count("*").alias("c"))
    more = F.col("c") > 1
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return groups.agg(zero(F.sum("c")).alias("total"), F.count("*").alias("distinct_groups"), F.count_if(more).alias("duplicate_groups"), zero(F.sum(F.when(more, F.col("c")))).alias("duplicate_rows"), zero(F.sum(F.col("c") - 1)).alias("surplus_rows"), zero(F.max("c")).alias("max_copies"))


def isid(df: DataFrame, *names: str, missok: bool = False) -> DataFrame:
    """One row: whether the keys identify rows, and non-null keys unless missok."""
    need(df, *names)
    some = F.lit(False)
    for n in names:
        some |= q(n).isNull()
    groups = df.groupBy(*map(q, names)).agg(F.count("*").alias("c"), F.max(some).alias("gap"))
    return groups.agg(F.count_if(F.col("c") > 1).alias("repeated_keys"), F.coalesce(F.sum(F.when(F.col("gap"), F.col("c"))), F.lit(0)).cast("bigint").alias("missing_rows")).withColumn("unique", (F.col("repeated_keys") == 0) & (F.lit(missok) | (F.col("missing_rows") == 0)))


def assert_rows(df: DataFrame, predicate: str | Column) -> DataFrame:
    """Rows checked and rows where the predicate is false or unknown."""
    return df.agg(F.count("*").alias("checked"), F.count_if(~truth(predicate)).alias("failed"))


def tabulate(df: DataFrame, row: str, column: str | None = None, predicate: str | Column | None = None, missing: bool = False, labels: bool = False) -> DataFrame:
    """Counts and percentages of the sample; two-way also by row and by column. Pre-aggregated before any window.

    With ``labels`` each variable has a text column beside it: the value's label, or the value as text where it has none.
    """
    names = [row] + ([column] if column else [])
    need(df, *names)
    sample = _where(df, predicate)
    if not missing:
        for n in names:
            sample = sample.where(q(n).isNotNull())
    counts = sample.groupBy(*map(q, names)).agg(F.count("*").alias("n"))
    share = lambda *by: 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*map(q, by)))
    out = counts.withColumn("percent", share())
    out = out.withColumn("row_percent", share(row)).withColumn("column_percent", share(column)) if column else out
    for n in names if labels else []:
        out = labelled(out, n, f"{n}_label")
        out = out.withColumn(f"{n}_label", F.coalesce(q(f"{n}_label"), q(n).cast("string")))
    return out


def by_count(df: DataFrame, *by: str) -> DataFrame:
    need(df, *by)
    return df.groupBy(*map(q, by)).agg(F.count("*").alias("n"))


def by_means(df: DataFrame, by: Sequence[str], *names: str) -> DataFrame:
    need(df, *by, *names)
    return df.groupBy(*map(q, by)).agg(*[F.avg(q(n).cast("double")).alias(f"mean_{n}") for n in names])


def collapse(df: DataFrame, stat: str, names: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row per group with stat_name columns; stat is count, mean, sum, min or max. Integer sums stay exact."""
    need(df, *names, *by)
    kinds = dict(df.dtypes)
    if stat != "count" and (bad := [n for n in names if not is_numeric(kinds[n])]):
        raise ValueError(f"not numeric: {', '.join(bad)}")
    whole = ("tinyint", "smallint", "int", "bigint")
    make = {"count": F.count, "mean": lambda c: F.avg(c.cast("double")), "min": F.min, "max": F.max}
    total = lambda n: F.sum(q(n).cast("decimal(38,0)")) if kinds[n] in whole else F.sum(q(n))
    aggs = [(total(n) if stat == "sum" else make[stat](q(n))).alias(f"{stat}_{n}") for n in names]
    return df.groupBy(*map(q, by)).agg(*aggs, F.min(ROW).alias(ROW))


_TURNS = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)


def _powers(turn: np.uint64, n: int) -> np.ndarray:
    """turn**(n - 1), ..., turn, 1 modulo 2**64."""
    up = np.full(max(n, 1), turn, np.uint64)
    up[0] = 1
    return np.multiply.accumulate(up)[::-1][max(n, 1) - n :]


def _part_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a range of rows in order: its number, its rows and two polynomials in its rows' hashes."""
    total, n = [0, 0], 0
    for batch in batches:
        leaf = batch.column(0).to_numpy().view(np.uint64)
        total = [(t * pow(int(turn), len(leaf), 1 << 64) + int((leaf * _powers(turn, len(leaf))).sum(dtype=np.uint64))) % (1 << 64) for t, turn in zip(total, _TURNS, strict=True)]
        n += len(leaf)
    yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n], pa.int64()), *(pa.array(np.array([t], np.uint64).view(np.int64)) for t in total)], ["part", "n", "a", "b"])


def datasignature(df: DataFrame) -> DataFrame:
    """A digest of schema and rows in order. One row: signature, rows.

    Rows are hashed, each range of rows gives two polynomials in its hashes, and those of neighbouring ranges combine
    to that of both, so neither partitions nor gaps in row numbers matter. The algorithm is this library's own.
    """
    schema = ";".join(f"{n}:{t}" for n, t in df.dtypes if n != ROW)
    cells = [F.concat(F.lit("v"), F.length(q(n).cast("string")).cast("string"), F.lit(":"), q(n).cast("string")) for n in names_of(df)]
    row = F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("null")) for c in cells]), 256)
    leaf = F.conv(F.substring(row, 1, 15), 16, 10).cast("bigint")
    rows = df.select(ROW, leaf.alias("leaf")).repartitionByRange(ROW).sortWithinPartitions(ROW).select("leaf")
    total, n = [0, 0], 0
    for r in sorted(rows.mapInArrow(_part_hashes, "part bigint, n bigint, a bigint, b bigint").collect()):
        total = [(t * pow(int(turn), r["n"], 1 << 64) + h) % (1 << 64) for t, turn, h in zip(total, _TURNS, (r["a"], r["b"]), strict=True)]
        n += r["n"]
    return df.sparkSession.createDataFrame([(hashlib.sha256(f"{schema}/{n}/{total[0]}/{total[1]}".encode()).hexdigest(), n)], "signature string, rows bigint")


def histogram(df: DataFrame, name: str, low: float, high: float, bins: int = 10) -> DataFrame:
    """Counts of finite values in equal bins of [low, high]; values outside are left out."""
    x = finite_or_null(q(name))
    width = (high - low) / bins
    at = F.least(F.floor((x - low) / width), F.lit(bins - 1))
    inside = df.where((x >= low) & (x <= high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return inside.select("bin", (low + F.col("bin") * width).alias("low"), (low + (F.col("bin") + 1) * width).alias("high"), "n")


def scatter_points(df: DataFrame, y: str, x: str, most: int = 10_000) -> DataFrame:
    """The finite pairs to draw, by x and row; more than ``most`` are an error, not a sample."""
    points = df.where(finite(q(x)) & finite(q(y))).select(number(q(x)).alias("x"), number(q(y)).alias("y"), ROW)
    if points.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} points")
    return points.orderBy("x", ROW).drop(ROW)
