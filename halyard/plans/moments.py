"""Estimation samples, designs with factor terms, and distributed sums.

Rows stay in Spark. A fit sees small results only: counts, cross products,
scores, and their sums by cluster.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.safe import all_finite, is_numeric, key, number, truth
from ..operators.rows import need, q

_FACTOR = re.compile(r"i(?:b\((.*)\))?\.(.+)")
MAX_LEVELS = 1000


@dataclass(frozen=True)
class Term:
    """A column of the design: a variable, or an indicator of a variable's level."""

    name: str
    variable: str
    level: object = None
    factor: bool = False

    def column(self) -> Column:
        if not self.factor:
            return number(q(self.variable))
        return F.when(q(self.variable).isNotNull(), (q(self.variable) == F.lit(self.level)).cast("double"))


@dataclass
class Design:
    """Complete cases: y, x1..xk (without the constant), optional weight w and cluster g."""

    rows: DataFrame
    outcome: str
    terms: list[Term]
    constant: bool
    source: DataFrame

    @property
    def names(self) -> list[str]:
        return (["_cons"] if self.constant else []) + [t.name for t in self.terms]

    @property
    def k(self) -> int:
        return len(self.names)

    def x(self) -> list[Column]:
        return ([F.lit(1.0)] if self.constant else []) + [F.col(f"x{i}") for i in range(len(self.terms))]


def _plain(terms: Sequence[str]) -> list[tuple[str, str | None, bool]]:
    out = []
    for t in terms:
        m = _FACTOR.fullmatch(t)
        out.append((m[2], m[1], True) if m else (t, None, False))
    return out


def design(df: DataFrame, y: str, terms: Sequence[str], predicate: str | Column | None = None, constant: bool = True, weight: str | None = None, cluster: str | None = None, extra: dict[str, Column] | None = None, outcome: Column | None = None) -> Design:
    """Rows where outcome, terms, weight, cluster and extras are all there and finite; levels come from those rows."""
    plain, kinds = _plain(terms), dict(df.dtypes)
    need(df, *([y] if outcome is None else []), *[v for v, _, _ in plain], *[n for n in (weight, cluster) if n])
    if bad := [v for v, _, factor in plain if not factor and not is_numeric(kinds[v])]:
        raise ValueError(f"not numeric: {', '.join(bad)}")
    sample = df if predicate is None else df.where(truth(predicate))
    response = number(q(y)) if outcome is None else outcome
    extra = extra or {}
    fine = all_finite([response, *[q(v) for v, _, factor in plain if not factor], *([q(weight)] if weight else []), *extra.values()])
    for v, _, factor in plain:
        fine &= q(v).isNotNull() if factor else F.lit(True)
    if cluster:
        fine &= key(q(cluster), kinds[cluster]).isNotNull()
    sample = sample.where(fine)
    full: list[Term] = []
    for v, base, factor in plain:
        if not factor:
            full.append(Term(v, v))
            continue
        levels = [r[0] for r in sample.select(q(v)).distinct().orderBy(v).limit(MAX_LEVELS + 1).collect()]
        if len(levels) > MAX_LEVELS:
            raise ValueError(f"{v} has more than {MAX_LEVELS} levels")
        skip = levels[0] if base is None and levels else next((x for x in levels if str(x) == base), None)
        full += [Term(f"{v}_{x}", v, x, True) for x in levels if x != skip]
    columns = [response.alias("y"), *[t.column().alias(f"x{i}") for i, t in enumerate(full)]]
    columns += [number(q(weight)).alias("w")] if weight else []
    columns += [key(q(cluster), kinds[cluster]).alias("g")] if cluster else []
    columns += [c.cast("double").alias(n) for n, c in extra.items()]
    return Design(sample.select(*columns), y, full, constant, df)


def _pair_sums(columns: list[Column], weight: Column | None = None) -> list[Column]:
    w = F.lit(1.0) if weight is None else weight
    return [F.sum(w * columns[i] * columns[j]).alias(f"s{i}_{j}") for i in range(len(columns)) for j in range(i, len(columns))]


def _square(row, n: int) -> np.ndarray:
    out = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            out[i, j] = out[j, i] = row[f"s{i}_{j}"] or 0.0
    return out


def cross_products(rows: DataFrame, columns: list[Column], weight: Column | None = None) -> tuple[int, np.ndarray]:
    """Row count and the symmetric matrix of weighted sums of products; one job, partial sums before the exchange.

    Columns are shifted by their means first, and the shift is undone in exact algebra on the driver, so that
    large means don't cost digits.
    """
    n = len(columns)
    w = F.lit(1.0) if weight is None else weight
    means = rows.agg(F.count("*").alias("n"), F.sum(w).alias("w"), *[(F.sum(w * c) / F.sum(w)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    if not means["n"]:
        raise ValueError("no observations")
    m = np.array([means[f"m{i}"] for i in range(n)])
    shifted = [c - F.lit(float(v)) for c, v in zip(columns, m, strict=True)]
    row = rows.agg(*_pair_sums(shifted, weight), *[F.sum(w * c).alias(f"d{i}") for i, c in enumerate(shifted)]).first()
    d = np.array([row[f"d{i}"] for i in range(n)])
    return means["n"], _square(row, n) + np.outer(m, d) + np.outer(d, m) + means["w"] * np.outer(m, m)


def meat(rows: DataFrame, scores: list[Column], cluster: bool = False) -> tuple[int, np.ndarray]:
    """Sum of outer products of scores, by row or by cluster sum, and the number of rows or clusters."""
    k = len(scores)
    each = rows.select(*[s.alias(f"u{i}") for i, s in enumerate(scores)], *(["g"] if cluster else []))
    if cluster:
        each = each.groupBy("g").agg(*[F.sum(f"u{i}").alias(f"u{i}") for i in range(k)])
    row = each.agg(F.count("*").alias("n"), *_pair_sums([F.col(f"u{i}") for i in range(k)])).first()
    return row["n"], _square(row, k)


def linear(columns: list[Column], beta: np.ndarray) -> Column:
    out = F.lit(0.0)
    for c, b in zip(columns, beta, strict=True):
        out = out + F.lit(float(b)) * c
    return out


def solved(a: np.ndarray, names: Sequence[str]) -> np.ndarray:
    """Inverse of a cross-product matrix; collinear columns are an error."""
    scale = np.sqrt(np.clip(np.diag(a), 1e-300, None))
    unit = a / np.outer(scale, scale)
    if np.linalg.matrix_rank(unit, tol=1e-10) < len(a):
        raise ValueError(f"collinear: {', '.join(names)}")
    return np.linalg.inv(unit) / np.outer(scale, scale)


def partial_sums(rows: DataFrame, columns: list[Column], kernel: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Adds up kernel(values) over all rows: numpy in each Arrow batch, one short vector per partition, sums in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = kernel(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "value"])

    named = rows.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    out = named.mapInArrow(run, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(len(out))
    for r in out:
        total[r["at"]] = r["value"]
    return total
