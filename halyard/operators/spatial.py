"""Spatial regressions: weights are a table of edges (source, target, weight), and W x is a join and a sum.

W x of a unit is the weighted sum of x over its edges' targets; a unit without edges has 0.  The models are
lag (y = a W y + X b + e, two-stage least squares on X, W X and W W X), error (e = r W e + u, r by moments of the
residuals, then transformed least squares) and sarar (both).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.safe import all_finite, number
from ..sources.shared import stored
from ..sources.tables import ROW
from .iv import ivregress
from .linear import Fit, regress
from .rows import need, q

_STEPS = {"rook": [(0, 1), (1, 0), (0, -1), (-1, 0)], "queen": [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]}


def contiguous(df: DataFrame, unit: str, row: str, column: str, kind: str = "queen") -> DataFrame:
    """Edges of weight 1 between units in touching cells of a grid: a common side (rook), or a side or corner (queen).

    Cells are whole numbers; units without a cell have no edges, units of one cell aren't neighbours of each other.
    """
    need(df, unit, row, column)
    if kind not in _STEPS:
        raise ValueError("kind is rook or queen")
    cells = df.select(q(unit).alias("unit"), q(row).cast("long").alias("r"), q(column).cast("long").alias("c")).where("r is not null and c is not null")
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _STEPS[kind]])
    asked = cells.select(F.col("unit").alias("source"), "r", "c", F.explode(steps).alias("s")).select("source", (F.col("r") + F.col("s.a")).alias("r"), (F.col("c") + F.col("s.b")).alias("c"))
    return asked.join(cells.withColumnRenamed("unit", "target"), ["r", "c"]).select("source", "target", F.lit(1.0).alias("weight"))


def standardised(edges: DataFrame) -> DataFrame:
    """Weights divided by their sum over each source; a source whose weights add up to 0 keeps them."""
    total = edges.groupBy(F.col("source").alias("__source")).agg(F.sum("weight").alias("__total"))
    each = F.when(F.col("__total") != 0, F.col("weight") / F.col("__total")).otherwise(F.col("weight"))
    return edges.join(total, F.col("source") == F.col("__source")).select("source", "target", each.alias("weight"))


def lagged(df: DataFrame, edges: DataFrame, unit: str, names: dict[str, str]) -> DataFrame:
    """Adds W x under a new name for each variable (x: name); edges to units that aren't there, or to a missing x, count for nothing."""
    need(df, unit, *names)
    sides = df.select(q(unit).alias("__target"), *[number(q(x)).alias(f"__{i}") for i, x in enumerate(names)])
    links = edges.select(F.col("source").alias("__source"), F.col("target").alias("__to"), F.col("weight").alias("__weight"))
    products = links.join(sides, F.col("__to") == F.col("__target")).groupBy("__source").agg(*[F.sum(F.col("__weight") * F.col(f"__{i}")).alias(f"__{i}") for i in range(len(names))])
    out = df.join(products, q(unit) == F.col("__source"), "left")
    return out.select(*[q(c) for c in df.columns], *[F.coalesce(F.col(f"__{i}"), F.lit(0.0)).alias(n) for i, n in enumerate(names.values())])


def residual_weight(units: DataFrame, edges: DataFrame, e: str) -> tuple[float, float]:
    """(r, variance) of e = r W e + u by the generalised moments of Kelejian and Prucha.

    The three moments are linear in r, its square and the variance.  Without the variance their squared distance is a
    polynomial of degree four in r, whose least value between -1 and 1 is taken exactly.
    """
    one = lagged(units.select("unit", q(e).alias("e")), edges, "unit", {"e": "we"})
    two = lagged(stored(one, "spatial"), edges, "unit", {"we": "wwe"})
    terms = ["e * e", "e * we", "e * wwe", "we * we", "we * wwe", "wwe * wwe"]
    n, ee, ef, eg, ff, fg, gg = two.agg(F.count("*"), *[F.expr(f"sum({t})") for t in terms]).first()
    squares = edges.agg(F.sum(F.col("weight") ** 2)).first()[0] or 0.0
    if n == 0 or ff == 0 or not squares:
        raise ValueError("no residual has neighbours")
    left = np.array([[2 * ef, -ff, n], [2 * fg, -gg, squares], [eg + ff, -fg, 0.0]]) / n
    right = np.array([ee, ff, ef]) / n
    v = left[:, 2]
    free = np.eye(3) - np.outer(v, v) / (v @ v)
    a, b, c = free @ left[:, 1], free @ left[:, 0], -(free @ right)
    distance = np.polynomial.Polynomial([c @ c, 2 * b @ c, b @ b + 2 * a @ c, 2 * a @ b, a @ a])
    turns = [z.real for z in distance.deriv().roots() if abs(z.imag) < 1e-9 and -1 < z.real < 1]
    r = float(min([*turns, -0.999999, 0.999999], key=distance))
    return r, float(v @ (right - left[:, 0] * r - left[:, 1] * r * r) / (v @ v))


def spregress(df: DataFrame, y: str, *terms: str, unit: str, edges: DataFrame, model: str = "lag", standardise: bool = True, robust: bool = False) -> Fit:
    """A spatial regression; the coefficient of W y is named W.y, and stats hold r (``error_weight``) and its variance.

    Rows where y or a term is missing leave first, with their edges; edges of a unit with itself or to unknown units are
    dropped, and repeated ones add up.  A unit twice, or a row without one, is an error.  ``standardise`` divides weights
    by their sum over a unit's edges that are left.  Standard errors take r as known.
    """
    need(df, y, *terms, unit)
    if model not in ("lag", "error", "sarar"):
        raise ValueError("model is lag, error or sarar")
    if not terms:
        raise ValueError("a spatial regression needs a term")
    names = [f"x{i}" for i in range(len(terms))]
    wanted = {"y": y, **dict(zip(names, terms, strict=True))}
    sample = stored(df.where(all_finite([number(q(c)) for c in wanted.values()])).select(q(unit).alias("unit"), *[number(q(c)).alias(k) for k, c in wanted.items()], F.lit(1.0).alias("one")), "spatial")
    if sample.where("unit is null").limit(1).count() or sample.groupBy("unit").count().where("count > 1").limit(1).count():
        raise ValueError("every row needs a unit of its own")
    ids = sample.select(F.col("unit").alias("__unit"))
    links = edges.where("source <> target and weight is not null").groupBy("source", "target").agg(F.sum(F.col("weight").cast("double")).alias("weight"))
    links = links.join(ids, F.col("source") == F.col("__unit"), "left_semi").join(ids, F.col("target") == F.col("__unit"), "left_semi")
    links = stored(standardised(links) if standardise else links, "spatial")
    first = stored(lagged(sample, links, "unit", {c: f"w_{c}" for c in ["y", "one", *names]}), "spatial")
    units = stored(lagged(first, links, "unit", {f"w_{c}": f"ww_{c}" for c in ["y", *names]}), "spatial").withColumn(ROW, F.lit(0))
    tools = [f"w_{c}" for c in names] + [f"ww_{c}" for c in names]

    def two_stages(table: DataFrame) -> Fit:
        return ivregress(table, "y", *names, endog=["w_y"], iv=tools, robust=robust)

    labels = {"w_y": "W.y", "one": "_cons", **dict(zip(names, terms, strict=True))}

    def named(fit: Fit, **stats: float) -> Fit:
        fit.kind, fit.names = f"spatial_{model}", [labels.get(n, n) for n in fit.names]
        fit.stats |= stats
        return fit

    if model == "lag":
        return named(two_stages(units))
    start = regress(units, "y", *names) if model == "error" else two_stages(units)
    e = F.col("y")
    for name, b in zip(start.names, start.beta.tolist(), strict=True):
        e = e - (F.lit(b) if name == "_cons" else b * F.col(name))
    r, variance = residual_weight(units.withColumn("e", e), links, "e")
    turned = units.withColumns({"y": F.expr(f"y - ({r!r}D) * w_y"), "w_y": F.expr(f"w_y - ({r!r}D) * ww_y"), **{c: F.expr(f"{c} - ({r!r}D) * w_{c}") for c in ["one", *names]}})
    if model == "error":
        fit = regress(turned, "y", "one", *names, constant=False, robust=robust)
    else:
        kept = turned.withColumn("unity", F.lit(1.0)).withColumns({f"h_{c}": F.expr(f"{c} + ({r!r}D) * w_{c}") for c in names})
        fit = ivregress(kept, "y", endog=["one", *names, "w_y"], iv=["unity", *[f"h_{c}" for c in names], *tools], constant=False, robust=robust)
    return named(fit, error_weight=r, error_variance=variance)


def effects(fit: Fit, sources: Sequence[str] | None = None) -> dict[str, float]:
    """Total effect of each term in a lag model with standardised weights: b / (1 - a)."""
    if "W.y" not in fit.names:
        raise ValueError("effects need a lag of y")
    return {n: fit[n] / (1 - fit["W.y"]) for n in (sources or [n for n in fit.names if n not in ("W.y", "_cons")])}
