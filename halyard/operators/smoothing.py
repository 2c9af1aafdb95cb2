"""Local smoothing of groups of any size.

Rows are numbered by group, x and row order, and dealt into blocks of BLOCK numbers.  A row's window is a run of numbers,
so for the rows of one block most blocks of the window lie in it whole, on one side.  There the tricube weight is a
polynomial in x, and weighted sums follow from a block's moments; only blocks at the windows' ends, and the rows' own,
are gone through row by row.  Moments are added up in a tree of FAN blocks a node, so a run of blocks is a few nodes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.safe import finite_or_null
from ..sources.shared import stored
from ..sources.tables import ROW, ranked
from .rows import need, q

#: Numbers of a block, and blocks or nodes of a node.
BLOCK, FAN = 512, 16
#: Highest power of x in a weighted sum: nine of the weight, two of the fit.
DEGREE = 11
_CHOOSE = np.array([[math.comb(p, m) for m in range(DEGREE + 1)] for p in range(DEGREE + 1)], float)
_LAG = np.maximum(np.arange(DEGREE + 1)[:, None] - np.arange(DEGREE + 1), 0)
_NODE = "g long, level int, i long, centre double, radius double, mx array<double>, my array<double>"


def _shifted(m: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Moments of scale * z + shift from those of z, for each scale and shift."""
    size = m.shape[-1]
    lifts = _CHOOSE[:size, :size] * np.power.outer(shift, _LAG[:size, :size])
    return (lifts @ (np.power.outer(scale, np.arange(size)) * m)[..., None])[..., 0]


def _joined(centre: np.ndarray, radius: np.ndarray, mx: np.ndarray, my: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """One node for several; z is the distance from the centre by the radius, 0 where that is 0."""
    low, high = (centre - radius).min(), (centre + radius).max()
    c, r = (low + high) / 2, (high - low) / 2
    scale, shift = (radius / r, (centre - c) / r) if r > 0 else (0 * radius, 0 * radius)
    return c, r, _shifted(mx, scale, shift).sum(axis=0), _shifted(my, scale, shift).sum(axis=0)


def _leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for g, i, x, y in zip(batch["g"], batch["i"], batch["xs"], batch["ys"], strict=True):
            x, y = np.asarray(x, float), np.asarray(y, float)
            c, r = (x[0] + x[-1]) / 2, (x[-1] - x[0]) / 2
            powers = np.power.outer((x - c) / r if r > 0 else 0 * x, np.arange(DEGREE + 1))
            out.append((g, 0, i, c, r, powers.sum(axis=0), y @ powers[:, :-1]))
        yield pd.DataFrame(out, columns=["g", "level", "i", "centre", "radius", "mx", "my"])


def _parent(nodes: pd.DataFrame) -> pd.DataFrame:
    c, r, mx, my = _joined(nodes["centre"].to_numpy(), nodes["radius"].to_numpy(), np.stack(nodes["mx"]), np.stack(nodes["my"]))
    return pd.DataFrame([(nodes["g"].iat[0], nodes["level"].iat[0] + 1, nodes["i"].iat[0] // FAN, c, r, mx, my)], columns=["g", "level", "i", "centre", "radius", "mx", "my"])


def covering(low: int, high: int, depth: int) -> list[tuple[int, int]]:
    """(level, number) of the nodes that make up the blocks from low to high - 1, levels below depth."""
    found = []
    for level in range(depth):
        if low >= high:
            break
        up, down = (-(-low // FAN), high // FAN) if level + 1 < depth else (0, 0)
        if up >= down:
            found += [(level, i) for i in range(low, high)]
            break
        found += [(level, i) for i in [*range(low, up * FAN), *range(down * FAN, high)]]
        low, high = up, down
    return found


def _half(n: int, bandwidth: float) -> int:
    return int((n * bandwidth - 0.5) // 2)


def _asks(batches: Iterator[pd.DataFrame], bandwidth: float, depth: int) -> Iterator[pd.DataFrame]:
    """For each block what its rows' windows take: blocks row by row (side 0), nodes before (-1) and after (1) the block."""
    for batch in batches:
        out = []
        for g, n, t, start, size in batch[["g", "n", "i", "start", "size"]].itertuples(index=False):
            k = max(_half(n, bandwidth), 0)
            last = start + size - 1
            # blocks that hold the first and the last ends of windows
            low, low_end = max(g, start - k) // BLOCK, max(g, last - k) // BLOCK
            high, high_end = (min(g + n, start + k + 1) - 1) // BLOCK, (min(g + n, last + k + 1) - 1) // BLOCK
            out += [(g, n, t, 0, -1, i) for i in sorted({*range(low, min(low_end, t) + 1), t, *range(max(high, t), high_end + 1)})]
            out += [(g, n, t, -1, *node) for node in covering(low_end + 1, t, depth)]
            out += [(g, n, t, 1, *node) for node in covering(t + 1, high, depth)]
        yield pd.DataFrame(out, columns=["g", "n", "t", "side", "level", "i"])


def _fitted(parts: pd.DataFrame, bandwidth: float) -> pd.DataFrame:
    """The smooth at the rows of one block."""
    g, n, t = (int(parts[c].iat[0]) for c in ("g", "n", "t"))
    k = _half(n, bandwidth)
    near = parts[parts["side"] == 0].sort_values("i")
    own = near[near["i"] == t].iloc[0]
    x, y = np.asarray(own["xs"], float), np.asarray(own["ys"], float)
    at = int(own["start"]) + np.arange(len(x))
    if k <= 0:
        return pd.DataFrame({"number": at, "fitted": y})
    numbers = np.concatenate([s + np.arange(len(v)) for s, v in zip(near["start"], near["xs"], strict=True)])
    all_x, all_y = np.concatenate(list(near["xs"])), np.concatenate(list(near["ys"]))
    first, end = np.maximum(g, at - k), np.minimum(g + n, at + k + 1)
    reach = np.maximum(x - all_x[np.searchsorted(numbers, first)], all_x[np.searchsorted(numbers, end - 1)] - x)
    h = np.where(reach > 0, 1.0001 * reach, 1.0)
    sums = np.zeros((5, len(x)))
    for a in range(0, len(x), 128):
        b = slice(a, a + 128)
        u = (all_x - x[b, None]) / h[b, None]
        inside = (numbers >= first[b, None]) & (numbers < end[b, None])
        u = np.where(inside, u, 1.0)
        a3 = np.minimum(np.abs(u), 1)
        a3 *= a3 * a3
        w = (1 - a3) * inside
        w *= (1 - a3) * (1 - a3)
        wu = w * u
        sums[:, b] += [w.sum(axis=1), wu.sum(axis=1), (wu * u).sum(axis=1), w @ all_y, wu @ all_y]
    for side in (-1, 1):
        far = parts[parts["side"] == side]
        if len(far):
            c, r, mx, my = _joined(far["centre"].to_numpy(), far["radius"].to_numpy(), np.stack(far["mx"]), np.stack(far["my"]))
            p, v = _shifted(mx, r / h, (c - x) / h), _shifted(my, r / h, (c - x) / h)
            weighted = lambda m, j, s=side: m[:, j] - 3 * s * m[:, j + 3] + 3 * m[:, j + 6] - s * m[:, j + 9]
            sums += [weighted(p, 0), weighted(p, 1), weighted(p, 2), weighted(v, 0), weighted(v, 1)]
    s, su, suu, sv, suv = sums
    det = s * suu - su * su
    flat = det <= 1e-12 * s * suu
    return pd.DataFrame({"number": at, "fitted": np.where(flat, sv / s, (suu * sv - su * suv) / np.where(flat, 1.0, det))})


def lowess(df: DataFrame, y: str, x: str, into: str, by: str | None = None, bandwidth: float = 2 / 3) -> DataFrame:
    """Locally linear tricube smooth over centred ranks, per group of ``by``, for groups of any size.

    A window has the given share of its group, cut off at its ends; ties in x stand in row order.  Where all of a window
    has one x, the smooth is its mean; where a window is the row alone, it is y.  Work grows with rows times BLOCK, not
    with the square of a group, and a task sees a few blocks of rows at a time.  Rows that aren't finite get null; a null
    group is a group.
    """
    need(df, y, x, *([by] if by else []))
    if not 0 < bandwidth < 1:
        raise ValueError("bandwidth must lie between 0 and 1")
    rows = df.withColumns({"__x": finite_or_null(q(x)), "__y": finite_or_null(q(y)), "__g": q(by) if by else F.lit(0)}).withColumnRenamed(ROW, "__was")
    # rows without a value come last, beyond all groups, so that all rows keep one table
    blank = F.col("__x").isNull() | F.col("__y").isNull()
    placed = ranked(rows.withColumn("__blank", blank), "__blank", "__g", "__x", "__was")
    used = placed.where("not __blank")
    held = F.sort_array(F.collect_list(F.struct(ROW, "__x", "__y")))
    blocks = used.groupBy("__g", F.expr(f"{ROW} div {BLOCK}").alias("i")).agg(held.alias("held"))
    blocks = stored(blocks.select("__g", "i", F.col(f"held.{ROW}")[0].alias("start"), F.size("held").alias("size"), F.col("held.__x").alias("xs"), F.col("held.__y").alias("ys")), "lowess-blocks")
    groups = blocks.groupBy("__g").agg(F.min("start").alias("g"), F.sum("size").alias("n"))
    blocks = blocks.join(groups, blocks["__g"].eqNullSafe(groups["__g"])).select("g", "n", "i", "start", "size", "xs", "ys")
    largest = groups.agg(F.max("n")).first()[0] or 0
    depth = 1
    nodes = stored(blocks.where(f"n > {3 * BLOCK}").select("g", "i", "xs", "ys").mapInPandas(_leaves, _NODE), "lowess-nodes")
    levels = [nodes]
    while largest > BLOCK * FAN**depth:
        levels.append(stored(levels[-1].groupBy("g", "level", F.expr(f"i div {FAN}")).applyInPandas(_parent, _NODE), "lowess-nodes"))
        depth += 1
    for more in levels[1:]:
        nodes = nodes.unionByName(more)
    asks = blocks.select("g", "n", "i", "start", "size").mapInPandas(lambda b: _asks(b, bandwidth, depth), "g long, n long, t long, side int, level int, i long")
    near = asks.where("side = 0").join(blocks.drop("n", "size"), ["g", "i"])
    far = asks.where("side <> 0").join(nodes, ["g", "level", "i"])
    parts = near.drop("level").unionByName(far.drop("level"), allowMissingColumns=True)
    smooth = parts.groupBy("g", "t").applyInPandas(lambda p: _fitted(p, bandwidth), "number long, fitted double")
    out = placed.join(smooth, placed[ROW] == smooth["number"], "left")
    return out.select(*[F.col("__was").alias(ROW) if c == ROW else q(c) for c in df.columns], F.col("fitted").alias(into))
