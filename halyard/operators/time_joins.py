"""As-of joins and interval joins.

As-of: both sides become one table, dealt into ranges of key and time, so a key that holds a third of all rows is spread
over as many tasks as its rows need.  Each range carries its last right row forward; what a range's first key needs from
ranges before it comes from a table with a row for each range.

Intervals: each goes to the size class of the next power of two and touches at most two cells there; a point looks up one
cell in each class that occurs.  So an interval of any length makes at most two rows, and the join is one of equal keys,
whose hot cells Spark can split.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from ..sources.tables import ROW, place
from .rows import names_of, need, q


def _renamed(left: DataFrame, right: DataFrame, skip: Sequence[str], suffix: str) -> dict[str, str]:
    """New names of the right side's columns, beside the left's."""
    taken, out = set(names_of(left)), {}
    for c in names_of(right):
        if c not in skip:
            new = c
            while new in taken:
                new += suffix
            taken.add(new)
            out[c] = new
    return out


def _order(df: DataFrame) -> Column:
    return place(df) if ROW in df.columns else F.array().cast("array<bigint>")


def asof_join(left: DataFrame, right: DataFrame, time: str, right_time: str | None = None, by: Sequence[str] = (), direction: str = "backward", strict: bool = False, how: str = "left", tolerance: Column | None = None, suffix: str = "_right") -> DataFrame:
    """Each left row with the last right row of its keys at or before its time (``forward``: the first at or after it).

    With ``strict`` equal times don't match. ``tolerance`` is an interval or number that the match may be away at most.
    Of right rows with equal times the last in their order matches (forward: the first). Null keys and times never match:
    such left rows stay alone, or go with ``how`` inner. The left side's columns and order stay.
    """
    if direction not in ("backward", "forward") or how not in ("left", "inner"):
        raise ValueError("direction is backward or forward, how is left or inner")
    other = right_time or time
    need(left, time, *by)
    need(right, other, *by)
    back = direction == "backward"
    names = _renamed(left, right, list(by), suffix)
    keys = [f"__k{i}" for i in range(len(by))]
    kinds = {k: dict(left.dtypes)[b] for k, b in zip(keys, by, strict=True)}
    whole = lambda t: reduce(Column.__and__, [q(b).isNotNull() for b in by], q(t).isNotNull())
    own = F.struct(*[q(c) for c in left.columns]).alias("__left")
    given = F.struct(*[q(c).alias(n) for c, n in names.items()]).alias("__right")
    # at equal times a right row stands before the left ones that it matches
    first_side = 1 if strict else 0
    kind = dict(left.dtypes)[time]
    lefts = left.where(whole(time)).select(*[q(b).alias(k) for k, b in zip(keys, by, strict=True)], q(time).alias("__time"), F.lit(1 - first_side).alias("__side"), _order(left).alias("__tie"), own, F.lit(None).cast(right.select(given).dtypes[0][1]).alias("__right"))
    rights = right.where(whole(other)).select(*[q(b).cast(kinds[k]).alias(k) for k, b in zip(keys, by, strict=True)], q(other).cast(kind).alias("__time"), F.lit(first_side).alias("__side"), _order(right).alias("__tie"), F.lit(None).cast(left.select(own).dtypes[0][1]).alias("__left"), given)
    order = [*[F.col(k) for k in keys], F.col("__time") if back else F.col("__time").desc(), "__side", F.col("__tie") if back else F.col("__tie").desc()]
    # ranges are written once, so that their bounds and their rows are of one evaluation
    ranges = stored(lefts.union(rights).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "asof")
    within = Window.partitionBy("__part", *keys).orderBy(*order[len(keys):])
    carried = ranges.withColumn("__found", F.last("__right", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    key = F.struct(*keys, F.lit(0).alias("__any"))
    rank = F.struct("__time", "__tie")
    ahead = F.col("__right").isNotNull()
    # a row for each range: its first and last key, and the last right row of the last key
    ends = ranges.groupBy("__part").agg(F.min(key).alias("__first"), F.max(key).alias("__last"))
    finals = ranges.where(ahead).join(F.broadcast(ends.select("__part", "__last")), "__part").where(key == F.col("__last"))
    best = (F.max_by if back else F.min_by)("__right", rank)
    last = finals.groupBy("__part").agg(best.alias("__kept"))
    bounds = stored(ends.join(last, "__part", "left"), "asof-bounds")
    # earlier ranges that end with the key which this one begins with
    before = bounds.select(F.col("__part").alias("__earlier"), F.col("__last").alias("__first"), F.col("__kept")).where("__kept IS NOT NULL")
    found = bounds.select("__part", "__first").join(F.broadcast(before), "__first").where("__earlier < __part").groupBy("__part", "__first").agg(F.max_by("__kept", "__earlier").alias("__brought"))
    joined = carried.where(F.col("__left").isNotNull()).join(F.broadcast(found.select("__part", F.col("__first"), "__brought")), (carried["__part"] == found["__part"]) & (key == F.col("__first")), "left")
    match = F.coalesce("__found", "__brought")
    if tolerance is not None:
        away = F.col(f"__left.`{time}`") - match[names[other]] if back else match[names[other]] - F.col(f"__left.`{time}`")
        match = F.when(away <= tolerance, match)
    matched = joined.select("__left.*", match.alias("__match"))
    out = matched.select(*[q(c) for c in left.columns], *[F.col("__match")[n].alias(n) for n in names.values()], F.col("__match").isNotNull().alias("__hit"))
    if how == "inner":
        return out.where("__hit").drop("__hit")
    lone = left.where(~whole(time))
    kinds_right = dict(right.dtypes)
    nothing = lone.select(*[q(c) for c in left.columns], *[F.lit(None).cast(kinds_right[c]).alias(n) for c, n in names.items()])
    return out.drop("__hit").union(nothing)


def _number(c: Column, kind: str) -> Column:
    """A time as a whole number of microseconds or days, a number as it is."""
    if kind == "timestamp":
        return F.unix_micros(c)
    if kind == "timestamp_ntz":
        # by the clock's own parts, as a zone may repeat an hour
        seconds = F.unix_date(c.cast("date")).cast("long") * 86_400 + F.hour(c) * 3_600 + F.minute(c) * 60
        return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return F.unix_date(c) if kind == "date" else c.cast("double")


#: Size classes are powers of two of one of these units.
SMALLEST = -40


def interval_join(points: DataFrame, intervals: DataFrame, time: str, start: str, end: str, by: Sequence[str] = (), how: str = "inner", suffix: str = "_right") -> DataFrame:
    """Each point with every interval of its keys that holds it: start <= time < end.

    Empty intervals (end <= start) and nulls in key, time or bounds match nothing; with ``how`` left such points, and others
    without an interval, stay once with nulls. Repeated rows stay: points are told apart by their place.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    need(points, time, *by)
    need(intervals, start, end, *by)
    names = _renamed(points, intervals, list(by), suffix)
    kinds = dict(intervals.dtypes)
    lo, hi = (_number(q(c), kinds[c]) for c in (start, end))
    length = (hi - lo).cast("double")
    # the class whose cells are at least as long as the interval
    size = F.greatest(F.ceil(F.log2(length)), F.lit(SMALLEST)).cast("int")
    cell = lambda v, c: F.floor(v.cast("double") / F.pow(F.lit(2.0), c))
    keys = [f"__k{i}" for i in range(len(by))]
    spans = intervals.where((lo < hi) & q(start).isNotNull() & q(end).isNotNull())
    spans = spans.select(*[q(b).alias(k) for k, b in zip(keys, by, strict=True)], lo.alias("__lo"), hi.alias("__hi"), size.alias("__class"), *[q(c).alias(n) for c, n in names.items()])
    spans = spans.withColumn("__cell", F.explode(F.array_distinct(F.array(cell(F.col("__lo"), F.col("__class")), cell(F.col("__hi"), F.col("__class"))))))
    # there are at most some tens of classes, whatever the number of intervals
    classes = sorted(r[0] for r in spans.select("__class").distinct().collect())
    at = _number(q(time), dict(points.dtypes)[time])
    placed_ = points.withColumns({"__at": at, "__class": F.explode(F.array(*[F.lit(c) for c in classes])) if classes else F.lit(None).cast("int")})
    placed_ = placed_.withColumn("__cell", cell(F.col("__at"), F.col("__class")))
    on = (placed_["__class"] == spans["__class"]) & (placed_["__cell"] == spans["__cell"]) & (F.col("__lo") <= F.col("__at")) & (F.col("__at") < F.col("__hi"))
    for k, b in zip(keys, by, strict=True):
        on = on & (placed_[b] == spans[k])
    if how == "inner":
        return placed_.join(spans, on).select(*[placed_[c] for c in points.columns], *[spans[n] for n in names.values()])
    # a point has a row in each class: those that met nothing leave one row, if none of them met anything
    if ROW not in points.columns:
        raise ValueError("a left join tells points apart by their place, which these rows lack")
    met = placed_.join(spans, on).select(*[placed_[c] for c in points.columns], *[spans[n] for n in names.values()])
    some = met.select(F.col(ROW).alias("__seen")).distinct()
    alone = points.join(some, points[ROW] == some["__seen"], "left_anti").select(*points.columns, *[F.lit(None).cast(kinds[c]).alias(n) for c, n in names.items()])
    return met.unionByName(alone)
