"""Filters, projections, derived columns, sorting, joins and reshapes. Order is the column ``__row``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import guarded, is_numeric, truth
from ..sources.shared import dropped, stored
from ..sources.tables import ROW, arranged, place, ranked


#: Most columns that one variable is spread over.
MAX_COLUMNS = 5_000
#: Right rows of a key from which its pairs are counted, pairs from which a key is split over tasks, and about the most shares of all split keys.
OFTEN, PAIRS, SHARES = 100, 1 << 22, 400


def names_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW]


def need(df: DataFrame, *names: str) -> None:
    if missing := [n for n in names if n not in names_of(df)]:
        raise ValueError(f"unknown variable: {', '.join(missing)}")


def q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def keep_if(df: DataFrame, predicate: str | Column) -> DataFrame:
    return df.where(truth(predicate))


def drop_if(df: DataFrame, predicate: str | Column) -> DataFrame:
    """Keeps the exact complement: rows where the predicate is false or unknown."""
    return df.where(~truth(predicate))


def keep(df: DataFrame, *names: str) -> DataFrame:
    """In the order asked for; a repeated name gets a number."""
    need(df, *names)
    used: dict[str, int] = {}
    out = []
    for n in names:
        used[n] = used.get(n, -1) + 1
        out.append(q(n).alias(f"{n}_{used[n]}" if used[n] else n))
    return df.select(*out, ROW)


def drop(df: DataFrame, *names: str) -> DataFrame:
    need(df, *names)
    if len(left := [c for c in names_of(df) if c not in names]) == 0:
        raise ValueError("no variable would remain")
    return df.select(*map(q, left), ROW)


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    need(df, old)
    if new in df.columns:
        raise ValueError(f"{new} exists")
    return df.withColumnRenamed(old, new)


def generate(df: DataFrame, name: str, expression: str | Column) -> DataFrame:
    """A numeric column, null where the result isn't finite."""
    if name in df.columns:
        raise ValueError(f"{name} exists")
    return df.withColumn(name, guarded(expression))


def replace(df: DataFrame, name: str, expression: str | Column, predicate: str | Column | None = None) -> DataFrame:
    """New values where the predicate holds; type and place of the column stay."""
    need(df, name)
    kind = dict(df.dtypes)[name]
    value = guarded(expression) if is_numeric(kind) else (F.expr(expression) if isinstance(expression, str) else expression)
    value = value.cast(kind) if not is_numeric(kind) or kind in ("double", "float") else value
    return df.withColumn(name, value if predicate is None else F.when(truth(predicate), value).otherwise(q(name)))


def recode(df: DataFrame, name: str, rules: Sequence[tuple], into: str | None = None) -> DataFrame:
    """First matching rule wins. Rules: (value, new), ((low, high), new) with None for an open end,
    ("missing", new), ("nonmissing", new) or ("else", new)."""
    need(df, name)
    text = not is_numeric(dict(df.dtypes)[name]) or any(isinstance(new, str) for _, new in rules)
    out, last = None, q(name).cast("string") if text else q(name).cast("double")
    for what, new in rules:
        if what == "else":
            last = F.lit(new)
            break
        if what in ("missing", "nonmissing"):
            test = q(name).isNull() if what == "missing" else q(name).isNotNull()
        elif isinstance(what, tuple):
            low, high = what
            test = q(name).isNotNull()
            test = test & (q(name) >= low) if low is not None else test
            test = test & (q(name) <= high) if high is not None else test
        else:
            test = q(name) == F.lit(what)
        out = F.when(test, F.lit(new)) if out is None else out.when(test, F.lit(new))
    value = last if out is None else out.otherwise(last)
    return df.withColumn(into or name, value.cast("string") if text else value.cast("double"))


def encode(df: DataFrame, name: str, into: str) -> tuple[DataFrame, DataFrame]:
    """Sorted distinct strings become 1..K. Returns the table and the label set (code, label)."""
    need(df, name)
    levels = df.select(q(name).alias("label")).where("label is not null").distinct()
    labels = ranked(levels, "label").select((F.col(ROW) + 1).alias("code"), "label")
    named = labels.select(F.col("code").alias(into), F.col("label").alias("__label"))
    return df.join(named, q(name) == F.col("__label"), "left").drop("__label").select(*names_of(df), into, ROW), labels


def decode(df: DataFrame, name: str, labels: DataFrame, into: str) -> DataFrame:
    """The label of each code; unknown codes are null."""
    need(df, name)
    named = labels.select(F.col("code").alias("__code"), F.col("label").alias(into))
    return df.join(named, q(name) == F.col("__code"), "left").select(*names_of(df), into, ROW)


def sort(df: DataFrame, *names: str) -> DataFrame:
    """Ascending, nulls last, ties in their former order."""
    return gsort(df, *names)


def gsort(df: DataFrame, *keys: str) -> DataFrame:
    """Keys with + or - before the name; nulls last both ways."""
    order = []
    for k in keys:
        n = k.lstrip("+-")
        need(df, n)
        order.append(q(n).desc_nulls_last() if k.startswith("-") else q(n).asc_nulls_last())
    return arranged(df.withColumnRenamed(ROW, "__was"), *order, "__was").drop("__was")


def head(df: DataFrame, n: int = 5) -> DataFrame:
    return df.orderBy(ROW).limit(n)


def tail(df: DataFrame, n: int = 5) -> DataFrame:
    return df.orderBy(F.desc(ROW)).limit(n).orderBy(ROW)


def join_tables(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", suffix: str = "_right") -> DataFrame:
    """Null keys never match; output by left row, then right row; names that clash get the suffix.

    The right keys are counted first. A key with many pairs is split: its left rows are dealt into shares, each of which gets
    all its right rows, so that more machines make the pairs of one key faster.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    need(left, *on)
    need(right, *on)
    taken, renamed = set(names_of(left)), []
    for c in names_of(right):
        if c in on:
            continue
        new = c if c not in taken else c + suffix
        n = 2
        while new in taken:
            new, n = f"{c}{suffix}_{n}", n + 1
        taken.add(new)
        renamed.append(q(c).alias(new))
    keys = [q(k).alias(f"__k{i}") for i, k in enumerate(on)]
    other = right.select(*keys, *renamed, place(right).alias("__right"))
    mine, match, extra = left.withColumn(ROW, place(left)), [q(k) == F.col(f"__k{i}") for i, k in enumerate(on)], [f"__k{i}" for i in range(len(on))]
    if (split := _shares(left, right, on)) is not None:
        shares, n = split
        named, parts = [F.col(f"__s{i}") for i in range(len(on))], F.coalesce("__parts", F.lit(1))
        mine = mine.join(F.broadcast(shares), [q(k) == s for k, s in zip(on, named, strict=True)], "left").withColumn("__share", F.pmod(F.xxhash64(ROW), parts).cast("int")).drop("__parts", *[f"__s{i}" for i in range(len(on))])
        other = other.join(F.broadcast(shares), [F.col(k) == s for k, s in zip(extra, named, strict=True)], "left").withColumn("__copy", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts", *[f"__s{i}" for i in range(len(on))])
        # numbers of partitions that are asked for stay: few bytes make many pairs
        mine, other = mine.repartition(n, *map(q, on), "__share"), other.repartition(n, *extra, "__copy")
        match, extra = [*match, F.col("__share") == F.col("__copy")], [*extra, "__share", "__copy"]
    joined = mine.join(other, match, how).drop(*extra)
    return joined.withColumn(ROW, F.concat(ROW, F.coalesce("__right", F.array().cast("array<bigint>")))).drop("__right")


def _shares(left: DataFrame, right: DataFrame, on: Sequence[str]) -> tuple[DataFrame, int] | None:
    """(key columns __s0.., __parts) of the keys to split, SHARES of them at most, and a number of partitions; None without such keys."""
    kinds = dict(left.dtypes), dict(right.dtypes)
    if not on or any(kinds[0][k] != kinds[1][k] for k in on):
        return None
    names = [f"__s{i}" for i in range(len(on))]
    keyed = [df.select(*[q(k).alias(n) for k, n in zip(on, names, strict=True)]).dropna(how="any").groupBy(*names) for df in (left, right)]
    often = stored(keyed[1].agg(F.count("*").alias("__r")).where(F.col("__r") >= OFTEN), "often")
    if often.isEmpty():
        dropped(often)
        return None
    pairs = stored(keyed[0].agg(F.count("*").alias("__l")).join(often, names).select(*names, (F.col("__l") * F.col("__r").cast("double")).alias("__pairs")), "pairs")
    dropped(often)
    most = max(PAIRS, (pairs.agg(F.sum("__pairs")).first()[0] or 0) / SHARES)
    shares = pairs.where(F.col("__pairs") > most).select(*names, F.ceil(F.col("__pairs") / most).cast("int").alias("__parts"))
    parts = shares.agg(F.sum("__parts")).first()[0]
    return (shares, max(2 * parts, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))) if parts else None


def append(top: DataFrame, bottom: DataFrame) -> DataFrame:
    """The rows of both, by name; the same columns and types are required."""
    if dict(top.drop(ROW).dtypes) != dict(bottom.drop(ROW).dtypes):
        raise ValueError("columns or types differ")
    sides = [df.withColumn(ROW, F.concat(F.array(F.lit(side).cast("bigint")), place(df))) for side, df in enumerate((top, bottom))]
    return sides[0].unionByName(sides[1])


def reshape_long(df: DataFrame, stubs: Sequence[str], i: Sequence[str], j: str) -> DataFrame:
    """Columns stub_suffix become rows; suffixes in order of first appearance; j is text."""
    need(df, *i)
    found: dict[str, list[str]] = {}
    for c in names_of(df):
        for s in stubs:
            if c.startswith(s + "_"):
                found.setdefault(c[len(s) + 1 :], []).append(s)
    if not found or any(sorted(v) != sorted(stubs) for v in found.values()):
        raise ValueError("incomplete set of columns")
    rows = F.array(*[F.struct(F.lit(n).cast("bigint").alias("__n"), F.lit(s).alias(j), *[q(f"{x}_{s}").alias(x) for x in stubs]) for n, s in enumerate(found)])
    out = df.select(*map(q, i), place(df).alias(ROW), F.inline(rows))
    return out.withColumn(ROW, F.concat(ROW, F.array("__n"))).select(*map(q, i), q(j), *map(q, stubs), ROW)


def reshape_wide(df: DataFrame, values: Sequence[str], i: Sequence[str], j: str) -> DataFrame:
    """Values of j become columns value_j, sorted; groups in order of their first row. More than MAX_COLUMNS values are an error."""
    need(df, *values, *i, j)
    levels = sorted(r[0] for r in df.select(q(j).cast("string").alias("j")).where("j is not null").distinct().limit(MAX_COLUMNS + 1).collect())
    if len(levels) > MAX_COLUMNS:
        raise ValueError(f"{j} has more than {MAX_COLUMNS} values")
    if not levels:
        raise ValueError("no values of j")
    cells = [F.max(F.when(q(j).cast("string") == level, q(v))).alias(f"{v}_{level}") for v in values for level in levels]
    return df.groupBy(*map(q, i)).agg(*cells, F.min(ROW).alias(ROW))


def lagged(df: DataFrame, name: str, by: Sequence[str], order: str, n: int = 1) -> Column:
    return F.lag(q(name), n).over(Window.partitionBy(*map(q, by)).orderBy(q(order)))


def label_variable(df: DataFrame, name: str, text: str) -> DataFrame:
    """Keeps a label in the column's metadata; it follows renames and Parquet files."""
    need(df, name)
    return df.withMetadata(name, {**df.schema[name].metadata, "label": text})


def label_values(df: DataFrame, name: str, labels: dict[int, str]) -> DataFrame:
    """Keeps the labels of integer codes in the column's metadata."""
    need(df, name)
    return df.withMetadata(name, {**df.schema[name].metadata, "values": {str(k): v for k, v in labels.items()}})


def labels_of(df: DataFrame) -> dict[str, dict]:
    return {f.name: f.metadata for f in df.schema if "label" in f.metadata or "values" in f.metadata}


def labelled(df: DataFrame, name: str, into: str) -> DataFrame:
    """A text column with the labels of a column's codes; unknown codes are null."""
    need(df, name)
    out = F.lit(None).cast("string")
    for k, v in df.schema[name].metadata.get("values", {}).items():
        out = F.when(q(name) == int(k), v).otherwise(out)
    return df.withColumn(into, out)
