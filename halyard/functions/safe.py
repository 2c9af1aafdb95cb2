"""Missing values and safe arithmetic.

Three notions of missing: null (counts, keys), not finite per variable
(summaries), and jointly not finite (estimation samples).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def is_numeric(kind: str) -> bool:
    return kind.split("(")[0] in NUMERIC


def number(column: Column) -> Column:
    return column.cast("double")


def finite(column: Column) -> Column:
    """True where the value is neither null, NaN nor infinite."""
    x = number(column)
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def finite_or_null(column: Column) -> Column:
    x = number(column)
    return F.when(finite(x), x)


def all_finite(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [finite(c) for c in columns])


def key(column: Column, kind: str) -> Column:
    """A grouping key: NaN and infinities are missing, both zeros are one."""
    return F.when(finite(column), column + F.lit(0.0)) if kind in ("float", "double") else column


def truth(predicate: str | Column) -> Column:
    """Rows where the predicate is true; unknown counts as false."""
    return F.coalesce(F.expr(predicate) if isinstance(predicate, str) else predicate, F.lit(False))


def guarded(expression: str | Column) -> Column:
    """An arithmetic result, null where it isn't a finite number."""
    return finite_or_null(F.expr(expression) if isinstance(expression, str) else expression)


def register(spark: SparkSession) -> None:
    """SQL functions for SQL text: isfinite, normal_cdf, t_pvalue, t_quantile."""
    from .dist import normal_cdf_udf, t_pvalue_udf, t_quantile_udf

    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION isfinite(x DOUBLE) RETURNS BOOLEAN RETURN coalesce(NOT isnan(x) AND abs(x) < double('inf'), false)")
    for name, udf in (("normal_cdf", normal_cdf_udf), ("t_pvalue", t_pvalue_udf), ("t_quantile", t_quantile_udf)):
        spark.udf.register(name, udf)


def sql(df: DataFrame, text: str, **tables: DataFrame) -> DataFrame:
    """Spark SQL over the view ``active`` and the named tables; only queries."""
    if text.strip().split(None, 1)[0].lower() not in ("select", "with"):
        raise ValueError("only SELECT or WITH")
    if "active" in tables:
        raise ValueError("active is reserved")
    df.drop("__row").createOrReplaceTempView("active")
    for name, table in tables.items():
        table.drop("__row").createOrReplaceTempView(name)
    return df.sparkSession.sql(text)


class Relations:
    """Named tables of a session: put under a name, used by it, and queried together."""

    def __init__(self):
        self.tables: dict[str, DataFrame] = {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        if not name.isidentifier() or name.lower() == "active":
            raise ValueError(f"not a table name: {name}")
        self.tables[name] = df
        return df

    def use(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise ValueError(f"unknown table: {name}")
        return self.tables[name]

    def drop(self, name: str) -> None:
        self.use(name)
        del self.tables[name]

    def sql(self, active: DataFrame, text: str, into: str | None = None) -> DataFrame:
        """A query over the view ``active`` and all named tables; with ``into`` the result, numbered in its order, gets a name."""
        from ..sources.tables import numbered

        out = numbered(sql(active, text, **self.tables))
        return self.put(into, out) if into else out
