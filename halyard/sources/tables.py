"""Reading and writing tables. Every table carries its row order in the hidden column ``__row``.

The order is a value to sort by, not a number: a bigint that ascends (with gaps), or a list of them that is compared
place by place, as joins, appended and reshaped tables have it.  So these need no shuffle for the order's sake.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stored

ROW = "__row"


def numbered(df: DataFrame) -> DataFrame:
    """Adds the order of rows as read; ids ascend over partitions without a shuffle."""
    return df.withColumn(ROW, F.monotonically_increasing_id())


#: Rows of one file that the order has room for; files get the bits above.
FILE_BITS = 40


def _with_file_number(df: DataFrame) -> DataFrame:
    """Adds __file: the number of the row's file in ascending order of paths, however Spark splits and packs the files."""
    # local paths are told with one slash or three
    paths = sorted(re.sub("^(\\w+):///", r"\1:/", p) for p in df.inputFiles())
    named = df.withColumn("__named", F.regexp_replace("_metadata.file_path", "^(\\w+):///", "$1:/"))
    if any("%" in p for p in paths):
        # escaped names: take them as the rows tell them
        paths = sorted(r[0] for r in named.select("__named").distinct().collect())
    # a row a file, all of which the driver has listed
    numbers = F.broadcast(df.sparkSession.createDataFrame(list(zip(paths, range(len(paths)), strict=True)), "__path string, __file long"))
    known = F.coalesce("__file", F.raise_error(F.concat(F.lit("a file that was not listed: "), "__named")).cast("long"))
    return named.join(numbers, named["__named"] == numbers["__path"], "left").withColumn("__file", known).drop("__named", "__path")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A file or folder; rows keep the order of their files, by path, and of the rows in them, whatever the splits."""
    df = spark.read.parquet(path)
    if len(df.inputFiles()) <= 1:
        return df.withColumn(ROW, F.col("_metadata.row_index"))
    placed = _with_file_number(df.withColumn("__at", F.col("_metadata.row_index")))
    return placed.withColumn(ROW, F.shiftleft("__file", FILE_BITS) + F.col("__at")).drop("__file", "__at")


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True) -> DataFrame:
    """Types are inferred, integers as bigint; empty fields are null. The order is file, block of the file, row."""
    df = spark.read.csv(path, sep=delimiter, header=header, inferSchema=True, enforceSchema=False)
    wide = {c: F.col(f"`{c}`").cast("bigint") for c, t in df.dtypes if t == "int"}
    if len(df.inputFiles()) <= 1:
        return numbered(df.withColumns(wide) if wide else df)
    # ids ascend within a block, which one task reads; blocks and files have places of their own
    placed = _with_file_number(df.withColumns({**wide, "__block": F.col("_metadata.file_block_start"), "__at": F.monotonically_increasing_id()}))
    return placed.withColumn(ROW, F.array("__file", "__block", "__at")).drop("__file", "__block", "__at")


def use(spark: SparkSession, path: str, **options) -> DataFrame:
    kind = path.lower().rpartition(".")[2]
    if kind == "csv":
        return read_csv(spark, path, **options)
    if kind == "parquet":
        if options:
            raise ValueError("Parquet files take no options")
        return read_parquet(spark, path)
    raise ValueError(f"unsupported format: {kind}")


def ordered(df: DataFrame) -> DataFrame:
    """The rows in their order, without the order column."""
    return df.orderBy(ROW).drop(ROW)


def save(df: DataFrame, path: str, replace: bool = False, partitions: int | None = None) -> None:
    """Parquet, in row order; ``partitions`` sets the number of files."""
    out = ordered(df)
    (out.coalesce(partitions) if partitions else out).write.mode("overwrite" if replace else "errorifexists").parquet(path)


def export(df: DataFrame, path: str, replace: bool = False, partitions: int | None = None) -> None:
    """CSV with a header, in row order."""
    out = ordered(df)
    (out.coalesce(partitions) if partitions else out).write.mode("overwrite" if replace else "errorifexists").csv(path, header=True)


def place(df: DataFrame) -> Column:
    """The order as a list, to which further places can be added."""
    return F.col(ROW) if dict(df.dtypes)[ROW].startswith("array") else F.array(F.col(ROW))


def arranged(df: DataFrame, *order) -> DataFrame:
    """Rows in the order of the given keys: ranges are sorted, and row ids ascend over the ranges."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(ROW, F.monotonically_increasing_id())


def ranked(df: DataFrame, *order) -> DataFrame:
    """Dense numbers from 0 by the given keys. The ranges are stored once, so that sizes and rows are of one evaluation."""
    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "ranks")
    sizes = placed.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("__least"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a range
    starts = sizes.select("__part", "__least", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    return placed.join(F.broadcast(starts), "__part").withColumn(ROW, F.col("__start") + F.col("__at") - F.col("__least")).drop("__part", "__at", "__least", "__start")
