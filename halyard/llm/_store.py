"""Intermediate tables in the folder that all executors share, and helpers for columns and batches."""

from __future__ import annotations

import gc
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..sources import shared
from ..sources.shared import dropped, new_path

__all__ = ["dropped", "new_path", "stored", "text_batches", "unclashed"]


#: Removes what a query shuffled as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again, which cuts its lineage; what the write shuffled goes with its end."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        out = shared.stored(df, name)
    finally:
        conf.set(CLEANUP, before)
    # broadcasts go once the driver collects its garbage
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return out


def unclashed(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Without the columns that a result is about to define under the same name, in any case."""
    lower = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in lower])


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Few rows to an Arrow batch, as one text may be megabytes long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
