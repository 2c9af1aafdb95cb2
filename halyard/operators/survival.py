"""Survival curves and the Cox model, on rows aggregated by distinct time; times are swept in blocks, not in one task."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.safe import finite, number
from ..plans.moments import design, linear, solved
from ..plans.ranks import blocks, running
from .linear import Fit
from .rows import need, q


def survival_curve(df: DataFrame, time: str, failure: str) -> DataFrame:
    """Per distinct time: at risk, failed, Kaplan-Meier survival and Nelson-Aalen cumulative hazard."""
    need(df, time, failure)
    rows = df.where(finite(q(time)) & finite(q(failure))).groupBy(number(q(time)).alias("time")).agg(F.count("*").alias("n"), F.sum(number(q(failure))).cast("bigint").alias("failed"))
    out = running(rows.withColumn("block", blocks(rows, "time")), ["n"], "time", later=True).withColumnRenamed("sum_n", "at_risk")
    d, n = F.col("failed").cast("double"), F.col("at_risk")
    out = out.withColumns({"gone": F.when(d >= n, 1).otherwise(0), "log": F.when(d < n, F.log(1 - d / n)).otherwise(0.0), "hazard": d / n})
    out = running(out, ["gone", "log", "hazard"], "time")
    return out.select("time", "at_risk", "failed", F.when(F.col("sum_gone") > 0, 0.0).otherwise(F.exp("sum_log")).alias("survival"), F.col("sum_hazard").alias("cumulative_hazard"))


def stcox(df: DataFrame, time: str, *terms: str, failure: str, predicate=None) -> Fit:
    """Breslow ties. A step aggregates by distinct time, and sums up the risk sets block by block."""
    d = design(df, time, terms, predicate, False, None, None, {"failed": number(q(failure))})
    k = d.k
    mean = [v or 0.0 for v in d.rows.agg(*[F.avg(c) for c in d.x()]).first()]
    x = [c - F.lit(float(m)) for c, m in zip(d.x(), mean, strict=True)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    rows = d.rows.withColumn("block", blocks(d.rows, "y")).persist()
    names = ["a", *(f"a{i}" for i in range(k)), *(f"h{i}_{j}" for i, j in pairs)]

    def swept(b: np.ndarray) -> DataFrame:
        """Per distinct time: failures, their sums, and the sums over all at risk."""
        e, fail = F.exp(linear(x, b)), F.col("failed")
        per = rows.groupBy("block", "y").agg(F.sum(e).alias("a"), F.sum(fail).alias("d"), F.sum(fail * linear(x, b)).alias("l"), *[F.sum(e * c).alias(f"a{i}") for i, c in enumerate(x)], *[F.sum(fail * c).alias(f"u{i}") for i, c in enumerate(x)], *[F.sum(e * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in pairs])
        return running(per, names, "y", later=True)

    try:
        b, n = np.zeros(k), rows.count()
        for _ in range(100):
            dead, at, mean_of = F.col("d"), F.col("sum_a"), lambda i: F.col(f"sum_a{i}") / F.col("sum_a")
            total = swept(b).agg(F.sum(dead).alias("dead"), F.sum(F.col("l") - dead * F.log(at)).alias("ll"), *[F.sum(F.col(f"u{i}") - dead * mean_of(i)).alias(f"g{i}") for i in range(k)], *[F.sum(dead * (F.col(f"sum_h{i}_{j}") / at - mean_of(i) * mean_of(j))).alias(f"i{i}_{j}") for i, j in pairs]).first()
            if not total["dead"]:
                raise ValueError("no failures")
            info = np.zeros((k, k))
            for i, j in pairs:
                info[i, j] = info[j, i] = total[f"i{i}_{j}"]
            if not k:
                break
            step = solved(info, d.names) @ np.array([total[f"g{i}"] for i in range(k)])
            b = b + step
            if np.abs(step).max() < 1e-10 * max(1.0, np.abs(b).max()):
                break
        shift = math.exp(float(b @ np.array(mean))) if k else 1.0
        base = swept(b).where("d > 0").select(F.col("y").alias("time"), "block", (F.col("d") / F.col("sum_a") / shift).alias("hazard"))
        return Fit("cox", d.names, b, solved(info, d.names) if k else info, n, None, {"ll": total["ll"], "failures": total["dead"]}, d, {"baseline": base})
    finally:
        rows.unpersist()


def baseline(fit: Fit, spark=None) -> DataFrame:
    """time and cumulative baseline hazard, at the failure times."""
    return running(fit.info["baseline"], ["hazard"], "time").select("time", F.col("sum_hazard").alias("hazard"))
