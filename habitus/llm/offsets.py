"""Running totals within groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_offsets(
    df: DataFrame, key: str, part: Column, order: list[str], value: str, offset: str
) -> DataFrame:
    """``offset``: the sum of ``value`` over the rows of the same ``key`` before each row.

    Rows are taken by ``part``, a slice number, then in ``order``.  Each slice
    sums on its own; only the slice totals, one row per key and slice, are
    summed along a whole key.
    """
    within = Window.partitionBy(key, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sliced = df.withColumn("__part", part)
    totals = sliced.groupBy(key, "__part").agg(F.sum(value).alias("__sum"))
    along = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col(key).alias("__key"),
        F.col("__part").alias("__slice"),
        F.coalesce(F.sum("__sum").over(along), F.lit(0)).alias("__start"),
    )
    local = sliced.withColumn("__local", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return (
        local.join(
            starts, (F.col(key) == F.col("__key")) & (F.col("__part") == F.col("__slice"))
        )
        .withColumn(offset, (F.col("__start") + F.col("__local")).cast("long"))
        .drop("__part", "__local", "__key", "__slice", "__start")
    )
