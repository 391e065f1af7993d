"""Joins whose left side has hot keys, at most ``MOST`` of which can exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot with more than a ``MOST``-th of all rows, so no more than ``MOST`` are.
MOST = 1000
LEAST = 1000


def hot_keys(counts: DataFrame, count: str, keep) -> DataFrame:
    """Keys of ``counts`` (one row a key) that hold more than a ``MOST``-th of all rows."""
    total = counts.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    return keep(counts.filter(F.col(count) > max(LEAST, total // MOST)).drop(count), "hot")


def join_hot(big: DataFrame, small: DataFrame, on: list[str], hot: DataFrame, how: str) -> DataFrame:
    """``big`` joined to ``small``, which has few rows a key.

    Rows of hot keys stay where they are and meet a broadcast of the hot part of
    ``small``; the others are shuffled.  ``big`` and ``small`` are read twice.
    """
    mark = "__hot"
    keys = F.broadcast(hot.select(*on))
    marked = big.join(F.broadcast(hot.select(*on).withColumn(mark, F.lit(True))), on, "left")
    warm = marked.filter(F.col(mark).isNull()).drop(mark).join(small, on, how)
    few = F.broadcast(small.join(keys, on, "left_semi"))
    return warm.unionByName(marked.filter(F.col(mark)).drop(mark).join(few, on, how))
