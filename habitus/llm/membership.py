"""A fixed-size filter of ids: cheap pre-selection before an exact join.

The bitmap has ``BITS`` bits whatever it holds, so it may be broadcast.  It
never misses an id; when it gets full it lets more other rows through, and the
exact join that follows removes them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 24
SEEDS = (17, 71)


def places(*key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(BITS)) for seed in SEEDS]


def bitmap(df: DataFrame, *key: str) -> np.ndarray:
    """The filter of all keys of ``df``, as at most BITS / 64 words."""
    place = F.explode(F.array(*places(*(F.col(k) for k in key))))
    words = (
        df.select(place.alias("place"))
        .groupBy(F.shiftright("place", 6).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(BITS // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def hits(words: np.ndarray, of_rows: list[np.ndarray]) -> np.ndarray:
    """Which rows are in the filter, from the arrays of their places."""
    hit = np.ones(len(of_rows[0]), bool)
    for place in of_rows:
        hit &= (words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
    return hit


def maybe_in(df: DataFrame, filter_: np.ndarray, *key: str | Column) -> Column:
    """True for every row whose key is in the filter, and for few others."""
    shared = df.sparkSession.sparkContext.broadcast(filter_)

    @F.pandas_udf("boolean")
    def test(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series(hits(shared.value, [one.to_numpy(np.int64), two.to_numpy(np.int64)]))

    return test(*places(*(F.col(k) if isinstance(k, str) else k for k in key)))


def only_ids(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``docs`` that may have a key of ``ids``: all that have, few others."""
    return docs.filter(maybe_in(docs, bitmap(ids, key), key))


def without_ids(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``docs`` whose key is not in ``ids``; nulls stay.

    Only rows that the filter lets through take part in the exact join, so most
    kept rows are never shuffled.
    """
    test = "__maybe__"
    marked = docs.withColumn(test, maybe_in(docs, bitmap(ids, key), key))
    clear = marked.filter(~F.col(test)).drop(test)
    doubtful = marked.filter(F.col(test)).drop(test)
    return clear.unionByName(doubtful.join(ids.select(key).distinct(), key, "left_anti"))
