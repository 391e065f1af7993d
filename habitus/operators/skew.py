"""Per-group selections that stay balanced when one group holds most rows.

Each works in two steps.  The first cuts every group into salted slices and
reduces each slice to a bounded remainder that provably contains the answer;
the second finishes on the remainders.  Nothing is dropped that could be part of
the result, and no task ever sees a whole hot group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from habitus.session import salt


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    unique: Sequence[str],
    rank: str = "rank",
) -> DataFrame:
    """First ``k`` rows per key in ``order``, with their rank.

    ``unique`` names the columns that tell the rows of a group apart; they
    choose the slice.  A row among the first k of its group is among the first
    k of its slice, so the first step loses nothing.
    """
    slice_, local = "__slice", "__local_rank"
    sliced = df.withColumn(slice_, salt(df, *unique))
    within = Window.partitionBy(*keys, slice_).orderBy(*order)
    short = (
        sliced.withColumn(local, F.row_number().over(within))
        .filter(F.col(local) <= k)
        .drop(local, slice_)
    )
    overall = Window.partitionBy(*keys).orderBy(*order)
    return short.withColumn(rank, F.row_number().over(overall)).filter(
        F.col(rank) <= k
    )


def within_budget(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    cost: str,
    budget: int,
    unique: Sequence[str],
    inclusive: bool = False,
    position: str = "position",
) -> DataFrame:
    """Rows per key, in order, while a running budget lasts.

    A row is kept while the cost *before* it is below the budget
    (``inclusive=False``, the last row may overshoot) or while the cost *up to
    and including* it is within the budget (``inclusive=True``, stops at the
    first row that does not fit).  Costs are never negative, so a row that is
    over budget inside its slice is over budget in its group: each slice can be
    cut on its own running sum first.
    """
    slice_, spent = "__slice", "__spent"
    frame = (Window.unboundedPreceding, 0 if inclusive else -1)
    limit = (
        F.col(spent) <= budget if inclusive else F.col(spent) < budget
    )

    def cut(rows: DataFrame, parts: list[str]) -> DataFrame:
        window = Window.partitionBy(*parts).orderBy(*order).rowsBetween(*frame)
        return rows.withColumn(
            spent, F.coalesce(F.sum(cost).over(window), F.lit(0))
        ).filter(limit)

    sliced = df.withColumn(slice_, salt(df, *unique))
    short = cut(sliced, [*keys, slice_]).drop(slice_, spent)
    kept = cut(short, list(keys)).drop(spent)
    numbering = Window.partitionBy(*keys).orderBy(*order)
    return kept.withColumn(position, F.row_number().over(numbering))


def first_paths_and_count(
    hits: DataFrame, keys: Sequence[str], path: str, keep: int
) -> DataFrame:
    """Row count and the first ``keep`` paths per key, from one pass over ``hits``.

    One narrow shuffle on (keys, slice) serves both answers, so whatever
    produced the hits - regular expressions over file contents - runs once.
    """
    slice_, local, n = "__slice", "__local_rank", "__n"
    group = Window.partitionBy(*keys, slice_)
    sliced = hits.select(*keys, path, salt(hits, path).alias(slice_))
    short = (
        sliced.withColumn(n, F.count(F.lit(1)).over(group))
        .withColumn(local, F.row_number().over(group.orderBy(path)))
        .filter(F.col(local) <= keep)
    )
    return short.groupBy(*keys).agg(
        F.sum(F.when(F.col(local) == 1, F.col(n))).alias("count"),
        F.slice(F.sort_array(F.collect_list(path)), 1, keep).alias("files"),
    )
