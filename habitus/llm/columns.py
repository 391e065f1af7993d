"""Column expressions shared by the native operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six ASCII space characters, as a pattern and as plain text.
SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once, inside one expression."""
    return F.element_at(F.transform(F.array(value), then), 1)


def spaced_words(text: Column) -> Column:
    """Maximal runs without ASCII space, in order; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def window_hashes(hashes: Column, size: int) -> Column:
    """A 64-bit hash per run of ``size`` neighbours; empty when there is none."""
    return let(
        hashes,
        lambda h: F.when(
            F.size(h) >= size,
            F.transform(
                F.sequence(F.lit(0), F.size(h) - size),
                lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(size))),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
