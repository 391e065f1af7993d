"""Durations and local timestamps as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_duration(ms: Column) -> Column:
    """``850ms``, ``12s``, ``3m 4s`` or ``1h 2m 3s``."""
    # halves round up, as in ECMAScript
    safe = F.greatest(F.lit(0), F.floor(ms + F.lit(0.5))).cast("bigint")
    total = F.floor(safe / 1000 + F.lit(0.5)).cast("bigint")
    minutes = F.floor(total / 60).cast("bigint")
    seconds = total % 60
    hours = F.floor(minutes / 60).cast("bigint")
    text = lambda c: c.cast("string")
    return (
        F.when(safe < 1000, F.concat(text(safe), F.lit("ms")))
        .when(minutes == 0, F.concat(text(seconds), F.lit("s")))
        .when(
            hours == 0,
            F.concat(text(minutes), F.lit("m "), text(seconds), F.lit("s")),
        )
        .otherwise(
            F.concat(
                text(hours),
                F.lit("h "),
                text(minutes % 60),
                F.lit("m "),
                text(seconds),
                F.lit("s"),
            )
        )
    )


def local_timestamp(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss GMT+h[:mm]`` in the session time zone."""
    offset = F.date_format(ts, "xxx")  # +hh:mm
    hours = F.substring(offset, 2, 2).cast("int").cast("string")
    minutes = F.substring(offset, 5, 2)
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss"),
        F.lit(" GMT"),
        F.substring(offset, 1, 1),
        hours,
        F.when(minutes == "00", "").otherwise(F.concat(F.lit(":"), minutes)),
    )
