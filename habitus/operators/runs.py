"""Measures over completion calls, the same for batch and stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from habitus.functions.timefmt import format_duration

USAGE = T.StructType(
    [
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
        T.StructField("total_tokens", T.LongType()),
        T.StructField("reasoning_tokens", T.LongType()),
        T.StructField(
            "completion_tokens_details",
            T.StructType([T.StructField("reasoning_tokens", T.LongType())]),
        ),
    ]
)
CALLS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("phase", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("max_tokens", T.IntegerType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("finished_at", T.TimestampType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("request_chars", T.LongType()),
        T.StructField("response_chars", T.LongType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("finish_reason", T.StringType()),
        T.StructField("usage", USAGE),
        T.StructField("empty_reason", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def measures() -> list[Column]:
    """Aggregates of a group of calls; missing numbers count as zero."""
    first = (F.coalesce("attempt", F.lit(1)) <= 1)
    ok = F.coalesce("ok", F.lit(False))
    reasoning = F.coalesce(
        "usage.completion_tokens_details.reasoning_tokens", "usage.reasoning_tokens"
    )

    def total(value: Column | str) -> Column:
        return F.sum(F.coalesce(value, F.lit(0)))

    return [
        F.count(F.lit(1)).alias("requests"),
        F.count_if(first).alias("turns"),
        F.count_if(~first).alias("retries"),
        F.count_if(ok).alias("succeeded"),
        F.count_if(~ok).alias("failed"),
        total("request_chars").alias("request_chars"),
        total("response_chars").alias("response_chars"),
        total("duration_ms").alias("llm_duration_ms"),
        total("usage.prompt_tokens").alias("prompt_tokens"),
        total("usage.completion_tokens").alias("completion_tokens"),
        total(reasoning).alias("reasoning_tokens"),
        total("usage.total_tokens").alias("total_tokens"),
    ]


def phase_metrics(calls: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Measures per run and phase; a call without a phase is 'unknown' (A9)."""
    named = calls.withColumn("phase", F.coalesce("phase", F.lit("unknown")))
    return named.groupBy(*keys, "phase").agg(*measures())


def call_metrics(calls: DataFrame) -> DataFrame:
    """Measures per run."""
    return calls.groupBy("run_id").agg(*measures())


def run_and_phase_metrics(calls: DataFrame) -> DataFrame:
    """A8 and A9 from one aggregation; run rows have a null phase."""
    named = calls.withColumn("phase", F.coalesce("phase", F.lit("unknown")))
    return named.groupingSets(
        [[F.col("run_id")], [F.col("run_id"), F.col("phase")]], F.col("run_id"), F.col("phase")
    ).agg(*measures())


def run_metrics(calls: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per run: status, wall time and the measures of its calls.

    ``runs`` is (run_id, status, created_at, updated_at).
    """
    wall = F.greatest(F.lit(0), F.unix_millis("updated_at") - F.unix_millis("created_at"))
    names = [f for f in call_metrics(calls).columns if f != "run_id"]
    return (
        runs.join(call_metrics(calls), "run_id", "left")
        .select(
            "run_id",
            "status",
            F.col("created_at").alias("started_at"),
            F.col("updated_at").alias("finished_at"),
            wall.alias("duration_ms"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in names],
        )
    )


def run_history(metrics: DataFrame) -> DataFrame:
    """The rows a run appends to its history."""
    return metrics.select(
        "finished_at",
        "status",
        format_duration(F.col("duration_ms")).alias("duration"),
        format_duration(F.col("llm_duration_ms")).alias("llm_time"),
        F.col("requests").alias("llm_requests"),
        F.col("turns").alias("conversation_turns"),
        "retries",
        F.col("total_tokens").alias("tokens"),
        "run_id",
    )
