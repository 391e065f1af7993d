"""Run measures as a continuous query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from habitus.operators.runs import measures, phase_metrics
from habitus.sources.logs import call_lines, parse_calls


def read_call_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Call rows as log files arrive; broken lines are dropped as in batch."""
    return parse_calls(
        call_lines(spark.readStream.option("recursiveFileLookup", "true").text(folder))
    )


def stream_run_metrics(calls: DataFrame) -> DataFrame:
    """Measures per run and phase, updated as calls arrive.

    State is one short row per run and phase.  It is kept for good, since a run
    may be resumed at any time; ``windowed_run_metrics`` bounds it by time.
    """
    return phase_metrics(calls)


def windowed_run_metrics(
    calls: DataFrame, window: str = "1 hour", lateness: str = "10 minutes"
) -> DataFrame:
    """Measures per time window and phase, closed once calls can no longer be that late."""
    return (
        calls.withColumn("phase", F.coalesce("phase", F.lit("unknown")))
        .withWatermark("at", lateness)
        .groupBy(F.window("at", window).alias("w"), "phase")
        .agg(*measures())
        .select(F.col("w.start").alias("window_start"), "*")
        .drop("w")
    )


def run_available(metrics: DataFrame, result: str, checkpoint: str) -> StreamingQuery:
    """Process all that is there and stop; the measures are a Parquet table in ``result``.

    Each batch replaces the table, so nothing passes the driver and a repeated
    batch leaves the same table.  Both folders are ones all executors reach.
    """

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(result)

    return (
        metrics.writeStream.outputMode("complete")
        .foreachBatch(replace)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_increments(calls: DataFrame, result: str, checkpoint: str) -> StreamingQuery:
    """Process all that is there and stop; each batch adds its own sums to ``result``.

    Every measure is a sum over calls, so the sums of the batches add up to those
    of all calls: the query keeps no state, writes only what is new, and counts a
    call however late it comes.  A batch is a folder that a repeated delivery
    replaces.  ``read_increments`` adds up, ``fold_increments`` joins folders.
    """

    def add(batch: DataFrame, number: int) -> None:
        phase_metrics(batch).write.mode("overwrite").parquet(f"{result}/batch={number}")

    return (
        calls.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _summed(rows: DataFrame) -> DataFrame:
    names = [c for c in rows.columns if c not in ("run_id", "phase", "batch")]
    return rows.groupBy("run_id", "phase").agg(*[F.sum(c).alias(c) for c in names])


def read_increments(spark: SparkSession, result: str, folded: str | None = None) -> DataFrame:
    """Measures per run and phase over all batches, or over a fold and the batches after it."""
    rows = spark.read.parquet(result)
    if folded is None:
        return _summed(rows)
    before = spark.read.parquet(folded)
    upto = before.agg(F.max("batch")).first()[0]
    return _summed(before.unionByName(rows.filter(F.col("batch") > (-1 if upto is None else upto))))


def fold_increments(spark: SparkSession, result: str, folded: str, before: str | None = None) -> int:
    """Write the measures of all batches so far to a new folder; returns the last batch in it.

    ``before`` is the fold made last; only batches after it are read.  Each row
    names the last batch, so a reader knows which batches still count.
    """
    upto = spark.read.parquet(result).agg(F.max("batch")).first()[0]
    read_increments(spark, result, before).withColumn("batch", F.lit(upto)).write.mode("overwrite").parquet(folded)
    return upto
