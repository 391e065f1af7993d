"""Call logs: one JSON object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitus.functions import patterns as rx
from habitus.operators.runs import CALLS

# Names of the log's fields, as they are written.
WRITTEN_NAMES = {
    "run_id": "runId",
    "max_tokens": "maxTokens",
    "started_at": "startedAt",
    "finished_at": "finishedAt",
    "duration_ms": "durationMs",
    "request_chars": "requestChars",
    "response_chars": "responseChars",
    "finish_reason": "finishReason",
    "empty_reason": "emptyReason",
}


def call_lines(text: DataFrame) -> DataFrame:
    """Lines with the folder of their log: each run logs into its own folder."""
    return text.select(
        "value", F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+\z", 1).alias("folder")
    )


def parse_calls(lines: DataFrame) -> DataFrame:
    """(value, folder) lines as call rows; blank and broken lines are dropped.

    A number written as text is no number and becomes null.  The run id comes
    from the record, else from the folder.
    """
    written = {f.name: WRITTEN_NAMES.get(f.name, f.name) for f in CALLS.fields}
    schema = ", ".join(f"`{written[f.name]}` {f.dataType.simpleString()}" for f in CALLS.fields)
    valid = (rx.trim(F.col("value")) != "") & F.try_parse_json("value").isNotNull()
    rows = lines.filter(valid).select("folder", F.from_json("value", schema).alias("r"))
    return rows.select(
        *[
            F.coalesce("r.runId", "folder").alias("run_id")
            if f.name == "run_id"
            else F.col(f"r.`{written[f.name]}`").alias(f.name)
            for f in CALLS.fields
        ]
    )


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """Calls of all logs under ``path``."""
    return parse_calls(call_lines(spark.read.option("recursiveFileLookup", "true").text(path)))
