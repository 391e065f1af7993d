"""Batch completion with a caller-supplied function (M3)."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Attempts and growth of the answer budget.
MAX_ATTEMPTS = 3
MIN_GROWTH = 4_096
MAX_TOKENS_CEILING = 32_768
CUT_OFF = ("length", "max_tokens", "content_filter")
RETRY_EMPTY = ("length", "content_filter")

Complete = Callable[[str, int], dict]
ATTEMPT = (
    "struct<attempt:int,max_tokens:int,duration_ms:bigint,request_chars:bigint,"
    "response_chars:bigint,ok:boolean,finish_reason:string,prompt_tokens:bigint,"
    "completion_tokens:bigint,total_tokens:bigint,reasoning_tokens:bigint,error:string>"
)


def grown(base: int, retry: int) -> int:
    """Answer budget of retry 1, 2, ..."""
    return min(max(base * (retry + 2), base + MIN_GROWTH), MAX_TOKENS_CEILING)


def _ask(fn: Complete, prompt: str, base: int, pinned: bool) -> tuple[str | None, list[dict]]:
    """One prompt's answer, null when none was complete, and its attempt log."""
    log: list[dict] = []
    for retry in range(MAX_ATTEMPTS):
        budget = base if pinned or retry == 0 else grown(base, retry)
        began = time.monotonic()
        try:
            reply, error = fn(prompt, budget), None
        except Exception as failure:  # noqa: BLE001 - every failure is logged, as data
            reply, error = {}, str(failure)
        text = reply.get("content") or ""
        usage = reply.get("usage") or {}
        finish = reply.get("finish_reason")
        complete = bool(text) and finish not in CUT_OFF
        log.append(
            {
                "attempt": retry + 1,
                "max_tokens": budget,
                "duration_ms": int((time.monotonic() - began) * 1000),
                "request_chars": len(prompt),
                "response_chars": len(text),
                "ok": complete,
                "finish_reason": finish,
                "prompt_tokens": usage.get("prompt_tokens"),
                "completion_tokens": usage.get("completion_tokens"),
                "total_tokens": usage.get("total_tokens"),
                "reasoning_tokens": usage.get("reasoning_tokens"),
                "error": error,
            }
        )
        if complete:
            return text, log
        again = (
            bool(text)
            or finish in RETRY_EMPTY
            or bool(usage.get("completion_tokens"))
            or bool(reply.get("reasoning"))
        )
        if error is not None or not again:
            break
    return None, log


def complete(
    prompts: DataFrame, fn: Complete, max_tokens: int = 4_096, pinned: bool = False
) -> DataFrame:
    """(all prompt columns, response, attempts): one row per prompt.

    ``fn(prompt, max_tokens)`` returns a dict with ``content`` and, optionally,
    ``finish_reason`` and ``usage``.  It runs in the tasks, batch by batch, and
    must be safe to repeat: a lost task asks again.
    """
    spec = prompts.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = [_ask(fn, p, max_tokens, pinned) for p in batch["prompt"]]
            yield batch.assign(
                response=[a for a, _ in answers],
                attempts=[json.dumps(log) for _, log in answers],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spec.fields)
    out = prompts.mapInPandas(run, f"{schema}, response string, attempts string")
    return out.withColumn("attempts", F.from_json("attempts", f"array<{ATTEMPT}>"))


def call_rows(completed: DataFrame, run_id: str, phase: str) -> DataFrame:
    """The attempt log as call rows for the run measures."""
    rows = completed.select(
        F.col(run_id).alias("run_id"), F.col(phase).alias("phase"), F.inline("attempts")
    )
    tokens = ("prompt_tokens", "completion_tokens", "total_tokens", "reasoning_tokens")
    usage = F.struct(
        *tokens, F.struct(F.lit(None).cast("bigint").alias("reasoning_tokens")).alias("completion_tokens_details")
    )
    return rows.withColumn("usage", usage).drop(*tokens)


def complete_missing(
    prompts: DataFrame, done_path: str, keys: list[str], fn: Complete, **options: int
) -> DataFrame:
    """Ask only for prompts not answered yet and add the answers to the table (resume).

    Answers are written before they are read again, so a rerun repeats nothing
    that was stored.
    """
    spark = prompts.sparkSession
    todo = prompts
    try:
        done = spark.read.parquet(done_path)
        todo = prompts.join(done.filter("response IS NOT NULL").select(*keys), keys, "left_anti")
    except Exception as missing:  # noqa: BLE001 - no table yet: everything is to do
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    complete(todo, fn, **options).write.mode("append").parquet(done_path)
    return spark.read.parquet(done_path)
