"""Queries over the catalog, runs and call logs, batch and streaming."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitus.functions.paths import skill_path_parts
from habitus.operators import catalog as ct
from habitus.operators import runs as rn
from habitus.session import shared_folder
from habitus.streaming import metrics as st
from workload import corpus
from workload.views import duck_with, view

NOW = "2030-01-01 00:00:00"
USAGE = (
    "named_struct('prompt_tokens', k, 'completion_tokens', k * 2,"
    " 'total_tokens', CASE WHEN event_id % 13 = 0 THEN NULL ELSE k * 3 END,"
    " 'reasoning_tokens', k + 1, 'completion_tokens_details',"
    " named_struct('reasoning_tokens', CASE WHEN event_id % 2 = 0 THEN k + 5 END)) AS usage"
)


def calls(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_calls").select(
        "run_id", F.col("called_at").cast("timestamp").alias("at"),
        F.expr("CASE WHEN event_id % 11 = 0 THEN NULL ELSE phase END AS phase"),
        "attempt", "duration_ms", "request_chars", "response_chars", "ok", F.expr(USAGE), "event_id",
    )


def _entries(spark: SparkSession, sf: str, half: int | None = None) -> DataFrame:
    """Catalog rows grouped from the view, or from the older (0) or newer (1) half of it.

    Where a catalog is merged the halves are the catalog and what was learned.
    """
    rows = view(spark, sf, "v_catalog")
    if half is not None:
        rows = rows.filter(F.col("k") == half)
    return rows.groupBy("lock_key", "name", "language", "skill_path").agg(
        F.array("language").alias("raw_languages"),
        F.array_sort(F.collect_set("source_project")).alias("source_projects"),
        F.array_sort(F.collect_set("source_file")).alias("source_files"),
        F.sha2(F.sum("n_chars").cast("string"), 256).alias("content_hash"),
        F.count(F.lit(1)).alias("learn_count"),
        F.timestamp_seconds(F.min("doc_id") * 60).alias("created_at"),
        F.timestamp_seconds(F.max("doc_id") * 60).alias("updated_at"),
    )


def _long(spark: SparkSession, sf: str, half: int) -> tuple[DataFrame, DataFrame]:
    """(entries, sources) of the older or newer half of the view, without a list."""
    rows = view(spark, sf, "v_catalog").filter(F.col("k") == half)
    entries = rows.groupBy("lock_key", "name", "language", "skill_path").agg(
        F.sha2(F.sum("n_chars").cast("string"), 256).alias("content_hash"),
        F.count(F.lit(1)).alias("learn_count"),
        F.timestamp_seconds(F.min("doc_id") * 60).alias("created_at"),
        F.timestamp_seconds(F.max("doc_id") * 60).alias("updated_at"),
    )
    sources = ct.as_sources(rows, "project", "source_project")
    for kind, value in (("file", "source_file"), ("language", "language")):
        sources = sources.unionByName(ct.as_sources(rows, kind, value))
    return entries, sources


def upsert_catalog(spark: SparkSession, sf: str) -> DataFrame:
    (entries, known), (learned, found) = _long(spark, sf, 0), _long(spark, sf, 1)
    merged = ct.with_lists(
        ct.upsert_entries(entries, learned, F.lit(NOW).cast("timestamp")), ct.merge_sources(known, found)
    )
    return merged.select(
        "lock_key", "name", "language", "skill_path", "learn_count", "content_hash",
        F.array_join("raw_languages", ",").alias("raw_languages"),
        F.array_join("source_projects", ",").alias("source_projects"),
        F.array_join("source_files", ",").alias("source_files"),
        F.unix_seconds("created_at").alias("created_at"), F.unix_seconds("updated_at").alias("updated_at"),
    )


def union_sources(spark: SparkSession, sf: str) -> DataFrame:
    (entries, known), (learned, found) = _long(spark, sf, 0), _long(spark, sf, 1)
    keys = entries.select("lock_key").union(learned.select("lock_key")).distinct()
    return ct.with_lists(keys, ct.merge_sources(known, found), ("file",)).select(
        "lock_key", F.array_join("source_files", ",").alias("files")
    )


def list_skills(spark: SparkSession, sf: str) -> DataFrame:
    return ct.list_skills(_entries(spark, sf)).select("lock_key", F.unix_seconds("updated_at").alias("updated_at"))


def skill_paths(spark: SparkSession, sf: str) -> DataFrame:
    path = F.when(F.col("doc_id") % 5 == 0, F.col("lock_key")).when(
        F.col("doc_id") % 5 == 1, F.concat(F.lit("reference/"), "language")
    ).otherwise(F.col("skill_path"))
    return view(spark, sf, "v_catalog").select("doc_id", skill_path_parts(path, F.col("language")).alias("p")).select(
        "doc_id", "p.skill", "p.project_type", "p.overview_type"
    )


def skill_status(spark: SparkSession, sf: str) -> DataFrame:
    return ct.skill_status(_entries(spark, sf)).select(
        "skill", "project_type", F.array_join("languages", ",").alias("languages"), "files", "projects",
        F.unix_seconds("updated_at").alias("updated_at"),
    )


def status_totals(spark: SparkSession, sf: str) -> DataFrame:
    return ct.status_totals(_entries(spark, sf))


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """One run per user, from its first to its last call."""
    c = calls(spark, sf)
    return c.groupBy("run_id").agg(F.min("at").alias("created_at"), F.max("at").alias("updated_at")).select(
        "run_id", F.lit("complete").alias("status"), "created_at", "updated_at"
    )


def call_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rn.call_metrics(calls(spark, sf))


def phase_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rn.phase_metrics(calls(spark, sf))


def run_and_phase_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rn.run_and_phase_metrics(calls(spark, sf))


def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rn.run_metrics(calls(spark, sf), _runs(spark, sf)).drop(
        "started_at", "finished_at"
    )


def run_history(spark: SparkSession, sf: str) -> DataFrame:
    metrics = rn.run_metrics(calls(spark, sf), _runs(spark, sf))
    return rn.run_history(metrics).withColumn("finished_at", F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss"))


def latest_compatible_run(spark: SparkSession, sf: str) -> DataFrame:
    keyed = view(spark, sf, "v_calls").select(
        F.concat(F.lit("/w/"), F.col("phase")).alias("project_root"), F.lit("s").alias("skill"), F.lit("t").alias("project_type"),
        (F.col("event_id") % 50).cast("string").alias("scan_hash"), (F.col("attempt") % 2).cast("string").alias("evidence_hash"), "run_id",
    )
    wanted = keyed.filter(F.col("scan_hash") != "7").drop("run_id").distinct()
    return ct.latest_compatible_run(keyed, wanted)


def trace_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "v_catalog").select(
        F.col("language").alias("skill"), F.col("source_project").alias("project_type"),
        (F.col("doc_id") % 5).alias("saved_at"), F.col("doc_id").alias("rule"),
    )
    return ct.with_snapshots(rows, "saved_at").withColumn("generation", F.col("generation").cast("bigint"))


def evidence_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return ct.evidence_fingerprint(corpus._evidence(spark, sf), ["project"])


def stream_run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The event files as a stream: same measures as the batch query, row for row."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    shaped = stream.selectExpr(
        "CAST(user_id AS STRING) AS run_id", "ts AS at",
        "CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS phase", "event_id",
        "CAST(event_id % 4 AS INT) AS attempt", "CAST(floor(value * 100) AS BIGINT) AS duration_ms",
        "CAST(event_id % 1000 AS BIGINT) AS request_chars", "CAST(event_id % 300 AS BIGINT) AS response_chars",
        "event_type <> 'error' AS ok", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k",
    ).selectExpr("*", USAGE)
    folder = f"{shared_folder(spark)}/stream-{os.urandom(8).hex()}"
    st.run_increments(shaped, f"{folder}/result", f"{folder}/checkpoint").awaitTermination()
    return st.read_increments(spark, f"{folder}/result")


QUERIES = {
    f.__name__: f
    for f in (
        upsert_catalog, union_sources, list_skills, skill_paths, skill_status, status_totals, call_metrics,
        phase_metrics, run_and_phase_metrics, run_metrics, run_history, latest_compatible_run,
        trace_snapshots, evidence_fingerprint, stream_run_metrics,
    )
}

# ----------------------------------------------------------------- SQL side

_CAT = f"""WITH {duck_with('v_catalog')},
ent AS (SELECT k, lock_key, name, language, skill_path, list_sort(list(DISTINCT source_project)) AS ps, list_sort(list(DISTINCT source_file)) AS fs,
   sha256(CAST(sum(n_chars) AS VARCHAR)) AS h, count(*) AS n, min(doc_id) * 60 AS c, max(doc_id) * 60 AS u FROM v_catalog GROUP BY ALL),
w AS (SELECT lock_key, skill_path, language, list_distinct(list(source_project)) AS ps, list_distinct(list(source_file)) AS fs, max(doc_id) * 60 AS u
   FROM v_catalog GROUP BY ALL),
a AS (SELECT * FROM ent WHERE k = 0), b AS (SELECT * FROM ent WHERE k = 1)"""
_M = """count(*) AS requests, count(*) FILTER (coalesce(attempt, 1) <= 1) AS turns, count(*) FILTER (coalesce(attempt, 1) > 1) AS retries,
 count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, CAST(sum(request_chars) AS BIGINT) AS request_chars,
 CAST(sum(response_chars) AS BIGINT) AS response_chars, CAST(sum(duration_ms) AS BIGINT) AS llm_duration_ms, CAST(sum(k) AS BIGINT) AS prompt_tokens,
 CAST(sum(k * 2) AS BIGINT) AS completion_tokens, CAST(sum(CASE WHEN event_id % 2 = 0 THEN k + 5 ELSE k + 1 END) AS BIGINT) AS reasoning_tokens,
 CAST(sum(CASE WHEN event_id % 13 = 0 THEN 0 ELSE k * 3 END) AS BIGINT) AS total_tokens"""
_CALLS = f"WITH {duck_with('v_calls')}, c AS (SELECT * REPLACE (CASE WHEN event_id % 11 = 0 THEN 'unknown' ELSE phase END AS phase) FROM v_calls)"
_DUR = lambda ms: (
    f"CASE WHEN {ms} < 1000 THEN {ms} || 'ms' WHEN ({ms} + 500) // 1000 < 60 THEN ({ms} + 500) // 1000 || 's'"
    f" WHEN ({ms} + 500) // 1000 < 3600 THEN ({ms} + 500) // 60000 || 'm ' || ({ms} + 500) // 1000 % 60 || 's'"
    f" ELSE ({ms} + 500) // 3600000 || 'h ' || ({ms} + 500) // 60000 % 60 || 'm ' || ({ms} + 500) // 1000 % 60 || 's' END"
)
_PHASES = f"{_CALLS} SELECT run_id, phase, {_M} FROM c GROUP BY ALL"
_RUNS = f"""{_CALLS}, m AS (SELECT run_id, {_M}, greatest(0, epoch_us(max(called_at)) // 1000 - epoch_us(min(called_at)) // 1000) AS duration_ms, max(called_at) AS finished FROM c GROUP BY run_id)"""

ORACLES = {
    "upsert_catalog": f"""{_CAT} SELECT coalesce(a.lock_key, b.lock_key) AS lock_key, coalesce(b.name, a.name) AS name, coalesce(b.language, a.language) AS language,
      coalesce(b.skill_path, a.skill_path) AS skill_path, CASE WHEN b.k IS NULL THEN a.n ELSE coalesce(a.n, 0) + 1 END AS learn_count, coalesce(b.h, a.h) AS content_hash,
      coalesce(b.language, a.language) AS raw_languages,
      array_to_string(list_sort(list_distinct(list_concat(coalesce(a.ps, []), coalesce(b.ps, [])))), ',') AS source_projects,
      array_to_string(list_sort(list_distinct(list_concat(coalesce(a.fs, []), coalesce(b.fs, [])))), ',') AS source_files,
      coalesce(a.c, 1893456000) AS created_at, CASE WHEN b.k IS NULL THEN a.u ELSE 1893456000 END AS updated_at FROM a FULL JOIN b ON a.lock_key = b.lock_key""",
    "union_sources": f"""{_CAT} SELECT coalesce(a.lock_key, b.lock_key) AS lock_key,
      array_to_string(list_sort(list_distinct(list_concat(coalesce(a.fs, []), coalesce(b.fs, [])))), ',') AS files FROM a FULL JOIN b ON a.lock_key = b.lock_key""",
    "list_skills": f"{_CAT} SELECT lock_key, u AS updated_at FROM w ORDER BY u DESC, lock_key",
    "skill_paths": f"""WITH {duck_with('v_catalog')}, p AS (SELECT doc_id, language, CASE WHEN doc_id % 5 = 0 THEN lock_key WHEN doc_id % 5 = 1 THEN 'reference/' || language ELSE skill_path END AS path FROM v_catalog)
      SELECT doc_id, CASE WHEN doc_id % 5 > 1 THEN split_part(path, '/', 1) ELSE 'unknown' END AS skill, language AS project_type,
        CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE language END AS overview_type FROM p""",
    "skill_status": f"""{_CAT} SELECT split_part(skill_path, '/', 1) AS skill, split_part(skill_path, '/', 3) AS project_type, language AS languages,
      CAST(len(fs) AS BIGINT) AS files, CAST(len(ps) AS BIGINT) AS projects, u AS updated_at FROM w""",
    "status_totals": f"""{_CAT} SELECT split_part(skill_path, '/', 1) AS skill, count(*) AS types, count(*) AS entries FROM w GROUP BY 1
      UNION ALL SELECT NULL, count(*), count(*) FROM w""",
    "call_metrics": f"{_CALLS} SELECT run_id, {_M} FROM c GROUP BY run_id",
    "phase_metrics": _PHASES,
    "run_and_phase_metrics": f"{_CALLS} SELECT run_id, phase, {_M} FROM c GROUP BY GROUPING SETS ((run_id), (run_id, phase))",
    "run_metrics": f"{_RUNS} SELECT * EXCLUDE (finished), 'complete' AS status FROM m",
    "run_history": f"""{_RUNS} SELECT strftime(finished, '%Y-%m-%d %H:%M:%S') AS finished_at, 'complete' AS status, {_DUR('duration_ms')} AS duration,
      {_DUR('llm_duration_ms')} AS llm_time, requests AS llm_requests, turns AS conversation_turns, retries, total_tokens AS tokens, run_id FROM m""",
    "latest_compatible_run": f"""WITH {duck_with('v_calls')} SELECT '/w/' || phase AS project_root, 's' AS skill, 't' AS project_type, CAST(event_id % 50 AS VARCHAR) AS scan_hash,
      CAST(attempt % 2 AS VARCHAR) AS evidence_hash, max(run_id) AS run_id FROM v_calls WHERE event_id % 50 <> 7 GROUP BY ALL""",
    "trace_snapshots": f"""WITH {duck_with('v_catalog')}, r AS (SELECT language AS skill, source_project AS project_type, doc_id % 5 AS saved_at, doc_id AS rule FROM v_catalog),
      g AS (SELECT *, dense_rank() OVER (PARTITION BY skill, project_type ORDER BY saved_at DESC) AS generation FROM r) SELECT * FROM g WHERE generation <= 2""",
    "evidence_fingerprint": f"""WITH {corpus.EVIDENCE_CTE} SELECT project, sha256('[' || string_agg('{{"rule_id":"' || rule_id || '","confidence":"' || confidence
      || '","count":' || "count" || ',"files":["' || array_to_string(files, '","') || '"]}}', ',' ORDER BY rule_id) || ']') AS evidence_hash FROM evidence GROUP BY project""",
    "stream_run_metrics": _PHASES,
}
