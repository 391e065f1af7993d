"""Queries over artifacts that are written and read back: folders, logs, generations, increments."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitus.operators import runs
from habitus.session import shared_folder
from habitus.sources import artifacts, folders, generations
from habitus.sources.logs import read_calls as read_logs
from workload import documents as wd
from workload import learning
from workload.documents import KEY
from workload.views import duck_with


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{os.urandom(8).hex()}"


def read_layer_docs(spark: SparkSession, sf: str) -> DataFrame:
    """All layer documents as files, read back: of several files of a layer the first."""
    root = _place(spark, "skills")
    named = F.concat(F.col("layer"), F.when(F.col("doc_id") % 3 == 0, "-a ").otherwise("-项目+"), F.col("doc_id").cast("string"))
    folders.write_layer_docs(wd.layer_docs(spark, sf).withColumn("file_stem", named), root)
    return artifacts.read_layer_docs(spark, root).select(
        *KEY, "layer", "file_stem", F.md5("content").alias("content_md5")
    )


def read_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence sidecars of all references as JSON files, read back with the other three absent."""
    root = _place(spark, "sidecars")
    folders.write_layer_docs(wd.layer_docs(spark, sf), root)
    folders.write_sidecar(folders.evidence_sidecars(wd.doc_evidence(spark, sf)), root, "EVIDENCE.json")
    whole = artifacts.read_artifacts(spark, root)
    items = artifacts.evidence_items(whole.select(*KEY, F.col("evidence").alias("r")))
    return (
        whole.filter(F.col("trace").isNull() & F.col("manifest").isNull() & F.col("verify").isNull())
        .select(*KEY, F.col("evidence.projectType").alias("evidence_type"))
        .join(items, KEY, "left")
        .select(
            *KEY, "evidence_type", "rule_id", "layer", "category", "summary", "confidence",
            F.array_join("files", "|").alias("files"), "count",
        )
    )


def read_calls(spark: SparkSession, sf: str) -> DataFrame:
    """The call log as files of JSON lines, read back and measured per run and phase."""
    root = _place(spark, "logs")
    folders.write_calls(learning.calls(spark, sf).drop("event_id"), root)
    return runs.phase_metrics(read_logs(spark, root))


def artifact_generations(spark: SparkSession, sf: str) -> DataFrame:
    """Documents learned twice, and once by a writer that was lost: current and previous rows."""
    path = _place(spark, "generations")
    rows = wd.layer_docs(spark, sf).select(*KEY, "layer", "doc_id", F.md5("content").alias("content_md5"))
    again = rows.filter(F.col("doc_id") % 5 == 0)
    generations.write_generation({"docs": rows}, path)
    generations.write_generation({"docs": again}, path)
    generations.stage({"docs": rows.withColumn("content_md5", F.lit("lost"))}, path)
    return generations.read_generation(spark, path, "docs").withColumn("age", F.lit(1)).unionByName(
        generations.read_generation(spark, path, "docs", 2).withColumn("age", F.lit(2))
    )


QUERIES = {f.__name__: f for f in (read_layer_docs, read_artifacts, read_calls, artifact_generations)}

# ----------------------------------------------------------------- SQL side

_STEM = "layer || CASE WHEN doc_id % 3 = 0 THEN '-a ' ELSE '-项目+' END || doc_id"

ORACLES = {
    "read_layer_docs": f"""WITH {duck_with('v_layer_docs')}, d AS (SELECT *, {_STEM} AS stem FROM v_layer_docs)
      SELECT skill, project_type, layer, min(stem) AS file_stem, md5(arg_min(content, stem)) AS content_md5 FROM d GROUP BY ALL""",
    "read_artifacts": f"""WITH {wd.DOCS}, {wd.EVIDENCE}, keys AS (SELECT DISTINCT skill, project_type, project FROM v_layer_docs)
      SELECT k.skill, k.project_type, CASE WHEN e.rule_id IS NOT NULL THEN k.project_type END AS evidence_type, e.rule_id, e.layer, e.category, e.summary,
        e.confidence, array_to_string(e.files, '|') AS files, e."count" AS "count" FROM keys k LEFT JOIN evidence e ON e.project = k.project""",
    "read_calls": learning._PHASES,
    "artifact_generations": f"""WITH {duck_with('v_layer_docs')}, d AS (SELECT skill, project_type, layer, doc_id, md5(content) AS content_md5,
        max(CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY skill, project_type) AS twice FROM v_layer_docs)
      SELECT skill, project_type, layer, doc_id, content_md5, 1 AS age FROM d WHERE twice = 0 OR doc_id % 5 = 0
      UNION ALL SELECT skill, project_type, layer, doc_id, content_md5, 2 FROM d WHERE twice = 1""",
}
