"""Reference folders and call logs as files, written by tasks.

A file is written under a hidden name and moved to its own, so a reader never
sees half a file, and a task that is repeated after a lost executor leaves the
same files.  Rows are shuffled by folder; a task holds one Arrow batch of a few
megabytes, and of its texts one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitus.operators.trace import KEY
from habitus.session import bounded_batches
from habitus.sources.artifacts import EVIDENCE_JSON, TRACE_JSON
from habitus.sources.logs import WRITTEN_NAMES

#: Lines of a log file, about.
LINES_A_FILE = 10_000


def _folder() -> Column:
    return F.concat_ws("/", "skill", F.lit("reference"), "project_type")


def write_files(files: DataFrame, root: str) -> int:
    """Write each row of (folder, name, text) below ``root``; returns how many.

    ``root`` is a path or URI that ``pyarrow`` reaches from all executors.  Of
    rows with equal places the one with the greatest text stays; nulls are empty.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        attempt = TaskContext.get().taskAttemptId()
        made: set[str] = set()
        for batch in batches:
            for row in range(batch.num_rows):
                folder, name, text = (column[row] for column in batch.columns)
                folder, name = folder.as_py(), name.as_py()
                place = f"{base}/{folder}"
                if place not in made:
                    store.create_dir(place, recursive=True)
                    made.add(place)
                hidden = f"{place}/.{name}.{attempt}"
                with store.open_output_stream(hidden) as out:
                    out.write(text.as_buffer())
                store.move(hidden, f"{place}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["files"])

    bounded_batches(files.sparkSession)
    single = files.groupBy("folder", "name").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    return single.mapInArrow(write, "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def write_layer_docs(layer_docs: DataFrame, root: str) -> int:
    """(skill, project_type, file_stem, content) as ``<skill>/reference/<type>/<stem>.md``."""
    name = F.concat("file_stem", F.lit(".md"))
    return write_files(
        layer_docs.select(_folder().alias("folder"), name.alias("name"), F.col("content").alias("text")), root
    )


def write_sidecar(rows: DataFrame, root: str, name: str) -> int:
    """(skill, project_type, r) as the JSON file ``name`` of each reference."""
    return write_files(
        rows.select(_folder().alias("folder"), F.lit(name).alias("name"), F.to_json("r").alias("text")), root
    )


def evidence_sidecars(evidence: DataFrame) -> DataFrame:
    """(skill, project_type, r): the evidence of each reference as its sidecar holds it.

    A reference has at most one item per rule of the rule set, each with at most
    a dozen files, so the list is short.
    """
    item = F.struct(
        F.col("rule_id").alias("id"), "layer", "category", "summary", "confidence", "files", "count"
    )
    listed = evidence.groupBy(*KEY).agg(F.array_sort(F.collect_list(item)).alias("items"))
    text = F.to_json(F.struct(F.col("project_type").alias("projectType"), "items"))
    return listed.select(*KEY, F.from_json(text, EVIDENCE_JSON).alias("r"))


def trace_sidecars(rules: DataFrame, templates: DataFrame) -> DataFrame:
    """(skill, project_type, r): rules and templates of each reference, in their order.

    A reference has eight documents, which bound both lists.
    """
    ids = F.col("evidence_ids").alias("evidenceIds")

    def listed(rows: DataFrame, name: str, *fields: str | Column) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("row"))))
        return rows.groupBy(*KEY).agg(F.transform(ordered, lambda x: x["row"]).alias(name))

    both = listed(rules, "rules", "id", "layer", "text", "tags", "files", ids, "status").join(
        listed(templates, "templates", "id", "layer", "name", "status", "files", ids), list(KEY), "full"
    )
    text = F.to_json(
        F.struct(F.col("skill").alias("skillName"), F.col("project_type").alias("projectType"), "rules", "templates")
    )
    return both.select(*KEY, F.from_json(text, TRACE_JSON).alias("r"))


def write_calls(calls: DataFrame, root: str) -> int:
    """Call rows as JSON lines, each run in its own folder.

    A run's log is cut into files of about ``LINES_A_FILE`` lines, so that a hot
    run is no single file.  A line's file follows from the line alone.  Calls
    without a run go to the folder ``unknown``.
    """
    written = [F.col(c).alias(WRITTEN_NAMES.get(c, c)) for c in calls.columns]
    lines = calls.select(
        F.coalesce("run_id", F.lit("unknown")).alias("folder"), F.to_json(F.struct(*written)).alias("line")
    )
    # the count is by a narrow pass over the calls; few rows, one per run
    sizes = calls.groupBy(F.coalesce("run_id", F.lit("unknown")).alias("folder")).agg(
        F.ceil(F.count(F.lit(1)) / LINES_A_FILE).alias("parts")
    )
    lines = lines.join(sizes, "folder").withColumn("part", F.pmod(F.xxhash64("line"), "parts"))
    texts = lines.groupBy("folder", "part").agg(
        F.concat(F.array_join(F.array_sort(F.collect_list("line")), "\n"), F.lit("\n")).alias("text")
    )
    return write_files(
        texts.select("folder", F.concat(F.lit("calls-"), F.col("part").cast("string"), F.lit(".jsonl")).alias("name"), "text"),
        root,
    )
