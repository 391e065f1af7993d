"""Layer documents and their sidecars on disk; table outputs."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from habitus.operators.facts import stored
from habitus.session import BATCH_BYTES

# Sidecar names and their fields, as they are written.
EVIDENCE_JSON = (
    "projectType string, languages array<string>, fileCount bigint, totalSize bigint,"
    " items array<struct<id:string,layer:string,category:string,summary:string,"
    "confidence:string,files:array<string>,count:bigint>>"
)
TRACE_JSON = (
    "skillName string, projectType string,"
    " rules array<struct<id:string,layer:string,text:string,tags:array<string>,"
    "files:array<string>,evidenceIds:array<string>,status:string>>,"
    " templates array<struct<id:string,layer:string,name:string,status:string,"
    "files:array<string>,evidenceIds:array<string>>>"
)
MANIFEST_JSON = (
    "skillName string, projectType string, outputLanguage string,"
    " layers array<struct<id:string,title:string,file:string,scope:array<string>,"
    "topics:array<string>,ruleCount:bigint,templateCount:bigint,antiPatternCount:bigint,"
    "gapCount:bigint,evidenceIds:array<string>>>,"
    " evidence struct<itemCount:bigint,coveredLayers:array<string>>"
)
VERIFY_JSON = (
    "skillName string, projectType string, ok boolean, errors array<string>,"
    " warnings array<string>, llmValidation struct<ok:boolean,output:string>,"
    " summary struct<layers:bigint,rules:bigint,templates:bigint,staleRules:bigint,"
    "pendingRules:bigint>"
)
SIDECARS = {
    "EVIDENCE.json": EVIDENCE_JSON,
    "TRACE.json": TRACE_JSON,
    "MANIFEST.json": MANIFEST_JSON,
    "VERIFY.json": VERIFY_JSON,
}


#: Bytes of files that a task reads, about, and listed entries it hands on at once.
SPLIT_BYTES = 64 << 20
ENTRIES = 10_000


def _place(path: str) -> list[Column]:
    """skill and type of ``<skill>/reference/<type>/<file>``."""
    at = r"([^/]+)/reference/([^/]+)/[^/]+\z"
    return [
        F.regexp_extract(path, at, group).alias(name) for group, name in ((1, "skill"), (2, "project_type"))
    ]


def _store(root: str):
    """Where ``root`` lies and its place there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if re.match(r"[A-Za-z][\w+.-]*:", root) else os.path.abspath(root))


def _whole_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, name, size) of files whose name is like ``pattern``, listed by tasks.

    Level by level, each folder once; the driver sees no file.  Hidden folders and
    files are left out as Spark's sources do, and files without a byte.  ``root``
    is a path or URI that ``pyarrow`` reaches from all executors.
    """
    named = re.compile(pattern, re.DOTALL)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        names = ["path", "name", "is_folder", "size"]
        pack = lambda rows: pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.bool_(), pa.int64()))], names
        )
        store, _ = _store(root)
        rows = []
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for entry in store.get_file_info(fs.FileSelector(folder)):
                    name = entry.base_name
                    if name.startswith(".") or (name.startswith("_") and "=" not in name):
                        continue
                    is_folder = entry.type == fs.FileType.Directory
                    if is_folder or (entry.size and named.fullmatch(name)):
                        rows.append((entry.path, name, is_folder, entry.size or 0))
                    if len(rows) >= ENTRIES:
                        yield pack(rows)
                        rows = []
        if rows:
            yield pack(rows)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level, files = spark.createDataFrame([(_store(root)[1],)], "path string"), None
    while True:
        found = stored(
            level.repartition(tasks, "path").mapInArrow(listed, "path string, name string, is_folder boolean, size long")
        )
        own = found.filter("not is_folder").select("path", "name", "size")
        files = own if files is None else files.unionByName(own)
        level = found.filter("is_folder").select("path")
        if level.isEmpty():
            return files


def _texts(files: DataFrame, root: str) -> DataFrame:
    """``files`` (path, size and others) with ``value``, the whole text, final line break included."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(root)
        for batch in batches:
            first, texts, held = 0, [], 0
            for row, path in enumerate(batch.column("path").to_pylist()):
                with store.open_input_stream(path) as data:
                    texts.append(data.read())
                held += len(texts[-1])
                if held > BATCH_BYTES or row + 1 == batch.num_rows:
                    columns = [*batch.slice(first, len(texts)).columns, pa.array(texts, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "value"])
                    first, texts, held = row + 1, [], 0

    spark = files.sparkSession
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // SPLIT_BYTES))
    whole = files.repartition(tasks, "path").mapInArrow(read, f"{schema}, value binary")
    return whole.withColumn("value", F.col("value").cast("string"))


def read_layer_docs(spark: SparkSession, root: str) -> DataFrame:
    """(skill, project_type, layer, file_stem, content): the first file of each layer.

    The first is found among the names; only such files are opened.  An empty
    file holds no document.
    """
    stem = F.regexp_extract("path", r"([^/]+)\.md\z", 1)
    files = _whole_files(spark, root, r"L[1-8]-.*\.md").select(
        *_place("path"), F.left(stem, F.lit(2)).alias("layer"), F.struct(stem.alias("file_stem"), "path", "size").alias("f")
    )
    place = ["skill", "project_type", "layer"]
    first = stored(files.groupBy(*place).agg(F.min("f").alias("f")).select(*place, "f.*"))
    return _texts(first, root).select(*place, "file_stem", F.col("value").alias("content"))


def joined_layers(layer_docs: DataFrame) -> DataFrame:
    """(skill, project_type, content): the eight documents in order, newline-joined."""
    ordered = F.array_sort(F.collect_list(F.struct("layer", "content")))
    return layer_docs.groupBy("skill", "project_type").agg(
        F.concat(
            F.array_join(F.transform(ordered, lambda x: x["content"]), "\n"), F.lit("\n")
        ).alias("content")
    )


def read_sidecar(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(skill, project_type, r): one parsed sidecar per folder, broken ones null."""
    return _parsed(_texts(_whole_files(spark, root, re.escape(name)), root), name)


def _parsed(text: DataFrame, name: str) -> DataFrame:
    valid = F.try_parse_json("value").isNotNull()
    return text.select(
        *_place("path"),
        F.when(valid, F.from_json("value", SIDECARS[name])).alias("r"),
    )


def read_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """One row per reference folder with its four sidecars, null where absent.

    The tree is listed once; a name picks its files from that listing before any is opened.
    """
    files = _whole_files(spark, root, r".*\.(?:md|json)")
    folders = files.select(*_place("path")).filter(F.col("skill") != "").distinct()
    for name in SIDECARS:
        side = _parsed(_texts(files.filter(F.col("name") == name), root), name)
        column = name.removesuffix(".json").lower()
        folders = folders.join(
            side.withColumnRenamed("r", column), ["skill", "project_type"], "left"
        )
    return folders


def evidence_items(sidecars: DataFrame) -> DataFrame:
    """Evidence rows of read sidecars."""
    return sidecars.select(
        "skill", "project_type", F.inline("r.items")
    ).withColumnRenamed("id", "rule_id")


def trace_rows(sidecars: DataFrame) -> DataFrame:
    """Trace rule rows of read sidecars."""
    return sidecars.select("skill", "project_type", F.inline("r.rules")).withColumnRenamed(
        "evidenceIds", "evidence_ids"
    )


def write_artifacts(tables: Mapping[str, DataFrame], path: str) -> None:
    """Each table under ``path/<name>``, replacing only the references written."""
    for name, table in tables.items():
        (
            table.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("skill", "project_type")
            .parquet(f"{path}/{name}")
        )


def append_run_history(history: DataFrame, path: str) -> None:
    """Add the rows of finished runs."""
    history.write.mode("append").parquet(path)


def append_snapshot(trace: DataFrame, path: str, saved_at: Column) -> None:
    """Keep a trace generation; readers rank generations by ``saved_at``."""
    trace.withColumn("saved_at", saved_at).write.mode("append").partitionBy(
        "skill", "project_type"
    ).parquet(path)
