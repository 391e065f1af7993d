"""The catalog of what has been learned.

The catalog is kept in two long tables, so that no row grows with the files of a
type: ``entries`` (lock_key, name, language, skill_path, content_hash, created_at,
updated_at, learn_count), one row a key, and ``sources`` (lock_key, kind, value),
one row for every source project, source file and raw language of a key.  Lists
are made on output only (``with_lists``).

The list form of one row a key, ``catalog``, is (lock_key, name, language, raw_languages, created_at, updated_at,
learn_count, source_projects, source_files, skill_path, content_hash), one row
per key; ``learned`` carries the same columns without the counters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from habitus.functions.paths import skill_path_parts

SETS = ("source_projects", "source_files")
REPLACED = ("name", "language", "raw_languages", "skill_path", "content_hash")


def union_sources(old: Column, new: Column) -> Column:
    """Sorted set union of two lists (U4)."""
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(old, empty), F.coalesce(new, empty)))


def upsert_catalog(catalog: DataFrame, learned: DataFrame, now: Column) -> DataFrame:
    """The catalog after one learning round, one learned row per key.

    New keys start at one and keep their lists as given; known keys count up,
    keep their creation time and merge their lists.
    """
    old = catalog.select("lock_key", F.struct(*[c for c in catalog.columns if c != "lock_key"]).alias("old"))
    new = learned.select("lock_key", F.struct(*REPLACED, *SETS).alias("new"))
    known, seen = F.col("old").isNotNull(), F.col("new").isNotNull()
    merged = old.join(new, "lock_key", "full_outer")
    return merged.select(
        "lock_key",
        *[F.when(seen, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in REPLACED],
        F.when(known, F.col("old.created_at")).otherwise(now).alias("created_at"),
        F.when(seen, now).otherwise(F.col("old.updated_at")).alias("updated_at"),
        (F.coalesce("old.learn_count", F.lit(0)) + F.when(seen, 1).otherwise(0)).cast("bigint").alias("learn_count"),
        *[
            F.when(known & seen, union_sources(F.col(f"old.{c}"), F.col(f"new.{c}")))
            .when(known, F.col(f"old.{c}"))
            .otherwise(F.col(f"new.{c}"))
            .alias(c)
            for c in SETS
        ],
    )


#: Kinds of sources and the list each becomes on output.
KINDS = {"project": "source_projects", "file": "source_files", "language": "raw_languages"}
ENTRY = ("name", "language", "skill_path", "content_hash")
SOURCE = ["lock_key", "kind", "value"]


def as_sources(rows: DataFrame, kind: str, value: str) -> DataFrame:
    """(lock_key, kind, value) once each, from rows with a key and a value."""
    return (
        rows.filter(F.col(value).isNotNull())
        .select("lock_key", F.lit(kind).alias("kind"), F.col(value).cast("string").alias("value"))
        .distinct()
    )


def new_sources(known: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``found`` that ``known`` lacks, once each (U4).

    The join is by the whole row: a key with very many files is spread by them.
    """
    return found.select(*SOURCE).distinct().join(known.select(*SOURCE), SOURCE, "left_anti")


def merge_sources(known: DataFrame, found: DataFrame) -> DataFrame:
    """Set union of two source tables without a list of either (U4)."""
    return known.select(*SOURCE).unionByName(new_sources(known, found))


def upsert_entries(entries: DataFrame, learned: DataFrame, now: Column) -> DataFrame:
    """The entries after one learning round, at most one learned row a key.

    New keys start at one; known keys count up and keep their creation time.
    """
    old = entries.select("lock_key", F.struct(*ENTRY, "created_at", "updated_at", "learn_count").alias("old"))
    new = learned.select("lock_key", F.struct(*ENTRY).alias("new"))
    known, seen = F.col("old").isNotNull(), F.col("new").isNotNull()
    return old.join(new, "lock_key", "full_outer").select(
        "lock_key",
        *[F.when(seen, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in ENTRY],
        F.when(known, F.col("old.created_at")).otherwise(now).alias("created_at"),
        F.when(seen, now).otherwise(F.col("old.updated_at")).alias("updated_at"),
        (F.coalesce("old.learn_count", F.lit(0)) + F.when(seen, 1).otherwise(0)).cast("bigint").alias("learn_count"),
    )


def with_lists(entries: DataFrame, sources: DataFrame, kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """Entries with a sorted list per kind of source: the output form, as long as its lists are."""
    lists = sources.groupBy("lock_key").agg(
        *[
            F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("value")))).alias(KINDS[kind])
            for kind in kinds
        ]
    )
    empty = F.array().cast("array<string>")
    return entries.join(lists, "lock_key", "left").withColumns(
        {KINDS[kind]: F.coalesce(KINDS[kind], empty) for kind in kinds}
    )


def learn_round(path: str, number: int, learned: DataFrame, found: DataFrame, now: Column) -> None:
    """Store learning round ``number`` under ``path``: its entries and only its new sources.

    Each round is a partition of both tables and replaces nothing but itself, so
    a round that failed half-way or is delivered again leaves the same catalog.
    """
    spark = learned.sparkSession
    entries, known = read_catalog(spark, path, before=number)
    additions = new_sources(known, found)
    for name, rows in (("sources", additions), ("entries", upsert_entries(entries, learned, now))):
        (
            rows.withColumn("round", F.lit(number))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("round")
            .parquet(f"{path}/{name}")
        )


ENTRY_SCHEMA = (
    "lock_key string, name string, language string, skill_path string, content_hash string,"
    " created_at timestamp, updated_at timestamp, learn_count bigint"
)


def read_catalog(spark: SparkSession, path: str, before: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, sources) as they were stored before round ``before``, or last.

    Entries are stored after the sources of their round, so the last round of
    entries is one that has all its sources.
    """

    def stored(name: str, schema: str) -> DataFrame:
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        files = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(there):
            return spark.createDataFrame([], f"{schema}, round int")
        return spark.read.schema(f"{schema}, round int").parquet(f"{path}/{name}")

    entries = stored("entries", ENTRY_SCHEMA)
    if before is not None:
        entries = entries.filter(F.col("round") < before)
    last = entries.agg(F.max("round")).first()[0]
    sources = stored("sources", "lock_key string, kind string, value string")
    if last is None:
        return entries.drop("round").limit(0), sources.drop("round").limit(0)
    return (
        entries.filter(F.col("round") == last).drop("round"),
        sources.filter(F.col("round") <= last).drop("round"),
    )


def list_skills(catalog: DataFrame) -> DataFrame:
    """Entries, most recently updated first."""
    return catalog.orderBy(F.desc("updated_at"), "lock_key")


def _typed(catalog: DataFrame) -> DataFrame:
    parts = skill_path_parts(F.col("skill_path"), F.col("language"))
    return catalog.withColumn("__p", parts).select(
        F.col("__p.skill").alias("skill"),
        F.col("__p.project_type").alias("project_type"),
        "language",
        "updated_at",
        "source_projects",
        F.size("source_files").cast("bigint").alias("n_files"),
    )


def skill_status(catalog: DataFrame) -> DataFrame:
    """(skill, project_type, languages, files, projects, updated_at) per type (A10).

    Distinct projects are counted over exploded rows, so that no list of all
    projects of a type is ever built.
    """
    rows = _typed(catalog)
    sums = rows.groupBy("skill", "project_type").agg(
        F.array_sort(F.collect_set("language")).alias("languages"),
        F.sum("n_files").alias("files"),
        F.max("updated_at").alias("updated_at"),
    )
    projects = (
        rows.select("skill", "project_type", F.explode("source_projects").alias("p"))
        .groupBy("skill", "project_type")
        .agg(F.count_distinct("p").alias("projects"))
    )
    return sums.join(projects, ["skill", "project_type"], "left").withColumn(
        "projects", F.coalesce("projects", F.lit(0))
    )


def status_totals(catalog: DataFrame) -> DataFrame:
    """(skill, types, entries), by skill and over all: the row with null skill (A10)."""
    return (
        _typed(catalog)
        .rollup("skill")
        .agg(
            F.count_distinct("skill", "project_type").alias("types"),
            F.count(F.lit(1)).alias("entries"),
        )
    )


def latest_compatible_run(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Newest run per wanted (project_root, skill, project_type, scan_hash, evidence_hash).

    ``wanted`` may also carry a run_id; then only that run counts.
    """
    keys = ["project_root", "skill", "project_type", "scan_hash", "evidence_hash"]
    on = keys + (["run_id"] if "run_id" in wanted.columns else [])
    return runs.join(wanted.select(*on).distinct(), on, "left_semi").groupBy(*keys).agg(
        F.max("run_id").alias("run_id")
    )


def evidence_fingerprint(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, evidence_hash) over the items alone, so that an equal rescan matches.

    At most one item per rule in a group.
    """
    item = F.struct("rule_id", "confidence", "count", "files")
    return evidence.groupBy(*keys).agg(
        F.sha2(F.to_json(F.array_sort(F.collect_list(item))), 256).alias("evidence_hash")
    )


def with_snapshots(traces: DataFrame, saved_at: str) -> DataFrame:
    """Traces with the generation each belongs to: 1 current, 2 previous."""
    window = Window.partitionBy("skill", "project_type").orderBy(F.desc(saved_at))
    # one row per saving of a reference, not per rule
    saves = traces.select("skill", "project_type", saved_at).distinct()
    ranked = saves.withColumn("generation", F.row_number().over(window)).filter(
        F.col("generation") <= 2
    )
    return traces.join(ranked, ["skill", "project_type", saved_at])
