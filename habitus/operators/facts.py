"""What later steps need to know of every file, from one read of the contents.

``file_facts`` turns raw files into narrow rows: attributes, digest, length, a
score per layer, and a bit per convention rule that the file matches.  Rules are
tried on files that the scan's own filters let through; every other file keeps
its path, since project types and ignore files are read from here too.
``write_facts`` stores the rows in buckets of (project, path).

Ignore files are applied to the narrow rows.  Projects share pattern sets, so a
set is compiled once and decides each directory once; only the globs that can
match a file in a directory they do not cover are tried on paths.  The decision
never touches contents, at any size.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitus.config import ScanConfig
from habitus.functions import globs
from habitus.functions import patterns as rx
from habitus.functions.languages import detect_language, file_priority
from habitus.functions.paths import LAYERS, file_extension, layer_scores
from habitus.operators import scanning
from habitus.operators.rules import RULES, Rule, rule_conditions, shared_columns
from habitus.session import shared_folder

#: Rules in one long of the mask.
BITS = 62
#: Files whose text is kept: project types and ignore patterns are read from it.
KEPT_TEXTS = ("package.json", ".gitignore")
KEY = ("project", "path")


def rule_mask(rules: Sequence[Rule]) -> Column:
    """One bit per rule, in longs of ``BITS`` rules."""
    words = []
    conditions = rule_conditions(tuple(rules))
    for first in range(0, len(conditions), BITS):
        word = F.lit(0).cast("bigint")
        for bit, condition in enumerate(conditions[first : first + BITS]):
            word = word.bitwiseOR(F.when(condition, F.lit(1 << bit)).otherwise(F.lit(0)).cast("bigint"))
        words.append(word)
    return F.array(*words)


def file_facts(
    files_raw: DataFrame, config: ScanConfig = ScanConfig(), rules: Sequence[Rule] = RULES
) -> DataFrame:
    """(project, path, size, scanned, language, extension, length, lead, digest, priority,
    scores, mask, text) of every raw file.

    ``scanned`` tells whether the path and content filters keep the file; columns
    that say more than its path does are null where they do not.  ``lead`` counts
    the white space the content begins with.
    """
    files = scanning.with_slashes(files_raw).select("project", "path", "content", F.col("size").cast("bigint").alias("size"))
    kept = F.coalesce(scanning.path_filters(config) & scanning.scannable(config.max_file_size), F.lit(False))
    # columns of their own, so that the rules share them instead of repeating them
    marked = files.withColumns(
        {
            "scanned": kept,
            "extension": file_extension(F.col("path")),
            **shared_columns(),
        }
    )
    here = lambda value: F.when(F.col("scanned"), value)
    scores = F.transform(layer_scores(F.col("path")), lambda s: s["score"])
    length = F.length("content")
    return marked.select(
        "project", "path", "size", "scanned",
        here(detect_language(F.col("path"))).alias("language"), "extension",
        here(length).alias("length"),
        here(length - F.length(rx.trim_start(F.col("content")))).alias("lead"),
        here(F.sha2("content", 256)).alias("digest"),
        here(file_priority(F.col("path"))).alias("priority"),
        here(scores).alias("scores"),
        here(rule_mask(rules)).alias("mask"),
        F.when(F.col("path").isin(*KEPT_TEXTS), F.col("content")).alias("text"),
    )


def stored(rows: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, written once and read by several steps."""
    place = f"{shared_folder(rows.sparkSession).rstrip('/')}/rows_{uuid.uuid4().hex}"
    rows.write.parquet(place)
    return rows.sparkSession.read.schema(rows.schema).parquet(place)


def write_facts(facts: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows stored in buckets of (project, path), in the folder all executors share.

    Joins by that key read the table without an exchange.
    """
    spark = facts.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"facts_{uuid.uuid4().hex}"
    place = folder or f"{shared_folder(spark).rstrip('/')}/{name}"
    writer = facts.repartition(buckets, *KEY).write.format("parquet").option("path", place)
    writer.bucketBy(buckets, *KEY).sortBy(*KEY).saveAsTable(name)
    return spark.table(name)


def _own_texts(facts: DataFrame, name: str) -> DataFrame:
    return facts.filter(F.col("path") == name).select("project", "path", F.col("text").alias("content"))


def pattern_sets(ignore_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(project, set) and (set, dir_regex, file_regex) of root ignore files.

    A set is what the globs of one or many projects have in common: their text.
    ``file_regex`` holds the globs that can match a file without covering its
    directory, null if there are none.
    """
    listed = globs.gitignore_globs(F.col("content"))
    found = (
        ignore_files.filter((F.col("path") == ".gitignore") & F.col("content").isNotNull())
        .select("project", listed.alias("globs"))
        .filter(F.size("globs") > 0)
        .withColumn("set", F.sha2(F.array_join("globs", "\n"), 256))
    )
    narrow = F.filter("globs", lambda g: ~F.endswith(g, F.lit("**")))
    sets = (
        found.groupBy("set")
        .agg(F.first("globs").alias("globs"))
        .select("set", globs.globs_alternation(F.col("globs")).alias("dir_regex"), globs.globs_alternation(narrow).alias("file_regex"))
    )
    return found.select("project", "set"), sets


def ignored_paths(paths: DataFrame, ignore_files: DataFrame) -> DataFrame:
    """(project, path) of the files that their project's root ignore file covers.

    ``paths`` holds (project, path), ``ignore_files`` (project, path, content).
    A directory is decided by its path and a final slash: every glob that
    reaches so far ends in text of any kind, so it covers all files below.
    """
    owners, sets = pattern_sets(ignore_files)
    folder = F.regexp_extract("path", "^(.*/)?[^/]*", 1)
    keyed = paths.select(*KEY, folder.alias("folder")).join(owners, "project")
    folders = keyed.select("set", "folder").distinct().join(sets, "set")
    decided = folders.select(
        "set", "folder", globs.prunes_path(F.col("folder"), F.col("dir_regex")).alias("covered"), "file_regex"
    ).filter("covered or file_regex is not null")
    by_file = F.when(F.col("covered"), True).otherwise(globs.prunes_path(F.col("path"), F.col("file_regex")))
    return keyed.join(decided, ["set", "folder"]).filter(by_file).select(*KEY)


def scanned_facts(facts: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Facts of the files a scan returns (S1-S6): filtered, and not ignored."""
    kept = facts.filter("scanned")
    if not config.respect_gitignore:
        return kept
    ignored = ignored_paths(kept, _own_texts(facts, ".gitignore"))
    return kept.join(ignored, list(KEY), "left_anti")


def project_types(facts: DataFrame) -> DataFrame:
    """(project, project_type) of all raw projects (S8), without another read of contents."""
    return scanning.detect_project_type(facts.withColumn("content", F.col("text")))


def fact_hits(facts: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(project, rule_id, path): the rules whose bits are set."""
    set_ = [
        F.when(F.get("mask", F.lit(k // BITS)).bitwiseAND(F.lit(1 << k % BITS)) != 0, F.lit(rule.id))
        for k, rule in enumerate(rules)
    ]
    return facts.select("project", F.explode(F.array_compact(F.array(*set_))).alias("rule_id"), "path")


def scored_layers() -> Column:
    """The stored scores as array of struct(layer, score), as ``paths.layer_scores`` gives them."""
    return F.array(
        *(
            F.struct(F.lit(layer).alias("layer"), F.get("scores", F.lit(k)).alias("score"))
            for k, layer in enumerate(LAYERS)
        )
    )
