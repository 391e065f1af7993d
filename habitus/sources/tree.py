"""Raw source trees as a table.

Spark's own file sources skip every path segment that starts with a dot or an
underscore, which loses ``.env``, ``.github`` and ``__init__.py``.  A tree is read
in two steps instead:

1. Folders are listed level by level, each one once.  A level is a table of
   folders, spread over all tasks; before it is listed, folders that a scan would
   leave out are dropped, so nothing below ``node_modules`` or an ignored folder is
   ever looked at.
2. The files found are dealt into splits of about equal bytes, and every split is
   read by a task of its own, so a huge repository is as many tasks as it needs.

The folders have to be a mount that all executors see.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitus.config import ScanConfig
from habitus.functions import globs
from habitus.operators.facts import pattern_sets, stored
from habitus.operators.scanning import outside_hidden_dirs

SCHEMA = "project string, path string, content string, size bigint"
ENTRIES = "project string, path string, is_folder boolean, size bigint"
#: Bytes of files that a task reads.
SPLIT_BYTES = 64 << 20
#: Rows that a task hands on at once.
ROWS = 256


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What is in each folder of (project, path); links are left out."""
    for batch in batches:
        rows = []
        for project, folder in zip(batch["project"], batch["path"]):
            try:
                with os.scandir(os.path.join(project, folder)) as entries:
                    for entry in entries:
                        path = f"{folder}/{entry.name}" if folder else entry.name
                        if entry.is_dir(follow_symlinks=False):
                            rows.append((project, path, True, 0))
                        elif entry.is_file(follow_symlinks=False):
                            rows.append((project, path, False, entry.stat().st_size))
            except OSError:
                continue
        yield pd.DataFrame(rows, columns=["project", "path", "is_folder", "size"])


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of (project, path, size); files that are no text or cannot be read are left out."""
    for batch in batches:
        rows, held = [], 0
        for project, path, size in zip(batch["project"], batch["path"], batch["size"]):
            try:
                with open(os.path.join(project, path), encoding="utf-8", newline="") as handle:
                    rows.append((project, path, handle.read(), size))
            except (OSError, UnicodeDecodeError):
                continue
            held += size
            if len(rows) >= ROWS or held > 4 << 20:
                yield pd.DataFrame(rows, columns=["project", "path", "content", "size"])
                rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["project", "path", "content", "size"])


def _pruned(folders: DataFrame, config: ScanConfig, ignores: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    """Folders that a scan enters: none that is hidden, excluded or ignored as a whole."""
    inside = F.concat("path", F.lit("/"))
    kept = folders.filter(outside_hidden_dirs(inside, config.visible_hidden_dirs)).filter(
        ~globs.match_globs_or_ancestor(inside, config.exclude)
    )
    if ignores is None:
        return kept
    owners, sets = ignores
    covered = globs.prunes_path(inside, F.col("dir_regex"))
    return (
        kept.join(owners, "project", "left")
        .join(sets, "set", "left")
        .filter(~F.coalesce(covered, F.lit(False)))
        .select("project", "path")
    )


def list_tree(
    spark: SparkSession, roots: list[str], config: ScanConfig | None = ScanConfig()
) -> tuple[DataFrame, DataFrame]:
    """(project, path, size) of all files, and (project, path) of the folders listed.

    A round lists one level; there are as many rounds as the deepest tree has
    levels.  ``config`` names what is left out, None lists everything.
    """
    level = spark.createDataFrame([(root, "") for root in dict.fromkeys(roots)], "project string, path string")
    ignores, files, folders = None, None, None
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        spread = stored(level.repartition(tasks, "project", "path"))
        found = stored(spread.mapInPandas(_listed, ENTRIES))
        own = found.filter("not is_folder").select("project", "path", "size")
        files = own if files is None else files.unionByName(own)
        folders = spread if folders is None else folders.unionByName(spread)
        if ignores is None and config is not None and config.respect_gitignore:
            texts = own.filter(F.col("path") == ".gitignore").mapInPandas(_contents, SCHEMA)
            ignores = tuple(map(stored, pattern_sets(texts)))
        level = found.filter("is_folder").select("project", "path")
        if config is not None:
            level = _pruned(level, config, ignores)
        level = stored(level)
        if level.isEmpty():
            return files, folders


def splits(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``files`` dealt into partitions of about ``split_bytes``; a larger file stays whole."""

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            if len(batch):
                upto = before + np.cumsum(batch["size"].to_numpy())
                start = upto - batch["size"].to_numpy()
                before = int(upto[-1])
                yield batch.assign(part=part, place=start // split_bytes)

    dealt = stored(files.mapInPandas(numbered, "project string, path string, size bigint, part int, place bigint"))
    used = {r["part"]: r["n"] for r in dealt.groupBy("part").agg((F.max("place") + 1).alias("n")).collect()}
    firsts = dict(zip(sorted(used), np.cumsum([0, *(used[p] for p in sorted(used))]).tolist()))
    if not used:
        return files
    first = F.element_at(F.create_map(*[F.lit(x) for pair in firsts.items() for x in pair]), F.col("part"))
    number = (first + F.col("place")).cast("int")
    return dealt.repartitionById(sum(used.values()), number).select("project", "path", "size")


def read_tree(
    spark: SparkSession, roots: list[str], max_bytes: int | None = None,
    config: ScanConfig | None = ScanConfig(), split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """(project, path, content, size) of every text file below the roots.

    ``max_bytes`` spares reading files that a later size filter would drop.  A
    folder that ``config`` excludes is not entered; its own filters for files are
    left to ``scan_files``.
    """
    files, _ = list_tree(spark, roots, config)
    files = files.filter(F.col("size") > 0)
    if max_bytes is not None:
        files = files.filter(F.col("size") <= max_bytes)
    return splits(files, split_bytes).mapInPandas(_contents, SCHEMA)
