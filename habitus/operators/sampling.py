"""Code samples and file plans under character and file budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from habitus.functions import patterns as rx
from habitus.functions.languages import file_priority
from habitus.functions.paths import IMPORTANT_SCORE, layer_scores
from habitus.operators.facts import scored_layers
from habitus.operators.skew import top_k, within_budget
from habitus.session import broadcast_if_small, cut_lineage

# Budgets.
SAMPLE_BUDGET = 50_000
SAMPLE_BUDGET_LEARN = 80_000
SAMPLE_FILE_LIMIT = 8_000
SAMPLE_HALF = 4_000
CUT_MARK = "\n\n... (truncated) ...\n\n"
LISTING_BUDGET = 20_000
LAYER_BUDGET = 30_000
LAYER_MAX_FILES = 12
LAYER_FILE_LIMIT = 4_000
LAYER_IMPORTANT_LIMIT = 8_000
CUT_MARK_RESERVE = 38
HEAD_ONLY_LIMIT = 1_000


def _measured(files: DataFrame) -> DataFrame:
    """Files with length, leading white space, priority and layer scores, computed next to the scan."""
    length = F.length("content")
    return files.withColumns(
        {
            "length": length,
            "lead": length - F.length(rx.trim_start(F.col("content"))),
            "priority": file_priority(F.col("path")),
            "layers": layer_scores(F.col("path")),
        }
    )


def _known(files: DataFrame, facts: DataFrame | None) -> DataFrame:
    return _measured(files) if facts is None else facts.withColumn("layers", scored_layers())


def code_sample(
    files: DataFrame, max_chars: int = SAMPLE_BUDGET, facts: DataFrame | None = None
) -> DataFrame:
    """(project, position, path, content): files by priority, then size, until the
    emitted characters reach the budget (W1).

    Priorities and emitted lengths come from ``facts`` or are computed next to the
    scan; the running sum works on that metadata only, and contents join back for
    the chosen.
    """
    length = F.length("content")
    meta = _known(files, facts).select(
        "project",
        "path",
        "size",
        "priority",
        F.when(
            F.col("length") > SAMPLE_FILE_LIMIT, 2 * SAMPLE_HALF + len(CUT_MARK)
        ).otherwise(F.col("length")).alias("emitted"),
    )
    chosen = within_budget(
        meta,
        ["project"],
        [F.asc("priority"), F.asc("size"), F.asc("path")],
        "emitted",
        max_chars,
        unique=["path"],
    ).select("project", "path", "position")
    cut = F.when(
        length > SAMPLE_FILE_LIMIT,
        F.concat(
            F.left("content", F.lit(SAMPLE_HALF)),
            F.lit(CUT_MARK),
            F.right("content", F.lit(SAMPLE_HALF)),
        ),
    ).otherwise(F.col("content"))
    return pick_files(files, chosen).select(
        "project", "position", "path", cut.alias("content")
    )


def pick_files(files: DataFrame, chosen: DataFrame) -> DataFrame:
    """Join file rows to a choice of (project, path); contents stay at the scan.

    The choice is bounded per project, not overall.  It is written and measured:
    up to the broadcast limit it goes to the scan of contents.  Beyond it the
    runtime filter of ``build_session`` drops other files at the scan, and only
    chosen contents are shuffled, by (project, path) - a key without hot values.
    """
    choice = cut_lineage(chosen)
    small = broadcast_if_small(choice)
    return files.join(choice if small is None else small, ["project", "path"])


def layer_file_plan(files: DataFrame) -> DataFrame:
    """(project, layer, position, path, size, score): best files per layer.

    ``files`` are scanned files or their facts, whose scores are taken as stored.
    """
    layers = scored_layers() if "scores" in files.columns else layer_scores(F.col("path"))
    scored = files.select(
        "project", "path", "size", F.explode(layers).alias("s")
    ).select("project", "path", "size", "s.layer", "s.score")
    return top_k(
        scored.filter(F.col("score") > 0),
        ["project", "layer"],
        [F.desc("score"), F.asc("size"), F.asc("path")],
        LAYER_MAX_FILES,
        unique=["path"],
        rank="position",
    )


def sanitize_file_plan(plan: DataFrame, files: DataFrame) -> DataFrame:
    """(project, layer, position, path): proposed paths that exist, at most 12.

    ``plan`` is (project, layer, paths ARRAY<STRING>).
    """
    proposed = plan.select(
        "project", "layer", F.posexplode("paths").alias("ord", "path")
    ).filter(F.col("path").isNotNull())
    known = proposed.join(
        files.select("project", "path"), ["project", "path"], "left_semi"
    )
    return top_k(
        known,
        ["project", "layer"],
        [F.asc("ord")],
        LAYER_MAX_FILES,
        unique=["ord"],
        rank="position",
    ).select("project", "layer", "position", "path")


def merge_file_plans(selected: DataFrame, fallback: DataFrame) -> DataFrame:
    """Selected files first, then fallback ones, distinct, at most 12 per layer."""
    columns = ["project", "layer", "position", "path"]
    both = (
        selected.select(*columns)
        .withColumn("source", F.lit(0))
        .unionByName(fallback.select(*columns).withColumn("source", F.lit(1)))
    )
    first = both.groupBy("project", "layer", "path").agg(
        F.min(F.struct("source", "position")).alias("first")
    )
    # both plans hold at most 12 files per layer, so the window is bounded
    order = Window.partitionBy("project", "layer").orderBy("first")
    return (
        first.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= LAYER_MAX_FILES)
        .select(*columns)
    )


def truncate_middle(text: Column, limit: Column) -> Column:
    """Cut to about ``limit`` characters, keeping both ends when there is room."""
    head = F.floor(limit * F.lit(0.6)).cast("int")
    tail = F.greatest(F.lit(0), limit - head - CUT_MARK_RESERVE)
    return (
        F.when(F.length(text) <= limit, text)
        .when(limit <= HEAD_ONLY_LIMIT, F.left(text, limit))
        .otherwise(F.concat(F.left(text, head), F.lit(CUT_MARK), F.right(text, tail)))
    )


def truncated_length(length: Column, limit: Column) -> Column:
    """Length of ``truncate_middle`` without building the text."""
    head = F.floor(limit * F.lit(0.6)).cast("int")
    tail = F.greatest(F.lit(0), limit - head - CUT_MARK_RESERVE)
    return (
        F.when(length <= limit, length)
        .when(limit <= HEAD_ONLY_LIMIT, limit)
        .otherwise(head + tail + len(CUT_MARK))
    )


def layer_samples(
    plan: DataFrame, files: DataFrame, facts: DataFrame | None = None
) -> DataFrame:
    """(project, layer, position, path, content): plan files cut to the layer budget.

    What a file may use depends on what earlier ones emitted, so the at most 12
    (length, limit) pairs of a layer are folded in order; contents stay out of
    the fold and are cut afterwards.  A file whose cut would be blank is passed
    over: only a short cut, which keeps the beginning alone, can be, and the count
    of leading white space tells.
    """
    meta = _known(files, facts).select(
        "project",
        "path",
        "size",
        F.col("length").cast("int").alias("length"),
        F.col("lead").cast("int").alias("lead"),
        F.explode("layers").alias("s"),
    ).select("project", "path", "size", "length", "lead", "s.layer", "s.score")
    planned = plan.select("project", "layer", "path").join(
        meta, ["project", "layer", "path"]
    )
    entry = F.struct(
        (-F.col("score")).alias("order_score"),
        "size",
        "path",
        "length",
        "lead",
        F.when(F.col("score") >= IMPORTANT_SCORE, LAYER_IMPORTANT_LIMIT)
        .otherwise(LAYER_FILE_LIMIT)
        .alias("limit"),
    )
    grouped = planned.groupBy("project", "layer").agg(
        F.array_sort(F.collect_list(entry)).alias("entries")
    )
    start = F.struct(
        F.lit(0).alias("total"),
        F.array().cast("array<struct<path:string,limit:int>>").alias("picked"),
    )

    def step(state: Column, entry: Column) -> Column:
        limit = F.least(entry["limit"], F.lit(LAYER_BUDGET) - state["total"])
        taken = F.struct(
            (state["total"] + truncated_length(entry["length"], limit)).alias("total"),
            F.concat(
                state["picked"],
                F.array(F.struct(entry["path"].alias("path"), limit.alias("limit"))),
            ).alias("picked"),
        )
        blank = (entry["length"] > limit) & (limit <= HEAD_ONLY_LIMIT) & (entry["lead"] >= limit)
        return F.when((state["total"] < LAYER_BUDGET) & ~blank, taken).otherwise(state)

    picked = grouped.select(
        "project",
        "layer",
        F.posexplode(F.aggregate("entries", start, step)["picked"]).alias("ord", "p"),
    ).select(
        "project",
        "layer",
        (F.col("ord") + 1).alias("position"),
        F.col("p.path").alias("path"),
        F.col("p.limit").alias("limit"),
    )
    return pick_files(files.select("project", "path", "content"), picked).select(
        "project",
        "layer",
        "position",
        "path",
        truncate_middle(F.col("content"), F.col("limit")).alias("content"),
    )


def file_listing(files: DataFrame, budget: int = LISTING_BUDGET) -> DataFrame:
    """(project, listing): sorted file lines within the budget, then what was left out."""
    lines = files.select(
        "project",
        F.concat(
            "path",
            F.lit(" ("),
            "language",
            F.lit(", "),
            F.col("size").cast("string"),
            F.lit(" bytes)"),
        ).alias("line"),
    ).withColumn("cost", F.length("line") + 1)
    totals = lines.groupBy("project").agg(F.count(F.lit(1)).alias("n_files"))
    kept = within_budget(
        lines, ["project"], [F.asc("line")], "cost", budget, unique=["line"], inclusive=True
    )
    # at most budget characters per project
    shown = kept.groupBy("project").agg(
        F.count(F.lit(1)).alias("n_shown"),
        F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("shown"),
    )
    left_out = F.col("n_files") - F.coalesce("n_shown", F.lit(0))
    return totals.join(shown, "project", "left").select(
        "project",
        F.concat_ws(
            "\n",
            "shown",
            F.when(
                left_out > 0,
                F.concat(
                    F.lit("... "),
                    left_out.cast("string"),
                    F.lit(" more file(s) omitted"),
                ),
            ),
        ).alias("listing"),
    )


__all__ = [
    "code_sample",
    "file_listing",
    "layer_file_plan",
    "layer_samples",
    "merge_file_plans",
    "pick_files",
    "sanitize_file_plan",
    "truncate_middle",
]
