"""Evidence: which conventions each project follows, how strongly, in which files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from habitus.functions.timefmt import local_timestamp
from habitus.operators.rules import RULES, Rule, rule_applies, rule_conditions, rules_table, shared_columns
from habitus.operators.skew import first_paths_and_count

# Evidence files kept per rule, and those quoted in a prompt.
FILES_PER_RULE = 12
FILES_PER_PROMPT_LINE = 5
EMPTY_PROMPT = (
    "No deterministic evidence was extracted. Treat all style claims as low"
    " confidence unless supported by code snippets."
)
PROMPT_HEAD = (
    "## Deterministic Evidence\n"
    "Use this as the factual floor. Prefer these observations over unsupported inference.\n\n"
)


def rule_hits(files: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(project, rule_id, path): every file each rule matches.

    All predicates run once, inside the generator right above the scan; only
    the ids of matching rules leave it, the content column does not.  The array
    is not a named column on purpose: a filter on its size would be derived and
    pushed below, and every pattern would run twice.
    """
    matched = F.array_compact(
        F.array(
            *[
                F.when(condition, F.lit(rule.id))
                for rule, condition in zip(rules, rule_conditions(tuple(rules)))
            ]
        )
    )
    files = files.withColumns(shared_columns())
    return files.select("project", F.explode(matched).alias("rule_id"), "path")


def confidence(count: Column, min_high: Column, min_medium: Column) -> Column:
    return (
        F.when(count >= min_high, "high")
        .when(count >= min_medium, "medium")
        .otherwise("low")
    )


def confidence_rank(value: Column) -> Column:
    return F.when(value == "high", 3).when(value == "medium", 2).otherwise(1)


def collect_evidence(
    files: DataFrame, project_types: DataFrame, rules: Sequence[Rule] = RULES
) -> DataFrame:
    """Evidence items per project (A3, A4).

    ``project_types`` is (project, project_type).  Rules that do not apply to a
    project's type are dropped after aggregation, when a project has at most
    one row per rule.
    """
    return evidence_of_hits(rule_hits(files, rules), project_types, rules)


def evidence_of_hits(
    hits: DataFrame, project_types: DataFrame, rules: Sequence[Rule] = RULES
) -> DataFrame:
    """Evidence items from (project, rule_id, path), however they were found."""
    found = first_paths_and_count(hits, ["project", "rule_id"], "path", FILES_PER_RULE)
    # the rule table has one row per rule: a fixed, tiny broadcast
    described = found.join(
        F.broadcast(rules_table(hits.sparkSession, list(rules))), "rule_id"
    )
    typed = described.join(project_types, "project", "left").withColumn(
        "project_type", F.coalesce("project_type", F.lit("unknown"))
    )
    return typed.filter(rule_applies(F.col("applies_to"), F.col("project_type"))).select(
        "project",
        "project_type",
        "rule_id",
        "layer",
        "category",
        "summary",
        confidence(F.col("count"), F.col("min_high"), F.col("min_medium")).alias(
            "confidence"
        ),
        "files",
        F.col("count").cast("bigint").alias("count"),
    )


def evidence_order() -> list[Column]:
    return [
        F.asc("layer"),
        F.desc(confidence_rank(F.col("confidence"))),
        F.desc("count"),
        F.asc("rule_id"),
    ]


def order_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence with its report position per project."""
    # at most one row per rule in a window partition
    window = Window.partitionBy("project").orderBy(*evidence_order())
    return evidence.withColumn("position", F.row_number().over(window))


def evidence_reports(
    files_summary: DataFrame, project_types: DataFrame, evidence: DataFrame
) -> DataFrame:
    """Report header per project: type, languages, sizes, item count."""
    items = evidence.groupBy("project").agg(F.count(F.lit(1)).alias("item_count"))
    return (
        files_summary.join(project_types, "project", "left")
        .join(items, "project", "left")
        .select(
            "project",
            F.coalesce("project_type", F.lit("unknown")).alias("project_type"),
            "languages",
            "file_count",
            "total_size",
            F.coalesce("item_count", F.lit(0)).alias("item_count"),
        )
    )


def evidence_stats(evidence: DataFrame, types: DataFrame, key: Sequence[str]) -> DataFrame:
    """Counts per type, with ``missing`` where a type has no evidence at all (A5)."""
    stats = evidence.groupBy(*key).agg(
        F.count(F.lit(1)).alias("item_count"),
        F.count_distinct("layer").alias("covered_layers"),
        F.count_if(F.col("confidence") == "high").alias("high"),
        F.count_if(F.col("confidence") == "medium").alias("medium"),
        F.count_if(~F.col("confidence").isin("high", "medium")).alias("low"),
    )
    joined = types.select(*key).distinct().join(stats, list(key), "left")
    return joined.select(
        *key,
        *[
            F.coalesce(F.col(c), F.lit(0)).alias(c)
            for c in ("item_count", "covered_layers", "high", "medium", "low")
        ],
        F.col("item_count").isNull().alias("missing"),
    )


def _listed(line: Column, order_by: Sequence[str] = ("position",)) -> Column:
    """Newline-joined lines in order; groups are bounded by the rule count."""
    ordered = F.array_sort(F.collect_list(F.struct(*order_by, line.alias("line"))))
    return F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")


def evidence_prompt(evidence: DataFrame, projects: DataFrame) -> DataFrame:
    """(project, prompt): one line per item, fixed text where there is none (M1)."""
    line = F.format_string(
        "- %s/%s [%s, %d file(s)]: %s Evidence files: %s",
        F.col("layer"),
        F.col("category"),
        F.col("confidence"),
        F.col("count"),
        F.col("summary"),
        F.array_join(F.slice("files", 1, FILES_PER_PROMPT_LINE), ", "),
    )
    lines = order_evidence(evidence).groupBy("project").agg(_listed(line).alias("lines"))
    return (
        projects.select("project")
        .distinct()
        .join(lines, "project", "left")
        .select(
            "project",
            F.coalesce(
                F.concat(F.lit(PROMPT_HEAD), "lines"), F.lit(EMPTY_PROMPT)
            ).alias("prompt"),
        )
    )


def escape_cell(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), r"\r?\n", " ")


# Labels of the rendered evidence report.
REPORT_LABELS = {
    "zh": {
        "title": "# 证据 · ",
        "generated": "生成时间：",
        "summary": "## 摘要",
        "files": "- 扫描文件数：",
        "languages": "- 语言：",
        "items": "- 证据项：",
        "table": "## 证据表",
        "head": "| 层级 | 类别 | 置信度 | 数量 | 证据 | 文件 |",
        "note": "> 本文件是在 LLM 合成前由确定性规则提取的证据。",
    },
    "en": {
        "title": "# Evidence · ",
        "generated": "Generated at: ",
        "summary": "## Summary",
        "files": "- Files scanned: ",
        "languages": "- Languages: ",
        "items": "- Evidence items: ",
        "table": "## Evidence Table",
        "head": "| Layer | Category | Confidence | Count | Evidence | Files |",
        "note": "> This file is deterministic evidence extracted before the LLM synthesis step.",
    },
}


def evidence_report_text(
    reports: DataFrame, evidence: DataFrame, generated_at: Column, language: str = "zh"
) -> DataFrame:
    """(project, report): the markdown report of each project."""
    label = REPORT_LABELS[language]
    row = F.concat(
        F.lit("| "),
        F.concat_ws(
            " | ",
            "layer",
            "category",
            "confidence",
            F.col("count").cast("string"),
            escape_cell(F.col("summary")),
            escape_cell(F.array_join("files", "<br>")),
        ),
        F.lit(" |"),
    )
    rows = order_evidence(evidence).groupBy("project").agg(_listed(row).alias("rows"))
    langs = F.array_join("languages", ", ")
    head = [
        F.concat(F.lit(label["title"]), "project_type"),
        F.lit(""),
        F.concat(F.lit(label["generated"]), local_timestamp(generated_at)),
        F.lit(""),
        F.lit(label["summary"]),
        F.lit(""),
        F.concat(F.lit(label["files"]), F.col("file_count").cast("string")),
        F.concat(
            F.lit(label["languages"]), F.when(langs == "", "unknown").otherwise(langs)
        ),
        F.concat(F.lit(label["items"]), F.col("item_count").cast("string")),
        F.lit(""),
        F.lit(label["table"]),
        F.lit(""),
        F.lit(label["head"]),
        F.lit("|-------|----------|------------|-------|----------|-------|"),
    ]
    return (
        reports.join(rows, "project", "left")
        .select(
            "project",
            F.concat_ws(
                "\n", *head, F.col("rows"), F.lit(""), F.lit(label["note"])
            ).alias("report"),
        )
    )


__all__ = [
    "collect_evidence",
    "confidence",
    "evidence_of_hits",
    "evidence_order",
    "evidence_prompt",
    "evidence_report_text",
    "evidence_reports",
    "evidence_stats",
    "order_evidence",
    "rule_hits",
]
