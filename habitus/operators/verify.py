"""Manifests and checks over layer documents and their traces.

All checks run inside the row of a document; only short results are grouped,
at most eight per reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitus.functions import patterns as rx
from habitus.functions.paths import LAYERS
from habitus.operators import documents as docs
from habitus.operators.documents import let
from habitus.operators.trace import KEY

SECTIONS = tuple(docs.SECTION_ALIASES)
# Section labels by output language, playbook entries.
LABELS = {
    "zh": ("范围", "规则", "模板", "反模式", "证据", "缺口"),
    "en": ("Scope", "Rules", "Templates", "Anti-patterns", "Evidence", "Gaps"),
}
PLAYBOOK = {
    "en": [
        ("Add page/component", "Follow project map, module contracts, naming, execution and cross-cutting policy.", ["L1", "L2", "L3", "L4", "L7"]),
        ("Add API/data flow", "Start from module contracts, then data/state and security/performance policy.", ["L2", "L5", "L7"]),
        ("Add tests or logging", "Use the quality system first, then execution patterns.", ["L6", "L4"]),
        ("Change bootstrap/build", "Use operations/bootstrap and cross-cutting configuration policy.", ["L8", "L7"]),
    ],
    "zh": [
        ("新增页面/组件", "先看项目地图、模块契约、命名、执行模式和横切策略。", ["L1", "L2", "L3", "L4", "L7"]),
        ("新增 API/数据流", "先看模块契约，再看数据状态与安全/性能策略。", ["L2", "L5", "L7"]),
        ("新增测试或日志", "优先遵守质量体系，再参考执行模式。", ["L6", "L4"]),
        ("修改启动/构建", "优先参考工程运行与横切配置策略。", ["L8", "L7"]),
    ],
}
MESSAGE_LIMIT = 500


def layer_grid(keys: DataFrame) -> DataFrame:
    """Every reference with all eight layers."""
    return keys.select(*KEY).distinct().select(
        *KEY, F.explode(F.array(*[F.lit(l) for l in LAYERS])).alias("layer")
    )


def missing_layers(layer_docs: DataFrame) -> DataFrame:
    """(skill, project_type, layer) of the layers a reference lacks."""
    present = layer_docs.select(*KEY, "layer")
    return layer_grid(present).join(present, [*KEY, "layer"], "left_anti")


def document_facts(layer_docs: DataFrame) -> DataFrame:
    """What manifest and checks need of each document, without its text."""

    def facts(found: Column) -> Column:
        count = lambda name: F.size(docs.section_bullets(found, name))
        return F.struct(
            docs.section_bullets(found, "Scope").alias("scope"),
            count("Anti-patterns").alias("anti_pattern_count"),
            count("Gaps").alias("gap_count"),
            F.array_compact(
                F.array(*[F.when(~docs.has_section(found, s), F.lit(s)) for s in SECTIONS])
            ).alias("absent"),
        )

    content = F.col("content")
    return layer_docs.select(
        *KEY,
        "layer",
        "file_stem",
        docs.layer_title(content).alias("title"),
        docs.topics(content).alias("topics"),
        docs.truncation(content).alias("truncation"),
        let(docs.sections(content), facts).alias("facts"),
    ).select(*KEY, "layer", "file_stem", "title", "topics", "truncation", "facts.*")


def layer_manifest(
    layer_docs: DataFrame, rules: DataFrame, templates: DataFrame
) -> DataFrame:
    """One row per reference and layer, present or not."""
    active = F.col("status") == "active"
    by_rule = rules.filter(active).groupBy(*KEY, "layer").agg(
        F.count(F.lit(1)).alias("rule_count"),
        # all rules of a layer cite the same list: distinct lists are few
        F.array_distinct(F.flatten(F.sort_array(F.collect_set("evidence_ids")))).alias("evidence_ids"),
    )
    by_template = templates.filter(active).groupBy(*KEY, "layer").agg(
        F.count(F.lit(1)).alias("template_count")
    )
    rows = layer_grid(layer_docs)
    for side in (document_facts(layer_docs), by_rule, by_template):
        rows = rows.join(side, [*KEY, "layer"], "left")
    empty = F.array().cast("array<string>")
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("bigint").alias(name)
    return rows.select(
        *KEY,
        "layer",
        F.coalesce("title", "layer").alias("title"),
        F.coalesce(F.concat("file_stem", F.lit(".md")), F.lit("")).alias("file"),
        F.coalesce("scope", empty).alias("scope"),
        F.coalesce("topics", empty).alias("topics"),
        zero("rule_count"),
        zero("template_count"),
        zero("anti_pattern_count"),
        zero("gap_count"),
        F.coalesce("evidence_ids", empty).alias("evidence_ids"),
    )


def playbook(spark, language: str = "zh") -> DataFrame:
    """The task playbook: a constant table."""
    return spark.createDataFrame(
        PLAYBOOK[language], "task string, action string, layers array<string>"
    )


def verify(
    layer_docs: DataFrame,
    rules: DataFrame,
    templates: DataFrame,
    llm_validation: DataFrame | None = None,
) -> DataFrame:
    """Errors and warnings per reference; ok means no errors.

    ``llm_validation`` is an optional (skill, project_type, ok, output).
    """
    fact = F.struct("truncation", "absent")
    # at most eight short structs per reference
    by_layer = document_facts(layer_docs).groupBy(*KEY).agg(
        F.map_from_entries(F.collect_list(F.struct("layer", fact))).alias("facts")
    )
    status = F.col("status")
    rule_stats = rules.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("rules"),
        F.count_if(status == "stale").alias("stale_rules"),
        F.count_if(status == "pending").alias("pending_rules"),
    )
    template_stats = templates.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("templates"),
        F.count_if(status == "pending").alias("pending_templates"),
    )
    joined = by_layer.join(rule_stats, list(KEY), "left").join(template_stats, list(KEY), "left")
    if llm_validation is not None:
        joined = joined.join(
            llm_validation.select(*KEY, F.col("ok").alias("llm_ok"), F.col("output").alias("llm_output")),
            list(KEY),
            "left",
        )
    else:
        joined = joined.withColumns(
            {"llm_ok": F.lit(None).cast("boolean"), "llm_output": F.lit(None).cast("string")}
        )
    layers = F.array(*[F.lit(l) for l in LAYERS])
    of = lambda l: F.try_element_at("facts", l)
    n = lambda name: F.coalesce(name, F.lit(0))
    details = rx.trim(rx.squeeze(F.col("llm_output")))
    text = lambda c: c.cast("string")
    errors = F.concat(
        F.array_compact(
            F.transform(
                layers,
                lambda l: F.when(of(l).isNull(), F.concat(l, F.lit(" missing"))).when(
                    of(l)["truncation"].isNotNull(),
                    F.concat(l, F.lit(" appears truncated: "), of(l)["truncation"]),
                ),
            )
        ),
        F.when(
            ~F.col("llm_ok"),
            F.array(
                F.concat(
                    F.lit("LLM validation failed: "),
                    F.coalesce(
                        F.nullif(F.left(details, F.lit(MESSAGE_LIMIT)), F.lit("")),
                        F.lit("no details"),
                    ),
                )
            ),
        ).otherwise(F.array().cast("array<string>")),
    )
    absent = F.flatten(
        F.transform(
            layers,
            lambda l: F.transform(
                F.coalesce(of(l)["absent"], F.array().cast("array<string>")),
                lambda s: F.concat(l, F.lit(" missing "), s, F.lit(" section")),
            ),
        )
    )
    totals = F.array_compact(
        F.array(
            F.when(n("rules") == 0, "No structured rules extracted"),
            F.when(n("pending_templates") > 0, F.concat(text(n("pending_templates")), F.lit(" pending template(s)"))),
            F.when(n("stale_rules") > 0, F.concat(text(n("stale_rules")), F.lit(" stale rule(s)"))),
        )
    )
    listed = joined.select(
        *KEY,
        errors.alias("errors"),
        F.concat(absent, totals).alias("warnings"),
        F.size(F.filter(layers, lambda l: of(l).isNotNull())).cast("bigint").alias("layers"),
        *[n(c).alias(c) for c in ("rules", "templates", "stale_rules", "pending_rules")],
        F.when(
            F.col("llm_ok").isNotNull(),
            F.struct(F.col("llm_ok").alias("ok"), F.col("llm_output").alias("output")),
        ).alias("llm_validation"),
    )
    return listed.withColumn("ok", F.size("errors") == 0)


def failures(report: DataFrame, strict: bool = False) -> DataFrame:
    """References whose report counts as failed; ``strict`` includes warnings."""
    failed = ~F.col("ok")
    if strict:
        failed = failed | (F.size("warnings") > 0)
    return report.filter(failed)


def validate_layers(layer_docs: DataFrame) -> DataFrame:
    """(skill, project_type, layer, issue): missing layers and structure."""
    issue = docs.structure_issue(F.col("content"))
    found = layer_docs.select(*KEY, "layer", issue.alias("issue"))
    return (
        layer_grid(layer_docs)
        .join(found.withColumn("present", F.lit(True)), [*KEY, "layer"], "left")
        .select(*KEY, "layer", F.when(F.col("present").isNull(), "missing").otherwise(F.col("issue")).alias("issue"))
        .filter(F.col("issue").isNotNull())
    )


def local_check(layer_docs: DataFrame, language: str = "zh") -> DataFrame:
    """(skill, project_type, layer, issue): truncation and absent sections."""
    content = F.col("content")
    label = dict(zip(SECTIONS, LABELS[language]))
    absent = {s: ~docs.heading_matches(content, name) for s, name in label.items()}
    no_anti = (
        ~docs.heading_matches(content, "反模式") & ~rx.test(content, r"###\s+Anti-?patterns?", "i")
        if language == "zh"
        else ~docs.heading_matches(content, "Anti-patterns") & ~docs.heading_matches(content, "反模式")
    )
    issues = F.array_compact(
        F.array(
            F.when(docs.looks_cut_off(content), "appears truncated"),
            *[F.when(absent[s], F.lit(f"missing {name}")) for s, name in label.items()],
            F.when(
                absent["Templates"] & ~content.rlike(f"(?i){docs.NO_PATTERN}"),
                "missing template fallback",
            ),
            F.when(no_anti, "missing anti-patterns"),
        )
    )
    found = layer_docs.select(*KEY, "layer", F.explode(issues).alias("issue"))
    gone = missing_layers(layer_docs).withColumn("issue", F.lit("missing"))
    return found.unionByName(gone)


def stale_rules(rules: DataFrame, files: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """(skill, project_type, id, stale): whether every cited file is gone.

    ``files`` is (skill, project_type, path) of the current scan; with ``owners``,
    (skill, project_type, project), it is (project, path).  Then cited paths alone
    are looked up, and the files of a project are not repeated for each of its
    references.
    """
    cited = rules.select(*KEY, "id", F.explode("files").alias("path"))
    if owners is not None:
        wanted = cited.select(*KEY, "path").distinct().join(owners.select(*KEY, "project").distinct(), list(KEY))
        files = wanted.join(files.select("project", "path"), ["project", "path"], "left_semi")
    current = files.select(*KEY, "path").distinct().withColumn("hit", F.lit(True))
    gone = (
        cited.join(current, [*KEY, "path"], "left")
        .groupBy(*KEY, "id")
        .agg((F.count("hit") == 0).alias("stale"))
    )
    return (
        rules.select(*KEY, "id")
        .join(gone, [*KEY, "id"], "left")
        .select(*KEY, "id", F.coalesce("stale", F.lit(False)).alias("stale"))
    )


def mark_stale(rules: DataFrame, files: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """Rules with status 'stale' where all their cited files disappeared."""
    flags = stale_rules(rules, files, owners)
    return rules.join(flags, [*KEY, "id"]).withColumn(
        "status", F.when(F.col("stale"), "stale").otherwise(F.col("status"))
    ).drop("stale")


# How much of a rule text identifies it, rows a report shows.
DIFF_TEXT = 180
DIFF_SHOWN = 12
STALE_SHOWN = 20


def diff_key(text: Column) -> Column:
    """What identifies a rule text: the start of it in lower case, white space squeezed.

    A start of several times the length mostly yields the whole key; only
    where it does not is the whole text squeezed.
    """

    def key(low: Column) -> Column:
        start = F.when(F.length(low) > 2 * DIFF_TEXT, rx.squeeze(F.left(low, F.lit(2 * DIFF_TEXT))))
        return let(
            start,
            lambda s: F.left(F.when(F.length(s) >= DIFF_TEXT, s).otherwise(rx.squeeze(low)), F.lit(DIFF_TEXT)),
        )

    return let(F.lower(text), key)


def trace_diff(current: DataFrame, previous: DataFrame, shown: Column | None = None) -> DataFrame:
    """(skill, project_type, change, layer, text): added and removed rules.

    ``shown`` is what a row shows of its text, all of it if none is given; it is
    made before rows are shuffled.
    Keys are compared by half a SHA-256 digest, 128 bits, so that texts are shuffled
    once as rows that may be shown, and never as keys of the other side.
    """

    def keyed(df: DataFrame) -> DataFrame:
        # a generator stays where it is: a test of the key that a join asks for
        # does not run the key's expressions a second time
        digest = F.unhex(F.left(F.sha2(diff_key(F.col("text")), 256), F.lit(32)))
        text = F.col("text") if shown is None else shown
        return df.select(*KEY, "layer", text.alias("text"), F.inline(F.array(F.struct(digest.alias("__text")))))

    now, before = keyed(current), keyed(previous)
    on = [*KEY, "__text"]
    known = lambda df: df.select(*on).distinct()
    added = now.join(known(before), on, "left_anti").withColumn("change", F.lit("added"))
    removed = before.join(known(now), on, "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed).select(*KEY, "change", "layer", "text")


def inspect(manifest: DataFrame, report: DataFrame, layer: str | None = None) -> DataFrame:
    """Manifest rows with their reference's check result."""
    rows = manifest if layer is None else manifest.filter(F.lower("layer") == layer.lower())
    summary = report.select(
        *KEY, "ok", F.size("warnings").alias("warnings"), F.size("errors").alias("errors")
    )
    return rows.join(summary, list(KEY), "left")


__all__ = [
    "document_facts", "failures", "inspect", "layer_grid", "layer_manifest", "local_check",
    "mark_stale", "missing_layers", "playbook", "stale_rules", "trace_diff",
    "validate_layers", "verify",
]
