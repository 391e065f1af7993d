"""Prompt tables: one row per project and layer (M2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitus.functions.paths import LAYERS
from habitus.operators import documents as docs
from habitus.operators.sampling import truncate_middle

# Limits of prompt parts.
EXISTING_LIMIT = 6_000
STALE_SHOWN = 20
# Layer titles, topics, template names, scopes by output language.
LAYER_TITLES = {
    "zh": dict(zip(LAYERS, docs.LAYER_NAMES.values())),
    "en": dict(
        zip(
            LAYERS,
            (
                "Project Skeleton", "Modules And Interfaces", "Naming And Types", "Implementation Patterns",
                "Data And State", "Quality Assurance", "Cross-Cutting Concerns", "Engineering And Bootstrap",
            ),
        )
    ),
}
LAYER_SPECS = {
    "en": {
        "L1": (("Directory Layout And File Naming", "Module Organization"), "New Project Structure", "[Minimal directory tree]"),
        "L2": (("Module Split Granularity", "API/Interface Design", "Dependency Organization"), "New Module Skeleton", "[Module skeleton]"),
        "L3": (("Naming Conventions", "Type Usage", "Constant Management"), "Naming Example", "[Naming example]"),
        "L4": (("Function Design", "Error Handling", "Async/Concurrency", "Resource Management"), "Typical Function", "[Input -> validate -> process -> error -> output]"),
        "L5": (("State Management", "Data Persistence", "Caching Strategy"), "Data Access", "[Data fetch + state + cache]"),
        "L6": (("Testing", "Lint/Formatting", "Docs And Comments", "Logging"), "Test Skeleton", "[Test skeleton]"),
        "L7": (("Security", "Performance", "Configuration Management"), "No existing pattern", "No existing pattern"),
        "L8": (("Build Tooling", "Package Management", "Application Bootstrap", "Environment Management", "Common Dependencies", "Git Conventions", "CI/CD"), "Project Startup Commands", "[Scaffold commands]"),
    },
    "zh": {
        "L1": (("目录结构与文件命名", "模块组织方式"), "新项目结构", "[最小目录树]"),
        "L2": (("模块拆分粒度", "API/接口设计", "依赖组织"), "新模块骨架", "[模块骨架]"),
        "L3": (("命名约定", "类型使用", "常量管理"), "命名示例", "[命名示例]"),
        "L4": (("函数设计", "错误处理", "异步/并发", "资源管理"), "典型函数", "[输入 -> 校验 -> 处理 -> 错误 -> 输出]"),
        "L5": (("状态管理", "数据持久化", "缓存策略"), "数据访问", "[数据请求 + 状态 + 缓存]"),
        "L6": (("测试", "Lint/格式化", "文档与注释", "日志"), "测试骨架", "[测试骨架]"),
        "L7": (("安全", "性能", "配置管理"), "无现有模式", "无现有模式"),
        "L8": (("构建工具", "包管理", "应用启动", "环境管理", "常用依赖", "Git 约定", "CI/CD"), "项目启动命令", "[脚手架命令]"),
    },
}
LAYER_META = {
    "en": {
        "L1": ("project map, entrypoints, directory responsibilities, runtime boundaries", "module API details, function internals, deployment scripts", ("add page/component", "locate entrypoint", "place new files")),
        "L2": ("module contracts, public interfaces, dependency direction, split granularity", "local function bodies, persistence details, build operations", ("add API", "split module", "define boundary")),
        "L3": ("domain language, naming, type shapes, DTO/entity/model vocabulary", "runtime control flow and storage implementation", ("name types", "add DTO/model", "align constants")),
        "L4": ("execution patterns, function shape, error flow, async/resource handling", "module placement, data schema ownership, CI/build setup", ("write function", "handle errors", "add async flow")),
        "L5": ("state, persistence, caching, transactions, data flow", "UI layout, generic naming, build tooling", ("add store/repository", "change data flow", "add cache")),
        "L6": ("quality system: tests, lint, formatting, docs, logging/observability", "business rule invention, deployment topology", ("add tests", "add logging", "update docs")),
        "L7": ("cross-cutting policy: security, authorization, performance, configuration, i18n/accessibility when present", "one-off feature implementation unless it expresses a shared policy", ("add permission", "validate input", "optimize shared path")),
        "L8": ("operations and bootstrap: package manager, build, startup, env, CI/CD, deployment hooks", "feature-level business logic and local function internals", ("change startup", "adjust build", "configure environment")),
    },
    "zh": {
        "L1": ("项目地图、入口、目录职责、运行边界", "模块 API 细节、函数内部实现、部署脚本", ("新增页面/组件", "定位入口", "放置新文件")),
        "L2": ("模块契约、公开接口、依赖方向、拆分粒度", "局部函数体、持久化细节、构建运行配置", ("新增 API", "拆分模块", "定义边界")),
        "L3": ("领域语言、命名、类型形态、DTO/Entity/Model 词汇", "运行控制流和存储实现", ("命名类型", "新增 DTO/模型", "对齐常量")),
        "L4": ("执行模式、函数形态、错误流、异步与资源处理", "模块放置、数据 schema 归属、CI/构建设置", ("编写函数", "处理错误", "新增异步流程")),
        "L5": ("状态、持久化、缓存、事务、数据流", "UI 布局、通用命名、构建工具", ("新增 store/repository", "修改数据流", "新增缓存")),
        "L6": ("质量体系：测试、lint、格式化、文档、日志/观测", "凭空新增业务规则、部署拓扑", ("新增测试", "补日志", "更新文档")),
        "L7": ("横切策略：安全、权限、性能、配置、存在时的国际化/可访问性", "不能代表共享策略的一次性功能实现", ("新增权限", "输入校验", "优化公共路径")),
        "L8": ("工程运行：包管理、构建、启动、环境、CI/CD、部署钩子", "特性级业务逻辑和局部函数内部", ("修改启动", "调整构建", "配置环境")),
    },
}
SECTION_ORDER = {
    "zh": ("范围", "规则", "模板", "反模式", "证据", "缺口"),
    "en": ("Scope", "Rules", "Templates", "Anti-patterns", "Evidence", "Gaps"),
}
TAGS = {
    "zh": "[个人偏好] [项目特定] [必须] [推荐] [可选] [待验证]",
    "en": "[Personal Preference] [Project-Specific] [Must] [Recommended] [Optional] [To Verify]",
}
PRIOR_HEAD = "## Layers Already Written\nRefer to them, do not repeat them."
NO_SAMPLES = "## Layer-Relevant Code Evidence\nNo additional layer-specific source snippets were selected."


def layer_brief(layer: str, language: str) -> str:
    """What is asked for one layer: header, scope, sections, tags, topics, template."""
    topics, template, hint = LAYER_SPECS[language][layer]
    owns, excludes, uses = LAYER_META[language][layer]
    return "\n".join(
        [
            f"Write {layer} only, under the header `## {layer} · {LAYER_TITLES[language][layer]}`.",
            f"- Owns: {owns}",
            f"- Does not own: {excludes}",
            f"- Used for: {', '.join(uses)}",
            "Sections, in this order: " + ", ".join(SECTION_ORDER[language]),
            "Tags: " + TAGS[language],
            "Topics: " + ", ".join(topics),
            f"Template: {template} {hint}",
            "Cite real file paths; put unverified ideas under the last section only.",
        ]
    )


def sample_blocks(samples: DataFrame) -> DataFrame:
    """(project, layer, samples): the chosen files of a layer as fenced blocks.

    A layer holds at most a dozen files within its character budget.
    """
    block = F.concat(F.lit("### "), "path", F.lit("\n```\n"), "content", F.lit("\n```"))
    ordered = F.array_sort(F.collect_list(F.struct("position", block.alias("b"))))
    return samples.groupBy("project", "layer").agg(
        F.concat(
            F.lit("## Layer-Relevant Code Evidence\n\n"),
            F.array_join(F.transform(ordered, lambda x: x["b"]), "\n\n"),
        ).alias("samples")
    )


def update_policy(stale: DataFrame) -> DataFrame:
    """(project, policy): what became of the previous rules.

    ``stale`` is (project, layer, text, stale); only the first twenty stale rules
    are quoted, chosen before anything is collected.
    """
    from habitus.operators.skew import top_k

    totals = stale.groupBy("project").agg(
        F.count_if("stale").alias("n_stale"), F.count_if(~F.col("stale")).alias("n_active")
    )
    shown = top_k(
        stale.filter("stale"), ["project"], [F.asc("layer"), F.asc("text")], STALE_SHOWN,
        unique=["text"], rank="r",
    )
    line = F.concat(F.lit("\n- STALE "), "layer", F.lit(": "), "text")
    quoted = shown.groupBy("project").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("l")))), lambda x: x["l"]), ""
        ).alias("quoted")
    )
    return totals.join(quoted, "project", "left").select(
        "project",
        F.concat(
            F.lit("## Update Trace Policy\n- Rules still supported by files: "), F.col("n_active").cast("string"),
            F.lit("\n- Rules whose cited files disappeared: "), F.col("n_stale").cast("string"),
            F.coalesce("quoted", F.lit("")),
        ).alias("policy"),
    )


def prior_layers(written: DataFrame) -> DataFrame:
    """(project, layer, prior): for every layer, the key points of the layers before it.

    ``written`` is (project, layer, content), at most one document a layer.  Key
    points are a few headings, and a project has eight layers: what is gathered
    per project is bounded, and no document leaves its row.
    """
    points = written.select("project", "layer", docs.key_points(F.col("content")).alias("points"))
    entries = points.groupBy("project").agg(
        F.array_sort(F.collect_list(F.struct("layer", "points"))).alias("entries")
    )
    layers = F.array(*(F.lit(layer) for layer in LAYERS))
    before = F.filter("entries", lambda e: e["layer"] < F.col("layer"))
    lines = F.transform(
        before,
        lambda e, i: F.concat(F.lit("Layer "), (i + 1).cast("string"), F.lit(", written:\n"), e["points"]),
    )
    return (
        entries.select("project", "entries", F.explode(layers).alias("layer"))
        .filter(F.size(before) > 0)
        .select(
            "project", "layer",
            F.concat(F.lit(PRIOR_HEAD), F.lit("\n"), F.array_join(lines, "\n")).alias("prior"),
        )
    )


def layer_prompts(
    samples: DataFrame,
    evidence_prompts: DataFrame,
    previous: DataFrame | None = None,
    policy: DataFrame | None = None,
    language: str = "zh",
    written: DataFrame | None = None,
) -> DataFrame:
    """(project, layer, prompt) for all eight layers of every project.

    ``previous`` is (project, layer, content) of the last learning; a layer sees
    its own previous document only, cut in the middle.  ``written`` is the same of
    this learning; a layer sees the key points of the layers before it.  ``policy``
    is (project, policy), see ``update_policy``.
    """
    briefs = F.array(
        *[F.struct(F.lit(l).alias("layer"), F.lit(layer_brief(l, language)).alias("brief")) for l in LAYERS]
    )
    rows = evidence_prompts.select(
        "project", F.col("prompt").alias("evidence"), F.inline(briefs)
    ).join(sample_blocks(samples), ["project", "layer"], "left")
    existing: Column = F.lit(None).cast("string")
    if previous is not None:
        rows = rows.join(
            previous.select(
                "project", "layer",
                truncate_middle(F.col("content"), F.lit(EXISTING_LIMIT)).alias("existing"),
            ),
            ["project", "layer"],
            "left",
        )
        existing = F.when(
            F.col("existing").isNotNull(),
            F.concat(F.lit("## Existing "), "layer", F.lit("\n```markdown\n"), "existing", F.lit("\n```")),
        )
    prior: Column = F.lit(None).cast("string")
    if written is not None:
        rows = rows.join(prior_layers(written), ["project", "layer"], "left")
        prior = F.col("prior")
    note: Column = F.lit(None).cast("string")
    if policy is not None:
        rows = rows.join(policy, "project", "left")
        note = F.col("policy")
    return rows.select(
        "project",
        "layer",
        F.concat_ws(
            "\n\n", "brief", prior, "evidence", note, existing, F.coalesce("samples", F.lit(NO_SAMPLES))
        ).alias("prompt"),
    )


def type_overview(files_summary: DataFrame, project_types: DataFrame) -> DataFrame:
    """(project, title, file_count): header of a type's index page."""
    from habitus.functions.languages import display_name

    return files_summary.join(project_types, "project", "left").select(
        "project",
        F.concat(
            F.coalesce("project_type", F.lit("unknown")),
            F.lit(" · "),
            F.array_join(F.transform("languages", display_name), " · "),
        ).alias("title"),
        "file_count",
    )
