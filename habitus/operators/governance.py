"""Cleaning of generated layer documents before they are kept.

Each document is cleaned inside its row.  Speculative lines leave the body for
the gap section, unsafe templates are removed and noted there, required sections
are filled.  The one thing that needs other rows - whether a tool named in a
template occurs in the evidence - is a join with one short list per reference.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitus.functions import patterns as rx
from habitus.operators import documents as docs
from habitus.operators.documents import let
from habitus.operators.prompts import LAYER_META, LAYER_SPECS
from habitus.operators.trace import KEY

_S = f"[{rx.INLINE_SPACE_CLASS}]"
_INLINE_SPACES = rx.SPACE_CHARS.replace("\n", "")
# Wording tests.
META_LINE = (
    r"完整延续|延续部分|续写|继续添加|直接从断点|断点处继续|只输出剩余|勿重复已有内容|未重复标题|紧接之前"
    r"|previous response|truncated response|continuation|continue exactly"
    r"|return only the missing|close any open markdown code fence"
)
SPECULATION = (
    r"\[待验证\]|\[To Verify\]|建议|推荐使用|建议采用|推测(?!的)|推断(?!的)|推论|基于项目推论|可能(?!是)"
    r"|不代表现有|未展示|未发现|suggest|recommend|consider|might|maybe|not found|not shown"
    r"|unverified|to verify"
)
SUGGESTION = (
    r"\[待验证\]|\[To Verify\]|建议|推荐|可考虑|引入|添加|配置|迁移|抽取|补充|统一|清理|推断|推论|可能|未发现|未展示"
    r"|suggest|recommend|consider|add|introduce|configure|migrate|extract|clean|maybe|not found|not shown"
)
UNSAFE_CANDIDATE = (
    r"无现有模式|No existing pattern|待验证|To Verify|建议|推荐使用|建议引入|建议采用|可考虑|example\.com"
    r"|暂未实现|推测|可能|未发现|未展示|Vitest|Jest|Cypress|Playwright|Sentry|commitlint|husky|GitHub Actions"
)
UNSAFE_BODY = (
    r"\[待验证\]|\[To Verify\]|待验证|暂未实现|建议|推荐使用|可考虑|建议骨架|推测|可能|未发现|未展示|suggest"
    r"|recommend|consider|might|maybe|not found|not shown|unverified|to verify"
)
TOOLS = (
    r"\b(?:Vitest|Jest|Cypress|Playwright|Sentry|SonarQube|JaCoCo|Checkstyle|SpotBugs|commitlint|husky"
    r"|GitHub Actions|vite-plugin-compression|vite-plugin-imagemin)\b"
)
GAP_HEADING = r"^###[ \t]+(?:缺口|待验证|To Verify|Unverified|⚠️\s*Gaps|Gaps)[ \t]*(?:\n|\z)"
# Default texts by output language.
DEFAULT_SCOPE = {
    "zh": {
        "L1": "项目地图、目录职责、入口与文件放置边界。",
        "L2": "模块契约、公开接口、依赖方向与拆分粒度。",
        "L3": "命名、类型形态、常量与领域词汇。",
        "L4": "函数形态、错误处理、异步流程与资源管理。",
        "L5": "状态管理、持久化、缓存与数据流。",
        "L6": "测试、Lint/格式化、文档注释与日志反馈。",
        "L7": "认证授权、安全、性能、配置等跨模块策略。",
        "L8": "包管理、构建工具、环境变量、应用启动、CI/CD 与部署入口。",
    },
    "en": {
        "L1": "Project map, directory responsibilities, entry points, and file placement boundaries.",
        "L2": "Module contracts, public interfaces, dependency direction, and split granularity.",
        "L3": "Naming, type shapes, constants, and domain vocabulary.",
        "L4": "Function shape, error handling, async flows, and resource management.",
        "L5": "State management, persistence, caching, and data flow.",
        "L6": "Tests, lint/formatting, documentation comments, and logging feedback.",
        "L7": "Authentication, authorization, security, performance, configuration, and other cross-module policies.",
        "L8": "Package management, build tooling, environment variables, application bootstrap, CI/CD, and deployment entry points.",
    },
}
TEXTS = {
    "zh": {
        "scope": "范围", "gaps": "缺口", "observed": "已观察风险", "suggested": "建议改进",
        "none": "- 无。", "pending": "[待验证]", "no_pattern": "无现有模式",
        "template": "### 模板：无现有模式\n⚠️ 无现有模式。当前代码中未提取到可复用模板。\n",
        "anti": "### 反模式\n- ⚠️ 无现有模式。\n",
        "evidence": "- 详见 EVIDENCE.md 与 TRACE.json 中的确定性证据。", "stop": "。",
        "removed": ("模板「", "」包含建议性或未验证内容，已从模板区移入缺口。"),
    },
    "en": {
        "scope": "Scope", "gaps": "Gaps", "observed": "Observed Risks", "suggested": "Suggested Improvements",
        "none": "- None.", "pending": "[To Verify]", "no_pattern": "No existing pattern",
        "template": "### Template: No existing pattern\n⚠️ No existing pattern. No reusable template was extracted from the current code.\n",
        "anti": "### Anti-patterns\n- ⚠️ No existing pattern.\n",
        "evidence": "- See EVIDENCE.md and TRACE.json for deterministic evidence.", "stop": ".",
        "removed": ('Template "', '" was removed because it is a suggested or unverified pattern.'),
    },
}
DOWNGRADED = ("模板「", "」包含建议性或未验证内容，已降级为\"无现有模式\"。")
UNCONFIRMED = ("模板「", "」引用了未确认工具 ", "，已降级为\"无现有模式\"。")


def _in_any_case(line: Column, test: Callable[[Column, Column], Column]) -> Column:
    """``test`` of the line and its lower-case form, each evaluated once."""
    return let(line, lambda l: let(F.lower(l), lambda low: test(l, low)))


def is_meta_line(line: Column) -> Column:
    return _in_any_case(line, lambda l, low: rx.worded(l, low, META_LINE))


def is_speculative(line: Column) -> Column:
    """A line that belongs to the gaps."""
    return _in_any_case(
        line,
        lambda l, low: (rx.worded(l, low, SPECULATION) & ~rx.worded(l, low, docs.NO_PATTERN))
        | rx.worded(l, low, META_LINE),
    )


def is_suggestion(line: Column) -> Column:
    """A gap line that proposes something."""
    return _in_any_case(line, lambda l, low: rx.worded(l, low, SUGGESTION))


def parted(lines: Column, test: Callable[[Column], Column]) -> Column:
    """struct<yes, no>: lines that meet ``test`` and the others; each is tested once."""
    tested = F.transform(lines, lambda l: F.struct(l.alias("line"), test(l).alias("met")))

    def part(found: Column) -> Column:
        side = lambda met: F.transform(F.filter(found, met), lambda x: x["line"])
        return F.struct(side(lambda x: x["met"]).alias("yes"), side(lambda x: ~x["met"]).alias("no"))

    return let(tested, part)


def partition_speculative(content: Column) -> Column:
    """struct<kept, gaps>: body and the lines that leave it.

    Fences are folded first, so a code block is one line that always stays.
    """

    def fixed(line: Column) -> Column:
        return (
            F.startswith(line, F.lit("#"))
            | F.startswith(line, F.lit("|"))
            | F.startswith(F.ltrim(line, F.lit(_INLINE_SPACES)), F.lit("```"))
        )

    def part(found: Column) -> Column:
        return F.struct(
            docs.unfold(F.array_join(found["no"], "\n")).alias("kept"), found["yes"].alias("gaps")
        )

    moves = lambda l: ~fixed(l) & is_speculative(rx.trim(l))
    return let(parted(docs.lines(docs.fold_fences(content)), moves), part)


def extract_gap_sections(content: Column) -> Column:
    """struct<kept, gaps>: the document without its gap sections, and their lines."""
    pieces = F.split(F.concat(F.lit("\n"), content), docs._SECTION_START)

    def part(all_: Column) -> Column:
        is_gap = lambda p: F.startswith(p, F.lit("###")) & p.rlike(rf"(?i){GAP_HEADING}")
        found = F.flatten(
            F.transform(
                F.filter(all_, is_gap),
                lambda p: F.filter(
                    F.transform(docs.lines(F.regexp_replace(p, r"^[^\n]*\n?", "")), rx.trim),
                    lambda l: (l != "")
                    & ~l.rlike(rf"^####{_S}+")
                    & ~l.rlike(r"^---+\z")
                    & ~l.rlike(rf"(?i)^-+{_S}*(?:无|None|N/A)[。.]?\z"),
                ),
            )
        )
        rest = F.transform(
            all_,
            lambda p: F.when(~is_gap(p), p).when(F.endswith(p, F.lit("\n")), "\n").otherwise(""),
        )
        kept = F.substr(F.array_join(rest, ""), F.lit(2))
        rule = ("\n---",)
        kept = rx.replace_where(kept, rule, r"\n---\s*\n\s*(?=###\s*(?:反模式|Anti-?patterns?|证据|Evidence))", "\n", "i")
        kept = rx.replace_where(kept, rule, r"\n{2,}---\s*\n{2,}(?=---\s*\n)", "\n\n")
        kept = rx.replace_where(kept, ("\n\n\n",), r"\n{3,}", "\n\n")
        return F.struct(kept.alias("kept"), found.alias("gaps"))

    return let(pieces, part)


def dedupe_gap_lines(lines: Column) -> Column:
    """First position, last value per line with squeezed white space."""

    def dedupe(found: Column) -> Column:
        keys = F.transform(found, rx.squeeze)
        firsts = F.filter(
            F.sequence(F.lit(1), F.size(found)),
            lambda i: F.array_position(keys, F.element_at(keys, i)) == i,
        )
        last = lambda key: F.element_at(
            F.filter(found, lambda l: rx.squeeze(l) == key), -1
        )
        return F.when(F.size(found) == 0, found).otherwise(
            F.transform(firsts, lambda i: last(F.element_at(keys, i.cast("int"))))
        )

    return let(lines, dedupe)


def append_gaps(body: Column, lines: Column, language: str) -> Column:
    """The document with one structured gap section at its end."""
    text = TEXTS[language]

    def write(found: Column) -> Column:
        side = lambda found: F.when(F.size(found) == 0, F.lit(text["none"])).otherwise(
            F.array_join(dedupe_gap_lines(found), "\n")
        )
        return F.concat(
            rx.trim_end(body),
            F.lit(f"\n\n\n### {text['gaps']}\n\n#### {text['observed']}\n"),
            side(found["no"]),
            F.lit(f"\n\n#### {text['suggested']}\n"),
            side(found["yes"]),
        )

    trimmed = F.filter(F.transform(lines, rx.trim), lambda l: l != "")
    bulleted = F.transform(
        trimmed, lambda l: F.when(F.startswith(l, F.lit("-")), l).otherwise(F.concat(F.lit("- "), l))
    )
    return let(parted(bulleted, is_suggestion), write)


def sides_of(text: Column, hit: Column) -> tuple[Column, Column]:
    """What stands before and after ``hit``, a pattern's first match in ``text``.

    For matches that are no shorter wherever their text stands: then the first
    match is also the first place of its text.  No match is ''.
    """
    before = F.when(hit == "", text).otherwise(F.call_function("substring_index", text, hit, F.lit(1)))
    return before, F.substr(text, F.length(before) + F.length(hit) + 1)


def ensure_scope(content: Column, layer: Column, language: str) -> Column:
    """The document with a filled scope section."""
    defaults = F.create_map(*[F.lit(x) for pair in DEFAULT_SCOPE[language].items() for x in pair])
    fallback = F.try_element_at(defaults, layer)
    heading = F.lit(f"### {TEXTS[language]['scope']}\n")
    # white space after the heading is skipped first, so an empty section followed
    # by another one counts as filled, as specified
    pattern = (
        rf"(?s)(\n###{_S}+(?:范围|Scope)[{rx.SPACE_CLASS}]*\n)(.*?)(?=\n###|\n---|\n## |\z)"
    )
    line = F.substring_index(content, "\n", 1)
    head, rest = rx.trim_end(line), F.substr(content, F.length(line) + 1)

    def fill(hit: Column) -> Column:
        filled = rx.trim(F.regexp_extract(hit, f"(?i){pattern}", 2)) != ""
        before, after = sides_of(content, hit)
        return (
            F.when(hit == "", F.concat(head, F.lit("\n\n"), heading, fallback, F.lit("\n"), rest))
            .when(filled, content)
            .otherwise(F.concat(before, F.lit("\n"), heading, fallback, F.lit("\n"), after))
        )

    hit = F.regexp_extract(content, f"(?i){pattern}", 0)
    return F.when(layer.isNull(), content).otherwise(let(hit, fill))


def strip_unsafe_templates(body: Column) -> Column:
    """struct<kept, removed>: a template body without unsafe candidates, and their names."""
    pieces = F.split(F.concat(F.lit("\n"), body), rf"(?md)^(?={docs._CANDIDATE})")
    named = lambda p: p.rlike(rf"(?md)\A{docs._CANDIDATE}")
    unsafe = lambda p: named(p) & p.rlike(f"(?i){UNSAFE_CANDIDATE}")

    def heading(piece: Column) -> Column:
        first = rx.trim(F.regexp_extract(piece, r"^[^\n]*", 0))
        return rx.trim(
            F.when(F.startswith(first, F.lit("#")), F.regexp_replace(first, rf"^####{_S}+", ""))
            .otherwise(F.regexp_extract(first, rf"^\*\*(.+?)\*\*{_S}*\z", 1))
        )

    return let(
        pieces,
        lambda all_: F.struct(
            F.substr(F.array_join(F.filter(all_, lambda p: ~unsafe(p)), ""), F.lit(2)).alias("kept"),
            F.transform(F.filter(all_, unsafe), heading).alias("removed"),
        ),
    )


def confirm_tools(templates: DataFrame, evidence: DataFrame) -> DataFrame:
    """Rows of ``templates`` (keys, body) with the tools no evidence names.

    A tool is confirmed when a summary or a cited file of the reference's
    evidence contains its name, in any case.
    """
    named = evidence.groupBy(*KEY).agg(
        # at most one summary and a dozen files per rule of the rule set
        F.transform(
            F.flatten(F.collect_list(F.concat(F.array("summary"), "files"))), F.lower
        ).alias("__named")
    )
    tools = F.regexp_extract_all("body", F.lit(rx.java(TOOLS, "i")), F.lit(0))
    known = F.coalesce("__named", F.array().cast("array<string>"))
    return templates.join(named, list(KEY), "left").withColumn(
        "unconfirmed",
        F.filter(tools, lambda t: ~F.exists(known, lambda n: F.contains(n, F.lower(t)))),
    ).drop("__named")


# The first template section up to the next heading of level three or deeper.
_FIRST_TEMPLATE = (
    rf"(?is)(\n###{_S}+(?:模板|Templates?|Template)(?:[：:]([^\n]*?))?[{rx.SPACE_CLASS}]*\n)"
    r"(.*?)(?=\n###|\n---|\n## |\z)"
)


def govern(layer_docs: DataFrame, evidence: DataFrame, language: str = "zh") -> DataFrame:
    """Cleaned layer documents.

    ``layer_docs`` is (skill, project_type, layer, content), ``evidence`` the
    items of each reference.
    """
    text = TEXTS[language]
    col = F.col
    body = docs.trim_layer_tail(col("content"))
    plain = F.array_join(
        F.filter(docs.lines(body), lambda l: ~is_meta_line(rx.trim(l))), "\n"
    )
    rows = layer_docs.select(*KEY, "layer", plain.alias("doc"))
    rows = rows.select(*KEY, "layer", ensure_scope(col("doc"), col("layer"), language).alias("doc"))
    rows = rows.select(*KEY, "layer", extract_gap_sections(col("doc")).alias("g"))
    rows = rows.select(*KEY, "layer", col("g.gaps").alias("old_gaps"), partition_speculative(col("g.kept")).alias("p"))
    rows = rows.select(*KEY, "layer", "old_gaps", col("p.gaps").alias("moved"),
                       ensure_scope(col("p.kept"), col("layer"), language).alias("doc"))
    # the first template section, split into before, heading, body and after
    rows = rows.withColumn("hit", F.regexp_extract("doc", _FIRST_TEMPLATE, 0))
    head, inside = F.regexp_extract(col("hit"), _FIRST_TEMPLATE, 1), F.regexp_extract(col("hit"), _FIRST_TEMPLATE, 3)
    title = rx.trim(F.regexp_extract(col("hit"), _FIRST_TEMPLATE, 2))
    before, after = sides_of(col("doc"), col("hit"))
    rows = rows.select(
        *KEY, "layer", "old_gaps", "moved", "doc",
        before.alias("before"),
        after.alias("after"),
        head.alias("head"),
        F.when(title != "", title).otherwise("Template").alias("name"),
        strip_unsafe_templates(inside).alias("t"),
    ).withColumn("body", col("t.kept"))
    rows = confirm_tools(rows, evidence)
    start, end = text["removed"]
    removed = F.transform(
        "t.removed", lambda n: F.concat(F.lit(f"- {text['pending']} {start}"), n, F.lit(end))
    )
    absent = col("head") == ""
    single = col("head").rlike(rf"(?i)^\n###{_S}+(?:模板|Template)(?:[：:]|{_S}*\n)")
    titled = rx.test(col("doc"), r"^###\s+(?:模板|Templates?|Template)(?:\s|[：:]|$)", "im")
    no_pattern = col("name").rlike(f"(?i){docs.NO_PATTERN}") | col("body").rlike(f"(?i){docs.NO_PATTERN}")
    emptied = (F.size("t.removed") > 0) & (rx.trim(col("body")) == "")
    issue = F.when(absent | emptied | no_pattern | ~single, None).when(
        col("body").rlike(f"(?i){UNSAFE_BODY}"),
        F.concat(F.lit(DOWNGRADED[0]), "name", F.lit(DOWNGRADED[1])),
    ).when(
        F.size("unconfirmed") > 0,
        F.concat(F.lit(UNCONFIRMED[0]), "name", F.lit(UNCONFIRMED[1]), F.array_join("unconfirmed", ", "), F.lit(UNCONFIRMED[2])),
    )
    rows = rows.withColumn("removed", removed).withColumn("issue", issue)
    block = F.lit("\n" + text["template"])
    anti = rf"(?i)\n(?=###[ \t]+(?:反模式|Anti-?patterns?))"
    around = F.split(col("doc"), anti, 2)
    added = F.when(
        F.size(around) > 1,
        F.concat(rx.trim_end(F.get(around, F.lit(0))), F.lit("\n"), block, F.lit("\n"), F.get(around, F.lit(1))),
    ).otherwise(F.concat(rx.trim_end(col("doc")), block, F.lit("\n" + text["anti"])))
    replaced = F.concat("before", F.lit("\n\n" + text["template"].rstrip("\n") + "\n"), "after")
    kept = F.when(
        F.size("t.removed") > 0,
        F.concat("before", F.lit("\n"), rx.trim_end(F.concat("head", rx.trim_end(col("body")))), F.lit("\n"), "after"),
    ).otherwise(col("doc"))
    final = (
        F.when(absent & titled, col("doc"))
        .when(absent, added)
        .when(emptied | col("issue").isNotNull(), replaced)
        .otherwise(kept)
    )
    note = F.when(
        col("issue").isNotNull(), F.array(F.concat(F.lit(f"- {text['pending']} "), col("issue")))
    ).otherwise(F.array().cast("array<string>"))
    return rows.select(
        *KEY,
        "layer",
        append_gaps(final, F.concat("moved", "removed", note, "old_gaps"), language).alias("content"),
    )


# Labels of sections that are appended when absent.
SECTION_LABELS = {
    "zh": ("范围", "规则", "模板", "反模式", "证据", "缺口"),
    "en": ("Scope", "Rules", "Templates", "Anti-patterns", "Evidence", "Gaps"),
}


def fill_required_sections(
    layer_docs: DataFrame, language: str = "zh", template_names: dict[str, str] | None = None
) -> DataFrame:
    """Documents with every section heading present, stubs where absent."""
    text, content, layer = TEXTS[language], F.col("content"), F.col("layer")
    meta = LAYER_META[language]
    owns = ("Owns", "Does not own", "Task uses") if language == "en" else ("负责", "不负责", "任务入口")

    def of(pick) -> Column:
        return F.try_element_at(
            F.create_map(*[x for l, m in meta.items() for x in (F.lit(l), F.lit(pick(l, m)))]), layer
        )

    scope = of(
        lambda _, m: f"- {owns[0]}: {m[0]}\n- {owns[1]}: {m[1]}\n- {owns[2]}: {', '.join(m[2])}"
    )
    names = template_names or {l: s[1] for l, s in LAYER_SPECS[language].items()}
    template = of(lambda l, _: f"#### {names[l]}\n{text['no_pattern']}")
    stub = F.lit(f"- {text['no_pattern']}{text['stop']}")
    bodies = [scope, stub, template, stub, F.lit(text["evidence"]), F.lit(text["none"])]
    blocks = [
        F.when(
            ~docs.heading_matches(content, label),
            F.concat(F.lit(f"\n\n### {label}\n"), body),
        ).otherwise("")
        for label, body in zip(SECTION_LABELS[language], bodies)
    ]
    return layer_docs.withColumn("content", rx.trim(F.concat(rx.trim(content), *blocks)))
