"""Markdown documents as columns: layers, sections, blocks, templates, counts.

A document is one row and stays one row until it is exploded: text is cut by
regular expressions at line starts (sections at headings, groups at
sub-headings, blocks at list items), which takes one linear pass in the JVM and
no shuffle.  Fenced code is folded first, so that a line start inside a fence
is no line start for the cutting patterns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from habitus.functions import patterns as rx
from habitus.functions.paths import LAYERS
from habitus.functions.patterns import let

# Section names and their headings, in order of preference.
SECTION_ALIASES = {
    "Scope": ("Scope", "范围", "边界"),
    "Rules": ("Rules", "规则", "约定", "Conventions"),
    "Templates": ("Templates", "Template", "模板"),
    "Anti-patterns": ("Anti-patterns", "Anti-pattern", "反模式"),
    "Evidence": ("Evidence", "证据"),
    "Gaps": ("Gaps", "缺口", "待验证", "To Verify"),
}
LAYER_NAMES = {
    "L1": "项目骨架",
    "L2": "模块与接口",
    "L3": "命名与类型",
    "L4": "实现模式",
    "L5": "数据与状态",
    "L6": "质量保障",
    "L7": "横切关注点",
    "L8": "工程化与启动",
}
LAYER_SPLITS = (
    r"\n(?=## L\d+[ ·：:]\s*.+)",
    r"\n(?=### L\d+[ ·：:]\s*.+)",
    r"\n(?=## L\d+[\s\n])",
    r"\n(?=### L\d+[\s\n])",
)
LAYER_HEADERS = (
    r"^#{2,3}\s*(L\d+)\s*[·：:\s]+\s*(.+?)(?:\s*$|\n)",
    r"^#{2,3}\s*(L\d+)\s*$",
)
KNOWN_TAG = r"\[(?:个人偏好|项目特定|必须|推荐|可选)\]"
EVIDENCE_LEAD = r"(?:\*\*)?(?:证据|Evidence)(?:\*\*)?[：:]"
TEMPLATE_TITLE = r"^(?:Templates?|模板|Template)(?:[：:]\s*(.*?))?$"
NO_PATTERN = r"无现有模式|No existing pattern"
PENDING_TEMPLATE = (
    r"待验证|To Verify|suggest|recommend|建议|建议引入|建议采用|推荐使用|可考虑|可能|maybe"
    r"|无现有模式|No existing pattern|example\.com|Vitest|Jest|Cypress|Playwright|Sentry"
)
CONVENTION_HEADING = (
    r"###\s+(?:约定|规范|规则|模式|组织|设计|使用|命名|管理|策略|工具|启动|配置|环境"
    r"|Convention|Conventions|Rules|Pattern|Patterns|Organization|Design|Usage|Naming"
    r"|Management|Strategy|Tooling|Bootstrap|Configuration|Environment)"
)
DECISION_SECTION = (
    r"##\s+(?:决策启发式|Decision Heuristics)\s*\n([\s\S]*?)(?=\n## |\n---\n|$)"
)
SUGGESTION_WORDS = r"\[待验证\]|建议|推荐|可考虑|引入|添加|配置|迁移|抽取|补充|统一|清理"
SPECULATIVE_WORDS = r"\[待验证\]|建议|推荐使用|推测|可能|未发现|未展示"
TOPICS_KEPT = 10
KEY_POINTS_KEPT = 8

_S = f"[{rx.INLINE_SPACE_CLASS}]"
# One line break inside folded code; a noncharacter, so text does not hold it.
FOLD = "\uFDD0"
_FENCE_START = rf"(?md)^(?={_S}*```)"
_SECTION_START = rf"(?md)^(?=###?{_S}+|---{_S}*$)"
_SECTION_HEAD = rf"^###{_S}+([^\n]*[^{rx.SPACE_CLASS}])[^\n]*"
_ITEM = rf"{_S}?(?:[-*]|\d+\.){_S}"
_STOP = rf"{_S}*(?:###{_S}+[^{rx.SPACE_CLASS}]|---{_S}*$)"
_GROUP = (
    rf"{_S}*(?!#{{1,3}}{_S})(?!(?i:{EVIDENCE_LEAD}))"
    rf"(?:(?:{KNOWN_TAG}{_S}*)+$|####{_S}+[^{rx.SPACE_CLASS}]|\*\*.+\*\*)"
)
_CANDIDATE = rf"{_S}*(?:####{_S}+[^{rx.SPACE_CLASS}].*|\*\*.+?\*\*{_S}*)$"


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def fold_fences(text: Column) -> Column:
    """The text with every fenced code block on one line.

    Pieces cut before fence lines alternate between outside and inside, whatever
    the number of fences; inside pieces lose their line breaks.
    """
    pieces = F.split(F.concat(F.lit("\n"), text), _FENCE_START)
    folded = F.transform(
        pieces,
        lambda piece, i: F.when(i % 2 == 1, F.replace(piece, F.lit("\n"), F.lit(FOLD))).otherwise(piece),
    )
    return F.substr(F.array_join(folded, ""), F.lit(2))


def unfold(text: Column) -> Column:
    return F.replace(text, F.lit(FOLD), F.lit("\n"))


# ------------------------------------------------------------------ layers


def layer_id(content: Column) -> Column:
    """Layer a document declares in its level-2 heading, else null."""
    return rx.extract(content, r"^##\s+(L[1-8])\b", 1, "m")


def layer_title(content: Column) -> Column:
    return rx.trim(rx.extract(content, r"^##\s+(.+)$", 1, "m"))


def trim_layer_tail(section: Column) -> Column:
    """Drop everything from the first foreign level-2 heading on, fences aside."""
    body = F.replace(rx.trim(section), F.lit("\r\n"), F.lit("\n"))

    def cut(parts: Column) -> Column:
        head = rx.trim_end(F.get(parts, F.lit(0)))
        shorter = F.regexp_replace(head, rf"(?:^|\n){_S}*---\z", "")
        return F.when(F.size(parts) > 1, shorter).otherwise(head)

    foreign = rx.java(r"\n(?=##\s+(?!L[1-8]\b))", inline=True)
    return rx.trim(unfold(let(F.split(fold_fences(body), foreign, 2), cut)))


def split_layers(content: Column) -> Column:
    """array<struct<layer, file_stem, content>> of a document that holds all layers."""
    tries = [F.split(content, rx.java(p)) for p in LAYER_SPLITS]
    pieces = F.coalesce(
        *[F.when(F.size(t) >= len(LAYERS), t) for t in tries], F.array(content)
    )
    names = F.create_map(*[F.lit(x) for pair in LAYER_NAMES.items() for x in pair])

    def describe(piece: Column) -> Column:
        layer = F.coalesce(*[rx.extract(piece, p, 1, "m") for p in LAYER_HEADERS])
        title = F.coalesce(
            F.nullif(rx.trim(rx.extract(piece, LAYER_HEADERS[0], 2, "m")), F.lit("")),
            F.lit("unknown"),
        )
        stem = F.concat(layer, F.lit("-"), F.coalesce(F.try_element_at(names, layer), title))
        return F.struct(layer.alias("layer"), stem.alias("file_stem"), piece.alias("content"))

    described = F.filter(
        F.transform(F.transform(pieces, trim_layer_tail), describe),
        lambda x: x["layer"].isNotNull(),
    )

    def last_of_each(found: Column) -> Column:
        stems = F.transform(found, lambda x: x["file_stem"])
        return F.filter(
            found,
            lambda x, i: ~F.array_contains(
                F.slice(stems, i + 2, F.size(stems)), x["file_stem"]
            ),
        )

    return let(described, last_of_each)


def missing_layers(stems: Column) -> Column:
    """Layer ids no file stem starts with."""
    layers = F.array(*[F.lit(l) for l in LAYERS])
    return let(
        stems,
        lambda found: F.filter(layers, lambda l: ~F.exists(found, lambda s: F.startswith(s, l))),
    )


# ---------------------------------------------------------------- sections


def sections(content: Column) -> Column:
    """array<struct<title, body>>: level-3 sections in order.

    A section ends at the next level-2 or level-3 heading or rule line; fences
    do not count here.
    """
    pieces = F.split(F.concat(F.lit("\n"), content), _SECTION_START)
    heads = F.filter(pieces, lambda p: p.rlike(_SECTION_HEAD))
    return F.transform(
        heads,
        lambda p: F.struct(
            F.regexp_extract(p, _SECTION_HEAD, 1).alias("title"),
            F.regexp_replace(p, r"^[^\n]*\n?", "").alias("body"),
        ),
    )


def plain_title(title: Column) -> Column:
    """Lower-cased title up to a colon."""
    return F.lower(rx.trim(F.regexp_replace(title, r"(?s)[：:].*\z", "")))


def _lookup(name: Column) -> Column:
    pairs = {a.lower(): s for s, aliases in SECTION_ALIASES.items() for a in aliases}
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.try_element_at(table, name)


def section_name(title: Column, loose: bool = False) -> Column:
    """Canonical section a title names exactly, else null (D3).

    ``loose`` also accepts a leading warning sign and dashes for spaces, as the
    overview reports do.
    """
    if not loose:
        return _lookup(plain_title(title))
    bare = plain_title(F.regexp_replace(title, rf"^⚠️{_S}*", ""))
    spaced = F.regexp_replace(bare, rf"[-{rx.SPACE_CLASS}]+", " ")
    return F.coalesce(_lookup(bare), _lookup(spaced))


def _titled(alias: str) -> str:
    return rf"(?i)^{alias}(?:[ \t]|[：:]|\z)"


def has_section(found: Column, name: str) -> Column:
    """Some section's title starts with an alias of ``name``."""
    joined = "|".join(SECTION_ALIASES[name])
    return F.exists(found, lambda s: s["title"].rlike(_titled(f"(?:{joined})")))


def titled_body(found: Column, alias: str) -> Column:
    """Body of the first section whose title starts with ``alias``, else null."""
    return F.get(F.filter(found, lambda s: s["title"].rlike(_titled(alias))), F.lit(0))["body"]


def first_section_body(found: Column, name: str) -> Column:
    """Body of the first section of the first alias that has one, else null."""
    return F.coalesce(*[titled_body(found, alias) for alias in SECTION_ALIASES[name]])


def bullets(body: Column) -> Column:
    trimmed = F.transform(lines(body), rx.trim)
    return F.filter(trimmed, lambda l: l.rlike(rf"^[-*]{_S}+"))


def section_bullets(found: Column, name: str) -> Column:
    """Bullet lines of a section; Scope falls back to its prose on one line."""

    def read(body: Column) -> Column:
        found_bullets = bullets(body)
        if name != "Scope":
            return found_bullets
        prose = F.filter(
            F.transform(lines(body), rx.trim),
            lambda l: (l != "") & ~F.startswith(l, F.lit("```")),
        )
        joined = rx.trim(rx.squeeze(F.array_join(prose, " ")))
        fallback = F.when(joined != "", F.array(joined)).otherwise(
            F.array().cast("array<string>")
        )
        return F.when(F.size(found_bullets) > 0, found_bullets).otherwise(fallback)

    return F.coalesce(
        let(first_section_body(found, name), read), F.array().cast("array<string>")
    )


def topics(content: Column, kept: int = TOPICS_KEPT) -> Column:
    found = rx.extract_all(content, r"^###\s+(.+)$", 1, "m")
    return F.slice(F.transform(found, rx.trim), 1, kept)


def key_points(content: Column) -> Column:
    """First level-2 and level-3 headings, one per line."""
    found = rx.extract_all(content, r"^#{2,3}\s+.+", 0, "m")
    return F.when(F.size(found) == 0, "(no headers)").otherwise(
        F.array_join(F.slice(found, 1, KEY_POINTS_KEPT), "\n")
    )


# ------------------------------------------------------------- rule blocks


def rule_groups(body: Column, fallback_title: Column) -> Column:
    """array<struct<heading, text>>: stretches of a body under one group heading.

    Heading lines are known-tag lines, level-4 headings and bold leads outside
    fences; the stretch before the first one belongs to ``fallback_title``.
    """
    pieces = F.split(F.concat(F.lit("\n"), fold_fences(body)), rf"(?md)^(?={_GROUP})")
    return F.transform(
        pieces,
        lambda p, i: F.struct(
            F.when(i == 0, fallback_title)
            .otherwise(F.regexp_replace(rx.trim(F.regexp_extract(p, r"^[^\n]*", 0)), rf"^####{_S}+", ""))
            .alias("heading"),
            F.when(i == 0, p).otherwise(F.regexp_replace(p, r"^[^\n]*\n?", "")).alias("text"),
        ),
    )


def list_blocks(text: Column) -> Column:
    """Top-level list items of a stretch with the lines that belong to them."""
    pieces = F.split(F.concat(F.lit("\n"), text), rf"(?md)^(?={_ITEM}|{_STOP})")
    return F.transform(
        F.filter(pieces, lambda p: p.rlike(rf"^{_ITEM}")), lambda p: lines(unfold(p))
    )


# --------------------------------------------------------------- templates


def template_name(name: Column) -> Column:
    bare = F.regexp_replace(name, rf"^#+{_S}+", "")
    bare = F.regexp_replace(bare, r"^\*\*(.+)\*\*\z", "$1")
    bare = rx.trim(F.regexp_replace(bare, r"^\[(.+)\]\z", "$1"))
    return F.when(bare != "", bare).otherwise("Template")


def missing_only(body: Column) -> Column:
    """The body says there is no pattern, and nothing else."""
    meaningful = F.filter(
        F.transform(lines(body), rx.trim),
        lambda l: (l != "")
        & ~l.rlike(rf"^#{{1,6}}{_S}+")
        & ~F.regexp_replace(l, rf"^[⚠️{rx.SPACE_CLASS}]+", "").rlike(rf"(?i)^(?:{NO_PATTERN})"),
    )
    return (
        body.rlike(f"(?i){NO_PATTERN}")
        & ~F.contains(body, F.lit("```"))
        & (F.size(meaningful) == 0)
    )


def candidates(body: Column) -> Column:
    """array<struct<heading, text, body>>: named template candidates in a body."""
    pieces = F.split(F.concat(F.lit("\n"), body), rf"(?md)^(?={_CANDIDATE})")
    named = F.filter(pieces, lambda p: p.rlike(rf"(?md)\A{_CANDIDATE}"))

    def describe(piece: Column) -> Column:
        first = rx.trim(F.regexp_extract(piece, r"^[^\n]*", 0))
        heading = F.when(
            F.startswith(first, F.lit("#")), F.regexp_replace(first, rf"^####{_S}+", "")
        ).otherwise(F.regexp_extract(first, rf"^\*\*(.+?)\*\*{_S}*\z", 1))
        return F.struct(
            heading.alias("heading"),
            piece.alias("text"),
            F.regexp_replace(piece, r"^[^\n]*\n?", "").alias("body"),
        )

    return F.transform(named, describe)


def _first_prose(body: Column) -> Column:
    kept = F.filter(
        F.transform(lines(body), rx.trim),
        lambda l: (l != "")
        & ~F.startswith(l, F.lit("```"))
        & ~l.rlike(rf"^[-*]{_S}+")
        & ~l.rlike(r"^`[^`]+`[：:]"),
    )
    return F.coalesce(F.get(kept, F.lit(0)), F.lit("Template"))


def templates(found: Column) -> Column:
    """array<struct<name, body>>: the representative template of each section."""

    def pick(section: Column) -> Column:
        heading = rx.trim(F.regexp_extract(section["title"], rx.java(TEMPLATE_TITLE, "i"), 1))
        body = section["body"]

        def among(named: Column) -> Column:
            active = F.filter(named, lambda c: ~missing_only(c["body"]))
            best = F.coalesce(F.get(active, F.lit(0)), F.get(named, F.lit(0)))
            return F.when(
                best.isNotNull(),
                F.struct(template_name(best["heading"]).alias("name"), best["body"].alias("body")),
            ).otherwise(
                F.struct(template_name(_first_prose(body)).alias("name"), body.alias("body"))
            )

        return F.when(
            heading != "",
            F.struct(template_name(heading).alias("name"), body.alias("body")),
        ).otherwise(let(candidates(body), among))

    titled = F.filter(found, lambda s: rx.test(s["title"], TEMPLATE_TITLE, "i"))
    return F.transform(titled, pick)


def template_status(name: Column, body: Column) -> Column:
    return (
        F.when(name.rlike(f"(?i){NO_PATTERN}"), "missing")
        .when(missing_only(body), "missing")
        .when(body.rlike(f"(?i){PENDING_TEMPLATE}"), "pending")
        .otherwise("active")
    )


# --------------------------------------------------------- checks and counts


def truncation(content: Column) -> Column:
    """Why a layer looks cut off, null when it does not."""
    tail = rx.trim(F.element_at(lines(rx.trim_end(content)), -1))
    odd_fences = F.regexp_count(content, F.lit("```")) % 2 == 1
    odd_ticks = F.regexp_count(tail, F.lit("`")) % 2 == 1
    return F.when(odd_fences, "unclosed code fence").when(
        odd_ticks, F.concat(F.lit('dangling inline code "'), F.left(tail, F.lit(80)), F.lit('"'))
    )


def looks_cut_off(content: Column) -> Column:
    """Stricter form: fences at line starts, or a last line that cannot be an end."""
    odd = F.regexp_count(content, F.lit("(?md)^```")) % 2 == 1
    end = rx.trim_end(F.regexp_replace(rx.trim_end(content), rf"\n---{_S}*\z", ""))
    return odd | end.rlike(r"(?:\.\.\.|\[…\]|[,，:：;；]|-)\z")


def structure_issue(content: Column) -> Column:
    """Structural complaint about a layer document, null when there is none."""
    convention = rx.test(content, CONVENTION_HEADING, "i")
    template = rx.test(content, r"^###\s+(?:模板|Templates?|Template)(?:\s|[：:]|$)", "im")
    anti = rx.test(content, r"###\s+Anti-?patterns?", "i") | rx.test(content, r"###\s+反模式")
    return F.when(~convention & ~template & ~anti, "structure").when(
        ~template & ~content.rlike(f"(?i){NO_PATTERN}"), "template"
    )


def heading_matches(content: Column, label: str) -> Column:
    """A level-3 heading equals, contains or is contained in ``label``, loosely."""
    wanted = " ".join(label.lower().replace(":", "").replace("：", "").split())
    heads = F.transform(
        rx.extract_all(content, r"^###\s+(.+)$", 1, "m"),
        lambda h: rx.trim(rx.squeeze(F.regexp_replace(F.lower(h), "[：:]", ""))),
    )
    return F.exists(heads, lambda h: F.contains(h, F.lit(wanted)) | F.contains(F.lit(wanted), h))


def decision_table(content: Column) -> Column:
    """The decision section when it has a data row, else '' (D15)."""
    pattern = rx.java(DECISION_SECTION)

    def keep(text: Column) -> Column:
        rows = F.filter(
            F.transform(lines(text), rx.trim),
            lambda l: F.startswith(l, F.lit("|"))
            & ~l.rlike(rf"^\|{_S}*-+")
            & ~l.rlike("(?i)场景|Scenario"),
        )
        return F.when(F.size(rows) > 0, rx.trim(text)).otherwise("")

    return let(F.regexp_extract(content, pattern, 0), keep)


def gap_counts(found: Column) -> Column:
    """struct<observed, suggested>: gap bullets by sub-heading or wording."""
    gaps = F.filter(found, lambda s: section_name(s["title"], loose=True) == "Gaps")

    def stretches(section: Column) -> Column:
        return F.split(
            F.concat(F.lit("\n"), section["body"]), rf"(?md)^(?={_S}*####{_S}+[^{rx.SPACE_CLASS}])"
        )

    def count(piece: Column) -> Column:
        head = rx.trim(F.regexp_extract(piece, r"^[^\n]*", 0))
        sub = F.when(F.startswith(head, F.lit("####")), head)
        kept = F.filter(
            F.transform(lines(piece), rx.trim),
            lambda l: F.startswith(l, F.lit("-")) & ~l.rlike(rf"^-+{_S}*(?:无|None|N/A)[。.]?\z"),
        )
        suggesting = F.size(F.filter(kept, lambda l: l.rlike(SUGGESTION_WORDS)))
        total = F.size(kept)
        by_head = F.when(sub.rlike("(?i)已观察|Observed|Risk"), 0).when(
            sub.rlike("(?i)建议|改进|Suggested|Improvement"), total
        )
        suggested = F.coalesce(by_head, suggesting)
        return F.struct((total - suggested).alias("observed"), suggested.alias("suggested"))

    counted = F.transform(F.flatten(F.transform(gaps, stretches)), count)
    total = lambda name: F.aggregate(
        counted, F.lit(0), lambda acc, c: acc + c[name]
    )
    return F.struct(total("observed").alias("observed"), total("suggested").alias("suggested"))


def speculative_residuals(content: Column) -> Column:
    """Lines with a speculative word outside gap sections and fences."""
    pieces = F.split(F.concat(F.lit("\n"), content), _SECTION_START)
    outside = F.filter(
        pieces,
        lambda p: ~(
            p.rlike(_SECTION_HEAD)
            & F.coalesce(
                section_name(F.regexp_extract(p, _SECTION_HEAD, 1), loose=True) == "Gaps",
                F.lit(False),
            )
        ),
    )
    text = F.regexp_replace(F.array_join(outside, ""), rf"(?md)^```(?s:.)*?^```{_S}*$", "")
    found = F.filter(
        lines(text),
        lambda l: l.rlike(SPECULATIVE_WORDS)
        & ~l.rlike(rf"^{_S}*#")
        & ~F.contains(l, F.lit("无现有模式"))
        & ~l.rlike(rf"^{_S}*\|")
        & ~l.rlike(rf"^{_S}*[-*]{_S}*⚠️"),
    )
    return F.size(found)
