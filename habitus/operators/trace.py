"""Rules and templates of layer documents, linked to the evidence behind them.

``layer_docs`` is (skill, project_type, layer, file_stem, content), one row per
layer of a reference.  Every document expands to its rules by generators alone;
only the short rule rows are shuffled afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from habitus.functions import patterns as rx
from habitus.operators import documents as docs
from habitus.operators.documents import let

KEY = ("skill", "project_type")

# Tags, evidence notes and wording tests.
ALL_TAGS = (
    r"\[(?:个人偏好|项目特定|必须|推荐|可选|Personal Preference|Project-Specific"
    r"|Must|Recommended|Optional)\]"
)
ZH_TAGS = r"\[(?:个人偏好|项目特定|必须|推荐|可选)\]"
SCOPE_TAG = r"\[?(?:个人偏好|项目特定|Personal Preference|Project-Specific)\]?"
CONFIDENCE_TAG = r"\[?(?:必须|推荐|可选|Must|Recommended|Optional)\]?"
PROJECT_TAG = "[项目特定]"
TAG_EQUIVALENTS = {
    "[项目特定]": ("[项目特定]", "[Project-Specific]"),
    "[个人偏好]": ("[个人偏好]", "[Personal Preference]"),
    "[必须]": ("[必须]", "[Must]"),
    "[推荐]": ("[推荐]", "[Recommended]"),
    "[可选]": ("[可选]", "[Optional]"),
}
STARRED_EVIDENCE = r"\*?\s*(?:证据|Evidence)[：:][^*]*\*?"
BRACKETED_EVIDENCE = r"[（(]\s*(?:证据|Evidence)[：:][^）)]*[）)]"
ABSENCE_WORDS = (
    r"未发现|未展示|未出现|未启用|未见|无显式|当前无|不存在|通过文件片段推断|早期分析|L8\s*中提及"
)
PENDING_RULE = r"待验证|To Verify|suggest|recommend|建议|考虑|maybe|可能"
BARE_TOPICS = ("安全", "性能", "配置管理", "CSS 类名", "Props 类型声明", "组件命名", "函数与变量命名")
FILE_REF = (
    r"(?:^|[\s(`])([A-Za-z0-9_.@/-]+\.(?:ts|tsx|js|jsx|vue|java|go|rs|py|rb|php|cs|json|yml"
    r"|yaml|toml|xml|md|sql|css|scss|html))(?:[:)`\s.,;]|$)"
)
# every ending of FILE_REF starts with one of these
FILE_ENDS = tuple(f".{e}" for e in "ts js vue java go rs py rb php cs yml yaml toml xml md sql scss html".split())
BORROWED_FILES = 5
MIN_RULE_LENGTH = 12
RULE_SECTIONS = ("Rules", "规则", "约定", "Conventions")


# ------------------------------------------------------------ text helpers


COLONS = ("：", ":")
LIST_STARTS = "-*0123456789"


def _no_texts() -> Column:
    return F.array().cast("array<string>")


def strip_strong(text: Column) -> Column:
    return rx.replace_where(text, ("**",), r"(^|[^/])\*\*", "$1")


def _without_notes(text: Column, bracketed: bool) -> Column:
    """Without evidence notes; each holds a colon and the word."""

    def clean(text: Column) -> Column:
        text = rx.replace_where(text, COLONS, STARRED_EVIDENCE, " ", "i")
        return rx.replace_where(text, ("(", "（"), BRACKETED_EVIDENCE, " ", "i") if bracketed else text

    named = lambda text: F.contains(text, F.lit("证据")) | F.contains(F.lower(text), F.lit("evidence"))
    colon = lambda text: rx.contains_any(text, [(c,) for c in COLONS])
    return let(text, lambda t: F.when(colon(t) & named(t), clean(t)).otherwise(t))


def normalize(text: Column) -> Column:
    return rx.trim(rx.squeeze(F.lower(text)))


def extract_tags(text: Column) -> Column:
    """Bracketed spans."""
    found = F.regexp_extract_all(text, F.lit(r"\[[^\]]+\]"), F.lit(0))
    return F.when(~F.contains(text, F.lit("[")), _no_texts()).otherwise(found)


def normalize_tags(tags: Column) -> Column:
    """Distinct tags; a confidence without a scope means project-specific."""

    def complete(unique: Column) -> Column:
        scoped = F.exists(unique, lambda t: t.rlike(f"(?i){SCOPE_TAG}"))
        rated = F.exists(unique, lambda t: t.rlike(f"(?i){CONFIDENCE_TAG}"))
        return F.when(
            ~scoped & rated, F.array_distinct(F.concat(F.array(F.lit(PROJECT_TAG)), unique))
        ).otherwise(unique)

    return let(F.array_distinct(tags), complete)


def has_tag(tags: Column, required: str) -> Column:
    accepted = [t.lower() for t in TAG_EQUIVALENTS.get(required, (required,))]
    return F.arrays_overlap(
        F.transform(tags, F.lower), F.array(*[F.lit(t) for t in accepted])
    )


def file_refs(text: Column) -> Column:
    """Distinct path-like tokens in order; the character after one is consumed."""
    found = F.array_distinct(rx.extract_all(text, FILE_REF, 1))
    return F.when(~rx.contains_any(text, [(e,) for e in FILE_ENDS]), _no_texts()).otherwise(found)


def _plain_brackets(text: Column) -> Column:
    return rx.replace_where(text, ("【", "】"), "[【】]", " ")


def _without_marker(text: Column) -> Column:
    return rx.replace_at(text, LIST_STARTS, r"^(?:[-*]|\d+\.)\s+", "")


# Marks without which the cleaning of a text only trims it, and first characters likewise.
MARKS = "*[#:"
FIRST_MARKS = LIST_STARTS.replace("*", "")


def clean_body(text: Column) -> Column:
    """Body text of a rule without marks, tags and evidence notes."""

    def clean(text: Column) -> Column:
        # white space beside a tag collapses with the space that replaces it
        text = rx.replace_where(strip_strong(text), ("[",), ZH_TAGS, " ")
        return rx.trim(rx.squeeze(_without_notes(_plain_brackets(text), bracketed=True)))

    return rx.unless_plain(text, MARKS, clean)


def clean_title(text: Column) -> Column:

    def clean(text: Column) -> Column:
        text = rx.replace_at(strip_strong(text), "*", r"^\*\*(.+?)\*\*$", "$1")
        text = _without_marker(text)
        text = rx.replace_where(text, ("[",), r"\[[^\]]+\]", " ")
        text = rx.replace_at(text, "#", r"^#+\s+", "")
        return rx.squeeze(rx.trim(text))

    return rx.unless_plain(text, MARKS, clean, FIRST_MARKS)


def clean_rule(text: Column) -> Column:
    """Final text of a trace rule."""

    def clean(text: Column) -> Column:
        text = rx.replace_where(text, ("[",), ALL_TAGS, " ", "i")
        text = rx.squeeze(_without_notes(text, bracketed=False))
        text = rx.replace_where(text, COLONS, r"([：:])\s*\1+", "$1")
        text = rx.replace_at(text, "：:" + rx.SPACE_CHARS, r"^[\s：:]+", "")
        text = rx.trim(rx.replace_at(text, "[", r"^\[['\"][^\]]+\][：:]\s*", ""))
        return rx.replace_where(text, COLONS, r"^(.{2,80})[：:]\s*\1[：:]", "$1:")

    return rx.unless_plain(text, MARKS, clean)


def clean_line(text: Column) -> Column:
    """Rule or anti-pattern line as reports show it (D6, overview form)."""

    def clean(text: Column) -> Column:
        text = rx.replace_at(rx.trim(strip_strong(text)), "*", r"^\*\*(.+?)\*\*$", "$1")
        text = rx.replace_at(_without_marker(text), "#", r"^#{1,6}\s+", "")
        text = rx.replace_where(text, ("[",), rf"\s*{ALL_TAGS}\s*", " ", "i")
        text = _without_notes(_plain_brackets(text), bracketed=True)
        text = rx.trim(rx.replace_at(text, "[", r"^\[(.+)\]$", "$1"))
        text = rx.trim(rx.replace_at(text, LIST_STARTS, r"^(?:(?:[-*]|\d+\.)\s+)+", ""))
        text = rx.replace_where(text, COLONS, r"\s+([：:])\s*", "$1")
        text = rx.replace_where(text, COLONS, r"([：:])\s*[：:]+", "$1")
        text = rx.replace_where(text, COLONS, r"^(.{2,80})[：:]\s*\1[：:]", "$1:")
        text = rx.replace_at(text, "：:" + rx.SPACE_CHARS, r"^[\s：:]+", "")
        text = rx.replace_at(text, "[", r"^\[['\"][^\]]+\][：:]\s*", "")
        return rx.trim(rx.squeeze(text))

    return rx.unless_plain(text, MARKS, clean, FIRST_MARKS)


def _sp(count: str) -> str:
    return f"[{rx.SPACE_CLASS}]{count}"


def is_observation(text: Column) -> Column:
    """A remark about evidence or absence, not a rule.

    The pattern runs only on texts that hold a word it needs, found by byte searches.
    """

    def guarded(line: Column) -> Column:
        found = rx.test(
            line,
            r"^⚠️|\[待验证\]|(?i:To Verify)"
            rf"|^\*?\s*(?i:证据|Evidence)[：:]|^（?证据[：:]|{ABSENCE_WORDS}",
        )
        latin = let(
            F.lower(line),
            lambda l: F.contains(l, F.lit("to verify")) | (F.contains(l, F.lit("evidence")) & line.rlike("[:：]")),
        )
        words = [*rx.required_literals(ABSENCE_WORDS), ("⚠️",), ("待验证",), ("证据",)]
        holds = latin | (line.rlike(f"[{rx.WIDE_RANGE}]") & rx.contains_any(line, words))
        return F.when(~holds, False).otherwise(found)

    return let(text, guarded)


def _heading(text: Column) -> Column:
    return F.startswith(text, F.lit("#")) & rx.test(text, r"^#{1,6}\s+")


def is_usable(text: Column) -> Column:
    return (
        (F.length(text) >= MIN_RULE_LENGTH)
        & ~_heading(text)
        & ~(rx.contains_any(text, [(c,) for c in COLONS]) & rx.trim(text).rlike("(?i)^(?:证据|Evidence)[：:]"))
        & ~let(F.lower(text), lambda l: rx.guarded_test(text, docs.NO_PATTERN, "i", l))
    )


def is_actionable(text: Column) -> Column:
    trimmed = rx.trim(text)
    return (
        (F.length(text) > MIN_RULE_LENGTH)
        & ~(F.endswith(trimmed, F.lit("：")) | F.endswith(trimmed, F.lit(":")))
        & ~_heading(text)
        & ~trimmed.isin(*BARE_TOPICS)
        & ~rx.guarded_test(text, rf"推测|可能|推断|无现有模式|⚠️|\[待验证\]|{ABSENCE_WORDS}")
        & ~(F.startswith(text, F.lit("如：")) | F.startswith(text, F.lit("如:")))
    )


def is_actionable_anti_pattern(text: Column) -> Column:
    return is_actionable(text) & ~rx.mentions(text, "建议|推荐使用|可考虑|待验证")


def is_pending_line(text: Column) -> Column:
    return F.contains(text, F.lit("[待验证]")) | rx.test(
        rx.trim(text), r"^###\s+(?:待验证|缺口|Gaps|To Verify)\b", "i"
    )


def rule_status(text: Column, own: Column, borrowed: Column) -> Column:
    """pending by wording, active with any file, else weak."""
    return (
        F.when(let(rx.ascii_lower(text), lambda t: rx.mentions(t, PENDING_RULE.lower())), "pending")
        .when((F.size(own) > 0) | (F.size(borrowed) > 0), "active")
        .otherwise("weak")
    )


# -------------------------------------------------------------- rule rows


def _rule_bodies(content: Column) -> Column:
    """Bodies rules are read from: rule sections, then all other open sections."""

    def gather(found: Column) -> Column:
        explicit = [docs.titled_body(found, alias) for alias in RULE_SECTIONS]
        stated = F.transform(
            F.array_compact(F.array(*explicit)),
            lambda b: F.struct(F.lit("").alias("title"), b.alias("body")),
        )
        open_ = F.filter(found, lambda s: docs.section_name(s["title"]).isNull())
        return F.concat(stated, open_)

    return let(docs.sections(content), gather)


def _report_bodies(content: Column) -> Column:
    """Bodies the reports read: every rule-named section untitled, open ones titled."""
    name = lambda s: docs.section_name(s["title"], loose=True)
    kept = F.filter(
        docs.sections(content), lambda s: F.coalesce(name(s), F.lit("Rules")) == "Rules"
    )
    return F.transform(
        kept,
        lambda s: F.struct(
            F.when(name(s) == "Rules", "").otherwise(s["title"]).alias("title"),
            s["body"].alias("body"),
        ),
    )


def rule_blocks(layer_docs: DataFrame, bodies: Column, keys: Sequence[str]) -> DataFrame:
    """(keys, section_pos, group_pos, block_pos, heading, block ARRAY<STRING>)."""
    sections = layer_docs.select(*keys, F.posexplode(bodies).alias("section_pos", "s"))
    groups = sections.select(
        *keys,
        "section_pos",
        F.posexplode(docs.rule_groups(F.col("s.body"), F.col("s.title"))).alias("group_pos", "g"),
    )
    return groups.select(
        *keys,
        "section_pos",
        "group_pos",
        F.col("g.heading").alias("heading"),
        F.posexplode(docs.list_blocks(F.col("g.text"))).alias("block_pos", "block"),
    )


def _rest_of(block: Column, clean) -> Column:
    """Cleaned continuation lines of a block, observations and blanks dropped."""

    def body(line: Column) -> Column:
        bare = _without_marker(rx.replace_at(line, "*", r"^\*\*(.+?)\*\*$", "$1"))
        return clean(rx.trim(rx.replace_at(rx.trim(bare), "-*", r"^[-*]\s+", "")))

    trimmed = F.transform(F.slice(block, 2, F.greatest(F.size(block), F.lit(1))), rx.trim)
    code = F.filter(trimmed, lambda l: (l != "") & ~F.startswith(l, F.lit("```")))
    return F.filter(F.transform(code, body), lambda l: (l != "") & ~is_observation(l))


def _item_parts(raw: Column) -> Column:
    """struct<title, body> of an item's first line."""
    bold_body = rx.java(r"^\*\*(.+?)\*\*\s*[：:]\s*(.+)$")
    bold_only = rx.java(r"^\*\*(.+?)\*\*\s*$")
    colon = rx.java(r"^([^：:]{2,32})[：:]\s*(.+)$")

    def part(title: Column, body: Column) -> Column:
        return F.struct(title.alias("title"), body.alias("body"))

    def plain(text: Column) -> Column:
        head = F.regexp_extract(text, colon, 1)
        return F.when(
            text.rlike(colon) & ~F.contains(head, F.lit("`")),
            part(clean_title(head), clean_body(F.regexp_extract(text, colon, 2))),
        ).otherwise(part(F.lit(""), text))

    def parts(raw: Column) -> Column:
        strong = F.startswith(raw, F.lit("**"))
        return (
            F.when(
                strong & raw.rlike(bold_body),
                part(
                    clean_title(F.regexp_extract(raw, bold_body, 1)),
                    clean_body(F.regexp_extract(raw, bold_body, 2)),
                ),
            )
            .when(
                strong & raw.rlike(bold_only),
                part(clean_title(F.regexp_extract(raw, bold_only, 1)), F.lit("")),
            )
            .otherwise(let(clean_body(raw), plain))
        )

    return let(raw, parts)


def _without_repeated_title(body: Column, title: Column) -> Column:
    rest = rx.trim(
        rx.replace(F.substr(body, F.length(title) + 1), r"^\s*[：:，,。-]*\s*", "")
    )
    repeats = (title != "") & F.startswith(F.lower(body), F.lower(title))
    return F.when(repeats & (rest != ""), rest).otherwise(body)


def _keep(df: DataFrame, condition: Column, columns: Sequence[str]) -> DataFrame:
    """Rows meeting a condition on expensive computed columns.

    As a generator over zero or one struct it stays where it is; a plain filter
    would be pushed below and evaluate the whole chain of expressions twice.
    """
    return df.select(F.inline(F.when(condition, F.array(F.struct(*columns)))))


def compose_rules(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, positions, text): trace rule text of each block."""
    order = ("section_pos", "group_pos", "block_pos")
    raw = rx.trim(rx.replace(rx.trim(F.get("block", F.lit(0))), r"^(?:[-*]|\d+\.)\s+", ""))
    parsed = blocks.select(
        *keys,
        *order,
        clean_title(F.col("heading")).alias("group_title"),
        _item_parts(raw).alias("item"),
        _rest_of(F.col("block"), clean_body).alias("rest"),
        F.array_join(
            normalize_tags(
                F.concat(
                    extract_tags(F.col("heading")),
                    F.flatten(F.transform("block", extract_tags)),
                )
            ),
            " ",
        ).alias("tag_text"),
    )
    first = F.filter(
        F.array(F.col("item.body")), lambda b: (b != "") & ~is_observation(b)
    )
    composed = parsed.select(
        *keys,
        *order,
        "tag_text",
        F.col("item.title").alias("item_title"),
        F.concat(first, F.col("rest")).alias("parts"),
        F.array_join(
            F.when(
                normalize(F.col("item.title")) == normalize(F.col("group_title")),
                F.filter(F.array("group_title"), lambda t: t != ""),
            ).otherwise(F.filter(F.array("group_title", "item.title"), lambda t: t != "")),
            " / ",
        ).alias("title"),
    )
    title_only = (
        (F.size("parts") > 1)
        & (F.col("item_title") != "")
        & (normalize(F.get("parts", F.lit(0))) == normalize(F.col("item_title")))
    )
    body = rx.trim(
        rx.squeeze(
            F.array_join(
                F.when(title_only, F.slice("parts", 2, F.greatest(F.size("parts"), F.lit(1)))).otherwise(F.col("parts")),
                " ",
            )
        )
    )
    joined = composed.select(*keys, *order, "tag_text", "title", body.alias("body"))
    prefix = F.concat_ws(
        " ", F.nullif("title", F.lit("")), F.nullif("tag_text", F.lit(""))
    )
    worded = joined.select(
        *keys,
        *order,
        F.when(
            F.col("body") != "",
            F.concat(
                F.when(prefix != "", F.concat(prefix, F.lit("："))).otherwise(""),
                _without_repeated_title(F.col("body"), F.col("title")),
            ),
        ).alias("worded"),
    )
    cleaned = worded.select(
        *keys,
        *order,
        is_usable(F.col("worded")).alias("usable"),
        clean_rule(F.col("worded")).alias("text"),
    )
    return _keep(cleaned, F.col("usable"), [*keys, *order, "text"])


def first_position(df: DataFrame, keys: Sequence[str], key: Column, value: str, order: Column) -> DataFrame:
    """One row per key: first position, last value.

    A value that is its own key is not carried beside it.
    """
    keyed = df.select(*keys, key.alias("__key"), F.col(value).alias(value), order.alias("__at"))
    other = F.when(~F.col(value).eqNullSafe(F.col("__key")), F.struct(value))
    last = keyed.select(*keys, "__key", "__at", other.alias("__other")).groupBy(*keys, "__key").agg(
        F.min("__at").alias("position_key"), F.max_by("__other", "__at").alias("__other")
    )
    return last.select(
        *keys, "position_key",
        F.when(F.col("__other").isNull(), F.col("__key")).otherwise(F.col("__other")[value]).alias(value),
    )


def bare_bullet(text: Column) -> Column:
    return rx.trim(F.regexp_replace(text, rf"^[-*]{_sp('*')}", ""))


def layer_evidence(evidence: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, layer, evidence_ids, evidence_files): what a layer's rules may cite.

    At most one item per rule of the rule set in a group, each with at most a
    dozen files, so the lists are short.
    """
    rank = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)
    item = F.struct((-rank).alias("r"), (-F.col("count")).alias("n"), "rule_id", "files")
    ordered = F.array_sort(F.collect_list(item))
    return evidence.groupBy(*keys, "layer").agg(
        F.transform(ordered, lambda x: x["rule_id"]).alias("evidence_ids"),
        F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["files"]))).alias("evidence_files"),
    )


def link_to_evidence(rows: DataFrame, linked: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Every row of a layer with that layer's evidence, empty lists where none.

    The join strategy is left to adaptive execution: the evidence side has at
    most eight short entries per reference but no bound overall.  Joined by the
    reference alone, rows that lie together by reference stay where they are.
    """
    lists = ("evidence_ids", "evidence_files")
    entry = F.struct("layer", F.struct(*lists))
    by_layer = linked.filter(F.col("layer").isNotNull()).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(entry)).alias("__layers")
    )
    found = F.try_element_at("__layers", F.col("layer"))
    empty = F.array().cast("array<string>")
    return rows.join(by_layer, list(keys), "left").select(
        *rows.columns, *[F.coalesce(found[c], empty).alias(c) for c in lists]
    )


def _declared(layer_docs: DataFrame) -> DataFrame:
    """Documents that declare their layer, keyed by it."""
    return layer_docs.select(
        *KEY, docs.layer_id(F.col("content")).alias("layer"), "content"
    ).filter(F.col("layer").isNotNull())


def _numbered(rows: DataFrame, order: Sequence[str], mark: str) -> DataFrame:
    """Ids ``type-layer-r001`` counted over a whole reference.

    A reference has at most eight documents, so the window is bounded by them.
    """
    window = Window.partitionBy(*KEY).orderBy(*order)
    numbered = rows.withColumn("pos", F.row_number().over(window))
    digits = F.col("pos").cast("string")
    return numbered.withColumn(
        "id",
        F.concat_ws(
            "-",
            "project_type",
            "layer",
            F.concat(F.lit(mark), F.lpad(digits, F.greatest(F.length(digits), F.lit(3)), F.lit("0"))),
        ),
    )


def trace_rules(layer_docs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Rules of all references with tags, files, evidence ids and status."""
    keys = [*KEY, "layer"]
    blocks = rule_blocks(_declared(layer_docs), _rule_bodies(F.col("content")), keys)
    # texts are shuffled once, by reference: what follows is keyed by it
    composed = compose_rules(blocks, keys).repartition(*KEY)
    unique = first_position(
        composed, keys, bare_bullet(F.col("text")), "text",
        F.struct("section_pos", "group_pos", "block_pos"),
    )
    numbered = _numbered(unique, ["layer", "position_key"], "r")
    linked = link_to_evidence(numbered, layer_evidence(evidence))
    return linked.withColumn("own", file_refs(F.col("text"))).select(
        *KEY,
        "id",
        "pos",
        "layer",
        bare_bullet(F.col("text")).alias("text"),
        extract_tags(F.col("text")).alias("tags"),
        F.when(F.size("own") > 0, F.col("own"))
        .otherwise(F.slice("evidence_files", 1, BORROWED_FILES))
        .alias("files"),
        "evidence_ids",
        rule_status(F.col("text"), F.col("own"), F.col("evidence_files")).alias("status"),
    )


def document_templates(layer_docs: DataFrame) -> DataFrame:
    """(skill, project_type, layer, pos, name, body, status)."""
    found = _declared(layer_docs).select(
        *KEY, "layer", F.posexplode(docs.templates(docs.sections(F.col("content")))).alias("pos", "t")
    )
    return found.select(
        *KEY,
        "layer",
        "pos",
        F.col("t.name").alias("name"),
        F.col("t.body").alias("body"),
        docs.template_status(F.col("t.name"), F.col("t.body")).alias("status"),
    )


def trace_templates(layer_docs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Templates of all references with status, files and evidence ids."""
    rows = document_templates(layer_docs).select(
        *KEY, "layer", F.col("pos").alias("doc_pos"), "name", "status",
        F.slice(file_refs(F.col("body")), 1, BORROWED_FILES).alias("files"),
    )
    linked = link_to_evidence(rows, layer_evidence(evidence))
    return _numbered(linked, ["layer", "doc_pos"], "t").select(
        *KEY, "id", "pos", "layer", "name", "status", "files", "evidence_ids"
    )
