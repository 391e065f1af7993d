"""What is surfaced of a learned reference: ranked rules, templates, totals.

Rows are keyed by (skill, project_type).  Ranking works on short texts; every
selection cuts salted slices first, so that one huge reference stays spread.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from habitus.functions import patterns as rx
from habitus.functions.paths import skill_path_parts
from habitus.operators import documents as docs
from habitus.operators import trace as tr
from habitus.operators.documents import let
from habitus.operators.evidence import evidence_stats
from habitus.operators.skew import top_k
from habitus.operators.trace import KEY
from habitus.session import broadcast_if_small, cut_lineage

# How much is surfaced.
TYPE_RULES_SHOWN = 20
HARD_RULES_SHOWN = 12
TEMPLATES_SHOWN = 8
NEVER_DO_SHOWN = 20
CROSS_SHOWN = 8
SCENARIOS_SHOWN = 8
PER_CATEGORY = 4
KEY_LENGTH = 120
#: Documents of a reference up to which one task holds its rules: eight layers, each several times.
REFERENCE_DOCS = 64
HARD_TAGS = ("[个人偏好]", "[必须]")
TYPE_TAGS = ("[项目特定]", "[必须]")

# Keyword weights of a rule, in points.
RULE_WEIGHTS = [
    (r"模块|分层|目录|包名|依赖方向|业务域|-api|-biz|src/api|src/views", 42),
    (r"API|接口|Controller|request|DTO|VO|ReqVO|RespVO|参数|契约|@Valid", 38),
    (r"权限|认证|授权|XSS|Security|token|脱敏|校验|v-has", 34),
    (r"错误|异常|日志|拦截|CommonResult|ElMessage|ApiErrorLog", 30),
    (r"状态|store|Pinia|缓存|Redis|数据|Mapper|DO|数据库|持久化", 28),
    (r"配置|环境|常量|Properties|\.env|Maven|POM|版本", 24),
    (r"测试|JUnit|Mockito|Lint|构建|启动|CI|Vite|pnpm|npm", 20),
    (r"命名|后缀|PascalCase|camelCase|snake_case|枚举|Lombok", 18),
]
LENGTH_POINTS = {"short": (140, 12), "long": (220, -15), "very long": (320, -30)}
LIBRARY_TALK = (r"优先选择|主力|工具库|第三方库|插件", -8)
# Rule categories, first match wins.
RULE_CATEGORIES = [
    (r"模块|分层|目录|包名|依赖方向|业务域", "architecture"),
    (r"API|接口|Controller|request|DTO|VO|参数|契约", "api"),
    (r"权限|认证|授权|XSS|Security|token|脱敏|校验", "security"),
    (r"错误|异常|日志|拦截|CommonResult|ElMessage", "errors"),
    (r"状态|store|Pinia|缓存|Redis|数据|Mapper|数据库", "data"),
    (r"配置|环境|常量|Properties|\.env|Maven|POM", "config"),
    (r"测试|JUnit|Mockito|Lint|构建|启动|CI|Vite", "quality"),
    (r"命名|后缀|PascalCase|camelCase|snake_case|枚举", "naming"),
]
# Topics of which only one rule is kept; all patterns must occur.
RULE_TOPICS = [
    ("api-function-naming", (r"api", r"命名|name", r"api\s*结尾|以 api|api 后缀|api$")),
    (
        "token-access-management",
        (
            r"token|令牌|admin-token|admin-refresh-token",
            r"auth\.js|cookies|localstorage|存取|读取|写入|删除|管理",
        ),
    ),
    ("vite-env-config", (r"vite_|import\.meta\.env|loadenv|环境变量|\.env",)),
    ("pinia-persistence", (r"pinia|store|状态", r"persist|持久化")),
]
ANTI_PATTERN_TOPICS = [
    (
        "hardcoded-backend-url",
        r"硬编码.*(?:后端|接口|api).*地址|(?:后端|接口|api).*地址.*硬编码|http:\/\/192\.168\.",
    ),
    ("direct-state-mutation", r"直接修改.*state|state.*直接修改"),
]
QUOTES = "[`\"'“”‘’]"
QUOTE_CHARS = tuple("`\"'“”‘’")
# Template scoring.
TEMPLATE_POINTS = [
    (r"新|骨架|结构|模块|API|Service|数据|启动", 10),
    (r"示例|命名", 4),
    (r"测试|质量|日志", 3),
]
UNSAFE_TEMPLATE = (
    r"待验证|暂未实现|推测|可能|未发现|未展示|建议|推荐使用|可考虑"
)
TOOL_NAMES = (
    "Vitest|Jest|Cypress|Playwright|Sentry|SonarQube|JaCoCo|Checkstyle|SpotBugs|commitlint|husky"
    "|GitHub Actions|vite-plugin-compression|vite-plugin-imagemin"
)
# Concerns shared across types: id, summary, required and optional words.
CONCERNS = [
    ("module-boundaries", "按领域/模块分层组织代码，并保持依赖方向单向", ("模块",),
     ("分层", "业务域", "src/views", "-api", "-biz", "Controller", "依赖")),
    ("api-facade", "对外调用先经过稳定 API/接口层，业务代码不直接穿透底层实现", ("API",),
     ("接口", "request", "Controller", "Api", "端点", "Mapper")),
    ("typed-contracts", "用显式类型/DTO/VO 作为跨层数据契约", ("VO",),
     ("DTO", "类型", "ReqVO", "RespVO", "参数", "校验", "@Valid")),
    ("central-config", "配置、常量和环境差异集中管理，业务层只引用命名入口", ("配置",),
     (".env", "VITE_", "常量", "POM", "父 POM", "版本")),
    ("security-gates", "认证、授权和输入安全通过统一入口处理", ("权限",),
     ("认证", "授权", "token", "Security", "@Valid", "v-has")),
    ("observable-errors", "错误和访问行为通过统一机制记录或反馈", ("日志",),
     ("错误", "异常", "拦截", "ElMessage", "ApiErrorLog", "访问日志")),
    ("migration-discipline", "持久化结构变更要进入版本化脚本或受控迁移流程", ("迁移",),
     ("Flyway", "SQL", "db/migration", "数据库")),
    ("test-safety-net", "核心逻辑需要自动化测试作为重构安全网", ("测试",),
     ("JUnit", "Mockito", "spec", "单元测试")),
    ("avoid-duplication", "重复配置和重复实现应抽到共享层，避免多处漂移", ("重复",),
     ("共享", "公共", "配置", "复用")),
]
REQUIRED_POINTS = 3
# Scenario rows: type, trigger pattern, case-insensitive, scenario, action, layer.
API_TYPED = "在 `src/api/` 对应业务域文件中导出命名接口函数和对应类型契约"
API_PLAIN = "在 `src/api/` 对应业务域 `.js` 文件中导出命名接口函数，并通过统一 `request` 封装调用"
SCENARIOS = [
    ("vue3", r"src/api|API", False, "新增前端接口", None, "L2"),
    ("vue3", r"Pinia|store|状态|State Management", True, "新增跨页面状态",
     "在 `src/stores/modules/` 新增 Pinia 模块，并通过 action 管理读取、更新与持久化", "L5"),
    ("vue3", r"v-hasRole|权限", False, "新增权限控制",
     "使用 `v-hasRole` / `v-hasPermi` 控制界面元素", "L7"),
    ("spring-boot", r"-api|-biz", False, "新增后端业务模块",
     "按 `nezha-module-<domain>-api` / `nezha-module-<domain>-biz` 分层创建", "L1, L2"),
    ("spring-boot", r"Mapper|BaseMapper", False, "新增数据访问",
     "创建 DO 和 Mapper，Mapper 继承 `BaseMapperX<T>` 或 `BaseMapper<T>`", "L5"),
    ("spring-boot", r"Flyway|迁移", False, "新增数据库变更",
     "在受控迁移目录添加版本化 SQL，并避免业务代码内硬编码结构变更", "L1, L8"),
]


# ------------------------------------------------------------ rules to rank


def _short_key(text: Column) -> Column:
    return F.left(rx.squeeze(F.lower(text)), F.lit(KEY_LENGTH))


def few_documents(layer_docs: DataFrame, most: int = REFERENCE_DOCS) -> bool:
    """No reference has more than ``most`` documents, so that one task can hold any of them."""
    counted = layer_docs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") > most).isEmpty()


def report_rules(layer_docs: DataFrame, together: bool = False) -> DataFrame:
    """(skill, project_type, at, text, tags): rules as reports read them.

    The first of equal rules of a reference is kept.  ``together`` deals the rules
    out by reference, so that nothing that is keyed by it shuffles their texts
    again; for references of few documents (``few_documents``).
    """
    keys = [*KEY, "layer"]
    blocks = tr.rule_blocks(layer_docs, tr._report_bodies(F.col("content")), keys)
    first = rx.trim(rx.replace(rx.trim(F.get("block", F.lit(0))), r"^(?:[-*]|\d+\.)\s+", ""))

    def clean(line: Column) -> Column:
        return tr.clean_line(
            rx.trim(rx.replace(line, r"^(?:[-*]|\d+\.)\s+(?:[-*]\s+)?", ""))
        )

    trimmed = F.filter(
        F.transform("block", rx.trim), lambda l: (l != "") & ~F.startswith(l, F.lit("```"))
    )
    parts = F.filter(
        F.transform(trimmed, clean), lambda l: (l != "") & ~tr.is_observation(l)
    )
    at = F.struct("layer", "section_pos", "group_pos", "block_pos")
    read = blocks.select(
        *KEY,
        at.alias("at"),
        tr.clean_line(F.col("heading")).alias("group_title"),
        first.alias("first"),
        tr.clean_line(first).alias("item_title"),
        (F.size(tr.extract_tags(first)) == 0).alias("untagged"),
        parts.alias("parts"),
        tr.normalize_tags(
            F.concat(
                tr.extract_tags(F.col("heading")),
                F.flatten(F.transform("block", tr.extract_tags)),
            )
        ).alias("tags"),
    )
    same = _short_key(F.col("item_title")) == _short_key(F.col("group_title"))
    titled = read.withColumn(
        "first_is_title",
        (F.size("parts") > 1)
        & (F.col("first").rlike(r"^\*\*.+\*\*") | (F.length("item_title") <= 28) | same),
    )
    title = F.when(
        F.col("first_is_title"),
        F.array_join(
            F.filter(
                F.when(same, F.array("group_title")).otherwise(F.array("group_title", "item_title")),
                lambda t: t != "",
            ),
            " / ",
        ),
    ).otherwise(F.when(F.col("untagged"), F.col("group_title")).otherwise(""))
    body = rx.trim(
        rx.squeeze(
            F.array_join(
                F.when(
                    F.col("first_is_title"), F.slice("parts", 2, F.greatest(F.size("parts"), F.lit(1)))
                ).otherwise(F.col("parts")),
                " ",
            )
        )
    )
    worded = titled.select(*KEY, "at", "tags", title.alias("title"), body.alias("body"))
    text = tr.clean_line(
        F.when(F.col("title") != "", F.concat("title", F.lit("："), "body")).otherwise(F.col("body"))
    )
    rules = tr._keep(
        worded.select(*KEY, "at", "tags", "body", text.alias("text")),
        F.col("body") != "",
        [*KEY, "at", "tags", "text"],
    )
    if together:
        rules = rules.repartition(*KEY)
    return (
        rules.withColumn("__key", _short_key(F.col("text")))
        .groupBy(*KEY, "__key")
        .agg(F.min(F.struct("at", "text", "tags")).alias("r"))
        .select(*KEY, "r.*")
    )


def _first_of_equal(rules: DataFrame) -> DataFrame:
    return rules.groupBy(*KEY, "text").agg(F.min("at").alias("at"))


def marked_rules(
    trace_rules: DataFrame, stated: DataFrame, kinds: Mapping[str, tuple[str, ...]]
) -> DataFrame:
    """(skill, project_type, kind, at, text): rules with all tags of a kind.

    Traced rules count where a reference has any of the kind; the others take what
    their documents state (``report_rules``).  Both tag languages count in a trace,
    the original ones in documents.  Either table is read once for all kinds; rules
    without tags are told apart first, the others are tested further.
    """
    columns = [*KEY, "kind", "at", "text"]

    def of_kinds(tags: Column, has) -> Column:
        wanted = lambda t: [
            F.when(reduce(lambda a, b: a & b, [has(t, tag) for tag in required]), kind)
            for kind, required in kinds.items()
        ]
        return F.explode(F.when(F.size("tags") > 0, let(tags, lambda t: F.array_compact(F.array(*wanted(t))))))

    def first_of_equal(rules: DataFrame) -> DataFrame:
        return rules.groupBy(*KEY, "kind", "text").agg(F.min("at").alias("at")).select(*columns)

    # what else a trace holds is made for rules with tags only
    tagged = trace_rules.filter(F.size("tags") > 0).select(
        *KEY, "pos", "text", "status", "files", "evidence_ids",
        of_kinds(tr.normalize_tags(F.col("tags")), tr.has_tag).alias("kind"),
    )
    active = (F.col("status") == "active") & ((F.size("files") > 0) | (F.size("evidence_ids") > 0))
    # the order of a trace is its counter; the shape matches a document position
    at = F.struct(
        F.lit("").alias("layer"), F.col("pos").alias("section_pos"),
        F.lit(0).alias("group_pos"), F.lit(0).alias("block_pos"),
    )
    cleaned = tr._keep(tagged, active, [*KEY, "kind", "pos", "text"]).select(
        *KEY, "kind", at.alias("at"), tr.clean_line(F.col("text")).alias("text")
    )
    actionable = tr.is_actionable(F.col("text"))
    # few short rows, read once for the rules and once for the references that have any
    from_trace = cut_lineage(first_of_equal(tr._keep(cleaned, actionable, columns)))
    marked = stated.select(*KEY, "at", "text", of_kinds(F.col("tags"), F.array_contains).alias("kind"))
    kept = tr._keep(marked, ~tr.is_pending_line(F.col("text")) & actionable, columns).join(
        from_trace.select(*KEY, "kind").distinct(), [*KEY, "kind"], "left_anti"
    )
    return from_trace.unionByName(first_of_equal(kept))


def tagged_rules(
    trace_rules: DataFrame, stated: DataFrame, required: tuple[str, ...]
) -> DataFrame:
    """(skill, project_type, at, text): rules with all required tags (``marked_rules``)."""
    return marked_rules(trace_rules, stated, {"required": required}).drop("kind")


def score_rule(text: Column) -> Column:
    """Keyword weights plus length points."""

    def keywords(lowered: Column) -> Column:
        score = F.lit(0)
        for pattern, weight in RULE_WEIGHTS:
            score = score + F.when(rx.mentions(lowered, pattern.lower()), weight).otherwise(0)
        return score

    score = let(rx.ascii_lower(text), keywords)
    length = F.length(text)
    limit, points = LENGTH_POINTS["short"]
    score = score + F.when(length <= limit, points).otherwise(0)
    for name in ("long", "very long"):
        limit, points = LENGTH_POINTS[name]
        score = score + F.when(length > limit, points).otherwise(0)
    pattern, points = LIBRARY_TALK
    return score + F.when(rx.mentions(text, pattern), points).otherwise(0)


def categorize_rule(text: Column) -> Column:
    """First matching keyword family."""

    def family(lowered: Column) -> Column:
        kind = None
        for pattern, name in RULE_CATEGORIES:
            hit = rx.mentions(lowered, pattern.lower())
            kind = F.when(hit, name) if kind is None else kind.when(hit, name)
        return kind.otherwise("other")

    return let(rx.ascii_lower(text), family)


def rule_key(text: Column) -> Column:
    """Topic of a rule, else its beginning: rules of one key say the same."""

    def topic(plain: Column) -> Column:
        key = None
        for name, patterns in RULE_TOPICS:
            hit = reduce(lambda a, b: a & b, [rx.mentions(plain, p) for p in patterns])
            key = F.when(hit, name) if key is None else key.when(hit, name)
        return key.otherwise(_short_key(text))

    return let(rx.squeeze(rx.replace_where(F.lower(text), QUOTE_CHARS, QUOTES, "")), topic)


def dedupe_near_rules(rules: DataFrame) -> DataFrame:
    """One rule per key: higher score, then longer, then earlier."""
    scored = rules.select(
        *KEY, "at", "text", score_rule(F.col("text")).alias("score"),
        rule_key(F.col("text")).alias("__key"),
    )
    first = F.struct(
        (-F.col("score")).alias("s"), (-F.length("text")).alias("n"), "at", "text", "score"
    )
    return (
        scored.groupBy(*KEY, "__key")
        .agg(F.min(first).alias("r"))
        .select(*KEY, "r.at", "r.text", "r.score")
    )


def select_top_rules(rules: DataFrame, limit: int) -> DataFrame:
    """(skill, project_type, position, text): the best ``limit`` rules.

    Ranked by score, at most four per category while more rules exist than are
    shown, then filled up by rank; the result is back in original order.  A rule
    beyond the first ``limit`` + 1 of its category can neither be chosen nor
    change the test for more, so categories are cut first, in salted slices.
    """
    unique = dedupe_near_rules(rules).withColumn("category", categorize_rule(F.col("text")))
    order = [F.desc("score"), F.asc("at")]
    short = top_k(unique, [*KEY, "category"], order, limit + 1, unique=["text"], rank="c")
    whole = Window.partitionBy(*KEY)
    late = F.when((F.col("n") > limit) & (F.col("c") > PER_CATEGORY), 1).otherwise(0)
    ranked = (
        short.withColumn("n", F.count(F.lit(1)).over(whole))
        .withColumn("pick", F.row_number().over(whole.orderBy(late, *order)))
        .filter(F.col("pick") <= limit)
    )
    return ranked.withColumn(
        "position", F.row_number().over(whole.orderBy("at"))
    ).select(*KEY, "position", "text", "score", "category")


# --------------------------------------------------------------- templates


def template_info(trace_templates: DataFrame, layer_docs: DataFrame) -> DataFrame:
    """(skill, project_type, pos, layer, name, unsafe, missing): traced, else read."""
    traced = trace_templates.select(
        *KEY,
        "pos",
        "layer",
        tr.docs.template_name(F.col("name")).alias("name"),
        (F.col("status") == "pending").alias("unsafe"),
        (F.col("status") == "missing").alias("missing"),
    )
    body = F.col("body")
    missing = F.contains(F.col("name"), F.lit("无现有模式")) | docs.missing_only(body)
    unsafe = body.rlike(UNSAFE_TEMPLATE) | rx.test(body, rf"\b(?:{TOOL_NAMES})\b", "i")
    order = Window.partitionBy(*KEY).orderBy("layer", "doc_pos")
    keys = traced.select(*KEY).distinct()
    small = broadcast_if_small(keys)
    # where the references fit, documents of traced ones are not taken apart again
    others = layer_docs if small is None else layer_docs.join(small, list(KEY), "left_anti")
    found = tr.document_templates(others).withColumnRenamed("pos", "doc_pos")
    read = (
        (found.join(keys, list(KEY), "left_anti") if small is None else found)
        .withColumn("pos", F.row_number().over(order))
        .select(*KEY, "pos", "layer", "name", (~missing & unsafe).alias("unsafe"), missing.alias("missing"))
    )
    return traced.unionByName(read)


def score_template(layer: Column, name: Column) -> Column:
    number = F.coalesce(F.try_to_number(F.regexp_replace(layer, "^L", ""), F.lit("99")).cast("int"), F.lit(99))
    score = F.when(number.between(1, 8), 20 - number).otherwise(0)
    for pattern, points in TEMPLATE_POINTS:
        score = score + F.when(name.rlike(pattern), points).otherwise(0)
    return score


def select_top_templates(templates: DataFrame, limit: int = TEMPLATES_SHOWN) -> DataFrame:
    """Templates with ``hidden`` set on usable ones beyond the best ``limit``.

    Visibility goes by (layer, name), so equal names of a layer stay together.
    """
    usable = templates.filter(~F.col("unsafe") & ~F.col("missing"))
    scored = usable.withColumn("score", score_template(F.col("layer"), F.col("name")))
    best = top_k(
        scored, list(KEY), [F.desc("score"), F.asc("pos")], limit, unique=["pos"]
    )
    shown = best.select(*KEY, "layer", "name").distinct().withColumn("__shown", F.lit(True))
    return templates.join(shown, [*KEY, "layer", "name"], "left").select(
        *KEY, "pos", "layer", "name", "unsafe", "missing",
        (~F.col("unsafe") & ~F.col("missing") & F.col("__shown").isNull()).alias("hidden"),
    )


# ------------------------------------------------------------ anti-patterns


def format_anti_pattern(line: Column) -> Column:
    body = rx.trim(
        F.regexp_replace(rx.replace(line, r"^[❌✗×xX]\s*", ""), rf"^[🚫⚠️][{rx.SPACE_CLASS}]*", "")
    )
    return F.when(body != "", F.concat(F.lit("❌ "), body)).otherwise(line)


def anti_pattern_key(line: Column) -> Column:
    plain = F.regexp_replace(F.lower(line), rf"^[❌✗×xX🚫⚠️{rx.SPACE_CLASS}]+", "")
    plain = rx.trim(rx.squeeze(F.regexp_replace(plain, QUOTES, "")))

    def name(text: Column) -> Column:
        key = None
        for topic, pattern in ANTI_PATTERN_TOPICS:
            hit = rx.test(text, pattern, "i")
            key = F.when(hit, topic) if key is None else key.when(hit, topic)
        return key.otherwise(F.left(text, F.lit(KEY_LENGTH)))

    return let(plain, name)


def anti_patterns(layer_docs: DataFrame) -> DataFrame:
    """(skill, project_type, at, text): one line per key and reference.

    Every dash bullet of every anti-pattern section is read.
    """
    titled = F.filter(
        docs.sections(F.col("content")),
        lambda s: s["title"].rlike(r"(?i)^(?:反模式|Anti-?patterns?)\z"),
    )
    bullets = F.flatten(
        F.transform(titled, lambda s: F.filter(docs.lines(s["body"]), lambda l: rx.test(l, r"^\s*-")))
    )
    found = layer_docs.select(*KEY, "layer", F.posexplode(bullets).alias("pos", "line"))
    cleaned = found.select(
        *KEY, F.struct("layer", "pos").alias("at"), tr.clean_line(F.col("line")).alias("line")
    ).filter(tr.is_actionable_anti_pattern(F.col("line")))
    return (
        cleaned.select(*KEY, "at", format_anti_pattern(F.col("line")).alias("text"))
        .withColumn("__key", anti_pattern_key(F.col("text")))
        .groupBy(*KEY, "__key")
        .agg(F.min(F.struct("at", "text")).alias("r"))
        .select(*KEY, "r.*")
    )


def never_do(found: DataFrame, limit: int = NEVER_DO_SHOWN) -> DataFrame:
    """(skill, position, text, more): distinct over types, first ``limit``.

    ``more`` is how many were left out, the same on every row of a skill.
    """
    keyed = (
        found.withColumn("__key", anti_pattern_key(F.col("text")))
        .groupBy("skill", "__key")
        .agg(F.min(F.struct("project_type", "at", "text")).alias("r"))
        .select("skill", "r.*")
    )
    totals = keyed.groupBy("skill").agg(F.count(F.lit(1)).alias("__n"))
    shown = top_k(
        keyed, ["skill"], [F.asc("project_type"), F.asc("at"), F.asc("text")], limit,
        unique=["text"], rank="position",
    )
    return shown.join(totals, "skill").select(
        "skill", "position", "text", F.greatest(F.lit(0), F.col("__n") - limit).alias("more")
    )


# ------------------------------------------------------- across the types


def surfaced_texts(type_rules: DataFrame, hard_rules: DataFrame, anti: DataFrame) -> DataFrame:
    """(skill, project_type, kind, text): what the cross-type reports search."""
    part = lambda df, kind: df.select(*KEY, F.lit(kind).alias("kind"), "text")
    return (
        part(type_rules, "type")
        .unionByName(part(hard_rules, "hard"))
        .unionByName(part(anti, "anti"))
    )


def cross_type_patterns(texts: DataFrame, concerns=CONCERNS) -> DataFrame:
    """(skill, position, concern, pattern, types, score): concerns of two or more types.

    Keyword hits are found per text and combined by partial aggregates; the
    texts of a type are never put together.
    """
    words = sorted({w.lower() for _, _, need, some in concerns for w in (*need, *some)})
    lowered = F.lower("text")
    flags = [
        F.bool_or(F.contains(lowered, F.lit(w))).alias(f"w{i}") for i, w in enumerate(words)
    ]
    per_type = texts.groupBy(*KEY).agg(*flags)
    flag = {w: F.col(f"w{i}") for i, w in enumerate(words)}

    def concern(id_: str, summary: str, need: tuple[str, ...], some: tuple[str, ...]) -> Column:
        required = reduce(lambda a, b: a & b, [flag[w.lower()] for w in need])
        hits = reduce(
            lambda a, b: a + b, [flag[w.lower()].cast("int") for w in some], F.lit(0)
        )
        matched = required & (hits > 0) if some else required
        return F.when(
            matched,
            F.struct(
                F.lit(id_).alias("concern"),
                F.lit(summary).alias("pattern"),
                (hits + REQUIRED_POINTS * len(need)).alias("points"),
            ),
        )

    hits = per_type.select(*KEY, F.inline(F.array_compact(F.array(*[concern(*c) for c in concerns]))))
    by_concern = hits.groupBy("skill", "concern", "pattern").agg(
        F.sum("points").alias("score"),
        # one entry per project type of a skill
        F.array_sort(F.collect_set("project_type")).alias("types"),
    ).filter(F.size("types") >= 2)
    # at most one row per concern of the constant catalog
    order = Window.partitionBy("skill").orderBy(F.desc("score"), "pattern")
    return by_concern.withColumn("position", F.row_number().over(order)).filter(
        F.col("position") <= CROSS_SHOWN
    )


def scenario_guide(texts: DataFrame, languages: DataFrame) -> DataFrame:
    """(skill, position, scenario, action, layer): task hints for known types.

    ``languages`` is (skill, project_type, language).
    """
    rules = texts.filter(F.col("kind") != "anti")
    triggers = [
        F.bool_or(F.col("text").rlike(("(?i)" if ci else "") + pattern)).alias(f"t{i}")
        for i, (_, pattern, ci, *_rest) in enumerate(SCENARIOS)
    ]
    typed = languages.groupBy(*KEY).agg(
        F.bool_or(F.col("language").rlike("(?i)typescript")).alias("typed")
    )
    facts = rules.groupBy(*KEY).agg(*triggers).join(typed, list(KEY), "left")
    api = F.when(F.coalesce("typed", F.lit(False)), API_TYPED).otherwise(API_PLAIN)
    rows = [
        F.when(
            (F.col("project_type") == kind) & F.col(f"t{i}"),
            F.struct(
                F.lit(i).alias("ord"),
                F.lit(scene).alias("scenario"),
                (api if action is None else F.lit(action)).alias("action"),
                F.lit(layer).alias("layer"),
            ),
        )
        for i, (kind, _, _, scene, action, layer) in enumerate(SCENARIOS)
    ]
    found = facts.select("skill", F.inline(F.array_compact(F.array(*rows))))
    unique = found.groupBy("skill", "scenario", "action").agg(
        F.min(F.struct("ord", "layer")).alias("r")
    ).select("skill", "scenario", "action", "r.*")
    order = Window.partitionBy("skill").orderBy("ord", "action")
    return (
        unique.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= SCENARIOS_SHOWN)
        .drop("ord")
    )


def decision_tables(layer_docs: DataFrame) -> DataFrame:
    """(skill, project_type, section): decision sections with rows, first per type."""
    found = layer_docs.select(
        *KEY, "layer", docs.decision_table(F.col("content")).alias("section")
    )
    return (
        found.filter(F.col("section") != "")
        .groupBy(*KEY)
        .agg(F.min_by("section", "layer").alias("section"))
    )


# ------------------------------------------------------------------- totals


def catalog_types(catalog: DataFrame) -> DataFrame:
    """Catalog entries with the (skill, project_type) their path names."""
    parts = skill_path_parts(F.col("skill_path"), F.col("language"))
    return catalog.withColumn("__p", parts).select(
        F.col("__p.skill").alias("skill"),
        F.col("__p.overview_type").alias("project_type"),
        "language", "learn_count", "updated_at", "source_projects",
    )


def document_counts(layer_docs: DataFrame) -> DataFrame:
    """(skill, project_type, observed, suggested, residuals)."""
    content = F.col("content")
    per_doc = layer_docs.select(
        *KEY,
        docs.gap_counts(docs.sections(content)).alias("g"),
        docs.speculative_residuals(content).alias("r"),
    )
    return per_doc.groupBy(*KEY).agg(
        F.sum("g.observed").alias("observed"),
        F.sum("g.suggested").alias("suggested"),
        F.sum("r").alias("residuals"),
    )


@dataclass(frozen=True)
class Surfaced:
    """Short tables several reports read, each computed once and written out.

    ``stated`` holds what the documents state: the best ``TYPE_RULES_SHOWN`` rules
    of each reference, their positions as ``at``, where they are asked for, else none.
    """

    stated: DataFrame | None
    raw_type: DataFrame
    raw_hard: DataFrame
    type_rules: DataFrame
    hard_rules: DataFrame
    anti: DataFrame
    templates: DataFrame


def surfaced_rules(
    layer_docs: DataFrame, trace_rules: DataFrame, kinds: Mapping[str, tuple[str, ...]], best: bool
) -> dict[str, DataFrame]:
    """(skill, project_type, at, text) of each kind, of the best stated ones as ``best``.

    Documents are read once, in one job: both take the same rows as they were shuffled.
    """
    stated = report_rules(layer_docs, few_documents(layer_docs))
    rows = marked_rules(trace_rules, stated, kinds)
    if best:
        top = select_top_rules(stated.select(*KEY, "at", "text"), TYPE_RULES_SHOWN)
        at = F.struct(
            F.lit("").alias("layer"), F.col("position").alias("section_pos"),
            F.lit(0).alias("group_pos"), F.lit(0).alias("block_pos"),
        )
        rows = rows.unionByName(top.select(*KEY, F.lit("best").alias("kind"), at.alias("at"), "text"))
    kept = cut_lineage(rows)
    return {k: kept.filter(F.col("kind") == k).drop("kind") for k in (*kinds, *["best"] * best)}


def surface(
    layer_docs: DataFrame, trace_rules: DataFrame, trace_templates: DataFrame, best: bool = False
) -> Surfaced:
    """Rules, anti-patterns and templates of all references, documents read once each.

    ``best``: with the best rules that documents state.
    """
    rules = surfaced_rules(layer_docs, trace_rules, {"type": TYPE_TAGS, "hard": HARD_TAGS}, best)
    return Surfaced(
        rules.get("best"),
        rules["type"],
        rules["hard"],
        cut_lineage(select_top_rules(rules["type"], TYPE_RULES_SHOWN)),
        cut_lineage(select_top_rules(rules["hard"], HARD_RULES_SHOWN)),
        cut_lineage(anti_patterns(layer_docs)),
        cut_lineage(select_top_templates(cut_lineage(template_info(trace_templates, layer_docs)))),
    )


def type_stats(
    catalog: DataFrame, layer_docs: DataFrame, surfaced: Surfaced, evidence: DataFrame
) -> DataFrame:
    """One row per learned type with everything the reports count."""
    entries = catalog_types(catalog)
    heads = entries.groupBy(*KEY).agg(F.max("learn_count").alias("learn_count"))
    projects = (
        entries.select(*KEY, F.explode("source_projects").alias("p"))
        .groupBy(*KEY)
        .agg(F.count_distinct("p").alias("projects"))
    )
    langs = (
        entries.select(*KEY, F.explode(F.split("language", ", ")).alias("l"))
        .groupBy(*KEY)
        .agg(F.array_sort(F.collect_set("l")).alias("languages"))
    )
    count = lambda df, name: df.groupBy(*KEY).agg(F.count(F.lit(1)).alias(name))
    visible = ~F.col("unsafe") & ~F.col("missing") & ~F.col("hidden")
    by_template = surfaced.templates.groupBy(*KEY).agg(
        F.count_if(visible).alias("templates"),
        F.count_if("hidden").alias("hidden_templates"),
        F.count_if("missing").alias("missing_templates"),
        F.count_if("unsafe").alias("unsafe_templates"),
    )
    stats = evidence_stats(evidence, heads, list(KEY)).select(
        *KEY,
        F.col("item_count").alias("evidence_items"),
        F.col("covered_layers").alias("evidence_layers"),
        F.col("low").alias("low_evidence"),
        F.col("missing").alias("evidence_missing"),
    )
    rows = heads
    for side in (
        projects,
        langs,
        count(surfaced.raw_type, "raw_type_rules"),
        count(surfaced.type_rules, "type_rules"),
        count(surfaced.raw_hard, "raw_hard_rules"),
        count(surfaced.hard_rules, "hard_rules"),
        count(surfaced.anti, "anti_patterns"),
        by_template,
        document_counts(layer_docs),
        stats,
    ):
        rows = rows.join(side, list(KEY), "left")
    counted = [
        c for c in rows.columns
        if c not in (*KEY, "languages", "evidence_missing", "learn_count")
    ]
    return rows.select(
        *KEY, "languages", "learn_count",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counted],
        F.coalesce("evidence_missing", F.lit(True)).alias("evidence_missing"),
    )


TOTALS = (
    "raw_type_rules", "type_rules", "hard_rules", "templates", "missing_templates",
    "hidden_templates", "unsafe_templates", "anti_patterns", "residuals", "evidence_items",
    "evidence_layers", "low_evidence",
)


def totals(stats: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per skill: summed type rows and distinct projects."""
    projects = (
        catalog_types(catalog)
        .select("skill", F.explode("source_projects").alias("p"))
        .groupBy("skill")
        .agg(F.count_distinct("p").alias("projects"))
    )
    return (
        stats.groupBy("skill")
        .agg(
            F.count(F.lit(1)).alias("types"),
            *[F.sum(c).alias(c) for c in TOTALS],
            F.count_if("evidence_missing").alias("missing_evidence"),
        )
        .join(projects, "skill", "left")
        .withColumn("projects", F.coalesce("projects", F.lit(0)))
    )


def quality_checks(totals_row: DataFrame, cross: DataFrame) -> DataFrame:
    """(skill, ord, check, level, n): the six checks of a quality report."""
    promoted = cross.groupBy("skill").agg(F.count(F.lit(1)).alias("promoted"))
    rows = totals_row.join(promoted, "skill", "left").withColumn(
        "promoted", F.coalesce("promoted", F.lit(0))
    )

    def check(ord_: int, name: str, n: Column, passes: Column, otherwise: str) -> Column:
        return F.struct(
            F.lit(ord_).alias("ord"),
            F.lit(name).alias("check"),
            F.when(passes, "PASS").otherwise(otherwise).alias("level"),
            n.cast("bigint").alias("n"),
        )

    c = F.col
    hidden = F.greatest(F.lit(0), c("raw_type_rules") - c("type_rules"))
    return rows.select(
        "skill",
        F.inline(
            F.array(
                check(1, "speculative residuals", c("residuals"), c("residuals") == 0, "WARN"),
                check(2, "unsafe templates", c("unsafe_templates"), c("unsafe_templates") == 0, "WARN"),
                check(3, "compressed rules", hidden, hidden == 0, "INFO"),
                check(4, "cross-type patterns", c("promoted"), c("promoted") > 0, "INFO"),
                check(5, "missing evidence", c("missing_evidence"), c("missing_evidence") == 0, "WARN"),
                check(6, "evidence items", c("evidence_items"), c("evidence_items") > 0, "WARN"),
            )
        ),
    )


def master_overview(
    catalog: DataFrame, layer_docs: DataFrame, surfaced: Surfaced, stats: DataFrame
) -> DataFrame:
    """(skill, section, project_type, ord, payload): the entry page as rows."""
    type_rules, hard_rules, anti = surfaced.type_rules, surfaced.hard_rules, surfaced.anti
    shown = surfaced.templates.filter(
        ~F.col("unsafe") & ~F.col("missing") & ~F.col("hidden")
    )
    texts = surfaced_texts(type_rules, hard_rules, anti)
    entries = catalog_types(catalog)
    languages = entries.select(*KEY, F.explode(F.split("language", ", ")).alias("language"))
    tables = decision_tables(layer_docs)
    hints = scenario_guide(texts, languages).join(
        tables.select("skill").distinct(), "skill", "left_anti"
    )
    history = F.concat(
        F.lit("**"), "language", F.lit("** · "), F.col("learn_count").cast("string"), F.lit("x · "),
        F.array_join(F.transform("source_projects", lambda p: F.regexp_extract(p, r"[^/\\]*\z", 0)), ", "),
    )
    index = F.concat_ws(
        " | ", F.array_join("languages", ", "),
        *[F.col(x).cast("string") for x in ("type_rules", "hard_rules", "templates", "hidden_templates", "projects")],
    )
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, section: str, kind: Column | str, ord_: Column | str, payload: Column | str) -> DataFrame:
        col = lambda x: F.col(x) if isinstance(x, str) else x
        return df.select(
            "skill", F.lit(section).alias("section"), col(kind).alias("project_type"),
            col(ord_).cast("bigint").alias("ord"), col(payload).alias("payload"),
        )

    parts = [
        rows(type_rules, "type rules", "project_type", "position", "text"),
        rows(hard_rules, "hard rules", "project_type", "position", "text"),
        rows(cross_type_patterns(texts), "cross-type rules", none, "position",
             F.concat("pattern", F.lit(" ("), F.array_join("types", " + "), F.lit(")"))),
        rows(shown, "templates", "project_type", "pos", F.concat("layer", F.lit(" "), "name")),
        rows(never_do(anti), "never do", none, "position", "text"),
        rows(tables, "scenarios", "project_type", F.lit(0), "section"),
        rows(hints, "scenarios", none, "position", F.concat_ws(" | ", "scenario", "action", "layer")),
        rows(stats, "type index", "project_type", F.lit(0), index),
        rows(entries, "learning history", "project_type", F.lit(0), history),
    ]
    return reduce(DataFrame.unionByName, parts)
