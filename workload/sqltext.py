"""SQL fragments the document checks share.

They follow documents line by line with window functions, which is another
route than the library takes (it cuts text at line starts inside the row).
"""

from __future__ import annotations

# The white-space set of the rules, in RE2 notation.
SPACES = (
    r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
W = f"[{SPACES}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(column: str, pattern: str) -> str:
    """``pattern`` occurs in ``column``; ``\\s`` is the full white-space set."""
    return f"regexp_matches({column}, {q(spaces(pattern))})"


def spaces(pattern: str) -> str:
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(SPACES if in_class else W)
            i += 2
            continue
        if two[:1] == "\\":
            out.append(two)
            i += 2
            continue
        if two[0] in "[]":
            in_class = two[0] == "["
        out.append(two[0])
        i += 1
    return "".join(out)


def sub(column: str, pattern: str, by: str) -> str:
    return f"regexp_replace({column}, {q(spaces(pattern))}, {q(by)}, 'g')"


def trim(column: str) -> str:
    return sub(column, r"^\s+|\s+$", "")


def squeeze(column: str) -> str:
    return sub(column, r"\s+", " ")


def strip_strong(x: str) -> str:
    return sub(x, r"(^|[^/])\*\*", r"\1")


EVIDENCE_STAR = r"(?i)\*?\s*(?:证据|Evidence)[：:][^*]*\*?"
EVIDENCE_BRACKET = r"(?i)[（(]\s*(?:证据|Evidence)[：:][^）)]*[）)]"
ZH_TAGS = r"\[(?:个人偏好|项目特定|必须|推荐|可选)\]"
ALL_TAGS = (
    r"(?i)\s*\[(?:个人偏好|项目特定|必须|推荐|可选|Personal Preference|Project-Specific"
    r"|Must|Recommended|Optional)\]\s*"
)


def clean_body(x: str) -> str:
    x = sub(strip_strong(x), rf"\s*{ZH_TAGS}\s*", " ")
    x = sub(x, "[【】]", " ")
    x = sub(sub(x, EVIDENCE_STAR, " "), EVIDENCE_BRACKET, " ")
    return trim(squeeze(x))


def clean_title(x: str) -> str:
    x = sub(strip_strong(x), r"^\*\*(.+?)\*\*$", r"\1")
    x = sub(x, r"^(?:[-*]|\d+\.)\s+", "")
    x = sub(sub(x, r"\s*\[[^\]]+\]\s*", " "), r"^#+\s+", "")
    return squeeze(trim(x))


def clean_rule(x: str) -> str:
    x = squeeze(sub(sub(x, ALL_TAGS, " "), EVIDENCE_STAR, " "))
    x = sub(sub(x, "：\\s*：+", "："), ":\\s*:+", ":")
    x = sub(x, r"^[\s：:]+", "")
    return trim(sub(x, r"^\[['\"][^\]]+\][：:]\s*", ""))


def clean_line(x: str) -> str:
    x = sub(trim(strip_strong(x)), r"^\*\*(.+?)\*\*$", r"\1")
    x = sub(sub(x, r"^(?:[-*]|\d+\.)\s+", ""), r"^#{1,6}\s+", "")
    x = sub(sub(x, ALL_TAGS, " "), "[【】]", " ")
    x = sub(sub(x, EVIDENCE_STAR, " "), EVIDENCE_BRACKET, " ")
    x = trim(sub(x, r"^\[(.+)\]$", r"\1"))
    x = trim(sub(x, r"^(?:(?:[-*]|\d+\.)\s+)+", ""))
    x = sub(sub(x, r"\s+([：:])\s*", r"\1"), r"([：:])\s*[：:]+", r"\1")
    x = sub(sub(x, r"^[\s：:]+", ""), r"^\[['\"][^\]]+\][：:]\s*", "")
    return trim(squeeze(x))


def normalize(x: str) -> str:
    return trim(squeeze(f"lower({x})"))


def observation(x: str) -> str:
    return "(" + " OR ".join(
        rx(x, p)
        for p in (
            "^⚠️",
            r"(?i)\[待验证\]|To Verify",
            r"(?i)^\*?\s*(?:证据|Evidence)[：:]",
            r"^（?证据[：:]",
            r"未发现|未展示|未出现|未启用|未见|无显式|当前无|不存在|通过文件片段推断|早期分析|L8\s*中提及",
        )
    ) + ")"


def actionable(x: str) -> str:
    return (
        f"(length({x}) > 12 AND NOT {rx(trim(x), '[：:]$')} AND NOT {rx(x, '^#{1,6}' + chr(92) + 's+')}"
        f" AND NOT {rx(trim(x), '^(?:安全|性能|配置管理|CSS 类名|Props 类型声明|组件命名|函数与变量命名)$')}"
        f" AND NOT {rx(x, '推测|可能|未发现|未展示|未出现|未启用|未见|推断|无现有模式|无显式|当前无|不存在|通过文件片段推断|早期分析|L8' + chr(92) + 's*中提及|⚠️|' + chr(92) + '[待验证' + chr(92) + ']')}"
        f" AND NOT {rx(x, '^如[：:]')})"
    )


def usable(x: str) -> str:
    s = chr(92) + "s"
    return (
        f"(length({x}) >= 12 AND NOT {rx(x, '^#{1,6}' + s + '+')}"
        f" AND NOT {rx(trim(x), '(?i)^(?:证据|Evidence)[：:]')}"
        f" AND NOT {rx(x, '(?i)无现有模式|No existing pattern')})"
    )


RESERVED = (
    "scope", "范围", "边界", "rules", "规则", "约定", "conventions", "templates", "template", "模板",
    "anti-patterns", "anti-pattern", "反模式", "evidence", "证据", "gaps", "缺口", "待验证", "to verify",
)
NAMES = {
    "Scope": ("scope", "范围", "边界"),
    "Rules": ("rules", "规则", "约定", "conventions"),
    "Templates": ("templates", "template", "模板"),
    "Anti-patterns": ("anti-patterns", "anti-pattern", "反模式"),
    "Evidence": ("evidence", "证据"),
    "Gaps": ("gaps", "缺口", "待验证", "to verify"),
}


def plain_title(x: str) -> str:
    return f"lower({trim(sub(x, '(?s)[：:].*$', ''))})"


def titled(alias: str, x: str = "title") -> str:
    return rx(x, f"(?i)^{alias}(?:[ \\t]|[：:]|$)")


def lines_cte(source: str, doc: str = "doc_id", extra: str = "") -> str:
    """lines(doc_id, n, line, t, boundary section number); secs(doc_id, sid, title)."""
    boundary = rx("line", r"^(?:###?\s+|---\s*$)")
    head = rx("line", r"^###\s+\S")
    return f"""
raw_lines AS (
  SELECT {doc}{extra}, unnest(l) AS line, generate_subscripts(l, 1) AS n
  FROM (SELECT {doc}{extra}, string_split(content, chr(10)) AS l FROM {source}) s),
lines AS (
  SELECT *, {trim('line')} AS t,
    count(*) FILTER ({boundary}) OVER (PARTITION BY {doc} ORDER BY n ROWS UNBOUNDED PRECEDING) AS sid,
    {head} AS is_head FROM raw_lines),
secs AS (
  SELECT {doc}{extra}, sid, n AS head_n, {trim(sub('line', r'^###\s+', ''))} AS title FROM lines WHERE is_head),
body_lines AS (
  SELECT l.* EXCLUDE (is_head), s.title, s.head_n FROM lines l JOIN secs s USING ({doc}, sid) WHERE l.n > s.head_n)"""


HEADING = (
    "(NOT " + rx("t", r"^#{1,3}\s+")
    + " AND NOT " + rx("t", r"(?i)^(?:\*\*)?(?:证据|Evidence)(?:\*\*)?[：:]")
    + " AND (" + rx("t", rf"^(?:{ZH_TAGS}\s*)+$") + " OR " + rx("t", r"^####\s+") + " OR " + rx("t", r"^\*\*.+\*\*") + "))"
)
ITEM = rx("line", r"^\s?(?:[-*]|\d+\.)\s+")
STOP = "(" + rx("t", r"^###\s+") + " OR " + rx("t", r"^---\s*$") + ")"


def blocks_cte(bodies: str) -> str:
    """blk: lines of list blocks; ``bodies`` is (doc_id, ord, title, sid)."""
    return f"""
marked AS (
  SELECT b.doc_id, b.ord, b.title AS fallback, l.n, l.line, l.t,
    starts_with(l.t, '```') AS fence,
    count(*) FILTER (starts_with(l.t, '```')) OVER (PARTITION BY b.doc_id, b.ord ORDER BY l.n ROWS UNBOUNDED PRECEDING) % 2 = 1 AS odd
  FROM ({bodies}) b JOIN body_lines l ON l.doc_id = b.doc_id AND l.sid = b.sid),
typed AS (
  SELECT *, CASE WHEN fence OR odd OR t = '' THEN NULL WHEN {HEADING} THEN 'H' WHEN {ITEM} THEN 'I' WHEN {STOP} THEN 'S' END AS kind
  FROM marked),
filled AS (
  SELECT *, last_value(CASE WHEN kind = 'H' THEN {sub('t', r'^####' + chr(92) + 's+', '')} END IGNORE NULLS) OVER w AS heading_line,
    last_value(kind IGNORE NULLS) OVER w AS state,
    max(CASE WHEN kind IS NOT NULL THEN n END) OVER w AS start_n
  FROM typed WINDOW w AS (PARTITION BY doc_id, ord ORDER BY n ROWS UNBOUNDED PRECEDING)),
blk AS (
  SELECT doc_id, ord, start_n, n, line, t, coalesce(heading_line, fallback) AS heading FROM filled WHERE state = 'I')"""
