"""Queries over surfaced rules, templates and totals of references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitus.operators import overview as ov
from habitus.operators import trace as tr
from habitus.session import cut_lineage
from workload import documents as wd
from workload import sqltext as s
from workload.documents import KEY
from workload.sqltext import q, rx, sub, trim

# Concerns with words that occur in the driver's text, next to the shipped ones.
CONCERNS = [
    *ov.CONCERNS,
    ("shared-state", "State lives in stores", ("store",), ("Pinia", "modules")),
    ("naming", "Names are kept", ("names",), ()),
    ("articles", "The article", ("the", "and"), ("ation", "tion", "zzz")),
]


def _trace(spark: SparkSession, sf: str, evidence: DataFrame | None = None) -> DataFrame:
    """Traces whose rules of every second reference carry tags."""
    found = wd.doc_evidence(spark, sf, stored=True) if evidence is None else evidence
    rules = tr.trace_rules(wd.layer_docs(spark, sf), found)
    even = F.substring("skill", 6, 9).cast("int") % 2 == 0
    tags = (
        F.when(even & (F.col("pos") % 5 == 0), F.array(F.lit("[Must]")))
        .when(even & (F.col("pos") % 5 == 1), F.array(F.lit("[个人偏好]"), F.lit("[必须]")))
        .otherwise(F.col("tags"))
    )
    return rules.withColumn("tags", tags)


def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    """One catalog entry per reference, from its first document."""
    first = wd.layer_docs(spark, sf).groupBy(*KEY, "project").agg(F.min("doc_id").alias("d"))
    language = (
        F.when(F.col("d") % 3 == 0, "typescript, vue").when(F.col("d") % 3 == 1, "java").otherwise("go, config")
    )
    return first.select(
        F.concat_ws("/", *KEY).alias("lock_key"),
        language.alias("language"),
        (F.col("d") % 4 + 1).alias("learn_count"),
        F.timestamp_seconds(F.col("d") * 60).alias("updated_at"),
        F.array(
            F.concat(F.lit("/w/"), "project"), F.concat(F.lit("/w/p"), (F.col("d") % 3).cast("string"))
        ).alias("source_projects"),
        F.concat(F.col("skill"), F.lit("/reference/"), F.col("project_type"), F.lit("/")).alias("skill_path"),
    )


def report_rules(spark: SparkSession, sf: str) -> DataFrame:
    return ov.report_rules(wd.layer_docs(spark, sf)).select(
        *KEY, "text", F.array_join("tags", "|").alias("tags")
    )


def tagged_rules(spark: SparkSession, sf: str) -> DataFrame:
    d = wd.layer_docs(spark, sf)
    stated = ov.report_rules(d, ov.few_documents(d))
    rules = ov.marked_rules(_trace(spark, sf), stated, {"type": ov.TYPE_TAGS, "hard": ov.HARD_TAGS})
    return rules.select(*KEY, "kind", "text")


def rule_scores(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return ov.report_rules(wd.layer_docs(spark, sf)).select(
        *KEY, "text", ov.score_rule(text).cast("bigint").alias("score"),
        ov.categorize_rule(text).alias("category"), ov.rule_key(text).alias("rule_key"),
    )


def _all_rules(spark: SparkSession, sf: str) -> DataFrame:
    return ov.report_rules(wd.layer_docs(spark, sf)).select(*KEY, "at", "text")


def dedupe_near_rules(spark: SparkSession, sf: str) -> DataFrame:
    return ov.dedupe_near_rules(_all_rules(spark, sf)).select(
        *KEY, "text", F.col("score").cast("bigint").alias("score")
    )


def select_top_rules(spark: SparkSession, sf: str) -> DataFrame:
    return ov.select_top_rules(_all_rules(spark, sf), ov.TYPE_RULES_SHOWN).select(
        *KEY, F.col("position").cast("bigint").alias("position"), "text"
    )


def _templates(spark: SparkSession, sf: str) -> DataFrame:
    d = wd.layer_docs(spark, sf)
    traced = cut_lineage(tr.trace_templates(d, wd.doc_evidence(spark, sf)))
    # short rows, read three times: to pick the best, to name them, to mark the others
    return ov.select_top_templates(cut_lineage(ov.template_info(traced, d)), 2)


def select_top_templates(spark: SparkSession, sf: str) -> DataFrame:
    return _templates(spark, sf).select(
        *KEY, F.col("pos").cast("bigint").alias("pos"), "layer", "name", "unsafe", "missing", "hidden"
    )


def read_templates(spark: SparkSession, sf: str) -> DataFrame:
    d = wd.layer_docs(spark, sf)
    none = tr.trace_templates(d, wd.doc_evidence(spark, sf)).filter(F.lit(False))
    return ov.template_info(none, d).withColumn("pos", F.col("pos").cast("bigint"))


def anti_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return ov.anti_patterns(wd.layer_docs(spark, sf)).select(*KEY, "text")


def never_do(spark: SparkSession, sf: str) -> DataFrame:
    return ov.never_do(ov.anti_patterns(wd.layer_docs(spark, sf)), 3).select(
        "skill", F.col("position").cast("bigint").alias("position"), "text", F.col("more").cast("bigint").alias("more")
    )


def _texts(spark: SparkSession, sf: str, surfaced: ov.Surfaced | None = None) -> DataFrame:
    """Texts the cross-type reports search; documents are read once for stated rules."""
    if surfaced is not None:
        top = ov.select_top_rules(surfaced.stated.select(*KEY, "at", "text"), ov.TYPE_RULES_SHOWN)
        return ov.surfaced_texts(top, surfaced.hard_rules, surfaced.anti)
    d = wd.layer_docs(spark, sf)
    rules = ov.surfaced_rules(d, _trace(spark, sf), {"hard": ov.HARD_TAGS}, best=True)
    hard = ov.select_top_rules(rules["hard"], ov.HARD_RULES_SHOWN)
    return ov.surfaced_texts(rules["best"], hard, ov.anti_patterns(d))


def cross_type_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return ov.cross_type_patterns(_texts(spark, sf), CONCERNS).select(
        "skill", F.col("position").cast("bigint").alias("position"), "pattern",
        F.array_join("types", "|").alias("types"), F.col("score").cast("bigint").alias("score"),
    )


def scenario_guide(spark: SparkSession, sf: str) -> DataFrame:
    langs = ov.catalog_types(_catalog(spark, sf)).select(
        *KEY, F.explode(F.split("language", ", ")).alias("language")
    )
    return ov.scenario_guide(_texts(spark, sf), langs).withColumn(
        "position", F.col("position").cast("bigint")
    )


def decision_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a decision section: with rows, without, or cut by a heading."""
    tail = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\n## Decision Heuristics\n| Scenario | Do |\n|---|---|\n| "), "layer", F.lit(" | x |\n\n## Log\n| a |")))
        .when(F.col("doc_id") % 3 == 1, "\n## 决策启发式\n\n| 场景 | 做法 |\n|---|---|\n")
        .otherwise("")
    )
    d = wd.layer_docs(spark, sf).withColumn("content", F.concat("content", tail))
    return ov.decision_tables(d)


def document_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ov.document_counts(wd.layer_docs(spark, sf))


def _reports(
    spark: SparkSession, sf: str, best: bool = False
) -> tuple[DataFrame, DataFrame, ov.Surfaced, DataFrame]:
    """Documents, catalog, surfaced tables and type rows, shared inputs written once."""
    d, e = wd.layer_docs(spark, sf), wd.doc_evidence(spark, sf, stored=True)
    named = tr.trace_templates(d, e).select(*KEY, "pos", "layer", "name", "status")
    surfaced = ov.surface(d, _trace(spark, sf, e), cut_lineage(named), best)
    catalog = _catalog(spark, sf)
    return d, catalog, surfaced, ov.type_stats(catalog, d, surfaced, e)


def type_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf)[3].withColumn("languages", F.array_join("languages", "|"))


def quality_totals(spark: SparkSession, sf: str) -> DataFrame:
    _, catalog, _, stats = _reports(spark, sf)
    return ov.totals(stats, catalog)


def quality_checks(spark: SparkSession, sf: str) -> DataFrame:
    _, catalog, surfaced, stats = _reports(spark, sf, best=True)
    cross = ov.cross_type_patterns(_texts(spark, sf, surfaced), CONCERNS)
    return ov.quality_checks(ov.totals(stats, catalog), cross).withColumn(
        "ord", F.col("ord").cast("bigint")
    )


def master_overview(spark: SparkSession, sf: str) -> DataFrame:
    d, catalog, surfaced, stats = _reports(spark, sf)
    return ov.master_overview(catalog, d, surfaced, stats)


QUERIES = {
    f.__name__: f
    for f in (
        report_rules, tagged_rules, rule_scores, dedupe_near_rules, select_top_rules, select_top_templates,
        read_templates, anti_patterns, never_do, cross_type_patterns, scenario_guide, decision_tables,
        document_counts, type_stats, quality_totals, quality_checks, master_overview,
    )
}

# ----------------------------------------------------------------- SQL side

_BS = chr(92)
_LOOSE = s.plain_title(sub("title", r"^⚠️\s*", ""))
_RULES = "('rules', '规则', '约定', 'conventions')"
_REPORT_BODIES = (
    f"SELECT doc_id, sid AS ord, CASE WHEN {_LOOSE} IN {_RULES} THEN '' ELSE title END AS title, sid FROM secs"
    f" WHERE {_LOOSE} IN {_RULES} OR NOT ({_LOOSE} IN ({', '.join(map(q, s.RESERVED))})"
    f" OR {sub(_LOOSE, '[-' + _BS + 's]+', ' ')} IN ({', '.join(map(q, s.RESERVED))}))"
)


def short_key(x: str) -> str:
    return f"left({s.squeeze(f'lower({x})')}, 120)"


_PART = s.clean_line(trim(sub("t", r"^(?:[-*]|\d+\.)\s+(?:[-*]\s+)?", "")))
_TAGS_OF = f"list_concat(regexp_extract_all(first(heading), '\\[[^\\]\\n]+\\]'), coalesce(flatten(list(regexp_extract_all(line, '\\[[^\\]\\n]+\\]') ORDER BY n)), []))"
REPORT = f"""{wd.LINES},{s.blocks_cte(_REPORT_BODIES)},
rp AS (
  SELECT doc_id, ord, start_n, list(c ORDER BY n) AS parts FROM (
    SELECT doc_id, ord, start_n, n, {_PART} AS c FROM blk WHERE t <> '' AND NOT starts_with(t, '```')) r
  WHERE c <> '' AND NOT {s.observation('c')} GROUP BY ALL),
rt AS (SELECT doc_id, ord, start_n, {_TAGS_OF} AS tg FROM blk GROUP BY ALL),
ru AS (SELECT doc_id, ord, start_n, list_filter(tg, lambda x, i: list_position(tg, x) = i) AS tg FROM rt),
rn AS (SELECT doc_id, ord, start_n, CASE WHEN len(list_filter(tg, lambda x: regexp_matches(x, '(?i){tr.SCOPE_TAG}'))) = 0
     AND len(list_filter(tg, lambda x: regexp_matches(x, '(?i){tr.CONFIDENCE_TAG}'))) > 0
     THEN list_concat(['[项目特定]'], tg) ELSE tg END AS tags FROM ru),
ri AS (SELECT doc_id, ord, start_n, {s.clean_line('heading')} AS gt, {wd._ITEM_TEXT} AS raw FROM blk WHERE n = start_n),
rj AS (SELECT *, {s.clean_line('raw')} AS it FROM ri JOIN rn USING (doc_id, ord, start_n) JOIN rp USING (doc_id, ord, start_n)),
rk AS (SELECT *, {short_key('it')} = {short_key('gt')} AS same, len(parts) > 1 AND (regexp_matches(raw, '^\\*\\*.+\\*\\*') OR length(it) <= 28
     OR {short_key('it')} = {short_key('gt')}) AS fit FROM rj),
rl0 AS (SELECT *, CASE WHEN fit THEN CASE WHEN same OR it = '' THEN gt WHEN gt = '' THEN it ELSE gt || ' / ' || it END
     WHEN len(regexp_extract_all(raw, '\\[[^\\]\\n]+\\]')) = 0 THEN gt ELSE '' END AS ttl,
     {trim(s.squeeze("array_to_string(CASE WHEN fit THEN parts[2:] ELSE parts END, ' ')"))} AS body FROM rk),
rr AS (SELECT d.skill, d.project_type, (d.layer, l.ord, l.start_n) AS pos_at, tags,
     {s.clean_line("CASE WHEN ttl <> '' THEN ttl || '：' || body ELSE body END")} AS text
  FROM rl0 l JOIN v_layer_docs d ON d.doc_id = l.doc_id WHERE body <> ''),
report0 AS (SELECT skill, project_type, arg_min(pos_at, pos_at) AS pos_at, arg_min(text, pos_at) AS text, arg_min(tags, pos_at) AS tags
  FROM (SELECT *, {short_key('text')} AS k FROM rr) x GROUP BY skill, project_type, k)"""

_SCORE = " + ".join(
    [f"CASE WHEN regexp_matches(text, {q('(?i)' + p)}) THEN {w} ELSE 0 END" for p, w in ov.RULE_WEIGHTS]
    + [
        "CASE WHEN length(text) <= 140 THEN 12 ELSE 0 END", "CASE WHEN length(text) > 220 THEN -15 ELSE 0 END",
        "CASE WHEN length(text) > 320 THEN -30 ELSE 0 END",
        f"CASE WHEN regexp_matches(text, {q(ov.LIBRARY_TALK[0])}) THEN -8 ELSE 0 END",
    ]
)
_CATEGORY = "CASE " + " ".join(
    f"WHEN regexp_matches(text, {q('(?i)' + p)}) THEN {q(n)}" for p, n in ov.RULE_CATEGORIES
) + " ELSE 'other' END"
_PLAIN = s.squeeze(sub("lower(text)", ov.QUOTES, ""))
_RULE_KEY = "CASE " + " ".join(
    "WHEN " + " AND ".join(rx(_PLAIN, p) for p in ps) + f" THEN {q(n)}" for n, ps in ov.RULE_TOPICS
) + f" ELSE {short_key('text')} END"


def ranked(source: str, name: str, limit: int) -> str:
    """Greedy selection over near-distinct rules, as SQL CTEs."""
    return f"""
{name}_n AS (SELECT * FROM (SELECT skill, project_type, pos_at, text, score, row_number() OVER (PARTITION BY skill, project_type, k ORDER BY score DESC, length(text) DESC, pos_at) AS r
   FROM (SELECT *, {_SCORE} AS score, {_RULE_KEY} AS k FROM {source}) x) y WHERE r = 1),
{name}_r AS (SELECT *, count(*) OVER (PARTITION BY skill, project_type) AS n,
   row_number() OVER (PARTITION BY skill, project_type, cat ORDER BY score DESC, pos_at) AS c FROM (SELECT *, {_CATEGORY} AS cat FROM {name}_n) x),
{name}_p AS (SELECT *, row_number() OVER (PARTITION BY skill, project_type ORDER BY CASE WHEN n > {limit} AND c > 4 THEN 1 ELSE 0 END, score DESC, pos_at) AS pick FROM {name}_r),
{name} AS (SELECT skill, project_type, text, row_number() OVER (PARTITION BY skill, project_type ORDER BY pos_at) AS position FROM {name}_p WHERE pick <= {limit})"""


def tagged(name: str, tags: tuple[str, ...]) -> str:
    equivalents = [tuple(t.lower() for t in tr.TAG_EQUIVALENTS[t]) for t in tags]
    traced = " AND ".join(
        f"len(list_filter(nt, lambda x: lower(x) IN ({', '.join(map(q, e))}))) > 0" for e in equivalents
    )
    stated = " AND ".join(f"list_contains(tags, {q(t)})" for t in tags)
    return f"""
{name}_t AS (SELECT skill, project_type, min(('', k, 0)) AS pos_at, text FROM (
   SELECT skill, project_type, k, {s.clean_line('text')} AS text, CASE WHEN len(tg) > 0 AND len(list_filter(tg, lambda x: regexp_matches(x, '(?i){tr.SCOPE_TAG}'))) = 0
       AND len(list_filter(tg, lambda x: regexp_matches(x, '(?i){tr.CONFIDENCE_TAG}'))) > 0 THEN list_concat(['[项目特定]'], tg) ELSE tg END AS nt
   FROM xtrace WHERE status = 'active' AND (len(files) > 0 OR len(ids) > 0)) x WHERE {traced} AND {s.actionable('text')} GROUP BY skill, project_type, text),
{name} AS (SELECT skill, project_type, pos_at, text FROM {name}_t UNION ALL
   SELECT skill, project_type, min(pos_at), text FROM report0 r WHERE {stated} AND NOT contains(text, '[待验证]') AND {s.actionable('text')}
     AND NOT EXISTS (SELECT 1 FROM {name}_t t WHERE t.skill = r.skill AND t.project_type = r.project_type) GROUP BY skill, project_type, text)"""


# both rule pipelines in one statement: the shared CTE names are prefixed in one of them
def _prefixed(text: str, names: tuple[str, ...], mark: str) -> str:
    import re

    for name in names:
        text = re.sub(rf"\b{name}\b", mark + name, text)
    return text


_BLOCK_NAMES = ("marked", "typed", "filled", "blk")
_TRACE_TAIL = _prefixed(wd.TRACE[len(wd.LINES):], _BLOCK_NAMES, "t_")
XTRACE = f"""
xtrace AS (SELECT skill, project_type, layer, k, text, files, ids, status, CASE WHEN CAST(skill[6:] AS INT) % 2 = 0 AND k % 5 = 0 THEN ['[Must]']
   WHEN CAST(skill[6:] AS INT) % 2 = 0 AND k % 5 = 1 THEN ['[个人偏好]', '[必须]'] ELSE tags END AS tg FROM (
   SELECT t.*, CAST(regexp_extract(id, '-r(\\d+)$', 1) AS BIGINT) AS k FROM trace t) x)"""
BOTH = f"{REPORT}{_TRACE_TAIL}, {XTRACE}, {tagged('typed_rules', ov.TYPE_TAGS)}, {tagged('hard_rules', ov.HARD_TAGS)}"

_AP_BODY = f"""
ap0 AS (SELECT l.doc_id, l.sid, n, line FROM body_lines l WHERE regexp_matches(title, '(?i)^(?:反模式|Anti-?patterns?)$')),
ap1 AS (SELECT d.skill, d.project_type, (d.layer, sid, n) AS pos_at, {s.clean_line('line')} AS line FROM ap0 a JOIN v_layer_docs d ON d.doc_id = a.doc_id
  WHERE {rx('line', r'^' + _BS + 's*-')}),
ap2 AS (SELECT skill, project_type, pos_at, {trim(sub(sub('line', r'^[❌✗×xX]\s*', ''), r'^[🚫⚠️]\s*', ''))} AS b, line FROM ap1
  WHERE {s.actionable('line')} AND NOT regexp_matches(line, '建议|推荐使用|可考虑|待验证')),
ap3 AS (SELECT skill, project_type, pos_at, CASE WHEN b <> '' THEN '❌ ' || b ELSE line END AS text FROM ap2),
ap4 AS (SELECT *, {trim(s.squeeze(sub(sub('lower(text)', r'^[❌✗×xX🚫⚠️\s]+', ''), ov.QUOTES, '')))} AS p FROM ap3),
ap5 AS (SELECT *, CASE WHEN regexp_matches(p, {q('(?i)' + ov.ANTI_PATTERN_TOPICS[0][1].replace(_BS + '/', '/'))}) THEN 'hardcoded-backend-url'
  WHEN regexp_matches(p, {q('(?i)' + ov.ANTI_PATTERN_TOPICS[1][1])}) THEN 'direct-state-mutation' ELSE left(p, 120) END AS k FROM ap4),
ap AS (SELECT skill, project_type, k, min(pos_at) AS pos_at, arg_min(text, pos_at) AS text FROM ap5 GROUP BY ALL)"""

_NUM = "CASE WHEN layer ~ '^L[1-8]$' THEN 20 - CAST(layer[2:] AS INT) ELSE 0 END"
_TSCORE = _NUM + "".join(
    f" + CASE WHEN regexp_matches(name, {q(p)}) THEN {n} ELSE 0 END" for p, n in ov.TEMPLATE_POINTS
)


def shown_templates(limit: int) -> str:
    return f"""
ti AS (SELECT skill, project_type, layer, name, status = 'pending' AS unsafe, status = 'missing' AS missing,
    CAST(regexp_extract(id, '-t(\\d+)$', 1) AS BIGINT) AS pos FROM (SELECT * REPLACE ({wd._tname('name')} AS name) FROM ttrace) x),
tk AS (SELECT DISTINCT skill, project_type, layer, name FROM (SELECT *, row_number() OVER (PARTITION BY skill, project_type ORDER BY {_TSCORE} DESC, pos) AS r
    FROM ti WHERE NOT unsafe AND NOT missing) x WHERE r <= {limit}),
tshow AS (SELECT i.*, NOT unsafe AND NOT missing AND k.skill IS NULL AS hidden FROM ti i LEFT JOIN tk k USING (skill, project_type, layer, name))"""


_CAT = """
docs_first AS (SELECT skill, project_type, project, min(doc_id) AS d FROM v_layer_docs GROUP BY ALL),
cat AS (SELECT skill, project_type, d, CASE WHEN d % 3 = 0 THEN 'typescript, vue' WHEN d % 3 = 1 THEN 'java' ELSE 'go, config' END AS language,
   d % 4 + 1 AS learn_count, ['/w/' || project, '/w/p' || d % 3] AS source_projects FROM docs_first)"""
_ALL = f"all_rules AS (SELECT skill, project_type, pos_at, text FROM report0), {ranked('all_rules', 'top_rules', ov.TYPE_RULES_SHOWN)}"
_HARD = f"{BOTH}, {ranked('hard_rules', 'top_hard', ov.HARD_RULES_SHOWN)}"
TEXTS = f"""{_ALL}, {_AP_BODY},
texts AS (SELECT skill, project_type, 'type' AS kind, text FROM top_rules UNION ALL SELECT skill, project_type, 'hard', text FROM top_hard
  UNION ALL SELECT skill, project_type, 'anti', text FROM ap)"""


def cross_cte(concerns, source: str = "texts") -> str:
    arms = []
    for _, summary, need, some in concerns:
        hits = " + ".join(f"CASE WHEN contains(h, {q(w.lower())}) THEN 1 ELSE 0 END" for w in some) or "0"
        cond = " AND ".join(f"contains(h, {q(w.lower())})" for w in need)
        arms.append(
            f"SELECT skill, project_type, {q(summary)} AS pattern, {3 * len(need)} + {hits} AS pts FROM hay WHERE {cond}"
            + (f" AND {hits} > 0" if some else "")
        )
    return f"""hay AS (SELECT skill, project_type, lower(string_agg(text, chr(10))) AS h FROM {source} GROUP BY ALL),
cr AS (SELECT skill, pattern, sum(pts) AS score, string_agg(project_type, '|' ORDER BY project_type) AS types FROM ({' UNION ALL '.join(arms)}) x
  GROUP BY ALL HAVING count(*) >= 2),
crossed AS (SELECT * FROM (SELECT skill, row_number() OVER (PARTITION BY skill ORDER BY score DESC, pattern) AS position, pattern, types, CAST(score AS BIGINT) AS score FROM cr) x WHERE position <= 8)"""


def scenario_cte(source: str = "texts") -> str:
    arms = " UNION ALL ".join(
        f"SELECT skill, project_type, {i} AS ord, {q(scene)} AS scenario, "
        + (f"CASE WHEN ts THEN {q(ov.API_TYPED)} ELSE {q(ov.API_PLAIN)} END" if action is None else q(action))
        + f" AS action, {q(layer)} AS layer FROM facts WHERE project_type = {q(kind)} AND regexp_matches(h, {q(('(?i)' if ci else '') + p)})"
        for i, (kind, p, ci, scene, action, layer) in enumerate(ov.SCENARIOS)
    )
    return f"""facts AS (SELECT t.skill, t.project_type, string_agg(text, chr(10)) AS h, bool_or(contains(c.language, 'typescript')) AS ts
   FROM {source} t LEFT JOIN cat c ON c.skill = t.skill AND c.project_type = t.project_type WHERE kind <> 'anti' GROUP BY ALL),
sg AS (SELECT skill, scenario, action, min(ord) AS ord, arg_min(layer, ord) AS layer FROM ({arms}) x GROUP BY ALL),
scen AS (SELECT * FROM (SELECT skill, row_number() OVER (PARTITION BY skill ORDER BY ord, action) AS position, scenario, action, layer FROM sg) x WHERE position <= 8)"""


_CHECKS_SQL = wd.ORACLES["document_checks"]
_DC = f"dc AS (SELECT * FROM ({_CHECKS_SQL}) z)"
STATS = f"""{BOTH}, {ranked('typed_rules', 'top_type', ov.TYPE_RULES_SHOWN)}, {ranked('hard_rules', 'top_hard', ov.HARD_RULES_SHOWN)}, {_AP_BODY},
{wd.TEMPLATES}, {wd.TTRACE}, {shown_templates(8)}, {_CAT}, {_DC},
dcs AS (SELECT skill, project_type, sum(observed) AS observed, sum(suggested) AS suggested, sum(residuals) AS residuals FROM dc JOIN v_layer_docs USING (doc_id) GROUP BY ALL),
es AS (SELECT skill, project_type, count(*) AS n, count(DISTINCT layer) AS l, count(*) FILTER (confidence = 'low') AS low FROM dev GROUP BY ALL),
tst AS (SELECT skill, project_type, count(*) FILTER (NOT unsafe AND NOT missing AND NOT hidden) AS templates, count(*) FILTER (hidden) AS hidden_templates,
   count(*) FILTER (missing) AS missing_templates, count(*) FILTER (unsafe) AS unsafe_templates FROM tshow GROUP BY ALL),
cnt AS (SELECT skill, project_type, count(*) FILTER (k = 1) AS a, count(*) FILTER (k = 2) AS b, count(*) FILTER (k = 3) AS c, count(*) FILTER (k = 4) AS d, count(*) FILTER (k = 5) AS e FROM (
   SELECT skill, project_type, 1 AS k FROM typed_rules UNION ALL SELECT skill, project_type, 2 FROM top_type UNION ALL SELECT skill, project_type, 3 FROM hard_rules
   UNION ALL SELECT skill, project_type, 4 FROM top_hard UNION ALL SELECT skill, project_type, 5 FROM ap) x GROUP BY ALL),
stats AS (SELECT c.skill, c.project_type, array_to_string(list_sort(string_split(c.language, ', ')), '|') AS languages, c.learn_count,
   len(list_distinct(c.source_projects)) AS projects, coalesce(a, 0) AS raw_type_rules, coalesce(b, 0) AS type_rules, coalesce(cnt.c, 0) AS raw_hard_rules,
   coalesce(cnt.d, 0) AS hard_rules, coalesce(e, 0) AS anti_patterns, coalesce(templates, 0) AS templates, coalesce(hidden_templates, 0) AS hidden_templates,
   coalesce(missing_templates, 0) AS missing_templates, coalesce(unsafe_templates, 0) AS unsafe_templates, CAST(coalesce(observed, 0) AS BIGINT) AS observed,
   CAST(coalesce(suggested, 0) AS BIGINT) AS suggested, CAST(coalesce(residuals, 0) AS BIGINT) AS residuals, coalesce(es.n, 0) AS evidence_items,
   coalesce(l, 0) AS evidence_layers, coalesce(low, 0) AS low_evidence, es.n IS NULL AS evidence_missing
 FROM cat c LEFT JOIN cnt USING (skill, project_type) LEFT JOIN tst USING (skill, project_type) LEFT JOIN dcs USING (skill, project_type) LEFT JOIN es USING (skill, project_type)),
pj AS (SELECT skill, count(DISTINCT p) AS projects FROM (SELECT skill, unnest(source_projects) AS p FROM cat) x GROUP BY ALL),
tot AS (SELECT s.skill, count(*) AS types, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ov.TOTALS)}, count(*) FILTER (evidence_missing) AS missing_evidence,
   first(pj.projects) AS projects FROM stats s JOIN pj USING (skill) GROUP BY s.skill)"""
_MASTER_TEXTS = """mtexts AS (SELECT skill, project_type, 'type' AS kind, text FROM top_type UNION ALL SELECT skill, project_type, 'hard', text FROM top_hard
  UNION ALL SELECT skill, project_type, 'anti', text FROM ap)"""


def _never(limit: int) -> str:
    return f"""nd AS (SELECT skill, k, arg_min(text, (project_type, pos_at)) AS text, min((project_type, pos_at)) AS o FROM ap GROUP BY ALL),
never AS (SELECT * FROM (SELECT skill, row_number() OVER (PARTITION BY skill ORDER BY o, text) AS position, text,
   greatest(0, count(*) OVER (PARTITION BY skill) - {limit}) AS more FROM nd) x WHERE position <= {limit})"""


ORACLES = {
    "report_rules": f"{REPORT} SELECT skill, project_type, text, array_to_string(tags, '|') AS tags FROM report0",
    "tagged_rules": f"""{BOTH} SELECT skill, project_type, 'type' AS kind, text FROM typed_rules
      UNION ALL SELECT skill, project_type, 'hard', text FROM hard_rules""",
    "rule_scores": f"{REPORT} SELECT skill, project_type, text, {_SCORE} AS score, {_CATEGORY} AS category, {_RULE_KEY} AS rule_key FROM report0",
    "dedupe_near_rules": f"{REPORT}, {_ALL} SELECT skill, project_type, text, score FROM top_rules_n",
    "select_top_rules": f"{REPORT}, {_ALL} SELECT skill, project_type, position, text FROM top_rules",
    "select_top_templates": f"{wd.LINES}, {wd.EVIDENCE}, {wd.TEMPLATES}, {wd.TTRACE}, {shown_templates(2)} SELECT skill, project_type, pos, layer, name, unsafe, missing, hidden FROM tshow",
    "read_templates": f"""{wd.LINES}, {wd.TEMPLATES}, x AS (SELECT t.skill, t.project_type, t.layer, t.name, t.pos, contains(t.name, '无现有模式') OR
        (t.status = 'missing' AND NOT regexp_matches(t.name, '(?i)无现有模式|No existing pattern')) OR (regexp_matches(t.name, '(?i)No existing pattern') AND
        regexp_matches(t.body, '(?i)无现有模式|No existing pattern') AND NOT contains(t.body, '```')) AS missing, t.body FROM tplx t)
      SELECT skill, project_type, row_number() OVER (PARTITION BY skill, project_type ORDER BY layer, pos) AS pos, layer, name,
        NOT missing AND (regexp_matches(body, {q(ov.UNSAFE_TEMPLATE)}) OR regexp_matches(body, {q(r'(?i)\b(' + ov.TOOL_NAMES + r')\b')})) AS unsafe, missing FROM x""",
    "anti_patterns": f"{wd.LINES}, {_AP_BODY} SELECT skill, project_type, text FROM ap",
    "never_do": f"{wd.LINES}, {_AP_BODY}, {_never(3)} SELECT * FROM never",
    "cross_type_patterns": f"{_HARD}, {TEXTS}, {cross_cte(CONCERNS)} SELECT * FROM crossed",
    "scenario_guide": f"{_HARD}, {TEXTS}, {_CAT}, {scenario_cte()} SELECT * FROM scen",
    "decision_tables": f"""WITH {wd.DOCS} SELECT skill, project_type, '## Decision Heuristics' || chr(10) || '| Scenario | Do |' || chr(10) || '|---|---|' || chr(10)
      || '| ' || min(layer) || ' | x |' AS section FROM v_layer_docs WHERE doc_id % 3 = 0 GROUP BY ALL""",
    "document_counts": f"""SELECT skill, project_type, CAST(sum(observed) AS BIGINT) AS observed, CAST(sum(suggested) AS BIGINT) AS suggested,
      CAST(sum(residuals) AS BIGINT) AS residuals FROM ({_CHECKS_SQL}) c JOIN ({wd.DOCS[len('v_layer_docs AS '):]}) d ON c.doc_id = d.doc_id GROUP BY ALL""",
    "type_stats": f"{STATS} SELECT * FROM stats",
    "quality_totals": f"{STATS} SELECT * FROM tot",
    "quality_checks": f"""{STATS}, all_rules AS (SELECT skill, project_type, pos_at, text FROM report0), {ranked('all_rules', 'top_rules', ov.TYPE_RULES_SHOWN)},
      texts AS (SELECT skill, project_type, 'type' AS kind, text FROM top_rules UNION ALL SELECT skill, project_type, 'hard', text FROM top_hard
      UNION ALL SELECT skill, project_type, 'anti', text FROM ap), {cross_cte(CONCERNS)},
      pr AS (SELECT t.*, (SELECT count(*) FROM crossed c WHERE c.skill = t.skill) AS promoted, greatest(0, raw_type_rules - type_rules) AS packed FROM tot t)
      SELECT skill, CAST(1 AS BIGINT) AS ord, 'speculative residuals' AS "check", CASE WHEN residuals = 0 THEN 'PASS' ELSE 'WARN' END AS level, residuals AS n FROM pr
      UNION ALL SELECT skill, 2, 'unsafe templates', CASE WHEN unsafe_templates = 0 THEN 'PASS' ELSE 'WARN' END, unsafe_templates FROM pr
      UNION ALL SELECT skill, 3, 'compressed rules', CASE WHEN packed = 0 THEN 'PASS' ELSE 'INFO' END, packed FROM pr
      UNION ALL SELECT skill, 4, 'cross-type patterns', CASE WHEN promoted > 0 THEN 'PASS' ELSE 'INFO' END, promoted FROM pr
      UNION ALL SELECT skill, 5, 'missing evidence', CASE WHEN missing_evidence = 0 THEN 'PASS' ELSE 'WARN' END, missing_evidence FROM pr
      UNION ALL SELECT skill, 6, 'evidence items', CASE WHEN evidence_items > 0 THEN 'PASS' ELSE 'WARN' END, evidence_items FROM pr""",
    "master_overview": f"""{STATS}, {_MASTER_TEXTS}, {cross_cte(ov.CONCERNS, 'mtexts')}, {scenario_cte('mtexts')}, {_never(20)}
      SELECT skill, 'type rules' AS section, project_type, position AS ord, text AS payload FROM top_type
      UNION ALL SELECT skill, 'hard rules', project_type, position, text FROM top_hard
      UNION ALL SELECT skill, 'cross-type rules', NULL, position, pattern || ' (' || replace(types, '|', ' + ') || ')' FROM crossed
      UNION ALL SELECT skill, 'templates', project_type, pos, layer || ' ' || name FROM tshow WHERE NOT unsafe AND NOT missing AND NOT hidden
      UNION ALL SELECT skill, 'never do', NULL, position, text FROM never
      UNION ALL SELECT skill, 'scenarios', NULL, position, scenario || ' | ' || action || ' | ' || layer FROM scen
      UNION ALL SELECT skill, 'type index', project_type, 0, replace(languages, '|', ', ') || ' | ' || type_rules || ' | ' || hard_rules || ' | ' || templates
        || ' | ' || hidden_templates || ' | ' || projects FROM stats
      UNION ALL SELECT skill, 'learning history', project_type, 0, '**' || language || '** · ' || learn_count || 'x · '
        || array_to_string(list_transform(source_projects, lambda p: regexp_extract(p, '[^/]*$')), ', ') FROM cat""",
}
