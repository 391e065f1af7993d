"""Queries over layer documents: sections, rules, templates, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitus.operators import documents as docs
from habitus.operators import trace as tr
from habitus.operators import verify as vf
from habitus.session import broadcast_if_small, cut_lineage
from workload import corpus
from workload import sqltext as s
from workload.sqltext import q, rx, sub, trim
from workload.views import duck_with, view

KEY = ["skill", "project_type"]


def layer_docs(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_layer_docs")


def doc_evidence(spark: SparkSession, sf: str, stored: bool = False) -> DataFrame:
    """Evidence of the project each reference was learned from.

    ``stored``: written once, by project, before references multiply it.
    """
    owners = layer_docs(spark, sf).select(*KEY, "project").distinct()
    found = corpus._evidence(spark, sf).drop("project_type")
    return owners.join(cut_lineage(found) if stored else found, "project")


def _id_docs(spark: SparkSession, sf: str) -> DataFrame:
    return layer_docs(spark, sf).select("doc_id", "layer", "content")


def split_layers(spark: SparkSession, sf: str) -> DataFrame:
    found = view(spark, sf, "v_full_docs").select(
        "doc_id", F.explode(docs.split_layers(F.col("content"))).alias("l")
    )
    return found.select(
        "doc_id", "l.layer", "l.file_stem",
        F.length("l.content").cast("bigint").alias("n_chars"), F.md5("l.content").alias("content_md5"),
    )


def split_missing(spark: SparkSession, sf: str) -> DataFrame:
    stems = F.transform(docs.split_layers(F.col("content")), lambda x: x["file_stem"])
    return view(spark, sf, "v_full_docs").select(
        "doc_id", F.explode(docs.missing_layers(stems)).alias("layer")
    )


def missing_layers(spark: SparkSession, sf: str) -> DataFrame:
    return vf.missing_layers(layer_docs(spark, sf))


def sections(spark: SparkSession, sf: str) -> DataFrame:
    found = _id_docs(spark, sf).select(
        "doc_id", F.posexplode(docs.sections(F.col("content"))).alias("pos", "s")
    )
    body = docs.rx.trim(F.col("s.body"))
    return found.select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("s.title").alias("title"),
        docs.section_name(F.col("s.title")).alias("name"), F.md5(body).alias("body_md5"),
    )


def section_bullets(spark: SparkSession, sf: str) -> DataFrame:
    def read(found):
        return F.array(
            *[
                F.struct(
                    F.lit(n).alias("name"),
                    docs.has_section(found, n).alias("present"),
                    docs.section_bullets(found, n).alias("lines"),
                )
                for n in ("Scope", "Templates", "Anti-patterns", "Evidence", "Gaps")
            ]
        )

    rows = _id_docs(spark, sf).select(
        "doc_id", F.explode(docs.let(docs.sections(F.col("content")), read)).alias("r")
    )
    return rows.select(
        "doc_id", "r.name", "r.present", F.array_join("r.lines", "\n").alias("lines")
    )


def rule_blocks(spark: SparkSession, sf: str) -> DataFrame:
    blocks = tr.rule_blocks(_id_docs(spark, sf), tr._rule_bodies(F.col("content")), ["doc_id"])
    return blocks.groupBy("doc_id", "heading").agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.sum(F.size(F.filter("block", lambda l: docs.rx.trim(l) != ""))).alias("n_lines"),
    )


def rule_texts(spark: SparkSession, sf: str) -> DataFrame:
    blocks = tr.rule_blocks(_id_docs(spark, sf), tr._rule_bodies(F.col("content")), ["doc_id"])
    return tr.compose_rules(blocks, ["doc_id"]).select("doc_id", "text")


def text_features(spark: SparkSession, sf: str) -> DataFrame:
    line = _id_docs(spark, sf).select(
        "doc_id", F.posexplode(docs.lines(F.col("content"))).alias("n", "line")
    )
    text = F.col("line")
    return line.select(
        "doc_id",
        F.col("n").cast("bigint").alias("n"),
        F.array_join(tr.extract_tags(text), "|").alias("tags"),
        F.array_join(tr.file_refs(text), "|").alias("files"),
        F.array_join(tr.normalize_tags(tr.extract_tags(text)), "|").alias("normal_tags"),
        tr.has_tag(tr.extract_tags(text), "[必须]").alias("must"),
    )


def rule_tests(spark: SparkSession, sf: str) -> DataFrame:
    line = _id_docs(spark, sf).select(
        "doc_id", F.posexplode(docs.lines(F.col("content"))).alias("n", "line")
    )
    text = F.col("line")
    return line.select(
        "doc_id",
        F.col("n").cast("bigint").alias("n"),
        tr.is_usable(text).alias("usable"),
        tr.is_actionable(text).alias("actionable"),
        tr.is_actionable_anti_pattern(text).alias("anti_pattern"),
        tr.is_observation(text).alias("observation"),
        F.md5(tr.clean_line(text)).alias("clean_md5"),
        F.md5(tr.clean_rule(text)).alias("rule_md5"),
    )


def templates(spark: SparkSession, sf: str) -> DataFrame:
    return tr.document_templates(layer_docs(spark, sf)).select(
        *KEY, "layer", F.col("pos").cast("bigint").alias("pos"), "name", "status"
    )


def trace_rules(spark: SparkSession, sf: str) -> DataFrame:
    return tr.trace_rules(layer_docs(spark, sf), doc_evidence(spark, sf)).select(
        *KEY, "id", "layer", "text", "status",
        F.array_join("tags", "|").alias("tags"),
        F.array_join("files", "|").alias("files"),
        F.array_join("evidence_ids", "|").alias("evidence_ids"),
    )


def trace_templates(spark: SparkSession, sf: str) -> DataFrame:
    return tr.trace_templates(layer_docs(spark, sf), doc_evidence(spark, sf)).select(
        *KEY, "id", "layer", "name", "status",
        F.array_join("files", "|").alias("files"),
        F.array_join("evidence_ids", "|").alias("evidence_ids"),
    )


def layer_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return tr.layer_evidence(doc_evidence(spark, sf)).select(
        *KEY, "layer", F.array_join("evidence_ids", "|").alias("evidence_ids"),
        F.size("evidence_files").cast("bigint").alias("n_files"),
    )


def _trace(spark: SparkSession, sf: str):
    d, e = layer_docs(spark, sf), cut_lineage(doc_evidence(spark, sf))
    return d, cut_lineage(tr.trace_rules(d, e)), cut_lineage(tr.trace_templates(d, e))


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    return vf.layer_manifest(*_trace(spark, sf))


def layer_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return _manifest(spark, sf).select(
        *KEY, "layer", "title", "file", "rule_count", "template_count", "anti_pattern_count",
        "gap_count", F.array_join("scope", "|").alias("scope"), F.array_join("topics", "|").alias("topics"),
        F.array_join("evidence_ids", "|").alias("evidence_ids"),
    )


def _llm(spark: SparkSession, sf: str) -> DataFrame:
    """A validation outcome per reference, from its first document."""
    first = layer_docs(spark, sf).groupBy(*KEY).agg(F.min("doc_id").alias("d"))
    return first.select(
        *KEY, (F.col("d") % 16 != 0).alias("ok"),
        F.concat(F.lit(" bad  at "), F.col("d").cast("string")).alias("output"),
    )


def _verify(spark: SparkSession, sf: str) -> DataFrame:
    return vf.verify(*_trace(spark, sf), _llm(spark, sf))


def verify(spark: SparkSession, sf: str) -> DataFrame:
    return _verify(spark, sf).select(
        *KEY, "ok", F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"),
        "layers", "rules", "templates", "stale_rules", "pending_rules",
    )


def inspect(spark: SparkSession, sf: str) -> DataFrame:
    parts = _trace(spark, sf)
    report = vf.verify(*parts, _llm(spark, sf))
    return vf.inspect(vf.layer_manifest(*parts), report, "l4").select(
        *KEY, "layer", "rule_count", "template_count", "ok",
        F.col("warnings").cast("bigint").alias("warnings"), F.col("errors").cast("bigint").alias("errors"),
    )


def stale_rules(spark: SparkSession, sf: str) -> DataFrame:
    _, rules, _ = _trace(spark, sf)
    owners = layer_docs(spark, sf).select(*KEY, "project").distinct()
    # Every vue file has moved: its old path is gone, its new one is known to no rule.
    moved = F.when(F.col("language") == "vue", F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    current = corpus.scanned(spark, sf).select("project", moved.alias("path"))
    return vf.stale_rules(rules, current, owners)


def _snapshots(spark: SparkSession, sf: str):
    """Two overlapping line sets of every document: now and before.

    Documents that share an id come once for each of them, as if joined by it.
    """
    d = layer_docs(spark, sf).filter(F.col("doc_id").isNotNull())
    shared = cut_lineage(d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") > 1))
    if not shared.isEmpty():
        small = broadcast_if_small(shared)
        found = d.join(shared if small is None else small, "doc_id", "left")
        d = found.withColumn("__again", F.explode(F.sequence(F.lit(1), F.coalesce("times", F.lit(1)))))
    line = d.select(*KEY, "layer", "doc_id", F.posexplode(docs.lines(F.col("content"))).alias("n", "text"))
    now = line.withColumn("text", F.when(F.col("n") % 5 == 1, F.concat("text", F.lit(" now"))).otherwise(F.col("text")))
    before = line.withColumn("text", F.when(F.col("n") % 4 == 1, F.concat(F.lit("Old "), "text")).otherwise(F.translate(F.replace("text", F.lit(" "), F.lit("  ")), "abcdefg", "ABCDEFG")))
    return now, before


def trace_diff(spark: SparkSession, sf: str) -> DataFrame:
    diff = vf.trace_diff(*_snapshots(spark, sf), shown=F.unhex(F.md5("text")))
    return diff.select(*KEY, "change", "layer", F.lower(F.hex("text")).alias("text_md5"))


def validate_layers(spark: SparkSession, sf: str) -> DataFrame:
    return vf.validate_layers(layer_docs(spark, sf))


def local_check(spark: SparkSession, sf: str) -> DataFrame:
    return vf.local_check(layer_docs(spark, sf), "en")


def document_checks(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("content")
    gaps = docs.gap_counts(docs.sections(c))
    return _id_docs(spark, sf).select(
        "doc_id",
        docs.truncation(c).alias("truncation"),
        docs.looks_cut_off(c).alias("cut_off"),
        docs.key_points(c).alias("key_points"),
        gaps["observed"].cast("bigint").alias("observed"),
        gaps["suggested"].cast("bigint").alias("suggested"),
        docs.speculative_residuals(c).cast("bigint").alias("residuals"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        split_layers, split_missing, missing_layers, sections, section_bullets, rule_blocks, rule_texts,
        text_features, rule_tests, templates, layer_evidence, trace_rules, trace_templates, layer_manifest,
        verify, inspect, stale_rules, trace_diff, validate_layers, local_check, document_checks,
    )
}

# ----------------------------------------------------------------- SQL side

DOCS = duck_with("v_layer_docs")
LINES = f"WITH {DOCS},{s.lines_cte('v_layer_docs', extra=', layer')}"


def _names() -> str:
    rows = ", ".join(f"({q(a)}, {q(n)})" for n, al in s.NAMES.items() for a in al)
    return f"names AS (SELECT * FROM (VALUES {rows}) AS t(alias, name))"


_RULE_BODIES = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS ord, '' AS title, min(sid) AS sid FROM secs WHERE {s.titled(a)} GROUP BY doc_id"
    for i, a in enumerate(("Rules", "规则", "约定", "Conventions"))
) + (
    f" UNION ALL SELECT doc_id, 100 + sid AS ord, title, sid FROM secs WHERE {s.plain_title('title')}"
    f" NOT IN ({', '.join(map(q, s.RESERVED))})"
)
BLOCKS = f"{LINES},{s.blocks_cte(_RULE_BODIES)}"

_ITEM_TEXT = trim(sub("t", r"^(?:[-*]|\d+\.)\s+", ""))
_REST = s.clean_body(
    trim(sub(trim(sub(sub("t", r"^\*\*(.+?)\*\*$", r"\1"), r"^(?:[-*]|\d+\.)\s+", "")), r"^[-*]\s+", ""))
)
_BOLD_BODY = s.spaces(r"^\*\*(.+?)\*\*\s*[：:]\s*(.+)$")
_BOLD_ONLY = s.spaces(r"^\*\*(.+?)\*\*\s*$")
_COLON = s.spaces(r"^([^：:]{2,32})[：:]\s*(.+)$")

RULE_TEXTS = f"""{BLOCKS},
rest AS (
  SELECT doc_id, ord, start_n, list(c ORDER BY n) AS rest FROM (
    SELECT doc_id, ord, start_n, n, {_REST} AS c FROM blk WHERE n > start_n AND t <> '' AND NOT starts_with(t, '```')) r
  WHERE c <> '' AND NOT {s.observation('c')} GROUP BY ALL),
tags AS (
  SELECT doc_id, ord, start_n, first(heading) AS h,
    list_concat(regexp_extract_all(first(heading), '\\[[^\\]]+\\]'),
      coalesce(flatten(list(regexp_extract_all(line, '\\[[^\\]]+\\]') ORDER BY n)), [])) AS tg
  FROM blk GROUP BY ALL),
utags AS (
  SELECT doc_id, ord, start_n, list_filter(tg, lambda x, i: list_position(tg, x) = i) AS tg FROM tags),
ntags AS (
  SELECT doc_id, ord, start_n, array_to_string(CASE WHEN len(list_filter(tg, lambda x: regexp_matches(x, '(?i)\\[?(?:个人偏好|项目特定|Personal Preference|Project-Specific)\\]?'))) = 0
     AND len(list_filter(tg, lambda x: regexp_matches(x, '(?i)\\[?(?:必须|推荐|可选|Must|Recommended|Optional)\\]?'))) > 0
     THEN list_concat(['[项目特定]'], tg) ELSE tg END, ' ') AS tag_text FROM utags),
items AS (
  SELECT doc_id, ord, start_n, {s.clean_title('heading')} AS gt, {_ITEM_TEXT} AS raw FROM blk WHERE n = start_n),
plain AS (SELECT *, {s.clean_body('raw')} AS cb FROM items),
parts AS (
  SELECT doc_id, ord, start_n, gt,
    CASE WHEN regexp_matches(raw, {q(_BOLD_BODY)}) THEN {s.clean_title(f"regexp_extract(raw, {q(_BOLD_BODY)}, 1)")}
      WHEN regexp_matches(raw, {q(_BOLD_ONLY)}) THEN {s.clean_title(f"regexp_extract(raw, {q(_BOLD_ONLY)}, 1)")}
      WHEN regexp_matches(cb, {q(_COLON)}) AND NOT contains(regexp_extract(cb, {q(_COLON)}, 1), '`') THEN {s.clean_title(f"regexp_extract(cb, {q(_COLON)}, 1)")}
      ELSE '' END AS it,
    CASE WHEN regexp_matches(raw, {q(_BOLD_BODY)}) THEN {s.clean_body(f"regexp_extract(raw, {q(_BOLD_BODY)}, 2)")}
      WHEN regexp_matches(raw, {q(_BOLD_ONLY)}) THEN ''
      WHEN regexp_matches(cb, {q(_COLON)}) AND NOT contains(regexp_extract(cb, {q(_COLON)}, 1), '`') THEN {s.clean_body(f"regexp_extract(cb, {q(_COLON)}, 2)")}
      ELSE cb END AS ib
  FROM plain),
joined AS (
  SELECT p.doc_id, p.ord, p.start_n, gt, it, tag_text,
    list_concat(CASE WHEN ib <> '' AND NOT {s.observation('ib')} THEN [ib] ELSE [] END, coalesce(rest, [])) AS pl
  FROM parts p JOIN ntags USING (doc_id, ord, start_n) LEFT JOIN rest USING (doc_id, ord, start_n)),
bodies AS (
  SELECT *, {trim(s.squeeze(f"array_to_string(CASE WHEN len(pl) > 1 AND it <> '' AND {s.normalize('pl[1]')} = {s.normalize('it')} THEN pl[2:] ELSE pl END, ' ')"))} AS body,
    CASE WHEN gt = '' THEN it WHEN it = '' OR {s.normalize('it')} = {s.normalize('gt')} THEN gt ELSE gt || ' / ' || it END AS title
  FROM joined),
stripped AS (
  SELECT *, CASE WHEN title <> '' AND starts_with(lower(body), lower(title))
      THEN {trim(sub("body[length(title) + 1:]", r"^\s*[：:，,。-]*\s*", ""))} ELSE '' END AS rst FROM bodies WHERE body <> ''),
worded AS (
  SELECT doc_id, ord, start_n,
    CASE WHEN title = '' AND tag_text = '' THEN '' WHEN title = '' THEN tag_text || '：' WHEN tag_text = '' THEN title || '：'
      ELSE title || ' ' || tag_text || '：' END || CASE WHEN rst <> '' THEN rst ELSE body END AS w FROM stripped),
rule_text AS (
  SELECT doc_id, ord, start_n, {s.clean_rule('w')} AS text FROM worded WHERE {s.usable('w')})"""

_FILE_RX = s.spaces(tr.FILE_REF)
_FILES = lambda x: (
    f"list_distinct_ordered({x})"
)


def files_of(x: str) -> str:
    found = f"regexp_extract_all({x}, {q(_FILE_RX)}, 1)"
    return f"list_filter({found}, lambda f, i: list_position({found}, f) = i)"


def _pending(x: str) -> str:
    return f"regexp_matches({x}, '(?i)待验证|To Verify|suggest|recommend|建议|考虑|maybe|可能')"


EVIDENCE = (
    corpus.EVIDENCE_CTE
    + f""", owners AS (SELECT DISTINCT skill, project_type, project FROM v_layer_docs),
dev AS (SELECT o.skill, o.project_type, e.project, e.layer, e.rule_id, e.files, e.confidence, e."count", e.position
  FROM owners o JOIN ordered e ON o.project = e.project),
lev AS (
  SELECT skill, project_type, layer, list(rule_id ORDER BY position) AS ids, flatten(list(files ORDER BY position)) AS af
  FROM dev GROUP BY ALL),
lev2 AS (SELECT skill, project_type, layer, ids, list_filter(af, lambda f, i: list_position(af, f) = i) AS ef FROM lev)"""
)

_ID = (
    "project_type || '-' || layer || '-{m}' || lpad(CAST(k AS VARCHAR), CAST(greatest(3, length(CAST(k AS VARCHAR))) AS INT), '0')"
)
TRACE = f"""{RULE_TEXTS}, {EVIDENCE},
firsts AS (
  SELECT doc_id, bare, min((ord, start_n)) AS at, arg_max(text, (ord, start_n)) AS text FROM (
    SELECT *, {trim(sub('text', r'^[-*]\s*', ''))} AS bare FROM rule_text) r GROUP BY doc_id, bare),
trule AS (
  SELECT d.skill, d.project_type, d.layer, f.text, {files_of('f.text')} AS own,
    coalesce(ids, []) AS ids, coalesce(ef, []) AS ef,
    row_number() OVER (PARTITION BY d.skill, d.project_type ORDER BY d.layer, f.at) AS k
  FROM firsts f JOIN v_layer_docs d ON f.doc_id = d.doc_id
  LEFT JOIN lev2 e ON e.skill = d.skill AND e.project_type = d.project_type AND e.layer = d.layer),
trace AS (
  SELECT skill, project_type, layer, {_ID.replace('{m}', 'r')} AS id, {trim(sub('text', r'^[-*]\s*', ''))} AS text,
    regexp_extract_all(text, '\\[[^\\]]+\\]') AS tags, CASE WHEN len(own) > 0 THEN own ELSE ef[1:5] END AS files, ids,
    CASE WHEN {_pending('text')} THEN 'pending' WHEN len(own) > 0 OR len(ef) > 0 THEN 'active' ELSE 'weak' END AS status
  FROM trule)"""

# templates: candidate headings by line, bodies up to the next one
_TT = "(?i)^(?:Templates?|模板|Template)(?:[：:]|$)"
_CAND = f"({rx('t', r'^####' + chr(92) + 's+')} OR {rx('t', r'^' + chr(92) + '*' + chr(92) + '*.+?' + chr(92) + '*' + chr(92) + '*$')})"


def _tname(x: str) -> str:
    x = trim(sub(sub(sub(x, r"^#+\s+", ""), r"^\*\*(.+)\*\*$", r"\1"), r"^\[(.+)\]$", r"\1"))
    return f"CASE WHEN {x} = '' THEN 'Template' ELSE {x} END"


def _missing(agg_body: str, meaningful: str) -> str:
    return f"(regexp_matches({agg_body}, '(?i)无现有模式|No existing pattern') AND NOT contains({agg_body}, '```') AND {meaningful} = 0)"


_MEANINGFUL = (
    f"count(*) FILTER (t <> '' AND NOT {rx('t', r'^#{1,6}' + chr(92) + 's+')}"
    f" AND NOT regexp_matches({sub('t', '^[⚠️' + chr(92) + 's]+', '')}, '(?i)^(无现有模式|No existing pattern)'))"
)
TEMPLATES = f"""
tl AS (
  SELECT *, {_CAND} AS cand, count(*) FILTER ({_CAND}) OVER (PARTITION BY doc_id, sid ORDER BY n ROWS UNBOUNDED PRECEDING) AS c
  FROM body_lines WHERE regexp_matches(title, {q(_TT)})),
tsec AS (SELECT doc_id, sid, title, {trim(sub('title', r'(?i)^(?:Templates?|模板|Template)(?:[：:]\s*)?', ''))} AS hn
  FROM secs WHERE regexp_matches(title, {q(_TT)})),
whole AS (SELECT doc_id, sid, string_agg(line, chr(10) ORDER BY n) AS body, {_MEANINGFUL} AS m,
    arg_min(t, n) FILTER (t <> '' AND NOT starts_with(t, '```') AND NOT {rx('t', r'^[-*]' + chr(92) + 's+')} AND NOT regexp_matches(t, '^`[^`]+`[：:]')) AS prose
  FROM tl GROUP BY ALL),
cands AS (SELECT doc_id, sid, c, first(CASE WHEN cand THEN {trim(sub(sub('t', r'^####' + chr(92) + 's+', ''), r'^' + chr(92) + '*' + chr(92) + '*(.+?)' + chr(92) + '*' + chr(92) + '*$', chr(92) + '1'))} END ORDER BY n) AS h,
    coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT cand), '') AS body,
    count(*) FILTER (NOT cand AND t <> '' AND NOT {rx('t', r'^#{1,6}' + chr(92) + 's+')}
      AND NOT regexp_matches({sub('t', '^[⚠️' + chr(92) + 's]+', '')}, '(?i)^(无现有模式|No existing pattern)')) AS m
  FROM tl WHERE c > 0 GROUP BY ALL),
ranked AS (SELECT *, {_missing('body', 'm')} AS mo, row_number() OVER (PARTITION BY doc_id, sid ORDER BY {_missing('body', 'm')}, c) AS r FROM cands),
tpl AS (
  SELECT t.doc_id, t.sid, CASE WHEN hn <> '' THEN {_tname('hn')} WHEN k.h IS NOT NULL THEN {_tname('k.h')} ELSE {_tname("coalesce(w.prose, 'Template')")} END AS name,
    CASE WHEN hn <> '' OR k.h IS NULL THEN coalesce(w.body, '') ELSE k.body END AS body,
    CASE WHEN hn <> '' OR k.h IS NULL THEN coalesce({_missing('w.body', 'w.m')}, false) ELSE k.mo END AS mo
  FROM tsec t LEFT JOIN whole w USING (doc_id, sid) LEFT JOIN (SELECT * FROM ranked WHERE r = 1) k USING (doc_id, sid)),
tplx AS (
  SELECT d.skill, d.project_type, d.layer, t.doc_id, row_number() OVER (PARTITION BY t.doc_id ORDER BY sid) - 1 AS pos, name, body,
    CASE WHEN regexp_matches(name, '(?i)无现有模式|No existing pattern') OR mo THEN 'missing'
      WHEN regexp_matches(body, {q('(?i)' + docs.PENDING_TEMPLATE)}) THEN 'pending' ELSE 'active' END AS status
  FROM tpl t JOIN v_layer_docs d ON t.doc_id = d.doc_id)"""
TTRACE = f"""
ttrace AS (
  SELECT skill, project_type, layer, {_ID.replace('{m}', 't')} AS id, name, status, files, ids FROM (
    SELECT t.*, {files_of('t.body')}[1:5] AS files, coalesce(e.ids, []) AS ids,
      row_number() OVER (PARTITION BY t.skill, t.project_type ORDER BY t.layer, t.pos) AS k
    FROM tplx t LEFT JOIN lev2 e ON e.skill = t.skill AND e.project_type = t.project_type AND e.layer = t.layer) x)"""

_ALIAS = {
    "Scope": ("Scope", "范围", "边界"),
    "Rules": ("Rules", "规则", "约定", "Conventions"),
    "Templates": ("Templates", "Template", "模板"),
    "Anti-patterns": ("Anti-patterns", "Anti-pattern", "反模式"),
    "Evidence": ("Evidence", "证据"),
    "Gaps": ("Gaps", "缺口", "待验证", "To Verify"),
}


def _first_sections(names: tuple[str, ...]) -> str:
    """first_sec(doc_id, name, sid): the section read for each name."""
    arms = " UNION ALL ".join(
        f"SELECT doc_id, {q(n)} AS name, {i} AS pref, sid FROM secs WHERE {s.titled(a)}"
        for n in names
        for i, a in enumerate(_ALIAS[n])
    )
    return f"""first_sec AS (SELECT doc_id, name, arg_min(sid, (pref, sid)) AS sid FROM ({arms}) a GROUP BY ALL),
bul AS (SELECT f.doc_id, f.name, list(t ORDER BY n) FILTER ({rx('t', r'^[-*]' + chr(92) + 's+')}) AS b,
   string_agg(t, ' ' ORDER BY n) FILTER (t <> '' AND NOT starts_with(t, '```')) AS prose
  FROM first_sec f LEFT JOIN body_lines l ON l.doc_id = f.doc_id AND l.sid = f.sid GROUP BY ALL),
bul2 AS (SELECT doc_id, name, CASE WHEN len(b) > 0 THEN b WHEN name = 'Scope' AND coalesce(prose, '') <> ''
   THEN [{trim(s.squeeze('prose'))}] ELSE [] END AS lines FROM bul)"""


_SIX = tuple(_ALIAS)
FACTS = f"""{_first_sections(_SIX)},
present AS (
  {' UNION ALL '.join(f"SELECT DISTINCT doc_id, {q(n)} AS name FROM secs WHERE {s.titled('(?:' + '|'.join(a) + ')')}" for n, a in _ALIAS.items())})"""
_TAIL = trim(f"regexp_extract({sub('content', r'\s+$', '')}, '[^\\n]*$')")
_TRUNC = f"""CASE WHEN len(regexp_extract_all(content, '```')) % 2 = 1 THEN 'unclosed code fence'
  WHEN len(regexp_extract_all({_TAIL}, '`')) % 2 = 1 THEN 'dangling inline code "' || {_TAIL}[1:80] || '"' END"""
GRID = """
keys AS (SELECT DISTINCT skill, project_type FROM v_layer_docs),
grid AS (SELECT skill, project_type, 'L' || i AS layer FROM keys, range(1, 9) AS r(i))"""
_SECTION_ROWS = ", ".join(f"({i}, {q(n)})" for i, n in enumerate(_SIX))
VERIFY = f"""{TRACE}, {TEMPLATES}, {TTRACE}, {FACTS}, {GRID},
trunc AS (SELECT skill, project_type, layer, doc_id, {_TRUNC} AS why FROM v_layer_docs),
err AS (
  SELECT g.skill, g.project_type, string_agg(CASE WHEN t.doc_id IS NULL THEN g.layer || ' missing' ELSE g.layer || ' appears truncated: ' || why END, '|' ORDER BY g.layer)
    FILTER (t.doc_id IS NULL OR why IS NOT NULL) AS e, count(t.doc_id) AS layers
  FROM grid g LEFT JOIN trunc t USING (skill, project_type, layer) GROUP BY ALL),
warn AS (
  SELECT d.skill, d.project_type, string_agg(d.layer || ' missing ' || x.name || ' section', '|' ORDER BY d.layer, x.i) AS w
  FROM v_layer_docs d CROSS JOIN (VALUES {_SECTION_ROWS}) AS x(i, name)
  WHERE NOT EXISTS (SELECT 1 FROM present p WHERE p.doc_id = d.doc_id AND p.name = x.name) GROUP BY ALL),
rs AS (SELECT skill, project_type, count(*) AS rules, count(*) FILTER (status = 'pending') AS pending_rules FROM trace GROUP BY ALL),
ts AS (SELECT skill, project_type, count(*) AS templates, count(*) FILTER (status = 'pending') AS pt FROM ttrace GROUP BY ALL),
llm AS (SELECT skill, project_type, min(doc_id) % 16 <> 0 AS ok, 'bad at ' || min(doc_id) AS o FROM v_layer_docs GROUP BY ALL),
report AS (
  SELECT k.skill, k.project_type, concat_ws('|', e, CASE WHEN NOT llm.ok THEN 'LLM validation failed: ' || o END) AS errors,
    concat_ws('|', w, CASE WHEN coalesce(rules, 0) = 0 THEN 'No structured rules extracted' END,
      CASE WHEN coalesce(pt, 0) > 0 THEN pt || ' pending template(s)' END) AS warnings,
    layers, coalesce(rules, 0) AS rules, coalesce(templates, 0) AS templates, 0 AS stale_rules, coalesce(pending_rules, 0) AS pending_rules
  FROM keys k LEFT JOIN err USING (skill, project_type) LEFT JOIN warn USING (skill, project_type) LEFT JOIN rs USING (skill, project_type)
  LEFT JOIN ts USING (skill, project_type) LEFT JOIN llm USING (skill, project_type)),
mani AS (
  SELECT g.skill, g.project_type, g.layer, coalesce({trim("regexp_extract(d.content, '(?m)^##[ \\t]+(.+)$', 1)")}, g.layer) AS title,
    coalesce(d.file_stem || '.md', '') AS file, coalesce(r.n, 0) AS rule_count, coalesce(t.n, 0) AS template_count,
    coalesce(len(a.lines), 0) AS anti_pattern_count, coalesce(len(gp.lines), 0) AS gap_count,
    coalesce(array_to_string(sc.lines, '|'), '') AS scope,
    coalesce(array_to_string(list_transform(regexp_extract_all(d.content, '(?m)^###[ \\t]+(.+)$', 1)[1:10], lambda h: {trim('h')}), '|'), '') AS topics,
    coalesce(r.ids, '') AS evidence_ids
  FROM grid g LEFT JOIN v_layer_docs d USING (skill, project_type, layer)
  LEFT JOIN (SELECT skill, project_type, layer, count(*) AS n, array_to_string(first(ids), '|') AS ids FROM trace WHERE status = 'active' GROUP BY ALL) r USING (skill, project_type, layer)
  LEFT JOIN (SELECT skill, project_type, layer, count(*) AS n FROM ttrace WHERE status = 'active' GROUP BY ALL) t USING (skill, project_type, layer)
  LEFT JOIN (SELECT * FROM bul2 WHERE name = 'Anti-patterns') a ON a.doc_id = d.doc_id
  LEFT JOIN (SELECT * FROM bul2 WHERE name = 'Gaps') gp ON gp.doc_id = d.doc_id
  LEFT JOIN (SELECT * FROM bul2 WHERE name = 'Scope') sc ON sc.doc_id = d.doc_id)"""

# one text split into pieces at the chosen layer headings
_MARK = lambda h, tail: f"regexp_replace(content, '\\n({h} L\\d+{tail})', chr(1) || '\\1', 'g')"
SPLIT = f"""WITH {duck_with('v_full_docs')},
tries AS (SELECT doc_id, content, string_split({_MARK('##', '[ ·：:]')}, chr(1)) AS a, string_split({_MARK('###', '[ ·：:]')}, chr(1)) AS b,
    string_split({_MARK('##', '[' + chr(92) + 's]')}, chr(1)) AS c, string_split({_MARK('###', '[' + chr(92) + 's]')}, chr(1)) AS d FROM v_full_docs),
pieces AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (
    SELECT doc_id, CASE WHEN len(a) >= 8 THEN a WHEN len(b) >= 8 THEN b WHEN len(c) >= 8 THEN c WHEN len(d) >= 8 THEN d ELSE [content] END AS p FROM tries) x),
pl AS (SELECT doc_id, i, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (
    SELECT doc_id, i, string_split(replace({trim('piece')}, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM pieces) x),
pf AS (SELECT *, count(*) FILTER ({rx('line', r'^' + chr(92) + 's*```')}) OVER (PARTITION BY doc_id, i ORDER BY n ROWS UNBOUNDED PRECEDING) % 2 = 1 AS inside FROM pl),
pc AS (SELECT *, min(n) FILTER (NOT inside AND n > 1 AND {rx('line', r'^##' + chr(92) + 's+')} AND NOT regexp_matches(line, '^##\\s+L[1-8]\\b')) OVER (PARTITION BY doc_id, i) AS cut FROM pf),
body AS (SELECT doc_id, i, {trim("string_agg(line, chr(10) ORDER BY n) FILTER (cut IS NULL OR n < cut)")} AS b0, max(cut) AS cut FROM pc GROUP BY ALL),
body2 AS (SELECT doc_id, i, {trim("CASE WHEN cut IS NOT NULL THEN regexp_replace(b0, '(?:^|' || chr(10) || ')[ \\t]*---$', '') ELSE b0 END")} AS content FROM body),
heads AS (SELECT doc_id, i, content, coalesce(nullif(regexp_extract(content, '(?m)^#{{2,3}}\\s*(L\\d+)\\s*[·：:\\s]+\\s*(.+?)(?:\\s*$|\\n)', 1), ''),
    nullif(regexp_extract(content, '(?m)^#{{2,3}}\\s*(L\\d+)\\s*$', 1), '')) AS layer FROM body2),
named AS (SELECT doc_id, i, content, layer, layer || '-' || CASE layer {' '.join(f"WHEN {q(k)} THEN {q(v)}" for k, v in docs.LAYER_NAMES.items())} END AS file_stem
  FROM heads WHERE layer IS NOT NULL),
split AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, file_stem ORDER BY i DESC) AS r FROM named) x WHERE r = 1)"""

_ACT = {"usable": s.usable("line"), "actionable": s.actionable("line")}
_TAGS = "regexp_extract_all(line, '\\[[^\\]]+\\]')"
_UT = f"list_filter({_TAGS}, lambda x, i: list_position({_TAGS}, x) = i)"

ORACLES = {
    "split_layers": f"{SPLIT} SELECT doc_id, layer, file_stem, length(content) AS n_chars, md5(content) AS content_md5 FROM split",
    "split_missing": f"""{SPLIT} SELECT d.doc_id, 'L' || k AS layer FROM v_full_docs d, range(1, 9) AS r(k)
      WHERE NOT EXISTS (SELECT 1 FROM split s WHERE s.doc_id = d.doc_id AND starts_with(s.file_stem, 'L' || k))""",
    "missing_layers": f"""WITH {DOCS}, {GRID} SELECT g.* FROM grid g
      WHERE NOT EXISTS (SELECT 1 FROM v_layer_docs d WHERE d.skill = g.skill AND d.project_type = g.project_type AND d.layer = g.layer)""",
    "sections": f"""{LINES}, {_names()}, b AS (SELECT doc_id, sid, string_agg(line, chr(10) ORDER BY n) AS body FROM body_lines GROUP BY ALL)
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sid) - 1 AS pos, title, name, md5({trim("coalesce(body, '')")}) AS body_md5
      FROM secs LEFT JOIN b USING (doc_id, sid) LEFT JOIN names ON alias = {s.plain_title('title')}""",
    "section_bullets": f"""{LINES}, {FACTS}
      SELECT d.doc_id, x.name, p.doc_id IS NOT NULL AS present, coalesce(array_to_string(b.lines, chr(10)), '') AS lines
      FROM v_layer_docs d CROSS JOIN (VALUES ('Scope'), ('Templates'), ('Anti-patterns'), ('Evidence'), ('Gaps')) AS x(name)
      LEFT JOIN present p ON p.doc_id = d.doc_id AND p.name = x.name LEFT JOIN bul2 b ON b.doc_id = d.doc_id AND b.name = x.name""",
    "rule_blocks": f"{BLOCKS} SELECT doc_id, heading, count(DISTINCT (ord, start_n)) AS n_blocks, count(*) FILTER (t <> '') AS n_lines FROM blk GROUP BY ALL",
    "rule_texts": f"{RULE_TEXTS} SELECT doc_id, text FROM rule_text",
    "text_features": f"""{LINES} SELECT doc_id, n - 1 AS n, array_to_string({_TAGS}, '|') AS tags, array_to_string({files_of('line')}, '|') AS files,
      array_to_string(CASE WHEN len(list_filter({_UT}, lambda x: regexp_matches(x, '(?i){tr.SCOPE_TAG}'))) = 0
        AND len(list_filter({_UT}, lambda x: regexp_matches(x, '(?i){tr.CONFIDENCE_TAG}'))) > 0
        THEN list_concat(['[项目特定]'], {_UT}) ELSE {_UT} END, '|') AS normal_tags,
      len(list_filter({_TAGS}, lambda x: lower(x) IN ('[必须]', '[must]'))) > 0 AS must FROM lines""",
    "rule_tests": f"""{LINES} SELECT doc_id, n - 1 AS n, {_ACT['usable']} AS usable, {_ACT['actionable']} AS actionable,
      {_ACT['actionable']} AND NOT regexp_matches(line, '建议|推荐使用|可考虑|待验证') AS anti_pattern, {s.observation('line')} AS observation,
      md5({s.clean_line('line')}) AS clean_md5, md5({s.clean_rule('line')}) AS rule_md5 FROM lines""",
    "templates": f"{LINES}, {TEMPLATES} SELECT skill, project_type, layer, pos, name, status FROM tplx",
    "layer_evidence": f"WITH {DOCS}, {EVIDENCE} SELECT skill, project_type, layer, array_to_string(ids, '|') AS evidence_ids, len(ef) AS n_files FROM lev2",
    "trace_rules": f"""{TRACE} SELECT skill, project_type, id, layer, text, status, array_to_string(tags, '|') AS tags,
      array_to_string(files, '|') AS files, array_to_string(ids, '|') AS evidence_ids FROM trace""",
    "trace_templates": f"""{LINES}, {EVIDENCE}, {TEMPLATES}, {TTRACE} SELECT skill, project_type, id, layer, name, status,
      array_to_string(files, '|') AS files, array_to_string(ids, '|') AS evidence_ids FROM ttrace""",
    "layer_manifest": f"{VERIFY} SELECT * FROM mani",
    "verify": f"{VERIFY} SELECT *, errors = '' AS ok FROM report",
    "inspect": f"""{VERIFY} SELECT m.skill, m.project_type, m.layer, rule_count, template_count, errors = '' AS ok,
      CASE WHEN warnings = '' THEN 0 ELSE len(string_split(warnings, '|')) END AS warnings,
      CASE WHEN errors = '' THEN 0 ELSE len(string_split(errors, '|')) END AS errors
      FROM mani m JOIN report r USING (skill, project_type) WHERE layer = 'L4'""",
    "stale_rules": f"""{TRACE}, cur AS (SELECT DISTINCT o.skill, o.project_type, f.path FROM owners o JOIN files f ON o.project = f.project WHERE language <> 'vue')
      SELECT t.skill, t.project_type, t.id, len(t.files) > 0 AND NOT bool_or(c.path IS NOT NULL) AS stale
      FROM (SELECT skill, project_type, id, files, unnest(CASE WHEN len(files) > 0 THEN files ELSE [NULL] END) AS p FROM trace) t
      LEFT JOIN cur c ON c.skill = t.skill AND c.project_type = t.project_type AND c.path = t.p GROUP BY t.skill, t.project_type, t.id, t.files""",
    "trace_diff": f"""WITH {DOCS}, ln AS (SELECT skill, project_type, layer, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS n FROM (
        SELECT skill, project_type, layer, string_split(content, chr(10)) AS l FROM v_layer_docs) x),
      now AS (SELECT skill, project_type, layer, CASE WHEN n % 5 = 1 THEN line || ' now' ELSE line END AS text FROM ln),
      old AS (SELECT skill, project_type, layer, CASE WHEN n % 4 = 1 THEN 'Old ' || line ELSE translate(replace(line, ' ', '  '), 'abcdefg', 'ABCDEFG') END AS text FROM ln),
      nk AS (SELECT *, left({s.squeeze('lower(text)')}, 180) AS k FROM now), ok AS (SELECT *, left({s.squeeze('lower(text)')}, 180) AS k FROM old)
      SELECT skill, project_type, 'added' AS change, layer, md5(text) AS text_md5 FROM nk WHERE NOT EXISTS (
        SELECT 1 FROM ok WHERE ok.skill = nk.skill AND ok.project_type = nk.project_type AND ok.k = nk.k)
      UNION ALL SELECT skill, project_type, 'removed', layer, md5(text) FROM ok WHERE NOT EXISTS (
        SELECT 1 FROM nk WHERE ok.skill = nk.skill AND ok.project_type = nk.project_type AND ok.k = nk.k)""",
    "validate_layers": f"""WITH {DOCS}, {GRID}, c AS (SELECT g.*, d.content,
        {rx('content', '(?i)' + docs.CONVENTION_HEADING)} AS conv, {rx('content', r'(?im)^###' + chr(92) + 's+(?:模板|Templates?|Template)(?:' + chr(92) + 's|[：:]|$)')} AS tmpl,
        {rx('content', r'(?i)###' + chr(92) + 's+Anti-?patterns?')} OR {rx('content', r'###' + chr(92) + 's+反模式')} AS no_go
        FROM grid g LEFT JOIN v_layer_docs d USING (skill, project_type, layer)),
      i AS (SELECT skill, project_type, layer, CASE WHEN content IS NULL THEN 'missing' WHEN NOT conv AND NOT tmpl AND NOT no_go THEN 'structure'
        WHEN NOT tmpl AND NOT regexp_matches(content, '(?i)无现有模式|no existing pattern') THEN 'template' END AS issue FROM c)
      SELECT * FROM i WHERE issue IS NOT NULL""",
    "local_check": f"""{LINES}, {GRID}, hd AS (SELECT doc_id, {trim(s.squeeze("regexp_replace(lower(title), '[：:]', '', 'g')"))} AS h FROM secs),
      lab AS (SELECT * FROM (VALUES {', '.join(f"({q(n)}, {q(n.lower())})" for n in vf.LABELS['en'])}) AS t(name, w)),
      has AS (SELECT DISTINCT doc_id, name FROM hd, lab WHERE contains(h, w) OR contains(w, h)),
      zh AS (SELECT DISTINCT doc_id FROM hd WHERE contains(h, '反模式') OR contains('反模式', h)),
      ends AS (SELECT *, {sub(sub(sub('content', r'\s+$', ''), r'\n---\s*$', ''), r'\s+$', '')} AS e FROM v_layer_docs)
      SELECT skill, project_type, layer, 'missing' AS issue FROM grid g WHERE NOT EXISTS (SELECT 1 FROM v_layer_docs d
        WHERE d.skill = g.skill AND d.project_type = g.project_type AND d.layer = g.layer)
      UNION ALL SELECT skill, project_type, layer, 'appears truncated' FROM ends WHERE len(regexp_extract_all(content, '(?m)^```')) % 2 = 1
        OR regexp_matches(e, '(?:\\.\\.\\.|\\[…\\]|[,，:：;；]|-)$')
      UNION ALL SELECT d.skill, d.project_type, d.layer, 'missing ' || name FROM v_layer_docs d, lab
        WHERE NOT EXISTS (SELECT 1 FROM has x WHERE x.doc_id = d.doc_id AND x.name = lab.name)
      UNION ALL SELECT skill, project_type, layer, 'missing template fallback' FROM v_layer_docs d
        WHERE NOT EXISTS (SELECT 1 FROM has x WHERE x.doc_id = d.doc_id AND x.name = 'Templates') AND NOT regexp_matches(content, '(?i)无现有模式|no existing pattern')
      UNION ALL SELECT skill, project_type, layer, 'missing anti-patterns' FROM v_layer_docs d
        WHERE NOT EXISTS (SELECT 1 FROM has x WHERE x.doc_id = d.doc_id AND x.name = 'Anti-patterns') AND doc_id NOT IN (SELECT doc_id FROM zh)""",
    "document_checks": f"""{LINES},
      gl AS (SELECT *, last_value(CASE WHEN {rx('t', r'^####' + chr(92) + 's+')} THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id, sid ORDER BY n ROWS UNBOUNDED PRECEDING) AS sub
        FROM body_lines WHERE {s.plain_title(sub('title', '^⚠️' + chr(92) + 's*', ''))} IN ('gaps', '缺口', '待验证', 'to verify')),
      gk AS (SELECT doc_id, CASE WHEN regexp_matches(sub, '(?i)已观察|Observed|Risk') THEN 0 WHEN regexp_matches(sub, '(?i)建议|改进|Suggested|Improvement') THEN 1
          WHEN regexp_matches(t, {q(docs.SUGGESTION_WORDS)}) THEN 1 ELSE 0 END AS sg
        FROM gl WHERE starts_with(t, '-') AND NOT {rx('t', r'^-+' + chr(92) + 's*(?:无|None|N/A)[。.]?$')}),
      g AS (SELECT doc_id, count(*) - sum(sg) AS observed, sum(sg) AS suggested FROM gk GROUP BY ALL),
      outside AS (SELECT l.doc_id, l.n, l.line FROM lines l LEFT JOIN secs s USING (doc_id, sid)
        WHERE s.title IS NULL OR {s.plain_title(sub('s.title', '^⚠️' + chr(92) + 's*', ''))} NOT IN ('gaps', '缺口', '待验证', 'to verify')),
      txt AS (SELECT doc_id, regexp_replace(string_agg(line, chr(10) ORDER BY n), '(?m)^```(?s:.)*?^```\\s*$', '', 'g') AS x FROM outside GROUP BY ALL),
      rl AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS line FROM txt),
      r AS (SELECT doc_id, count(*) AS residuals FROM rl WHERE regexp_matches(line, {q(docs.SPECULATIVE_WORDS)}) AND NOT {rx('line', r'^' + chr(92) + 's*#')}
        AND NOT contains(line, '无现有模式') AND NOT {rx('line', r'^' + chr(92) + 's*' + chr(92) + '|')} AND NOT {rx('line', r'^' + chr(92) + 's*[-*]' + chr(92) + 's*⚠️')} GROUP BY ALL),
      ends AS (SELECT *, {sub(sub(sub('content', r'\s+$', ''), r'\n---\s*$', ''), r'\s+$', '')} AS e FROM v_layer_docs)
      SELECT d.doc_id, {_TRUNC} AS truncation, len(regexp_extract_all(content, '(?m)^```')) % 2 = 1 OR regexp_matches(e, '(?:\\.\\.\\.|\\[…\\]|[,，:：;；]|-)$') AS cut_off,
        array_to_string(regexp_extract_all(content, '(?m)^#{{2,3}}[ \\t]+.+')[1:8], chr(10)) AS key_points,
        CAST(coalesce(observed, 0) AS BIGINT) AS observed, CAST(coalesce(suggested, 0) AS BIGINT) AS suggested, coalesce(residuals, 0) AS residuals
      FROM ends d LEFT JOIN g ON g.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id""",
}
