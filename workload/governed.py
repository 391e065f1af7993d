"""SQL for the cleaning of generated documents: scope, gaps, templates, the whole.

Documents are followed line by line, and look-aheads are written as searches for
the place where the part before them ends.
"""

from __future__ import annotations

from habitus.operators import documents as docs
from habitus.operators import governance as gv
from workload import corpus
from workload import sqltext as s
from workload.sqltext import q, rx, trim
from workload.views import duck_with

INLINE = "[" + s.SPACES.replace(r"\n", "") + "]"
TEXT = gv.TEXTS["en"]
NL = "chr(10)"


def trim_end(x: str) -> str:
    return f"regexp_replace({x}, {q(s.W + '+$')}, '')"


def _end(x: str) -> str:
    """The place in ``x`` where the next heading or rule begins, or its end."""
    places = [f"CASE WHEN instr({x}, {NL} || {q(p)}) > 0 THEN instr({x}, {NL} || {q(p)}) ELSE length({x}) + 1 END" for p in ("###", "---", "## ")]
    return f"least({', '.join(places)})"


def _lines(doc: str) -> str:
    return f"unnest(string_split({doc}, {NL})) AS line, generate_subscripts(string_split({doc}, {NL}), 1) AS n"


def scope_steps(name: str, source: str) -> str:
    """``doc`` of ``source`` with a filled scope section."""
    default = "CASE layer " + " ".join(f"WHEN {q(l)} THEN {q(t)}" for l, t in gv.DEFAULT_SCOPE["en"].items()) + " END"
    added = f"{q('### ' + TEXT['scope'])} || {NL} || {default} || {NL}"
    heading = q(rf"(?i)\n###{INLINE}+(?:范围|Scope){s.W}*\n")
    first = f"split_part(doc, {NL}, 1)"
    return f"""{name}_a AS (SELECT *, regexp_extract(doc, {heading}) AS sh FROM {source}),
{name}_b AS (SELECT *, substr(doc, instr(doc, sh) + length(sh)) AS sr FROM {name}_a),
{name} AS (SELECT * EXCLUDE (doc, sh, sr), CASE WHEN sh <> '' AND {trim(f"left(sr, {_end('sr')} - 1)")} <> '' THEN doc
  WHEN sh <> '' THEN left(doc, instr(doc, sh) - 1) || {NL} || {added} || substr(sr, {_end('sr')})
  ELSE {trim_end(first)} || {NL} || {NL} || {added} || substr(doc, length({first}) + 1) END AS doc FROM {name}_b)"""


def gap_steps(name: str, source: str) -> str:
    """``doc`` without its gap sections and ``old_gaps``, their lines in order."""
    start = rf"^(?:###?{INLINE}+|---{INLINE}*$)"
    heading = r"(?i)^###[ \t]+(?:缺口|待验证|To Verify|Unverified|⚠️\s*Gaps|Gaps)[ \t]*$"
    doc = "doc"
    doc = f"regexp_replace({doc}, {q(s.spaces(r'(?i)\n---\s*\n\s*(###\s*(?:反模式|Anti-?patterns?|证据|Evidence))'))}, {q(chr(10) + chr(92) + '1')}, 'g')"
    doc = f"regexp_replace({doc}, {q(s.spaces(r'\n{2,}---\s*\n{2,}(---\s*\n)'))}, {q(chr(10) * 2 + chr(92) + '1')}, 'g')"
    doc = f"regexp_replace({doc}, '\\n{{3,}}', {NL} || {NL}, 'g')"
    return f"""{name}_l AS (SELECT doc_id, {_lines('doc')} FROM {source}),
{name}_n AS (SELECT *, count(*) FILTER (regexp_matches(line, {q(start)})) OVER (PARTITION BY doc_id ORDER BY n) AS sec FROM {name}_l),
{name}_s AS (SELECT *, regexp_matches(first(line) OVER (PARTITION BY doc_id, sec ORDER BY n), {q(s.spaces(heading))}) AS gap,
  row_number() OVER (PARTITION BY doc_id, sec ORDER BY n) AS k, {trim('line')} AS t FROM {name}_n),
{name}_k AS (SELECT doc_id, string_agg(CASE WHEN gap THEN '' ELSE line END, {NL} ORDER BY n) FILTER (NOT gap OR k = 1) AS doc,
  coalesce(list(t ORDER BY n) FILTER (gap AND k > 1 AND t <> '' AND NOT {rx('t', r'^####\s+')} AND NOT regexp_matches(t, '^---+$')
    AND NOT {rx('t', r'(?i)^-+\s*(?:无|None|N/A)[。.]?$')}), []) AS old_gaps FROM {name}_s GROUP BY doc_id),
{name} AS (SELECT o.* EXCLUDE (doc), k.old_gaps, {doc.replace('doc,', 'k.doc,', 1)} AS doc FROM {source} o JOIN {name}_k k USING (doc_id))"""


def appended_gaps(name: str, source: str) -> str:
    """``content``: ``doc`` with the lines of ``gaps`` as one section at its end."""
    side = lambda flag: f"coalesce(string_agg(line, {NL} ORDER BY n) FILTER ({flag}), {q(TEXT['none'])})"
    return f"""{name}_l AS (SELECT doc_id, {trim('line')} AS t, n FROM (SELECT doc_id, unnest(gaps) AS line, generate_subscripts(gaps, 1) AS n FROM {source}) x),
{name}_b AS (SELECT doc_id, n, CASE WHEN starts_with(t, '-') THEN t ELSE '- ' || t END AS line FROM {name}_l WHERE t <> ''),
{name}_d AS (SELECT doc_id, min(n) AS n, arg_max(line, n) AS line, regexp_matches(line, {q('(?i)' + gv.SUGGESTION)}) AS suggests
  FROM {name}_b GROUP BY doc_id, {s.squeeze('line')}, regexp_matches(line, {q('(?i)' + gv.SUGGESTION)})),
{name}_g AS (SELECT doc_id, {side('NOT suggests')} AS observed, {side('suggests')} AS suggested FROM {name}_d GROUP BY doc_id),
{name} AS (SELECT o.*, {trim_end('doc')} || {NL} || {NL} || {NL} || {q('### ' + TEXT['gaps'])} || {NL} || {NL} || {q('#### ' + TEXT['observed'])} || {NL}
  || coalesce(observed, {q(TEXT['none'])}) || {NL} || {NL} || {q('#### ' + TEXT['suggested'])} || {NL} || coalesce(suggested, {q(TEXT['none'])}) AS content
  FROM {source} o LEFT JOIN {name}_g USING (doc_id))"""


DRAFTS = f"""{duck_with('v_governed_docs')},
drafts AS (SELECT row_number() OVER () AS doc_id, skill, project_type, layer, content AS doc FROM v_governed_docs)"""

ENSURE_SCOPE = f"""WITH {DRAFTS}, {scope_steps('sc', 'drafts')}
SELECT skill, project_type, layer, md5(doc) AS content_md5 FROM sc"""

REGROUP_GAPS = f"""WITH {DRAFTS}, {gap_steps('ga', 'drafts')}, gb AS (SELECT *, old_gaps AS gaps FROM ga), {appended_gaps('ap', 'gb')}
SELECT skill, project_type, layer, md5(content) AS content_md5 FROM ap"""


def _spoken(pattern: str) -> str:
    """A wording test whose look-aheads are spelled out: another character or the end."""
    for word, char in (("推测", "的"), ("推断", "的"), ("可能", "是")):
        pattern = pattern.replace(f"{word}(?!{char})", f"{word}(?:[^{char}]|$)")
    return pattern


def _is(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q('(?i)' + pattern)})"


def govern_sql(evidence_names: str) -> str:
    """The whole cleaning; ``evidence_names`` defines gnames (skill, project_type, nm)."""
    speculative = f"({_is('t', gv.META_LINE)} OR (NOT {_is('t', docs.NO_PATTERN)} AND {_is('t', _spoken(gv.SPECULATION))}))"
    plain = f"array_to_string(list_filter(string_split({trim('doc')}, {NL}), lambda l: NOT {_is(trim('l'), gv.META_LINE)}), {NL})"
    head = rf"(?is)\n###{INLINE}+(?:模板|Templates?|Template)(?:[：:]([^\n]*?))?{s.W}*\n"
    candidate = rf"^{INLINE}*(?:####{INLINE}+[^{s.SPACES}].*|\*\*.+?\*\*{INLINE}*)$"
    single = rf"^\n###{INLINE}+(?:模板|Template)(?:[：:]|{INLINE}*\n)"
    name = f"CASE WHEN starts_with(f, '#') THEN regexp_replace(f, '^####{INLINE}+', '') ELSE regexp_extract(f, '^\\*\\*(.+?)\\*\\*{INLINE}*$', 1) END"
    titled = s.rx("doc", r"(?im)^###\s+(?:模板|Templates?|Template)(?:\s|[：:]|$)")
    tools = q("(?i)" + gv.TOOLS)
    pending, (before, behind) = TEXT["pending"], TEXT["removed"]
    anti = r"(?i)\n###[ \t]+(?:反模式|Anti-?patterns?)"
    block = q("\n" + TEXT["template"])
    whole = trim_end("doc") + f" || {block} || {q(chr(10) + TEXT['anti'])}"
    around = f"{trim_end('left(doc, instr(doc, ah) - 1)')} || {NL} || {block} || {NL} || substr(doc, instr(doc, ah) + 1)"
    replaced = f"before || {q(chr(10) * 2 + TEXT['template'].rstrip(chr(10)) + chr(10))} || after"
    kept = f"CASE WHEN len(removed) > 0 THEN before || {NL} || {trim_end('head || ' + trim_end('body'))} || {NL} || after ELSE doc END"
    return f"""WITH {DRAFTS}, {evidence_names},
g1 AS (SELECT * EXCLUDE (doc), {plain} AS doc FROM drafts),
{scope_steps('g2', 'g1')}, {gap_steps('g3', 'g2')},
l4 AS (SELECT doc_id, {_lines('doc')} FROM g3),
f4 AS (SELECT *, {trim('line')} AS t, starts_with({trim('line')}, '```') AS fence FROM l4),
p4 AS (SELECT *, count(*) FILTER (fence) OVER (PARTITION BY doc_id ORDER BY n) % 2 = 1 AS odd FROM f4),
m4 AS (SELECT *, NOT fence AND NOT odd AND NOT starts_with(line, '#') AND NOT starts_with(line, '|') AND {speculative} AS moves FROM p4),
k4 AS (SELECT doc_id, coalesce(string_agg(line, {NL} ORDER BY n) FILTER (NOT moves), '') AS doc, coalesce(list(line ORDER BY n) FILTER (moves), []) AS moved FROM m4 GROUP BY doc_id),
g4 AS (SELECT o.* EXCLUDE (doc), k.doc, k.moved FROM g3 o JOIN k4 k USING (doc_id)),
{scope_steps('g5', 'g4')},
h6 AS (SELECT *, regexp_extract(doc, {q(head)}) AS head, {trim(f'regexp_extract(doc, {q(head)}, 1)')} AS title FROM g5),
r6 AS (SELECT *, CASE WHEN head = '' THEN '' ELSE substr(doc, instr(doc, head) + length(head)) END AS rest FROM h6),
g6 AS (SELECT *, CASE WHEN head = '' THEN doc ELSE left(doc, instr(doc, head) - 1) END AS before, left(rest, {_end('rest')} - 1) AS inside,
  substr(rest, {_end('rest')}) AS after, CASE WHEN title <> '' THEN title ELSE 'Template' END AS name FROM r6),
l7 AS (SELECT doc_id, {_lines('inside')} FROM g6),
c7 AS (SELECT *, regexp_matches(line, {q(candidate)}) AS cand, count(*) FILTER (regexp_matches(line, {q(candidate)})) OVER (PARTITION BY doc_id ORDER BY n) AS c FROM l7),
u7 AS (SELECT doc_id, c, min(n) AS n, string_agg(line, {NL} ORDER BY n) AS piece, {trim('first(line ORDER BY n)')} AS f FROM c7 GROUP BY doc_id, c),
v7 AS (SELECT *, c > 0 AND {_is('piece', gv.UNSAFE_CANDIDATE)} AS unsafe, {trim(name)} AS called FROM u7),
k7 AS (SELECT doc_id, coalesce(string_agg(piece, {NL} ORDER BY n) FILTER (NOT unsafe), '') AS body, coalesce(list(called ORDER BY n) FILTER (unsafe), []) AS removed FROM v7 GROUP BY doc_id),
g7 AS (SELECT * FROM g6 JOIN k7 USING (doc_id)),
t8 AS (SELECT doc_id, skill, project_type, unnest(ts) AS tool, generate_subscripts(ts, 1) AS i FROM (SELECT *, regexp_extract_all(body, {tools}) AS ts FROM g7) x),
n8 AS (SELECT doc_id, string_agg(tool, ', ' ORDER BY i) AS tools FROM t8 t WHERE NOT EXISTS (
  SELECT 1 FROM gnames g WHERE g.skill = t.skill AND g.project_type = t.project_type AND contains(g.nm, lower(t.tool))) GROUP BY doc_id),
g8 AS (SELECT *, head = '' AS absent, len(removed) > 0 AND {trim('body')} = '' AS emptied, regexp_extract(doc, {q(anti)}) AS ah FROM g7 LEFT JOIN n8 USING (doc_id)),
g9 AS (SELECT *, CASE WHEN absent OR emptied OR {_is('name', docs.NO_PATTERN)} OR {_is('body', docs.NO_PATTERN)} OR NOT {_is('head', single)} THEN NULL
  WHEN {_is('body', gv.UNSAFE_BODY)} THEN {q(gv.DOWNGRADED[0])} || name || {q(gv.DOWNGRADED[1])}
  WHEN tools IS NOT NULL THEN {q(gv.UNCONFIRMED[0])} || name || {q(gv.UNCONFIRMED[1])} || tools || {q(gv.UNCONFIRMED[2])} END AS issue FROM g8),
g10 AS (SELECT doc_id, skill, project_type, layer,
  list_concat(moved, list_transform(removed, lambda r: {q('- ' + pending + ' ' + before)} || r || {q(behind)}),
    CASE WHEN issue IS NULL THEN [] ELSE [{q('- ' + pending + ' ')} || issue] END, old_gaps) AS gaps,
  CASE WHEN absent AND {titled} THEN doc WHEN absent AND ah <> '' THEN {around} WHEN absent THEN {whole}
    WHEN emptied OR issue IS NOT NULL THEN {replaced} ELSE {kept} END AS doc FROM g9),
{appended_gaps('g11', 'g10')}
SELECT skill, project_type, layer, content FROM g11"""


EVIDENCE_NAMES = f"""{corpus.EVIDENCE_CTE}, owners AS (SELECT DISTINCT skill, project_type, project FROM v_governed_docs),
gnames AS (SELECT o.skill, o.project_type, lower(unnest(list_concat([CASE WHEN rule_id = 'ci-workflows' THEN 'runs SonarQube in CI' ELSE summary END], e.files))) AS nm
  FROM owners o JOIN evidence e ON o.project = e.project)"""
GOVERN = govern_sql(EVIDENCE_NAMES)
