"""Queries over generated documents, prompts and completions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitus.functions import patterns as rxp
from habitus.operators import completion, prompts, sampling
from habitus.operators import documents as docs
from habitus.operators import evidence as ev
from habitus.operators import governance as gv
from habitus.operators import runs as rn
from habitus.operators import scanning
from habitus.operators.rules import RULES, Rule, register_rule
from habitus.session import cut_lineage
from workload import corpus, governed
from workload import documents as wd
from workload import sqltext as s
from workload.documents import KEY
from workload.sqltext import q, rx, sub, trim
from workload.views import duck_with, table, view

PLANNED = ["project", "layer"]


def drafts(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_governed_docs")


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence of the drafts' projects; one item names a tool, as a summary may."""
    owners = drafts(spark, sf).select(*KEY, "project").distinct()
    found = corpus._evidence(spark, sf).drop("project_type").withColumn(
        "summary", F.when(F.col("rule_id") == "ci-workflows", "runs SonarQube in CI").otherwise(F.col("summary"))
    )
    return owners.join(found, "project").drop("project")


def partition_speculative(spark: SparkSession, sf: str) -> DataFrame:
    rows = drafts(spark, sf).select(*KEY, "layer", docs.let(F.col("content"), gv.partition_speculative).alias("p"))
    return rows.select(
        *KEY, "layer", F.md5("p.kept").alias("kept_md5"), F.array_join("p.gaps", "\n").alias("gaps")
    )


def extract_gap_sections(spark: SparkSession, sf: str) -> DataFrame:
    rows = drafts(spark, sf).select(*KEY, "layer", gv.extract_gap_sections(F.col("content")).alias("g"))
    return rows.select(*KEY, "layer", F.array_join("g.gaps", "\n").alias("gaps"),
                       F.contains(F.col("g.kept"), F.lit("### Gaps")).alias("left_over"))


def strip_unsafe_templates(spark: SparkSession, sf: str) -> DataFrame:
    found = drafts(spark, sf).select(*KEY, "layer", F.posexplode(docs.sections(F.col("content"))).alias("pos", "s"))
    rows = found.select(*KEY, "layer", "pos", gv.strip_unsafe_templates(F.col("s.body")).alias("t"))
    return rows.select(
        *KEY, "layer", F.col("pos").cast("bigint").alias("pos"),
        F.md5(rxp.trim(F.col("t.kept"))).alias("kept_md5"), F.array_join("t.removed", "|").alias("removed"),
    )


def confirm_tools(spark: SparkSession, sf: str) -> DataFrame:
    named = drafts(spark, sf).select(*KEY, "layer", F.col("content").alias("body"))
    return gv.confirm_tools(named, _evidence(spark, sf)).select(
        *KEY, "layer", F.array_join("unconfirmed", "|").alias("unconfirmed")
    )


def ensure_scope(spark: SparkSession, sf: str) -> DataFrame:
    filled = gv.ensure_scope(F.col("content"), F.col("layer"), "en")
    return drafts(spark, sf).select(*KEY, "layer", F.md5(filled).alias("content_md5"))


def regroup_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Gap sections wherever they stand, cut out and written as one at the end."""
    rows = drafts(spark, sf).select(*KEY, "layer", gv.extract_gap_sections(F.col("content")).alias("g"))
    whole = gv.append_gaps(F.col("g.kept"), F.col("g.gaps"), "en")
    return rows.select(*KEY, "layer", F.md5(whole).alias("content_md5"))


def govern(spark: SparkSession, sf: str) -> DataFrame:
    return gv.govern(drafts(spark, sf), _evidence(spark, sf), "en")


def fill_required_sections(spark: SparkSession, sf: str) -> DataFrame:
    filled = gv.fill_required_sections(drafts(spark, sf).select(*KEY, "layer", "content"), "en")
    return filled.select(*KEY, "layer", F.md5("content").alias("content_md5"))


def type_overview(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.type_overview(scanning.project_summary(corpus.scanned(spark, sf)), corpus.types(spark, sf))


def layer_prompts(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus.scanned(spark, sf)
    samples = sampling.layer_samples(sampling.layer_file_plan(files), files)
    kinds = corpus.types(spark, sf)
    asked = ev.evidence_prompt(ev.collect_evidence(files, kinds), kinds)
    return prompts.layer_prompts(samples, asked, language="en").select(
        *PLANNED, F.length("prompt").cast("bigint").alias("n_chars"), F.md5("prompt").alias("prompt_md5")
    )


def _one_document(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """(project, layer, content): of a layer's documents that of the first reference."""
    return view(spark, sf, name).groupBy("project", "layer").agg(
        F.min_by("content", F.concat_ws("/", "skill", "project_type")).alias("content")
    )


def update_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts of a second learning: earlier documents, what became of their rules, layers written so far."""
    files = corpus.scanned(spark, sf)
    samples = sampling.layer_samples(sampling.layer_file_plan(files), files)
    kinds = corpus.types(spark, sf)
    asked = ev.evidence_prompt(ev.collect_evidence(files, kinds), kinds)
    known = view(spark, sf, "v_layer_docs").select(
        "project", "layer", F.concat_ws(" ", "skill", "project_type", F.lit("rule")).alias("text"),
        (F.length("content") % 2 == 0).alias("stale"),
    )
    return prompts.layer_prompts(
        samples, asked, _one_document(spark, sf, "v_governed_docs"), prompts.update_policy(known), "en",
        _one_document(spark, sf, "v_layer_docs"),
    ).select(*PLANNED, F.length("prompt").cast("bigint").alias("n_chars"), F.md5("prompt").alias("prompt_md5"))


def register_rule_query(spark: SparkSession, sf: str) -> DataFrame:
    """The whole rule set with one rule more."""
    rules = register_rule(
        "long-article", "L3", "Prose", "Long text with an article.",
        lambda f: f.ext(".md", ".html") & f.body(r"\bthe\b", "i"), min_high=3,
    )
    found = ev.collect_evidence(corpus.scanned(spark, sf), corpus.types(spark, sf), rules)
    return found.select("project", "rule_id", "confidence", "count")


def _echo(prompt: str, max_tokens: int) -> dict:
    """A deterministic completion: its answer is cut off while the budget is short."""
    words = prompt.split()
    need = 200 * (1 + len(words) % 40)
    if not words:
        return {"content": "", "finish_reason": "stop", "usage": {"prompt_tokens": 0}}
    if len(words) % 7 == 0:
        return {"content": "", "finish_reason": "stop"}
    finish = "length" if need > max_tokens else "stop"
    usage = {"prompt_tokens": len(words), "completion_tokens": min(need, max_tokens), "total_tokens": len(words) + min(need, max_tokens)}
    return {"content": words[0], "finish_reason": finish, "usage": usage}


def _completed(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("run_id"), F.col("role").alias("phase"), "conv_id", "turn",
        F.col("text").alias("prompt"),
    )
    return completion.complete(asked, _echo, 1_000)


def complete(spark: SparkSession, sf: str) -> DataFrame:
    rows = _completed(spark, sf)
    return rows.select(
        "conv_id", "turn", F.coalesce("response", F.lit("")).alias("response"),
        F.size("attempts").cast("bigint").alias("n_attempts"),
        F.element_at("attempts", -1)["max_tokens"].cast("bigint").alias("last_budget"),
    )


def completion_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Measures of the attempts a batch completion logged."""
    calls = completion.call_rows(_completed(spark, sf), "run_id", "phase")
    return rn.phase_metrics(calls).drop("llm_duration_ms")


QUERIES = {
    f.__name__: f
    for f in (
        partition_speculative, extract_gap_sections, strip_unsafe_templates, confirm_tools, govern,
        ensure_scope, regroup_gaps, update_prompts,
        fill_required_sections, type_overview, layer_prompts, complete, completion_calls,
    )
}
QUERIES["register_rule"] = register_rule_query

# ----------------------------------------------------------------- SQL side

_ARTICLE = Rule(
    "long-article", "L3", "Prose", "Long text with an article.",
    lambda f: f.ext(".md", ".html") & f.body(r"\bthe\b", "i"), min_high=3,
)
_BS = chr(92)
_GOV = f"WITH {duck_with('v_governed_docs')},{s.lines_cte('v_governed_docs', doc='skill, project_type, layer')}"
_GOV = f"""WITH {duck_with('v_governed_docs')}, gdocs AS (SELECT *, row_number() OVER (ORDER BY skill, project_type, layer) AS doc_id FROM v_governed_docs),{s.lines_cte('gdocs')}"""
# a look-ahead is written out: not followed by the character, or at the end
_SPEC = (
    gv.SPECULATION.replace("推测(?!的)", "推测(?:[^的]|$)").replace("推断(?!的)", "推断(?:[^的]|$)")
    .replace("可能(?!是)", "可能(?:[^是]|$)")
)
_SPECLINE = (
    f"(regexp_matches(t, {q('(?i)' + gv.META_LINE)}) OR (NOT regexp_matches(t, '(?i)无现有模式|no existing pattern') AND regexp_matches(t, {q('(?i)' + _SPEC)})))"
)
_FENCED = f"""gf AS (SELECT *, starts_with(t, '```') AS fence, count(*) FILTER (starts_with(t, '```')) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) % 2 = 1 AS odd FROM lines),
gm AS (SELECT *, NOT fence AND NOT odd AND NOT starts_with(line, '#') AND NOT starts_with(line, '|') AND {_SPECLINE} AS moves FROM gf)"""
_CAND = wd._CAND
_TOOL_RX = q(r"(?i)\b(?:" + gv.TOOLS.removeprefix(r"\b(?:"))
_GEV = corpus.EVIDENCE_CTE + """, owners AS (SELECT DISTINCT skill, project_type, project FROM v_governed_docs),
gnames AS (SELECT o.skill, o.project_type, lower(unnest(list_concat([CASE WHEN rule_id = 'ci-workflows' THEN 'runs SonarQube in CI' ELSE summary END], e.files))) AS nm
  FROM owners o JOIN evidence e ON o.project = e.project)"""


def _label_sql() -> str:
    labels = gv.SECTION_LABELS["en"]
    text, meta, specs = gv.TEXTS["en"], prompts.LAYER_META["en"], prompts.LAYER_SPECS["en"]
    per_layer = lambda pick: "CASE layer " + " ".join(
        f"WHEN {q(l)} THEN {q(pick(l))}" for l in meta
    ) + " END"
    bodies = [
        per_layer(lambda l: f"- Owns: {meta[l][0]}\n- Does not own: {meta[l][1]}\n- Task uses: {', '.join(meta[l][2])}"),
        q("- No existing pattern."),
        per_layer(lambda l: f"#### {specs[l][1]}\nNo existing pattern"),
        q("- No existing pattern."), q(text["evidence"]), q("- None."),
    ]
    return " || ".join(
        f"CASE WHEN len(list_filter(hs, lambda h: contains(h, {q(lb.lower())}) OR contains({q(lb.lower())}, h))) > 0 THEN ''"
        f" ELSE chr(10) || chr(10) || {q('### ' + lb)} || chr(10) || {b} END"
        for lb, b in zip(labels, bodies)
    )


_BRIEFS = ", ".join(f"({q(l)}, {q(prompts.layer_brief(l, 'en'))})" for l in docs.LAYER_NAMES)
_MD = "list_filter([{c}], lambda x: x IS NOT NULL)"
_PROMPT_EV = corpus.ORACLES["evidence_prompt"]
_SAMPLE_SQL = corpus.ORACLES["layer_samples"].replace(
    "SELECT project, layer, position, path, length(c) AS n_chars, md5(c) AS content_md5 FROM cut",
    "SELECT project, layer, position, path, c FROM cut",
)
_WORDS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))"
_NEED = "200 * (1 + w % 40)"
_ASK = f"""WITH c AS (SELECT conv_id, turn, role, text, {_WORDS} AS w, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')[1] AS first FROM conversations),
d AS (SELECT *, CASE WHEN w = 0 OR w % 7 = 0 THEN 1 WHEN {_NEED} <= 1000 THEN 1 WHEN {_NEED} <= 5096 THEN 2 ELSE 3 END AS n, {_NEED} AS need FROM c)"""
_ATT = f"""{_ASK}, a AS (SELECT conv_id, role, length(text) AS rc, w, need, n, i, CASE i WHEN 1 THEN 1000 WHEN 2 THEN 5096 ELSE 5096 END AS budget, length(first) AS fl
  FROM d, range(1, 4) AS r(i) WHERE i <= n),
b AS (SELECT *, w > 0 AND w % 7 <> 0 AS answered, w > 0 AND w % 7 <> 0 AND need <= budget AS ok FROM a)"""

ORACLES = {
    "ensure_scope": governed.ENSURE_SCOPE,
    "regroup_gaps": governed.REGROUP_GAPS,
    "govern": governed.GOVERN,
    "partition_speculative": f"""{_GOV}, {_FENCED} SELECT d.skill, d.project_type, d.layer, md5(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT moves), '')) AS kept_md5,
      coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (moves), '') AS gaps FROM gm JOIN gdocs d USING (doc_id) GROUP BY ALL""",
    "extract_gap_sections": f"""{_GOV}, gl AS (SELECT doc_id, n, t FROM body_lines WHERE regexp_matches(title, '(?i)^(?:缺口|待验证|To Verify|Unverified|⚠️\\s*Gaps|Gaps)$')
        AND t <> '' AND NOT {rx('t', r'^####' + _BS + 's+')} AND NOT regexp_matches(t, '^---+$') AND NOT regexp_matches(t, '(?i)^-+\\s*(?:无|None|N/A)[。.]?$'))
      SELECT d.skill, d.project_type, d.layer, coalesce(string_agg(t, chr(10) ORDER BY n), '') AS gaps, false AS left_over FROM gdocs d LEFT JOIN gl USING (doc_id) GROUP BY ALL""",
    "strip_unsafe_templates": f"""{_GOV}, cl AS (SELECT *, {_CAND} AS cand, count(*) FILTER ({_CAND}) OVER (PARTITION BY doc_id, sid ORDER BY n ROWS UNBOUNDED PRECEDING) AS c FROM body_lines),
      cb AS (SELECT doc_id, sid, c, string_agg(line, chr(10) ORDER BY n) AS txt, min(n) AS n0,
        first(CASE WHEN cand THEN {trim(sub(sub('t', r'^####' + _BS + 's+', ''), r'^' + _BS + '*' + _BS + '*(.+?)' + _BS + '*' + _BS + '*$', _BS + '1'))} END ORDER BY n) AS h FROM cl GROUP BY ALL),
      cu AS (SELECT *, c > 0 AND regexp_matches(txt, {q('(?i)' + gv.UNSAFE_CANDIDATE)}) AS unsafe FROM cb),
      k AS (SELECT doc_id, sid, string_agg(txt, chr(10) ORDER BY n0) FILTER (NOT unsafe) AS kept, string_agg(h, '|' ORDER BY n0) FILTER (unsafe) AS removed FROM cu GROUP BY ALL)
      SELECT d.skill, d.project_type, d.layer, row_number() OVER (PARTITION BY s.doc_id ORDER BY s.sid) - 1 AS pos, md5({trim("coalesce(kept, '')")}) AS kept_md5, coalesce(removed, '') AS removed
      FROM secs s JOIN gdocs d USING (doc_id) LEFT JOIN k USING (doc_id, sid)""",
    "confirm_tools": f"""WITH {duck_with('v_governed_docs')}, {_GEV},
      tools AS (SELECT skill, project_type, layer, unnest(t) AS tool, generate_subscripts(t, 1) AS i FROM (SELECT *, regexp_extract_all(content, {_TOOL_RX}) AS t FROM v_governed_docs) x),
      un AS (SELECT * FROM tools t WHERE NOT EXISTS (SELECT 1 FROM gnames g WHERE g.skill = t.skill AND g.project_type = t.project_type AND contains(g.nm, lower(t.tool))))
      SELECT d.skill, d.project_type, d.layer, coalesce(string_agg(tool, '|' ORDER BY i), '') AS unconfirmed FROM v_governed_docs d LEFT JOIN un USING (skill, project_type, layer) GROUP BY ALL""",
    "fill_required_sections": f"""WITH {duck_with('v_governed_docs')}, h AS (SELECT *, list_transform(regexp_extract_all(content, '(?m)^###[ \\t]+(.+)$', 1),
        lambda x: {trim(s.squeeze("regexp_replace(lower(x), '[：:]', '', 'g')"))}) AS hs FROM v_governed_docs)
      SELECT skill, project_type, layer, md5({trim(trim('content') + ' || ' + _label_sql())}) AS content_md5 FROM h""",
    "type_overview": f"""WITH {corpus.FILES_CTE}, {corpus.TYPES_CTE}, dim AS (SELECT * FROM (VALUES {', '.join(f"({q(g)}, {q(n)})" for g, (n, _, _) in corpus.languages.language_dimension().items())}) AS t(g, nm)),
      g AS (SELECT project, language, count(*) AS n, sum(size) AS s FROM files GROUP BY ALL)
      SELECT g.project, first(t.project_type) || ' · ' || string_agg(coalesce(nm, upper(language[1:1]) || language[2:]), ' · ' ORDER BY s DESC, language) AS title, CAST(sum(n) AS BIGINT) AS file_count
      FROM g JOIN types t ON t.project = g.project LEFT JOIN dim ON dim.g = language GROUP BY g.project""",
    "layer_prompts": f"""WITH sm AS ({_SAMPLE_SQL}), pe AS ({_PROMPT_EV}), br AS (SELECT * FROM (VALUES {_BRIEFS}) AS t(layer, brief)),
      sb AS (SELECT project, layer, '## Layer-Relevant Code Evidence' || chr(10) || chr(10) || string_agg('### ' || path || chr(10) || '```' || chr(10) || c || chr(10) || '```', chr(10) || chr(10) ORDER BY position) AS b FROM sm GROUP BY ALL),
      p AS (SELECT pe.project, br.layer, br.brief || chr(10) || chr(10) || pe.prompt || chr(10) || chr(10) || coalesce(sb.b, {q(prompts.NO_SAMPLES)}) AS x
        FROM pe CROSS JOIN br LEFT JOIN sb ON sb.project = pe.project AND sb.layer = br.layer)
      SELECT project, layer, length(x) AS n_chars, md5(x) AS prompt_md5 FROM p""",
    "update_prompts": f"""WITH sm AS ({_SAMPLE_SQL}), pe AS ({_PROMPT_EV}), br AS (SELECT * FROM (VALUES {_BRIEFS}) AS t(layer, brief)),
      sb AS (SELECT project, layer, '## Layer-Relevant Code Evidence' || chr(10) || chr(10) || string_agg('### ' || path || chr(10) || '```' || chr(10) || c || chr(10) || '```', chr(10) || chr(10) ORDER BY position) AS b FROM sm GROUP BY ALL),
      {duck_with('v_governed_docs', 'v_layer_docs')},
      old AS (SELECT project, layer, arg_min(content, skill || '/' || project_type) AS c FROM v_governed_docs GROUP BY ALL),
      cut AS (SELECT project, layer, CASE WHEN length(c) <= 6000 THEN c ELSE left(c, 3600) || {q(sampling.CUT_MARK)} || right(c, 6000 - 3600 - {sampling.CUT_MARK_RESERVE}) END AS c FROM old),
      new AS (SELECT project, layer, arg_min(content, skill || '/' || project_type) AS c FROM v_layer_docs GROUP BY ALL),
      pts AS (SELECT project, layer, regexp_extract_all(c, '(?m)^#{{2,3}}[ \t]+.+')[1:8] AS hs, row_number() OVER (PARTITION BY project ORDER BY layer) AS i FROM new),
      pri AS (SELECT br.layer, pts.project, {q(prompts.PRIOR_HEAD)} || chr(10) || string_agg('Layer ' || i || ', written:' || chr(10) ||
        CASE WHEN len(hs) = 0 THEN '(no headers)' ELSE array_to_string(hs, chr(10)) END, chr(10) ORDER BY i) AS prior FROM br JOIN pts ON pts.layer < br.layer GROUP BY ALL),
      rl AS (SELECT project, layer, skill || ' ' || project_type || ' rule' AS text, length(content) % 2 = 0 AS stale FROM v_layer_docs),
      st AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY layer, text) AS r FROM rl WHERE stale),
      po AS (SELECT project, '## Update Trace Policy' || chr(10) || '- Rules still supported by files: ' || count(*) FILTER (NOT stale) || chr(10)
        || '- Rules whose cited files disappeared: ' || count(*) FILTER (stale) AS head FROM rl GROUP BY project),
      qu AS (SELECT project, string_agg(chr(10) || '- STALE ' || layer || ': ' || text, '' ORDER BY r) AS quoted FROM st WHERE r <= {prompts.STALE_SHOWN} GROUP BY project),
      p AS (SELECT pe.project, br.layer, concat_ws(chr(10) || chr(10), br.brief, pri.prior, pe.prompt, po.head || coalesce(qu.quoted, ''),
          '## Existing ' || br.layer || chr(10) || '```markdown' || chr(10) || cut.c || chr(10) || '```', coalesce(sb.b, {q(prompts.NO_SAMPLES)})) AS x
        FROM pe CROSS JOIN br LEFT JOIN sb ON sb.project = pe.project AND sb.layer = br.layer LEFT JOIN pri ON pri.project = pe.project AND pri.layer = br.layer
        LEFT JOIN po ON po.project = pe.project LEFT JOIN qu ON qu.project = pe.project LEFT JOIN cut ON cut.project = pe.project AND cut.layer = br.layer)
      SELECT project, layer, length(x) AS n_chars, md5(x) AS prompt_md5 FROM p""",
    "complete": f"""{_ASK} SELECT conv_id, turn, CASE WHEN w > 0 AND w % 7 <> 0 AND need <= 5096 THEN first ELSE '' END AS response, n AS n_attempts,
      CASE n WHEN 1 THEN 1000 ELSE 5096 END AS last_budget FROM d""",
    "completion_calls": f"""{_ATT} SELECT CAST(conv_id AS VARCHAR) AS run_id, role AS phase, count(*) AS requests, count(*) FILTER (i = 1) AS turns, count(*) FILTER (i > 1) AS retries,
      count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, CAST(sum(rc) AS BIGINT) AS request_chars,
      CAST(sum(CASE WHEN answered THEN fl ELSE 0 END) AS BIGINT) AS response_chars, CAST(sum(CASE WHEN answered THEN w ELSE 0 END) AS BIGINT) AS prompt_tokens,
      CAST(sum(CASE WHEN answered THEN least(need, budget) ELSE 0 END) AS BIGINT) AS completion_tokens, CAST(0 AS BIGINT) AS reasoning_tokens,
      CAST(sum(CASE WHEN answered THEN w + least(need, budget) ELSE 0 END) AS BIGINT) AS total_tokens FROM b GROUP BY ALL""",
    "register_rule": corpus.evidence_cte([*RULES, _ARTICLE]).join(
        ["WITH ", """ SELECT project, rule_id, confidence, "count" FROM evidence"""]
    ),
}
