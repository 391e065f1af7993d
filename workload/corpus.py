"""Queries over files: scanning, languages, evidence, samples and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitus.config import ScanConfig
from habitus.functions import globs, languages, paths
from habitus.functions.timefmt import format_duration, local_timestamp
from habitus.operators import evidence as ev
from habitus.operators import facts as fx
from habitus.operators import rules as rl
from habitus.operators import sampling, scanning
from workload.views import duck_with, view

CONFIG = ScanConfig()


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_files_raw")


def scanned(spark: SparkSession, sf: str) -> DataFrame:
    return scanning.scan_files(raw(spark, sf), CONFIG)


def facts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Facts of all raw files, from one read of the contents, and those the scan keeps."""
    every = fx.stored(fx.file_facts(raw(spark, sf), CONFIG))
    return every, fx.scanned_facts(every, CONFIG)


def types(spark: SparkSession, sf: str) -> DataFrame:
    return scanning.detect_project_type(raw(spark, sf))


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


# ---------------------------------------------------------------- SQL pieces

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


def language_case(path: str) -> str:
    name = f"regexp_extract({path}, '[^/]*$')"
    ext = f"lower(regexp_extract({name}, '\\.[^.]*$'))"
    whole = " ".join(f"WHEN {q(k)} THEN {q(v[2])}" for k, v in languages.FILE_NAMES.items())
    by_ext = " ".join(f"WHEN {q(k)} THEN {q(v[2])}" for k, v in languages.EXTENSIONS.items())
    return f"coalesce(CASE {name} {whole} END, CASE {ext} {by_ext} END, 'other')"


EXTENSION = "lower(regexp_extract(regexp_extract(path, '[^/]*$'), '\\.[^.]*$'))"

IGNORE_CTE = r"""
ign_lines AS (
  SELECT project, trim(l, ' ' || chr(9) || chr(13)) AS line FROM (
    SELECT project, unnest(string_split(content, chr(10))) AS l
    FROM v_files_raw WHERE path = '.gitignore') t),
ign_globs AS (
  SELECT project, line,
    CASE WHEN NOT contains(g, '*') AND NOT contains(g, '/') THEN '**/' || g || '/**'
         WHEN starts_with(g, '**') THEN g ELSE '**/' || g END AS pat
  FROM (SELECT project, line,
          regexp_replace(regexp_replace(line, '^/', ''), '/$', '/**') AS g
        FROM ign_lines WHERE line <> '' AND NOT starts_with(line, '#')) t),
ign_rx AS (
  SELECT project, '^(?:' || string_agg(replace(replace(replace(
      regexp_replace(regexp_replace(pat, '([.+^${}()|\[\]])', '\\\1', 'g'), '\*\*/?', chr(1), 'g'),
      '*', '[^/]*'), chr(1), '.*'), '?', '[^/]'), '|') || ')(?:/|$)' AS rx
  FROM ign_globs GROUP BY project)"""

FILES_CTE = f"""{duck_with('v_files_raw')},{IGNORE_CTE},
files AS (
  SELECT f.project, f.path, f.content, f.size, {language_case('f.path')} AS language,
    {EXTENSION.replace('path', 'f.path')} AS extension
  FROM v_files_raw f LEFT JOIN ign_rx i ON f.project = i.project
  WHERE f.size > 0 AND f.size <= {CONFIG.max_file_size}
    AND regexp_matches(f.path, {q('^' + globs.any_glob_regex(CONFIG.include) + '$')})
    AND NOT regexp_matches(f.path, {q('^' + globs.any_glob_regex(CONFIG.exclude) + '(?:/|$)')})
    AND NOT regexp_matches(regexp_replace(f.path, '(^|/)\\.(github|vscode)/', '\\1x/', 'g'), '(^|/)\\.[^/]*/')
    AND trim(f.content, {_SPACE}) <> ''
    AND NOT coalesce(regexp_matches(f.path, i.rx), false))"""

_has = lambda name: (
    f"(json_extract_string(deps, '$.\"{name}\"') IS NOT NULL"
    f" OR json_extract_string(dev, '$.\"{name}\"') IS NOT NULL)"
)
TYPES_CTE = f"""types AS (
  SELECT project, CASE
    WHEN {_has('vue')} THEN CASE WHEN regexp_matches(coalesce(
        json_extract_string(dev, '$.vue'), json_extract_string(deps, '$.vue'), ''), '^\\^?3')
        THEN 'vue3' ELSE 'vue2' END
    {' '.join(f"WHEN {_has(d)} THEN {q(k)}" for d, k in scanning.TYPE_BY_DEPENDENCY)}
    WHEN has_maven THEN 'spring-boot' WHEN has_go THEN 'go' WHEN has_cargo THEN 'rust'
    WHEN has_python THEN 'python' ELSE 'unknown' END AS project_type
  FROM (SELECT project,
      json_extract(max(CASE WHEN path = 'package.json' AND json_valid(content) THEN content END), '$.dependencies') AS deps,
      json_extract(max(CASE WHEN path = 'package.json' AND json_valid(content) THEN content END), '$.devDependencies') AS dev,
      bool_or(path IN ('pom.xml', 'build.gradle')) AS has_maven, bool_or(path = 'go.mod') AS has_go,
      bool_or(path = 'Cargo.toml') AS has_cargo,
      bool_or(path IN ('pyproject.toml', 'requirements.txt')) AS has_python
    FROM v_files_raw GROUP BY project) t)"""


class SqlText(str):
    """A SQL condition that composes like a column."""

    def __and__(self, other: str) -> SqlText:
        return SqlText(f"({self} AND {other})")

    def __or__(self, other: str) -> SqlText:
        return SqlText(f"({self} OR {other})")

    def __invert__(self) -> SqlText:
        return SqlText(f"(NOT {self})")


class SqlProbe:
    """The rule vocabulary in DuckDB SQL; helpers are written line by line."""

    production = SqlText(
        "NOT regexp_matches(path, '(^|/)(test|tests|__tests__|fixtures?|mocks?)/', 'i')"
    )

    def _rx(self, column: str, pattern: str, flags: str) -> SqlText:
        # RE2 has no escaped solidus and no [\s\S]; '.' with (?s) is the same set
        pattern = pattern.replace("\\/", "/").replace(r"[\s\S]", r"(?s:.)")
        mode = f"(?{flags})" if flags else ""
        return SqlText(f"regexp_matches({column}, {q(mode + pattern)})")

    def path(self, pattern: str, flags: str = "") -> SqlText:
        return self._rx("path", pattern, flags)

    def body(self, pattern: str, flags: str = "") -> SqlText:
        return self._rx("content", pattern, flags)

    def ext(self, *extensions: str) -> SqlText:
        return SqlText(f"extension IN ({', '.join(map(q, extensions))})")

    def _lines(self, condition: str) -> SqlText:
        return SqlText(
            "len(list_filter(list_transform(regexp_split_to_array(content, '\\r?\\n'),"
            f" lambda l: trim(l, {_SPACE})),"
            f" lambda t: t <> '' AND NOT starts_with(t, '//') AND NOT starts_with(t, '*')"
            f" AND ({condition}))) > 0"
        )

    def pinia(self) -> SqlText:
        found = [f"regexp_matches(t, {q(p)})" for p in rl.PINIA_LINES]
        found.append(f"(regexp_matches(t, {q(rl.PINIA_CREATE)}) AND NOT contains(t, '=>'))")
        return self._lines(" OR ".join(found))

    def security(self) -> SqlText:
        java = "extension = '.java'"
        script = "extension IN ('.ts', '.js', '.tsx', '.jsx', '.vue')"
        guarded = self.path(rl.PERMISSION_DIR, "i")
        return self._lines(
            f"({java} AND regexp_matches(t, {q(rl.JAVA_GUARD)}))"
            f" OR ({script} AND regexp_matches(t, {q(rl.PERMISSION_IMPORT)}))"
            f" OR ((extension = '.vue' OR {guarded}) AND regexp_matches(t, {q(rl.PERMISSION_DIRECTIVE)})"
            f" AND NOT contains(t, 'rules.includes'))"
            f" OR ({java} AND regexp_matches(t, {q(rl.SECURITY_TYPE)}))"
            f" OR regexp_matches(t, {q(rl.SANITIZE_CALL)})"
        )


def _rules_values(rules: list[rl.Rule] = rl.RULES) -> str:
    rows = [
        f"({q(r.id)}, {q(r.layer)}, {q(r.category)}, {q(r.summary)}, {r.min_high}, {r.min_medium},"
        f" [{', '.join(map(q, r.applies_to))}]::VARCHAR[])"
        for r in rules
    ]
    return (
        "rules AS (SELECT * FROM (VALUES " + ", ".join(rows) + ")"
        " AS t(rule_id, layer, category, summary, min_high, min_medium, applies_to))"
    )


def _applies() -> str:
    lists = {
        "frontend": rl.FRONTEND_TYPES,
        "node": rl.NODE_TYPES,
        "java": rl.JAVA_TYPES,
    }
    arms = " ".join(
        f"WHEN a = '{k}' THEN k IN ({', '.join(map(q, v))})" for k, v in lists.items()
    )
    return (
        "len(applies_to) = 0 OR len(list_filter(applies_to, lambda a: CASE "
        f"{arms} WHEN a = 'mixed' THEN contains(k, 'mixed') OR k = 'unknown' ELSE k = a END)) > 0"
    )


def _hits_cte(rules: list[rl.Rule] = rl.RULES) -> str:
    probe = SqlProbe()
    cases = ", ".join(
        f"CASE WHEN {r.when(probe)} THEN {q(r.id)} END" for r in rules
    )
    return f"""hits AS (
  SELECT project, path, unnest(list_filter([{cases}], lambda x: x IS NOT NULL)) AS rule_id FROM files)"""


def evidence_cte(rules: list[rl.Rule] = rl.RULES) -> str:
    return f"""{FILES_CTE}, {TYPES_CTE}, {_rules_values(rules)}, {_hits_cte(rules)},
found AS (
  SELECT project, rule_id, count(*) AS n,
    list_slice(list_sort(list(path)), 1, {ev.FILES_PER_RULE}) AS files
  FROM hits GROUP BY project, rule_id),
evidence AS (
  SELECT * FROM (SELECT f.project, coalesce(t.project_type, 'unknown') AS project_type, f.rule_id, r.layer,
    r.category, r.summary, r.applies_to, coalesce(t.project_type, 'unknown') AS k,
    CASE WHEN n >= min_high THEN 'high' WHEN n >= min_medium THEN 'medium' ELSE 'low' END AS confidence,
    f.files, n AS "count"
  FROM found f JOIN rules r ON f.rule_id = r.rule_id LEFT JOIN types t ON f.project = t.project) e
  WHERE {_applies()}),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY project ORDER BY layer,
    CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, "count" DESC, rule_id) AS position
  FROM evidence)"""


EVIDENCE_CTE = evidence_cte()


def _layer_score_sql(layer: str) -> str:
    parts = []
    for pattern, named, other in paths.LAYER_PATH_WEIGHTS:
        pattern = pattern.replace("\\/", "/")
        parts.append(
            f"CASE WHEN regexp_matches(lower(path), {q(pattern)}) THEN {named.get(layer, other)} ELSE 0 END"
        )
    return " + ".join(parts)


LAYER_SCORES = (
    "[" + ", ".join(f"{{'layer': '{l}', 'score': {_layer_score_sql(l)}}}" for l in paths.LAYERS) + "]"
)
PLAN_CTE = f"""{FILES_CTE},
scored AS (
  SELECT project, path, size, s.layer AS layer, CAST(s.score AS BIGINT) AS score
  FROM (SELECT project, path, size, unnest({LAYER_SCORES}) AS s FROM files) t),
plan AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, layer ORDER BY score DESC, size, path) AS position
    FROM scored WHERE score > 0) t WHERE position <= {sampling.LAYER_MAX_FILES})"""


def _is_code(language: str) -> str:
    dim = languages.language_dimension()
    other = [g for g, v in dim.items() if not v[2]]
    return f"{language} NOT IN ({', '.join(map(q, other))}, 'other')"


PRIORITY = f"""CASE WHEN regexp_extract(path, '[^/]*$') IN ({', '.join(map(q, languages.KEY_FILE_NAMES))}) THEN 0
  WHEN contains(regexp_extract(path, '[^/]*$'), 'config') OR contains(regexp_extract(path, '[^/]*$'), 'types')
    OR ends_with(path, '.d.ts') THEN 1
  WHEN {_is_code(language_case('path'))} THEN 2 ELSE 3 END"""

# Sequential budget: each row carries (spent so far, limit) through a recursion.
SAMPLES_CTE = f"""{PLAN_CTE},
queued AS (
  SELECT p.project, p.layer, p.path, p.score, length(f.content) AS len, length(f.content) - length(ltrim(f.content, {_SPACE})) AS lead,
    CASE WHEN p.score >= {paths.IMPORTANT_SCORE} THEN {sampling.LAYER_IMPORTANT_LIMIT} ELSE {sampling.LAYER_FILE_LIMIT} END AS cap,
    row_number() OVER (PARTITION BY p.project, p.layer ORDER BY p.score DESC, p.size, p.path) AS ord
  FROM plan p JOIN files f ON p.project = f.project AND p.path = f.path),
walk AS (
  WITH RECURSIVE w(project, layer, ord, path, lim, blank, total) AS (
    SELECT project, layer, ord, path, least(cap, {sampling.LAYER_BUDGET}), false,
      {{first}} FROM queued WHERE ord = 1
    UNION ALL
    SELECT q.project, q.layer, q.ord, q.path, least(q.cap, {sampling.LAYER_BUDGET} - w.total), {{blank}},
      w.total + CASE WHEN {{blank}} THEN 0 ELSE {{next}} END
    FROM w JOIN queued q ON q.project = w.project AND q.layer = w.layer AND q.ord = w.ord + 1
    WHERE w.total < {sampling.LAYER_BUDGET})
  SELECT project, layer, row_number() OVER (PARTITION BY project, layer ORDER BY ord) AS ord, path, lim FROM w WHERE NOT blank)"""


def _cut_len(length: str, limit: str) -> str:
    return (
        f"CASE WHEN {length} <= {limit} THEN {length} WHEN {limit} <= {sampling.HEAD_ONLY_LIMIT} THEN {limit}"
        f" ELSE CAST(floor({limit} * 0.6) AS BIGINT) + greatest(0, {limit} - CAST(floor({limit} * 0.6) AS BIGINT)"
        f" - {sampling.CUT_MARK_RESERVE}) + {len(sampling.CUT_MARK)} END"
    )


_LEFT = f"least(q.cap, {sampling.LAYER_BUDGET} - w.total)"
SAMPLES_CTE = SAMPLES_CTE.replace(
    "{first}", _cut_len("len", f"least(cap, {sampling.LAYER_BUDGET})")
).replace(
    "{blank}",
    f"(q.len > {_LEFT} AND {_LEFT} <= {sampling.HEAD_ONLY_LIMIT} AND q.lead >= {_LEFT})",
).replace("{next}", _cut_len("q.len", f"least(q.cap, {sampling.LAYER_BUDGET} - w.total)"))

# ------------------------------------------------------------------- queries


def scan_files(spark: SparkSession, sf: str) -> DataFrame:
    return scanned(spark, sf).select(
        "project", "path", "language", "extension", "size", F.sha2("content", 256).alias("content_hash")
    )


def glob_match(spark: SparkSession, sf: str) -> DataFrame:
    return raw(spark, sf).select(
        "project",
        "path",
        globs.match_globs(F.col("path"), ("src/**", "**/*.p?", "web/*/p1*.vue")).alias("matched"),
    )


def gitignore_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return scanning.gitignore_patterns(raw(spark, sf))


def discover_projects(spark: SparkSession, sf: str) -> DataFrame:
    return scanning.discover_projects(raw(spark, sf))


def group_by_language(spark: SparkSession, sf: str) -> DataFrame:
    return scanning.group_by_language(scanned(spark, sf)).select(
        "project", "language", "n_files", "total_size", F.col("position").cast("bigint").alias("position")
    )


def project_summary(spark: SparkSession, sf: str) -> DataFrame:
    return scanning.project_summary(scanned(spark, sf)).select(
        "project", F.array_join("languages", ",").alias("languages"), "file_count", "total_size"
    )


def file_attributes(spark: SparkSession, sf: str) -> DataFrame:
    path = F.col("path")
    return raw(spark, sf).select(
        "project",
        "path",
        paths.is_production_file(path).alias("production"),
        languages.detect_language(path).alias("language"),
        languages.display_name(languages.detect_language(path)).alias("display_name"),
        languages.category(languages.detect_language(path)).alias("category"),
        languages.is_code(languages.detect_language(path)).alias("is_code"),
        languages.file_priority(path).cast("bigint").alias("priority"),
    )


def layer_file_scores(spark: SparkSession, sf: str) -> DataFrame:
    return raw(spark, sf).select(
        "project", "path", F.explode(paths.layer_scores(F.col("path"))).alias("s")
    ).select(
        "project",
        "path",
        F.col("s.layer").alias("layer"),
        F.col("s.score").cast("bigint").alias("score"),
        (F.col("s.score") >= paths.IMPORTANT_SCORE).alias("important"),
    )


def line_probes(spark: SparkSession, sf: str) -> DataFrame:
    probe = rl.ColumnProbe(F.col("path"), F.col("extension"), F.col("content"))
    return scanned(spark, sf).select(
        "project", "path", probe.pinia().alias("pinia"), probe.security().alias("security")
    )


def rule_targets(spark: SparkSession, sf: str) -> DataFrame:
    kinds = types(spark, sf).select("project_type").distinct()
    table = F.array(
        *(
            F.struct(
                F.lit(r.id).alias("rule_id"),
                F.array(*(F.lit(t) for t in r.applies_to)).cast("array<string>").alias("applies_to"),
            )
            for r in rl.RULES
        )
    )
    return (
        kinds.select("project_type", F.inline(table))
        .filter(rl.rule_applies(F.col("applies_to"), F.col("project_type")))
        .select("project_type", "rule_id")
    )


def rule_hits(spark: SparkSession, sf: str) -> DataFrame:
    return ev.rule_hits(scanned(spark, sf))


def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return raw(spark, sf).select(
        "project", "path", F.sha2("content", 256).alias("content_hash")
    )


def scan_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return scanning.scan_fingerprint(scanned(spark, sf))


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    every, kept = facts(spark, sf)
    return ev.evidence_of_hits(fx.fact_hits(kept), fx.project_types(every))


def collect_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return ev.order_evidence(_evidence(spark, sf)).select(
        "project",
        "project_type",
        "rule_id",
        "layer",
        "category",
        "summary",
        "confidence",
        F.array_join("files", "|").alias("files"),
        "count",
        F.col("position").cast("bigint").alias("position"),
    )


def evidence_stats(spark: SparkSession, sf: str) -> DataFrame:
    every, kept = facts(spark, sf)
    kinds = fx.project_types(every)
    found = ev.evidence_of_hits(fx.fact_hits(kept), kinds)
    return ev.evidence_stats(found, kinds, ["project", "project_type"])


def evidence_prompt(spark: SparkSession, sf: str) -> DataFrame:
    every, kept = facts(spark, sf)
    kinds = fx.project_types(every)
    return ev.evidence_prompt(ev.evidence_of_hits(fx.fact_hits(kept), kinds), kinds)


def evidence_report(spark: SparkSession, sf: str) -> DataFrame:
    every, files = facts(spark, sf)
    kinds = fx.project_types(every)
    found = ev.evidence_of_hits(fx.fact_hits(files), kinds)
    head = ev.evidence_reports(scanning.project_summary(files), kinds, found)
    return ev.evidence_report_text(head, found, F.lit("2024-05-06 07:08:09").cast("timestamp"), "en")


def code_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.code_sample(scanned(spark, sf), 20_000).select(
        "project",
        F.col("position").cast("bigint").alias("position"),
        "path",
        F.length("content").cast("bigint").alias("n_chars"),
        F.md5(F.col("content")).alias("content_md5"),
    )


def layer_file_plan(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.layer_file_plan(scanned(spark, sf)).select(
        "project", "layer", F.col("position").cast("bigint").alias("position"), "path",
        F.col("score").cast("bigint").alias("score"),
    )


def _proposed(files: DataFrame) -> DataFrame:
    """A proposed plan as a completion would return it: paths, some of them unknown."""
    picked = sampling.layer_file_plan(files).select(
        "project", "layer", (F.lit(100) - F.col("position")).alias("ord"),
        F.when(F.col("position") % 3 == 0, F.concat(F.lit("gone/"), "path")).otherwise(F.col("path")).alias("path"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("ord", "path")))
    return picked.groupBy("project", "layer").agg(
        F.transform(ordered, lambda x: x["path"]).alias("paths")
    )


def sanitize_file_plan(spark: SparkSession, sf: str) -> DataFrame:
    files = scanned(spark, sf)
    return sampling.sanitize_file_plan(_proposed(files), files).withColumn(
        "position", F.col("position").cast("bigint")
    )


def merge_file_plans(spark: SparkSession, sf: str) -> DataFrame:
    files = scanned(spark, sf)
    chosen = sampling.sanitize_file_plan(_proposed(files), files)
    return sampling.merge_file_plans(chosen, sampling.layer_file_plan(files)).withColumn(
        "position", F.col("position").cast("bigint")
    )


def ignored_paths(spark: SparkSession, sf: str) -> DataFrame:
    files = raw(spark, sf)
    return fx.ignored_paths(files.select("project", "path"), files)


def layer_samples(spark: SparkSession, sf: str) -> DataFrame:
    kept = fx.write_facts(facts(spark, sf)[1])
    return sampling.layer_samples(sampling.layer_file_plan(kept), raw(spark, sf), kept).select(
        "project", "layer", F.col("position").cast("bigint").alias("position"), "path",
        F.length("content").cast("bigint").alias("n_chars"),
        F.md5(F.col("content")).alias("content_md5"),
    )


def file_listing(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.file_listing(scanned(spark, sf), 900)


def time_labels(spark: SparkSession, sf: str) -> DataFrame:
    calls = view(spark, sf, "v_calls")
    return calls.select(
        "event_id",
        format_duration(F.col("duration_ms") * (F.col("event_id") % 997)).alias("duration"),
        local_timestamp(F.col("called_at").cast("timestamp")).alias("local_time"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        scan_files, glob_match, gitignore_patterns, discover_projects, group_by_language,
        project_summary, file_attributes, layer_file_scores, line_probes, rule_targets, rule_hits,
        content_hashes, scan_fingerprint, collect_evidence, evidence_stats, evidence_prompt,
        evidence_report, code_sample, layer_file_plan, sanitize_file_plan, merge_file_plans,
        layer_samples, file_listing, time_labels, ignored_paths,
    )
}
QUERIES["detect_project_type"] = types

_PROPOSED = """prop AS (SELECT project, layer, position AS pos,
    CASE WHEN position % 3 = 0 THEN 'gone/' || path ELSE path END AS path FROM plan),
sane AS (SELECT project, layer, path, row_number() OVER (PARTITION BY project, layer ORDER BY pos DESC) AS position
  FROM prop p WHERE EXISTS (SELECT 1 FROM files f WHERE f.project = p.project AND f.path = p.path))"""

ORACLES = {
    "scan_files": f"WITH {FILES_CTE} SELECT project, path, language, extension, size, sha256(content) AS content_hash FROM files",
    "glob_match": f"""WITH {duck_with('v_files_raw')} SELECT project, path, (starts_with(path, 'src/')
        OR regexp_matches(path, '\\.p[^/]$') OR regexp_matches(path, '^web/[^/]*/p1[^/]*\\.vue$')) AS matched FROM v_files_raw""",
    "gitignore_patterns": f"WITH {duck_with('v_files_raw')}, {IGNORE_CTE} SELECT project, pat AS pattern FROM ign_globs",
    "detect_project_type": f"WITH {duck_with('v_files_raw')}, {TYPES_CTE} SELECT project, project_type FROM types",
    "discover_projects": f"""WITH {duck_with('v_files_raw')},
m AS (SELECT project AS root, path, len(string_split(path, '/')) AS depth, split_part(path, '/', 1) AS child,
        regexp_extract(path, '[^/]*$') IN ({', '.join(map(q, scanning.PROJECT_MARKERS))}) AS marker FROM v_files_raw),
r AS (SELECT root, bool_or(marker AND depth = 1) AS top FROM m GROUP BY root),
k AS (SELECT DISTINCT root, child FROM m WHERE marker AND depth = 2 AND NOT starts_with(child, '.') AND child <> 'node_modules')
SELECT root, '' AS project FROM r WHERE top OR root NOT IN (SELECT root FROM k)
UNION ALL SELECT k.root, k.child FROM k JOIN r ON k.root = r.root WHERE NOT r.top""",
    "group_by_language": f"""WITH {FILES_CTE} SELECT project, language, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS total_size,
      row_number() OVER (PARTITION BY project ORDER BY sum(size) DESC, language) AS position FROM files GROUP BY project, language""",
    "project_summary": f"""WITH {FILES_CTE}, g AS (SELECT project, language, count(*) AS n, sum(size) AS s FROM files GROUP BY project, language)
      SELECT project, string_agg(language, ',' ORDER BY s DESC, language) AS languages, CAST(sum(n) AS BIGINT) AS file_count,
      CAST(sum(s) AS BIGINT) AS total_size FROM g GROUP BY project""",
    "file_attributes": f"""WITH {duck_with('v_files_raw')},
dim AS (SELECT * FROM (VALUES {', '.join(f"({q(g)}, {q(n)}, {q(c)})" for g, (n, c, _) in languages.language_dimension().items())}) AS t(g, n, c)),
a AS (SELECT project, path, {language_case('path')} AS language FROM v_files_raw)
SELECT project, path, {SqlProbe.production} AS production, language,
  coalesce(n, upper(language[1:1]) || language[2:]) AS display_name, coalesce(c, 'other') AS category,
  {_is_code('language')} AS is_code, CAST({PRIORITY} AS BIGINT) AS priority FROM a LEFT JOIN dim ON language = g""",
    "layer_file_scores": f"""WITH {duck_with('v_files_raw')} SELECT project, path, s.layer AS layer, CAST(s.score AS BIGINT) AS score,
      s.score >= {paths.IMPORTANT_SCORE} AS important FROM (SELECT project, path, unnest({LAYER_SCORES}) AS s FROM v_files_raw) t""",
    "line_probes": f"WITH {FILES_CTE} SELECT project, path, {SqlProbe().pinia()} AS pinia, {SqlProbe().security()} AS security FROM files",
    "rule_targets": f"""WITH {duck_with('v_files_raw')}, {TYPES_CTE}, {_rules_values()}
      SELECT k AS project_type, rule_id FROM (SELECT DISTINCT project_type AS k FROM types) t, rules WHERE {_applies()}""",
    "rule_hits": f"WITH {FILES_CTE}, {_hits_cte()} SELECT project, rule_id, path FROM hits",
    "content_hashes": f"WITH {duck_with('v_files_raw')} SELECT project, path, sha256(content) AS content_hash FROM v_files_raw",
    "scan_fingerprint": f"""WITH {FILES_CTE}, d AS (SELECT project, sha256(path || chr(31) || size || chr(31) || sha256(content)) AS h FROM files)
      SELECT project, count(*) AS file_count, sha256(count(*) || ':' || {" || ':' || ".join(
        f"sum(CAST('0x' || h[{1 + 15 * i}:{15 + 15 * i}] AS BIGINT))" for i in range(4))}) AS scan_hash FROM d GROUP BY project""",
    "collect_evidence": f"""WITH {EVIDENCE_CTE} SELECT project, project_type, rule_id, layer, category, summary, confidence,
      array_to_string(files, '|') AS files, "count", position FROM ordered""",
    "evidence_stats": f"""WITH {EVIDENCE_CTE} SELECT t.project, t.project_type, count(e.rule_id) AS item_count,
      count(DISTINCT e.layer) AS covered_layers, count(*) FILTER (confidence = 'high') AS high,
      count(*) FILTER (confidence = 'medium') AS medium, count(*) FILTER (confidence = 'low') AS low,
      count(e.rule_id) = 0 AS missing
      FROM types t LEFT JOIN evidence e ON t.project = e.project GROUP BY t.project, t.project_type""",
    "evidence_prompt": f"""WITH {EVIDENCE_CTE}, l AS (SELECT project, string_agg('- ' || layer || '/' || category || ' [' || confidence || ', '
        || "count" || ' file(s)]: ' || summary || ' Evidence files: ' || array_to_string(files[1:{ev.FILES_PER_PROMPT_LINE}], ', '),
        chr(10) ORDER BY position) AS lines FROM ordered GROUP BY project)
      SELECT t.project, coalesce({q(ev.PROMPT_HEAD)} || lines, {q(ev.EMPTY_PROMPT)}) AS prompt FROM types t LEFT JOIN l ON t.project = l.project""",
    "evidence_report": f"""WITH {EVIDENCE_CTE}, g AS (SELECT project, language, count(*) AS n, sum(size) AS s FROM files GROUP BY project, language),
      h AS (SELECT project, string_agg(language, ', ' ORDER BY s DESC, language) AS langs, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY project),
      r AS (SELECT project, count(*) AS items, string_agg('| ' || layer || ' | ' || category || ' | ' || confidence || ' | ' || "count" || ' | '
        || replace(summary, '|', '\\|') || ' | ' || replace(array_to_string(files, '<br>'), '|', '\\|') || ' |', chr(10) ORDER BY position) AS rows
        FROM ordered GROUP BY project)
      SELECT h.project, concat_ws(chr(10), '# Evidence · ' || t.project_type, '', 'Generated at: 2024-05-06 07:08:09 GMT+0', '', '## Summary', '',
        '- Files scanned: ' || h.n, '- Languages: ' || langs, '- Evidence items: ' || coalesce(items, 0), '', '## Evidence Table', '',
        '| Layer | Category | Confidence | Count | Evidence | Files |', '|-------|----------|------------|-------|----------|-------|', rows, '',
        '> This file is deterministic evidence extracted before the LLM synthesis step.') AS report
      FROM h LEFT JOIN types t ON h.project = t.project LEFT JOIN r ON h.project = r.project""",
    "code_sample": f"""WITH {FILES_CTE}, m AS (SELECT project, path, content, size, {PRIORITY} AS priority,
        CASE WHEN length(content) > {sampling.SAMPLE_FILE_LIMIT} THEN left(content, {sampling.SAMPLE_HALF}) || {q(sampling.CUT_MARK)}
          || right(content, {sampling.SAMPLE_HALF}) ELSE content END AS cut FROM files),
      w AS (SELECT *, sum(length(cut)) OVER (PARTITION BY project ORDER BY priority, size, path
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
          row_number() OVER (PARTITION BY project ORDER BY priority, size, path) AS position FROM m)
      SELECT project, position, path, length(cut) AS n_chars, md5(cut) AS content_md5 FROM w WHERE coalesce(before, 0) < 20000""",
    "layer_file_plan": f"WITH {PLAN_CTE} SELECT project, layer, position, path, score FROM plan",
    "sanitize_file_plan": f"WITH {PLAN_CTE}, {_PROPOSED} SELECT project, layer, position, path FROM sane",
    "merge_file_plans": f"""WITH {PLAN_CTE}, {_PROPOSED}, u AS (SELECT project, layer, path, min(src * 1000 + position) AS o FROM (
        SELECT project, layer, path, position, 0 AS src FROM sane UNION ALL SELECT project, layer, path, position, 1 AS src FROM plan) t
        GROUP BY project, layer, path)
      SELECT * FROM (SELECT project, layer, row_number() OVER (PARTITION BY project, layer ORDER BY o) AS position, path FROM u) t
      WHERE position <= {sampling.LAYER_MAX_FILES}""",
    "layer_samples": f"""WITH {SAMPLES_CTE}, cut AS (SELECT w.project, w.layer, w.ord AS position, w.path,
        CASE WHEN length(f.content) <= lim THEN f.content WHEN lim <= {sampling.HEAD_ONLY_LIMIT} THEN left(f.content, lim)
          ELSE left(f.content, CAST(floor(lim * 0.6) AS BIGINT)) || {q(sampling.CUT_MARK)} ||
            right(f.content, greatest(0, lim - CAST(floor(lim * 0.6) AS BIGINT) - {sampling.CUT_MARK_RESERVE})) END AS c
        FROM walk w JOIN files f ON w.project = f.project AND w.path = f.path)
      SELECT project, layer, position, path, length(c) AS n_chars, md5(c) AS content_md5 FROM cut""",
    "file_listing": f"""WITH {FILES_CTE}, l AS (SELECT project, path || ' (' || language || ', ' || size || ' bytes)' AS line FROM files),
      w AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY project ORDER BY line ROWS UNBOUNDED PRECEDING) AS used FROM l),
      g AS (SELECT project, count(*) AS n, count(*) FILTER (used <= 900) AS k, string_agg(line, chr(10) ORDER BY line) FILTER (used <= 900) AS shown FROM w GROUP BY project)
      SELECT project, concat_ws(chr(10), shown, CASE WHEN n > k THEN '... ' || (n - k) || ' more file(s) omitted' END) AS listing FROM g""",
    "ignored_paths": f"""WITH {duck_with('v_files_raw')}, {IGNORE_CTE}
      SELECT f.project, f.path FROM v_files_raw f JOIN ign_rx i ON f.project = i.project WHERE regexp_matches(f.path, i.rx)""",
    "time_labels": f"""WITH {duck_with('v_calls')}, d AS (SELECT event_id, called_at, duration_ms * (event_id % 997) AS ms FROM v_calls),
      e AS (SELECT *, CAST(floor(ms / 1000 + 0.5) AS BIGINT) AS s FROM d)
      SELECT event_id, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm ' || s % 60 || 's'
        ELSE s // 3600 || 'h ' || s // 60 % 60 || 'm ' || s % 60 || 's' END AS duration, strftime(called_at, '%Y-%m-%d %H:%M:%S') || ' GMT+0' AS local_time FROM e""",
}
