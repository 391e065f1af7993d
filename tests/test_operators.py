"""Operators against small loops and hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from habitus.functions import globs
from habitus.functions.timefmt import format_duration
from habitus.operators import catalog, documents as docs, governance as gv, overview as ov
from habitus.operators import runs, sampling, scanning, trace as tr, verify as vf
from habitus.operators.completion import call_rows, complete, complete_missing, grown
from habitus.operators.documents import let
from habitus.sources import artifacts
from habitus.sources.logs import read_calls
from habitus.sources.tree import read_tree
from habitus.streaming import metrics as st

RAW = "project string, path string, content string, size bigint"


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "pattern, path, expected",
    [
        ("**/*.ts", "a.ts", True),
        ("**/*.ts", "src/b/a.ts", True),
        ("**/dist/**", "xdist/a", True),
        ("src/?.ts", "src/a.ts", True),
        ("src/?.ts", "src/ab.ts", False),
        ("a.b", "axb", False),
        ("src/*", "src/a/b", False),
        ("**/*.ts", "src\\a.ts", True),
    ],
)
def test_globs(spark, pattern, path, expected):
    assert one(spark, globs.match_globs(F.col("p"), [pattern]), p=path) is expected


def test_scan_filters_and_types(spark):
    rows = [
        ("p", ".gitignore", "out/\nsecret\n*.gen.ts\n# no\n!keep.ts\n", 30),
        ("p", "package.json", '{"dependencies":{"vue":"^3.4"},"devDependencies":{}}', 50),
        ("p", "src/a.ts", "let a", 5),
        ("p", "src/blank.ts", "　 \n", 5),
        ("p", "src/big.ts", "x", 300_000),
        ("p", "out/deep/b.ts", "x", 1),
        ("p", "secret/c.ts", "x", 1),
        ("p", "x.gen.ts", "x", 1),
        ("p", ".github/workflows/ci.yml", "on: push", 8),
        ("p", ".cache/d.ts", "x", 1),
        ("p", ".env.local", "A=1", 3),
        ("q", "go.mod", "module q", 8),
        ("r", "package.json", "{broken", 7),
    ]
    raw = spark.createDataFrame(rows, RAW)
    kept = {r.path for r in scanning.scan_files(raw).filter("project = 'p'").collect()}
    assert kept == {"package.json", "src/a.ts", ".github/workflows/ci.yml", ".env.local"}
    kinds = dict(scanning.detect_project_type(raw).collect())
    assert kinds == {"p": "vue3", "q": "go", "r": "unknown"}


def test_tree_source_sees_dot_and_underscore_names(spark, tmp_path):
    for name in (".env", ".github/ci.yml", "pkg/__init__.py", "pkg/deep/a.ts", "bin.dat"):
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(b"\xff\xfe" if name == "bin.dat" else b"x = 1")
    found = {r.path for r in read_tree(spark, [str(tmp_path)]).collect()}
    assert found == {".env", ".github/ci.yml", "pkg/__init__.py", "pkg/deep/a.ts"}


def test_every_folder_is_listed_once_and_ignored_ones_never(spark, tmp_path):
    from habitus.sources.tree import list_tree, splits

    texts = {
        "a/.gitignore": "secret/\n/out\n*.log", "a/src/x.ts": "x" * 900, "a/src/deep/er/y.ts": "y" * 5000, "a/src/deep/z.log": "z",
        "a/secret/k.ts": "k", "a/src/secret/in/k.ts": "k", "a/out/o.ts": "o", "a/node_modules/m/i.js": "i", "a/.git/HEAD": "h",
        "a/.github/ci.yml": "on: push", "b/secret/k.ts": "k", "b/w.ts": "w" * 300, "b/empty.ts": "",
    }
    for name, text in texts.items():
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    (tmp_path / "b" / "link").symlink_to(tmp_path / "a")
    roots = [str(tmp_path / "a"), str(tmp_path / "b")]
    files, folders = list_tree(spark, roots)
    listed = sorted((r.project[-1], r.path) for r in folders.collect())
    assert listed == [
        ("a", ""), ("a", ".github"), ("a", "src"), ("a", "src/deep"), ("a", "src/deep/er"), ("b", ""), ("b", "secret")
    ]
    want = {n for n in texts if not any(x in n for x in ("a/secret", "src/secret", "a/out", "node_modules", ".git/"))}
    assert {f"{r.project[-1]}/{r.path}" for r in files.collect()} == want
    read = read_tree(spark, roots)
    assert {f"{r.project[-1]}/{r.path}": r.content for r in read.collect()} == {n: texts[n] for n in want if texts[n]}
    kept = {r.path for r in scanning.scan_files(read).filter(F.col("project").endswith("a")).collect()}
    assert kept == {"src/x.ts", "src/deep/er/y.ts", ".github/ci.yml"}
    every, _ = list_tree(spark, roots, None)
    assert every.count() == len(texts)
    many = spark.range(300).selectExpr("'p' project", "cast(id as string) path", "case when id = 7 then 900L else 10L end size").repartition(3)
    dealt = splits(many, 100).rdd.glom().map(lambda part: [r["size"] for r in part]).collect()
    assert sum(map(len, dealt)) == 300 and all(sum(part) <= 100 + 900 for part in dealt)
    assert sorted(sum(part) for part in dealt)[-2] <= 110 and splits(many.limit(0)).count() == 0


def test_code_sample_equals_the_loop(spark):
    rng = random.Random(7)
    rows, expected = [], set()
    for p in range(20):
        files = [(f"p{p}", f"src/f{i}.ts", "x" * rng.choice([1, 50, 8001, 900]), rng.randint(1, 9)) for i in range(25)]
        rows += files
        spent = 0
        for _, path, content, size in sorted(files, key=lambda f: (f[3], f[1])):
            if spent >= 5000:
                break
            expected.add((f"p{p}", path))
            spent += len(content) if len(content) <= 8000 else 8000 + len(sampling.CUT_MARK)
    got = sampling.code_sample(spark.createDataFrame(rows, RAW), 5000)
    assert {(r.project, r.path) for r in got.collect()} == expected


def test_top_rules_equal_the_greedy_loop(spark):
    rng = random.Random(3)
    words = ["模块", "接口", "权限", "日志", "缓存", "命名", "plain"]
    rows = []
    for t in range(12):
        for i in range(rng.randint(1, 60)):
            rows.append(("s", f"t{t}", i, f"{rng.choice(words)} {rng.choice(words)} number {t} {i} " + "x" * rng.randint(0, 250)))
    df = spark.createDataFrame(rows, "skill string, project_type string, at int, text string")
    limit = 8
    got = {}
    for r in ov.select_top_rules(df, limit).orderBy("project_type", "position").collect():
        got.setdefault(r.project_type, []).append(r.text)
    scored = df.select("project_type", "at", "text", ov.score_rule(F.col("text")).alias("s"), ov.categorize_rule(F.col("text")).alias("c")).collect()
    for t in {r[1] for r in rows}:
        ranked = sorted((r for r in scored if r.project_type == t), key=lambda r: (-r.s, r["at"]))
        chosen, count = [], {}
        for r in ranked:
            if len(chosen) < limit and not (count.get(r.c, 0) >= 4 and len(ranked) > limit):
                chosen.append(r)
                count[r.c] = count.get(r.c, 0) + 1
        for r in ranked:
            if len(chosen) < limit and r not in chosen:
                chosen.append(r)
        assert got[t] == [r.text for r in sorted(chosen, key=lambda r: r["at"])]


DOC = """## L2 · Modules

### Scope
Owns the
contracts

### Rules
#### Naming [Must]
- **Keep** [项目特定]: every api function ends with Api
  and stays small
```ts
- not a rule
```
- [必须] routes live in src/api/user.ts next to views
- 建议 to move things around some day
### x inside
- an open section states this convention too
### Templates
#### One
No existing pattern
#### Two
see `src/b.ts` here
### Anti-patterns
- Never call fetch from a view component
- 直接修改 state 会破坏数据流的约定
### Gaps
#### Observed Risks
- a risk
#### Suggested Improvements
- None.
- add tests
"""


def layer_doc(spark, content=DOC, layer="L2"):
    return spark.createDataFrame(
        [("s", "vue3", layer, f"{layer}-x", content)],
        "skill string, project_type string, layer string, file_stem string, content string",
    )


EVIDENCE = (
    "skill string, project_type string, rule_id string, layer string, category string, summary string,"
    " confidence string, files array<string>, count bigint"
)


def test_trace_of_a_document(spark):
    evidence = spark.createDataFrame(
        [("s", "vue3", "api", "L2", "API", "facade", "high", ["a.ts", "b.ts"], 7)], EVIDENCE
    )
    docs_ = layer_doc(spark)
    rules = tr.trace_rules(docs_, evidence).orderBy("pos").collect()
    assert [r.id for r in rules] == [f"vue3-L2-r00{i}" for i in (1, 2, 3, 4)]
    assert rules[0].text.startswith("Naming / Keep") and "not a rule" in rules[0].text
    assert rules[1].files == ["src/api/user.ts"] and rules[1].status == "active"
    assert rules[2].status == "pending"
    assert rules[3].text.startswith("x inside：") and rules[3].files == ["a.ts", "b.ts"]
    templates = tr.trace_templates(docs_, evidence).collect()
    assert [(t.name, t.status, t.files) for t in templates] == [("Two", "active", ["src/b.ts"])]
    manifest = vf.layer_manifest(docs_, tr.trace_rules(docs_, evidence), tr.trace_templates(docs_, evidence))
    row = manifest.filter("layer = 'L2'").first()
    assert (row.rule_count, row.template_count, row.anti_pattern_count, row.scope) == (3, 1, 2, ["Owns the contracts"])
    assert manifest.count() == 8


def test_sections_ignore_fences_and_files_consume_a_separator(spark):
    found = one(spark, docs.sections(F.col("c")), c="### A\n```\n### B\n```\n#### sub\n---\n### C")
    assert [s.title for s in found] == ["A", "B", "C"]
    assert one(spark, tr.file_refs(F.col("c")), c="a.ts b.ts  c.ts") == ["a.ts", "c.ts"]
    assert one(spark, tr.clean_rule(F.col("c")), c="Title here：Title here：body") == "Title here:body"


def test_split_layers_last_duplicate_and_foreign_tail(spark):
    text = "# T\n" + "\n".join(f"## L{i} · P\nbody{i}" for i in range(1, 9)) + "\n## L3 · P\nlater\n\n---\n\n## Notes\nx"
    layers = {l.layer: l.content for l in one(spark, docs.split_layers(F.col("c")), c=text)}
    assert len(layers) == 8 and layers["L3"] == "## L3 · P\nlater" and layers["L8"].endswith("body8")


def test_gap_lines_first_position_last_value(spark):
    x = one(spark, gv.dedupe_gap_lines(F.split("c", "\\|")), c="- a b|- c|- a  b|- d")
    assert x == ["- a  b", "- c", "- d"]
    counts = one(spark, let(docs.sections(F.col("c")), docs.gap_counts), c=DOC)
    assert (counts.observed, counts.suggested) == (1, 1)


def test_governed_document(spark):
    text = (
        "## L6 · Quality\n### Rules\n- keep tests fast\n- maybe add more\ncontinue exactly here\n"
        "```\nmaybe in code\n```\n### Template: Runner\nrun JaCoCo nightly\n### Anti-patterns\n- no sleeps\n"
        "### Gaps\n- None.\n- a risk remains\n"
    )
    none = spark.createDataFrame([], EVIDENCE)
    out = gv.govern(layer_doc(spark, text, "L6"), none, "en").first().content
    assert "continue exactly" not in out and "maybe in code" in out
    assert out.count("### Gaps") == 1 and "### Scope" in out
    body, gaps = out.split("### Gaps")
    assert "maybe add more" not in body and "- maybe add more" in gaps and "- a risk remains" in gaps
    assert "### Template: No existing pattern" in body and "JaCoCo" in gaps
    known = spark.createDataFrame([("s", "vue3", "t", "L6", "Q", "uses jacoco", "low", ["a"], 1)], EVIDENCE)
    assert "run JaCoCo nightly" in gv.govern(layer_doc(spark, text, "L6"), known, "en").first().content


def test_diff_reports_duplicates_and_ignores_case_and_space(spark):
    schema = "skill string, project_type string, layer string, text string"
    now = spark.createDataFrame([("s", "t", "L1", x) for x in ("A  rule", "new", "new")], schema)
    old = spark.createDataFrame([("s", "t", "L1", x) for x in ("a rule", "gone")], schema)
    got = sorted((r.change, r.text) for r in vf.trace_diff(now, old).collect())
    assert got == [("added", "new"), ("added", "new"), ("removed", "gone")]


def test_stale_needs_every_file_gone(spark):
    rules = spark.createDataFrame(
        [("s", "t", "1", ["a", "b"]), ("s", "t", "2", ["x"]), ("s", "t", "3", [])],
        "skill string, project_type string, id string, files array<string>",
    )
    files = spark.createDataFrame([("s", "t", "a")], "skill string, project_type string, path string")
    assert {r.id: r.stale for r in vf.stale_rules(rules, files).collect()} == {"1": False, "2": True, "3": False}


def test_catalog_counts_and_merges(spark):
    learned = spark.createDataFrame(
        [("k", "n", "go", ["go"], "s/reference/go/", "h", ["p2"], ["f2", "f1"])],
        "lock_key string, name string, language string, raw_languages array<string>, skill_path string,"
        " content_hash string, source_projects array<string>, source_files array<string>",
    )
    start = catalog.upsert_catalog(
        learned.limit(0).selectExpr("*", "timestamp'2020-01-01' created_at", "timestamp'2020-01-01' updated_at", "0L learn_count"),
        learned, F.lit("2024-01-01").cast("timestamp"),
    )
    again = learned.withColumn("source_files", F.array(F.lit("f3"), F.lit("f1")))
    row = catalog.upsert_catalog(start, again, F.lit("2024-02-01").cast("timestamp")).first()
    assert row.learn_count == 2 and row.source_files == ["f1", "f2", "f3"]
    assert row.created_at.month == 1 and row.updated_at.month == 2


def test_catalog_rounds_repeat_without_trace(spark, tmp_path):
    at = lambda day: F.lit(f"2024-01-{day:02}").cast("timestamp")
    entry = lambda *keys: spark.createDataFrame(
        [(k, "n", "go", "s/reference/go/", "h") for k in keys],
        "lock_key string, name string, language string, skill_path string, content_hash string",
    )
    source = lambda *rows: spark.createDataFrame(list(rows), "lock_key string, kind string, value string")
    path = str(tmp_path / "catalog")
    catalog.learn_round(path, 1, entry("a"), source(("a", "file", "f2"), ("a", "file", "f1"), ("a", "project", "p")), at(1))
    for _ in range(2):  # delivered twice
        catalog.learn_round(path, 2, entry("a", "b"), source(("a", "file", "f1"), ("a", "file", "f3"), ("b", "file", "f1")), at(2))
    entries, sources = catalog.read_catalog(spark, path)
    rows = {r.lock_key: r for r in catalog.with_lists(entries, sources).collect()}
    assert rows["a"].source_files == ["f1", "f2", "f3"] and rows["a"].source_projects == ["p"]
    assert (rows["a"].learn_count, rows["b"].learn_count, rows["b"].raw_languages) == (2, 1, [])
    assert (rows["a"].created_at.day, rows["a"].updated_at.day, rows["b"].created_at.day) == (1, 2, 2)
    assert sources.count() == sources.distinct().count() == 5
    # sources of a round whose entries never came do not count
    source(("a", "file", "lost")).withColumn("round", F.lit(3)).write.mode("append").partitionBy("round").parquet(f"{path}/sources")
    assert catalog.read_catalog(spark, path)[1].count() == 5
    assert catalog.read_catalog(spark, path, before=2)[1].count() == 3


def test_call_logs_batch_equals_stream(spark, tmp_path):
    folder = tmp_path / "logs" / "run-1"
    folder.mkdir(parents=True)
    (folder / "calls.jsonl").write_text(
        '{"at":"2024-01-01T00:00:00Z","phase":"P0","attempt":1,"ok":true,"durationMs":5,"usage":{"total_tokens":3,"reasoning_tokens":2}}\n'
        '\n{broken\n{"phase":"P0","attempt":2,"ok":false,"durationMs":"7","usage":{"completion_tokens_details":{"reasoning_tokens":9},"reasoning_tokens":1}}\n'
    )
    calls = read_calls(spark, str(tmp_path / "logs"))
    row = runs.phase_metrics(calls).first()
    assert (row.run_id, row.requests, row.turns, row.retries, row.reasoning_tokens, row.llm_duration_ms) == ("run-1", 2, 1, 1, 11, 5)
    stream = st.stream_run_metrics(st.read_call_stream(spark, str(tmp_path / "logs")))
    st.run_available(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).collect() == [row]


def test_observations_and_tags(spark):

    texts = ["（证据：src/a.ts", "证据：x", "* evidence: y", "（说明：z", "[a\nb] c [d]", "to VERIFY it"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        tr.is_observation(F.col("t")).alias("o"), tr.extract_tags(F.col("t")).alias("tags")
    ).collect()
    assert [r.o for r in rows] == [True, True, True, False, False, True]
    assert rows[4].tags == ["[a\nb]", "[d]"]


def test_every_bullet_of_an_anti_pattern_section_counts(spark):

    body = "## L1\n### 反模式\n- ❌ never call the backend from a view component\n\ntext\n- ❌ never keep passwords in source files\n### Other\n- not an anti pattern at all here\n"
    docs = spark.createDataFrame([("s", "t", "L1", body)], "skill string, project_type string, layer string, content string")
    assert {r.text for r in ov.anti_patterns(docs).collect()} == {
        "❌ never call the backend from a view component", "❌ never keep passwords in source files"
    }


def test_cluster_needs_a_shared_folder(spark, monkeypatch):

    from habitus import session

    class Cluster:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getCheckpointDir():
                return None

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError):
        session.shared_folder(Cluster)


def test_completion_budgets_retries_and_resume(spark, tmp_path):
    assert grown(128, 1) == 4224 and grown(8192, 1) == 24576 and grown(20000, 2) == 32768

    def fn(prompt, budget):
        cut = budget < 5000 and prompt == "long"
        return {"content": prompt.upper(), "finish_reason": "length" if cut else "stop", "usage": {"total_tokens": 4}}

    asked = spark.createDataFrame([("r", "P0", "long"), ("r", "P0", "ok")], "run_id string, phase string, prompt string")
    done = complete(asked, fn, 4000)
    assert sorted((r.response, len(r.attempts)) for r in done.collect()) == [("LONG", 2), ("OK", 1)]
    assert runs.call_metrics(call_rows(done, "run_id", "phase")).first().retries == 1
    path = str(tmp_path / "answers")
    assert complete_missing(asked.limit(1), path, ["prompt"], fn, max_tokens=4000).count() == 1
    assert complete_missing(asked, path, ["prompt"], fn, max_tokens=4000).count() == 2


def test_artifacts_round_trip(spark, tmp_path):
    place = tmp_path / "my skill" / "reference" / "vue3"
    place.mkdir(parents=True)
    (place / "L1-项目骨架.md").write_text("## L1 · A\n")
    (place / "EVIDENCE.json").write_text('{"items":[{"id":"x","layer":"L1","confidence":"high","files":["a"],"count":2}]}')
    (place / "TRACE.json").write_text("{broken")
    row = artifacts.read_layer_docs(spark, str(tmp_path)).first()
    assert (row.skill, row.project_type, row.layer, row.file_stem, row.content) == ("my skill", "vue3", "L1", "L1-项目骨架", "## L1 · A\n")
    read = artifacts.read_artifacts(spark, str(tmp_path)).first()
    assert read.trace is None and read.manifest is None and read.evidence["items"][0].id == "x"
    out = str(tmp_path / "out")
    for value in (1, 2):
        artifacts.write_artifacts({"t": spark.createDataFrame([("a", "b", value)], "skill string, project_type string, v int")}, out)
    assert [r.v for r in spark.read.parquet(out + "/t").collect()] == [2]


def test_durations(spark):
    df = spark.createDataFrame([(999,), (1500,), (61_000,), (3_600_000,)], "ms bigint")
    assert [r.x for r in df.select(format_duration(F.col("ms")).alias("x")).collect()] == ["999ms", "2s", "1m 1s", "1h 0m 0s"]
