"""Work that must not grow faster than its input: joins, listings, patterns tried on long texts."""

import re

from pyspark.sql import functions as F

from habitus.functions import patterns as rx
from habitus.operators import documents as docs
from habitus.operators import governance as gv
from habitus.operators import overview as ov
from habitus.operators import trace as tr
from habitus.operators import verify as vf
from habitus.session import BATCH_BYTES
from habitus.sources import artifacts, folders
from workload import overview, views

# words, their other case, look-alikes beyond ASCII, spaces of all kinds
TEXTS = [
    None, "", "plain words of no kind", "the api name ends in api", "API 后缀 of names", "Vite_ and .ENV",
    "toKen of Kelvin", "İnterface CI", "模块 分层", "TOKEN in cookies", "a b  c", "　wide",
    "“quoted” pinia 'store' persist", "优先选择 x", "Maybe later", "To Verify: x", "⚠️ watch", "x ⚠️ y",
    "Evidence: src/a.ts", "* 证据：x", "（证据：y）", "L8 中提及 it", "当前无 tests", "see src/a.ts, b.json;c.md",
    "no.end here.x", "[Must] keep [x", "如：这样写代码才可以通过检查", "ends with colon here:", "# heading with words",
    "推测 the state of things", "安全", "建议 moving it elsewhere now",
]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "n int, text string").repartition(1)


def _lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def test_keywords_as_patterns_find_them_without_patterns(spark):
    text = F.col("text")
    df = _texts(spark).select("n", "text", ov.score_rule(text).alias("s"), ov.categorize_rule(text).alias("c"))
    assert "RLIKE" not in df._jdf.queryExecution().optimizedPlan().toString().upper()
    for r in df.collect():
        if r.text is None:
            assert (r.s, r.c) == (0, "other")
            continue
        found = lambda p: re.search(p.lower(), _lower(r.text)) is not None
        points = sum(w for p, w in ov.RULE_WEIGHTS if found(p)) + (12 if len(r.text) <= 140 else 0)
        points += -8 if re.search(ov.LIBRARY_TALK[0], r.text) else 0
        assert r.s == points, r.text
        assert r.c == next((k for p, k in ov.RULE_CATEGORIES if found(p)), "other"), r.text


def test_guards_lose_no_match(spark):
    text = F.col("text")
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), ov.QUOTES, ""), rx.java(r"\s+"), " ")
    key = F.left(F.regexp_replace(F.lower(text), rx.java(r"\s+"), " "), F.lit(ov.KEY_LENGTH))
    for name, patterns in reversed(ov.RULE_TOPICS):
        hit = F.lit(True)
        for p in patterns:
            hit = hit & rx.test(plain, p)
        key = F.when(hit, name).otherwise(key)
    trimmed = rx.trim(text)
    observation = rx.test(
        text,
        r"^⚠️|\[待验证\]|(?i:To Verify)"
        rf"|^\*?\s*(?i:证据|Evidence)[：:]|^（?证据[：:]|{tr.ABSENCE_WORDS}",
    )
    topics = r"^(?:安全|性能|配置管理|CSS 类名|Props 类型声明|组件命名|函数与变量命名)$"
    actionable = (
        (F.length(text) > 12) & ~trimmed.rlike(r"[：:]\z") & ~rx.test(text, r"^#{1,6}\s+") & ~rx.test(trimmed, topics)
        & ~rx.test(text, rf"推测|可能|推断|无现有模式|⚠️|\[待验证\]|{tr.ABSENCE_WORDS}") & ~text.rlike("^如[：:]")
    )
    status = F.when(text.rlike(f"(?i){tr.PENDING_RULE}"), "pending").otherwise("weak")
    none = F.array().cast("array<string>")
    pairs = [
        (rx.squeeze(text), F.regexp_replace(text, rx.java(r"\s+"), " ")),
        (ov.rule_key(text), key),
        (tr.is_observation(text), observation),
        (tr.is_actionable(text), actionable),
        (tr.extract_tags(text), F.regexp_extract_all(text, F.lit(r"\[[^\]]+\]"), F.lit(0))),
        (tr.file_refs(text), F.array_distinct(rx.extract_all(text, tr.FILE_REF, 1))),
        (tr.rule_status(text, none, none), status),
    ]
    columns = [c.alias(f"{side}{i}") for i, pair in enumerate(pairs) for side, c in zip("gw", pair)]
    for r in _texts(spark).select("text", *columns).collect():
        for i in range(len(pairs)):
            assert r[f"g{i}"] == r[f"w{i}"], (r.text, i)


def test_stems_are_made_once_for_all_layers(spark):
    stems = F.transform(docs.split_layers(F.col("t")), lambda x: x["file_stem"])
    df = spark.createDataFrame([("# M\n## L2 · b\nx\n",), ("no layer",)], "t string").select(docs.missing_layers(stems).alias("m"))
    assert [r.m for r in df.collect()] == [["L1", *[f"L{i}" for i in range(3, 9)]], [f"L{i}" for i in range(1, 9)]]
    assert str(docs.missing_layers(stems)).startswith("Column<'get(transform(array(")


def test_stale_rules_look_up_cited_paths_only(spark):
    rules = spark.createDataFrame(
        [("s", "a", "1", ["x", "gone"]), ("s", "a", "2", ["gone"]), ("s", "b", "3", ["x"]), ("s", "b", "4", []), ("t", "a", "5", ["y"])],
        "skill string, project_type string, id string, files array<string>",
    )
    owners = spark.createDataFrame(
        [("s", "a", "p"), ("s", "a", "p"), ("s", "a", None), ("s", "b", "q"), ("t", "a", "q"), ("t", "a", "p")],
        "skill string, project_type string, project string",
    )
    files = spark.createDataFrame(
        [("p", "x"), ("p", "x"), ("q", "y"), ("q", None), (None, "gone"), *[("p", f"n{i}") for i in range(50)]],
        "project string, path string",
    )
    got = {r.id: r.stale for r in vf.stale_rules(rules, files, owners).collect()}
    whole = {r.id: r.stale for r in vf.stale_rules(rules, owners.join(files, "project")).collect()}
    assert got == whole == {"1": False, "2": True, "3": True, "4": False, "5": False}


def test_artifacts_list_the_tree_once(spark, tmp_path, monkeypatch):
    for kind, names in (("a", ("L1-x.md", "EVIDENCE.json")), ("b", ("TRACE.json",)), ("c", ("L2-y.md",))):
        folder = tmp_path / "s" / "reference" / kind
        folder.mkdir(parents=True)
        for name in names:
            (folder / name).write_text('{"projectType": "k"}' if name.startswith("E") else "{broken" if name.startswith("T") else "# x")
    listed = []
    whole = artifacts._whole_files
    monkeypatch.setattr(artifacts, "_whole_files", lambda *a: listed.append(a) or whole(*a))
    rows = {r.project_type: r for r in artifacts.read_artifacts(spark, str(tmp_path)).collect()}
    assert len(listed) == 1
    assert set(rows) == {"a", "b", "c"} and rows["a"].evidence.projectType == "k"
    assert rows["b"].trace is None and rows["c"].evidence is None and rows["a"].manifest is None


def test_files_reach_python_in_bounded_batches(spark, tmp_path):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = spark.createDataFrame([("f", "a", "é" * 9), ("f", "b", None), (None, "c", "")], "folder string, name string, text string")
    assert folders.write_files(rows.filter("folder is not null"), str(tmp_path)) == 2
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == BATCH_BYTES
    assert (tmp_path / "f" / "a").read_text() == "é" * 9 and (tmp_path / "f" / "b").read_text() == ""


def test_cross_type_texts_take_what_was_surfaced(spark, monkeypatch):
    from workload import overview as wo

    monkeypatch.setattr(ov, "report_rules", lambda *a: (_ for _ in ()).throw(AssertionError("documents read again")))
    at = "struct<layer:string,section_pos:int,group_pos:int,block_pos:int>"
    stated = spark.createDataFrame(
        [("s", "t", ("L1", 0, 0, 0), "store modules", [])], f"skill string, project_type string, at {at}, text string, tags array<string>"
    )
    short = stated.select("skill", "project_type", "text")
    surfaced = ov.Surfaced(stated, None, None, None, short.withColumn("text", F.lit("hard")), short.withColumn("text", F.lit("anti")), None)
    got = sorted((r.kind, r.text) for r in wo._texts(spark, "", surfaced).collect())
    assert got == [("anti", "anti"), ("hard", "hard"), ("type", "store modules")]


def test_large_inputs_in_one_row_group_are_spread(spark, tmp_path):
    """One row group is one scan task: above the size limit it was read by that task alone."""
    cores = spark.sparkContext.defaultParallelism
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    spark.range(4000).coalesce(1).write.parquet(one)
    spark.range(4000).repartition(4 * cores).write.parquet(many)
    read, even = spark.read.parquet(one), spark.read.parquet(many)
    cut = views.spread(read, [read], small=0)
    assert views.scan_tasks([read]) == (4000, 4000)
    assert cut.rdd.getNumPartitions() >= cores and views.scan_tasks([cut])[0] <= 2 * 4000 // cores
    assert sorted(r.id for r in cut.collect()) == list(range(4000))
    small_tasks = views.spread(read, [read], small=0, task_bytes=1 << 10)
    assert small_tasks.rdd.getNumPartitions() > cores
    kept = views.spread(even, [even], small=0)
    assert "Repartition" not in kept._jdf.queryExecution().optimizedPlan().toString()


def test_plain_texts_skip_the_patterns(spark):
    """Cleaning runs on texts that hold a mark; others are only trimmed, with equal results."""
    ran = F.lit("ran")
    texts = {" plain text é ": "plain text é", "a  b": "ran", "a\tb": "ran", "a：b": "ran", "x [y]": "ran", "- a": "ran", " a": "ran"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.x for r in rows.select("t", rx.unless_plain(F.col("t"), tr.MARKS, lambda t: ran, tr.FIRST_MARKS).alias("x")).collect()}
    assert got == texts
    cleaned = {"a [必须]  b": "a b", "[必须][推荐] a": "a", " a　 b ": "a b", "a * Evidence: x.ts * b": "a b", "**a** b": "a b"}
    rows = spark.createDataFrame([(t,) for t in cleaned], "t string")
    assert {r.t: r.x for r in rows.select("t", tr.clean_body(F.col("t")).alias("x")).collect()} == cleaned


def test_gap_lines_are_tested_once_and_by_words_first(spark):
    text = F.col("text")
    df = _texts(spark)
    tested = df.select("text", gv.is_speculative(text).alias("gap"), gv.is_meta_line(text).alias("meta"), gv.is_suggestion(text).alias("more"))
    search = lambda pattern, t: re.search(pattern, t, re.I | re.A) is not None
    for r in tested.collect():
        if r.text is None:
            assert r.gap is None and r.meta is None and r.more is None
            continue
        meta = search(gv.META_LINE, r.text)
        gap = search(gv.SPECULATION, r.text) and not search(docs.NO_PATTERN, r.text)
        assert (r.gap, r.meta, r.more) == (meta or gap, meta, search(gv.SUGGESTION, r.text)), r.text
    parted = df.select(gv.partition_speculative(text).alias("p"))
    assert parted._jdf.queryExecution().optimizedPlan().toString().count("推断(?!的)") == 1
    whole = "a maybe\n# maybe\n| maybe\n\u3000```ts\nmaybe\n```\nb\n  可能是 c\n推测 d"
    got = spark.createDataFrame([(whole,), (None,)], "text string").select(gv.partition_speculative(text).alias("p")).collect()
    assert got[0].p.gaps == ["a maybe", "推测 d"] and got[0].p.kept == "# maybe\n| maybe\n\u3000```ts\nmaybe\n```\nb\n  可能是 c"
    assert got[1].p.gaps is None and got[1].p.kept is None


def test_a_diff_makes_each_key_once_and_squeezes_starts_only(spark):
    odd = ["", "  a  b ", "A B", "x" * 179 + "  y", "x" * 180 + " z", ("w  " * 400), "\u3000" * 500 + "ab" * 100, "ΑΣ" * 100, "İ" * 200, "é \t" * 300, " " * 1000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, *odd])], "n int, text string")
    whole = F.left(rx.squeeze(F.lower("text")), F.lit(vf.DIFF_TEXT))
    assert df.select(vf.diff_key(F.col("text")).eqNullSafe(whole).alias("same")).distinct().collect() == [(True,)]
    rows = df.select(F.lit("s").alias("skill"), F.lit("t").alias("project_type"), F.lit("L1").alias("layer"), "text")
    plan = _plan(vf.trace_diff(rows, rows.withColumn("text", F.reverse("text"))))
    assert plan.count("lower(") == 4, plan


def test_templates_are_traced_once(spark, monkeypatch):
    read, plain = [], tr.document_templates
    monkeypatch.setattr(tr, "document_templates", lambda d: read.append(d) or plain(d))
    shown = overview._templates(spark, "/root/testdata/sf0.001")
    assert len(read) == 2 and "Relation [" not in _plan(shown)


def test_folders_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(artifacts, "ENTRIES", 3)
    for place, text in (
        ("my skill/reference/vue3/L1-b 100%.md", "second"), ("my skill/reference/vue3/L1-a+项目.md", "first\n"),
        ("my skill/reference/vue3/L1-0.md", ""), ("my skill/reference/vue3/L9-x.md", "no layer"),
        ("my skill/reference/vue3/L2-a.txt", "no document"), ("my skill/reference/vue3/.L2-a.md.1", "half"),
        ("s/reference/_old/L1-a.md", "left out"), ("s/reference/.git/L1-a.md", "left out"), ("s/reference/t=1/L8-x.md", "x"),
        ("deep/er/s/reference/go/L3-x.md", "deep"), ("L4-top.md", "no reference"),
    ):
        (tmp_path / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / place).write_text(text)
    for root in (str(tmp_path), tmp_path.as_uri()):
        read = artifacts.read_layer_docs(spark, root)
        assert "binaryFile" not in _plan(read)
        assert sorted(map(tuple, read.collect())) == [
            ("", "", "L4", "L4-top", "no reference"), ("my skill", "vue3", "L1", "L1-a+项目", "first\n"),
            ("s", "go", "L3", "L3-x", "deep"), ("s", "t=1", "L8", "L8-x", "x"),
        ]


def test_scope_and_template_are_matched_once(spark):
    head = "## L1 · A\n"
    texts = {
        head + "x": head.strip() + "\n\n### Scope\n{}\n\nx",
        head + "### Scope\n\n---\nb\n### Scope\nc": None,
        head + "a\n### scope\nfull\n### Scope\n\n": None,
        head + "a\n### 范围\n": head + "a\n### Scope\n{}\n",
        head + "a\n### Scope\n \n## B\n### Scope\n \n## B": None,
        "": "\n\n### Scope\n{}\n",
    }
    df = spark.createDataFrame([(t, "L1") for t in texts], "c string, layer string")
    made = df.select("c", gv.ensure_scope(F.col("c"), F.col("layer"), "en").alias("out"))
    assert _plan(made).count("(.*?)") == 2  # in the text, and in what was found there
    for r in made.collect():
        assert r.out == (texts[r.c] or r.c).format(gv.DEFAULT_SCOPE["en"]["L1"]), r.c
    evidence = "skill string, project_type string, summary string, files array<string>"
    docs_ = df.select(F.lit("s").alias("skill"), F.lit("t").alias("project_type"), "layer", F.col("c").alias("content"))
    plan = _plan(gv.govern(docs_, spark.createDataFrame([], evidence), "en"))
    assert plan.count("regexp_extract(doc#") == 2  # scope, template
