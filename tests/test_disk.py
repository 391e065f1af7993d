"""Work that must not write its input again and again: shuffles, checkpoints, keys."""

import time

from pyspark.sql import functions as F

from habitus.operators import documents as docs
from habitus.operators import overview as ov
from habitus.operators import trace as tr
from habitus.operators import verify as vf
from habitus.session import SHUFFLE_CLEANUP, cut_lineage
from workload import documents, views

EVIDENCE = "skill string, project_type string, layer string, rule_id string, confidence string, count bigint, files array<string>"
AT = "struct<layer:string,section_pos:int,group_pos:int,block_pos:int>"


def _physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _docs(spark):
    rows = [
        ("s", "t", "L1", "## L1 · A\n### Rules\n- keep api names short and plain\n- * keep api names short and plain\n- see src/a.ts for the names\n"),
        ("s", "t", "L2", "## L2 · B\n### Rules\n- **Stores** [必须]: keep state in stores\n"),
        ("s", "u", "L1", "## L1 · A\n### Rules\n- keep api names short and plain\n"),
        (None, "t", "L1", "## L1 · A\n### Rules\n- keep api names short and plain\n"),
    ]
    return spark.createDataFrame(rows, "skill string, project_type string, layer string, content string")


def test_texts_of_a_trace_are_shuffled_once(spark):
    evidence = spark.createDataFrame(
        [("s", "t", "L1", "r1", "low", 1, ["a"]), ("s", "t", "L1", "r0", "high", 1, ["b", "a"]), ("s", "t", None, "r9", "low", 1, ["x"]),
         (None, "t", "L1", "r8", "low", 1, ["y"]), ("s", "v", "L1", "r7", "low", 1, ["z"])], EVIDENCE,
    )
    traced = tr.trace_rules(_docs(spark), evidence)
    # texts by reference, evidence by layer and by reference
    assert _physical(traced).count("Exchange hashpartitioning") == 3
    got = sorted(((r.skill or "", r.project_type, r.pos, r.text, r.files, r.evidence_ids) for r in traced.collect()), key=str)
    plain = "keep api names short and plain"
    assert got == sorted([
        ("s", "t", 1, plain, ["b", "a"], ["r0", "r1"]), ("s", "t", 2, "see src/a.ts for the names", ["src/a.ts"], ["r0", "r1"]),
        ("s", "t", 3, "Stores ：keep state in stores", [], []), ("s", "u", 1, plain, [], []), ("", "t", 1, plain, [], []),
    ], key=str)


def test_a_value_that_is_its_key_is_kept(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "- x"), ("a", 3, "y"), ("a", 4, None), ("b", 1, "- y"), ("b", 2, "y")], "k string, n int, v string")
    got = tr.first_position(df, ["k"], tr.bare_bullet(F.col("v")), "v", F.col("n"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 1, "- x"), ("a", 3, "y"), ("a", 4, None), ("b", 1, "y")], key=str)


def test_marked_rules_of_all_kinds_are_found_together(spark):
    long = "a rule that is long enough "
    trace = spark.createDataFrame(
        [("s", "t", 1, long + "1", ["[Must]"], "active", ["f"], []), ("s", "t", 2, long + "2", ["[个人偏好]", "[必须]"], "active", [], ["e"]),
         ("s", "t", 3, long + "1", ["[必须]"], "active", ["f"], []), ("s", "u", 1, long + "3", ["[必须]"], "pending", ["f"], []),
         ("s", "u", 2, long + "4", ["[必须]"], "active", [], []), ("s", "u", 3, "short", ["[必须]"], "active", ["f"], []), ("s", "u", 4, long, [], "active", ["f"], [])],
        "skill string, project_type string, pos int, text string, tags array<string>, status string, files array<string>, evidence_ids array<string>",
    )
    stated = spark.createDataFrame(
        [("s", "t", ("L1", 0, 0, 0), long + "5", ["[项目特定]", "[必须]"]), ("s", "u", ("L2", 0, 0, 0), long + "6", ["[项目特定]", "[必须]", "[个人偏好]"]),
         ("s", "u", ("L1", 0, 0, 0), long + "6", ["[项目特定]", "[必须]"]), ("s", "u", ("L3", 0, 0, 0), long + "[待验证]", ["[项目特定]", "[必须]"]), ("s", "u", ("L4", 0, 0, 0), long + "7", [])],
        f"skill string, project_type string, at {AT}, text string, tags array<string>",
    )
    kinds = {"type": ov.TYPE_TAGS, "hard": ov.HARD_TAGS}
    got = sorted((r.project_type, r.kind, r.at.layer, r.at.section_pos, r.text) for r in ov.marked_rules(trace, stated, kinds).collect())
    assert got == [("t", "hard", "", 2, long + "2"), ("t", "type", "", 1, long + "1"), ("u", "hard", "L2", 0, long + "6"), ("u", "type", "L1", 0, long + "6")]
    for kind, tags in kinds.items():
        one = sorted((r.project_type, kind, r.at.layer, r.at.section_pos, r.text) for r in ov.tagged_rules(trace, stated, tags).collect())
        assert one == [r for r in got if r[1] == kind]


def test_rules_of_small_references_are_shuffled_once(spark):
    docs = _docs(spark)
    assert ov.few_documents(docs) and not ov.few_documents(docs, 1)
    best = lambda together: ov.select_top_rules(ov.report_rules(docs, together).select("skill", "project_type", "at", "text"), 2)
    assert _physical(best(True)).count("Exchange hashpartitioning") == 1
    assert sorted(map(str, best(True).collect())) == sorted(map(str, best(False).collect()))


def test_documents_of_traced_references_are_not_taken_apart_again(spark, monkeypatch):
    text = "## L1 · A\n### Template: One\n```\nx\n```\n### Template: Two\nmaybe 可能\n"
    docs_ = spark.createDataFrame(
        [("s", "t", "L1", text), ("s", "u", "L1", text), (None, "t", "L1", text)], "skill string, project_type string, layer string, content string"
    )
    traced = spark.createDataFrame(
        [("s", "t", 1, "L1", "Known", "pending"), (None, "t", 1, "L1", "Lost", "active")],
        "skill string, project_type string, pos int, layer string, name string, status string",
    )
    seen, plain = [], tr.document_templates
    monkeypatch.setattr(tr, "document_templates", lambda d: seen.append(d) or plain(d))
    got = sorted(map(str, ov.template_info(traced, docs_).collect()))
    assert sorted(str((r.skill, r.project_type)) for r in seen[0].collect()) == ["('s', 'u')", "(None, 't')"]
    monkeypatch.setattr(ov, "broadcast_if_small", lambda df: None)
    assert got == sorted(map(str, ov.template_info(traced, docs_).collect())) and len(got) == 6


def test_even_inputs_are_not_dealt_out(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(4000).repartition(4 * cores).write.parquet(str(tmp_path / "many"))
    even = spark.read.parquet(str(tmp_path / "many"))
    assert "REPARTITION" not in _physical(views.spread(even, [even]))


def test_a_diff_shuffles_no_key_texts(spark):
    rows = spark.createDataFrame(
        [("s", "t", "L1", "Same  text"), ("s", "t", "L1", "new"), ("s", "t", "L2", "new"), (None, "t", "L1", "x"), ("s", "t", "L1", None), ("s", "u", "L1", "")],
        "skill string, project_type string, layer string, text string",
    )
    old = rows.withColumn("text", F.when(F.col("text") == "new", "OLD").otherwise(F.upper("text")))
    diff = vf.trace_diff(rows, old)
    sides = [line for line in _physical(diff).split("\n") if "HashAggregate(keys=[skill" in line]
    assert len(sides) == 4 and not any(" text#" in line for line in sides)
    got = sorted((r.change, r.skill or "", r.layer, r.text) for r in diff.filter("text is not null").collect())
    assert got == [
        ("added", "", "L1", "x"), ("added", "s", "L1", "new"), ("added", "s", "L2", "new"),
        ("removed", "", "L1", "X"), ("removed", "s", "L1", "OLD"), ("removed", "s", "L2", "OLD"),
    ]
    assert diff.filter("text is null").count() == 2
    short = vf.trace_diff(rows, old, F.left("text", F.lit(1)))
    assert sorted(map(str, short.collect())) == sorted(map(str, diff.withColumn("text", F.left("text", F.lit(1))).collect()))


def test_snapshots_repeat_documents_of_one_id_without_moving_the_others(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(i, f"line {i}\nmore", "en", "src", 9) for i in range(20)]
    for name, ids in (("once", []), ("twice", [3, 3, 7, None])):
        more = [(i, "again", "de", "other", 5) for i in ids]
        spark.createDataFrame(rows + more, schema).repartition(4).write.parquet(str(tmp_path / name / "documents.parquet"))
        sf = str(tmp_path / name)
        d = documents.layer_docs(spark, sf)
        whole = d.select("doc_id", "layer", "content").join(d.select("doc_id", *documents.KEY), "doc_id")
        now, before = documents._snapshots(spark, sf)
        want = whole.select(*documents.KEY, "layer", "doc_id", F.posexplode(docs.lines(F.col("content"))).alias("n", "text"))
        key = lambda df: sorted(map(tuple, df.select("skill", "project_type", "layer", "doc_id", "n").collect()))
        assert key(now) == key(before) == key(want)
        assert ("Join" in _physical(now)) == bool(ids)


def test_a_cut_leaves_no_shuffle_files(spark):
    blocks = lambda: [b for b in map(str, _blocks(spark)) if b.startswith("shuffle_")]
    before = set(blocks())
    kept = cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if not set(blocks()) - before:
            break
        time.sleep(0.2)
    assert not set(blocks()) - before
    assert kept.count() == 7 and kept.groupBy("k").count().count() == 7
    assert spark.conf.get(SHUFFLE_CLEANUP) == "false"


def _blocks(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return [found.apply(i) for i in range(found.size())]
