import json

import pytest
from pyspark.sql import functions as F

from habitus.operators import runs
from habitus.sources import artifacts, folders, generations
from habitus.sources.logs import parse_calls, call_lines, read_calls
from habitus.streaming import metrics as st

KEYS = "skill string, project_type string"


def table(spark, *rows):
    return spark.createDataFrame(rows, f"{KEYS}, v int")


def values(df):
    return sorted((r.skill, r.project_type, r.v) for r in df.collect())


def test_generations_replace_whole_references(spark, tmp_path):
    path = str(tmp_path / "kept")
    rules, templates = table(spark, ("a", "t", 1), ("b", "t", 2)), table(spark, ("a", "t", 10))
    assert generations.write_generation({"rules": rules, "templates": templates}, path) == 1
    # the reference loses its templates, the other one stays
    empty = table(spark, ("a", "t", 0)).limit(0)
    assert generations.write_generation({"rules": table(spark, ("a", "t", 3)), "templates": empty}, path) == 2
    assert values(generations.read_generation(spark, path, "rules")) == [("a", "t", 3), ("b", "t", 2)]
    assert values(generations.read_generation(spark, path, "templates")) == []
    assert values(generations.read_generation(spark, path, "rules", age=2)) == [("a", "t", 1)]
    assert values(generations.read_generation(spark, path, "templates", age=2)) == [("a", "t", 10)]


def test_a_lost_writer_changes_nothing_and_may_repeat(spark, tmp_path):
    path = str(tmp_path / "kept")
    generations.write_generation({"rules": table(spark, ("a", "t", 1))}, path)

    @F.udf("int")
    def broken(v):
        raise RuntimeError("lost")

    rows = table(spark, ("a", "t", 2), ("c", "t", 5))
    with pytest.raises(Exception, match="lost"):
        generations.write_generation({"rules": rows, "templates": rows.withColumn("v", broken("v"))}, path)
    staged = generations.stage({"rules": rows}, path)
    assert values(generations.read_generation(spark, path, "rules")) == [("a", "t", 1)]
    assert generations.commit(spark, path, staged) == generations.commit(spark, path, staged) == 2
    assert generations.commits(spark, path).count() == 2
    assert values(generations.read_generation(spark, path, "rules")) == [("a", "t", 2), ("c", "t", 5)]


def test_generations_of_odd_rows(spark, tmp_path):
    path = str(tmp_path / "kept")
    assert generations.generations_of(spark, path).count() == 0
    rows = table(spark, (None, "t", 1), ("a", "t", None), ("a", "t", None))
    generations.write_generation({"rules": rows}, path, references=table(spark, (None, "t", 0), ("a", "t", 0), ("z", "t", 0)))
    assert generations.read_generation(spark, path, "rules").count() == 3
    generations.write_generation({"rules": rows.limit(0)}, path, references=table(spark, (None, "t", 0)))
    assert [r.skill for r in generations.read_generation(spark, path, "rules").collect()] == ["a", "a"]
    with pytest.raises(ValueError):
        generations.write_generation({"commits": rows}, path)


def test_folders_round_trip(spark, tmp_path):
    root = str(tmp_path / "skills")
    rows = [("my skill", "vue3", "L1-b", "second\n"), ("my skill", "vue3", "L1-a", "first + 100%\n"), ("s", "项目", "L8-x", "x"), ("s", "项目", "L7-x", None), ("s", "项目", "notes", "no layer")]
    docs = spark.createDataFrame(rows, f"{KEYS}, file_stem string, content string")
    assert folders.write_layer_docs(docs, root) == folders.write_layer_docs(docs, root) == 5
    read = artifacts.read_layer_docs(spark, root).collect()
    assert sorted((r.skill, r.project_type, r.layer, r.file_stem, r.content) for r in read) == [
        ("my skill", "vue3", "L1", "L1-a", "first + 100%\n"), ("s", "项目", "L8", "L8-x", "x"),
    ]  # an empty file holds no document
    items = spark.createDataFrame(
        [("s", "项目", "r2", "L1", "c", "two", "low", ["b"], 1), ("s", "项目", "r1", "L2", "c", 'o"ne', "high", [], 7)],
        f"{KEYS}, rule_id string, layer string, category string, summary string, confidence string, files array<string>, count bigint",
    )
    assert folders.write_sidecar(folders.evidence_sidecars(items), root, "EVIDENCE.json") == 1
    back = artifacts.evidence_items(artifacts.read_sidecar(spark, root, "EVIDENCE.json"))
    assert sorted(map(tuple, back.select(*items.columns).collect())) == sorted(map(tuple, items.collect()))
    assert {(r.skill, r.evidence is None) for r in artifacts.read_artifacts(spark, root).collect()} == {("my skill", True), ("s", False)}
    written = json.loads((tmp_path / "skills" / "s" / "reference" / "项目" / "EVIDENCE.json").read_text())
    assert [i["id"] for i in written["items"]] == ["r1", "r2"]


def test_trace_sidecars_keep_order(spark, tmp_path):
    rules = spark.createDataFrame(
        [("s", "t", f"t-L1-r{n:03}", n, "L1", f"rule {n}", ["[Must]"], ["a.ts"], ["e"], "active") for n in range(12, 0, -1)],
        f"{KEYS}, id string, pos int, layer string, text string, tags array<string>, files array<string>, evidence_ids array<string>, status string",
    )
    templates = spark.createDataFrame(
        [("u", "t", "t-L1-t001", 1, "L1", "one", "pending", [], [])],
        f"{KEYS}, id string, pos int, layer string, name string, status string, files array<string>, evidence_ids array<string>",
    )
    folders.write_sidecar(folders.trace_sidecars(rules, templates), str(tmp_path), "TRACE.json")
    read = {r.skill: r.r for r in artifacts.read_sidecar(spark, str(tmp_path), "TRACE.json").collect()}
    assert [x.text for x in read["s"].rules] == [f"rule {n}" for n in range(1, 13)]
    assert read["s"].rules[0].evidenceIds == ["e"] and read["s"].templates is None
    assert read["u"].rules is None and read["u"].templates[0].name == "one"


def test_call_logs_are_written_in_files_of_bounded_length(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(folders, "LINES_A_FILE", 50)
    calls = spark.range(500).select(
        F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, F.lit(None)).otherwise("cold").alias("run_id"),
        F.lit("P1").alias("phase"), (F.col("id") % 2 + 1).cast("int").alias("attempt"), F.col("id").alias("duration_ms"),
    )
    assert folders.write_calls(calls, str(tmp_path)) == 10
    back = read_calls(spark, str(tmp_path)).select("run_id", "phase", "attempt", "duration_ms")
    want = calls.fillna({"run_id": "unknown"})
    assert back.exceptAll(want).count() == want.exceptAll(back).count() == 0


def test_increments_equal_batch_after_three_deliveries(spark, tmp_path):
    logs, out, mark = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "ckpt")

    def deliver(day, *calls):
        folder = logs / "run-1"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{day}.jsonl").write_text("".join(json.dumps(c) + "\n" for c in calls))
        st.run_increments(st.read_call_stream(spark, str(logs)), out, mark).awaitTermination()

    def same(folded=None):
        got, want = st.read_increments(spark, out, folded), runs.phase_metrics(read_calls(spark, str(logs)))
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))

    deliver(1, {"phase": "P0", "ok": True, "durationMs": 5}, {"ok": False})
    same()
    deliver(2, {"phase": "P0", "attempt": 2, "usage": {"total_tokens": 3}})
    one, two = str(tmp_path / "fold1"), str(tmp_path / "fold2")
    assert st.fold_increments(spark, out, one) == 1
    # a call of the first day that comes last still counts
    deliver(3, {"runId": "run-0", "at": "2020-01-01T00:00:00Z", "phase": "P9"})
    same(), same(one)
    assert st.fold_increments(spark, out, two, one) == 2
    same(two)
    # a batch delivered again replaces itself
    again = parse_calls(call_lines(spark.read.text(str(logs / "run-1" / "3.jsonl"))))
    runs.phase_metrics(again).write.mode("overwrite").parquet(f"{out}/batch=2")
    same()
