"""Facts of files, ignore decisions and the literal prefilter."""

from __future__ import annotations

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from habitus.functions import patterns as rx
from habitus.operators import evidence as ev
from habitus.operators import facts as fx
from habitus.operators import rules as rl
from habitus.operators import sampling, scanning
from habitus.plans.learn import prepare
from tests.test_evidence import MIXED, RULES, files_of

RAW = "project string, path string, content string, size bigint"


class Patterns:
    """Collects what rules ask of paths and contents."""

    def __init__(self) -> None:
        self.seen: set[tuple[str, str]] = set()
        self.production = True

    def path(self, pattern, flags=""):
        self.seen.add((pattern, flags))
        return True

    body = path

    def ext(self, *_):
        return True

    def pinia(self):
        return True

    security = pinia


def rule_patterns():
    probe = Patterns()
    for rule in RULES:
        for first in (True, False):  # both sides of every "and" and "or"
            probe.production = first
            rule.when(probe)
    return sorted(probe.seen)


@pytest.mark.parametrize("pattern, flags", rule_patterns())
def test_every_match_holds_the_literals(pattern, flags):
    ways = rx.required_literals(pattern, flags)
    modes = (re.M if "m" in flags else 0) | (re.I if "i" in flags else 0)

    @settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(re.compile(pattern, modes | re.A)))
    def holds(text):
        text = text.lower() if "i" in flags else text
        assert not ways or any(all(x in text for x in way) for way in ways)

    holds()


def test_literals_of_small_patterns():
    assert rx.required_literals(r"(a|bc)+x?d") == [("a", "d"), ("bc", "d")]
    assert rx.required_literals(r"(^|/)x[yz]+w*v{2}u") == [("u", "x")]
    assert rx.required_literals(r"ab?c|abd") == [("a", "c"), ("abd",)]
    assert rx.required_literals(r"\s+|x") == [] == rx.required_literals("(?=abc).")
    assert rx.required_literals(r"\bAB\.c\b", "i") == [("ab.c",)]


def raw_files(spark, extra=()):
    rows = [("p", p, c, len(c.encode())) for p, c in MIXED.items()]
    rows += [("p", "tests/x.ts", "mapState({})", 12), ("p", "dist/a.ts", "mapState({})", 12), ("p", "b.ts", " \n", 2),
             ("p", "package.json", '{"dependencies":{"react":"1"}}', 30), ("p", ".gitignore", "legacy/\n*.prisma", 18),
             ("q", "a.bin", "x", 1), ("r", "win\\b.ts", "createSlice()", 13), *extra]
    return spark.createDataFrame(rows, RAW).repartition(3)


def test_facts_equal_the_scan(spark):
    raw = raw_files(spark)
    known = fx.stored(fx.file_facts(raw))
    kept = fx.write_facts(fx.scanned_facts(known))
    files = scanning.scan_files(raw)
    common = ["project", "path", "language", "size", "extension"]
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(kept.select(common)) == rows(files.select(common))
    assert known.count() == raw.count()
    assert rows(fx.project_types(known)) == rows(scanning.detect_project_type(raw))
    assert rows(fx.fact_hits(kept)) == rows(ev.rule_hits(files))
    assert rows(scanning.scan_fingerprint(kept)) == rows(scanning.scan_fingerprint(files))
    assert rows(sampling.layer_file_plan(kept)) == rows(sampling.layer_file_plan(files))
    assert rows(sampling.code_sample(scanning.with_slashes(raw), 500, kept)) == rows(sampling.code_sample(files, 500))
    plan = sampling.layer_file_plan(kept)
    assert rows(sampling.layer_samples(plan, scanning.with_slashes(raw), kept)) == rows(sampling.layer_samples(plan, files))


def test_more_rules_than_one_word_of_bits(spark):
    rules = [rl.Rule(f"r{k}", "L1", "c", "s", lambda f, k=k: f.body(f"k{k};")) for k in range(130)]
    raw = spark.createDataFrame([("p", "a.ts", "k0; k61; k62; k129;", 19)], RAW)
    hits = fx.fact_hits(fx.file_facts(raw, rules=rules), rules)
    assert {r.rule_id for r in hits.collect()} == {"r0", "r61", "r62", "r129"}


def test_one_read_of_contents_and_no_exchange_for_bucketed_joins(spark, tmp_path):
    raw_files(spark).write.parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    physical = fx.file_facts(raw)._jdf.queryExecution().executedPlan().toString()
    assert physical.count("FileScan") == 1 and "Exchange" not in physical
    learned = prepare(raw)
    for frame in (learned.evidence, learned.summary, learned.fingerprints):
        scans = [l for l in frame._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in l]
        assert not any("content" in l for l in scans)
    wanted = spark.createDataFrame([("p", "L1", ["pom.xml", "gone"])], "project string, layer string, paths array<string>")
    chosen = sampling.sanitize_file_plan(wanted, learned.files)
    assert [r.path for r in chosen.collect()] == ["pom.xml"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = learned.files.join(learned.files.select("project", "path", "digest"), ["project", "path"])
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert learned.prompts.count() == 3 * 8


def ignored_by_loop(path, lines):
    """Every directory on the way and the file itself against every glob, one at a time."""
    globs = []
    for line in map(str.strip, lines):
        if line and not line.startswith("#"):
            line = line.removeprefix("/")
            line = line + "**" if line.endswith("/") else line
            bare = "*" not in line and "/" not in line
            globs.append(f"**/{line}/**" if bare else line if line.startswith("**") else f"**/{line}")
    parts = path.split("/")

    def matches(glob, text):
        body = re.sub(r"[.+^${}()|\[\]]", lambda m: "\\" + m.group(0), glob)
        body = re.sub(r"\*\*/?", "\x01", body).replace("*", "[^/]*").replace("\x01", ".*").replace("?", "[^/]")
        return re.fullmatch(body, text, re.S)

    return any(matches(g, "/".join(parts[:n])) for n in range(1, len(parts) + 1) for g in globs)


def test_ignores_equal_the_loop_on_nested_folders(spark):
    rng = random.Random(2)
    names = ["a", "b", "out", "dist", "x.gen.ts", "keep.ts", "y.log", "deep", "m?n", "src"]
    lines = ["out", "/dist/", "*.gen.ts", "a/*.log", "deep/**", "**/b/src", "src/a/", "y.*", "# no", "", "!keep.ts", "a/b/*", "?.x", "m?n/", "**", "b/**/out"]
    rows, want, sets = [], set(), {}
    for k in range(12):
        sets[f"p{k}"] = rng.sample(lines[:-2] if k else lines, rng.randint(0, 4))
    sets["p11"] = sets["p10"]
    for project, own in sets.items():
        rows.append((project, ".gitignore", "\n".join(own), 9))
        for path in {"/".join(rng.choice(names) for _ in range(rng.randint(1, 5))) for _ in range(80)}:
            rows.append((project, path, "x", 1))
        for _, path, _, _ in [r for r in rows if r[0] == project]:
            if ignored_by_loop(path, own):
                want.add((project, path))
    raw = spark.createDataFrame(rows, RAW)
    got = [tuple(r) for r in fx.ignored_paths(raw.select("project", "path"), raw).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    by_scan = scanning.drop_ignored(raw, scanning.ignore_regexes(raw))
    assert {(r.project, r.path) for r in by_scan.collect()} == {r[:2] for r in rows} - want


def test_blank_cuts_are_passed_over(spark):
    files = {f"src/api/f{k:02}.ts": "x" * 8_000 for k in range(3)}
    files["src/api/g.ts"] = "y" * 5_500
    files["src/api/h.ts"] = " " * 900 + "late " * 2_000
    files["src/api/i.ts"] = "z" * 11_000
    rows = [("p", p, c, len(c)) for p, c in files.items()]
    rows.sort(key=lambda r: r[1])
    rows = [(p, q, c, k + 1) for k, (p, q, c, _) in enumerate(rows)]
    raw = spark.createDataFrame(rows, RAW)
    plan = sampling.layer_file_plan(raw)
    got = sampling.layer_samples(plan, raw).filter("layer = 'L2'").orderBy("position").collect()
    want, total = [], 0
    for _, path, content, _ in rows:  # all score alike, sizes are in order
        if total >= sampling.LAYER_BUDGET:
            break
        limit = min(sampling.LAYER_IMPORTANT_LIMIT, sampling.LAYER_BUDGET - total)
        if len(content) <= limit:
            cut = content
        elif limit <= 1_000:
            cut = content[:limit]
        else:
            head = int(limit * 0.6)
            tail = max(0, limit - head - sampling.CUT_MARK_RESERVE)
            cut = content[:head] + sampling.CUT_MARK + content[len(content) - tail :]
        if cut.strip():
            want.append((path, cut))
            total += len(cut)
    assert [(r.path, r.content) for r in got] == want
    assert "src/api/h.ts" not in [p for p, _ in want] and "src/api/i.ts" in [p for p, _ in want]


def test_rules_of_a_registered_set_are_built_once(spark):
    assert rl.rule_conditions(tuple(RULES)) is rl.rule_conditions(tuple(RULES))
    more = rl.register_rule("mine", "L1", "c", "s", lambda f: F.col("content").startswith("pack"))
    found = ev.rule_hits(files_of(spark, MIXED), more).filter("rule_id = 'mine'")
    assert {r.path for r in found.collect()} == {"internal/handlers/user.go", "internal/store/user.go"}
