"""Toxicity, quality classifier and quality rules."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from habitus.llm import quality_classifier as qc
from habitus.llm import toxicity as tox
from habitus.llm.quality_rules import quality_rules
from habitus.llm.queries import QUERIES
from habitus.llm.tables import table, written
from habitus.llm.words import PLAIN, SPACED, buffers, hash_of, slices, windows, words
from tests.llm.helpers import LABELS, ODD, WORD, docs, invented

SMALL = "/root/testdata/sf0.01"


def test_words_follow_the_pattern_and_cut_at_texts():
    import pyarrow as pa

    texts = ["Ab cd\x0bcd", None, "", "x y  é", "cd"]
    found = []
    for begin, _, data, offsets in slices(pa.array(texts), limit=4):
        owner, hashes = words(data, offsets, SPACED)
        found += list(zip((owner + begin).tolist(), hashes.tolist(), strict=True))
    want = [
        (k, hash_of(w.lower() if w.isascii() else w)) for k, t in enumerate(texts) for w in WORD.findall(t or "")
    ]
    assert found == want
    raw, offsets = buffers(pa.array(["a-b", "c"])[1:])
    assert bytes(raw) == b"c" and offsets.tolist() == [0, 1]


def test_one_huge_text_is_hashed_in_pieces():
    data = np.frombuffer(("lorem ipsum " * 500).encode(), np.uint8)
    offsets = np.array([0, len(data)])
    whole = words(data, offsets, PLAIN)[1]
    assert (words(data, offsets, PLAIN, limit=97)[1] == whole).all()
    owner, runs = windows(np.zeros(len(whole), int), whole, 5)
    assert len(runs) == len(whole) - 4 and len(np.unique(runs)) == 2 and not owner.any()


def test_log_ratios_by_hand():
    counts = np.zeros((2, 4))
    counts[:, 0] = 900, 100  # as common in both
    counts[:, 1] = 0, 60  # toxic only
    counts[:, 2] = 3, 0  # rare
    ratios = tox.log_ratios(counts)
    assert abs(ratios[0]) < 0.1 and ratios[2] == 0 and ratios[3] == 0
    more, fewer = 60 * 160 / 1063, 60 * 903 / 1063  # expected of each class
    up = 60 - more - tox.DISCOUNT - tox.DEVIATIONS * more**0.5
    down = fewer - tox.DISCOUNT - tox.DEVIATIONS * fewer**0.5
    want = np.log((more + up) / 160) - np.log((fewer - down) / 903)
    assert ratios[1] == pytest.approx(want, rel=1e-5)
    assert not tox.log_ratios(np.zeros((2, 4))).any()


def test_toxicity_on_held_out_rows(spark):
    labels = table(spark, SMALL, "labels").select("doc_id", "toxic")
    rows = QUERIES["op1_toxicity"](spark, SMALL).join(labels, "doc_id").filter("held_out").collect()
    caught = [r.predicted for r in rows if r.toxic == 1]
    assert sum(r.predicted for r in rows if r.toxic == 0) == 0 and sum(caught) >= 0.6 * len(caught)


def test_toxicity_of_odd_rows(spark):
    rng = random.Random(5)
    plain = [(k, " ".join(invented(rng, 40)) + " and of the", "s") for k in range(100, 160)]
    bad = [(k, " ".join(invented(rng, 30)) + " zorgan zorgan the", "s") for k in range(200, 260)]
    table_ = docs(spark, [*ODD, *plain, *bad], extra=True)
    labels = spark.createDataFrame(
        [(k, 1, 0) for k, _, _ in plain] + [(k, 1, 1) for k, _, _ in bad] + [(1, 1, None), (None, 1, 1), (200, 0, 1)], LABELS
    )
    result, _ = tox.toxicity(table_, labels, F.lit(True), written)
    got = [tuple(r) for r in result.collect()]
    assert len(got) == table_.count() and all(0 < s < 1 for _, s, _ in got)
    by_id = {i: p for i, _, p in got}
    assert all(by_id[k] == 1 for k, _, _ in bad) and not any(by_id[k] for k, _, _ in plain)
    assert len({s for i, s, _ in got if i in (1, 2, 3)}) == 1
    empty, _ = tox.toxicity(table_.limit(0), labels, F.lit(True), written)
    assert empty.count() == 0


def test_every_expression_is_counted_by_itself(spark):
    # 2^20 buckets would mix these: the rare word shares its low hash bits with a common one.
    low = {}
    for k in range(10_000):
        low.setdefault(hash_of(f"w{k}") & 0xFFFFF, f"w{k}")
    rare = next(f"z{k}" for k in range(10_000_000) if hash_of(f"z{k}") & 0xFFFFF in low)
    common = low[hash_of(rare) & 0xFFFFF]
    texts = [(f"{common} a{k}", 0) for k in range(300)] + [(f"b{k} {rare} c c", 1) for k in range(40)]
    rows = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(texts)], "doc_id long, text string, label int")
    learned = rows.select(F.col("doc_id").alias("id"), "label")
    counts = {(r.kind, r.hash & (2**64 - 1)): (r.other, r.toxic) for r in tox.count_expressions(rows).collect()}
    assert counts[tox.WORD, hash_of(rare)] == (0, 40) and counts[tox.WORD, hash_of(common)] == (300, 0)
    assert counts[tox.WORDS, 0] == (600, 120) and counts[tox.PAIRS, 0] == (300, 120)
    asked = [f"{rare} {common}", f"x {rare} c c {common}", "", "c", None, "c", f"c {rare} c c c"]
    asked = spark.createDataFrame([(k, t) for k, t in enumerate(asked)], "doc_id long, text string")
    small, large = (tox.fit(rows, learned, written, limit=n) for n in (1 << 20, 0))
    assert small.entries is not None and large.entries is None
    want, got = ({r.id: r.evidence for r in tox.scored(asked, m).collect()} for m in (small, large))
    assert len(got) == 7 and all(got[k] == pytest.approx(want[k]) for k in want) and want[6] > 0 == want[2]


def test_sample_holds_the_lowest_hashes(spark):
    learned = spark.range(5000).select("id", (F.col("id") % 2).cast("int").alias("label"))
    want = [r.id for r in learned.orderBy(F.xxhash64("id"), "id").limit(700).collect()]
    assert [r.id for r in qc.sampled(learned, 700).collect()] == want
    assert qc.sampled(learned, 5000).count() == qc.sampled(learned, 9000).count() == 5000
    assert qc.sampled(learned.limit(0), 10).count() == 0


def test_shallow_trees_and_pairs_learn_what_they_should():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, len(qc.FEATURES))).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # a pure interaction
    model = qc.boost(x, y)
    assert (0, 1) in model.pairs
    assert ((model.scores(x) > 0.5) == y).mean() > 0.95
    alone = qc.boost(x, (x[:, 2] > 0.5).astype(float))
    assert ((alone.scores(x) > 0.5) == (x[:, 2] > 0.5)).mean() > 0.97
    assert qc.boost(x[:0], y[:0]).scores(x[:3]) == pytest.approx(0.5)


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, len(qc.FEATURES))).astype(np.float32)
    model = qc.boost(x, (x[:, 0] + x[:, 1] > 0).astype(float))
    for row, got in zip(x[:20], model.scores(x[:20]), strict=True):
        bins = [int((model.cuts[j] <= row[j]).sum()) for j in range(len(row))]
        total = model.intercept + sum(model.tables[j][b] for j, b in enumerate(bins))
        total += sum(g[bins[a] * 8 // 32, bins[b] * 8 // 32] for (a, b), g in zip(model.pairs, model.grids, strict=True))
        assert got == pytest.approx(1 / (1 + np.exp(-total)))


def test_quality_on_held_out_rows(spark):
    labels = table(spark, SMALL, "labels").select("doc_id", "quality")
    rows = QUERIES["op10_quality_classifier"](spark, SMALL).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


def test_quality_of_odd_rows(spark):
    table_ = docs(spark, ODD, extra=True)
    labels = spark.createDataFrame([(5, 1, 0), (4, 0, 0), (4, 1, 0), (None, 0, 0), (7, None, 0)], LABELS)
    result, _ = qc.quality_scores(table_, labels, F.lit(True), written)
    got = result.collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert qc.quality_scores(table_.limit(0), labels.limit(0), F.lit(True), written)[0].count() == 0


def test_features_of_one_text():
    import pyarrow as pa

    got = dict(zip(qc.FEATURES, qc.features_of(pa.array(["The cat|\nThe CAT!\nThe cat|", None]))[0], strict=True))
    assert got["log_words"] == pytest.approx(np.log(7)) and got["bars"] == pytest.approx(2 / 6)
    assert got["exclaimed"] == pytest.approx(1 / 6) and got["function_words"] == pytest.approx(0.5)
    assert got["distinct_words"] == pytest.approx(2 / 6) and got["repeated_lines"] == pytest.approx(1 / 3)
    assert got["upper"] == pytest.approx(6 / 18)


def brute_repeats(text: str) -> int:
    ws = WORD.findall(text)
    runs = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    return len({i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(5)})


def test_quality_rules_against_loops(spark):
    rng = random.Random(2)
    some = invented(rng, 12)
    texts = [" ".join(rng.choice(some[: 2 + k % 9]) for _ in range(rng.randint(0, 60))) for k in range(60)]
    texts += ["a b c d e\nx\na b c d e\n \n \nx", "# $ % word " * 10, "- a\n- b\n- c\n- d\n" * 3]
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in quality_rules(docs(spark, rows, extra=True)).collect()}
    for k, t, _ in rows:
        ws = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[k]
        assert (r.n_words, r.word_chars) == (len(ws), sum(map(len, ws)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t)
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == brute_repeats(t)
        assert r.base_failed == (len(ws) < 10 or 100 * brute_repeats(t) > 20 * len(ws))
        assert not (r.kept and r.base_failed)
    odd = {(r.doc_id, r.n_words, r.kept) for r in quality_rules(docs(spark, ODD, extra=True)).collect()}
    assert {(1, 0, False), (2, 0, False), (3, 0, False), (8, 30000, False), (7, 5, False)} <= odd
    assert quality_rules(docs(spark, ODD).limit(0)).count() == 0


def test_quality_rules_judge_one_ratio_each(spark):
    rng = random.Random(9)
    good = " ".join(w if k % 6 else "the" for k, w in enumerate(invented(rng, 120)))
    cases = {
        "": good, "symbols": good.replace(" ", " ### "), "upper_case": good.upper().replace("THE", "the"),
        "stop_words": good.replace(" the ", " ThX "), "exclaimed": good.replace(" ", "!! "),
    }
    got = quality_rules(docs(spark, [(k, t, "s") for k, t in enumerate(cases.values())])).orderBy("doc_id").collect()
    for name, row in zip(cases, got, strict=True):
        assert row.kept == (not name) and (not name or name in row.broken), (name, row)


def test_quality_rules_use_no_user_function(spark):
    plan = quality_rules(docs(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan.replace("Exchange SinglePartition", "")
