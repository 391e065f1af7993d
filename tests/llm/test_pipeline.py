"""The pipeline, stage by stage, and the registration of its queries."""

from __future__ import annotations

import corpus_pipeline as cp
import pytest

import __spark_entry__ as entry
from habitus.llm.mixing import targets
from habitus.llm.queries import ORACLES, QUERIES
from habitus.llm.tables import table
from tests.llm.helpers import WORD, ODD, docs
from tests.llm.test_matches import brute_components, brute_leaks, brute_spans

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Rows after each stage, first the documents themselves."""
    folder = tmp_path_factory.mktemp("stages")
    frame = table(spark, SMALL, "documents")
    out = [frame.collect()]
    for number, (_, stage) in enumerate(cp.STAGES):
        stage(spark, frame, SMALL).write.parquet(f"{folder}/{number}")
        frame = spark.read.parquet(f"{folder}/{number}")
        if number < 4:
            assert frame.columns == COLUMNS
        out.append(frame.collect())
    return out


def test_toxic_documents_go_and_others_stay(spark, steps):
    toxic = {r.doc_id for r in table(spark, SMALL, "labels").filter("toxic = 1").collect()}
    gone = {r.doc_id for r in steps[0]} - {r.doc_id for r in steps[1]}
    named = {r.doc_id for r in table(spark, SMALL, "labels").collect()}
    assert gone & named <= toxic


def test_one_document_of_each_group_stays(steps):
    rows = [(r.doc_id, r.text, r.source) for r in steps[1]]
    want = {i for i, _, root in brute_components(rows) if root is None or i == root}
    assert {r.doc_id for r in steps[2]} == want and len(steps[2]) == len(want)


def test_benchmark_documents_go(spark, steps):
    items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    leaks = {i for i, _ in brute_leaks([(r.doc_id, r.text, r.source) for r in steps[2]], items)}
    assert {r.doc_id for r in steps[3]} == {r.doc_id for r in steps[2]} - leaks


def test_secrets_are_masked_and_nothing_else(steps):
    before = {r.doc_id: r for r in steps[3]}
    assert {r.doc_id for r in steps[4]} == set(before)
    for r in steps[4]:
        old = before[r.doc_id]
        assert not brute_spans(r.text) and r.n_chars == len(r.text)
        if not brute_spans(old.text) and "[SECRET]" not in r.text:
            assert r.text == old.text


def test_mix_takes_what_targets_ask(steps):
    sizes, taken = {}, {}
    assert {r.doc_id for r in steps[5]} == {r.doc_id for r in steps[4]}
    words = {r.doc_id: len(WORD.findall(r.text)) for r in steps[4]}
    for r in steps[5]:
        assert r["size"] == words[r.doc_id] and r.taken <= 2 * r["size"]
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for source, target in zip(sorted(sizes), targets([sizes[s] for s in sorted(sizes)]), strict=True):
        assert abs(taken[source] - target) <= 0.05 * target + 128


def test_run_applies_all_stages(spark, steps):
    assert sorted(map(tuple, cp.run(spark, SMALL).collect())) == sorted(map(tuple, steps[5]))


def test_stages_stand_odd_rows(spark):
    frame = docs(spark, ODD)
    for number, (_, stage) in enumerate(cp.STAGES):
        assert stage(spark, frame, SMALL).count() >= len(ODD) - 2, number


def test_every_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [name for name, _ in cp.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "secret_scans", "mixing"]
