"""Mixing, archives, HTML and token counts."""

from __future__ import annotations

import base64
import hashlib
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from habitus.llm import mixing, warc
from habitus.llm.html_text import html_text, rendered
from habitus.llm.queries import QUERIES, tokenizer_path
from habitus.llm.tables import shared_folder, table, written
from habitus.llm.token_counts import Lengths, load, pieces, token_counts
from tests.llm.helpers import ODD, WORD, docs, invented

SMALL = "/root/testdata/sf0.001"


def test_targets_share_and_stop():
    assert mixing.targets([100, 100, 100]) == pytest.approx([200, 450 - 200 - 250 / 3, 250 / 3])
    assert mixing.targets([10, 1000, 0]) == pytest.approx([20, 1495, 0])
    assert mixing.targets([0, 0]).tolist() == [0, 0] and len(mixing.targets([])) == 0
    rng = random.Random(1)
    for _ in range(50):
        sizes = [rng.randint(0, 1000) for _ in range(rng.randint(1, 12))]
        want = mixing.targets(sizes)
        assert (want <= 2 * np.array(sizes) + 1e-6).all() and want.sum() == pytest.approx(1.5 * sum(sizes))
        level = [w / (5, 2, 1)[k % 3] for k, w in enumerate(want) if w < 2 * sizes[k] - 1e-6]
        assert not level or max(level) == pytest.approx(min(level))


def test_permutations_are_permutations():
    for size in (1, 2, 3, 7, 64, 1000):
        number, full = np.arange(size), np.full(size, size)
        one = mixing.permuted(number, full, np.full(size, 5, np.uint64))
        two = mixing.permuted(number, full, np.full(size, 6, np.uint64))
        assert sorted(one) == sorted(two) == list(range(size))
        assert size < 10 or (one != two).any()


def test_shards_split_fixed_totals_alike_in_any_task():
    totals = np.array([50_000, 30_000, 48, 0, 20_000])
    shards = 4000

    def draws(begin, end):
        return {k: dict(zip(who.tolist(), n.tolist(), strict=True)) for k, who, n in mixing.shard_draws(totals, shards, begin, end, 9)}

    whole = draws(0, shards)
    sums = Counter()
    for counts in whole.values():
        sums.update(counts)
    assert [sums[k] for k in range(5)] == totals.tolist()
    assert {**draws(0, 17), **draws(17, 2500), **draws(2500, shards)} == whole
    first = np.array([whole.get(k, {}).get(0, 0) for k in range(shards)])
    assert abs(first.var() / first.mean() - 1) < 0.1  # as a multinomial's over many shards


def test_small_sources_meet_their_targets():
    sizes = np.array([64_000_000] + [640 * (k + 1) for k in range(50)])
    plan = mixing.Recipe([f"s{k:02d}" for k in range(51)], sizes, mixing.targets(sizes))
    got = mixing.slot_totals(plan) * mixing.BLOCK_WORDS
    assert (np.abs(got - plan.targets) <= mixing.BLOCK_WORDS).all()
    assert (mixing.slot_totals(plan) <= 2 * plan.blocks).all()


def mixed_table(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(invented(rng, rng.randint(1, 400))), rng.choice(["a", "a", "a", "b", "é", "\U0001f600", None])) for k in range(200)]
    return docs(spark, [*rows, *[(i, t, s) for i, t, s in ODD if i != 8]], extra=True)


def test_mix_matches_its_blocks_and_targets(spark):
    table_ = mixed_table(spark)
    documents, blocks, plan = mixing.mix(table_, written)
    rows = documents.collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r["size"]
        assert r.taken <= 2 * r["size"]
    assert plan.sources == sorted((s for s in sizes if s is not None)) + [None]
    assert [sizes[s] for s in plan.sources] == plan.sizes.tolist()
    want = dict(zip(plan.sources, mixing.targets(plan.sizes), strict=True))
    taken = Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert (r.source_size, r.target) == (sizes[r.source], pytest.approx(want[r.source]))
    for source, target in want.items():
        assert abs(taken[source] - target) <= 0.02 * target + 2 * mixing.BLOCK_WORDS, source
    by_id, by_slot = Counter(), defaultdict(int)
    for b in blocks.collect():
        by_id[b.id] += b.end - b.begin
        by_slot[b.shard, b.source_no, b.slot] += b.end - b.begin
    assert max(by_slot.values()) <= mixing.BLOCK_WORDS
    per_id = Counter()
    for r in rows:
        per_id[r.doc_id] += r.taken
    assert {i: n for i, n in per_id.items() if n} == dict(by_id)
    again = mixing.mix(table_, written)[0].collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))


def test_mix_counts_words_and_stands_empty_tables(spark):
    table_ = docs(spark, ODD)
    got = Counter((r.doc_id, r["size"]) for r in mixing.mix(table_, written)[0].collect())
    assert got == Counter((i, len(WORD.findall(t or ""))) for i, t, _ in ODD)
    documents, blocks, _ = mixing.mix(table_.limit(0), written)
    assert documents.count() == 0 and blocks.count() == 0


PAGES = [
    (3, "http://a/3", "<p>same</p>"), (1, "http://a/1", "<p>same</p>"), (2, None, None), (4, "http://ä/\r\n x", ""),
    (5, "u", "é" * 1000), (None, "n", "<p>same</p>"), (None, "n", "alone"), (6, "t", "é" * 1000), (6, "t", "é" * 1000),
]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_archives_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    folder = shared_folder(spark)
    index = written(warc.write_archives(pages.repartition(2), folder))
    got = Counter(
        (r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest)
        for r in warc.read_records(index, folder).collect()
    )
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = Counter()
    for i, _, h in PAGES:
        low = first.get(h or "")
        again = low is not None and i != low
        want[str(i), "revisit" if again else "response", str(low) if again else None, len((h or "").encode()), digest(h)] += 1
    assert got == want
    texts = {r.page_id: r.payload for r in warc.read_records(index.filter("page_id = '5'"), folder).collect()}
    assert texts == {"5": "é" * 1000}
    assert {r.url for r in index.collect()} == {u for _, u, _ in PAGES}
    none = written(warc.write_archives(pages.limit(0), folder))
    assert warc.read_records(none, folder).count() == 0


def test_small_payloads_may_stay_responses(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder = shared_folder(spark)
    index = written(warc.write_archives(pages, folder, least_bytes=100))
    kinds = {(r.payload_bytes < 100, r.record_type) for r in warc.read_records(index, folder, payloads=False).collect()}
    assert kinds == {(True, "response"), (False, "response"), (False, "revisit")}


def test_damaged_record_is_noticed():
    good = warc.record("1", "u", b"<p>x</p>", digest("<p>x</p>"), None)
    assert warc.parsed(good)[3] == b"<p>x</p>"
    with pytest.raises(ValueError):
        warc.parsed(good.replace(b"<p>x</p>", b"<p>y</p>"))


RENDERED = {
    "": "", "  <!-- c -->  ": "", "a  b\n c": "a b c", "<p>a<p>b": "a\n\nb", "a<br>b<br><br>c": "a\nb\n\nc",
    "<div>a<div>b</div>c</div>": "a\nb\nc", "x<b>y</b> <i> z</i>": "xy z", "t&amp;u&nbsp;v": "t&u\xa0v",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "- a\n- b\n  - c\n- d",
    "<ol start=9><li>x<li>y</ol>": "9. x\n10. y",
    "<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>": "a     bbb\ncccc  d",
    "<table><tr><th>漢字<th>x<tr><td>abc<td>y</table>": "漢字  x\nabc   y",
    "<table><tr><td colspan=2>wide<td>z<tr><td>a<td>b<td>c</table>": "wide  z\na  b  c",
    "<head><title>t</title><style>p{}</style></head><body>x<script>var a='<p>';</script>y": "xy",
    "<p hidden>no</p><p style='color:red; display : none'>no</p><p>yes": "yes",
    "<div style='visibility:hidden'>no</div>a<template>no</template>": "a",
    "<pre>  a\n   b</pre>c": "  a\n   b\n\nc", "<p>a</div></span>b</p>": "ab", "<b><p>a</b>b": "ab",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n  d\nu\n  e", "<h1>h</h1>x": "h\n\nx", "a<hr>b": "a\n\nb",
    "<img alt='pic'> x": "pic x", "<![CDATA[x]]>y<![if z]>w": "yw", "<blockquote>q</blockquote>r": "  q\n\nr",
    "a < b <": "a < b <", "</p>x</table>": "x",
}


@pytest.mark.parametrize("html", RENDERED)
def test_rendering(html):
    assert rendered(html) == RENDERED[html]


MISPLACED = {
    "<table><td>A<td>B</table>": "A  B", "<table><thead><th>Name<th>Age<tbody><td>x<td>1</table>": "Name  Age\nx     1",
    "<table><tr><td>a<tbody><td>b</table>": "a\nb", "<table><caption>c<td>x</table>": "c\nx",
    "<table><tr><form><td>x</td></form></tr><form><tr><td>y</table>": "x\ny",
    "<table><div>note</div><tr><td>x</table>z": "note\n\nx\n\nz", "<table><tr>loose<td>x</table>": "loose\n\nx",
    "<table>a<tr><td>b</td></tr>c</table>": "ac\n\nb", "<table><tr><td>a<table>in<td>b</table>c</table>": "ain\nb\nc",
    "<table><tr><div>d<td>x</table>": "d\n\nx", "<table><tr><img alt=pic><td>x</table>": "pic\n\nx",
    "<table><tr><td>a</td></tr><table><tr><td>b</table>": "a\n\nb", "<table><colgroup>g<col><tr><td>x</table>": "g\n\nx",
    "<table><tr><td>a<table></tr>x</table>b</table>": "ax\nb", "<table> <tr> <td>a</td> <td>b</td> </tr> </table>": "a  b",
    "<p>n<math><mi>x</mi><mo>=</mo><mn>2</mn></math>": "nx=2",
    "<math><semantics><mi>x</mi><annotation>tex</annotation></semantics></math>": "x",
    "<svg><title>t</title><desc>d</desc><path d='m'/><text>a</text><text>b</text></svg>": "a b",
    "<svg><desc/><text>a</text></svg>": "a", "<svg/>a": "a", "x<desc>y</desc><text>z</text>": "xyz",
}


@pytest.mark.parametrize("html", MISPLACED)
def test_rendering_of_misplaced_and_foreign_text(html):
    assert rendered(html) == MISPLACED[html]


def test_deep_pages_do_not_break():
    assert rendered("<div>" * 50_000 + "x") == "x"
    assert rendered("<b>" * 5_000 + "x" + "</b>" * 9_000 + "y") == "xy"


def test_html_of_odd_rows(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("text", F.lit("t"))
    got = Counter((r.page_id, r.text, r.n_chars, r.n_lines) for r in html_text(pages).collect())
    assert got == Counter((i, t, len(t), int(bool(t))) for i, _, h in PAGES for t in [rendered(h or "")])
    assert html_text(pages.limit(0)).count() == 0


def test_every_visible_word_of_the_pages_is_kept(spark):
    import re

    for r in table(spark, SMALL, "pages").join(QUERIES["op3_html_text"](spark, SMALL), "page_id").limit(50).collect():
        body = re.sub(r"(?s)<(head|script|style)\b.*?</\1>|<!--.*?-->|<!DOCTYPE[^>]*>", " ", r.html)
        import html as h

        words = h.unescape(re.sub(r"<[^>]+>", " ", body)).split()
        assert [w for w in r.text.split() if w != "-"] == [w for w in words if w != "-"]


TRICKY = [
    "", " ", "a b", " a  b ", "a\n b", "it's  'tis don't", "<|endoftext|> x <|endoftext|>y", "<|endof text|>", "tab\tx  y",
    "1 2 3 abc123 $%& !?", "é ü 漢字 　x", "x" * 5000, "​   z", "a \x1c b", "é ́ x", "long text " * 40000,
]


def test_token_counts_equal_whole_encodings(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(8)
    texts = TRICKY + ["".join(rng.choice("ab '.\n\t1é  ") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    table_ = docs(spark, [(k, t, "s") for k, t in enumerate(texts)], extra=True)
    for r in token_counts(table_, tokenizer_path(), batch_bytes=200).collect():
        want = len(whole.encode(texts[r.doc_id], add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), want, want > 1024), texts[r.doc_id][:50]
    odd = {(r.doc_id, r.n_tokens) for r in token_counts(docs(spark, ODD), tokenizer_path()).collect()}
    assert {(1, 0), (2, 0)} <= odd and token_counts(docs(spark, ODD).limit(0), tokenizer_path()).count() == 0


def test_other_tokenizer_files(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    texts = [t for t in TRICKY if len(t) < 1000]
    table_ = docs(spark, [(k, t, "s") for k, t in enumerate(texts)])
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    other = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    for path, count in (("piece_bpe_32k.model", lambda t: len(model.encode(t))), ("word_bpe_49k.json", lambda t: len(other.encode(t, add_special_tokens=False)))):
        got = token_counts(table_, tokenizer_path(path)).collect()
        assert [count(texts[r.doc_id]) for r in got] == [r.n_tokens for r in got], path


def test_known_pieces_are_bounded(monkeypatch):
    from habitus.llm import token_counts as tc

    monkeypatch.setattr(tc, "KEPT_BYTES", 3 * (tc.ENTRY_BYTES + 4 * tc.LONGEST_KEPT))
    lengths = Lengths(load(tokenizer_path()), 50)
    assert [lengths.of([t])[0] for t in ("a b c d e f", "g h i j", "a b")] == [6, 4, 2]
    assert len(lengths.rest) <= 4 and pieces("a b  c d") == ["a", "b  c", "d"]
    # texts without spaces are forgotten with their batch
    chinese = ["".join(chr(0x4E00 + (7 * k + j) % 900) for j in range(500)) for k in range(40)]
    before = len(lengths.heads)
    assert lengths.of(chinese) == load(tokenizer_path())(chinese)
    assert not any(len(piece) > tc.LONGEST_KEPT for piece in lengths.heads) and len(lengths.heads) <= before


def test_html_of_hostile_spans_and_long_lines():
    assert rendered('<table><td colspan="' + "9" * 5000 + '">A<td>B</table>').split() == ["A", "B"]
    assert rendered('<table><td colspan="²">A<td rowspan="x">B</table>') == "A  B"
    assert rendered("<table><tr><td rowspan=2>A<td>B<tr><td>C<tr><td>D</table>") == "A  B\n   C\nD"
    assert rendered("<table><tr><td>A<td rowspan=0>B<td>C<tr><td>D<td>E<tr><td>F<td>G</table>") == "A  B  C\nD     E\nF     G"
    assert rendered("<table><tr><td rowspan=2 colspan=2>A<td>B<tr><td>C</table>").split("\n")[1].strip() == "C"
    assert rendered("<p>Pick <select><option>one<option selected>two</select> now") == "Pick now"
    words = "word " * 300_000
    began = time.perf_counter()
    assert rendered(f"<span>{words}</span>" + "<b>x</b> " * 20_000) == words + "x " * 19_999 + "x"
    assert time.perf_counter() - began < 10
