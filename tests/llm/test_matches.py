"""Jaccard join, decontamination and secret scans."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from habitus.llm import decontaminate as dc
from habitus.llm import jaccard_join as jj
from habitus.llm import secrets as sec
from habitus.llm.components import components
from habitus.llm.membership import bitmap, maybe_in, without_ids
from habitus.llm.tables import written
from tests.llm.helpers import ODD, docs, invented


def shingle_set(text):
    ws = (text or "").encode().lower().split()
    if 0 < len(ws) < 5:
        return {tuple(ws)}
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}


def brute_components(rows):
    sets = [shingle_set(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(sets[k]), least.get(find(k))) for k, (i, _, _) in enumerate(rows))


def near_copies(rng, count):
    """Texts in groups whose members differ by a few words, many sharing a passage."""
    passage = invented(rng, 30)
    out = []
    while len(out) < count:
        base = invented(rng, rng.choice([2, 5, 7, 12, 30, 80, 150]))
        if rng.random() < 0.5:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(rng.choice([1, 1, 2, 4, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(["new", "Word", "X"])
            if rng.random() < 0.3:
                copy = copy[: max(1, len(copy) - rng.randint(1, 9))]
            out.append(rng.choice([" ", "\n"]).join(copy))
    return out[:count]


@pytest.mark.parametrize("frequent", [None, 0])
def test_components_equal_all_pairs(spark, monkeypatch, frequent):
    rng = random.Random(11)
    texts = near_copies(rng, 260) + ["a b", "A b", "a b c d", "", "x"]
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    rng.shuffle(rows)
    if frequent is not None:  # every shingle counts as frequent: pairs only
        real = jj.frequency_levels
        monkeypatch.setattr(jj, "frequency_levels", lambda d: (real(d)[0], frequent))
    got = Counter(tuple(r) for r in jj.jaccard_components(docs(spark, rows, extra=True), written).collect())
    assert got == brute_components(rows)


def test_components_of_odd_rows(spark):
    got = Counter(tuple(r) for r in jj.jaccard_components(docs(spark, ODD, extra=True), written).collect())
    assert got == brute_components(ODD)
    assert jj.jaccard_components(docs(spark, ODD).limit(0), written).count() == 0


def test_one_of_each_keeps_the_smallest_and_rows_without_words(spark):
    rows = [*ODD, (9, "same words every time " * 3, "z")]
    kept = Counter((r.doc_id, r.text) for r in jj.one_of_each(docs(spark, rows), written).collect())
    assert kept == Counter({(i, t): 1 for i, t, _ in rows if i not in (6, 9)})


@pytest.mark.parametrize("frequent", [0, 3, 8, 99])
def test_similar_sets_share_a_signature(frequent):
    rng = np.random.default_rng(frequent)
    levels = rng.integers(0, 10, jj.COUNTERS).astype(np.uint8)
    for n in [2, 3, 4, 5, 6, 9, 10, 25, 60, 200, 700]:
        for _ in range(30):
            x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            most = (n * 25) // 100  # larger partner: n + added, all of x kept
            added = rng.integers(0, most + 1)
            y = np.unique(np.concatenate([x, rng.integers(0, 1 << 63, added, dtype=np.uint64)]))
            gone = rng.integers(0, max(1, len(y) // 9) + 1)
            z = np.sort(rng.permutation(y)[gone:])
            for a, b in ((x, y), (x, z), (y, z)):
                common = len(np.intersect1d(a, b))
                if 100 * common >= 80 * (len(a) + len(b) - common) and not np.array_equal(a, b):
                    level = lambda v: levels[(v & np.uint64(jj.COUNTERS - 1)).astype(int)]
                    (ra, pa, fa, ea), (rb, pb, fb, eb) = (jj.signatures(v, level(v), frequent) for v in (a, b))
                    shared = lambda u, v: len(np.intersect1d(u, v))
                    assert shared(ra, rb) or shared(pa, pb), (n, frequent, len(a), len(b), common)
                    behind = len(a) - len(ra) - len(fa) if ea <= eb else len(b) - len(rb) - len(fb)
                    assert common <= shared(ra, rb) + shared(fa, fb) + behind


def test_contraction_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (131, 130)]
    rng = random.Random(3)
    names = {k: rng.randint(-(1 << 60), 1 << 60) for k in range(200)}
    df = spark.createDataFrame([(names[a], names[b]) for a, b in edges], "a long, b long")
    got = {r.node: r.root for r in components(df, written).collect()}
    for group in (range(41), range(100, 130), (130, 131)):
        members = [names[k] for k in group]
        assert {got[m] for m in members} == {min(members)}
    assert components(df.limit(0), written).count() == 0


def test_filter_never_misses(spark):
    have = spark.range(0, 3000, 3).selectExpr("id", "cast(id as string) as name")
    rows = spark.range(3000).unionByName(spark.sql("select cast(null as long) as id"))
    let_through = {r.id for r in rows.filter(maybe_in(rows, bitmap(have, "id"), "id")).collect()}
    assert set(range(0, 3000, 3)) <= let_through and len(let_through) < 1100
    assert {r.id for r in without_ids(rows, have, "id").collect()} == {k for k in range(3000) if k % 3} | {None}


def bag(text):
    ws = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]


def brute_leaks(rows, items):
    bags = {i: bag(t) for i, t in items}
    df = Counter(s for b in bags.values() for s in set(b))
    weight = lambda s: round(100 * math.log1p(len(items) / df[s])) if s in df else round(100 * math.log1p(len(items)))
    found = {}
    for i, t, _ in rows:
        runs = bag(t)
        for item, own in bags.items():
            if not own:
                continue
            a = Counter(own)
            for at in range(len(runs) - len(own) + 1):
                b = Counter(runs[at : at + len(own)])
                common = sum(min(n, b[s]) * weight(s) for s, n in a.items())
                total = sum(n * weight(s) for c in (a, b) for s, n in c.items()) - common
                if 100 * common >= 80 * total:
                    found[i, item] = max(found.get((i, item), 0), common / total)
    return found


def test_leaks_equal_all_windows(spark):
    rng = random.Random(6)
    items = [(k, " ".join(invented(rng, rng.choice([12, 20, 33, 60])))) for k in range(12)]
    items += [(20, "too short to tell"), (21, None), (22, ""), (23, items[0][1])]
    rows = []
    for k in range(80):
        words = invented(rng, rng.randint(0, 120))
        if k % 2:
            part = rng.choice(items[:12])[1].split()
            for _ in range(rng.choice([0, 0, 1])):
                part[rng.choice([0, 1, -1])] = "changed"
            part = part[rng.choice([0, 0, 1]) : len(part) - rng.choice([0, 0, 1])]
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() + rng.choice(["", ",", "!"]) for w in part]
        rows.append((k, " ".join(words), "s"))
    rows.append((90, items[3][1] + " " + items[4][1], "s"))
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit(1))
    got = dc.contaminated(docs(spark, rows, extra=True), table, written).collect()
    want = brute_leaks(rows, items)
    assert {(r.doc_id, r.item_id): pytest.approx(r.similarity) for r in got} == want
    assert len(want) > 30 and all(r.hamming <= dc.RADIUS for r in got)
    kept = dc.decontaminated(docs(spark, rows), table, written)
    assert {r.doc_id for r in kept.collect()} == {i for i, _, _ in rows} - {i for i, _ in want}
    assert dc.contaminated(docs(spark, rows).limit(0), table, written).count() == 0
    assert dc.contaminated(docs(spark, rows), table.limit(0), written).count() == 0


def test_leaks_of_very_long_items(spark):
    rng = random.Random(9)
    long, short = invented(rng, 3000), invented(rng, 15)
    changed = long[:1500] + ["other"] + long[1501:]
    items = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(short))], "item_id long, text string")
    rows = [(1, " ".join(invented(rng, 50) + changed + short), "s"), (2, " ".join(long[:2000]), "s"), (3, " ".join(short), "s")]
    got = {(r.doc_id, r.item_id): (r.start_word, r.n_words) for r in dc.contaminated(docs(spark, rows), items, written).collect()}
    assert got == {(1, 1): (50, 3000), (1, 2): (3050, 15), (3, 2): (0, 15)}


def test_leaks_of_odd_rows(spark):
    items = spark.createDataFrame([(1, "same words every time same words every"), (1, "same words every time same words every")], "item_id long, text string")
    got = dc.contaminated(docs(spark, ODD, extra=True), items, written).collect()
    assert {r.doc_id for r in got} <= {5, 6}
    assert dc.decontaminated(docs(spark, ODD), items, written).count() >= len(ODD) - 2


def test_leaks_of_repeated_and_unnamed_items(spark):
    rng = random.Random(8)
    texts = [" ".join(invented(rng, 20)) for _ in range(6)]
    items = [(1, texts[0]), (1, texts[0]), (None, texts[1]), (None, texts[1]), (2, texts[2]), (2, texts[3])]
    items += [(None, texts[4]), (4, texts[0]), (5, None), (None, None)]
    rows = [(k, t, "s") for k, t in enumerate(texts)] + [(9, texts[2] + " " + texts[3], "s"), (None, texts[1], "s")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.similarity) for r in dc.contaminated(docs(spark, rows), table, written).collect())
    pairs = [(0, 1), (0, 4), (1, None), (2, 2), (3, 2), (4, None), (9, 2), (None, None)]
    assert got == Counter((i, item, 1.0) for i, item in pairs)
    assert [r.doc_id for r in dc.decontaminated(docs(spark, rows), table, written).collect()] == [5]
    unnamed = table.filter("item_id is null")
    assert {r.doc_id for r in dc.contaminated(docs(spark, rows), unnamed, written).collect()} == {1, 4, None}


def test_blocks_reach_every_fingerprint_within_the_radius():
    rng = random.Random(1)
    masks = set(dc.near_masks())
    assert len(masks) == 697
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), dc.RADIUS):
            b ^= 1 << bit
        assert any(((a ^ b) >> (16 * k)) & 0xFFFF in masks for k in range(4))


def test_fingerprint_by_hand(spark):
    rows = [(-1, 2), (0, 1), (1, 5), (-(1 << 63), 3)]
    df = spark.createDataFrame(rows, "h long, w long")
    got = df.agg(dc.fingerprint(F.col("h"), F.col("w")).alias("p")).first().p
    want = 0
    for k in range(64):
        if sum(w if (h >> k) & 1 else -w for h, w in rows) > 0:
            want |= 1 << k
    assert got & ((1 << 64) - 1) == want


ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A
)


def brute_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def secret_texts(rng):
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = [
        "token = " + hexes(40), "é漢\U0001f600 password: 'hunter22'", "secret=token:abcdefgh", "TOKEN=abc apikey==x",
        "api_key = abcdef api-key=abcdef", "ſecret=abcdef toKen=abcdef", "AKIA" + "A" * 16, "AKIA" + "B" * 15,
        "xAKIAAKIA" + "Z9" * 10, hexes(23), hexes(24) + "g" + hexes(30), "passwd\t=abcdef passwd  =  abcdef",
        "token='' secret=\"...---", "password=password=passwd1", "", "plain",
    ]
    parts = ["token", "Secret", "=", ":", " ", "'", '"', "abc", "0f9a", hexes(12), "AKIA", "ABCD1234", "é", "\n", "password"]
    return texts + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(200)]


def test_patterns_equal_python(spark):
    texts = secret_texts(random.Random(4))
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    for r in sec.secret_scan(docs(spark, rows, extra=True), written).collect():
        want = brute_spans(texts[r.doc_id])
        line = ",".join(f"{sec.KINDS[k]}:{a}:{b}" for a, k, b in want)
        counts = Counter(k for _, k, _ in want)
        assert (r.n_assign, r.n_access, r.n_hex) == (counts[0], counts[1], counts[2]), texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest(), texts[r.doc_id]
        assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == [s for s in line.split(",") if s]


def test_battery_tells_keys_from_names(spark):
    rng = random.Random(12)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rng.choice(b64) for _ in range(n)) for n in (32, 40, 44, 64, 86) for _ in range(8)]
    keys = [k for k in keys if re.search("[0-9]", k) and re.search("[A-Za-z]", k) and not re.search("AKIA", k)]
    names = [
        f"user_{a}_profile_update_2024_final" for a in ("alpha", "gamma", "delta", "sigma")
    ] + ["2024-01-01-0000-0000-1111-a", "aaaaaaaaaaaaaaaaaaaa1111111111", "section1section2section3section4", "abcabcabcabcabcabcabc123123"]
    rows = [(k, f"see {t} there", "s") for k, t in enumerate(keys + names)]
    got = {r.doc_id: "random:4:" in r.spans for r in sec.secret_scan(docs(spark, rows), written).collect()}
    caught = sum(got[k] for k in range(len(keys)))
    assert caught >= 0.85 * len(keys)
    assert not any(got[k] for k in range(len(keys), len(rows)))


def test_candidates_need_neither_letters_nor_digits(spark):
    rng = random.Random(21)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    keys = ["".join(rng.choice(letters) for _ in range(48)) for _ in range(20)]
    keys += ["".join(rng.choice("0123456789") for _ in range(22)) for _ in range(20)]  # 24 would be hex
    names = [
        "counterrevolutionaries", "internationalization-of-applications", "getApplicationContextFromServletRequest",
        "11111111112222222222", "00000000000000000000", "=" * 40, "-" * 40, "a" + "=" * 30, "=" * 30 + "a" + "=" * 9, "/=" * 20,
    ]
    rows = [(k, f"see {t} there", "s") for k, t in enumerate(keys + names)]
    got = {r.doc_id: "random:4:" in r.spans for r in sec.secret_scan(docs(spark, rows), written).collect()}
    assert sum(got[k] for k in range(20)) >= 16 and sum(got[k] for k in range(20, 40)) >= 10
    assert not any(got[k] for k in range(40, len(rows)))


def test_battery_statistics_by_hand(spark):
    token = "Ab3dEf9hIjK1mNoP5rStU7wXyZ"
    got = spark.range(1).select(sec.battery(F.lit(token)).alias("t")).first().t
    alphabet = sec.ENCODINGS["base64"][0]
    v, n = [alphabet.index(c) + 1 for c in token], len(token)
    squares = sum(c * c for c in Counter(token).values())
    pairs = n * (n - 1) * 0.065
    z = (squares - n - pairs) / math.sqrt(2 * pairs * (1 - 0.065))
    level = -math.log10(0.5 * math.erfc(-z / math.sqrt(2)))
    assert (got.encoding, got.band) == ("base64", 1) and abs(got.level - math.floor(level * 10)) <= 1
    chi = (64 / n * squares - n - 63) / math.sqrt(126)
    high = [x * 2 > 64 for x in v]
    h = sum(high)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    expected = 2 * h * (n - h) / n + 1
    r = abs(runs - expected) / math.sqrt((expected - 1) * (expected - 2) / (n - 1))
    mean = sum(v) / n
    serial = abs(sum((a - mean) * (b - mean) for a, b in zip(v, v[1:], strict=False)) / sum((a - mean) ** 2 for a in v)) * math.sqrt(n)
    worst = max(chi, r, serial, 0)
    assert got.random == (6 * 0.5 * math.erfc(worst / math.sqrt(2)) >= sec.LEAST_P)


def test_false_discovery_levels(spark):
    counts = {0: 90, 30: 5, 50: 5}
    tests = [(("base64", 1, level, True),) for level, n in counts.items() for _ in range(n)]
    df = spark.createDataFrame(tests, "test struct<encoding:string,band:int,level:int,random:boolean>")
    one = df.select(F.array(F.struct("test")).alias("__candidates"))
    # at 3.0: 0.001 * 100 candidates <= 0.01 * 10 found
    assert sec.discovery_levels(one) == {("base64", 1): 30}
    assert sec.discovery_levels(one.limit(0)) == {}


def test_masking_and_odd_rows(spark):
    texts = ["a token = abcdef0123 b", "AKIA" + "A" * 20 + "!", "é " + "0f" * 20, "clean", None]
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    got = {r.doc_id: r.text for r in sec.mask_secrets(docs(spark, rows, extra=True), written).collect()}
    assert got == {0: "a [SECRET] b", 1: "[SECRET]!", 2: "é [SECRET]", 3: "clean", 4: None}
    odd = sec.secret_scan(docs(spark, ODD, extra=True), written)
    assert Counter((r.doc_id, r.spans) for r in odd.collect()) == Counter((i, "") for i, _, _ in ODD)
    assert sec.secret_scan(docs(spark, ODD).limit(0), written).count() == 0


def test_native_operators_use_no_user_function(spark):
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    table = docs(spark, [(1, "a b c d e f g token=abcdefgh", "s")])
    for df in (dc.contaminated(table, items, written), dc.decontaminated(table, items, written), sec.secret_scan(table, written), sec.mask_secrets(table, written)):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
