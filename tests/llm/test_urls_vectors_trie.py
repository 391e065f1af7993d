"""URL filters, clusters by pivots and the conversation trie, against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from habitus.llm import pivot_clusters as pivots
from habitus.llm import prefix_trie as tries
from habitus.llm.hot import hot_keys, join_hot
from habitus.llm.queries import QUERIES, URL_RULES
from habitus.llm.tables import table, written
from habitus.llm.url_filter import RULE, url_verdicts

SMALL = "/root/testdata/sf0.001"

# URLs


def brute_url(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [
        (len(h + p), len(h), h + p, v)
        for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


ODD_URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.org/es/x?y#z", "http://example.org", "http://org/",
    "http://notexample.org/es/", "http://a.example.org/en/1#f/", "http://a.example.org/en/21", "x://y://com/de/",
    "http://fr.com?/fr/", "http://shop.com/fr/" + "long/" * 20000, "http://" + "a." * 3000 + "com/de/x",
    "http://é.COM/fr/É", "http://com./de/", "http://.com/de/", "http://a..org/", "http://É.org/", "http://u@h.com:80/de/",
    "http://line\nbreak.com/de/\nx",
]


def pages(spark, urls):
    rows = [(k if k % 7 else None, u, "h", "a", k) for k, u in enumerate(urls)] + [(1, "http://b.com/de/", "h", "a", 1)] * 3
    return rows, spark.createDataFrame(rows, "page_id long, url string, host string, path string, key int")


@pytest.mark.parametrize("rules", [URL_RULES, [], [("", "", "block"), ("com", "", "block"), ("y:", "", "block")]])
def test_verdicts_of_odd_urls(spark, rules):
    rows, df = pages(spark, ODD_URLS)
    got = url_verdicts(df, spark.createDataFrame(rules, RULE), written).collect()
    want = sorted(((r[0], *brute_url(r[1], rules)) for r in rows), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want


def test_verdicts_by_many_rules_and_ties(spark):
    rng = random.Random(5)
    words = ["a", "b", "com", "org", "x", "shop"]
    host = lambda: ".".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
    path = lambda: rng.choice(["", "/"]) + "/".join(rng.choice(words) for _ in range(rng.randint(0, 3)))
    rules = [(host(), p if (p := path()).startswith("/") else "", rng.choice(["allow", "block"])) for _ in range(300)]
    messy = [*rules, *rules[:50], (None, "/", "block"), ("com", "/", None), ("ORG", None, "block")]
    clean = [*rules, ("org", "", "block")]
    strict = {(h, p): max(v for a, b, v in clean if (a, b) == (h, p)) for h, p, _ in clean}
    urls = [f"http://{host()}/{path().lstrip('/')}" for _ in range(2000)]
    rows, df = pages(spark, urls)
    got = url_verdicts(df, spark.createDataFrame(messy, RULE), written, default="none").collect()
    want = [(r[0], *brute_url(r[1], [(h, p, v) for (h, p), v in strict.items()], "none")) for r in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_no_pages(spark):
    _, df = pages(spark, [])
    assert url_verdicts(df.limit(0), spark.createDataFrame(URL_RULES, RULE), written).count() == 0


def test_hot_keys_join_like_others(spark):
    big = written(spark.range(30000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id"))
    small = written(spark.range(0, 20000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).union(spark.sql("select 7L, 1L")))
    hot = hot_keys(big.groupBy("k").count(), "count", written)
    assert [r.k for r in hot.collect()] == [7]
    for how in ("inner", "left"):
        got = join_hot(big, small, ["k"], hot, how)
        assert sorted(map(str, got.collect())) == sorted(map(str, big.join(small, "k", how).collect()))


# vectors


def brute_clusters(rows, size, scale, clusters, rounds):
    """(id, cluster, distance) and the centroids, with Python's whole numbers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(min(max(np.floor(scale * float(x)), -pivots.REACH), pivots.REACH)) for x in v]))
    seed = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    cents = [v for _, v in sorted(kept, key=seed)[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for k in range(len(cents)):
            own = [v for (_, v), (_, who) in zip(kept, found) if who == k]
            if own:
                cents[k] = [sum(col) // len(own) for col in zip(*own)]
    return [(i, k, d) for (i, _), (d, k) in zip(kept, assign())], cents


VECTORS = "vec_id long, embedding array<float>, label int, v int, id string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("kind", ["plain", "ties", "far", "few"])
def test_clusters_like_brute_force(spark, kind):
    rng = random.Random(kind)
    draw = {
        "plain": lambda: rng.gauss(0, 1), "few": lambda: rng.gauss(0, 1),
        "ties": lambda: float(rng.randint(0, 1)), "far": lambda: rng.choice([1e30, -3e5, 2.5, 1e5, 0.0]),
    }[kind]
    rows = [(k, [draw() for _ in range(4)]) for k in range(9 if kind == "few" else 400)]
    rows += [rows[0]] * 5 + [(None, rows[1][1]), (5, None), (6, []), (7, [1.0] * 3), (8, [1.0, None, 1.0, 1.0])]
    rows += [(9, [1.0, float("nan"), 1.0, 1.0]), (10, [float("inf"), 1.0, 1.0, 1.0]), (None, [0.5] * 4)]
    got, centroids = pivots.pivot_clusters(vectors(spark, rows), written, size=4, clusters=16)
    got = got.collect()
    want, cents = brute_clusters(rows, 4, 64.0, 16, 3)
    assert sorted(map(str, ((r.vec_id, r.cluster, r.distance) for r in got))) == sorted(map(str, want))
    assert centroids.tolist() == cents
    total = sum(d for _, _, d in want)
    for r in got:
        assert r.inertia == (total if total < 1 << 63 else None)
        assert r.cluster_inertia == sum(d for _, k, d in want if k == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, cents[r.cluster])).encode()).hexdigest()


def test_pivots_spare_distances(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(16, 64)) * 3
    rows = [(k, [float(x) for x in centres[k % 16] + rng.normal(size=64) * 0.2]) for k in range(800)]
    got, _ = pivots.pivot_clusters(vectors(spark, rows), written)
    assert got.agg(F.avg("n_measured")).first()[0] < 8


def test_no_vectors(spark):
    got, _ = pivots.pivot_clusters(vectors(spark, [(1, None), (2, [1.0])]), written)
    assert got.count() == 0
    assert got.columns[:3] == ["vec_id", "cluster", "distance"]


# conversations


def brute_trie(rows, group=5, heads=9):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (c % group if c >= 0 else -(-c % group))
        built = [*own.get(base, [])[:h], *turns[h:]]
        for d in range(len(built) + 1):
            members.setdefault(tuple(built[:d]), []).append(c)
        ends.setdefault(tuple(built), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[q] for q in below) if below else 1
        mine = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        saved[p] = mine + sum(saved[q] for q in below)
    return [
        (
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p],
            hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest(),
        )
        for p, m in members.items()
    ]


TURNS = "conv_id long, turn long, role string, text string, conv string, depth int, x int, chain int"


def turns(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "c", 1, 2, 3) for r in rows], TURNS).repartition(parts)


def trie_equals(spark, rows, **how):
    got = tries.prefix_trie(turns(spark, rows), written, **how)
    assert got.columns == [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    ]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_trie(rows)))


def test_trie_of_odd_turns(spark):
    rows = [
        (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (2, 5, "", ""), (None, 0, "user", "a"),
        (3, 0, "us", "era"), (4, 0, "user", "a"), (4, 0, "user", "b"), (4, 1, "bot", "é漢" * 30000), (0, 1, "user", "a"),
        (-3, 0, "user", "a"), (-7, 1, "x", "y"), (9, 2, None, "a"), (10**15 + 2, 0, "user", "a"), (5, 0, "2:", "a"),
        (7, 0, "user", "a"), (7, 1, "bot", "x"), (11, 0, "user", "a"), (12, 3, "user", "only one turn, and its base has one"),
    ]
    trie_equals(spark, rows)
    trie_equals(spark, rows[:1])
    assert tries.prefix_trie(turns(spark, rows).limit(0), written).count() == 0


def test_trie_of_many_alike_and_one_long(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for c in range(400):
        kind = rng.random()
        if kind < 0.4:  # one conversation many times, some cut short
            rows += [(c, t, "user" if t % 2 else "bot", f"common {t}") for t in range(rng.choice([3, 12, 12, 12]))]
        else:
            rows += [(c, t, "user", rng.choice(["common 0", "yes", "no", "why"])) for t in range(rng.randint(1, 11))]
    rows += [(401, t, "bot", f"turn {t % 3}") for t in range(3000)]
    rows += [(405, t, "bot", f"turn {t % 3}") for t in range(2990)]
    monkeypatch.setattr(tries, "DEPTHS", 64)
    trie_equals(spark, rows)


def test_weak_fingerprints_are_noticed(spark):
    rows = [(c, t, "user", f"{c} {t}") for c in range(40) for t in range(4)]
    with pytest.raises(ValueError, match="fingerprints"):
        tries.prefix_trie(turns(spark, rows), written, prime=3)


def test_id_lists_of_edges(spark):
    rows = [(d, d, d, c) for d in range(3) for c in range(1000 if d == 1 else 2)]
    df = spark.createDataFrame(rows, "depth long, x long, y long, conv long").withColumn("ends", F.lit(True))
    got = {r.depth: r.ends_sha256 for r in tries.end_digests(df.repartition(3), written).collect()}
    want = {d: hashlib.sha256(",".join(str(c) for _, _, k, c in rows if k == d).encode()).hexdigest() for d in range(3)}
    assert got == want


def test_queries_read_their_tables(spark):
    assert QUERIES["op11_url_filters"](spark, SMALL).count() == table(spark, SMALL, "pages").count()
    assert QUERIES["op12_centroid_clusters"](spark, SMALL).count() == table(spark, SMALL, "embeddings").count()
    rows = [tuple(r)[:4] for r in table(spark, SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op13_conversation_trie"](spark, SMALL).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_trie(rows)))
