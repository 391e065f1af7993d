"""The prefix trie of rebuilt conversations, from fingerprints that compose.

A conversation is rebuilt as the head of its group's base conversation and its
own turns after the head.  No rebuilt text is made.  Every turn has a digest; the
fingerprint of a run of turns is its length n and, in each of ``LANES`` lanes, the
sum of x(i) * B**i modulo a prime over its turns.  Runs compose,
(n, u) + (m, v) = (n + m, u + B**n * v), and a known beginning can be taken off
again, so a rebuilt prefix follows from three products: the base's head, the own
turns so far, and the own turns that the head replaces.

1. Turns are sorted once by range partition.  Each task multiplies its piece of a
   conversation; the few pieces that go on in the next partition are composed.
2. One row per conversation and depth holds the prefix's fingerprint, the one
   before it and a reference to its last turn.  Equal fingerprints of one depth
   form a node.
3. A node is verified: its members must agree in the node above and in the digest
   of the turn they refer to, and digests are held against the texts they stand
   for.  By induction from the root, members then agree in all turns.  Where they
   do not, another base is taken.
4. Every node belongs to the chain of the member with the least hashed id.  Member
   sets shrink along a path, so a path meets few chains (about the logarithm of
   the conversations), whatever the trie's shape.  Sums over subtrees are sums of
   chains, passed up from chain to chain, and running sums inside a chain that
   are taken in slices.
5. The ids that end at a node are sorted by range and hashed as a stream; a node
   whose ids lie in several partitions is finished from pieces of text.

Odd rows: a null role or text is empty; a null turn comes first; turns of equal
number are ordered by their digest, so that reruns agree; rows without conv_id
belong to no conversation.  Repeated turns stay.  An empty table has no node, not
even the root.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from habitus.llm.hot import hot_keys, join_hot

LANES = 4
PRIME = (1 << 31) - 1
SEEDS = (1, 2, 3, 4)
#: Depths of a chain that are summed in one window.
DEPTHS = 1024
#: Ids in one piece of text of a node's list.
IDS = 10_000
#: Pieces of one node that a task holds back.
HELD = 64
NODE = ["depth", "x", "y"]


def bases(seed: int, prime: int) -> list[int]:
    rng = random.Random(seed)
    return [rng.randrange(2, prime) for _ in range(LANES)]


def powers(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    """``base ** exponents`` modulo the prime, by squaring."""
    out = np.ones(len(exponents), np.int64)
    left, square = exponents.copy(), base
    while left.any():
        out = np.where(left & 1, out * square % prime, out)
        left >>= 1
        square = square * square % prime
    return out


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn; the role's length keeps role and text apart."""
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)


def sorted_turns(turns: DataFrame, seed: int, prime: int) -> DataFrame:
    """(conv, part, local, d0, d1, n_bytes, p0.., t0..) of every turn.

    ``local`` counts the turns of the conversation in this partition, p is the
    product up to the turn, and t its own term.
    """
    base = bases(seed, prime)
    order = ["conv", "turn", "digest", "row"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, count, carry = None, 0, [0] * LANES
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column("conv").to_numpy()
            digest = np.array([bytes.fromhex(d) for d in batch.column("digest").to_pylist()], "S32")
            words = np.frombuffer(digest.tobytes(), "<u8").reshape(n, LANES)
            begins = np.flatnonzero(np.diff(conv, prepend=conv[0] - 1) != 0)
            sizes = np.diff(begins, append=n)
            local = np.arange(n) - np.repeat(begins, sizes)
            goes_on = last is not None and conv[0] == last
            if goes_on:
                local[: sizes[0]] += count
            columns = []
            for k in range(LANES):
                term = (words[:, k] % np.uint64(prime)).astype(np.int64) * powers(base[k], local, prime) % prime
                run = np.cumsum(term)
                before = run[begins] - term[begins]
                if goes_on:
                    before[0] -= carry[k]
                product = (run - np.repeat(before, sizes)) % prime
                carry[k] = int(product[-1])
                columns += [product, term]
            last, count = conv[-1], int(local[-1]) + 1
            bits = words.astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv"), pa.array(np.full(n, part, np.int32)), pa.array(local.astype(np.int64)),
                    pa.array(bits[:, 0]), pa.array(bits[:, 1]), batch.column("n_bytes"),
                    *map(pa.array, columns),
                ],
                ["conv", "part", "local", "d0", "d1", "n_bytes", *lane_names("p", "t")],
            )

    schema = "conv bigint, part int, local bigint, d0 bigint, d1 bigint, n_bytes bigint, " + ", ".join(
        f"{c} bigint" for c in lane_names("p", "t")
    )
    return turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(scan, schema)


def lane_names(*letters: str) -> list[str]:
    return [f"{letter}{k}" for k in range(LANES) for letter in letters]


def carried(turns: DataFrame, seed: int, prime: int) -> DataFrame:
    """(conv, part, start, s0.., w0..) of pieces that have earlier pieces.

    At most one conversation of a partition begins in an earlier one, so there
    are no more rows than partitions.
    """
    base = bases(seed, prime)

    @F.pandas_udf("array<bigint>")
    def raised(exponent):
        values = exponent.to_numpy(np.int64)
        return exponent.__class__(list(np.stack([powers(b, values, prime) for b in base], axis=1)))

    pieces = turns.groupBy("conv", "part").agg((F.max("local") + 1).alias("size"))
    several = pieces.groupBy("conv").agg(F.count("*").alias("n")).filter("n > 1").select("conv")
    pieces = pieces.join(several, "conv", "left_semi")
    edge = pieces.select("conv", "part", (F.col("size") - 1).alias("local"), "size")
    ends = turns.join(F.broadcast(edge), ["conv", "part", "local"])
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = ends.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn(
        "w", raised("start")
    )
    for k in range(LANES):
        placed = placed.withColumn(f"w{k}", F.get("w", F.lit(k)))
        term = F.col(f"p{k}") * F.col(f"w{k}") % prime
        placed = placed.withColumn(f"s{k}", F.coalesce(F.sum(term).over(before), F.lit(0)) % prime)
    return placed.filter("start > 0").select("conv", "part", "start", *lane_names("s", "w"))


def whole_products(turns: DataFrame, pieces: DataFrame, prime: int) -> DataFrame:
    """(conv, pos, d0, d1, n_bytes, u0.., v0..): products up to and before every turn."""
    joined = turns.join(F.broadcast(pieces), ["conv", "part"], "left")
    start = F.coalesce("start", F.lit(0))
    out = []
    for k in range(LANES):
        s, w = F.coalesce(f"s{k}", F.lit(0)), F.coalesce(f"w{k}", F.lit(1))
        upto = (s + w * F.col(f"p{k}")) % prime
        out += [upto.alias(f"u{k}"), ((upto + prime - w * F.col(f"t{k}") % prime) % prime).alias(f"v{k}")]
    return joined.select("conv", (start + F.col("local")).alias("pos"), "d0", "d1", "n_bytes", *out)


def key(lanes: list[Column]) -> list[Column]:
    """Two 62-bit numbers of four lanes."""
    return [lanes[0] * F.lit(1 << 31) + lanes[1], lanes[2] * F.lit(1 << 31) + lanes[3]]


def conversation_parts(products: DataFrame, group: int, heads: int) -> DataFrame:
    """(conv, h, k, n_own, head, c0..): what a conversation is rebuilt from.

    ``head`` holds the first k turns of the base, c the product of the own turns
    that they replace.
    """
    h = (F.crc32(F.col("conv").cast("string")) % heads).alias("h")
    turn = F.struct("pos", *(f"u{k}" for k in range(LANES)), "d0", "d1", "n_bytes")
    opens = (F.col("pos") < heads - 1) & (F.col("conv") % group == 0)
    convs = (
        products.withColumn("h", h)
        .groupBy("conv", "h")
        .agg(
            F.count("*").alias("n_own"),
            F.sort_array(F.collect_list(F.when(opens, turn))).alias("opening"),
            *(F.max(F.when(F.col("pos") == F.col("h") - 1, F.col(f"u{k}"))).alias(f"c{k}") for k in range(LANES)),
        )
        .withColumn("base", F.col("conv") - F.col("conv") % group)
    )
    openings = convs.filter(F.col("conv") % group == 0).select(
        F.col("conv").alias("base"), F.col("opening").alias("of_base")
    )
    head = F.when(F.col("of_base").isNotNull(), F.slice("of_base", 1, F.col("h").cast("int"))).otherwise(
        F.slice("opening", 1, 0)
    )
    return (
        convs.join(openings, "base", "left")
        .withColumn("head", head)
        .select(
            "conv", "h", F.size("head").cast("long").alias("k"), "n_own", "head",
            *(F.coalesce(f"c{k}", F.lit(0)).alias(f"c{k}") for k in range(LANES)),
        )
    )


MEMBER = [*NODE, "px", "py", "conv", "d0", "d1", "n_bytes", "ends"]


def memberships(products: DataFrame, parts: DataFrame, seed: int, prime: int, heads: int, keep) -> DataFrame:
    """A row for every conversation and depth: node, node above, last turn, whether it ends."""
    base = bases(seed, prime)
    length = F.col("k") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))
    zero = F.lit(0).cast("long")
    roots = parts.select(
        zero.alias("depth"), zero.alias("x"), zero.alias("y"), zero.alias("px"), zero.alias("py"), "conv",
        zero.alias("d0"), zero.alias("d1"), zero.alias("n_bytes"), (length == 0).alias("ends"),
    )
    turn = F.col("turn")
    at = turn["pos"] + 1
    previous = F.get("head", (turn["pos"] - 1).cast("int"))
    here = key([turn[f"u{k}"] for k in range(LANES)])
    above = [F.when(turn["pos"] > 0, c).otherwise(0) for c in key([previous[f"u{k}"] for k in range(LANES)])]
    in_head = parts.select("conv", "head", length.alias("length"), F.explode("head").alias("turn")).select(
        at.alias("depth"), here[0].alias("x"), here[1].alias("y"), above[0].alias("px"), above[1].alias("py"),
        "conv", turn["d0"].alias("d0"), turn["d1"].alias("d1"), turn["n_bytes"].alias("n_bytes"),
        (at == F.col("length")).alias("ends"),
    )
    last = F.element_at("head", -1)
    states = parts.filter("n_own > h").select(
        "conv", "h", "k", "n_own", *(f"c{k}" for k in range(LANES)),
        *(F.when(F.col("k") > 0, last[f"u{k}"]).otherwise(0).alias(f"b{k}") for k in range(LANES)),
    )
    hot = hot_keys(parts.select("conv", "n_own"), "n_own", keep)
    own = join_hot(products, states, ["conv"], hot, "inner").filter("pos >= h")
    shift = (F.col("h") - F.col("k")).cast("int")
    depth = F.col("k") + F.col("pos") - F.col("h") + 1

    def rebuilt(letter: str) -> list[Column]:
        """Product of the base's head and the own turns after the first h."""
        lanes = []
        for k in range(LANES):
            back = F.get(F.array(*(F.lit(pow(base[k], -n, prime)) for n in range(heads))), shift)
            tail = (F.col(f"{letter}{k}") + prime - F.col(f"c{k}")) % prime
            lanes.append((F.col(f"b{k}") + back * tail) % prime)
        return key(lanes)

    here, above = rebuilt("u"), rebuilt("v")
    in_tail = own.select(
        depth.alias("depth"), here[0].alias("x"), here[1].alias("y"),
        *(F.when(depth > 1, c).otherwise(0).alias(n) for c, n in zip(above, ("px", "py"))),
        "conv", "d0", "d1", "n_bytes", (F.col("pos") == F.col("n_own") - 1).alias("ends"),
    )
    return roots.unionByName(in_head).unionByName(in_tail).select(*MEMBER)


def grouped(members: DataFrame) -> DataFrame:
    """One row a node; ``same`` is true if its members agree in last turn and node above."""
    told = ["px", "py", "d0", "d1", "n_bytes"]
    chain = F.xxhash64("conv")  # one to one on long numbers
    sums = members.groupBy(*NODE).agg(
        F.count("*").alias("n_convs"), F.min("conv").alias("conv"), F.min(chain).alias("chain"),
        *(F.min(c).alias(c) for c in told), *(F.max(c).alias(f"max_{c}") for c in told),
    )
    same = F.lit(True)
    for c in told:
        same = same & (F.col(c) == F.col(f"max_{c}"))
    return sums.withColumn("same", same).drop(*(f"max_{c}" for c in told))


def linked(nodes: DataFrame, keep) -> DataFrame:
    """Nodes with their number of children and the chain and conv of the node above."""
    above = [(F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")]
    below = nodes.filter("depth > 0")
    children = below.select(*above).groupBy(*NODE).agg(F.count("*").alias("n_children"))
    counted = keep(
        nodes.drop("same", "d0", "d1").join(children, NODE, "left").fillna(0, ["n_children"]), "counted"
    )
    hot = hot_keys(counted.select(*NODE, "n_children"), "n_children", keep)
    parents = counted.select(*NODE, F.col("chain").alias("parent_chain"), F.col("conv").alias("parent_conv"))
    carried_ = ["x", "y", "chain", "conv", "n_convs", "n_children", "n_bytes"]
    lower = counted.filter("depth > 0").select(*above, *(F.col(c).alias(f"own_{c}") for c in carried_))
    found = join_hot(lower, parents, NODE, hot, "left").select(
        (F.col("depth") + 1).alias("depth"), *(F.col(f"own_{c}").alias(c) for c in carried_),
        "parent_chain", "parent_conv",
    )
    top = counted.filter("depth = 0").select(
        "depth", *carried_, F.lit(None).cast("long").alias("parent_chain"), F.lit(None).cast("long").alias("parent_conv")
    )
    return keep(top.unionByName(found), "linked")


SUMS = ["n_leaves", "saved_tokens"]


def chain_totals(chains: DataFrame, keep) -> DataFrame:
    """(chain, sums) over a chain and all chains that hang on it, directly or not.

    Round by round, what a chain holds itself is passed to the chain above and
    summed there; a round more than the longest way through chains is taken.
    """
    up = chains.select("chain", "parent_chain")
    parts = [chains.select("chain", *SUMS)]
    passed = chains.select("chain", "parent_chain", *SUMS)
    while True:
        passed = keep(
            passed.filter("parent_chain is not null")
            .groupBy(F.col("parent_chain").alias("chain"))
            .agg(*(F.sum(c).alias(c) for c in SUMS)),
            "passed",
        )
        if passed.isEmpty():
            break
        parts.append(passed)
        passed = passed.join(up, "chain")
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total.groupBy("chain").agg(*(F.sum(c).alias(c) for c in SUMS))


def subtree_sums(nodes: DataFrame, keep) -> DataFrame:
    """(chain, depth, sums) over the subtree of every node."""
    own = nodes.select(
        "chain", "depth", "parent_chain",
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"),
    )
    tops = own.filter("parent_chain is null or parent_chain != chain").select(
        "chain", "parent_chain", (F.col("depth") - 1).alias("at")
    )
    chains = keep(own.groupBy("chain").agg(*(F.sum(c).alias(c) for c in SUMS)).join(tops, "chain"), "chains")
    totals = chain_totals(chains, keep)
    hanging = (
        totals.join(chains.select("chain", "parent_chain", "at"), "chain")
        .filter("parent_chain is not null")
        .groupBy(F.col("parent_chain").alias("chain"), F.col("at").alias("depth"))
        .agg(*(F.sum(c).alias(c) for c in SUMS))
    )
    single = own.select("chain", "depth", *SUMS).unionByName(hanging).groupBy("chain", "depth").agg(
        *(F.sum(c).alias(c) for c in SUMS)
    )
    sliced = single.withColumn("slice", F.floor(F.col("depth") / DEPTHS))
    deeper = Window.partitionBy("chain", "slice").orderBy(F.desc("depth"))
    inside = sliced.select("chain", "depth", "slice", *(F.sum(c).over(deeper).alias(c) for c in SUMS))
    later = Window.partitionBy("chain").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    below = sliced.groupBy("chain", "slice").agg(*(F.sum(c).alias(c) for c in SUMS))
    below = below.select("chain", "slice", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"later_{c}") for c in SUMS))
    return inside.join(below, ["chain", "slice"]).select(
        "chain", "depth", *((F.col(c) + F.col(f"later_{c}")).alias(c) for c in SUMS)
    )


DIGESTS = "depth bigint, x bigint, y bigint, part int, place bigint, ids string, ends_sha256 string"


def runs(batch: pa.RecordBatch) -> list[tuple[tuple[int, int, int], int, int]]:
    """(node, begin, end) of the nodes of one sorted batch."""
    columns = [batch.column(c).to_numpy() for c in NODE]
    changes = np.zeros(batch.num_rows, bool)
    changes[0] = True
    for c in columns:
        changes[1:] |= c[1:] != c[:-1]
    begins = np.flatnonzero(changes)
    ends = np.append(begins[1:], batch.num_rows)
    names = zip(*(c[begins].tolist() for c in columns))
    return list(zip(names, begins.tolist(), ends.tolist()))


def digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.int32(), pa.int64(), pa.string(), pa.string()]
    names = [f.split()[0] for f in DIGESTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of nodes inside the sorted partition; pieces of text of all others.

    The first and the last node of a partition may go on outside, and a list of
    more than ``HELD`` pieces is not held back.
    """
    part = TaskContext.get().partitionId()
    node, inside, texts, place = None, False, [], 0

    def pieces() -> list[tuple]:
        return [(*node, part, place + k, text, None) for k, text in enumerate(texts)]

    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv").to_pylist()
        out = []
        for name, begin, end in runs(batch):
            if name != node:
                if texts:
                    out.append((*node, None, None, None, hashlib.sha256(",".join(texts).encode()).hexdigest()))
                inside, node, texts, place = node is not None, name, [], 0
            texts += [",".join(map(str, ids[at : min(at + IDS, end)])) for at in range(begin, end, IDS)]
            inside = inside and len(texts) <= HELD
            if not inside:
                out += pieces()
                place += len(texts)
                texts = []
        if out:
            yield digest_rows(out)
    if texts:
        yield digest_rows(pieces())


def hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of nodes from their pieces of text in order, one piece held at a time."""
    node, sha = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column("ids").to_pylist()
        out = []
        for name, begin, end in runs(batch):
            if name != node:
                if node is not None:
                    out.append((*node, None, None, None, sha.hexdigest()))
                node, sha = name, hashlib.sha256()
                sha.update(texts[begin].encode())
                begin += 1
            for text in texts[begin:end]:
                sha.update(b",")
                sha.update(text.encode())
        if out:
            yield digest_rows(out)
    if node is not None:
        yield digest_rows([(*node, None, None, None, sha.hexdigest())])


def end_digests(members: DataFrame, keep) -> DataFrame:
    """(node, ends_sha256) of every node at which conversations end.

    SHA-256 has to see a list in order, so the pieces of a node that is cut by
    the ranges pass through one task, as a stream of short rows.
    """
    ends = members.filter("ends").select(*NODE, "conv")
    order = [*NODE, "conv"]
    found = keep(
        ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(hash_ids, DIGESTS), "ends"
    )
    cut = found.filter("ids is not null")
    joined = (
        cut.repartition(*NODE).sortWithinPartitions(*NODE, "part", "place").mapInArrow(hash_pieces, DIGESTS)
    )
    return found.filter("ids is null").unionByName(joined).select(*NODE, "ends_sha256")


def digests_hold(turns: DataFrame) -> bool:
    """Does every digest stand for one role and text?"""
    texts = turns.groupBy("digest", "role", "text").agg(F.lit(1).alias("one"))
    return texts.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def prefix_trie(
    conversations: DataFrame, keep, group: int = 5, heads: int = 9, prime: int = PRIME,
    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversation c begins with the first h = crc32(c) % ``heads`` turns of
    conversation c - c % ``group``, which take the place of its own first h.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"),
        role.alias("role"), text.alias("text"),
    )
    turns = turns.withColumn("digest", turn_digest(F.col("role"), F.col("text")))
    if not digests_hold(turns):
        raise ValueError("two turns share a digest")
    short = turns.select(
        "conv", "turn", "digest", F.octet_length("text").cast("long").alias("n_bytes"),
        F.monotonically_increasing_id().alias("row"),
    )
    for seed in SEEDS:
        ordered = keep(sorted_turns(short, seed, prime), "turns")
        products = whole_products(ordered, keep(carried(ordered, seed, prime), "carried"), prime)
        parts = keep(conversation_parts(products, group, heads), "parts")
        members = keep(memberships(products, parts, seed, prime, heads, keep), "members")
        nodes = keep(grouped(members), "nodes")
        if nodes.filter("not same").isEmpty():
            break
    else:
        raise ValueError("different conversations share fingerprints with every base")
    tree = linked(nodes, keep)
    sums = subtree_sums(tree, keep)
    return (
        tree.join(sums, ["chain", "depth"])
        .join(end_digests(members, keep), NODE, "left")
        .select(
            F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"),
            "n_convs", "n_children", *SUMS,
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )
