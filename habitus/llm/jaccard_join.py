"""N-gram Jaccard join with token-combination prefixes.

A document is its set of five-word shingles (64-bit hashes).  Shingles have one
global order: by the level of their document frequency, rare first, then by
hash.  Frequencies come from counters of a fixed number over all documents; two
shingles may share a counter, which makes one look more frequent and changes
speed only.

Signatures of a set of ``n``, which must share ``t = ceil(0.8 n)`` shingles with
any partner: take shingles in order; a rare one counts 1, a frequent one counts
1 unless it is the first of its class (classes split frequent shingles by
hash).  The prefix ends when the count reaches ``n - t + 1``.  Were two sets that
reach the bound to share no rare shingle and at most one shingle per class in
their prefixes, they would miss ``n - t + 1`` shingles of the shorter-reaching
prefix: so linked sets share a rare shingle or a pair of one class.  Rare
shingles of the prefix are signatures, and so are all pairs within a class.  The
number of classes grows with ``n``: sets of neighbouring size steps (factor
1.25, as linked sets may differ by no more) meet under a common step.

Equal sets are one class of documents.  Candidates are verified in two rounds
so that no group of copies is expanded into pairs: first everything that shares
a signature with its first member, the one with the fewest shingles of its own;
then only sets that share a signature and are still in different components.

A pair is verified only if it can reach the similarity.  Whatever is common and
in the prefix that ends first is in both prefixes: at most the smaller number of
rare ones that occur elsewhere too, plus the common frequent ones, of which each
set carries the first ``CARRIED``.  The rest of the overlap is at most what stands
behind the prefix that ends first.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitus.llm.components import components
from habitus.llm.membership import bitmap, hits, places, without_ids
from habitus.llm.words import SPACED, mix, slices, windows, words

WINDOW = 5
#: Percent of the union that linked sets share.
PERCENT = 80
COUNTERS, CHUNKS = 1 << 22, 512
#: Bytes kept of a shingle's hash when sets are compared.
COMPARED = 5
#: Partners of one set that one task compares.
PARTNERS = 500
SIZE_STEP = 1.25
HEADS, CARRIED = 16, 48
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text of a batch."""
    for begin, end, data, offsets in slices(column):
        texts, hashes = words(data, offsets, SPACED)
        count = end - begin
        n_words = np.bincount(texts, minlength=count)
        owner, shingles = windows(texts, hashes, WINDOW)
        order = np.lexsort((shingles, owner))
        owner, shingles = owner[order], shingles[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (shingles[1:] != shingles[:-1])
        owner, shingles = owner[new], shingles[new]
        edges = np.searchsorted(owner, np.arange(count + 1))
        first = np.searchsorted(texts, np.arange(count + 1))
        for k in range(count):
            if 0 < n_words[k] < WINDOW:
                whole = hashes[first[k] : first[k + 1]]
                value = np.array([len(whole)], np.uint64)
                for h in whole:
                    value = mix(value * _PAIR + h)
                yield begin + k, value
            else:
                yield begin + k, shingles[edges[k] : edges[k + 1]]


def class_of(shingles: np.ndarray, level: np.ndarray) -> int:
    """Number of a set: a 60-bit digest below a measure of its rare shingles.

    Copies with edits have shingles much rarer than their median one; the text
    they were made from has none.  So the smallest number of a group is its
    most central set.
    """
    own = int((level.astype(np.int64) + 3 < np.median(level)).sum()).bit_length()
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=8).digest()
    return min(own, 7) << 60 | int.from_bytes(digest, "little") >> 4


def frequency_levels(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(level per counter, first frequent level) from all texts of ``docs`` (id, text)."""
    width = COUNTERS // CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(COUNTERS, np.uint32)
        waiting: list[np.ndarray] = []

        def add_up():
            places, n = np.unique(np.concatenate(waiting), return_counts=True)
            held[places.astype(np.int64)] += n.astype(np.uint32)
            waiting.clear()

        for batch in batches:
            size = 0
            for _, shingles in shingle_sets(batch.column(0)):
                waiting.append(shingles & np.uint64(COUNTERS - 1))
                size += len(shingles)
                if size > 1 << 17:
                    add_up()
                    size = 0
            if waiting:
                add_up()
            pa.default_memory_pool().release_unused()
        if held.any():
            parts = [zlib.compress(part.tobytes(), 1) for part in held.reshape(CHUNKS, width)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], names=["chunk", "data"]
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(data), np.uint32)
                held[chunk] = held.get(chunk, 0) + part.astype(np.uint64)
        level = lambda v: np.floor(2 * np.log2(np.maximum(v, 1))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(held), pa.int32()),
                pa.array([level(v).tobytes() for v in held.values()], pa.binary()),
                pa.array([int(v.sum()) for v in held.values()], pa.int64()),
            ],
            names=["chunk", "levels", "total"],
        )

    spark = docs.sparkSession
    tasks = min(CHUNKS, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = (
        docs.select("text")
        .mapInArrow(count, "chunk int, data binary")
        .repartition(tasks, "chunk")
        .mapInArrow(add, "chunk int, levels binary, total long")
        .collect()
    )
    levels = np.zeros((CHUNKS, width), np.uint8)
    for row in rows:
        levels[row["chunk"]] = np.frombuffer(row["levels"], np.uint8)
    mean = sum(row["total"] for row in rows) / COUNTERS
    return levels.ravel(), math.ceil(2 * math.log2(32 + 4 * mean))


def _place(level: np.ndarray, ordered: np.ndarray, length: int) -> int:
    """Where the global order stands at the end of a prefix, as a positive number."""
    return int(level[length - 1]) << 56 | int(ordered[length - 1]) >> 8


def signatures(
    shingles: np.ndarray, level: np.ndarray, frequent: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(rare shingles, hashes of frequent pairs, frequent shingles, last place) of one prefix.

    A set of fewer than two shingles has none: it is linked to equal sets only.
    """
    n = len(shingles)
    none = np.empty(0, np.uint64)
    if n < 2:
        return none, none, none, 0
    need = n - (PERCENT * n + 99) // 100 + 1
    order = np.lexsort((shingles, level))
    ordered, often = shingles[order], level[order] >= frequent
    if not often[:need].any():
        return mix(ordered[:need]), none, none, _place(level[order], ordered, need)
    out, longest = [], 0
    step = math.floor(math.log(n) / math.log(SIZE_STEP) + 1e-9)
    for key in (step, step + 1):
        classes = max(1, int(0.08 * SIZE_STEP ** (key - 1)))
        group = (ordered >> np.uint64(11)).astype(np.int64) % classes
        where = np.flatnonzero(often)
        credit = np.ones(n, np.int64)
        credit[where[np.unique(group[where], return_index=True)[1]]] = 0
        end = int(np.searchsorted(np.cumsum(credit), need)) + 1
        longest = max(longest, end)
        chosen = where[where < end]
        by_group = chosen[np.argsort(group[chosen], kind="stable")]
        for members in np.split(by_group, np.flatnonzero(np.diff(group[by_group])) + 1):
            if len(members) > 1:
                tokens = np.sort(ordered[members])
                a, b = np.triu_indices(len(tokens), 1)
                out.append(mix(mix(tokens[a]) * _PAIR + tokens[b] + np.uint64(key)))
    head, frequent_ones = ordered[:longest], often[:longest]
    return (
        mix(head[~frequent_ones]),
        np.unique(np.concatenate([none, *out])),
        head[frequent_ones],
        _place(level[order], ordered, longest),
    )


def signature_table(docs: DataFrame, levels: np.ndarray, frequent: int) -> DataFrame:
    """A row (id, class, n, behind, often, place, carried) per document of ``docs``
    (id, text), and a row (signature, single, class, n) per signature.

    ``behind`` counts the shingles after the prefix, ``often`` the frequent ones
    in it, of which ``carried`` has the first; ``place`` is where the prefix ends;
    ``class`` is null for an empty set.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    kind = docs.schema["id"].dataType.simpleString()
    columns = ("id", "is_doc", "class", "n", "signature", "single", "behind", "often", "place", "carried")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            classes, sizes, marks, lengths, alone = [], [], [], [], []
            held = 0

            def flush(classes=classes, sizes=sizes, marks=marks, lengths=lengths, alone=alone, type_=ids.type):
                flat = np.concatenate(marks).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.nulls(len(flat), type_), pa.array(np.zeros(len(flat), bool)),
                        pa.array(np.repeat(classes, lengths)), pa.array(np.repeat(sizes, lengths).astype(np.int32)),
                        pa.array(flat), pa.array(np.repeat(alone, lengths)),
                        pa.nulls(len(flat), pa.int32()), pa.nulls(len(flat), pa.int32()),
                        pa.nulls(len(flat), pa.int64()), pa.nulls(len(flat), pa.list_(pa.int64())),
                    ],
                    names=columns,
                )
                for part in (classes, sizes, marks, lengths, alone):
                    part.clear()

            own, place = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            carried: list = [[]] * len(ids)
            size, behind, often = (np.zeros(len(ids), np.int32) for _ in range(3))
            for row, shingles in shingle_sets(batch.column(1)):
                if not len(shingles):
                    continue
                level = shared.value[(shingles & np.uint64(COUNTERS - 1)).astype(np.int64)]
                singles, pairs, common, place[row] = signatures(shingles, level, frequent)
                size[row], often[row] = len(shingles), len(common)
                behind[row] = len(shingles) - len(singles) - len(common)
                carried[row] = common[:CARRIED].view(np.int64)
                own[row] = class_of(shingles, level)
                for found, single in ((singles, True), (pairs, False)):
                    classes.append(own[row])
                    sizes.append(size[row])
                    marks.append(found)
                    lengths.append(len(found))
                    alone.append(single)
                held += len(singles) + len(pairs)
                if held > 1 << 16:
                    yield from flush()
                    held = 0
            if classes:
                yield from flush()
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array(np.ones(len(ids), bool)), pa.array(own, mask=size == 0), pa.array(size),
                    pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.bool_()), pa.array(behind), pa.array(often),
                    pa.array(place), pa.array(carried, pa.list_(pa.int64())),
                ],
                names=columns,
            )
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(
        extract,
        f"id {kind}, is_doc boolean, class long, n int, signature long, single boolean,"
        " behind int, often int, place long, carried array<long>",
    )


def compared_sets(docs: DataFrame, levels: np.ndarray, wanted: np.ndarray) -> DataFrame:
    """(class, tokens): the set of each document, ``COMPARED`` bytes per shingle, sorted.

    Only documents (id, text) that the filter ``wanted`` lets through, tested
    here so that a task needs one Python worker.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    filter_ = docs.sparkSession.sparkContext.broadcast(wanted)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, sets, held = [], [], 0
            chosen = hits(filter_.value, [c.to_numpy() for c in batch.columns[1:]])
            for _, shingles in shingle_sets(batch.column(0).filter(pa.array(chosen))):
                if len(shingles):
                    level = shared.value[(shingles & np.uint64(COUNTERS - 1)).astype(np.int64)]
                    classes.append(class_of(shingles, level))
                    raw = shingles.view(np.uint8).reshape(-1, 8)[:, 8 - COMPARED :]
                    sets.append(raw.tobytes())
                    held += raw.nbytes
                if held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(classes), pa.array(sets, pa.binary())], names=["class", "tokens"])
                    classes, sets, held = [], [], 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(classes, pa.int64()), pa.array(sets, pa.binary())], names=["class", "tokens"]
            )

    tested = docs.select("text", *(p.alias(f"place{k}") for k, p in enumerate(places(F.col("id")))))
    return tested.mapInArrow(extract, "class long, tokens binary")


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, COMPARED)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :COMPARED] = raw
    return out.view(np.uint64).ravel()


def verified(
    pairs: DataFrame, docs: DataFrame, levels: np.ndarray, members: DataFrame, keep
) -> DataFrame:
    """The pairs (a, b) of classes whose sets are linked.

    ``members`` has a document per class (class, id).  Only documents that stand
    for a class of some pair are read.  Sets meet by ``a``: each task gets the
    set of ``a`` first, then a slice of its partners one by one.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    standing = members.join(wanted, "class").select("id")
    sets = compared_sets(docs, levels, bitmap(standing, "id"))
    sets = keep(sets.join(wanted, "class", "left_semi").dropDuplicates(["class"]))
    slices_of = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("slices"))
    heads = slices_of.join(sets, slices_of["a"] == sets["class"]).select(
        "a", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"),
        F.lit(None).cast("long").alias("b"), "tokens",
    )
    partners = (
        pairs.join(slices_of, "a")
        .join(sets, pairs["b"] == sets["class"])
        .select("a", F.pmod(F.xxhash64("b"), F.col("slices")).cast("int").alias("slice"), "b", "tokens")
    )
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = (
        heads.unionByName(partners)
        .repartition(tasks, "a", "slice")
        .sortWithinPartitions("a", "slice", F.col("b").asc_nulls_first())
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, head = None, np.empty(0, np.uint64)
        for batch in batches:
            found = []
            for a, slice_, b, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b is None:
                    current, head = (a, slice_), _unpacked(tokens)
                    continue
                if current != (a, slice_):
                    raise ValueError("a set is missing")
                other = _unpacked(tokens)
                common = len(np.intersect1d(head, other, assume_unique=True))
                if 100 * common >= PERCENT * (len(head) + len(other) - common):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())],
                names=["a", "b"],
            )

    return keep(together.mapInArrow(compare, "a long, b long"))


def jaccard_components(
    docs: DataFrame, keep, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_shingles, component_id) for every row.

    A component is what links reach; its id is the smallest document id in it.
    Null texts count as empty; texts without words have no shingles and their
    own id as component; one to four words are one shingle; repeated rows are
    equal sets; a null id never names a component that has another id; other
    columns are not read.
    """
    narrow = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    levels, frequent = frequency_levels(narrow)
    table = keep(signature_table(narrow, levels, frequent))
    members = (
        table.filter("is_doc and class is not null")
        .groupBy("class")
        .agg(F.min("id").alias("id"))
    )
    marks = table.filter("not is_doc").select("signature", "single", "class", "n")
    shared = (
        marks.groupBy("signature")
        .agg(F.min(F.struct("class", "n")).alias("least"), F.max("class").alias("most"))
        .filter("least.class != most")
        .select("signature", F.col("least.class").alias("a"), F.col("least.n").alias("an"))
        .hint("merge")
    )
    meeting = keep(marks.join(shared, "signature").distinct())
    met = meeting.filter("single").groupBy("class").agg(F.count("*").cast("int").alias("met"))
    bounds = keep(
        table.filter("is_doc and class is not null")
        .groupBy("class")
        .agg(*(F.first(c).alias(c) for c in ("often", "behind", "place", "carried")))
        .join(met, "class", "left")
        .select("class", F.coalesce("met", F.lit(0)).alias("met"), "often", "behind", "place", "carried")
    )
    close = lambda x, y: f"100 * least({x}, {y}) >= {PERCENT} * greatest({x}, {y})"
    reach = lambda x, y: (
        f"{100 + PERCENT} * (least(met{x}, met{y}) + if(place{x} <= place{y}, behind{x}, behind{y})"
        f" + least(often{x}, often{y}, size(array_intersect(carried{x}, carried{y}))"
        f" + often{x} - size(carried{x}) + often{y} - size(carried{y})))"
        f" >= {PERCENT} * (n{x} + n{y})"
    )
    traits = ("met", "often", "behind", "place", "carried")
    side = lambda x: bounds.select(F.col("class").alias(x), *(F.col(c).alias(c + x) for c in traits))
    first = keep(
        meeting.filter(F.col("class") != F.col("a"))
        .select("a", F.col("an").alias("na"), F.col("class").alias("b"), F.col("n").alias("nb"))
        .filter(close("na", "nb"))
        .distinct()
        .join(side("a"), "a")
        .join(side("b"), "b")
        .filter(reach("a", "b"))
        .select("a", "b")
    )
    links = verified(first, narrow, levels, members, keep)
    roots = components(links, keep)

    placed = meeting.join(roots.withColumnRenamed("node", "class"), "class", "left").select(
        "signature", "class", "n", F.coalesce("root", "class").alias("root")
    )
    mixed = (
        placed.groupBy("signature")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"))
        .filter("low != high")
        .select("signature")
        .hint("merge")
    )
    apart = keep(placed.join(mixed, "signature"))
    # A pair meets under many signatures; it is made under the smallest that is
    # among the first few of both sets, where there is one.
    heads = apart.groupBy("class").agg(
        F.slice(F.sort_array(F.collect_set("signature")), 1, HEADS).alias("heads")
    )
    bounded = keep(apart.join(heads, "class").join(bounds, "class"))
    left, right = (
        bounded.select("signature", *(F.col(c).alias(c + x) for c in ("class", "n", "root", "heads", *traits)))
        for x in "ab"
    )
    once = F.coalesce(F.get(F.array_intersect("headsa", "headsb"), 0), left["signature"]) == left["signature"]
    pairable = (
        (left["signature"] == right["signature"])
        & F.expr("roota < rootb")
        & F.expr(close("na", "nb"))
        & F.expr(reach("a", "b"))
        & once
    )
    second = (
        left.join(right, pairable)
        .select(F.least("classa", "classb").alias("a"), F.greatest("classa", "classb").alias("b"))
        .distinct()
        .join(first, ["a", "b"], "left_anti")
    )
    second = keep(second)
    if not second.isEmpty():
        links = keep(links.unionByName(verified(second, narrow, levels, members, keep)))
        roots = components(links, keep)
    named = (
        members.join(roots.withColumnRenamed("node", "class"), "class", "left")
        .select("class", "id", F.coalesce("root", "class").alias("root"))
    )
    smallest = named.groupBy("root").agg(F.min("id").alias("component"))
    labelled = named.join(smallest, "root").select("class", "component")
    return (
        table.filter("is_doc")
        .select("id", "class", "n")
        .join(labelled, "class", "left")
        .select(
            F.col("id").alias(id_col),
            F.col("n").cast("long").alias("n_shingles"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )


def one_of_each(docs: DataFrame, keep, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents whose component has a smaller id.

    Rows that share an id share its fate; rows equal in id and text stay once.
    Rows without an id stay.
    """
    found = keep(jaccard_components(docs, keep, id_col, text_col))
    gone = found.filter(F.col(id_col) != F.col("component_id")).select(id_col)
    kept = without_ids(docs, gone, id_col)
    twice = keep(found.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").select(id_col))
    if twice.isEmpty():
        return kept
    again = kept.join(twice, id_col, "left_semi").dropDuplicates([id_col, text_col])
    return without_ids(kept, twice, id_col).unionByName(again.select(*kept.columns))
