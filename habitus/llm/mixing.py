"""Mixing sources to target weights.

1. Each source's words, document after document in a pseudorandom order, are
   packed into blocks of a fixed number of words.
2. The mix is a row of output shards of about ``shard_blocks`` slots.  Each source
   has a fixed number of slots; how many of them a shard holds is a multinomial
   draw given that number, so small sources meet their targets too.
3. A source's slots are numbered through all shards; pass ``n`` over the source
   maps slot numbers to block numbers by a pseudorandom permutation of its own.
4. Blocks are joined by source and number.

No source has slots for more than ``PASSES`` passes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitus.llm.offsets import running_offsets
from habitus.llm.words import mix as hash64

BLOCK_WORDS = 64
SHARD_BLOCKS = 8192
SLOTS_PER_TASK = 500_000
WEIGHTS = (5, 2, 1)
SHARE = 1.5
PASSES = 2
#: Slices of a source in which running totals are taken.
SLICES = 1024
#: The recipe has a row per source and is held by the driver; more is an error.
MAX_SOURCES = 100_000

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Recipe:
    """Per source, in code point order with null last."""

    sources: list
    sizes: np.ndarray
    targets: np.ndarray

    @property
    def blocks(self) -> np.ndarray:
        return -(-self.sizes // BLOCK_WORDS)


def targets(sizes: Sequence[int], weights: Sequence[int] = WEIGHTS, share: float = SHARE) -> np.ndarray:
    """Words wanted from each source: ``share`` of all words by repeating weights.

    A target stops at ``PASSES`` times its source; what it gives up is shared
    among the others by weight, until none is above.
    """
    size = np.asarray(sizes, float)
    weight = np.array([weights[k % len(weights)] for k in range(len(size))], float)
    want = np.zeros(len(size))
    open_ = np.ones(len(size), bool)
    left = share * size.sum()
    while open_.any():
        want[open_] = left * weight[open_] / weight[open_].sum()
        full = open_ & (want > PASSES * size)
        if not full.any():
            break
        want[full] = PASSES * size[full]
        left -= want[full].sum()
        open_ &= ~full
    return want


def recipe(sized: DataFrame) -> Recipe:
    """Targets from (source, size)."""
    rows = (
        sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    )
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r["source"] is None, [ord(c) for c in r["source"] or ""]))
    sizes = np.array([r["size"] for r in rows], np.int64)
    return Recipe([r["source"] for r in rows], sizes, targets(sizes))


def permuted(number: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for each key, evaluated at ``number``.

    Four Feistel rounds over the next even number of bits; values outside the
    range are sent through again until they fall inside.
    """
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    value = number.astype(np.uint64)
    size = size.astype(np.uint64)
    todo = np.ones(len(value), bool)
    while todo.any():
        left, right = value[todo] >> half[todo], value[todo] & mask[todo]
        for turn in range(4):
            salt = hash64(key[todo].astype(np.uint64) + np.uint64(turn + 1))
            left, right = right, left ^ (hash64(right + salt) & mask[todo])
        value[todo] = (left << half[todo]) | right
        todo &= value >= size
    return value.astype(np.int64)


def slot_totals(plan: Recipe) -> np.ndarray:
    """Slots of each source in the whole mix, never more than ``PASSES`` over its blocks."""
    per_block = plan.sizes / np.maximum(plan.blocks, 1)
    wanted = np.where(plan.sizes > 0, plan.targets / np.maximum(per_block, 1e-9), 0)
    return np.minimum(np.rint(wanted).astype(np.int64), PASSES * plan.blocks)


def shard_draws(
    totals: np.ndarray, shards: int, begin: int, end: int, seed: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, sources, slots) for the shards from ``begin`` to ``end``.

    Every source's total is split multinomially over all shards: each half of a
    run of shards draws its part from a generator named by the run, so any task
    draws the same counts for a shard, and the counts of all shards add up.
    """
    runs = [(0, shards, np.flatnonzero(totals), totals[totals > 0])]
    while runs:
        low, high, sources, slots = runs.pop()
        if high <= begin or low >= end or not len(sources):
            continue
        if high - low == 1:
            yield low, sources, slots
            continue
        middle = (low + high) // 2
        left = np.random.default_rng([seed, low, high]).binomial(slots, (middle - low) / (high - low))
        right = slots - left
        runs.append((middle, high, sources[right > 0], right[right > 0]))
        runs.append((low, middle, sources[left > 0], left[left > 0]))


def drawn_slots(spark, plan: Recipe, seed: int, shard_blocks: int) -> DataFrame:
    """(source_no, shard, n): every shard's multinomial source counts."""
    totals = slot_totals(plan)
    shards = -(-int(totals.sum()) // shard_blocks)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            first, last = int(batch["id"].min()), int(batch["id"].max())
            for shard, sources, n in shard_draws(totals, shards, first, last + 1, seed):
                yield pd.DataFrame({"source_no": sources, "shard": shard, "n": n})

    tasks = max(1, min(shards, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, shards, 1, tasks).mapInPandas(draw, "source_no int, shard long, n long")


def mixed_blocks(spark, plan: Recipe, seed: int = 0, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """(source_no, shard, slot, pass, block): the mix as a table of block numbers."""
    numbered = running_offsets(
        drawn_slots(spark, plan, seed, shard_blocks), "source_no", F.expr("shard div 1024"), ["shard"], "n", "first"
    )
    blocks = np.asarray(plan.blocks, np.int64)

    @F.pandas_udf("pass int, block long")
    def place(source_no: pd.Series, slot: pd.Series) -> pd.DataFrame:
        source, number = source_no.to_numpy(), slot.to_numpy()
        size = blocks[source]
        turn = number // size
        key = hash64((source.astype(np.uint64) << np.uint64(20)) + turn.astype(np.uint64)) + np.uint64(seed)
        return pd.DataFrame({"pass": turn.astype(np.int32), "block": permuted(number % size, size, key)})

    # A few rows per shard become thousands of slots: spread them by what they become.
    total = int(plan.targets.sum()) // BLOCK_WORDS
    spread = numbered.repartition(1 + total // SLOTS_PER_TASK, "source_no", "shard")
    slots = spread.select(
        "source_no", "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot")
    )
    placed = slots.withColumn("at", place("source_no", "slot"))
    return placed.select("source_no", "shard", "slot", "at.pass", "at.block")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def packed(sized: DataFrame, plan: Recipe) -> DataFrame:
    """(row, id, source_no, size, first): where each document's words lie in its source.

    Documents go by id, then by a hash of the text; rows equal in both are the
    same to the mix.
    """
    numbers = sized.sparkSession.createDataFrame(
        [(s, k) for k, s in enumerate(plan.sources)], "name string, source_no int"
    )
    known = sized.join(F.broadcast(numbers), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    part = F.pmod(F.xxhash64("id", "digest"), F.lit(SLICES))
    return running_offsets(known, "source_no", part, ["id", "digest", "row"], "size", "first")


def mix(
    docs: DataFrame,
    keep,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 0,
) -> tuple[DataFrame, DataFrame, Recipe]:
    """(documents, blocks, recipe).

    ``documents`` has a row per input row: id, size, source, source_size,
    target, taken.  ``blocks`` has a row per piece of a document in a slot of
    the mix: shard, slot, pass, source_no, block, id, and the words ``begin`` to
    ``end`` of that document.  Null and empty texts have size 0 and are taken 0
    times; a null source is a source, the last one; rows that repeat an id are
    documents of their own; other columns are not read.  An empty table gives
    empty results.
    """
    spark = docs.sparkSession
    sized = keep(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            F.xxhash64(F.col(text_col).cast("string")).alias("digest"),
            word_count(F.col(text_col).cast("string")).alias("size"),
        )
    )
    plan = recipe(sized)
    placed = packed(sized, plan)
    pieces = placed.filter(F.col("size") > 0).select(
        "row",
        "id",
        "source_no",
        "first",
        "size",
        F.explode(
            F.sequence(
                F.expr(f"first div {BLOCK_WORDS}"), F.expr(f"(first + size - 1) div {BLOCK_WORDS}")
            )
        ).alias("block"),
    )
    cut = pieces.select(
        "row",
        "id",
        "source_no",
        "block",
        (F.greatest(F.col("block") * BLOCK_WORDS, "first") - F.col("first")).alias("begin"),
        (
            F.least((F.col("block") + 1) * BLOCK_WORDS, F.col("first") + F.col("size")) - F.col("first")
        ).alias("end"),
    )
    # Spark guesses the slots' size from the shards', far too low: never broadcast them.
    slots = mixed_blocks(spark, plan, seed).hint("merge")
    blocks = cut.join(slots, ["source_no", "block"]).select(
        "shard", "slot", "pass", "source_no", "block", "id", "begin", "end"
    )
    uses = slots.groupBy("source_no", "block").agg(F.count("*").alias("uses")).hint("merge")
    taken = (
        cut.join(uses, ["source_no", "block"])
        .groupBy("row")
        .agg(F.sum((F.col("end") - F.col("begin")) * F.col("uses")).alias("taken"))
        .hint("merge")
    )
    amounts = spark.createDataFrame(
        [
            (s, int(n), float(t))
            for s, n, t in zip(plan.sources, plan.sizes, plan.targets, strict=True)
        ],
        "name string, source_size long, target double",
    )
    documents = (
        sized.join(taken, "row", "left")
        .join(F.broadcast(amounts), F.col("source").eqNullSafe(F.col("name")))
        .select(
            F.col("id").alias(id_col),
            "size",
            F.col("source").alias(source_col),
            "source_size",
            "target",
            F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        )
    )
    return documents, blocks, plan
