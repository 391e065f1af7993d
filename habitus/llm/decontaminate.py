"""Benchmark decontamination with built-in functions only.

Texts are compared as words without case and punctuation, in five-word shingles
that weigh more the fewer benchmark items hold them.

1. Every shingle of every document is looked up in the benchmark's shingles.
   Only shingles found there can add to a similarity, so nothing is lost.
2. From each place where a run of found shingles begins, and from each found
   first shingle of an item, windows are cut in every size that items have.  A
   window stands if its found weight allows the similarity wanted.
3. Windows and items get 64-bit SimHash fingerprints over benchmark shingles.
   The fingerprint is cut into four blocks of 16 bits; items are indexed under
   every value within three bits of each block.  Two fingerprints that differ in
   at most ``RADIUS`` = 15 bits differ in at most three bits of some block, so
   every such pair of equal size meets.
4. Pairs that meet are verified by exact weighted-shingle (bag) similarity.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from habitus.llm.columns import window_hashes
from habitus.session import broadcast_if_small

WINDOW = 5
PERCENT = 80
BLOCKS, BLOCK_BITS = 4, 16
RADIUS = 15
#: Weights are whole numbers, so sums are exact.
SCALE = 100


def shingles(text: Column) -> Column:
    """Hashes of all five-word shingles, in order; null texts have none."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return window_hashes(F.transform(words, lambda w: F.xxhash64(w)), WINDOW)


def fingerprint(hash_: Column, weight: Column) -> Column:
    """SimHash as an aggregate: bit k is set when the weights of hashes with bit k prevail."""
    bits = []
    for k in range(64):
        signed = F.when(F.shiftright(hash_, k).bitwiseAND(F.lit(1)) == 1, weight).otherwise(-weight)
        one = 1 << k if k < 63 else -(1 << 63)
        bits.append(F.when(F.sum(signed) > 0, F.lit(one)).otherwise(F.lit(0)).cast("long"))
    out = bits[0]
    for bit in bits[1:]:
        out = out.bitwiseOR(bit)
    return out


def block(fingerprint_: Column, k: int) -> Column:
    return F.shiftright(fingerprint_, k * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def near_masks() -> list[int]:
    """Differences of at most RADIUS // BLOCKS bits within a block."""
    return [
        sum(1 << b for b in chosen)
        for n in range(RADIUS // BLOCKS + 1)
        for chosen in combinations(range(BLOCK_BITS), n)
    ]


class Benchmark:
    """Shingles, weights, sizes and fingerprints of the items.

    An item is a pair of id (null too) and text, so repeated rows count once.
    Equal texts share one bag: ``item`` is a hash of the text, and ``names``
    holds the ids of each.
    """

    def __init__(self, items: DataFrame, keep, id_col: str, text_col: str):
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        listed = items.select(F.col(id_col).alias("name"), F.xxhash64(text).alias("item"), text.alias("text"))
        self.names = keep(listed.select("name", "item").distinct())
        total = self.names.count()
        texts = (
            listed.groupBy("item")
            .agg(F.first("text").alias("text"))
            .join(self.names.groupBy("item").agg(F.count("*").alias("named")), "item")
            .select("item", "named", shingles(F.col("text")).alias("s"))
        )
        rows = keep(
            texts.select("item", "named", F.size("s").alias("size"), F.posexplode("s").alias("place", "shingle"))
        )
        holders = rows.groupBy("shingle", "item").agg(
            F.first("named").alias("named"), F.min("place").alias("place")
        )
        self.vocabulary = keep(
            holders.groupBy("shingle")
            .agg(F.sum("named").alias("df"), F.max(F.col("place") == 0).alias("opens"))
            .select("shingle", "opens", F.round(SCALE * F.log1p(F.lit(total) / F.col("df"))).cast("long").alias("weight"))
        )
        #: Weight of a shingle that no item has.
        self.foreign = int(
            items.sparkSession.range(1).select(F.round(SCALE * F.log1p(F.lit(float(total))))).first()[0] or 0
        )
        weighted = rows.join(self.vocabulary, "shingle")
        self.bags = keep(
            weighted.groupBy("item", "shingle", "weight").agg(F.count("*").alias("item_n"))
        )
        self.items = keep(
            weighted.groupBy("item").agg(
                F.first("size").alias("size"),
                F.sum("weight").alias("item_weight"),
                fingerprint(F.col("shingle"), F.col("weight")).alias("item_print"),
            )
        )
        self.sizes = sorted(r["size"] for r in self.items.select("size").distinct().collect())

    def index(self) -> DataFrame:
        """A row per item, block and value within reach of that block."""
        masks = F.array(*(F.lit(m) for m in near_masks()))
        spread = self.items.select(
            "item", "size", "item_weight", "item_print",
            F.posexplode(F.array(*(block(F.col("item_print"), k) for k in range(BLOCKS)))).alias("block", "value"),
        )
        return spread.withColumn("value", F.explode(F.transform(masks, lambda m: F.col("value").bitwiseXOR(m))))


def found_shingles(docs: DataFrame, bench: Benchmark, id_col: str, text_col: str) -> DataFrame:
    """(key, id, place, shingle, weight, opens): every benchmark shingle of every document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cut = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), shingles(text).alias("s")
    )
    every = cut.select("id", "key", F.posexplode("s").alias("place", "shingle"))
    small = broadcast_if_small(bench.vocabulary)
    return every.join(bench.vocabulary if small is None else small, "shingle")


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    keep,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(id, key, item_id, start_word, n_words, hamming, similarity): the best window per text and item.

    ``key`` is a hash of the text.  Null and short texts (under five words) have
    no shingles and match nothing, on either side; an empty table on either side
    gives no rows; equal windows are settled by the first place; repeated rows
    are reported once per id, and all their texts share the key; repeated item
    rows count once, each text of an item id is looked for by itself, and null
    item ids are reported as null; other columns are not read.
    """
    bench = Benchmark(items, keep, item_id, item_text)
    hits = keep(found_shingles(docs, bench, id_col, text_col))
    longest = max(bench.sizes, default=1)
    # Equal texts are compared once.
    texts = hits.select("key", "place", "shingle", "weight", "opens").distinct()
    in_order = Window.partitionBy("key").orderBy("place")
    starts = texts.select(
        "key",
        F.col("place").alias("start"),
        (F.col("opens") | (F.col("place") - F.coalesce(F.lag("place").over(in_order), F.lit(-2)) > 1)).alias("begins"),
    ).filter("begins").drop("begins").distinct()
    # A window reaches into its start's stretch of places and the next one.
    stretch = F.floor(F.col("start") / longest)
    reached = starts.withColumn("stretch", F.explode(F.array(stretch, stretch + 1)))
    near = texts.select(
        "key", F.floor(F.col("place") / longest).alias("stretch"), F.struct("place", "shingle", "weight").alias("h")
    )
    runs = (
        reached.join(near, ["key", "stretch"])
        .filter((F.col("h.place") >= F.col("start")) & (F.col("h.place") < F.col("start") + longest))
        .groupBy("key", "start")
        .agg(F.array_sort(F.collect_list("h")).alias("ahead"))
    )
    sized = runs.select(
        "key", "start", "ahead", F.explode(F.array(*(F.lit(n) for n in bench.sizes or [0]))).alias("size")
    ).withColumn("found", F.filter("ahead", lambda h: h["place"] < F.col("start") + F.col("size")))
    weight = F.aggregate("found", F.lit(0).cast("long"), lambda acc, h: acc + h["weight"])
    windows = keep(
        sized.select("key", "start", "size", "found", weight.alias("found_weight"))
        .withColumn(
            "window_weight", F.col("found_weight") + (F.col("size") - F.size("found")) * F.lit(bench.foreign)
        )
        .filter(100 * F.col("found_weight") >= PERCENT * F.col("window_weight"))
        .select("key", "start", "size", "window_weight", "found")
    )
    name = ["key", "start", "size"]
    terms = windows.select(*name, "window_weight", F.explode("found").alias("h"))
    prints = terms.groupBy(*name, "window_weight").agg(
        fingerprint(F.col("h.shingle"), F.col("h.weight")).alias("print")
    )
    probes = prints.select(
        *name, "window_weight", "print",
        F.posexplode(F.array(*(block(F.col("print"), k) for k in range(BLOCKS)))).alias("block", "value"),
    )
    met = (
        probes.join(bench.index(), ["size", "block", "value"])
        .withColumn("hamming", F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))))
        .filter(F.col("hamming") <= RADIUS)
        .select(*name, "window_weight", "item", "item_weight", "hamming")
        .distinct()
    )
    bags = terms.groupBy(*name, F.col("h.shingle").alias("shingle")).agg(F.count("*").alias("n"))
    common = (
        met.join(bags, name)
        .join(bench.bags, ["item", "shingle"])
        .groupBy(*name, "window_weight", "item", "item_weight", "hamming")
        .agg(F.sum(F.least("n", "item_n") * F.col("weight")).alias("common"))
    )
    union = F.col("window_weight") + F.col("item_weight") - F.col("common")
    verified = common.filter(100 * F.col("common") >= PERCENT * union).withColumn(
        "similarity", F.col("common") / union
    )
    best = (
        verified.groupBy("key", "item")
        .agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "size", "hamming")).alias("best"))
        .join(bench.names, "item")
        .groupBy("key", "name")
        .agg(F.max("best").alias("best"))
    )
    named = hits.select("id", "key").distinct()
    return best.join(named, "key").select(
        F.col("id").alias(id_col),
        "key",
        F.col("name").alias(item_id),
        (-F.col("best.back")).cast("long").alias("start_word"),
        (F.col("best.size") + WINDOW - 1).cast("long").alias("n_words"),
        F.col("best.hamming").cast("long").alias("hamming"),
        F.col("best.similarity").alias("similarity"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, keep, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item."""
    gone = keep(contaminated(docs, items, keep, id_col, text_col).select("key").distinct())
    small = broadcast_if_small(gone)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = docs.withColumn("__key", F.xxhash64(text))
    gone = (gone if small is None else small).withColumnRenamed("key", "__key")
    return marked.join(gone, "__key", "left_anti").select(*docs.columns)
