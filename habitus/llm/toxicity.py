"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of other texts, hold continuation counts of words and
of word pairs: in how many different texts an expression occurs.  Both back off
to the same shared counts.  What a class expects of an expression is its share
of the shared count; a class departs from that only by what remains of the
difference after an absolute discount (``DISCOUNT`` plus ``DEVIATIONS`` standard
deviations of the expected count).  Rare expressions therefore score alike in
both classes, and so do common ones that are equally common.  A word after its
predecessor is scored by the pair where the pair departs, else by the word.

The evidence of a text is its log-likelihood under the toxic model minus that
under the other, divided by its length; a logistic curve learned from the same
rows turns it into a score.

Every expression is counted by itself, under a 64-bit hash, in a Parquet table that
grows with the labelled rows.  Only expressions on which the classes differ score;
they are broadcast if they measure small, and joined to the texts' expressions if not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitus.llm.membership import only_ids
from habitus.llm.words import PLAIN, mix, slices, words
from habitus.session import BROADCAST_LIMIT

#: Kinds of rows of the table of counts: words, pairs, and the sums of each.
WORD, PAIR, WORDS, PAIRS = range(4)
#: Entries that a worker gathers before it hands on their sums.
HELD = 1 << 20
#: Bytes of an entry that is broadcast: hash and log ratio.
ENTRY = 12
#: Absolute discount, and the standard deviations of the expected count added to it.
DISCOUNT, DEVIATIONS = 2.0, 4.0
#: Words added to a text's length, so that a few words never decide alone.
LENGTH_PRIOR = 20
#: Evidence is calibrated in this many steps per unit, within +-RANGE.
STEPS, RANGE = 2000, 4


def pairs(texts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word with its predecessor, and where there is one."""
    two, has = np.zeros(len(hashes), np.uint64), np.zeros(len(hashes), bool)
    if len(hashes) > 1:
        two[1:] = mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])
        has[1:] = texts[1:] == texts[:-1]
    return two, has


def once(texts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every expression of a text once."""
    order = np.lexsort((hashes, texts))
    texts, hashes = texts[order], hashes[order]
    first = np.ones(len(texts), bool)
    first[1:] = (texts[1:] != texts[:-1]) | (hashes[1:] != hashes[:-1])
    return texts[first], hashes[first]


def summed(kind: int, hashes: list[np.ndarray], toxic: list[np.ndarray]) -> pa.RecordBatch:
    """Texts per class of each hash, and a row of their sums."""
    keys, where = np.unique(np.concatenate(hashes), return_inverse=True)
    bad = np.bincount(where, np.concatenate(toxic), len(keys)).astype(np.int64)
    other = np.bincount(where, minlength=len(keys)) - bad
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.append(np.full(len(keys), kind), WORDS + kind).astype(np.int8)),
            pa.array(np.append(keys.view(np.int64), 0)),
            pa.array(np.append(other, other.sum())),
            pa.array(np.append(bad, bad.sum())),
        ],
        names=["kind", "hash", "other", "toxic"],
    )


def count_expressions(labelled: DataFrame) -> DataFrame:
    """(kind, hash, other, toxic): texts per class of every expression, and sums per kind.

    Expressions of at most ``DISCOUNT`` texts are counted in the sums only: their
    excess is never above the discount, so they back off in both classes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (([], []), ([], []))
        size = 0
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for begin, _, data, offsets in slices(batch.column(0)):
                texts, hashes = words(data, offsets, PLAIN)
                two, has = pairs(texts, hashes)
                for kind, found in ((WORD, once(texts, hashes)), (PAIR, once(texts[has], two[has]))):
                    held[kind][0].append(found[1])
                    held[kind][1].append(label[begin + found[0]])
                    size += len(found[0])
                if size >= HELD:
                    for kind in (WORD, PAIR):
                        yield summed(kind, *held[kind])
                    held, size = (([], []), ([], [])), 0
        if size:
            for kind in (WORD, PAIR):
                yield summed(kind, *held[kind])

    return (
        labelled.select("text", F.col("label").cast("int").alias("label"))
        .mapInArrow(count, "kind byte, hash long, other long, toxic long")
        .groupBy("kind", "hash")
        .agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
        .filter((F.col("kind") >= WORDS) | (F.col("other") + F.col("toxic") > DISCOUNT))
    )


def log_ratios(counts: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """log P(expression | toxic) - log P(expression | other); 0 where both back off.

    ``total`` holds the sums per class if ``counts`` is a part of the table.
    """
    shared = counts.sum(axis=0)
    total = counts.sum(axis=1) if total is None else total
    if not (total > 0).all():
        return np.zeros(counts.shape[1], np.float32)
    logs = []
    for kind in (0, 1):
        expected = shared * total[kind] / total.sum()
        excess = counts[kind] - expected
        left = np.maximum(np.abs(excess) - DISCOUNT - DEVIATIONS * np.sqrt(expected), 0)
        mass = expected + np.sign(excess) * left
        logs.append(np.log(np.where(shared > 0, mass, 1) / total[kind]))
    out = logs[1] - logs[0]
    out[shared == 0] = 0
    out[np.abs(out) < 1e-9] = 0
    return out.astype(np.float32)


def log_ratio_table(counts: DataFrame) -> DataFrame:
    """(kind, hash, ratio) of the expressions whose log ratio is not 0."""
    totals = {WORDS: np.zeros(2), PAIRS: np.zeros(2)}
    for r in counts.filter(F.col("kind") >= WORDS).collect():
        totals[r["kind"]] = np.array([r["other"], r["toxic"]], float)

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column(0).to_numpy()
            table = np.stack([batch.column(k).to_numpy() for k in (2, 3)]).astype(float)
            out = np.zeros(len(kind), np.float32)
            for k in (WORD, PAIR):
                out[kind == k] = log_ratios(table[:, kind == k], totals[WORDS + k])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out)], names=["kind", "hash", "ratio"]
            )

    return (
        counts.filter(F.col("kind") < WORDS)
        .mapInArrow(ratios, "kind byte, hash long, ratio float")
        .filter(F.col("ratio") != 0)
    )


def looked_up(hashes: np.ndarray, keys: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Ratio of each hash, 0 for one that is not among the sorted keys."""
    if not len(keys):
        return np.zeros(len(hashes))
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, ratios[at], 0).astype(float)


def evidence_of(column: pa.Array, entries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Length-normalised log-likelihood difference of every text of a batch."""
    out = np.zeros(len(column))
    for begin, end, data, offsets in slices(column):
        texts, hashes = words(data, offsets, PLAIN)
        two, has = pairs(texts, hashes)
        word = looked_up(hashes, *entries[WORD])
        pair = np.where(has, looked_up(two, *entries[PAIR]), 0)
        given = pair.copy()
        given[1:] -= word[:-1]
        gain = np.where(pair != 0, given, word)
        count = end - begin
        out[begin:end] = np.bincount(texts, gain, count) / (
            np.bincount(texts, minlength=count) + LENGTH_PRIOR
        )
    return out


def places(column: pa.Array, keys: pa.Array) -> Iterator[pa.RecordBatch]:
    """(key, word, before, pair, n, length): each word after each predecessor, per text.

    A first word has null for predecessor and pair.
    """
    keys = keys.to_numpy()
    for begin, end, data, offsets in slices(column):
        texts, hashes = words(data, offsets, PLAIN)
        two, has = pairs(texts, hashes)
        length = np.bincount(texts, minlength=end - begin)
        before = np.zeros(len(hashes), np.uint64)
        before[1:] = hashes[:-1]
        rows = np.rec.fromarrays([texts, hashes, np.where(has, before, 0), np.where(has, two, 0), has])
        rows, n = np.unique(rows, return_counts=True)
        texts, word, before, two, has = (rows[name] for name in rows.dtype.names)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys[begin + texts]), pa.array(word.view(np.int64)),
                pa.array(before.view(np.int64), mask=~has), pa.array(two.view(np.int64), mask=~has),
                pa.array(n.astype(np.int64)), pa.array(length[texts].astype(np.int64)),
            ],
            names=["key", "word", "before", "pair", "n", "length"],
        )


@dataclass
class ToxicityModel:
    """``table`` holds (kind, hash, ratio); ``entries`` the same in memory if it is small."""

    table: DataFrame
    entries: list[tuple[np.ndarray, np.ndarray]] | None = None
    intercept: float = 0.0
    slope: float = 0.0

    def with_evidence(self, docs: DataFrame, text_col: str = "text", name: str = "evidence") -> DataFrame:
        """``docs`` with the evidence of each row's text."""
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        if self.entries is None:
            key = F.xxhash64(text)
            marked = docs.withColumn("__key", key)
            return (
                marked.join(self.joined(docs.select(key.alias("key"), text.alias("text"))), marked["__key"] == F.col("__of"), "left")
                .withColumn(name, F.coalesce("__evidence", F.lit(0.0)))
                .select(*docs.columns, name)
            )
        shared = docs.sparkSession.sparkContext.broadcast(self.entries)

        @F.arrow_udf("double")
        def difference(column: pa.Array) -> pa.Array:
            return pa.array(evidence_of(column, shared.value))

        return docs.withColumn(name, difference(text))

    def joined(self, texts: DataFrame) -> DataFrame:
        """(__of, __evidence) per key of ``texts`` (key, text), by joins with the table."""

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from places(batch.column(1), batch.column(0))

        every = texts.mapInArrow(cut, "key long, word long, before long, pair long, n long, length long")

        def ratios(kind: int, on: str) -> DataFrame:
            return self.table.filter(F.col("kind") == kind).select(
                F.col("hash").alias(on), F.col("ratio").cast("double").alias(f"{on}_ratio")
            )

        # A word alone counts its ratio; where the pair departs, pair less predecessor counts instead.
        alone = every.select("key", "length", "word", "n").join(ratios(WORD, "word"), "word")
        paired = (
            every.join(ratios(PAIR, "pair"), "pair")
            .join(ratios(WORD, "word"), "word", "left")
            .join(ratios(WORD, "before"), "before", "left")
        )
        instead = (
            F.col("pair_ratio") - F.coalesce("before_ratio", F.lit(0.0)) - F.coalesce("word_ratio", F.lit(0.0))
        )
        gains = alone.select("key", "length", (F.col("n") * F.col("word_ratio")).alias("gain")).unionByName(
            paired.select("key", "length", (F.col("n") * instead).alias("gain"))
        )
        total = gains.groupBy("key").agg(F.sum("gain").alias("gain"), F.first("length").alias("length"))
        copies = texts.groupBy("key").agg(F.count("*").alias("copies"))  # each copy of a text added its gain
        return total.join(copies, "key").select(
            F.col("key").alias("__of"),
            (F.col("gain") / F.col("copies") / (F.col("length") + LENGTH_PRIOR)).alias("__evidence"),
        )

    def score(self, evidence: Column) -> Column:
        return 1 / (1 + F.exp(-(F.lit(self.intercept) + F.lit(self.slope) * evidence)))


def labelled_once(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, label) once per id: the larger label of a repeated row, nulls dropped."""
    return (
        labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label_col).cast("int").alias("label"))
    )


def fit(
    docs: DataFrame, learned: DataFrame, keep, id_col: str = "doc_id", text_col: str = "text", limit: int = BROADCAST_LIMIT
) -> ToxicityModel:
    """The two models from every document with a row in ``learned`` (id, label)."""
    narrow = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    # The hint keeps one plan at every size; only labelled texts are shuffled.
    labelled = only_ids(narrow, learned, "id").join(learned.hint("shuffle_hash"), "id")
    table = keep(log_ratio_table(keep(count_expressions(labelled))))
    model = ToxicityModel(table)
    if ENTRY * table.count() <= limit:
        rows = table.toArrow()
        kind, hashes, ratio = (rows[name].to_numpy() for name in ("kind", "hash", "ratio"))
        model.entries = []
        for k in (WORD, PAIR):
            keys = hashes[kind == k].astype(np.int64).view(np.uint64)
            order = np.argsort(keys)
            model.entries.append((keys[order], ratio[kind == k][order].astype(np.float32)))
    return model


def calibrate(model: ToxicityModel, evidence: DataFrame, learned: DataFrame) -> ToxicityModel:
    """Logistic curve over all learned rows, from a histogram of fixed size.

    ``evidence`` holds (id, evidence).  With one class only, the score is that
    class's smoothed share.
    """
    step = F.round(F.least(F.greatest("evidence", F.lit(-RANGE)), F.lit(RANGE)) * STEPS)
    bins = (
        evidence.join(learned, "id")
        .groupBy(step.cast("int").alias("step"), "label")
        .count()
        .toArrow()
    )
    x = bins["step"].to_numpy() / STEPS
    y = bins["label"].to_numpy().astype(float)
    weight = bins["count"].to_numpy().astype(float)
    positive, total = float((weight * y).sum()), float(weight.sum())
    rate = (positive + 0.5) / (total + 1)
    model.intercept, model.slope = float(np.log(rate / (1 - rate))), 0.0
    if 0 < positive < total:
        mean = float((weight * x).sum() / total)
        spread = float(np.sqrt((weight * (x - mean) ** 2).sum() / total)) or 1.0
        inputs = np.stack([np.ones_like(x), (x - mean) / spread])
        beta = np.array([model.intercept, 0.0])
        ridge = np.array([1e-3, 0.1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(beta @ inputs, -30, 30)))
            gradient = inputs @ (weight * (p - y)) + ridge * beta
            hessian = (inputs * (weight * p * (1 - p))) @ inputs.T + np.diag(ridge)
            move = np.linalg.solve(hessian, gradient)
            beta = beta - np.clip(move, -3, 3)
            if np.abs(move).max() < 1e-8:
                break
        model.slope = float(beta[1] / spread)
        model.intercept = float(beta[0] - beta[1] * mean / spread)
    return model


def scored(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, evidence) per row, in input order of columns; null texts are empty."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return model.with_evidence(narrow).select("id", "evidence")


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    keep,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    threshold: float = 0.3,
) -> tuple[DataFrame, ToxicityModel]:
    """(id, score, predicted) for every row, and the model.

    ``learn`` tells over ``labels`` which rows may be learned from; ``keep``
    writes a table that is read twice (see ``tables.written``).  Null and empty
    texts have no evidence and get the curve's score at zero; null ids are
    scored and never learned from; repeated rows are scored each; other columns
    are not read.
    """
    learned = labelled_once(labels.filter(learn), id_col, label_col)
    model = fit(docs, learned, keep, id_col, text_col)
    evidence = keep(scored(docs, model, id_col, text_col))
    calibrate(model, evidence, learned)
    score = model.score(F.col("evidence"))
    result = evidence.select(
        F.col("id").alias(id_col), score.alias("score"), (score >= threshold).cast("int").alias("predicted")
    )
    return result, model
