"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into at most ``BINS`` bins.  Cyclic boosting visits the
features in turn and adds to each one's lookup table what a shallow tree over
its bins learns from the current residuals; then the pairs of features with the
largest remaining gain get small two-way tables in the same way.  A score is a
sum of table entries, looked up for whole Arrow batches at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitus.llm.words import PLAIN, hash_of, slices, windows, words

#: The model is fitted on at most this many labelled rows, drawn by a hash of
#: the id; it has a few thousand parameters, so more rows change little.
SAMPLE_ROWS = 50_000
BINS, COARSE = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 150, 60, 6
RATE, LEAST_WEIGHT = 0.1, 2.0

FEATURES = (
    "log_words", "mean_word", "long_word", "upper", "digits", "symbols", "bars", "exclaimed",
    "stops", "non_ascii", "lines", "distinct_words", "repeated_windows", "repeated_lines",
    "function_words",
)

# Frequent function words of four languages.
FUNCTION_WORDS = (
    "the of and to in is that it for was on as with be by at this from or an "
    "le la les de des du un une et est en que qui dans pour pas sur au par il elle "
    "der die das und ist von zu den mit im nicht ein eine auf dem sich es "
    "el los las y del se por con para su al lo como"
).split()

# Byte classes, exclusive: the last one that holds wins.
_KINDS = ("other", "lower", "upper", "digit", "punct", "symbol", "bar", "bang", "line", "space", "high")
_CODE = np.zeros(256, np.int64)
for _chars, _kind in (
    ("abcdefghijklmnopqrstuvwxyz", "lower"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "upper"),
    ("0123456789", "digit"), (".,;:?", "punct"), ("#*$%&<>", "symbol"), ("|", "bar"),
    ("!", "bang"), ("\n", "line"), (" \t\r\x0b\x0c", "space"),
):
    _CODE[[ord(c) for c in _chars]] = _KINDS.index(_kind)
_CODE[128:] = _KINDS.index("high")
_LINE = np.arange(256) != ord("\n")


def _repeated(texts: np.ndarray, hashes: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: how many hashes, and how many distinct ones."""
    if not len(hashes):
        return np.zeros(count), np.zeros(count)
    order = np.lexsort((hashes, texts))
    t, h = texts[order], hashes[order]
    new = np.ones(len(h), bool)
    new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
    return np.bincount(texts, minlength=count).astype(float), np.bincount(t[new], minlength=count).astype(float)


def features_of(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text; every share of an empty text is 0."""
    functions = np.sort(np.array([hash_of(w) for w in set(FUNCTION_WORDS)], np.uint64))
    out = np.zeros((len(column), len(FEATURES)), np.float32)
    for begin, end, data, offsets in slices(column):
        count = end - begin
        owner = np.repeat(np.arange(count), np.diff(offsets))
        kinds = np.bincount(owner * len(_KINDS) + _CODE[data], minlength=count * len(_KINDS))
        n = dict(zip(_KINDS, kinds.reshape(count, -1).T.astype(float), strict=True))
        texts, hashes = words(data, offsets, PLAIN)
        n_words, distinct = _repeated(texts, hashes, count)
        n_windows, new_windows = _repeated(*windows(texts, hashes, 5), count)
        n_lines, new_lines = _repeated(*words(data, offsets, _LINE), count)
        at = np.minimum(np.searchsorted(functions, hashes), len(functions) - 1)
        n_function = np.bincount(texts[functions[at] == hashes], minlength=count)
        letters = n["lower"] + n["upper"]
        size = np.diff(offsets)
        per = lambda a, b: a / np.maximum(b, 1)
        out[begin:end] = np.stack(
            [
                np.log1p(n_words), per(letters + n["high"] + n["digit"], n_words),
                per(size, n_words), per(n["upper"], letters), per(n["digit"], size),
                per(n["symbol"], n_words), per(n["bar"], n_words), per(n["bang"], n_words),
                per(n["punct"], n_words), per(n["high"], size), per(n["line"], n_words),
                per(distinct, n_words), per(n_windows - new_windows, n_windows),
                per(n_lines - new_lines, n_lines), per(n_function, n_words),
            ],
            axis=1,
        )
    return out


def featured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, features) for every row; null texts count as empty."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array(features_of(batch.column(1)).ravel())
            listed = pa.FixedSizeListArray.from_arrays(values, len(FEATURES)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), listed], names=["id", "features"])

    narrow = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(extract, f"id {kind}, features array<float>")


def _leaves(gradient: np.ndarray, weight: np.ndarray, depth: int, low: int, high: int, out: np.ndarray) -> float:
    """Fill out[low:high] with the values of a tree over ordered bins; return its gain."""
    g, w = gradient[low:high].sum(), weight[low:high].sum()
    out[low:high] = g / (w + 1.0)
    own = g * g / (w + 1.0)
    if depth == 0 or high - low < 2:
        return own
    left_g, left_w = np.cumsum(gradient[low:high])[:-1], np.cumsum(weight[low:high])[:-1]
    gains = left_g**2 / (left_w + 1.0) + (g - left_g) ** 2 / (w - left_w + 1.0)
    gains[(left_w < LEAST_WEIGHT) | (w - left_w < LEAST_WEIGHT)] = -1
    best = int(np.argmax(gains))
    if gains[best] <= own + 1e-9:
        return own
    cut = low + best + 1
    return _leaves(gradient, weight, depth - 1, low, cut, out) + _leaves(gradient, weight, depth - 1, cut, high, out)


def _grid(gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """A two-level tree over a grid: one cut on the rows, then one per side on the columns."""
    best, table = -1.0, np.zeros_like(gradient)
    for cut in range(1, gradient.shape[0]):
        trial, gain = np.zeros_like(gradient), 0.0
        for part in (slice(0, cut), slice(cut, None)):
            row = np.zeros(gradient.shape[1])
            gain += _leaves(gradient[part].sum(0), weight[part].sum(0), 1, 0, len(row), row)
            trial[part] = row
        if gain > best:
            best, table = gain, trial
    return table, best


@dataclass
class AdditiveModel:
    cuts: list[np.ndarray]
    tables: np.ndarray  # [feature, bin]
    intercept: float
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        total = np.full(len(x), self.intercept)
        for j in range(bins.shape[1]):
            total += self.tables[j][bins[:, j]]
        coarse = bins * COARSE // BINS
        for (a, b), grid in zip(self.pairs, self.grids, strict=True):
            total += grid[coarse[:, a], coarse[:, b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting with logistic loss; without two classes, the smoothed share."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    width = x.shape[1]
    cuts = [
        np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.empty(0)
        for j in range(width)
    ]
    model = AdditiveModel(cuts, np.zeros((width, BINS)), float(np.log(rate / (1 - rate))))
    if not 0 < y.sum() < len(y):
        return model
    bins = model.binned(x)
    total = np.full(len(y), model.intercept)

    def sums(cells: np.ndarray, size: int):
        p = 1 / (1 + np.exp(-total))
        return np.bincount(cells, y - p, size), np.bincount(cells, p * (1 - p), size)

    for _ in range(ROUNDS):
        for j in range(width):
            step = np.zeros(BINS)
            _leaves(*sums(bins[:, j], BINS), 2, 0, BINS, step)
            model.tables[j] += RATE * step
            total += RATE * step[bins[:, j]]
    coarse = bins * COARSE // BINS
    cells = {
        (a, b): coarse[:, a] * COARSE + coarse[:, b] for a in range(width) for b in range(a + 1, width)
    }
    shape = (COARSE, COARSE)

    def fitted(pair):
        gradient, weight = sums(cells[pair], COARSE * COARSE)
        return _grid(gradient.reshape(shape), weight.reshape(shape))

    ranked = sorted(cells, key=lambda pair: (-fitted(pair)[1], pair))[:PAIRS]
    model.pairs, model.grids = ranked, [np.zeros(shape) for _ in ranked]
    for _ in range(PAIR_ROUNDS):
        for k, pair in enumerate(ranked):
            step = fitted(pair)[0]
            model.grids[k] += RATE * step
            total += RATE * step.ravel()[cells[pair]]
    return model


def sampled(learned: DataFrame, sample_rows: int) -> DataFrame:
    """The ``sample_rows`` rows of ``learned`` (id, label) whose ids hash lowest.

    Ids above the matching quantile of the hash, with six deviations of room, are
    left out before anything is sorted, so no task hands on more than its share.
    """
    total = learned.count()
    place = F.xxhash64("id")
    if total > sample_rows:
        share = min(1.0, (sample_rows + 6 * sample_rows**0.5 + 6) / total)
        learned = learned.filter(place <= min(int(-(2**63) + share * 2**64), 2**63 - 1))
    return learned.orderBy(place, "id").limit(sample_rows)


def fit(features: DataFrame, learned: DataFrame, sample_rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """The model from (id, features) and (id, label): at most ``sample_rows`` ids.

    An id with several rows of features counts once, with the smallest.
    """
    chosen = F.broadcast(sampled(learned, sample_rows))
    rows = (
        features.join(chosen, "id")
        .groupBy("id", "label")
        .agg(F.min("features").alias("features"))
        .orderBy(F.xxhash64("id"), "id")
        .select("features", "label")
        .toArrow()
    )
    x = np.array(rows["features"].to_pylist(), np.float32).reshape(-1, len(FEATURES))
    return boost(x, rows["label"].to_numpy().astype(float))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    keep,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.5,
) -> tuple[DataFrame, AdditiveModel]:
    """(id, score, predicted) for every row, and the model.

    ``learn`` tells over ``labels`` which rows may be learned from; ``keep``
    writes a table that is read twice.  An id labelled twice counts once, with
    the larger label; null labels and ids are not learned from; of an id with
    several rows the smallest features are learned from.  Null and empty
    texts have all features 0 and are scored like any other; repeated rows are
    scored each; other columns are not read.
    """
    learned = (
        labels.filter(learn & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label_col).cast("int").alias("label"))
    )
    features = keep(featured(docs, id_col, text_col))
    model = fit(features, learned)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
        return pa.array(shared.value.scores(values))

    result = features.select(F.col("id").alias(id_col), score("features").alias("score"))
    return result.select(id_col, "score", (F.col("score") >= threshold).cast("int").alias("predicted")), model
