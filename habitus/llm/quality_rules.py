"""Quality rules: a threshold table compiled into one projection, built-ins only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitus.llm.columns import let, spaced_words, window_hashes

SYMBOLS = "#*$%&|<>"
WINDOW = 5

# Frequent function words of four languages.
STOP_WORDS = (
    "the of and to in is that it for was on as with be by at this from or an are not "
    "le la les de des du un une et est en que qui dans pour pas sur au avec par il elle "
    "der die das und ist von zu den mit im nicht ein eine auf dem sich des es als auch an "
    "el los las y del se por con para su al lo como más o pero sus"
).split()


@dataclass(frozen=True)
class Rule:
    """A ratio of two measures that must stay within [low, high].

    ``least`` is the size of the denominator from which the rule speaks: ratios
    of very short texts say little.
    """

    name: str
    over: str
    under: str
    low: float | None = None
    high: float | None = None
    least: int = 1


#: The production table.
RULES = (
    Rule("word_length", "word_chars", "n_words", low=1.5, high=15.0, least=10),
    Rule("symbols", "n_symbols", "n_words", high=0.25, least=10),
    Rule("stop_words", "n_stop", "n_words", low=0.01, least=50),
    Rule("upper_case", "n_upper", "word_chars", high=0.5, least=50),
    Rule("exclaimed", "n_exclaimed", "n_words", high=0.6, least=10),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.5, least=4),
    Rule("bullet_lines", "n_bullets", "n_lines", high=0.9, least=4),
    Rule("cut_lines", "n_cut_lines", "n_lines", high=0.5, least=4),
)


def repeated_words(windows: Column) -> Column:
    """How many words lie in a window of five that occurs twice or more in the text.

    ``windows`` are the 64-bit hashes of a text's windows in order.  Sorting them
    with their places brings equal ones together; only texts that have equal
    windows are sorted.
    """

    def covered(places: Column) -> Column:
        return F.aggregate(
            F.transform(
                places,
                lambda p, k: F.coalesce(
                    F.least(F.get(places, k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)
                ),
            ),
            F.lit(0),
            lambda total, n: total + n,
        )

    def places(ordered: Column) -> Column:
        equal = lambda k, x: F.coalesce(F.get(ordered, k)["w"] == x["w"], F.lit(False))
        marked = F.transform(
            ordered, lambda x, k: F.when(equal(k - 1, x) | equal(k + 1, x), x["i"])
        )
        return F.array_sort(F.array_compact(marked))

    placed = F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
        let(F.array_sort(placed), lambda ordered: let(places(ordered), covered))
    )


def count_of(text: Column, characters: str) -> Column:
    """How many characters of ``text`` belong to a pattern class."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", ""))


def measured(source: DataFrame) -> DataFrame:
    """Every measure a rule may use, for columns ``id`` and ``text`` (no nulls)."""
    text, words, lines = F.col("text"), F.col("words"), F.col("lines")
    cut = source.select(
        "id",
        spaced_words(text).alias("words"),
        F.filter(
            F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")
        ).alias("lines"),
        count_of(text, SYMBOLS).alias("n_symbols"),
        count_of(text, "A-Z").alias("n_upper"),
        count_of(text, "!").alias("n_exclaimed"),
    )
    hashed = cut.select(
        "id",
        "n_symbols",
        "n_upper",
        "n_exclaimed",
        F.size(words).alias("n_words"),
        F.length(F.array_join(words, "")).alias("word_chars"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).alias("n_stop"),
        F.size(lines).alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-*•]\s"))).alias("n_bullets"),
        F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).alias("n_cut_lines"),
        window_hashes(F.transform(words, lambda w: F.xxhash64(w)), WINDOW).alias("windows"),
    )
    return hashed.withColumn("n_repeat_words", repeated_words(F.col("windows"))).drop("windows")


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules a row breaks, from its measure columns."""
    broken = []
    for rule in rules:
        ratio = F.col(rule.over) / F.when(F.col(rule.under) >= rule.least, F.col(rule.under))
        outside = F.lit(False)
        if rule.low is not None:
            outside = outside | (ratio < rule.low)
        if rule.high is not None:
            outside = outside | (ratio > rule.high)
        broken.append(F.when(F.coalesce(outside, F.lit(False)), F.lit(rule.name)))
    return F.array_compact(F.array(*broken))


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """One row per document: measures, base verdict, broken rules, ``kept``.

    One scan, no shuffle, no user function.  Null texts count as empty; an empty
    text has no words and fails the base rule; repeated rows are judged each; a
    null id stays null; other columns are not carried, so none can clash.
    """
    source = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    flat = measured(source)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = flat.withColumn("base_failed", base).withColumn("broken", verdict(rules))
    longs = [c for c in flat.columns if c != "id"]
    return judged.select(
        F.col("id").alias(id_col),
        *(F.col(c).cast("long").alias(c) for c in longs),
        "base_failed",
        (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"),
        "broken",
    )
