"""Secret scans with built-in functions only.

Three fixed kinds are found by pattern.  Beside them every long token, whatever
its characters, is a candidate for the randomness battery:

* its encoding is inferred (decimal, hex, base32, lower-case letters, base64) and
  its characters are counted;
* it must look random: chi-squared uniformity over the alphabet, the number of
  runs above and below the middle of the alphabet, and serial correlation, none
  significant at ``LEAST_P``;
* it must not look ordinary: ordinary tokens repeat characters more often, so
  the count of equal character pairs gives a p-value for "ordinary".  These
  p-values go through false-discovery control (Benjamini-Hochberg) within strata
  of encoding and length, over all documents, from a histogram of fixed size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitus.llm.columns import let

# The three patterns, in the order in which kinds are listed.
ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST = 6

_TOKEN = "A-Za-z0-9+/_=-"
#: Maximal runs of 20 or more characters, two of them other than the padding ``=``.
TOKEN = rf"(?<![{_TOKEN}])(?==*[A-Za-z0-9+/_-]=*[A-Za-z0-9+/_-])[{_TOKEN}]{{20,}}"

#: Encodings: alphabet, and how often two characters of an ordinary token of that
#: look (numbers, dates, identifiers, words) are equal.
ENCODINGS = {
    "decimal": ("0123456789", 0.20),
    "hex": ("0123456789abcdef", 0.15),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.10),
    "lower": ("abcdefghijklmnopqrstuvwxyz", 0.065),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.065),
}
BANDS = (24, 32, 48, 64)
LEAST_P = 0.001
FALSE_SHARE = 0.01
#: Steps per unit of -log10 p, and the largest value kept apart.
STEPS, TOP = 10, 400

SPAN = "struct<start:int,rank:int,end:int>"


def spans(text: Column, pattern: str, rank: int, second: int = 0) -> Column:
    """Code point spans of all matches, leftmost first, never overlapping.

    The text between matches and the matches themselves alternate, so running
    lengths give the places.  With ``second``, matches whose second group has
    fewer characters are consumed but not returned.
    """
    none = F.array().cast(f"array<{SPAN}>")

    def placed(between: Column, found: Column, groups: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))

        def step(acc: Column, k: Column) -> Column:
            begin = acc["at"] + F.length(F.get(between, k))
            end = begin + F.length(F.get(found, k))
            span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"))
            good = F.length(F.get(groups, k)) >= second
            return F.struct(
                end.alias("at"),
                F.when(good, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"),
            )

        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda acc: acc["out"])

    all_of = lambda group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.when(
        text.rlike(pattern),
        let(
            F.struct(
                F.split(text, pattern, -1).alias("between"),
                all_of(0).alias("found"),
                (all_of(2) if second else all_of(0)).alias("groups"),
            ),
            lambda x: placed(x["between"], x["found"], x["groups"]),
        ),
    ).otherwise(none)


def upper_tail(x: Column) -> Column:
    """P(normal > x) for x >= 0: a polynomial near 0, a continued fraction beyond 3."""
    density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    t = 1 / (1 + 0.2316419 * x)
    near = density * t * (
        0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))
    )
    far = density / (x + 1 / (x + 2 / (x + 3 / (x + 4 / (x + 5)))))
    return F.when(x < 3, near).otherwise(far)


def battery(token: Column) -> Column:
    """struct(encoding, band, level, random) of one candidate.

    ``level`` is -log10 of the p-value for "ordinary", in steps; ``random`` tells
    whether no randomness test objects.
    """

    def tests(body: Column, encoding: Column) -> Column:
        per = lambda k: F.element_at(
            F.create_map(*(x for e, v in ENCODINGS.items() for x in (F.lit(e), F.lit(v[k])))), encoding
        )
        alphabet, ordinary = per(0), per(1)
        n = F.length(body).cast("double")
        width = F.length(alphabet).cast("double")
        values = F.transform(F.split(body, "(?!^)(?!$)"), lambda c: F.position(c, alphabet))

        def measured(v: Column) -> Column:
            add = lambda acc, x: acc + x
            zero = F.lit(0.0)
            squares = F.aggregate(
                F.array_distinct(v), zero,
                lambda acc, x: acc + F.pow(F.size(v) - F.size(F.array_remove(v, x)), F.lit(2.0)),
            )
            high = F.aggregate(F.transform(v, lambda x: (x * 2 > width).cast("double")), zero, add)
            turns = F.aggregate(
                F.transform(
                    v, lambda x, i: F.when(i > 0, ((x * 2 > width) != (F.get(v, i - 1) * 2 > width)).cast("double")).otherwise(0.0)
                ),
                zero, add,
            )
            mean = F.aggregate(v, zero, lambda acc, x: acc + x) / n
            around = lambda x: x - mean
            spread = F.aggregate(v, zero, lambda acc, x: acc + around(x) * around(x))
            lagged = F.aggregate(
                F.transform(v, lambda x, i: F.when(i > 0, around(x) * around(F.get(v, i - 1))).otherwise(0.0)), zero, add
            )
            return F.struct(
                squares.alias("squares"), high.alias("high"), (turns + 1).alias("runs"),
                spread.alias("spread"), lagged.alias("lagged"),
            )

        def judged(m: Column) -> Column:
            chi = width / n * m["squares"] - n
            uniform = (chi - (width - 1)) / F.sqrt(2 * (width - 1))
            low = n - m["high"]
            expected = 2 * m["high"] * low / n + 1
            variance = (expected - 1) * (expected - 2) / (n - 1)
            runs = F.when(variance > 0, F.abs(m["runs"] - expected) / F.sqrt(variance)).otherwise(99.0)
            serial = F.when(m["spread"] > 0, F.abs(m["lagged"] / m["spread"]) * F.sqrt(n)).otherwise(99.0)
            worst = F.greatest(uniform, runs, serial, F.lit(0.0))
            pairs = n * (n - 1) * ordinary
            distance = (m["squares"] - n - pairs) / F.sqrt(2 * pairs * (1 - ordinary))
            level = F.when(
                distance < 0, -F.log10(F.greatest(upper_tail(-distance), F.lit(1e-39)))
            ).otherwise(0.0)
            band = sum((n >= b).cast("int") for b in BANDS)
            return F.struct(
                encoding.alias("encoding"),
                band.alias("band"),
                F.least(F.floor(level * STEPS), F.lit(TOP)).cast("int").alias("level"),
                (6 * upper_tail(worst) >= LEAST_P).alias("random"),
            )

        return let(values, lambda v: let(measured(v), judged))

    stripped = F.regexp_replace(token, "=+$", "")
    kind = (
        F.when(stripped.rlike(r"^[0-9]+$"), F.lit("decimal"))
        .when(stripped.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lit("hex"))
        .when(stripped.rlike(r"^[A-Z2-7]+$"), F.lit("base32"))
        .when(stripped.rlike(r"^[a-z]+$"), F.lit("lower"))
        .otherwise(F.lit("base64"))
    )
    shaped = let(
        F.struct(stripped.alias("body"), kind.alias("kind")),
        lambda x: F.struct(
            x["kind"].alias("kind"),
            F.when(x["kind"] == "hex", F.lower(x["body"]))
            .otherwise(F.translate(x["body"], "-_=", "+/"))
            .alias("body"),
        ),
    )
    return let(shaped, lambda x: tests(x["body"], x["kind"]))


def scanned(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with __base (spans of the three kinds) and __candidates (tested tokens)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = F.array_sort(
        F.concat(
            spans(text, ASSIGN, 0, ASSIGN_LEAST),
            spans(text, ACCESS, 1),
            spans(text, HEX, 2),
        )
    )
    with_base = docs.withColumn("__base", base).withColumn("__tokens", spans(text, TOKEN, 3))
    free = F.filter(
        "__tokens",
        lambda t: ~F.exists("__base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])),
    )
    tested = F.transform(
        free,
        lambda t: F.struct(
            t.alias("span"), battery(F.substring(text, t["start"] + 1, t["end"] - t["start"])).alias("test")
        ),
    )
    return with_base.withColumn("__candidates", tested).drop("__tokens")


def discovery_levels(candidates: DataFrame) -> dict[tuple[str, int], int]:
    """Lowest level accepted per (encoding, band), from a column ``__candidates``."""
    counts = (
        candidates.select(F.explode("__candidates.test").alias("t"))
        .groupBy("t.encoding", "t.band", "t.level")
        .count()
        .collect()
    )
    strata: dict[tuple[str, int], dict[int, int]] = {}
    for encoding, band, level, count in counts:
        strata.setdefault((encoding, band), {})[level] = count
    accepted = {}
    for stratum, by_level in strata.items():
        total, above = sum(by_level.values()), 0
        for level in sorted(by_level, reverse=True):
            above += by_level[level]
            if 10 ** (-level / STEPS) * total <= FALSE_SHARE * above:
                accepted[stratum] = level
    return accepted


def accepted_spans(levels: dict[tuple[str, int], int]) -> Column:
    """Spans of the candidates that the battery and the false-discovery control accept."""
    if not levels:
        return F.array().cast(f"array<{SPAN}>")
    table = F.create_map(*(F.lit(x) for (e, b), v in sorted(levels.items()) for x in (f"{e}:{b}", v)))
    good = F.filter(
        "__candidates",
        lambda c: c["test"]["random"]
        & F.coalesce(
            c["test"]["level"] >= F.element_at(table, F.concat_ws(":", c["test"]["encoding"], c["test"]["band"].cast("string"))),
            F.lit(False),
        ),
    )
    return F.transform(good, lambda c: c["span"])


def listed(spans_: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(
            spans_,
            lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def secret_scan(docs: DataFrame, keep, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts of the three kinds, digest of their spans, and all spans.

    ``keep`` writes the short table of spans and candidates, which is read once
    for the false-discovery control and once for the result.  Null texts count
    as empty; a text without secrets has empty lists; repeated rows are scanned
    each; candidates that overlap a span of the three kinds are left out; other
    columns are not carried.
    """
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    found = keep(scanned(source, "__text").select("__id", "__base", "__candidates"))
    levels = discovery_levels(found)
    number = lambda rank: F.size(F.filter("__base", lambda s: s["rank"] == rank)).cast("long")
    both = F.array_sort(F.concat("__base", accepted_spans(levels)))
    return found.select(
        F.col("__id").alias(id_col),
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(listed(F.col("__base")), 256).alias("base_sha256"),
        listed(both).alias("spans"),
    )


def masked(text: Column, spans_: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones together, replaced by ``mask``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        before = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], before, F.lit(mask))).otherwise(acc["out"]).alias("out"),
        )

    done = F.aggregate(spans_, start, step)
    return F.when(F.size(spans_) == 0, text).otherwise(
        let(done, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text))))
    )


def mask_secrets(docs: DataFrame, keep, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """All rows and columns of ``docs``, secrets in the text replaced by ``mask``.

    Null texts stay null.
    """
    levels = discovery_levels(keep(scanned(docs.select(text_col), text_col).select("__candidates")))
    found = scanned(docs, text_col)
    both = F.array_sort(F.concat("__base", accepted_spans(levels)))
    text = masked(F.col(text_col), both, mask)
    return found.withColumn(text_col, text).select(*docs.columns)
