"""URL filters by host suffix and path prefix, looked up by short hashes.

A rule is a host, a path and a verdict.  It fits a URL whose host is the rule's
or ends with a dot and the rule's, and whose path starts with the rule's path.
Its expression is host and path in one string.

1. Rules have shapes: the number of labels of the host and the length of the
   path.  A URL can only be hit by expressions of those shapes, so it is expanded
   into one host suffix and path prefix for every shape that fits into it.
2. Expressions are hashed with SHA-256.  A bitmap of fixed size over the rules'
   32-bit hash prefixes lets few of the others through.
3. What is left joins the rules by hash prefix; the whole digest confirms it.
4. The longest expression wins, then the longer host; of equal rules the greater
   verdict (block before allow) holds.

Nulls and other odd rows: a URL that is null or without ``://`` has an empty host
and path; only a rule with an empty host fits it.  Rules without host or verdict
are left out, a null path is empty.  Repeated pages are judged one by one; an
empty table of pages gives no rows, an empty table of rules the default for all.
Other columns of the pages are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitus.llm.hot import hot_keys, join_hot
from habitus.llm.membership import bitmap, maybe_in

RULE = "host string, path string, verdict string"


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first ``://`` to ``/``, ``?`` or ``#``, then to ``?`` or ``#``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return lowered(host), path


def labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."))) + 1


def short(digest: Column) -> Column:
    """The first 32 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def rule_table(rules: DataFrame) -> DataFrame:
    """(key, digest, host, path, verdict, n_labels, n_path), one row an expression."""
    return (
        rules.select(lowered("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .filter("host is not null and verdict is not null")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("digest", F.sha2(F.concat("host", "path"), 256))
        .withColumn("key", short(F.col("digest")))
        .withColumn("n_labels", labels(F.col("host")))
        .withColumn("n_path", F.length("path"))
    )


def expressions(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Digests of the host suffixes and path prefixes of every shape that fits."""
    if not shapes:
        return F.array().cast("array<string>")
    known = F.array(*(F.struct(F.lit(n).alias("labels"), F.lit(p).alias("path")) for n, p in shapes))
    fitting = F.filter(known, lambda s: (s["labels"] <= labels(host)) & (s["path"] <= F.length(path)))
    return F.transform(
        fitting,
        lambda s: F.sha2(
            F.concat(
                F.call_function("substring_index", host, F.lit("."), -s["labels"]),
                F.substring(path, F.lit(1), s["path"]),
            ),
            256,
        ),
    )


def url_verdicts(
    pages: DataFrame, rules: DataFrame, keep, default: str = "allow", id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """(id, host, path, rule, verdict) of every page.

    ``rule`` is the expression that decides, null where none fits and ``default``
    holds.  The shapes of the rules are held by the driver: pairs of a number of
    labels and a length, however many rules there are.
    """
    known = keep(rule_table(rules), "rules")
    shapes = sorted((r["n_labels"], r["n_path"]) for r in known.select("n_labels", "n_path").distinct().collect())
    host, path = url_parts(F.col(url_col).cast("string"))
    rows = keep(
        pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "pages",
    )
    found = rows.select(
        "row", F.explode(expressions(F.col("host"), F.col("path"), shapes)).alias("digest")
    ).withColumn("key", short(F.col("digest")))
    found = keep(found.filter(maybe_in(found, bitmap(known, "key"), "key")), "found")
    hot = hot_keys(found.groupBy("key").count(), "count", keep)
    rule = known.select("key", F.col("digest").alias("rule_digest"), "host", "path", "verdict")
    hits = join_hot(found, rule, ["key"], hot, "inner").filter("digest = rule_digest")
    best = hits.groupBy("row").agg(
        F.max(
            F.struct(
                (F.length("host") + F.length("path")).alias("length"), F.length("host").alias("of_host"),
                F.concat("host", "path").alias("rule"), "verdict",
            )
        ).alias("best")
    )
    return rows.join(best, "row", "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
