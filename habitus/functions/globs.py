"""Glob patterns as regular expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from habitus.functions import patterns as rx

_DOUBLE_STAR = "\x01"


def glob_regex(pattern: str) -> str:
    """One glob as a regex body: ``**`` (with an optional slash) is any text,
    ``*`` any text without a slash, ``?`` one character that is no slash."""
    text = pattern.replace("\\", "/")
    text = re.sub(r"[.+^${}()|\[\]]", lambda m: "\\" + m.group(0), text)
    text = re.sub(r"\*\*/?", _DOUBLE_STAR, text).replace("*", "[^/]*")
    return text.replace(_DOUBLE_STAR, ".*").replace("?", "[^/]")


def any_glob_regex(globs: Iterable[str]) -> str:
    """All globs as one alternation."""
    return "(?:" + "|".join(glob_regex(g) for g in globs) + ")"


def match_globs(path: Column, globs: Iterable[str]) -> Column:
    """The whole path matches one of the globs."""
    globs = list(globs)
    if not globs:
        return F.lit(False)
    return F.replace(path, F.lit("\\"), F.lit("/")).rlike(
        rf"^{any_glob_regex(globs)}\z"
    )


def prunes_path(path: Column, alternation: Column) -> Column:
    """The path or one of its directories matches the alternation."""
    return F.regexp_like(
        path, F.concat(F.lit("^"), alternation, F.lit(r"(?:/|\z)"))
    )


def match_globs_or_ancestor(path: Column, globs: Iterable[str]) -> Column:
    globs = list(globs)
    if not globs:
        return F.lit(False)
    return path.rlike(rf"^{any_glob_regex(globs)}(?:/|\z)")


def gitignore_globs(content: Column) -> Column:
    """The globs an ignore file stands for, as an array."""
    lines = F.transform(F.split(content, "\n"), rx.trim)
    kept = F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("#")))

    def to_glob(line: Column) -> Column:
        line = F.regexp_replace(line, "^/", "")
        line = F.regexp_replace(line, r"/\z", "/**")
        bare = ~F.contains(line, F.lit("*")) & ~F.contains(line, F.lit("/"))
        return (
            F.when(bare, F.concat(F.lit("**/"), line, F.lit("/**")))
            .when(F.startswith(line, F.lit("**")), line)
            .otherwise(F.concat(F.lit("**/"), line))
        )

    return F.transform(kept, to_glob)


def globs_alternation(globs: Column) -> Column:
    """An array of globs as one regex alternation, null when it is empty."""

    def to_regex(glob: Column) -> Column:
        text = F.replace(glob, F.lit("\\"), F.lit("/"))
        text = F.regexp_replace(text, r"([.+^${}()|\[\]])", r"\\$1")
        text = F.regexp_replace(text, r"\*\*/?", _DOUBLE_STAR)
        text = F.replace(text, F.lit("*"), F.lit("[^/]*"))
        text = F.replace(text, F.lit(_DOUBLE_STAR), F.lit(".*"))
        return F.replace(text, F.lit("?"), F.lit("[^/]"))

    joined = F.array_join(F.transform(globs, to_regex), "|")
    return F.when(
        F.size(globs) > 0, F.concat(F.lit("(?:"), joined, F.lit(")"))
    )
