"""Regular expressions, written once and compiled for Java.

Patterns across the library are written in ECMAScript notation because the
conventions they encode were specified that way.  ``java`` turns one into the
form ``rlike`` / ``regexp_*`` need so that both notations agree:

* ``\\s`` in Java is ASCII only, ECMAScript also counts the Unicode spaces;
* ``\\b`` in Java treats accented letters as word characters, ECMAScript only
  ASCII ones;
* ``$`` without the multi-line flag matches before a final newline in Java.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ECMAScript white-space set.
SPACE_CLASS = (
    r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
)
SPACE_CHARS = "\t\n\x0b\f\r \u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
)
# The same set without the newline, for tests that must stay on one line.
INLINE_SPACE_CLASS = SPACE_CLASS.replace(r"\n", "")
WORD_EDGE = (
    r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
)
# Cheaper halves for an edge whose inner side is known to be a word character.
WORD_START = r"(?<![A-Za-z0-9_])"
WORD_END = r"(?![A-Za-z0-9_])"
ANY_CHAR = r"[\s\S]"
# Texts of Latin, Greek or Cyrillic letters hold none of these: no wide space, no
# full-width mark, no ideograph.  One range, so a search costs little.
WIDE_RANGE = r"\x{1680}-\x{10FFFF}"


def _closing(pattern: str, at: int) -> int:
    """Index of the parenthesis that closes the one at ``at``, or -1."""
    depth, in_class, i = 0, False, at
    while i < len(pattern):
        char = pattern[i]
        if char == "\\":
            i += 1
        elif char in "[]":
            in_class = char == "["
        elif not in_class and char in "()":
            depth += 1 if char == "(" else -1
            if depth == 0:
                return i
        i += 1
    return -1


def _plain_words(group: str) -> list[str] | None:
    """Alternatives of a flat group of literal text, else None."""
    body = group.removeprefix("?:")
    return None if any(c in "()[]*?{\\" for c in body) else body.split("|")


def _is_word(char: str) -> bool:
    return char == "_" or (char.isascii() and char.isalnum())


def _word_edge(pattern: str, at: int) -> str:
    """Java form of the ``\\b`` at ``at``: one look-around where one side is certain.

    Before a group of literal words the possible first letters are tested first,
    so most positions of a text are rejected by a single character class.
    """
    after = pattern[at + 2 :]
    if after[:1] == "(" and (end := _closing(after, 0)) > 0:
        words = _plain_words(after[1:end])
        if words and all(w and _is_word(w[0]) for w in words):
            return f"(?=[{''.join(sorted({w[0] for w in words}))}])" + WORD_START
    if after[:1] and _is_word(after[0]) and after[1:2] not in ("?", "*", "{"):
        return f"(?={after[0]})" + WORD_START
    before = pattern[:at]
    if before and _is_word(before[-1]) and before[-2:-1] != "\\":
        return WORD_END
    if before.endswith(")"):
        for start in range(len(before) - 1, -1, -1):
            if before[start] == "(" and _closing(before, start) == len(before) - 1:
                words = _plain_words(before[start + 1 : -1])
                if words and all(w and _is_word(w[-1]) for w in words):
                    return WORD_END
                break
    return WORD_EDGE


def java(pattern: str, flags: str = "", inline: bool = False) -> str:
    """Compile an ECMAScript pattern for Java; ``inline`` keeps ``\\s`` on one line."""
    space = INLINE_SPACE_CLASS if inline else SPACE_CLASS
    multiline = "m" in flags
    out: list[str] = []
    in_class = False
    i = 0
    while i < len(pattern):
        if not in_class and pattern.startswith(ANY_CHAR, i):
            out.append(r"(?s:.)")
            i += len(ANY_CHAR)
            continue
        char = pattern[i]
        if char == "\\" and i + 1 < len(pattern):
            pair = pattern[i : i + 2]
            if pair == r"\s":
                out.append(space if in_class else f"[{space}]")
            elif pair == r"\S":
                out.append(f"[^{space}]")
            elif pair == r"\b" and not in_class:
                out.append(_word_edge(pattern, i))
            else:
                out.append(pair)
            i += 2
            continue
        if char == "[" and not in_class:
            in_class = True
            out.append("[")
            # a second bracket inside a class needs an escape in Java
        elif char == "[" and in_class:
            out.append(r"\[")
        elif char == "]" and in_class:
            in_class = False
            out.append("]")
        elif char == "$" and not in_class and not multiline:
            out.append(r"\z")
        else:
            out.append(char)
        i += 1
    mode = "".join(f for f in flags if f in "im")
    return (f"(?{mode})" if mode else "") + "".join(out)


class _Literals:
    """Reads a pattern once, for text that its matches must contain."""

    ZERO_WIDTH = "bB"
    #: More ways than this are not told apart.
    MOST = 12

    def __init__(self, pattern: str) -> None:
        self.pattern, self.at = pattern, 0

    def alternatives(self) -> set[frozenset[str]]:
        """Every match of what starts here contains all texts of one of these sets."""
        found = self.sequence()
        while self.pattern.startswith("|", self.at):
            self.at += 1
            found = found | self.sequence()
        return found

    def sequence(self) -> set[frozenset[str]]:
        ways: set[frozenset[str]] = {frozenset()}
        run = ""

        def closed() -> set[frozenset[str]]:
            return {w | {run} for w in ways} if run else ways

        while self.at < len(self.pattern) and self.pattern[self.at] not in "|)":
            text, inner, width = self.item()
            least, most = self.repeat()
            if width == 0:
                continue
            if text and least:
                run += text
                if most == 1:
                    continue
            ways, run = closed(), ""
            if inner and least and len(ways) * len(inner) <= self.MOST:
                ways = {w | i for w in ways for i in inner}
        return closed()

    def item(self) -> tuple[str, set[frozenset[str]] | None, int]:
        """(literal character, what a group needs, 0 if nothing is consumed)."""
        char = self.pattern[self.at]
        if char == "(":
            end = _closing(self.pattern, self.at)
            ahead = self.pattern.startswith(("(?=", "(?!", "(?<"), self.at)
            if ahead:
                self.at = end + 1
                return "", None, 0
            self.at += 3 if self.pattern.startswith("(?:", self.at) else 1
            inner = self.alternatives()
            self.at = end + 1
            return "", inner, 1
        if char == "[":
            at = self.at + 1
            while self.pattern[at] != "]":
                at += 2 if self.pattern[at] == "\\" else 1
            self.at = at + 1
            return "", None, 1
        if char == "\\":
            code = self.pattern[self.at + 1]
            self.at += 2
            if code.isalnum():
                return "", None, int(code not in self.ZERO_WIDTH)
            return code, None, 1
        self.at += 1
        if char in "^$":
            return "", None, 0
        return ("", None, 1) if char == "." else (char, None, 1)

    def repeat(self) -> tuple[int, int | None]:
        """How often the item before stands here, at least and at most."""
        char = self.pattern[self.at : self.at + 1]
        if char not in ("?", "*", "+", "{"):
            return 1, 1
        if char == "{":
            self.at = self.pattern.index("}", self.at) + 1
            least, most = 0, None
        else:
            self.at += 1
            least, most = int(char == "+"), 1 if char == "?" else None
        if self.pattern.startswith("?", self.at):
            self.at += 1
        return least, most


def _shortened(way: frozenset[str]) -> frozenset[str]:
    """Without texts that are part of another text of the set."""
    return frozenset(x for x in way if not any(x != y and x in y for y in way))


def required_literals(pattern: str, flags: str = "") -> list[tuple[str, ...]]:
    """Sets of texts; every match of ``pattern`` contains all texts of one of them.

    A search for a few bytes spares most texts the regular expression.  A set
    that another one follows from is left out; [] if nothing is known.  Patterns
    that ignore case give lower-case texts, for a lower-cased column.
    """
    ways = _Literals(pattern).alternatives()
    if "i" in flags:
        ways = {frozenset(x.lower() for x in w) for w in ways}
    ways = {_shortened(w) for w in ways}
    if frozenset() in ways:
        return []
    implied = lambda w, v: all(any(x in y for y in w) for x in v)
    kept = [w for w in ways if not any(v != w and implied(w, v) for v in ways)]
    return sorted(tuple(sorted(w, key=lambda x: (-len(x), x))) for w in kept)


def contains_any(column: Column, ways: list[tuple[str, ...]]) -> Column:
    """The column holds all texts of one of the sets."""
    found = None
    for texts in ways:
        every = F.contains(column, F.lit(texts[0]))
        for text in texts[1:]:
            every = every & F.contains(column, F.lit(text))
        found = every if found is None else found | every
    return found


def plain_words(pattern: str) -> list[str] | None:
    """Alternatives of a flat pattern of literal texts, else None."""
    if r"\|" in pattern or any(c in "\\.^$*+?()[]{}" for c in re.sub(r"\\[^A-Za-z0-9]", "", pattern)):
        return None
    return [re.sub(r"\\(.)", r"\1", word) for word in pattern.split("|")]


def mentions(column: Column, pattern: str) -> Column:
    """``test`` for patterns without anchors; literal texts are found by byte searches alone."""
    words = plain_words(pattern)
    return contains_any(column, [(w,) for w in words]) if words else guarded_test(column, pattern)


def is_ascii(column: Column) -> Column:
    return F.octet_length(column) == F.length(column)


def ascii_lower(column: Column) -> Column:
    """The letters A-Z in lower case and no others: what a pattern that ignores case compares."""
    return F.when(is_ascii(column), F.lower(column)).otherwise(
        F.translate(column, ascii_uppercase, ascii_lowercase)
    )


def guarded_test(
    column: Column, pattern: str, flags: str = "", lowered: Column | None = None
) -> Column:
    """``test``, run only on texts that hold what every match must contain.

    Patterns that ignore case are guarded where the ``lowered`` column is at hand.
    """
    place = lowered if "i" in flags else column
    needed = required_literals(pattern, flags) if place is not None else []
    found = test(column, pattern, flags)
    return contains_any(place, needed) & found if needed else found


def worded(column: Column, lowered: Column, pattern: str) -> Column:
    """``test`` in any case, run only on texts that hold a word the pattern needs.

    ``lowered`` is the column in lower case.  Words beyond ASCII are looked for
    only in texts that are not plain ASCII.
    """
    needed = required_literals(pattern, "i")
    plain = [w for w in needed if all(map(str.isascii, w))]
    wide = [w for w in needed if w not in plain]
    holds = contains_any(lowered, plain) if plain else F.lit(False)
    if wide:
        holds = holds | (~is_ascii(lowered) & contains_any(lowered, wide))
    found = test(column, pattern, "i")
    return holds & found if needed else found


def test(column: Column, pattern: str, flags: str = "", inline: bool = False) -> Column:
    """True where the pattern occurs anywhere in the column."""
    return column.rlike(java(pattern, flags, inline))


def replace(column: Column, pattern: str, by: str, flags: str = "") -> Column:
    """Replace every match; ``by`` may use ``$1``."""
    return F.regexp_replace(column, java(pattern, flags), by)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside one expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def replace_where(
    column: Column, needed: tuple[str, ...], pattern: str, by: str, flags: str = ""
) -> Column:
    """``replace``, run only on texts that hold one of the ``needed`` literals.

    Every match must contain one of them; the search for them is a plain byte
    comparison, many times cheaper than the pattern.
    """

    def guarded(text: Column) -> Column:
        present = F.contains(text, F.lit(needed[0]))
        for literal in needed[1:]:
            present = present | F.contains(text, F.lit(literal))
        return F.when(present, replace(text, pattern, by, flags)).otherwise(text)

    return let(column, guarded)


def extract_all(column: Column, pattern: str, group: int, flags: str = "") -> Column:
    return F.regexp_extract_all(column, F.lit(java(pattern, flags)), F.lit(group))


def extract(column: Column, pattern: str, group: int, flags: str = "") -> Column:
    """First match's group, null (not '') when the pattern does not occur."""
    return F.when(
        column.rlike(java(pattern, flags)),
        F.regexp_extract(column, java(pattern, flags), group),
    )


def trim(column: Column) -> Column:
    """Strip Unicode white space from both ends, on bytes."""
    return F.btrim(column, F.lit(SPACE_CHARS))


def trim_start(column: Column) -> Column:
    return F.ltrim(column, F.lit(SPACE_CHARS))


def trim_end(column: Column) -> Column:
    return F.rtrim(column, F.lit(SPACE_CHARS))


def squeeze(column: Column) -> Column:
    """Collapse runs of white space to one space.

    Most texts have single plain spaces only; searches for single characters tell,
    for the spaces beyond Latin only where a text has such characters at all.
    """
    wide = SPACE_CLASS[SPACE_CLASS.index(r"\u1680"):]

    def guarded(text: Column) -> Column:
        uneven = (
            F.contains(text, F.lit("  "))
            | text.rlike(r"[\t\n\x0B\f\r\xA0]")
            | (text.rlike(f"[{WIDE_RANGE}]") & text.rlike(f"[{wide}]"))
        )
        return F.when(uneven, replace(text, r"\s+", " ")).otherwise(text)

    return let(column, guarded)


def unless_plain(column: Column, marks: str, change: Callable[[Column], Column], first: str = "") -> Column:
    """``change`` of texts that may need it, the others without spaces at their ends.

    A text is plain when it holds none of ``marks``, no white space but single
    spaces, nothing beyond Latin, Greek and Cyrillic letters, and does not start
    with a character of ``first``.  ``change`` must do no more than trim such texts.
    """
    special = "".join("\\" + c for c in marks) + r"\t\n\x0B\f\r\xA0" + WIDE_RANGE

    def guarded(text: Column) -> Column:
        bare = F.trim(text)
        plain = ~text.rlike(f"[{special}]") & ~F.contains(text, F.lit("  "))
        if first:
            plain = plain & ~F.left(bare, F.lit(1)).isin(*first)
        return F.when(plain, bare).otherwise(change(text))

    return let(column, guarded)


def replace_at(column: Column, first: str, pattern: str, by: str, flags: str = "") -> Column:
    """``replace`` for patterns anchored at the start, run only where the text
    starts with one of the characters in ``first``."""
    return let(
        column,
        lambda text: F.when(
            F.left(text, F.lit(1)).isin(*first), replace(text, pattern, by, flags)
        ).otherwise(text),
    )
