"""Small tables and words shared by the tests."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars int"
LABELS = "doc_id long, quality int, toxic int"


def invented(rng: random.Random, count: int) -> list[str]:
    return ["".join(rng.choice("abcdefghilmnoprstuvw") for _ in range(rng.randint(3, 8))) for _ in range(count)]


def docs(spark, rows, extra: bool = False):
    """Documents from (doc_id, text, source); ``extra`` adds columns with clashing names."""
    full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    df = spark.createDataFrame(full, DOCS).coalesce(2)
    if extra:
        for name in ("id", "key", "label", "row", "size", "words", "class", "signature", "score", "a", "b"):
            df = df.withColumn(name, df["n_chars"])
    return df


#: Rows every operator has to stand: nulls, empty and blank texts, repeats, ties.
ODD = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "one", None), (4, "one", None),
    (None, "no id at all but some words here", "b"), (5, "same words every time " * 3, "b"),
    (6, "same words every time " * 3, "c"), (7, "é ü 漢字   x", "c"), (8, "word " * 30000, "c"),
]
