"""Token counts per text: batched encoding inside Arrow functions, lengths only."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 1 << 20
#: About how many bytes of pieces a worker keeps, what a piece costs besides its
#: characters, and the longest piece that is kept beyond its batch.
KEPT_BYTES, ENTRY_BYTES, LONGEST_KEPT = 96 << 20, 128, 64

#: A single space between two non-space characters.  Pre-tokenizers that keep
#: white space in front of a word start a new piece there, whatever stands
#: before; no special token holds a space.
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space that is no safe cut, so that plain splitting at spaces will not do.
OTHER_SPACE = re.compile(r"^\s|\s\s|\s$")

_LOADED: dict[str, object] = {}


def load(path: str):
    """(encode function giving lengths) for a ``.json`` or ``.model`` file, once per worker."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _LOADED[path] = lambda texts: [
                len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            ]
    return _LOADED[path]


def pieces(text: str) -> list[str]:
    """The text cut at every safe place, without the spaces at the cuts."""
    return SAFE_CUT.split(text) if OTHER_SPACE.search(text) else text.split(" ")


class Lengths:
    """Token counts of pieces; each distinct piece is encoded once while it is kept.

    ``heads`` are pieces at the start of a text, ``rest`` pieces after a cut,
    which carry its space.  Both are emptied when they hold about ``KEPT_BYTES``;
    pieces over ``LONGEST_KEPT`` characters, as texts without spaces give, are
    forgotten with their batch.
    """

    def __init__(self, encode, batch_bytes: int):
        self.encode, self.batch_bytes = encode, batch_bytes
        self.heads: dict[str, int] = {}
        self.rest: dict[str, int] = {}
        self.held = 0

    def learn(self, known: dict[str, int], wanted: set[str], prefix: str) -> None:
        """Encode the missing pieces in batches of about equal bytes."""
        batch: list[str] = []
        held = 0

        def flush():
            known.update(zip(batch, self.encode([prefix + x for x in batch]), strict=True))
            batch.clear()

        for piece in wanted - known.keys():
            batch.append(piece)
            held += len(piece) + 16
            if held >= self.batch_bytes:
                flush()
                held = 0
        if batch:
            flush()

    def forget(self, known: dict[str, int], used: set[str]) -> None:
        """Drop the long pieces of a batch."""
        for piece in used:
            if len(piece) > LONGEST_KEPT:
                del known[piece]

    def of(self, texts: list[str]) -> list[int]:
        cut = [pieces(text) for text in texts]
        first = {parts[0] for parts in cut}
        rest = [parts[1:] for parts in cut]
        later = set().union(*rest)
        before = len(self.heads) + len(self.rest)
        self.learn(self.heads, first, "")
        self.learn(self.rest, later, " ")
        after = self.rest.__getitem__
        counts = [
            self.heads[parts[0]] + sum(map(after, tail))
            for parts, tail in zip(cut, rest, strict=True)
        ]
        self.forget(self.heads, first)
        self.forget(self.rest, later)
        # a kept piece has at most LONGEST_KEPT characters of up to four bytes
        self.held += (len(self.heads) + len(self.rest) - before) * (ENTRY_BYTES + 4 * LONGEST_KEPT)
        if self.held > KEPT_BYTES:
            self.heads.clear()
            self.rest.clear()
            self.held = 0
        return counts


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 1024,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row.

    Texts are cut at safe places and each distinct piece is encoded once while a
    worker keeps it, so cost follows distinct pieces and a very long text with spaces
    is never encoded as one; one without a safe place is.  Batches hold about ``batch_bytes`` each.  Sentencepiece
    texts are not cut (its models may merge across spaces).  Null texts count as
    empty, empty texts have no tokens, repeated rows are counted each, a null id
    stays null, other columns are not carried.
    """
    cuts = tokenizer.endswith(".json")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load(tokenizer)
        lengths = Lengths(encode, batch_bytes)
        for batch in batches:
            totals = np.zeros(batch.num_rows, np.int64)
            rows: list[int] = []
            texts: list[str] = []
            held = 0

            def flush(rows=rows, texts=texts, totals=totals):
                totals[rows] = lengths.of(texts) if cuts else encode(texts)
                rows.clear()
                texts.clear()

            for row, value in enumerate(batch.column(1)):
                text = value.as_py()
                if not text:
                    continue
                rows.append(row)
                texts.append(text)
                held += len(text)
                if held >= batch_bytes:
                    flush()
                    held = 0
            if texts:
                flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(totals)],
                names=["id", "n_bytes", "n_tokens"],
            )

    narrow = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).cast("string").alias("text"),
        F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0))
        .cast("long")
        .alias("n_bytes"),
    )
    kind = narrow.schema["id"].dataType.simpleString()
    counted = narrow.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(
        F.col("id").alias(id_col),
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
