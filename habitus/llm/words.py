"""Word hashes of whole Arrow text batches, computed with array operations.

A word is a maximal run of bytes of a byte class.  Two classes are used:
``SPACED`` (anything but the six ASCII space characters, the pattern
``[^\\x20\\x09-\\x0D]+``) and ``PLAIN`` (ASCII letters and digits and every
non-ASCII byte, so that punctuation separates).  Both fold A-Z to a-z.

Texts are read as UTF-8 bytes straight from the Arrow buffers and taken in
slices of about ``SLICE`` bytes, so working memory follows the slice, not the
batch.  Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 18

_BYTES = np.arange(256)
_SPACE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
_ALNUM = (
    ((_BYTES >= 48) & (_BYTES <= 57))
    | ((_BYTES >= 65) & (_BYTES <= 90))
    | ((_BYTES >= 97) & (_BYTES <= 122))
    | (_BYTES >= 128)
)
SPACED = ~_SPACE
PLAIN = _ALNUM

_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_FOLDED = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES)
_VALUE = mix((_FOLDED + 1).astype(np.uint64) * _BASE)


def hash_of(word: str, salt: int = 0) -> int:
    """The hash :func:`hash_words` gives to one word (for fixed word lists)."""
    data = np.frombuffer(word.encode(), np.uint8)
    _, _, h = hash_words(data, np.array([0, len(data)]), np.ones(256, bool))
    return int(mix(h + np.uint64(salt))[0]) if salt else int(h[0])


def hash_words(
    data: np.ndarray, offsets: np.ndarray, inside: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start byte, hash) of every word, in text order.

    ``offsets`` cut ``data`` into texts; no word crosses a cut.  ``inside`` is
    the byte class.
    """
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    member = inside[data]
    begins = member.copy()
    begins[1:] &= ~member[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = member[edges]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    spans = np.diff(starts, append=len(data))
    first = starts[0]
    place = np.arange(first, len(data)) - np.repeat(starts, spans)
    powers = np.empty(int(spans.max()), np.uint64)
    powers[0] = 1
    powers[1:] = _BASE
    np.cumprod(powers, out=powers)
    terms = _VALUE[data[first:]] * powers[place]
    terms[~member[first:]] = 0
    hashes = mix(np.add.reduceat(terms, starts - first))
    texts = np.searchsorted(offsets, starts, side="right") - 1
    return texts, starts, hashes


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(offsets):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of at most ``limit`` bytes (one text at least)."""
    raw, offsets = buffers(column)
    begin, count = 0, len(offsets) - 1
    while begin < count:
        end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
        end = min(max(end, begin + 1), count)
        yield begin, end, raw[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        begin = end


def words(
    data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, limit: int = 16 * SLICE
) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every word; one huge text is hashed in pieces."""
    if len(offsets) != 2 or len(data) <= limit:
        texts, _, hashes = hash_words(data, offsets, inside)
        return texts, hashes
    parts, begin = [], 0
    while begin < len(data):
        end = min(begin + limit, len(data))
        while end < len(data):  # on to the next byte outside words
            gap = np.flatnonzero(~inside[data[end : end + limit]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + limit, len(data))
        piece = data[begin:end]
        parts.append(hash_words(piece, np.array([0, len(piece)]), inside)[2])
        begin = end
    hashes = np.concatenate(parts)
    return np.zeros(len(hashes), np.int64), hashes


def windows(texts: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every run of ``size`` words that stays in one text."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for k in range(size):
        total = total * _BASE + mix(hashes[k : k + count] + np.uint64(k))
    whole = texts[:count] == texts[size - 1 :]
    return texts[:count][whole], mix(total[whole])
