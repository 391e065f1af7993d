"""WARC archives: records written with an index, read back by coalesced byte ranges.

Writing: every task compresses its records one by one (gzip members, as WARC
readers expect) into archives in a shared folder and returns an index row per
record: archive, offset, length, url, digest.  Archive names carry the task
attempt, and only rows of attempts that Spark committed reach the index, so a
repeated or speculative task leaves at most an archive that nothing refers to.

Reading: selected index rows are grouped by stretches of an archive; each task
sorts the records of its stretches, merges neighbours into one read and checks
every payload against its digest.

Archives are opened with ``pyarrow.fs``, so the folder may be on any store that
library and all executors reach.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitus.llm.membership import bitmap, maybe_in

ARCHIVE_BYTES = 64 << 20
#: Records of one stretch are read by one task; gaps up to GAP are read over.
STRETCH, GAP = 4 << 20, 64 << 10
END = b"\r\n\r\n"
PRINTABLE = "".join(chr(c) for c in range(0x21, 0x7F))

# Digits of radix 32 and the base32 alphabet.
RADIX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: each 5 hex digits are 4 base32 digits."""
    digits = F.sha1(payload)
    groups = [
        F.lpad(F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)
    ]
    return F.translate(F.concat(*groups), RADIX, ALPHABET)


def record(page_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record.  A revisit has an empty block and names its response."""
    revisit = refers_to is not None
    block = b"" if revisit else (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
        % len(payload)
    ) + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url or '', safe=PRINTABLE)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    else:
        head.append("Content-Type: application/http; msgtype=response")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + END + block + END


def parsed(data: bytes) -> tuple[str, str, str | None, bytes | None, int, str]:
    """(page_id, type, refers_to, payload, payload_bytes, digest) of a record."""
    head, _, rest = data.partition(END)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != END:
        raise ValueError("record does not end where its length says")
    named = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    name = fields["WARC-Record-ID"][len("<urn:page:") : -1]
    if fields["WARC-Type"] == "revisit":
        refers = fields["WARC-Refers-To"][len("<urn:page:") : -1]
        return name, "revisit", refers, None, int(fields["X-Payload-Length"]), named
    payload = block.partition(END)[2]
    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if found != named:
        raise ValueError(f"payload of {name} does not match its digest")
    return name, "response", None, payload, len(payload), found


def opened(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _archive_writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        name, out, at, count = "", None, 0, 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{count:03d}.warc.gz"
                        out, at, count = store.open_output_stream(f"{base}/{name}", compression=None), 0, count + 1
                    member = gzip.compress(
                        record(str(page_id), url, payload, digest, refers_to), compresslevel=6, mtime=0
                    )
                    out.write(member)
                    rows.append((name, at, len(member), url, digest, page_id))
                    at += len(member)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(
                        (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                    )],
                    names=["archive", "offset", "length", "url", "digest", "page_id"],
                )
        finally:
            if out is not None:
                out.close()

    return write


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_bytes: int = 0,
) -> DataFrame:
    """Write every row as a record below ``folder``; the index is the result.

    Write the result to a table before using it: computing it writes archives.
    Of rows with equal payloads of ``least_bytes`` or more, those with the
    smallest id are responses and the others revisit it.  Null payloads are
    empty, null urls are written empty, a null id is larger than all others (and
    alone, a response); rows that repeat an id are records of their own; other
    columns are not written.
    """
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    whole = pages.select(
        F.col(id_col).cast("string").alias("page_id"),
        F.col(id_col).alias("order_id"),
        F.col(url_col).cast("string").alias("url"),
        body.alias("payload"),
        base32_sha1(body).alias("digest"),
    )
    narrow = whole.filter(F.octet_length("payload") >= least_bytes).select("digest", "order_id", "page_id")
    firsts = (
        narrow.groupBy("digest")
        .agg(F.min("order_id").alias("first"), F.count("*").alias("copies"))
        .filter("copies > 1 and first is not null")
    )
    again = (
        narrow.join(firsts, "digest")
        .filter(~F.col("order_id").eqNullSafe(F.col("first")))
        .select(
            F.col("digest").alias("d"), F.coalesce("page_id", F.lit("")).alias("p"),
            F.col("first").cast("string").alias("refers_to"),
        )
        .distinct()
    )
    # Only rows that may be revisits are shuffled with their payloads.
    key = (F.col("digest"), F.coalesce("page_id", F.lit("")))
    marked = whole.drop("order_id").withColumn("maybe", maybe_in(whole, bitmap(again, "d", "p"), *key))
    doubtful = (
        marked.filter("maybe")
        .join(again, (key[0] == F.col("d")) & (key[1] == F.col("p")), "left")
    )
    columns = ("page_id", "url", "payload", "digest", "refers_to")
    records = (
        marked.filter("not maybe").withColumn("refers_to", F.lit(None).cast("string")).select(*columns)
        .unionByName(doubtful.select(*columns))
    )
    return records.mapInArrow(
        _archive_writer(folder),
        "archive string, offset long, length long, url string, digest string, page_id string",
    )


def read_records(selected: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records of the selected index rows, by coalesced reads in offset order.

    Columns: page_id and refers_to (as text), record_type, payload_bytes,
    payload_digest, and ``payload`` (text, null for revisits) if wanted.
    """
    stretches = (
        selected.groupBy("archive", F.expr(f"offset div {STRETCH}").alias("stretch"))
        .agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"))
        .select("archive", F.col("records.offset").alias("offsets"), F.col("records.length").alias("lengths"))
    )
    schema = "page_id string, record_type string, refers_to string, payload_bytes long, payload_digest string"
    schema += ", payload string" if payloads else ""
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.string()] * payloads
    names = [part.split()[0] for part in schema.split(", ")]

    def merged(offsets: list[int], lengths: list[int]) -> Iterator[list[tuple[int, int]]]:
        run: list[tuple[int, int]] = []
        for offset, length in zip(offsets, lengths, strict=True):
            if run and offset - sum(run[-1]) > GAP:
                yield run
                run = []
            run.append((offset, length))
        if run:
            yield run

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        for batch in batches:
            for name, offsets, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(f"{base}/{name}") as archive:
                    for run in merged(offsets, lengths):
                        begin, end = run[0][0], sum(run[-1])
                        data = archive.read_at(end - begin, begin)
                        rows = []
                        for offset, length in run:
                            got = parsed(gzip.decompress(data[offset - begin : offset - begin + length]))
                            page, kind, refers, payload, size, digest = got
                            text = None if payload is None else payload.decode()
                            rows.append((page, kind, refers, size, digest, text)[: len(kinds)])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(column, type_) for column, type_ in zip(zip(*rows, strict=True), kinds, strict=True)],
                            names=names,
                        )

    return stretches.mapInArrow(read, schema)
