"""WARC archives: written in segments with chunked framing, read back and reassembled.

Each page is one record. Of the pages with one payload the one with the largest
id is written as a response and the others as revisits of it. A response's block is an
HTTP message in chunked transfer framing; a block longer than ``segment_bytes``
goes into a first segment and continuation records, which may lie in any file.

Files are written by Spark's text source with the end of a record as line end,
and read by it with a record's first line as line end, so they lie in any store.
To make that safe for every payload, a chunk ends inside each place of the
payload that looks like such a line; a record's length is still checked against
its header. Readers group
segments by their origin's identifier, order them by number, verify the total
length, undo the framing and check the payload's digest.
"""

from __future__ import annotations

import re
import uuid
from base64 import b32encode
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import by_batch, keep, no_text, texts_of
from tidewatch.session import checkpoint_root

# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
MARK = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"

CHUNK_BYTES = 8192
_RECORD = "origin string, segment int, total long, page long, refers long, type string, digest string, length long, block binary"
_BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def payload_digest(payload: Column) -> Column:
    """Base32 SHA-1, upper case."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), *_BASE32)


def chunked(payload: bytes) -> bytes:
    """Chunked transfer framing; no chunk holds what could be taken for a record border."""
    cuts = {m.start() + 5 for m in re.finditer(re.escape(MARK), payload)}
    cuts |= {*range(CHUNK_BYTES, len(payload), CHUNK_BYTES), len(payload)}
    out, start = [], 0
    for cut in sorted(cuts - {0}):
        out.append(b"%X\r\n%s\r\n" % (cut - start, payload[start:cut]))
        start = cut
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("broken chunk")
        at = end + 4 + size


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{name}: {value}\r\n" for name, value in [*fields, ("Content-Length", len(block))] if value is not None]
    return VERSION + "".join(lines).encode() + b"\r\n" + block


def _one_line(value: str | None) -> str | None:
    """White space and what looks like a record's first line can't stand in a header; they are written as in a URL."""
    coded = value and re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value)
    return coded and coded.replace(MARK.decode(), "WARC%2F1.1")


def _records(pages: DataFrame, segment_bytes: int) -> DataFrame:
    """(value): the bytes of each record; ``pages`` has page, url, digest, length, refers and html (null for revisits)."""

    def make():
        task, run = TaskContext.get().partitionId(), [0]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("page", "url", "digest", "length", "refers")]
            for page, url, digest, length, refers, html in zip(*columns, texts_of(batch, "html"), strict=True):
                run[0] += 1
                # Equal rows still are records of their own.
                own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {task} {run[0]}')}>"
                head = [("WARC-Date", EPOCH), ("WARC-Target-URI", _one_line(url)), ("WARC-Page-ID", page)]
                if refers is not None:
                    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-Payload-Length: %d\r\n\r\n" % length
                    head += [("WARC-Type", "revisit"), ("WARC-Profile", PROFILE), ("WARC-Record-ID", own)]
                    head += [("WARC-Refers-To-Page-ID", refers), ("WARC-Payload-Digest", f"sha1:{digest}")]
                    out.append(_record([*head, ("Content-Type", "application/http; msgtype=response")], http))
                    continue
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(html)
                parts = _segments(block, segment_bytes)
                for number, part in enumerate(parts, 1):
                    fields = [*head, ("WARC-Type", "response" if number == 1 else "continuation")]
                    if number == 1:
                        fields += [("WARC-Record-ID", own), ("WARC-Payload-Digest", f"sha1:{digest}")]
                        fields += [("Content-Type", "application/http; msgtype=response")]
                    else:
                        name = uuid.uuid5(uuid.NAMESPACE_URL, f"{own} {number}")
                        fields += [("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Segment-Origin-ID", own)]
                    if len(parts) > 1:
                        fields += [("WARC-Segment-Number", number)]
                        fields += [("WARC-Segment-Total-Length", len(block) if number == len(parts) else None)]
                    out.append(_record(fields, part))
            return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

        return step

    return pages.mapInArrow(by_batch(make), "value binary")


def _segments(block: bytes, size: int) -> list[bytes]:
    return [block[i : i + size] for i in range(0, len(block), size)]


def write_warc(pages: DataFrame, path: str, *, segment_bytes: int = 1 << 16) -> None:
    """Write a record a row to gzip files below ``path``; ``pages`` as for ``_records``."""
    text = _records(pages, segment_bytes).select(F.col("value").cast("string"))
    text.write.option("lineSep", END.decode()).option("compression", "gzip").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Every record below ``path``: origin, segment, total, page, refers, type, digest, length, block."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            rows = []
            for raw in texts_of(batch, "value"):
                if not raw:  # before a file's first record
                    continue
                head, _, rest = raw.partition(END)
                fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n"))
                size = int(fields["Content-Length"])
                block = rest[:size]
                if len(block) != size or rest[size:] != END:
                    raise ValueError(f"record {fields['WARC-Record-ID']} has not the length it states")
                number = lambda name, f=fields: int(f[name]) if name in f else None
                kept = re.search(rb"\r\nX-Payload-Length: (\d+)\r\n", block) if fields["WARC-Type"] == "revisit" else None
                rows.append((
                    fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"]),
                    number("WARC-Segment-Number"),
                    number("WARC-Segment-Total-Length"),
                    number("WARC-Page-ID"),
                    number("WARC-Refers-To-Page-ID"),
                    fields["WARC-Type"],
                    fields.get("WARC-Payload-Digest", "sha1:").removeprefix("sha1:") or None,
                    int(kept[1]) if kept else None,
                    block,
                ))
            if not rows:
                return None
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, _NAMES)

        return step

    raw = spark.read.option("lineSep", VERSION.decode()).text(path).select(F.col("value").cast("binary").alias("value"))
    return raw.mapInArrow(by_batch(make), _RECORD)


_NAMES = [part.split()[0] for part in _RECORD.split(", ")]
_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
_PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_PAGE_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]


def _payload(block: bytes, digest: str) -> bytes:
    head, _, body = block.partition(END)
    payload = dechunked(body) if b"\r\nTransfer-Encoding: chunked" in head else body
    if b32encode(sha1(payload).digest()).decode() != digest:
        raise ValueError("a payload has not the digest its record states")
    return payload


def reassembled(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and payload (null for revisits) of each record.

    Records in one piece are decoded where they are read; only segments are
    shuffled, sorted by origin and number, and joined one record at a time.
    """

    def whole_rows(rows: list[tuple], page, refers, kind, digest, length, block) -> None:
        payload = None if kind == "revisit" else _payload(block, digest)
        rows.append((page, length if payload is None else len(payload), digest, kind, refers, payload))

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PAGE_TYPES, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, [p.split()[0] for p in _PAGE.split(", ")])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("page", "refers", "type", "digest", "length")]
            for *fields, block in zip(*columns, texts_of(batch, "block"), strict=True):
                whole_rows(rows, *fields, block)
            if rows:
                yield packed(rows)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        origin, first, parts = None, None, []
        names = ("origin", "segment", "total", "page", "refers", "type", "digest", "length")
        for batch in batches:
            rows: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in names]
            for at, segment, total, *fields, block in zip(*columns, texts_of(batch, "block"), strict=True):
                if at != origin:
                    if parts:
                        raise ValueError(f"record {origin} has no last segment")
                    origin, first = at, fields
                parts.append(block)
                if segment != len(parts):
                    raise ValueError(f"record {origin} lacks segment {len(parts)}")
                if total is not None:
                    if total != sum(map(len, parts)):
                        raise ValueError(f"record {origin} has not the total length it states")
                    whole_rows(rows, *first, b"".join(parts))
                    parts = []
            if rows:
                yield packed(rows)
        if parts:
            raise ValueError(f"record {origin} has no last segment")

    in_one = records.filter("segment IS NULL").mapInArrow(decode, _PAGE)
    segments = records.filter("segment IS NOT NULL").repartition("origin").sortWithinPartitions("origin", "segment")
    return in_one.unionByName(segments.mapInArrow(join, _PAGE))


def archive_round_trip(
    pages: DataFrame, *, least_bytes: int = 0, segment_bytes: int = 1 << 16, key: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """Write all pages as WARC records to the shared folder, read the archives back and describe each page.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to and
    payload (null for revisits). Of rows with equal payloads of at least
    ``least_bytes`` bytes those with the largest page_id are responses and the
    others revisit it.

    Null html is an empty payload. A row with a null page_id is a revisit if a
    row with an id has its payload, else a response. Equal rows are records of
    their own. Null urls are left out of the record. Other columns are not read;
    no rows give no rows.
    """
    spark = pages.sparkSession
    payload = no_text(html)
    read = pages.select(
        F.col(key).cast("long").alias("page"),
        F.col(url).alias("url"),
        payload.alias("html"),
        payload_digest(payload).alias("digest"),
        F.octet_length(payload).cast("long").alias("length"),
    )
    last = keep(
        read.filter(F.col("length") >= least_bytes)
        .groupBy("digest", "length")
        .agg(F.max("page").alias("last"), F.count("*").alias("n"))
        .filter("n > 1 AND last IS NOT NULL")
        .select("digest", "length", "last"),
        "last-pages",
    )
    refers = F.when(~F.col("page").eqNullSafe(F.col("last")), F.col("last"))
    dealt = read.join(last, ["digest", "length"], "left").withColumn("refers", refers)
    path = f"{checkpoint_root(spark)}/llm-warc-{uuid.uuid4().hex}"
    write_warc(dealt.withColumn("html", F.when(F.col("refers").isNull(), F.col("html"))), path, segment_bytes=segment_bytes)
    return reassembled(read_warc(spark, path))
