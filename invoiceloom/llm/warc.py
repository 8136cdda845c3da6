"""WARC archives written and read as a table of chunks.

A record is rows of (record identifier, chunk number, bytes). An oversized payload becomes several segment records
(one ``response`` and its ``continuation`` records), so no row, batch or task holds more of it than a chunk beside
the cell it came from. Digests are carried along from chunk to chunk.

Files are written and read by the text source of Spark (``lineSep``), so they go wherever the cluster keeps its data.
They are gzip files: one task reads a file from start to end, which keeps the segments of a record together and in order.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from invoiceloom.llm.rows import column

CHUNK_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
DATE = "1970-01-01T00:00:00Z"

VERSION = b"WARC/1.1"
#: What stands between two records; the first bytes of a file and the last four are the only others.
BETWEEN = "\r\n\r\nWARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNK_SCHEMA = pa.schema(
    [
        ("record_id", pa.string()), ("row_id", pa.int64()), ("page_id", pa.int64()), ("chunk_no", pa.int32()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("is_last", pa.bool_()), ("stated_digest", pa.string()),
        ("data", pa.binary()),
    ]
)
CHUNK_DDL = (
    "record_id string, row_id long, page_id long, chunk_no int, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, is_last boolean, stated_digest string, data binary"
)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def plan_records(
    df: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", min_revisit_bytes: int = 0
) -> DataFrame:
    """Rows (page_id, url, payload, refers_to): what each page writes.

    Of rows with equal payloads of at least ``min_revisit_bytes``, those with the largest id are responses
    (``refers_to`` null) and the others refer to it. Null html is an empty payload. Rows that repeat an id are records of their
    own; those with a null id refer to the largest id, or are responses where no equal payload has an id.
    """
    payload = F.coalesce(F.encode(column(html_column), "UTF-8"), F.lit(b""))
    pages = df.select(
        column(id_column).cast("long").alias("page_id"), column(url_column).cast("string").alias("url"), payload.alias("payload")
    ).withColumn("content", F.sha2("payload", 256))
    first = (
        pages.where(F.octet_length("payload") >= min_revisit_bytes)
        .groupBy("content")
        .agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
        .where("n > 1")
        .select("content", "largest")
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))
    return pages.join(first, "content", "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def header(fields: list[tuple[str, object]]) -> bytes:
    lines = [VERSION.decode(), *(f"{k}: {v}" for k, v in fields if v is not None)]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def printed_url(url: str | None) -> str:
    """The address as one line of visible ASCII; everything else percent-encoded."""
    raw = (url or "").encode()
    return "".join(chr(b) if 0x21 <= b <= 0x7E else f"%{b:02X}" for b in raw)


def cuts(block: memoryview, size: int) -> Iterator[memoryview]:
    """Parts of at most ``size`` bytes, cut inside every ``WARC/1.1`` so that no part reads like the start of a record."""
    at = 0
    while True:
        end = min(at + size, len(block))
        # a view of one chunk is copied for the search, never the whole block
        found = bytes(block[at:end]).find(VERSION)
        if found >= 0:
            end = at + found + 2
        yield block[at:end]
        at = end
        if at >= len(block):
            return


def segments(page_id, row_id: int, url, payload: memoryview, refers_to, size: int, date: str) -> Iterator[bytes]:
    """The records of one page as bytes, each without its last line feed."""
    sha = hashlib.sha1(usedforsecurity=False)
    for at in range(0, len(payload), size):
        sha.update(payload[at : at + size])
    name = f"urn:page:{'null' if page_id is None else page_id}:{row_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{name}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", printed_url(url)),
        ("WARC-Payload-Digest", f"sha1:{base32(sha.digest())}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE), ("Content-Length", len(http))]
        yield header(fields) + http + b"\r\n\r"
        return
    parts = cuts(payload, size)
    part, following = next(parts), next(parts, None)
    # a payload that starts like a record would follow the blank line of the HTTP head: its first part is then "WA"
    fields += [("WARC-Segment-Number", 1 if following is not None else None), ("Content-Length", len(http) + len(part))]
    yield b"".join((header(fields), http, part, b"\r\n\r"))
    number, done = 2, len(http) + len(part)
    while following is not None:
        part, following = following, next(parts, None)
        done += len(part)
        yield b"".join((
            header([
                ("WARC-Type", "continuation"),
                ("WARC-Record-ID", f"<{name}:{number}>"),
                ("WARC-Date", date),
                ("WARC-Segment-Origin-ID", f"<{name}>"),
                ("WARC-Segment-Number", number),
                ("WARC-Segment-Total-Length", done if following is None else None),
                ("Content-Length", len(part)),
            ]),
            part,
            b"\r\n\r",
        ))
        number += 1


def write_warc(records: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, date: str = DATE) -> None:
    """Write planned records (:func:`plan_records`) as gzipped WARC files below ``path``; an empty table writes no record."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            ids, rows, urls, refers = (batch.column(i).to_pylist() for i in (0, 1, 2, 4))
            for i, payload in enumerate(batch.column(3)):
                view = memoryview(payload.as_buffer())
                for value in segments(ids[i], rows[i], urls[i], view, refers[i], chunk_bytes, date):
                    out.append(value)
                    held += len(value)
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    # the number only has to differ between rows of one written file set
    numbered = records.select("page_id", F.monotonically_increasing_id().alias("row_id"), "url", "payload", "refers_to")
    lines = numbered.mapInArrow(chunks, "value binary").select(F.col("value").cast("string"))
    writer = lines.write.option("lineSep", "\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
    writer.text(path)


def read_chunks(spark: SparkSession, path: str, with_data: bool = True) -> DataFrame:
    """The chunk table of an archive written by :func:`write_warc`.

    A row per segment: record_id, row_id, page_id, chunk_no, record_type, refers_to, bytes and SHA-1 of the payload up to
    and with this chunk, whether it is the last, the digest the record states and (``with_data``) the bytes. A revisit has one
    chunk, its size and digest as stated. A segment out of order or a digest that differs from the stated one ends
    the job: the archive is damaged.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_record, total, sha = None, 0, None
        for batch in batches:
            out = []
            for cell in batch.column(0):
                raw = memoryview(cell.as_buffer()) if cell.is_valid else memoryview(b"")
                if len(raw) == 0:
                    continue
                head_end = bytes(raw[: 1 << 16]).find(b"\r\n\r\n")
                if head_end < 0:
                    raise ValueError("a WARC record without a header")
                head = bytes(raw[:head_end]).decode()
                fields = dict(x.split(": ", 1) for x in head.split("\r\n") if ": " in x)
                size = int(fields["Content-Length"])
                block = raw[head_end + 4 : head_end + 4 + size]
                if len(block) != size:
                    raise ValueError(f"a WARC record of {len(block)} bytes states {size}")
                kind = fields["WARC-Type"]
                if kind == "continuation":
                    number = int(fields["WARC-Segment-Number"])
                    if open_record is None or open_record["record_id"] != fields["WARC-Segment-Origin-ID"] or open_record["chunk_no"] + 1 != number:
                        raise ValueError("a WARC segment is not where it belongs")
                    record, data, last = open_record | {"chunk_no": number}, block, "WARC-Segment-Total-Length" in fields
                else:
                    if open_record is not None:
                        raise ValueError("a WARC record lacks its last segment")
                    http_end = bytes(block[: 1 << 12]).index(b"\r\n\r\n") + 4
                    record_id = fields["WARC-Record-ID"]
                    page, row = record_id.strip("<>").split(":")[2:4]
                    to = fields.get("WARC-Refers-To")
                    record = {
                        "record_id": record_id, "row_id": int(row), "page_id": None if page == "null" else int(page), "chunk_no": 1,
                        "record_type": kind, "refers_to": None if to is None else int(to.strip("<>").split(":")[2]),
                        "stated_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                    }
                    data, last = block[http_end:], "WARC-Segment-Number" not in fields
                    total, sha = 0, hashlib.sha1(usedforsecurity=False)
                total += len(data)
                sha.update(data)
                digest = base32(sha.digest())
                stated = record["stated_digest"]
                if kind == "revisit":
                    length = bytes(block).split(b"Content-Length: ", 1)[1].split(b"\r\n", 1)[0]
                    total, digest = int(length), stated
                if last and digest != stated:
                    raise ValueError(f"{record['record_id']}: the payload has not the digest that its record states")
                out.append(record | {"payload_bytes": total, "payload_digest": digest, "is_last": last, "data": bytes(data) if with_data else None})
                open_record = None if last else record
            if out:
                yield pa.RecordBatch.from_pylist(out, CHUNK_SCHEMA)
        if open_record is not None:
            raise ValueError("a WARC record lacks its last segment")

    text = spark.read.option("lineSep", BETWEEN).text(path).select(F.col("value").cast("binary"))
    return text.mapInArrow(parse, CHUNK_DDL)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: page_id, payload_bytes, payload_digest, record_type and refers_to."""
    chunks = read_chunks(spark, path, with_data=False).where("is_last")
    return chunks.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
