"""Legacy archive conversion: ARC archives of either version to WARC, and a WARC reader.

An archive is one file: a version block, and records of a header line and as many bytes as
it declares. Spark's text writer writes archives as they are, since the bytes that part
records in either format can serve as its line separator; its reader of whole files reads
them back. Both work on every store that Spark can write to. Archives are cut at
``ARCHIVE_BYTES``, so that one in memory is bounded; a larger record is one of its own.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stylograin.llm.common import mapped, stored

ARCHIVE_BYTES = 8 << 20

#: The fields of a record's header line by version of the format, and of the WARC profile of a repeated payload.
ARC_FIELDS = {
    b"1": [b"URL", b"IP-address", b"Archive-date", b"Content-type", b"Archive-length"],
    b"2": [b"URL", b"IP-address", b"Archive-date", b"Content-type", b"Result-code", b"Checksum", b"Location", b"Offset", b"Filename",
           b"Archive-length"],
}
WARC_VERSION = b"WARC/1.1"
SAME_PAYLOAD = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-record")
KEY, PAYLOAD_LENGTH, REFERS_TO_KEY = b"X-Key", b"X-Payload-Length", b"X-Refers-To-Key"


def digest(payload: bytes) -> str:
    """Upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def field_value(value: bytes | None) -> bytes:
    """A value without the bytes that would end a header field."""
    return b"-" if not value else b"".join(b"%%%02X" % b if b <= 0x20 or b == 0x7F else bytes([b]) for b in value)


@dataclass
class ArcRecord:
    version: bytes
    offset: int
    fields: dict[bytes, bytes]
    content: bytes
    truncated: bool

    def http(self) -> tuple[bytes, bytes]:
        """Head (with its empty line) and payload; a record without an HTTP head is all payload."""
        if not self.content.startswith(b"HTTP/"):
            return b"", self.content
        end = self.content.find(b"\r\n\r\n")
        return (self.content, b"") if end < 0 else (self.content[:end + 4], self.content[end + 4:])


def header(head: bytes, name: bytes) -> bytes | None:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.lower():
            return value.strip()
    return None


def arc_records(data: bytes) -> Iterator[ArcRecord]:
    """The records of an archive, version blocks included. A version block sets how the header lines after it are read.

    Header lines are read from the right, as old URLs hold blanks. A declared length beyond
    the end of the archive gives a record of what is there, marked as truncated.
    """
    at, version = 0, b"1"
    while at < len(data):
        if data[at:at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end].rstrip(b"\r")
        is_version = line.startswith(b"filedesc:")
        n = len(ARC_FIELDS[b"1"])
        if is_version:
            block = data[end + 1:end + 64].split(b"\n", 1)[0].split(b" ")
            if block[0] not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {block[0]!r}")
            version = block[0]
        else:
            n = len(ARC_FIELDS[version])
        parts = line.rsplit(b" ", n - 1)
        if len(parts) < n or not parts[-1].isdigit():
            raise ValueError(f"no ARC header line at byte {at}: {line[:200]!r}")
        length = int(parts[-1])
        content = data[end + 1:end + 1 + length]
        yield ArcRecord(version, at, dict(zip(ARC_FIELDS[b"1" if is_version else version], parts)), content, len(content) < length)
        at = end + 1 + length


def arc_archive(records: list[tuple[bytes, bytes, bytes, bytes]], version: bytes, name: bytes) -> bytes:
    """An archive of (URL, date, content type, content), without the line feed after its last record."""
    columns = b" ".join(ARC_FIELDS[version])
    about = version + b" 0 converter\n" + columns + b"\n"
    parts = [b"filedesc://" + name + b" 0.0.0.0 19960101000000 text/plain " + b"%d\n" % len(about) + about]
    for url, date, kind, content in records:
        middle = b"200 - - 0 " + name + b" " if version == b"2" else b""
        parts.append(b" ".join([url, b"0.0.0.0", date, kind]) + b" " + middle + b"%d\n" % len(content) + content)
    return b"\n".join(parts)


def write_arc(pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "20200101000000",
              archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one ARC record per row as an HTTP response, in compressed archives of either version by turns.

    The key is kept in a field of the HTTP head; a null key has no field, a null payload is
    empty, and a null URL is "-". Blanks and control bytes in URLs are percent-encoded.
    """
    def archives(batches):
        held, size, n = [], 0, 0
        for batch in batches:
            for k, u, body in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(),
                                  batch.column(2).cast(pa.binary()).to_pylist()):
                body = body or b""
                if held and size + len(body) > archive_bytes:
                    yield one(held, n)
                    held, size, n = [], 0, n + 1
                head = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(body)]
                if k is not None:
                    head.append(KEY + b": " + str(k).encode())
                held.append((field_value(u), date.encode(), b"text/html", b"\r\n".join(head) + b"\r\n\r\n" + body))
                size += len(body) + 200
        if held:
            yield one(held, n)

    def one(held, n):
        return pa.RecordBatch.from_arrays([pa.array([arc_archive(held, b"12"[n % 2:n % 2 + 1], b"pages.arc")], pa.binary())], names=["value"])

    _write(mapped(pages.select(key, url, payload), archives, "value binary"), folder, "\n")


def _write(archives: DataFrame, folder: str, end: str) -> None:
    """One file per row; ``end`` is what must follow the last record of an archive."""
    (archives.select(F.col("value").cast("string")).write.option("lineSep", end).option("maxRecordsPerFile", 1)
     .option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(folder))


def _archives(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path", "content")


def _plain(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def record_id(path: str, record: ArcRecord) -> bytes:
    """The same identifier for the same record of the same archive, on every run."""
    name = path.rsplit("/", 1)[-1]
    return b"<urn:uuid:" + str(uuid.uuid5(NAMESPACE, f"{name}:{record.offset}")).encode() + b">"


def warc_date(date: bytes) -> bytes:
    """ISO form of 14 digits (fewer are filled up with the first moment)."""
    d = (date + b"00000101000000"[len(date):]).decode("ascii", "replace") if date.isdigit() else "19960101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z".encode()


def warc_record(path: str, record: ArcRecord, original: dict | None) -> bytes:
    """One WARC record, without the two line breaks after it; ``original`` is the record that a revisit repeats."""
    head, payload = record.http()
    fields = record.fields
    if fields[b"URL"].startswith(b"filedesc:"):
        named = [(b"WARC-Type", b"warcinfo")]
        block, kind = b"software: ARC converter\r\nformat: WARC File Format 1.1\r\nconvertedFrom: ARC/" + record.version + b"\r\n", b"application/warc-fields"
    else:
        block, kind = record.content, b"application/http;msgtype=response" if head else fields[b"Content-type"]
        named = [(b"WARC-Type", b"response" if head else b"resource"), (b"WARC-Target-URI", fields[b"URL"])]
        if fields[b"IP-address"] not in (b"0.0.0.0", b"-"):
            named.append((b"WARC-IP-Address", fields[b"IP-address"]))
        named += [(b"WARC-Payload-Digest", b"sha1:" + digest(payload).encode()), (PAYLOAD_LENGTH, b"%d" % len(payload))]
        key = header(head, KEY)
        if key is not None:
            named.append((KEY, key))
        if original is not None:
            named[0] = (b"WARC-Type", b"revisit")
            named += [(b"WARC-Profile", SAME_PAYLOAD), (b"WARC-Refers-To", original["record_id"].encode())]
            if original["key"] is not None:
                named.append((REFERS_TO_KEY, str(original["key"]).encode()))
            block = head
        if record.truncated:
            named.append((b"WARC-Truncated", b"length"))
    named += [(b"WARC-Record-ID", record_id(path, record)), (b"WARC-Date", warc_date(fields[b"Archive-date"])),
              (b"WARC-Block-Digest", b"sha1:" + digest(block).encode()), (b"Content-Type", kind), (b"Content-Length", b"%d" % len(block))]
    return WARC_VERSION + b"\r\n" + b"".join(k + b": " + v + b"\r\n" for k, v in named) + b"\r\n" + block


def convert(spark: SparkSession, arc_folder: str, warc_folder: str, *, min_bytes: int = 0) -> None:
    """Convert each ARC archive below a folder to a WARC archive.

    Of the records with the same payload of ``min_bytes`` or more, the one with the largest
    key stays a response (no key is smallest; of equal keys, the last archive and record);
    the others become revisits of it. Payloads are never shuffled: their digests are, to
    find the originals, and the compressed archives, to meet what their records repeat.
    """
    def describe(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for at, record in enumerate(arc_records(_plain(content))):
                    if not record.fields[b"URL"].startswith(b"filedesc:"):
                        head, payload = record.http()
                        key = header(head, KEY)
                        rows.append((path, at, record_id(path, record).decode(), None if key is None else int(key), digest(payload), len(payload)))
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(("path", "at", "record_id", "key", "digest", "length"), r)) for r in rows],
                                                     schema=pa.schema([("path", pa.string()), ("at", pa.int64()), ("record_id", pa.string()),
                                                                       ("key", pa.int64()), ("digest", pa.string()), ("length", pa.int64())]))

    archives = _archives(spark, arc_folder)
    records = stored(mapped(archives, describe, "path string, at bigint, record_id string, key bigint, digest string, length bigint")
                     .where(F.col("length") >= min_bytes), "records")
    last = F.max(F.struct("key", "path", "at", "record_id"))
    originals = stored(records.groupBy("digest").agg(last.alias("original"), F.count("*").alias("n")).where("n > 1").drop("n"), "originals")
    revisits = (records.join(originals, "digest").where("record_id <> original.record_id")
                .groupBy("path").agg(F.collect_list(F.struct("at", F.col("original.record_id").alias("record_id"), F.col("original.key").alias("key"))).alias("revisits")))

    def rewrite(batches):
        for batch in batches:
            for path, content, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                original = {r["at"]: r for r in known or ()}
                out = b"\r\n\r\n".join(warc_record(path, r, original.get(at)) for at, r in enumerate(arc_records(_plain(content))))
                if out:  # a file without records, as Spark writes for no rows, gives no archive
                    yield pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], names=["value"])

    _write(mapped(archives.join(stored(revisits, "revisits"), "path", "left").select("path", "content", "revisits"), rewrite, "value binary"),
           warc_folder, "\r\n\r\n")


def warc_records(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].split(b"\r\n")
        if end < 0 or not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}: {data[at:at + 80]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in lines[1:])}
        length = int(fields[b"content-length"])
        yield fields, data[end + 4:end + 4 + length]
        at = end + 4 + length + 4


READ_SCHEMA = ("record_id string, record_type string, target_uri string, date string, key bigint, payload_bytes bigint, payload_digest string, "
               "refers_to string, refers_to_key bigint, intact boolean, payload binary")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record with a payload (not ``warcinfo``).

    Length and digest are those of the full payload, also of a revisit, whose ``payload``
    is null. ``intact`` says whether the blocks and payloads have the digests that the
    headers give.
    """
    def read(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows, size = [], 0
                for fields, block in warc_records(_plain(content)):
                    kind = fields[b"warc-type"].decode()
                    if kind == "warcinfo":
                        continue
                    _, payload = ArcRecord(b"", 0, {}, block, False).http()
                    named, key, to = fields[b"warc-payload-digest"].decode().removeprefix("sha1:"), fields.get(KEY.lower()), fields.get(REFERS_TO_KEY.lower())
                    intact = fields[b"warc-block-digest"].decode() == "sha1:" + digest(block) and (kind == "revisit" or digest(payload) == named)
                    refers = fields.get(b"warc-refers-to")
                    rows.append({"record_id": fields[b"warc-record-id"].decode(), "record_type": kind, "target_uri": fields[b"warc-target-uri"].decode("utf-8", "replace"),
                                 "date": fields[b"warc-date"].decode(), "key": None if key is None else int(key), "payload_bytes": int(fields[PAYLOAD_LENGTH.lower()]),
                                 "payload_digest": named, "refers_to": refers and refers.decode(), "refers_to_key": None if to is None else int(to),
                                 "intact": intact, "payload": None if kind == "revisit" else payload})
                    size += len(payload)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_read_types)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_read_types)

    return mapped(_archives(spark, folder).select("content"), read, READ_SCHEMA)


_read_types = pa.schema([(c.split()[0], {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[c.split()[1]])
                         for c in READ_SCHEMA.split(", ")])
