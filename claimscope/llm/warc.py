"""WARC archives: writer with identical-payload revisits and a salvage
reader (operator 9).

Writing.  Pages with equal payloads (SHA-1) form a group; its row with the
smallest page id becomes a ``response`` record, the others ``revisit``
records that refer to it.  Groups are found by an aggregate over narrow
digest rows; records are written by Spark's text writer, so any file system
Spark can write to will do: each row is one record as its own gzip member (or
plain), and the line separator is an empty gzip member (or the blank lines
that end a record).  The files are ordinary ``.warc.gz`` / ``.warc`` content.

Reading.  The salvage reader takes a file's bytes and walks record by record.
Each gzip member must inflate with a right checksum, each record must have a
version line, a length, a header that ends, the whole block and, where it has
one, a payload that matches its digest.  After a failed check it searches for
the next member (or version line) that parses, goes on there, and logs the
bytes in between as a quarantined gap with the reason.

Defined results.  Null payload is the empty payload.  Rows that repeat the
smallest page id of a payload are responses too.  A null page id is larger
than any other.  An empty table gives no archive records.  Payloads of any
length up to what one row can hold are written whole.  A damaged record is
lost alone: it appears as a gap, later records are recovered.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.llm.common import scratch, ship

VERSION = b"WARC/1.1\r\n"
RECORDS_PER_FILE = 4000
HOT = 4096            # payloads with 1 / HOT of all rows are joined by broadcast
GZIP_LEVEL = 1
_MAGIC = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_START = re.compile(rb"WARC/1\.[01]\r\n")


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


EMPTY_MEMBER = _member(b"")
RECORD_END = b"\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _target(page_id) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def build_record(page_id, payload: bytes, refers_to, revisit: bool, url: str | None = None,
                 date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record without the blank lines that end it."""
    head = [("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, _target(page_id))}>"),
            ("WARC-Date", date), ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or _target(page_id))),
            ("WARC-Page-ID", "" if page_id is None else str(page_id)),
            ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"), ("WARC-Payload-Length", str(len(payload)))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisit:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To-Page", "" if refers_to is None else str(refers_to))]
        block = http + b"\r\n"
    else:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block


class Damage(ValueError):
    """A failed check, with its reason."""


def parse_record(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """Headers, block and the end of the record (its closing blank lines
    included) that begins at ``at``; raises ``Damage``."""
    if not _START.match(data, at):
        raise Damage("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damage("header without end")
    head = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        k, sep, v = line.partition(b":")
        if not sep:
            raise Damage("bad header line")
        head[k.strip().decode("utf-8", "replace").lower()] = v.strip().decode("utf-8", "replace")
    length = head.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", length):
        raise Damage("no length")
    stop = end + 4 + int(length)
    if stop > len(data):
        raise Damage("block cut short")
    block = data[end + 4:stop]
    if head.get("warc-type") == "response" and "warc-payload-digest" in head:
        payload = block.partition(b"\r\n\r\n")[2]
        if head["warc-payload-digest"] != f"sha1:{payload_digest(payload)}":
            raise Damage("payload digest differs")
    if data[stop:stop + 4] == RECORD_END:
        stop += 4
    elif stop < len(data):
        raise Damage("no blank lines after the block")
    return head, block, stop


def _inflate(data: memoryview, at: int) -> tuple[bytes, int]:
    """The gzip member at ``at`` and its end; raises ``Damage``."""
    z = zlib.decompressobj(31)
    try:
        out = z.decompress(data[at:])
    except zlib.error as e:
        raise Damage("bad gzip member") from e
    if not z.eof:
        raise Damage("gzip member cut short")
    return out, len(data) - len(z.unused_data)


def salvage(data: bytes):
    """Yield ``("record", start, end, headers, block)`` and
    ``("gap", start, end, reason, None)`` covering all bytes of ``data``."""
    view, at, bad_from, reason = memoryview(data), 0, None, ""
    packed = data[:2] == _MAGIC[:2] or (_MAGIC in data and not _START.search(data[:4096]))
    while at < len(data):
        try:
            if packed:
                # One member at a time from a bounded window first: a member
                # rarely needs the whole rest of the file.
                window = 1 << 20
                while True:
                    try:
                        member, used = _inflate(view[at:at + window], 0)
                        end = at + used
                        break
                    except Damage:
                        if at + window >= len(data):
                            raise
                        window *= 8
                if member:
                    head, block, stop = parse_record(member)
                    if stop != len(member):
                        raise Damage("more than a record in a member")
                    found = ("record", at, end, head, block)
                else:
                    found = None
            else:
                head, block, end = parse_record(data, at)
                found = ("record", at, end, head, block)
        except Damage as e:
            if bad_from is None:
                bad_from, reason = at, str(e)
            if packed:
                nxt = data.find(_MAGIC, at + 1)
            else:
                m = _START.search(data, at + 1)
                nxt = m.start() if m else -1
            at = nxt if nxt >= 0 else len(data)
            continue
        if bad_from is not None:
            yield ("gap", bad_from, at, reason, None)
            bad_from = None
        if found:
            yield found
        at = end
    if bad_from is not None:
        yield ("gap", bad_from, len(data), reason, None)


def with_roles(pages: DataFrame, key: str = "page_id", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """``(key, payload, revisit, refers_to)``: the role of each row's record.
    Payloads under ``min_bytes`` are always responses."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(key, body.alias("__body")).withColumn("__sha", F.sha1("__body"))
    # Payloads with 1 / HOT of all rows or more, at most HOT of them, are
    # broadcast: their bodies stay in place and never meet in one task.
    first = rows.groupBy("__sha").agg(F.min(key).alias("__first"), F.count(F.lit(1)).alias("__n"))
    limit = pages.count() / HOT
    hot = F.broadcast(first.where(F.col("__n") >= max(2, limit)).drop("__n"))
    others = first.where(F.col("__n") < max(2, limit)).drop("__n")
    known = rows.join(hot, "__sha").unionByName(rows.join(hot, "__sha", "left_anti").join(others, "__sha"))
    return known.select(
        key, "__body", (~F.col(key).eqNullSafe(F.col("__first")) & (F.octet_length("__body") >= min_bytes)).alias("__revisit"),
        "__first")


def write_archives(pages: DataFrame, path: str, key: str = "page_id", payload: str = "html",
                   min_bytes: int = 0, gzip: bool = True) -> None:
    """Write one record per row below ``path``."""
    roles = with_roles(pages, key, payload, min_bytes)

    def run(batches):
        for batch in batches:
            out = []
            for page, body, revisit, first in zip(*(batch.column(i) for i in range(4))):
                body = body.as_py()
                rec = build_record(page.as_py(), body, first.as_py(), revisit.as_py())
                out.append(_member(rec + RECORD_END) if gzip else rec)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    # Binary as text: the writer copies a string's bytes unchanged.
    (roles.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
     .write.option("lineSep", (EMPTY_MEMBER if gzip else RECORD_END).decode("latin-1"))
     .option("encoding", "ISO-8859-1").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


READ_SCHEMA = ("kind string, file string, start long, end long, reason string, page_id string, record_type string, "
               "payload_bytes long, payload_digest string, refers_to string, payload binary")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and quarantined gaps of all archives below ``path``."""
    ship(spark)

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                rows = []
                for kind, start, end, head, block in salvage(content.as_py()):
                    row = {"kind": kind, "file": file.as_py(), "start": start, "end": end}
                    if kind == "gap":
                        row["reason"] = head
                    else:
                        revisit = head.get("warc-type") == "revisit"
                        body = None if revisit else block.partition(b"\r\n\r\n")[2]
                        row |= {"page_id": head.get("warc-page-id") or None, "record_type": head.get("warc-type"),
                                "payload_bytes": int(head["warc-payload-length"]) if revisit else len(body),
                                "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:"),
                                "refers_to": head.get("warc-refers-to-page") or None if revisit else None,
                                "payload": body if payloads else None}
                    rows.append(row)
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_pylist(rows, ARROW_SCHEMA)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, ARROW_SCHEMA)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, READ_SCHEMA)


ARROW_SCHEMA = pa.schema([
    ("kind", pa.string()), ("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string()),
    ("page_id", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])


def round_trip(pages: DataFrame, key: str = "page_id", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write the archives below the shared folder, read them back by the
    salvage reader and return its records and gaps."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archives(pages, path, key, payload, min_bytes=min_bytes)
    return read_archives(spark, path, payloads=False)


def records(read: DataFrame, id_type: str = "bigint") -> DataFrame:
    """The records of ``read_archives`` with typed ids."""
    return read.where("kind = 'record'").select(
        F.col("page_id").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(id_type).alias("refers_to"))
