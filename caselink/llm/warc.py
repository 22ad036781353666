"""WARC writing with revisit records, and a salvage reader.

Archives are gzip WARC/1.1, one member per record. They are stored as rows
(name, records, data) of a Parquet table, whose commit protocol leaves no half
archive behind when an executor is lost; `data` is the archive file byte for
byte.

The reader checks every member (gzip CRC), version line, header and content
length, the payload's digest and length, and that ids are whole numbers; a field
that cannot be read is a failed check like any other. After a failed check it searches for the next
member or version line from which a whole valid record can be read, goes on from
there, and logs the bytes between as a quarantined gap. No later record is lost
to an earlier fault.

Defined cases: null html is an empty payload; null url becomes `about:blank`. Of
equal payloads the row with the largest page_id is the response; a null page_id
is less than all, and if several rows carry that page_id, or all are null, each
of them is a response. An empty table gives no archive and no rows. Other
columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
ID = "<urn:page:{}>"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

ARCHIVES = "name string, records long, data binary"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, at long"
GAPS = "archive string, start long, end long, reason string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, level: int = 3, digest: str | None = None) -> bytes:
    """One record as a gzip member; a revisit names the response and carries no payload."""
    block = HTTP if revisit else HTTP + payload
    clean = re.sub(r"[\x00-\x20\x7f]", "%20", url) if url else "about:blank"
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {ID.format('null' if page_id is None else page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{digest or base32_sha1(payload)}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines[4:4] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {ID.format(refers_to)}"]
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    head = VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n"
    return squeeze.compress(head + block + b"\r\n\r\n") + squeeze.flush()


@dataclass
class Record:
    start: int
    end: int
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]


@dataclass
class Salvage:
    records: list[Record] = field(default_factory=list)
    gaps: list[tuple[int, int, str]] = field(default_factory=list)


def parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at `at` of uncompressed bytes; ValueError names the failed check."""
    if not re.match(rb"WARC/1\.[01]\r\n", raw[at : at + 10]):
        raise ValueError("version line")
    blank = raw.find(b"\r\n\r\n", at)
    if blank < 0:
        raise ValueError("header")
    head = raw[at:blank]
    headers: dict[str, str] = {}
    for line in head.split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header")
        headers[key.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not re.fullmatch(r"[0-9]{1,15}", headers.get("content-length", "")):
        raise ValueError("content length")
    start = at + len(head) + 4
    end = start + int(headers["content-length"])
    if raw[end : end + 4] != b"\r\n\r\n":
        raise ValueError("content length")
    block = raw[start:end]
    check(headers, block)
    return headers, block, end + 4


def check(headers: dict[str, str], block: bytes) -> None:
    """ValueError where a field cannot be read, or says something else than the record holds."""
    response = headers.get("warc-type") == "response"
    payload = block.partition(b"\r\n\r\n")[2]
    wanted = headers.get("warc-payload-digest", "")
    if response and wanted.startswith("sha1:") and base32_sha1(payload) != wanted[5:]:
        raise ValueError("payload digest")
    length = headers.get("warc-payload-length")
    if length is not None and (not re.fullmatch("[0-9]{1,18}", length) or response and int(length) != len(payload)):
        raise ValueError("payload length")
    for name in ("warc-record-id", "warc-refers-to"):
        page = _PAGE.fullmatch(headers.get(name, ""))
        if page and not _whole(page[1]):
            raise ValueError(name)


_PAGE = re.compile(r"<urn:page:(.*)>", re.S)


def _whole(text: str) -> bool:
    """Whether a text is null or a whole number of 64 bits, in ASCII digits."""
    return text == "null" or bool(re.fullmatch(r"-?[0-9]{1,19}", text)) and -(1 << 63) <= int(text) < 1 << 63


def _one(data: bytes, at: int) -> Record:
    """The record at `at`, compressed or not."""
    if data[at : at + 3] != MAGIC:
        headers, block, end = parse(data, at)
        return Record(at, end, headers, block)
    inflate = zlib.decompressobj(31)
    raw, feed, size = [], at, 1 << 16
    try:
        while not inflate.eof and feed < len(data):
            raw.append(inflate.decompress(data[feed : feed + size]))
            feed += size
    except zlib.error as e:
        raise ValueError("gzip member") from e
    if not inflate.eof:
        raise ValueError("gzip member cut short")
    whole = b"".join(raw)
    headers, block, end = parse(whole)
    if end != len(whole):
        raise ValueError("content length")
    return Record(at, min(feed, len(data)) - len(inflate.unused_data), headers, block)


_NEXT = re.compile(re.escape(MAGIC) + rb"|WARC/1\.[01]\r\n")


def salvage(data: bytes) -> Salvage:
    """All whole records of an archive, and the byte gaps between them with the first failed check of each."""
    out, at = Salvage(), 0
    fault, lost = "", 0
    while at < len(data):
        try:
            record = _one(data, at)
        except ValueError as e:
            if not fault:
                fault, lost = str(e), at
            found = _NEXT.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if fault:
            out.gaps.append((lost, at, fault))
            fault = ""
        out.records.append(record)
        at = record.end
    if fault:
        out.gaps.append((lost, len(data), fault))
    return out


def _id(text: str | None) -> int | None:
    page = _PAGE.fullmatch(text or "")
    return int(page[1]) if page and page[1] != "null" else None


def plan(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to, revisit. Digests are grouped with partial aggregation; only groups of several rows join back."""
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    small = keyed.select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("digest"), F.octet_length("html").alias("size"))
    groups = (
        small.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null").select("digest", "first_id")
    )
    again = (
        small.where(F.col("size") >= min_bytes).join(groups, "digest")
        .where(F.col("page_id").isNull() | (F.col("page_id") < F.col("first_id")))
        .select("page_id", "digest", F.col("first_id").alias("refers_to"))
        .distinct()
        .select(F.col("page_id").alias("pid"), "digest", "refers_to")
    )
    return (
        keyed.withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
        .join(again.hint("shuffle_hash"), F.col("page_id").eqNullSafe(F.col("pid")) & (F.col("sha") == F.col("digest")), "left")
        .select("page_id", "url", "html", "sha", "refers_to", F.col("digest").isNotNull().alias("revisit"))
    )


def write(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = 4 << 20) -> DataFrame:
    """The archives of `pages`, stored in the shared folder: name, records, data."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        held: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal k
            k += 1
            out = pa.RecordBatch.from_pydict({"name": [f"pages-{task:06d}-{k:05d}.warc.gz"], "records": [len(held)], "data": [b"".join(held)]}, pa.schema([("name", pa.string()), ("records", pa.int64()), ("data", pa.binary())]))
            held.clear()
            return out

        size = 0
        for batch in batches:
            ids, urls, html, shas, refs, revisits = (batch.column(c) for c in ("page_id", "url", "html", "sha", "refers_to", "revisit"))
            for i in range(batch.num_rows):
                digest = base64.b32encode(bytes.fromhex(shas[i].as_py())).decode()
                held.append(member(ids[i].as_py(), urls[i].as_py(), html[i].as_buffer().to_pybytes(), refs[i].as_py(), revisits[i].as_py(), digest=digest))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return cut(plan(pages, min_bytes).mapInArrow(pack, ARCHIVES), "warc", "none")


def _read(archives: DataFrame, schema: str, rows) -> DataFrame:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = rows(batch.column("name")[i].as_py(), salvage(batch.column("data")[i].as_py()))
                if found:
                    yield pa.RecordBatch.from_pylist(found, ARROW[schema])

    return archives.select("name", "data").mapInArrow(go, schema)


ARROW = {
    RECORDS: pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("archive", pa.string()), ("at", pa.int64())]),
    GAPS: pa.schema([("archive", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string())]),
}


def _record_rows(name: str, found: Salvage) -> list[dict]:
    return [
        {
            "page_id": _id(r.headers.get("warc-record-id")),
            "payload_bytes": len(r.payload) if r.headers.get("warc-type") != "revisit" else int(r.headers.get("warc-payload-length", 0)),
            "payload_digest": r.headers.get("warc-payload-digest", "").removeprefix("sha1:"),
            "record_type": r.headers.get("warc-type"),
            "refers_to": _id(r.headers.get("warc-refers-to")),
            "url": r.headers.get("warc-target-uri"),
            "archive": name,
            "at": r.start,
        }
        for r in found.records
    ]


def read(archives: DataFrame) -> DataFrame:
    """One row for each record that can be recovered."""
    return _read(archives, RECORDS, _record_rows)


def gaps(archives: DataFrame) -> DataFrame:
    """The quarantine log: byte ranges of no valid record, and why."""
    return _read(archives, GAPS, lambda name, found: [{"archive": name, "start": a, "end": b, "reason": why} for a, b, why in found.gaps])


SQL = """
WITH sized AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS digest FROM pages),
firsts AS (SELECT digest, max(page_id) AS first_id, count(*) AS n FROM sized GROUP BY digest),
letters AS (
  SELECT digest, list_transform(range(8), lambda i: CAST('0x' || substr(digest, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS five FROM firsts),
named AS (
  SELECT digest, array_to_string(list_transform(five, lambda v: array_to_string(list_transform([32768, 1024, 32, 1], lambda d: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v // d) % 32 + 1 AS BIGINT), 1)), '')), '') AS payload_digest FROM letters)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN n > 1 AND page_id < first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n > 1 AND page_id < first_id THEN first_id END AS refers_to
FROM sized JOIN firsts USING (digest) JOIN named USING (digest)
"""
