"""Legacy archive converter: ARC files of either version to WARC, and reading both.

An ARC file begins with a version block, whose second line names the version and whose third names the fields of the
record headers that follow: version 1 has ``URL IP-address Archive-date Content-type Archive-length``, version 2 adds
result code, checksum, location, offset and file name. Records are cut by their declared lengths only, so a payload may
hold anything. For each record a WARC record is synthesised: an identifier that follows from address, date and content,
the date in ISO 8601, the type (warcinfo for the version block, response for HTTP, resource otherwise) and SHA-1
digests of block and payload. Records whose payload of at least ``REVISIT_BYTES`` another one holds with a larger
X-Page-Id become revisits of the one with the largest; shorter payloads are always written out.

A WARC file is what Spark's text writer makes of gzipped records, a member each, with an empty member as the line
separator; a file holds ``RECORDS_A_FILE`` records at most, and fewer where the largest record times their number would
be beyond ``FILE_BYTES``. Files are read back as binary files. Payloads may be any bytes. Parsing never looks past a
declared length. A revisit names the identifier, address and date of the record that it refers to.

Null payloads are empty, null addresses ``-``; white space in an address is percent-encoded. Rows without a page_id
have no X-Page-Id, come back without one, are never revisits and have none. Repeated rows are records of their own. Empty tables give empty archives. Extra columns don't matter, whatever their names.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, schema, slices

REVISIT_BYTES = 1000
#: A file ends at so many records or, in bytes, at about so much; a larger record is a file by itself.
RECORDS_A_FILE = 2000
ARC_RECORDS = 500
FILE_BYTES = 128 << 20
PIECE = 1 << 16
#: As small as level 9 within 0.1 % on the test pages, in three quarters of its time.
LEVEL = 6
#: What ends a WARC record, and a gzip member that holds nothing.
SEPARATOR = b"\r\n\r\n"
NOTHING = gzip.compress(b"", mtime=0)

#: Fixed names of the header fields of ARC records.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
RECORDS = "url string, date string, mime string, http binary, payload binary, page_id long, arc_type string"
WARC = "record_id string, type string, date string, url string, page_id long, payload_bytes long, payload_digest string, refers_to long, payload binary"


def arc_file(records: list[tuple[int | None, str, bytes]], version: int, date: str, name: str) -> bytes:
    """An ARC file of HTTP responses: (page_id, url, payload)."""
    origin = f"{version} {1 if version == 1 else 0} Marlspike\n{ARC_FIELDS[version]}\n".encode()
    out = [_arc_record(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", origin, 0, name)]
    at = len(out[0])
    for page, url, payload in records:
        own = b"" if page is None else b"X-Page-Id: %d\r\n" % page
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n" % (own, len(payload))
        out.append(_arc_record(version, url, "0.0.0.0", date, "text/html", http + payload, at, name))
        at += len(out[-1])
    return b"".join(out)


def _arc_record(version: int, url: str, ip: str, date: str, mime: str, content: bytes, offset: int, name: str) -> bytes:
    more = f" 200 {hashlib.sha1(content).hexdigest()} - {offset} {name}" if version == 2 else ""
    return f"{url} {ip} {date} {mime}{more} {len(content)}\n".encode() + content + b"\n"


def read_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file, gzipped or not; fields by the names that its version block declares."""
    data = inflate(data)
    names: list[str] = ARC_FIELDS[1].split()
    at = 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        values = line.split(" ")
        if line.startswith("filedesc://"):
            names = _declared(data, end + 1, int(values[-1]))
        if len(values) != len(names):
            raise ValueError(f"ARC header with {len(values)} fields, {len(names)} are declared: {line[:200]}")
        record = dict(zip(names, values))
        length = int(record["Archive-length"])
        content = data[end + 1 : end + 1 + length]
        if len(content) != length:
            raise ValueError(f"ARC record of {length} bytes ends after {len(content)}")
        at = end + 1 + length
        yield _arc_parts(record, content)


def _declared(data: bytes, start: int, length: int) -> list[str]:
    """Names from the version block. The block's own header has the same fields."""
    first, second, *_ = data[start : start + length].decode("utf-8", "replace").split("\n")
    names = second.split()
    if not names or names[0] != "URL" or names[-1] != "Archive-length":
        raise ValueError(f"ARC version block {first!r} declares {second!r}")
    return names


def _arc_parts(record: dict[str, str], content: bytes) -> dict:
    url = record["URL"]
    kind = "warcinfo" if url.startswith("filedesc://") else "response" if url.startswith(("http://", "https://")) or content.startswith(b"HTTP/") else "resource"
    http, payload = b"", content
    if kind == "response" and content.startswith(b"HTTP/"):
        head, gap, payload = content.partition(b"\r\n\r\n")
        http = head + gap
    page = re.search(rb"(?im)^X-Page-Id: (-?\d+)", http)
    return {"url": url, "date": iso_date(record["Archive-date"]), "mime": record["Content-type"], "http": http, "payload": payload, "page_id": int(page[1]) if page else None, "arc_type": kind}


def iso_date(digits: str) -> str:
    """ARC's 14 digits, or the first of them, as an ISO 8601 date in UTC; what is left out is the earliest."""
    full = digits + "00000101000000"[len(digits) :]
    return datetime.datetime.strptime(full[:14], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def warc_digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(url: str, date: str, page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {page_id} {digest}')}>"


def warc_record(record: dict, refers_to: int | None) -> bytes:
    """A WARC record up to its closing separator. A revisit keeps the HTTP header, drops the payload and names the record that holds it."""
    payload = record["payload"] or b""
    http = record["http"] or b""
    block = http + (b"" if refers_to is not None else payload)
    kind = "revisit" if refers_to is not None else record["arc_type"]
    digest = warc_digest(payload)
    head = [
        "WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(record['url'], record['date'], record['page_id'], digest)}", f"WARC-Date: {record['date']}", f"WARC-Target-URI: {record['url']}",
        f"WARC-Payload-Digest: {digest}", f"WARC-Block-Digest: {warc_digest(block)}",
        f"Content-Type: {'application/http; msgtype=response' if http else 'application/warc-fields' if kind == 'warcinfo' else record['mime']}",
    ]
    if refers_to is not None:
        there = record_id(record["refers_url"], record["refers_date"], refers_to, digest)
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {there}", f"WARC-Refers-To-Target-URI: {record['refers_url']}", f"WARC-Refers-To-Date: {record['refers_date']}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block


def read_warc(data: bytes) -> Iterator[dict]:
    """Records of a WARC file, gzipped or not, cut by their declared lengths."""
    data = inflate(data)
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record begins with {version[:80]!r}")
        head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        length = int(head["content-length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) != length:
            raise ValueError(f"WARC block of {length} bytes ends after {len(block)}")
        at = end + 4 + length
        http, gap, payload = block.partition(b"\r\n\r\n") if head["content-type"].startswith("application/http") else (b"", b"", block)
        fields = dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:] if b": " in x)
        size = len(payload) if head["warc-type"] != "revisit" else int(fields.get(b"Content-Length", b"0"))
        refers = head.get("x-refers-to-page")
        page = fields.get(b"X-Page-Id")
        yield {
            "record_id": head["warc-record-id"], "type": head["warc-type"], "date": head["warc-date"], "url": head["warc-target-uri"], "page_id": int(page) if page else None,
            "payload_bytes": size, "payload_digest": base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex(), "refers_to": int(refers) if refers else None, "payload": payload,
        }


def inflate(data: bytes) -> bytes:
    """All members of a gzip file, or the data if it is none. Read in pieces that begin small, so that what follows a member isn't copied whole for each."""
    out, at = [], 0
    while data[at : at + 2] == b"\x1f\x8b":
        member, size = zlib.decompressobj(wbits=31), PIECE >> 5
        while not member.eof and at < len(data):
            piece = data[at : at + size]
            size = min(2 * size, PIECE)
            out.append(member.decompress(piece))
            at += len(piece) - len(member.unused_data)
        out.append(member.flush())
    return b"".join(out) if out else data


def arc_files(pages: DataFrame, date: str = "20240131120000") -> DataFrame:
    """Pages as ARC files: name and content. Up to ARC_RECORDS pages of about FILE_BYTES at most are a file, of alternating versions."""

    def run(batches):
        made = 0
        for batch in slices(batches, ARC_RECORDS):
            ids, urls, bodies = (batch.column(c).to_pylist() for c in range(3))
            rows = [(p, re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), u) if u else "-", h or b"") for p, u, h in zip(ids, urls, bodies)]
            for some in _by_bytes(rows, FILE_BYTES):
                made += 1
                name = f"pages-{made:05d}.arc"
                content = arc_file(some, 1 + made % 2, date, name)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.large_binary()).cast(pa.binary())], names=["name", "content"])

    return pages.select(F.col("page_id").cast("long"), "url", F.col("html").cast("binary").alias("html")).mapInArrow(run, schema("name string, content binary"))


def _by_bytes(rows: list[tuple], most: int) -> Iterator[list[tuple]]:
    """The rows in parts whose payloads, the last of each row, are of so many bytes at most, or a single row."""
    part, size = [], 0
    for row in rows:
        if part and size + len(row[-1]) > most:
            yield part
            part, size = [], 0
        part.append(row)
        size += len(row[-1])
    if part:
        yield part


def _batches(rows: list[dict], names: list[str], kinds) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)


def _bounded(records: Iterator[dict], most: int = FILE_BYTES // 8) -> Iterator[list[dict]]:
    """Up to 200 records, or as few as have the bytes."""
    rows, size = [], 0
    for record in records:
        rows.append(record)
        size += len(record["payload"])
        if len(rows) == 200 or size > most:
            yield rows
            rows, size = [], 0
    yield rows


_ARC_KINDS = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.string())
_WARC_KINDS = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())


def arc_records(files: DataFrame) -> DataFrame:
    """Records of the ARC files in ``content``."""
    names = schema(RECORDS).fieldNames()

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                for rows in _bounded(read_arc(content.as_py() or b"")):
                    yield _batches(rows, names, _ARC_KINDS)

    return files.select("content").mapInArrow(run, schema(RECORDS))


def to_warc(records: DataFrame, path: str, scratch: Scratch, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Write ARC records as WARC files: a gzip member per record, as readers that seek by record expect, and an empty one between two."""
    long_ = (F.octet_length("payload") >= revisit_bytes) & (F.col("arc_type") == "response") & F.col("page_id").isNotNull()
    digest = F.sha1("payload")
    sizes = scratch.keep(records.select(F.when(long_, digest).alias("digest"), "page_id", "url", "date", (F.octet_length("payload") + F.octet_length("http")).alias("bytes")), "sizes")
    a_file = max(1, min(RECORDS_A_FILE, FILE_BYTES // (sizes.agg(F.max("bytes")).first()[0] or 1)))
    copies = sizes.where("digest IS NOT NULL").groupBy("digest").agg(F.max(F.struct("page_id", "url", "date")).alias("last"), F.count("*").alias("many")).where("many > 1").select("digest", "last")
    refers = F.when(F.col("last.page_id") > F.col("page_id"), F.col("last"))
    joined = records.where(long_).withColumn("digest", digest).join(copies, "digest", "left").withColumn("refers", refers).drop("digest", "last")
    short = records.where(~F.coalesce(long_, F.lit(False)))  # goes round the join
    placed = joined.unionByName(short.withColumn("refers", F.lit(None).cast("struct<page_id:bigint,url:string,date:string>")))
    placed = placed.select("*", F.col("refers.page_id").alias("refers_to"), F.col("refers.url").alias("refers_url"), F.col("refers.date").alias("refers_date"))
    names = [*schema(RECORDS).fieldNames(), "refers_to", "refers_url", "refers_date"]

    def run(batches):
        any_bytes = pc.CastOptions(target_type=pa.string(), allow_invalid_utf8=True)
        for batch in slices(batches, 200):
            rows = batch.to_pylist()
            raw = pa.array([gzip.compress(warc_record(r, r["refers_to"]) + SEPARATOR, LEVEL, mtime=0) for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([raw.cast(options=any_bytes)], names=["value"])

    placed.select(*names).mapInArrow(run, schema("value string")).write.option("encoding", "ISO-8859-1").option("lineSep", NOTHING.decode("latin-1")).option("maxRecordsPerFile", a_file).text(path)


def warc_records(files: DataFrame) -> DataFrame:
    """Records of the WARC files in ``content``, as spark.read.format("binaryFile") gives them."""
    names = schema(WARC).fieldNames()

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                for rows in _bounded(read_warc(content.as_py() or b"")):
                    yield _batches(rows, names, _WARC_KINDS)

    return files.select("content").mapInArrow(run, schema(WARC))


def convert(files: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """ARC files to WARC files in the shared folder, read back."""
    scratch = Scratch(files.sparkSession, "archives")
    path = scratch.path("warc")
    to_warc(arc_records(files), path, scratch, revisit_bytes)
    return warc_records(files.sparkSession.read.format("binaryFile").load(path))
