"""Legacy archive converter: ARC files to WARC files.

An ARC file begins with a version block (``filedesc://``) that names the version and the fields of its header lines.
Version 1 lines have URL, IP address, date, type and length; version 2 lines have five more fields before the length.
Records are found by the declared lengths. For each one the converter makes up what WARC asks for: an identifier, an
ISO timestamp, a record type and digests; of equal payloads of at least 100 bytes only one keeps its block, the others
become ``revisit`` records.

Archives are text files of Spark's own writer with gzip (a record may hold any bytes; a cast from binary to string
leaves them alone), so they go to whatever store the shared folder is in; they are read by the binaryFile source.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_REVISIT, ARCHIVE_BYTES = 100, 16 << 20
DATE = "20260101000000"
V1 = ("url", "ip", "date", "type", "length")
V2 = ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length")
RECORD = "archive string, at long, version int, url string, ip string, date string, mime string, page_id long, http boolean, block binary, payload_bytes long, payload_digest string"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---- ARC -------------------------------------------------------------------------------------------------------------


def version_block(name: str, version: int = 1) -> bytes:
    fields = b"URL IP-address Archive-date Content-type Archive-length" if version == 1 else b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
    body = b"%d 0 tonearm\n%s\n" % (version, fields)
    line = f"filedesc://{name} 0.0.0.0 {DATE} text/plain" + (f" 200 - - 0 {name}" if version == 2 else "")
    return line.encode() + b" %d\n" % len(body) + body


def header_line(url: str, mime: str, length: int, version: int = 1, ip: str = "0.0.0.0", date: str = DATE) -> bytes:
    """A header line; white space and control characters of the URL are percent-encoded, as the line's fields need."""
    url = "".join(c if c > " " and c != "\x7f" and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in url) or "urn:none"
    return f"{url} {ip} {date} {mime}".encode() + (b" 200 - - 0 -" if version == 2 else b"") + b" %d\n" % length


def arc_records(data: bytes) -> Iterator[tuple[int, int, dict, bytes]]:
    """Offset, version, header fields and content of each record, by declared lengths. A broken archive is an error."""
    version, at = 1, 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].rstrip(b"\r")
        if line.startswith(b"filedesc://"):
            names = V1 if line.count(b" ") == 4 else V2
        else:
            names = V1 if version == 1 else V2
        parts = line.rsplit(b" ", len(names) - 1)
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"no header line of version {version} at byte {at}")
        fields = {k: v.decode("utf-8", "replace") for k, v in zip(names, parts, strict=True)}
        content = data[end + 1 : end + 1 + int(fields["length"])]
        if len(content) != int(fields["length"]):
            raise ValueError(f"the record at byte {at} is cut short")
        if line.startswith(b"filedesc://"):
            version = int(content.split(b" ", 1)[0])
        yield at, version, fields, content
        at = end + 1 + len(content)


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header (with its blank line) and payload; without such a header all is payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    m = re.search(rb"\r?\n\r?\n", block)
    return (block[: m.end()], block[m.end() :]) if m else (block, b"")


def write_arc(pages: DataFrame, path: str, version: int = 1) -> None:
    """Write pages (page_id, url, payload binary; null: empty) as ARC files. The page_id travels as an HTTP header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for key, url, payload in zip(*(batch.column(c) for c in ("page_id", "url", "payload")), strict=True):
                if not held:
                    held = [version_block(f"tonearm-{part:06d}-{made:06d}.arc", version)]
                body = payload.as_py() or b""
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"X-Page-Id: %d\r\n" % key.as_py() if key.is_valid else b"") + b"Content-Length: %d\r\n\r\n" % len(body) + body
                held.append(header_line(url.as_py() or "", "text/html", len(block), version) + block)
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield one(b"\n".join(held))
                    held, size, made = [], 0, made + 1
        if held:
            yield one(b"\n".join(held))

    write_archives(pages.select("page_id", "url", "payload").mapInArrow(run, "value binary"), path, "\n")


def one(archive: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], names=["value"])


def write_archives(rows: DataFrame, path: str, end: str) -> None:
    """A file for each row: an archive of about ARCHIVE_BYTES, gathered where its records are, without a shuffle."""
    rows.select(F.col("value").cast("string").alias("value")).write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("lineSep", end).option("maxRecordsPerFile", 1).text(path)


def unzipped(data: bytes) -> bytes:
    """All members of a gzip file; other data as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        data = d.unused_data
    return b"".join(out)


def page_id(head: bytes) -> int | None:
    key = re.search(rb"(?im)^X-Page-Id: (-?\d+)\r?$", head)
    return int(key[1]) if key else None


def read_arc(spark: SparkSession, path: str, heads: bool = False) -> DataFrame:
    """The records of all ARC files at path, without their version blocks. heads: blocks are empty."""
    names = RECORD.replace(",", "").split()[::2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, held = [], 0
                for at, version, f, block in arc_records(unzipped(data.as_py())):
                    if f["url"].startswith("filedesc://"):
                        continue
                    head, payload = split_http(block)
                    rows.append((file.as_py(), at, version, f["url"], f["ip"], f["date"], f["type"], page_id(head), bool(head), b"" if heads else block, len(payload), hashlib.sha256(payload).hexdigest()))
                    held += 200 if heads else len(block)
                    if held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
        types = RECORD.replace(",", "").split()[1::2]
        columns = zip(*rows, strict=True) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, t in zip(columns, types, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORD)


# ---- WARC ------------------------------------------------------------------------------------------------------------


def record_id(page_id: int | None, url: str, date: str, digest: str) -> str:
    """A version 8 UUID: the page_id's 64 bits and 58 bits of a hash; without a page_id, hash bits only."""
    h = int.from_bytes(hashlib.sha256(f"{url} {date} {digest}".encode()).digest(), "big")
    key = (page_id & (2**64 - 1)) if page_id is not None else h >> 190 & (2**64 - 1)
    a, rest = key >> 16, key & 0xFFFF
    x = (a << 80) | (0x8 << 76) | ((rest >> 4) << 64) | (0b10 << 62) | ((rest & 0xF) << 58) | ((h & (2**57 - 1)) << 1) | (page_id is not None)
    s = f"{x:032x}"
    return f"<urn:uuid:{s[:8]}-{s[8:12]}-{s[12:16]}-{s[16:20]}-{s[20:]}>"


def page_of(uri: str) -> int | None:
    """The page_id in an identifier made by record_id."""
    x = int(uri.strip("<>").removeprefix("urn:uuid:").replace("-", ""), 16)
    if not x & 1:
        return None
    key = (x >> 80) << 16 | (x >> 64 & 0xFFF) << 4 | (x >> 58 & 0xF)
    return key - 2**64 if key >= 2**63 else key


def iso(date: str) -> str:
    d = (date + "00000101000000"[len(date) :])[:14] if len(date) < 14 else date[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(kind: str, uri: str, date: str, url: str, ip: str, block: bytes, digest: str, mime: str, more: tuple[str, ...] = ()) -> bytes:
    """Header and block, without the two line ends after it."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {uri}", f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-IP-Address: {ip}", f"Content-Type: {mime}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", *more, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block


def converted(data: bytes, revisits: dict[int, dict]) -> Iterator[bytes]:
    """The WARC archives (about ARCHIVE_BYTES each) of one ARC archive; revisits: the records, by offset, whose payload another one keeps."""
    held: list[bytes] = []
    size = 0
    for at, _, f, block in arc_records(data):
        if f["url"].startswith("filedesc://"):
            continue
        if not held:
            body = b"software: tonearm\r\nformat: WARC File Format 1.1\r\n"
            of = hashlib.sha256(body).hexdigest()
            held = [warc_record("warcinfo", record_id(None, "warcinfo", DATE, of), iso(DATE), "urn:tonearm", "0.0.0.0", body, of, "application/warc-fields")]
        head, payload = split_http(block)
        digest = hashlib.sha256(payload).hexdigest()
        kind, mime, more = ("response", "application/http; msgtype=response", ()) if head else ("resource", f["type"], ())
        first = revisits.get(at)
        if first is not None:
            to = record_id(first["page_id"], first["url"], first["date"], digest)
            kind, block = "revisit", head
            more = (f"WARC-Refers-To: {to}", f"WARC-Refers-To-Target-URI: {first['url']}", f"WARC-Refers-To-Date: {iso(first['date'])}", f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Full-Payload-Length: {len(payload)}")
        held.append(warc_record(kind, record_id(page_id(head), f["url"], f["date"], digest), iso(f["date"]), f["url"], f["ip"], block, digest, mime, more))
        size += len(held[-1])
        if size >= ARCHIVE_BYTES:
            yield b"\r\n\r\n".join(held)
            held, size = [], 0
    if held:
        yield b"\r\n\r\n".join(held)


def convert(spark: SparkSession, arc: str, warc: str, least: int = LEAST_REVISIT) -> None:
    """ARC files at arc to WARC files at warc, archive by archive.

    Of records with equal payloads of at least `least` bytes, the one with the smallest page_id (then archive and
    offset; null page_ids last) is the response, others revisit it. Only heads (digest, key, place) are shuffled for
    that. The records that revisit are sent back as one list for each archive that has some, which meets its archive,
    compressed as it is; payloads aren't shuffled.
    """
    from .common import drop_saved, saved

    place = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "archive", "at", "url", "date")
    heads = saved(read_arc(spark, arc, heads=True).where(F.col("payload_bytes") >= least).select("payload_digest", place.alias("place")), "arc-heads")
    shared = heads.groupBy("payload_digest").agg(F.min("place").alias("best"), F.count("*").alias("n")).where("n > 1").drop("n")
    other = (F.col("place.archive") != F.col("best.archive")) | (F.col("place.at") != F.col("best.at"))
    again = heads.join(shared, "payload_digest").where(other).select(F.col("place.archive").alias("archive"), F.struct("place.at", "best.page_id", "best.url", "best.date").alias("r"))
    lists = saved(again.groupBy("archive").agg(F.collect_list("r").alias("revisits")), "revisits")  # an archive's records: bounded by its size
    drop_saved(heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, own = (batch.column(c)[i].as_py() for c in ("content", "revisits"))
                for archive in converted(unzipped(data), {r["at"]: r for r in own or ()}):
                    yield one(archive)

    files = spark.read.format("binaryFile").load(arc).select("path", "content")
    met = files.join(lists, files["path"] == lists["archive"], "left").select("content", "revisits")
    write_archives(met.mapInArrow(run, "value binary"), warc, "\r\n\r\n")


WARC = "warc_type string, record_id string, date string, url string, page_id long, payload_bytes long, payload_digest string, refers_to string, refers_to_page long"


def warc_records(data: bytes) -> Iterator[tuple[dict, bytes]]:
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.decode().lower(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:])}
        block = data[end + 4 : end + 4 + int(head["content-length"])]
        if data[end + 4 + len(block) : end + 8 + len(block)] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} has another length than it declares")
        yield head, block
        at = end + 8 + len(block)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record but warcinfo, its digests checked against the bytes read."""
    names, types = WARC.replace(",", "").split()[::2], WARC.replace(",", "").split()[1::2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows = []
                for h, block in warc_records(unzipped(data.as_py())):
                    if h["warc-type"] == "warcinfo":
                        continue
                    if h["warc-block-digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
                        raise ValueError(f"{h['warc-record-id']}: its block is not the one that was written")
                    digest = h["warc-payload-digest"].removeprefix("sha256:")
                    head, payload = split_http(block)
                    size = int(h.get("warc-full-payload-length", len(payload)))
                    if h["warc-type"] != "revisit" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{h['warc-record-id']}: its payload has another digest")
                    to = h.get("warc-refers-to")
                    rows.append((h["warc-type"], h["warc-record-id"], h["warc-date"], h["warc-target-uri"], page_of(h["warc-record-id"]), size, digest, to, page_of(to) if to else None))
                columns = zip(*rows, strict=True) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64() if t == "long" else pa.string()) for c, t in zip(columns, types, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, WARC)


def archived(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Write pages (page_id, url, html) as ARC files, convert these to WARC files and read the WARC records back.

    A null html is an empty payload; a null url becomes ``urn:none``. Records without a page_id have none afterwards.
    Rows that repeat a page_id are records of their own: of those with equal payloads one is the response. A very long
    payload is written whole, in an archive that is as much longer; a task holds one archive. An empty table gives no
    archives and an empty result. Extra columns are not read.
    """
    from .common import new_path

    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    write_arc(rows, arc)
    convert(spark, arc, warc, least)
    return read_warc(spark, warc)
