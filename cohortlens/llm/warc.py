"""Conversion of legacy ARC archives to WARC, written and read through Spark.

``read_arc`` parses ARC files of either version: a version block, then for each record one header line (5 fields in version 1, 10 in
version 2, parsed from the right because the address comes first) whose last field is the declared length of the document that
follows. ``convert`` synthesises for each record its WARC equivalent: identifier, ISO timestamp, type, payload and block digests, lengths. The
version block becomes a warcinfo record, an HTTP message a response or revisit, anything else (dns:, plain documents) a resource.
``pages_to_warc`` writes a table of pages as ARC files of both versions first, and converts those.

A record is known by its key, where an exporter left one in the message's X-Archive-Key header and the archives are said to be
keyed, else by its date and place (file and byte). An identifier is a UUID (version 8): 57 bits of the payload digest, a bit
that says whether the rest is a key, and the key in 64 bits (two's complement) or as many bits of the place's hash. So a revisit can name its
response without a table, and a reader finds the key.

All content is bytes, whatever its character set. Every WARC record is a gzip member of its own, so that readers can seek to it. Files are
written by Spark's text writer, which separates rows by one byte: the last of a member's trailer, which is 0 (the length of a record under 16
MB; a longer one gets an empty member behind it), is left to it. Any file system that Spark reaches will do, and a lost task is just run again.
Files are read as binaries, of FILE_BYTES or so where this module writes them, and cut by declared lengths, never by searching for separators.

Deduplication: of HTTP messages with equal payloads of at least ``MIN_DUPLICATE`` bytes the one with the smallest key (else the first by date and
place) is the response, the others are revisits without payload. Found by one aggregation over digests with partial sums; each archive is
converted where it lies, beside the broadcast revisits, or after a join by shuffle where these are too many.

Defined results. Null html: empty payload. Null or odd url: "about:blank", white space percent-encoded. A row without
page_id is a record without key, never the smallest: a revisit of the smallest key with its payload, a response if there is none.
Rows repeated with one page_id are all written, each as response if that page_id is the smallest. Empty tables, folders and files give no rows.
An archive that is cut short, or of an unknown version, is an error that names the byte.
"""

from __future__ import annotations

import gzip
import hashlib
import itertools
import re
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, broadcast_if_small, materialize, new_path, scratch

MIN_DUPLICATE = 100
SALTS = 32
#: Payload bytes of an archive that is written here, about.
FILE_BYTES = 64 << 20
#: How hard records are compressed, and legacy ones that this module exports; bytes that are decompressed at a time.
LEVEL, LEGACY_LEVEL = 4, 1
STEP = 8192
TERMINATOR = b"\r\n\r\n"
VERSION_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def http_message(key: int | None, payload: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Archive-Key: {'-' if key is None else key}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def arc_lines(records, version: int):
    """The version block, then each of records (url, ip, 14-digit date, content type, document) with its header line; a line break follows each."""
    about = f"{version} 0 legacy\n{VERSION_FIELDS[version]}\n".encode()
    extra = " 200 - - 0 -" if version == 2 else ""
    head = f"filedesc://export.arc 0.0.0.0 20000101000000 text/plain{extra} {len(about)}\n".encode() + about
    at = len(head) + 1
    yield head
    for url, ip, date, kind, doc in records:
        mark = f" 200 {zlib.crc32(doc):08x} - {at} export.arc" if version == 2 else ""
        line = f"{url} {ip} {date} {kind}{mark} {len(doc)}\n".encode() + doc
        at += len(line) + 1
        yield line


def build_arc(records, version: int) -> bytes:
    return b"\n".join(arc_lines(records, version))


def parse_arc(data: bytes):
    """Yields (url, ip, date, content type, document) of the records of an ARC file behind its version block."""
    for k, record in enumerate(arc_records(data)):
        if k:
            yield record[1:]


def arc_records(data: bytes):
    """Yields (byte, url, ip, date, content type, document) of every record of an ARC file, its version block first."""
    at, fields = 0, 0
    while at < len(data):
        if data[at:at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at:end if end >= 0 else len(data)].rstrip(b"\r").decode("utf-8", "replace")
        parts = line.rsplit(" ", fields - 1 if fields else 1)
        if end < 0 or len(parts) < 2 or fields and len(parts) != fields or not parts[-1].isdigit():
            raise ValueError(f"bad ARC header line at byte {at}")
        size = int(parts[-1])
        doc = data[end + 1:end + 1 + size]
        if len(doc) < size:
            raise ValueError(f"ARC record at byte {at} is cut short")
        if not fields:
            version = doc.split(b"\n", 1)[0].split(b" ", 1)[0]
            if not version.isdigit() or int(version) not in VERSION_FIELDS:
                raise ValueError(f"unknown ARC version {version[:20]!r} at byte {at}")
            fields = len(VERSION_FIELDS[int(version)].split())
            parts = line.rsplit(" ", fields - 1)  # the block's own line has the fields that it declares
            if len(parts) != fields:
                raise ValueError(f"bad ARC header line at byte {at}")
        yield at, parts[0], parts[1], parts[2], parts[3], doc
        at = end + 1 + size


def split_http(doc: bytes) -> tuple[bytes, bytes] | None:
    """(head with its blank line, payload) of an HTTP message; None for other documents."""
    if not doc.startswith(b"HTTP/"):
        return None
    end = re.search(rb"\r?\n\r?\n", doc)
    return (doc[:end.end()], doc[end.end():]) if end else (doc, b"")


def key_in(head: bytes) -> int | None:
    found = re.search(rb"(?im)^X-Archive-Key: (-?\d{1,20})\r?$", head)
    key = int(found[1]) if found else None
    return key if key is not None and -(1 << 63) <= key < 1 << 63 else None


def _identifier(digest: str, is_key: bool, low: int) -> str:
    free = int(digest[:15], 16) >> 3 << 65 | is_key << 64 | low & (1 << 64) - 1  # 122 bits
    x = f"{free >> 74:012x}8{free >> 62 & 0xFFF:03x}{2 << 62 | free & (1 << 62) - 1:016x}"
    return f"<urn:uuid:{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}>"


def record_id(digest: str, key: int | str | None) -> str:
    """The identifier of a record with this payload digest and key, or date and place."""
    if isinstance(key, str):
        return _identifier(digest, False, int.from_bytes(hashlib.sha256(key.encode()).digest()[:8], "big"))
    return _identifier(digest, key is not None, key or 0)


def key_of(identifier: str) -> int | None:
    x = identifier.strip("<>").rsplit(":", 1)[1].replace("-", "")
    free = int(x[:12], 16) << 74 | int(x[13:16], 16) << 62 | int(x[16:], 16) & (1 << 62) - 1
    key = free & (1 << 64) - 1
    return (key - (1 << 64) if key >> 63 else key) if free >> 64 & 1 else None


def timestamp(date: str) -> str:
    """An ISO time of up to 14 digits; what is missing is the first month, day, hour."""
    if not re.fullmatch(r"\d{4,17}", date):
        raise ValueError(f"no ARC date: {date}")
    d = date[:14] + "00000101000000"[len(date[:14]):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def to_warc(record, key: int | str | None = None, refers_to: int | str | None = None) -> bytes:
    """The WARC record, with its terminator, of an ARC record (url, ip, date, content type, document); a revisit if it refers to another."""
    url, ip, date, kind, doc = record
    http, block, more = split_http(doc), doc, []
    payload = http[1] if http else doc
    digest = hashlib.sha256(payload).hexdigest()
    if url.lower().startswith("filedesc:"):
        name, content = "warcinfo", "text/plain"
        more.append(f"WARC-Filename: {url.partition('://')[2] or url}")
    elif http:
        name, content = "response" if refers_to is None else "revisit", "application/http;msgtype=response"
    else:
        name, content = "resource", kind if "/" in kind else "application/octet-stream"
    if name != "warcinfo":
        more += [f"WARC-Target-URI: {url}", f"WARC-IP-Address: {ip}", f"WARC-Payload-Digest: sha256:{digest}"]
    if name == "revisit":
        block = http[0]
        more += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(digest, refers_to)}", f"X-Payload-Length: {len(payload)}"]
    lines = [
        "WARC/1.1", f"WARC-Type: {name}", f"WARC-Record-ID: {record_id(digest, key)}", f"WARC-Date: {timestamp(date)}", f"Content-Type: {content}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", *more, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + TERMINATOR + block + TERMINATOR


def parse_warc(data: bytes):
    """Yields (headers, block) of each record, checking the block's digest."""
    at = 0
    while at < len(data):
        end = data.index(TERMINATOR, at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        block = data[end + 4:end + 4 + size]
        if "sha256:" + hashlib.sha256(block).hexdigest() != head["WARC-Block-Digest"]:
            raise ValueError(f"damaged WARC record at byte {at}")
        yield head, block
        at = end + 4 + size + len(TERMINATOR)


def members(data: bytes):
    """The content of each gzip member of data, empty ones left out; data itself if it is not compressed."""
    if data[:2] != b"\x1f\x8b":
        if data:
            yield data
        return
    view, at = memoryview(data), 0
    while data[at:at + 2] == b"\x1f\x8b":
        one, content = zlib.decompressobj(31), []
        while not one.eof:
            part = view[at:at + STEP]  # what follows a member is copied, so little at a time
            if not part:
                raise ValueError("an archive is cut short")
            content.append(one.decompress(part))
            at += len(part) - len(one.unused_data)
        if any(content):
            yield b"".join(content)


def mark_revisits(slim: DataFrame) -> DataFrame:
    """slim: key, digest, n_bytes. The rows that revisit another: key, digest, refers_to (once each)."""
    large = slim.where(F.col("n_bytes") >= MIN_DUPLICATE)
    other = F.col("key").isNull() | (F.col("key") > F.col("refers_to"))
    first = large.groupBy("digest").agg(F.min("key").alias("refers_to"), F.max("key").alias("last"), F.count_if(F.col("key").isNull()).alias("nameless"))
    first = materialize(first.where("last > refers_to or (nameless > 0 and refers_to is not null)").select("digest", "refers_to"), "warc-first")
    n, keys = first.count(), ["digest"]
    if n > BROADCAST_ROWS:
        first, keys = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["digest", "salt"]
        large = large.withColumn("salt", F.pmod(F.hash("key"), F.lit(SALTS)))
    return large.join(broadcast_if_small(first, n), keys).where(other).select("key", "digest", "refers_to").distinct()


ARC = {"url": pa.string(), "ip": pa.string(), "date": pa.string(), "kind": pa.string(), "doc": pa.binary()}


def _read_arc(keyed: bool, bodies: bool):
    """Files (path, content) -> key, digest and n_bytes of the payload (HTTP messages only), and with bodies the columns of ARC."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                name, rows, size = path.rsplit("/", 1)[-1], [], 0
                for at, url, ip, date, kind, doc in arc_records(b"".join(members(content.as_buffer().to_pybytes()))):
                    http = split_http(doc)
                    key = (key_in(http[0]) if http else None) if keyed else f"{date:<14} {name} {at:015d}"
                    rows.append((key, hashlib.sha256(http[1]).hexdigest() if http else None, len(http[1]) if http else None, url, ip, date, kind, doc if bodies else b""))
                    size += len(doc)
                    if size > 8 << 20 or len(rows) >= 2000:
                        yield _arc_batch(rows, keyed, bodies)
                        rows, size = [], 0
                if rows:
                    yield _arc_batch(rows, keyed, bodies)

    return run


def _arc_batch(rows, keyed: bool, bodies: bool):
    kinds = {"key": pa.int64() if keyed else pa.string(), "digest": pa.string(), "n_bytes": pa.int64(), **(ARC if bodies else {})}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], list(kinds))


def read_arc(spark, path: str, keyed: bool = False, bodies: bool = True) -> DataFrame:
    """key, digest, n_bytes and url, ip, date, kind, doc of the records of the ARC files (plain or gzip) below path. key: the exporter's
    if keyed, else date and place as text that sorts by them."""
    schema = f"key {'long' if keyed else 'string'}, digest string, n_bytes long" + (", url string, ip string, date string, kind string, doc binary" if bodies else "")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(_read_arc(keyed, bodies), schema)


def member(record: bytes, level: int = LEVEL) -> bytes:
    """record as a gzip member without its last byte, which is 0."""
    data = gzip.compress(record, level, mtime=0)
    if data[-1]:
        data += gzip.compress(b"", mtime=0)
    return data[:-1]


def _convert(batches):
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("url", "ip", "date", "kind", "doc", "key", "refers_to")]
        yield pa.RecordBatch.from_arrays([pa.array([member(to_warc(r[:5], r[5], r[6])) for r in zip(*cols)], pa.binary())], ["value"])


def _write(rows: DataFrame, path: str) -> None:
    """Members without their last byte as files: text is written as the bytes that it is, and the byte between."""
    rows.select(F.col("value").cast("string")).write.option("lineSep", "\x00").text(path)


def convert(spark, arc_path: str, warc_path: str, keyed: bool = False) -> None:
    """Convert the ARC files below arc_path to WARC files below warc_path, one for one while revisits are few."""
    with scratch(spark):
        slim = read_arc(spark, arc_path, keyed, bodies=False).where("digest is not null")
        marks = materialize(mark_revisits(slim), "warc-revisits")
        n = marks.count()
        of = marks.select(F.col("key").alias("k"), F.col("digest").alias("d"), "refers_to")
        records = read_arc(spark, arc_path, keyed)
        both = records.join(broadcast_if_small(of, n), F.equal_null("key", "k") & (F.col("digest") == F.col("d")), "left").drop("k", "d")
        _write(both.mapInArrow(_convert, "value binary"), warc_path)


def _export(batches):
    """Pages as the rows of one ARC file for each task, of version 1 or 2 in turn."""
    from pyspark import TaskContext

    def records():
        for batch in batches:
            for key, url, html in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html")):
                place = quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%~")
                seconds = (key or 0) % 86_400
                yield place, "192.0.2.1", f"20000101{seconds // 3600:02d}{seconds // 60 % 60:02d}{seconds % 60:02d}", "text/html", http_message(key, html.as_py() or b"")

    rows, every = [], records()
    first = next(every, None)
    if first is None:
        return
    for line in arc_lines(itertools.chain([first], every), TaskContext.get().partitionId() % 2 + 1):
        rows.append(member(line + b"\n", LEGACY_LEVEL))
        if len(rows) >= 500:
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])
            rows = []
    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])


def export_arc(pages: DataFrame, path: str) -> None:
    """pages (page_id, url, html) as ARC files. Rows stay where they lie unless that makes files too large."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("html"))
    total = rows.agg(F.sum(F.coalesce(F.length("html"), F.lit(0)) + 1024)).first()[0] or 0
    files = -(-total // FILE_BYTES)
    rows = rows.repartition(files) if files > rows.rdd.getNumPartitions() else rows
    _write(rows.mapInArrow(_export, "value binary"), path)


def pages_to_warc(pages: DataFrame, path: str) -> None:
    """Write each row of pages (page_id, url, html) as an ARC record, and convert these archives to WARC files at path."""
    spark = pages.sparkSession
    legacy = new_path(spark, "arc")
    export_arc(pages, legacy)
    convert(spark, legacy, path, keyed=True)


def _read(batches):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "date", "record_id", "refers_to_id", "content_type"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * 5]
    for batch in batches:
        for content in batch.column("content"):
            cols: list[list] = [[] for _ in names]
            for content_ in members(content.as_buffer().to_pybytes()):
                for head, block in parse_warc(content_):
                    kind, refers = head["WARC-Type"], head.get("WARC-Refers-To")
                    http = split_http(block) if head["Content-Type"].startswith("application/http") else None
                    payload = http[1] if http else block
                    size = int(head["X-Payload-Length"]) if kind == "revisit" else len(payload)
                    digest = head.get("WARC-Payload-Digest", "").partition(":")[2] or None
                    if kind in ("response", "resource") and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"damaged payload in {head['WARC-Record-ID']}")
                    row = (key_of(head["WARC-Record-ID"]), size, digest, kind, key_of(refers) if refers else None, head.get("WARC-Target-URI"), head["WARC-Date"], head["WARC-Record-ID"], refers, head["Content-Type"])
                    for col, v in zip(cols, row):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def read_warc(spark, path: str, info: bool = False) -> DataFrame:
    """page_id (the key, if the record has one), payload_bytes, payload_digest, record_type, refers_to, url, date, record_id, refers_to_id and
    content_type of each record below path; warcinfo records only if info."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, date string, record_id string, refers_to_id string, content_type string"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(_read, schema).where(F.lit(info) | (F.col("record_type") != "warcinfo"))


def op6_arc_to_warc(spark, sf_dir):
    path = new_path(spark, "warc")
    pages_to_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to FROM f
"""
