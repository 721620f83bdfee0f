"""WARC archives from pages, by way of a converter of legacy ARC archives.

``write_arc`` stores pages as ARC files (one gzip member a record), version 1 and version 2 in turn: version 1 headers are
"URL IP date type length", version 2 headers "URL IP date type status checksum location offset filename length"; the file's own
first record says which.  ``read_arc`` splits records by the declared lengths alone.  ``convert`` turns each ARC file into
a WARC file: record ids are uuid5 of the archive name and offset (the same after a retry), dates become ISO 8601, HTTP
records become ``response`` or ``revisit`` records, digests are computed from the payload.  ``read_warc`` reads files back.

A record of at least ``REVISIT_BYTES`` bytes whose payload an earlier record (smaller page_id) has is a revisit of that one.
Payloads are never shuffled: only (digest, page_id) rows decide, counted with map-side combining, and each archive's name then
gets its own decisions (as many as it has records), so a payload that a third of all pages share costs one row a page.  The task
that converts an archive reads its bytes itself, by name, so that contents are in no join, whatever the input's size.

Files go to the shared folder, written under their final name after a rename, so a task that runs twice leaves one file.
Archives hold at most ``ARCHIVE_BYTES`` of records, headers included, and one more record, which bounds what a task holds; a very
long page is one record of its archive, read whole.

Columns of pages other than page_id, url and html are not read, whatever their names.

Defined results: null html is an empty payload; a null url is stored as "urn:page:<id>", white space in urls is escaped;
rows with a null page_id are stored without one and come back with null page_id, as responses; rows that repeat a page_id are
records of their own (of two equal ones the first by (page_id, archive, offset) is the response); an empty table gives no archives.
"""

from __future__ import annotations

import hashlib
import io
import math
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernspan.session import fits_broadcast, keep, lean, scratch_path, ship

REVISIT_BYTES = 100
ARCHIVE_BYTES = 8 << 20
#: Archives that a converting task takes one after another, where there are more archives than cores.
ARCHIVES_A_TASK = 16
DATE = "20240101000000"
_SPACES = re.compile(r"[\x00-\x20\x7f]")
_ID = re.compile(rb"(?im)^X-Page-Id: (-?\d+)\r$")


class ArchiveError(ValueError):
    pass


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _store(uri: str, data: bytes) -> None:
    fs, path = _filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part, compression=None) as f:
        f.write(data)
    fs.move(part, path)


def _fetch(uri: str) -> bytes:
    fs, path = _filesystem(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member; plain data is one."""
    if data[:2] != b"\x1f\x8b":
        yield 0, data
        return
    view, at = memoryview(data), 0
    while at < len(view):
        d, out, to = zlib.decompressobj(31), [], at
        while not d.eof:  # in small pieces, since what is left of a piece is copied
            piece = view[to : to + 8192]
            if not len(piece):
                raise ArchiveError(f"gzip member at {at} has no end")
            out.append(d.decompress(piece))
            to += len(piece)
        yield at, b"".join(out)
        at = to - len(d.unused_data)


# --- ARC


def arc_head(version: int, name: str) -> bytes:
    fields = "URL IP-address Archive-date Content-type Archive-length" if version == 1 else "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
    body = f"{version} 0 fernspan\n{fields}\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {DATE} text/plain " + (f"{len(body)}\n" if version == 1 else f"200 - - 0 {name} {len(body)}\n")
    return line.encode() + body + b"\n"


def arc_record(version: int, url: str, payload: bytes, page_id: int | None, name: str, offset: int) -> bytes:
    extra = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{extra}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    if version == 1:
        line = f"{url} 0.0.0.0 {DATE} text/html {len(body)}\n"
    else:
        line = f"{url} 0.0.0.0 {DATE} text/html 200 {hashlib.md5(payload).hexdigest()} - {offset} {name} {len(body)}\n"
    return line.encode() + body + b"\n"


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file of either version: offset, url, ip, date, type, and the body by its declared length."""
    version = 0
    for base, content in members(data):
        at = 0
        while at < len(content):
            if content[at : at + 1] == b"\n":  # between records
                at += 1
                continue
            end = content.find(b"\n", at)
            if end < 0:
                raise ArchiveError(f"header line without end at {base + at}")
            parts = content[at:end].decode("utf-8").split(" ")
            if parts[0].startswith("filedesc://"):
                version = int(content[end + 1 : end + 2])
                if version not in (1, 2):
                    raise ArchiveError(f"ARC version {version}")
            if len(parts) != (5 if version == 1 else 10):
                raise ArchiveError(f"{len(parts)} fields in a header of version {version} at {base + at}")
            length = int(parts[-1])
            body = content[end + 1 : end + 1 + length]
            if len(body) != length:
                raise ArchiveError(f"record at {base + at} ends before its declared length")
            yield {"offset": base if at == 0 else base + at, "url": parts[0], "ip": parts[1], "date": parts[2], "type": parts[3], "body": body, "version": version}
            at = end + 1 + length


def _http(body: bytes) -> tuple[bytes, bytes, int | None]:
    """(HTTP head, payload, page_id)"""
    cut = body.find(b"\r\n\r\n")
    if not body.startswith(b"HTTP/") or cut < 0:
        return b"", body, None
    head = body[: cut + 4]
    m = _ID.search(head)
    return head, body[cut + 4 :], int(m[1]) if m else None


# --- WARC


def warc_record(headers: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def record_id(archive: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}>"


def iso(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def to_warc(arc: bytes, name: str, revisits: dict[int, int]) -> bytes:
    """The WARC file equivalent to an ARC file; revisits: offset of a record to the page_id whose payload it repeats."""
    out = io.BytesIO()
    for r in parse_arc(arc):
        head = {"WARC-Record-ID": record_id(name, r["offset"]), "WARC-Date": iso(r["date"])}
        if r["url"].startswith("filedesc://"):
            block = f"software: fernspan\r\nformat: WARC File Format 1.1\r\nconverted-from: ARC/{r['version']}\r\n".encode()
            out.write(_member(warc_record({"WARC-Type": "warcinfo"} | head | {"WARC-Filename": name, "Content-Type": "application/warc-fields"}, block)))
            continue
        http, payload, page_id = _http(r["body"])
        digest = hashlib.sha256(payload).hexdigest()
        head |= {"WARC-Target-URI": r["url"], "WARC-IP-Address": r["ip"], "WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Length": str(len(payload))}
        if page_id is not None:
            head["X-Page-Id"] = str(page_id)
        first = revisits.get(r["offset"])
        if first is None:
            block, kind = http + payload, "response"
        else:
            block, kind = http, "revisit"
            head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page-Id": str(first)}
        if not http:
            kind, mime = "resource", r["type"]
        else:
            mime = "application/http; msgtype=response"
        head |= {"WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type": mime}
        out.write(_member(warc_record({"WARC-Type": kind} | head, block)))
    return out.getvalue()


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record, checked against the digests it declares."""
    for base, content in members(data):
        at = 0
        while at < len(content):
            cut = content.find(b"\r\n\r\n", at)
            lines = content[at:cut].decode("utf-8").split("\r\n")
            if cut < 0 or not lines[0].startswith("WARC/1."):
                raise ArchiveError(f"no WARC record at {base + at}")
            head = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
            n = int(head["content-length"])
            block = content[cut + 4 : cut + 4 + n]
            if content[cut + 4 + n : cut + 8 + n] != b"\r\n\r\n":
                raise ArchiveError(f"record at {base + at} doesn't end where it declares")
            if "warc-block-digest" in head and head["warc-block-digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
                raise ArchiveError(f"block digest of the record at {base + at}")
            yield head, block
            at = cut + 8 + n


# --- Spark


def write_arc(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ARC files of pages (page_id, url, html) below folder; one row for each file: archive."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, names = TaskContext.get().partitionId(), 0, []
        held, size, offset, name, version = [], 0, 0, "", 1

        def close() -> None:
            nonlocal held
            if held:
                _store(f"{folder}/{name}", b"".join(held))
                names.append(name)
                held = []

        for b in batches:
            for page_id, url, html in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                if not held:
                    version = 1 + number % 2
                    name = f"part-{part:06d}-{number:06d}.arc.gz"
                    held.append(_member(arc_head(version, name)))
                    number, size, offset = number + 1, 0, len(held[0])
                target = _SPACES.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
                record = arc_record(version, target, payload, page_id, name, offset)
                held.append(_member(record))
                offset += len(held[-1])
                if (size := size + len(record)) >= ARCHIVE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["archive"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(lean(write), "archive string")


def read_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(archive, content) of the files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            rows = []
            for r in parse_arc(content.as_py()):
                if not r["url"].startswith("filedesc://"):
                    _, payload, page_id = _http(r["body"])
                    rows.append((name, r["offset"], page_id, hashlib.sha256(payload).hexdigest(), len(payload)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["archive", "offset", "page_id", "digest", "size"])


def _convert(arcs: str, warcs: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for name, decided in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                target = name.replace(".arc.gz", ".warc.gz")
                _store(f"{warcs}/{target}", to_warc(_fetch(f"{arcs}/{name}"), target, {x["offset"]: x["first"] for x in decided or []}))
                done.append(target)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["archive"])

    return run


def decide(index: DataFrame) -> DataFrame:
    """(archive, offset, first) of the records that revisit another one's payload."""
    able = index.filter((F.col("size") >= REVISIT_BYTES) & F.col("page_id").isNotNull())
    place = F.struct("page_id", "archive", "offset")
    first = keep(able.groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("at")).filter("n > 1").select("digest", "at"), "warc_first")
    first = F.broadcast(first) if fits_broadcast(first.count(), 192) else first
    again = able.join(first, "digest").filter(place != F.col("at"))
    return again.select("archive", "offset", F.col("at.page_id").alias("first"))


def archive(pages: DataFrame, folder: str) -> str:
    """Writes pages as ARC files, converts these to WARC files, and returns the folder of the WARC files."""
    spark = pages.sparkSession
    ship(spark)
    arcs, warcs = f"{folder}/arc", f"{folder}/warc"
    names = keep(write_arc(pages, arcs), "warc_names")
    if not (n := names.count()):
        return ""
    index = keep(read_files(spark, arcs, ".arc.gz").mapInArrow(lean(_index), "archive string, offset long, page_id long, digest string, size long"), "warc_index")
    decided = keep(decide(index).groupBy("archive").agg(F.collect_list(F.struct("offset", "first")).alias("decided")), "warc_decided")
    tasks = max(min(n, spark.sparkContext.defaultParallelism), math.ceil(n / ARCHIVES_A_TASK))
    files = names.join(decided, "archive", "left").select("archive", "decided").repartition(tasks)
    keep(files.mapInArrow(lean(_convert(arcs, warcs)), "archive string"), "warc_done")
    return warcs


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content in b.column(1):
            rows = []
            for head, block in parse_warc(content.as_py()):
                if head["warc-type"] in ("response", "revisit"):
                    digest, size = head["warc-payload-digest"].removeprefix("sha256:"), int(head["x-payload-length"])
                    if head["warc-type"] == "response":
                        _, payload, _ = _http(block)
                        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != size:
                            raise ArchiveError(f"payload of {head['warc-record-id']}")
                    first = head.get("x-refers-to-page-id")
                    rows.append((int(head["x-page-id"]) if "x-page-id" in head else None, size, digest, head["warc-type"], int(first) if first is not None else None))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def round_trip(pages: DataFrame) -> DataFrame:
    """Per page, from the WARC files read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    folder = archive(pages, scratch_path(spark, "archives"))
    if not folder:
        return spark.createDataFrame([], schema)
    return read_files(spark, folder, ".warc.gz").mapInArrow(lean(_rows), schema)


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first < p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.payload_bytes >= 100 AND p.payload_digest = f.payload_digest
"""
