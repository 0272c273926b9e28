"""WARC records in ZIP-packaged archives: a writer, and a reader that never extracts.

An archive is a ZIP file whose members are stored, not deflated: `archive/data.warc.gz` (one
gzip member per record), `indexes/index.cdxj` (for each record the file, offset and length)
and `datapackage.json`. The reader finds the end-of-central-directory record from the file's
tail (ZIP64 if its fields are full), parses the central directory, skips each member's local
header, and reads single records by range from offset and length of the index.

Distribution: tasks write archives of about ARCHIVE_BYTES to the shared folder under names of
their own and return the paths; that list is written down before anything reads it, so a
task that runs again leaves a file nobody refers to, never a half-written one that is read.
Archives are read back in parallel, one at a time in a task.

Defined results: a null payload is empty. Of records with equal payloads of at least
REVISIT_BYTES bytes the one with the largest page_id is the response (rows that repeat
page_id and payload are all responses), others revisit it. Null ids and urls survive the
round trip. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import durable, in_arrow, new_folder, text_of

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 32 << 20
#: Fixed value: the date of all records, as the tables hold none.
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the ZIP format: signatures and record layouts.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_LOCAL = struct.Struct("<4sHHHHHIIIHH")
_CENTRAL = struct.Struct("<4sHHHHHHIIIHHHHHII")
_END = struct.Struct("<4sHHHHIIH")
_END64 = struct.Struct("<4sQHHIIQQQQ")
_LOCATOR64 = struct.Struct("<4sIQI")
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


@dataclass(frozen=True)
class Member:
    """A ZIP member: where its local header stands and how it is kept."""

    name: str
    method: int
    header: int
    packed: int
    size: int
    crc: int


class ZipWriter:
    """Stored members, one after the other; ZIP64 fields where a number needs them, or everywhere if forced."""

    def __init__(self, out, force64: bool = False):
        self.out, self.force64, self.at, self.members = out, force64, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, parts: list[bytes]) -> None:
        size, crc = sum(map(len, parts)), 0
        for part in parts:
            crc = zlib.crc32(part, crc)
        raw, wide = name.encode(), self.force64 or size >= _FULL32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        shown = _FULL32 if wide else size
        self.members.append(Member(name, 0, self.at, size, size, crc))
        self._put(_LOCAL.pack(LOCAL, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, shown, shown, len(raw), len(extra)) + raw + extra)
        for part in parts:
            self._put(part)

    def close(self) -> None:
        first = self.at
        for m in self.members:
            wide = self.force64 or m.size >= _FULL32 or m.header >= _FULL32
            extra = struct.pack("<HHQQQ", 1, 24, m.size, m.packed, m.header) if wide else b""
            size, at = (_FULL32, _FULL32) if wide else (m.size, m.header)
            raw = m.name.encode()
            self._put(_CENTRAL.pack(CENTRAL, 45, 45 if wide else 20, 0x800, 0, 0, 0x21, m.crc, size, size, len(raw), len(extra), 0, 0, 0, 0, at) + raw + extra)
        length, count = self.at - first, len(self.members)
        if self.force64 or first >= _FULL32 or count >= _FULL16:
            end64 = self.at
            self._put(_END64.pack(END64, _END64.size - 12, 45, 45, 0, 0, count, count, length, first))
            self._put(_LOCATOR64.pack(LOCATOR64, 0, end64, 1))
            count, length, first = _FULL16, _FULL32, _FULL32
        self._put(_END.pack(END, 0, 0, count, count, length, first, 0))


class ZipRanges:
    """Members of a ZIP file by range reads; `source` has size() and read_at(length, offset)."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail_at = max(0, size - _END.size - _FULL16)
        tail = source.read_at(size - tail_at, tail_at)
        at = tail.rfind(END)
        while at >= 0 and (len(tail) - at < _END.size or at + _END.size + _END.unpack_from(tail, at)[7] > len(tail)):
            at = tail.rfind(END, 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        _, _, _, _, count, length, first, _ = _END.unpack_from(tail, at)
        if count == _FULL16 or length == _FULL32 or first == _FULL32:
            end = tail_at + at
            signature, _, end64, _ = _LOCATOR64.unpack(source.read_at(_LOCATOR64.size, end - _LOCATOR64.size)) if end >= _LOCATOR64.size else (b"", 0, 0, 0)
            if signature == LOCATOR64:
                found = _END64.unpack(source.read_at(_END64.size, end64))
                if found[0] != END64:
                    raise ValueError("no ZIP64 end of central directory")
                count, length, first = found[7], found[8], found[9]
        self.members = {m.name: m for m in self._directory(source.read_at(length, first), count)}

    @staticmethod
    def _directory(data: bytes, count: int):
        at = 0
        for _ in range(count):
            signature, _, _, flags, method, _, _, crc, packed, size, n, extras, note, _, _, _, header = _CENTRAL.unpack_from(data, at)
            if signature != CENTRAL:
                raise ValueError("broken central directory")
            at += _CENTRAL.size
            name = data[at : at + n].decode("utf-8" if flags & 0x800 else "cp437")
            extra, e = data[at + n : at + n + extras], 0
            while e + 4 <= len(extra):
                kind, k = struct.unpack_from("<HH", extra, e)
                if kind == 1:
                    wide = iter(struct.unpack_from(f"<{k // 8}Q", extra, e + 4))
                    size = next(wide) if size == _FULL32 else size
                    packed = next(wide) if packed == _FULL32 else packed
                    header = next(wide) if header == _FULL32 else header
                e += 4 + k
            at += n + extras + note
            yield Member(name, method, header, packed, size, crc)

    def start(self, name: str) -> int:
        """File offset of a stored member's first byte."""
        m = self.members[name]
        if m.method:
            raise ValueError(f"{name} is not stored")
        found = _LOCAL.unpack(self.source.read_at(_LOCAL.size, m.header))
        if found[0] != LOCAL:
            raise ValueError("broken local header")
        return m.header + _LOCAL.size + found[9] + found[10]

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        m = self.members[name]
        length = m.size - offset if length is None else length
        if offset < 0 or length < 0 or offset + length > m.size:
            raise ValueError(f"range outside of {name}")
        return self.source.read_at(length, self.start(name) + offset)


class _File:
    """Range reads of a file that pyarrow opened."""

    def __init__(self, opened):
        self.opened = opened

    def size(self) -> int:
        return self.opened.size()

    def read_at(self, length: int, offset: int) -> bytes:
        return self.opened.read_at(length, offset)


def filesystem(uri: str):
    """(file system, path) of a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"\w+:/", uri) else "file://" + uri)


def _clean(value: str) -> str:
    """A header value on one line; what can't stand there is percent-encoded."""
    return re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP header of the full payload but not the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, f"WARC-Target-URI: {_clean(url)}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _id(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(found[1]) if found else None


def parse_record(data: bytes) -> dict:
    """Fields of one record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    cut = data.index(b"\r\n\r\n")
    version, *lines = data[:cut].decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = data[cut + 4 : cut + 4 + int(head["content-length"])]
    end = block.index(b"\r\n\r\n")
    length = int(re.search(rb"(?mi)^Content-Length: (\d+)", block[:end])[1])
    kind, payload = head["warc-type"], block[end + 4 :]
    digest = base64.b32decode(head["warc-payload-digest"].partition(":")[2]).hex()
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {head['warc-record-id']} is damaged")
    url = head.get("warc-target-uri")
    return {
        "page_id": _id(head["warc-record-id"]),
        "url": None if url is None else re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _id(head.get("warc-refers-to")),
        "payload": payload,
    }


def _gzip(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Archive:
    """An archive in the making: record members and their index lines."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.index: list[str] = []
        self.size = 0

    def add(self, url: str | None, data: bytes, digest: str) -> None:
        entry = {"url": url, "digest": digest, "filename": "data.warc.gz", "offset": str(self.size), "length": str(len(data))}
        self.index.append(f"{_clean(url or '-')} {re.sub(r'[^0-9]', '', DATE)} {json.dumps(entry)}\n")
        self.parts.append(data)
        self.size += len(data)

    def write(self, folder: str) -> str:
        system, path = filesystem(folder)
        name = f"{uuid.uuid4().hex}.wacz"
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{name}") as out:
            z = ZipWriter(out)
            z.add("archive/data.warc.gz", self.parts)
            z.add("indexes/index.cdxj", ["".join(self.index).encode()])
            z.add("datapackage.json", [json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "records": len(self.index)}).encode()])
            z.close()
        return f"{folder}/{name}"


def planned(pages: DataFrame) -> DataFrame:
    """_id, _url, _html, _refers_to: revisits point at the row of equal payload that is kept in full."""
    rows = pages.select(F.col("page_id").alias("_id"), F.col("url").cast("string").alias("_url"), text_of("html").alias("_html"))
    rows = rows.withColumn("_key", F.when(F.octet_length("_html") >= REVISIT_BYTES, F.sha2(F.encode("_html", "UTF-8"), 256)))
    # written first: one row per repeated payload, of a size that Spark then knows
    groups = durable(
        rows.filter("_key IS NOT NULL").groupBy("_key").agg(F.max("_id").alias("_top"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("_key").alias("_same"), "_top"),
        "warc-groups",
    )
    joined = rows.join(groups, F.col("_key") == F.col("_same"), "left")
    return joined.select("_id", "_url", "_html", F.when(~F.col("_id").eqNullSafe(F.col("_top")), F.col("_top")).alias("_refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES, level: int = 1) -> DataFrame:
    """Write a record per row; (path, records, bytes) of the archives, in the shared folder if none is named."""
    folder = (folder or new_folder(pages.sparkSession, "warc")).rstrip("/")

    def run(batches):
        import pyarrow as pa

        made: list[tuple[str, int, int]] = []
        archive = _Archive()

        def finish(a: _Archive) -> None:
            if a.index:
                made.append((a.write(folder), len(a.index), a.size))

        for batch in batches:
            for page_id, url, page, refers_to in zip(*(c for c in batch.columns), strict=True):
                payload, url = page.as_py().encode(), url.as_py()
                data = record(page_id.as_py(), url, payload, refers_to.as_py())
                archive.add(url, _gzip(data, level), hashlib.sha1(payload).hexdigest())
                if archive.size >= archive_bytes:
                    finish(archive)
                    archive = _Archive()
        finish(archive)
        yield pa.RecordBatch.from_arrays(
            [pa.array([m[i] for m in made], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"]
        )

    return durable(in_arrow(planned(pages), run, "path string, records bigint, bytes bigint"), "warc-list")


def archive_records(path: str):
    """The records of one archive, in the order of its index, each read by range."""
    system, at = filesystem(path)
    with system.open_input_file(at) as opened:
        z = ZipRanges(_File(opened))
        for name in sorted(n for n in z.members if n.startswith("indexes/") and n.endswith(".cdxj")):
            for line in z.read(name).decode().splitlines():
                entry = json.loads(line.split(" ", 2)[2])
                packed = z.read(f"archive/{entry['filename']}", int(entry["offset"]), int(entry["length"]))
                yield parse_record(zlib.decompress(packed, 47))


_FIELDS = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
READ_SCHEMA = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of all archives whose path is a row; payload binary only if asked for."""
    spark = archives.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    fields = [*_FIELDS, *["payload"] * with_payload]

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * with_payload]

        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows], k) for f, k in zip(fields, kinds, strict=True)], fields)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                for row in archive_records(path):
                    rows.append(row)
                    size += len(row["payload"])
                    if size > 1 << 22 or len(rows) >= 2000:
                        yield flush(rows)
                        rows, size = [], 0
                if rows:
                    yield flush(rows)

    return in_arrow(archives.select("path").repartition(tasks), run, READ_SCHEMA + ", payload binary" * with_payload)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    back = read_archives(write_archives(pages))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
s AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest,
             CASE WHEN octet_length(payload) >= 1000 THEN max(page_id) OVER (PARTITION BY payload) ELSE page_id END AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM s
"""
