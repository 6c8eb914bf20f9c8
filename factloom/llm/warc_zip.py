"""WARC records in ZIP packages, and a reader that takes single records by range (operator 4).

A package holds a stored member of WARC records, each compressed by itself, an index of their
offsets and a short description. The reader parses the central directory, with its ZIP64 forms, from the
end of the file, finds the stored members, and reads records from their places without
extracting anything. Files are reached through pyarrow's file systems by URI, so packages may
lie wherever all executors can see them.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import lean, settled, slices, tidied

#: Payloads shorter than this are never written as revisits.
LEAST_REVISIT = 100
#: A package is closed when its records reach this size, and another one is begun.
PACKAGE_BYTES = 256 * 1024 * 1024
#: Records that lie side by side are read together up to this size.
READ_BYTES = 4 * 1024 * 1024
#: The members of a package. A reader takes records that aren't compressed, too.
PACKED, PLAIN, INDEX = "archive/data.warc.gz", "archive/data.warc", "indexes/index.jsonl"
LEVEL = 3
_UNKNOWN16, _UNKNOWN32 = 0xFFFF, 0xFFFFFFFF


def file_system(uri: str):
    """pyarrow's file system for a URI or path, and the path in it."""
    from pyarrow import fs

    if re.match(r"file:/(?!/)", uri):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


@dataclass(frozen=True)
class Member:
    name: str
    header: int
    size: int
    packed: int
    method: int


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """Sizes and offset of an entry, those that don't fit 32 bits from its ZIP64 field."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide = iter(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
            return [next(wide) if v == _UNKNOWN32 else v for v in values]
        at += 4 + size
    return values


def members(file, size: int) -> list[Member]:
    """The entries of the central directory of an open ZIP file of `size` bytes.

    Raises ValueError for what is no ZIP file, for split ones and for broken directories.
    """
    tail_at = max(0, size - 22 - _UNKNOWN16)
    file.seek(tail_at)
    tail = file.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no end of a central directory")
    disk, first, _, count, length, start = struct.unpack_from("<HHHHII", tail, end + 4)
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        file.seek(struct.unpack_from("<Q", tail, end - 12)[0])
        wide = file.read(56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of the central directory")
        disk, first, _, count, length, start = struct.unpack_from("<IIQQQQ", wide, 16)
    if disk or first:
        raise ValueError("a split archive")
    file.seek(start)
    data, found, at = file.read(length), [], 0
    for _ in range(count):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("a broken central directory")
        method, = struct.unpack_from("<H", data, at + 10)
        packed, full, names, extras, notes = struct.unpack_from("<IIHHH", data, at + 20)
        header, = struct.unpack_from("<I", data, at + 42)
        name = data[at + 46 : at + 46 + names].decode("utf-8", "replace")
        full, packed, header = _wide(data[at + 46 + names : at + 46 + names + extras], [full, packed, header])
        found.append(Member(name, header, full, packed, method))
        at += 46 + names + extras + notes
    return found


def stored_at(file, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method or member.size != member.packed:
        raise ValueError(f"{member.name} is compressed; records can't be read by range")
    file.seek(member.header)
    head = file.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header of {member.name}")
    return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))


def _identity(key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}/{digest}')}>"


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit without the payload if refers_to is given."""
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_identity(key, digest)}", f"WARC-Date: {date}",
        *([] if url is None else [f"WARC-Target-URI: {quote(url, safe=_URI_SAFE)}"]),
        *([] if key is None else [f"X-Page-Id: {key}"]),
        *([] if refers_to is None else ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_identity(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]),
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_URI_SAFE = "!#$&'()*+,/:;=?@[]-._~"


def parse(data: bytes) -> dict:
    """A record's fields; its payload is null in a revisit. Raises ValueError if it is broken."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not gap or not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record of another length than its header says")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload of another digest than its header says")
    number = lambda name: int(fields[name]) if name in fields else None
    url = fields.get("warc-target-uri")
    return {
        "page_id": number("x-page-id"), "url": None if url is None else unquote(url), "record_type": fields["warc-type"],
        "payload_bytes": length, "payload_digest": digest, "refers_to": number("x-refers-to-page-id"), "payload": None if revisit else payload,
    }


def _roles(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, digest: 32 bytes, refers_to) of the rows that revisit another's payload."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8")
    rows = df.select(F.col(key).cast("long").alias("key"), F.unhex(F.sha2(payload, 256)).alias("digest"), F.octet_length(payload).alias("size"))
    rows = settled(rows.filter((F.col("size") >= LEAST_REVISIT) & F.col("key").isNotNull()).select("key", "digest"), "digests")
    first = rows.groupBy("digest").agg(F.min("key").alias("refers_to"), F.max("key").alias("last")).filter("refers_to < last")
    return rows.join(settled(first.select("digest", "refers_to"), "firsts"), "digest").filter("key > refers_to").distinct()


def write(df: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record of each row to packages under path, and a table of the packages.

    The payload is the html in UTF-8 (null: empty). Of rows with equal payloads of at least 100
    bytes the one with the smallest key becomes a response, the others revisits of it; rows of
    that smallest key are all responses, and so are rows without a key. A null url is left out.
    A task writes each package under a name of its own attempt and then renames it, so a task
    that is run again leaves one package.
    """
    roles = _roles(df, key, html)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.encode(F.coalesce("html", F.lit("")), "utf-8"), 256)))
    rows = rows.repartition(n, "key", "digest").join(roles, ["key", "digest"], "left").select("key", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        files, top = file_system(path)
        files.create_dir(f"{top}/packages", recursive=True)
        package, made = None, []
        for batch in slices(batches, "html"):
            for row in batch.to_pylist():
                if package is None:
                    package = _Package(files, f"{top}/packages/part-{task.partitionId():05d}-{len(made):03d}.zip", task.taskAttemptId())
                package.add(record(row["key"], row["url"], (row["html"] or "").encode(), row["refers_to"], date), row["key"])
                if package.size >= PACKAGE_BYTES:
                    made.append(package.close())
                    package = None
        if package is not None:
            made.append(package.close())
        yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    with tidied(df.sparkSession):
        rows.mapInArrow(lean(run), "name string, records long, bytes long").write.parquet(f"{path}/table")


def packed(data: bytes) -> bytes:
    """data as one gzip member; the same bytes for the same data."""
    one = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return one.compress(data) + one.flush()


def unpacked(data: bytes) -> bytes:
    return zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data


class _Package:
    """A package being written as a stream."""

    def __init__(self, files, path: str, attempt: int):
        self.files, self.path, self.held = files, path, f"{path}.{attempt}"
        self.stream = files.open_output_stream(self.held)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(PACKED), "w", force_zip64=True)
        self.size, self.index = 0, []

    def add(self, data: bytes, key: int | None) -> None:
        data = packed(data)
        self.member.write(data)
        self.index.append(json.dumps({"key": key, "offset": self.size, "length": len(data)}))
        self.size += len(data)

    def close(self) -> dict:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(f"{line}\n" for line in self.index))
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "records": len(self.index)}))
        self.zip.close()
        self.stream.close()
        self.files.move(self.held, self.path)
        return {"name": self.path.rpartition("/")[2], "records": len(self.index), "bytes": self.size}


def _places(file, size: int) -> Iterator[tuple[int, int]]:
    """Offset in the file and length of each record, by the index or, without one, by the records themselves."""
    by_name = {m.name: m for m in members(file, size)}
    own = by_name.get(PACKED) or by_name.get(PLAIN)
    if own is None:
        raise ValueError("no member of records")
    start = stored_at(file, own)
    if INDEX in by_name:
        at = stored_at(file, by_name[INDEX])
        file.seek(at)
        for line in file.read(by_name[INDEX].size).splitlines():
            entry = json.loads(line)
            yield start + entry["offset"], entry["length"]
        return
    at, end = start, start + own.size
    while at < end:
        length = _gzip_length(file, at, end) if own.name == PACKED else _plain_length(file, at, end)
        yield at, length
        at += length


def _gzip_length(file, at: int, end: int) -> int:
    """The length of the gzip member at a place, read in parts of bounded size."""
    one, read = zlib.decompressobj(31), 0
    while not one.eof:
        file.seek(at + read)
        data = file.read(min(65536, end - at - read))
        if not data:
            raise ValueError("a record without an end")
        read += len(data)
        while data and not one.eof:
            one.decompress(data, 1 << 20)
            data = one.unconsumed_tail
    return read - len(one.unused_data)


def _plain_length(file, at: int, end: int) -> int:
    """The length of the record at a place, by its header."""
    head = b""
    while b"\r\n\r\n" not in head:
        file.seek(at + len(head))
        more = file.read(min(4096, end - at - len(head)))
        if not more:
            raise ValueError("a record without an end of its header")
        head += more
    head = head.partition(b"\r\n\r\n")[0] + b"\r\n\r\n"
    return len(head) + int(re.search(rb"(?im)^content-length:\s*(\d+)", head)[1]) + 4


def index(spark: SparkSession, path: str) -> DataFrame:
    """(name, offset, length) of every record of the packages under path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = file_system(path)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                where = f"{top}/packages/{name}"
                with files.open_input_file(where) as file:
                    places = list(_places(file, file.size()))
                for at in range(0, len(places), 50_000):
                    part = places[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array([p[0] for p in part], type=pa.int64()), pa.array([p[1] for p in part], type=pa.int64())], names=["name", "offset", "length"])

    return spark.read.schema("name string, records long, bytes long").parquet(f"{path}/table").select("name").mapInArrow(run, "name string, offset long, length long")


_RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read(places: DataFrame, path: str) -> DataFrame:
    """The records at `places`, all of index() or a selection, each with its payload (null in revisits).

    Records near each other go to one task, which reads neighbours in one range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = file_system(path)
        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        name, file = None, None
        for batch in batches:
            rows = batch.to_pylist()
            at = 0
            while at < len(rows):
                first, last = rows[at], at + 1
                end = first["offset"] + first["length"]
                while last < len(rows) and rows[last]["name"] == first["name"] and rows[last]["offset"] == end and end - first["offset"] < READ_BYTES:
                    end += rows[last]["length"]
                    last += 1
                if name != first["name"]:
                    name, file = first["name"], files.open_input_file(f"{top}/packages/{first['name']}")
                file.seek(first["offset"])
                data = file.read(end - first["offset"])
                cut = _cut(data, rows[at:last])
                yield pa.RecordBatch.from_pylist([parse(unpacked(c)) for c in cut], schema=kinds)
                at = last

    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = places.repartition(n, "name", F.floor(F.col("offset") / (16 * READ_BYTES))).sortWithinPartitions("name", "offset")
    return near.select("name", "offset", "length").mapInArrow(lean(run), _RECORD)


def _cut(data: bytes, rows: list[dict]) -> list[bytes]:
    base = rows[0]["offset"]
    return [data[r["offset"] - base : r["offset"] - base + r["length"]] for r in rows]
