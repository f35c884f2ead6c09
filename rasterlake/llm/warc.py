"""WARC records in ZIP packages: a writer, and a reader that parses directories and range-reads records.

A package stores (does not compress) ``archive/data.warc.gz``, whose records are gzip members of their own, and
``indexes/index.cdxj``, which gives each record's place. The reader finds the end record, the ZIP64 end record
where there is one, and the central directory; looks up where a stored member begins; and reads the ranges it
needs, never unpacking the package.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from io import BytesIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm.common import materialize, shared_dir, table

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Ranges:
    """A byte source that is read by ranges: a buffer, or a seekable binary file."""

    def __init__(self, source):  # noqa: ANN001
        self.view = memoryview(source) if isinstance(source, (bytes, bytearray, memoryview)) else None
        self.file = None if self.view is not None else source
        self.size = len(self.view) if self.view is not None else source.seek(0, 2)

    def read(self, at: int, size: int) -> bytes:
        if at < 0 or size < 0 or at + size > self.size:
            raise ValueError(f"range {at}+{size} is outside the {self.size} bytes of the archive")
        if self.view is not None:
            return bytes(self.view[at : at + size])
        self.file.seek(at)
        return self.file.read(size)


class ZipDirectory:
    """Members of a ZIP file by name, from the central directory, with ZIP64 sizes and offsets."""

    def __init__(self, source: Ranges):
        self.source = source
        tail_at = max(0, source.size - 22 - 65535)
        tail = source.read(tail_at, source.size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(b"PK\x05\x06", 0, end)  # the signature can also stand in a comment
        if end < 0:
            raise ValueError("no end of central directory: not a ZIP file")
        count, size, offset = struct.unpack_from("<HII", tail, end + 10)
        at = tail_at + end
        if at >= 20 and source.read(at - 20, 4) == b"PK\x06\x07":
            (at64,) = struct.unpack("<Q", source.read(at - 12, 8))
            record = source.read(at64, 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("the ZIP64 locator points at no ZIP64 end record")
            count, size, offset = struct.unpack_from("<QQQ", record, 32)
        self.members: dict[str, tuple[int, int, int, int]] = {}
        directory, at = source.read(offset, size), 0
        for _ in range(count):
            sig, _, _, flags, method, _, _, _, packed, plain, n, extra, comment, _, _, _, header = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, at)
            if sig != 0x02014B50:
                raise ValueError("damaged central directory")
            name = directory[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            wide = _wide(directory[at + 46 + n : at + 46 + n + extra])
            plain, packed, header = (next(wide) if x == 0xFFFFFFFF else x for x in (plain, packed, header))
            self.members[name] = (method, packed, plain, header)
            at += 46 + n + extra + comment

    def place(self, name: str) -> tuple[int, int]:
        """Offset and size of a stored member's bytes."""
        method, packed, _, header = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed; only stored members can be read by ranges")
        local = self.source.read(header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"{name} has no local header")
        n, extra = struct.unpack_from("<HH", local, 26)
        return header + 30 + n + extra, packed


def _wide(extra: bytes) -> Iterator[int]:
    """The 64-bit values of a ZIP64 extra field, in order."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            yield from struct.unpack_from(f"<{size // 8}Q", extra, at + 4)
            return
        at += 4 + size


def write_record(kind: str, record_id: str, url: str, payload: bytes, digest: bytes, refers_to: str | None) -> bytes:
    """One gzip member. A revisit keeps the HTTP header, with the length of the full payload, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(digest).decode(), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def read_record(member: bytes) -> dict:
    """Headers, HTTP header and payload of one gzip member."""
    raw = zlib.decompress(member, 31)
    cut = raw.index(b"\r\n\r\n")
    lines = raw[:cut].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = raw[cut + 4 : cut + 4 + int(headers["Content-Length"])]
    end = block.index(b"\r\n\r\n") + 4
    http = dict(x.split(": ", 1) for x in block[:end].decode().strip().split("\r\n")[1:])
    return {"headers": headers, "http": http, "payload": block[end:]}


def write_package(records: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A package of ``(url, gzip member)`` records."""
    out, index, at = BytesIO(), [], 0
    for k, (url, member) in enumerate(records):
        index.append(f"{k:09d} " + json.dumps({"url": url, "offset": at, "length": len(member)}))
        at += len(member)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, parts in ((DATA, [m for _, m in records]), (INDEX, ["\n".join(index).encode()])):
            with z.open(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), "w", force_zip64=zip64) as f:
                for p in parts:
                    f.write(p)
    return out.getvalue()


def read_package(source: Ranges) -> Iterator[dict]:
    """The records of a package, each by a range-read of what the index says."""
    directory = ZipDirectory(source)
    data, size = directory.place(DATA)
    at, n = directory.place(INDEX)
    for line in source.read(at, n).decode().split("\n") if n else []:
        entry = json.loads(line.split(" ", 1)[1])
        if entry["offset"] + entry["length"] > size:
            raise ValueError("the index points outside its archive")
        yield read_record(source.read(data + entry["offset"], entry["length"]))


def _uri(url: str | None, page: str) -> str:
    """A one-line target; a null or empty url becomes the record's own name."""
    return "".join(c if " " < c else f"%{ord(c):02X}" for c in url) if url else page


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", dedupe_bytes: int = 1000, package_bytes: int = 8_000_000, folder: str | None = None) -> DataFrame:
    """Packages ``(name, content)`` with one record for each row; with ``folder`` (a URI), files there: ``(name, path)``.

    Null payloads are empty. Of equal payloads of at least ``dedupe_bytes``, the one with the largest key is a
    response and the others revisit it; rows that share that key are all responses, a null key revisits, and if
    all are null, all are responses. Extra columns are not read; an empty table gives no package. A package
    closes once it holds ``package_bytes``, which bounds what a task holds (besides one record).
    What each repeated digest is kept under is one narrow table, joined to the rows as Spark's own statistics decide: while it is below
    the session's broadcast threshold, payloads do not move. Each attempt of a task writes files of its
    own, so a repeated one overwrites nothing; the paths in the result are those of the attempt that counted.
    """
    rows = pages.select(pages[key].cast("long").alias("id"), pages[url].alias("url"), F.coalesce(pages[payload], F.lit("")).cast("binary").alias("body"))
    rows = rows.withColumn("bytes", F.octet_length("body")).withColumn("digest", F.unhex(F.sha1("body")))
    many = rows.where(F.col("bytes") >= dedupe_bytes).groupBy("digest", "bytes").agg(F.max("id").alias("keep"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(materialize(many), ["digest", "bytes"], "left")
    rows = rows.withColumn("refers_to", F.when(F.col("keep").isNotNull() & ~F.col("id").eqNullSafe(F.col("keep")), F.col("keep")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, size, seq = [], 0, 0
        attempt = uuid.uuid4().hex

        def close() -> pa.RecordBatch:
            if folder is not None:
                name = f"part-{part:06d}-{seq:06d}-{attempt}.wacz"
                disk, at = fs.FileSystem.from_uri(folder)
                disk.create_dir(at)
                with disk.open_output_stream(f"{at}/{name}") as f:
                    f.write(write_package(held))
                return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([f"{folder}/{name}"])], ["name", "path"])
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{seq:06d}.wacz"]), pa.array([write_package(held)], pa.binary())], ["name", "content"])

        for batch in batches:
            ids, urls, digests, refs = (batch.column(c).to_pylist() for c in ("id", "url", "digest", "refers_to"))
            bodies = batch.column("body")
            for k, i in enumerate(ids):
                name = f"urn:page:{'' if i is None else i}"
                target = _uri(urls[k], name)
                member = write_record("response" if refs[k] is None else "revisit", name, target, bodies[k].as_py(), digests[k], None if refs[k] is None else f"urn:page:{refs[k]}")
                held.append((target, member))
                size += len(member)
                if size >= package_bytes:
                    yield close()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield close()

    return rows.select("id", "url", "digest", "refers_to", "body").mapInArrow(write, "name string, content binary" if folder is None else "name string, path string")


def read_archives(packages: DataFrame, content: str = "content", payloads: bool = True) -> DataFrame:
    """Records of packages: rows with the whole file in ``content``, as the binaryFile source gives them, or, where that
    column is a string, with the URI of the file, which is opened where the row is read and read by ranges.

    Gives ``page_id``, ``url``, ``record_type``, ``refers_to``, ``payload_bytes`` and ``payload_digest`` of the
    full payload (a revisit has them from its headers) and, if asked for, ``payload``. A response whose payload
    does not match its digest or length is an error. Null content gives no records.
    """
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    fields += [("payload", pa.binary())] if payloads else []
    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}

    def page(uri: str | None) -> int | None:
        number = uri.strip("<>").rpartition(":")[2] if uri else ""
        return int(number) if number else None

    def records(value: pa.Scalar) -> Iterator[dict]:
        if pa.types.is_binary(value.type) or pa.types.is_large_binary(value.type):
            yield from read_package(Ranges(memoryview(value.as_buffer())))
            return
        disk, path = fs.FileSystem.from_uri(value.as_py())
        with disk.open_input_file(path) as f:
            yield from read_package(Ranges(f))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                if not value.is_valid:
                    continue
                out: list[list] = [[] for _ in fields]
                for r in records(value):
                    h, kind = r["headers"], r["headers"]["WARC-Type"]
                    digest, size = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex(), int(r["http"]["Content-Length"])
                    if kind == "response" and (size != len(r["payload"]) or digest != hashlib.sha1(r["payload"]).hexdigest()):
                        raise ValueError(f"{h['WARC-Record-ID']} does not match its digest")
                    for c, x in zip(out, (page(h["WARC-Record-ID"]), h["WARC-Target-URI"], kind, page(h.get("WARC-Refers-To")), size, digest, r["payload"]), strict=False):
                        c.append(x)
                    if len(out[0]) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, fields, strict=True)], [n for n, _ in fields])
                        out = [[] for _ in fields]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, fields, strict=True)], [n for n, _ in fields])

    return packages.select(content).mapInArrow(read, ", ".join(f"{n} {kinds[t]}" for n, t in fields))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for every row of ``pages``, written and read back; see ``write_archives`` for nulls, ties and repeated rows."""
    packages = materialize(write_archives(table(spark, sf_dir, "pages"), folder=f"{shared_dir(spark)}/{uuid.uuid4().hex}"))
    tasks = min(max(packages.count(), 1), 10_000)  # a row is a path, so rows do not tell how much there is to read
    return read_archives(packages.repartition(tasks), "path", payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS keep FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN keep IS NOT NULL AND keep IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keep IS DISTINCT FROM page_id THEN keep END AS refers_to
FROM k
"""
