"""WARC records in ZIP-packaged archives, written and read without extraction.

An archive is a ZIP file whose members are all *stored*: ``archive/data.warc.gz`` (one gzip member a record),
``indexes/index.cdx`` (a line a record: page id, record type, offset, length) and ``datapackage.json``.  A reader
finds the end record at the file's tail (and the ZIP64 locator and directory where the 16- or 32-bit fields
overflow), parses the central directory, and from a stored member's local header knows the byte range of its data:
the index, and then single records, are read by offset.

Archives live in a folder that executors share, under names that hold the task's attempt, and only those that the
committed manifest names are read: a task that is run twice leaves a file that nothing refers to.

Only the pages whose payload may repeat shuffle; a revisit names the record it refers to (WARC-Refers-To).  An index carries
every record's offset and length, and readers fetch neighbouring records in one range and cut it up by them.

Defined results.  A null html has an empty payload.  A null page_id or url is kept as null (header left out).  Rows that
share the smallest page_id among equal payloads are all responses; repeated rows are records of one id.  A payload of any
length is one record, held by one task at a time.  An empty table gives no archive and no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import semi, state

MIN_REVISIT_BYTES = 100
#: Bytes of record data after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdx", "datapackage.json"
_CAP16, _CAP32 = 0xFFFF, 0xFFFFFFFF
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the WARC standard


# --- ZIP, stored members only -----------------------------------------------------------------------------------


class StoredZip:
    """Writes stored members one after another to a stream; sizes follow the data, so the stream is never rewound.

    The member's sizes go to the data descriptor and to the central directory; readers here use the latter."""

    def __init__(self, sink, zip64: bool | None = None):
        self.sink, self.at, self.members, self.force = sink, 0, [], zip64
        self.begun: list | None = None

    def _write(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.begun = [raw, self.at, 0, 0]
        # bit 3: sizes follow in a descriptor; bit 11: the name is UTF-8; method 0: stored
        self._write(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x0808, 0, 0, 0x21, 0, 0, 0, len(raw), 0) + raw)

    def data(self, chunk: bytes) -> int:
        """Returns the chunk's offset in the member."""
        at = self.begun[3]
        self.begun[2] = zlib.crc32(chunk, self.begun[2])
        self.begun[3] += len(chunk)
        self._write(chunk)
        return at

    def end(self) -> None:
        raw, start, crc, size = self.begun
        big = self.force or size >= _CAP32
        self._write(struct.pack("<IIQQ" if big else "<IIII", 0x08074B50, crc, size, size))
        self.members.append((raw, start, crc, size))
        self.begun = None

    def close(self) -> None:
        directory = self.at
        for raw, start, crc, size in self.members:
            extra = b""
            if self.force or size >= _CAP32 or start >= _CAP32:
                extra = struct.pack("<HHQQQ", 1, 24, size, size, start)
                size32, start32 = _CAP32, _CAP32
            else:
                size32, start32 = size, start
            self._write(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x0808, 0, 0, 0x21, crc, size32, size32, len(raw), len(extra), 0, 0, 0, 0, start32) + raw + extra)
        length, n, end = self.at - directory, len(self.members), self.at
        if self.force or n >= _CAP16 or directory >= _CAP32 or length >= _CAP32:
            self._write(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, length, directory))
            self._write(struct.pack("<IIQI", 0x07064B50, 0, end, 1))
            n, length, directory = _CAP16, _CAP32, _CAP32
        self._write(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, length, directory, 0))


class StoredZipReader:
    """Byte ranges of the stored members of a ZIP in a seekable file."""

    TAIL = 22 + _CAP16  # the end record and the longest comment

    def __init__(self, file):
        self.file = file
        size = file.seek(0, io.SEEK_END)
        tail_at = max(0, size - self.TAIL - 20)
        tail = self._range(tail_at, size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        n, _, length, directory = struct.unpack_from("<HHII", tail, at + 8)
        if n == _CAP16 or length == _CAP32 or directory == _CAP32:
            mark, _, where, _ = struct.unpack_from("<IIQI", tail, at - 20) if at >= 20 else (0, 0, 0, 0)
            if mark == 0x07064B50:
                head = self._range(where, 56)
                if head[:4] != b"PK\x06\x06":
                    raise ValueError("no ZIP64 end of central directory")
                n, length, directory = struct.unpack_from("<QQQ", head, 32)
        self.members: dict[str, tuple[int, int, int, int]] = {}
        raw, at = self._range(directory, length), 0
        for _ in range(n):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", raw, at + 8)
            crc, packed, size, n_name, n_extra, n_comment = struct.unpack_from("<IIIHHH", raw, at + 16)
            start = struct.unpack_from("<I", raw, at + 42)[0]
            name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x0800 else "cp437")
            extra, x = raw[at + 46 + n_name : at + 46 + n_name + n_extra], 0
            while x + 4 <= len(extra):
                kind, width = struct.unpack_from("<HH", extra, x)
                if kind == 1:  # in this order, and only those whose 32-bit field is full
                    y = x + 4
                    for field in ("size", "packed", "start"):
                        if {"size": size, "packed": packed, "start": start}[field] == _CAP32:
                            value = struct.unpack_from("<Q", extra, y)[0]
                            y += 8
                            size, packed, start = (value if field == f else v for f, v in (("size", size), ("packed", packed), ("start", start)))
                x += 4 + width
            self.members[name] = (start, packed, crc, method)
            at += 46 + n_name + n_extra + n_comment

    def _range(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        return self.file.read(length)

    def range_of(self, name: str) -> tuple[int, int]:
        """Where a stored member's data is in the file: offset and length."""
        start, size, _, method = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed, not stored")
        head = self._range(start, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {name}")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return start + 30 + n_name + n_extra, size

    def read(self, name: str) -> bytes:
        data = self._range(*self.range_of(name))
        if zlib.crc32(data) != self.members[name][2]:
            raise ValueError(f"{name} is damaged")
        return data


# --- WARC -------------------------------------------------------------------------------------------------------


def _clean(value: str) -> str:
    return "".join(c if c >= " " else "%%%02X" % ord(c) for c in value)


def record_id(page_id: int | str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}:{digest}')}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id if not revisit else f'{page_id}>{refers_to}', digest)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and the HTTP body of one record."""
    top = raw.index(b"\r\n\r\n")
    lines = raw[:top].decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = raw[top + 4 : top + 4 + int(head["content-length"])]
    http = block.index(b"\r\n\r\n")
    for line in block[:http].split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        head.setdefault("http-" + k.decode().strip().lower(), v.decode().strip())
    return head, block[http + 4 :]


# --- Spark ------------------------------------------------------------------------------------------------------


def record_types(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """pages (page_id, url, html) with digest and refers_to.  Ids and digests shuffle to find repeated payloads, then only
    the pages that may have one."""
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    page = page.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    first = page.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    first = state.keep(first, "warc-repeated")
    might = semi.might_hold(first.select(F.xxhash64("digest").alias("id")), first.count())
    asked = page.withColumn("maybe", might.column(F.xxhash64("digest")))
    joined = asked.where("maybe").join(first.withColumnRenamed("digest", "digest_"), F.col("digest") == F.col("digest_"), "left")
    names = ["page_id", "url", "html", "digest"]
    typed = joined.select(*names, F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to"))
    return asked.where("not maybe").select(*names, F.lit(None).cast("long").alias("refers_to")).unionAll(typed)


def _filesystem(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_archives(typed: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, zip64: bool | None = None) -> DataFrame:
    """Manifest of the archives written: archive (file name), records, bytes."""
    root = folder if "://" in folder else folder.replace("file:", "", 1)

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        files, base = _filesystem(root)
        files.create_dir(base, recursive=True)
        part = 0

        class Archive:
            def __init__(self):
                self.name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{part:04d}.wacz"
                self.stream = files.open_output_stream(f"{base}/{self.name}")
                self.zip, self.lines, self.size = StoredZip(self.stream, zip64), [], 0
                self.zip.begin(DATA)

            def add(self, page_id, url, html, digest, refers_to):
                record = gzip.compress(warc_record(page_id, url, html, digest, refers_to), 1, mtime=0)
                at = self.zip.data(record)
                self.size += len(record)
                self.lines.append(f"{'' if page_id is None else page_id} {'revisit' if refers_to is not None else 'response'} {at} {len(record)}\n")

            def close(self):
                self.zip.end()
                self.zip.begin(INDEX)
                self.zip.data("".join(self.lines).encode())
                self.zip.end()
                self.zip.begin(PACKAGE)
                self.zip.data(json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}).encode())
                self.zip.end()
                self.zip.close()
                self.stream.close()
                return pa.RecordBatch.from_pylist([{"archive": self.name, "records": len(self.lines), "bytes": self.zip.at}], schema=manifest)

        manifest = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
        archive = None
        for batch in batches:
            for page_id, url, html, digest, refers in zip(*batch.columns, strict=True):
                archive = archive or Archive()
                archive.add(page_id.as_py(), url.as_py(), html.as_py().encode("utf-8"), digest.as_py(), refers.as_py())
                if archive.size >= archive_bytes:
                    yield archive.close()
                    archive, part = None, part + 1
        if archive:
            yield archive.close()

    out = typed.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "archive string, records long, bytes long")
    return state.keep(out, "warc-manifest")


def _ranges(text: bytes, most: int) -> Iterator[tuple[int, list[int]]]:
    """Neighbouring records of an index as ranges of at most ``most`` bytes (or one record): offset, the records' lengths."""
    at, sizes, length = 0, [], 0
    for line in text.decode().splitlines():
        offset, size = map(int, line.rsplit(" ", 2)[1:])
        if sizes and (length + size > most or at + length != offset):
            yield at, sizes
            sizes, length = [], 0
        at = at if sizes else offset
        sizes.append(size)
        length += size
    if sizes:
        yield at, sizes


def read_archives(manifest: DataFrame, folder: str, range_bytes: int = 8 << 20) -> DataFrame:
    """Every record of the archives that ``manifest`` (archive) names: page_id, url, record_type, refers_to,
    payload (the body stored with the record; null for a revisit), payload_bytes, payload_digest."""
    root = folder if "://" in folder else folder.replace("file:", "", 1)
    spark = manifest.sparkSession

    def plan(batches):
        files, base = _filesystem(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.open_input_file(f"{base}/{name}") as file:
                    archive = StoredZipReader(file)
                    start, _ = archive.range_of(DATA)
                    got = [(name, start + at, sizes) for at, sizes in _ranges(archive.read(INDEX), range_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.string(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["archive", "at", "sizes"])

    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def fetch(batches):
        files, base = _filesystem(root)
        for batch in batches:
            for name, at, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with files.open_input_file(f"{base}/{name}") as file:
                    file.seek(at)
                    raw = file.read(sum(sizes))
                rows, begin = [], 0
                for size in sizes:
                    record = zlib.decompress(raw[begin : begin + size], 31)
                    begin += size
                    head, body = parse_record(record)
                    revisit = head["warc-type"] == "revisit"
                    digest = head["warc-payload-digest"].removeprefix("sha256:")
                    if not revisit and hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError(f"payload digest differs in {name}")
                    number = lambda k: int(head[k]) if k in head else None
                    rows.append((number("x-page-id"), head.get("warc-target-uri"), head["warc-type"], number("x-refers-to-page-id"), None if revisit else body, int(head["http-content-length"]), digest))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    slots = max(2, spark.sparkContext.defaultParallelism)
    ranges = manifest.select("archive").mapInArrow(plan, "archive string, at long, sizes array<long>").repartition(2 * slots)
    return ranges.mapInArrow(fetch, "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives go once their records have been read back."""
    with state.steps(spark) as outlives:
        folder = state.owned(state.fresh_path(spark, "warc"))
        manifest = write_archives(record_types(spark.read.parquet(f"{sf_dir}/pages.parquet")), folder)
        out = state.keep(read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "warc-records")
        outlives(out)
    return out


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN f.first < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first < p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
"""
