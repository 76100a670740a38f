"""WARC archives as a Python data source: planned partitions, pushed-down header predicates, lazy payloads.

Each record is a gzip member of its own. This writer notes the member's length and a number of its file in the member's
extra field, so its reader goes from header to header without inflating what no predicate lets through, and starts at any
byte of a large file: at the first member after it with the file's number. Members without the note (other writers'
files, of one record or many, which then share the member's position) and plain WARC files are read through, by one task
each. Headers have any length. What is no whole record gives a row with `error` and the position, and reading goes on at
the next record (mode PERMISSIVE) or ends there (mode FAILFAST).
"""

from __future__ import annotations

import base64
import posixpath
import re
import struct
import uuid
import zlib
from dataclasses import dataclass
from hashlib import sha1

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

SCHEMA = (
    "path string, position long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, "
    "content_type string, payload_digest string, content_length long, header_payload_bytes long, payload_bytes long, computed_digest string, error string, payload binary"
)
_COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
#: Columns that a header alone decides, and the header they come from.
_FROM_HEADER = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date",
    "content_type": "Content-Type", "payload_digest": "WARC-Payload-Digest",
}
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a path or address as Spark names it (file:, hdfs:, s3:, gs: or plain)."""
    if re.match(r"file:/(?!/)", path):
        path = "file://" + path[5:]
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


#: The first bytes of a member that notes its length: gzip's, and an extra field `sl` of the file's number and the length.
_NOTED = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H2sH", 20, b"sl", 16)
_HEAD = len(_NOTED) + 16


def member(data: bytes, level: int = 1, number: int = 0) -> bytes:
    """One gzip member whose extra field `sl` holds the number of its file and its own length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    return _NOTED + struct.pack("<QQ", number, _HEAD + len(body) + 8) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def clean(value) -> str:
    """A header value on one line."""
    return re.sub(r"[\r\n]+", " ", value or "").strip()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_record(page_id, url, html: bytes, digest: str, refers_to) -> bytes:
    """The response record of a page, or a revisit record (no payload) where it refers to another page."""
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", page_urn(page_id)), ("WARC-Date", "2024-01-01T00:00:00Z")]
    if url is not None:
        headers.append(("WARC-Target-URI", clean(url)))
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Bytes", str(len(html)))]
    if refers_to is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", page_urn(refers_to))]
    return record(headers, _HTTP + (html if refers_to is None else b""))


def page_urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class WarcWriter(DataSourceWriter):
    """Writes rows (page_id, url, html, digest, refers_to); files show up under their names at commit."""

    def __init__(self, path: str, file_bytes: int, level: int):
        self.path, self.file_bytes, self.level = path, file_bytes, level

    def write(self, iterator) -> _Written:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(int=0)}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        for row in iterator:
            if out is None or size >= self.file_bytes:
                if out is not None:
                    out.close()
                own = uuid.uuid4()
                name, number = f"{own.hex}.warc.gz", own.int & 0xFFFFFFFFFFFFFFFF
                files.append((posixpath.join(root, f"_{name}.part"), posixpath.join(root, name)))
                out = fs.open_output_stream(files[-1][0], compression=None)
                size = out.write(member(info, self.level, number)) or 0
            data = member(page_record(row.page_id, row.url, (row.html or "").encode("utf-8"), row.digest, row.refers_to), self.level, number)
            out.write(data)
            size += len(data)
        if out is not None:
            out.close()
        return _Written(files)

    def commit(self, messages) -> None:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        for m in messages:
            for part, name in m.files if m else ():
                fs.move(part, name)

    def abort(self, messages) -> None:
        fs, _ = file_system(self.path)
        for m in messages:
            for part, _ in m.files if m else ():
                fs.delete_file(part)


class _Parts(InputPartition):
    """Byte ranges (path, begin, end, size of the file)."""

    def __init__(self, parts: list[tuple[str, int, int, int]]):
        self.parts = parts


class Unreadable(Exception):
    """What stands here is no whole record."""


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: str, partition_bytes: int, permissive: bool):
        self.path, self.payload, self.partition_bytes, self.permissive = path, payload, partition_bytes, permissive
        self.wanted: list[tuple[str, list]] = []

    def pushFilters(self, filters):
        """Takes equality, membership and presence of header columns; the rest stays with Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            if name in _FROM_HEADER and isinstance(f, EqualTo):
                self.wanted.append((name, [f.value]))
            elif name in _FROM_HEADER and isinstance(f, In):
                self.wanted.append((name, list(f.value)))
            elif name in _FROM_HEADER and isinstance(f, IsNotNull):
                self.wanted.append((name, []))
            else:
                yield f

    def partitions(self):
        """Ranges of files, packed to a size, large files first.

        The size is partition_bytes, or less where that gives under 256 partitions, but no less than 4 MB. Every task
        that gets a range of a large file looks at the file's first member: if it notes no length, the task at the
        file's start reads all of it.
        """
        fs, root = file_system(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        files = sorted(((f.size, f.path) for f in found if f.is_file and re.search(r"\.warc(\.gz)?$", f.path)), reverse=True)
        size = min(self.partition_bytes, max(4 << 20, sum(n for n, _ in files) // 256))
        packed: list[list[tuple[str, int, int, int]]] = []
        room = 0
        for n, path in files:
            for begin in range(0, n, size):
                end = min(n, begin + size)
                if not packed or room < end - begin:
                    packed.append([])
                    room = size
                packed[-1].append((path, begin, end, n))
                room -= end - begin
        return [_Parts(p) for p in packed] or [_Parts([])]

    def read(self, partition):
        fs, _ = file_system(self.path)
        rows, held = [], 0
        for path, begin, end, size in partition.parts:
            with fs.open_input_file(path) as raw:
                signature = None
                if end - begin < size:
                    head = raw.read(_HEAD)
                    if head.startswith(_NOTED):
                        signature = head[: len(_NOTED) + 8]
                        begin = next_member(raw, begin, end, signature)
                    if begin is None or begin and not signature:
                        continue
                    raw.seek(begin)
                for row in self._records(path, raw, begin, end, signature):
                    rows.append(row)
                    held += len(row[-1] or b"") + 500
                    if held > 8 << 20:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows):
        kinds = {"position": pa.int64(), "content_length": pa.int64(), "header_payload_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(_COLUMNS, zip(*rows, strict=True), strict=True)], names=_COLUMNS)

    def _wants(self, headers: dict[str, str]) -> bool:
        for column, values in self.wanted:
            value = headers.get(_FROM_HEADER[column].lower())
            if value is None or values and value not in values:
                return False
        return True

    def _records(self, path: str, raw, begin: int, end: int, signature: bytes | None):
        """Rows of the records from begin on, up to the first member with the signature from end on, where the next range starts.

        Headers first; of a record that no predicate lets through, nothing else is decoded.
        """
        buffer = Buffer(raw, begin)
        while (head := buffer.peek(4)) and not (signature and buffer.at >= end and buffer.peek(len(signature)) == signature):
            at = buffer.at
            source = Member(buffer) if head[:2] == b"\x1f\x8b" else Plain(buffer)
            while True:
                try:
                    while source.more():
                        headers = parse_headers(source)
                        length = content_length(headers)
                        if self._wants(headers):
                            yield self._row(path, at, headers, source, length)
                        else:
                            source.skip(length)
                        if source.single:
                            break
                    source.finish()
                    break
                except (Unreadable, zlib.error) as e:
                    if not self.permissive:
                        raise ValueError(f"no whole WARC record in {path} at {at}: {e}") from e
                    if not self.wanted:
                        yield (path, at, *[None] * (len(_COLUMNS) - 4), str(e), None)
                    if not source.resume():
                        source.recover()
                        break

    def _row(self, path, at, headers, source, length):
        block, digest, size = None, None, None
        if self.payload != "false":
            block = source.read(length)
            if (headers.get("content-type") or "").startswith("application/http"):
                block = block.partition(b"\r\n\r\n")[2]
            size, digest = len(block), base64.b32encode(sha1(block).digest()).decode()
            if self.payload == "digest":
                block = None
        else:
            source.skip(length)
        own = headers.get("x-payload-bytes") or ""
        declared = int(own) if re.fullmatch("[0-9]{1,18}", own) else None
        return (path, at, *(headers.get(_FROM_HEADER[c].lower()) for c in ("record_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "payload_digest")), length, declared, size, digest, None, block)


def next_member(raw, begin: int, end: int, signature: bytes) -> int | None:
    """Offset of the first member of this file that starts in the range, by the signature that all its members share."""
    at, tail = begin, b""
    raw.seek(begin)
    while at - len(tail) < end and (got := raw.read(1 << 20)):
        data = tail + got
        found = data.find(signature)
        if found >= 0:
            place = at - len(tail) + found
            return place if place < end else None
        at += len(got)
        tail = data[-(len(signature) - 1) :]
    return None


def content_length(headers: dict[str, str]) -> int:
    """The length of a record's block; a header without one, or with what is no length, is unreadable."""
    value = headers.get("content-length")
    if value is None or not re.fullmatch("[0-9]{1,18}", value):
        raise Unreadable(f"Content-Length {value!r}"[:200])
    return int(value)


class Buffer:
    """Bytes of a file from an offset on with a look ahead; skipping forgets what is held and seeks over the rest."""

    def __init__(self, raw, at: int):
        self.raw, self.held, self.at = raw, bytearray(), at

    def peek(self, n: int) -> bytes:
        while len(self.held) < n and (more := self.raw.read(max(n - len(self.held), 1 << 20))):
            self.held += more
        return bytes(self.held[:n])

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        del self.held[: len(out)]
        self.at += len(out)
        return out

    def skip(self, n: int) -> int:
        """Leaves out n bytes, or those there are; how many there were."""
        kept = min(n, len(self.held))
        del self.held[:kept]
        gone = min(n - kept, self.raw.size() - self.raw.tell())
        if gone:
            self.raw.seek(self.raw.tell() + gone)
        self.at += kept + gone
        return kept + gone

    def go_to(self, at: int) -> None:
        self.held, self.at = bytearray(), at
        self.raw.seek(at)

    def seek_next(self, pattern: re.Pattern, after: int) -> None:
        """To the first match of a pattern of up to 16 bytes from the offset on, or to the end."""
        self.go_to(after)
        while True:
            data = self.peek(1 << 20)
            found = pattern.search(data)
            if found and (found.end() < len(data) or len(data) < 1 << 20):
                self.take(found.start())
                return
            if len(data) < 1 << 20:
                self.take(len(data))
                return
            self.take(len(data) - 16)


class Plain:
    """One record of a file without compression."""

    single = True

    def __init__(self, buffer: Buffer):
        self.buffer, self.start = buffer, buffer.at

    def more(self) -> bool:
        return bool(self.peek(1))

    def peek(self, n: int) -> bytes:
        return self.buffer.peek(n)

    def read(self, n: int) -> bytes:
        out = self.buffer.take(n)
        if len(out) < n:
            raise Unreadable("ends before its Content-Length")
        return out

    def skip(self, n: int) -> None:
        if self.buffer.skip(n) < n:
            raise Unreadable("ends before its Content-Length")

    def finish(self) -> None:
        while self.buffer.peek(1) in (b"\r", b"\n"):
            self.buffer.take(1)

    def resume(self) -> bool:
        return False

    def recover(self) -> None:
        """To the next line that starts as a record does."""
        self.buffer.seek_next(re.compile(rb"(?<=\n)WARC/[0-9]"), self.start + 1)


class Member:
    """One gzip member, inflated as far as it is read; one that notes its length holds a single record."""

    def __init__(self, buffer: Buffer):
        self.buffer, self.start = buffer, buffer.at
        head = buffer.peek(_HEAD)
        self.length = struct.unpack("<Q", head[-8:])[0] if len(head) == _HEAD and head.startswith(_NOTED) else None
        self.single = self.length is not None
        self.inflate = zlib.decompressobj(31)
        self.held = bytearray()

    def more(self) -> bool:
        while self.peek(1) in (b"\r", b"\n"):
            del self.held[:1]
        return bool(self.held)

    def _more(self) -> bool:
        if self.inflate.eof:
            return False
        raw = self.buffer.peek(32 << 10)
        if not raw:
            raise Unreadable("the gzip member has no end")
        self.held += self.inflate.decompress(raw)
        self.buffer.skip(len(raw) - len(self.inflate.unused_data))
        return True

    def peek(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        return bytes(self.held[:n])

    def read(self, n: int) -> bytes:
        out = self.peek(n)
        if len(out) < n:
            raise Unreadable("ends before its Content-Length")
        del self.held[:n]
        return out

    def skip(self, n: int) -> None:
        if self.length is not None:
            return
        while n > 0:
            self.peek(1)
            gone = min(n, len(self.held))
            if not gone:
                raise Unreadable("ends before its Content-Length")
            del self.held[:gone]
            n -= gone

    def finish(self) -> None:
        if self.length is not None and not self.inflate.eof:
            rest = self.start + self.length - self.buffer.at
            if rest < 0 or self.buffer.skip(rest) < rest:
                raise Unreadable("the gzip member has no end")
        else:
            while self._more():
                self.held.clear()

    def resume(self) -> bool:
        """Goes on at the next line of this member that starts as a record does, if there is one."""
        try:
            while not self.single:
                if found := re.compile(rb"\nWARC/[0-9]").search(self.held):
                    del self.held[: found.start() + 1]
                    return True
                del self.held[:-7]
                if not self._more():
                    break
        except (Unreadable, zlib.error):
            pass
        return False

    def recover(self) -> None:
        """To the next member that starts as a record does: right behind this one if its end is known, else by search."""
        search, at = re.compile(rb"\x1f\x8b\x08"), self.start + 1
        if self.inflate.eof:
            return
        if self.length is not None:
            self.buffer.go_to(self.start + self.length)
            if self.buffer.peek(3) in (b"\x1f\x8b\x08", b""):
                return
        while True:
            self.buffer.seek_next(search, at)
            at = self.buffer.at + 1
            head = self.buffer.peek(64 << 10)
            try:
                if not head or zlib.decompressobj(31).decompress(head, 5) == b"WARC/":
                    return
            except zlib.error:
                pass


def parse_headers(source) -> dict[str, str]:
    """Header names in lower case with their values; what is no record, or ends before its blank line, is unreadable."""
    size = 1024
    if source.peek(5) != b"WARC/":
        raise Unreadable("no record starts here")
    while True:
        head = source.peek(size)
        end = head.find(b"\r\n\r\n")
        if end >= 0:
            break
        if len(head) < size:
            raise Unreadable("headers without an end")
        size *= 4
    source.read(end + 4)
    out = {}
    for line in head[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out.setdefault(name.strip().lower(), value.strip())
    return out


class WarcSource(DataSource):
    """format("warc"): options path, payload (true, or digest: sizes and digests alone, or false: neither), mode (PERMISSIVE or FAILFAST), partitionBytes, fileBytes, level."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        mode, payload = self.options.get("mode", "PERMISSIVE").upper(), self.options.get("payload", "true").lower()
        if mode not in ("PERMISSIVE", "FAILFAST") or payload not in ("true", "digest", "false"):
            raise ValueError(f"mode {mode}, payload {payload}")
        return WarcReader(self.options["path"], payload, int(self.options.get("partitionBytes", 128 << 20)), mode == "PERMISSIVE")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("fileBytes", 1 << 30)), int(self.options.get("level", 1)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def digest_of(html) -> F.Column:
    """Base32 of nothing but the SHA-1, as bytes: equal payloads have equal ones."""
    return F.unhex(F.sha1(F.coalesce(html, F.lit("")).cast("binary")))


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, digest, refers_to: of equal payloads of at least least_bytes the largest page_id answers.

    The others refer to it; a null id is the smallest, rows that repeat the largest id all answer, smaller payloads
    are never revisits. The winners come from a partial aggregate by digest, so a hot payload costs one row a task.
    """
    sized = pages.select("page_id", "url", "html", digest_of(F.col("html")).alias("raw_digest"))
    big = F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes
    winners = sized.where(big).groupBy("raw_digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("copies")).where("copies > 1").select(F.col("raw_digest").alias("won_digest"), "winner")
    joined = sized.join(winners, sized["raw_digest"] == winners["won_digest"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("winner")) & F.col("won_digest").isNotNull(), F.col("winner"))
    return joined.select("page_id", "url", "html", base32(F.col("raw_digest")).alias("digest"), refers.alias("refers_to"))


def base32(raw) -> F.Column:
    """Base32 of 20 bytes, by four groups of five bytes."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    groups = [F.lpad(F.conv(F.substring(F.hex(raw), 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), digits, letters)


def write_pages(pages: DataFrame, path: str, least_bytes: int = 0, file_bytes: int = 1 << 30) -> None:
    register(pages.sparkSession)
    with_revisits(pages, least_bytes).write.format("warc").option("fileBytes", file_bytes).mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool | str = True, mode: str = "PERMISSIVE", partition_bytes: int = 128 << 20) -> DataFrame:
    """The records of all .warc and .warc.gz files below the path, in the columns of SCHEMA.

    Headers that a record lacks, and payloads that are not asked for, are null. What is no whole record is a row with
    `error`, unless a predicate on a header leaves it out. An empty folder, or a file without bytes, has no records.
    """
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("mode", mode).option("partitionBytes", partition_bytes).load(path)


def page_number(urn) -> F.Column:
    return F.regexp_extract(urn, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def page_index(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to from the archives.

    A response's figures are computed from its payload; a revisit has none, so its header's stand in. A record that cannot
    be read is an error here, as an index without it would be wrong.
    """
    rows = read(spark, path, payload="digest", mode="FAILFAST").where(F.col("record_type").isin("response", "revisit"))
    answers = F.col("record_type") == "response"
    return rows.select(
        page_number(F.col("record_id")).alias("page_id"),
        F.when(answers, F.col("payload_bytes")).otherwise(F.col("header_payload_bytes")).alias("payload_bytes"),
        F.when(answers, F.col("computed_digest")).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        "record_type",
        F.when(~answers, page_number(F.col("refers_to"))).alias("refers_to"),
    )
