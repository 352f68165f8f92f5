"""WARC archives as a Spark data source, and page archives with revisit records.

Archives are read by file: small files share a task. A record's headers are parsed first and tested with the record-type and header predicates;
a block that is not wanted is skipped, by seeking where the archive is plain or its gzip members say how long they are, else by inflating it away.
The payload is decoded only where the read schema has a payload column. Files are opened through Arrow's file systems (local, HDFS, S3, ...), so a path means the
same on driver and executors. Writers stage their files and the driver's commit publishes those of successful attempts alone.
"""

from __future__ import annotations

import contextlib
import io
import posixpath
import re
import struct
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from ._common import Tables, cut, read, remove, scratch

SCHEMA = "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, content_type string, content_length long, headers map<string,string>, payload binary, file string, offset long"
#: Fixed values of the WARC 1.1 format: header names of the columns, and the revisit profile.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "content_type": "Content-Type"}
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 16
BATCH_BYTES, BATCH_ROWS = 1 << 22, 1000


class BrokenArchive(ValueError):
    """An archive that breaks the format, with file and position."""


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def _hidden(path: str) -> bool:
    return posixpath.basename(path).startswith(("_", "."))


# ---- reading ----------------------------------------------------------------------------------------------------------


class Plain:
    """An uncompressed archive: skipping is seeking."""

    def __init__(self, raw):
        self.raw = raw

    def at(self) -> int:
        return self.raw.tell()

    def more(self) -> bool:
        return bool(self.raw.peek(1))

    def line(self) -> bytes:
        return self.raw.readline(1 << 20)

    def take(self, n: int) -> bytes:
        return self.raw.read(n)

    def begin(self) -> int:
        return self.at()

    def skip(self, n: int) -> None:
        self.raw.seek(n - 1, io.SEEK_CUR)
        if not self.raw.read(1):
            raise EOFError


class Members:
    """A gzip archive as one stream of bytes that knows where members begin and, if they say so, where they end."""

    def __init__(self, raw):
        self.raw, self.buffer, self.inflate, self.start, self.end, self.size, self.given = raw, b"", None, 0, None, None, 0

    def _open_member(self) -> bool:
        """Start the next member; its optional ``sl`` field has the compressed and the uncompressed length."""
        while (pad := self.raw.peek(1)[:1]) == b"\0":  # padding between members
            self.raw.read(1)
        if not pad:
            return False
        self.start, self.end, self.size, self.given = self.raw.tell(), None, None, 0
        head = self.raw.read(12)
        if len(head) == 12 and head[3] & 4:
            (n,) = struct.unpack("<H", head[10:])
            extra = self.raw.read(n)
            while len(extra) >= 4:
                tag, (size,) = extra[:2], struct.unpack("<H", extra[2:4])
                if tag == b"sl" and size == 8:
                    packed, self.size = struct.unpack("<II", extra[4:12])
                    self.end = self.start + packed
                extra = extra[4 + size :]
        self.raw.seek(self.start)
        self.inflate = zlib.decompressobj(31)
        return True

    def _fill(self, least: int, cross: bool = True) -> None:
        """Have ``least`` bytes at hand, from the next member too only if that is asked for or nothing is left of this one."""
        while len(self.buffer) < least:
            if self.inflate is None and ((self.buffer and not cross) or not self._open_member()):
                return
            packed = self.inflate.unconsumed_tail or self.raw.read(CHUNK)
            if not packed:
                raise EOFError
            out = self.inflate.decompress(packed, max(CHUNK, least - len(self.buffer)))
            self.given += len(out)
            self.buffer += out
            if self.inflate.eof:
                self.raw.seek(-len(self.inflate.unused_data), io.SEEK_CUR)
                self.inflate = None

    def at(self) -> int:
        return self.start

    def more(self) -> bool:
        self._fill(1)
        return bool(self.buffer)

    def line(self) -> bytes:
        while (at := self.buffer.find(b"\n")) < 0 and (before := len(self.buffer)) < 1 << 20:
            self._fill(before + 512, cross=False)
            if len(self.buffer) == before:
                self._fill(before + 1)
            if len(self.buffer) == before:
                break
        out, self.buffer = (self.buffer, b"") if at < 0 else (self.buffer[: at + 1], self.buffer[at + 1 :])
        return out

    def take(self, n: int) -> bytes:
        self._fill(n)
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        return out

    def begin(self) -> int:
        """Offset of the member that the record starts in; afterwards ``skip`` knows if the record fills the member."""
        self.whole, self.begun = self.end is not None and self.given == len(self.buffer), self.start
        return self.start

    def skip(self, n: int) -> None:
        if self.whole and self.start == self.begun and self.size == self.given - len(self.buffer) + n:
            self.raw.seek(self.end - 1)
            self.buffer, self.inflate = b"", None
            if not self.raw.read(1):
                raise EOFError
            return
        while n:
            self._fill(1)
            if not self.buffer:
                raise EOFError
            step = min(n, len(self.buffer))
            self.buffer, n = self.buffer[step:], n - step


def read_headers(lines) -> tuple[str, dict[str, str]]:
    """First line and headers of a block of lines, names as written; a repeated name's values are joined by ``, ``."""
    first, out, name = lines().rstrip(b"\r\n").decode("utf-8", "replace"), {}, None
    while (line := lines()).strip():
        text = line.rstrip(b"\r\n").decode("utf-8", "replace")
        if text[0] in " \t" and name:  # a folded line
            out[name] += " " + text.strip()
            continue
        name, found, value = text.partition(":")
        if not found:
            raise ValueError(f"no header: {text[:80]!r}")
        out[name] = f"{out[name]}, {value.strip()}" if name in out else value.strip()
    return first, out


def http_payload(block: bytes) -> bytes:
    """What follows the HTTP headers of a response block."""
    for end in (b"\r\n\r\n", b"\n\n"):
        if (at := block.find(end)) >= 0:
            return block[at + len(end) :]
    return b""


def records(raw, compressed: bool, wanted, payloads: bool):
    """(offset, headers, payload or None) of each record that ``wanted`` (of its columns) accepts; others are skipped unread."""
    stream = Members(raw) if compressed else Plain(raw)
    while True:
        offset = stream.at()
        try:
            if not stream.more():
                return
            offset = stream.begin()
            version, headers = read_headers(stream.line)
            if not version.startswith("WARC/"):
                raise ValueError(f"no record: {version[:40]!r}")
            lower = {k.lower(): v for k, v in headers.items()}
            length = int(lower["content-length"])
            row = {c: lower.get(h.lower()) for c, h in HEADERS.items()} | {"content_length": length, "headers": headers, "offset": offset}
            if wanted(row):
                if payloads:
                    block = stream.take(length)
                    if len(block) < length:
                        raise EOFError
                    http = (row["content_type"] or "").lower().startswith("application/http")
                    row["payload"] = http_payload(block) if http else block
                    stream.take(4)
                else:
                    stream.skip(length + 4)
                yield row
            else:
                stream.skip(length + 4)
        except (ValueError, KeyError, EOFError, zlib.error) as e:
            raise BrokenArchive(f"at {offset}: {type(e).__name__} {e}") from e


def _compare(kind, value, want):
    if kind is EqualNullSafe:
        return value == want
    if kind is IsNull:
        return value is None
    if kind is IsNotNull:
        return value is not None
    if value is None:
        return None
    tests = {EqualTo: lambda: value == want, In: lambda: value in want, GreaterThan: lambda: value > want, GreaterThanOrEqual: lambda: value >= want, LessThan: lambda: value < want, LessThanOrEqual: lambda: value <= want,
             StringStartsWith: lambda: value.startswith(want), StringEndsWith: lambda: value.endswith(want), StringContains: lambda: want in value}
    return None if want is None else tests[kind]()


def holds(test, row: dict):
    """A pushed filter on a record's header columns, by three-valued logic."""
    if isinstance(test, Not):
        inner = holds(test.child, row)
        return None if inner is None else not inner
    return _compare(type(test), row.get(test.attribute[0]), getattr(test, "value", None))


_PUSHED = (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith, StringEndsWith, StringContains)


def supported(test) -> bool:
    if isinstance(test, Not):
        return supported(test.child)
    if not isinstance(test, _PUSHED) or len(test.attribute) != 1:
        return False
    ordered = isinstance(test, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual))
    return test.attribute[0] == "content_length" or (test.attribute[0] in HEADERS and not ordered)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.path, self.columns, self.tests = options["path"], schema.fieldNames(), []
        self.types = pa.schema([(f.name, _ARROW[f.name]) for f in schema.fields])
        self.target, self.permissive = int(options.get("targetBytes", 128 << 20)), options.get("mode", "failfast").lower() == "permissive"
        if kinds := options.get("types"):
            self.tests.append(In(("record_type",), tuple(k.strip() for k in kinds.split(","))))
        self.tests += [EqualTo((f"header:{k[7:].lower()}",), v) for k, v in options.items() if k.lower().startswith("header.")]

    def partitions(self):
        fs, base = _file_system(self.path)
        info = fs.get_file_info(base)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(base, recursive=True))
        found = sorted((f for f in found if f.is_file and not any(_hidden(p) for p in f.path[len(base) :].split("/") if p)), key=lambda f: f.path)
        out, size = [], 0
        for f in found:
            if not out or size + f.size > self.target:
                out.append([])
                size = 0
            out[-1].append(f.path)
            size += f.size
        return [Files(p) for p in out] or [Files([])]

    def read(self, partition):
        fs, _ = _file_system(self.path)

        def wanted(row):
            if any(t.attribute[0].startswith("header:") for t in self.tests if not isinstance(t, Not)):
                row = row | {f"header:{k.lower()}": v for k, v in row["headers"].items()}
            return all(holds(t, row) for t in self.tests)

        rows, size = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as f, io.BufferedReader(f, 1 << 18) as raw:
                try:
                    for row in records(raw, path.endswith(".gz"), wanted, "payload" in self.columns):
                        rows.append(row | {"file": path})
                        size += len(row.get("payload") or b"") + 1000
                        if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                            yield self._batch(rows)
                            rows, size = [], 0
                except BrokenArchive as e:
                    if not self.permissive:  # else what stands before the break is kept
                        raise BrokenArchive(f"{path} {e}") from e
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        columns = [pa.array([list(r["headers"].items()) if c == "headers" else r.get(c) for r in rows], t) for c, t in zip(self.columns, self.types.types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, schema=self.types)


class PushingReader(WarcReader):
    def pushFilters(self, filters):
        for f in filters:
            if supported(f):
                self.tests.append(f)
            else:
                yield f


_ARROW = {c: pa.string() for c in (*HEADERS, "file")} | {"content_length": pa.int64(), "offset": pa.int64(), "payload": pa.binary(), "headers": pa.map_(pa.string(), pa.string())}


# ---- writing ----------------------------------------------------------------------------------------------------------


def _clean(value: str) -> str:
    """A header value: control characters and blanks at its ends would break the header and are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]|^ | $", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(row: dict) -> bytes:
    """One record: responses and revisits with an HTTP block, others with the payload as their block."""
    kind, payload = row["record_type"], row.get("payload") or b""
    if kind in ("response", "revisit"):
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n" if kind == "response" else "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        block, content_type = head.encode() + (payload if kind == "response" else b""), "application/http;msgtype=response"
    else:
        block, content_type = payload, row.get("content_type") or "application/octet-stream"
    lines = ["WARC/1.1", *(f"{HEADERS[c]}: {_clean(row[c])}" for c in ("record_type", "record_id", "date", "target_uri", "refers_to", "payload_digest") if row.get(c) is not None)]
    if kind == "revisit":
        lines.append(f"WARC-Profile: {IDENTICAL}")
    lines += [f"Content-Type: {_clean(content_type)}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose ``sl`` field has its compressed and uncompressed length (absent where they exceed 32 bits)."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 10 + 14 + len(body) + 8
    if total >= 1 << 32 or len(data) >= 1 << 32:
        return struct.pack("<4sIBB", b"\x1f\x8b\x08\0", 0, 0, 255) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    extra = b"sl" + struct.pack("<HII", 8, total, len(data))
    return struct.pack("<4sIBBH", b"\x1f\x8b\x08\x04", 0, 0, 255, len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data))


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex
        self.suffix = ".warc" if options.get("compression", "gzip") == "none" else ".warc.gz"
        self.level, self.roll = int(options.get("level", 6)), int(options.get("maxFileBytes", 1 << 30))
        self.date = options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator):
        fs, base = _file_system(f"{self.path}/_staging-{self.job}")
        fs.create_dir(base, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                for k in range(batch.num_rows):
                    row = {c: batch.column(i)[k].as_py() for i, c in enumerate(batch.schema.names)}
                    data = record_bytes({"date": self.date} | {c: v for c, v in row.items() if v is not None})
                    data = data if self.suffix == ".warc" else member(data, self.level)
                    if out is None or size + len(data) > self.roll:
                        if out is not None:
                            out.close()
                        names.append(f"{uuid.uuid4().hex}{self.suffix}")
                        out, size = fs.open_output_stream(f"{base}/{names[-1]}", compression=None), 0
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages):
        fs, base = _file_system(self.path)
        old = [f for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if f.is_file and not _hidden(f.path)] if self.overwrite else []
        for m in messages:
            for name in m.names if m else []:
                fs.move(f"{base}/_staging-{self.job}/{name}", f"{base}/{name}")
        for f in old:
            fs.delete_file(f.path)
        self.abort(messages)

    def abort(self, messages):
        fs, base = _file_system(f"{self.path}/_staging-{self.job}")
        if fs.get_file_info(base).type != pafs.FileType.NotFound:
            fs.delete_dir(base)


class WarcSource(DataSource):
    """Format ``warc``. Read options: ``types`` (record types, comma-separated), ``header.<Name>`` (exact value of any header), ``mode`` (``permissive`` keeps what stands before a break),
    ``targetBytes`` of a task, and ``pushdown`` = true in sessions with ``spark.sql.python.filterPushdown.enabled``, so that filters on header columns are tested before a block is read.
    A read schema of fewer columns is allowed; without ``payload`` no block is decoded. Write options: ``compression`` (gzip or none), ``level``, ``maxFileBytes``, ``date``.
    Rows to write have ``record_type``, ``record_id`` and any of ``date``, ``target_uri``, ``refers_to``, ``payload_digest``, ``content_type``, ``payload``; a null value is no header, a null payload empty."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return (PushingReader if self.options.get("pushdown", "false").lower() == "true" else WarcReader)(self.options, schema)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


@contextlib.contextmanager
def pushing(spark: SparkSession):
    """Filter pushdown into Python sources for the jobs that run inside; the session's own setting comes back."""
    name = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def archived(spark: SparkSession, path: str, columns: list[str] | None = None, **options: str) -> DataFrame:
    """The records under ``path`` with the named columns (all of them by default)."""
    spark.dataSource.register(WarcSource)
    every = T._parse_datatype_string(SCHEMA)
    return spark.read.format("warc").schema(T.StructType([every[c] for c in columns or every.fieldNames()])).options(**options).load(path)


def with_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", uri_col: str = "url", least: int = 100) -> DataFrame:
    """Records of pages: of equal payloads of at least ``least`` bytes that with the smallest id is the response, and the others revisit it.

    Null text is an empty payload. Repeated rows of the smallest id are responses all of them; a null id is larger than any other, and pages without any id are responses.
    First ids are found by partial minima a digest; only digests that occur more than once are written and joined back. The planner knows that table's size: payloads
    move only if it is too large to be broadcast under the session's threshold (then by a join that splits hot digests).
    """
    payload = F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{uri_col}`").cast("string").alias("target_uri"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    urn = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("")), F.lit(":"), F.substring("digest", 1, 16), F.lit(">"))
    large = rows.where(F.octet_length("payload") >= least)
    firsts = large.groupBy(F.col("digest").alias("d")).agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("d", "first")
    firsts = cut(firsts)
    x = rows.join(firsts, (F.col("digest") == F.col("d")) & (F.octet_length("payload") >= least), "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return x.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), urn(F.col("id")).alias("record_id"), "target_uri",
        F.when(again, urn(F.col("first"))).alias("refers_to"), F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), F.when(~again, F.col("payload")).alias("payload"),
    )


def write_archive(spark: SparkSession, rows: DataFrame, path: str, **options: str) -> None:
    spark.dataSource.register(WarcSource)
    rows.write.format("warc").mode("append").options(**options).save(path)


def resolved(responses: DataFrame, revisits: DataFrame) -> DataFrame:
    """(record_id, payload_bytes, digest, record_type, refers_to) of responses, and of revisits with their response's size and digest.

    Responses of one record id are equal; a revisit whose response is not there has nulls.
    """
    once = responses.groupBy(F.col("record_id").alias("refers_to")).agg(F.first("payload_bytes").alias("payload_bytes"), F.first("digest").alias("digest"))
    own = responses.select("record_id", "payload_bytes", "digest", F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to"))
    return own.unionByName(revisits.join(once, "refers_to", "left").select("record_id", "payload_bytes", "digest", F.lit("revisit").alias("record_type"), "refers_to"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back: responses with their payloads, revisits by headers alone."""
    path, tables = scratch(spark, "warc"), Tables(spark)
    write_archive(spark, with_revisits(read(spark, sf_dir, "pages")), path)
    with pushing(spark):
        responses = archived(spark, path, ["record_type", "record_id", "payload"], pushdown="true").where("record_type = 'response'")
        responses = tables.cut(responses.select("record_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("digest")), "responses")
        revisits = archived(spark, path, ["record_type", "record_id", "refers_to"], pushdown="true").where("record_type = 'revisit'")
        revisits = tables.cut(revisits.select("record_id", "refers_to"), "revisits")
    remove(spark, path)
    page = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(-?\\d*):", 1), F.lit("")).cast("long")
    return resolved(responses, revisits).select(page("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))


OP12_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), r AS (
  SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM r
"""
