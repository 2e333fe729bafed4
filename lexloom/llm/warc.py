"""WARC archives as a Spark data source: a writer of one gzip member a record, and a reader that splits archives anywhere.

    spark.dataSource.register(WarcSource)
    records.write.format("warc").mode("append").save(path)
    spark.read.format("warc").load(path)

An archive of gzip members has no index, so a task is given a range of bytes only. It scans its range for the gzip magic; a candidate is taken for a member if it
decodes to the head of a WARC record and if the members behind it follow one another without a gap to the end of the range and MARGIN beyond (the magic also occurs inside
compressed data, and an archive may lie inside a payload: such a chain breaks where the outer member goes on; only an archive within a payload that is longer than
a range and the margin together is not told apart). A task owns the records that
start inside its range and reads the last of them to its end. Ranges that begin a file need no search.

Files are reached through pyarrow's file systems by the path's scheme. Tasks write to a folder beside and the driver moves whole files at the commit, so that lost or
repeated tasks leave nothing in the archive.

Defined results: a null payload of a response is an empty one; a revisit has none. A null record id becomes `<urn:page:none>`; line breaks and other characters that
headers can't hold are percent-encoded in URIs; a null URI has no header. A range without a member of its own gives no rows, an empty table an archive with no records. A member that can't
be decoded, is cut short, lacks the WARC head or whose payload doesn't have its stated digest is an error, never a missing row. A record is held whole by a task, whatever its
length; of others only a bounded window.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from lexloom.llm.common import BROADCAST_ROWS, save, shared_dir

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 64 << 20
#: How far beyond its range a task looks whether members go on as they should, before it takes the first it found for one.
MARGIN = 4 << 20
#: Bytes that are read and decoded at a time.
WINDOW = 1 << 20
#: An archive file is closed beyond this.
FILE_BYTES = 1 << 30
#: Records and bytes of a batch that a task hands to Spark.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Payloads of fewer bytes are always stored.
LEAST_REVISIT = 100
SCHEMA = "record_id string, record_type string, target_uri string, date string, payload binary, payload_bytes long, payload_digest string, refers_to string, path string, offset long"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


# Records


def _uri(text: str) -> str:
    """A URI that is safe in a header: white space, controls and characters beyond ASCII percent-encoded."""
    return re.sub("[^!-~]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "replace")), text)


def record_bytes(kind: str, record_id: str | None, uri: str | None, date: str, payload: bytes, size: int, digest: str, refers_to: str | None) -> bytes:
    """A record of a page: the HTTP response, or for a revisit its head only, which still tells the length of the whole payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id or "<urn:page:none>"), ("WARC-Date", date)]
    head += [("WARC-Target-URI", _uri(uri))] if uri is not None else []
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        head += [("WARC-Refers-To", refers_to)] if refers_to is not None else []
    return _framed(head, block)


def _framed(head: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _fields(raw: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with a blank goes on with the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def parsed(data: bytes, path: str, offset: int) -> tuple:
    """A row of SCHEMA from a decoded member."""
    at = data.find(b"\r\n\r\n")
    if at < 0 or not data.startswith(b"WARC/"):
        raise ValueError(f"no WARC record at {path}:{offset}")
    head = _fields(data[:at])
    length = int(head.get("content-length", "-1"))
    block = data[at + 4 : at + 4 + max(length, 0)]
    if length < 0 or len(block) != length:
        raise ValueError(f"the record at {path}:{offset} is cut short")
    kind, payload, size = head.get("warc-type", ""), block, length
    if head.get("content-type", "").replace(" ", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(_fields(http).get("content-length", len(payload))) if kind == "revisit" else len(payload)
    digest = head.get("warc-payload-digest")
    if kind == "revisit":
        payload = None
    elif digest is None or digest.startswith("sha256:"):
        own = hashlib.sha256(payload).hexdigest()
        if digest not in (None, f"sha256:{own}"):
            raise ValueError(f"the payload at {path}:{offset} doesn't have its digest")
        digest = f"sha256:{own}"
    elif digest.startswith("sha1:") and digest[5:] != base64.b32encode(hashlib.sha1(payload).digest()).decode():
        raise ValueError(f"the payload at {path}:{offset} doesn't have its digest")
    return (head.get("warc-record-id"), kind, head.get("warc-target-uri"), head.get("warc-date"), payload, size, digest and digest.removeprefix("sha256:"), head.get("warc-refers-to"), path, offset)


# Reading by ranges


class Members:
    """Gzip members of a file, found from anywhere in it."""

    def __init__(self, file: pa.NativeFile, size: int):
        self.file, self.size = file, size
        self.base, self.held = 0, b""

    def at(self, offset: int) -> bytes:
        """Bytes from an offset on, up to the end of the window around it; empty at the end of the file."""
        if not self.base <= offset < self.base + len(self.held):
            self.base, self.held = offset, self.file.read_at(min(WINDOW, max(self.size - offset, 0)), offset)
        return self.held[offset - self.base :]

    def decoded(self, offset: int) -> Iterator[bytes | int]:
        """What a member holds, some bytes at a time, and last where the next one begins."""
        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            part = self.at(offset)
            if not part:
                raise ValueError("cut short")
            data = part
            while data and not unpack.eof:
                yield unpack.decompress(data, WINDOW)
                data = unpack.unconsumed_tail
            offset += len(part) - len(unpack.unused_data)
        yield offset

    def whole(self, offset: int) -> tuple[bytes, int]:
        *parts, end = self.decoded(offset)
        return b"".join(parts), end

    def end(self, offset: int) -> int:
        """Where a member ends; nothing is kept."""
        for x in self.decoded(offset):
            last = x
        return last

    def is_record(self, offset: int) -> bool:
        """Whether a member that begins like a record stands here."""
        head = self.at(offset)
        if len(head) < 32 and self.base + len(self.held) < self.size:
            self.held = b""
            head = self.at(offset)
        if not head.startswith(MAGIC) or len(head) < 4 or head[3] & 0xE0:
            return False
        try:
            found = b""
            for x in self.decoded(offset):
                if isinstance(x, int) or len(found) >= 5:
                    break
                found += x
            return found.startswith(b"WARC/")
        except (zlib.error, ValueError):
            return False

    def chained(self, offset: int, end: int) -> bool:
        """Whether members follow one another from here to an end, and a record or the end of the file comes then."""
        try:
            while offset < end:
                offset = self.end(offset)
                if offset < self.size and not self.is_record(offset):
                    return False
            return True
        except (zlib.error, ValueError):
            return False

    def first(self, begin: int, end: int) -> int | None:
        """The first member that starts inside a range."""
        offset = begin
        while offset < end:
            part = self.at(offset)
            found = part.find(MAGIC)
            if found < 0:
                step = max(len(part) - len(MAGIC) + 1, 1)
                if step < len(MAGIC) and offset + len(part) >= self.size:
                    return None
                offset += step
                if offset > self.base + len(self.held) - len(MAGIC):
                    self.held = b""  # the magic may lie across two windows
                continue
            offset += found
            if offset < end and self.is_record(offset) and self.chained(offset, min(end + MARGIN, self.size)):
                return offset
            offset += 1
        return None


@dataclass
class ByteRange(InputPartition):
    path: str
    size: int
    begin: int
    end: int


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.keep = options.get("payload", "true").lower() != "false"

    def partitions(self) -> list[ByteRange]:
        system, root = file_system(self.path)
        found = system.get_file_info(root)
        files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f for f in files if f.type == fs.FileType.File and not re.search(r"/[._]", f.path.removeprefix(root))), key=lambda f: f.path)
        return [ByteRange(f.path, f.size, at, min(at + self.split, f.size)) for f in files for at in range(0, f.size, self.split)] or [ByteRange("", 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        if partition.size:
            system, _ = file_system(self.path)
            with system.open_input_file(partition.path) as file:
                members = Members(file, partition.size)
                at = members.first(partition.begin, partition.end) if partition.begin else 0
                while at is not None and at < partition.end:
                    data, end = members.whole(at)
                    row = parsed(data, partition.path, at)
                    rows.append(row if self.keep else (*row[:4], None, *row[5:]))
                    held += len(row[4] or b"") if self.keep else 0
                    at = end
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 4 + [pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


# Writing


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Rows of the columns record_id, record_type (response or revisit), target_uri, date, payload, payload_bytes, payload_digest, refers_to; others are left out."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.level = int(options.get("level", 6))
        self.job = uuid.uuid4().hex

    def _folder(self) -> tuple[fs.FileSystem, str, str]:
        system, root = file_system(self.path)
        return system, root, f"{root}/_temporary-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, _, folder = self._folder()
        system.create_dir(folder, recursive=True)
        files: list[str] = []
        out = None
        try:
            for batch in iterator:
                columns = [batch.column(batch.schema.get_field_index(n)) for n in ("record_type", "record_id", "target_uri", "date", "payload", "payload_bytes", "payload_digest", "refers_to")]
                for row in zip(*columns, strict=True):
                    kind, record_id, uri, date, payload, size, digest, refers_to = (x.as_py() for x in row)
                    if out is None or out.tell() >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out = system.open_output_stream(f"{folder}/{files[-1]}", compression=None)
                        info = b"software: lexloom\r\nformat: WARC File Format 1.1\r\n"
                        out.write(member(_framed([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", files[-1]), ("Content-Type", "application/warc-fields")], info), self.level))
                    out.write(member(record_bytes(kind, record_id, uri, date, payload or b"", size, digest, refers_to), self.level))
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root, folder = self._folder()
        for name in (f for m in messages if m for f in m.files):
            system.move(f"{folder}/{name}", f"{root}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, _, folder = self._folder()
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only added to; write with mode('append')")
        return WarcWriter(dict(self.options))


# Pages


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _page_id(urn: Column) -> Column:
    return F.regexp_extract(urn, "^<urn:page:(.*)>$", 1).try_cast("long")


def page_records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Rows for the writer from page_id, url, html (null: empty). Of pages with equal payloads of at least `least` bytes those with the smallest page_id are responses, the others revisit it.

    A null page_id is larger than any other; where all are null, all are responses.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    digest, size = F.sha2("payload", 256), F.octet_length("payload").cast("long")
    # Only ids and digests are moved to find what repeats; copies are counted before they meet.
    repeated = own.select("page_id", size.alias("n"), digest.alias("payload_digest")).filter(F.col("n") >= least)
    repeated = repeated.groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1 and _first is not null").drop("_n")
    repeated = save(pages.sparkSession, repeated, "repeated")
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    found = own.withColumn("payload_bytes", size).withColumn("payload_digest", digest).join(repeated, "payload_digest", "left")
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return found.select(
        _urn(F.col("page_id")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        F.when(~again, F.col("payload")).alias("payload"),
        "payload_bytes",
        "payload_digest",
        F.when(again, _urn(F.col("_first"))).alias("refers_to"),
    )


def write_pages(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> None:
    pages.sparkSession.dataSource.register(WarcSource)
    page_records(pages, least).write.format("warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True, split: int = SPLIT_BYTES) -> DataFrame:
    """Records of all archives under a path, by ranges of `split` bytes; without payloads where only what is told of them is needed."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("splitBytes", split).option("payload", str(payload).lower()).load(path)


def restored(records: DataFrame) -> DataFrame:
    """Responses and revisits, each with its whole payload: a revisit's is that of the response it refers to. Responses must have ids of their own."""
    stored = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("payload").alias("_stored"))
    return records.filter("record_type in ('response', 'revisit')").join(stored, "refers_to", "left").withColumn("payload", F.coalesce("payload", "_stored")).drop("_stored")


def round_trip(pages: DataFrame, split: int = SPLIT_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (page_id), as read back from an archive of the pages in the shared folder."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_pages(pages, path)
    found = read_archive(spark, path, payload=False, split=split).filter("record_type in ('response', 'revisit')")
    return found.select(_page_id(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", _page_id(F.col("refers_to")).alias("refers_to"))
