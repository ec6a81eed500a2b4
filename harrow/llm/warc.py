"""WARC archives: a Python data source that reads and writes them, and identical-payload revisits."""

from __future__ import annotations

import fnmatch
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from harrow.llm.common import identified, materialise

#: Named header fields, as columns; fixed by the WARC standard.
HEADER_COLUMNS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To",
}
READ_DDL = (
    "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, "
    "payload_length long, payload binary, file string, file_offset long"
)
WRITE_DDL = "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, payload_length long, payload binary"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = pa.schema([
    *((c, pa.string()) for c in HEADER_COLUMNS), ("payload_length", pa.int64()), ("payload", pa.binary()),
    ("file", pa.string()), ("file_offset", pa.int64()),
])
CHUNK = 1 << 18


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it of a uri or plain path, so that archives may lie in any shared store."""
    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


def record_bytes(row: dict) -> bytes:
    """A response or revisit record; the HTTP head tells the length of the full payload in both."""
    revisit = row["record_type"] == "revisit"
    payload = b"" if revisit else row["payload"] or b""
    length = row["payload_length"] if row["payload_length"] is not None else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    head = [f"{field}: {row[column]}" for column, field in HEADER_COLUMNS.items() if row[column] is not None]
    head = [line.replace("\r", " ").replace("\n", " ") for line in head]
    if revisit:
        head.append(f"WARC-Profile: {REVISIT_PROFILE}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(["WARC/1.1", *head, "", ""]).encode() + http + payload + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes gzip members, one per record, to files of its own; a failed job's files are removed.

    Files get a name without the archive ending until the job commits, so readers never see half a file or a
    file of a lost attempt; a job removes those when it ends.
    """

    def __init__(self, path: str, max_file_bytes: int, level: int):
        self.path, self.max_file_bytes, self.level = path.rstrip("/"), max_file_bytes, level
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = filesystem(self.path)
        store.create_dir(folder, recursive=True)
        files, sink, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if sink is None:
                    files.append(f"{folder}/{self.job}-{uuid.uuid4().hex}")
                    sink, size = store.open_output_stream(f"{files[-1]}.part"), 0
                packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                data = packer.compress(record_bytes(row)) + packer.flush()
                sink.write(data)
                size += len(data)
                if size >= self.max_file_bytes:
                    sink.close()
                    sink = None
        if sink is not None:
            sink.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = filesystem(self.path)
        for file in (f for m in messages if m for f in m.files):
            store.move(f"{file}.part", f"{file}.warc.gz")
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        """Remove what attempts of this job have left, their messages lost or not."""
        store, folder = filesystem(self.path)
        for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.base_name.startswith(f"{self.job}-") and info.base_name.endswith(".part"):
                store.delete_file(info.path)


class Malformed(ValueError):
    """A record that breaks the standard."""


class Inflater:
    """A stream of bytes from gzip members or plain data, read forward; ``skip`` makes no copies of what it passes."""

    def __init__(self, source: pa.NativeFile):
        self.source, self.raw, self.plain = source, b"", b""
        self.gzip: bool | None = None
        self.unpacker = zlib.decompressobj(31)
        self.taken = 0  # compressed bytes used up

    def _more(self) -> bool:
        if not self.raw:
            self.raw = self.source.read(CHUNK)
            if not self.raw:
                return False
        if self.gzip is None:
            self.gzip = self.raw[:2] == b"\x1f\x8b"
        if not self.gzip:
            self.plain += self.raw
            self.taken += len(self.raw)
            self.raw = b""
            return True
        before = len(self.raw)
        try:
            self.plain += self.unpacker.decompress(self.raw, CHUNK)
        except zlib.error as e:
            self.raw, self.source = b"", pa.BufferReader(b"")  # nothing behind can be unpacked
            raise Malformed(f"archive can't be unpacked: {e}") from e
        if self.unpacker.eof:
            self.raw, self.unpacker = self.unpacker.unused_data, zlib.decompressobj(31)
        else:
            self.raw = self.unpacker.unconsumed_tail
        self.taken += before - len(self.raw)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes before ``mark``, which is passed over; None at the end of the data."""
        at = 0
        while (found := self.plain.find(mark, at)) < 0:
            at = max(0, len(self.plain) - len(mark) + 1)
            if not self._more():
                return None
        out, self.plain = self.plain[:found], self.plain[found + len(mark) :]
        return out

    def take(self, size: int) -> bytes:
        parts, missing = [], size
        while missing:
            if not self.plain and not self._more():
                raise Malformed("archive ends inside a record")
            part = self.plain[:missing]
            self.plain = self.plain[len(part) :]
            parts.append(part)
            missing -= len(part)
        return b"".join(parts)

    def skip(self, size: int) -> None:
        while size:
            if not self.plain and not self._more():
                raise Malformed("archive ends inside a record")
            passed = min(size, len(self.plain))
            self.plain = self.plain[passed:]
            size -= passed


def one_record(stream: Inflater, wanted: list[tuple[str, frozenset]], payload: bool) -> dict | None:
    """The next record, empty if it is not wanted; None at the end."""
    at = stream.taken
    head = stream.until(b"\r\n\r\n")
    if head is None:
        return None
    lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        fields.setdefault(name.strip().lower(), value.strip())
    size = fields.get("content-length", "")
    if not lines[0].startswith("WARC/") or not (size.isascii() and size.isdigit()):
        raise Malformed(f"no record with a length at byte {at}")
    length = int(size)
    row: dict = {c: fields.get(f.lower()) for c, f in HEADER_COLUMNS.items()}
    if not all(row[c] in values for c, values in wanted):
        stream.skip(length + 4)
        return {}
    row |= {"payload_length": length, "payload": None, "file_offset": at}
    if fields.get("content-type", "").startswith("application/http"):
        http = stream.until(b"\r\n\r\n")
        if http is None or len(http) + 4 > length:
            raise Malformed(f"no whole http head at byte {at}")
        length -= len(http) + 4
        named = (line.partition(b":") for line in http.split(b"\r\n")[1:])
        told = next((v.strip() for n, _, v in named if n.strip().lower() == b"content-length"), b"")
        row["payload_length"] = int(told) if told.isdigit() else length
    if payload and row["record_type"] != "revisit":
        row["payload"] = stream.take(length)
    else:
        stream.skip(length)
    stream.skip(4)
    return row


def records(source: pa.NativeFile, wanted: list[tuple[str, frozenset]], payload: bool, mark: bool = False) -> Iterator[dict]:
    """Records whose headers meet all predicates (column, allowed values); the bodies of others are only passed over.

    A malformed record is an error, or with ``mark`` a row of the type ``malformed`` that holds its place alone; reading
    then goes on at the next record that can be found.
    """
    stream = Inflater(source)
    while True:
        at = stream.taken
        try:
            row = one_record(stream, wanted, payload)
            if row is None:
                return
        except Malformed as e:
            if not mark:
                raise Malformed(f"malformed record: {e}") from e
            row = dict.fromkeys(HEADER_COLUMNS) | {"record_type": "malformed", "payload_length": None, "payload": None, "file_offset": at}
            if any(c != "record_type" or "malformed" not in values for c, values in wanted):
                row = {}
            try:
                found = stream.until(b"WARC/1.")
            except Malformed:
                found = None
            if found is None:
                yield from [row] if row else []
                return
            stream.plain = b"WARC/1." + stream.plain
        if row:
            yield row


@dataclass
class File(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    """One partition per archive file. Equality and IN predicates on header columns are pushed down to the reader."""

    def __init__(self, path: str, pattern: str, payload: bool, mark: bool = False):
        self.path, self.pattern, self.payload, self.mark = path, pattern, payload, mark
        self.wanted: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in HEADER_COLUMNS:
                self.wanted.append((f.attribute[0], frozenset(f.value if isinstance(f, In) else [f.value])))
            else:
                yield f

    def partitions(self) -> list[File]:
        """The archives; one without a name if there are none, as Spark asks for one partition at least."""
        store, folder = filesystem(self.path)
        info = store.get_file_info(folder)
        if info.type == fs.FileType.NotFound:
            return [File("")]
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(folder, recursive=True))
        return [File(i.path) for i in found if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, self.pattern)] or [File("")]

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        if partition is None or not partition.path:
            return
        store, _ = filesystem(self.path)
        held: list[dict] = []
        weight = 0
        with store.open_input_stream(partition.path) as source:
            for row in records(source, self.wanted, self.payload, self.mark):
                held.append(row | {"file": partition.path})
                weight += len(row["payload"] or b"")
                if len(held) >= 2000 or weight >= 8 << 20:
                    yield pa.RecordBatch.from_pylist(held, schema=READ_SCHEMA)
                    held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=READ_SCHEMA)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(folder)`` and ``df.write.format("warc").mode("append").save(folder)``.

    Options: ``pattern`` of file names, ``payload`` (false: bodies are never decoded), ``malformed`` (``fail``, or ``mark``:
    such records are rows of the type ``malformed``), ``maxFileBytes``, ``level``. A folder without archives has no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_DDL

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("pattern", "*.warc*"), self.options.get("payload", "true") != "false", self.options.get("malformed", "fail") == "mark")

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only appended to")
        return WarcWriter(self.options["path"], int(self.options.get("maxFileBytes", 256 << 20)), int(self.options.get("level", 1)))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def page_records(pages: DataFrame, min_bytes: int = 1000, date: datetime = datetime(2024, 1, 1, tzinfo=UTC)) -> DataFrame:
    """A record per row of ``pages`` (page_id, url, html), as the writer takes it.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the largest page_id (then the last by
    position) is the response and the others revisit it; smaller payloads are all responses. Null html counts as
    empty, a null page_id as smaller than any, a null url leaves its header out. Repeated rows have a record each; an
    empty table has none; other columns are left out.

    Copies meet as digests; whole pages move once, by their rows' names, so that a page that is repeated very often
    burdens no single task.
    """
    named, row = identified(pages)
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = named.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"),
        F.octet_length(body).cast("long").alias("payload_length"), F.sha1(body).alias("digest"), F.col(row).alias("row_id"),
    )
    place = F.struct(F.col("page_id"), F.col("row_id"))
    digests = materialise(rows.where(F.col("payload_length") >= min_bytes).select("digest", "payload_length", "page_id", "row_id"), "digests")
    first = digests.groupBy("digest", "payload_length").agg(F.max(place).alias("keeper"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    first = materialise(first.drop("copies"), "keepers")
    copies = digests.join(first, ["digest", "payload_length"]).where(place != F.col("keeper")).select("row_id", "keeper")
    joined = rows.join(copies, "row_id", "left")
    revisit = F.col("keeper").isNotNull()

    def name(page: Column, row_id: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), F.hex(F.xxhash64(row_id)), F.lit(">"))

    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        name(F.col("page_id"), F.col("row_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date.strftime("%Y-%m-%dT%H:%M:%SZ")).alias("date"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        F.when(revisit, name(F.col("keeper.page_id"), F.col("keeper.row_id"))).alias("refers_to"),
        "payload_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def page_of(record_id: str) -> Column:
    """The page_id that a record id of :func:`page_records` names; null if it had none."""
    return F.regexp_extract(F.col(record_id), r"^<urn:page:(-?\d+):", 1).try_cast("long")
