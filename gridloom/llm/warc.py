"""WARC archives as chunked record tables.

Payloads travel as rows of (record, chunk number, bytes), so no Python worker
holds a whole record: digests grow chunk by chunk, the writer streams a record's
chunks into the archive, and the reader streams an archive into chunk rows that
carry the length and the digest so far; the last chunk of a record has the
digest of its whole payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, cut, hot_join, shared_folder

CHUNK = 1 << 18
LEVEL = 3
#: Bytes at which an archive is full.
ROLL = 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A fixed date: archives of equal pages are equal.
DATE = "2026-01-01T00:00:00Z"

CHUNKS = "record_id string, chunk_no long, chunk binary, payload_bytes long, payload_digest string, last boolean, record_type string, uri string, refers_to_id string, stated_digest string, stated_bytes long, source_id string, refers_to string, archive string, place long"


def _record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr(parts).encode()).digest())}>"


def _head(kind: str, record: str, digest: str, url: str, n: int, page: str, refers: tuple[str, str] | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = len(http) + (n if kind == "response" else 0)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Source-ID: {page}"]
    if refers:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers[0]}", f"X-Refers-To-Source-ID: {refers[1]}"]
    return "\r\n".join([*lines, "Content-Type: application/http; msgtype=response", f"Content-Length: {block}", "", ""]).encode() + http


def _clean(value: str | None) -> str:
    """A header value: white space and controls are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value or "")


def record_chunks(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", chunk: int = CHUNK) -> DataFrame:
    """(row, page, url, no, last, chunk): payloads in UTF-8 as rows of at most
    ``chunk`` bytes, a record's in order; null ones are one empty chunk.  Only
    numbers are exploded, so a payload is cut as its chunks are asked for."""
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(page_id).cast("long").alias("page"), F.col(url).cast("string").alias("url"), bytes_of(html).alias("body"))
    top = F.greatest(F.lit(1), F.ceil(F.octet_length("body") / chunk)).cast("int") - 1
    rows = rows.withColumn("top", top).select("row", "page", "url", "body", "top", F.explode(F.sequence(F.lit(0), "top")).alias("no"))
    return rows.select("row", "page", "url", "no", (F.col("no") == F.col("top")).alias("last"), F.expr(f"substring(body, no * {chunk} + 1, {chunk})").alias("chunk"))


def record_digests(chunks: DataFrame) -> DataFrame:
    """(row, page, n, digest) of records, from digests that grow chunk by chunk."""

    def run(batches):
        sha, size = hashlib.sha1(), 0
        for b in batches:
            out = []
            for row, page, last, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                sha.update(data)
                size += len(data)
                if last:
                    out.append((row, page, size, sha.digest()))
                    sha, size = hashlib.sha1(), 0
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["row", "page", "n", "digest"])

    return chunks.select("row", "page", "last", "chunk").mapInArrow(run, "row long, page long, n long, digest binary")


class _Archives:
    """The archives of one task: a new one begins where the last has ``roll``
    bytes.  An archive is written under another name and renamed when complete,
    so a task that is run again does no harm."""

    def __init__(self, folder: str, part: int, level: int, roll: int):
        self.folder, self.part, self.level, self.roll = folder, part, level, roll
        self.files, self.base = fs.FileSystem.from_uri(folder)
        self.out = self.squeeze = None
        self.made: list[tuple[str, int]] = []

    def begin(self, head: bytes) -> None:
        if self.out is not None and self.out.tell() >= self.roll:
            self.close()
        if self.out is None:
            self.hidden, self.n = f".part-{self.part:05d}-{uuid.uuid4().hex}", 0
            self.out = self.files.open_output_stream(f"{self.base}/{self.hidden}", compression=None)
        self.n += 1
        self.squeeze = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        self.write(head)

    def write(self, data: bytes) -> None:
        self.out.write(self.squeeze.compress(data))

    def end(self) -> None:
        self.out.write(self.squeeze.compress(b"\r\n\r\n") + self.squeeze.flush())

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            name = f"part-{self.part:05d}-{len(self.made):05d}.warc.gz"
            self.files.move(f"{self.base}/{self.hidden}", f"{self.base}/{name}")
            self.made.append((name, self.n))
            self.out = None


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, chunk: int = CHUNK, level: int = LEVEL, roll: int = ROLL) -> list[str]:
    """Writes a record for each row of ``pages`` and returns the archives' names.

    Of records with equal payloads of at least ``least`` bytes the one with the
    largest page_id is a response and the others are revisits of it (null ids
    come below all; of repeated rows one is the response); smaller payloads
    are all responses.  Null payloads are empty.

    The records' digests are taken first, chunk by chunk, and who revisits whom
    is found from these alone; groups of copies meet by ``hot_join``.  Then the
    chunks stream into the archives in order, and each payload's digest is
    taken again: a row whose text isn't the one that was digested is an error.
    An archive ends at the record that fills it to ``roll`` bytes.
    """
    chunks = record_chunks(pages, page_id, url, html, chunk)
    records = cut(record_digests(chunks))
    groups = cut(records.filter(F.col("n") >= least).groupBy("digest").agg(F.max(F.struct("page", -F.col("row"))).alias("best"), F.count("*").alias("copies")))
    large = hot_join(records.filter(F.col("n") >= least), groups, ["digest"], "copies", records.count())
    own = -F.col("best.col2") == F.col("row")
    roles = large.select("row", "n", "digest", F.lit(True).alias("grouped"), (~own).alias("revisit"), F.col("best.page").alias("newest"))
    roles = roles.unionByName(records.filter(F.col("n") < least).select("row", "n", "digest", F.lit(False).alias("grouped"), F.lit(False).alias("revisit"), F.lit(None).cast("long").alias("newest")))
    rows = chunks.join(roles, "row").sortWithinPartitions("row", "no")

    def write(batches):
        from pyspark import TaskContext

        archives = _Archives(folder, TaskContext.get().partitionId(), level, roll)
        sha = None
        for b in batches:
            for row, page, url, n, digest, grouped, revisit, newest, last, no, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if no == 0:
                    sha = hashlib.sha1()
                    record = _record_id("response", page, digest) if grouped and not revisit else _record_id("page", page, row, digest)
                    refers = (_record_id("response", newest, digest), "" if newest is None else str(newest)) if revisit else None
                    archives.begin(_head("revisit" if revisit else "response", record, base64.b32encode(digest).decode(), _clean(url), n, "" if page is None else str(page), refers))
                sha.update(data)
                if not revisit:
                    archives.write(data)
                if last:
                    if sha.digest() != digest:
                        raise ValueError(f"the row of page {page} has changed while it was written")
                    archives.end()
        archives.close()
        cols = list(zip(*archives.made, strict=True)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64())], names=["name", "records"])

    files, base = fs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)
    named = rows.select("row", "page", "url", "n", "digest", "grouped", "revisit", "newest", "last", "no", "chunk").mapInArrow(write, "name string, records long").collect()
    return sorted(f"{folder}/{r.name}" for r in named)


class _Stream:
    """Reads lines and counted bytes of a gzip file of any number of members, holding little of it."""

    def __init__(self, raw):
        self.raw, self.held, self.unzip, self.rest = raw, bytearray(), zlib.decompressobj(31), b""

    def _more(self) -> bool:
        while True:
            if self.unzip.eof:
                self.rest = self.unzip.unused_data
                self.unzip = zlib.decompressobj(31)
            data = self.rest or self.unzip.unconsumed_tail or self.raw.read(1 << 16)
            self.rest = b""
            if not data:
                return False
            found = self.unzip.decompress(data, CHUNK)
            if found:
                self.held += found
                return True

    def line(self) -> bytes | None:
        start = 0
        while (end := self.held.find(b"\n", start)) < 0:
            start = len(self.held)
            if not self._more():
                if self.held:
                    raise ValueError("the archive ends within a line")
                return None
        found = bytes(self.held[: end + 1])
        del self.held[: end + 1]
        return found

    def some(self, n: int) -> bytes:
        """Up to ``n`` bytes, at least one."""
        if not self.held and not self._more():
            raise ValueError("the archive ends within a record")
        found = bytes(self.held[:n])
        del self.held[:n]
        return found


def _fields(stream: _Stream) -> dict[str, str]:
    out: dict[str, str] = {}
    while (line := stream.line()) not in (None, b"\r\n", b"\n"):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def records(raw, archive: str, chunk: int = CHUNK, payload: bool = True) -> Iterator[tuple]:
    """The chunk rows of one archive, in order, as tuples of CHUNKS."""
    stream = _Stream(raw)
    place = 0
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{archive}: no record where one should begin")
        head = _fields(stream)
        left = int(head["content-length"])
        stated = None
        if head.get("content-type", "").startswith("application/http"):
            before = len(first := stream.line() or b"")
            while (line := stream.line()) is not None:
                before += len(line)
                if not line.strip():
                    break
                name, _, value = line.decode("latin-1").partition(":")
                if name.strip().lower() == "content-length":
                    stated = int(value)
            left -= before
            if not first.startswith(b"HTTP/"):
                raise ValueError(f"{archive}: no HTTP head in {head.get('warc-record-id')}")
        sha, no, size = hashlib.sha1(), 0, 0
        common = (head.get("warc-type"), head.get("warc-target-uri"), head.get("warc-refers-to"), head.get("warc-payload-digest", "").removeprefix("sha1:") or None, stated, head.get("x-source-id") or None, head.get("x-refers-to-source-id") or None, archive, place)
        while True:
            held = bytearray()
            while left and len(held) < chunk:
                got = stream.some(min(left, chunk - len(held)))
                left -= len(got)
                held += got
            sha.update(held)
            size += len(held)
            yield (head["warc-record-id"], no, bytes(held) if payload else None, size, base64.b32encode(sha.digest()).decode(), not left, *common)
            no += 1
            if not left:
                break
        place += 1


def read_archives(spark: SparkSession, archives: list[str], chunk: int = CHUNK, payload: bool = True, check: bool = False) -> DataFrame:
    """The chunked record table of ``archives``; without payload the bytes are
    read and digested but not passed on.  A broken archive is an error, and with
    ``check`` also a response whose length or digest isn't what its head states."""
    schema = CHUNKS
    names = [x.split()[0] for x in CHUNKS.split(", ")]

    def read(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                files, base = fs.FileSystem.from_uri(path)
                with files.open_input_stream(base, compression=None, buffer_size=1 << 20) as raw:
                    held, size = [], 0
                    for row in records(raw, path, chunk, payload):
                        if check and row[5] and row[6] == "response" and (row[4], row[3]) != (row[9], row[10]):
                            raise ValueError(f"{path}: {row[0]} isn't what its head states")
                        held.append(row)
                        size += len(row[2] or b"") + 400
                        if size > 8 * chunk:
                            yield _batch(held, names)
                            held, size = [], 0
                    if held:
                        yield _batch(held, names)

    if not archives:
        return spark.createDataFrame([], schema)
    one_each = spark.createDataFrame([(x,) for x in archives], "path string").repartition(len(archives))
    return one_each.mapInArrow(read, schema)


_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [_TYPES[x.split()[1]] for x in CHUNKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back:
    page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's length and digest are those of the payload as read; a
    revisit has no payload, and its own head states them.
    """
    archives = write_archives(pages, shared_uri(pages.sparkSession), **options)
    last = read_archives(pages.sparkSession, archives, payload=False, check=True).filter("last")
    response = F.col("record_type") == "response"
    return last.select(
        F.col("source_id").cast("long").alias("page_id"),
        F.when(response, F.col("payload_bytes")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(response, F.col("payload_digest")).otherwise(F.col("stated_digest")).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def shared_uri(spark: SparkSession) -> str:
    folder = shared_folder(spark, "warc")
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
