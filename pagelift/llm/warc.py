"""WARC archives through a chunked record table.

A page becomes rows ``(record, chunk_no, data)``: its payload is cut into
chunks of ``CHUNK`` bytes, and no step after that holds a record as a whole.
The writer streams chunk rows into gzip members (one a record), checking the
SHA-256 as it goes; the reader streams the archives back into chunk rows, each
with the digest of the payload so far, so the last row of a record carries the
digest of all of it without a shuffle.

Equal payloads of ``REVISIT_BYTES`` or more are stored once: the record with
the smallest page_id is a response, the others are revisits without a payload.
Digests are found in a scan of their own and only (digest, id) is shuffled; a
bitmap of fixed size lets the writer's scan pass all pages that surely are no
revisits, and only the rest are joined.

Archives go to the shared folder through ``pyarrow.fs`` (any file system that
the workers can open by URI).  A task names its files by attempt and returns
them as rows; only rows of finished attempts reach the manifest, which is what
the reader reads, so lost or repeated tasks leave no records twice.

Defined cases: a null html is an empty payload; a null url leaves the target
empty; a null page_id keeps its row (smallest last, and ``refers_to`` null when
all ids of a payload are null); rows that share id and payload are a response
and its revisits; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import run_folder, written
from .ngram_join import SKETCH_BITS, _bitmap, _bucket_of, _id_hash

CHUNK = 1 << 20
REVISIT_BYTES = 100
FILE_BYTES = 1 << 30
BATCH_BYTES = 4 << 20
READ_BYTES = 1 << 18
DATE = "2000-01-01T00:00:00Z"
# Fixed values of the WARC format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

CHUNK_SCHEMA = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
                "chunk_no int, is_last boolean, data binary")


# ---------------------------------------------------------------- records
def records(pages: DataFrame, min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Pages with record_type, refers_to, payload_bytes and payload_digest; html is null for revisits."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
                       F.octet_length(html).cast("long").alias("payload_bytes"))
    digest = F.sha2(F.col("html"), 256).alias("payload_digest")
    narrow = written(own.filter(F.col("payload_bytes") >= min_bytes).select("page_id", "url", "payload_bytes", digest), "warc-digests")
    shared = (narrow.groupBy("payload_digest").agg(F.count("*").alias("k"), F.min("page_id").alias("refers_to")).filter("k > 1").drop("k"))
    # all rows of a shared payload but the first of its smallest id
    again = (narrow.join(shared, "payload_digest")
             .withColumn("copy", F.row_number().over(Window.partitionBy("payload_digest", "page_id").orderBy("url")))
             .filter("copy > 1 or not page_id <=> refers_to").drop("copy"))
    again = written(again, "warc-revisits")
    hit = _bitmap(again.select(F.coalesce("page_id", F.lit(0)).alias("id")), "id")
    columns = own.columns

    def split(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.unpackbits(hit.value).astype(bool)
            for part in batches:
                ids = pc.fill_null(part.column(0), 0).to_numpy(zero_copy_only=False)
                yield part.filter(pa.array(held[_bucket_of(_id_hash(ids), SKETCH_BITS)] == wanted))
        return own.mapInArrow(run, own.schema).withColumn("payload_digest", F.sha2(F.col("html"), 256))

    revisits = again.groupBy("page_id", "payload_digest").agg(F.count("*").alias("k"))
    touched = split(True).alias("p").join(
        revisits.alias("r"), F.expr("p.page_id <=> r.page_id and p.payload_digest = r.payload_digest"), "left")
    nth = F.row_number().over(Window.partitionBy("p.page_id", "p.payload_digest").orderBy(F.col("p.url").desc()))
    touched = touched.withColumn("nth", nth).filter("nth > coalesce(k, 0)").select(*(f"p.{c}" for c in [*columns, "payload_digest"]))
    responses = split(False).unionByName(touched).select(
        "page_id", "url", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "payload_bytes", "payload_digest", "html")
    return responses.unionByName(again.select(
        "page_id", "url", F.lit("revisit").alias("record_type"), "refers_to", "payload_bytes", "payload_digest", F.lit(None).cast("string").alias("html")))


def chunked(recs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row per record and chunk; a record without payload has one row."""
    size = F.when(F.col("html").isNull(), F.lit(0)).otherwise(F.col("payload_bytes"))
    last = F.greatest(F.lit(0), F.floor((size - 1) / chunk)).cast("int")
    return (recs.withColumn("_last", last).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("_last"))))
            .withColumn("data", F.substring(F.coalesce(F.col("html"), F.lit("")).cast("binary"), F.col("chunk_no") * chunk + 1, F.lit(chunk)))
            .select("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "chunk_no",
                    (F.col("chunk_no") == F.col("_last")).alias("is_last"), "data"))


# ---------------------------------------------------------------- writing
def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _one_line(text: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text or "")


def _head(row: dict, length: int) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_name(row['page_id'])}", f"WARC-Date: {DATE}",
             f"WARC-Target-URI: {_one_line(row['url'])}", "Content-Type: application/http; msgtype=response",
             f"WARC-Payload-Digest: sha256:{row['payload_digest']}"]
    if row["record_type"] == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(row['refers_to'])}"]
    lines.append(f"Content-Length: {len(http) + length}")
    return "\r\n".join(lines).encode() + END + http


class _Archive:
    """One gzip member a record; a new file after ``FILE_BYTES``."""

    def __init__(self, folder: str, task: str):
        self.fs, self.path = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.folder, self.task, self.files, self.out = folder, task, [], None

    def begin(self, head: bytes) -> None:
        if self.out is None:
            name = f"{self.task}-{len(self.files):04d}.warc.gz"
            self.files.append([f"{self.folder}/{name}", 0, 0])
            self.out = self.fs.open_output_stream(f"{self.path}/{name}", compression=None)
        self.member = zlib.compressobj(6, zlib.DEFLATED, 31)
        self.put(head)

    def put(self, data: bytes) -> None:
        if small := self.member.compress(data):
            self.out.write(small)
            self.files[-1][1] += len(small)

    def end(self) -> None:
        self.put(END)
        small = self.member.flush()
        self.out.write(small)
        self.files[-1][1] += len(small)
        self.files[-1][2] += 1
        if self.files[-1][1] >= FILE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def write(chunks: DataFrame, folder: str) -> DataFrame:
    """Streams chunk rows (records whole and in order within a partition) into archives; the manifest of their files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        archive = _Archive(folder, f"part-{task.partitionId():06d}-{task.taskAttemptId()}")
        digest = None
        for part in batches:
            for row in part.to_pylist():
                if row["chunk_no"] == 0:
                    archive.begin(_head(row, row["payload_bytes"] if row["record_type"] == "response" else 0))
                    digest = hashlib.sha256()
                digest.update(row["data"])
                archive.put(row["data"])
                if row["is_last"]:
                    if row["record_type"] == "response" and digest.hexdigest() != row["payload_digest"]:
                        raise ValueError(f"page {row['page_id']}: the chunks don't make up the payload")
                    archive.end()
        archive.close()
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in archive.files], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
                                         ["path", "bytes", "records"])

    return written(chunks.mapInArrow(run, "path string, bytes long, records long"), "warc-manifest")


# ---------------------------------------------------------------- reading
class _Members:
    """Bytes of the gzip members of a file, read forward only."""

    def __init__(self, stream):
        self.stream, self.rest, self.inflate, self.ready = stream, b"", None, b""

    def _fill(self) -> bool:
        while True:
            if not self.rest:
                self.rest = self.stream.read(READ_BYTES)
                if not self.rest:
                    return False
            if self.inflate is None:
                self.inflate = zlib.decompressobj(31)
            data = self.inflate.decompress(self.rest, READ_BYTES)
            if self.inflate.eof:
                self.rest, self.inflate = self.inflate.unused_data, None
            else:
                self.rest = self.inflate.unconsumed_tail
            if data:
                self.ready += data
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.ready.find(mark)) < 0:
            if not self._fill():
                return None
        out, self.ready = self.ready[:at], self.ready[at + len(mark):]
        return out

    def take(self, most: int) -> bytes:
        while not self.ready:
            if not self._fill():
                raise ValueError("the archive ends within a record")
        out, self.ready = self.ready[:most], self.ready[most:]
        return out


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode().split("\r\n")[1:])
    return {k.lower(): v.strip() for k, _, v in pairs}


def _number(name: str | None) -> int | None:
    text = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def _read_rows(stream, chunk: int) -> Iterator[tuple]:
    members = _Members(stream)
    while (head := members.until(END)) is not None:
        fields = _fields(head)
        http = members.until(END)
        left = int(fields["content-length"]) - len(http) - len(END)
        full = int(_fields(http)["content-length"])
        kind, want = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
        digest, number, done = hashlib.sha256(), 0, 0
        while True:
            parts, size = [], 0
            while size < min(chunk, left):
                parts.append(members.take(min(chunk, left) - size))
                size += len(parts[-1])
            data = b"".join(parts)
            left, done = left - size, done + size
            digest.update(data)
            so_far = want if kind == "revisit" else digest.hexdigest()
            if not left and so_far != want:
                raise ValueError(f"{fields['warc-record-id']}: its payload has another digest")
            yield (_number(fields["warc-record-id"]), fields["warc-target-uri"], kind, _number(fields.get("warc-refers-to")),
                   full if kind == "revisit" else done, so_far, number, not left, data)
            number += 1
            if not left:
                break
        if members.until(END) != b"":
            raise ValueError(f"{fields['warc-record-id']}: its length is wrong")


def read(manifest: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows of the archives; payload_bytes and payload_digest count what a record has shown so far."""
    files = max(1, manifest.count())
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.binary()]
    names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for path in part.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with system.open_input_stream(at, compression=None) as stream:
                    for row in _read_rows(stream, chunk):
                        rows.append(row)
                        size += len(row[-1])
                        if size >= BATCH_BYTES or len(rows) >= 10_000:
                            yield batch(rows)
                            rows, size = [], 0
                yield batch(rows)

    return manifest.select("path").repartition(min(files, 4096)).mapInArrow(run, CHUNK_SCHEMA)


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads them back: a row per record."""
    folder = folder or run_folder(pages.sparkSession, "warc")
    manifest = write(chunked(records(pages)), folder)
    return read(manifest).filter("is_last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
