"""WARC archives as chunk tables.

Payloads move as rows of a record's identifier and a chunk number; writer and reader
carry the digest on from chunk to chunk. Besides the cell of the table that is written,
which Spark holds whole, nothing has more of a record than a few chunks. An archive is a
sequence of gzip members, one for each record, written by one task into a folder that
all executors share, through pyarrow's file systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.core.deploy import ship
from millrace.core.durable import cut, delete
from millrace.llm.files import place

CHUNK = 1 << 16
__all__ = ["Writer", "chunk_rows", "delete", "read", "read_records", "write"]
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _base32(sha1) -> str:
    return base64.b32encode(sha1.digest()).decode()


def _header(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def _one_line(text: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in text or "urn:unknown")


def begin_record(record: str, url: str | None, n: int, digest: str, refers_to: str | None) -> bytes:
    """What precedes the payload of n bytes: of a response, or of a revisit that refers to the record with the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    revisit = refers_to is not None
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{record}>"), ("WARC-Date", _DATE), ("WARC-Target-URI", _one_line(url))]
    fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", _PROFILE)] if revisit else []
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + (0 if revisit else n)))]
    return _header(fields) + http


class Writer:
    """Writes chunk rows, those of a record one after the other, as gzip members of one stream."""

    def __init__(self, out):
        self.out, self.records = out, 0

    def chunk(self, record: str, n: int, last: bool, part, url: str | None, size: int, digest: str, refers_to: str | None) -> None:
        """Chunk n of a record whose payload has size bytes and a digest in all; both are checked at the last chunk of a response."""
        if n == 0:
            self.pack, self.sha1, self.done = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha1(), 0
            self.out.write(self.pack.compress(begin_record(record, url, size, digest, refers_to)))
        if refers_to is None:
            self.sha1.update(part)
            self.done += len(part)
            self.out.write(self.pack.compress(part))
        if last:
            if refers_to is None and (self.done != size or _base32(self.sha1) != digest):
                raise ValueError(f"the chunks of record {record} don't come to its payload")
            self.out.write(self.pack.compress(b"\r\n\r\n") + self.pack.flush())
            self.records += 1


def chunk_rows(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """(row, chunk, last, data, and all columns but payload) of each chunk of rows (payload, n, ...); one empty chunk of an empty payload.

    n is the payload's length, row a number for the row it came from. The payload is
    cut inside generated code, a chunk at a time, so a task allocates chunks only
    besides the cell that it reads.
    """
    others = [c for c in rows.columns if c != "payload"]
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    placed = numbered.select("row", *others, "payload", F.explode(F.sequence(F.lit(0), F.greatest((F.col("n") + (size - 1)) / size, F.lit(1)).cast("int") - 1)).alias("chunk"))
    data = F.substring(F.col("payload"), F.col("chunk") * size + 1, F.lit(size))
    return placed.select("row", "chunk", ((F.col("chunk") + 1) * F.lit(size).cast("long") >= F.col("n")).alias("last"), data.alias("data"), *others)


def write(pages: DataFrame, folder: str, least_revisit: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", size: int = CHUNK) -> DataFrame:
    """Write a record for each row; returns the manifest (path, records, bytes) of the archives, from a checkpoint.

    The payload is the text in UTF-8, empty for null. Of rows with equal payloads of
    least_revisit bytes or more, those of the smallest id are responses and the others
    revisit it; smaller payloads are all responses. Null ids come last: such a row
    revisits one with an id, and is a response where no row has one. A null url is
    written as urn:unknown. An empty table gives an empty manifest. Only files in the
    manifest count: a task that was lost or run twice may leave others in the folder.

    Payloads move as chunk rows of size bytes at most from the first shuffle on; a
    revisit's payload stays behind but for one empty chunk. A task sorts its chunk rows
    by record, which may spill, and writes one archive.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("n", F.length("payload"))
    groups = rows.where(F.col("n") >= least_revisit).groupBy("sha1", "n").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows"))
    repeated = groups.where("rows > 1 and first is not null").drop("rows")
    typed = chunk_rows(rows, size).join(repeated, ["sha1", "n"], "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first").cast("string"))
    ready = typed.select("row", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "url", "chunk", "last", "data", F.col("n").cast("long").alias("n"), "sha1", refers.alias("refers_to"))
    first = F.col("refers_to").isNull()
    ready = ready.where(first | (F.col("chunk") == 0)).withColumn("last", F.col("last") | ~first).withColumn("data", F.when(first, F.col("data")))
    # a record's chunks come from one map task and have one sha1, so one task of the join gets all of them, also where a hot sha1 is split
    ready = ready.sortWithinPartitions("row", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = place(folder)
        path = f"{root}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out = writer = None
        for batch in batches:
            if out is None and batch.num_rows:
                system.create_dir(root, recursive=True)
                out = system.open_output_stream(path, compression=None)
                writer = Writer(out)
            columns = {c: batch.column(c) for c in ("id", "url", "chunk", "last", "data", "n", "sha1", "refers_to")}
            for k in range(batch.num_rows):
                record, url, n, last, _, size, sha1, refers = (None if name == "data" else columns[name][k].as_py() for name in columns)
                data = columns["data"][k]
                writer.chunk(record, n, last, memoryview(data.as_buffer()) if data.is_valid else b"", url, size, base64.b32encode(bytes.fromhex(sha1)).decode(), refers)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([writer.records]), pa.array([system.get_file_info(path).size])], ["path", "records", "bytes"])

    written = cut(ready.mapInArrow(run, "path string, records long, bytes long"))
    prefix = folder[: len(folder) - len(place(folder)[1])]
    return written.withColumn("path", F.concat(F.lit(prefix), "path"))


def _members(stream, size: int) -> Iterator[bytes]:
    """The decompressed bytes of a sequence of gzip members, a bounded piece at a time."""
    pack = zlib.decompressobj(31)
    rest = b""
    while piece := rest or stream.read(size):
        data = pack.decompress(piece, size)
        if data:
            yield data
        if pack.eof:
            rest, pack = pack.unused_data, zlib.decompressobj(31)
        else:
            rest = pack.unconsumed_tail
    if not pack.eof and pack.unconsumed_tail:
        raise ValueError("an archive ends within a record")


class _Source:
    """Reads lines and counted bytes off pieces of bytes."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def more(self) -> bool:
        if not self.held:
            self.held = next(self.pieces, b"")
        return bool(self.held)

    def until(self, end: bytes, most: int = 1 << 20) -> bytes:
        while (at := self.held.find(end)) < 0:
            piece = next(self.pieces, b"")
            if not piece or len(self.held) > most:
                raise ValueError("a record's header has no end")
            self.held += piece
        found, self.held = self.held[:at], self.held[at + len(end) :]
        return found

    def counted(self, n: int, size: int) -> Iterator[bytes]:
        while n:
            if not self.more():
                raise ValueError("an archive ends within a record")
            part, self.held = self.held[: min(n, size)], self.held[min(n, size) :]
            n -= len(part)
            yield part


def _fields(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n")[1:])}


def read_records(stream, size: int = CHUNK) -> Iterator[tuple]:
    """(place of the record in the archive, record, chunk number, last, bytes, payload bytes so far, digest so far, type, refers to, url) of each chunk, streamed.

    A response's digest and length are computed from the chunks, and its last chunk is
    checked against the record's header. A revisit is one empty chunk with the digest
    and the length that it states.
    """
    source = _Source(_members(stream, size))
    name = lambda field: field.removeprefix("<urn:page:").removesuffix(">")
    at = -1
    while source.more():
        at += 1
        head = _fields(source.until(b"\r\n\r\n"))
        length = int(head["content-length"])
        http = source.until(b"\r\n\r\n")
        length -= len(http) + 4
        record, kind, url = name(head["warc-record-id"]), head["warc-type"], head["warc-target-uri"]
        stated = head["warc-payload-digest"].removeprefix("sha1:")
        if kind == "revisit":
            yield at, record, 0, True, b"", int(_fields(http)["content-length"]), stated, kind, name(head["warc-refers-to"]), url
        else:
            sha1, n, total = hashlib.sha1(), 0, 0
            held = b""
            for piece in source.counted(length, size):
                held += piece
                while len(held) > size:
                    part, held = held[:size], held[size:]
                    sha1.update(part)
                    total += len(part)
                    yield at, record, n, False, part, total, _base32(sha1), kind, None, url
                    n += 1
            sha1.update(held)
            if _base32(sha1) != stated:
                raise ValueError(f"record {record} doesn't have the payload that its header states")
            yield at, record, n, True, held, total + len(held), _base32(sha1), kind, None, url
        for part in source.counted(4, 4):
            if part.strip(b"\r\n"):
                raise ValueError("a record isn't followed by two empty lines")


def read(spark: SparkSession, manifest: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunk table of archives: (path, place, record, chunk, last, data, n_bytes, digest, record_type, refers_to, url).

    place counts the records of an archive from 0; it tells rows of one id apart.
    n_bytes and digest (base32 SHA-1) are of the payload up to and with the chunk, so a
    record's last chunk has those of all of it. A revisit is one empty chunk with the
    length and digest that it states. manifest needs a column path and is small, a row
    an archive; each archive is the work of a task of its own.
    """
    ship(spark)
    names = ["path", "place", "record", "chunk", "last", "data", "n_bytes", "digest", "record_type", "refers_to", "url"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, inner = place(path)
                rows, held = [], 0
                with system.open_input_stream(inner, compression=None) as stream:
                    for row in read_records(stream, size):
                        rows.append((path, *row))
                        held += len(row[4]) + 200
                        if held > 2_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "path string, place long, record string, chunk long, last boolean, data binary, n_bytes long, digest string, record_type string, refers_to string, url string"
    archives = manifest.select("path")
    # ranges of as many paths as there are: one archive each, as the ranges of so few rows are cut after a look at all of them
    return archives.repartitionByRange(max(1, archives.count()), "path").mapInArrow(run, schema)
