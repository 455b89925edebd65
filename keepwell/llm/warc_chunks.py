"""WARC archives as a chunked record table.

A payload is a run of rows (record_id, chunk_no, data): writing and reading hold one
chunk of it at a time. The reader carries the digest along, so each chunk row has the
size and the SHA-1 of the payload up to its end, and the row marked ``last`` has those
of the whole payload. Archives are gzip files with one member per record, written by
the tasks under a temporary name and moved into place, so a task that runs twice
leaves one file; the folder must be one that all executors reach.

Equal payloads of at least ``least`` bytes are stored once: the record with the
largest identifier is the response, the others are revisits that refer to it. Groups
are found by SHA-256 and length on narrow rows; only payloads that a bounded bit table
lets through are shuffled.

Defined cases: a null payload is the empty one; a null url is written empty; repeated
rows with the identifier that stays are all responses, and a null identifier ranks
lowest; empty tables write no files and read as no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from keepwell.llm.base import maybe_member, membership, surely_not
from keepwell.session import scratch_path, settle

CHUNK = 1 << 16
FILE_BYTES = 64 << 20
_READ = 1 << 16


def plan_records(rows: DataFrame, least: int = 1000) -> tuple[DataFrame, DataFrame]:
    """From (id long, uri, payload binary): responses with payload, and revisits without.

    Both have id, uri, n_bytes, sha1; revisits also refers_to.
    """
    rank = F.coalesce("id", F.lit(-(1 << 63)))
    known = rows.select("id", "uri", F.coalesce("payload", F.lit(b"")).alias("payload")).withColumns({
        "n_bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload"),
        "content": F.concat_ws(":", F.sha2("payload", 256), F.octet_length("payload")), "rank": rank})
    narrow = known.where(F.col("n_bytes") >= least).select("id", "uri", "n_bytes", "sha1", "content", "rank")
    several = settle(narrow.groupBy("content").agg(F.max("rank").alias("keep"), F.count(F.lit(1)).alias("n"))
                     .where("n > 1").drop("n"), "repeated-payloads")
    revisits = (narrow.join(several, "content").where("rank != keep")
                .select("id", "uri", "n_bytes", "sha1", F.col("keep").alias("refers_to")))
    bits = membership(several, "content")
    unsure = maybe_member(known, "content", bits).join(several, "content", "left").where("keep is null or rank = keep")
    sure = surely_not(known, "content", bits)
    columns = ["id", "uri", "n_bytes", "sha1", "payload"]
    return sure.select(*columns).unionByName(unsure.select(*columns)), revisits


def chunk_rows(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Payload rows cut into chunk rows, in order and next to each other."""
    last = F.greatest(F.expr(f"cast((n_bytes - 1) div {chunk} as int)"), F.lit(0))
    return (records.withColumn("last_no", last).select("*", F.explode(F.sequence(F.lit(0), "last_no")).alias("chunk_no"))
            .select("id", "uri", "n_bytes", "sha1", F.lit(None).cast("long").alias("refers_to"), "chunk_no",
                    (F.col("chunk_no") == F.col("last_no")).alias("last"),
                    F.expr(f"substring(payload, chunk_no * {chunk} + 1, {chunk})").alias("data")))


def record_id(number: int | None) -> str:
    return f"<urn:record:{'none' if number is None else number}>"


def _header(row: dict, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n_bytes']}\r\n\r\n".encode()
    revisit = row["refers_to"] is not None
    uri = (row["uri"] or "").encode().replace(b"%", b"%25").replace(b"\r", b"%0D").replace(b"\n", b"%0A")
    digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
    lines = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"),
             f"WARC-Record-ID: {record_id(row['id'])}".encode(), b"WARC-Target-URI: " + uri, f"WARC-Date: {date}".encode(),
             f"WARC-Payload-Digest: sha1:{digest}".encode(), b"Content-Type: application/http;msgtype=response",
             f"Content-Length: {len(http) + (0 if revisit else row['n_bytes'])}".encode()]
    if revisit:
        lines += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {record_id(row['refers_to'])}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + http


def write_archives(responses: DataFrame, revisits: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z",
                   chunk: int = CHUNK, file_bytes: int = FILE_BYTES, level: int = 1) -> DataFrame:
    """Writes all records below ``folder`` and returns the list of files: file, records, bytes."""
    rows = chunk_rows(responses, chunk)
    rows = rows.unionByName(revisits.withColumns({"chunk_no": F.lit(0), "last": F.lit(True), "data": F.lit(b"")}).select(rows.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}"
        mark = f"_open-{context.taskAttemptId()}-"
        done: list[tuple[str, int, int]] = []
        out = packer = None
        records = written = 0

        def put(data: bytes) -> None:
            nonlocal written
            if data:
                out.write(data)
                written += len(data)

        def close() -> None:
            nonlocal out, records, written
            if out is not None:
                out.close()
                final = f"{name}-{len(done):04d}.warc.gz"
                store.move(posixpath.join(base, mark + name), posixpath.join(base, final))
                done.append((final, records, written))
                out, records, written = None, 0, 0

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("id", "uri", "n_bytes", "sha1", "refers_to", "chunk_no", "last")}
                if row["chunk_no"] == 0:
                    if out is None:
                        out = store.open_output_stream(posixpath.join(base, mark + name), compression=None)
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    put(packer.compress(_header(row, date)))
                put(packer.compress(batch.column("data")[i].as_buffer()))
                if row["last"]:
                    put(packer.compress(b"\r\n\r\n") + packer.flush())
                    records += 1
                    if written >= file_bytes:
                        close()
        close()
        yield pa.RecordBatch.from_pydict({"file": [d[0] for d in done], "records": [d[1] for d in done], "bytes": [d[2] for d in done]},
                                         schema=pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return settle(rows.mapInArrow(run, "file string, records long, bytes long"), "archive-files")


_BLANK = b"\r\n\r\n"
_HEAD = 1 << 20  # a header is no longer than this


class _Unpacked:
    """The bytes behind a stream of gzip members, or of plain text, in order and in small parts."""

    def __init__(self, source):
        self.source, self.buffer, self.raw = source, bytearray(), source.read(_READ)
        self.member = zlib.decompressobj(31) if self.raw[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        if not self.raw:
            self.raw = self.source.read(_READ)
            if not self.raw:
                return False
        if self.member is None:
            self.buffer += self.raw
            self.raw = b""
            return True
        if self.member.eof:
            self.member = zlib.decompressobj(31)
        self.buffer += self.member.decompress(self.raw, _READ)
        self.raw = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
        return True

    def upto(self, mark: bytes, most: int = 1 << 20) -> bytes | None:
        """What comes before ``mark``, which is skipped; None at the end of the file."""
        while (at := self.buffer.find(mark)) < 0:
            if len(self.buffer) > most:
                raise ValueError("no end of a header")
            if not self.more():
                if self.buffer.strip():
                    raise EOFError("the archive ends within a record")
                return None
        found = bytes(self.buffer[:at])
        del self.buffer[:at + len(mark)]
        return found

    def head(self, most: int) -> bytes | None:
        """What comes before the first blank line within ``most`` bytes, without taking it; None if there is none."""
        seen = 0
        while (at := self.buffer.find(_BLANK, max(0, seen - 3), most)) < 0:
            seen = len(self.buffer)
            if seen >= min(most, _HEAD) or not self.more():
                return None
        return bytes(self.buffer[:at])

    def skip(self, n: int) -> None:
        while n > 0:
            n -= len(self.take(min(n, _READ)))

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self.more():
                raise EOFError("the archive ends within a record")
        found = bytes(self.buffer[:n])
        del self.buffer[:n]
        return found


def _fields(block: bytes) -> dict[str, str]:
    pairs = (line.split(b":", 1) for line in block.split(b"\r\n")[1:] if b":" in line)
    return {k.decode().strip().lower(): v.decode(errors="replace").strip() for k, v in pairs}


RECORD = ("record_id string, record_type string, uri string, refers_to string, chunk_no int, data binary, "
          "n_bytes long, sha1 string, last boolean, intact boolean")


def records_of(source, chunk: int, keep_data: bool) -> Iterator[tuple]:
    """Chunk rows of one archive, as in ``RECORD``.

    The payload of a response, request or revisit that holds HTTP is what follows the
    HTTP header; of all other records (warcinfo, metadata, resource, and blocks without
    a blank line) it is the whole block. A revisit states its payload, it has none.
    """
    unpacked = _Unpacked(source)
    while (top := unpacked.upto(_BLANK)) is not None:
        warc = _fields(top.lstrip(b"\r\n"))
        if not warc.get("content-length", "").isdigit():
            raise ValueError("a record without Content-Length")
        left, kind = int(warc["content-length"]), warc.get("warc-type")
        holds_http = kind in ("response", "request", "revisit") and warc.get("content-type", "application/http").startswith("application/http")
        http_block = unpacked.head(left) if holds_http else None
        digest_field = warc.get("warc-payload-digest", "")
        stated = base64.b32decode(digest_field.removeprefix("sha1:")).hex() if digest_field.startswith("sha1:") else None
        uri = warc.get("warc-target-uri", "").replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
        fixed = (warc.get("warc-record-id"), kind, uri, warc.get("warc-refers-to"))
        if kind == "revisit":
            size = _fields(http_block or b"").get("content-length", "")
            unpacked.skip(left + 4)
            yield (*fixed, 0, b"" if keep_data else None, int(size) if size.isdigit() else None, stated, True, None)
            continue
        if http_block is not None:
            left -= len(unpacked.take(len(http_block) + len(_BLANK)))
        digest, n, number = hashlib.sha1(), 0, 0
        while True:
            data = unpacked.take(min(chunk, left))
            digest.update(data)
            n, left = n + len(data), left - len(data)
            sofar = digest.hexdigest()
            yield (*fixed, number, data if keep_data else None, n, sofar, left == 0, None if left else stated in (None, sofar))
            number += 1
            if left == 0:
                break
        unpacked.take(4)


def read_archives(files: DataFrame, folder: str, chunk: int = CHUNK, keep_data: bool = True) -> DataFrame:
    """The chunked record table of the archives named in ``files``; each file is read by one task, in parts."""
    schema = StructType.fromDDL(RECORD)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(posixpath.join(base, name), compression=None) as source:
                    for row in records_of(source, chunk, keep_data):
                        rows.append(row)
                        held += len(row[5] or b"")
                        if len(rows) >= 5000 or held > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

    return files.select("file").repartition(max(1, files.count())).mapInArrow(run, schema)


def round_trip(spark: SparkSession, rows: DataFrame, least: int = 1000, folder: str | None = None) -> DataFrame:
    """Writes (id, uri, payload) as archives and reads them back: the last chunk row of every record, without data."""
    folder = folder or scratch_path(spark, "archives")
    files = write_archives(*plan_records(rows, least), folder)
    return read_archives(files, folder, keep_data=False).where("last").drop("data")
