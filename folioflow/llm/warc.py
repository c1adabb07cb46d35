"""WARC archives through a chunked record table.

Writing: each record is a gzip member of its own; its payload goes from the Arrow buffer through the
compressor in pieces of ``CHUNK_BYTES``. Reading: an archive is decompressed piece by piece, and a record becomes rows of
(record id, chunk number, bytes, digest so far), so neither side holds a record twice or builds one whole.
The last chunk's digest is the record's.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with the largest id is the
response and the others are revisits that refer to it.

Scale: payload digests are grouped first (a pre-aggregated maximum by digest), away from the payloads; digests that many
records have are joined by broadcast. Only pages that may be revisits are shuffled with their payload, by
id and digest, so that a hot payload lies in no one place; smaller ones are written where they are read. A task writes files of its own name and
attempt and lists them; only listed files are read, so tasks that are lost and run again leave nothing in the result. Each
archive is read by a task of its own.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import join_counted, release, shared_dir, table, written
from ._text import filesystem

CHUNK_BYTES = 1 << 16
MIN_REVISIT = 1000
#: Uncompressed bytes after which a task begins a new file.
FILE_BYTES = 256 << 20

_LISTED = "path string, records long, bytes long"
CHUNKS = ("record_id string, record_type string, refers_to string, target_uri string, payload_bytes long, chunk_no long, bytes binary, "
          "digest_so_far string, bytes_so_far long, is_last boolean, payload_digest string")


def _header(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _line(value: str | None) -> str:
    """A header value: line breaks would end it."""
    return (value or "").replace("\r", "%0D").replace("\n", "%0A")


def pieces(payload: memoryview, size: int = CHUNK_BYTES) -> Iterator[memoryview]:
    for at in range(0, len(payload), size):
        yield payload[at : at + size]


def write_record(out, record_id: str, uri: str | None, payload: memoryview, sha1: str, refers_to: str | None) -> int:
    """One gzip member; a revisit carries the payload's length and digest but no payload. Returns the payload bytes written."""
    body = memoryview(b"") if refers_to is not None else payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Target-URI", _line(uri)),
              ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()),
              ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "text/html"), ("Content-Length", str(len(body)))]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    out.write(packer.compress(_header(fields)))
    for piece in pieces(body):
        out.write(packer.compress(piece))
    out.write(packer.compress(b"\r\n\r\n") + packer.flush())
    return len(body)


def unpacked(source, size: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The bytes of a file of gzip members, at most ``size`` at a time."""
    unpacker = zlib.decompressobj(31)
    while True:
        data = source.read(size)
        if not data:
            if not unpacker.eof and unpacker.unused_data == b"" and unpacker.unconsumed_tail:
                raise ValueError("the archive is cut short")
            return
        while data:
            if unpacker.eof:
                unpacker = zlib.decompressobj(31)
            got = unpacker.decompress(data, size)
            if got:
                yield got
            data = unpacker.unused_data if unpacker.eof else unpacker.unconsumed_tail


def records(parts: Iterator[bytes], size: int = CHUNK_BYTES) -> Iterator[tuple[dict[str, str], int, bytes, str, int, bool]]:
    """(header, chunk number, bytes, sha1 so far, bytes so far, whether last) of every chunk; an empty payload has one empty chunk."""
    held = b""

    def more() -> bool:
        nonlocal held
        got = next(parts, None)
        if got is None:
            return False
        held += got
        return True

    while held or more():
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError("a record header is cut short")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in held[:end].decode().split("\r\n")[1:])
        held = held[end + 4 :]
        left, number, sha1, total = int(head["Content-Length"]), 0, hashlib.sha1(), 0
        while True:
            while len(held) < min(left, size):
                if not more():
                    raise ValueError("a payload is cut short")
            chunk, held = held[: min(left, size)], held[min(left, size) :]
            left, total = left - len(chunk), total + len(chunk)
            sha1.update(chunk)
            yield head, number, chunk, sha1.hexdigest(), total, left == 0
            number += 1
            if left == 0:
                break
        while len(held) < 4:
            if not more():
                raise ValueError("a record's end is cut short")
        held = held[4:]


def roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(id, url, payload, sha1, refers_to) of every row; refers_to is null for a response.

    Null payloads are empty. A row without an id, or with fewer than MIN_REVISIT bytes, is a response; rows that repeat an id are records of their
    own, and of equal payloads all rows with the largest id are responses. Other columns of ``pages`` play no part.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    digested = rows.withColumn("sha1", F.sha1(F.col("payload").cast("binary")))
    may = F.col("id").isNotNull() & (F.octet_length("payload") >= MIN_REVISIT)
    digests = written(digested.where(may).groupBy("id", "sha1").agg(F.count("*").alias("times")), "digests")
    shared = written(digests.groupBy("sha1").agg(F.max("id").alias("last"), F.min("id").alias("least"), F.count("*").alias("n")).where("least < last").select("sha1", "n", "last"), "payloads")
    revisits = written(join_counted(digests, shared, "sha1", "n").where("id < last").select("id", "sha1", "last"), "revisits")
    release(digests, shared)
    large = digested.where(may).join(revisits.hint("merge"), ["id", "sha1"], "left").select("id", "url", "payload", "sha1", F.col("last").alias("refers_to"))
    return large.unionByName(digested.where(~may).withColumn("refers_to", F.lit(None).cast("long")))


def record_id(page: int | None) -> str:
    return f"urn:page:{'' if page is None else page}"


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the archives below ``folder``; returns the list of finished files (path, records, bytes), itself a written table.

    Which records are revisits is told at ``roles``. Without rows there are no files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        out, listed, number = None, [], 0
        for batch in batches:
            payloads = batch.column("payload").cast(pa.binary())
            for k, (page, url, sha1, refers) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "url", "sha1", "refers_to")), strict=True)):
                if out is None or listed[-1][2] >= file_bytes:
                    if out is not None:
                        out.close()
                    name = f"part-{task.stageId()}-{task.partitionId():05d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
                    out, number = fs.open_output_stream(f"{base}/{name}", compression=None), number + 1
                    listed.append([f"{folder}/{name}", 0, 0])
                payload = memoryview(payloads[k].as_buffer())
                listed[-1][2] += write_record(out, record_id(page), url, payload, sha1, None if refers is None else record_id(refers))
                listed[-1][1] += 1
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in listed], t) for c, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return written(roles(pages, id_col, url_col, payload_col).mapInArrow(run, _LISTED), "archives")


def read_chunks(listed: DataFrame, chunk_bytes: int = CHUNK_BYTES, payload: bool = True, last_only: bool = False) -> DataFrame:
    """The chunk rows of the archives in ``listed`` (path). Without ``payload`` their bytes are null; ``last_only`` leaves one row a record.

    An empty payload is one chunk of no bytes. A path listed twice is read twice; an empty list has no rows. Other columns of ``listed`` play no part.
    """
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = filesystem(path)
                rows: list[tuple] = []
                held = 0
                with fs.open_input_stream(at, compression=None) as source:
                    for head, number, chunk, digest, total, last in records(unpacked(source), chunk_bytes):
                        if last_only and not last:
                            continue
                        revisit = head["WARC-Type"] == "revisit"
                        stored = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        rows.append((head["WARC-Record-ID"].strip("<>"), head["WARC-Type"], head["WARC-Refers-To"].strip("<>") if revisit else None, head["WARC-Target-URI"],
                                     int(head["X-Payload-Length"]), number, chunk if payload else None, digest, total, last, stored))
                        held += len(chunk) if payload else 0
                        if len(rows) >= 4096 or held >= 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    # As many ranges of paths as there are archives: a number that is given is kept, however small the paths are.
    return listed.select("path").repartitionByRange(max(1, listed.count()), "path").mapInArrow(run, CHUNKS)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = write_archives(table(spark, sf_dir, "pages"), shared_dir(spark, "warc"))
    page = lambda c: F.nullif(F.regexp_replace(c, "^urn:page:", ""), F.lit("")).cast("long")
    read = read_chunks(listed, payload=False, last_only=True)
    response = F.col("record_type") == "response"
    # A response's length and digest are those of the bytes read back; a revisit stores no payload, only its length and digest.
    return read.select(page("record_id").alias("page_id"), F.when(response, F.col("bytes_so_far")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
                       F.when(response, F.col("digest_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))


OP8_SQL = """
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to
FROM (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS d, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
"""
