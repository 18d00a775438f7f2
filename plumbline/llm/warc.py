"""WARC files as a table of chunks.

A record's payload is read from the file piece by piece and becomes rows (record_id, chunk_no, start, chunk,
digest, last, valid, error). digest is the SHA-1 of the payload up to the end of the chunk, carried from chunk to
chunk; on the last one, valid says whether it equals the digest in the record's header (null where there is
none). Neither reader nor table ever holds more than a chunk of a record; a batch of rows has BATCH_BYTES
of chunks at most, or one chunk.

An empty payload gives one empty chunk. Of a response record the HTTP head is left out. Files may be gzipped,
as a whole or record by record. What is wrong in a file becomes a row with an error, an empty chunk, last true and
valid false: after a broken head reading goes on at the next line that begins a record; a file that ends within a record,
or whose bytes can't be read any further, ends with such a row. A missing file fails the job.

write() makes one file for each task, in a folder that all executors reach, under a name that no other
attempt at the task has, and returns the names that the successful attempts gave: files of lost attempts are
never read. A null page_id is written as "null", a null or empty html as an empty payload, a null url not at
all. Repeated rows become repeated records. Other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, shared_dir, table

CHUNK_BYTES = 64 << 10
BATCH_BYTES = 4 << 20
HEAD_BYTES = 1 << 20
SCHEMA = "record_id string, chunk_no int, start bigint, chunk binary, digest string, last boolean, valid boolean, error string"
_ARROW = pa.schema([("record_id", pa.string()), ("chunk_no", pa.int32()), ("start", pa.int64()), ("chunk", pa.binary()), ("digest", pa.string()), ("last", pa.bool_()), ("valid", pa.bool_()), ("error", pa.string())])
#: What reading raises where the bytes end early or aren't what their compression says.
_UNREADABLE = (EOFError, OSError, zlib.error)


class _Stream:
    """Reads lines and pieces from a file without ever holding more than it was asked for and one block."""

    def __init__(self, raw: BinaryIO, block: int = 256 << 10) -> None:
        self.raw, self.block, self.kept = raw, block, b""

    def _more(self) -> bool:
        piece = self.raw.read(self.block)
        self.kept += piece
        return bool(piece)

    def line(self) -> bytes:
        """Up to and with the next line feed; what is left at the end of the file."""
        while (at := self.kept.find(b"\n")) < 0:
            if len(self.kept) > HEAD_BYTES:
                raise ValueError("a head has too long a line")
            if not self._more():
                at = len(self.kept) - 1
                break
        out, self.kept = self.kept[: at + 1], self.kept[at + 1 :]
        return out

    def to_record(self) -> None:
        """Skips lines, of any length, up to one that begins a record, or to the end of the file."""
        while True:
            at = 0 if self.kept.startswith(b"WARC/") else self.kept.find(b"\nWARC/") + 1 or -1
            if at >= 0:
                self.kept = self.kept[at:]
                return
            self.kept = self.kept[-5:]
            if not self._more():
                self.kept = b""
                return

    def take(self, most: int) -> bytes:
        """Some bytes, most at most; none at the end of the file."""
        if not self.kept:
            self._more()
        out, self.kept = self.kept[:most], self.kept[most:]
        return out


def _head(stream: _Stream) -> dict[str, str] | None:
    """The fields of the next record, names in lower case; None at the end of the file."""
    first = stream.line()
    while first and not first.strip():
        first = stream.line()
    if not first:
        return None
    if not first.startswith(b"WARC/"):
        raise ValueError(f"no WARC record begins with {first[:40]!r}")
    fields: dict[str, str] = {}
    name, size = "", 0
    while (line := stream.line()).strip():
        size += len(line)
        if size > HEAD_BYTES:
            raise ValueError("a head is too long")
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[0] in " \t" and name:
            fields[name] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    if not line:
        raise EOFError("the file ends within a head")
    return fields


def _matches(field: str | None, digest: bytes) -> bool | None:
    """Whether a field such as sha1:BASE32 (or hexadecimal) names the digest; None where it can't be told."""
    kind, _, value = (field or "").partition(":")
    if kind.lower() != "sha1" or not value:
        return None
    return value.upper() == base64.b32encode(digest).decode() or value.lower() == digest.hex()


def chunks(raw: BinaryIO, chunk_bytes: int = CHUNK_BYTES, kinds: tuple[str, ...] = ("resource", "response")) -> Iterator[tuple]:
    """Rows of a file's records of these types."""
    stream = _Stream(raw)
    empty = hashlib.sha1().hexdigest()
    while True:
        try:
            if (head := _head(stream)) is None:
                return
            size = head.get("content-length", "")
            if not (size.isascii() and size.isdigit()):
                raise ValueError(f"a record has the Content-Length {size[:40]!r}")
            left = int(size)
        except ValueError as e:
            yield "", 0, 0, b"", empty, True, False, str(e)
            stream.to_record()
            continue
        except _UNREADABLE as e:
            yield "", 0, 0, b"", empty, True, False, str(e)
            return
        kind, wanted = head.get("warc-type"), head.get("warc-type") in kinds
        if wanted and kind == "response" and "http" in head.get("content-type", "http"):
            try:
                while left:
                    line = stream.line()
                    line, stream.kept = line[:left], line[left:] + stream.kept
                    left -= len(line)
                    if not line.strip():
                        break
            except (ValueError, *_UNREADABLE) as e:
                yield head.get("warc-record-id", "").strip("<>"), 0, 0, b"", empty, True, False, str(e)
                stream.to_record()
                continue
        name = head.get("warc-record-id", "").strip("<>")
        state, start, no, piece = hashlib.sha1(), 0, 0, b""
        while True:
            while left and len(piece) < chunk_bytes:
                try:
                    more, why = stream.take(min(left, chunk_bytes - len(piece))), "the file ends within a record"
                except _UNREADABLE as e:
                    more, why = b"", str(e)
                if not more:
                    if wanted:
                        state.update(piece)
                        yield name, no, start, piece, state.hexdigest(), True, False, why
                    else:
                        yield name, 0, 0, b"", empty, True, False, why
                    return
                left -= len(more)
                piece += more
            if wanted:
                state.update(piece)
                last = not left
                valid = _matches(head.get("warc-payload-digest"), state.digest()) if last else None
                yield name, no, start, piece, state.hexdigest(), last, valid, None
            start, no, piece = start + len(piece), no + 1, b""
            if not left:
                break


def read(spark: SparkSession, paths: list[str], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of WARC files, a task for each of the files."""

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                where, name = fs.FileSystem.from_uri(path)
                with where.open_input_stream(name, compression="gzip" if name.endswith(".gz") else None) as raw:
                    for row in chunks(raw, chunk_bytes):
                        rows.append(row)
                        size += len(row[3]) + 64
                        if size > BATCH_BYTES:
                            yield _batch(rows)
                            rows, size = [], 0
        if rows:
            yield _batch(rows)

    if not paths:
        return spark.createDataFrame([], SCHEMA)
    names = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, path string")
    return names.repartitionByRange(len(paths), "i").select("path").mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def _field(text: str) -> bytes:
    return "".join(c if c.isprintable() else "%{:02X}".format(ord(c)) for c in text).encode()


def record(page_id: int | None, url: str | None, payload: memoryview | bytes, when: str = "2020-01-01T00:00:00Z") -> bytes:
    """The head of a resource record with this payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest())
    target = b"" if url is None else b"WARC-Target-URI: " + _field(url) + b"\r\n"
    return b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:pages:%s>\r\nWARC-Date: %s\r\n%sContent-Type: text/html\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n" % (
        str("null" if page_id is None else page_id).encode(), when.encode(), target, digest, len(payload),
    )


def write(pages: DataFrame, folder: str) -> list[str]:
    """Writes pages (page_id, url, html) as WARC files of resource records into folder; returns their names."""

    def run(batches):
        path, out = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc", None
        for batch in batches:
            if out is None:
                where, name = fs.FileSystem.from_uri(path)
                where.create_dir(name.rpartition("/")[0], recursive=True)
                out = where.open_output_stream(name, buffer_size=1 << 20)
            html = batch.column(2)
            for i, (page, url) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                text = html[i]
                payload = memoryview(text.as_buffer() or b"") if text.is_valid else memoryview(b"")
                out.write(record(page, url, payload))
                for s in range(0, len(payload), CHUNK_BYTES):
                    out.write(payload[s : s + CHUNK_BYTES])
                out.write(b"\r\n\r\n")
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    chosen = bounded(pages).select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return sorted(r["path"] for r in chosen.mapInArrow(run, "path string").collect())


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as WARC files to the shared folder and read back as chunks."""
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    rows = read(spark, write(table(spark, sf_dir, "pages"), folder))
    return rows.withColumn("chunk", F.replace(F.base64("chunk"), F.lit("\r\n"), F.lit("")))


ORACLE = f"""
WITH p AS (SELECT 'urn:pages:' || coalesce(CAST(page_id AS VARCHAR), 'null') AS record_id, encode(coalesce(html, '')) AS h FROM pages),
c AS (SELECT record_id, h, octet_length(h) AS n, unnest(range(0, greatest(1, (octet_length(h) + {CHUNK_BYTES - 1}) // {CHUNK_BYTES}))) AS k FROM p)
SELECT record_id, CAST(k AS INTEGER) AS chunk_no, CAST(k * {CHUNK_BYTES} AS BIGINT) AS start,
base64(h[k * {CHUNK_BYTES} + 1:(k + 1) * {CHUNK_BYTES}]) AS chunk, sha1(h[1:(k + 1) * {CHUNK_BYTES}]) AS digest,
(k + 1) * {CHUNK_BYTES} >= n AS last, CASE WHEN (k + 1) * {CHUNK_BYTES} >= n THEN true END AS valid, CAST(NULL AS VARCHAR) AS error FROM c
"""
