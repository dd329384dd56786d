"""Dictionary-compressed WARC writer: ``.warc.zst`` archives with an embedded Zstandard dictionary.

Each archive starts with a skippable frame (magic 0x184D2A5D) that holds a dictionary built from all the archive's
own records; every record follows as a Zstandard frame of its own, so one can be read alone at its offset. A
reader needs nothing but the archive.

A Spark partition writes its archives as its rows come: rows are gathered until their records reach
``ARCHIVE_BYTES``, the dictionary is built, the frames go out. No row is shuffled, memory is bounded by the archive
size, and a task that runs again writes the same bytes under the same names. ``frames`` gives the archives' bytes
as rows, ``write`` also puts them into files.

Defined cases. A null url gives the record the target ``urn:page:<page_id>``; a null html is an empty body; a null
page_id leaves out the header that names it. Repeated rows are records of their own with equal record ids. Records
too few or too small for a dictionary are compressed without one, behind an empty skippable frame. An archive of
no rows is not written. Only page_id, url and html are read; other columns don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.llm.common import arrow_batches, table

MAGIC = 0x184D2A5D
ARCHIVE_BYTES, DICTIONARY_BYTES, LEVEL = 64 << 20, 112 << 10, 3
DATE = "2020-01-01T00:00:00Z"
_SPACE = uuid.UUID("6f0e2a5c-3c57-5b0e-9f0a-0d6a6c0f7a11")


def _digest(body: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()


def _block(headers: list[tuple[str, str]], body: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"


def _line(value: str) -> str:
    """A header's value can't hold line ends or other control characters."""
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in value)


def response(page_id: int | None, url: str | None, html: str | None, date: str = DATE) -> bytes:
    """One WARC response record."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    target = _line(url) if url else f"urn:page:{page_id}"
    identity = uuid.uuid5(_SPACE, f"{page_id}\n{url}\n{hashlib.sha256(payload).hexdigest()}")
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{identity}>"), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", _digest(payload)), ("WARC-Block-Digest", _digest(http))]
    if page_id is not None:
        headers.append(("WARC-Page-ID", str(page_id)))
    return _block([*headers, ("Content-Type", "application/http; msgtype=response")], http)


def info(name: str, date: str = DATE) -> bytes:
    body = b"software: gritstone\r\nformat: WARC File Format 1.1\r\n"
    return _block([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], body)


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from all of the records, b"" where they are too little to build one from."""
    total = sum(map(len, records))
    if len(records) < 8 or total < 16 << 10:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(1 << 10, total // 16)), records, k=200, d=8, f=18, accel=1, split_point=1.0).as_bytes()
    except zstandard.ZstdError:  # records without anything in common
        return b""


def archive(name: str, records: list[bytes], level: int = LEVEL, date: str = DATE) -> Iterator[bytes]:
    """The archive's members: the dictionary's frame, the warcinfo record, and each record. Their concatenation is the file."""
    words = build_dictionary(records)
    yield struct.pack("<II", MAGIC, len(words)) + words
    press = zstandard.ZstdCompressor(level=level, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    for record in (info(name, date), *records):
        yield press.compress(record)


def read(data: bytes) -> Iterator[bytes]:
    """The records of an archive, by the dictionary that its first frame holds."""
    magic, size = struct.unpack_from("<II", data)
    if magic != MAGIC:
        raise ValueError("the archive doesn't start with a dictionary frame")
    words = data[8 : 8 + size]
    if words[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may itself be compressed
        words = zstandard.ZstdDecompressor().decompress(words)
    open_ = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    at = 8 + size
    while at < len(data):
        one = open_.decompressobj()
        record = one.decompress(data[at:])
        yield record
        at = len(data) - len(one.unused_data)


def frames(pages: DataFrame, prefix: str = "pages", archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL, date: str = DATE, date_column: str | None = None) -> DataFrame:
    """archive, member, byte_offset, page_id, raw_bytes, frame: member 0 is the dictionary, 1 the warcinfo, the rest are records.

    A record's date is that of its row's ``date_column`` (a timestamp), where one is named and not null, else ``date``."""

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number, ids, records, held = 0, [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal number, ids, records, held
            name = f"{prefix}-{part:06d}-{number:04d}.warc.zst"
            owner, size = [None, None, *ids], [0, len(info(name, date)), *map(len, records)]
            at, rows = 0, []
            for i, frame in enumerate(archive(name, records, level, date)):
                rows.append((name, i, at, owner[i], size[i], frame))
                at += len(frame)
                if i == len(size) - 1 or len(rows) == 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["archive", "member", "byte_offset", "page_id", "raw_bytes", "frame"])
                    rows = []
            number, ids, records, held = number + 1, [], [], 0

        for batch in batches:
            for page_id, url, html, at in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "at")), strict=True):
                ids.append(page_id)
                records.append(response(page_id, url, html, at or date))
                held += len(records[-1])
                if held >= archive_bytes:
                    yield from close()
        if records:
            yield from close()

    at = F.lit(None).cast("string") if date_column is None else F.date_format(F.to_utc_timestamp(F.col(date_column), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), at.alias("at"))
    return arrow_batches(rows, press, "archive string, member int, byte_offset bigint, page_id bigint, raw_bytes bigint, frame binary")


def write(pages: DataFrame, folder: str, prefix: str = "pages", archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL, date: str = DATE, date_column: str | None = None) -> DataFrame:
    """Write the archives into ``folder`` (any URI that pyarrow's file systems know); gives archive, records, bytes.

    Each file is written under a name of its task's attempt and moved into place, so a lost executor leaves no half archive."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        name, out, done = None, None, []

        def close() -> None:
            if out is not None:
                out.close()
                store.move(f"{root}/.{name}.{attempt}", f"{root}/{name}")

        for batch in batches:
            for archive_name, frame in zip(batch.column("archive").to_pylist(), batch.column("frame").to_pylist(), strict=True):
                if archive_name != name:
                    close()
                    name, out = archive_name, store.open_output_stream(f"{root}/.{archive_name}.{attempt}")
                    done.append([name, -2, 0])
                out.write(frame)
                done[-1][1] += 1
                done[-1][2] += len(frame)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "records", "bytes"])

    return arrow_batches(frames(pages, prefix, archive_bytes, level, date, date_column), save, "archive string, records bigint, bytes bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(table(spark, sf_dir, "pages"))
