"""WARC archives compressed with Zstandard: a leading skippable frame with the dictionary, then one frame for each record.

Tasks write archives of a bounded size straight into a shared folder, through the file system its address names. What they wrote is known only
from the manifest that Spark commits, so the files of a task that was lost and ran again are never read. Readers take archives from the manifest, each
streams its file frame by frame and checks what it reads.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import first_by_hash, shared_folder, stored
from .words import pieces

#: First bytes of the skippable frame that holds the dictionary (fixed values of the format).
DICTIONARY_FRAME = 0x184D2A5D
#: An archive is closed once it has this many compressed bytes.
ARCHIVE_BYTES = 64 << 20
#: Payloads, and characters of each, that the dictionary is trained on: it only helps compression, every record is written whole.
DICTIONARY_ROWS, DICTIONARY_CHARS, DICTIONARY_BYTES = 2_000, 4_000, 64 << 10
LEVEL = 3
_READ = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that breaks the format."""


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32, as archives name payloads."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: int | None) -> str:
    """A key's record id; records without a key have one that nothing can refer to."""
    return f"<urn:uuid:{uuid.uuid4() if key is None else uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}')}>"


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None = None, date: str = "2000-01-01T00:00:00Z") -> bytes:
    """One record: an HTTP response with its payload, or a revisit with the response's head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(key)),
        ("WARC-Date", date),
        ("WARC-Target-URI", " ".join((url or "about:blank").split())),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if key is not None:
        fields.append(("X-Page-Id", str(key)))
    if refers_to is not None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-Id", str(refers_to))]
        payload = b""
    fields.append(("WARC-Block-Digest", f"sha1:{digest(http + payload)}"))
    fields.append(("Content-Length", str(len(http) + len(payload))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + http + payload + b"\r\n\r\n"


def _head(data: bytes, what: str) -> tuple[str, dict[str, str], int]:
    """(first line, fields by lower-case name, where the body begins)."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise WarcError(f"{what} head without an end")
    try:
        first, *lines = data[:end].decode().split("\r\n")
    except UnicodeDecodeError as e:
        raise WarcError(f"{what} head is not UTF-8") from e
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"{what} field without a name: {line[:60]!r}")
        if name.lower() in fields:
            raise WarcError(f"{what} field twice: {name}")
        fields[name.lower()] = value.strip()
    return first, fields, end + 4


def _length(fields: dict[str, str], what: str) -> int:
    value = fields.get("content-length", "")
    if not value.isascii() or not value.isdigit():
        raise WarcError(f"{what} without a right Content-Length: {value[:60]!r}")
    return int(value)


def parse(data: bytes) -> dict:
    """Check one record and take it apart."""
    first, fields, at = _head(data, "record")
    if first not in ("WARC/1.1", "WARC/1.0"):
        raise WarcError(f"no WARC version: {first[:60]!r}")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise WarcError(f"record without {name}")
    if fields["warc-type"] not in ("response", "revisit"):
        raise WarcError(f"unknown record type {fields['warc-type'][:60]!r}")
    datetime.fromisoformat(fields["warc-date"].replace("Z", "+00:00")).astimezone(UTC)
    size = _length(fields, "record")
    if len(data) != at + size + 4 or data[at + size :] != b"\r\n\r\n":
        raise WarcError(f"record of {len(data)} bytes, its head and Content-Length make {at + size + 4}")
    block = data[at : at + size]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise WarcError("block digest differs")
    status, http, body = _head(block, "HTTP")
    if not status.startswith("HTTP/"):
        raise WarcError(f"no HTTP status: {status[:60]!r}")
    payload, n = block[body:], _length(http, "HTTP")
    revisit = fields["warc-type"] == "revisit"
    named = fields.get("warc-payload-digest", "")
    if not named.startswith("sha1:"):
        raise WarcError("record without a payload digest")
    if revisit:
        if payload or fields.get("warc-profile") != _PROFILE or "warc-refers-to" not in fields:
            raise WarcError("revisit with a payload, without its profile or without its response")
    elif len(payload) != n or f"sha1:{digest(payload)}" != named:
        raise WarcError("payload differs from its length or digest")
    return {
        "page_id": int(fields["x-page-id"]) if "x-page-id" in fields else None,
        "record_type": fields["warc-type"],
        "url": fields.get("warc-target-uri"),
        "payload_bytes": n,
        "payload_digest": named[5:],
        "refers_to": int(fields["x-refers-to-page-id"]) if revisit and "x-refers-to-page-id" in fields else None,
        "payload": None if revisit else payload,
    }


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary


def frames(stream, read: int = _READ) -> Iterator[bytes]:
    """The content of every frame of an archive, one at a time; the dictionary comes from the leading skippable frame."""
    data = stream.read(8)
    dictionary = None
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_FRAME:
        size = struct.unpack("<I", data[4:])[0]
        held = b""
        while len(held) < size and (more := stream.read(size - len(held))):
            held += more
        if len(held) < size:
            raise WarcError("dictionary frame cut short")
        if held[:4] == zstandard.FRAME_HEADER:
            held = zstandard.ZstdDecompressor().decompress(held, max_output_size=1 << 27)
        dictionary = zstandard.ZstdCompressionDict(held) if held else None
        data = b""
    context = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while True:
        data = data or stream.read(read)
        if not data:
            return
        frame, out = context.decompressobj(), []
        while True:
            try:
                out.append(frame.decompress(data))
            except zstandard.ZstdError as e:
                raise WarcError(f"frame can't be decoded: {e}") from e
            if frame.eof:
                data = frame.unused_data
                break
            data = stream.read(read)
            if not data:
                raise WarcError("last frame cut short")
        yield b"".join(out)


def read_archive(path: str) -> Iterator[dict]:
    """The records of one archive, checked; an error names the archive and the record."""
    system, inside = pafs.FileSystem.from_uri(path)
    with system.open_input_stream(inside) as stream:
        number = 0
        try:
            for number, frame in enumerate(frames(stream), 1):  # noqa: B007
                yield parse(frame)
        except ValueError as e:
            raise WarcError(f"{path}, after record {number}: {e}") from e


def train_dictionary(pages: DataFrame, payload: str = "html") -> bytes:
    """A dictionary from a bounded sample of payloads, by order of their hash; none if there is too little to train on."""
    text = F.substring(F.col(f"`{payload}`").cast("string"), 1, DICTIONARY_CHARS)
    rows = first_by_hash(pages.select(text.alias("t")).where("length(t) > 0"), "t", DICTIONARY_ROWS).collect()
    samples = [record(k, None, r.t.encode(), None) for k, r in enumerate(rows)]
    if sum(map(len, samples)) < 20 * 1024 or len(samples) < 10:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 10), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


_MANIFEST = T.StructType().add("path", T.StringType()).add("records", T.LongType()).add("bytes", T.LongType())


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", dictionary: bytes = b"") -> DataFrame:
    """Write a record per row of ``pages`` (which may hold ``refers_to``, for revisits) and return the manifest (path, records, bytes)."""
    shared = pages.sparkSession.sparkContext.broadcast(dictionary)
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).alias("payload"), "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inside = pafs.FileSystem.from_uri(folder)
        system.create_dir(inside, recursive=True)
        trained = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        context = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=True)
        out, name, records, size = None, "", 0, 0
        made: list[tuple[str, int, int]] = []
        for batch in batches:
            for piece in pieces(batch, "payload"):
                for k, u, p, r in zip(*(piece.column(c).to_pylist() for c in ("key", "url", "payload", "refers_to"))):
                    if out is None:
                        name = f"part-{uuid.uuid4().hex}.warc.zst"
                        out, records, size = system.open_output_stream(f"{inside}/{name}"), 0, 0
                        out.write(dictionary_frame(shared.value))
                    frame = context.compress(record(k, u, p.encode(), r))
                    out.write(frame)
                    records, size = records + 1, size + len(frame)
                    if size >= ARCHIVE_BYTES:
                        out.close()
                        out = made.append((f"{folder}/{name}", records, size))
        if out is not None:
            out.close()
            made.append((f"{folder}/{name}", records, size))
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], _MANIFEST.names)

    return stored(rows.mapInArrow(run, _MANIFEST), "manifest")


_RECORD = T.StructType().add("page_id", T.LongType()).add("record_type", T.StringType()).add("url", T.StringType()).add("payload_bytes", T.LongType()).add("payload_digest", T.StringType()).add("refers_to", T.LongType()).add("payload", T.BinaryType())


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives in ``manifest`` (a column path): page_id, record_type, url, payload_bytes, payload_digest, refers_to, payload.

    ``payload`` is null for revisits, and for all records without ``payloads``; lengths and digests are checked either way. A damaged archive,
    head, length or digest fails the job with a message that names the archive.
    """
    schema = T.StructType([f for f in _RECORD.fields if payloads or f.name != "payload"])
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(schema.names, kinds)], schema.names)

        rows, size = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for r in read_archive(path):
                    rows.append(r)
                    size += len(r["payload"] or b"")
                    if not payloads:
                        r["payload"] = None
                    if len(rows) >= 2_000 or size >= 8 << 20:
                        yield pack(rows)
                        rows, size = [], 0
        if rows:
            yield pack(rows)

    paths = manifest.select("path")
    return paths.repartition(max(1, manifest.count()), F.xxhash64("path")).mapInArrow(run, schema)


def revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = 0) -> DataFrame:
    """(key, refers_to): rows whose payload another row with a smaller key has too, for payloads of at least ``least`` bytes.

    The rows carry a digest and a key only. Groups of one fall out before the join; a group with very many rows is split by Spark's skew handling.
    """
    text = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit(""))
    slim = pages.select(F.col(f"`{key}`").cast("long").alias("key"), F.sha1(text).alias("digest"), F.octet_length(text).alias("size")).where(F.col("size") >= least).drop("size")
    groups = slim.groupBy("digest").agg(F.min("key").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return slim.join(groups, "digest").where("key > refers_to").select("key", "refers_to")


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Write ``pages`` as archives into the shared folder and return their manifest.

    Of equal payloads the row with the smallest key is the response and the others are revisits of it; null payloads are empty. Keys name one row each:
    a key that comes twice with one payload makes two responses, and rows whose key is null, which nothing can refer to, are responses too. An empty table makes no archive. Other columns are ignored.
    """
    refers = revisits(pages, key, payload, least).distinct().withColumnRenamed("key", "_key")
    rows = pages.select(key, url, payload)
    joined = rows.join(refers, rows[f"`{key}`"] == refers["_key"], "left").drop("_key")
    return write_archives(joined, shared_folder(pages.sparkSession, "warc"), key, url, payload, train_dictionary(pages, payload))
