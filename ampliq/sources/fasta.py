"""FASTA scan: plain files by byte range, gzip files one partition each; one row per record, every byte read once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from ..functions.seq import decode_strand
from .fastq import FileRange, _gzip_chunks, _plain_chunks, open_fs

SCHEMA = "file string, pos bigint, header string, seq string"
_ARROW = pa.schema([("file", pa.string()), ("pos", pa.int64()), ("header", pa.string()), ("seq", pa.string())])
_SPACE = bytes(range(9, 14)) + b" "
#: Letters of sequence that are given out together.
BATCH_BYTES = 4 << 20


def list_fasta(paths: list[str]) -> list[tuple[str, int]]:
    """Files of folders (all below them but hidden ones and markers) and single paths with their sizes, in order."""
    found: dict[str, int] = {}
    for path in paths:
        fs, inner = open_fs(path)
        prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
        info = fs.get_file_info(inner)
        infos = fs.get_file_info(pafs.FileSelector(inner, recursive=True)) if info.type == pafs.FileType.Directory else [info]
        for one in infos:
            below = one.path[len(inner) :].strip("/").split("/")
            if one.type == pafs.FileType.File and not any(part[:1] in ("_", ".") for part in below):
                found.setdefault(prefix + one.path, one.size)
    return sorted(found.items())


def _pieces(path: str, start: int, end: int | None) -> Iterator[tuple[int, list[bytes]]]:
    """(pos, parts) of the records whose ``>`` stands at the beginning of a line in [start, end); parts come in order, without the ``>``.

    What stands before the first record of a file belongs to none. A damaged
    gzip file gives what stands before the damage.
    """
    fs, inner = open_fs(path)
    with fs.open_input_stream(inner, compression=None) if path.lower().endswith(".gz") else fs.open_input_file(inner) as f:
        if path.lower().endswith(".gz"):
            chunks, at = _gzip_chunks(f, []), 0
        else:
            # The line end before a range tells whether it begins with a record.
            at = max(0, start - 1)
            f.seek(at)
            chunks = _plain_chunks(f)
        pos, parts = -1, []
        held, line_start = b"", start == 0
        for chunk in chunks:
            # A line end is looked at together with what follows it.
            data, held = held + chunk, b""
            if data.endswith(b"\n"):
                data, held = data[:-1], b"\n"
            low = 0
            while True:
                if line_start and low == 0 and data[:1] == b">":
                    mark = 0
                else:
                    found = data.find(b"\n>", low)
                    mark = found + 1 if found >= 0 else -1
                if mark < 0:
                    break
                if pos >= 0:
                    parts.append(data[low:mark])
                    yield pos, parts
                if end is not None and at + mark >= end:
                    return
                pos, parts, low, line_start = at + mark, [], mark + 1, False
            if pos >= 0:
                parts.append(data[low:])
            elif end is not None and at + len(data) >= end:
                return
            at, line_start = at + len(data), line_start and not data
        if pos >= 0:
            yield pos, [*parts, held]


def records(path: str, start: int = 0, end: int | None = None) -> Iterator[tuple[int, str, str]]:
    """(pos, header, seq) of the records of a range; white space goes from sequences and from the ends of headers, bytes that are no UTF-8 are replaced."""
    for pos, parts in _pieces(path, start, end):
        head, _, body = b"".join(parts).partition(b"\n")
        yield pos, head.decode("utf-8", "replace").rstrip(), body.translate(None, _SPACE).decode("utf-8", "replace")


class FastaSource(DataSource):
    """``spark.read.format("fasta")``; options: paths (one a line), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FastaReader(dict(self.options))


class FastaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split("\n") if p]
        self.split = int(options.get("splitbytes", options.get("splitBytes", 64 << 20)))

    def partitions(self):
        parts = []
        for path, size in list_fasta(self.paths):
            if path.lower().endswith(".gz"):
                parts.append(FileRange(path, 0, None))
            else:
                parts += [FileRange(path, at, min(at + self.split, size)) for at in range(0, size, self.split)]
        return parts or [FileRange("", 0, 0)]

    def read(self, partition):
        rows, size = [], 0

        def given() -> pa.RecordBatch:
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array([partition.path] * len(rows)), *[pa.array(c, t) for c, t in zip(columns, _ARROW.types[1:])]], schema=_ARROW)

        for row in records(partition.path, partition.start, partition.end) if partition.path else ():
            rows.append(row)
            size += len(row[1]) + len(row[2])
            if size >= BATCH_BYTES or len(rows) >= 10_000:
                yield given()
                rows, size = [], 0
        if rows:
            yield given()


def read_fasta(spark: SparkSession, paths: str | list[str], run_pattern: str | None = None, split_bytes: int = 64 << 20) -> DataFrame:
    """Records of FASTA files (also gzip) and folders: file, ord, header, seq and, with a pattern, run.

    Records begin with ``>`` at the beginning of a line; text before the first
    one of a file is dropped. ``run_pattern`` takes its first group from the path.
    """
    spark.dataSource.register(FastaSource)
    paths = [paths] if isinstance(paths, str) else list(paths)
    scan = spark.read.format("fasta").option("paths", "\n".join(paths)).option("splitBytes", str(split_bytes)).load()
    out = scan.select("file", F.struct("file", "pos").alias("ord"), "header", "seq")
    if run_pattern:
        out = out.withColumn("run", F.regexp_extract("file", run_pattern, 1))
    return out


def read_alignment(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Aligned records with the letters of reverse-strand reads decoded."""
    return read_fasta(spark, paths).withColumn("seq", decode_strand(F.upper("seq")))


def read_runs(spark: SparkSession, root: str, name: str = "consensus_filtered.fa") -> DataFrame:
    """The named FASTA of every run folder directly below ``root``, or of ``root`` itself."""
    from .fastq import open_fs

    fs, inner = open_fs(root)
    from pyarrow.fs import FileSelector, FileType

    names = [f"{inner.rstrip('/')}/{name}"] + [
        f"{i.path}/{name}" for i in fs.get_file_info(FileSelector(inner)) if i.type == FileType.Directory
    ]
    there = sorted(i.path for i in fs.get_file_info(names) if i.type == FileType.File)
    prefix = root[: len(root) - len(inner)] if root.endswith(inner) else ""
    return read_fasta(spark, [prefix + p for p in there], r"([^/]+)/[^/]+$")
