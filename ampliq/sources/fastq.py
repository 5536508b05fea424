"""FASTQ scan: plain files by byte range, gzip files one partition each."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, pos bigint, header string, seq string, qual string, issue string"
_ARROW = pa.schema([("file", pa.string()), ("pos", pa.int64()), ("header", pa.string()), ("seq", pa.string()), ("qual", pa.string()), ("issue", pa.string())])
SUFFIXES = (".fastq", ".fq", ".fastq.gz", ".fq.gz")
BATCH = 4096


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def list_files(paths: list[str], recursive: bool = True, suffixes: tuple[str, ...] = SUFFIXES) -> list[tuple[str, int]]:
    """FASTQ files of folders and single paths with their sizes, each once, in order."""
    found: dict[str, int] = {}
    for path in paths:
        fs, inner = open_fs(path)
        prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
        info = fs.get_file_info(inner)
        if info.type == pafs.FileType.Directory:
            infos = fs.get_file_info(pafs.FileSelector(inner, recursive=recursive))
        else:
            infos = [info] if info.type == pafs.FileType.File else []
        for one in infos:
            if one.type == pafs.FileType.File and one.path.lower().endswith(suffixes):
                found.setdefault(prefix + one.path, one.size)
    return sorted(found.items(), key=lambda kv: kv[0].lower())


class _Lines:
    """Lines of a byte stream with the offset each begins at, and a short look-ahead."""

    def __init__(self, chunks: Iterator[bytes], start: int = 0):
        self.chunks, self.buffer, self.used, self.base, self.done = chunks, b"", 0, start, False

    @property
    def at(self) -> int:
        return self.base + self.used

    def peek(self, n: int) -> list[bytes]:
        out, frm = [], self.used
        while len(out) < n:
            cut = self.buffer.find(b"\n", frm)
            if cut >= 0:
                out.append(self.buffer[frm : cut + 1])
                frm = cut + 1
            elif self.done:
                if frm < len(self.buffer):
                    out.append(self.buffer[frm:])
                break
            else:
                frm -= self.used
                self._more()
        return out

    def _more(self):
        self.base += self.used
        rest, self.used = self.buffer[self.used :], 0
        try:
            self.buffer = rest + next(self.chunks)
        except StopIteration:
            self.buffer, self.done = rest, True

    def skip(self, n_bytes: int):
        self.used += n_bytes


def _plain_chunks(f, size: int = 1 << 20) -> Iterator[bytes]:
    while chunk := f.read(size):
        yield chunk


def _gzip_chunks(f, trouble: list, size: int = 1 << 20) -> Iterator[bytes]:
    """Decompressed data of all members; damage ends the stream and is noted in ``trouble``."""
    engine, inside = zlib.decompressobj(31), False
    while raw := f.read(size):
        while raw:
            before = engine.copy()
            try:
                yield engine.decompress(raw)
            except zlib.error as exc:
                yield _before_damage(before, raw)
                trouble.append(f"damaged compressed data ({exc})")
                return
            inside, raw = True, b""
            if engine.eof:
                raw = engine.unused_data.lstrip(b"\0")
                engine, inside = zlib.decompressobj(31), False
    if inside:
        trouble.append("compressed data ends early")


def _before_damage(engine, raw: bytes) -> bytes:
    """What can be decoded of a piece in which the damage lies."""
    out = b""
    try:
        for i in range(0, len(raw), 16):
            out += engine.decompress(raw[i : i + 16])
    except zlib.error:
        pass
    return out


def records(path: str, start: int = 0, end: int | None = None) -> Iterator[tuple]:
    """(pos, header, seq, qual, issue) of the records that begin in [start, end).

    A range that begins inside a record first finds a header whose sequence and
    quality have equal lengths. Trailing lines that make no full record are
    left out. A damaged gzip file gives its good records and then one issue.
    """
    fs, inner = open_fs(path)
    try:
        f = fs.open_input_file(inner)
    except FileNotFoundError:
        yield 0, None, None, None, "file vanished"
        return
    trouble: list[str] = []
    with f:
        if path.lower().endswith(".gz"):
            lines = _Lines(_gzip_chunks(f, trouble))
            end = None
        else:
            if start:
                f.seek(start - 1)
                lines = _Lines(_plain_chunks(f), start - 1)
                lines.skip(sum(map(len, lines.peek(1))))
                _resync(lines)
            else:
                lines = _Lines(_plain_chunks(f))
        while end is None or lines.at < end:
            four = lines.peek(4)
            if not four:
                break
            if not four[0].startswith(b"@"):
                lines.skip(len(four[0]))
                continue
            if len(four) < 4:
                break
            head, seq, _, qual = (x.rstrip(b"\r\n") for x in four)
            if seq and not (len(qual) != len(seq) and not four[3].endswith(b"\n")):
                yield lines.at, *(x.decode("utf-8", "replace") for x in (head[1:], seq, qual)), None
            lines.skip(sum(map(len, four)))
    for issue in trouble:
        yield lines.at, None, None, None, issue


def _resync(lines: _Lines):
    while four := lines.peek(4):
        good = len(four) == 4 and four[0].startswith(b"@") and four[2].startswith(b"+")
        if good and len(four[1].strip()) == len(four[3].strip()):
            return
        lines.skip(len(four[0]))


def batches(path: str, start: int = 0, end: int | None = None) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def flush():
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *[pa.array(c, t) for c, t in zip(cols, _ARROW.types[1:])]], schema=_ARROW)

    for row in records(path, start, end):
        rows.append(row)
        if len(rows) >= BATCH:
            yield flush()
            rows.clear()
    if rows:
        yield flush()


class FileRange(InputPartition):
    def __init__(self, path: str, start: int, end: int | None):
        self.path, self.start, self.end = path, start, end


class FastqSource(DataSource):
    """``spark.read.format("fastq").load(path)``; options: recursive, splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FastqReader(dict(self.options))


class FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split("\n") if p]
        self.recursive = options.get("recursive", "true").lower() != "false"
        self.suffixes = tuple(options["suffixes"].split("\n")) if options.get("suffixes") else SUFFIXES
        self.split = int(options.get("splitbytes", options.get("splitBytes", 128 << 20)))

    def partitions(self):
        parts = []
        for path, size in list_files(self.paths, self.recursive, self.suffixes):
            if path.lower().endswith(".gz"):
                parts.append(FileRange(path, 0, None))
            else:
                parts += [FileRange(path, at, min(at + self.split, size)) for at in range(0, size, self.split)]
        return parts or [FileRange("", 0, 0)]

    def read(self, partition):
        if partition.path:
            yield from batches(partition.path, partition.start, partition.end)


def read_fastq(
    spark: SparkSession, paths: str | list[str], recursive: bool = True, split_bytes: int = 128 << 20, suffixes: str | tuple[str, ...] = SUFFIXES
) -> DataFrame:
    """Records and read issues of FASTQ files and folders (see ``reads`` and ``read_issues``)."""
    spark.dataSource.register(FastqSource)
    paths = [paths] if isinstance(paths, str) else list(paths)
    return (
        spark.read.format("fastq").option("paths", "\n".join(paths)).option("recursive", str(recursive)).option("splitBytes", str(split_bytes))
        .option("suffixes", "\n".join([suffixes] if isinstance(suffixes, str) else suffixes)).load()
    )


def reads(scan: DataFrame) -> DataFrame:
    """The good records with read id and source order."""
    good = scan.filter("issue is null")
    return good.select(
        "file", F.struct("file", "pos").alias("ord"), F.regexp_extract("header", r"^(\S*)", 1).alias("read_id"), "seq", "qual"
    )


def read_issues(scan: DataFrame) -> DataFrame:
    """Files that were damaged, cut short or gone, with what happened."""
    return scan.filter("issue is not null").select("file", "issue")


def path_group(path, root: str) -> Column:
    """First folder below ``root``; files directly in it form ``(folder root)``."""
    path = F.col(path) if isinstance(path, str) else path
    inside = F.regexp_replace(path, "^(?:file:)?/*\\Q" + root.strip("/") + "\\E/+", "")
    return F.when(F.contains(inside, F.lit("/")), F.substring_index(inside, "/", 1)).otherwise("(folder root)")


def with_path_group(df: DataFrame, root: str) -> DataFrame:
    return df.withColumn("grp", path_group("file", root))
