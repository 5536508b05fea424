"""Letters per alignment column, as one matrix per key that can be added up.

A task counts all reads of a batch at once, so a key sends one row per batch and not one per letter; the rows of a key then pass one after the other
through a sum, in the order of the key. A key with very many reads is therefore counted everywhere, and no task holds more than its matrix.
Matrices move and are stored as compact bytes (``count_sums``), as most columns hold one letter; they become columns where they are read (``columns_of``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.packs import squeeze_counts, stretch_counts

LETTERS = {"A": "A", "C": "C", "G": "G", "T": "T", "-": "gap", "N": "N"}
#: Letters read at once; a task holds up to some 150 bytes for each.
PIECE = 1 << 20
#: Counts given out together.
BLOCK = 1 << 21
_KINDS = len(LETTERS) + 1
_SLOT = np.full(256, _KINDS - 1)
_SLOT[[ord(b) for b in LETTERS]] = np.arange(len(LETTERS))
COLUMN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("n", *[f"n_{name}" for name in LETTERS.values()])])
_COLUMN = pa.struct([pa.field(f.name, pa.int64(), False) for f in COLUMN])


def _places(batch: pa.RecordBatch, keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(first, which): a row of each distinct key in a batch, and the number of every row's key."""
    code = np.zeros(batch.num_rows, np.int64)
    for key in keys:
        column = batch.column(key).dictionary_encode(null_encoding="encode")
        code = np.unique(code * len(column.dictionary) + np.asarray(column.indices), return_inverse=True)[1]
    _, first, which = np.unique(code, return_index=True, return_inverse=True)
    return first, which


def _counting(keys: Sequence[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("aln").cast(pa.large_string())
            at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(at, at[low] + PIECE, "right")) - 1)
                part = batch.slice(low, high - low)
                first, which = _places(part, keys)
                size = np.diff(at[low : high + 1])
                width = np.zeros(len(first), np.int64)
                np.maximum.at(width, which, size)
                base = np.concatenate([[0], np.cumsum(width)])
                place = np.arange(at[low], at[high]) + np.repeat(base[which] - at[low:high], size)
                counts = np.bincount(place * _KINDS + _SLOT[data[at[low] : at[high]]], minlength=base[-1] * _KINDS)
                cut = base * _KINDS
                own = [part.column(k).take(pa.array(first)) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array([squeeze_counts(counts[a:b], _KINDS) for a, b in zip(cut[:-1], cut[1:])], pa.binary())], [*keys, "counts"])
                low = high

    return count


def _columns(matrices: list[np.ndarray]) -> pa.Array:
    """Matrices as lists of structs."""
    flat = np.concatenate(matrices).reshape(-1, _KINDS)
    fields = [flat.sum(axis=1), *flat.T[:-1]]
    cols = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(f)) for f in fields], fields=list(_COLUMN))
    at = np.concatenate([[0], np.cumsum([len(m) // _KINDS for m in matrices])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), cols, type=pa.list_(_COLUMN))


def _plus(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    if a is None or len(a) < len(b):
        a, b = b.copy(), a if a is not None else b[:0]
    a[: len(b)] += b
    return a


def _summing(keys: Sequence[str], levels: Sequence[int]):
    """Sums of the rows of each key, which come one after the other; with levels the sums up to each of them."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums = None, [None] * max(1, len(levels))
        names, reads, done, size = [], [], [], 0
        types: list[pa.DataType] = []

        def settle() -> None:
            nonlocal size
            total = None
            for k, m in enumerate(sums):
                total = total if m is None else _plus(total, m)
                if total is not None:
                    names.append((*key, *([levels[k]] if levels else [])))
                    reads.append(int(total.reshape(-1, _KINDS).sum(axis=1).max(initial=0)))
                    done.append(squeeze_counts(total, _KINDS))
                    size += len(done[-1])

        def given() -> pa.RecordBatch:
            kinds = [*types, *([pa.int32()] if levels else [])]
            own = [pa.array([n[k] for n in names], t) for k, t in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([*own, pa.array(reads, pa.int64()), pa.array(done, pa.binary())], [*keys, *(["level"] if levels else []), "reads", "counts"])

        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            bands = batch.column("band").to_pylist() if levels else [0] * batch.num_rows
            owners = zip(*(batch.column(k).to_pylist() for k in keys)) if keys else [()] * batch.num_rows
            # Looked at where they lie; a list would hold a batch's matrices twice.
            for own, band, raw in zip(owners, bands, batch.column("counts")):
                if own != key:
                    if key is not None:
                        settle()
                    key, sums = own, [None] * len(sums)
                    if size > BLOCK:
                        yield given()
                        names, reads, done, size = [], [], [], 0
                sums[band] = _plus(sums[band], stretch_counts(raw.as_py(), _KINDS))
        if key is not None:
            settle()
            yield given()

    return add


def count_sums(aln: DataFrame, keys: Sequence[str] = ("sample",), rank: str | None = None, levels: Sequence[int] = ()) -> DataFrame:
    """(keys, reads, counts): the counts of ``count_matrix`` as compact bytes, which are cheap to store and to move."""
    keys, levels = list(keys), sorted(levels)
    rows = aln.filter("aln <> ''").select(*keys, *([rank] if rank else []), F.upper("aln").alias("aln"))
    own = list(keys)
    if levels:
        band = sum((F.col(rank) > level).cast("int") for level in levels)
        rows = rows.filter(F.col(rank) <= levels[-1]).withColumn("band", band)
        own.append("band")
    rows = rows.select(*own, "aln")
    part = T.StructType([*[rows.schema[k] for k in own], T.StructField("counts", T.BinaryType())])
    counted = rows.mapInArrow(_counting(own), part)
    # Rows of one key only: as many as batches of reads that hold it.
    met = counted.repartition(*keys) if keys else counted.repartition(1)
    named = [*[rows.schema[k] for k in keys], *([T.StructField("level", T.IntegerType())] if levels else [])]
    out = T.StructType([*named, T.StructField("reads", T.LongType()), T.StructField("counts", T.BinaryType())])
    return (met.sortWithinPartitions(*keys) if keys else met).mapInArrow(_summing(keys, levels), out)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows of ``count_sums`` with their matrices, some at a time."""
    for batch in batches:
        low, held, size = 0, [], 0
        for k, raw in enumerate(batch.column("counts")):
            held.append(stretch_counts(raw.as_py(), _KINDS).reshape(-1, _KINDS))
            size += held[-1].size
            if size > BLOCK or k + 1 == batch.num_rows:
                yield batch.slice(low, k + 1 - low), held
                low, held, size = k + 1, [], 0


def columns_of(sums: DataFrame) -> DataFrame:
    """The matrices of ``count_sums`` with ``cols`` for their bytes; other columns stay."""
    rest = [f for f in sums.schema.fields if f.name != "counts"]

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in _blocks(batches):
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in rest), _columns([m.reshape(-1) for m in held])], [*(f.name for f in rest), "cols"])

    return sums.mapInArrow(unfold, T.StructType([*rest, T.StructField("cols", T.ArrayType(COLUMN, False))]))


def sums_of(matrix: DataFrame) -> DataFrame:
    """``columns_of`` undone; what holds bytes already stays as it is."""
    if "counts" in matrix.columns:
        return matrix
    rest = [f for f in matrix.schema.fields if f.name != "cols"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = []
            for cols in batch.column("cols"):
                n, *named = (cols.values.field(k).to_numpy(zero_copy_only=False) for k in range(_KINDS))
                raw.append(squeeze_counts(np.stack([*named, n - sum(named)], axis=1).reshape(-1), _KINDS))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(raw, pa.binary())], [*(f.name for f in rest), "counts"])

    return matrix.mapInArrow(fold, T.StructType([*rest, T.StructField("counts", T.BinaryType())]))


def with_calls(matrix: DataFrame, thresholds: Sequence[float], strict: bool = False) -> DataFrame:
    """The rows with ``calls`` for their counts: the aligned consensus at each threshold.

    A column's letter is the one above the threshold share; gaps give way when
    another letter is left, unless ``strict``. Columns of many rows are called together.
    """
    sums = sums_of(matrix)
    rest = [f for f in sums.schema.fields if f.name != "counts"]
    letters, gap, unclear = np.frombuffer("".join(LETTERS).encode(), np.uint8), list(LETTERS).index("-"), ord("N")
    thresholds = [float(t) for t in thresholds]

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in _blocks(batches):
            at = np.cumsum([0, *map(len, held)])
            counts = np.concatenate(held)
            share = counts[:, : len(letters)] / np.maximum(counts.sum(axis=1), 1)[:, None]
            texts = []
            for t in thresholds:
                over = share > t
                n, first = over.sum(axis=1), letters[over.argmax(axis=1)]
                many = np.full(len(first), unclear, np.uint8)
                if not strict:
                    solid = over.copy()
                    solid[:, gap] = False
                    many = np.where(solid.sum(axis=1) == 1, letters[solid.argmax(axis=1)], many)
                out = np.where(n == 1, first, np.where(n == 0, unclear, many)).astype(np.uint8).tobytes().decode()
                texts.append([out[a:b] for a, b in zip(at[:-1], at[1:])])
            calls = pa.array([list(own) for own in zip(*texts)] if texts else [[] for _ in held], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in rest), calls], [*(f.name for f in rest), "calls"])

    return sums.mapInArrow(call, T.StructType([*rest, T.StructField("calls", T.ArrayType(T.StringType()))]))


def second_bases(matrix: DataFrame, minor: float) -> DataFrame:
    """(sample, pos, second, n): columns of 4 reads and more whose second base reaches ``minor`` of them, in samples with 2 such columns."""
    sums = sums_of(matrix).select("sample", "counts")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in _blocks(batches):
            counts, size = np.concatenate(held), np.array([len(m) for m in held])
            at = np.repeat(np.cumsum(size) - size, size)
            owner, n = np.repeat(np.arange(len(held)), size), counts.sum(axis=1)
            second = np.sort(counts[:, :4], axis=1)[:, 2]
            good = np.flatnonzero((n >= 4) & (second > 0) & (second / np.maximum(n, 1) >= minor))
            good = good[np.bincount(owner[good], minlength=len(held))[owner[good]] >= 2]
            own = [part.column("sample").take(pa.array(owner[good])), pa.array((good - at[good]).astype(np.int32)), pa.array(second[good]), pa.array(n[good])]
            yield pa.RecordBatch.from_arrays(own, ["sample", "pos", "second", "n"])

    kinds = [T.StructField(name, kind) for name, kind in (("pos", T.IntegerType()), ("second", T.LongType()), ("n", T.LongType()))]
    return sums.mapInArrow(find, T.StructType([sums.schema["sample"], *kinds]))


def count_matrix(aln: DataFrame, keys: Sequence[str] = ("sample",), rank: str | None = None, levels: Sequence[int] = ()) -> DataFrame:
    """(keys, reads, cols): how often each letter stands in each alignment column (``aln``, plain letters), in column order.

    ``cols`` holds structs (n, n_A, n_C, n_G, n_T, n_gap, n_N); ``n`` counts all
    letters, ``reads`` is the largest n. Empty and null rows count nowhere, a key
    without others is left out. With ``levels`` a key has a row for each level:
    the counts of its reads up to that ``rank``. Reads are counted once, in bands
    between the levels, and the bands are added up.
    """
    return columns_of(count_sums(aln, keys, rank, levels))


def column_counts(aln: DataFrame, keys: Sequence[str] = ("sample",)) -> DataFrame:
    """The same with one row per column: keys, pos (from 0), n and a count per letter."""
    return count_matrix(aln, keys).select(*keys, F.posexplode("cols").alias("pos", "c")).select(*keys, "pos", "c.*")
