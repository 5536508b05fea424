"""Compact bytes for what is stored or moved in bulk: letters of like reads, counts of columns."""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa

_KINDS = ("u1", "<u2", "<u4", "<i8")
#: Stands for a text that is null; no sequence holds it.
_NULL = "\0"


def squeeze(data: bytes) -> bytes:
    """Compressed bytes, told their length."""
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True) if data else b""


def stretch(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True) if data else b""


def squeeze_texts(texts: list[str | None]) -> bytes:
    """One or more texts without line breaks; what they share is held once."""
    return squeeze("\n".join([_NULL if t is None else t for t in texts]).encode())


def stretch_texts(data: bytes) -> list[str | None]:
    return [None if t == _NULL else t for t in stretch(data).decode().split("\n")]


def squeeze_counts(counts: np.ndarray, width: int) -> bytes:
    """Counts (rows of ``width``, flat, not negative) in the narrowest type that holds them, one place of all rows after the other."""
    most = int(counts.max(initial=0))
    kind = next(k for k, t in enumerate(_KINDS) if most <= np.iinfo(t).max)
    return bytes([kind]) + squeeze(np.ascontiguousarray(counts.reshape(-1, width).T, _KINDS[kind]).tobytes())


def stretch_counts(data: bytes, width: int) -> np.ndarray:
    """The counts of ``squeeze_counts``, flat again."""
    flat = np.frombuffer(stretch(data[1:]), _KINDS[data[0]])
    return flat.reshape(width, -1).T.astype(np.int64).reshape(-1)


def runs_of(batches, key: int = 0):
    """(key, rows) for each run of rows with the same first value, across batches."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    yield from groupby(rows, key=lambda row: row[key])
