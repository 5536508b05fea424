"""Words, word hashes and shingles of whole texts, as numpy arrays over Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled at once; one longer text makes a larger piece of its own.
PIECE_BYTES = 4 << 20

U64 = np.uint64
_MULTIPLIERS = np.random.default_rng(20).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | U64(1)
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(outside: list[tuple[int, int]]) -> np.ndarray:
    """A table that is True for bytes in none of the given closed ranges."""
    table = np.ones(256, bool)
    for low, high in outside:
        table[low : high + 1] = False
    return table


#: Everything but ASCII white space.
NOT_SPACE = byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: ASCII letters and digits (after lower-casing) and all that is not ASCII.
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, column: str, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text each, so that work arrays stay small."""
    _, at = buffers(batch.column(column))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(at, at[low] + size, "right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the usual finaliser of shifts and odd multipliers)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def word_bounds(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte bounds of every word, and for each text the number of its first word (one more at the end)."""
    inside = table[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    # Texts lie side by side in the buffer; words end with their text.
    before[at[:-1]] = False
    after[at[1:]] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, at)


def hash_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, eight bytes at a time."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    lengths = ends - starts
    h = mix(lengths.astype(np.uint64) * _MULTIPLIERS[0])
    todo = np.arange(len(starts))
    k = 0
    while len(todo):
        left = lengths[todo] - k
        x = eight[starts[todo] + k] & _MASKS[np.minimum(left, 8)]
        h[todo] = mix((h[todo] ^ x) * _MULTIPLIERS[1] + U64(k))
        k += 8
        todo = todo[left > 8]
    return h


def word_hashes(column: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): hashes of the lower-cased words of all texts in order, and where each text's words begin."""
    data, at = buffers(column)
    data = LOWER[data]
    starts, ends, first = word_bounds(data, at, table)
    return hash_slices(data, starts, ends), first


def shingle_sets(hashes: np.ndarray, first: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``width`` words.

    A text with fewer words has its whole sequence as the one shingle, a text
    without words none.
    """
    n = len(hashes)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        rolled += hashes[k : k + len(rolled)] * _MULTIPLIERS[2 + k]
    rolled = mix(rolled)
    for low, high in zip(first[:-1], first[1:]):
        if high - low >= width:
            yield np.unique(rolled[low : high - width + 1])
        elif high > low:
            yield mix(np.sum(hashes[low:high] * _MULTIPLIERS[2 : 2 + high - low], keepdims=True) + U64(high - low))
        else:
            yield np.zeros(0, np.uint64)
