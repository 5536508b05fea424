"""Benchmark decontamination by Wu-Manber search over words.

The letters of the search are words: a pattern is a window of words of a benchmark item, a block is two neighbouring words. For every pattern
length there is a shift table by block: how far a window may move when its last block is this one. Where the shift is nought, the block's hash
selects a bucket of patterns, their words' hashes are compared, and the bytes themselves confirm an occurrence. Many stretches of text advance
at once, one step each, as numpy arrays.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import ALNUM, LOWER, U64, buffers, hash_slices, mix, pieces, word_bounds

WINDOW = 10
#: Benchmark text that one search holds in memory; a larger benchmark is searched for in as many blocks as it takes, one after the other.
BLOCK_BYTES = 32 << 20
#: Words of a stretch that advances as one lane.
LANE_WORDS = 256
_PAIR = U64(0x9E3779B97F4A7C15)


def split_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word ends, first word of each text, word hashes)."""
    data, at = buffers(column)
    data = LOWER[data]
    starts, ends, first = word_bounds(data, at, ALNUM)
    return data, starts, ends, first, hash_slices(data, starts, ends)


@dataclass
class Patterns:
    """The distinct windows of one length with their tables."""

    length: int
    words: np.ndarray  # a row of word hashes for each pattern, ordered by suffix
    joined: list[bytes]  # the same as bytes
    items: list[list[int]]
    suffixes: np.ndarray  # sorted distinct hashes of last blocks
    bucket: np.ndarray  # where each suffix's patterns begin, and the end
    shift: np.ndarray


def _block(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    return mix(before * _PAIR + last)


def _cell(block: np.ndarray, shift: np.ndarray) -> np.ndarray:
    return (block & U64(len(shift) - 1)).astype(np.int64)


def build(items: list[tuple[int, str | None]], window: int = WINDOW) -> list[Patterns]:
    """Tables for the windows of the items; an item with fewer words, but not none, is one window."""
    ids = [i for i, _ in items]
    data, starts, ends, first, hashes = split_words(pa.array([t for _, t in items], pa.string()))
    found: dict[int, dict[bytes, tuple[np.ndarray, list[int]]]] = defaultdict(dict)
    for item, low, high in zip(ids, first[:-1], first[1:]):
        words = [data[s:e].tobytes() for s, e in zip(starts[low:high], ends[low:high])]
        size = min(window, len(words))
        for k in range(len(words) - size + 1) if size else ():
            _, of = found[size].setdefault(b" ".join(words[k : k + size]), (hashes[low + k : low + k + size], []))
            if not of or of[-1] != item:
                of.append(item)
    out = []
    for length, patterns in sorted(found.items()):
        words = np.stack([w for w, _ in patterns.values()])
        joined, of = list(patterns), [i for _, i in patterns.values()]
        last = _block(words[:, -2] if length > 1 else np.zeros(len(words), np.uint64), words[:, -1])
        order = np.argsort(last, kind="stable")
        suffixes, begin = np.unique(last[order], return_index=True)
        size = 1 << max(12, math.ceil(math.log2(8 * len(words) * length)))
        shift = np.full(size, length - (length > 1), np.int16)
        shift = np.maximum(shift, 1)
        for end in range(1 if length > 1 else 0, length):
            block = _block(words[:, end - 1] if length > 1 else np.zeros(len(words), np.uint64), words[:, end])
            np.minimum.at(shift, _cell(block, shift), length - 1 - end)
        out.append(Patterns(length, words[order], [joined[k] for k in order], [of[k] for k in order], suffixes, np.append(begin, len(words)), shift))
    return out


def occurrences(p: Patterns, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, pattern) of every place where a pattern's word hashes stand inside one text."""
    m = p.length
    low, high = first[:-1] + m - 1, first[1:]
    lanes = np.maximum(0, -(-(high - low) // LANE_WORDS))
    at = np.repeat(low, lanes) + LANE_WORDS * (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    end = np.minimum(at + LANE_WORDS, np.repeat(high, lanes))
    places, which = [], []
    while len(at):
        block = _block(hashes[at - 1] if m > 1 else np.zeros(len(at), np.uint64), hashes[at])
        step = p.shift[_cell(block, p.shift)]
        if len(stop := np.flatnonzero(step == 0)):
            suffix = np.searchsorted(p.suffixes, block[stop])
            suffix[suffix == len(p.suffixes)] = 0
            same = p.suffixes[suffix] == block[stop]
            here, row, till = at[stop][same], p.bucket[suffix[same]], p.bucket[suffix[same] + 1]
            while len(here):
                equal = (hashes[here[:, None] + np.arange(1 - m, 1)] == p.words[row]).all(axis=1)
                places.append(here[equal] - (m - 1))
                which.append(row[equal])
                row = row + 1
                more = row < till
                here, row, till = here[more], row[more], till[more]
        at = at + np.maximum(step, 1)
        live = at < end
        at, end = at[live], end[live]
    none = np.zeros(0, np.int64)
    return np.concatenate(places or [none]), np.concatenate(which or [none])


def _runs(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of words under the closed ranges."""
    out: list[list[int]] = []
    for low, high in sorted(zip(first.tolist(), last.tolist())):
        if out and low <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def search(column: pa.Array, patterns: list[Patterns]) -> tuple[list[int], list[list[tuple[int, int]]], list[list[int]]]:
    """For each text the number of words, the runs of hit words and the items with occurring windows."""
    data, starts, ends, first, hashes = split_words(column)
    n_words = np.diff(first)
    runs: list[list[tuple[int, int]]] = [[] for _ in n_words]
    items: list[set[int]] = [set() for _ in n_words]
    ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for p in patterns:
        place, which = occurrences(p, hashes, first)
        text = np.searchsorted(first, place, "right") - 1
        for t, a, row in zip(text.tolist(), place.tolist(), which.tolist()):
            if b" ".join(data[s:e].tobytes() for s, e in zip(starts[a : a + p.length], ends[a : a + p.length])) == p.joined[row]:
                ranges[t].append((a - first[t], a - first[t] + p.length - 1))
                items[t].update(p.items[row])
    for t, found in ranges.items():
        low, high = np.array(found).T
        runs[t] = _runs(low, high)
    return n_words.tolist(), runs, [sorted(i) for i in items]


_ADDED = T.StructType().add("n_words", T.LongType()).add("hit_runs", T.ArrayType(T.StructType().add("first", T.LongType()).add("last", T.LongType()))).add("item_ids", T.ArrayType(T.LongType()))
_RUN = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def find_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (by default all) of every row with ``n_words``, ``hit_runs`` (numbers of the first and last word of each maximal run of
    words inside an occurring window, from 0) and ``item_ids`` (sorted, distinct).

    Words are lower-cased (A-Z) runs of ASCII letters, digits and all characters beyond ASCII. Null and empty texts have no words; items that are
    null or empty have no windows; equal items are each named; an empty benchmark hits nothing; repeated rows each get their own result. Columns
    with the names of the three results are replaced. The benchmark's size is asked first: up to ``BLOCK_BYTES`` it goes to every task, a larger one in
    blocks of that size.
    """
    spark = docs.sparkSession
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in _ADDED.names]
    items = benchmark.select(F.col(f"`{item}`").cast("long").alias("item"), F.col(f"`{item_text}`").alias("text")).where("item is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        shared = spark.sparkContext.broadcast([vars(p) for p in build([tuple(r) for r in own.orderBy("item", "text").collect()], window)])
        carried = [*keep, *(["_text"] if k < blocks - 1 else [])]
        rows = rows.mapInArrow(_scan(shared, carried, k > 0), T.StructType([rows.schema[c] for c in carried] + _ADDED.fields))
    return rows


def _scan(shared, carried: list[str], again: bool):
    """The search for one block of the benchmark; ``again``: results of blocks before are there already."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [Patterns(**p) for p in shared.value]
        for batch in batches:
            for piece in pieces(batch, "_text"):
                n, runs, ids = search(piece.column("_text"), patterns)
                if again:
                    earlier = [[(r["first"], r["last"]) for r in x] for x in piece.column("hit_runs").to_pylist()]
                    runs = [_runs(*np.array([*a, *b]).T) if a or b else [] for a, b in zip(runs, earlier)]
                    ids = [sorted({*a, *b}) for a, b in zip(ids, piece.column("item_ids").to_pylist())]
                made = [pa.array(n, pa.int64()), pa.array([[{"first": a, "last": b} for a, b in r] for r in runs], _RUN), pa.array(ids, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in carried), *made], [*carried, *_ADDED.names])

    return scan
