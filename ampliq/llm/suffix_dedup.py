"""Exact removal of long repeated byte strings with suffix arrays of shards.

Equal strings meet in one shard: each string of ``LENGTH`` bytes is stood for by the anchor inside it whose hash is least, and strings with one anchor go
to one shard. Only stretches around anchors that occur more than once travel. In a shard a suffix array is built by induced sorting: suffixes are
classified, the leftmost smaller ones among their neighbours are sorted first, and their order induces that of all others in two scans. Neighbours in
the array that have ``LENGTH`` bytes in common are equal strings; of these the earliest stays and the others are repeated.

Numpy does the scans: a bucket of suffixes induces its predecessors all at once, bucket by bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BY_RANGE, bit_tables, by_range, may_hold, stored
from .words import U64, buffers, hash_slices, mix, pieces

#: Bytes of a string that counts as repeated, and of the anchors that bring equal strings together.
LENGTH, ANCHOR = 100, 32
#: An anchor that turns up so often, counting twice at most among texts handled together, has its strings dealt out one by one.
HOT = 4_096
#: Anchors meant for one shard, most bits of the table of repeated anchors (64 MB), stretches a task combines before it passes them on.
SHARD_ANCHORS, MOST_BITS, COMBINED = 250_000, 29, 150_000
_TABLE = np.random.default_rng(6).integers(0, 1 << 63, 256, dtype=np.uint64) << U64(1) | U64(1)
_STEPS = tuple(int(x) | 1 for x in np.random.default_rng(7).integers(1 << 62, 1 << 63, 8))


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``ANCHOR`` bytes from each place on, by doubling."""
    h = _TABLE[data]
    size, k = 1, 0
    while size < ANCHOR:
        h = h[:-size] * U64(_STEPS[k]) + h[size:]
        size, k = 2 * size, k + 1
    return mix(h)


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first, last): the anchors of all texts, and the first and last start of the strings each stands for.

    The anchor of a string is the least hash of the places inside it, the leftmost of equals; equal strings have it at the same offset.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none.astype(np.uint64), none, none, none
    # Hash and place in one number: the hash's upper 40 bits decide, then the place.
    bits = max(1, int(len(data)).bit_length())
    h = anchor_hashes(data)
    key = (h >> U64(bits)) << U64(bits) | np.arange(len(h), dtype=np.uint64)
    window = LENGTH - ANCHOR + 1
    size = 1
    while 2 * size <= window:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < window:
        key = np.minimum(key[: len(key) - (window - size)], key[window - size :])
    start = np.arange(len(key))
    place = (key & U64((1 << bits) - 1)).astype(np.int64)
    # Strings don't cross texts.
    own = np.ones(len(key), bool)
    for end in at[1:-1]:
        own[max(0, end - LENGTH + 1) : end] = False
    start, place = start[own], place[own]
    if not len(start):
        return none.astype(np.uint64), none, none, none
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)]))
    last = np.append(new[1:], len(start)) - 1
    # Least hashes are small: spread them anew.
    return mix(h[place[new]] + U64(1)), place[new], start[new], start[last]


# -- suffix arrays


def _distribute(lists: list[list[np.ndarray]], places: np.ndarray, chars: np.ndarray) -> None:
    """Append places to their characters' lists in the order given."""
    if len(places):
        order = np.argsort(chars, kind="stable")
        places, chars = places[order], chars[order]
        cuts = np.flatnonzero(chars[1:] != chars[:-1]) + 1
        low = 0
        for high in [*cuts.tolist(), len(places)]:
            lists[chars[low]].append(places[low:high])
            low = high


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _induce(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, letters: int) -> np.ndarray:
    """The suffix array that the given order of the leftmost smaller suffixes induces."""
    bounds = np.searchsorted(t[lms], np.arange(letters + 1))
    larger: list[list[np.ndarray]] = [[] for _ in range(letters)]
    left: list[np.ndarray] = []
    for c in range(letters):
        done, queue = [], _joined(larger[c])
        while len(queue):
            done.append(queue)
            before = queue[queue > 0] - 1
            before = before[~smaller[before]]
            chars = t[before]
            same = chars == c
            _distribute(larger, before[~same], chars[~same])
            queue = before[same]
        left.append(_joined(done))
        own = lms[bounds[c] : bounds[c + 1]]
        before = own[own > 0] - 1
        _distribute(larger, before, t[before])
    less: list[list[np.ndarray]] = [[] for _ in range(letters)]
    less[0].append(np.array([len(t) - 1], np.int32))
    out: list[np.ndarray] = []
    for c in range(letters - 1, -1, -1):
        done, queue = [], _joined(less[c])
        while len(queue):
            done.append(queue)
            before = queue[queue > 0] - 1
            before = before[smaller[before]]
            chars = t[before]
            same = chars == c
            _distribute(less, before[~same], chars[~same])
            queue = before[same]
        own = left[c][::-1]
        before = own[own > 0] - 1
        before = before[smaller[before]]
        _distribute(less, before, t[before])
        out += [_joined(done), own]
    return np.concatenate(out)[::-1]


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``t`` (small integers, the last one 0 and the only 0) in order by their first ``depth`` letters at least."""
    n, letters = len(t), int(t.max()) + 1
    if n == 1:
        return np.zeros(1, np.int32)
    t = t.astype(np.uint16)
    # A suffix is smaller than the next one if its first change of letter rises.
    change = np.flatnonzero(t[:-1] != t[1:])
    upto = np.searchsorted(change, np.arange(n - 1))
    smaller = np.append(t[change[upto]] < t[change[upto] + 1], True)
    lms = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    m = len(lms)
    # First order: by the stretches up to the next such suffix, which induction sorts from any order within a letter.
    found = _induce(t, smaller, lms[np.argsort(t[lms], kind="stable")], letters)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = found[is_lms[found]]
    after = np.zeros(n, np.int32)
    after[lms] = np.append(lms[1:], n - 1)
    hashes = hash_slices(t.view(np.uint8), 2 * order.astype(np.int64), 2 * (after[order].astype(np.int64) + 1))
    rank_at = np.zeros(n, np.int64)
    rank_at[order] = np.cumsum(np.concatenate([[0], hashes[1:] != hashes[:-1]]))
    rank = rank_at[lms]
    # The stretches' ranks are the letters of a text of their own, whose suffixes are sorted by twice as many of them each time.
    step = 1
    while rank.max() < m - 1 and 2 * step < depth + 2:
        key = rank * (m + 1)
        key[: m - step] += rank[step:] + 1
        by = np.argsort(key, kind="stable")
        rank = np.empty(m, np.int64)
        rank[by] = np.cumsum(np.concatenate([[0], key[by][1:] != key[by][:-1]]))
        step *= 2
    return _induce(t, smaller, lms[np.argsort(rank, kind="stable")], letters)


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes: for each suffix of ``order``, what it shares with the one before it there, capped at ``most``; by place in ``data``."""
    padded = np.zeros(len(data) + most + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(shape=(len(data) + most,), dtype="<u8", buffer=padded, strides=(1,))
    out = np.zeros(len(data), np.int32)
    here, above, k = order[1:].astype(np.int64), order[:-1].astype(np.int64), 0
    while len(here) and k < most:
        differ = eight[here + k] ^ eight[above + k]
        stop = differ != 0
        low = differ[stop]
        out[here[stop]] = np.minimum(most, k + (np.log2((low & (~low + U64(1))).astype(np.float64)) // 8).astype(np.int32))
        here, above = here[~stop], above[~stop]
        k += 8
    out[here] = most
    return out


def repeated_starts(segments: list[bytes], docs: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """For each stretch (its document and start given) where in it a string begins that also begins earlier in one of the others."""
    sizes = np.array([len(s) for s in segments], np.int64)
    data = np.frombuffer(b"\0".join(segments), np.uint8)
    at = np.cumsum(sizes + 1) - sizes - 1
    t = data.astype(np.int16) + 2
    t[at[1:] - 1] = 1
    t = np.append(t, 0)
    order = suffix_array(t, LENGTH)
    of = np.repeat(np.arange(len(segments)), sizes - LENGTH + 1)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(sizes - LENGTH + 1) - (sizes - LENGTH + 1), sizes - LENGTH + 1)
    whole = np.full(len(t), -1, np.int64)
    whole[at[of] + offset] = np.arange(len(of))
    order = order[whole[order] >= 0]
    shared = common_prefixes(data, order, LENGTH)[order] >= LENGTH
    shared[0] = False
    group = np.cumsum(~shared)
    string = whole[order]
    doc, place = docs[of[string]], starts[of[string]] + offset[string]
    sort = np.lexsort((place, doc, group))
    first = np.concatenate([[True], group[sort][1:] != group[sort][:-1]])
    head = np.maximum.accumulate(np.where(first, np.arange(len(sort)), 0))
    later = (doc[sort] != doc[sort][head]) | (place[sort] != place[sort][head])
    hit = np.sort(string[sort][later])
    cut = np.searchsorted(of[hit], np.arange(len(segments) + 1))
    return [offset[hit[a:b]] for a, b in zip(cut[:-1], cut[1:])]


def _ranges(starts: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges under strings that begin at the sorted places."""
    cuts = np.flatnonzero(np.diff(starts) > LENGTH) + 1
    return [(int(p[0]), int(p[-1]) + LENGTH) for p in np.split(starts, cuts) if len(p)]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal ranges under those given."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


# -- Spark


def _tables(rows: DataFrame, top: int, bits: int, hot_bits: int) -> list[bytes]:
    """Tables of repeated and of hot anchors; anchors that share a cell send more than needed and lose nothing."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                h, n = np.unique(anchors(*buffers(piece.column("text")))[0], return_counts=True)
                yield by_range(np.repeat(h, np.minimum(n, 2)), top)

    return bit_tables(rows.select("text").mapInArrow(passed, BY_RANGE), top, [(bits, 2), (hot_bits, HOT)])


_ROW = "shard int, hash long, doc long, start long, stop long, segment binary"
_NAMES = ["shard", "hash", "doc", "start", "stop", "segment"]
_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _stretches(rows: DataFrame, marks: list[bytes], shards: int) -> DataFrame:
    """Stretches around repeated anchors for the shards, equal ones of a task combined; and ranges (without a segment) that are repeated within a task."""
    shared = rows.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.frombuffer(x, np.uint8) for x in shared.value]
        first: dict[bytes, tuple[int, int, int]] = {}  # hash, document, start
        done: dict[int, list[tuple[int, int]]] = {}  # document: ranges seen to be repeated

        def packed() -> Iterator[pa.RecordBatch]:
            dealt = mix(np.fromiter((v[0] for v in first.values()), np.int64, len(first)).view(np.uint64)) % U64(shards)
            made = [(k, h, d, a, a + len(s), s) for k, (s, (h, d, a)) in zip(dealt.tolist(), first.items())]
            for d, ranges in done.items():
                made += [(d % shards, 0, d, a, b, None) for a, b in merged(ranges)]
            for low in range(0, len(made), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made[low : low + 20_000]), _KINDS)], _NAMES)
            first.clear()
            done.clear()

        for batch in batches:
            for piece in pieces(batch, "text"):
                data, at = buffers(piece.column("text"))
                h, place, low, high = anchors(data, at)
                keep = may_hold(tables[0], h)
                h, low, high = h[keep], low[keep], high[keep]
                single = may_hold(tables[1], h)
                # Strings of hot anchors go one by one, by their own hash.
                n = high[single] - low[single] + 1
                starts = np.repeat(low[single], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                h = np.concatenate([h[~single], hash_slices(data, starts, starts + LENGTH)])
                low, high = np.concatenate([low[~single], starts]), np.concatenate([high[~single], starts])
                doc = np.searchsorted(at, low, "right") - 1
                ids = piece.column("id").to_pylist()
                raw = data.tobytes()
                for x, d, a, b, o in zip(h.view(np.int64).tolist(), doc.tolist(), low.tolist(), high.tolist(), at[doc].tolist()):
                    segment, new = raw[a : b + LENGTH], (x, ids[d], a - o)
                    old = first.setdefault(segment, new)
                    if old is not new:
                        if new[1:] < old[1:]:
                            first[segment], old, new = new, new, old
                        if new[1:] != old[1:]:
                            done.setdefault(new[1], []).append((new[2], new[2] + len(segment)))
                if len(first) > COMBINED or len(done) > COMBINED:
                    yield from packed()
        yield from packed()

    return rows.mapInArrow(run, _ROW)


def _resolve(group: pa.Table) -> pa.Table:
    """(doc, start, stop): repeated ranges of one shard."""
    doc, start, stop = (group.column(c).to_numpy() for c in ("doc", "start", "stop"))
    segments = group.column("segment").combine_chunks()
    out: list[tuple[int, int, int]] = [(int(d), int(a), int(b)) for d, a, b in zip(*(x[segments.is_null().to_numpy(zero_copy_only=False)] for x in (doc, start, stop)))]
    own = np.flatnonzero(segments.is_valid().to_numpy(zero_copy_only=False))
    if len(own):
        coded = segments.take(pa.array(own)).dictionary_encode()
        code, texts = coded.indices.to_numpy(), coded.dictionary
        doc, start, stop, anchor = doc[own], start[own], stop[own], group.column("hash").to_numpy()[own]
        # Of equal stretches all but the earliest are repeated from end to end.
        order = np.lexsort((start, doc, code))
        new = np.concatenate([[True], code[order][1:] != code[order][:-1]])
        head = order[new]
        lead = np.repeat(head, np.diff(np.append(np.flatnonzero(new), len(order))))
        later = order[(doc[order] != doc[lead]) | (start[order] != start[lead])]
        out += zip(doc[later].tolist(), start[later].tolist(), stop[later].tolist())
        # Different stretches around one anchor share strings in part.
        _, back, n = np.unique(anchor[head], return_inverse=True, return_counts=True)
        mixed = head[n[back] > 1]
        if len(mixed):
            held = texts.take(pa.array(code[mixed])).to_pylist()
            for d, a, hits in zip(doc[mixed].tolist(), start[mixed].tolist(), repeated_starts(held, doc[mixed], start[mixed])):
                if len(hits):
                    out += [(d, a + x, a + y) for x, y in _ranges(hits)]
    return pa.table([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], ["doc", "start", "stop"])


_REMOVED = ["n_bytes", "removed", "kept"]


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, removed, kept) for every row: the bytes of the text, the maximal byte ranges that are removed, and what is left, as bytes.

    A byte goes if a string of ``LENGTH`` bytes over it also begins earlier: in a document with a smaller id, or at a smaller place of the same one.
    Null texts are empty; texts below ``LENGTH`` bytes lose nothing. Ids must not be null; rows with one id count as one document, and texts that differ
    under one id are an error of the caller. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = max(1, total // 32)
    top = max(4, math.ceil(math.log2(max(1, expected / 1_000_000))))
    bits = min(MOST_BITS, max(16, top + 3, math.ceil(math.log2(4 * expected))))
    marks = _tables(rows, top, bits, max(top + 3, bits - 4))
    shards = max(8, -(-expected // SHARD_ANCHORS))
    # Keyed repartitioning and grouping share one exchange.
    sent = _stretches(rows, marks, shards).repartition(shards, "shard")
    found = sent.groupBy("shard").applyInArrow(_resolve, "doc long, start long, stop long")
    cut = stored(found.groupBy(F.col("doc").alias("id")).agg(F.collect_list(F.struct("start", "stop")).alias("ranges")), "ranges")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            for piece in pieces(batch, "text"):
                data, at = buffers(piece.column("text"))
                raw = data.tobytes()
                removed, kept = [], []
                for own, a, b in zip(piece.column("ranges").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    runs = merged([(r["start"], r["stop"]) for r in own or ()])
                    removed.append([{"start": x, "stop": y} for x, y in runs])
                    ends = [0, *(v for r in runs for v in r), b - a]
                    kept.append(b"".join([raw[a + x : a + y] for x, y in zip(ends[::2], ends[1::2])]))
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(np.diff(at)), pa.array(removed, kind), pa.array(kept, pa.binary())], ["id", *_REMOVED])

    done = rows.join(cut, "id", "left").mapInArrow(finish, "id long, n_bytes long, removed array<struct<start:long,stop:long>>, kept binary")
    return done.withColumnRenamed("id", id)
