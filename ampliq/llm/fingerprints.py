"""Bottom-k sketches of shingle hashes.

A sketch holds the k smallest distinct hashes of a document's shingles, in order. The sketch of a union is the k smallest of both sketches, so parts can
be sketched apart and merged in any order; from two sketches follow estimates of resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import NOT_SPACE, U64, pieces, shingle_sets, word_hashes

#: Hashes in a sketch, words in a shingle.
K, WORDS = 128, 5
#: Hashes are kept to six bytes.
HASH_BITS = 48
#: Rows of neighbouring ids meant for one bucket.
BUCKET_ROWS = 2_000


def sketches(texts: list[str], k: int = K, words: int = WORDS) -> list[np.ndarray]:
    """The k smallest shingle hashes of each text (all, if it has fewer), sorted."""
    hashes, first = word_hashes(pa.array(texts, pa.string()), NOT_SPACE)
    return [np.unique(s[:k] >> U64(64 - HASH_BITS)) for s in shingle_sets(hashes, first, words)]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of both together."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((int(a[k - 1]) + 1) / 2.0**HASH_BITS)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity: the share of the union's sketch that both hold; two empty documents are alike."""
    both = merge(a, b, k)
    return float(len(np.intersect1d(np.intersect1d(a, b, True), both, True)) / len(both)) if len(both) else 1.0


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b holds; 1 for an empty a."""
    size = distinct(a, k)
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / size) if size else 1.0


def packed(sketch: np.ndarray) -> bytes:
    """Six bytes a hash, the largest first bytes first."""
    return sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """The sketch that was packed."""
    six = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return np.hstack([np.zeros((len(six), 2), np.uint8), six]).view(">u8").ravel().astype(np.uint64)


def sketch(docs: DataFrame, text: str = "text", keep: list[str] | None = None, k: int = K, words: int = WORDS) -> DataFrame:
    """The columns ``keep`` (by default all) with ``sketch`` (binary, six bytes a hash). Null and empty texts have an empty sketch."""
    keep = [c for c in (keep if keep is not None else docs.columns) if c != "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "_text"):
                made = pa.array([packed(s) for s in sketches([t or "" for t in piece.column("_text").to_pylist()], k, words)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), made], [*keep, "sketch"])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    return rows.mapInArrow(run, T.StructType([rows.schema[c] for c in keep] + [T.StructField("sketch", T.BinaryType())]))


def merged(rows: DataFrame, key: list[str], sketch: str = "sketch", k: int = K, parts: int = 32) -> DataFrame:
    """One sketch for each key from sketches of its parts, in two steps, so that a hot key's rows are merged in many tasks first.

    Null sketches count as empty; a key with null columns is a key like others.
    """

    def union(group: pa.Table) -> pa.Table:
        total = np.zeros(0, np.uint64)
        for column in group.column(sketch).chunks:
            held = [unpacked(x) for x in column.to_pylist() if x]
            total = np.unique(np.concatenate([total, *held]))[:k]
        return pa.table([*(group.column(c).slice(0, 1) for c in key), pa.array([packed(total)], pa.binary())], [*key, sketch])

    schema = T.StructType([rows.schema[c] for c in key] + [T.StructField(sketch, T.BinaryType())])
    dealt = rows.select(*key, sketch).withColumn("_part", F.pmod(F.xxhash64(sketch), F.lit(parts)))
    return dealt.groupBy(*key, "_part").applyInArrow(union, schema).groupBy(*key).applyInArrow(union, schema)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter (of code points, rounded down) replaced by the first as many, or all, of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_OUT = [("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.BinaryType()), ("edited_fingerprint", T.BinaryType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType())]


def _compare(rows: list[tuple[int, str | None]], k: int, words: int) -> pa.RecordBatch:
    """Each of the rows but the last against the one after it."""
    texts = [t or "" for _, t in rows]
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    own, new = sketches(texts, k, words), sketches(changed, k, words)
    n = len(changed)
    columns: list[pa.Array] = [
        pa.array([i for i, _ in rows[:n]], pa.int64()),
        pa.array([len(t) for t in texts[:n]], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        pa.array([packed(s) for s in own[:n]], pa.binary()),
        pa.array([packed(s) for s in new], pa.binary()),
        pa.array([resemblance(a, b, k) for a, b in zip(own, new)], pa.float64()),
        pa.array([resemblance(a, b, k) for a, b in zip(own, own[1:])], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["_id", *(c for c, _ in _OUT)])


def edits(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """Every document's sketch next to that of its edited text and of the next document, by ascending id; after the last comes the first.

    Neighbours meet because ids are cut into ranges at ids that exist: the row at a cut belongs to its own range and closes the one before, and the
    first row closes the last range. Inside a range rows stream past in order. Null texts are empty; rows with one id follow each other by their
    text; rows without an id come before all others; a table with one row compares it with itself; an empty table gives no rows. Other columns of
    ``docs`` are not carried along, so their names can't clash.
    """
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("_id"), F.col(f"`{text}`").alias("_text"))
    n, low = docs.select(F.count("*"), F.min(F.col(f"`{id}`").cast("long"))).first()
    buckets = max(1, min(10_000, n // BUCKET_ROWS))
    cuts = rows.agg(F.percentile_approx("_id", [q / buckets for q in range(1, buckets)], 20 * buckets)).first()[0] if buckets > 1 else []
    # At most ten thousand numbers, whatever the data.
    cuts = sorted(set(cuts or []) - {low})
    held = F.array(*[F.lit(c) for c in cuts]) if cuts else F.lit(None).cast("array<long>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))] or [F.lit(0)])
    bucket = F.reduce(steps, F.lit(0), lambda at, step: F.when(F.get(held, at + step - 1) <= F.col("_id"), at + step).otherwise(at))
    closes = F.col("_id").eqNullSafe(F.lit(low).cast("long"))
    rows = rows.withColumn("_bucket", bucket)
    at_cut = (F.col("_bucket") > 0) & (F.get(held, F.col("_bucket") - 1) == F.col("_id"))
    own = F.struct(F.col("_bucket").alias("bucket"), F.lit(False).alias("closing"))
    before = F.when(closes, F.struct(F.lit(len(cuts)).alias("bucket"), F.lit(True).alias("closing"))).when(at_cut, F.struct((F.col("_bucket") - 1).alias("bucket"), F.lit(True).alias("closing")))
    placed = rows.select("_id", "_text", F.explode(F.array_compact(F.array(own, before))).alias("_at")).select("_at.bucket", "_at.closing", "_id", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple[int, int, str | None] | None = None  # bucket, id and text of a row whose next one is still to come
        for batch in batches:
            for piece in pieces(batch, "_text"):
                line: list[tuple[int, str | None]] = []
                for bucket, closing, i, text in zip(*(piece.column(c).to_pylist() for c in ("bucket", "closing", "_id", "_text"))):
                    if waiting is None or waiting[0] != bucket:
                        if len(line) > 1:
                            yield _compare(line, k, words)
                        line = []
                    elif not line:
                        line = [waiting[1:]]
                    if waiting is not None and waiting[0] == bucket or not closing:
                        line.append((i, text))
                    waiting = None if closing else (bucket, i, text)
                    if closing:
                        if len(line) > 1:
                            yield _compare(line, k, words)
                        line = []
                if len(line) > 1:
                    yield _compare(line, k, words)

    schema = T.StructType([T.StructField("_id", T.LongType())] + [T.StructField(c, t) for c, t in _OUT])
    dealt = placed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "closing", "_id", "_text")
    return dealt.mapInArrow(run, schema).withColumnRenamed("_id", id)
