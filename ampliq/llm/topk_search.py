"""Exact search for the largest inner products by block-at-a-time pruning.

Vectors are put in an order that keeps like ones together and cut into blocks. A block stores its vectors (the forward index) and, for every
component, the largest and the smallest value in it. A query's bound for a block sums what each component can give at most: its own value times the
block's largest where it is positive, times the smallest where it is negative. Blocks are scored in the order of their bounds until the bound falls
below the k-th score found; a bound that equals it is still scored, since a smaller id may win the tie.

Queries come in blocks of bounded bytes that go to all tasks; the index stays where it is. First every query's best blocks by bound, of all, are
scored: their k-th score is where every task begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import top_n_per
from .common import first_by_hash, stored

#: Vectors in a block.
BLOCK = 64
#: Components of the sampled vectors that pivots are chosen from; pivots only decide which vectors lie side by side.
SAMPLE_VALUES = 1 << 19
PIVOTS = 256
#: Bytes of queries that are sent to every task at once.
QUERY_BYTES = 8 << 20
#: Blocks with the highest bounds that are scored first for every query.
SEEDS = 4
#: Bounds (queries x blocks) that a task holds at once.
BOUNDS = 1 << 21
#: Beyond this sums are made in 64-bit integers instead of doubles, which hold every integer up to it.
EXACT = 1 << 53


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), dim)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exactly."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _by_dim(batch: pa.RecordBatch, vectors: str = "vector") -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = np.diff(np.asarray(batch.column(vectors).offsets))
    for dim in np.unique(sizes).tolist():
        yield dim, batch.filter(pa.array(sizes == dim))


def whole(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(id long, vector array<long>, row long): components as floor(``scale`` * x), x as a double, of the rows that take part.

    Rows whose id or vector is null, or whose vector holds a null or a value
    that is not finite, take no part. Every row has a number of its own, so
    rows with one id, or equal in everything, stay apart.
    """
    x = F.col(f"`{vector}`").cast("array<double>")
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{vector}`").isNotNull() & usable)
    return stored(rows.select(F.col(f"`{key}`").cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale)).alias("vector"), F.monotonically_increasing_id().alias("row")), "vectors")


# -- the index


def _pivots(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each number of components some unit vectors in the middle of many, from a sample of bounded size."""
    dim = rows.agg(F.max(F.size("vector"))).first()[0] or 1
    sample = first_by_hash(rows, "row", max(PIVOTS, SAMPLE_VALUES // max(1, dim))).select("vector").collect()
    out = {}
    for size in {len(r[0]) for r in sample} - {0}:
        x = np.array(sorted(r[0] for r in sample if len(r[0]) == size), np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1)
        k = min(PIVOTS, max(1, len(x) // 8))
        centres = x[np.random.default_rng(12).choice(len(x), k, replace=False)]
        for _ in range(6):
            near = (x @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            centres = np.where((sums != 0).any(axis=1, keepdims=True), sums, centres)
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        out[size] = centres
    return out


def _placing(shared):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            for dim, part in _by_dim(batch):
                x = _matrix(part.column("vector"), dim).astype(np.float64)
                near = np.zeros((len(x), 2), np.int64)
                along = np.zeros(len(x))
                if dim in pivots:
                    score = x @ pivots[dim].T
                    near[:, 0], along = score.argmax(axis=1), score.max(axis=1)
                    score[np.arange(len(x)), near[:, 0]] = -np.inf
                    near[:, 1] = score.argmax(axis=1)
                made = [pa.array(np.full(len(x), dim)), pa.array(near[:, 0]), pa.array(near[:, 1]), pa.array(along)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, "dim", "near", "next", "along"])

    return place


_INDEX = "block long, dim long, near long, ids binary, rows binary, vectors binary, wide boolean, low array<long>, high array<long>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as blocks; a block's vectors have the same number of components and the same nearest pivot."""
    names = [c.split()[0] for c in _INDEX.split(", ")]
    for batch in batches:
        dims, near = np.asarray(batch.column("dim")), np.asarray(batch.column("near"))
        ids, rows = np.asarray(batch.column("id")), np.asarray(batch.column("row"))
        new = np.flatnonzero(np.concatenate([[True], (dims[1:] != dims[:-1]) | (near[1:] != near[:-1])])) if len(dims) else np.zeros(0, int)
        out = []
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(dims)]):
            for low in range(a, b, BLOCK):
                high = min(b, low + BLOCK)
                x = _matrix(batch.column("vector").slice(low, high - low), int(dims[low]))
                wide = bool(np.abs(x).max(initial=0) >= 1 << 15)
                out.append((int(rows[low]), int(dims[low]), int(near[low]), ids[low:high].tobytes(), rows[low:high].tobytes(), x.astype(np.int64 if wide else np.int16).tobytes(), wide, x.min(axis=0).tolist(), x.max(axis=0).tolist()))
        if out:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names)


def build(rows: DataFrame) -> DataFrame:
    """The index of rows of ``whole``: one row for each block, every vector in one block."""
    shared = rows.sparkSession.sparkContext.broadcast(_pivots(rows))
    placed = rows.mapInArrow(_placing(shared), "id long, vector array<long>, row long, dim long, near long, next long, along double")
    order = ["dim", "near", "next", "along", "row"]
    return stored(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_cut, _INDEX), "blocks")


# -- the search


class _Best:
    """The best k candidates of every query seen so far, by score and then id."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.n, self.k, self.least = n, k, least.copy()
        self.query = self.score = self.id = self.row = np.zeros(0, np.int64)

    def add(self, parts: list[tuple[np.ndarray, ...]]) -> None:
        query, score, key, row = (np.concatenate([mine, *(p[j] for p in parts)]) for j, mine in enumerate((self.query, self.score, self.id, self.row)))
        order = np.lexsort((row, key, -score, query))
        query = query[order]
        begin = np.searchsorted(query, np.arange(self.n))
        kept = order[np.arange(len(query)) - begin[query] < self.k]
        self.query, self.score, self.id, self.row = (np.concatenate([mine, *(p[j] for p in parts)])[kept] for j, mine in enumerate((self.query, self.score, self.id, self.row)))
        last = np.searchsorted(self.query, np.arange(self.n)) + self.k - 1
        full = np.bincount(self.query, minlength=self.n) == self.k
        self.least[full] = np.maximum(self.least[full], self.score[last[full]])


class _Blocks:
    """Blocks of one number of components, ready to be scored."""

    def __init__(self, part: pa.RecordBatch, dim: int):
        kinds = [np.int64 if w else np.int16 for w in part.column("wide").to_pylist()]
        self.ids = [np.frombuffer(v, np.int64) for v in part.column("ids").to_pylist()]
        self.vectors = [np.frombuffer(v, t).reshape(len(i), dim) for v, t, i in zip(part.column("vectors").to_pylist(), kinds, self.ids)]
        self.rows = [np.frombuffer(v, np.int64) for v in part.column("rows").to_pylist()]

    def score(self, block: int, queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, best: _Best) -> tuple[np.ndarray, ...]:
        """(query, score, id, row) of the block's vectors that may be among the best of ``queries``, each query's own row aside."""
        got = _product(vectors[queries], self.vectors[block])
        at, column = np.nonzero((got >= best.least[queries][:, None]) & (self.rows[block][None, :] != own[queries][:, None]))
        return queries[at], got[at, column], self.ids[block][column], self.rows[block][column]


def bounds(vectors: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each query and block the sum over components of the most that the block's values can give."""
    return _product(np.hstack([np.maximum(vectors, 0), np.minimum(vectors, 0)]), np.hstack([high, low]))


def _pruned(part: pa.RecordBatch, dim: int, vectors: np.ndarray, own: np.ndarray, best: _Best) -> None:
    """Score the blocks of ``part`` for all queries, each in the order of its bounds and in steps that double, until they fall below its k-th score."""
    blocks = _Blocks(part, dim)
    bound = bounds(vectors, _matrix(part.column("low"), dim), _matrix(part.column("high"), dim))
    order = np.argsort(-bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, axis=1)
    low, high = 0, 1
    while low < bound.shape[1]:
        query, place = np.nonzero(bound[:, low:high] >= best.least[:, None])
        if not len(query):
            return
        wanted = order[query, place + low]
        by = np.argsort(wanted, kind="stable")
        wanted, query = wanted[by], query[by]
        cut = np.flatnonzero(np.diff(wanted, prepend=-1))
        best.add([blocks.score(int(wanted[a]), query[a:b], own, vectors, best) for a, b in zip(cut, [*cut[1:], len(wanted)])])
        low, high = high, 3 * high


_FOUND = "query long, row long, score long, id long"


def _found(best: _Best) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(best.query), pa.array(best.row), pa.array(best.score), pa.array(best.id)], ["query", "row", "score", "id"])


def _seeding(shared):
    """Every query's blocks with the highest bounds among those of a task."""

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        for batch in batches:
            for dim, part in _by_dim(batch, "low"):
                if dim not in queries:
                    continue
                number, _, vectors = queries[dim]
                step = max(16, BOUNDS // len(number))
                for low in range(0, part.num_rows, step):
                    some = part.slice(low, step)
                    bound = bounds(vectors, _matrix(some.column("low"), dim), _matrix(some.column("high"), dim))
                    first = np.argpartition(-bound, min(SEEDS, bound.shape[1]) - 1, axis=1)[:, :SEEDS]
                    block = np.asarray(some.column("block"))[first]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(number, first.shape[1])), pa.array(block.ravel()), pa.array(np.take_along_axis(bound, first, axis=1).ravel())], ["query", "block", "bound"])

    return seed


def _scoring(shared, k: int):
    """Blocks with the queries for which they come first."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        for batch in batches:
            for dim, part in _by_dim(batch, "low"):
                number, own, vectors = queries[dim]
                blocks = _Blocks(part, dim)
                best = _Best(len(number), k, np.full(len(number), np.iinfo(np.int64).min))
                for j, wanted in enumerate(part.column("queries").to_pylist()):
                    best.add([blocks.score(j, np.searchsorted(number, np.sort(wanted)), own, vectors, best)])
                best.query = number[best.query]
                yield _found(best)

    return score


def _searching(shared, begin, k: int):
    """The rest of the search: all blocks of a task, from the k-th scores found before."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, least = shared.value, begin.value
        best = {dim: _Best(len(number), k, least[number]) for dim, (number, _, _) in queries.items()}
        for batch in batches:
            for dim, part in _by_dim(batch, "low"):
                if dim in queries:
                    number, own, vectors = queries[dim]
                    step = max(16, BOUNDS // len(number))
                    for low in range(0, part.num_rows, step):
                        _pruned(part.slice(low, step), dim, vectors, own, best[dim])
        for dim, own_best in best.items():
            own_best.query = queries[dim][0][own_best.query]
            yield _found(own_best)

    return search


def search(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of ``queries`` (rows of ``whole``) the ``k`` other rows of the index with the largest inner products.

    Equal scores are ranked by the smaller id. Vectors meet only those with as
    many components; with fewer than ``k`` others all are returned. Query rows
    that share an id each have their own ranks, and find each other.
    """
    spark = queries.sparkSession
    size = queries.agg(F.sum(8 * (F.size("vector") + 2))).first()[0] or 0
    parts = max(1, -(-size // QUERY_BYTES))
    out = None
    for part in range(parts):
        own = queries.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == part) if parts > 1 else queries
        held = own.orderBy("row").toArrow()
        ids, rows = (np.asarray(held.column(c).combine_chunks(), np.int64) for c in ("id", "row"))
        number = np.arange(len(ids))
        by_dim = {}
        for dim, some in _by_dim(pa.RecordBatch.from_arrays([held.column("vector").combine_chunks(), pa.array(number), pa.array(rows)], ["vector", "number", "row"])):
            by_dim[dim] = (np.asarray(some.column("number")), np.asarray(some.column("row")), _matrix(some.column("vector"), dim))
        shared = spark.sparkContext.broadcast(by_dim)

        seeds = index.select("block", "low", "high").mapInArrow(_seeding(shared), "query long, block long, bound long")
        seeds = top_n_per(seeds, ["query"], [F.col("bound").desc(), "block"], SEEDS).groupBy("block").agg(F.collect_list("query").alias("queries"))
        first = index.join(seeds, "block").select("ids", "rows", "vectors", "wide", "low", "queries").mapInArrow(_scoring(shared, k), _FOUND)
        kth = top_n_per(first, ["query"], [F.col("score").desc(), "id", "row"], k).where(F.col("rn") == k).select("query", "score").toArrow()
        # Where fewer than k were scored, all that is found counts.
        least = np.full(len(ids), np.iinfo(np.int64).min)
        least[np.asarray(kth.column("query").combine_chunks(), np.int64)] = np.asarray(kth.column("score").combine_chunks(), np.int64)

        found = index.mapInArrow(_searching(shared, spark.sparkContext.broadcast(least), k), _FOUND)
        best = top_n_per(found, ["query"], [F.col("score").desc(), "id", "row"], k, number="rank")
        names = spark.createDataFrame(pa.table([pa.array(number), pa.array(ids)], ["query", "query_id"]))
        best = best.join(names, "query").select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
        out = best if out is None else out.union(stored(best, "found"))
    return out
