"""Ranked lexical search over an index whose documents are grouped by their length normaliser.

A term's score in a document depends on its weight, on how often it stands there (tf) and on the document's normaliser m alone. The index therefore
groups documents into strata of equal m; inside a stratum a term's postings are grouped by tf, so an impact is computed once for each tf. A stratum
whose postings are many is dealt into parts by the documents' hash. The largest tf of every term bounds what a part can give to an item: items visit
the parts in the order of their bounds until these fall below the k-th score found.

Items come in blocks of bounded bytes that go to all tasks; documents are read once a block, and lists are kept for the block's terms. First every
item's best parts by bound, of all, are scored: their k-th score is where every task begins.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import top_n_per
from .common import stored
from .words import ALNUM, pieces, word_hashes

#: Bytes of items' texts that are searched for at once.
ITEM_BYTES = 4 << 20
#: Postings meant for a part of a stratum.
PART_POSTINGS = 300_000
#: Parts with the highest bounds that are scored first for every item.
SEEDS = 3
#: Bounds (items x parts) that a task holds at once.
BOUNDS = 1 << 21
_SCALE = 1_000_000_000


class Items:
    """A block of items: their distinct terms as numbers into the block's vocabulary, and how often each stands in the item."""

    def __init__(self, texts: list[str]):
        hashes, first = word_hashes(pa.array(texts, pa.string()), ALNUM)
        self.vocabulary = np.unique(hashes)
        number = np.searchsorted(self.vocabulary, hashes)
        counted = [sorted(Counter(number[a:b].tolist()).items()) for a, b in zip(first[:-1], first[1:])]
        self.first = np.concatenate([[0], np.cumsum([len(c) for c in counted])]).astype(np.int64)
        self.terms = np.array([t for c in counted for t, _ in c], np.int64)
        self.times = np.array([n for c in counted for _, n in c], np.int64)


# -- the index


def _counting(shared):
    """(id, n, terms, tfs): for each document its number of terms and how often it holds which terms of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            for piece in pieces(batch, "text"):
                hashes, first = word_hashes(piece.column("text"), ALNUM)
                n = np.diff(first)
                term = np.searchsorted(vocabulary, hashes)
                term[term == len(vocabulary)] = 0
                known = vocabulary[term] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
                key = (np.repeat(np.arange(len(n)), n) * max(1, len(vocabulary)) + term)[known]
                key, tf = np.unique(key, return_counts=True)
                doc, term = np.divmod(key, max(1, len(vocabulary)))
                at = pa.array(np.searchsorted(doc, np.arange(len(n) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(n, pa.int64()), *lists], ["id", "n", "terms", "tfs"])

    return count


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a task's documents hold each term."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        got = np.bincount(np.asarray(batch.column("terms").flatten()), minlength=len(total))
        got[: len(total)] += total
        total = got
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "df"])


_PART = "m long, part long, docs binary, terms binary, most binary, starts binary, tfs binary, lengths binary, postings binary"


def _stratum(group: pa.Table) -> pa.Table:
    """A part of a stratum: for each term its groups of equal tf, highest first, and the documents of each group.

    ``starts`` cuts the groups by term, ``lengths`` tells how many postings each has.
    """
    group = group.sort_by("id").combine_chunks()
    lists = group.column("terms").combine_chunks()
    doc = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    term, tf = (np.asarray(group.column(c).combine_chunks().flatten(), np.int64) for c in ("terms", "tfs"))
    by = np.lexsort((doc, -tf, term))
    doc, term, tf = doc[by], term[by], tf[by]
    new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])])) if len(term) else np.zeros(0, np.int64)
    starts = np.flatnonzero(np.diff(term[new], prepend=-1)) if len(new) else new
    values = [
        np.asarray(group.column("id").combine_chunks(), np.int64),
        term[new][starts],
        tf[new][starts],
        np.append(starts, len(new)),
        tf[new],
        np.diff(np.append(new, len(term))),
        doc.astype(np.int32),
    ]
    return pa.table([group.column("m").slice(0, 1), group.column("part").slice(0, 1), *(pa.array([v.tobytes()], pa.binary()) for v in values)], [c.split()[0] for c in _PART.split(", ")])


class Index:
    """An index for the terms of a block of items: the parts of all strata, and the weights of the terms."""

    def __init__(self, docs: DataFrame, items: Items, key: str, text: str):
        sc = docs.sparkSession.sparkContext
        rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
        counted = stored(rows.mapInArrow(_counting(sc.broadcast(items.vocabulary)), "id long, n long, terms array<int>, tfs array<int>"), "counted").where("n > 0")
        n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
        #: One value for each term of the block.
        self.weights = np.zeros(len(items.vocabulary), np.int64)
        for term, df in counted.select("terms").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
            self.weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        m = F.expr(f"75L + (25L * n * {n_docs}L) div {max(1, n_terms or 0)}L")
        named = counted.where("id is not null and size(terms) > 0").withColumn("m", m)
        # Stored, so that Spark knows its size and joins it without dealing documents by m; a stratum's parts are then dealt apart.
        sizes = stored(named.groupBy("m").agg(F.ceil(F.sum(F.size("terms")) / PART_POSTINGS).alias("parts")), "strata-sizes")
        dealt = named.join(sizes, "m").withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
        self.parts = stored(dealt.select("m", "part", "id", "terms", "tfs").repartition("m", "part").groupBy("m", "part").applyInArrow(_stratum, _PART), "strata")


# -- the search


def impacts(tf: np.ndarray, m: int) -> np.ndarray:
    """What one occurrence's weight is multiplied by, for an array of tf and a stratum."""
    return (_SCALE * tf) // (1000 * tf + 12 * m)


class _Part:
    """A part of a stratum with its postings' scores, each made once for a term and tf."""

    def __init__(self, row: dict, weights: np.ndarray):
        self.docs = np.frombuffer(row["docs"], np.int64)
        terms, starts, tfs, lengths = (np.frombuffer(row[c], np.int64) for c in ("terms", "starts", "tfs", "lengths"))
        once, which = np.unique(tfs, return_inverse=True)
        value = impacts(once, row["m"])[which] * np.repeat(weights[terms], np.diff(starts))
        self.terms, self.value = terms, np.repeat(value, lengths)
        self.at = np.concatenate([[0], np.cumsum(lengths)])[starts]
        self.postings = np.frombuffer(row["postings"], np.int32)

    def score(self, terms: np.ndarray, times: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the documents that reach ``least`` for an item."""
        place = np.searchsorted(self.terms, terms)
        place[place == len(self.terms)] = 0
        held = self.terms[place] == terms
        place, times = place[held], times[held]
        size = self.at[place + 1] - self.at[place]
        take = np.arange(size.sum()) + np.repeat(self.at[place] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        # Doubles hold the sums exactly: a bound of less than 2^53 was computed for the part before.
        score = np.bincount(self.postings[take], self.value[take] * np.repeat(times, size), len(self.docs)).astype(np.int64)
        good = np.flatnonzero(score >= least)
        return score[good], self.docs[good]


def _bounds(batch: pa.RecordBatch, items: Items, weights: np.ndarray) -> np.ndarray:
    """(items, parts): the most that a document of a part can score for an item."""
    out = np.zeros((len(items.first) - 1, batch.num_rows), np.int64)
    worth = np.zeros(len(weights), np.int64)
    full = np.flatnonzero(np.diff(items.first))
    for j, (m, terms, most) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("m", "terms", "most")))):
        terms = np.frombuffer(terms, np.int64)
        worth[terms] = weights[terms] * impacts(np.frombuffer(most, np.int64), m)
        if len(full):
            out[full, j] = np.add.reduceat(items.times * worth[items.terms], items.first[full])
        worth[terms] = 0
    if out.size and int(out.max()) >= 1 << 53:
        raise ValueError("an item has so many terms that its scores pass 2^53")
    return out


def _slices(batch: pa.RecordBatch, n: int) -> Iterator[pa.RecordBatch]:
    step = max(16, BOUNDS // max(1, n))
    for low in range(0, batch.num_rows, step):
        yield batch.slice(low, step)


def _seeding(shared):
    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        n = len(items.first) - 1
        for batch in batches:
            for some in _slices(batch, n):
                bound = _bounds(some, items, weights)
                if bound.size:
                    first = np.argpartition(-bound, min(SEEDS, bound.shape[1]) - 1, axis=1)[:, :SEEDS]
                    m, part = (np.asarray(some.column(c))[first].ravel() for c in ("m", "part"))
                    columns = [np.repeat(np.arange(n), first.shape[1]), m, part, np.take_along_axis(bound, first, axis=1).ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["item", "m", "part", "bound"])

    return seed


_FOUND = "item long, score long, doc_id long"


class _Best:
    """An item's best k documents so far."""

    def __init__(self, k: int, least: int):
        self.k, self.least = k, least
        self.score = self.id = np.zeros(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        if len(score):
            score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
            order = np.lexsort((ids, -score))[: self.k]
            self.score, self.id = score[order], ids[order]
            if len(order) == self.k:
                self.least = max(self.least, int(self.score[-1]))


def _given(best: dict[int, _Best]) -> pa.RecordBatch:
    item = np.repeat(np.fromiter(best, np.int64, len(best)), [len(b.score) for b in best.values()])
    columns = [np.concatenate([np.zeros(0, np.int64), *(getattr(b, c) for b in best.values())]) for c in ("score", "id")]
    return pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), *(pa.array(c) for c in columns)], ["item", "score", "doc_id"])


def _scoring(shared, k: int):
    """Parts with the items for which they come first."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        best: dict[int, _Best] = {}
        for batch in batches:
            for row in batch.to_pylist():
                part = _Part(row, weights)
                for item in row["items"]:
                    own = slice(items.first[item], items.first[item + 1])
                    held = best.setdefault(item, _Best(k, 1))
                    held.add(*part.score(items.terms[own], items.times[own], held.least))
        yield _given(best)

    return score


def _searching(shared, begin, k: int):
    """All parts of a task in the order of every item's bounds, until these fall below its k-th score."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (items, weights), least = shared.value, begin.value
        best = {i: _Best(k, int(v)) for i, v in enumerate(least)}
        for batch in batches:
            for some in _slices(batch, len(best)):
                bound = _bounds(some, items, weights)
                order = np.argsort(-bound, axis=1, kind="stable")
                # Step by step every item has its next part, so that a part is unpacked once for all items that have it in the same step.
                parts: dict[int, _Part] = {}
                for step in range(some.num_rows):
                    live = [i for i in best if bound[i, order[i, step]] >= best[i].least]
                    if not live:
                        break
                    for i in sorted(live, key=lambda i: order[i, step]):
                        j = int(order[i, step])
                        if j not in parts:
                            if len(parts) >= 64:
                                parts.pop(next(iter(parts)))
                            parts[j] = _Part({c: some.column(c)[j].as_py() for c in some.schema.names}, weights)
                        own = slice(items.first[i], items.first[i + 1])
                        best[i].add(*parts[j].score(items.terms[own], items.times[own], best[i].least))
        yield _given(best)

    return search


def search(docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` documents with the highest scores above 0, equal scores by ascending id.

    Terms are runs of ASCII letters and digits and of all characters beyond
    ASCII, with A-Z lower-cased. Null and empty texts have no terms: such
    documents count nowhere and such items find nothing. Documents without an
    id count in the statistics and cannot be named. Every row is a document,
    and every row an item, of its own, also where ids repeat.
    """
    spark = docs.sparkSession
    rows = items.select(F.col(f"`{item}`").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // ITEM_BYTES))
    out = None
    for block in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else rows
        held = own.orderBy("item_id", "text").collect()
        made = Items([r.text or "" for r in held])
        index = Index(docs, made, key, text)
        shared = spark.sparkContext.broadcast((made, index.weights))

        seeds = index.parts.select("m", "part", "terms", "most").mapInArrow(_seeding(shared), "item long, m long, part long, bound long")
        seeds = top_n_per(seeds, ["item"], [F.col("bound").desc(), "m", "part"], SEEDS).groupBy("m", "part").agg(F.collect_list("item").alias("items"))
        first = index.parts.join(seeds, ["m", "part"]).mapInArrow(_scoring(shared, k), _FOUND)
        least = np.ones(len(held), np.int64)
        for r in top_n_per(first, ["item"], [F.col("score").desc(), "doc_id"], k).where(F.col("rn") == k).select("item", "score").collect():
            least[r.item] = r.score

        found = index.parts.mapInArrow(_searching(shared, spark.sparkContext.broadcast(least), k), _FOUND)
        best = top_n_per(found, ["item"], [F.col("score").desc(), "doc_id"], k, number="rank")
        names = spark.createDataFrame([(n, r.item_id) for n, r in enumerate(held)], "item long, item_id " + rows.schema["item_id"].dataType.simpleString())
        best = best.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = best if out is None else out.union(stored(best, "found"))
    return out
