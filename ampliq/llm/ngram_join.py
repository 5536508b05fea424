"""Similarity join on word shingles with adaptive multi-match prefixes.

Two sets with Jaccard similarity of at least p/q share at least ceil(p n / q) of the n elements of either. With all elements in one global order, sets
that share t elements share at least m of them within their first n - t + m elements: a prefix that is longer by m - 1 demands m matches. Each document
chooses its m by the estimated cost of its candidates, the lists its prefix meets and the pairs they lead to; two documents are candidates if they share
as many prefix elements as the smaller of both m.

The order puts rare elements first: elements seen often are raised to levels kept in a table of a fixed size, inside a level the hash decides. Any order
gives right results, so a crowded table costs time only. Equal sets are one class from the start. Classes are first joined to the busiest meeting point of
their prefixes, which gathers large groups of near copies in as many checks as they have members; then every candidate pair that is not yet in one
group is checked exactly, so that no link between groups is missed and no group is expanded into its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BY_RANGE, bit_tables, by_range, components, forget, may_hold, stored
from .words import NOT_SPACE, U64, mix, pieces, shingle_sets, word_hashes

#: Matches that a document may demand at most.
MOST_MATCHES = 4
#: What checking a pair costs against meeting an entry of a list.
CHECK_COST = 8
#: Cells of the table of levels, and the counts from which an element is on each level.
CELL_BITS, LEVELS = 23, (24, 192, 1_536, 12_288, 98_304)
#: Elements counted together before their repeated ones are passed on.
COUNTED = 2_000_000
#: Bits of the tables of repeated prefix elements and of ids whose sets are needed, 16 MB each; ranges in which hashes are counted.
TABLE_BITS, RANGE_BITS = 27, 8


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    return shingle_sets(*word_hashes(column, NOT_SPACE), width)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """A row (id, n, s1, s2) for each document, and rows (token, count) for elements that come more than once among documents counted together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n", "s1", "s2", "token", "count"]
        held: list[np.ndarray] = []
        size, seen = 0, set()

        def repeated() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(held or [np.zeros(0, np.uint64)]), return_counts=True)
            token, count = token[count > 1], count[count > 1]
            none = [pa.nulls(len(token), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64())]
            return pa.RecordBatch.from_arrays([*none, pa.array(token.view(np.int64)), pa.array(count.astype(np.int64))], names)

        for batch in batches:
            for piece in pieces(batch, "text"):
                n, s1, s2 = [], [], []
                for u in _sets(piece.column("text"), width):
                    n.append(len(u))
                    s1.append(u.sum(dtype=np.uint64).view(np.int64) if len(u) else 0)
                    s2.append(np.bitwise_xor.reduce(mix(u + U64(1))).view(np.int64) if len(u) else 0)
                    if (s1[-1], s2[-1]) not in seen:
                        seen.add((s1[-1], s2[-1]))
                        held.append(u)
                        size += len(u)
                none = [pa.nulls(len(n), pa.int64())] * 2
                yield pa.RecordBatch.from_arrays([piece.column("id"), *(pa.array(x, pa.int64()) for x in (n, s1, s2)), *none], names)
                if size > COUNTED:
                    yield repeated()
                    held, size, seen = [], 0, set()
        yield repeated()

    return docs.mapInArrow(run, "id long, n long, s1 long, s2 long, token long, count long")


def levels(counts: DataFrame) -> bytes:
    """The level of every cell, the highest of the elements in it; one byte a cell, whatever the data."""
    level = sum((F.col("count") >= at).cast("int") for at in LEVELS)
    often = counts.groupBy("token").agg(F.sum("count").alias("count")).where(F.col("count") >= LEVELS[0])
    cells = often.select(F.shiftrightunsigned("token", 64 - CELL_BITS).alias("cell"), level.alias("level")).groupBy("cell").agg(F.max("level").alias("level"))
    block = 1 << 15

    def fill(group: pa.Table) -> pa.Table:
        out = np.zeros(block, np.uint8)
        cell = group.column("cell").to_numpy()
        out[cell % block] = group.column("level").to_numpy()
        return pa.table([pa.array([int(cell[0]) // block], pa.int64()), pa.array([out.tobytes()], pa.binary())], ["block", "levels"])

    table = np.zeros(1 << CELL_BITS, np.uint8)
    for r in cells.groupBy(F.shiftright("cell", 15)).applyInArrow(fill, "block long, levels binary").collect():
        table[r.block * block : (r.block + 1) * block] = np.frombuffer(r.levels, np.uint8)
    return table.tobytes()


def prefixes(docs: DataFrame, width: int, p: int, q: int, table: bytes) -> DataFrame:
    """(id, n, tokens): of each document with elements the first ones in the global order, enough for ``MOST_MATCHES``."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for piece in pieces(batch, "text"):
                ids, sizes, out = [], [], []
                for i, u in zip(piece.column("id").to_pylist(), _sets(piece.column("text"), width)):
                    if n := len(u):
                        own = level[(u >> U64(64 - CELL_BITS)).astype(np.int64)]
                        if own.any():
                            u = u[np.argsort(own, kind="stable")]
                        ids.append(i)
                        sizes.append(n)
                        out.append(u[: min(n, n - (p * n + q - 1) // q + MOST_MATCHES)].view(np.int64))
                at = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(out or [np.zeros(0, np.int64)])))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), tokens], ["id", "n", "tokens"])

    return docs.mapInArrow(run, "id long, n long, tokens array<long>")


def repeated(prefixes: DataFrame) -> bytes:
    """A table of the prefix elements that more than one document holds, of a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = np.unique(batch.column("tokens").flatten().to_numpy(zero_copy_only=False).view(np.uint64), return_counts=True)
            if len(h):
                yield by_range(np.repeat(h, np.minimum(n, 2)), RANGE_BITS)

    return bit_tables(prefixes.select("tokens").mapInArrow(run, BY_RANGE), RANGE_BITS, [(TABLE_BITS, 2)])[0]


def postings(prefixes: DataFrame, p: int, q: int) -> DataFrame:
    """(token, id, n, pos, most, m): the entries of the lists of elements that several prefixes hold, down to the prefix each document chose.

    ``most`` bounds the elements a document can share at all: those before this one that no other prefix holds are not shared.
    """
    shared = prefixes.sparkSession.sparkContext.broadcast(repeated(prefixes))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            tokens = batch.column("tokens")
            flat, at = tokens.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(tokens.value_lengths().to_numpy(zero_copy_only=False))])
            keep = np.flatnonzero(may_hold(table, flat.view(np.uint64)))
            row = np.searchsorted(at, keep, "right") - 1
            columns = [batch.column(c).to_numpy()[row] for c in ("id", "n")] + [keep - at[row], flat[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["id", "n", "pos", "token"])

    one = prefixes.mapInArrow(held, "id long, n long, pos long, token long")
    often = one.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    met = one.join(often, "token")
    own, before = W.partitionBy("id"), W.partitionBy("id").orderBy("pos")
    met = met.withColumn("least", F.expr(f"({p} * n + {q - 1}) div {q}")).withColumn("most", F.expr("n - pos - 1") + F.row_number().over(before))
    cost = [
        F.sum(F.when(F.col("pos") <= F.col("n") - F.col("least") + (m - 1), F.col("df") - 1).otherwise(0)).over(own) * (1 + CHECK_COST / m) + F.when(F.col("least") < m, F.lit(float("inf"))).otherwise(0.0)
        for m in range(1, MOST_MATCHES + 1)
    ]
    chosen = F.array_position(F.array(*cost), F.array_min(F.array(*cost)))
    met = met.withColumn("m", chosen).where("pos <= n - least + m - 1 and most >= least")
    return met.select("token", "id", "n", "pos", "most", "m")


def _similar(p: int, q: int) -> Column:
    """What sizes and bounds of entries x and y allow."""
    return F.expr(f"{q} * least(x.n, y.n) >= {p} * greatest(x.n, y.n) and {p + q} * least(x.most, y.most) >= {p} * (x.n + y.n)")


def _within(p: int, q: int) -> Column:
    """Whether the element stands in the prefixes that x and y need for each other, which follow from what both must share."""
    shared = f"(({p} * (x.n + y.n) + {p + q - 1}) div {p + q})"
    return F.expr(f"x.pos < x.n - {shared} + least(x.m, y.m) and y.pos < y.n - {shared} + least(x.m, y.m)")


def meeting_points(entries: DataFrame, p: int, q: int) -> DataFrame:
    """(a, b): each document with the one it meets most often among the first documents of its lists, by size class."""
    size = F.floor(F.log("n") / float(np.log(q / p)) + 1e-9).alias("size")
    keyed = entries.select("*", size)
    # The first document of a list is combined before the shuffle, however long the list.
    first = keyed.groupBy("token", "size").agg(F.min(F.struct("id", "n", "most")).alias("x"), F.count("*").alias("k")).where("k > 1").select("token", "size", "x")
    pairs = keyed.alias("y").join(first, ["token", "size"]).where(F.col("x.id") < F.col("y.id")).where(_similar(p, q))
    # Real neighbours share much of their prefixes; others are left to the exact search.
    met = pairs.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.count("*").alias("k"), F.min(F.expr(f"y.n - ({p} * y.n + {q - 1}) div {q} + 1")).alias("prefix")).where("4 * k >= prefix")
    return met.groupBy("b").agg(F.max_by("a", F.struct("k", -F.col("a"))).alias("a")).select("a", "b")


def candidates(entries: DataFrame, groups: DataFrame, p: int, q: int) -> DataFrame:
    """(a, b): pairs of documents not yet in one group that share enough prefix elements.

    Lists are joined by group and size first, so a group never meets itself.
    """
    e = entries.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    e = stored(e.join(e.groupBy("token").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a < _b").select("token"), "token", "left_semi"), "entries")
    key = ["token", "component", "n"]
    g = e.groupBy(*key).agg(F.min("pos").alias("pos"), F.max("most").alias("most"), F.max("m").alias("m"))
    meets = (F.col("x.token") == F.col("y.token")) & (F.col("x.component") < F.col("y.component")) & _similar(p, q) & _within(p, q)
    both = g.alias("x").join(g.alias("y"), meets).select("x.token", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "xy" for c in ("component", "n")])
    entry = F.struct("id", "n", "pos", "most", "m")
    for s in "xy":
        side = e.select("token", F.col("component").alias(f"{s}_component"), F.col("n").alias(f"{s}_n"), entry.alias(s))
        both = both.join(side, ["token", f"{s}_component", f"{s}_n"])
    a, b = F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")
    met = both.where(_similar(p, q) & _within(p, q)).groupBy(a, b).agg(F.count("*").alias("k"), F.min(F.least("x.m", "y.m")).alias("m"))
    return met.where("k >= m").select("a", "b")


def full_sets(docs: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(id, tokens): all elements of the documents in pairs (a, b), and perhaps of a few others.

    Which documents those are is told by a table of bits of a fixed size, so that no text is shuffled.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield by_range(np.unique(mix(np.concatenate([batch.column(c).to_numpy() for c in ("a", "b")]).view(np.uint64))), RANGE_BITS)

    shared = docs.sparkSession.sparkContext.broadcast(bit_tables(pairs.select("a", "b").mapInArrow(told, BY_RANGE), RANGE_BITS, [(TABLE_BITS, 1)])[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(table, mix(batch.column("id").to_numpy().view(np.uint64)))))
            for piece in pieces(batch, "text"):
                sets = list(_sets(piece.column("text"), width))
                at = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets or [np.zeros(0, np.uint64)]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([piece.column("id"), tokens], ["id", "tokens"])

    return docs.mapInArrow(run, "id long, tokens array<long>")


def _joined(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with the columns of both sides' sets, as _a_ and _b_ ones."""
    out = pairs.select("a", "b")
    for s in "ab":
        out = out.join(sets.select(F.col("id").alias(s), *[F.col(c).alias(f"_{s}_{c}") for c in sets.columns if c != "id"]), s)
    return out


def promising(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs (a, b) that a quarter of their elements doesn't rule out.

    Of the elements whose hash lies in one quarter the shared ones are counted;
    of the others at most as many are shared as the side with fewer has. A pair
    that would not be similar even then is none.
    """
    some = F.filter("tokens", lambda t: F.shiftrightunsigned(t, 62) == 0)
    both = _joined(pairs, sets.select("id", F.size("tokens").cast("long").alias("n"), some.alias("some")))
    most = F.size(F.array_intersect("_a_some", "_b_some")) + F.least(F.col("_a_n") - F.size("_a_some"), F.col("_b_n") - F.size("_b_some"))
    return both.withColumn("_most", most).where(f"{q} * _most >= {p} * (_a_n + _b_n - _most)").select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar, with the number of shared elements ``o``."""
    o = F.size(F.array_intersect("_a_tokens", "_b_tokens")).cast("long")
    sized = _joined(pairs, sets).select("a", "b", o.alias("o"), (F.size("_a_tokens") + F.size("_b_tokens")).cast("long").alias("n"))
    return sized.where(f"{q} * o >= {p} * (n - o)").select("a", "b", "o")


def linked_pairs(docs: DataFrame, pairs: DataFrame, width: int, p: int, q: int) -> DataFrame:
    """The similar ones of stored pairs (a, b), stored; the pairs are deleted then."""
    sets = stored(full_sets(docs, pairs, width), "sets")
    near = stored(promising(pairs, sets, p, q), "promising")
    links = stored(verified(near, sets, p, q), "links")
    forget(pairs, sets, near)
    return links


def linked(rows: DataFrame, width: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """(id, n, group) for ``rows`` (id long, text string): the size of each shingle set and the smallest id that the row is linked with over any
    number of links. Ids must be distinct and not null; rows without shingles are groups of their own.
    """
    first = stored(signatures(rows, width), "signatures")
    own = first.where("n is not null").select("id", "n", "s1", "s2")
    # Equal sets make a class, named by its smallest id.
    classes = stored(own.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("class")), "classes")
    table = levels(first.where("token is not null").select("token", "count"))
    heads = classes.select(F.col("class").alias("id"))
    first_ones = stored(prefixes(rows, width, p, q, table).join(heads, "id", "left_semi"), "prefixes")
    entries = stored(postings(first_ones, p, q), "entries")
    forget(first_ones)
    star = linked_pairs(rows, stored(meeting_points(entries, p, q), "pairs"), width, p, q)
    near = components(star)
    rest = linked_pairs(rows, stored(candidates(entries, near, p, q), "pairs"), width, p, q)
    forget(entries)
    found = components(star.select("a", "b").union(rest.select("a", "b")))
    named = classes.join(found.withColumnRenamed("id", "class"), "class", "left").select("n", "s1", "s2", F.coalesce("component", "class").alias("group"))
    empty = own.where("n = 0").select("id", "n", F.col("id").alias("group"))
    return own.where("n > 0").join(stored(named, "named"), ["n", "s1", "s2"]).select("id", "n", "group").union(empty)


def numbered(docs: DataFrame, key: str, text: str, *columns: Column) -> DataFrame:
    """(id, text, name, columns): rows with an id of their own beside their ``name``, the caller's key as a long.

    Where keys are distinct numbers, which a look at that column alone tells,
    they are the ids; else every row gets a number, and the table is written
    once so that the numbers stay.
    """
    rows = docs.select(F.col(f"`{key}`").try_cast("long").alias("name"), F.col(f"`{text}`").cast("string").alias("text"), *columns)
    odd = rows.groupBy("name").agg(F.count(F.lit(1)).alias("k")).where("name is null or k > 1")
    if odd.isEmpty():
        return rows.withColumn("id", F.col("name"))
    return stored(rows.withColumn("id", F.monotonically_increasing_id()), "numbered")


def groups(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """(id, n_shingles, component_id) for every row: the size of its shingle set and the smallest id it is linked with over any number of links.

    Two documents are linked if the Jaccard similarity of their sets is at least p/q. Words are lower-cased (A-Z) runs of anything but ASCII white
    space; a document with fewer words than ``width`` has them all as its one shingle; null and empty texts have no shingles, link with nothing and are
    their own component. Every row is a document of its own, also where ids repeat or are null (or, as longs, no numbers): a component is named by its
    smallest id, and has none only if no row of it has. Other columns are ignored.
    """
    rows = numbered(docs, id, text)
    found = stored(linked(rows.select("id", "text"), width, p, q).join(rows.select("id", "name"), "id"), "linked")
    # Groups of one need no other row's name.
    least = found.groupBy("group").agg(F.min("name").alias("component_id"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    named = found.join(stored(least, "components"), "group", "left")
    return named.select(F.col("name").alias(id), F.col("n").alias("n_shingles"), F.coalesce("component_id", "name").alias("component_id"))
