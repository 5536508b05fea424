"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

Every shard owns ``virtual_nodes`` points of a ring of 2^32 places; a key belongs to the next point clockwise. No shard may hold more than its
capacity: keys that find their shard full go on clockwise to the next shard with room. What a shard takes first is decided by the distance in
shards a key has already gone, then by the place on the ring, so the outcome depends on the set of keys and not on their order of arrival.

Only counts by arc meet on the driver: at most shards x virtual_nodes rows, whatever the data. Keys are numbered along the ring inside buckets of
the ring that grow in number with the table, so no task numbers an arc of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

RING_BITS = 32
#: Keys for which a bucket of the ring is meant; buckets are numbered by one window task each.
BUCKET_ROWS = 5_000
_MASK = (1 << 64) - 1


def _spread(x: int) -> int:
    """A fixed place on the ring for a number."""
    for k in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = ((x ^ (x >> 30)) * k) & _MASK
    return (x ^ (x >> 31)) >> (64 - RING_BITS)


def ring(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node in ring order; adding a shard adds its nodes and moves no others.

    The ring's last place is a node too, of the shard whose node comes first, so that no arc goes over the end.
    """
    at: dict[int, int] = {}
    for shard in range(shards):
        for node in range(virtual_nodes):
            at.setdefault(_spread((shard + 1) * 0x9E3779B97F4A7C15 + node * 0xD1B54A32D192ED03 & _MASK), shard)
    nodes = sorted(at.items())
    return nodes if nodes[-1][0] == (1 << RING_BITS) - 1 else [*nodes, ((1 << RING_BITS) - 1, nodes[0][1])]


def capacities(n: int, shards: int, epsilon: float) -> list[int]:
    """Most rows of each shard: (1 + epsilon) times the mean, rounded up; at 0 the first n mod shards shards take one more than the rest."""
    if epsilon > 0:
        return [math.ceil((1 + epsilon) * n / shards)] * shards
    return [n // shards + (k < n % shards) for k in range(shards)]


def place(counts: list[int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, from, to, shard, base): rows from..to-1 of an arc go to a shard, where they take the slots from ``base`` on.

    ``counts`` holds the keys of every arc. A key tries the distinct shards
    clockwise from its arc; of the keys trying a shard those that have gone the
    shortest way come first, then those first on the ring.
    """
    room, used, shards = list(room), [0] * len(room), len(room)
    waiting = {arc: 0 for arc, n in enumerate(counts) if n}
    seen = {arc: {nodes[arc][1]} for arc in waiting}
    at = {arc: arc for arc in waiting}
    out = []
    while waiting:
        for arc in sorted(waiting):
            shard = nodes[at[arc]][1]
            if take := min(room[shard], counts[arc] - waiting[arc]):
                out.append((arc, waiting[arc], waiting[arc] + take, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
                waiting[arc] += take
        waiting = {arc: done for arc, done in waiting.items() if done < counts[arc]}
        for arc in waiting:
            if len(seen[arc]) == shards:
                raise ValueError("the shards together have less room than there are keys")
            while nodes[at[arc]][1] in seen[arc]:
                at[arc] = (at[arc] + 1) % len(nodes)
            seen[arc].add(nodes[at[arc]][1])
    return out


def cells(nodes: list[tuple[int, int]], bits: int = 12) -> list[tuple[int, int, int, int]]:
    """(cell, from, to, arc): the ring cut into 2^bits cells and at the nodes, so that a place finds its arc by an equi-join on its cell."""
    out, low, size = [], 0, 1 << (RING_BITS - bits)
    for arc, (high, _) in enumerate(nodes):
        for cell in range(low // size, high // size + 1):
            out.append((cell, max(low, cell * size), min(high, (cell + 1) * size - 1), arc))
        low = high + 1
    return out


def bounded_ring(keys: DataFrame, key: str, shards: int = 16, virtual_nodes: int = 64, epsilon: float = 0.0) -> DataFrame:
    """``keys`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    ``epsilon`` is the slack of the capacity: at 0 the counts of two shards differ by at most one; more slack moves fewer keys when shards come
    or go. Rows with equal keys, null among them, take neighbouring places in the order of their other columns' hash; rows that are equal in
    everything may swap slots, which nobody can tell. An empty table gives no rows. Columns of ``keys`` named shard or slot are replaced;
    columns beginning with ``_ring`` are taken by this operator.
    """
    spark = keys.sparkSession
    keys = keys.drop("shard", "slot")
    nodes = ring(shards, virtual_nodes)
    place_of = F.pmod(F.xxhash64(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("\0null"))), F.lit(1 << RING_BITS))
    # Equal rows on equal places keep one order on every run.
    ties = [F.col(f"`{key}`").asc_nulls_first(), F.xxhash64(*[F.col(f"`{c}`") for c, t in keys.dtypes if not t.startswith(("map", "variant"))])]

    by_cell = spark.createDataFrame(cells(nodes), "_ring_cell int, _ring_low long, _ring_high long, _ring_arc int")

    def located(rows: DataFrame) -> DataFrame:
        at = (F.col("_ring_cell") == F.col("_ring_own")) & F.col("_ring_place").between(F.col("_ring_low"), F.col("_ring_high"))
        rows = rows.withColumn("_ring_place", place_of).withColumn("_ring_own", F.shiftright("_ring_place", RING_BITS - 12).cast("int"))
        # A few thousand rows whatever the data.
        return rows.join(F.broadcast(by_cell), at).withColumn("_ring_bucket", F.shiftright("_ring_place", shift)).drop("_ring_cell", "_ring_own", "_ring_low", "_ring_high")

    # Counting needs the key alone: these passes read one column.
    n = keys.count()
    shift = RING_BITS - min(RING_BITS, max(0, math.ceil(math.log2(max(1, n / BUCKET_ROWS)))))
    counted = stored(located(keys.select(f"`{key}`")).groupBy("_ring_arc", "_ring_bucket").count(), "ring-counts")
    by_arc = {r[0]: r[1] for r in counted.groupBy("_ring_arc").agg(F.sum("count")).collect()}
    counts = [by_arc.get(arc, 0) for arc in range(len(nodes))]
    placed = place(counts, nodes, capacities(n, shards, epsilon)) or [(0, 0, 0, 0, 0)]

    along = W.partitionBy("_ring_arc").orderBy("_ring_bucket").rowsBetween(W.unboundedPreceding, -1)
    before = counted.select("_ring_arc", "_ring_bucket", F.coalesce(F.sum("count").over(along), F.lit(0)).alias("_ring_before"))
    rows = located(keys).withColumn("_ring_row", F.row_number().over(W.partitionBy("_ring_arc", "_ring_bucket").orderBy("_ring_place", *ties)) - 1)
    rows = rows.join(before, ["_ring_arc", "_ring_bucket"]).withColumn("_ring_rank", F.col("_ring_row") + F.col("_ring_before"))
    # At most a few ranges for each virtual node.
    ranges = spark.createDataFrame(placed, "_ring_own int, _ring_from long, _ring_to long, shard int, _ring_base long")
    inside = (F.col("_ring_rank") >= F.col("_ring_from")) & (F.col("_ring_rank") < F.col("_ring_to"))
    out = rows.join(F.broadcast(ranges), (F.col("_ring_arc") == F.col("_ring_own")) & inside)
    return out.withColumn("slot", F.col("_ring_base") + F.col("_ring_rank") - F.col("_ring_from")).drop(*[c for c in out.columns if c.startswith("_ring")])
