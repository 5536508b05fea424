"""Running numbers and sums in a total order, without one task per group.

A plain window puts each group, or with no key the whole table, into one task.
Here the rows are range-partitioned on the full order, numbered inside each
partition, and shifted by what the partitions before it hold. Only the first
group of a partition can have begun earlier, so the shifts are at most one row
per partition: that bound is what makes broadcasting them safe.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def running(
    df: DataFrame,
    order: Sequence[str | Column],
    keys: Sequence[str] = (),
    number: str | None = "rn",
    sums: dict[str, str] | None = None,
) -> DataFrame:
    """Add ``number`` (1, 2, ... per key) and running ``sums`` (name -> column).

    ``order`` must be total within a key; NULL summands count as 0.
    """
    sums = sums or {}
    keys = list(keys)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if number and not keys and not sums:
        return _numbered(df, order, number, parts)
    placed = cut(
        df.repartitionByRange(parts, *[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id())
    )
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed
    if number:
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)))
    for name, column in sums.items():
        out = out.withColumn(f"_s_{name}", F.sum(F.coalesce(F.col(column), F.lit(0))).over(inside))

    totals = placed.groupBy("_part", *keys).agg(
        F.count(F.lit(1)).alias("_c"),
        *[F.sum(F.coalesce(F.col(column), F.lit(0))).alias(f"_t_{name}") for name, column in sums.items()],
    )
    # Only a partition's first and last group can straddle a boundary.
    if keys:
        key = F.struct(*keys)
        edge = totals.groupBy("_part").agg(
            F.min_by(F.struct("*"), key).alias("lo"), F.max_by(F.struct("*"), key).alias("hi")
        )
        edge = edge.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("e")).select("e.*")
    else:
        edge = totals
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = edge.select(
        "_part",
        *keys,
        F.sum("_c").over(before).alias("_c0"),
        *[F.sum(f"_t_{name}").over(before).alias(f"_t0_{name}") for name in sums],
    ).filter("_c0 is not null")

    on = (out["_part"] == shift["_part"]) if not keys else None
    if keys:
        cond = out["_part"] == shift["_part"]
        for k in keys:
            cond = cond & out[k].eqNullSafe(shift[k])
    else:
        cond = on
    joined = out.join(F.broadcast(shift), cond, "left")
    cols = [out[c] for c in df.columns]
    if number:
        cols.append((out["_n"] + F.coalesce(shift["_c0"], F.lit(0))).cast("bigint").alias(number))
    for name in sums:
        cols.append((out[f"_s_{name}"] + F.coalesce(shift[f"_t0_{name}"], F.lit(0))).alias(name))
    return joined.select(*cols)


def _numbered(df: DataFrame, order: list[Column], number: str, parts: int) -> DataFrame:
    """Running numbers over the whole table with one shuffle: an id tells the partition and the place in it."""
    placed = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    totals = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_c"))
    # One row per partition.
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c0"))
    joined = placed.join(F.broadcast(shift), part == F.col("_part"))
    return joined.select(*[placed[c] for c in df.columns], (place + 1 + F.col("_c0")).cast("bigint").alias(number))


#: Parts in which a key's rows are limited before they meet.
TOP_PARTS = 64


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per key, by partial aggregation (a hot key costs one row per task).

    ``order`` is ascending; negate numbers for descending.
    """
    rest = [c for c in df.columns if c not in keys]
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    if not rest:
        return df.dropDuplicates(list(keys))
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def top_n_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, number: str = "rn") -> DataFrame:
    """First ``n`` rows per key.

    Up to 1000 rows Spark limits each task's share before the shuffle (``spark.sql.optimizer.windowGroupLimitThreshold``); for more, a key's rows are
    first limited in parts, so that a hot key sends no task more than its parts' shares.
    """
    if n > 1000:
        part = F.pmod(F.xxhash64(*order), F.lit(TOP_PARTS))
        parts = Window.partitionBy(*keys, "_part").orderBy(*order)
        df = df.withColumn("_part", part).withColumn("_rn", F.row_number().over(parts)).filter(F.col("_rn") <= n).drop("_part", "_rn")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(number, F.row_number().over(w)).filter(F.col(number) <= n)
