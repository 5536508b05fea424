"""Reading, storing and labelling: what several operators of this package share."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex[:12]}"


def first_by_hash(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows of ``df`` whose keys' hashes are least.

    The hash alone first thins each task's rows to about twice what is wanted
    over all, so that few rows meet however many tasks there are.
    """
    total = df.select(key).count()
    h = F.xxhash64(key)
    share = min(1.0, (2 * n + 1000) / max(1, total))
    thin = df.where(h < F.lit(int(-(1 << 63) + share * ((1 << 64) - 1025)))) if share < 1 else df
    return thin.orderBy(h, key).limit(n)


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once what was made of them is stored and nothing else reads them."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        root = sc.getCheckpointDir()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            if root and path.toUri().getPath().startswith(sc._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath()):
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that can be reached over the edges (a, b), for every id with an edge.

    Each round hooks every node's parent under the smallest parent seen next to
    it and then follows parents (pointer jumping), so the number of rounds grows
    with the logarithm of a path's length. A hub's minimum is combined before
    the shuffle; the result of each round is stored. Parents are followed by way
    of the distinct ones that moved: those are stored too, so Spark knows their
    size and does not bring the members of a large group to its root.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    parent = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "parents")
    while True:
        near = both.join(parent.select(F.col("id").alias("b"), F.col("component").alias("_c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("_c").alias("_c"))
        # A node hands the smallest component next to it to its present root and to itself.
        seen = parent.join(near, "id")
        hooks = seen.select("id", F.least("component", "_c").alias("_c")).union(seen.select(F.col("component"), "_c"))
        low = hooks.groupBy("id").agg(F.min("_c").alias("_c"))
        hooked = parent.join(low, "id", "left").select("id", F.least("component", F.coalesce("_c", "component")).alias("component"))
        hooked = stored(hooked, "hooked")
        up = hooked.select(F.col("id").alias("component"), F.col("component").alias("_up")).where("component <> _up")
        moved = stored(up.join(hooked.select("component").distinct(), "component"), "moved")
        new = stored(hooked.join(moved, "component", "left").select("id", F.least("component", F.coalesce("_up", "component")).alias("component")), "parents")
        changed = new.join(parent.withColumnRenamed("component", "_old"), "id").where("component <> _old").limit(1).count()
        forget(parent, hooked, moved)
        parent = new
        if not changed:
            forget(both)
            return parent


# -- tables of bits: which hashes may occur, of a size that is given; cells may be shared, which lets more through and never less


def by_range(h: np.ndarray, top: int) -> pa.RecordBatch:
    """Sorted 64-bit hashes cut by their upper ``top`` bits: (range, hashes)."""
    cut = np.searchsorted(h >> np.uint64(64 - top), np.arange((1 << top) + 1))
    used = np.flatnonzero(np.diff(cut))
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([h[cut[k] : cut[k + 1]].tobytes() for k in used], pa.binary())], ["range", "hashes"])


BY_RANGE = "range long, hashes binary"


def bit_tables(parts: DataFrame, top: int, wanted: list[tuple[int, int]]) -> list[bytes]:
    """For each (bits, least) a table of 2^bits bits that marks the cells of hashes coming ``least`` times or more in the rows of ``by_range``.

    A range of hashes is counted by one task; the ranges' parts of the tables, of a fixed size together, are put in order on the driver.
    """

    def marked(group: pa.Table) -> pa.Table:
        own = group.column("range")[0].as_py()
        h, n = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()]), return_counts=True)
        out = []
        for bits, least in wanted:
            block = np.zeros(1 << (bits - top), bool)
            block[(h[n >= least] >> np.uint64(64 - bits)).astype(np.int64) - (own << (bits - top))] = True
            out.append(np.packbits(block).tobytes())
        return pa.table([pa.array([own]), pa.array([out], pa.list_(pa.binary()))], ["range", "blocks"])

    tables = [bytearray(1 << (bits - 3)) for bits, _ in wanted]
    for r in parts.groupBy("range").applyInArrow(marked, "range long, blocks array<binary>").collect():
        for table, block in zip(tables, r.blocks):
            table[r.range * len(block) : (r.range + 1) * len(block)] = block
    return [bytes(t) for t in tables]


def may_hold(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes lie in marked cells of a table (as numpy bytes)."""
    bits = len(table).bit_length() + 2
    cell = (h >> np.uint64(64 - bits)).astype(np.int64)
    return (table[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
