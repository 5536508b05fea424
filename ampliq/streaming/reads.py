"""The read operators over a folder that sequencing keeps filling.

Files must appear in the folder whole: a producer writes elsewhere and renames
into place, since the file source takes each file once, when it first sees it.
The source's checkpoint is the list of files seen, so a restart takes no file
twice, and a failed batch is run again over the same files.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import md5

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..operators import reads as R
from ..operators.consensus import modes_of_bins
from ..operators.ordering import first_per
from ..plans.phases import CallParams, consensus_of_subset
from ..session import cut, scratch_folder
from ..sources.fastq import SCHEMA, batches

PATTERN = "*.{fastq,fq,fastq.gz,fq.gz}"


def stream_files(spark: SparkSession, folder: str, files_per_batch: int | None = None, pattern: str = PATTERN) -> DataFrame:
    """New FASTQ files of a folder tree: path, modificationTime, length; contents are not loaded."""
    source = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    source = source.schema("path string, modificationTime timestamp, length long, content binary")
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    return source.load(folder).select("path", "modificationTime", "length")


def stream_fastq(spark: SparkSession, folder: str, files_per_batch: int | None = None, split_bytes: int = 64 << 20, pattern: str = PATTERN) -> DataFrame:
    """Records of new files, read range by range; a truncated last record is left out."""
    files = stream_files(spark, folder, files_per_batch, pattern)
    whole = F.endswith(F.lower("path"), F.lit(".gz"))
    starts = F.when(whole, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("bigint"))
    )
    ranges = files.select("path", "length", F.explode(starts).alias("start"))

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in batch.to_pylist():
                yield from batches(row["path"], row["start"], row["start"] + split_bytes)

    return ranges.repartition("path", "start").mapInArrow(read, SCHEMA)


def stream_coverage(reads: DataFrame, sheet: DataFrame, p: R.ReadParams) -> DataFrame:
    """Running reads per sample; every step before the count is stateless."""
    from ..plans.phases import demultiplex

    return R.sample_coverage(demultiplex(reads, sheet, p))


def stream_yield(events: DataFrame, time: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows per time window, with a watermark so that old windows close and leave the state."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    per = timed.withWatermark(time, late).groupBy(F.window(time, width).alias("w"))
    return per.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_fastq_stats(reads: DataFrame, group: str = "grp") -> DataFrame:
    """Running quality counters per group; no ranks, so the state is one row per group."""
    values = R.read_values(reads, [group])
    size, q = F.col("length"), F.col("q")
    return values.groupBy(group).agg(
        F.count(F.lit(1)).alias("reads"), F.sum("length").alias("bases"), F.sum("q").alias("q_sum"), F.sum("gc").alias("gc_sum"),
        *[F.count_if(q >= t).alias(f"reads_q{t}") for t in (10, 15, 20)],
        *[F.sum(F.when(q >= t, size).otherwise(0)).alias(f"bases_q{t}") for t in (10, 15, 20)],
    )


KEPT = "sample string, total long, rn int, read_id string, seq string, bins array<int>, counts array<long>"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ClosestReads(StatefulProcessor):
    """What a sample's consensus needs of all its reads so far: their number, how many have each length, and the few of best length.

    All three can be added to, so a batch costs its own reads and what is kept,
    not the reads of the batches before. At most ``n`` reads are kept.
    """

    def __init__(self, plen: int, window: int, n: int):
        self.plen, self.window, self.n = plen, window, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        # One value: each call to the state goes to Spark and back.
        self.state = handle.getValueState("reads", "bins array<int>, counts array<long>, kept array<struct<dev: int, read_id: string, digest: string, seq: string>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.state.get()
        lengths, kept = (Counter(dict(zip(before[0], before[1]))), list(map(tuple, before[2]))) if before else (Counter(), [])
        for part in rows:
            for read_id, seq in zip(part["read_id"], part["seq"]):
                lengths[len(seq) // 10] += 1
                dev = abs(len(seq) - self.plen)
                if dev <= self.window:
                    kept.append((dev, read_id, md5(seq.encode()).hexdigest(), seq))
            kept = sorted(kept)[: self.n]
        total = sum(lengths.values())
        bins = sorted(lengths.items())
        self.state.update(([b for b, _ in bins], [n for _, n in bins], kept))
        # A sample without a read of fitting length is still told of, once.
        rows_out = [(i + 1, r[1], r[3]) for i, r in enumerate(kept)] or [(0, None, None)]
        yield pd.DataFrame(
            {
                "sample": [key[0]] * len(rows_out), "total": total, "rn": [r[0] for r in rows_out], "read_id": [r[1] for r in rows_out], "seq": [r[2] for r in rows_out],
                "bins": [[b for b, _ in bins] if not i else None for i in range(len(rows_out))], "counts": [[n for _, n in bins] if not i else None for i in range(len(rows_out))],
            }
        )


def closest_reads(assigned: DataFrame, p: CallParams) -> DataFrame:
    """A stream of the chosen reads of every sample that grew (see ``ClosestReads``), with the state kept by Spark."""
    reads = assigned.select(F.col("sample").cast("string").alias("sample"), F.col("read_id").cast("string").alias("read_id"), "seq").filter("sample is not null and seq is not null")
    return reads.groupBy("sample").transformWithStateInPandas(ClosestReads(p.plen, p.window, p.reads_used[0]), KEPT, "Update", "None")


def consensus_cycle(path: str, p: CallParams) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` step: call the samples that grew again.

    The batch's own folder is replaced, so a batch that runs twice leaves one
    copy; Spark brings the state back to where it was before that batch.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = cut(batch)
        if batch.isEmpty():
            return
        coverage = batch.groupBy("sample").agg(F.max("total").alias("reads"))
        bins = batch.filter("bins is not null").select("sample", F.inline(F.arrays_zip("bins", "counts"))).select("sample", F.col("bins").alias("bin"), F.col("counts").alias("n"))
        called = consensus_of_subset(batch.filter("rn > 0").select("sample", "read_id", "seq", "rn"), coverage, modes_of_bins(bins), p)
        called.write.mode("overwrite").parquet(f"{path}/consensus/batch={batch_id}")

    return step


def stream_consensus(
    assigned: DataFrame, path: str, p: CallParams, trigger: dict | None = None, step: Callable[[DataFrame, int], None] | None = None
) -> StreamingQuery:
    """Keep the consensus of every sample up to date; the next cycle starts when one ends."""
    conf = assigned.sparkSession.conf
    name = "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    # State of several kinds needs this store; a query keeps the one it began with.
    conf.set(name, ROCKS)
    try:
        writer = closest_reads(assigned, p).writeStream.foreachBatch(step or consensus_cycle(path, p)).outputMode("update")
        return writer.option("checkpointLocation", f"{path}/checkpoint").trigger(**(trigger or {"processingTime": "0 seconds"})).start()
    finally:
        conf.set(name, before)


def latest_consensus(spark: SparkSession, path: str) -> DataFrame:
    """The last consensus of each sample."""
    calls = spark.read.parquet(f"{path}/consensus")
    return first_per(calls, ["sample"], [-F.col("batch")])


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what there is now; its result lies as Parquet in the shared folder, a part for each batch.

    In mode ``complete`` the last batch holds everything, else all batches together do. A batch that runs twice replaces its own part.
    """
    spark = stream.sparkSession
    path = scratch_folder(spark, "stream")

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    query = stream.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    try:
        out = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{path}/out")
    except AnalysisException:  # no batch ran
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        out = out.filter(F.col("batch") == out.agg(F.max("batch")).first()[0])
    return out.drop("batch")
