"""Streams over the given tables, run over all there is; each must equal its batch twin."""

from dataclasses import replace

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..plans.phases import CallParams
from ..session import scratch_folder
from ..streaming import reads as S
from .reads import _VALUES, PARAMS
from .registry import query


def _run(stream):
    return S.run_to_table(stream)


@query("st03_stream_coverage", f"SELECT truth AS sample, count(*) AS reads FROM fx_reads WHERE length(seq)<{PARAMS.product + PARAMS.demlen} GROUP BY 1")
def _(fx):
    live = fx.stream("documents")
    p = replace(PARAMS, tagmm=1, minlen=0, primermm=2)
    return _run(S.stream_coverage(live.reads, fx.sheet, p))


@query(
    "st06_stream_yield",
    """SELECT epoch(time_bucket(INTERVAL '5 minutes', ts)) AS start, epoch(time_bucket(INTERVAL '5 minutes', ts))+300 AS "end", count(*) AS n FROM events GROUP BY 1""",
)
def _(fx):
    out = _run(S.stream_yield(fx.stream("events").events, "ts"))
    return out.select(F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "n")


@query(
    "st07_stream_fastq_stats",
    f"""WITH {_VALUES} SELECT grp, count(*) AS reads, cast(sum(length) AS bigint) AS bases, round(sum(q),4) AS q_sum, round(sum(gc),4) AS gc_sum, count(*) FILTER (q>=10) AS reads_q10, count(*) FILTER (q>=15) AS reads_q15,
     count(*) FILTER (q>=20) AS reads_q20, cast(sum(CASE WHEN q>=10 THEN length ELSE 0 END) AS bigint) AS bases_q10, cast(sum(CASE WHEN q>=15 THEN length ELSE 0 END) AS bigint) AS bases_q15,
     cast(sum(CASE WHEN q>=20 THEN length ELSE 0 END) AS bigint) AS bases_q20 FROM v GROUP BY grp""",
)
def _(fx):
    out = _run(S.stream_fastq_stats(fx.stream("documents").reads))
    return out.withColumn("q_sum", F.round("q_sum", 4)).withColumn("gc_sum", F.round("gc_sum", 4))


# A sample's reads and their length modes, and how many reads of best length its consensus used, at most seven.
_GROWN = """WITH b AS (SELECT truth AS sample, length(seq)//10 AS bin, count(*) AS n FROM fx_reads GROUP BY 1,2), t AS (SELECT sample, sum(n) AS reads, arg_max(bin, n*100000-bin) AS b1 FROM b GROUP BY 1),
     f AS (SELECT b.sample, reads, b1, arg_max(bin, n*100000-bin) AS b2, max(n) AS n2 FROM b JOIN t ON t.sample=b.sample WHERE abs(bin-b1)>=3 AND reads>=10 GROUP BY 1,2,3),
     k AS (SELECT truth AS sample, least(7, count(*)) AS used FROM fx_reads WHERE abs(length(seq)-300)<=200 GROUP BY 1)
    SELECT t.sample, cast(t.reads AS bigint) AS coverage, cast(used AS bigint) AS used, CASE WHEN n2/f.reads>=0.2 THEN f.b1*10 END AS mode1, CASE WHEN n2/f.reads>=0.2 THEN b2*10 END AS mode2 FROM t LEFT JOIN f USING (sample) LEFT JOIN k USING (sample)"""


def _grown(fx, fail):
    """Reads that arrive in twelve files, four a batch; with ``fail`` the second batch is lost after its calls are written, and taken up again."""
    source, store = scratch_folder(fx.spark, "arriving"), scratch_folder(fx.spark, "called")
    arriving = fx.reads.select(F.col("truth").alias("sample"), F.col("read_id").cast("string").alias("read_id"), "seq")
    arriving.repartition(12).write.parquet(source)
    p = CallParams(plen=300, window=200, coverage=7, code=0, resolve=False)
    step = S.consensus_cycle(store, p)

    def lost(batch, batch_id):
        step(batch, batch_id)
        if batch_id == 1:
            raise RuntimeError("this batch is run again")

    for again in ([lost, step] if fail else [step]):
        live = fx.spark.readStream.schema(arriving.schema).option("maxFilesPerTrigger", 4).parquet(source)
        query = S.stream_consensus(live, store, p, {"availableNow": True}, again)
        try:
            query.awaitTermination()
        except StreamingQueryException:
            if again is not lost:
                raise
    return S.latest_consensus(fx.spark, store).select("sample", "coverage", F.col("reads").alias("used"), "mode1", "mode2")


@query("st04_stream_consensus", _GROWN)
def _(fx):
    return _grown(fx, False)


@query("st05_failed_batch", _GROWN)
def _(fx):
    return _grown(fx, True)
