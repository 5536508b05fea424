"""A sweep over parameter combinations that shares what combinations have in common and can be taken up again.

Everything lies under one shared folder: ``reads/<key>`` holds the reads per sample of one set of demultiplexing parameters and ``keys`` names the sets
that are complete, ``calls/idx=<n>`` holds a combination's barcodes and ``progress`` a row for each that is done. A sweep begun again finds both, so it
demultiplexes nothing twice and runs only the combinations that are left. Alignment and counts are shared by combinations that choose the same reads.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators import consensus as C
from ..operators import reads as R
from ..operators.runs import DEMULTIPLEX_KEYS, demultiplex_key, remaining_combinations
from ..session import cut
from ..sinks.writers import append_progress, read_progress
from .phases import CallParams, call_levels, count_levels, demultiplex

# Which setting each sweep parameter changes.
READ_SETTINGS = {"minlen": "minlen", "explen": "explen", "demlen": "demlen", "minq": "minq", "tagmm": "tagmm", "primersearchlen": "window", "primermismatch": "primermm"}
CALL_SETTINGS = {
    "explen": "plen", "lendev": "window", "maxcoverage": "coverage", "consfreqfixed": "threshold", "consfreqmin": "low", "consfreqmax": "high", "consfreqstep": "step",
    "mincoverage": "min_reads", "gencode": "code", "qclentol": "tol", "resolve_mixed.enabled": "resolve", "resolve_mixed.min_secondary_frac": "min_frac",
    "resolve_mixed.tolerance": "tolerance", "resolve_mixed.min_variant_reads": "cluster_reads", "resolve_mixed.alert_divergence": "alert", "resolve_mixed.minor_thresh": "minor",
}


def settings(base, combo: dict, names: dict[str, str]):
    """``base`` with a combination's values, in the types the base has."""
    given = {names[k]: type(getattr(base, names[k]))(v) for k, v in combo.items() if k in names and v is not None}
    return replace(base, **given)


def planned(combos: DataFrame) -> DataFrame:
    """Combinations (idx and parameter columns) with the name of their demultiplexing."""
    own = [k for k in DEMULTIPLEX_KEYS if k in combos.columns]
    return combos.withColumn("demultiplexed", demultiplex_key(own) if own else F.lit("base"))


def _known(spark: SparkSession, path: str) -> set[str]:
    try:
        return {r[0] for r in spark.read.parquet(f"{path}/keys").distinct().collect()}
    except AnalysisException:  # nothing is there yet
        return set()


def _reads(reads: DataFrame, sheet: DataFrame, path: str, key: str, p: R.ReadParams) -> DataFrame:
    """Reads per sample for one set of demultiplexing parameters, made only if no earlier sweep completed them."""
    spark = reads.sparkSession
    where = f"{path}/reads/{key}"
    if key not in _known(spark, path):
        demultiplex(reads, sheet, p).select("sample", "read_id", "seq").write.mode("overwrite").parquet(where)
        spark.createDataFrame([(key,)], "key string").write.mode("append").parquet(f"{path}/keys")
    return spark.read.parquet(where)


def run_sweep(reads: DataFrame, sheet: DataFrame, combos: DataFrame, path: str, base_reads: R.ReadParams, base_calls: CallParams, codes: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Run the combinations that are not done yet, ``most`` of them at most, and return the calls of all that are done.

    ``combos`` has ``idx`` and a column for each parameter that is swept, on top
    of the base settings; the list of combinations is a list of parameters and
    is walked on the driver, each combination as distributed jobs.
    """
    spark = reads.sparkSession
    left = remaining_combinations(planned(combos), read_progress(spark, f"{path}/progress"), ["idx"])
    todo = left.orderBy("demultiplexed", "idx").collect()[:most]
    held: dict = {}
    for combo in todo:
        values = combo.asDict()
        rp, cp = settings(base_reads, values, READ_SETTINGS), settings(base_calls, values, CALL_SETTINGS)
        same = (combo.demultiplexed, cp.plen, cp.window, cp.reads_used)
        if held.get("same") != same:
            own = _reads(reads, sheet, path, combo.demultiplexed, rp)
            aln = cut(C.align_packed(C.subset_by_length(own, cp.plen, cp.window, cp.reads_used[0])))
            held = {"same": same, "aln": aln, "counts": count_levels(aln, cp), "coverage": cut(R.sample_coverage(own))}
        called = call_levels(held["aln"], held["coverage"], cp, codes, held["counts"])
        out = held["coverage"].withColumnRenamed("reads", "coverage").join(called, "sample", "left").withColumn("status", F.coalesce("status", F.lit("NA")))
        where = f"{path}/calls/idx={combo.idx}"
        out.write.mode("overwrite").parquet(where)
        _done(spark, path, combo, where)
    return sweep_calls(spark, path)


def _done(spark: SparkSession, path: str, combo: Row, where: str) -> None:
    label = " ".join(f"{k}={v:g}" for k, v in combo.asDict().items() if k not in ("idx", "demultiplexed", "place") and v is not None)
    good = spark.read.parquet(where).filter("ok").count()
    row = [(int(combo.idx), combo.demultiplexed, where, label, good, False)]
    append_progress(spark.createDataFrame(row, "idx int, folder string, outpath string, parameters string, n_filtered long, variants boolean"), f"{path}/progress")


def sweep_calls(spark: SparkSession, path: str) -> DataFrame:
    """The calls of all finished combinations, with their ``idx``."""
    done = read_progress(spark, f"{path}/progress").select("idx")
    return spark.read.option("basePath", f"{path}/calls").parquet(f"{path}/calls").withColumn("idx", F.col("idx").cast("int")).join(done, "idx")
