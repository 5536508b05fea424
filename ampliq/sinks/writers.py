"""Sinks: FASTA, one file set per key, reports, sweep progress and growing dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.text import safe_name
from ..operators.records import wrap


def fasta_lines(df: DataFrame, cols: int | None = None) -> DataFrame:
    seq = wrap("seq", cols) if cols else F.col("seq")
    return df.select(F.concat(F.lit(">"), "header", F.lit("\n"), F.coalesce(seq, F.lit(""))).alias("value"))


def write_fasta(df: DataFrame, path: str, cols: int | None = None, sort: bool = False) -> bool:
    """Write records as FASTA parts; with ``sort`` in the order of ``ord``. Nothing is written when there is no record."""
    if df.isEmpty():
        return False
    rows = df.orderBy("ord") if sort else df
    fasta_lines(rows, cols).write.mode("overwrite").text(path)
    return True


def split_names(df: DataFrame, key) -> DataFrame:
    """Add ``name``, the file name of each record's key value; names equal but for case get ``_2``, ``_3``, ...

    The window runs over the distinct names, one per output file.
    """
    keyed = df.withColumn("_safe", F.coalesce(safe_name(key), F.lit("no_field")))
    values = keyed.groupBy("_safe").agg(F.min("ord").alias("first"))
    order = F.row_number().over(Window.partitionBy(F.lower("_safe")).orderBy("first"))
    n = values.withColumn("_n", order)
    name = F.when(F.col("_n") > 1, F.concat_ws("_", "_safe", F.col("_n").cast("string"))).otherwise(F.col("_safe"))
    return keyed.join(n.select("_safe", name.alias("name")), "_safe").drop("_safe")


def write_split(df: DataFrame, key, path: str) -> None:
    """One folder of FASTA parts per key value; large values are written by many tasks."""
    named = split_names(df, key)
    named.select(F.concat(F.lit(">"), "header", F.lit("\n"), "seq").alias("value"), "name").write.mode("overwrite").partitionBy("name").text(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path, sep="\t")


PROGRESS = "idx int, folder string, outpath string, parameters string, n_filtered long, variants boolean"


def append_progress(df: DataFrame, path: str) -> None:
    """Add finished combinations; each append is one committed write."""
    df.write.mode("append").parquet(path)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """Finished combinations, the last entry of an index winning; none when nothing is there yet."""
    try:
        done = spark.read.schema(PROGRESS).option("ignoreCorruptFiles", True).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], PROGRESS)
    stamped = done.withColumn("_t", F.struct("_metadata.file_modification_time", "_metadata.file_path"))
    rest = [c for c in done.columns if c != "idx"]
    return stamped.groupBy("idx").agg(F.max_by(F.struct(*rest), "_t").alias("r")).select("idx", "r.*")


def new_keys(fresh: DataFrame, stored: DataFrame, negative: str = "") -> DataFrame:
    """Entries (key, value) not stored yet, once per key, without unconfirmed negatives."""
    known = fresh.filter(F.col("value").isNotNull() & (F.col("value") != negative))
    once = known.groupBy("key").agg(F.min("value").alias("value"))
    return once.join(stored.select("key"), "key", "left_anti")


def append_dim(fresh: DataFrame, path: str, negative: str = "") -> None:
    spark = fresh.sparkSession
    try:
        stored = spark.read.parquet(path)
    except AnalysisException:
        stored = spark.createDataFrame([], "key string, value string")
    new_keys(fresh, stored, negative).write.mode("append").parquet(path)
