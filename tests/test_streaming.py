"""Files dropped in turns must give what a batch over all of them gives."""

import pytest
from pyspark.sql import functions as F

from ampliq.catalog import streams
from ampliq.catalog.fixtures import Fixtures
from ampliq.catalog.reads import PARAMS
from ampliq.operators import reads as R
from ampliq.plans.phases import CallParams, consensus_by_length, demultiplex
from ampliq.session import scratch_folder
from ampliq.sources.fastq import read_fastq, reads
from ampliq.streaming import reads as S

from .conftest import SF


def drop(folder, name, rows, cut=False):
    text = "".join(f"@{r.read_id}\n{r.seq}\n+\n{r.qual}\n" for r in rows)
    (folder / f".{name}").write_text(text + ("@half\nACG" if cut else ""))
    (folder / f".{name}").rename(folder / name)


def test_drops_equal_batch_and_restart_adds_nothing(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    fx = Fixtures(spark, SF)
    rows = fx.reads.select("read_id", "seq", "qual").orderBy("read_id").collect()
    variants_of = dict(sheet=fx.sheet, p=R.ReadParams(**{**PARAMS.__dict__, "tagmm": 1, "minlen": 139, "explen": 10_000_000}))
    calls = CallParams(plen=300, window=100000, code=0, coverage=3)
    for i in range(3):
        drop(folder, f"f{i}.fastq", rows[i::3], cut=i == 1)
        live = reads(S.stream_fastq(spark, str(folder), split_bytes=50_000))
        located = demultiplex(live, variants_of["sheet"], variants_of["p"])
        S.stream_consensus(located, store, calls, {"availableNow": True}).awaitTermination()
    batch = demultiplex(reads(read_fastq(spark, str(folder))), variants_of["sheet"], variants_of["p"])
    coverage = {r.sample: r.reads for r in R.sample_coverage(batch).collect()}
    columns = ["coverage", "reads", "seq", "ok", "how", "status", "mode1", "mode2"]
    want = {r.sample: [r[c] for c in columns] for r in consensus_by_length(batch, calls).collect()}
    latest = {r.sample: [r[c] for c in columns] for r in S.latest_consensus(spark, store).collect()}
    assert latest == want and {k: v[0] for k, v in latest.items()} == coverage
    files = spark.read.parquet(f"{store}/consensus").count()
    again = demultiplex(reads(S.stream_fastq(spark, str(folder))), variants_of["sheet"], variants_of["p"])
    S.stream_consensus(again, store, calls, {"availableNow": True}).awaitTermination()
    assert spark.read.parquet(f"{store}/consensus").count() == files
    want = coverage
    out = S.run_to_table(R.sample_coverage(demultiplex(reads(S.stream_fastq(spark, str(folder))), **variants_of)))
    assert {r.sample: r.reads for r in out.collect()} == want


def test_failed_batch_runs_again_and_counts_once(spark, tmp_path):
    """The second batch fails after its state was changed and its calls were half written; taken up again everything equals a batch."""
    rows = [(f"s{k % 3}", f"r{k}", "ACGTACGTAC" * (3 + k % 2)) for k in range(60)]
    source, store = tmp_path / "in", str(tmp_path / "out")
    for i in range(3):
        spark.createDataFrame(rows[i::3], "sample string, read_id string, seq string").coalesce(1).write.mode("append").parquet(str(source))
    calls = CallParams(plen=30, window=20, code=0, coverage=7)
    live = lambda: spark.readStream.schema("sample string, read_id string, seq string").option("maxFilesPerTrigger", 1).parquet(str(source))
    step, tried = S.consensus_cycle(store, calls), []

    def failing(batch, batch_id):
        tried.append(batch_id)
        step(batch, batch_id)
        if batch_id == 1:
            raise RuntimeError("lost")

    query = S.stream_consensus(live(), store, calls, {"availableNow": True}, failing)
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination()
    S.stream_consensus(live(), store, calls, {"availableNow": True}).awaitTermination()
    assert tried == [0, 1]
    columns = ["coverage", "reads", "seq", "ok", "status"]
    want = {r.sample: [r[c] for c in columns] for r in consensus_by_length(spark.createDataFrame(rows, "sample string, read_id string, seq string"), calls).collect()}
    assert {r.sample: [r[c] for c in columns] for r in S.latest_consensus(spark, store).collect()} == want
    assert {v[0] for v in want.values()} == {20}


def test_yield_closes_old_windows(spark):
    events = Fixtures(spark, SF).stream("events").events
    out = S.run_to_table(S.stream_yield(events, "ts"), "append")
    assert 0 < out.agg(F.sum("n")).first()[0] <= 1000


def test_a_streamed_table_may_be_a_folder_of_parts(spark, tmp_path):
    spark.range(20).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts")).repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    live = Fixtures(spark, str(tmp_path)).stream("events").events
    assert sorted(r.event_id for r in S.run_to_table(live, "append").collect()) == list(range(20))


def test_a_stream_without_rows_keeps_its_columns(spark, tmp_path):
    (tmp_path / "none").mkdir()
    live = spark.readStream.schema("a int").parquet(str(tmp_path / "none"))
    assert S.run_to_table(live, "append").columns == ["a"]


def test_arriving_reads_are_not_written_by_one_task(spark, monkeypatch):
    made = []
    monkeypatch.setattr(streams, "scratch_folder", lambda spark, name: made.append(scratch_folder(spark, name)) or made[-1])
    streams._grown(Fixtures(spark, SF), False)
    source = next(p for p in made if "arriving" in p)
    assert len(spark.read.parquet(source).inputFiles()) == 12
