"""What is stored and moved between steps: packed reads, compact counts, digests for sequences."""

import random

import numpy as np
from pyspark.sql import functions as F

from ampliq.functions import packs
from ampliq.operators import compare, consensus
from ampliq.operators.counts import columns_of, count_matrix, count_sums
from ampliq.operators.packing import PACKED, pack_reads, unpack_reads


def like_reads(n_samples: int, n: int = 10, size: int = 600) -> list[tuple]:
    rng = random.Random(7)
    rows = []
    for s in range(n_samples):
        text = "".join(rng.choice("ACGT") for _ in range(size))
        for k in range(n):
            at = rng.randrange(size)
            rows.append((f"s{s:03d}", f"r{k}", text[:at] + "T" * (k % 3) + text[at + (k % 2) :], k + 1))
    return rows


def test_packs_give_back_what_they_took():
    for texts in (["ACGT", None, "", "AC-T"], [""], [None], ["A"]):
        assert packs.stretch_texts(packs.squeeze_texts(texts)) == texts
    for most in (1, 300, 70_000, 1 << 33):
        counts = np.arange(70, dtype=np.int64) % 7 * (most // 6 + 1)
        assert packs.stretch_counts(packs.squeeze_counts(counts, 7), 7).tolist() == counts.tolist()
    assert packs.stretch_counts(packs.squeeze_counts(np.zeros(0, np.int64), 7), 7).tolist() == []


def test_aligned_reads_and_counts_are_small_and_whole(spark):
    """Aligned reads come in one shuffle at most and take a fraction of their letters, and so do their counts."""
    rows = like_reads(30)
    reads = spark.createDataFrame(rows, "sample string, read_id string, seq string, rn int").repartition(5)
    aligned = consensus.align_packed(reads)
    assert aligned.count() == 30
    assert aligned._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    letters = sum(len(r[2]) for r in rows)
    assert aligned.agg(F.sum(F.length(PACKED))).first()[0] < letters / 3
    back = consensus.align_to_template(reads).collect()
    assert {(r.sample, r.read_id, r.rn, r.aln.replace("-", "")) for r in back} == {(s, i, k, t) for s, i, t, k in rows}
    assert all(len({len(r.aln) for r in back if r.sample == s}) == 1 for s in {r[0] for r in rows})
    sums = count_sums(unpack_reads(aligned))
    assert sums.agg(F.sum(F.length("counts"))).first()[0] < letters
    assert sorted(columns_of(sums).collect()) == sorted(count_matrix(spark.createDataFrame(back)).collect())


def test_reads_packed_in_parts(spark):
    """Nulls, empty rows, ids of other types and a sample in several parts come back as they were."""
    rows = [("a", 1, "AC"), ("b", 2, None), ("a", 3, ""), ("a", 4, "GT"), (None, 5, "T"), ("b", 6, "-N")]
    df = spark.createDataFrame(rows, "sample string, read_id long, aln string")
    packed = pack_reads(df.coalesce(1)).withColumn("more", F.array(F.lit(1), F.lit(2)))
    back = unpack_reads(packed).collect()
    assert sorted([(r.sample, r.read_id, r.aln) for r in back], key=str) == sorted(rows, key=str) and {tuple(r.more) for r in back} == {(1, 2)}


def test_variant_groups_store_no_sequences(spark, monkeypatch):
    """Groups of variants are found by digests: no sequence is stored."""
    kept, cut = [], compare.cut
    monkeypatch.setattr(compare, "cut", lambda df: kept.append(df) or cut(df))
    rows = [(1, "a", "ACGTACGT"), (2, "a", "GTAC"), (3, "a", "TTTTTTTT"), (1, "b", "ACGT"), (2, "b", "ACGT")]
    df = spark.createDataFrame(rows, "run int, id string, seq string")
    got = {(r.id, r.run): r.variant for r in compare.variant_groups(df, ignore_ends=True).collect()}
    assert got == {("a", 1): 1, ("a", 2): 1, ("a", 3): 2, ("b", 1): 1, ("b", 2): 1}
    assert kept and not any(kind == "string" for df in kept for name, kind in df.dtypes if name not in ("id", "run"))


def test_calls_by_the_rule(spark):
    """Letters called as arrays follow the rule column by column, also from counts given as columns."""
    rng = random.Random(3)
    reads = [("s", k, "".join(rng.choice("AACG-NX") for _ in range(300))) for k in range(7)]
    aln = spark.createDataFrame(reads, "sample string, read_id int, aln string")

    def rule(column: str, t: float, strict: bool) -> str:
        over = [b for b in "ACGT-N" if column.count(b) / len(column) > t]
        solid = [b for b in over if b != "-"]
        return over[0] if len(over) == 1 else "N" if not over or strict or len(solid) != 1 else solid[0]

    for matrix in (count_sums(aln), count_matrix(aln)):
        for t in (0.1, 0.3, 0.6):
            for strict in (False, True):
                want = "".join(rule("".join(r[2][i] for r in reads), t, strict) for i in range(300))
                assert consensus.call_columns(matrix, t, 5, strict).first().aligned == want


def test_mixtures_start_no_frame_for_a_sample(spark):
    """Signatures of a sample are clustered as they pass, and aligned reads meet their places packed."""
    rows = [(f"s{s}", k, ("ACGT" if k < 6 else "TCGA") * 5) for s in range(3) for k in range(10)]
    found = consensus.haplotypes(spark.createDataFrame(rows, "sample string, read_id int, aln string"))
    assert sorted((r.sample, r["rank"], r["size"], r.seq) for r in found.collect()) == sorted((f"s{s}", k, n, t * 5) for s in range(3) for k, n, t in ((1, 6, "ACGT"), (2, 4, "TCGA")))
    assert not hasattr(consensus, "pd")


def test_state_of_a_sample_is_read_and_written_once():
    import pandas as pd

    from ampliq.streaming.reads import ClosestReads

    class Handle:
        def __init__(self):
            self.value, self.calls = None, 0

        def getValueState(self, name, schema):
            return self

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

    handle, step = Handle(), ClosestReads(20, 5, 2)
    step.init(handle)
    rows = [("r1", "A" * 20), ("r2", "A" * 23), ("r3", "A" * 41), ("r4", "A" * 21)]
    for part in (rows[:2], rows[2:]):
        out = next(iter(step.handleInputRows(("s",), iter([pd.DataFrame(part, columns=["read_id", "seq"])]), None)))
    assert handle.calls == 4
    assert out["read_id"].tolist() == ["r1", "r4"] and out["total"].tolist() == [4, 4] and out["bins"][0] == [2, 4] and out["counts"][0] == [3, 1]
