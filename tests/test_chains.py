"""Whole chains: coverage levels, genetic codes per sample, counts that add up, sweeps that are taken up again."""

import os
import random
from collections import Counter
from dataclasses import replace

from pyspark.sql import functions as F

from ampliq.functions import seq as S
from ampliq.operators import consensus as C
from ampliq.operators.counts import column_counts, count_matrix
from ampliq.catalog.fixtures import Fixtures
from ampliq.catalog.reads import PARAMS
from ampliq.operators import runs as R
from ampliq.plans import phases as P
from ampliq.plans import sweep as W

from .conftest import SF


def test_counts_add_up(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([1, 2]), k, "".join(rnd.choices("ACGTN-Rn", k=rnd.randrange(0, 30)))) for k in range(300)] + [("c", 1, 9, ""), ("d", 1, 9, None)]
    want = Counter()
    for sample, k, _, aln in rows:
        for pos, b in enumerate((aln or "").upper()):
            want[sample, k, pos, b] += 1
    df = spark.createDataFrame(rows, "sample string, k int, read_id int, aln string").repartition(7)
    got = column_counts(df, ["sample", "k"]).collect()
    assert {(r.sample, r.k, r.pos) for r in got} == {key[:3] for key in want} and len(got) == len({key[:3] for key in want})
    for r in got:
        assert [r.n_A, r.n_C, r.n_G, r.n_T, r.n_gap, r.n_N] == [want[r.sample, r.k, r.pos, b] for b in "ACGT-N"]
        assert r.n == sum(v for key, v in want.items() if key[:3] == (r.sample, r.k, r.pos))
    assert count_matrix(df, []).count() == 1 and count_matrix(df.limit(0), []).count() == 0
    levels = count_matrix(df.withColumn("rn", F.col("read_id") % 10 + 1), ["sample"], "rn", [3, 10, 7]).collect()
    for r in levels:
        part = [x[3] for x in rows if x[0] == r.sample and x[2] % 10 + 1 <= r.level and x[3]]
        assert r.reads == len(part) and [c.n for c in r.cols] == [sum(len(t) > k for t in part) for k in range(max(map(len, part)))]


def mixed_reads():
    """Samples that are clean, that are good only with their first reads, that only a sweep settles, mixtures, and hopeless ones."""
    rnd = random.Random(4)
    rows = []
    for k in range(14):
        base = "ATG" + "".join(rnd.choice(["GCT", "CAA", "AAC"]) for _ in range(19))
        other = base[:20] + ("A" if base[20] != "A" else "C") + base[21:40] + ("T" if base[40] != "T" else "G") + base[41:]
        n = rnd.choice([4, 8, 12, 24])
        for i in range(n):
            s = base
            if k % 4 == 1 and i >= 6:
                s = other
            elif k % 4 == 2:
                s = base[:10] + rnd.choice("ACGT") + base[11:]
            elif k % 4 == 3 and i % 5 > 2:
                s = other[:30] + "-" + other[31:]
            rows.append((f"s{k}", f"r{i}", s, i + 1))
    return rows


def test_levels_equal_single_calls(spark):
    rows = mixed_reads()
    aln = spark.createDataFrame(rows, "sample string, read_id string, aln string, rn int").repartition(3)
    total = Counter(r[0] for r in rows)
    codes = spark.createDataFrame([("s1", 5), ("s2", 1), ("s4", 2), ("s7", 11)], "sample string, code int")
    coverage = spark.createDataFrame(list(total.items()), "sample string, reads long")
    p = P.CallParams(plen=60, tol=3, code=0, levels=(8, 20, 5))
    got = {r.sample: r for r in P.call_levels(aln, coverage, p, codes).collect()}
    alone = {level: {r.sample: r for r in P.call_aligned(aln.filter(F.col("rn") <= level), p, codes).collect()} for level in p.levels}
    assert set(got) == set(total)
    seen = set()
    for sample, n in total.items():
        for level in sorted(p.levels, reverse=True):
            if level == 20 or n > level:
                want, last = alone[level][sample], level
                if want.ok:
                    break
        r = got[sample]
        assert (r.level, r.seq, r.ok, r.how, r.status, r.reads) == (last, want.seq, want.ok, want.how, want.status, want.reads)
        seen.add((r.level, r.status))
    assert {level for level, _ in seen} >= {20, 8} and len(seen) >= 3


def test_codes_of_rows_equal_single_codes(spark):
    rnd = random.Random(8)
    rows = [(k, "".join(rnd.choices("ACGTN-R", weights=[5, 5, 5, 5, 1, 1, 1], k=rnd.randrange(0, 90)))) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, seq string").withColumn("code", F.element_at(F.array(*map(F.lit, (1, 2, 5, 11, 0))), F.col("k") % 5 + 1))
    both = df.select("k", "code", C.passes_qc(F.col("seq"), F.col("code"), 60, 60).alias("q"), F.when(F.col("code") > 0, S.translates("seq", F.col("code"))).alias("t")).collect()
    for code in (1, 2, 5, 11, 0):
        own = df.filter(F.col("code") == code)
        want = {r.k: r.q for r in own.select("k", C.passes_qc(F.col("seq"), code, 60, 60).alias("q")).collect()}
        assert {r.k: r.q for r in both if r.code == code} == want
        if code:
            assert {r.k: r.t for r in both if r.code == code} == {r.k: r.t for r in own.select("k", S.translates("seq", code).alias("t")).collect()}


def test_grid_by_mixed_radix(spark):
    values = spark.createDataFrame([("minq", "7", 2), ("minq", "5", 1), ("tagmm", "0", 1), ("tagmm", "2", 3), ("tagmm", "1", 2), ("minlen", "10", 1), ("other", "1", 1)], "key string, value string, pos int")
    got = [tuple(r)[1:] for r in R.expand_grid(values, ["minq", "tagmm", "minlen"]).orderBy("place").collect()]
    assert got == [(q, float(t), 10.0) for q in (5.0, 7.0) for t in range(3)]
    assert R.expand_grid(values, ["minq", "demlen"]).count() == 0
    reused = R.phase1_reuse(spark.createDataFrame([(3, 1.0, None), (1, 1.0, 2.0), (2, 1.0, 2.0), (9, 1.0, None)], "run int, a double, b double"), ["a", "b"])
    assert [r.reused for r in reused.orderBy("run").collect()] == [False, True, False, True]


def test_sweep_is_taken_up_again_and_equals_single_runs(spark, tmp_path):
    fx = Fixtures(spark, SF)
    reads = fx.reads.withColumn("read_id", F.col("read_id").cast("string"))
    base = replace(PARAMS, tagmm=1, minlen=0, demlen=50, primermm=2)
    calls = P.CallParams(plen=300, window=300, coverage=8, code=0)
    combos = spark.createDataFrame([(0, 90.0, 0.3), (1, 170.0, 0.6), (2, 90.0, 0.6), (3, 170.0, 0.3)], "idx int, minlen double, consfreqfixed double")
    path = str(tmp_path / "sweep")
    assert {r.idx for r in W.run_sweep(reads, fx.sheet, combos, path, base, calls, most=1).collect()} <= {0, 1}
    files = {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{path}/reads") for f in names}
    got = W.run_sweep(reads, fx.sheet, combos, path, base, calls).collect()
    again = {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{path}/reads") for f in names}
    assert files and all(again[f] == t for f, t in files.items()) and len(os.listdir(f"{path}/reads")) == 2
    key = lambda r: (r.idx, r.sample)
    assert len({key(r) for r in got}) == len(got) and {r.idx for r in got} == {0, 1, 2, 3}
    columns = ["coverage", "reads", "seq", "ok", "how", "status"]
    for minlen in (90, 170):
        own = P.demultiplex(reads, fx.sheet, replace(base, minlen=minlen)).cache()
        for idx, freq in [(c.idx, c.consfreqfixed) for c in combos.filter(F.col("minlen") == minlen).collect()]:
            want = {r.sample: [r[c] for c in columns] for r in P.consensus_by_length(own, replace(calls, threshold=freq)).collect()}
            assert {r.sample: [r[c] for c in columns] for r in got if r.idx == idx} == want
    # Everything is done: nothing runs, the calls are still there.
    assert W.run_sweep(reads.limit(0), fx.sheet, combos, path, base, calls).count() == len(got)


def test_gaps_of_a_set_equal_those_of_its_rows(spark):
    rnd = random.Random(6)
    root = "".join(rnd.choices("ACGT", k=60))
    for n in (2, 3, 40):
        rows = []
        for i in range(n):
            seq = "".join(rnd.choice(["", "A", "CGT"]) if rnd.random() < 0.08 else c for c in (root if rnd.random() < 0.8 else rnd.choice([root[:20] + "GG" * 9 + root[20:], root[::-1], "AC"])))
            rows.append((f"r{i:02d}", seq))
        # Most insert at one place, so the set's consensus has letters there.
        rows += [(f"s{i:02d}", root[:30] + "T" * (3 + i % 4) + root[30:]) for i in range(n)] if n > 3 else []
        df = spark.createDataFrame(rows, "read_id string, seq string")
        want = {(r.read_id, r.estgaps, r.good) for r in C.estimate_gaps(C.align_set(df), keys=()).collect()}
        got = {(r.read_id, r.estgaps, r.good) for r in C.set_gaps(df).collect()}
        assert got == want and len(got) == (len(rows) if n > 2 else 0)


def test_one_long_barcode_widens_no_other(spark):
    """Rows of one width would hold 400 x 4 million letters."""
    rnd = random.Random(8)
    rows = [(f"r{i:03d}", "".join(rnd.choices("ACGT", k=40)), True) for i in range(400)] + [("long", "".join(rnd.choices("ACGT", k=400_000)), True)]
    df = spark.createDataFrame(rows, "sample string, seq string, ok boolean")
    out = {r.sample: r.estgaps for r in P.check_set(df).collect()}
    assert len(out) == 401 and out["long"] >= 399_900


def test_levels_read_the_alignment_once(spark, monkeypatch):
    """Without mixtures no copy of the aligned reads is stored, and a row of counts gives all its calls without a join."""
    kept, cut = [], P.cut
    monkeypatch.setattr(P, "cut", lambda df: kept.append(df) or cut(df))
    rows = [("a", k, "ACGT" if k < 6 else "AC-T", k + 1) for k in range(10)] + [("b", k, "ACGT" if k < 5 else "AGGT", k + 1) for k in range(10)]
    aln = spark.createDataFrame(rows, "sample string, read_id int, aln string, rn int")
    coverage = aln.groupBy("sample").agg(F.count(F.lit(1)).alias("reads"))
    done = P.call_levels(aln, coverage, P.CallParams(code=0, levels=(10, 5), low=0.2, high=0.6, resolve=False))
    got = {r.sample: (r.level, r.seq, r.how, r.ok) for r in done.collect()}
    assert got == {"a": (10, "ACGT", "threshold", True), "b": (5, "ACGT", "threshold", True)}
    assert not any("aln" in df.columns for df in kept)
    counts = P.count_levels(aln, P.CallParams(levels=(10, 5))).filter("level = 10").drop("level")
    called = P.call_counted(counts, aln, P.CallParams(code=0, resolve=False))
    assert "Join" not in called._jdf.queryExecution().optimizedPlan().toString()
