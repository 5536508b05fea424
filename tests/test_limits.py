"""Nothing is cut, dropped or refused because it is long, empty or unusual."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ampliq.functions import headers, seq
from ampliq.functions import text as X
from ampliq.functions.iupac import _scan, _scan_long, equal_letters
from ampliq.functions.seq import STOPS
from ampliq.operators import consensus, counts, identify, ordering
from ampliq.operators import reads as R
from ampliq.operators.runs import PARAMETERS
from ampliq.sinks import writers as K
from ampliq.sources import fasta, tables


def test_lookup_keeps_all_cells(spark):
    rows = spark.createDataFrame([(1, ["id1", *[f"v{k}" for k in range(1500)]]), (2, ["id2"]), (3, [])], "ord long, cells array<string>")
    got = {r.id: len(r.fields) for r in tables.parse_lookup(rows).collect()}
    assert got == {"id1": 1500, "id2": 0}


def test_long_numbers_sort_as_numbers(spark):
    names = ["a2", "a" + "1" * 39, "a10", "a" + "9" * 38, "a", "a002", "b1", "a1b" + "2" * 50, "a1b3"]
    got = [r.s for r in spark.createDataFrame([(n,) for n in names], "s string").orderBy(X.natural_key("s"), "s").collect()]
    assert got == ["a", "a1b3", "a1b" + "2" * 50, "a002", "a2", "a10", "a" + "9" * 38, "a" + "1" * 39, "b1"]


def test_every_accepted_genetic_code_has_stops():
    assert set(PARAMETERS["gencode"][1]) == set(STOPS)


@pytest.mark.parametrize("infix, last", [(True, False), (False, True)])
def test_long_patterns_equal_short_ones(infix, last):
    rnd, equal = random.Random(3), equal_letters("base")
    texts = ["".join(rnd.choices("ACGTR", k=rnd.randrange(0, 30))) for _ in range(60)]
    grid = np.frombuffer(b"".join(t.encode().ljust(30, b"\0") for t in texts), np.uint8).reshape(len(texts), 30)
    size = np.array([len(t) for t in texts])
    for _ in range(10):
        pattern = "".join(rnd.choices("ACGTRN", k=rnd.randrange(1, 25)))
        for a, b in zip(_scan(pattern, grid, size, equal, infix, last), _scan_long(pattern, grid, equal, size, infix, last)):
            assert a.tolist() == b.tolist()


def _product(rnd, n, tag_f, tag_r, p):
    back = str.maketrans("ACGTRY", "TGCAYR")
    insert = "".join(rnd.choices("ACGT", k=n))
    return insert, tag_f + p.primers_f[0] + insert + p.primers_r[0].replace("R", "A").translate(back)[::-1] + tag_r.translate(back)[::-1]


@pytest.mark.parametrize("primer_r", ["GTAAAATCAAGTCCACCRCG", "GTAAAATCAAGTCCACCRCGTTAGCCATTGCAACGGTTACCAGTTCAGGACTTAACCGGTTAACGAT"])
def test_tags_and_inserts_around_the_window(spark, primer_r):
    rnd = random.Random(4)
    p = R.ReadParams(taglen=4, primers_f=("ATGTCACCACAAACAGAGACTAAAGC",), primers_r=(primer_r,), window=100, primermm=2)
    rows, want = [], {}
    for n in range(0, 140, 3):
        insert, seq = _product(rnd, n, "ACCA", "CCGG", p)
        strand = "-" if n % 2 else "+"
        text = seq.translate(str.maketrans("ACGT", "TGCA"))[::-1] if n % 2 else seq
        rows.append((n, text, text))
        want[n] = ("ACCA", "CCGG", insert, strand)
    got = R.locate_primers(spark.createDataFrame(rows, "read_id long, seq string, qual string"), p).collect()
    assert {r.read_id: (r.tag_f, r.tag_r, r.insert, r.strand) for r in got} == want


def test_empty_records_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, "one", "ACGT"), (2, "two", ""), (3, "three", None)], "ord long, header string, seq string")
    assert K.write_fasta(rows.coalesce(1), str(tmp_path / "f"), sort=True)
    got = fasta.read_fasta(spark, str(tmp_path / "f")).orderBy("ord").collect()
    assert [(r.header, r.seq) for r in got] == [("one", "ACGT"), ("two", ""), ("three", "")]


def test_first_rows_of_hot_keys(spark):
    rows = spark.range(6000).select((F.col("id") % 2 * F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    got = ordering.top_n_per(rows, ["k"], ["v"], 1500)
    for k in (0, 1, 2):
        own = [r.v for r in rows.filter(F.col("k") == k).orderBy("v").collect()][:1500]
        assert [r.v for r in got.filter(F.col("k") == k).orderBy("rn").collect()] == own


@pytest.mark.parametrize("parts", [1, 7, 32])
def test_running_numbers_for_any_number_of_partitions(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = spark.range(500).select((F.col("id") * 7919 % 500).alias("v"), (F.col("id") * 7919 % 500 % 3).alias("k"), F.lit(2).alias("w"))
        assert {r.v: r.rn for r in ordering.running(rows, ["v"]).collect()} == {v: v + 1 for v in range(500)}
        got = ordering.running(rows, ["v"], keys=["k"], sums={"s": "w"}).collect()
        assert {r.v: (r.rn, r.s) for r in got} == {v: (v // 3 + 1, 2 * (v // 3 + 1)) for v in range(500)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_stops_of_long_and_unusual_texts(spark):
    """All frames of a batch are looked up as arrays; texts with other characters, gaps or none at all give what codons from left to right give."""
    rnd = random.Random(8)
    texts = ["", "TA", "TAATAGTGA", "ta-a.taguga", "TAA*TAG7TGA", None, "".join(rnd.choices("ACGT", k=200_000))]
    seq_rows = spark.createDataFrame(list(enumerate(texts)), "k int, s string").coalesce(1)
    got = {r.k: r.v for r in seq_rows.select("k", seq.scan_stops("s", 1).alias("v")).collect()}
    assert got[5].n is None and got[5].positions is None
    for k, text in enumerate(texts):
        if text is not None:
            clean = text.upper().replace("-", "").replace(".", "").replace("U", "T")
            n, rank, positions = seq._stops_in(clean, seq.stop_codons(1))
            assert (got[k].n, got[k].frame, got[k].positions) == (n, seq.FRAMES[rank], positions), text[:20]
    assert got[2].n == 0 and got[6].n > 1000


def test_stop_kernel_takes_whole_batches():
    """Texts of letters only are looked up together, and each gives what reading it alone gives."""
    letters = np.frombuffer("".join(random.Random(9).choices("ACGT", k=1_000_000)).encode(), np.uint8)
    n, rank, cuts, positions = seq._stops_of(letters, np.full(1000, 1000), seq._codon_table(seq.stop_codons(1)))
    text = letters[3000:4000].tobytes().decode()
    want = seq._stops_in(text, seq.stop_codons(1))
    assert (n[3], rank[3], positions[cuts[3] : cuts[4]].tolist()) == want


def test_names_of_hits_are_compared_in_compiled_code(spark, tmp_path):
    # Java leaves a method above 8,000 bytes uncompiled; the step then takes five times as long.
    ref = spark.createDataFrame([("s1", "Diptera", "Muscidae", "Musca", "musca domestica"), ("s2", "ß", "", "", "Musca cf. nova")], "sample string, q_order string, q_family string, q_genus string, q_organism string")
    hits = spark.createDataFrame(
        [("S1;1", "", "", "", "Musca_cf._domestica_x"), ("s2", "", "", "", "Musca nova"), ("s2", "SS", "", "", "Muscanova nova"), ("s3", "", "", "musca", "")],
        "query_name string, s_order string, s_family string, s_genus string, s_organism string",
    )
    rows = identify.lookup_taxonomy(hits.withColumn("sample", F.substring_index("query_name", ";", 1)), identify.reference_table(ref), "_own")
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    done = identify.with_level(rows, "level")
    assert sorted(r.level for r in done.collect()) == ["none", "order", "organism", "organism"]
    assert [r.level for r in identify.with_level(rows.drop("_own"), "level").orderBy("query_name", "s_organism").collect()] == [r.level for r in done.orderBy("query_name", "s_organism").collect()]
    made = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package").codegenStringSeq(done._jdf.queryExecution().executedPlan())
    assert max(made.apply(k)._3().maxMethodCodeSize() for k in range(made.size())) < 8000


def test_letters_are_counted_in_bounded_memory():
    text = "ACGT" * 1000
    batch = pa.RecordBatch.from_arrays([pa.array([f"s{k}" for k in range(3000)]), pa.array([text] * 3000)], ["sample", "aln"])
    tracemalloc.start()
    rows = sum(part.num_rows for part in counts._counting(["sample"])(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 3000 and peak < 250 << 20


def test_numbers_of_headers(spark):
    rows = [("a;7;8;ambs=1;estgaps=2", "ACN"), ("a_var1; LEN = 5 ;coverage=x=3;Ns=4;fixed_indels=", "AC"), ("len=9", "ANN"), ("a;len;olen=4;len=;len=3", "ACGT"), ("b;x", "RY")]
    got = spark.createDataFrame(rows, "h string, s string").select(headers.header_metrics("h", "s").alias("m")).select("m.*").collect()
    assert [tuple(r)[1:] for r in got] == [(7, 8, 1, 2), (5, None, 4, 0), (3, None, 2, 0), (4, None, 0, 0), (2, None, 2, 0)]


def test_gaps_of_aligned_texts(spark):
    """Shapes are compared as arrays: whatever the texts hold, null, empty, unequal or beyond ASCII, the result is that of a walk over their characters."""
    rnd = random.Random(5)
    texts = [None, "", "-", "a", "--", "é-x", "-é-", "x\U0001f600-", "A-C", "N-\n"] + ["".join(rnd.choices("AC-é", [5, 5, 2, share], k=40)) for share in (0, 0, 0, 1, 1)]
    rows = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string").coalesce(1)
    for r in rows.withColumn("n", seq.gaps_apart("a", "b")).collect():
        same = r.a is not None and r.b is not None and len(r.a) == len(r.b)
        assert r.n == (sum((x == "-") != (y == "-") for x, y in zip(r.a, r.b)) if same else None), (r.a, r.b)


def test_gaps_of_a_set_are_not_found_by_patterns(spark):
    aln = spark.createDataFrame([("s", k, "AC-GT" if k else "ACGGT") for k in range(4)], "sample string, read_id int, aln string")
    done = consensus.estimate_gaps(aln, ["sample"])
    assert sorted((r.read_id, r.estgaps, r.good) for r in done.collect()) == [(0, 1, False), (1, 0, True), (2, 0, True), (3, 0, True)]
    # A pattern replaced letter by letter took more than half of the whole query's time.
    assert "regexp_replace" not in done._jdf.queryExecution().optimizedPlan().toString()
