import gzip
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ampliq.catalog import QUERIES, files
from ampliq.catalog.fixtures import Fixtures
from ampliq.operators.runs import remaining_combinations
from ampliq.session import scratch_folder
from ampliq.sinks import writers as K
from ampliq.sources import fasta, fastq, tables, xml

from .conftest import SF

FASTA = b"junk before\nmore\n>a 1\r\nACGT\r\nAC\r\n>b\n>empty\n>c;x=1\nGG\xff\nTT\n"


def recs(df):
    return [(r.header, r.seq) for r in df.orderBy("ord").collect()]


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_bytes(FASTA)
    with gzip.open(tmp_path / "y.fa.gz", "wb") as f:
        f.write(b">z\nAA\nCC\n")
    got = recs(fasta.read_fasta(spark, str(tmp_path / "x.fa")))
    assert [h for h, _ in got] == ["a 1", "b", "empty", "c;x=1"]
    assert [s for _, s in got][:3] == ["ACGTAC", "", ""] and got[3][1].startswith("GG") and got[3][1].endswith("TT")
    assert recs(fasta.read_fasta(spark, str(tmp_path / "y.fa.gz"))) == [("z", "AACC")]


def test_fasta_ranges_give_each_record_once(spark, tmp_path):
    """Cut anywhere, also between a line end and the next record, inside headers and inside long sequences."""
    want = [(f"r{k} >x", "ACGT" * (k % 40)) for k in range(60)] + [("", ""), (">twice", "A"), ("last", "")]
    text = "before\n > no record\n" + "".join(f">{h}\r\n" + "".join(s[i : i + 30] + "\r\n" for i in range(0, len(s), 30)) for h, s in want)
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.fa").write_bytes(text.encode())
    (tmp_path / "in" / "_SUCCESS").write_bytes(b">no\nA\n")
    (tmp_path / "in" / "empty.fa").write_bytes(b"")
    for step in (1, 2, 7, 64, len(text) - 1, len(text) + 9):
        ranges = [(a, min(a + step, len(text))) for a in range(0, len(text), step)]
        assert [(h, s) for a, b in ranges for _, h, s in fasta.records(str(tmp_path / "in" / "a.fa"), a, b)] == want, step
    with gzip.open(tmp_path / "in" / "deep" / "b.fa.gz", "wb") as f:
        f.write(b">z\nAA\n>y")
    got = fasta.read_fasta(spark, str(tmp_path / "in"), split_bytes=100)
    assert recs(got) == want + [("z", "AA"), ("y", "")]
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_alignment_and_runs(spark, tmp_path):
    for run in ("r1", "r2"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "consensus_filtered.fa").write_text(f">s_{run}\nEFQP-\n")
    (tmp_path / "other").mkdir()
    got = fasta.read_runs(spark, str(tmp_path))
    assert sorted((r.run, r.header) for r in got.collect()) == [("r1", "s_r1"), ("r2", "s_r2")]
    aln = fasta.read_alignment(spark, str(tmp_path / "r1" / "consensus_filtered.fa"))
    assert recs(aln) == [("s_r1", "AGCT-")]


def fq(n, seq="ACGTACGT", qual="@@+IIII!"):
    return "".join(f"@r{i} x\n{seq}{'A' * (i % 5)}\n+\n{qual}{'@' * (i % 5)}\n" for i in range(n))


def test_fastq_ranges_give_each_record_once(spark, tmp_path):
    text = fq(200) + "@noseq\n\n+\n\n" + "@cut\nACGT\n+\nII"
    (tmp_path / "barcode2").mkdir()
    (tmp_path / "barcode2" / "a.fastq").write_text(text)
    (tmp_path / "b.fq").write_text(fq(3).replace("\n", "\r\n"))
    (tmp_path / "notes.txt").write_text("@x\nA\n+\nI\n")
    for split in (64, 333, 1 << 20):
        scan = fastq.read_fastq(spark, str(tmp_path), split_bytes=split)
        reads = fastq.with_path_group(fastq.reads(scan), str(tmp_path))
        ids = sorted((r.grp, r.read_id) for r in reads.collect())
        assert ids == sorted([("barcode2", f"r{i}") for i in range(200)] + [("(folder root)", f"r{i}") for i in range(3)]), split


def test_fastq_gzip_and_damage(spark, tmp_path):
    whole = gzip.compress(fq(500).encode()) + gzip.compress(fq(2).encode())
    (tmp_path / "ok.fastq.gz").write_bytes(whole)
    (tmp_path / "cut.fastq.gz").write_bytes(gzip.compress(fq(5000).encode(), 1)[:-200])
    scan = fastq.read_fastq(spark, [str(tmp_path / "ok.fastq.gz"), str(tmp_path / "cut.fastq.gz"), str(tmp_path / "ok.fastq.gz")]).cache()
    n = {r.file.rsplit("/", 1)[1]: r["count"] for r in fastq.reads(scan).groupBy("file").count().collect()}
    assert n["ok.fastq.gz"] == 502 and 0 < n["cut.fastq.gz"] < 5000
    issues = fastq.read_issues(scan).collect()
    assert len(issues) == 1 and issues[0].file.endswith("cut.fastq.gz")


def test_sample_sheet(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_bytes("﻿S1, acgt ,tgca,FFF,RRR,FF2,\n,,\n\nS2,AAAA,CCCC,ZZZ,YYY\n".encode())
    sheet = tables.read_sample_sheet(spark, str(path))
    assert [(r.sample, r.tag_f, r.tag_r) for r in sheet.orderBy("no").collect()] == [("S1", "ACGT", "TGCA"), ("S2", "AAAA", "CCCC")]
    primers = {(r.side, r.ordinal): r.seq for r in tables.sheet_primers(sheet).collect()}
    assert primers == {("forward", 0): "FFF", ("reverse", 0): "RRR", ("forward", 1): "FF2"}
    path.write_bytes("Pe\xf1a\x96,AA,CC\n".encode("latin-1"))
    assert tables.read_sample_sheet(spark, str(path)).first().sample == "Peña–"
    path.write_text("S1,AA\n")
    with pytest.raises(Exception, match="two tags"):
        tables.read_sample_sheet(spark, str(path)).collect()


def test_hits_taxonomy_and_identifications(spark, tmp_path):
    hits = tmp_path / "h.tsv"
    hits.write_text("Hit_rank\tQuery_name \tP_identity\tSubject_Order\tSubject_Family\tSubject_Genus\tSubject_organism\n1\tq1\t99,5\to\tf\tg\tg_s\n\n2\tq1\t98.5%\to\tf\tg\tg_t\n")
    got = tables.read_hits(spark, str(hits)).orderBy("hit_rank").collect()
    assert [(r.query_name, r.p_identity, r.s_organism) for r in got] == [("q1", 99.5, "g_s"), ("q1", 98.5, "g_t")]
    hits.write_text("Query_name,P_identity\nq,1\n")
    with pytest.raises(ValueError, match="Subject_Order"):
        tables.read_hits(spark, str(hits))
    tax = tmp_path / "t.csv"
    tax.write_text("plate,Code,O,F,G,S\n1,A,o,f,g,g s\n1,A,x,x,x,x\n2,,o,f,g,s\n")
    assert [tuple(r) for r in tables.read_taxonomy(spark, str(tax)).collect()] == [("A", "o", "f", "g", "g s")]
    tax.write_text("A,o,f,g,s\nB,o,f,g,s\n")
    assert tables.read_taxonomy(spark, str(tax)).count() == 2
    ids = tmp_path / "i.tsv"
    ids.write_text("Report of today\nQuery ID\tID%\tSpecies\t\t\nq1\t99.5%\ta b\n\t\t\nq1\t97\tc\n")
    assert sorted((r["Query ID"], r["ID%"], r.Species) for r in tables.read_id_table(spark, str(ids)).collect()) == [("q1", 97.0, "c"), ("q1", 99.5, "a b")]


def test_small_tables(spark, tmp_path):
    p = tmp_path / "x"
    p.write_text("id,a,b\nX 1,Árbol. b,\nX 1,new, ., \n,no,no\n")
    assert [(r.id, r.fields) for r in tables.read_lookup(spark, str(p)).collect()] == [("X_1", ["new"])]
    p.write_text("a\n\n b \n")
    assert sorted(r.pattern for r in tables.read_patterns(spark, str(p)).collect()) == ["a", "b"]
    p.write_text("\n")
    with pytest.raises(ValueError):
        tables.read_patterns(spark, str(p))
    p.write_text("Run\tFolder\tParameters\n1\ttag\tk=1, m=a\nbad\tx\t\n2\t/abs\t\n")
    runs = {r.run: (r.folder, r.params) for r in tables.read_run_summary(spark, str(p), "/out", "pre_").collect()}
    assert runs[1] == ("/out/pre_tag", {"k": "1", "m": "a"}) and runs[2][0] == "/abs" and len(runs) == 2
    a, b = tmp_path / "a", tmp_path / "b"
    a.write_text("k\told\nj\tx\ty\n")
    b.write_text("k\tnew\nbroken\n")
    assert {r.key: r.value for r in tables.read_dim_cache(spark, [str(a), str(b)]).collect()} == {"k": "new", "j": "x\ty"}


def test_xml_files(spark, tmp_path):
    p = tmp_path / "t.xml"
    p.write_text(
        "<TaxaSet><Taxon><TaxId>7</TaxId><ScientificName>A b</ScientificName><Rank>species</Rank><AkaTaxIds><TaxId>8</TaxId></AkaTaxIds>"
        "<LineageEx><Taxon><TaxId>1</TaxId><ScientificName>Fam</ScientificName><Rank>family</Rank></Taxon></LineageEx></Taxon>"
        "<Taxon><TaxId>9</TaxId><ScientificName>Gen</ScientificName><Rank>genus</Rank></Taxon></TaxaSet>"
    )
    got = {r.taxid: (r.family, r.genus) for r in xml.read_taxa(spark, str(p)).collect()}
    assert got == {"7": ("Fam", "-"), "8": ("Fam", "-"), "9": ("-", "Gen")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a;k=Red", "ACGTACGT"), (2, "b;k=red", "AC"), (3, "c", "GG")], "ord int, header string, seq string")
    out = str(tmp_path / "f")
    assert K.write_fasta(df, out, cols=3)
    assert sorted(recs(fasta.read_fasta(spark, out))) == [("a;k=Red", "ACGTACGT"), ("b;k=red", "AC"), ("c", "GG")]
    assert not K.write_fasta(df.filter("false"), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    from ampliq.functions.headers import header_field

    K.write_split(df, header_field("header", ";", "k"), str(tmp_path / "s"))
    assert sorted(d.name for d in (tmp_path / "s").iterdir() if d.is_dir()) == ["name=Red", "name=no_field", "name=red_2"]
    prog = str(tmp_path / "p")
    assert K.read_progress(spark, prog).count() == 0
    row = spark.createDataFrame([(0, "f", "o", "k=1", 5, True)], K.PROGRESS)
    K.append_progress(row, prog)
    plan = spark.createDataFrame([(0,), (1,)], "idx int")
    assert [r.idx for r in remaining_combinations(plan, K.read_progress(spark, prog), ["idx"]).collect()] == [1]
    dim = str(tmp_path / "d")
    for value in ("x", "y"):
        K.append_dim(spark.createDataFrame([("k", value), ("n", "-")], "key string, value string"), dim, negative="-")
    assert [(r.key, r.value) for r in spark.read.parquet(dim).collect()] == [("k", "x")]
    K.write_report(df.select("header", F.lit(None).cast("string").alias("e")), str(tmp_path / "r"))


def test_written_reads_are_in_more_files_the_more_they_are(spark, tmp_path):
    fx = Fixtures(spark, SF)
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "16k")
    try:
        files._write_fastq(fx, str(tmp_path / "out"))
    finally:
        spark.conf.set(name, before)
    assert len(list((tmp_path / "out").rglob("*.gz"))) > 4
    scan = fastq.read_fastq(spark, str(tmp_path / "out"), suffixes=".txt.gz")
    assert fastq.reads(scan).count() == fx.reads.filter("seq <> ''").count()


def test_an_identification_table_of_several_files(spark, monkeypatch):
    made = []
    monkeypatch.setattr(files, "ID_ROWS", 1000)
    monkeypatch.setattr(files, "_folder", lambda fx, name: made.append(scratch_folder(spark, name)) or made[0])
    out = QUERIES["src13_id_table"](spark, SF)
    want = Fixtures(spark, SF).hits.select("query_name", "p_identity", "s_organism")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    assert len(list(Path(made[0].removeprefix("file:")).glob("*.tsv"))) > 3
