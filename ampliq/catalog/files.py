"""File round trips: views written with the sinks into the shared folder and read back with the sources."""

import gzip
from itertools import groupby

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..session import scratch_folder
from ..sinks import writers as K
from ..sources import fasta, fastq, tables
from ..streaming import reads as S
from .registry import query

#: Rows, about, of a file of identifications.
ID_ROWS = 100_000


def _folder(fx, name):
    return scratch_folder(fx.spark, name)


@query("src01_fasta", "SELECT header, seq FROM fx_runs")
def _(fx):
    path = _folder(fx, "fasta")
    K.write_fasta(fx.runs, path, cols=60)
    return fasta.read_fasta(fx.spark, path).select("header", "seq")


@query("src02_alignment", "SELECT cast(read_id AS varchar) AS header, aln AS seq FROM fx_aln")
def _(fx):
    path = _folder(fx, "aln")
    # Letters of every other read are written as reverse-strand ones.
    seq = F.when(F.col("read_id") % 2 == 1, F.translate("aln", "AGCT", "EFQP")).otherwise(F.col("aln"))
    K.write_fasta(fx.aln.select(F.col("read_id").cast("string").alias("header"), F.lower(seq).alias("seq")), path)
    return fasta.read_alignment(fx.spark, path).select("header", "seq")


def _write_fastq(fx, path):
    """Files of four groups, in a folder for each pair of groups; as a compressed file is read by one task, a group has as many as its bytes ask for."""
    group = F.col("read_id") % 4
    record = F.concat_ws("\n", F.concat(F.lit("@"), F.col("read_id").cast("string"), F.lit(" x")), "seq", F.lit("+"), "qual")
    records = fx.reads.filter("seq <> ''").select(F.concat(F.lit("g"), F.floor(group / 2).cast("string")).alias("g"), group.alias("part"), record.alias("value"))
    records.hint("rebalance", "part").select("value", "g").write.partitionBy("g").option("compression", "gzip").text(path)


@query("src03_fastq", "SELECT cast(read_id AS varchar) AS read_id, seq, qual, concat('g=g', cast(floor((read_id%4)/2) AS int)) AS grp FROM fx_reads WHERE seq<>''")
def _(fx):
    path = _folder(fx, "fastq")
    _write_fastq(fx, path)
    scan = fastq.read_fastq(fx.spark, path, suffixes=".txt.gz")
    return fastq.with_path_group(fastq.reads(scan), path).select("read_id", "seq", "qual", "grp")


def _write_files(rows, root):
    """A file for each ``name`` of rows (name, at, data), its bytes in the order of ``at``; a file's rows pass through one task one by one."""

    def write(batches):
        name, out = None, None
        for batch in batches:
            rows = zip(batch.column("name").to_pylist(), batch.column("data").to_pylist())
            for own, part in groupby(rows, lambda row: row[0]):
                if own != name:
                    if out is not None:
                        out.close()
                    name = own
                    system, inside = fastq.open_fs(f"{root}/{name}")
                    system.create_dir(inside.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(inside, compression=None)
                out.write(b"".join(data for _, data in part))
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["name"])

    rows.repartition("name").sortWithinPartitions("name", "at").mapInArrow(write, "name string").count()


@arrow_udf(T.BinaryType())
def _member(text):
    """Each text as a gzip stream of its own; such streams can follow each other in a file."""
    return pa.array([gzip.compress(t.encode(), 1, mtime=0) for t in text.to_pylist()], pa.binary())


def _write_damaged(fx, root):
    """A whole file, one whose last record is cut short, one that breaks in mid-stream and one that ends inside a stream.

    Of the third the reads of every other group of four stand before the damage
    and the others behind it.
    """
    kind = F.get(F.array(*[F.lit(n) for n in ("whole.fastq.gz", "short.fastq", "broken.fastq.gz", "cut.fastq.gz")]), (F.col("read_id") % 4).cast("int"))
    lines = F.concat(F.lit("@"), F.col("read_id").cast("string"), F.lit("\n"), "seq", F.lit("\n+\n"), "qual", F.lit("\n"))
    behind = ((F.col("read_id") % 4 == 2) & (F.floor(F.col("read_id") / 4) % 2 == 1)).cast("int")
    text = fx.reads.select(kind.alias("name"), F.struct(behind.alias("a"), F.col("read_id").alias("b")).alias("at"), lines.alias("t"))
    data = F.when(F.col("name") == "short.fastq", F.col("t").cast("binary")).otherwise(_member("t"))
    last, middle = (1 << 62), -1
    odd = [("short.fastq", (2, last), b"@half\nACG"), ("broken.fastq.gz", (1, middle), b"these bytes are no gzip stream"), ("cut.fastq.gz", (2, last), gzip.compress(b"@late\n" + b"ACGT" * 900 + b"\n+\n" + b"I" * 3600 + b"\n")[:30])]
    extra = fx.spark.createDataFrame(odd, "name string, at struct<a: int, b: bigint>, data binary")
    _write_files(text.select("name", "at", data.alias("data")).unionByName(extra), root)


_GOOD = "SELECT cast(read_id AS varchar) AS item, 'read' AS kind FROM fx_reads WHERE NOT (read_id%4=2 AND (read_id//4)%2=1)"


@query("src04_damaged_fastq", f"{_GOOD} UNION ALL SELECT 'broken.fastq.gz', 'damaged' UNION ALL SELECT 'cut.fastq.gz', 'early end'")
def _(fx):
    path = _folder(fx, "damaged")
    _write_damaged(fx, path)
    scan = fastq.read_fastq(fx.spark, path, split_bytes=100_000)
    issues = fastq.read_issues(scan).select(
        F.substring_index("file", "/", -1).alias("item"), F.when(F.contains("issue", F.lit("ends early")), "early end").when(F.contains("issue", F.lit("damaged")), "damaged").otherwise(F.col("issue")).alias("kind")
    )
    return fastq.reads(scan).select(F.col("read_id").alias("item"), F.lit("read").alias("kind")).unionByName(issues)


@query("st02_stream_damaged", _GOOD)
def _(fx):
    path = _folder(fx, "damaged-stream")
    _write_damaged(fx, path)
    live = fastq.reads(S.stream_fastq(fx.spark, path, files_per_batch=1, split_bytes=100_000))
    return S.run_to_table(live.select(F.col("read_id").alias("item"), F.lit("read").alias("kind")), "append")


@query(
    "src07_sample_sheet",
    "SELECT sample, tag_f, tag_r, primer_f, primer_r FROM fx_sheet",
)
def _(fx):
    path = _folder(fx, "sheet")
    row = F.concat_ws(",", "sample", F.lower("tag_f"), F.concat(F.lit(" "), "tag_r"), "primer_f", "primer_r")
    fx.sheet.select(F.concat(row, F.lit("\n,,")).alias("value")).write.text(path)
    sheet = tables.read_sample_sheet(fx.spark, path)
    return sheet.select("sample", "tag_f", "tag_r", F.get("primers", F.lit(0)).alias("primer_f"), F.get("primers", F.lit(1)).alias("primer_r"))


@query(
    "src08_hits",
    "SELECT query_name, acc, cast(p_identity AS double) AS p_identity, s_order, s_organism FROM fx_hits",
)
def _(fx):
    path = _folder(fx, "hits")
    names = {"query_name": "Query_name ", "acc": "Accession", "p_identity": "P_identity", "s_order": "Subject_Order", "s_family": "Subject_Family", "s_genus": "Subject_Genus", "s_organism": "Subject_organism"}
    text = fx.hits.select(*[F.col(c).cast("string").alias(n) for c, n in names.items()])
    K.write_report(text.withColumn("P_identity", F.translate("P_identity", ".", ",")), path)
    hits = tables.read_hits(fx.spark, path)
    return hits.select("query_name", F.col("acc" if "acc" in hits.columns else "Accession").alias("acc"), "p_identity", "s_order", "s_organism")


@query("src12_taxonomy_file", "SELECT sample, min(q_order) AS q_order, min(q_organism) AS q_organism FROM fx_ctax GROUP BY 1")
def _(fx):
    path = _folder(fx, "tax")
    tax = fx.ctax.select(F.lit("1").alias("plate"), F.col("sample").alias("Code"), "q_order", "q_family", "q_genus", "q_organism")
    K.write_report(tax.unionByName(tax.withColumn("q_order", F.lit("later")).filter("false")), path)
    return tables.read_taxonomy(fx.spark, path).select("sample", "q_order", "q_organism")


@query("src13_id_table", "SELECT query_name AS query, p_identity AS identity, s_organism AS organism FROM fx_hits")
def _(fx):
    path = _folder(fx, "ids")
    row = F.concat_ws("\t", "query_name", F.concat(F.col("p_identity").cast("string"), F.lit("%")), "s_organism")
    # The search gives its results in several files, each with the title and header of its own.
    n_files = 1 + fx.lineitem.count() // ID_ROWS
    head = [((0, str(k)), t.encode() + b"\r\n") for k, t in enumerate(["Results of a search", "", "Query ID\tID%\tOrganism\t"])]
    heads = fx.spark.range(n_files).crossJoin(fx.spark.createDataFrame(head, "at struct<a: int, b: string>, data binary"))
    at = F.struct(F.lit(1).alias("a"), F.col("acc").alias("b")).alias("at")
    rows = fx.hits.select(F.pmod(F.xxhash64("query_name", "acc"), F.lit(n_files)).alias("id"), at, F.concat(row, F.lit("\r\n")).cast("binary").alias("data"))
    name = F.format_string("ids%s.tsv", F.col("id").cast("string")).alias("name")
    _write_files(rows.unionByName(heads).select(name, "at", "data"), path)
    return tables.read_id_table(fx.spark, path).select(F.col("Query ID").alias("query"), F.col("ID%").alias("identity"), F.col("Organism").alias("organism"))


@query("src14_runs", "SELECT concat('run_', run) AS run, header, seq FROM fx_runs WHERE run<3")
def _(fx):
    path = _folder(fx, "runs")
    record = F.concat(F.lit(">"), "header", F.lit("\r\n"), "seq", F.lit("\r\n")).cast("binary")
    # Run 3 lies a level too deep, and every run has a file of another name.
    at = F.concat(F.when(F.col("run") == 3, "deep/").otherwise(""), F.lit("run_"), F.col("run").cast("string"), F.lit("/"))
    rows = fx.runs.select(F.concat(at, F.lit("consensus_filtered.fa")).alias("name"), F.col("ord").alias("at"), record.alias("data"))
    other = fx.runs.select(F.concat(at, F.lit("consensus_all.fa")).alias("name"), F.col("ord").alias("at"), record.alias("data"))
    _write_files(rows.unionByName(other), path)
    return fasta.read_runs(fx.spark, path).select("run", "header", "seq")


@query("src16_pattern_file", "SELECT DISTINCT trim(p) AS pattern FROM (SELECT unnest(string_split(text, chr(10))) AS p FROM documents) t WHERE trim(p)<>''")
def _(fx):
    path = _folder(fx, "patterns")
    fx.documents.select(F.col("text").alias("value")).write.text(path)
    return tables.read_patterns(fx.spark, path).distinct()


@query("src17_lookup_file", "SELECT concat('X', p_partkey) AS id, concat(upper(substr(p_brand,1,1)), substr(p_brand,2), '|', p_type) AS fields FROM part")
def _(fx):
    path = _folder(fx, "lookup")
    rows = fx.part.select(F.concat(F.lit("X"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("a"), F.lit(None).cast("string").alias("b"), F.col("p_type").alias("c"))
    K.write_report(rows, path)
    return tables.read_lookup(fx.spark, path).select("id", F.array_join("fields", "|").alias("fields"))


@query("snk4_report", "SELECT cast(c_custkey AS varchar) AS k, c_name AS name, CASE WHEN c_nationkey%3=0 THEN NULL ELSE c_mktsegment END AS segment FROM customer")
def _(fx):
    path = _folder(fx, "report")
    K.write_report(fx.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.when(F.col("c_nationkey") % 3 != 0, F.col("c_mktsegment")).alias("segment")), path)
    return fx.spark.read.schema("k string, name string, segment string").csv(path, sep="\t", header=True)


@query("snk5_progress", "SELECT p_partkey AS idx, CASE WHEN p_size>25 THEN 'again' ELSE 'first' END AS folder FROM part")
def _(fx):
    path = _folder(fx, "progress")
    done = fx.part.select(
        F.col("p_partkey").cast("int").alias("idx"), F.lit("first").alias("folder"), F.lit("o").alias("outpath"), F.col("p_type").alias("parameters"), F.lit(1).cast("long").alias("n_filtered"), F.lit(True).alias("variants")
    )
    K.append_progress(done, path)
    K.append_progress(done.join(fx.part.filter("p_size > 25").select(F.col("p_partkey").cast("int").alias("idx")), "idx").withColumn("folder", F.lit("again")), path)
    return K.read_progress(fx.spark, path).select("idx", "folder")


@query("st02_stream_fastq", "SELECT cast(read_id AS varchar) AS read_id, seq, qual FROM fx_reads WHERE seq<>''")
def _(fx):
    path = _folder(fx, "stream")
    _write_fastq(fx, path)
    live = fastq.reads(S.stream_fastq(fx.spark, path, files_per_batch=2, pattern="*.txt.gz"))
    return S.run_to_table(live.select("read_id", "seq", "qual"), "append")
