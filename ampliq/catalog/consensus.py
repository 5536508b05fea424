"""Consensus, mixtures, barcode checks and whole phases."""

import re
from dataclasses import replace

from pyspark.sql import functions as F

from ..functions.headers import header_field, sample_of_header
from ..operators import consensus as C
from ..operators.counts import count_sums
from ..operators.nearest import nearest_refs
from ..operators import runs as R
from ..plans import phases as P
from ..plans.sweep import run_sweep
from ..session import cut, scratch_folder
from .reads import PARAMS
from .registry import query
from .scalars import _FRAMES, _FRAMES5

_COLS = """p AS (SELECT sample, i AS pos, substr(aln,cast(i AS int),1) AS b FROM (SELECT sample, aln, unnest(range(1,length(aln)+1)) AS i FROM fx_aln) u),
  c AS (SELECT sample, pos, b, count(*) AS n FROM p GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY sample, pos) AS tot FROM c)"""


def _calls(t, strict=False):
    many = "'N'" if strict else "CASE WHEN kk=1 THEN bb ELSE 'N' END"
    return f"""f AS (SELECT sample, pos, max(tot) AS tot, count(*) FILTER (n/tot>{t}) AS k, count(*) FILTER (n/tot>{t} AND b<>'-') AS kk, max(b) FILTER (n/tot>{t} AND b<>'-') AS bb, max(b) FILTER (n/tot>{t}) AS ba FROM t GROUP BY 1,2),
     cs AS (SELECT sample, max(tot) AS reads, string_agg(CASE WHEN k=0 THEN 'N' WHEN k=1 THEN ba ELSE {many} END,'' ORDER BY pos) AS aligned FROM f GROUP BY 1)"""


@query("a03_consensus", f"WITH {_COLS}, {_calls(0.3)} SELECT sample, cast(reads AS bigint) AS reads, aligned, replace(aligned,'-','') AS seq FROM cs")
def _(fx):
    return C.consensus(fx.aln, 0.3, 5)


@query("a04_strict_consensus", f"WITH {_COLS}, {_calls(0.08, True)} SELECT sample, aligned FROM cs")
def _(fx):
    return C.consensus(fx.aln, 0.08, 5, strict=True).select("sample", "aligned")




def _sweep(thresholds):
    """Consensus of each sample at each threshold."""
    return " UNION ALL ".join(
        f"SELECT cast({t} AS double) AS threshold, sample, replace(string_agg(CASE WHEN k=0 THEN 'N' WHEN k=1 THEN ba WHEN kk=1 THEN bb ELSE 'N' END,'' ORDER BY pos),'-','') AS seq FROM (SELECT sample, pos, count(*) FILTER (n/tot>{t}) AS k, count(*) FILTER (n/tot>{t} AND b<>'-') AS kk, max(b) FILTER (n/tot>{t} AND b<>'-') AS bb, max(b) FILTER (n/tot>{t}) AS ba FROM t GROUP BY 1,2) f GROUP BY sample"
        for t in thresholds
    )


@query(
    "a05_consensus_sweep",
    f"WITH {_COLS}, s AS ({_sweep((0.5, 0.4, 0.2))}) SELECT sample, min(seq) AS seq FROM (SELECT DISTINCT sample, seq FROM s WHERE NOT contains(seq,'N') AND seq<>'') d GROUP BY sample HAVING count(*)=1",
)
def _(fx):
    return C.consensus_sweep(count_sums(fx.aln), C.sweep_steps(0.2, 0.5, 0.1, 0.3), 0, 0, 0)


_POLY = f"""{_COLS}, r AS (SELECT sample, pos, n, tot, row_number() OVER (PARTITION BY sample, pos ORDER BY n DESC) AS k FROM t WHERE b NOT IN ('-','N')),
   y AS (SELECT sample, pos, n, tot FROM r WHERE k=2 AND n/tot>=0.2 AND tot>=4), z AS (SELECT sample, pos-1 AS pos, n AS second, cast(tot AS bigint) AS n, count(*) OVER (PARTITION BY sample) AS c FROM y)"""


@query("a06_polymorphic_columns", f"WITH {_POLY} SELECT sample, pos, second, n FROM z WHERE c>=2")
def _(fx):
    return C.polymorphic_columns(count_sums(fx.aln), 0.2)


@query("a07_haplotypes")
def _(fx):
    return C.haplotypes(fx.aln)


@query("a08_choose_haplotype")
def _(fx):
    return C.choose_haplotype(C.haplotypes(fx.aln), 0, 0, 0)


@query(
    "a09_length_modes",
    """WITH b AS (SELECT truth AS sample, length(seq)//10 AS bin, count(*) AS n FROM fx_reads GROUP BY 1,2), t AS (SELECT sample, sum(n) AS reads, arg_max(bin, n*100000-bin) AS b1 FROM b GROUP BY 1 HAVING sum(n)>=10),
     s AS (SELECT b.sample, reads, b1, arg_max(bin, n*100000-bin) AS b2, max(n) AS n2 FROM b JOIN t ON t.sample=b.sample WHERE abs(bin-b1)>=3 GROUP BY 1,2,3)
    SELECT sample, cast(reads AS bigint) AS reads, b1*10 AS mode1, b2*10 AS mode2, n2/reads AS share2 FROM s WHERE n2/reads>=0.2""",
)
def _(fx):
    return C.length_modes(fx.reads.select(F.col("truth").alias("sample"), "seq"))


@query(
    "a10_estimate_gaps",
    f"""WITH {_COLS}, {_calls(0.5, True)}, e AS (SELECT a.sample, a.read_id, list_sum(list_transform(list_zip(string_split(aln,''),string_split(aligned,'')), lambda p: CASE WHEN (p[1]='-')<>(p[2]='-') THEN 1 ELSE 0 END)) AS g FROM fx_aln a JOIN cs ON cs.sample=a.sample WHERE aln<>'')
    SELECT sample, read_id, g AS estgaps, g=0 AS good FROM e""",
)
def _(fx):
    return C.estimate_gaps(fx.aln, ["sample"]).select("sample", "read_id", F.col("estgaps").cast("bigint").alias("estgaps"), "good")


@query(
    "win3_subset_by_length",
    """SELECT * FROM (SELECT truth AS sample, read_id, row_number() OVER (PARTITION BY truth ORDER BY abs(length(seq)-400), cast(read_id AS varchar), md5(seq)) AS rn FROM fx_reads WHERE abs(length(seq)-400)<=300) t WHERE rn<=40""",
)
def _(fx):
    reads = fx.reads.select(F.col("truth").alias("sample"), "read_id", "seq")
    return C.subset_by_length(reads, 400, 300, 40).select("sample", "read_id", "rn")


@query("f09_length_window", "SELECT read_id FROM fx_reads WHERE abs(length(seq)-400)<=150")
def _(fx):
    return fx.reads.filter(F.abs(F.length("seq") - 400) <= 150).select("read_id")


@query(
    "f11_qc_noncoding",
    "SELECT ord, seq<>'' AND NOT contains(seq,'N') AS ok FROM fx_runs",
)
def _(fx):
    return C.qc_barcode(fx.runs, 0, 0, 0).select("ord", "ok")


@query(
    "f11_qc_coding",
    f"""WITH {_FRAMES5}, best AS (SELECT ord, arg_max(f, aa*10-frame) AS f, max(aa) AS aa, any_value(seq) AS seq FROM orfs GROUP BY ord),
     q AS (SELECT ord, seq, CASE WHEN aa*3>=length(seq)-2 THEN seq ELSE left(f,aa*3) END AS orf, seq<>'' AND NOT contains(seq,'N') AND abs(length(seq)-60)<=60 AND aa*3>=length(seq)*0.95 AS ok FROM best)
    SELECT ord, CASE WHEN ok THEN orf ELSE seq END AS seq, ok FROM q""",
)
def _(fx):
    return C.qc_barcode(fx.runs, 5, 60, 60).select("ord", "seq", "ok")


_VT = """v AS (SELECT run, ord, regexp_replace(split_part(header,';',1),'_var[0-9]+$','') AS sample, cast(right(cast(ord AS varchar),1) AS int) AS rank, cast(regexp_extract(header,';coverage=([0-9]+)',1) AS bigint) AS size,
    cast(regexp_extract(header,';frac=([0-9.]+)',1) AS double) AS frac, cast(regexp_extract(header,';Ns=([0-9]+)',1) AS bigint) AS n_n, try_cast(regexp_extract(header,';div=([^;%]*)',1) AS double)/100.0 AS div FROM fx_vars),
   q AS (SELECT *, row_number() OVER (PARTITION BY sample, frac>=0.2 AND size>=10 AND n_n=0 ORDER BY size DESC, ord) AS k FROM v)"""


@query(
    "f12_variant_tiers",
    f"""WITH {_VT} SELECT ord, CASE WHEN frac>=0.2 AND size>=10 AND n_n=0 AND k<=3 THEN 'quality' WHEN div>=0.03 AND frac>=0.1 AND size>=5 AND n_n<=2 THEN 'alert' WHEN div>=0.03 THEN 'trace' ELSE 'counted' END AS tier FROM q""",
)
def _(fx):
    h = lambda k: header_field("header", ";", k)
    variants = fx.vars.select(
        sample_of_header("header").alias("sample"), F.col("ord").alias("rank"), h("coverage").cast("bigint").alias("size"), h("frac").cast("double").alias("frac"),
        h("Ns").cast("bigint").alias("n_n"), (F.regexp_replace(h("div"), "%", "").try_cast("double") / 100.0).alias("divergence"), F.lit(None).cast("boolean").alias("translates"),
    )
    return C.variant_tiers(variants, coding=False).select(F.col("rank").alias("ord"), "tier")


@query(
    "ph7_genetic_code",
    "SELECT doc_id AS sample, coalesce(CASE WHEN quality=1 THEN 2 WHEN quality=0 THEN 11 END, 5) AS code FROM documents LEFT JOIN labels USING (doc_id)",
)
def _(fx):
    codes = fx.labels.select(F.col("doc_id").alias("sample"), F.when(F.col("quality") == 1, 2).otherwise(11).alias("code"))
    return C.with_genetic_code(fx.documents.select(F.col("doc_id").alias("sample")), codes, 5)


# -- chains ---------------------------------------------------------------------------------------


def _copies(fx):
    """Reads of a sample: its aligned copies without gaps, numbered."""
    return fx.aln.select("sample", "read_id", F.translate("aln", "-", "").alias("seq"), (F.col("read_id") % 10 + 1).cast("int").alias("rn"))


@query(
    "ph1_demultiplex",
    """SELECT cast(read_id AS varchar) AS read, truth AS sample FROM fx_reads WHERE length(seq)<422
    UNION ALL SELECT concat(read_id,'d',h), truth FROM fx_reads, (SELECT unnest(['p1','p2']) AS h) x WHERE length(seq) BETWEEN 361 AND 383""",
)
def _(fx):
    # Beside the reads as they are, products near the expected length ligated to themselves; a half then holds one of the two.
    one = fx.reads.withColumn("read_id", F.col("read_id").cast("string"))
    two = one.filter(F.length("seq").between(361, 383)).withColumn("read_id", F.concat("read_id", F.lit("d")))
    two = two.withColumn("seq", F.concat("seq", "seq")).withColumn("qual", F.concat("qual", "qual"))
    done = P.demultiplex(one.unionByName(two), fx.sheet, replace(PARAMS, tagmm=1, minlen=0, demlen=50, primermm=2))
    return done.select(F.substring_index("read_id", "_", 1).alias("read"), "sample")


@query("ph2_align_to_template", "SELECT sample, read_id, CASE WHEN length(aln)>0 THEN replace(aln,'-','') ELSE '' END AS letters FROM fx_aln")
def _(fx):
    aln = C.align_to_template(_copies(fx))
    return aln.select("sample", "read_id", F.translate("aln", "-", "").alias("letters"))


@query("ph3_call_consensus")
def _(fx):
    return P.call_aligned(fx.aln, P.CallParams(code=0))


@query("ph3_consensus_by_length")
def _(fx):
    reads = _copies(fx).drop("rn")
    return P.consensus_by_length(reads, P.CallParams(plen=400, window=100000, code=0))


# Labelled samples have ten more reads and a genetic code of their own; every sample's reads are ranked.
_RANKED = """g AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
  r AS (SELECT a.*, 1+a.read_id%10 AS rn FROM fx_aln a UNION ALL SELECT a.*, 11+a.read_id%10 FROM fx_aln a JOIN g ON g.doc_id=a.read_id//10),
  tot AS (SELECT sample, count(*) AS total, max(CASE quality WHEN 1 THEN 2 WHEN 0 THEN 5 ELSE 0 END) AS code FROM r LEFT JOIN g ON g.doc_id=read_id//10 GROUP BY 1),
  lv AS (SELECT unnest([20,10,5]) AS level),
  p AS (SELECT sample, rn, i AS pos, substr(aln,cast(i AS int),1) AS b FROM (SELECT sample, rn, aln, unnest(range(1,length(aln)+1)) AS i FROM r) u),
  c AS (SELECT sample, level, pos, b, count(*) AS n FROM p JOIN lv ON rn<=level GROUP BY ALL),
  t AS (SELECT *, sum(n) OVER (PARTITION BY sample, level, pos) AS tot FROM c)"""


def _at(th):
    return f"""SELECT sample, level, {th} AS th, max(tot) AS reads, replace(string_agg(CASE WHEN k=0 THEN 'N' WHEN k=1 THEN ba WHEN kk=1 THEN bb ELSE 'N' END,'' ORDER BY pos),'-','') AS seq
    FROM (SELECT sample, level, pos, max(tot) AS tot, count(*) FILTER (n/tot>{th}) AS k, count(*) FILTER (n/tot>{th} AND b<>'-') AS kk, max(b) FILTER (n/tot>{th} AND b<>'-') AS bb, max(b) FILTER (n/tot>{th}) AS ba FROM t GROUP BY 1,2,3) f GROUP BY 1,2"""


_ORFS = re.sub(r"\bord\b", "sample, level, th, code", _FRAMES.split("codons AS")[0]).replace("fx_runs", "called") + """codons AS (SELECT sample, level, th, code, seq, frame, f, regexp_extract_all(f,'[A-Z][A-Z][A-Z]') AS c FROM frames WHERE code<>0),
  orfs AS (SELECT sample, level, th, seq, frame, f, coalesce(list_min(list_filter(list_transform(c, lambda x, i: CASE WHEN x IN ('TAA','TAG','TAR') OR code=2 AND x IN ('AGA','AGG','AGR') THEN i END), lambda x: x IS NOT NULL))-1, length(c)) AS aa FROM codons),
  best AS (SELECT sample, level, th, arg_max(f, aa*10-frame) AS f, max(aa) AS aa FROM orfs GROUP BY ALL)"""


@query(
    "ph3_levels",
    f"""WITH {_RANKED}, called AS (SELECT u.*, code FROM ({_at(0.3)} UNION ALL {_at(0.2)}) u JOIN tot USING (sample)), {_ORFS},
  q AS (SELECT c.*, c.seq<>'' AND NOT contains(c.seq,'N') AND (code=0 OR abs(length(c.seq)-60)<=60 AND aa*3>=length(c.seq)*0.95) AS ok, CASE WHEN aa*3>=length(c.seq)-2 THEN c.seq ELSE left(f,aa*3) END AS orf FROM called c LEFT JOIN best USING (sample, level, th)),
  w AS (SELECT *, CASE WHEN ok AND code<>0 THEN orf ELSE seq END AS barcode FROM q),
  d AS (SELECT a.sample, a.level, a.reads, a.ok AND a.reads>=5 AS ok, b.ok AND b.reads>=5 AND NOT (a.ok AND a.reads>=5) AS swept, CASE WHEN a.reads>=5 THEN a.barcode ELSE '' END AS seq, b.barcode AS other FROM w a JOIN w b ON a.sample=b.sample AND a.level=b.level AND a.th=0.3 AND b.th=0.2),
  tried AS (SELECT d.*, d.ok OR swept AS good, max(d.ok OR swept) OVER (PARTITION BY d.sample ORDER BY level DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS settled FROM d JOIN tot USING (sample) WHERE level=20 OR total>level)
  SELECT sample, level, cast(reads AS bigint) AS reads, CASE WHEN swept THEN other ELSE seq END AS seq, good AS ok, CASE WHEN swept THEN 'sweep' ELSE 'threshold' END AS how, CASE WHEN reads<5 THEN 'NA' WHEN good THEN 'good' ELSE 'failed' END AS status
  FROM tried WHERE NOT coalesce(settled, false) QUALIFY row_number() OVER (PARTITION BY sample ORDER BY level)=1""",
)
def _(fx):
    codes = fx.labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    aln = fx.aln.withColumn("doc_id", F.floor(F.col("read_id") / 10)).withColumn("rn", (F.col("read_id") % 10 + 1).cast("int"))
    more = aln.join(codes, "doc_id").withColumn("rn", F.col("rn") + 10)
    aln = aln.unionByName(more.drop("quality"))
    own = more.filter("rn = 11 and quality is not null").select("sample", F.when(F.col("quality") == 1, 2).otherwise(5).alias("code"))
    coverage = aln.groupBy("sample").agg(F.count(F.lit(1)).alias("reads"))
    p = P.CallParams(plen=60, tol=60, code=0, levels=(20, 10, 5), low=0.2, high=0.2, resolve=False)
    return P.call_levels(aln, coverage, p, own).select("sample", "level", "reads", "seq", "ok", "how", "status")


@query("ph3_levels_mixed")
def _(fx):
    reads = _copies(fx).drop("rn")
    codes = fx.labels.select(F.concat(F.lit("S"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("sample"), F.when(F.col("quality") == 1, 2).otherwise(5).alias("code")).distinct()
    return P.consensus_by_length(reads, P.CallParams(plen=400, window=100000, code=0, tol=400, levels=(10, 7, 5)), codes.dropDuplicates(["sample"]))


@query("ph4_check_set")
def _(fx):
    reads = fx.runs.select(F.concat_ws("_", "sample", F.col("run").cast("string")).alias("sample"), "seq", (~F.contains("seq", F.lit("N")) & (F.length("seq") > 0)).alias("ok"))
    return P.check_set(reads)


def _first_copies(fx):
    return fx.runs.filter("run = 1").select("sample", "seq").filter("seq <> ''")


@query("j09_similar_reads")
def _(fx):
    reads = fx.runs.select("sample", F.col("ord").cast("string").alias("read_id"), "seq")
    return C.similar_reads(reads, _first_copies(fx), 400, 2).select("sample", "read_id", "dist", "rn")


@query("ph5_consensus_by_similarity")
def _(fx):
    return P.consensus_by_similarity(_copies(fx).drop("rn"), _first_copies(fx), P.CallParams(plen=400, code=0))


@query("j08_nearest_refs")
def _(fx):
    queries = fx.runs.filter("run = 3").select(F.col("sample").alias("id"), "seq")
    refs = fx.runs.filter("run < 3").select(F.concat_ws("_", "sample", F.col("run").cast("string")).alias("name"), "seq")
    return nearest_refs(queries, refs, 5)


@query("ph8_final_lists")
def _(fx):
    # The check of the set asks for them as well as the lists.
    calls = cut(P.call_aligned(fx.aln, P.CallParams(code=0)))
    return P.final_lists(calls, P.check_set(calls))


@query(
    "ph9_sweep_thresholds",
    f"WITH {_COLS}, s AS ({_sweep((0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7))}) SELECT threshold, sample, seq, NOT contains(seq,'N') AS ok FROM s",
)
def _(fx):
    combos = fx.lineitem.select((F.col("l_linenumber") / 10).alias("threshold")).distinct()
    swept = P.sweep_thresholds(count_sums(fx.aln), combos, 0, 0, 0)
    return swept.select("threshold", "sample", "seq", "ok")


@query(
    "ph9_sweep",
    """WITH v AS (SELECT minlen, freq, (row_number() OVER (ORDER BY minlen, freq)-1)::INT AS idx FROM (SELECT unnest([100,200]) AS minlen) a, (SELECT unnest([0.3::DOUBLE,0.6::DOUBLE]) AS freq) b)
    SELECT idx, cast(minlen AS double) AS minlen, freq, truth AS sample, count(*) AS coverage FROM fx_reads JOIN v ON length(seq)>minlen WHERE length(seq)<422 GROUP BY ALL""",
)
def _(fx):
    lists = [("minlen", "100", 1), ("minlen", "200", 2), ("consfreqfixed", "0.3", 1), ("consfreqfixed", "0.6", 2)]
    grid = R.expand_grid(fx.spark.createDataFrame(lists, "key string, value string, pos int"), ["minlen", "consfreqfixed"])
    combos = grid.select((2 * (F.col("place.p0") - 1) + F.col("place.p1") - 1).cast("int").alias("idx"), "minlen", "consfreqfixed")
    path = scratch_folder(fx.spark, "sweep")
    one = fx.reads.withColumn("read_id", F.col("read_id").cast("string"))
    base = replace(PARAMS, tagmm=1, minlen=0, demlen=50, primermm=2)
    calls = P.CallParams(plen=300, window=300, coverage=10, code=0, resolve=False)
    # Stopped inside the first of two demultiplexings, then taken up again.
    run_sweep(one, fx.sheet, combos, path, base, calls, most=1)
    done = run_sweep(one, fx.sheet, combos, path, base, calls)
    return done.join(combos, "idx").select("idx", "minlen", F.col("consfreqfixed").alias("freq"), "sample", "coverage")
