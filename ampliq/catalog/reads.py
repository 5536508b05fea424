"""Reads: filters, statistics and demultiplexing, and parsers over text that the tables give."""

from pyspark.sql import functions as F

from ..functions.seq import mean_q
from ..operators import reads as R
from ..sinks import writers as K
from ..sources import tables as T
from ..sources import xml as X
from .registry import query

PARAMS = R.ReadParams(
    minlen=120, explen=300, demlen=80, taglen=13, primers_f=("ATGTCACCACAAACAGAGACTAAAGC",), primers_r=("GTAAAATCAAGTCCACCRCG",), window=100, primermm=5
)
_L = PARAMS.product
_Q = "round(-10*log10(avg(pow(10,-(ascii(c)-33)/10.0))),9)"


@query("f01_min_length", "SELECT read_id FROM fx_reads WHERE length(seq)>250")
def _(fx):
    return R.filter_reads(fx.reads, 250).select("read_id")


_QCTE = f"q AS (SELECT read_id, {_Q} AS q FROM (SELECT read_id, unnest(string_split(qual,'')) AS c FROM fx_reads) u GROUP BY 1)"


@query(
    "f02_min_quality",
    f"""WITH long AS MATERIALIZED (SELECT read_id, qual FROM fx_reads WHERE length(seq)>250), q AS (SELECT read_id, {_Q} AS q FROM (SELECT read_id, unnest(string_split(qual,'')) AS c FROM long) u GROUP BY 1)
    SELECT read_id FROM q WHERE q>=12.5""",
)
def _(fx):
    return R.filter_reads(fx.reads, 250, 12.5).select("read_id")


_KIND = f"CASE WHEN length(seq)<{_L + 80} THEN 'single' WHEN length(seq)>{2 * _L - 80} AND length(seq)<{2 * (_L + 80)} THEN 'double' ELSE 'wrong' END"


@query("f03_classify_length", f"SELECT read_id, {_KIND} AS kind FROM fx_reads")
def _(fx):
    return R.classify_length(fx.reads, PARAMS).select("read_id", "kind")


@query(
    "f04_split_ligated",
    f"""WITH k AS (SELECT read_id, seq, {_KIND} AS kind FROM fx_reads)
    SELECT cast(read_id AS varchar) AS read_id, seq FROM k WHERE kind='single' UNION ALL SELECT concat(read_id,'p1'), substr(seq,1,{_L + 80}) FROM k WHERE kind='double'
    UNION ALL SELECT concat(read_id,'p2'), substr(seq,{_L - 80 + 1}) FROM k WHERE kind='double'""",
)
def _(fx):
    return R.split_ligated(R.classify_length(fx.reads, PARAMS), PARAMS).select("read_id", "seq")


@query(
    "a01_read_funnel",
    f"""WITH {_QCTE}, k AS (SELECT CASE WHEN length(seq)<=120 THEN 'short' WHEN q.q<11.5 THEN 'low' ELSE {_KIND} END AS s FROM fx_reads r LEFT JOIN q ON q.read_id=r.read_id)
    SELECT count(*) AS total, count(*) FILTER (s='short') AS too_short, count(*) FILTER (s='low') AS low_quality, count(*) FILTER (s='single') AS single, count(*) FILTER (s='double') AS double,
     count(*) FILTER (s='wrong') AS wrong_length, count(*) FILTER (s='single')+2*count(*) FILTER (s='double') AS after_split FROM k""",
)
def _(fx):
    from dataclasses import replace

    return R.read_funnel(fx.reads, replace(PARAMS, minq=11.5))


@query(
    "a01_assigned_reads",
    f"""SELECT count(*) AS total, count(*) FILTER (n<{_L + 50}) AS single, count(*) FILTER (n<{_L + 50})+2*count(*) FILTER (n>{2 * _L - 50} AND n<{2 * (_L + 50)}) AS after_split, count(*) FILTER (n<{_L + 50}) AS assigned
    FROM (SELECT length(seq) AS n FROM fx_reads) t""",
)
def _(fx):
    from dataclasses import replace

    from ..plans.phases import demultiplex

    p = replace(PARAMS, tagmm=1, minlen=0, demlen=50, primermm=2)
    return R.read_funnel(fx.reads, p, demultiplex(fx.reads, fx.sheet, p)).select("total", "single", "after_split", "assigned")


_VALUES = f"""{_QCTE}, v AS (SELECT r.read_id, grp, length(seq) AS length, q.q, 100.0*length(regexp_replace(seq,'[^GC]','','g'))/length(seq) AS gc FROM fx_reads r JOIN q ON q.read_id=r.read_id)"""


@query(
    "a13_fastq_stats",
    f"""WITH {_VALUES}, s AS (SELECT length, row_number() OVER (ORDER BY length)-1 AS i, count(*) OVER () AS n, sum(length) OVER (ORDER BY length DESC ROWS UNBOUNDED PRECEDING) AS acc, sum(length) OVER () AS tot FROM v)
    SELECT count(*) AS reads, cast(sum(length) AS bigint) AS bases, round(avg(length),6) AS mean_length, median(length) AS median_length, min(length) AS min_length, max(length) AS max_length,
     (SELECT max(length) FROM s WHERE acc*2>=tot) AS n50, count(*) FILTER (length<500) AS lt500, count(*) FILTER (length BETWEEN 500 AND 1000) AS from500to1000, count(*) FILTER (length>1000) AS gt1000,
     round(avg(q),6) AS mean_q, round(100.0*count(*) FILTER (q>=10)/count(*),6) AS q10_pct, round(100.0*count(*) FILTER (q>=15)/count(*),6) AS q15_pct, round(100.0*count(*) FILTER (q>=20)/count(*),6) AS q20_pct,
     round(100.0*sum(CASE WHEN q>=10 THEN length ELSE 0 END)/sum(length),6) AS bases_q10_pct, round(100.0*sum(CASE WHEN q>=15 THEN length ELSE 0 END)/sum(length),6) AS bases_q15_pct, round(100.0*sum(CASE WHEN q>=20 THEN length ELSE 0 END)/sum(length),6) AS bases_q20_pct,
     round(avg(gc),6) AS mean_gc, round(stddev_samp(gc),6) AS std_gc, (SELECT length FROM s WHERE i=floor(n*0.01)) AS len_p01, (SELECT length FROM s WHERE i=least(n-1,floor(n*0.99))) AS len_p99 FROM v""",
)
def _(fx):
    return R.fastq_stats(fx.reads)


@query(
    "a14_fastq_histograms",
    f"""WITH {_VALUES}, s AS (SELECT length, row_number() OVER (ORDER BY length)-1 AS i, count(*) OVER () AS n FROM v),
     b AS (SELECT (SELECT length FROM s WHERE i=floor(n*0.01)) AS lo, (SELECT length FROM s WHERE i=least(n-1,floor(n*0.99))) AS hi)
    SELECT 'length' AS value, cast(least(floor((length-lo)/cast(hi-lo AS double)*60),59) AS int) AS bin, count(*) AS n FROM v, b WHERE length BETWEEN lo AND hi GROUP BY 2
    UNION ALL SELECT 'gc', cast(least(floor(gc/100.0*60),59) AS int), count(*) FROM v GROUP BY 2""",
)
def _(fx):
    return R.fastq_histograms(fx.reads).filter("value <> 'q'")


@query(
    "a14_quality_histogram",
    f"""WITH {_VALUES}, b AS (SELECT min(q) AS lo, max(q) AS hi FROM v)
    SELECT 'q' AS value, cast(least(floor((q-lo)/(hi-lo)*60),59) AS int) AS bin, count(*) AS n FROM v, b GROUP BY 2""",
)
def _(fx):
    return R.fastq_histograms(fx.reads).filter("value = 'q'")


@query(
    "a15_fastq_by_group",
    f"""WITH {_VALUES} SELECT grp, row_number() OVER (ORDER BY cast(substr(grp,4) AS bigint)) AS place, count(DISTINCT read_id%7) AS files, count(*) AS reads, cast(sum(length) AS bigint) AS bases,
     round(100.0*count(*)/sum(count(*)) OVER (),6) AS reads_pct, round(avg(length),6) AS mean_length, round(avg(q),6) AS mean_q, round(100.0*count(*) FILTER (q>=10)/count(*),6) AS q10_pct,
     round(100.0*sum(CASE WHEN q>=10 THEN length ELSE 0 END)/sum(length),6) AS bases_q10_pct FROM v GROUP BY grp""",
)
def _(fx):
    return R.fastq_by_group(fx.reads.withColumn("file", F.col("read_id") % 7))


@query("a16_sample_reads", f"WITH {_VALUES} SELECT read_id, length, round(q,4) AS q FROM v ORDER BY md5(cast(read_id AS varchar)), read_id LIMIT 10000")
def _(fx):
    return R.sample_reads(fx.reads, 10000).withColumn("q", F.round("q", 4))


@query(
    "j01_tag_variants",
    """WITH t AS (SELECT DISTINCT tag FROM (SELECT tag_f AS tag FROM fx_sheet UNION ALL SELECT tag_r FROM fx_sheet) u), x AS (SELECT tag, unnest(range(1,14)) AS i FROM t),
     y AS (SELECT tag, cast(i AS int) AS i, unnest(['A','C','G','T']) AS b FROM x),
     m AS (SELECT tag, concat(substr(tag,1,i-1),b,substr(tag,i+1)) AS v FROM y UNION ALL SELECT tag, concat(b,substr(tag,1,i-1),substr(tag,i+1)) FROM y WHERE i>1
       UNION ALL SELECT tag, CASE WHEN i<13 THEN concat(substr(tag,2,i-2),b,substr(tag,i)) ELSE concat(substr(tag,2),b) END FROM y WHERE i>1)
    SELECT tag AS variant, tag, 0 AS depth FROM t UNION ALL SELECT v, min(tag), 1 FROM m WHERE v NOT IN (SELECT tag FROM t) GROUP BY v HAVING min(tag)=max(tag)""",
)
def _(fx):
    return R.tag_variants(fx.sheet, 1)


@query(
    "j02_locate_primers",
    """WITH o AS (SELECT read_id, CASE WHEN read_id%2=1 THEN reverse(translate(seq,'ACGTRY','TGCAYR')) ELSE seq END AS s FROM fx_reads)
    SELECT read_id, left(s,13) AS tag_f, reverse(translate(right(s,13),'ACGTRY','TGCAYR')) AS tag_r, substr(s,40,length(s)-72) AS insert,
      CASE WHEN read_id%2=1 THEN '-' ELSE '+' END AS strand, 0 AS primer_dist FROM o""",
)
def _(fx):
    return R.locate_primers(fx.reads, PARAMS).select("read_id", "tag_f", "tag_r", "insert", "strand", "primer_dist")


@query("j03_assign_samples", "SELECT regexp_extract(cast(read_id AS varchar),'[0-9]+') AS read, truth AS sample FROM fx_reads")
def _(fx):
    located = R.locate_primers(fx.reads, PARAMS)
    assigned = R.assign_samples(located, R.tag_variants(fx.sheet, 1), fx.sheet)
    return assigned.select(F.substring_index("read_id", "_", 1).alias("read"), "sample")


@query("a02_sample_coverage", "SELECT truth AS sample, count(*) AS reads FROM fx_reads GROUP BY 1")
def _(fx):
    located = R.locate_primers(fx.reads, PARAMS)
    return R.sample_coverage(R.assign_samples(located, R.tag_variants(fx.sheet, 1), fx.sheet))


# -- parsers over text lines ------------------------------------------------------------------


def _ncbi(fx, sep):
    cols = ["query_name", "acc", "p_identity", "alignment_length", "num_mismatches", "gap_opens"]
    text = [F.col(c).cast("string") for c in cols] + [F.lit("1")] * 4 + [F.lit("1e-50"), F.col("bit_score").cast("string")]
    query_name = F.translate("query_name", ",", "_")
    return fx.hits.select(F.struct("query_name", "acc").alias("ord"), F.concat_ws(sep, query_name, *text[1:]).alias("line"))


_RANKED = """SELECT * FROM (SELECT query_name, acc, p_identity, cast(alignment_length AS double) AS alignment_length, bit_score, row_number() OVER (PARTITION BY query_name ORDER BY acc) AS hit_rank FROM fx_hits) t"""


@query("src09_ncbi_tabular", f"{_RANKED} WHERE hit_rank<=2")
def _(fx):
    lines = _ncbi(fx, "\t")
    notes = lines.select("ord", F.concat(F.lit("# Query: "), "line").alias("line"))
    return T.parse_ncbi_tabular(lines.unionByName(notes), 2).select("query_name", "acc", "p_identity", "alignment_length", "bit_score", "hit_rank")


@query("src10_ncbi_csv", f"{_RANKED} WHERE hit_rank<=4")
def _(fx):
    return T.parse_ncbi_csv(_ncbi(fx, ","), 4).select("query_name", "acc", "p_identity", "alignment_length", "bit_score", "hit_rank")


@query(
    "src15_run_summary",
    """SELECT o_orderkey AS run, concat('/data/',o_orderstatus) AS folder, cast(o_custkey AS varchar) AS minlen, o_orderpriority AS mode FROM orders""",
)
def _(fx):
    rows = fx.orders.select(
        F.col("o_orderkey").cast("string").alias("Run"), F.col("o_orderstatus").alias("Folder"),
        F.concat(F.lit("minlen="), F.col("o_custkey").cast("string"), F.lit(", mode="), "o_orderpriority").alias("Parameters"),
    )
    runs = T.parse_run_summary(rows, "/data")
    return runs.select("run", "folder", F.col("params")["minlen"].alias("minlen"), F.col("params")["mode"].alias("mode"))


@query("src16_patterns", "SELECT DISTINCT trim(p) AS pattern FROM (SELECT unnest(string_split(text, chr(10))) AS p FROM documents) t WHERE trim(p)<>''")
def _(fx):
    lines = fx.documents.select(F.explode(F.split("text", "\n")).alias("value"))
    return T.parse_patterns(lines).distinct()


@query(
    "src17_lookup",
    """SELECT replace(p_name,' ','_') AS id, concat(arg_max(p_brand,p_partkey),'|',arg_max(p_type,p_partkey),'|',arg_max(replace(regexp_replace(cast(p_retailprice AS varchar),'\\.0$',''),'.','_'),p_partkey)) AS fields  FROM part GROUP BY 1""",
)
def _(fx):
    price = F.col("p_retailprice")
    rows = fx.part.select(
        F.col("p_partkey").alias("ord"), F.array("p_name", F.lit(" "), "p_brand", F.lit(" ., "), "p_type", price.cast("string")).alias("cells")
    )
    return T.parse_lookup(rows).select("id", F.array_join("fields", "|").alias("fields"))


@query(
    "src18_dim_cache",
    "SELECT p_name AS key, CASE WHEN max(p_size)>25 THEN concat('new',max(CASE WHEN p_size>25 THEN p_partkey END)) ELSE concat('old',max(p_partkey)) END AS value FROM part GROUP BY 1",
)
def _(fx):
    old = fx.part.groupBy(F.col("p_name").alias("key")).agg(F.concat(F.lit("old"), F.max("p_partkey").cast("string")).alias("value"))
    new = fx.part.filter("p_size > 25").groupBy(F.col("p_name").alias("key")).agg(F.concat(F.lit("new"), F.max("p_partkey").cast("string")).alias("value"))
    return T.latest_dim([old, new])


@query(
    "snk6_append_dim",
    "SELECT p_brand AS key, min(p_type) AS value FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size=50) AND p_type<>'SMALL' GROUP BY 1",
)
def _(fx):
    fresh = fx.part.select(F.col("p_brand").alias("key"), F.col("p_type").alias("value"))
    stored = fx.part.filter("p_size = 50").select(F.col("p_brand").alias("key")).distinct()
    return K.new_keys(fresh, stored, negative="SMALL")


@query(
    "snk3_split_names",
    """WITH v AS (SELECT c_custkey, concat(c_mktsegment, CASE WHEN c_nationkey%2=0 THEN ';' ELSE ':' END, lower(substr(c_name,1,c_nationkey%3))) AS v FROM customer),
     s AS (SELECT c_custkey, rtrim(regexp_replace(v,'[^a-zA-Z0-9_.-]+','_','g'),'_.') AS safe FROM v), g AS (SELECT safe, min(c_custkey) AS first FROM s GROUP BY 1),
     n AS (SELECT safe, row_number() OVER (PARTITION BY lower(safe) ORDER BY first) AS k FROM g)
    SELECT c_custkey AS ord, CASE WHEN k>1 THEN concat(n.safe,'_',k) ELSE n.safe END AS name FROM s JOIN n ON n.safe=s.safe""",
)
def _(fx):
    sep = F.when(F.col("c_nationkey") % 2 == 0, ";").otherwise(":")
    rows = fx.customer.select(F.col("c_custkey").alias("ord"), F.concat("c_mktsegment", sep, F.lower(F.substr("c_name", F.lit(1), F.col("c_nationkey") % 3))).alias("v"))
    return K.split_names(rows, "v").select("ord", "name")


@query("src19_lineages", "SELECT cast(c_custkey AS varchar) AS taxid, n_name AS family, r_name AS \"order\", '-' AS kingdom FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey UNION ALL SELECT concat('9',c_custkey), n_name, r_name, '-' FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey")
def _(fx):
    both = fx.customer.join(fx.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(fx.region, F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("c_custkey").cast("string")
    node = "<Taxon><TaxId>1</TaxId><ScientificName>%s</ScientificName><Rank>%s</Rank></Taxon>"
    text = F.format_string(
        "<Taxon><TaxId>%s</TaxId><ScientificName>%s</ScientificName><Rank>species</Rank><AkaTaxIds><TaxId>9%s</TaxId></AkaTaxIds><LineageEx>"
        + node % ("%s", "order") + node % ("%s", "Family") + node % ("later", "family") + "</LineageEx></Taxon>",
        key, F.col("c_name"), key, F.col("r_name"), F.col("n_name"),
    )
    taxa = both.select(F.from_xml(text, X.TAXON).alias("t")).select("t.*")
    return X.parse_lineages(taxa).select("taxid", "family", "order", "kingdom")


@query("src20_organisms", "SELECT concat('AC',p_partkey,'.1') AS acc, replace(p_name,' ','_') AS organism, cast(p_size AS varchar) AS taxid FROM part")
def _(fx):
    text = F.format_string(
        "<INSDSeq><INSDSeq_accession-version>AC%s.1</INSDSeq_accession-version><INSDSeq_organism>%s</INSDSeq_organism><INSDSeq_feature-table>"
        "<INSDFeature><INSDFeature_key>gene</INSDFeature_key></INSDFeature><INSDFeature><INSDFeature_key>source</INSDFeature_key><INSDFeature_quals>"
        "<INSDQualifier><INSDQualifier_name>db_xref</INSDQualifier_name><INSDQualifier_value>BOLD:1</INSDQualifier_value></INSDQualifier>"
        "<INSDQualifier><INSDQualifier_name>db_xref</INSDQualifier_name><INSDQualifier_value>taxon:%s</INSDQualifier_value></INSDQualifier>"
        "</INSDFeature_quals></INSDFeature></INSDSeq_feature-table></INSDSeq>",
        F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_size").cast("string"),
    )
    return X.parse_organisms(fx.part.select(F.from_xml(text, X.RECORD).alias("r")).select("r.*"))
