"""Scalar expressions over headers, cells and sequences."""

from pyspark.sql import functions as F

from ..functions import headers as H
from ..functions import iupac, text as T
from ..functions import seq as S
from .registry import query


def _text(col):
    """Arrays as text, so both engines compare plain columns."""
    return F.array_join(col, ",")


@query("sc01_revcomp", "SELECT ord, reverse(translate(seq,'ACGTRYSWKMBDHVN','TGCAYRSWMKVHDBN')) AS rc FROM fx_runs")
def _(fx):
    return fx.runs.select("ord", S.revcomp("seq").alias("rc"))


_FIELD = "list_filter(string_split(header,';'), lambda p: contains(p,'=') AND trim(split_part(p,'=',1))='{k}')[1]"


@query(
    "sc02_header_field",
    f"""SELECT ord, trim(string_split(header,';')[2]) AS second,
    trim(substr({_FIELD.format(k='ambs')}, strpos({_FIELD.format(k='ambs')},'=')+1)) AS ambs,
    trim(substr(string_split(header,';')[4], 6)) AS fourth,
    cast(NULL AS varchar) AS ninth, cast(NULL AS varchar) AS nosep
    FROM fx_runs""",
)
def _(fx):
    h = H.header_field
    return fx.runs.select(
        "ord",
        h("header", ";", 2).alias("second"),
        h("header", ";", "ambs").alias("ambs"),
        h("header", ";", 4).alias("fourth"),
        h("header", ";", 9).alias("ninth"),
        h("header", "|", 1).alias("nosep"),
    )


@query(
    "sc03_header_keys",
    """WITH k AS (SELECT header, unnest(string_split(header,';')) AS p FROM fx_vars)
    SELECT trim(split_part(p,'=',1)) AS key, count(*) AS n FROM k WHERE contains(p,'=') GROUP BY 1""",
)
def _(fx):
    keys = fx.vars.select(F.explode(H.header_key_array("header", ";")).alias("key"))
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sc04_extract_id",
    """SELECT ord, CASE WHEN length(split_part(header,';',1))>7 AND ends_with(split_part(header,';',1),'_all.fa')
      THEN left(split_part(header,';',1), -7) ELSE split_part(header,';',1) END AS id,
    regexp_extract(header,'\\S+') AS token FROM fx_runs""",
)
def _(fx):
    return fx.runs.select("ord", H.extract_id("header", ";", "_all.fa").alias("id"), H.extract_id("header").alias("token"))


@query(
    "sc05_sample_id",
    "SELECT ord, regexp_replace(split_part(header,';',1),'_var[0-9]+$','') AS sample FROM fx_vars",
)
def _(fx):
    return fx.vars.select("ord", H.sample_id("header").alias("sample"))


@query(
    "sc06_sample_of_header",
    """SELECT header, regexp_replace(regexp_replace(split_part(header,';',1),'_var[0-9]+$',''),'_all\\.fa$','') AS sample
    FROM (SELECT header FROM fx_vars UNION ALL SELECT header FROM fx_runs) t""",
)
def _(fx):
    both = fx.vars.select("header").unionByName(fx.runs.select("header"))
    return both.select("header", H.sample_of_header("header").alias("sample"))


@query(
    "sc07_variant_host",
    """SELECT header, regexp_matches(split_part(header,';',1),'_var[0-9]+$') AS variant,
    regexp_replace(split_part(header,';',1),'^(.*)_var.*$','\\1') AS host
    FROM (SELECT header FROM fx_vars UNION ALL SELECT header FROM fx_runs) t""",
)
def _(fx):
    both = fx.vars.select("header").unionByName(fx.runs.select("header"))
    return both.select("header", H.is_variant("header").alias("variant"), H.variant_host("header").alias("host"))


@query(
    "sc08_extract_sample_id",
    """SELECT ord, CASE WHEN regexp_extract(header,'^X0*([1-9][0-9]*)',1)<>'' THEN regexp_extract(header,'^X0*([1-9][0-9]*)',1)
        ELSE split_part(header,'_',1) END AS id,
      regexp_extract(header,'^((?:[^_.]*[_.]){1}[^_.]*)[_.]',1) AS any2,
      split_part(header,'_all.fa',1) AS plain,
      split_part(header,';',1) AS fallback, false AS matched FROM fx_runs""",
)
def _(fx):
    rules = H.extract_sample_id
    miss, matched = rules("header", [], ["pos:|:1", "nothing here"])
    return fx.runs.select(
        "ord",
        rules("header", ["^X0*([1-9][0-9]*)"], ["pos:_:1"])[0].alias("id"),
        rules("header", [], ["pos:_:5", "posany:_.:2"])[0].alias("any2"),
        rules("header", [], ["_all.fa"])[0].alias("plain"),
        miss.alias("fallback"),
        matched.alias("matched"),
    )


@query(
    "sc09_normalize_id",
    "SELECT ord, regexp_replace(lower(regexp_replace(sample,'^X','')),'(^|[^0-9])0+([0-9])','\\1\\2','g') AS id FROM fx_runs",
)
def _(fx):
    return fx.runs.select("ord", H.normalize_id("sample", "^X", True, True).alias("id"))


@query(
    "sc10_header_metrics",
    """SELECT header, regexp_replace(regexp_replace(split_part(header,';',1),'_var[0-9]+$',''),'_all\\.fa$','') AS sample,
      CASE WHEN kind='run' THEN cast(split_part(header,';',2) AS bigint) ELSE cast(regexp_extract(header,';len=([0-9]+)',1) AS bigint) END AS length,
      CASE WHEN kind='run' THEN cast(split_part(header,';',3) AS bigint) ELSE cast(regexp_extract(header,';coverage=([0-9]+)',1) AS bigint) END AS coverage,
      cast(regexp_extract(header,';(ambs|Ns)=([0-9]+)',2) AS bigint) AS ambs,
      cast(regexp_extract(header,';(estgaps|fixed_indels)=([0-9]+)',2) AS bigint) AS estgaps
    FROM (SELECT header, 'run' AS kind FROM fx_runs UNION ALL SELECT header, 'var' FROM fx_vars) t""",
)
def _(fx):
    both = fx.runs.select("header", "seq").unionByName(fx.vars.select("header", "seq"))
    return both.select("header", H.header_metrics("header", "seq").alias("m")).select("header", "m.*")


@query(
    "sc11_set_len_field",
    """SELECT ord, concat(split_part(header,';',1),';',cast(length(seq)+5 AS varchar), substr(header, strpos(header,';')+1+length(split_part(header,';',2)))) AS header
    FROM fx_runs""",
)
def _(fx):
    return fx.runs.select("ord", H.set_len_field("header", F.length("seq") + 5).alias("header"))


@query(
    "sc12_parse_div",
    """SELECT ord, coalesce(try_cast(regexp_extract(header,';div=([^;%]*)%?',1) AS double)/100.0, cast('nan' AS double)) AS div FROM fx_vars""",
)
def _(fx):
    return fx.vars.select("ord", H.parse_div("header").alias("div"))


@query(
    "sc13_parse_number",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount AS a, l_quantity AS b, cast(NULL AS double) AS c FROM lineitem""",
)
def _(fx):
    n = T.parse_number
    q = F.col("l_quantity").cast("string")
    return fx.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        n(F.translate(F.col("l_discount").cast("string"), ".", ",")).alias("a"),
        n(F.concat(F.lit(" "), q, F.lit(" %"))).alias("b"),
        n("l_returnflag").alias("c"),
    )


@query(
    "sc14_normalize_cell",
    f"""SELECT doc_id, trim(regexp_replace(regexp_replace(translate(trim(text,e' \\t\\r\\n'),'{T.ACCENTED}','{T.UNACCENTED}'),'[ .,]+','_','g'),'_+','_','g'),'_') AS cell
    FROM documents""",
)
def _(fx):
    return fx.documents.select("doc_id", T.normalize_cell("text").alias("cell"))


@query(
    "sc15_safe_name",
    """SELECT page_id, CASE WHEN s='' THEN 'empty' ELSE s END AS name FROM (SELECT page_id,
    left(trim(regexp_replace(url,'[^a-zA-Z0-9_.-]+','_','g'),'._'),80) AS s FROM pages) t""",
)
def _(fx):
    return fx.pages.select("page_id", T.safe_name("url").alias("name"))


_SHOW = """CASE WHEN trim({c}) IN ('0','0.0','-','','N/A','NA','nan','None') THEN NULL
  WHEN replace(trim({c}),'_',' ')=lower(replace(trim({c}),'_',' ')) THEN concat(upper(left(replace(trim({c}),'_',' '),1)),substr(replace(trim({c}),'_',' '),2))
  ELSE replace(trim({c}),'_',' ') END"""


@query(
    "sc16_display_taxon",
    f"""SELECT query_name, acc, {_SHOW.format(c='s_organism')} AS organism, {_SHOW.format(c='lower(s_family)')} AS family,
    {_SHOW.format(c="cast(gap_opens AS varchar)")} AS gap FROM fx_hits""",
)
def _(fx):
    d = T.display_taxon
    return fx.hits.select(
        "query_name", "acc", d("s_organism").alias("organism"),
        d(F.lower("s_family")).alias("family"), d(F.col("gap_opens").cast("string")).alias("gap"),
    )


@query(
    "sc17_species_key",
    """SELECT p_partkey, lower(replace(p_name,'  ',' ')) AS plain, lower(p_name) AS qualified, '' AS bare, '' AS open
    FROM part""",
)
def _(fx):
    k, name = T.species_key, F.col("p_name")
    word = F.substring_index(name, " ", 1)
    return fx.part.select(
        "p_partkey",
        k(name).alias("plain"),
        k(F.concat(word, F.lit(" cf. "), F.substring_index(name, " ", -1), F.lit(" Author"))).alias("qualified"),
        k(word).alias("bare"),
        k(F.concat(word, F.lit(" sp.2 x"))).alias("open"),
    )


@query(
    "sc18_concordance",
    """SELECT query_name, acc, CASE WHEN t.q_organism<>'' AND lower(t.q_organism)=lower(replace(h.s_organism,'_',' ')) THEN 'organism'
      WHEN t.q_genus<>'' AND lower(t.q_genus)=lower(h.s_genus) THEN 'genus' WHEN t.q_family<>'' AND lower(t.q_family)=lower(h.s_family) THEN 'family'
      WHEN t.q_order<>'' AND lower(t.q_order)=lower(h.s_order) THEN 'order' ELSE 'none' END AS level
    FROM fx_hits h LEFT JOIN fx_taxref t ON t.sample=split_part(h.query_name,'_all',1)""",
)
def _(fx):
    hits = fx.hits.withColumn("sample", H.sample_of_header("query_name"))
    both = hits.join(fx.taxref, "sample", "left")
    hit = {r: T.display_taxon(f"s_{r}") for r in T.RANKS}
    want = {r: T.display_taxon(f"q_{r}") for r in T.RANKS}
    return both.select("query_name", "acc", T.concordance(hit, want).alias("level"))


@query(
    "sc20_mean_q",
    """WITH q AS (SELECT read_id, unnest(string_split(qual,'')) AS c FROM fx_reads WHERE qual<>'')
    SELECT read_id, round(-10*log10(avg(pow(10,-(ascii(c)-33)/10.0))),6) AS q FROM q GROUP BY 1""",
)
def _(fx):
    return fx.reads.select("read_id", F.round(S.mean_q("qual"), 6).alias("q"))


@query(
    "sc21_seq_stats",
    """SELECT ord, length(seq) AS length, 0 AS gaps, length(seq)-length(replace(seq,'N','')) AS n,
      length(regexp_replace(seq,'[ACGT]','','g')) AS ambig, 0 AS invalid,
      length(seq)-length(replace(seq,'A','')) AS a, length(regexp_replace(seq,'[^GC]','','g')) AS gc,
      coalesce(round(100.0*length(regexp_replace(seq,'[^GC]','','g'))/nullif(length(regexp_replace(seq,'[^ACGT]','','g')),0),6),0) AS gc_pct,
      coalesce(round(100.0*length(regexp_replace(seq,'[ACGT]','','g'))/nullif(length(seq),0),6),0) AS ambig_pct FROM fx_runs""",
)
def _(fx):
    st = S.seq_stats("seq")
    plain = ["length", "gaps", "n", "ambig", "invalid", "a", "gc"]
    return fx.runs.select(
        "ord", *[st[k].cast("bigint").alias(k) for k in plain],
        F.round(st["gc_pct"], 6).alias("gc_pct"), F.round(st["ambig_pct"], 6).alias("ambig_pct"),
    )


@query(
    "sc22_max_homopolymer",
    """SELECT ord, coalesce(list_max(list_transform(regexp_extract_all(seq,'(A+|C+|G+|T+)'), lambda x: length(x))),0) AS longest FROM fx_runs""",
)
def _(fx):
    return fx.runs.select("ord", S.max_homopolymer("seq").cast("bigint").alias("longest"))


@query(
    "sc23_gc_pct",
    """SELECT read_id, coalesce(round(100.0*length(regexp_replace(seq,'[^GC]','','g'))/nullif(length(seq),0),6),0) AS gc FROM fx_reads""",
)
def _(fx):
    return fx.reads.select("read_id", F.round(S.gc_pct("seq"), 6).alias("gc"))


# Six frames of one sequence, and the codons of a frame before its first stop.
_RC = "reverse(translate({s},'ACGTN','TGCAN'))"
_FRAMES = f"""frames AS (SELECT ord, seq, k AS frame, CASE k WHEN 1 THEN seq WHEN 2 THEN substr(seq,2) WHEN 3 THEN substr(seq,3)
   WHEN 4 THEN {_RC.format(s='seq')} WHEN 5 THEN {_RC.format(s='left(seq,greatest(length(seq)-1,0))')}
   ELSE {_RC.format(s='left(seq,greatest(length(seq)-2,0))')} END AS f
   FROM (SELECT ord, seq, unnest([1,2,3,4,5,6]) AS k FROM fx_runs) u),
  codons AS (SELECT ord, seq, frame, f, regexp_extract_all(f,'[A-Z][A-Z][A-Z]') AS c FROM frames),
  stops AS (SELECT ord, seq, frame, f, length(c) AS n, list_min(list_filter(list_transform(c, lambda x, i: CASE WHEN x IN ({{stops}}) THEN i END), lambda x: x IS NOT NULL)) AS hit FROM codons),
  orfs AS (SELECT ord, seq, frame, f, coalesce(hit-1, n) AS aa FROM stops)"""
_FRAMES5 = _FRAMES.format(stops="'TAA','TAG','TAR'")


@query(
    "sc24_orf_lengths",
    f"WITH {_FRAMES5} SELECT ord, string_agg(cast(aa AS varchar), ',' ORDER BY frame) AS lengths FROM orfs GROUP BY ord",
)
def _(fx):
    return fx.runs.select("ord", _text(S.orf_lengths("seq", 5)).alias("lengths"))


@query(
    "sc25_translates",
    f"""WITH {_FRAMES5}, best AS (SELECT ord, arg_max(frame, aa*10-frame) AS frame, max(aa) AS aa, any_value(seq) AS seq FROM orfs GROUP BY ord)
    SELECT ord, aa>0 AND aa=floor((length(seq)-CASE WHEN frame IN (2,5) THEN 1 WHEN frame IN (3,6) THEN 2 ELSE 0 END)/3.0) AS reads_through FROM best""",
)
def _(fx):
    return fx.runs.select("ord", S.translates("seq", 5).alias("reads_through"))


@query(
    "sc26_orf_trim",
    f"""WITH {_FRAMES5}, best AS (SELECT ord, arg_max(f, aa*10-frame) AS f, max(aa) AS aa, any_value(seq) AS seq FROM orfs GROUP BY ord)
    SELECT ord, CASE WHEN aa*3>=length(seq)-2 THEN seq ELSE left(f, aa*3) END AS seq, aa FROM best""",
)
def _(fx):
    return fx.runs.select("ord", S.orf_trim("seq", 5).alias("t")).select("ord", "t.seq", F.col("t.aa").cast("bigint").alias("aa"))


@query(
    "sc27_scan_stops",
    """WITH s AS (SELECT ord, seq, k, CASE WHEN k<4 THEN substr(seq,k) ELSE substr(reverse(translate(seq,'ACGTN','TGCAN')),k-3) END AS f
       FROM (SELECT ord, seq, unnest([1,2,3,4,5,6]) AS k FROM fx_runs) u),
     c AS (SELECT ord, seq, k, list_filter(list_transform(regexp_extract_all(f,'[A-Z][A-Z][A-Z]'), lambda x, i: CASE WHEN x IN ('TAA','TAG','TGA','TAR','TRA') THEN i END), lambda x: x IS NOT NULL) AS hit FROM s),
     p AS (SELECT ord, k, length(hit) AS n, CASE WHEN k<4 THEN list_transform(hit, lambda i: (i-1)*3+k)
       ELSE list_reverse(list_transform(hit, lambda i: length(seq)-((i-1)*3+k-4)-2)) END AS pos FROM c)
    SELECT ord, min(n) AS n, arg_min(list_extract(['+1','+2','+3','-1','-2','-3'],k), n*10+k) AS frame,
     arg_min(array_to_string(pos,','), n*10+k) AS positions FROM p GROUP BY ord""",
)
def _(fx):
    best = fx.runs.select("ord", S.scan_stops("seq", 1).alias("b"))
    return best.select("ord", F.col("b.n").cast("bigint").alias("n"), "b.frame", _text(F.col("b.positions")).alias("positions"))


_TWINS = "FROM fx_runs a JOIN fx_runs b ON a.sample=b.sample AND a.run<b.run"


def _twins(fx):
    """Records of the same sample in two runs (a sample occurs once per run)."""
    a = fx.runs.select("sample", F.col("run").alias("run_a"), F.col("seq").alias("a"))
    b = fx.runs.select("sample", F.col("run").alias("run_b"), F.col("seq").alias("b"))
    return a.join(b, "sample").filter("run_a < run_b")


@query("sc28_edit_nw", f"SELECT a.sample, a.run AS run_a, b.run AS run_b, levenshtein(a.seq,b.seq) AS d {_TWINS}")
def _(fx):
    d = iupac.edit_iupac("a", "b")["plain"].cast("bigint")
    return _twins(fx).select("sample", "run_a", "run_b", d.alias("d"))


@query("sc29_edit_iupac")
def _(fx):
    d = iupac.edit_iupac("a", "b")
    inside = iupac.edit_iupac("a", "b", infix=True)
    return _twins(fx).select("sample", "run_a", "run_b", d["iupac"].alias("d"), inside["iupac"].alias("d_inside"))


@query("sc30_divergence")
def _(fx):
    return _twins(fx).select("sample", "run_a", "run_b", F.round(iupac.divergence("a", "b"), 9).alias("div"))


@query(
    "sc31_hamming",
    f"""SELECT a.sample, a.run AS run_a, b.run AS run_b,
     CASE WHEN length(a.seq)=length(b.seq) THEN list_sum(list_transform(list_zip(string_split(a.seq,''),string_split(b.seq,'')), lambda p: CASE WHEN p[1]=p[2] THEN 0 ELSE 1 END)) END AS d,
     length(a.seq)=length(b.seq) AND list_sum(list_transform(list_zip(string_split(a.seq,''),string_split(b.seq,'')), lambda p: CASE WHEN p[1]=p[2] OR p[1]='N' OR p[2]='N' THEN 0 ELSE 1 END))=0 AS compatible {_TWINS}
""",
)
def _(fx):
    return _twins(fx).select(
        "sample", "run_a", "run_b", S.hamming("a", "b").cast("bigint").alias("d"), S.iupac_compatible("a", "b").alias("compatible")
    )


@query("sc32_natural_key", "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS place FROM customer")
def _(fx):
    from ..operators.ordering import running

    named = fx.customer.select("c_custkey", F.concat(F.lit("Cust"), F.col("c_custkey").cast("string")).alias("name"))
    return running(named, [T.natural_key("name")], number="place").select("c_custkey", "place")


@query(
    "sc33_compress_ranges",
    """WITH n AS (SELECT DISTINCT l_orderkey, l_linenumber AS x FROM lineitem),
     g AS (SELECT l_orderkey, x, x - row_number() OVER (PARTITION BY l_orderkey ORDER BY x) AS island FROM n),
     r AS (SELECT l_orderkey, min(x) AS lo, max(x) AS hi FROM g GROUP BY l_orderkey, island)
    SELECT l_orderkey, string_agg(CASE WHEN lo=hi THEN cast(lo AS varchar) ELSE concat(lo,'..',hi) END, ',' ORDER BY lo) AS lines FROM r GROUP BY 1""",
)
def _(fx):
    lines = fx.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("x"))
    return lines.select("l_orderkey", T.compress_ranges("x").alias("lines"))


@query("sc37_query_key", "SELECT p_partkey, replace(p_name,' ','_') AS name FROM part")
def _(fx):
    return fx.part.select("p_partkey", T.query_key("p_name").alias("name"))
