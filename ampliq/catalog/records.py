"""Tools over sequence records."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import records as R
from .registry import query
from .scalars import _FRAMES5


@query(
    "f05_grep_regex",
    "SELECT ord, header FROM fx_runs WHERE regexp_matches(header,'^x.*ambs=0|_all\\.FA;1[0-9]*;','i')",
)
def _(fx):
    return R.grep(fx.runs, ["^x.*ambs=0", "_all\\.FA;1[0-9]*;"], "regex", ignore_case=True).select("ord", "header")


@query("f05_grep_plain", "SELECT ord, header FROM fx_runs WHERE contains(header,'estgaps=2') OR contains(header,';7')")
def _(fx):
    return R.grep(fx.runs, ["estgaps=2", ";7"]).select("ord", "header")


@query(
    "f05_grep_id",
    "SELECT ord, header FROM fx_runs WHERE split_part(sample,'_',1) IN (SELECT concat('S',lpad(cast(doc_id AS varchar),9,'0')) FROM labels WHERE quality=1)",
)
def _(fx):
    wanted = fx.labels.filter("quality = 1").select(
        F.concat(F.lit("s"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("pattern")
    )
    return R.grep(fx.runs, wanted, "id", ignore_case=True, suffix="_all.fa").select("ord", "header")


@query(
    "f06_filter_fields",
    """SELECT ord, header FROM fx_runs WHERE cast(split_part(header,';',2) AS double)>=100 AND cast(split_part(header,'ambs=',2)[1:1] AS double)=0
       AND NOT contains(lower(split_part(header,';',1)),'x')""",
)
def _(fx):
    crit = [(2, ">=", "100"), ("ambs", "=", "0"), (1, "not contains", "X")]
    return R.filter_fields(fx.runs, crit).select("ord", "header")


@query(
    "f06_filter_fields_any",
    """SELECT ord, header FROM fx_vars WHERE regexp_extract(header,';type=([a-z]+)',1)='corrected'
       OR cast(regexp_extract(header,';coverage=([0-9]+)',1) AS double)<6""",
)
def _(fx):
    return R.filter_fields(fx.vars, [("type", "=", "Corrected"), ("coverage", "<", "6"), ("none", ">", "0")], "any").select("ord", "header")


@query(
    "f13_trim_records",
    f"""WITH {_FRAMES5}, best AS (SELECT ord, arg_max(f, aa*10-frame) AS f, max(aa) AS aa, any_value(seq) AS seq FROM orfs GROUP BY ord),
     t AS (SELECT ord, seq, aa, CASE WHEN aa*3>=length(seq)-2 THEN seq ELSE left(f, aa*3) END AS orf FROM best WHERE seq<>''),
     s AS (SELECT ord, seq, orf, CASE WHEN orf=seq THEN 'unchanged' WHEN aa*3>=length(seq)*0.2 THEN 'trimmed' ELSE 'short_orf' END AS status FROM t)
    SELECT s.ord, status, CASE WHEN status='trimmed' THEN orf ELSE s.seq END AS seq,
     CASE WHEN status='trimmed' THEN concat(split_part(header,';',1),';',length(orf),substr(header,strpos(header,';')+1+length(split_part(header,';',2)))) ELSE header END AS header
    FROM s JOIN fx_runs r ON r.ord=s.ord""",
)
def _(fx):
    return R.trim_records(fx.runs, 5, 0.2).select("ord", "status", "seq", "header")


@query("a47_field_values", "SELECT split_part(header,'estgaps=',2) AS value, count(*) AS n FROM fx_runs GROUP BY 1")
def _(fx):
    return R.field_values(fx.runs, ";", "estgaps")


@query(
    "j04_append_info",
    """SELECT ord, CASE WHEN sample LIKE 'S%' THEN concat(header,'|',lang,'|',source) ELSE header END AS header, sample LIKE 'S%' AS found
    FROM fx_runs r JOIN documents d ON d.doc_id=r.ord%100000000000""",
)
def _(fx):
    sid = F.concat(F.lit("S"), F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    lookup = fx.documents.select(
        T.normalize_cell(sid).alias("id"), F.array(T.normalize_cell("lang"), T.normalize_cell("source")).alias("fields")
    )
    return R.append_info(fx.runs, lookup, suffix="_all.fa").select("ord", "header", "found")


@query("snk2_wrap", "SELECT ord, regexp_replace(regexp_replace(seq,'(.{60})','\\1' || chr(10),'g'), chr(10) || '$','') AS lines FROM fx_runs")
def _(fx):
    return fx.runs.select("ord", R.wrap("seq", 60).alias("lines"))


@query(
    "a11_fasta_stats",
    """WITH s AS (SELECT run, seq, length(seq) AS len, length(regexp_replace(seq,'[ACGT]','','g')) AS amb, length(regexp_replace(seq,'[^GC]','','g')) AS gc,
        length(regexp_replace(seq,'[^A]','','g')) AS a, length(regexp_replace(seq,'[^C]','','g')) AS c, length(regexp_replace(seq,'[^G]','','g')) AS g, length(regexp_replace(seq,'[^T]','','g')) AS t,
        coalesce(list_max(list_transform(regexp_extract_all(seq,'(A+|C+|G+|T+)'), lambda x: length(x))),0) AS homo FROM fx_runs),
      o AS (SELECT run, len, row_number() OVER (PARTITION BY run ORDER BY len DESC) AS i, sum(len) OVER (PARTITION BY run ORDER BY len DESC ROWS UNBOUNDED PRECEDING) AS acc, sum(len) OVER (PARTITION BY run) AS tot FROM s),
      n AS (SELECT run, min(i) AS l50, max(len) AS n50 FROM o WHERE acc*2>=tot GROUP BY run)
    SELECT s.run, count(*) AS sequences, cast(sum(len) AS bigint) AS bases, min(len) AS min_length, max(len) AS max_length, round(avg(len),2) AS mean_length,
      median(len) AS median_length, round(stddev_pop(len),2) AS sd_length, any_value(n50) AS n50, any_value(l50) AS l50, cast(sum(amb) AS bigint) AS ambiguous,
      round(100.0*sum(amb)/sum(len),4) AS ambiguous_pct, cast(sum(amb) AS bigint) AS n_bases, count(*) FILTER (amb>0) AS with_ambiguous,
      round(100.0*sum(gc)/sum(a+c+g+t),2) AS gc_pct, 0 AS gaps, 0 AS invalid, count(*) FILTER (len=0) AS empty,
      round(100.0*sum(a)/sum(a+c+g+t),2) AS a_pct, round(100.0*sum(c)/sum(a+c+g+t),2) AS c_pct, round(100.0*sum(g)/sum(a+c+g+t),2) AS g_pct, round(100.0*sum(t)/sum(a+c+g+t),2) AS t_pct,
      max(homo) AS max_homopolymer, round(avg(homo),2) AS mean_homopolymer, count(*)-count(DISTINCT seq) AS duplicates
    FROM s JOIN n ON s.run=n.run GROUP BY s.run""",
)
def _(fx):
    return R.fasta_stats(fx.runs)


@query(
    "a12_length_histogram",
    """WITH l AS (SELECT length(seq) AS len FROM fx_runs), b AS (SELECT min(len) AS lo, max(len) AS hi FROM l),
     w AS (SELECT lo, hi, (SELECT min(x) FROM (VALUES (1),(2),(5),(10),(20),(50),(100),(200),(500),(1000),(2000),(5000),(10000)) v(x) WHERE x>=greatest((hi-lo)/20.0,1)) AS width FROM b),
     g AS (SELECT width, (lo//width)*width AS start, unnest(range(0, (hi-(lo//width)*width)//width+1)) AS i FROM w)
    SELECT start+i*width AS bin_start, start+i*width+width-1 AS bin_end, count(l.len) AS n FROM g LEFT JOIN l ON l.len>=start+i*width AND l.len<start+(i+1)*width GROUP BY 1,2""",
)
def _(fx):
    return R.length_histogram(fx.runs)


@query("a17_unique_seqs", "SELECT run, min(ord) AS ord, arg_min(header, ord) AS header, seq FROM fx_runs GROUP BY run, seq")
def _(fx):
    return R.unique_seqs(fx.runs).select("run", "ord", "header", "seq")


@query(
    "a18_identical_groups",
    """WITH g AS (SELECT run, seq, count(*) AS copies, min(ord) AS first FROM fx_runs GROUP BY run, seq HAVING count(*)>1),
     n AS (SELECT run, seq, copies, row_number() OVER (PARTITION BY run ORDER BY first) AS group_no FROM g)
    SELECT r.run, group_no, copies, ord, header FROM fx_runs r JOIN n ON n.run=r.run AND n.seq=r.seq""",
)
def _(fx):
    return R.identical_groups(fx.runs).drop("seq")


@query("a19_repeated_headers", "SELECT 1 AS run, replace(text,' ','_') AS header, count(*) AS copies FROM documents GROUP BY 2 HAVING count(*)>1")
def _(fx):
    heads = fx.documents.select(F.lit(1).alias("run"), F.col("text").alias("header"))
    return R.repeated_headers(heads, spaces_as_underscore=True)


@query("a29_count_records", "SELECT run, count(*) AS n FROM fx_runs GROUP BY run")
def _(fx):
    return R.count_records(fx.runs)


@query(
    "ord1_sort_records",
    """SELECT run, ord, row_number() OVER (PARTITION BY run ORDER BY cast(split_part(header,';',3) AS bigint) DESC, split_part(header,';',1), ord) AS place FROM fx_runs""",
)
def _(fx):
    return R.sort_records(fx.runs, [(3, True), (1, False)]).select("run", "ord", "place")


@query("lim1_split_count", "SELECT run, ord, (row_number() OVER (PARTITION BY run ORDER BY ord)-1)//75+1 AS part FROM fx_runs")
def _(fx):
    return R.split_count(fx.runs, 75).select("run", "ord", "part")


@query("lim1_split_files", "SELECT run, ord, ntile(7) OVER (PARTITION BY run ORDER BY ord) AS part FROM fx_runs")
def _(fx):
    return R.split_files(fx.runs, 7).select("run", "ord", "part")


@query(
    "lim2_split_bases",
    """WITH RECURSIVE n AS MATERIALIZED (SELECT run, ord, length(seq) AS len, row_number() OVER (PARTITION BY run ORDER BY ord) AS rn FROM fx_runs),
     f AS (SELECT run, ord, rn, len AS acc, 1 AS cnt, 1 AS part FROM n WHERE rn=1
       UNION ALL SELECT n.run, n.ord, n.rn, CASE WHEN f.acc+n.len>5000 OR f.cnt>=12 THEN n.len ELSE f.acc+n.len END,
         CASE WHEN f.acc+n.len>5000 OR f.cnt>=12 THEN 1 ELSE f.cnt+1 END, CASE WHEN f.acc+n.len>5000 OR f.cnt>=12 THEN f.part+1 ELSE f.part END
       FROM f JOIN n ON n.run=f.run AND n.rn=f.rn+1)
    SELECT run, ord, part FROM f""",
)
def _(fx):
    return R.split_bases(fx.runs, 5000, max_seqs=12, blocks_of=4).select("run", "ord", "part")


@query(
    "set1_merge_inputs",
    "SELECT row_number() OVER (ORDER BY i, ord) AS place, header FROM (SELECT 0 AS i, ord, header FROM fx_vars UNION ALL SELECT 1, ord, header FROM fx_runs) t",
)
def _(fx):
    from ..operators.ordering import running

    both = R.merge_inputs(fx.vars.select("ord", "header"), fx.runs.select("ord", "header"))
    return running(both, ["ord"], number="place").select("place", "header")
