"""Hit tables, taxonomy, identification and the best sequence per sample."""

from pyspark.sql import functions as F

from ..functions.headers import sample_of_header
from ..operators import identify as I
from .registry import query

# Expected taxonomy of the customers as the operators read it.
_REF = """ref AS (SELECT lower(sample) AS low, CASE WHEN q_order='' THEN '' ELSE q_order END AS q_order, CASE WHEN q_family='-' THEN '' ELSE replace(q_family,'_',' ') END AS q_family,
   q_genus, CASE WHEN q_organism='NA' THEN '' ELSE q_organism END AS q_organism FROM fx_ctax)"""
_LEVEL = """CASE WHEN coalesce(q_organism,'')<>'' AND lower(q_organism)=lower(replace(s_organism,'_',' ')) THEN 4
   WHEN coalesce(q_genus,'')<>'' AND lower(q_genus)=lower(s_genus) THEN 3 WHEN coalesce(q_family,'')<>'' AND lower(q_family)=lower(replace(s_family,'_',' ')) THEN 2
   WHEN coalesce(q_order,'')<>'' AND lower(q_order)=lower(s_order) THEN 1 ELSE 0 END"""
_NAMES = "list_extract(['none','order','family','genus','organism'],cast({} AS int)+1)"
_SAMPLE = "regexp_replace(regexp_replace(split_part({},';',1),'_var[0-9]+$',''),'_all\\.fa$','')"
_LEVELED = f"""{_REF}, lv AS (SELECT h.*, {_SAMPLE.format('query_name')} AS sample, ref.low IS NOT NULL AS known, coalesce(q_order,'') AS q_order, coalesce(q_family,'') AS q_family,
   coalesce(q_genus,'') AS q_genus, coalesce(q_organism,'') AS q_organism, {_LEVEL} AS lev FROM fx_chits h LEFT JOIN ref ON ref.low=lower({_SAMPLE.format('query_name')}))"""


def _ref(fx):
    return I.reference_table(fx.ctax)


def _applied(fx, keep=False):
    return I.apply_taxonomy(fx.chits, _ref(fx), keep=keep)


@query(
    "win1_rank_hits",
    "SELECT query_name, acc, row_number() OVER (PARTITION BY query_name ORDER BY bit_score DESC, p_identity DESC, acc) AS hit_rank FROM fx_hits",
)
def _(fx):
    return I.rank_hits(fx.hits, [F.col("bit_score").desc(), F.col("p_identity").desc(), "acc"]).select("query_name", "acc", "hit_rank")


@query(
    "win2_top_hits",
    """SELECT * FROM (SELECT query_name, acc, p_identity, row_number() OVER (PARTITION BY query_name ORDER BY p_identity DESC NULLS LAST, acc) AS hit_rank FROM fx_hits) t WHERE hit_rank<=3""",
)
def _(fx):
    return I.top_hits(fx.hits, 3, [F.col("p_identity").desc_nulls_last(), F.col("acc")]).select("query_name", "acc", "p_identity", "hit_rank")


@query(
    "f07_filter_hits",
    "SELECT query_name, count(*) AS n_hits_raw, count(*) FILTER (alignment_length>=300) AS n_hits FROM fx_hits GROUP BY 1",
)
def _(fx):
    return I.filter_hits(fx.hits, 300)


@query("src11_hit_queries", "SELECT DISTINCT query_name FROM fx_hits")
def _(fx):
    return I.hit_queries(fx.hits)


@query("a49_hit_counts", "SELECT file, count(*) AS hits, count(DISTINCT query_name) AS queries FROM fx_chits GROUP BY 1")
def _(fx):
    return I.hit_counts(fx.chits)


@query(
    "win5_unsorted_groups",
    "SELECT DISTINCT query_name FROM (SELECT query_name, p_identity, lag(p_identity) OVER (PARTITION BY query_name ORDER BY acc) AS p FROM fx_hits) t WHERE p_identity>p",
)
def _(fx):
    return I.unsorted_groups(fx.hits, ["acc"], "p_identity")


@query(
    "f08_fix_blank_query",
    """WITH e AS (SELECT event_id, CASE WHEN event_type='error' THEN '' ELSE event_type END AS q FROM events),
      n AS (SELECT event_id, q, row_number() OVER (ORDER BY event_id) - row_number() OVER (PARTITION BY q='' ORDER BY event_id) AS island FROM e),
      d AS (SELECT event_id, q, CASE WHEN q='' THEN dense_rank() OVER (PARTITION BY q='' ORDER BY island) END AS no FROM n)
    SELECT event_id, CASE WHEN q='' THEN concat('No_query_ID_', lpad(cast(no AS varchar), greatest(2, length(cast(no AS varchar)))::int, '0')) ELSE q END AS query_name FROM d""",
)
def _(fx):
    name = F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))
    rows = fx.events.select("event_id", name.alias("query_name"))
    return I.fix_blank_query(rows, ["event_id"])


@query(
    "src12_reference_first",
    """SELECT o_custkey AS id, arg_min(o_orderstatus, o_orderkey) AS q_order FROM orders GROUP BY 1""",
)
def _(fx):
    ref = fx.orders.select(
        F.col("o_custkey").cast("string").alias("sample"), "o_orderkey", F.col("o_orderstatus").alias("q_order"),
        *[F.lit("").alias(c) for c in ("q_family", "q_genus", "q_organism")],
    )
    first = I.reference_table(ref, ["o_orderkey"])
    return first.select(F.col("sample").cast("bigint").alias("id"), "q_order")


@query(
    "j05_apply_taxonomy",
    f"""WITH {_LEVELED} SELECT file, query_name, hit_rank, q_order, q_family, q_genus, q_organism, known, {_NAMES.format('lev')} AS tax_level_match FROM lv""",
)
def _(fx):
    return _applied(fx).select("file", "query_name", "hit_rank", *I.QUERY_TAX, "known", "tax_level_match")


@query(
    "j05_taxonomy_counts",
    f"WITH {_LEVELED} SELECT count(*) AS rows_seen, count(*) FILTER (known) AS rows_filled, count(*) FILTER (NOT known) AS rows_unknown FROM lv",
)
def _(fx):
    return I.taxonomy_counts(_applied(fx))


@query(
    "j06_check_reference",
    """WITH s AS (SELECT DISTINCT split_part(query_name,'_all',1) AS sample FROM fx_hits),
      m AS (SELECT s.sample, t.sample AS exact, t.q_order, n.sample AS near FROM s LEFT JOIN fx_taxref t ON lower(t.sample)=lower(s.sample)
        LEFT JOIN fx_taxref n ON lower(replace(n.sample,'-',''))=lower(s.sample))
    SELECT sample, CASE WHEN exact IS NOT NULL THEN 'found' WHEN near IS NOT NULL THEN 'near' ELSE 'missing' END AS status,
      CASE WHEN exact IS NULL THEN near END AS near_id, coalesce(exact IS NOT NULL AND q_order='', false) AS empty_taxonomy FROM m""",
)
def _(fx):
    samples = fx.hits.select(sample_of_header("query_name").alias("sample"))
    return I.check_reference(samples, I.reference_table(fx.taxref))


@query(
    "j06_reference_layout",
    """WITH v AS (SELECT unnest([q_order,q_family,q_genus]) AS v FROM fx_taxref)
    SELECT count(*) AS names, round(avg(CASE WHEN regexp_matches(v,'[0-9]') THEN 1.0 ELSE 0.0 END),6) AS digit_share,
     avg(CASE WHEN regexp_matches(v,'[0-9]') THEN 1.0 ELSE 0.0 END)>0.5 AS suspicious FROM v WHERE v<>''""",
)
def _(fx):
    return I.reference_layout(I.reference_table(fx.taxref))


@query(
    "a45_reference_problems",
    """WITH s AS (SELECT DISTINCT split_part(query_name,'_all',1) AS sample FROM fx_hits)
    SELECT status, count(*) AS n FROM (SELECT CASE WHEN t.sample IS NULL THEN 'missing' WHEN q_order='' THEN 'empty' ELSE 'complete' END AS status
      FROM s LEFT JOIN fx_taxref t ON lower(t.sample)=lower(s.sample)) x GROUP BY 1""",
)
def _(fx):
    samples = fx.hits.select(sample_of_header("query_name").alias("sample"))
    checked = I.check_reference(samples, I.reference_table(fx.taxref))
    status = F.when(F.col("status") != "found", "missing").when(F.col("empty_taxonomy"), "empty").otherwise("complete")
    return checked.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def _dims(fx):
    organisms = fx.part.select(
        F.concat(F.lit("AC"), F.col("p_partkey").cast("string")).alias("acc"), F.col("p_name").alias("organism")
    )
    colour = F.substring_index("p_name", " ", 1)
    lineages = fx.part.filter("p_size > 10").select(
        F.col("p_name").alias("organism"), F.lit("Viridiplantae").alias("kingdom"), F.lit("-").alias("class"),
        colour.alias("order"), F.lit("-").alias("family"), F.substring_index("p_name", " ", -1).alias("genus"),
    ).distinct()
    return organisms, lineages


@query(
    "j15_enrich_hits",
    """WITH l AS (SELECT DISTINCT p_name AS organism FROM part WHERE p_size>10)
    SELECT query_name, partkey, suppkey, h.acc, coalesce(p.p_name,'-') AS organism, CASE WHEN l.organism IS NULL THEN 'Not_found_in_Taxonomy' ELSE 'Viridiplantae' END AS kingdom,
      CASE WHEN l.organism IS NULL THEN '-' ELSE split_part(p_name,' ',1) END AS "order", CASE WHEN l.organism IS NULL THEN '-' ELSE split_part(p_name,' ',-1) END AS genus,
      l.organism IS NOT NULL AS resolved
    FROM (SELECT query_name, partkey, suppkey, concat('AC',partkey) AS acc FROM fx_hits) h LEFT JOIN part p ON p.p_partkey=h.partkey LEFT JOIN l ON l.organism=p.p_name""",
)
def _(fx):
    hits = fx.hits.select("query_name", "partkey", "suppkey", F.concat(F.lit("AC"), F.col("partkey").cast("string")).alias("acc"))
    return I.enrich_hits(hits, *_dims(fx)).drop("class", "family")


@query(
    "j07_attach_hits",
    """SELECT file, count(*) AS records, count(*) FILTER (NOT EXISTS (SELECT 1 FROM fx_chits h WHERE h.file=c.file AND h.query_name=c.header)) AS unmatched
    FROM fx_cands c GROUP BY file""",
)
def _(fx):
    keyed = I.attach_key(fx.cands, fx.chits, ["file"])
    known = fx.chits.select("file", "query_name").distinct().withColumn("hit", F.lit(1))
    both = keyed.join(known, ["file", "query_name"], "left")
    return both.groupBy("file").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("hit").isNull()).alias("unmatched"))


@query(
    "j13_missing_seqs",
    "SELECT header FROM fx_cands WHERE orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag='R')",
)
def _(fx):
    answered = fx.cands.join(fx.lineitem.filter("l_returnflag = 'R'"), F.col("orderkey") == F.col("l_orderkey"), "left_semi")
    return I.missing_seqs(fx.cands, answered.select(F.col("header").alias("query_name"))).select("header")


@query("j13_nohit_seqs", "SELECT header FROM fx_cands WHERE header NOT IN (SELECT query_name FROM fx_chits)")
def _(fx):
    return I.nohit_seqs(fx.cands, fx.cands.select(F.col("header").alias("query_name")), fx.chits).select("header")


_BEST = f"""{_LEVELED}, bh AS (SELECT file, query_name, count(*) AS n_hits_raw, count(*) FILTER (alignment_length>=100) AS n_hits,
    arg_max(struct_pack(acc:=acc, lev:=lev, bit:=bit_score, o:=s_order, p:=p_identity, al:=alignment_length), lev*1e12+round(bit_score*1000)*100-hit_rank) FILTER (alignment_length>=100) AS b,
    arg_max(lev, round(bit_score*1000)*100-hit_rank) FILTER (alignment_length>=100) AS top FROM lv GROUP BY 1,2)"""


@query(
    "a31_best_concordant_hit",
    f"WITH {_BEST} SELECT file, query_name, n_hits_raw, n_hits, b.acc AS acc, {_NAMES.format('b.lev')} AS level, {_NAMES.format('top')} AS top_level FROM bh",
)
def _(fx):
    best = I.best_concordant_hit(_applied(fx), ["file"])
    return best.select("file", "query_name", "n_hits_raw", "n_hits", "best_hit.acc", "best_hit.level", "top_level")


@query(
    "a32_best_hits",
    f"""WITH {_LEVELED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_name ORDER BY lev DESC, bit_score DESC, p_identity DESC, gap_opens, num_mismatches, hit_rank) AS rn,
      count(*) OVER (PARTITION BY query_name) AS n_hits FROM lv) SELECT query_name, acc, bit_score, hit_rank, {_NAMES.format('lev')} AS tax_level_match, n_hits FROM r WHERE rn=1""",
)
def _(fx):
    return I.best_hits(_applied(fx, True)).select("query_name", "acc", "bit_score", "hit_rank", "tax_level_match", "n_hits")


_SCORED = f"""{_BEST}, c0 AS (SELECT c.file, c.header, c.seq, {_SAMPLE.format('c.header')} AS sample, contains(c.header,'_var') AS variant, length(c.seq) AS length, c.orderkey AS coverage,
     length(c.seq)-length(replace(replace(c.seq,'N',''),'R','')) AS ambs, CASE WHEN contains(c.header,'_var') THEN c.orderkey%2 ELSE c.orderkey%3 END AS estgaps,
     coalesce(n_hits,0) AS n_hits, coalesce(n_hits_raw,0) AS n_hits_raw, coalesce(b.lev,0) AS lev, coalesce(top,0) AS top, coalesce(b.bit,0) AS bit, b.acc AS acc, b.o AS s_order, b.p AS p_identity, b.al AS alignment_length,
     CASE WHEN n_hits_raw IS NULL THEN '' ELSE coalesce(ref.q_order,'') END AS q_order, CASE WHEN n_hits_raw IS NULL THEN '' ELSE coalesce(concat(ref.q_order,ref.q_family,ref.q_genus,ref.q_organism),'') END AS q_all
     FROM fx_cands c LEFT JOIN bh ON bh.file=c.file AND bh.query_name=c.header LEFT JOIN ref ON ref.low=lower({_SAMPLE.format('c.header')})),
   sc AS (SELECT *, 100.0*lev + CASE WHEN max(bit) OVER (PARTITION BY sample)>0 THEN 100.0*(bit/max(bit) OVER (PARTITION BY sample)) ELSE 0 END - 2.0*ambs - 2.0*estgaps AS score FROM c0)"""


@query(
    "a33_score_candidates",
    f"WITH {_SCORED} SELECT file, header, sample, n_hits, {_NAMES.format('lev')} AS level, round(score,6) AS score FROM sc",
)
def _(fx):
    cands = I.candidates(fx.cands, fx.chits, _ref(fx))
    return I.score_candidates(cands).select("file", "header", "sample", F.col("n_hits").cast("bigint").alias("n_hits"), "level", F.round("score", 6).alias("score"))


_RANKED = f"""{_SCORED}, o AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY score DESC, length DESC, coverage DESC, file, header) AS rn,
     row_number() OVER (PARTITION BY sample, variant ORDER BY score DESC, length DESC, coverage DESC, file, header) AS vrn FROM sc),
   a AS (SELECT sample, max(CASE WHEN rn=1 THEN header END) AS h1, max(CASE WHEN rn=2 THEN header END) AS h2, max(CASE WHEN vrn=1 AND NOT variant THEN header END) AS hb,
     max(CASE WHEN rn=1 THEN top END) AS t1, bool_or(rn=1 AND variant) AS v1, max(CASE WHEN vrn=1 AND NOT variant THEN top END) AS tb,
     count(*) AS n_candidates, count(DISTINCT file) AS n_files, count(DISTINCT seq)=1 AS identical FROM o GROUP BY sample),
   ch AS (SELECT *, coalesce(v1 AND hb IS NOT NULL AND t1<=tb, false) AS overruled FROM a),
   p AS (SELECT ch.*, x.file, x.header, x.seq, x.score, x.lev, x.n_hits, x.n_hits_raw, x.ambs, x.variant, x.q_all, x.q_order, x.acc, x.bit, y.file AS f2, y.score AS s2 FROM ch
     JOIN o x ON x.sample=ch.sample AND x.header=CASE WHEN overruled THEN hb ELSE h1 END
     LEFT JOIN o y ON y.sample=ch.sample AND y.header=CASE WHEN overruled THEN h1 ELSE h2 END),
   fl AS (SELECT *, CASE WHEN identical AND n_files=1 THEN 'only_one_run' WHEN identical AND n_files=5 THEN 'identical_in_all_runs' WHEN identical THEN 'identical_in_available_runs' ELSE 'resolved_by_score' END AS decision,
     array_to_string(list_filter([CASE WHEN n_hits=0 THEN CASE WHEN n_hits_raw>0 THEN 'hits_below_min_aln' ELSE 'no_blast_hit' END WHEN q_all='' THEN 'no_query_taxonomy' WHEN lev=0 THEN 'tax_mismatch' WHEN lev=1 THEN 'low_taxonomic_support' END,
       CASE WHEN NOT identical AND s2 IS NOT NULL AND abs(score-s2)<1.0 THEN 'near_tie' END,
       CASE WHEN n_files<5 THEN concat('missing_in_',5-n_files,'_run(s)') END,
       CASE WHEN variant THEN 'secondary_variant_selected' END, CASE WHEN ambs>0 THEN concat('ambs=',ambs) END], lambda x: x IS NOT NULL),';') AS flags FROM p)"""


def _best(fx):
    return I.best_sequence(I.candidates(fx.cands, fx.chits, _ref(fx)), 5)


@query(
    "a34_best_sequence",
    f"""WITH {_RANKED} SELECT sample, decision, n_candidates, n_files, file, header, seq, {_NAMES.format('lev')} AS level, n_hits, n_hits_raw, acc, round(score,2) AS score,
      CASE WHEN NOT identical THEN f2 END AS next_file, CASE WHEN NOT identical THEN round(s2,2) END AS next_score, flags, overruled FROM fl""",
)
def _(fx):
    return _best(fx).select(
        "sample", "decision", "n_candidates", F.col("n_files").cast("bigint").alias("n_files"), "file", "header", "seq", "level", "n_hits", "n_hits_raw", "acc",
        F.round("score", 2).alias("score"), "next_file", F.round("next_score", 2).alias("next_score"), "flags", "overruled",
    )


@query("a35_decisions", f"WITH {_RANKED} SELECT decision, count(*) AS n FROM fl GROUP BY 1")
def _(fx):
    return _best(fx).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a36_flag_counts",
    f"WITH {_RANKED} SELECT split_part(flag,'=',1) AS flag, count(*) AS n FROM (SELECT unnest(string_split(flags,';')) AS flag FROM fl WHERE flags<>'') t GROUP BY 1",
)
def _(fx):
    return I.flag_counts(_best(fx))


@query(
    "a37_split_identified",
    f"""WITH {_RANKED} SELECT CASE WHEN lev>0 THEN 'identified' WHEN n_hits=0 THEN 'no_blast_hit' ELSE 'tax_mismatch' END AS outcome,
      CASE WHEN lev>0 THEN '' WHEN n_hits=0 AND n_hits_raw>0 THEN 'below_min_aln' WHEN n_hits>0 AND q_all='' THEN 'no_query_tax' ELSE '' END AS reason, count(*) AS n FROM fl GROUP BY 1,2""",
)
def _(fx):
    return I.split_identified(_best(fx)).groupBy("outcome", "reason").agg(F.count(F.lit(1)).alias("n"))


_IDENT = f"""{_LEVELED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_name ORDER BY lev DESC, bit_score DESC, p_identity DESC, gap_opens, num_mismatches, hit_rank) AS rn FROM lv),
   ans AS (SELECT DISTINCT header FROM fx_cands c JOIN orders o ON o.o_orderkey=c.orderkey WHERE o_totalprice>50000),
   idt AS (SELECT c.file, c.header AS query_name, r.hit_rank, r.p_identity, CASE WHEN r.query_name IS NOT NULL THEN CASE WHEN concat(q_order,q_family,q_genus,q_organism)='' THEN 'no_reference' ELSE {_NAMES.format('lev')} END
     WHEN ans.header IS NOT NULL THEN 'no_hit' ELSE 'not_searched' END AS category
     FROM fx_cands c LEFT JOIN r ON r.rn=1 AND r.query_name=c.header LEFT JOIN ans ON ans.header=c.header)"""


def _identified(fx):
    queries = fx.cands.select("file", F.col("header").alias("query_name"))
    answered = fx.cands.join(fx.orders.filter("o_totalprice > 50000"), F.col("orderkey") == F.col("o_orderkey"), "left_semi")
    answered = answered.select(F.col("header").alias("query_name"))
    return queries, I.identify(queries, I.best_hits(_applied(fx, True)).drop("file"), answered)


@query(
    "a38_identification_summary",
    f"WITH {_IDENT} SELECT category, count(*) AS n, round(100.0*count(*)/sum(count(*)) OVER (),4) AS pct FROM idt GROUP BY 1",
)
def _(fx):
    return I.identification_summary(_identified(fx)[1])


@query(
    "a39_identity_bins",
    f"""WITH {_LEVELED}, r AS (SELECT p_identity, row_number() OVER (PARTITION BY query_name ORDER BY lev DESC, bit_score DESC, p_identity DESC, gap_opens, num_mismatches, hit_rank) AS rn FROM lv)
     SELECT CASE WHEN p_identity>=99 THEN '>=99' WHEN p_identity>=97 THEN '97-99' WHEN p_identity>=95 THEN '95-97' ELSE '<95' END AS identity, count(*) AS n FROM r WHERE rn=1 GROUP BY 1""",
)
def _(fx):
    # Only what orders the hits and what is counted travels.
    ordered = ["tax_level_match", "bit_score", "p_identity", "gap_opens", "num_mismatches", "hit_rank"]
    return I.identity_bins(I.best_hits(_applied(fx, True).select("_low", "query_name", *ordered)))


@query(
    "a39_review_counts",
    f"""WITH {_IDENT} SELECT count(*) FILTER (p_identity>0 AND p_identity<97) AS low_identity, count(*) FILTER (hit_rank<>1) AS best_not_first, count(*) FILTER (category='none') AS no_agreement,
      count(*) FILTER (category='no_hit') AS no_hit, count(*) FILTER (category='not_searched') AS not_searched FROM idt""",
)
def _(fx):
    return I.review_counts(_identified(fx)[1])


_CATS = ", ".join(f"count(*) FILTER (category='{c}') AS \"{c}\"" for c in I.CATEGORIES)


@query(
    "a40_identification_by_file",
    f"WITH {_IDENT} SELECT coalesce(file,'Total') AS file, {_CATS}, count(*) AS total FROM idt GROUP BY GROUPING SETS ((file),())",
)
def _(fx):
    return I.identification_by_file(*_identified(fx))
