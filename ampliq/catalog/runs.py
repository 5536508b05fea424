"""Work across runs: comparison, deduplication, coverage and parameter grids."""

from pyspark.sql import functions as F

from ..functions.headers import variant_host
from ..operators import compare as C
from ..operators import runs as R
from .registry import query


def _recs(fx):
    return C.parse_records(fx.runs)


_RECS = """recs AS (SELECT run, ord, header, sample AS id, seq, length(seq) AS length, 20+(ord%100000000000)%100 AS cov, length(seq)-length(replace(seq,'N','')) AS ambs, (ord%100000000000)%3 AS gaps FROM fx_runs)"""
# Ids shared on purpose: the language of a document stands for the sample.
_LANG = """recs AS (SELECT r.run, r.ord, d.lang AS id, r.seq, length(r.seq) AS length, 20+d.doc_id%100 AS cov, length(r.seq)-length(replace(r.seq,'N','')) AS ambs, d.doc_id%3 AS gaps
   FROM fx_runs r JOIN documents d ON d.doc_id=r.ord%100000000000)"""


@query(
    "a20_dedupe_ids",
    f"""WITH {_LANG} SELECT run, id, arg_min(ord, struct_pack(a:=ambs,b:=gaps,c:=-cov,d:=ord)) AS ord, count(*) AS copies FROM recs GROUP BY run, id""",
)
def _(fx):
    doc = fx.documents.select("doc_id", "lang")
    recs = _recs(fx).withColumn("doc_id", F.col("ord") % 100000000000).join(doc, "doc_id").withColumn("id", F.col("lang"))
    return C.dedupe_ids(recs.drop("doc_id", "lang")).select("run", "id", "ord", "copies")


@query(
    "a21_best_barcode",
    f"""WITH {_RECS}, b AS (SELECT *, rank() OVER (PARTITION BY id ORDER BY ambs, gaps, cov DESC) AS rk FROM recs)
    SELECT id, min(run) AS best_run, count(*)>1 AS tie FROM b WHERE rk=1 GROUP BY id""",
)
def _(fx):
    return C.best_barcode(_recs(fx)).select("id", "best_run", "tie")


_RC = "reverse(translate({},'ACGTN','TGCAN'))"


@query(
    "a22_variant_groups",
    f"""WITH {_RECS}, k AS (SELECT id, run, least(seq,{_RC.format('seq')}) AS k FROM recs), f AS (SELECT id, k, min(run) AS first FROM k GROUP BY 1,2),
     n AS (SELECT id, k, row_number() OVER (PARTITION BY id ORDER BY first) AS variant FROM f) SELECT k.id, run, variant FROM k JOIN n ON n.id=k.id AND n.k=k.k""",
)
def _(fx):
    return C.variant_groups(_recs(fx)).withColumn("variant", F.col("variant").cast("bigint"))


@query("a22_variant_groups_ends")
def _(fx):
    return C.variant_groups(_recs(fx), ignore_ends=True)


def _match(a, b):
    return f"length({a})=length({b}) AND coalesce(list_sum(list_transform(list_zip(string_split({a},''),string_split({b},'')), lambda p: CASE WHEN p[1]=p[2] OR p[1]='N' OR p[2]='N' THEN 0 ELSE 1 END)),0)=0"


_PAIRS = f"""{_RECS}, d AS (SELECT DISTINCT id, seq FROM recs), p AS (SELECT a.id, a.seq AS x, b.seq AS y FROM d a JOIN d b ON a.id=b.id AND a.seq<b.seq),
   st AS (SELECT id, x, y, CASE WHEN {_match('x', 'y')} THEN 1 WHEN {_RC.format('x')}=y THEN 0 WHEN {_match(_RC.format('x'), 'y')} THEN 1 ELSE 2 END AS s FROM p),
   w AS (SELECT id, max(s) AS s FROM st GROUP BY id), n AS (SELECT id, count(*) AS n_runs, min(run) AS only_run FROM recs GROUP BY id),
   states AS (SELECT n.id, n_runs, CASE WHEN n_runs=1 THEN 'unique' ELSE list_extract(['identical','compatible','different'],cast(coalesce(s,0) AS int)+1) END AS state, CASE WHEN n_runs=1 THEN only_run END AS only_in FROM n LEFT JOIN w ON w.id=n.id)"""


@query("a23_id_states", f"WITH {_PAIRS} SELECT * FROM states")
def _(fx):
    return C.id_states(_recs(fx)).select("id", "n_runs", "state", "only_in")


@query("a23_compare_report")
def _(fx):
    return C.compare_report(_recs(fx), [1, 2, 3])


@query("a24_compare_outputs", f"""WITH {_PAIRS}, b AS (SELECT id, run, row_number() OVER (PARTITION BY id ORDER BY ambs, gaps, cov DESC, run) AS rn, row_number() OVER (PARTITION BY id ORDER BY run) AS fr, seq FROM recs)
   SELECT 'best' AS set, id, run, seq FROM b WHERE rn=1 UNION ALL SELECT state, b.id, run, seq FROM b JOIN states s ON s.id=b.id WHERE state IN ('different','unique') OR fr=1""")
def _(fx):
    return C.compare_outputs(_recs(fx))


@query("a25_compare_summary", f"WITH {_PAIRS} SELECT state, count(*) AS n FROM states GROUP BY 1")
def _(fx):
    return C.compare_summary(C.id_states(_recs(fx)))


@query("j10_compare_all")
def _(fx):
    return C.compare_all(_recs(fx))


@query("j11_compare_ref")
def _(fx):
    return C.compare_ref(_recs(fx), 1)


@query(
    "j11_compare_ref_report",
    f"""WITH {_RECS}, r AS (SELECT * FROM recs WHERE run=1), o AS (SELECT * FROM recs WHERE run<>1),
     j AS (SELECT coalesce(r.id,o.id) AS id, o.run, CASE WHEN o.id IS NULL THEN 4 WHEN r.id IS NULL THEN 3 WHEN r.seq=o.seq THEN 0
        WHEN {_match('r.seq', 'o.seq')} THEN 1 WHEN {_RC.format('r.seq')}=o.seq THEN 0 WHEN {_match(_RC.format('r.seq'), 'o.seq')} THEN 1 ELSE 2 END AS s FROM r FULL JOIN o ON r.id=o.id)
    SELECT id, list_extract(['identical','compatible','different','not_in_reference','only_in_reference'],cast(max(s) AS int)+1) AS state, count(run) AS n_runs FROM j GROUP BY id""",
)
def _(fx):
    return C.compare_ref_report(_recs(fx), 1).select("id", "state", "n_runs")


@query("a26_id_match_summary", "SELECT run, count(DISTINCT sample) AS ids, count(*)-count(DISTINCT sample) AS repeated, 0 AS unmatched FROM fx_runs GROUP BY run")
def _(fx):
    return C.id_match_summary(_recs(fx))


@query("set3_shared_ids", "SELECT sample AS id FROM fx_runs GROUP BY 1 HAVING count(DISTINCT run)=3")
def _(fx):
    return C.shared_ids(_recs(fx), 3)


@query("set2_all_ids", "SELECT DISTINCT sample AS id FROM (SELECT sample FROM fx_runs UNION ALL SELECT sample FROM fx_vars) t")
def _(fx):
    return C.all_ids(_recs(fx), fx.vars.select(F.col("sample").alias("id")))


@query(
    "set4_only_in_first",
    "SELECT DISTINCT sample AS id FROM fx_runs WHERE run=1 AND sample NOT IN (SELECT sample FROM fx_runs WHERE run=2)",
)
def _(fx):
    return C.only_in(_recs(fx), 1, 2)


_DEDUP = """WITH s AS (SELECT sample, seq, arg_min(header, ord) AS header, arg_min(run, ord) AS run, min(ord) AS ord FROM fx_runs GROUP BY 1,2), n AS (SELECT sample, count(*) AS n_variants FROM s GROUP BY 1)"""


@query(
    "a27_dedup_runs",
    f"{_DEDUP} SELECT s.sample, CASE WHEN n_variants=1 THEN header ELSE concat(header,';run',run) END AS header, seq, run, ord FROM s JOIN n ON n.sample=s.sample",
)
def _(fx):
    return R.dedup_runs(fx.runs)


@query(
    "a27_dedup_report",
    f"""{_DEDUP}, d AS (SELECT DISTINCT sample, run FROM fx_runs), r AS (SELECT sample, count(*) AS n, string_agg(cast(run AS varchar),',' ORDER BY run) AS t FROM d GROUP BY 1)
    SELECT n.sample, n_variants, r.n AS n_runs_present, 3 AS n_runs_total, CASE t WHEN '1,2' THEN '1..2' WHEN '2,3' THEN '2..3' WHEN '1,2,3' THEN '1..3' ELSE t END AS runs FROM n JOIN r ON r.sample=n.sample""",
)
def _(fx):
    return R.dedup_report(fx.runs, 3)


@query(
    "a27_dedup_summary",
    f"{_DEDUP} SELECT count(*) AS n_samples, count(*) FILTER (n_variants=1) AS n_collapsed, count(*) FILTER (n_variants>1) AS n_with_variants, cast(sum(n_variants) AS bigint) AS n_written FROM n",
)
def _(fx):
    return R.dedup_summary(R.dedup_report(fx.runs, 3))


@query(
    "a28_merge_runs",
    """WITH u AS (SELECT 'consensus' AS kind, sample, seq, header, run, ord FROM fx_runs UNION ALL SELECT 'variant', regexp_replace(split_part(header,';',1),'^(.*)_var.*$','\\1'), seq, header, run, ord FROM fx_vars),
     s AS (SELECT kind, sample, seq, arg_min(header, struct_pack(a:=run,b:=ord)) AS header, min(run) AS run FROM u GROUP BY 1,2,3), n AS (SELECT kind, sample, count(*) AS n FROM s GROUP BY 1,2)
    SELECT s.kind, s.sample, CASE WHEN n=1 THEN header ELSE concat(header,';run',run) END AS header, seq, run FROM s JOIN n ON n.kind=s.kind AND n.sample=s.sample""",
)
def _(fx):
    return R.merge_runs(fx.runs, fx.vars.drop("sample")).drop("ord")


_VARS = """v AS (SELECT run, split_part(header,';',1) AS name, arg_min(try_cast(regexp_extract(header,';div=([^;%]*)%?',1) AS double)/100.0, ord) FILTER (NOT contains(header,'type=corrected')) AS div_raw,
     bool_or(NOT contains(header,'type=corrected')) AS has_raw, arg_min(coalesce(try_cast(regexp_extract(header,';div=([^;%]*)%?',1) AS double)/100.0,-1), struct_pack(c:=contains(header,'type=corrected'),o:=ord)) AS div FROM fx_vars GROUP BY 1,2),
   vs AS (SELECT run, regexp_replace(name,'^(.*)_var.*$','\\1') AS sample, count(*) AS n_variants, max(CASE WHEN div>=0 THEN div END) AS max_div FROM v GROUP BY 1,2)"""


@query("a30_variants_per_sample", f"WITH {_VARS} SELECT * FROM vs")
def _(fx):
    return R.variants_per_sample(fx.vars)


def _run(fx, run):
    """One run as its QC barcodes (those without ambiguity), filtered barcodes and variants."""
    recs = fx.runs.filter(F.col("run") == run)
    return {
        "qc": recs,
        "filtered": recs.filter(~F.contains("seq", F.lit("N"))),
        "variants": fx.vars.filter(F.col("run") == run).drop("run"),
    }


_TWO = f"""WITH {_VARS}, ids AS (SELECT DISTINCT sample FROM fx_runs), a AS (SELECT * FROM fx_runs WHERE run=1), b AS (SELECT * FROM fx_runs WHERE run=3),
   va AS (SELECT * FROM vs WHERE run=1), vb AS (SELECT * FROM vs WHERE run=3),
   t AS (SELECT ids.sample, a.seq AS qa, b.seq AS qb, CASE WHEN contains(a.seq,'N') THEN '' ELSE coalesce(a.seq,'') END AS fa, CASE WHEN contains(b.seq,'N') THEN '' ELSE coalesce(b.seq,'') END AS fb,
      coalesce(va.n_variants,0) AS na, coalesce(vb.n_variants,0) AS nb, va.max_div AS da, vb.max_div AS db
     FROM ids LEFT JOIN a ON a.sample=ids.sample LEFT JOIN b ON b.sample=ids.sample LEFT JOIN va ON va.sample=ids.sample LEFT JOIN vb ON vb.sample=ids.sample WHERE a.sample IS NOT NULL OR b.sample IS NOT NULL OR va.sample IS NOT NULL OR vb.sample IS NOT NULL),
   c AS (SELECT *, array_to_string(list_filter([CASE WHEN coalesce(qa,'')<>'' AND coalesce(qb,'')='' THEN 'QC barcode only in A' WHEN coalesce(qa,'')='' AND coalesce(qb,'')<>'' THEN 'QC barcode only in B' WHEN coalesce(qa,'')<>'' AND qa<>qb THEN 'QC barcode differs' END,
      CASE WHEN fa<>'' AND fb='' THEN 'filtered barcode only in A' WHEN fa='' AND fb<>'' THEN 'filtered barcode only in B' WHEN fa<>'' AND fa<>fb THEN 'filtered barcode differs' END,
      CASE WHEN na=0 AND nb>0 THEN 'variants only in B' WHEN nb=0 AND na>0 THEN 'variants only in A' WHEN na<>nb THEN 'variant count differs' END], lambda x: x IS NOT NULL),'; ') AS changes FROM t)"""


@query(
    "j12_compare_two",
    f"""{_TWO} SELECT sample, CASE WHEN qa IS NULL THEN 'no' ELSE 'yes' END AS qc_a, CASE WHEN qb IS NULL THEN 'no' ELSE 'yes' END AS qc_b, CASE WHEN fa='' THEN 'no' ELSE 'yes' END AS filtered_a, CASE WHEN fb='' THEN 'no' ELSE 'yes' END AS filtered_b,
      CASE WHEN fa<>'' AND fb<>'' THEN CASE WHEN fa=fb THEN 'yes' ELSE 'no' END ELSE '' END AS same_filtered, na AS variants_a, nb AS variants_b,
      CASE WHEN da IS NOT NULL THEN printf('%.1f',da*100) WHEN na>0 THEN 'NA' ELSE '' END AS max_div_a, CASE WHEN db IS NOT NULL THEN printf('%.1f',db*100) WHEN nb>0 THEN 'NA' ELSE '' END AS max_div_b, changes FROM c WHERE changes<>''""",
)
def _(fx):
    return R.compare_two(_run(fx, 1), _run(fx, 3))


@query("j12_change_counts", f"{_TWO} SELECT change, count(*) AS n FROM (SELECT unnest(string_split(changes,'; ')) AS change FROM c WHERE changes<>'') t GROUP BY 1")
def _(fx):
    return R.change_counts(R.compare_two(_run(fx, 1), _run(fx, 3)))


@query(
    "j16_identical_to_others",
    """WITH b AS (SELECT DISTINCT sample, seq FROM fx_runs) SELECT r.ord, count(*) AS n_others FROM fx_runs r JOIN b ON b.seq=r.seq AND b.sample<>r.sample GROUP BY 1""",
)
def _(fx):
    return R.identical_to_others(fx.runs.select("ord", "sample", "seq"), fx.runs).select("ord", "n_others")


def _winners(fx):
    return fx.runs.filter("run = 3").select(F.col("sample").alias("label"), F.col("sample").alias("host"), "seq")


def _coverage(fx):
    produced = fx.runs.select("run", F.col("sample").alias("host"), "seq").unionByName(
        fx.vars.select("run", variant_host("header").alias("host"), "seq")
    )
    return R.winner_coverage(_winners(fx), produced)


@query(
    "j14_winner_coverage",
    """SELECT DISTINCT w.sample AS label, p.run FROM (SELECT * FROM fx_runs WHERE run=3) w
     JOIN (SELECT run, sample, seq FROM fx_runs UNION ALL SELECT run, regexp_replace(split_part(header,';',1),'^(.*)_var.*$','\\1'), seq FROM fx_vars) p ON p.sample=w.sample AND p.seq=w.seq""",
)
def _(fx):
    return _coverage(fx)


def _order_coverage(fx):
    """Orders as winners and suppliers' nations as the runs that cover them."""
    nation = fx.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("bigint").alias("run"))
    return fx.lineitem.select(F.col("l_orderkey").alias("label"), "l_suppkey").join(nation, "l_suppkey").select("label", "run").distinct()


_COV = "WITH c AS (SELECT DISTINCT l_orderkey AS label, cast(s_nationkey AS bigint) AS run FROM lineitem JOIN supplier ON l_suppkey=s_suppkey)"


@query(
    "a41_minimal_runs",
    """WITH RECURSIVE c AS (SELECT DISTINCT l_orderkey AS label, cast(s_nationkey AS bigint) AS run FROM lineitem JOIN supplier ON l_suppkey=s_suppkey),
     sets AS (SELECT runs, count(*) AS n FROM (SELECT label, list_sort(list(run)) AS runs FROM c GROUP BY label) x GROUP BY runs),
     g AS (SELECT 0 AS step, cast(NULL AS bigint) AS run, cast(0 AS bigint) AS gain, cast(0 AS bigint) AS covered, cast([] AS bigint[]) AS chosen
       UNION ALL SELECT step+1, best.run, best.gain, covered+best.gain, list_append(chosen,best.run)
       FROM (SELECT g.step, g.covered, g.chosen, (SELECT arg_max({'run':run,'gain':gain},gain*1000-run) FROM (SELECT run, cast(sum(n) AS bigint) AS gain FROM (SELECT unnest(runs) AS run, n FROM sets WHERE NOT list_has_any(runs,g.chosen)) u GROUP BY run) v) AS best FROM g) w
       WHERE best IS NOT NULL)
    SELECT cast(step AS int) AS step, run, gain, covered, round(100.0*covered/(SELECT sum(n) FROM sets),1) AS covered_pct FROM g WHERE step>0""",
)
def _(fx):
    return R.minimal_runs(_order_coverage(fx))


@query("a41_never_covered", f"{_COV} SELECT o_orderkey AS label FROM orders WHERE o_orderkey NOT IN (SELECT label FROM c)")
def _(fx):
    return R.never_covered(fx.orders.select(F.col("o_orderkey").alias("label")), _order_coverage(fx))


@query(
    "a42_non_dominated_runs",
    """WITH c AS (SELECT DISTINCT l_orderkey AS label, p_size AS run FROM lineitem JOIN part ON l_partkey=p_partkey), s AS (SELECT run, count(*) AS hits FROM c GROUP BY run),
     o AS (SELECT a.run, b.run AS other, count(*) AS n FROM c a JOIN c b ON a.label=b.label AND a.run<>b.run GROUP BY 1,2)
    SELECT s.run, s.hits FROM s WHERE NOT EXISTS (SELECT 1 FROM o JOIN s t ON t.run=o.other WHERE o.run=s.run AND o.n=s.hits AND (t.hits>s.hits OR t.hits=s.hits AND t.run<s.run))""",
)
def _(fx):
    part = fx.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("run"))
    cover = fx.lineitem.join(part, "l_partkey").select(F.col("l_orderkey").alias("label"), "run")
    return R.non_dominated_runs(cover.distinct())


@query("a43_coverage_summary", f"{_COV} SELECT run, count(*) AS hits, round(100.0*count(*)/(SELECT count(*) FROM orders),1) AS pct FROM c GROUP BY run")
def _(fx):
    return R.coverage_summary(_order_coverage(fx), fx.orders.count())


@query(
    "a43_coverage_extremes",
    f"""{_COV}, h AS (SELECT run, count(*) AS hits FROM c GROUP BY run) SELECT arg_max(run, hits*1000-run) AS best_run, max(hits) AS best_hits, arg_min(run, hits*1000+run) AS worst_run, min(hits) AS worst_hits, round(avg(hits),1) AS average_hits FROM h""",
)
def _(fx):
    return R.coverage_extremes(R.coverage_summary(_order_coverage(fx), 1))


def _grid(fx):
    taxes = fx.lineitem.select(F.lit("minq").alias("key"), F.round(F.col("l_tax") * 100).cast("int").alias("pos")).distinct()
    sizes = fx.part.select(F.lit("qclentol").alias("key"), F.col("p_size").alias("pos")).distinct()
    values = taxes.unionByName(sizes).select("key", F.col("pos").cast("string").alias("value"), "pos")
    return R.expand_grid(values, ["minq", "qclentol"])


@query(
    "set5_expand_grid",
    "SELECT a.v AS minq, b.v AS qclentol FROM (SELECT DISTINCT round(l_tax*100) AS v FROM lineitem) a CROSS JOIN (SELECT DISTINCT cast(p_size AS double) AS v FROM part) b",
)
def _(fx):
    return _grid(fx).select("minq", "qclentol")


@query(
    "win6_phase1_reuse",
    """WITH g AS (SELECT a.v AS minq, b.v AS qclentol, row_number() OVER (ORDER BY a.v, b.v) AS run FROM (SELECT DISTINCT round(l_tax*100) AS v FROM lineitem) a CROSS JOIN (SELECT DISTINCT cast(p_size AS double) AS v FROM part) b)
    SELECT run, minq, qclentol, coalesce(lag(minq) OVER (ORDER BY run)=minq, false) AS reused FROM g""",
)
def _(fx):
    from ..operators.ordering import running

    combos = running(_grid(fx), ["place"], number="run").drop("place")
    return R.phase1_reuse(combos, ["minq"])


@query(
    "set5_apply_overrides",
    """SELECT p_size/100.0 AS frac, CAST(5 AS double) AS minq, least(0.2, p_size/100.0) AS minor_thresh FROM (SELECT DISTINCT cast(p_size AS double) AS p_size FROM part WHERE p_size>=10) t""",
)
def _(fx):
    key = "resolve_mixed.min_secondary_frac"
    sizes = fx.part.filter("p_size >= 10").select(F.lit(key).alias("key"), F.col("p_size").cast("string").alias("value"), F.col("p_size").alias("pos")).distinct()
    combos = R.apply_overrides(R.expand_grid(sizes, [key]), {"minq": 5})
    return combos.select(F.col(f"`{key}`").alias("frac"), "minq", F.col("`resolve_mixed.minor_thresh`").alias("minor_thresh"))
