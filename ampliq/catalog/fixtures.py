"""Sequencing-shaped views over the given tables, the same in Spark and DuckDB.

Each view is one SQL text. ``@name`` reads another view or base table, and the
``$`` words stand for the few spellings in which the two dialects differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

_WORDS = {
    "$S": ("string", "varchar"),
    "$RX": ("regexp_replace(upper(text),'[^ACGT]','')", "regexp_replace(upper(text),'[^ACGT]','','g')"),
    "$RUNS": (
        "explode(CASE WHEN l.labelled IS NULL THEN array(1,2) ELSE array(1,2,3) END)",
        "unnest(CASE WHEN l.labelled IS NULL THEN [1,2] ELSE [1,2,3] END)",
    ),

    "$K3": ("explode(array(0,1,2))", "unnest([0,1,2])"),
    "$K10": ("explode(array(0,1,2,3,4,5,6,7,8,9))", "unnest([0,1,2,3,4,5,6,7,8,9])"),
}


def _tag(key: str) -> str:
    """A 13-letter tag spread over all 4^13 words."""
    h = f"(({key}+1)*67108859*7919+{key}*{key}*104729)%67108864"
    letters = ",".join(f"substr('ACGT',cast(floor(({h})/{4**i}.0) as bigint)%4+1,1)" for i in range(13))
    letters = letters.replace("as bigint)%4+1,1)", "as int)%4+1,1)")
    return f"concat({letters})"


VIEWS = {
    # One template per document: every A, C, G and T of its whole text.
    "fx_bases": "SELECT doc_id, lang, source, $RX AS seq FROM @documents",
    # Records of three runs; run 2 names some samples differently, run 3 holds labelled ones only.
    "fx_runs": """
        SELECT run, sample, run*100000000000+doc_id AS ord, seq,
          concat(sample,'_all.fa;',cast(length(seq) AS $S),';',cast(20+doc_id%100 AS $S),';ambs=',
            cast(length(seq)-length(replace(seq,'N','')) AS $S),';estgaps=',cast(doc_id%3 AS $S)) AS header
        FROM (SELECT run, doc_id,
            concat(CASE WHEN run=2 AND lang='fr' THEN 'X' ELSE 'S' END, lpad(cast(doc_id AS $S),9,'0')) AS sample,
            CASE (doc_id*5+run*3)%7
              WHEN 0 THEN concat(substr(seq,1,9),translate(substr(seq,10,1),'ACGT','CGTA'),substr(seq,11))
              WHEN 1 THEN concat(substr(seq,1,19),'N',substr(seq,21))
              WHEN 2 THEN reverse(translate(seq,'ACGT','TGCA'))
              WHEN 3 THEN concat(seq,'ACGTTGCAAC')
              ELSE seq END AS seq
          FROM (SELECT cast(run AS bigint) AS run, doc_id, lang, seq FROM (SELECT b.doc_id, b.lang, b.seq, $RUNS AS run
                FROM @fx_bases b LEFT JOIN (SELECT DISTINCT doc_id AS labelled FROM @labels) l ON b.doc_id=l.labelled) w) u) t""",
    # Variant records: one or two variants per record, the first also in a corrected copy.
    "fx_vars": """
        SELECT run, sample, run*100000000000000+doc_id*10+k AS ord,
          concat(substr(seq,cast(v+1 AS int)),substr(seq,1,cast(v AS int))) AS seq,
          concat(sample,'_var',cast(v AS $S),';type=',CASE WHEN k=1 THEN 'corrected' ELSE 'raw' END,
            ';len=',cast(length(seq) AS $S),';coverage=',cast(3+doc_id%20 AS $S),';fixed_indels=',cast(k AS $S),
            ';Ns=',cast(doc_id%4 AS $S),';frac=0.',cast(10+doc_id%40 AS $S),
            ';div=',CASE WHEN (doc_id+k)%11=0 THEN 'NA' ELSE concat(cast((doc_id*7+k*3+run)%70 AS $S),'%') END,
            ';tier=',CASE WHEN doc_id%2=0 THEN 'quality' ELSE 'alert' END) AS header
        FROM (SELECT run, sample, doc_id, seq, k, CASE WHEN k=2 THEN 2 ELSE 1 END AS v
          FROM (SELECT run, sample, ord%100000000000 AS doc_id, seq, $K3 AS k FROM @fx_runs) a) b""",
    # Sample sheet: one sample and one tag pair per supplier, 16 reverse tags for each forward tag.
    "fx_sheet": f"""
        SELECT concat('P',lpad(cast(s_suppkey AS $S),6,'0')) AS sample, s_suppkey AS no,
          {_tag("cast(floor(s_suppkey/16.0) AS bigint)")} AS tag_f,
          {_tag("(s_suppkey%16+1000003)")} AS tag_r,
          'ATGTCACCACAAACAGAGACTAAAGC' AS primer_f, 'GTAAAATCAAGTCCACCRCG' AS primer_r
        FROM @supplier""",
    # Reads: three per document with a known sample; odd ones reversed, every third with one tag error.
    "fx_reads": """
        SELECT read_id, truth, grp, seq, translate(seq,'ACGTRY',q) AS qual
        FROM (SELECT read_id, truth, grp, q,
            CASE WHEN read_id%2=1 THEN reverse(translate(s,'ACGTR','TGCAY')) ELSE s END AS seq
          FROM (SELECT b.doc_id*4+k AS read_id, sh.sample AS truth, b.source AS grp,
              CASE b.doc_id%3 WHEN 0 THEN '5?I+55' WHEN 1 THEN '+.,(++' ELSE '/&$''//' END AS q,
              concat(CASE WHEN k=1 THEN concat(substr(sh.tag_f,1,3),translate(substr(sh.tag_f,4,1),'ACGT','CGTA'),substr(sh.tag_f,5)) ELSE sh.tag_f END,
                sh.primer_f, b.seq, reverse(translate(replace(sh.primer_r,'R','A'),'ACGT','TGCA')), reverse(translate(sh.tag_r,'ACGT','TGCA'))) AS s
            FROM (SELECT doc_id, source, seq, $K3 AS k FROM @fx_bases) b
            JOIN @fx_sheet sh ON sh.no=b.doc_id%(SELECT count(*) FROM @supplier)) r) t""",
    # Ten aligned reads per sample; every third sample is a 60/40 mixture.
    "fx_aln": """
        SELECT concat('S',lpad(cast(doc_id AS $S),9,'0')) AS sample, doc_id*10+k AS read_id, CASE
            WHEN length(seq)<40 THEN seq
            WHEN doc_id%3=0 AND k>=6 THEN concat(substr(seq,1,14),translate(substr(seq,15,1),'ACGT','CGTA'),substr(seq,16,14),translate(substr(seq,30,1),'ACGT','GTAC'),substr(seq,31))
            WHEN k=2 THEN concat(substr(seq,1,20),'-',substr(seq,22))
            WHEN k=3 THEN concat(substr(seq,1,39),translate(substr(seq,40,1),'ACGT','TACG'),substr(seq,41))
            ELSE seq END AS aln
        FROM (SELECT doc_id, seq, $K10 AS k FROM @fx_bases) t""",
    # Expected taxonomy per order; ids of one status differ in case, of another in a separator.
    "fx_taxref": """
        SELECT CASE o.o_orderstatus WHEN 'P' THEN concat('o',lpad(cast(o.o_orderkey AS $S),9,'0'))
            WHEN 'O' THEN concat('O-',lpad(cast(o.o_orderkey AS $S),9,'0'))
            ELSE concat('O',lpad(cast(o.o_orderkey AS $S),9,'0')) END AS sample,
          CASE WHEN o.o_orderpriority='1-URGENT' THEN '' ELSE r.r_name END AS q_order,
          CASE WHEN o.o_orderpriority='1-URGENT' THEN '' ELSE n.n_name END AS q_family,
          CASE WHEN o.o_orderpriority='1-URGENT' THEN '' ELSE replace(p.p_brand,'#','') END AS q_genus,
          CASE WHEN o.o_orderpriority='1-URGENT' THEN '' ELSE concat(replace(p.p_brand,'#',''),' ',lower(p.p_type)) END AS q_organism
        FROM @orders o JOIN @customer c ON o.o_custkey=c.c_custkey JOIN @nation n ON c.c_nationkey=n.n_nationkey
        JOIN @region r ON n.n_regionkey=r.r_regionkey JOIN @part p ON p.p_partkey=o.o_custkey""",
    # Search hits: the line items of an order are the hits of one query.
    "fx_hits": """
        SELECT concat('O',lpad(cast(l_orderkey AS $S),9,'0'),'_all.fa;658;',cast(l_orderkey%50 AS $S)) AS query_name,
          concat('AC',cast(l_partkey AS $S),'.',cast(l_linenumber AS $S),'.',cast(l_suppkey AS $S)) AS acc,
          l_suppkey AS suppkey, l_partkey AS partkey, p_identity, alignment_length, l_linenumber%3 AS gap_opens, num_mismatches, bit_score,
          r.r_name AS s_order, n.n_name AS s_family, replace(p.p_brand,'#','') AS s_genus,
          concat(replace(p.p_brand,'#',''),'_',lower(p.p_type)) AS s_organism
        FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, max(100-l_discount*100) AS p_identity,
            max(cast(l_quantity*15 AS bigint)) AS alignment_length, max(cast(round(l_tax*100) AS bigint)) AS num_mismatches,
            max(round(l_extendedprice/100,1)) AS bit_score FROM @lineitem GROUP BY 1,2,3,4) l
        JOIN @part p ON l.l_partkey=p.p_partkey JOIN @supplier s ON l.l_suppkey=s.s_suppkey
        JOIN @nation n ON s.s_nationkey=n.n_nationkey JOIN @region r ON n.n_regionkey=r.r_regionkey""",
    # Candidate records: the orders of a customer are the candidates of one sample, one file per priority.
    "fx_cands": """
        SELECT file, sample, orderkey, seq, CASE WHEN status='P'
            THEN concat(sample,'_var',cast(orderkey%9+1 AS $S),';type=raw;len=',cast(length(seq) AS $S),';coverage=',cast(orderkey AS $S),';fixed_indels=',cast(orderkey%2 AS $S),';Ns=',cast(n_amb AS $S))
            ELSE concat(sample,'_all.fa;',cast(length(seq) AS $S),';',cast(orderkey AS $S),';ambs=',cast(n_amb AS $S),';estgaps=',cast(orderkey%3 AS $S)) END AS header
        FROM (SELECT file, sample, orderkey, status, seq, length(seq)-length(replace(replace(seq,'N',''),'R','')) AS n_amb
          FROM (SELECT concat('run',substr(o_orderpriority,1,1)) AS file, concat('C',lpad(cast(o_custkey AS $S),9,'0')) AS sample,
              o_orderkey AS orderkey, o_orderstatus AS status,
              translate(cast(o_custkey*7919+o_orderkey%2 AS $S),'0123456789','ACGTACGTRN') AS seq FROM @orders) a) b""",
    # Expected taxonomy per customer; one market segment has none.
    "fx_ctax": """
        SELECT concat(CASE WHEN c_mktsegment='HOUSEHOLD' THEN 'c' ELSE 'C' END,lpad(cast(c_custkey AS $S),9,'0')) AS sample,
          CASE WHEN c_mktsegment='MACHINERY' THEN '' ELSE r.r_name END AS q_order,
          CASE WHEN c_mktsegment='MACHINERY' THEN '-' ELSE n.n_name END AS q_family,
          CASE WHEN c_mktsegment='MACHINERY' THEN '' ELSE replace(p.p_brand,'#','') END AS q_genus,
          CASE WHEN c_mktsegment='MACHINERY' THEN 'NA' ELSE concat(replace(p.p_brand,'#',''),' ',lower(p.p_type)) END AS q_organism
        FROM @customer c JOIN @nation n ON c.c_nationkey=n.n_nationkey JOIN @region r ON n.n_regionkey=r.r_regionkey
        JOIN @part p ON p.p_partkey=c.c_custkey""",
    # The hits of each candidate.
    "fx_chits": """
        SELECT c.file, c.header AS query_name, h.hit_rank, h.acc, h.p_identity, h.alignment_length, h.gap_opens, h.num_mismatches,
          h.bit_score, h.s_order, h.s_family, h.s_genus, h.s_organism
        FROM @fx_cands c JOIN (SELECT *, cast(substr(query_name,2,9) AS bigint) AS orderkey,
            row_number() OVER (PARTITION BY query_name ORDER BY bit_score DESC, p_identity DESC, acc) AS hit_rank FROM @fx_hits) h
          ON h.orderkey=c.orderkey""",
}

#: Costly columns of views. A filter from above, such as a join's "key is not null", would else be written out in terms of the whole text and work the
#: column out once more for each place it stands in, row by row under the scan.
COSTLY = {"fx_bases": "seq"}

_REF = re.compile(r"@(\w+)")


def _dialect(sql: str, which: int) -> str:
    for word in sorted(_WORDS, key=len, reverse=True):
        sql = sql.replace(word, _WORDS[word][which])
    return sql


def _needs(names: list[str]) -> list[str]:
    """The views in ``names`` and all they read, in the order they are defined."""
    want, todo = set(), list(names)
    while todo:
        name = todo.pop()
        if name in VIEWS and name not in want:
            want.add(name)
            todo += _REF.findall(VIEWS[name])
    return [name for name in VIEWS if name in want]


def with_fixtures(sql: str) -> str:
    """DuckDB text of ``sql`` with the fixture views it reads as CTEs."""
    names = _needs(re.findall(r"\bfx_\w+", sql))
    ctes = [f"{n} AS ({_REF.sub(r'\1', _dialect(VIEWS[n], 1))})" for n in names]
    sql = _dialect(sql, 1)
    if not ctes:
        return sql
    if re.match(r"with\s+recursive\b", sql, re.I):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + re.sub(r"(?i)^with\s+recursive\s", "", sql)
    if re.match(r"with\b", sql, re.I):
        return "WITH " + ",\n".join(ctes) + ",\n" + re.sub(r"(?i)^with\s", "", sql)
    return "WITH " + ",\n".join(ctes) + "\n" + sql


class Fixtures:
    """The base tables and fixture views of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str, **given: DataFrame):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._made: dict[str, DataFrame] = dict(given)

    def stream(self, table: str) -> "Fixtures":
        """The same views with one base table read as a stream."""
        schema = getattr(self, table).schema
        # A pattern, since the source takes the name of one file for a folder; the table may be either.
        source = self.spark.readStream.schema(schema).parquet(f"{self.sf_dir}/{table}[.]parquet")
        return Fixtures(self.spark, self.sf_dir, **{table: source})

    def _base(self, key: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{key}.parquet")
        if key == "documents":
            # Long texts in few row groups would leave most cores idle.
            df = df.repartition(self.spark.sparkContext.defaultParallelism)
        return df

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        key = name if name in BASE else f"fx_{name}"
        if key not in self._made:
            if key in BASE:
                self._made[key] = self._base(key)
            elif key in VIEWS:
                text = _dialect(VIEWS[key], 0).replace("{", "{{").replace("}", "}}")
                args = {n: getattr(self, n.removeprefix("fx_")) for n in _REF.findall(text)}
                made = self.spark.sql(_REF.sub(r"{\1}", text), **args)
                if key in COSTLY:
                    # Always true, but not deterministic to Spark, so no filter is moved below it; where nobody reads the column it still goes.
                    made = made.withColumn(COSTLY[key], F.when(F.spark_partition_id() >= 0, F.col(COSTLY[key])))
                self._made[key] = made
            else:
                raise AttributeError(name)
        return self._made[key]
