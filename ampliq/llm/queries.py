"""The registered queries of this package and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, fingerprints, html_text, lexical_search, ngram_join, prefix_trie, quality, secret_scan, sharding, suffix_dedup, topk_search, warc
from .common import stored, table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by a Jaccard similarity of 0.9 or more of their shingles of three words."""
    return ngram_join.groups(table(spark, sf_dir, "documents"), width=3, p=90, q=100)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives with revisits of equal payloads, and the archives read back."""
    manifest = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents on a ring of 16 shards whose row counts differ by at most one."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return sharding.bounded_ring(rows, "doc_id", 16).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' fingerprints against those of their edited texts and of the next documents."""
    made = fingerprints.edits(table(spark, sf_dir, "documents"))

    def line(c: str):
        return F.translate(F.base64(c), "\r\n", "").alias(c)

    return made.select("doc_id", "n_chars", "edited_sha256", line("fingerprint"), line("edited_fingerprint"), "near_edited", "near_next")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in documents and in what is encoded in them."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("secrets", lambda s: s["via"] == "")

    def listed(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in secret_scan.KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of documents under strings of 100 bytes that stand earlier too."""
    done = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    n = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    return done.select("doc_id", "n_bytes", n.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded with a public byte-level vocabulary and decoded again."""
    ids = bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(), keep=["doc_id"], decoded="decoded")
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside windows of ten words that also stand in benchmark items."""
    found = decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    ids = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.main_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"]).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of good quality, from two views trained on each other's labels."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, keep=["doc_id"]).withColumn("keep", F.col("score") >= quality.KEEP_AT)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix of the conversations, each of which begins with the first turns of another one."""
    own = stored(prefix_trie.turns(table(spark, sf_dir, "conversations")), "turns")
    return prefix_trie.nodes(*prefix_trie.branched(own)).drop("key")


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest integer inner products of every 50th vector with all others."""
    rows = topk_search.whole(table(spark, sf_dir, "embeddings"))
    return topk_search.search(topk_search.build(rows), rows.where("id % 50 = 0"), k=5)


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item's twenty documents with the highest scores."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


OP8_SQL = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS v
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
places AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS v
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
found AS (SELECT p.doc_id, p.i, p.size, b.item_id FROM places p JOIN windows b USING (size, v)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

#: CRC-32 bit by bit, as DuckDB has no function for it; 3988292384 is its polynomial.
OP11_SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda acc, b: list_reduce(list_concat([xor(acc, b)], range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT c.conv_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY t.conv_id <> c.base OR t.place > c.h, t.place) AS depth, t.role, t.text
  FROM convs c JOIN turns t ON (t.conv_id = c.base AND t.place <= c.h) OR (t.conv_id = c.conv_id AND t.place > c.h)),
paths AS (
  SELECT conv_id, depth, text, string_agg(md5(strlen(role)::VARCHAR || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', '' FROM convs),
ending AS (SELECT conv_id, arg_max(key, depth) AS key FROM paths GROUP BY conv_id),
ended AS (SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM ending GROUP BY key),
nodes AS (
  SELECT key, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, len(regexp_extract_all(any_value(text), '[^\\x20\\x09-\\x0D]+')) AS words
  FROM paths GROUP BY key),
kids AS (SELECT key[:-33] AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
facts AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (key)),
sums AS (
  SELECT a.key, sum((f.n_children = 0)::INT) AS n_leaves, sum((f.n_convs - 1) * f.words) AS saved
  FROM facts f JOIN paths a ON a.conv_id = f.conv_id AND a.depth <= f.depth GROUP BY a.key)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM facts f JOIN sums s USING (key) LEFT JOIN ended e USING (key) LEFT JOIN nodes p ON f.depth > 0 AND p.key = f.key[:-33]
"""

OP12_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.row, a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.row <> b.row AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INT AS rank FROM pairs) WHERE rank <= 5
"""

OP13_SQL = """
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, row_number() OVER () AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
asked AS (SELECT item, t, count(*) AS times FROM (SELECT item, unnest(w) AS t FROM items) GROUP BY ALL),
totals AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM docs WHERE len(w) > 0),
tfs AS (SELECT row, t, count(*) AS tf FROM (SELECT row, unnest(w) AS t FROM docs) WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
weights AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, totals GROUP BY t, n_docs),
m AS (SELECT row, doc_id, 75 + ((25 * len(w) * n_docs)::BIGINT // n_terms) AS m FROM docs, totals),
scores AS (
  SELECT item, doc_id, row, sum(times * weights.w * ((1000000000 * tf)::BIGINT // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (t) JOIN tfs USING (t) JOIN m USING (row) WHERE doc_id IS NOT NULL GROUP BY item, doc_id, row)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INT AS rank FROM scores WHERE score > 0) JOIN items USING (item) WHERE rank <= 20
"""


QUERIES = {
    "op6_suffix_dedup": op6_suffix_dedup,
    "op1_ngram_join": op1_ngram_join,
    "op2_warc": op2_warc,
    "op4_fingerprints": op4_fingerprints,
    "op5_secrets": op5_secrets,
    "op7_bpe": op7_bpe,
    "op8_decontaminate": op8_decontaminate,
    "op9_html_text": op9_html_text,
    "op10_quality": op10_quality,
    "op3_sharding": op3_sharding,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_topk": op12_topk,
    "op13_lexical": op13_lexical,
}

ORACLES: dict[str, str] = {
    "op8_decontaminate": OP8_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_topk": OP12_SQL,
    "op13_lexical": OP13_SQL,
}
