"""A training corpus from documents: quality, near duplicates, benchmark passages, secrets, tokens.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes each stage's result as Parquet into the shared folder
and reads it back for the next. SQL cannot express the classifier, so there is no oracle; tests hold the stages against brute-force versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampliq.llm import bpe, decontaminate, ngram_join, quality, secret_scan
from ampliq.llm.common import stored, table
from ampliq.llm.queries import tokenizer_path

#: What stands in a text where a secret stood.
MARK = "[SECRET]"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers find good; those of poor quality and the toxic ones go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where(F.col("score") >= quality.KEEP_AT).select(docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by a similarity of 0.8 of shingles of five words: that with the smallest id, then the smallest digest of its text.

    Every row is a document of its own, also where ids repeat or are null (these
    come last in their group); documents without words link with nothing and stay.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest")
    rows = ngram_join.numbered(docs, "doc_id", "text", rest)
    names = rows.select("id", "name", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    found = ngram_join.linked(rows.select("id", "text"), width=5, p=80, q=100).join(names, "id")
    first = found.groupBy("group").agg(F.min_by("id", F.struct(F.col("name").isNull(), "name", "digest", "id")).alias("id")).select("id")
    kept = rows.join(stored(first, "kept"), "id", "left_semi")
    return kept.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item stands."""
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hit_runs") == 0).select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark where a secret or the encoding of one stood and the length told anew."""
    found = secret_scan.scan(docs, redact=MARK)
    changed = F.when(F.size("secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", changed).select(docs.columns)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids."""
    return bpe.encode(docs, tokenizer_path(), keep=["doc_id", "lang", "source"]).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("decontaminate", without_benchmark),
    ("secrets", without_secrets),
    ("tokens", as_tokens),
]

#: None: SQL expresses neither the classifier nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
