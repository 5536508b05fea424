"""Taxonomy and sequence-record XML, parsed by Spark's own XML functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANKS = ["kingdom", "class", "order", "family", "genus"]
TAXON = (
    "TaxId string, ScientificName string, Rank string, AkaTaxIds struct<TaxId: array<string>>, "
    "LineageEx struct<Taxon: array<struct<TaxId: string, ScientificName: string, Rank: string>>>"
)
_QUALS = "INSDFeature_quals: struct<INSDQualifier: array<struct<INSDQualifier_name: string, INSDQualifier_value: string>>>"
RECORD = (
    "`INSDSeq_accession-version` string, INSDSeq_organism string, "
    f"`INSDSeq_feature-table` struct<INSDFeature: array<struct<INSDFeature_key: string, {_QUALS}>>>"
)


def parse_lineages(taxa: DataFrame) -> DataFrame:
    """(taxid, five ranks) from parsed taxa: the first name of each rank, also under merged ids."""
    def named(name, rank):
        return F.named_struct(F.lit("n"), F.trim(name), F.lit("r"), F.lower(F.trim(rank)))

    own = F.array(named(F.col("ScientificName"), F.col("Rank")))
    above = F.transform(F.col("LineageEx.Taxon"), lambda t: named(t["ScientificName"], t["Rank"]))
    names = F.when(above.isNull(), own).otherwise(F.concat(own, above))
    ids = F.filter(F.concat(F.array("TaxId"), F.coalesce("AkaTaxIds.TaxId", F.array().cast("array<string>"))), lambda i: F.trim(i) != "")
    rows = taxa.filter(F.trim("TaxId") != "").select(F.explode(ids).alias("taxid"), names.alias("_n"))

    def first(rank: str):
        return F.coalesce(F.get(F.filter("_n", lambda t: t["r"] == rank), F.lit(0))["n"], F.lit("-")).alias(rank)

    return rows.select(F.trim("taxid").alias("taxid"), *[first(rank) for rank in RANKS])


def parse_organisms(records: DataFrame) -> DataFrame:
    """(acc, organism, taxid) from parsed sequence records; the taxid comes from the source feature."""
    organism = F.trim("INSDSeq_organism")
    name = F.replace(F.replace(F.translate(organism, " ", "_"), F.lit("&apos;"), F.lit("'")), F.lit("&amp;"), F.lit("&"))
    source = F.get(F.filter(F.col("`INSDSeq_feature-table`.INSDFeature"), lambda f: f["INSDFeature_key"] == "source"), F.lit(0))
    ref = F.filter(
        source["INSDFeature_quals"]["INSDQualifier"],
        lambda q: (q["INSDQualifier_name"] == "db_xref") & F.startswith(q["INSDQualifier_value"], F.lit("taxon:")),
    )
    value = F.get(ref, F.lit(0))["INSDQualifier_value"]
    acc = F.trim("`INSDSeq_accession-version`")
    out = records.select(acc.alias("acc"), name.alias("organism"), F.trim(F.substr(value, F.lit(7))).alias("taxid"))
    return out.filter("acc <> '' and organism <> ''")


def read_taxa(spark: SparkSession, paths) -> DataFrame:
    return parse_lineages(spark.read.format("xml").option("rowTag", "Taxon").schema(TAXON).load(paths))


def read_organisms(spark: SparkSession, paths) -> DataFrame:
    return parse_organisms(spark.read.format("xml").option("rowTag", "INSDSeq").schema(RECORD).load(paths))
