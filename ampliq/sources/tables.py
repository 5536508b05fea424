"""Text tables: sample sheets, hits, taxonomy, identifications, lookups, run summaries.

The ``parse_*`` functions work on rows any reader delivered; the ``read_*``
functions look at the first line of a file on the driver to learn its layout
and leave the rest to Spark's readers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.headers import parameter_map
from ..functions.text import normalize_cell, parse_number
from ..operators.ordering import first_per, top_n_per

# Windows-1252 letters at the code points Latin-1 leaves to controls.
CP1252_FROM = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
CP1252_TO = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
# Columns of a hit table and the names they get here.
HIT_COLUMNS = {
    "Hit_rank": "hit_rank", "Query_name": "query_name", "Subject_accession.ver": "acc", "P_identity": "p_identity",
    "Alignment_length": "alignment_length", "Num_mismatches": "num_mismatches", "Gap_opens": "gap_opens",
    "Query_start": "query_start", "Query_end": "query_end", "Subject_start": "subject_start", "Subject_end": "subject_end",
    "Evalue": "evalue", "Bit_score": "bit_score", "Subject_Kingdom": "s_kingdom", "Subject_Class": "s_class",
    "Subject_Order": "s_order", "Subject_Family": "s_family", "Subject_Genus": "s_genus", "Subject_organism": "s_organism",
    "Query_Order": "q_order", "Query_Family": "q_family", "Query_Genus": "q_genus", "Query_organism": "q_organism",
    "Tax_level_match": "tax_level_match",
}
HIT_NUMBERS = ["hit_rank", "p_identity", "alignment_length", "num_mismatches", "gap_opens", "query_start", "query_end", "subject_start", "subject_end", "evalue", "bit_score"]
# The twelve columns of a search service's tabular output.
NCBI_COLUMNS = ["query_name", "acc", "p_identity", "alignment_length", "num_mismatches", "gap_opens", "query_start", "query_end", "subject_start", "subject_end", "evalue", "bit_score"]
# Header names of an identifier column.
ID_NAMES = ["sample", "sample_id", "sampleid", "id", "code", "voucher", "query", "query_name"]


def decode_bytes(content) -> Column:
    """Text of a small file: UTF-8 with or without mark, else Windows-1252."""
    content = F.col(content) if isinstance(content, str) else content
    other = F.translate(F.decode(content, "ISO-8859-1"), CP1252_FROM, CP1252_TO)
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(other)
    return F.regexp_replace(text, "^\ufeff", "")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Numbered lines of small files, whatever their encoding."""
    text = spark.read.format("binaryFile").load(path).select("path", decode_bytes("content").alias("_t"))
    return text.select("path", F.posexplode(F.split("_t", r"\r\n|\n|\r")).alias("no", "line"))


def _cells(lines: DataFrame, sep: str) -> DataFrame:
    """Stripped cells of each line as an array, quotes honoured."""
    width = lines.agg(F.max(F.size(F.split("line", "\\Q" + sep + "\\E")))).first()[0] or 1
    schema = ", ".join(f"c{i} string" for i in range(width))
    row = F.from_csv("line", F.lit(schema), {"sep": sep, "mode": "PERMISSIVE"})
    cells = F.transform(F.array(*[row[f"c{i}"] for i in range(width)]), lambda c: F.trim(F.coalesce(c, F.lit("")), F.lit(" \t")))
    return lines.select("path", "no", cells.alias("cells"))


def parse_sample_sheet(rows: DataFrame) -> DataFrame:
    """Samples with tags and primer pairs from (no, cells); a row without tags is an error."""
    used = rows.filter((F.size("cells") > 0) & (F.get("cells", F.lit(0)) != ""))
    tag_f, tag_r = (F.upper(F.coalesce(F.get("cells", F.lit(i)), F.lit(""))) for i in (1, 2))
    problem = F.concat(F.lit("sample sheet line "), (F.col("no") + 1).cast("string"), F.lit(": sample needs two tags"))
    checked = F.when((tag_f != "") & (tag_r != ""), tag_f).otherwise(F.raise_error(problem))
    primers = F.slice(F.col("cells"), F.lit(4), F.greatest(F.size("cells") - 3, F.lit(0)))
    return used.select("no", F.get("cells", F.lit(0)).alias("sample"), checked.alias("tag_f"), tag_r.alias("tag_r"), primers.alias("primers"))


def read_sample_sheet(spark: SparkSession, path: str) -> DataFrame:
    return parse_sample_sheet(_cells(_lines(spark, path), ","))


def sheet_primers(sheet: DataFrame) -> DataFrame:
    """Primers of the first row as (side, ordinal, seq); the other rows' primers are not used."""
    first = first_per(sheet.select(F.lit(1).alias("one"), "no", "primers"), ["one"], ["no"])
    p = first.select(F.posexplode("primers").alias("i", "seq")).filter("seq <> ''")
    return p.select(
        F.when(F.col("i") % 2 == 0, "forward").otherwise("reverse").alias("side"), F.floor(F.col("i") / 2).cast("int").alias("ordinal"), "seq"
    )


def _sniff(spark: SparkSession, path: str) -> tuple[str, str]:
    first = next((r.value for r in spark.read.text(path).limit(1).collect()), "")
    return first, "\t" if "\t" in first else ","


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """A hit table with its delimiter found from the first line, typed columns and short names."""
    head, sep = _sniff(spark, path)
    names = [h.strip() for h in head.lstrip("\ufeff").split(sep)]
    missing = [n for n in ("Query_name", "Subject_Order", "Subject_Family", "Subject_Genus", "Subject_organism") if n not in names]
    if missing:
        raise ValueError(f"hit table without {', '.join(missing)}")
    # Of a repeated column the last one counts.
    schema = ", ".join(f"`_{i}` string" for i in range(len(names)))
    raw = spark.read.schema(schema).csv(path, sep=sep, header=True, enforceSchema=True)
    last = {n: i for i, n in enumerate(names)}
    cols = []
    for name, i in last.items():
        short = HIT_COLUMNS.get(name, name)
        value = F.trim(F.col(f"_{i}"))
        cols.append((parse_number(value) if short in HIT_NUMBERS else value).alias(short))
    ordered = raw.withColumn("ord", F.monotonically_increasing_id())
    return ordered.select("ord", *cols).filter("query_name <> ''")


def parse_ncbi_rows(cells: DataFrame, nhits: int) -> DataFrame:
    """First ``nhits`` rows of each query from (ord, cells of twelve columns), ranked in source order."""
    typed = cells.select(
        "ord",
        *[
            (F.get("cells", F.lit(i)) if i < 2 else parse_number(F.get("cells", F.lit(i)))).alias(n)
            for i, n in enumerate(NCBI_COLUMNS)
        ],
    )
    return top_n_per(typed, ["query_name"], [F.col("ord")], nhits, number="hit_rank")


def parse_ncbi_tabular(lines: DataFrame, nhits: int) -> DataFrame:
    """Tabular search output from (ord, line): comment lines left out."""
    rows = lines.filter(~F.startswith("line", F.lit("#")) & (F.trim("line") != ""))
    return parse_ncbi_rows(rows.select("ord", F.split("line", "\t").alias("cells")), nhits)


def parse_ncbi_csv(lines: DataFrame, nhits: int) -> DataFrame:
    """Header-less comma-separated search output from (ord, line)."""
    return parse_ncbi_rows(lines.filter(F.trim("line") != "").select("ord", F.split("line", ",").alias("cells")), nhits)


def _text(spark: SparkSession, paths) -> DataFrame:
    return spark.read.text(paths).select(
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).alias("ord"),
        F.col("value").alias("line"),
    )


def read_ncbi_tabular(spark: SparkSession, paths, nhits: int) -> DataFrame:
    return parse_ncbi_tabular(_text(spark, paths), nhits)


def read_ncbi_csv(spark: SparkSession, paths, nhits: int) -> DataFrame:
    return parse_ncbi_csv(_text(spark, paths), nhits)


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Expected taxonomy: the id column by name (else the first) and the four columns after it."""
    head, sep = _sniff(spark, path)
    names = [h.strip().lower() for h in head.lstrip("\ufeff").split(sep)]
    at = next((i for i, n in enumerate(names) if n in ID_NAMES), None)
    header = at is not None
    at = at or 0
    if len(names) < at + 5:
        raise ValueError("the id must be followed by order, family, genus and organism")
    schema = ", ".join(f"`_{i}` string" for i in range(len(names)))
    raw = spark.read.schema(schema).csv(path, sep=sep, header=header).withColumn("ord", F.monotonically_increasing_id())
    cols = ["sample", "q_order", "q_family", "q_genus", "q_organism"]
    ref = raw.select("ord", *[F.trim(F.coalesce(F.col(f"_{at + i}"), F.lit(""))).alias(c) for i, c in enumerate(cols)]).filter("sample <> ''")
    if ref.isEmpty():
        raise ValueError("no ids in the taxonomy table")
    return first_per(ref, ["sample"], ["ord"]).drop("ord")


def read_id_table(spark: SparkSession, path: str) -> DataFrame:
    """Identification table whose header row stands among the first five lines."""
    probe = [r.value for r in spark.read.text(path).limit(5).collect()]
    at = next((i for i, line in enumerate(probe) if "Query ID" in line), None)
    if at is None:
        raise ValueError("no row with 'Query ID' among the first five")
    sep = "\t" if "\t" in probe[at] else ","
    names = [n.strip() for n in probe[at].rstrip("\r").split(sep)]
    while names and not names[-1]:
        names.pop()
    if "ID%" not in names:
        raise ValueError("no column ID%")
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    lines = _text(spark, path).withColumn("_row", F.from_csv("line", F.lit(schema), {"sep": sep}))
    lines = lines.filter(F.trim(F.translate("line", sep, " ")) != "").filter(~F.col("line").isin(*probe[: at + 1]))
    cols = [F.trim(F.coalesce(F.col(f"_row.c{i}"), F.lit(""))).alias(n) for i, n in enumerate(names)]
    return lines.select("ord", *cols).withColumn("ID%", parse_number("`ID%`"))


def parse_lookup(rows: DataFrame) -> DataFrame:
    """Lookup fields by id from (ord, cells): the later row wins, empty fields left out."""
    named = rows.filter(F.get("cells", F.lit(0)).isNotNull() & (F.trim(F.get("cells", F.lit(0))) != ""))
    fields = F.filter(
        F.transform(F.filter(F.slice("cells", F.lit(2), F.greatest(F.size("cells"), F.lit(1))), lambda c: F.trim(c) != ""), normalize_cell),
        lambda c: F.rlike(c, F.lit(r"(?U)\p{Alnum}")),
    )
    keyed = named.select(normalize_cell(F.get("cells", F.lit(0))).alias("id"), "ord", fields.alias("fields"))
    return keyed.groupBy("id").agg(F.max_by("fields", "ord").alias("fields"))


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    _, sep = _sniff(spark, path)
    cells = _cells(_lines(spark, path), sep).filter("no > 0")
    return parse_lookup(cells.select(F.struct("path", "no").alias("ord"), "cells"))


def parse_patterns(lines: DataFrame) -> DataFrame:
    """Patterns from lines (a column value): trimmed, empty ones left out."""
    return lines.select(F.trim("value").alias("pattern")).filter("pattern <> ''")


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    patterns = parse_patterns(spark.read.text(path))
    if patterns.isEmpty():
        raise ValueError("the pattern file is empty")
    return patterns


def parse_run_summary(rows: DataFrame, root: str, prefix: str = "") -> DataFrame:
    """Runs from a summary's rows: number, folder (absolute, or a tag below ``root``) and parameters."""
    folder = F.when(F.startswith("Folder", F.lit("/")), F.col("Folder")).otherwise(F.concat(F.lit(f"{root.rstrip('/')}/{prefix}"), "Folder"))
    return rows.select(
        F.trim("Run").try_cast("int").alias("run"), folder.alias("folder"), parameter_map(F.coalesce("Parameters", F.lit(""))).alias("params")
    ).filter("run is not null")


def read_run_summary(spark: SparkSession, path: str, root: str, prefix: str = "") -> DataFrame:
    rows = spark.read.csv(path, sep="\t", header=True)
    if "Parameters" not in rows.columns:
        rows = rows.withColumn("Parameters", F.lit(""))
    return parse_run_summary(rows, root, prefix)


def latest_dim(parts: list[DataFrame]) -> DataFrame:
    """Dimension (key, value) over several caches; a later cache overrides an earlier one."""
    out = None
    for i, part in enumerate(parts):
        one = part.select("key", "value").withColumn("_i", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("key").agg(F.max_by("value", "_i").alias("value"))


def read_dim_cache(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Key and value files (tab-separated, value may hold tabs), later paths first to be believed."""
    parts = []
    for path in paths:
        line = spark.read.text(path).filter(F.contains("value", F.lit("\t")))
        parts.append(line.select(F.substring_index("value", "\t", 1).alias("key"), F.regexp_replace("value", r"^[^\t]*\t", "").alias("value")))
    return latest_dim(parts)
