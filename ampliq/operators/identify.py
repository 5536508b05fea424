"""Search hits, taxonomy and the choice of the best sequence per sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.headers import header_metrics, is_variant, sample_of_header
from ..functions.text import RANKS, agreement, compared, display_taxon, level_depth, lineage_fields, query_key
from ..session import cut
from .ordering import first_per, running, top_n_per

LEVELS = ["none", "order", "family", "genus", "organism"]
QUERY_TAX = [f"q_{r}" for r in RANKS]
HIT_TAX = [f"s_{r}" for r in RANKS]
# Points per ambiguity and per estimated gap, and the weight of the bit score.
AMB_PENALTY, GAP_PENALTY, BIT_WEIGHT = 2.0, 2.0, 100.0


# -- hit tables -------------------------------------------------------------------


def rank_hits(hits: DataFrame, order: list[Column | str], query: str = "query_name") -> DataFrame:
    """Number the hits of each query in source order; a search returns a bounded number of hits for one query."""
    return hits.withColumn("hit_rank", F.row_number().over(Window.partitionBy(query).orderBy(*order)).cast("bigint"))


def top_hits(hits: DataFrame, n: int, order: list[Column | str], query: str = "query_name") -> DataFrame:
    """At most ``n`` hits per query in the given order."""
    return top_n_per(hits, [query], order, n, number="hit_rank")


def filter_hits(hits: DataFrame, min_aln: float = 100) -> DataFrame:
    """Per query: hits in all and hits at least ``min_aln`` long."""
    return hits.groupBy("query_name").agg(
        F.count(F.lit(1)).alias("n_hits_raw"), F.count_if(F.col("alignment_length") >= min_aln).alias("n_hits")
    )


def hit_queries(hits: DataFrame) -> DataFrame:
    return hits.select("query_name").distinct()


def hit_counts(hits: DataFrame) -> DataFrame:
    """Rows and distinct queries per file."""
    per_query = hits.groupBy("file", "query_name").agg(F.count(F.lit(1)).alias("_n"))
    return per_query.groupBy("file").agg(F.sum("_n").alias("hits"), F.count(F.lit(1)).alias("queries"))


def unsorted_groups(hits: DataFrame, order: list[str], value: str, query: str = "query_name") -> DataFrame:
    """Queries in which ``value`` rises somewhere, although hits should come best first."""
    numbered = running(hits.select(query, value, *[o for o in order if o not in (query, value)]), order, keys=[query])
    numbered = cut(numbered.select(query, "rn", value))
    before = numbered.select(query, (F.col("rn") + 1).alias("rn"), F.col(value).alias("_prev"))
    return numbered.join(before, [query, "rn"]).filter(F.col(value) > F.col("_prev")).select(query).distinct()


def fix_blank_query(rows: DataFrame, order: list[str], mode: str = "rename", query: str = "query_name") -> DataFrame:
    """Drop rows without a query id, or name each run of consecutive ones ``No_query_ID_nn``."""
    blank = F.trim(F.coalesce(F.col(query), F.lit(""))) == ""
    if mode == "drop":
        return rows.filter(~blank)
    flagged = rows.withColumn("_blank", blank.cast("bigint"))
    placed = running(flagged, order, sums={"_seen": "_blank"}).withColumn("_island", F.col("rn") - F.col("_seen"))
    islands = running(placed.filter("_blank = 1").select("_island").distinct(), ["_island"], number="_no")
    number = F.col("_no").cast("string")
    name = F.concat(F.lit("No_query_ID_"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number))
    both = placed.join(islands.withColumn("_blank", F.lit(1).cast("bigint")), ["_island", "_blank"], "left")
    return both.select(*[F.when(F.col("_blank") == 1, name).otherwise(F.col(c)).alias(c) if c == query else F.col(c) for c in rows.columns])


# -- taxonomy ---------------------------------------------------------------------


def reference_table(ref: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Expected taxonomy with readable names; the first row of an id wins."""
    shown = ref.select("sample", *[c for c in order or [] if c not in ("sample", *QUERY_TAX)], *[F.coalesce(display_taxon(c), F.lit("")).alias(c) for c in QUERY_TAX])
    return first_per(shown, ["sample"], order or QUERY_TAX).select("sample", *QUERY_TAX)


def expected_names() -> Column:
    """A row's expected taxonomy as hits are compared with it."""
    return compared({r: display_taxon(f"q_{r}") for r in RANKS})


def lookup_taxonomy(samples: DataFrame, ref: DataFrame, names: str | None = None) -> DataFrame:
    """Add the expected taxonomy by exact sample id, else by lower-case id; ``known`` tells whether found.

    One join does both: the reference is keyed by lower-case id, and each key
    holds the few spellings that share it. ``names`` adds the ``expected_names``
    under that name, worked out once for a row of the reference, and the key
    ``_low`` by which the rows lie together.
    """
    tax = F.struct(*QUERY_TAX)
    if names:
        ref = ref.withColumn(names, expected_names())
        tax = F.struct(*QUERY_TAX, names)
    keyed = ref.groupBy(F.lower("sample").alias("_low")).agg(
        F.collect_list(F.struct("sample", tax.alias("tax"))).alias("_exact"), F.min_by(tax, "sample").alias("_any")
    )
    both = samples.withColumn("_low", F.lower("sample")).join(keyed, "_low", "left")
    own = F.get(F.filter("_exact", lambda e: e["sample"] == F.col("sample")), F.lit(0))["tax"]
    found = both.withColumn("_tax", F.coalesce(own, "_any"))
    return found.select(*samples.columns, *[F.coalesce(F.col(f"_tax.{c}"), F.lit("")).alias(c) for c in QUERY_TAX], F.col("_tax").isNotNull().alias("known"), *([F.col(f"_tax.{names}").alias(names), F.col("_low")] if names else []))


def with_level(rows: DataFrame, name: str) -> DataFrame:
    """Add the concordance of the hit and query taxonomy of each row; ``_own`` may hold the ``expected_names``, and is left out.

    The cleaned names are columns first, so that each is worked out once for a
    row. The step stays small: Java leaves a method above 8,000 bytes uncompiled.
    """
    shown = {f"_s_{r}": display_taxon(f"s_{r}") for r in RANKS}
    own = {} if "_own" in rows.columns else {"_own": expected_names()}
    level = agreement({r: F.col(f"_s_{r}") for r in RANKS}, F.col("_own"))
    return rows.withColumns(own | shown).withColumn(name, level).drop(*shown, "_own")


def apply_taxonomy(hits: DataFrame, ref: DataFrame, suffix: str = "", keep: bool = False) -> DataFrame:
    """Fill the expected taxonomy of each hit's sample and the rank at which they agree; ``keep`` leaves the key ``_low`` of the join."""
    bare = hits.drop(*[c for c in (*QUERY_TAX, "tax_level_match", "known") if c in hits.columns])
    keyed = bare.withColumn("sample", sample_of_header("query_name", suffix))
    return with_level(lookup_taxonomy(keyed, ref, "_own"), "tax_level_match").drop(*([] if keep else ["_low"]))


def taxonomy_counts(applied: DataFrame) -> DataFrame:
    """Rows seen, filled and without a known sample."""
    return applied.agg(
        F.count(F.lit(1)).alias("rows_seen"), F.count_if("known").alias("rows_filled"), F.count_if(~F.col("known")).alias("rows_unknown")
    )


def check_reference(samples: DataFrame, ref: DataFrame) -> DataFrame:
    """Each sample as found, near (equal without separators) or missing, and whether its taxonomy is empty."""

    def stripped(c):
        return F.regexp_replace(F.lower(c), r"[-_.\s]+", "")

    found = lookup_taxonomy(samples.select("sample").filter("sample <> ''").distinct(), ref)
    near = first_per(ref.select(stripped("sample").alias("_n"), F.col("sample").alias("near_id")), ["_n"], ["near_id"])
    out = found.withColumn("_n", stripped("sample")).join(near, "_n", "left")
    status = F.when(F.col("known"), "found").when(F.col("near_id").isNotNull(), "near").otherwise("missing")
    empty = F.col("known") & (F.concat(*QUERY_TAX) == "")
    return out.select("sample", status.alias("status"), F.when(status == "near", F.col("near_id")).alias("near_id"), empty.alias("empty_taxonomy"))


def reference_layout(ref: DataFrame) -> DataFrame:
    """Share of rank names that hold digits; above one half the columns are probably misplaced."""
    ranks = ref.select(F.explode(F.array(*QUERY_TAX[:3])).alias("v")).filter("v <> ''")
    share = F.avg(F.rlike("v", F.lit("[0-9]")).cast("double"))
    return ranks.agg(F.count(F.lit(1)).alias("names"), F.round(share, 6).alias("digit_share"), F.coalesce(share > 0.5, F.lit(True)).alias("suspicious"))


def enrich_hits(hits: DataFrame, organisms: DataFrame, lineages: DataFrame, marker: str = "Not_found_in_Taxonomy") -> DataFrame:
    """Accession to organism to lineage; ``resolved`` is false where a dimension has no entry."""
    both = hits.join(organisms.select("acc", "organism"), "acc", "left").join(
        lineages.select("organism", F.struct("kingdom", "class", "order", "family", "genus").alias("_l")), "organism", "left"
    )
    fields = lineage_fields(F.col("_l"), marker)
    return both.select(
        *hits.columns,
        F.coalesce("organism", F.lit("-")).alias("organism"),
        *[v.alias(k) for k, v in fields.items()],
        (F.col("organism").isNotNull() & F.col("_l").isNotNull()).alias("resolved"),
    )


# -- sequences and their hits -------------------------------------------------------


def attach_key(fasta: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """The query name of each record: its header, or the header with ``_`` for spaces."""
    named = queries.select(*keys, F.col("query_name")).distinct()
    exact = named.select(*keys, F.col("query_name").alias("header"), F.lit(True).alias("_hit"))
    out = fasta.join(exact, [*keys, "header"], "left")
    return out.withColumn("query_name", F.when(F.col("_hit") | ~F.contains("header", F.lit(" ")), F.col("header")).otherwise(query_key("header"))).drop("_hit")


def missing_seqs(fasta: DataFrame, answered: DataFrame) -> DataFrame:
    """Records whose query was never answered."""
    keyed = fasta.withColumn("query_name", query_key("header"))
    return keyed.join(answered.select("query_name").distinct(), "query_name", "left_anti").select(*fasta.columns)


def nohit_seqs(fasta: DataFrame, answered: DataFrame, hits: DataFrame) -> DataFrame:
    """Records that were answered without a hit."""
    keyed = fasta.withColumn("query_name", query_key("header"))
    done = keyed.join(answered.select("query_name").distinct(), "query_name", "left_semi")
    return done.join(hits.select("query_name").distinct(), "query_name", "left_anti").select(*fasta.columns)


def best_concordant_hit(hits: DataFrame, keys: list[str], min_aln: float = 100) -> DataFrame:
    """Per query: hit counts, its best agreeing hit and the level of its top hit.

    Short hits count but carry no taxonomy. Deepest level first, then bit
    score, then rank. The key ``_low``, which a query decides, spares a shuffle:
    the join has laid its hits together.
    """
    long = F.col("alignment_length") >= min_aln
    rows = with_level(hits, "level")
    fields = ["acc", "hit_rank", "p_identity", "alignment_length", "bit_score", *HIT_TAX, "level"]
    hit = F.struct(*fields)
    by_level = F.struct(level_depth("level"), F.col("bit_score"), -F.col("hit_rank"))
    by_bit = F.struct(F.col("bit_score"), -F.col("hit_rank"))
    low = [c for c in rows.columns if c == "_low"]
    best = rows.groupBy(*low, *keys, "query_name").agg(
        F.count(F.lit(1)).alias("n_hits_raw"),
        F.count_if(long).alias("n_hits"),
        F.first(F.struct(*QUERY_TAX)).alias("query_tax"),
        F.max_by(F.when(long, hit), F.when(long, by_level)).alias("best_hit"),
        F.max_by(F.when(long, F.col("level")), F.when(long, by_bit)).alias("top_level"),
    )
    # Names are cleaned once for a query, not for each of its hits.
    h = F.col("best_hit")
    shown = F.struct(*[(display_taxon(h[c]) if c in HIT_TAX else h[c]).alias(c) for c in fields])
    return best.drop(*low).withColumn("best_hit", F.when(h.isNotNull(), shown))


def best_hits(hits: DataFrame) -> DataFrame:
    """Best hit of each query for the report, with the number of its hits; with the key ``_low`` of the join no row moves."""
    order = F.struct(
        level_depth("tax_level_match"), F.col("bit_score"), F.col("p_identity"), -F.col("gap_opens"), -F.col("num_mismatches"), -F.col("hit_rank")
    )
    rest = [c for c in hits.columns if c not in ("query_name", "_low")]
    best = hits.groupBy(*[c for c in hits.columns if c == "_low"], "query_name").agg(F.max_by(F.struct(*rest), order).alias("_b"), F.count(F.lit(1)).alias("n_hits"))
    return best.select("query_name", "_b.*", "n_hits")


def score_candidates(cands: DataFrame) -> DataFrame:
    """Taxonomic bonus, bit score relative to the sample's best, minus the penalties."""
    top = F.max("bit").over(Window.partitionBy("sample"))
    relative = F.when(F.col("_top") > 0, F.col("bit") / F.col("_top")).otherwise(F.lit(0.0))
    score = 100.0 * level_depth("level") + BIT_WEIGHT * relative - AMB_PENALTY * F.col("ambs") - GAP_PENALTY * F.col("estgaps")
    return cands.withColumn("_top", top).withColumn("score", score).drop("_top")


def candidates(fasta: DataFrame, hits: DataFrame, ref: DataFrame, min_aln: float = 100, suffix: str = "") -> DataFrame:
    """One row per record (file, header, seq) with its metrics, taxonomy and best hit."""
    metrics = fasta.withColumn("_m", header_metrics("header", "seq")).select(*fasta.drop("sample").columns, "_m.*")
    tagged = lookup_taxonomy(hits.withColumn("sample", sample_of_header("query_name", suffix)), ref, "_own")
    # A record meets its query under the header, else under the header with ``_`` for spaces: one key does both, the few spellings that share it
    # travel together.
    best = best_concordant_hit(tagged, ["file"], min_aln)
    hit = F.struct("query_name", "n_hits", "n_hits_raw", "query_tax", "best_hit", "top_level")
    keyed = best.groupBy("file", query_key("query_name").alias("_k")).agg(F.collect_list(hit).alias("_hits"))
    out = metrics.withColumn("_k", query_key("header")).join(keyed, ["file", "_k"], "left")

    def named(name: Column) -> Column:
        return F.get(F.filter("_hits", lambda h: h["query_name"] == name), F.lit(0))

    out = out.withColumn("_h", F.coalesce(named(F.col("header")), named(F.col("_k")))).select(*metrics.columns, *[F.col(f"_h.{c}") for c in ("n_hits", "n_hits_raw", "query_tax", "best_hit", "top_level")])
    return out.select(
        "file", "header", "seq", "sample", "length", "coverage", "ambs", "estgaps",
        F.coalesce("n_hits", F.lit(0)).alias("n_hits"),
        F.coalesce("n_hits_raw", F.lit(0)).alias("n_hits_raw"),
        # The expected taxonomy travels with the hit table: no row, no taxonomy.
        *[F.coalesce(F.col(f"query_tax.{c}"), F.lit("")).alias(c) for c in QUERY_TAX],
        "best_hit",
        F.coalesce(F.col("best_hit.level"), F.lit("none")).alias("level"),
        F.coalesce("top_level", F.lit("none")).alias("top_level"),
        F.coalesce(F.col("best_hit.bit_score"), F.lit(0.0)).alias("bit"),
        is_variant("header").alias("variant"),
    )


def best_sequence(cands: DataFrame, n_files: int) -> DataFrame:
    """The candidate kept for each sample, how it was decided and what to look at."""
    # One shuffle by sample serves the best bit score, the ranks and the aggregates.
    scored = score_candidates(cands)
    order = [F.col("score").desc(), F.coalesce("length", F.lit(0)).desc(), F.coalesce("coverage", F.lit(0)).desc(), F.col("file"), F.col("header")]
    row = F.struct(*[c for c in scored.columns if c != "sample"])
    rn = F.col("_rn")
    both = scored.withColumn("_rn", F.row_number().over(Window.partitionBy("sample").orderBy(*order))).groupBy("sample").agg(
        F.min_by(row, rn).alias("_a"),
        F.max_by(F.when(rn == 2, row), F.when(rn == 2, 1)).alias("_b"),
        F.min_by(F.when(~F.col("variant"), row), F.when(~F.col("variant"), rn)).alias("_bc"),
        F.count(F.lit(1)).alias("n_candidates"),
        F.size(F.collect_set("file")).alias("n_files"),
        (F.min(F.upper("seq")) == F.max(F.upper("seq"))).alias("identical"),
    )
    overruled = F.col("_a.variant") & F.col("_bc").isNotNull() & (level_depth(F.col("_a.top_level")) <= level_depth(F.col("_bc.top_level")))
    chosen = both.withColumn("overruled", F.coalesce(overruled, F.lit(False)))
    chosen = chosen.withColumn("best", F.when(F.col("overruled"), F.col("_bc")).otherwise(F.col("_a")))
    chosen = chosen.withColumn("next", F.when(F.col("overruled"), F.col("_a")).otherwise(F.col("_b")))
    everywhere = F.col("n_files") == n_files
    decision = (
        F.when((F.col("n_candidates") == 1) & F.lit(n_files == 1), "single_run")
        .when(F.col("identical") & F.lit(n_files > 1) & (F.col("n_files") == 1), "only_one_run")
        .when(F.col("identical") & everywhere, "identical_in_all_runs")
        .when(F.col("identical"), "identical_in_available_runs")
        .otherwise("resolved_by_score")
    )
    b = F.col("best")
    unknown = F.concat(*[b[c] for c in QUERY_TAX]) == ""
    flags = F.array_compact(
        F.array(
            F.when(b["n_hits"] == 0, F.when(b["n_hits_raw"] > 0, "hits_below_min_aln").otherwise("no_blast_hit"))
            .when(unknown, "no_query_taxonomy")
            .when(b["level"] == "none", "tax_mismatch")
            .when(b["level"] == "order", "low_taxonomic_support"),
            F.when(~F.col("identical") & F.col("next").isNotNull() & (F.abs(b["score"] - F.col("next.score")) < 1.0), "near_tie"),
            F.when(~everywhere & F.lit(n_files > 1), F.concat(F.lit("missing_in_"), (n_files - F.col("n_files")).cast("string"), F.lit("_run(s)"))),
            F.when(b["variant"], "secondary_variant_selected"),
            F.when(b["ambs"] > 0, F.concat(F.lit("ambs="), b["ambs"].cast("string"))),
        )
    )
    shown = F.col("next").isNotNull() & ~F.col("identical")
    hit = b["best_hit"]
    return chosen.select(
        "sample", decision.alias("decision"), "n_candidates", "n_files",
        *[b[c].alias(c) for c in ("file", "header", "seq", "length", "coverage", "ambs", "estgaps", "n_hits", "n_hits_raw", "level", *QUERY_TAX)],
        *[hit[c].alias(c) for c in (*HIT_TAX, "acc", "p_identity", "alignment_length", "bit_score")],
        b["score"].alias("score"),
        F.when(shown, F.col("next.file")).alias("next_file"),
        F.when(shown, F.col("next.score")).alias("next_score"),
        F.array_join(flags, ";").alias("flags"),
        "overruled",
    )


def flag_counts(best: DataFrame) -> DataFrame:
    """How many samples carry each flag; counts of ambiguities are put together."""
    flag = best.filter("flags <> ''").select(F.explode(F.split("flags", ";")).alias("flag"))
    return flag.groupBy(F.substring_index("flag", "=", 1).alias("flag")).agg(F.count(F.lit(1)).alias("n"))


def split_identified(best: DataFrame) -> DataFrame:
    """Each best sequence in one of identified, no_blast_hit or tax_mismatch, with its reason."""
    group = F.when(F.col("level") != "none", "identified").when(F.col("n_hits") == 0, "no_blast_hit").otherwise("tax_mismatch")
    reason = (
        F.when((group == "no_blast_hit") & (F.col("n_hits_raw") > 0), "below_min_aln")
        .when((group == "tax_mismatch") & (F.concat(*QUERY_TAX) == ""), "no_query_tax")
        .otherwise("")
    )
    return best.withColumn("outcome", group).withColumn("reason", reason)


# -- identification report --------------------------------------------------------


def identify(queries: DataFrame, best: DataFrame, answered: DataFrame, has_reference: bool = True) -> DataFrame:
    """Category of every query: the level of its best hit, or why it has none."""
    names = queries.select("query_name").distinct()
    rows = names.join(best, "query_name", "left").join(
        answered.select("query_name", F.lit(True).alias("_answered")).dropDuplicates(["query_name"]), "query_name", "left"
    )
    known = F.concat(*[F.coalesce(display_taxon(c), F.lit("")) for c in QUERY_TAX]) != "" if has_reference else F.lit(False)
    hit_category = F.when(~known, "no_reference").otherwise(F.col("tax_level_match")) if has_reference else F.lit("blast_hit")
    category = (
        F.when(F.col("hit_rank").isNotNull(), hit_category)
        .when(F.col("_answered"), "no_hit")
        .otherwise("not_searched")
    )
    return rows.withColumn("category", category).drop("_answered")


def identification_summary(identified: DataFrame) -> DataFrame:
    """Queries per category and their share in percent."""
    counts = identified.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def identity_bins(best: DataFrame) -> DataFrame:
    p = F.col("p_identity")
    name = F.when(p >= 99, ">=99").when(p >= 97, "97-99").when(p >= 95, "95-97").otherwise("<95")
    return best.groupBy(name.alias("identity")).agg(F.count(F.lit(1)).alias("n"))


def review_counts(identified: DataFrame) -> DataFrame:
    """Queries to look at, by reason."""
    p = F.col("p_identity")
    return identified.agg(
        F.count_if((p > 0) & (p < 97)).alias("low_identity"),
        F.count_if(F.col("hit_rank") != 1).alias("best_not_first"),
        F.count_if(F.col("category") == "none").alias("no_agreement"),
        F.count_if(F.col("category") == "no_hit").alias("no_hit"),
        F.count_if(F.col("category") == "not_searched").alias("not_searched"),
    )


CATEGORIES = ["organism", "genus", "family", "order", "none", "no_reference", "no_hit", "not_searched"]


def identification_by_file(queries: DataFrame, identified: DataFrame) -> DataFrame:
    """Categories per input file side by side, with a total of distinct queries."""
    named = queries.select("file", "query_name").distinct().join(identified.select("query_name", "category"), "query_name")
    wide = named.groupBy("file").agg(
        *[F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES], F.count(F.lit(1)).alias("total")
    )
    overall = identified.agg(*[F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES], F.count(F.lit(1)).alias("total"))
    return wide.unionByName(overall.select(F.lit("Total").alias("file"), *CATEGORIES, "total"))
