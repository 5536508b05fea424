"""Work across runs: deduplication, coverage of the best sequences, two-run reports, parameter grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.headers import parse_div, variant_host
from ..functions.text import compress_ranges
from ..session import cut
from .ordering import first_per, running

# Sweep parameters with their type and allowed range.
PARAMETERS: dict[str, tuple] = {
    "minlen": ("int", 0, 5000),
    "explen": ("int", 0, 5000),
    "demlen": ("int", 0, 500),
    "primersearchlen": ("int", 10, 500),
    "primermismatch": ("int", 0, 30),
    "tagmm": ("int", 0, 5),
    "consfreqfixed": ("float", 0.05, 0.95),
    "consfreqmin": ("float", 0.05, 0.95),
    "consfreqmax": ("float", 0.05, 0.95),
    "consfreqstep": ("float", 0.01, 0.5),
    "mincoverage": ("int", 1, 5000),
    "coverage2b": ("int", 1, 5000),
    "gencode": ("enum", (1, 2, 3, 4, 5, 6, 9, 10, 11, 12, 13, 14, 16, 21, 22, 23, 24, 25, 26)),
    "lendev": ("int", 0, 500),
    "qclentol": ("int", 0, 300),
    "maxcoverage": ("int", 0, 100000),
    "minq": ("int", 0, 50),
    "resolve_mixed.enabled": ("bool",),
    "resolve_mixed.min_secondary_frac": ("percent", 10, 50),
    "resolve_mixed.tolerance": ("percent", 0, 40),
    "resolve_mixed.min_variant_reads": ("int", 1, 1000),
    "resolve_mixed.alert_divergence": ("percent", 1, 50),
}
# The parameters that decide demultiplexing.
DEMULTIPLEX_KEYS = ["minlen", "explen", "demlen", "minq", "tagmm", "primersearchlen", "primermismatch"]


# -- merge --------------------------------------------------------------------------


def dedup_runs(df: DataFrame) -> DataFrame:
    """Distinct sequences per sample over runs (run, ord, sample, header, seq), first producer kept.

    A sample with several sequences gets ``;run<N>`` on each header.
    """
    seqs = df.groupBy("sample", "seq").agg(F.min(F.struct("run", "ord", "header")).alias("_f"))
    counts = seqs.groupBy("sample").agg(F.count(F.lit(1)).alias("n_variants"))
    both = seqs.join(counts, "sample")
    header = F.when(F.col("n_variants") == 1, F.col("_f.header")).otherwise(
        F.concat("_f.header", F.lit(";run"), F.col("_f.run").cast("string"))
    )
    return both.select("sample", header.alias("header"), "seq", F.col("_f.run").alias("run"), F.col("_f.ord").alias("ord"))


def dedup_report(df: DataFrame, n_runs: int) -> DataFrame:
    """Per sample: distinct sequences, runs present, runs in all and their numbers as ranges."""
    seqs = df.select("sample", "seq").distinct().groupBy("sample").agg(F.count(F.lit(1)).alias("n_variants"))
    runs = df.groupBy("sample").agg(F.collect_set("run").alias("_r"))
    return seqs.join(runs, "sample").select(
        "sample", "n_variants", F.size("_r").cast("bigint").alias("n_runs_present"), F.lit(n_runs).cast("bigint").alias("n_runs_total"),
        compress_ranges(F.col("_r")).alias("runs"),
    )


def dedup_summary(report: DataFrame) -> DataFrame:
    """Samples, those with one sequence, those with several, sequences written."""
    one = F.col("n_variants") == 1
    return report.agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_if(one).alias("n_collapsed"), F.count_if(~one).alias("n_with_variants"), F.sum("n_variants").alias("n_written")
    )


def merge_runs(consensus: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """Deduplicated consensus records and, grouped by host sample, secondary variants."""
    out = dedup_runs(consensus).withColumn("kind", F.lit("consensus"))
    if variants is None:
        return out
    hosted = variants.withColumn("sample", variant_host("header"))
    return out.unionByName(dedup_runs(hosted).withColumn("kind", F.lit("variant")))


def variants_per_sample(variants: DataFrame) -> DataFrame:
    """Per run and host sample: variants by name (raw record preferred) and the largest divergence."""
    name = F.trim(F.substring_index("header", ";", 1))
    corrected = F.array_contains(F.split("header", ";"), "type=corrected")
    rows = variants.select("run", name.alias("name"), "ord", corrected.cast("int").alias("_c"), parse_div("header").alias("div"))
    kept = first_per(rows, ["run", "name"], ["_c", "ord"])
    host = F.regexp_replace("name", r"_var(?:(?!_var).)*$", "")
    return kept.groupBy("run", host.alias("sample")).agg(
        F.count(F.lit(1)).alias("n_variants"), F.max(F.when(~F.isnan("div"), F.col("div"))).alias("max_div")
    )


# -- two runs side by side -----------------------------------------------------------


def _last(df: DataFrame) -> DataFrame:
    """Last record of each sample in a run, in upper case; empty ones count as absent."""
    last = df.groupBy("sample").agg(F.upper(F.max_by("seq", "ord")).alias("seq"))
    return last


def compare_two(a: Mapping[str, DataFrame], b: Mapping[str, DataFrame], all_samples: bool = False) -> DataFrame:
    """Per-sample differences of two runs, each given as ``qc``, ``filtered`` and ``variants`` records."""
    out = None
    for side, run in (("a", a), ("b", b)):
        for kind in ("qc", "filtered"):
            part = _last(run[kind]).select("sample", F.col("seq").alias(f"{kind}_{side}"))
            out = part if out is None else out.join(part, "sample", "full")
        var = variants_per_sample(run["variants"].withColumn("run", F.lit(0))).select(
            "sample", F.col("n_variants").alias(f"variants_{side}"), F.col("max_div").alias(f"div_{side}")
        )
        out = out.join(var, "sample", "full")
    cats = []
    for kind, label in (("qc", "QC"), ("filtered", "filtered")):
        x, y = (F.coalesce(F.col(f"{kind}_{s}"), F.lit("")) for s in "ab")
        cats.append(
            F.when((x != "") & (y == ""), f"{label} barcode only in A")
            .when((x == "") & (y != ""), f"{label} barcode only in B")
            .when((x != "") & (x != y), f"{label} barcode differs")
        )
    na, nb = (F.coalesce(F.col(f"variants_{s}"), F.lit(0)) for s in "ab")
    cats.append(
        F.when((na == 0) & (nb > 0), "variants only in B").when((nb == 0) & (na > 0), "variants only in A").when(na != nb, "variant count differs")
    )
    changes = F.array_join(F.array_compact(F.array(*cats)), "; ")

    def yes(c: Column) -> Column:
        return F.when(c, "yes").otherwise("no")

    fa, fb = (F.coalesce(F.col(f"filtered_{s}"), F.lit("")) for s in "ab")
    rows = out.select(
        "sample",
        *[yes(F.col(f"qc_{s}").isNotNull()).alias(f"qc_{s}") for s in "ab"],
        yes(fa != "").alias("filtered_a"), yes(fb != "").alias("filtered_b"),
        F.when((fa != "") & (fb != ""), yes(fa == fb)).otherwise("").alias("same_filtered"),
        na.alias("variants_a"), nb.alias("variants_b"),
        *[
            F.when(F.col(f"div_{s}").isNotNull(), F.format_string("%.1f", F.col(f"div_{s}") * 100)).when(F.col(f"variants_{s}") > 0, "NA").otherwise("").alias(f"max_div_{s}")
            for s in "ab"
        ],
        changes.alias("changes"),
    )
    return rows if all_samples else rows.filter("changes <> ''")


def change_counts(report: DataFrame) -> DataFrame:
    change = report.filter("changes <> ''").select(F.explode(F.split("changes", "; ")).alias("change"))
    return change.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def identical_to_others(variants: DataFrame, barcodes: DataFrame) -> DataFrame:
    """Variants whose sequence is the final barcode of other samples, with how many.

    Barcodes are counted by sequence first, so a sequence that many samples
    share costs one row, and the variant's own sample is taken off again.
    """
    bars = barcodes.select(F.upper("seq").alias("_s"), "sample").distinct()
    shared = bars.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
    own = bars.withColumn("_own", F.lit(1))
    keyed = variants.withColumn("_s", F.upper("seq"))
    both = keyed.join(shared, "_s").join(own, ["_s", "sample"], "left")
    n = F.col("_n") - F.coalesce("_own", F.lit(0))
    return both.withColumn("n_others", n).filter("n_others > 0").select(*variants.columns, "n_others")


# -- which runs are needed -------------------------------------------------------------


def winner_coverage(winners: DataFrame, produced: DataFrame) -> DataFrame:
    """Each winner (label, host, seq) with each run that produced that sequence for that host."""
    have = produced.select("run", "host", F.upper("seq").alias("_s")).distinct()
    want = winners.select("label", "host", F.upper("seq").alias("_s"))
    return want.join(have, ["host", "_s"]).select("label", "run").distinct()


def run_sets(coverage: DataFrame) -> DataFrame:
    """How many winners are covered by exactly each set of runs.

    Winners with the same set of runs are interchangeable, so all later steps
    work on these sets; a set holds at most as many runs as there are.
    """
    sets = coverage.groupBy("label").agg(F.sort_array(F.collect_set("run")).alias("runs"))
    return sets.groupBy("runs").agg(F.count(F.lit(1)).alias("n"))


def minimal_runs(coverage: DataFrame) -> DataFrame:
    """Greedy choice of runs: each time the one covering most winners left, lowest number on ties."""
    spark = coverage.sparkSession
    run_type = dict(coverage.dtypes)["run"]
    sets = cut(run_sets(coverage))
    total = sets.agg(F.sum("n")).first()[0] or 0
    chosen: list = []
    rows, covered = [], 0
    while covered < total:
        left = sets
        if chosen:
            left = sets.filter(~F.arrays_overlap("runs", F.array(*[F.lit(r).cast(run_type) for r in chosen])))
        gain = left.select(F.explode("runs").alias("run"), "n").groupBy("run").agg(F.sum("n").alias("gain"))
        best = gain.orderBy(F.col("gain").desc(), "run").first()
        chosen.append(best["run"])
        covered += best["gain"]
        rows.append((len(chosen), best["run"], best["gain"], covered, round(100.0 * covered / total, 1)))
    return spark.createDataFrame(rows, f"step int, run {run_type}, gain long, covered long, covered_pct double")


def never_covered(winners: DataFrame, coverage: DataFrame) -> DataFrame:
    return winners.select("label").join(coverage.select("label").distinct(), "label", "left_anti")


def non_dominated_runs(coverage: DataFrame) -> DataFrame:
    """Runs whose winners are not all covered by one other run (of equal runs the lowest number stays)."""
    sets = run_sets(coverage)
    size = sets.select(F.explode("runs").alias("run"), "n").groupBy("run").agg(F.sum("n").alias("hits"))
    overlap = (
        sets.select(F.explode("runs").alias("run"), "runs", "n")
        .select("run", F.explode("runs").alias("other"), "n")
        .groupBy("run", "other")
        .agg(F.sum("n").alias("both"))
    )
    sized = overlap.join(size, "run").join(size.select(F.col("run").alias("other"), F.col("hits").alias("other_hits")), "other")
    inside = (F.col("both") == F.col("hits")) & (
        (F.col("other_hits") > F.col("hits")) | ((F.col("other_hits") == F.col("hits")) & (F.col("other") < F.col("run")))
    )
    return size.join(sized.filter(inside).select("run").distinct(), "run", "left_anti")


def coverage_summary(coverage: DataFrame, n_winners: int) -> DataFrame:
    """Winners reproduced by each run and their share of all winners."""
    hits = coverage.groupBy("run").agg(F.count(F.lit(1)).alias("hits"))
    return hits.withColumn("pct", F.round(100.0 * F.col("hits") / n_winners, 1))


def coverage_extremes(summary: DataFrame) -> DataFrame:
    """Best, worst and average run."""
    return summary.agg(
        F.max_by("run", F.struct("hits", -F.col("run"))).alias("best_run"), F.max("hits").alias("best_hits"),
        F.min_by("run", F.struct("hits", "run")).alias("worst_run"), F.min("hits").alias("worst_hits"), F.round(F.avg("hits"), 1).alias("average_hits"),
    )


# -- parameter combinations ---------------------------------------------------------------


def typed_parameter(key: str, raw: Column) -> Column:
    """Value of a sweep parameter as a number, checked against its range; percents become fractions."""
    if key not in PARAMETERS:
        raise ValueError(f"unknown sweep parameter {key!r}; known: {', '.join(sorted(PARAMETERS))}")
    kind, *limits = PARAMETERS[key]
    text = F.lower(F.trim(raw))
    if kind == "bool":
        value = F.when(text.isin("1", "true", "yes", "on"), 1.0).when(text.isin("0", "false", "no", "off"), 0.0)
        good = value.isNotNull()
    else:
        value = text.try_cast("double")
        if kind == "enum":
            value = value.cast("int").cast("double")
            good = value.isin(*[float(v) for v in limits[0]])
        else:
            good = value.between(*limits)
            value = value / 100.0 if kind == "percent" else (value.cast("int").cast("double") if kind == "int" else value)
    problem = F.concat(F.lit(f"{key}: unusable value "), F.coalesce(raw, F.lit("NULL")))
    return F.when(F.coalesce(good, F.lit(False)), value).otherwise(F.raise_error(problem).cast("double"))


def expand_grid(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All combinations of the values (key, value, pos) of each key, last key fastest, with the ``place`` of each value in its list.

    The lists are parameters and come to the driver; the grid does not: a
    combination's values are the digits of its number in the mixed radix of the
    lists' lengths, so ``spark.range`` spreads a grid of any size.
    """
    lists: dict[str, list] = {k: [] for k in keys}
    for r in values.filter(F.col("key").isin(list(keys))).orderBy("key", "pos", "value").collect():
        lists[r.key].append(r)
    size = prod(len(lists[k]) for k in keys)
    digit, below = {}, 1
    for k in reversed(keys):
        digit[k] = (F.floor(F.col("id") / below) % max(1, len(lists[k]))).cast("int")
        below *= len(lists[k])

    def pick(k: str, field: str, kind: str) -> Column:
        return F.get(F.array(*[F.lit(r[field]) for r in lists[k]]).cast(f"array<{kind}>"), digit[k])

    kind = dict(values.dtypes)["pos"]
    return values.sparkSession.range(size).select(
        F.struct(*[pick(k, "pos", kind).alias(f"p{i}") for i, k in enumerate(keys)]).alias("place"),
        *[typed_parameter(k, pick(k, "value", "string")).alias(k) for k in keys],
    )


def apply_overrides(combos: DataFrame, base: Mapping[str, float]) -> DataFrame:
    """Combinations over a base map; the minor-allele threshold follows a small secondary fraction."""
    out = combos
    for key, value in base.items():
        if key not in out.columns:
            out = out.withColumn(key, F.lit(float(value)))
    frac = "resolve_mixed.min_secondary_frac"
    if frac in out.columns:
        out = out.withColumn("resolve_mixed.minor_thresh", F.least(F.lit(0.2), F.col(f"`{frac}`")))
    return out


def phase1_reuse(combos: DataFrame, keys: Sequence[str], order: str = "run") -> DataFrame:
    """Whether each combination can reuse the demultiplexing of the one before it, in the order of a column that names each once."""
    key = F.struct(*[F.col(f"`{k}`") for k in keys])
    numbered = running(combos, [order], number="_n")
    before = numbered.select((F.col("_n") + 1).alias("_n"), key.alias("_before"))
    joined = numbered.join(before, "_n", "left").withColumn("reused", F.coalesce(F.col("_before") == key, F.lit(False)))
    return joined.select(*combos.columns, "reused")


def demultiplex_key(keys: Sequence[str] = tuple(DEMULTIPLEX_KEYS)) -> Column:
    """A short name for a combination's demultiplexing parameters: combinations with the same name share their reads per sample."""
    return F.substr(F.sha2(F.concat_ws("|", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("-"))) for k in keys]), 256), F.lit(1), F.lit(16))


def remaining_combinations(planned: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned combinations without a finished one."""
    return planned.join(done.select(*keys).distinct(), list(keys), "left_anti")
